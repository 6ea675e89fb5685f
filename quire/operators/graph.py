"""Co-mention and interaction networks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.mentions import entity_matches, positions
from quire.session import cut_lineage


def entity_sets(sentences: DataFrame, groups: dict[str, list[str]], doc_id: str, index: str, text: str, windows: tuple[int, ...] = (2,)) -> DataFrame:
    """(w, doc_id, sent_idx, entities): distinct entities within w sentences of every sentence.

    Each sentence is searched once; all windows are frames over the same shuffle.
    """
    own = F.array_sort(F.array_distinct(F.transform(entity_matches(F.coalesce(F.col(text), F.lit("")), groups), lambda m: m["entity"])))
    s = sentences.select(F.col(doc_id).alias("doc_id"), F.col(index).alias("sent_idx"), own.alias("own"))
    frame = lambda w: Window.partitionBy("doc_id").orderBy("sent_idx").rowsBetween(-w, w)
    each = [F.struct(F.lit(w).alias("w"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("own").over(frame(w))))).alias("entities")) for w in windows]
    s = s.select("doc_id", "sent_idx", F.array(*each).alias("each"))
    return s.select("doc_id", "sent_idx", F.explode("each").alias("x")).select("x.w", "doc_id", "sent_idx", "x.entities")


def pairs_of(sets: DataFrame) -> DataFrame:
    """(w, a, b, n): contexts that hold both, a < b, pre-aggregated per task."""
    many = sets.filter(F.size("entities") > 1)
    a = many.select("w", F.posexplode("entities").alias("i", "a"), "entities")
    b = a.select("w", "a", F.explode(F.slice("entities", F.col("i") + 2, F.size("entities"))).alias("b"))
    return b.groupBy("w", "a", "b").agg(F.count(F.lit(1)).alias("n"))


def singles_of(sets: DataFrame) -> DataFrame:
    return sets.select("w", F.explode("entities").alias("entity")).groupBy("w", "entity").agg(F.count(F.lit(1)).alias("m"))


def jaccard(sets: DataFrame) -> DataFrame:
    """All pairs of entities seen, pairs never together with 0. The entities are those of the lexicon."""
    s, p = singles_of(sets), pairs_of(sets)
    x, y = s.toDF("w", "a", "na"), s.toDF("w2", "b", "nb")
    grid = x.join(y, (x.w == y.w2) & (x.a < y.b)).drop("w2").join(p, ["w", "a", "b"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return grid.select("w", "a", "b", "n", F.round(F.col("n") / (F.col("na") + F.col("nb") - F.col("n")), 4).alias("jaccard"))


def npmi(sets: DataFrame) -> DataFrame:
    s, p = singles_of(sets), pairs_of(sets)
    t = sets.groupBy("w").agg(F.count(F.lit(1)).alias("t"))
    j = p.join(s.toDF("w", "a", "na"), ["w", "a"]).join(s.toDF("w", "b", "nb"), ["w", "b"]).join(t, "w")
    pmi = F.log2(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))
    return j.select("w", "a", "b", "n", F.when(F.col("n") == F.col("t"), 0.0).otherwise(pmi / -F.log2(F.col("n") / F.col("t"))).alias("npmi"))


def window_sensitivity(sets: DataFrame, base: int = 2, top: int = 30) -> DataFrame:
    """Edges per window and the overlap of its strongest ones with those of the base window."""
    p = pairs_of(sets)
    r = p.withColumn("r", F.row_number().over(Window.partitionBy("w").orderBy(F.desc("n"), "a", "b"))).filter(F.col("r") <= top)
    edges = p.groupBy("w").agg(F.count(F.lit(1)).alias("edges"))
    ref = r.filter(F.col("w") == base).select("a", "b").withColumn("in_base", F.lit(1))
    j = r.join(ref, ["a", "b"], "left").groupBy("w").agg(F.sum(F.coalesce("in_base", F.lit(0))).alias("overlap"), F.count(F.lit(1)).alias("k"))
    n_base = ref.agg(F.count(F.lit(1)).alias("kb"))
    return edges.join(j, "w").crossJoin(F.broadcast(n_base)).select("w", "edges", "overlap", (F.col("overlap") / F.greatest(F.least("k", "kb"), F.lit(1))).alias("ratio"))


def plain_interactions(sentences: DataFrame, groups: dict[str, list[str]], verbs: dict[str, list[str]], fit: Column, doc_id: str, index: str, text: str) -> DataFrame:
    """Edges of plain text, where no parse gives roles: the first two different entities of a sentence
    with a verb of a group, of low confidence, once per verb group."""
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z]+"), F.lit(0))
    kinds = F.filter(F.array(*[F.when(F.arrays_overlap(words, F.array(*map(F.lit, v))), F.lit(k)) for k, v in sorted(verbs.items())]), lambda x: x.isNotNull())
    s = sentences.filter(fit).select(F.col(doc_id).alias("doc_id"), F.col(index).alias("sent_idx"), F.col(text).alias("sentence_text"), F.explode(kinds).alias("type"), entity_order(F.col(text), groups).alias("m"))
    s = s.filter(F.size("m") >= 2)
    return s.select("doc_id", "sent_idx", F.get("m", F.lit(0)).alias("src"), F.get("m", F.lit(1)).alias("dst"), "type", F.lit("low").alias("confidence"), F.left("sentence_text", F.lit(300)).alias("quote"))


def entity_order(text: Column, groups: dict[str, list[str]]) -> Column:
    """array<string>: the entities of a text in the order of their first places, ties by name."""
    places = positions(F.lower(F.coalesce(text, F.lit(""))), groups)
    if places is None:
        return F.array().cast("array<string>")
    return F.array_distinct(F.transform(F.array_sort(F.transform(places, lambda m: F.named_struct(F.lit("start"), m["start"], F.lit("entity"), m["entity"]))), lambda m: m["entity"]))


def parsed_interactions(tokens: DataFrame, verbs: dict[str, list[str]], entity: Column | None = None) -> DataFrame:
    """Edges of annotated sentences (doc_id, sent_idx, tokens, entities array<string>).

    A verb's subject and object that are both entities give a high edge; one of them with another
    entity of the sentence a medium one; none present, but two entities, a low one.
    """
    named = {w: k for k, v in verbs.items() for w in v}  # a verb of several groups belongs to the last
    group = F.create_map(*[F.lit(x) for kv in named.items() for x in kv])
    t = tokens.withColumn("v", F.explode("tokens")).withColumn("type", F.coalesce(group[F.lower("v.lemma")], group[F.lower("v.text")])).filter("type is not null")
    t = t.withColumns({"_s": F.try_element_at(F.filter("tokens", lambda c: (c["head_i"] == F.col("v.i")) & (c["i"] != F.col("v.i")) & c["dep"].isin(["nsubj", "nsubjpass"])), F.lit(-1))["text"],
                       "_o": F.try_element_at(F.filter("tokens", lambda c: (c["head_i"] == F.col("v.i")) & (c["i"] != F.col("v.i")) & c["dep"].isin(["dobj", "pobj", "obj", "iobj"])), F.lit(-1))["text"]})
    def alike(c: str):
        # a token names an entity if one is the other, bar a plural s, or begins with the other
        w = F.lower(F.col(c))
        return lambda e: (w == F.lower(e)) | (w == F.concat(F.lower(e), F.lit("s"))) | (F.rtrim(w, F.lit("s")) == F.lower(e)) | F.startswith(w, F.lower(e)) | F.startswith(F.lower(e), w)

    match = lambda c: F.try_element_at(F.filter("entities", alike(c)), F.lit(1))
    t = t.withColumns({"src": match("_s"), "dst": match("_o")})
    other = lambda c: F.try_element_at(F.filter("entities", lambda e: e != F.col(c)), F.lit(1))
    both = F.col("src").isNotNull() & F.col("dst").isNotNull()
    one = F.col("src").isNotNull() | F.col("dst").isNotNull()
    none = F.col("_s").isNull() & F.col("_o").isNull() & (F.size("entities") >= 2)
    t = t.withColumns({
        "confidence": F.when(both, "high").when(one, "medium").when(none, "low"),
        "a": F.when(both, F.col("src")).when(F.col("src").isNotNull(), F.col("src")).when(F.col("dst").isNotNull(), other("dst")).when(none, F.get("entities", F.lit(0))),
        "b": F.when(both, F.col("dst")).when(F.col("src").isNotNull(), other("src")).when(F.col("dst").isNotNull(), F.col("dst")).when(none, F.try_element_at("entities", F.lit(2))),
    })
    return t.filter("confidence is not null and a is not null and b is not null and a <> b").select("doc_id", "sent_idx", F.col("a").alias("src"), F.col("b").alias("dst"), "type", "confidence", F.lit("").alias("quote"))


def edges_of(hits: DataFrame, quotes: int = 3) -> DataFrame:
    """Typed edges with counts by confidence, the commonest confidence (ties upward) and a few quotes."""
    h = hits.filter("src is not null and dst is not null and src <> dst")
    n = lambda c: F.count_if(F.col("confidence") == c)
    e = h.groupBy("src", "dst", "type").agg(F.count(F.lit(1)).alias("n"), n("high").alias("high"), n("medium").alias("medium"), n("low").alias("low"))
    q = h.groupBy("src", "dst", "type", "quote").agg(F.min(F.struct("doc_id", "sent_idx")).alias("at"))
    q = q.withColumn("r", F.row_number().over(Window.partitionBy("src", "dst", "type").orderBy("at", "quote"))).filter(F.col("r") <= quotes)
    q = q.groupBy("src", "dst", "type").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "quote"))), lambda x: x["quote"]).alias("examples"))
    best = F.when((F.col("high") >= F.col("medium")) & (F.col("high") >= F.col("low")), "high").when(F.col("medium") >= F.col("low"), "medium").otherwise("low")
    return e.withColumn("confidence", best).join(q, ["src", "dst", "type"])


def robust_edges(edges: DataFrame, least: int = 2, confidences: tuple[str, ...] = ("high", "medium")) -> DataFrame:
    return edges.filter((F.col("n") >= least) & F.col("confidence").isin(*confidences))


def degrees(edges: DataFrame) -> DataFrame:
    b = edges.select(F.col("src").alias("node"), F.col("n").alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.col("n").alias("i")))
    d = b.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    return d.withColumns({"degree": F.col("out_degree") + F.col("in_degree"), "balance": F.col("out_degree") - F.col("in_degree")})


def graph_metrics(edges: DataFrame) -> DataFrame:
    """Nodes, edges (types merged), density, reciprocity and mean weighted degree, as one row."""
    e = edges.groupBy("src", "dst").agg(F.sum("n").alias("n"))
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst")).withColumn("back", F.lit(1))
    s = e.join(back, ["src", "dst"], "left").agg(F.count(F.lit(1)).alias("edges"), F.sum(F.coalesce("back", F.lit(0))).alias("r"), F.sum("n").alias("t"))
    nodes = e.select(F.explode(F.array("src", "dst")).alias("x")).agg(F.count_distinct("x").alias("nodes"))
    k = F.col("nodes")
    return s.crossJoin(F.broadcast(nodes)).select("nodes", "edges", (F.col("edges") / F.when(k > 1, k * (k - 1))).alias("density"), (F.col("r") / F.col("edges")).alias("reciprocity"),
                                                  (2.0 * F.col("t") / k).alias("mean_degree"), (2.0 * F.col("t") / F.when(k > 1, k * (k - 1))).alias("weighted_density"))


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 40) -> DataFrame:
    """Weighted PageRank, the mass of nodes without way out spread evenly; written out every ten rounds."""
    e = cut_lineage(edges.groupBy("src", "dst").agg(F.sum("n").cast("double").alias("n")))
    nodes = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    out = e.groupBy("src").agg(F.sum("n").alias("t"))
    e = cut_lineage(e.join(out, "src").select("src", "dst", (F.col("n") / F.col("t")).alias("p")))
    nodes = cut_lineage(nodes.join(out.select(F.col("src").alias("node"), F.lit(1).alias("has")), "node", "left"))
    k = nodes.count()
    rank = nodes.withColumn("rank", F.lit(1.0 / max(k, 1)))
    for i in range(rounds):
        lost = rank.agg(F.coalesce(F.sum(F.when(F.col("has").isNull(), F.col("rank"))), F.lit(0.0)).alias("lost"))
        sent = e.join(rank.select(F.col("node").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("p") * F.col("rank")).alias("got"))
        rank = nodes.join(sent, "node", "left").crossJoin(F.broadcast(lost)).select("node", "has", ((1 - damping) / max(k, 1) + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / max(k, 1))).alias("rank"))
        if i % 5 == 4:
            rank = cut_lineage(rank)
    return rank.select("node", "rank")


def betweenness(edges: DataFrame, most_edges: int = 5_000_000) -> DataFrame:
    """Normalised betweenness with weights as distances.

    The nodes are the lexicon's entities, so every task can hold the whole graph (a larger one is
    an error); the searches, one from every node, are shared out among the tasks and summed.
    """
    e = cut_lineage(edges.groupBy("src", "dst").agg(F.sum("n").cast("double").alias("n")))
    if e.limit(most_edges + 1).count() > most_edges:
        raise ValueError(f"betweenness is for graphs of at most {most_edges} edges")
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def brandes(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        import heapq

        names = sorted(set(b["src"]) | set(b["dst"]))
        near: dict[str, list] = {v: [] for v in names}
        for s, d, n in zip(b["src"], b["dst"], b["n"]):
            near[s].append((d, n))
        score = dict.fromkeys(names, 0.0)
        for s in names[key[0] :: parts]:
            dist, paths, back, done, heap = {s: 0.0}, {s: 1.0}, {v: [] for v in names}, [], [(0.0, s)]
            closed = set()
            while heap:
                d, v = heapq.heappop(heap)
                if v in closed:
                    continue
                closed.add(v)
                done.append(v)
                for w, c in near[v]:
                    x = d + c
                    if w not in dist or x < dist[w] - 1e-12:
                        dist[w], paths[w], back[w] = x, paths[v], [v]
                        heapq.heappush(heap, (x, w))
                    elif abs(x - dist[w]) <= 1e-12 and w not in closed:
                        paths[w] += paths[v]
                        back[w].append(v)
            gain = dict.fromkeys(names, 0.0)
            for w in reversed(done):
                for v in back[w]:
                    gain[v] += paths[v] / paths[w] * (1 + gain[w])
                if w != s:
                    score[w] += gain[w]
        k = len(names)
        f = 1.0 / ((k - 1) * (k - 2)) if k > 2 else 1.0
        return pd.DataFrame({"node": names, "betweenness": [score[v] * f for v in names]})

    shared = e.withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).groupBy("_g").applyInPandas(brandes, "node string, betweenness double")
    return shared.groupBy("node").agg(F.sum("betweenness").alias("betweenness"))


def edge_stability(hits: DataFrame, resamples: int = 50, top: int = 20, least: int = 2, confidences: tuple[str, ...] = ("high", "medium"), seed: int = 42) -> DataFrame:
    """Share of document resamples in which each of the strongest edges stays robust.

    Edges are counted once per document; a resample only weights documents, by Poisson draws from
    a hash of document and resample, so nothing is extracted again and nothing is collected.
    """
    per = hits.filter("src is not null and dst is not null and src <> dst").groupBy("doc_id", "src", "dst", "type").agg(*[F.count_if(F.col("confidence") == c).alias(c) for c in ("high", "medium", "low")])
    per = cut_lineage(per)
    strongest = edges_of(hits).orderBy(F.desc("n"), "src", "dst", "type").limit(top).select("src", "dst", "type", "n")
    cuts, total, term = [], 0.0, np.exp(-1.0)
    for k in range(8):
        total += term
        cuts.append(float(total))
        term /= k + 1
    u = (F.pmod(F.xxhash64("doc_id", "sample", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30))
    draw = sum((F.when(u >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    w = per.join(F.broadcast(strongest.select("src", "dst", "type")), ["src", "dst", "type"]).withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))).withColumn("m", draw)  # ``top`` rows
    s = w.groupBy("sample", "src", "dst", "type").agg(*[F.sum(F.col(c) * F.col("m")).alias(c) for c in ("high", "medium", "low")])
    best = F.when((F.col("high") >= F.col("medium")) & (F.col("high") >= F.col("low")), "high").when(F.col("medium") >= F.col("low"), "medium").otherwise("low")
    ok = (F.col("high") + F.col("medium") + F.col("low") >= least) & best.isin(*confidences)
    return strongest.join(s.groupBy("src", "dst", "type").agg((F.count_if(ok) / resamples).alias("stability")), ["src", "dst", "type"], "left").withColumn("stability", F.coalesce("stability", F.lit(0.0)))


def mirrored(pairs: DataFrame, *values: str) -> DataFrame:
    """Both directions of undirected edges, for reports."""
    return pairs.select("a", "b", *values).unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), *values))


def role_class(phrase: Column, entities: list[str], agents: list[str]) -> Column:
    """ETHNOS, IMPERIAL_AGENT or OTHER, by the names that a subject or object phrase holds."""
    low = F.lower(F.coalesce(phrase, F.lit("")))
    has = lambda names: F.exists(F.array(*[F.lit(n.lower()) for n in names]), lambda n: F.contains(low, n)) if names else F.lit(False)
    return F.when(has(entities), "ETHNOS").when(has(agents), "IMPERIAL_AGENT").otherwise("OTHER")


def role_counts(roles: DataFrame, subject: str, object_: str) -> DataFrame:
    """How often each class acts and is acted on, and the share of its roles in which it acts."""
    each = roles.select(F.col(subject).alias("role"), F.lit(1).alias("s"), F.lit(0).alias("o")).unionByName(roles.select(F.col(object_).alias("role"), F.lit(0).alias("s"), F.lit(1).alias("o")))
    return each.groupBy("role").agg(F.sum("s").alias("as_subject"), F.sum("o").alias("as_object")).withColumn("subject_share", F.col("as_subject") / (F.col("as_subject") + F.col("as_object")))
