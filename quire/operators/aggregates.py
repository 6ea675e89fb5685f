"""Counts, rates, keyness, indices and profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.stats import g2, log_ratio
from quire.functions.text import az_words, ocr_garbage
from quire.session import cut_lineage


def counts_by_document(m: DataFrame, group: str) -> DataFrame:
    return m.groupBy("doc_id", F.col(group).alias("group")).agg(F.count(F.lit(1)).alias("n"), F.max("doc_sent_count").alias("sentences"))


def document_rates(counts: DataFrame) -> DataFrame:
    """Mentions per ten thousand sentences; an unknown length counts as one sentence."""
    return counts.withColumn("rate", 10000.0 * F.col("n") / F.greatest(F.coalesce("sentences", F.lit(0)), F.lit(1)))


def rates(m: DataFrame, group: str) -> DataFrame:
    """Sum of mentions and mean and median rate over the documents where the group occurs."""
    r = document_rates(counts_by_document(m, group))
    return r.groupBy("group").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("documents"), F.avg("rate").alias("mean_rate"), F.expr("percentile(rate, 0.5)").alias("median_rate"))


def bootstrap_mean(values: DataFrame, group: str, value: str, key: str, resamples: int = 1000, seed: int = 42, least: int = 2) -> DataFrame:
    """95 % interval of each group's mean, numpy's generator seeded anew for every group.

    A group's values are reduced to (value, count) before they meet in one task.
    """
    counted = values.groupBy(F.col(group).alias("group"), F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("v")
        v, c = b["v"].to_numpy(), b["c"].to_numpy()
        n = int(c.sum())
        mean = float((v * c).sum() / n)
        if n < least:
            return pd.DataFrame({"group": [b["group"].iloc[0]], "mean": [mean], "low": [mean], "high": [mean]})
        draws = np.random.default_rng(seed).multinomial(n, c / n, resamples) @ v / n
        lo, hi = np.percentile(draws, [2.5, 97.5])
        return pd.DataFrame({"group": [b["group"].iloc[0]], "mean": [mean], "low": [float(lo)], "high": [float(hi)]})

    return counted.groupBy("group").applyInPandas(run, "group string, mean double, low double, high double")


def word_counts(texts: DataFrame, side: Column, text: str, stop: list[str], least: int = 2) -> DataFrame:
    w = texts.select(side.alias("side"), F.explode(az_words(F.col(text))).alias("word")).filter((F.length("word") >= least) & ~F.col("word").isin(stop))
    return w.groupBy("side", "word").agg(F.count(F.lit(1)).alias("n"))


def _score(j: DataFrame, least: int) -> DataFrame:
    j = j.filter((F.col("freq_focus") >= least) & ~ocr_garbage(F.col("word")))
    args = [F.col(c).cast("double") for c in ("freq_focus", "freq_ref", "n_focus", "n_ref")]
    return j.withColumns({"g2": g2(*args), "log_ratio": log_ratio(*args)})


def keyness_against(texts: DataFrame, label: str, text: str, stop: list[str], reference: str = "neutral", least: int = 2) -> DataFrame:
    """Every label's words against those of the reference label (none: all scores are 0)."""
    c = cut_lineage(word_counts(texts, F.col(label), text, stop))  # read three times
    totals = c.groupBy("side").agg(F.sum("n").alias("t"))
    ref = c.filter(F.col("side") == reference).select("word", F.col("n").alias("freq_ref"))
    n_ref = totals.filter(F.col("side") == reference).agg(F.coalesce(F.sum("t"), F.lit(0)).alias("n_ref"))
    f = c.filter(F.col("side") != reference).select(F.col("side").alias("comparison"), "word", F.col("n").alias("freq_focus"))
    j = f.join(ref, "word", "left").join(F.broadcast(totals.select(F.col("side").alias("comparison"), F.col("t").alias("n_focus"))), "comparison").crossJoin(F.broadcast(n_ref))  # few labels; one row
    return _score(j.withColumn("freq_ref", F.coalesce("freq_ref", F.lit(0))), least)


def keyness_rest(texts: DataFrame, label: str, text: str, stop: list[str], least: int = 2) -> DataFrame:
    """Every label's words against all others' together: the rest is the total less the label."""
    c = cut_lineage(word_counts(texts, F.col(label), text, stop))  # read three times
    by_word = c.groupBy("word").agg(F.sum("n").alias("w"))
    by_side = c.groupBy("side").agg(F.sum("n").alias("n_focus"))
    total = c.agg(F.sum("n").alias("t"))
    j = c.join(by_word, "word").join(by_side, "side").crossJoin(F.broadcast(total))  # one row
    j = j.select(F.col("side").alias("comparison"), "word", F.col("n").alias("freq_focus"), (F.col("w") - F.col("n")).alias("freq_ref"), "n_focus", (F.col("t") - F.col("n_focus")).alias("n_ref"))
    return _score(j, least)


def top_by(df: DataFrame, group: str, order: list, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("rank") <= k)


def garbage_words(texts: DataFrame, text: str) -> DataFrame:
    w = texts.select(F.explode(az_words(F.col(text))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return w.filter(ocr_garbage(F.col("word")))


def concordance(sentences: DataFrame, text: str, key: list[str], words: int = 10, lines: int = 3, span: int = 50) -> DataFrame:
    """Up to ``lines`` places of each of the most frequent words, with ``span`` characters on either side."""
    low = F.lower(F.col(text))
    tokens = sentences.filter(F.length(text) >= 10).select(*key, text, F.explode(F.array_distinct(F.filter(F.split(low, r"\s+"), lambda w: F.length(w) >= 3))).alias("word"))
    top = tokens.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(words)
    hit = tokens.join(F.broadcast(top), "word")  # at most ``words`` rows
    hit = top_by(hit, "word", key, lines)
    at = F.instr(F.lower(F.col(text)), F.col("word"))
    left = F.substring(F.col(text), F.greatest(at - span, F.lit(1)), F.least(at - 1, F.lit(span)))
    return hit.select("word", "n", *key, "rank", left.alias("left"), F.substring(F.col(text), at, F.length("word")).alias("match"), F.substring(F.col(text), at + F.length("word"), F.lit(span)).alias("right"))


def agency(edges: DataFrame) -> DataFrame:
    """(out - in) / (out + in) of each entity over edge counts."""
    both = edges.select(F.col("src").alias("entity"), F.col("n").alias("s"), F.col("n").alias("t")).unionByName(edges.select(F.col("dst").alias("entity"), (-F.col("n")).alias("s"), F.col("n").alias("t")))
    return both.groupBy("entity").agg((F.sum("s") / F.sum("t")).alias("agency"))


def othering(labelled: DataFrame) -> DataFrame:
    """Share of negative and exotic mentions."""
    return labelled.groupBy("ethnos_norm").agg(F.avg(F.col("r_label").isin("negative", "exotic").cast("int")).alias("oi"), F.count(F.lit(1)).alias("mentions"))


def polarity(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("ethnos_norm").agg(F.avg(F.when(F.col("r_label") == "negative", 1).when(F.col("r_label") == "positive", -1).otherwise(0)).alias("eps"))


def essential_density(table: DataFrame, labelled: DataFrame) -> DataFrame:
    """Essentialising sentences per mention; entities of either side, 0 without mentions."""
    n = labelled.groupBy("ethnos_norm").agg(F.count(F.lit(1)).alias("n"))
    j = table.select("ethnos_norm", F.col("n").alias("e")).join(n, "ethnos_norm", "full_outer")
    return j.select("ethnos_norm", F.when(F.coalesce("n", F.lit(0)) > 0, F.coalesce("e", F.lit(0)) / F.col("n")).otherwise(0.0).alias("ed"))


def profiles(labelled: DataFrame, essential: DataFrame, edges: DataFrame, n_sentences: DataFrame) -> DataFrame:
    """One row per entity: counts, indices, shares and differences from the weighted mean."""
    share = lambda c: F.avg(c.cast("int"))
    base = labelled.groupBy("ethnos_norm").agg(
        F.count(F.lit(1)).alias("mentions"), share(F.col("r_label").isin("negative", "exotic")).alias("oi"),
        F.avg(F.when(F.col("r_label") == "negative", 1).when(F.col("r_label") == "positive", -1).otherwise(0)).alias("eps"),
        share(F.col("r_label") == "uncertain").alias("uncertain_r"), share(F.col("o_label") == "unknown").alias("unknown_o"), share(F.col("is_noise")).alias("noise_share"))
    j = base.join(essential_density(essential, labelled), "ethnos_norm", "left").join(agency(edges), base.ethnos_norm == F.col("entity"), "left").drop("entity")
    j = cut_lineage(j.crossJoin(F.broadcast(n_sentences)))  # one row; the profiles are one row per entity
    j = j.withColumns({"mentions_norm": F.col("mentions") * 10000.0 / F.greatest("n_sentences", F.lit(1)), "agency": F.coalesce("agency", F.lit(0.0)), "ed": F.coalesce("ed", F.lit(0.0))}).drop("n_sentences")
    # the entities are as many as the lexicon has; their weighted means are one row
    means = j.agg(*[(F.sum(F.col(c) * F.col("mentions")) / F.sum("mentions")).alias(f"_{c}") for c in ("oi", "eps", "ed", "agency")])
    j = j.crossJoin(F.broadcast(means))
    return j.withColumns({f"{c}_delta": F.col(c) - F.col(f"_{c}") for c in ("oi", "eps", "ed", "agency")}).drop("_oi", "_eps", "_ed", "_agency")


def contingency(df: DataFrame, a: str, b: str, yates: bool = True) -> DataFrame:
    """Chi square, degrees of freedom, Cramer's V and the cells expected below five, as one row.

    Only cells with rows are stored; an absent cell adds its expected count. With one degree of
    freedom the continuity correction applies, as is usual. Empty tables give nulls.
    """
    c = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("o"))
    ra, rb, t = c.groupBy("a").agg(F.sum("o").alias("na")), c.groupBy("b").agg(F.sum("o").alias("nb")), c.agg(F.sum("o").alias("n"))
    # the classes of both sides are few: their product is the table itself
    full = ra.crossJoin(rb).join(c, ["a", "b"], "left").crossJoin(F.broadcast(t)).withColumn("o", F.coalesce("o", F.lit(0)))
    e = F.col("na") * F.col("nb") / F.col("n")
    full = full.withColumn("e", e)
    d = F.abs(F.col("o") - F.col("e"))
    s = full.agg(F.sum(d * d / F.col("e")).alias("x"), F.sum(F.pow(F.greatest(d - F.least(F.lit(0.5), d), F.lit(0.0)), 2) / F.col("e")).alias("y"), F.count_distinct("a").alias("r"), F.count_distinct("b").alias("k"), F.max("n").alias("n"), F.sum((F.col("e") < 5).cast("int")).alias("low_expected"))
    dof = (F.col("r") - 1) * (F.col("k") - 1)
    chi = F.when((dof == 1) & F.lit(yates), F.col("y")).otherwise(F.col("x"))
    v = F.when((F.least("r", "k") > 1) & (F.col("n") > 0), F.sqrt(chi / (F.col("n") * (F.least("r", "k") - 1))))
    return s.select(chi.alias("chi2"), dof.alias("dof"), v.alias("cramers_v"), F.col("low_expected"), F.col("n"), (F.col("r") * F.col("k")).alias("cells"))


def correlations(df: DataFrame, columns: list[str], ranks: bool = False) -> DataFrame:
    """Pairwise Pearson or Spearman coefficients; ties share their mean rank. For tables of entities."""
    if ranks:
        for c in columns:
            n = F.count(F.lit(1)).over(Window.partitionBy(c))
            df = df.withColumn(f"_{c}", F.rank().over(Window.orderBy(c)) + (n - 1) / 2)
        df = df.select(*[F.col(f"_{c}").alias(c) for c in columns])
    pairs = [(x, y) for i, x in enumerate(columns) for y in columns[i + 1 :]]
    one = df.agg(*[F.corr(x, y).alias(f"{x}|{y}") for x, y in pairs])
    return one.select(F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"{x}|{y}").alias("r")) for x, y in pairs])).alias("p")).select("p.*")


def purity(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """Share of rows in their cluster's largest class, over clusters 0 and up; share of -1."""
    c = df.groupBy(cluster, label).agg(F.count(F.lit(1)).alias("n"))
    top = c.groupBy(cluster).agg(F.max("n").alias("m"), F.sum("n").alias("n"))
    good = F.col(cluster) >= 0
    return top.agg((F.sum(F.when(good, F.col("m"))) / F.sum(F.when(good, F.col("n")))).alias("purity"), (F.sum(F.when(~good, F.col("n")).otherwise(0)) / F.sum("n")).alias("noise_ratio"))


def kmeans(df: DataFrame, columns: list[str], ks: tuple[int, ...] = (2, 3, 4, 5), seed: int = 42) -> DataFrame:
    """Adds ``cluster`` by the k of the best silhouette; too few rows are one cluster."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import VectorAssembler

    v = VectorAssembler(inputCols=columns, outputCol="features").transform(df.na.fill(0.0, columns))
    v = cut_lineage(v)  # read once for every k
    n = v.limit(max(ks) + 1).count()
    best, score = v.withColumn("cluster", F.lit(0)), -2.0
    for k in [k for k in ks if k < n]:
        out = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(v).transform(v)
        s = ClusteringEvaluator(featuresCol="features", predictionCol="cluster").evaluate(out)
        if s > score:
            best, score = out, s
    return best.drop("features")


def surface_forms(m: DataFrame, k: int = 15) -> DataFrame:
    c = m.filter("ethnos_norm is not null").groupBy("ethnos_norm", F.lower("ethnos_raw").alias("form")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("ethnos_norm"))
    return top_by(c.withColumn("total", total).withColumn("pct", F.bround(100.0 * F.col("n") / F.col("total"), 1)), "ethnos_norm", [F.desc("n"), "form"], k)


def crosstab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    return df.groupBy(row).pivot(column, values).agg(F.count(F.lit(1))).na.fill(0)


def r_by_entity(m: DataFrame, entities: list[str] | None = None, examples: int = 3) -> DataFrame:
    """Counts of R labels and of negative examples (at most ``examples``) per entity; ``entities`` names the wanted ones, None all."""
    c = lambda *k: F.count_if(F.col("r_label").isin(*k))
    ids = F.count_distinct(F.when(F.col("r_label") == "negative", F.col("mention_id")))
    some = m.filter(F.col("ethnos_norm").isNotNull() if entities is None else F.col("ethnos_norm").isin(entities))
    return some.groupBy("ethnos_norm").agg(F.count(F.lit(1)).alias("n"), c("negative").alias("negative"), c("exotic").alias("exotic"), F.least(F.lit(examples), ids).cast("int").alias("examples"))


def distribution(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts of every value of several columns in one pass."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(each.alias("x")).groupBy("x.dimension", "x.value").agg(F.count(F.lit(1)).alias("n"))


def stratified(df: DataFrame, group: str, order: list[str], groups: int = 30, most: int = 1000) -> DataFrame:
    """The first rows of the ``groups`` largest groups in equal parts, filled up from the rest in order; ``order`` tells every row."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), group).limit(groups)
    few = df.join(F.broadcast(sizes.select(group)), group)  # at most ``groups`` rows
    ranked = few.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("_r") <= most // groups)
    first = ranked.select(*df.columns, F.lit(0).alias("_f"))
    # of the first rows in order at most ``most`` are among those already: twice as many are enough to fill up
    rest = df.orderBy(*order).limit(2 * most).withColumn("_f", F.lit(1))
    both = first.unionByName(rest).withColumn("_k", F.row_number().over(Window.partitionBy(*order).orderBy("_f"))).filter("_k = 1")
    return both.orderBy("_f", *order).limit(most).drop("_f", "_k")


def hash_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """``n`` rows drawn by the hash of their key: the same ones in every run."""
    return df.orderBy(F.md5(F.col(key).cast("string")), key).limit(n)


def token_costs(log: DataFrame, input_price: float = 0.27, output_price: float = 1.10) -> DataFrame:
    """Totals and cost of a call log, prices per million tokens."""
    i, o = F.coalesce(F.sum("input_tokens"), F.lit(0)), F.coalesce(F.sum("output_tokens"), F.lit(0))
    return log.agg(i.alias("input_tokens"), o.alias("output_tokens"), ((i * input_price + o * output_price) / 1e6).alias("cost"))


def summary(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """(metric, value) rows of several aggregates in one pass."""
    one = df.agg(*[v.cast("double").alias(k) for k, v in metrics.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in metrics])).alias("x")).select("x.*")


def top_values(df: DataFrame, limits: dict[str, int]) -> DataFrame:
    """The commonest values of several columns: (dimension, value, n, rank), ties by value."""
    d = distribution(df, list(limits)).filter("value is not null")
    r = d.withColumn("rank", F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("n"), "value")))
    most = F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(v))])
    return r.filter(F.col("rank") <= most[F.col("dimension")])


def embedding_clusters(df: DataFrame, vector: str, k: int = 8, seed: int = 42) -> DataFrame:
    """Adds ``cluster`` and a two-dimensional projection (x, y) of a vector column."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = df.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))
    v = cut_lineage(v)  # read by the clusters and by the projection
    c = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(v).transform(v)
    p = PCA(k=2, inputCol="features", outputCol="_p").fit(v).transform(c)
    xy = vector_to_array("_p")
    return p.withColumns({"x": xy[0], "y": xy[1]}).drop("features", "_p")
