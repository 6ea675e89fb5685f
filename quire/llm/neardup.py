"""Problem 5: near-duplicate records with small edits, complete at any collection size.

Tokens are runs of words (of characters in scripts without blanks).  They are hashed into groups
whose counts, over the whole collection, give one fixed order from rare to frequent: a sketch of
fixed size, built in one pass.  Two records whose similarity reaches t share at least K tokens
among their rarest (1 - t) n + K, so an equi-join on those tokens finds every pair.  A record's
point is its token count in each of GROUPS groups; the sum of coordinate minima of two points
bounds their overlap, and what is left is verified on all tokens.  The points are not indexed in
an R-tree: its boxes exclude next to nothing for hashed tokens (measured, see README), so the
order by rarity finds the candidates instead.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.sketch import pieces, total
from quire.session import cut_lineage, release

#: Cells of the count of tokens: as many as the collection has tokens, roughly, within these bounds (of 2^bits).
SKETCH_BITS = (16, 23)
#: More furniture lines than this in a row are a list.
FURNITURE_RUN = 4
GROUPS = 256
_WORD = re.compile(r"[^\W_]+")
_BREAK = re.compile(r"[-\xad\xac][ \t]*\r?\n[ \t]*")
_UNSPACED = re.compile(r"[฀-๿㐀-鿿]")
_U = np.uint64


class _Ids(dict):
    """Word -> 32-bit hash, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        v = xxhash.xxh32_intdigest(word)
        self[word] = v
        return v


_IDS = _Ids()


def body(text: str) -> str:
    """The text without its furniture, told by its place alone: lines without letters, short lines that
    stand alone between blank ones (headings, house lines), lines that come again in the same text.

    Furniture stands between lines of text; more than ``FURNITURE_RUN`` such lines one after the
    other are text themselves, a list or table, and stay.
    """
    lines = text.split("\n")
    plain = [x.strip() for x in lines]
    core = [x.strip("0123456789 ()[]{}.,-—–|·*") for x in plain]
    again = {}
    for c in core:
        if 8 < len(c) < 80:
            c = c.lower()
            again[c] = again.get(c, 0) + 1
    kept, run, last = [], [], len(lines) - 1
    for k, x in enumerate(lines):
        n = len(plain[k])
        if not n:
            continue
        if n < 100:
            alone = (k == 0 or not plain[k - 1]) and (k == last or not plain[k + 1])
            if alone or n <= 14 and not any(c.isalpha() for c in x) or n < 80 and again.get(core[k].lower(), 0) > 1:
                run.append(x)
                continue
        if len(run) > FURNITURE_RUN:
            kept += run
        run = []
        kept.append(x)
    if len(run) > FURNITURE_RUN or not kept:
        kept += run
    return "\n".join(kept)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    return (h ^ (h >> _U(29))) >> _U(32)


def tokens(text: str, run: int, char_run: int) -> np.ndarray:
    """Distinct 32-bit hashes of the word runs of the text's body."""
    text = body(text)
    low = _BREAK.sub("", text).lower()
    with np.errstate(over="ignore"):
        if not low or low.isascii() or np.frombuffer(low.encode("utf-32-le"), np.uint32).max() < 0xE00:
            unspaced = False
        else:
            unspaced = len(_UNSPACED.findall(low)) * 4 > len(low)
        if unspaced:
            c = np.frombuffer("".join(x for x in low if x.isalnum() or x > "ฯ" and not x.isspace() and x not in "。，！？、；：“”‘’「」").encode("utf-32-le"), np.uint32).astype(_U)
            n = len(c) - char_run + 1
            if n < 1:
                return np.zeros(0, np.uint32)
            h = np.zeros(n, _U)
            for k in range(char_run):
                h = h * _U(0x100000001B3) + c[k : n + k]
        else:
            ids = _IDS
            w = np.array([ids[x] for x in _WORD.findall(low)], _U)
            n = len(w) - run + 1
            if n < 1:
                return np.zeros(0, np.uint32)
            h = np.zeros(n, _U)
            for k in range(run):
                h = h * _U(0x9E3779B97F4A7C15) + w[k : n + k]
        return np.unique(_mix(h)).astype(np.uint32)


def group_counts(tok: np.ndarray) -> np.ndarray:
    """How many tokens fall into each of GROUPS groups: the record's point."""
    return np.bincount(tok % np.uint32(GROUPS), minlength=GROUPS)


def _survey(docs: DataFrame, kind: str, run: int, char_run: int, bits: int) -> DataFrame:
    """One pass over the texts: a partial sketch of token counts, every record's tokens and exact-copy key."""
    size = 1 << bits

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketch = np.zeros(size, np.uint32)
        for b in batches:
            rows = []
            for i, text in zip(b["id"], b["text"]):
                t = tokens(text, run, char_run)
                sketch[np.unique(t & np.uint32(size - 1))] += 1
                rows.append(("c", 0, xxhash.xxh3_128_digest(" ".join(text.split())), i, t.tobytes()))
            yield pd.DataFrame(rows, columns=["kind", "chunk", "blob", "id", "tok"])
        out = [("t", c, blob, None, None) for c, blob in pieces(sketch)]
        yield pd.DataFrame(out, columns=["kind", "chunk", "blob", "id", "tok"]).astype({"id": "Int64"} if kind in ("bigint", "int") else {})

    return docs.mapInPandas(look, f"kind string, chunk int, blob binary, id {kind}, tok binary")


def _sketch_bits(docs: DataFrame) -> int:
    """About one cell for every eight bytes that the planner expects to read."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return min(max((size // 8).bit_length(), SKETCH_BITS[0]), SKETCH_BITS[1])


def near_duplicates(docs: DataFrame, doc_id: str, text: str, similarity: float = 0.8, run: int = 5, char_run: int = 12, shared: int = 14):
    """(members, pairs) of near-duplicate records.

    ``members`` has every record's id and the id of its class of exact copies (equal but for
    blanks); ``pairs`` has class ids a < b and the similarity of those classes whose token sets
    have a Jaccard similarity of at least ``similarity``.  No pair between different texts is lost:
    the candidate search is exact for every record size and no group is capped.  Null ids or
    texts are no records; texts without a whole run of words pair with their exact copies only;
    repeated ids count once; an empty table gives no rows.
    """
    base = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).filter("id is not null and text is not null")
    kind = dict(base.dtypes)["id"]
    bits = _sketch_bits(base)
    survey = cut_lineage(_survey(base, kind, run, char_run, bits))
    copies = survey.filter("kind = 'c'").select("id", "blob")
    classes = copies.groupBy("blob").agg(F.min("id").alias("class_id"), F.count_distinct("id").alias("n"))
    doubled = classes.filter("n > 1").select("blob", "class_id")
    members = cut_lineage(copies.join(doubled, "blob").select("id", "class_id").distinct())
    rest = members.filter("id <> class_id").select("id").distinct()
    # one byte a cell; 0 stands for counts of at most one, of which no cell's token can have more
    sums = np.maximum(total(survey.filter("kind = 't'"), bits), 1)
    order = docs.sparkSession.sparkContext.broadcast((np.log2(sums) * 8).astype(np.uint8))
    t = similarity
    held = survey.filter("kind = 'c'").select("id", "tok")

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = order.value
        for b in batches:
            heads, ids, ns = [], [], []
            for i, blob in zip(b["id"].tolist(), b["tok"].tolist()):
                tok = np.frombuffer(blob, np.uint32)
                n = len(tok)
                if not n:
                    continue
                top = min(n, int(n * (1 - t)) + 1 + shared)
                key = counts[tok & np.uint32((1 << bits) - 1)].astype(np.uint64) << _U(32) | tok
                key = np.sort(np.partition(key, top - 1)[:top] if top < n else key)
                alone = int(np.searchsorted(key, _U(1 << 32)))  # these stand in no other record
                heads.append(np.arange(alone, top, dtype=np.int64) << 32 | (key[alone:] & _U(0xFFFFFFFF)).astype(np.int64))
                ids.append(np.full(top - alone, i))
                ns.append(np.full(top - alone, n, np.int32))
            if heads:
                yield pd.DataFrame({"id": np.concatenate(ids), "n": np.concatenate(ns), "head": np.concatenate(heads)})

    # a head holds a token in its lower half and the token's place in the record's order in its upper one
    heads = held.join(rest, "id", "left_anti").mapInPandas(prefixes, f"id {kind}, n int, head bigint")
    token, pos = (lambda c: F.col(c).bitwiseAND(0xFFFFFFFF)), (lambda c: F.shiftright(F.col(c), 32))
    # both sides are one exchange
    x, y = heads.repartition(token("head")).alias("x"), heads.repartition(token("head")).alias("y")
    need = F.ceil(t / (1 + t) * (F.col("x.n") + F.col("y.n")) - 1e-9)
    least = F.least(F.lit(shared), need)
    near = x.join(y, token("x.head") == token("y.head")).filter(
        (F.col("x.id") < F.col("y.id")) & (F.col("x.n") >= t * F.col("y.n")) & (F.col("y.n") >= t * F.col("x.n"))
        & (pos("x.head") < F.col("x.n") - need + least) & (pos("y.head") < F.col("y.n") - need + least)
    )
    found = near.groupBy(F.col("x.id").alias("a"), F.col("y.id").alias("b")).agg(F.count(F.lit(1)).alias("c"), F.max(least).alias("k")).filter("c >= k")
    found = cut_lineage(found.select("a", "b"))
    links = found.select("a", "b", F.explode(F.array("a", "b")).alias("id"))
    joined = held.join(links, "id")
    both = joined.groupBy("a", "b").agg(F.max(F.when(F.col("id") == F.col("a"), F.col("tok"))).alias("ta"), F.max(F.when(F.col("id") == F.col("b"), F.col("tok"))).alias("tb"))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = []
            for i, j, ta, tb in zip(x["a"], x["b"], x["ta"], x["tb"]):
                u, v = np.frombuffer(ta, np.uint32), np.frombuffer(tb, np.uint32)
                n = len(u) + len(v)
                # the overlap is at most the sum of the smaller of each group's counts
                if np.minimum(group_counts(u), group_counts(v)).sum() * (1 + t) < t * n - 1e-9:
                    continue
                k = len(np.intersect1d(u, v, assume_unique=True))
                if k / (n - k) >= t:
                    out.append((i, j, k / (n - k)))
            yield pd.DataFrame(out, columns=["a", "b", "similarity"])

    pairs = both.mapInPandas(verify, f"a {kind}, b {kind}, similarity double")
    return members, pairs


def all_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs of records, classes of copies written out: (a, b), a < b.

    Quadratic in the size of a class of exact copies; ``clusters`` is the form that is not.
    """
    m = members.select(F.col("class_id").alias("k"), F.col("id").alias("m"))
    left = pairs.join(m.toDF("a", "ma"), "a", "left").select(F.coalesce("ma", "a").alias("x"), "b")
    both = left.join(m.toDF("b", "mb"), "b", "left").select("x", F.coalesce("mb", "b").alias("y"))
    same = m.toDF("k", "x").join(m.toDF("k", "y"), "k").filter("x < y").select("x", "y")
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).union(same).distinct()


def clusters(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, cluster_id): connected records, by least ids spread along pairs and pointers doubled.

    Only records with a copy or partner come out.  Rounds, each written to the
    shared folder, go on until nothing changes; their number is logarithmic in the longest chain.
    """
    edges = cut_lineage(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.select("b", "a")).union(members.select("id", "class_id")).union(members.select("class_id", "id")).distinct())
    state = cut_lineage(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("r")))
    while True:
        spread = edges.join(state.toDF("v", "rv"), "v").groupBy("u").agg(F.min("rv").alias("m"))
        low = state.join(spread, "u").select("u", F.least("r", "m").alias("r"))
        hop = low.join(low.toDF("r", "rr"), "r", "left").select("u", F.coalesce("rr", "r").alias("r2"))
        new = cut_lineage(hop.toDF("u", "r"))
        done = new.join(state.toDF("u", "old"), "u").filter("r <> old").isEmpty()
        release(state)
        state = new
        if done:
            break
    return state.toDF("id", "cluster_id")
