"""Problem 1: items that appear together, against a bipartite configuration null.

Item pairs, items and record sizes are counted exactly; everything else works on that table of
cells, whose size is the number of distinct pairs.  The null model is
the maximum-entropy bipartite graph that keeps every item's frequency and every basket's size
in expectation: item i stands in basket s with probability x_i y_s / (1 + x_i y_s).  Items of
equal frequency and baskets of equal size share their parameter, so the fit runs over classes
(some ten thousand at most, whatever the number of records) and not over items or baskets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.session import cut_lineage

#: Largest pair count whose tail is summed term by term; beyond it a saddlepoint formula is used.
EXACT_COUNT = 48


#: Records of more items are split into blocks of about so many, so that no task holds one whole.
BLOCK = 256


def incidences(rows: DataFrame, record: Sequence[Column], item: Column) -> DataFrame:
    """Distinct (r, s, item): the record as a key of 96 bits; a null item stands for the record itself."""
    named = [c for col in record for c in (col.isNull(), col)]  # nulls are values: (null, x) is not (x, null)
    keyed = rows.select(F.xxhash64(*named).alias("r"), F.hash(*named).alias("s"), item.cast("string").alias("item"))
    both = keyed.select("r", "s", F.explode(F.array_distinct(F.array(F.col("item"), F.lit(None).cast("string")))).alias("item"))
    return both.groupBy("r", "s", "item").agg(F.lit(1).alias("_1")).drop("_1")


def cells(flat: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b, size, n): pairs a<b, single items a=b, and with a=b=null the histogram of record sizes.

    A record of up to ``block`` items is one row; the items of a larger one are spread by hash over
    blocks, and every pair of its blocks is a row of its own.
    """
    sizes = cut_lineage(flat.groupBy("r", "s").agg(F.count("item").alias("k")))
    large = sizes.filter(F.col("k") > block).withColumn("nb", F.ceil(F.col("k") / block).cast("int"))  # at most incidences / block rows
    items = flat.filter("item is not null")
    small = items.join(large.select("r", "s"), ["r", "s"], "left_anti").groupBy("r", "s").agg(F.sort_array(F.collect_list("item")).alias("v"))
    first = small.select("v", F.posexplode("v").alias("i", "a"))
    near = first.select("a", F.explode(F.slice("v", F.col("i") + 1, F.lit(block))).alias("b"))
    spread = items.join(large, ["r", "s"]).withColumn("x", F.pmod(F.xxhash64("item"), F.col("nb")).cast("int"))
    spread = spread.select("r", "s", "item", "x", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("y"))
    lo, hi = F.least("x", "y"), F.greatest("x", "y")
    two = spread.groupBy("r", "s", lo.alias("lo"), hi.alias("hi")).agg(F.collect_list(F.when(F.col("x") == lo, F.col("item"))).alias("u"), F.collect_list(F.when(F.col("x") == hi, F.col("item"))).alias("w"))
    cross = two.select("lo", "hi", F.explode("u").alias("p"), "w").select("lo", "hi", "p", F.explode("w").alias("q")).filter((F.col("lo") < F.col("hi")) | (F.col("p") <= F.col("q")))
    pairs = near.union(cross.select(F.least("p", "q"), F.greatest("p", "q"))).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    hist = sizes.groupBy(F.col("k").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    no = F.lit(None).cast("string")
    return pairs.select("a", "b", F.lit(None).cast("bigint").alias("size"), "n").union(hist.select(no, no, "size", "n"))


def fit_null(degrees: np.ndarray, items: np.ndarray, sizes: np.ndarray, records: np.ndarray, tol: float = 1e-9, rounds: int = 100_000):
    """Parameters (x by item degree, y by basket size) whose expected degrees and sizes equal the observed.

    ``items[i]`` items have degree ``degrees[i]``; ``records[s]`` baskets have size ``sizes[s]``.
    A fit that has not converged after ``rounds`` is an error.
    """
    degrees, items, sizes, records = (np.asarray(v, float) for v in (degrees, items, sizes, records))
    total = max((degrees * items).sum(), 1.0)
    x, y = degrees / np.sqrt(total), sizes / np.sqrt(total)
    n, v = records.sum(), items.sum()
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.outer(x, y))
        nx = np.where(degrees >= n, 1e12, degrees / np.maximum((p * (y * records)).sum(1), 1e-300))
        p = 1.0 / (1.0 + np.outer(nx, y))
        ny = np.where(sizes >= v, 1e12, sizes / np.maximum((p * (nx * items)[:, None]).sum(0), 1e-300))
        change = max(np.max(np.abs(nx - x) / np.maximum(nx, 1e-300), initial=0), np.max(np.abs(ny - y) / np.maximum(ny, 1e-300), initial=0))
        x, y = nx, ny
        if change < tol:
            return x, y
    raise RuntimeError(f"the null model has not converged: change {change:.1e}")


def _pmf(q: np.ndarray, n: np.ndarray, top: int) -> np.ndarray:
    """P(X = 0 .. top) of sums of binomials, one row per pair, by convolution."""
    pmf = np.zeros((len(q), top + 1))
    pmf[:, 0] = 1
    for s in range(q.shape[1]):
        b = np.zeros_like(pmf)
        b[:, 0] = np.exp(n[s] * np.log1p(-q[:, s]))
        r = q[:, s] / (1 - q[:, s])
        for m in range(top):
            b[:, m + 1] = b[:, m] * max(n[s] - m, 0) / (m + 1) * r
        pmf = np.stack([(pmf[:, : m + 1] * b[:, m::-1]).sum(1) for m in range(top + 1)], 1)
    return pmf


def poisson_binomial_tail(q: np.ndarray, n: np.ndarray, count: np.ndarray) -> np.ndarray:
    """P(X >= count) for X a sum of n[s] Bernoulli(q[row, s]) variables, one row per pair.

    Counts up to ``EXACT_COUNT`` are summed exactly by convolving the classes' binomials; where
    1 - P(X < count) has no digits left, the terms from the count upwards are.  Larger counts take
    the Lugannani-Rice formula with the lattice correction, on both sides of the mean.
    """
    q = np.clip(q, 0.0, 1 - 1e-12)
    mean = (q * n).sum(1)
    out = np.ones(len(q))
    small = np.flatnonzero((count <= EXACT_COUNT) & (mean < 500))
    if len(small):
        k = count[small].astype(int)
        below = np.cumsum(np.concatenate([np.zeros((len(small), 1)), _pmf(q[small], n, int(k.max()))], 1), 1)
        out[small] = 1 - below[np.arange(len(small)), k]
        tiny = np.flatnonzero(out[small] < 1e-9)
        if len(tiny):
            k = k[tiny]
            upper = np.cumsum(_pmf(q[small[tiny]], n, int(k.max()) + 64)[:, ::-1], 1)[:, ::-1]
            out[small[tiny]] = upper[np.arange(len(tiny)), k]
    rest = np.setdiff1d(np.arange(len(q)), small)
    if len(rest):
        out[rest] = _saddlepoint(q[rest], n, count[rest].astype(float))
    return np.clip(out, 0, 1)


def _saddlepoint(q: np.ndarray, n: np.ndarray, count: np.ndarray) -> np.ndarray:
    t = np.zeros(len(q))
    target = np.minimum(count, n.sum() - 1e-6)
    for _ in range(80):
        e = np.exp(t)[:, None]
        p = q * e / (1 - q + q * e)
        k1, k2 = (n * p).sum(1), np.maximum((n * p * (1 - p)).sum(1), 1e-12)
        step = np.clip((target - k1) / k2, -1, 1)
        t = t + step
        if np.max(np.abs(step), initial=0) < 1e-10:
            break
    t = np.where(np.abs(t) < 1e-5, 1e-5, t)  # the formula has a gap at the mean
    k = (n * np.log1p(q * np.expm1(t)[:, None])).sum(1)
    w = np.sign(t) * np.sqrt(np.maximum(2 * (t * target - k), 1e-16))
    u = -np.expm1(-t) * np.sqrt(k2)
    phi = np.exp(-w * w / 2) / np.sqrt(2 * np.pi)
    upper = 0.5 * np.array([math.erfc(v / math.sqrt(2)) for v in w])
    got = upper + phi * (1 / u - 1 / w)
    return np.where(np.isfinite(got), np.maximum(got, 0), upper)


def false_discovery(df: DataFrame, p: str, tests: Column) -> DataFrame:
    """Benjamini-Hochberg q values over ``tests`` tests, without a global one-task sort.

    Equal p values are first merged and the distinct ones cut into ranges of equal number; ranks
    come from the ranges' counts (one row per range) and a window inside the range.  p = 1 is q = 1.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = df.filter(F.col(p) < 1).groupBy(p).agg(F.count(F.lit(1)).alias("_c"))
    distinct = cut_lineage(distinct.repartitionByRange(ranges, p).withColumn("_band", F.spark_partition_id()))
    inside = Window.partitionBy("_band").orderBy(p).rowsBetween(Window.unboundedPreceding, 0)
    sums = distinct.groupBy("_band").agg(F.sum("_c").alias("_bc"))
    below = Window.orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = sums.select("_band", F.coalesce(F.sum("_bc").over(below), F.lit(0)).alias("_start"))
    ranked = distinct.join(starts, "_band").withColumn("_raw", F.col(p) * tests / (F.col("_start") + F.sum("_c").over(inside)))
    mins = ranked.groupBy("_band").agg(F.min("_raw").alias("_bm"))
    above = Window.orderBy(F.desc("_band")).rowsBetween(Window.unboundedPreceding, -1)
    mins = mins.select("_band", F.min("_bm").over(above).alias("_after"))
    later = Window.partitionBy("_band").orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)
    q = ranked.join(mins, "_band").select(p, F.least(F.min("_raw").over(later), F.col("_after"), F.lit(1.0)).alias("q_value"))
    # one row per distinct value: the frequent ones fall on the side that a skewed join may split
    return df.filter(F.col(p) < 1).join(cut_lineage(q), p).unionByName(df.filter(F.col(p) >= 1).withColumn("q_value", F.lit(1.0)))


def _at(m: np.ndarray, degree: np.ndarray, x: np.ndarray, records: float) -> np.ndarray:
    """The parameter of items of frequency ``m``, between those of the classes."""
    return np.where(m >= records, 1e12, np.exp(np.interp(np.log(m), np.log(degree), np.log(x)))) if len(degree) else m


def cooccurrence(rows: DataFrame, record: Sequence[Column], item: Column, surprise: bool = True) -> DataFrame:
    """Exact counts of item pairs over records, with their surprise under the configuration null.

    Returns item_a < item_b, n_ab, n_a, n_b, n_records, lift and, with ``surprise``, expected,
    p_value and q_value.  A record is a distinct value of the ``record`` columns, nulls being
    values like others; a null item counts for no item, a record without items still counts as
    a record, repeated rows count once, and an empty input gives no rows.
    """
    c = cut_lineage(cells(cut_lineage(incidences(rows, record, item))))
    single = c.filter(F.col("a") == F.col("b")).select(F.col("a").alias("item"), F.col("n").alias("m"))
    hist = c.filter(F.col("a").isNull())
    total = hist.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_records"))
    pairs = c.filter(F.col("a") < F.col("b")).select("a", "b", F.col("n").alias("n_ab"))
    pairs = (
        pairs.join(single.toDF("a", "n_a"), "a").join(single.toDF("b", "n_b"), "b").crossJoin(F.broadcast(total))  # one row
        .select(F.col("a").alias("item_a"), F.col("b").alias("item_b"), "n_ab", "n_a", "n_b", "n_records",
                (F.col("n_ab") * F.col("n_records") / (F.col("n_a") * F.col("n_b"))).alias("lift"))
    )
    if not surprise:
        return pairs
    # the fit runs over classes: every frequency up to 1,000, above that ranges of a tenth of a per cent
    m, n = F.col("m"), F.count(F.lit(1))
    d = single.groupBy(F.when(m <= 1000, m).otherwise(1000 + F.floor(F.log(m / 1000.0) * 1000)).alias("_class")).agg(F.avg("m").alias("m"), n.alias("count")).orderBy("m").toPandas()
    k = F.col("size")
    h = hist.filter("size > 0").groupBy(F.when(k <= 1000, k).otherwise(1000 + F.floor(F.log(k / 1000.0) * 1000)).alias("_class")).agg((F.sum(k * F.col("n")) / F.sum("n")).alias("size"), F.sum("n").alias("n")).orderBy("size").toPandas()
    degree, sizes, records = d["m"].to_numpy(float), h["n"].to_numpy(float), float(h["n"].sum())
    x, y = fit_null(degree, d["count"], h["size"], sizes)
    items = float(d["count"].sum())

    def tails(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pa = [1 / (1 + 1 / np.maximum(np.outer(_at(b[k].to_numpy(float), degree, x, records), y), 1e-300)) for k in ("n_a", "n_b")]
            q = pa[0] * pa[1]
            yield b.assign(expected=(q * sizes).sum(1), p_value=poisson_binomial_tail(q, sizes, b["n_ab"].to_numpy()))

    schema = "item_a string, item_b string, n_ab bigint, n_a bigint, n_b bigint, n_records bigint, lift double, expected double, p_value double"
    tested = cut_lineage(pairs.mapInPandas(tails, schema))  # read for the q values and for the rows
    return false_discovery(tested, "p_value", F.lit(items * (items - 1) / 2)).select(*[f.split()[0] for f in schema.split(", ")], "q_value")
