from collections import Counter

import pytest
from pyspark.sql import functions as F

from quire.llm.packing import pack
from quire.llm.termfreq import term_frequencies


def test_terms(spark):
    data = [(1, ["The", "“tea,”", "..."]), (1, ["TEA"]), (2, ["tea", None]), (3, []), (4, None), (5, ["—"]), (None, ["tea"]), (None, ["x1"])] + [(9, ["tea"])] * 50
    df = spark.createDataFrame(data, "d int, t array<string>").withColumn("term", F.lit("clash"))
    got = {r["term"]: (r["occurrences"], r["records"], r["n_records"], r["mark"]) for r in term_frequencies(df, F.col("d"), F.col("t")).collect()}
    assert got == {"tea": (54, 4, 4, "common"), "the": (1, 1, 4, "rare"), "x1": (1, 1, 4, "rare")}
    assert term_frequencies(df.limit(0), F.col("d"), F.col("t")).count() == 0


@pytest.mark.parametrize("windows", [2, 64])
def test_packing(spark, windows):
    sizes = [(i, (i * 37) % 90 + 1) for i in range(300)] + [(1000, 950), (1001, 100), (1002, 0), (1003, None), (5, 6), (5, 6)]
    df = spark.createDataFrame(sizes, "id long, n int").withColumn("container_id", F.lit("clash")).repartition(3)
    kinds = spark.createDataFrame([("s", 100), ("l", 400)], "container_kind string, capacity int")
    got = pack(df, kinds, "id", "n", windows=windows, least_piece=10).collect()
    for kind, cap in (("s", 100), ("l", 400)):
        rows = [r for r in got if r["container_kind"] == kind]
        fill, whole, pieces = Counter(), Counter(), Counter()
        for r in rows:
            fill[r["container_id"]] += r["size"]
            whole[r["item_id"]] += r["size"]
            pieces[r["item_id"]] += 1
        want = Counter()
        for i, n in sizes:
            want[i] += n or 0
        assert +whole == +want and max(fill.values()) <= cap
        assert all(pieces[i] == sum(1 for j, _ in sizes if j == i) for i, n in sizes if (n or 0) <= cap)
        assert len(fill) <= (1.1 if windows > 2 else 1.4) * sum(fill.values()) / cap + 2
        big = sorted((r["offset"], r["size"]) for r in rows if r["item_id"] == 1000)
        assert all(a[0] + a[1] == b[0] for a, b in zip(big, big[1:])) and big[0][0] == 0
    assert pack(df.limit(0), kinds, "id", "n").count() == 0


def test_no_kind_is_left_out(spark):
    items = spark.createDataFrame([(1, 3)], "i long, n int")
    kinds = spark.range(1001).selectExpr("concat('k', id) container_kind", "cast(10 as int) capacity")
    with pytest.raises(ValueError, match="kinds"):
        pack(items, kinds, "i", "n")
