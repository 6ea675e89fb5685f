import itertools
import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quire.llm.cooccurrence import cells, cooccurrence, false_discovery, fit_null, poisson_binomial_tail


def rows(seed=1, records=60, items="abcdefg"):
    r = random.Random(seed)
    out = [(i, x, "n_ab") for i in range(records) for x in r.sample(items, r.randint(0, 4))]
    return out + out[:20] + [(7, None, "x"), (None, "a", "x"), (None, "b", "x"), (999, None, "x")]


def test_counts_as_brute_force(spark):
    data = rows()
    df = spark.createDataFrame(data, "rec int, item string, n_ab string")  # a clashing extra column
    sets = {}
    for k, i, _ in data:
        sets.setdefault(k, set()).update([i] if i else [])
    n = Counter(x for s in sets.values() for x in s)
    pairs = Counter(p for s in sets.values() for p in itertools.combinations(sorted(s), 2))
    got = cooccurrence(df, [F.col("rec")], F.col("item")).collect()
    assert {(r["item_a"], r["item_b"]): r["n_ab"] for r in got} == dict(pairs)
    assert all(r["n_a"] == n[r["item_a"]] and r["n_b"] == n[r["item_b"]] and r["n_records"] == len(sets) for r in got)
    assert all(0 <= r["p_value"] <= r["q_value"] + 1e-12 <= 1 + 1e-9 for r in got)


def test_empty(spark):
    df = spark.createDataFrame([], "rec int, item string")
    assert cooccurrence(df, [F.col("rec")], F.col("item")).count() == 0


def test_null_model_keeps_degrees():
    d, items, s, rec = [3, 10, 40], [5, 3, 2], [1, 2, 4], [25, 30, 15]
    total = sum(a * b for a, b in zip(d, items))
    s_total = sum(a * b for a, b in zip(s, rec))
    d = [x * s_total / total for x in d]
    x, y = fit_null(np.array(d), items, s, rec)
    p = 1 / (1 + 1 / np.outer(x, y))
    assert np.allclose((p * rec).sum(1), d, rtol=1e-5) and np.allclose((p * np.array(items)[:, None]).sum(0), s, rtol=1e-5)


def test_tails_against_convolution():
    rng = np.random.default_rng(3)
    n = np.array([40, 60, 25.0])
    for _ in range(6):
        q = rng.uniform(0.001, 0.7, 3)
        pmf = np.ones(1)
        for k, p in zip(n.astype(int), q):
            b = np.array([math.comb(k, j) * p**j * (1 - p) ** (k - j) for j in range(k + 1)])
            pmf = np.convolve(pmf, b)
        for c in (1, 5, 30, 60, 90):
            exact = pmf[c:].sum()
            got = poisson_binomial_tail(q[None], n, np.array([c]))[0]
            mean = (n * q).sum()
            assert abs(got - exact) < 1e-9 if c <= 48 else abs(got - exact) < 0.05 * min(exact, 1 - exact) + 2e-3 * (abs(c - mean) < 3) + 1e-9


def test_small_tails_keep_their_digits():
    n, q = np.array([300, 200.0]), np.array([[0.01, 0.004]])
    pmf = np.ones(1)
    for k, p in zip(n.astype(int), q[0]):
        pmf = np.convolve(pmf, [math.comb(k, j) * p**j * (1 - p) ** (k - j) for j in range(k + 1)])
    for c in (25, 35, 45):
        exact = math.fsum(pmf[c:])
        assert exact < 1e-9 and abs(poisson_binomial_tail(q, n, np.array([c]))[0] / exact - 1) < 1e-6


def test_large_records_in_blocks(spark):
    r = random.Random(4)
    sets = {i: r.sample([f"i{k}" for k in range(40)], n) for i, n in enumerate([0, 1, 3, 12, 30, 40])}
    flat = [(i, 0, x) for i, v in sets.items() for x in v] + [(i, 0, None) for i in sets]
    df = spark.createDataFrame(flat, "r long, s int, item string")
    want = Counter(p for v in sets.values() for p in itertools.combinations_with_replacement(sorted(v), 2))
    for block in (5, 7, 256):
        got = cells(df, block).collect()
        assert {(x["a"], x["b"]): x["n"] for x in got if x["a"]} == dict(want)
        assert sorted((x["size"], x["n"]) for x in got if not x["a"]) == [(0, 1), (1, 1), (3, 1), (12, 1), (30, 1), (40, 1)]


def test_p_and_q_as_brute_force(spark):
    data = rows(5, 40)
    sets = {}
    for k, i, _ in data:
        sets.setdefault(k, set()).update([i] if i else [])
    got = cooccurrence(spark.createDataFrame(data, "rec int, item string, x string"), [F.col("rec")], F.col("item")).collect()
    n = Counter(x for s in sets.values() for x in s)
    sizes = Counter(len(s) for s in sets.values() if s)
    deg = sorted(set(n.values()))
    x, y = fit_null(np.array(deg), [list(n.values()).count(v) for v in deg], sorted(sizes), [sizes[k] for k in sorted(sizes)])
    px = dict(zip(deg, x))
    for g in got:
        pmf = np.ones(1)
        for k, v in zip(sorted(sizes), y):
            prob = np.prod([px[g[c]] * v / (1 + px[g[c]] * v) for c in ("n_a", "n_b")])
            for _ in range(sizes[k]):
                pmf = np.convolve(pmf, [1 - prob, prob])
        assert abs(pmf[g["n_ab"] :].sum() - g["p_value"]) < 1e-7
    tests = len(n) * (len(n) - 1) / 2
    for g in got:
        ps = [(h["p_value"], sum(k["p_value"] <= h["p_value"] for k in got)) for h in got if h["p_value"] >= g["p_value"]]
        assert abs(g["q_value"] - min(1.0, min(p * tests / k for p, k in ps))) < 1e-9


def test_false_discovery(spark):
    p = [0.001, 0.001, 0.02, 0.03, 0.5, 1.0, 1e-30]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(p)], "i int, p_value double")
    got = {r["i"]: r["q_value"] for r in false_discovery(df, "p_value", F.lit(20.0)).collect()}
    order = sorted(range(len(p)), key=lambda i: p[i])
    ranks = {i: max(j + 1 for j, k in enumerate(order) if p[k] == p[i]) for i in order}
    want = {i: min(1, min(p[k] * 20 / ranks[k] for k in order if p[k] >= p[i])) for i in order}
    assert all(abs(got[i] - want[i]) < 1e-12 for i in want)
