import random

import numpy as np
from pyspark.sql import functions as F

from quire.llm.houselines import chunk_documents, chunks, repeated_lines
from quire.llm.neardup import all_pairs, body, clusters, near_duplicates, tokens


def texts(seed=2):
    r = random.Random(seed)
    vocabulary = [f"w{i}x" for i in range(400)]
    base = [[r.choice(vocabulary) for _ in range(r.randint(5, 160))] for _ in range(40)]
    out = []
    for k, words in enumerate(base):
        out.append(" ".join(words))
        for _ in range(k % 4):
            w = list(words)
            for _ in range(max(1, len(w) // r.choice([5, 10, 30]))):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            if k % 3 == 0:
                w = w[len(w) // 4 :] + w[: len(w) // 4]
            out.append(" ".join(w))
    return [(i, t) for i, t in enumerate(out + out[:5] + ["", "one", None])] + [(3, out[3])]


def test_pairs_as_brute_force(spark):
    data = texts()
    df = spark.createDataFrame(data, "id long, text string").withColumn("n", F.lit("clash")).repartition(5)
    sets = {i: set(tokens(t, 3, 8).tolist()) for i, t in data if t is not None}
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])}
    got = {tuple(r) for r in all_pairs(*near_duplicates(df, "id", "text", similarity=0.5, run=3, char_run=8)).collect()}
    assert got == want and len(want) > 60


def test_hot_group_and_clusters(spark):
    hot = " ".join(f"w{i}" for i in range(60))
    data = [(i, hot) for i in range(40)] + [(100, hot + " end"), (200, "something else entirely with other words here now")]
    df = spark.createDataFrame(data, "id long, text string")
    members, pairs = near_duplicates(df, "id", "text")
    assert members.count() == 40 and pairs.count() == 1  # copies stay one class
    got = {r["id"]: r["cluster_id"] for r in clusters(members, pairs).collect()}
    assert set(got) == {*range(40), 100} and set(got.values()) == {0}
    empty = near_duplicates(df.limit(0), "id", "text")
    assert all_pairs(*empty).count() == 0


def test_chunks_depend_on_content_only():
    r, h, n = chunks(["Return to the North Library on or before the last date", "xx return to the north library, on or before the LAST date!", ""])
    a, b = set(h[r == 0].tolist()), set(h[r == 1].tolist())
    assert len(a & b) >= len(a) - 2 and (r != 2).all() and n.sum() > 0
    assert len(chunks(["", " "])[0]) == 0


def house(spark):
    r = random.Random(4)
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    docs, rows = [], []
    for d in range(60):
        lines = [" ".join(r.choice(words) for _ in range(9)).capitalize() + "." for _ in range(4)]
        if d % 2 == 0:
            lines.append(["Return to the North Library by day 12", "RETURN TO THE NORTH LIBRARY BY DAY 7.", "Return to the N0rth Librarv by day 3"][d // 2 % 3])
        if d % 3 == 0:
            lines.append(f"Copied for the North Library by {r.choice(words).capitalize()}")
        docs.append((d, "\n\n".join(lines), "north", "x"))
        rows += [(d, i, t, "north", "x") for i, t in enumerate(lines)]
    rows += [(0, 4, rows[4][2], "north", "x"), (1, None, "a b c d", "north", "x"), (1, 9, None, None, "x")]
    return (spark.createDataFrame(rows, "doc_id long, sentence_index int, text string, source string, line string").repartition(3),
            spark.createDataFrame(docs, "id long, raw_text string, source string, line string"))


def test_house_lines(spark):
    s, d = house(spark)
    args = ("doc_id", "sentence_index", "text", "source", "id", "raw_text", "source")
    got = {(r["doc_id"], r["sentence_index"]) for r in repeated_lines(s, d, *args).collect()}
    want = {(k, 4) for k in range(0, 60, 2)} | {(k, 5 if k % 2 == 0 else 4) for k in range(0, 60, 3)}
    assert got == want
    assert repeated_lines(s.limit(0), d.limit(0), *args).count() == 0


def test_tokens_of_unspaced_text():
    t = "尼里塔经过了孤独的石塔又在河岸旁休息傍晚时分我们描述了马比镇那座古老的山谷"
    assert len(tokens(t, 3, 8)) == len(t) - 7 and tokens(t, 3, 8).dtype == np.uint32


def test_chunk_documents_as_brute_force(spark):
    r = random.Random(6)
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40)]
    rows = [(s, 5, d, " ".join(r.choice(words) for _ in range(8)) if r.random() < 0.6 else "Return to the North Library by noon") for s in (1, 2) for d in range(30) for _ in range(r.randint(1, 3))]
    want = {}
    for s, _, d, t in rows:
        for h in chunks([t])[1].tolist():
            want.setdefault((s, h), set()).add(d)
    got = chunk_documents(spark.createDataFrame(rows, "src long, enough long, doc_id long, text string").repartition(7)).collect()
    assert sorted(x["docs"] for x in got) == sorted(len(v) for v in want.values()) and max(x["docs"] for x in got) > 20


def test_words_are_runs_of_letters(spark):
    rows = [(d, 0, t) for d in range(6) for t in ["a-b-c-d", "only three words"]]
    s = spark.createDataFrame([(d, i, t, "s") for i, (d, _, t) in enumerate(rows)], "doc_id long, sentence_index int, text string, source string")
    d = spark.createDataFrame([(d, "a-b-c-d\nonly three words", "s") for d in range(6)], "id long, raw_text string, source string")
    got = {(x["doc_id"], x["sentence_index"]) for x in repeated_lines(s, d, "doc_id", "sentence_index", "text", "source", "id", "raw_text", "source").collect()}
    assert got == {(d, i) for i, (d, _, t) in enumerate(rows) if t == "a-b-c-d"}


def test_furniture_is_told_by_its_place():
    prose = "We crossed the river before dawn and sold the tea in the market near the old bridge beside the quiet mill"
    furniture = "\n\nVOYAGE TO THE LAKES\n\n12\n\n"
    assert body(f"{prose}\n{prose[::-1]}{furniture}{prose.upper()}") == f"{prose}\n{prose[::-1]}\n{prose.upper()}"
    listed = [f"{k} bales of wool number {k}" for k in range(9)]
    assert body("\n\n".join(listed)) == "\n".join(listed)
    # whatever share of the text the list is
    assert listed[3] in body("\n\n".join(listed) + f"\n\n{prose}\n{prose[::-1]}\n{prose.upper()}")
    assert body("") == "" and body("12") == "12" and body("\n \n") == ""
