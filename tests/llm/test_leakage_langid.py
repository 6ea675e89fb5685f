import random

import numpy as np
from pyspark.sql import functions as F

from quire.llm.langid import document_languages, is_scrap, repaired, segments, settled, stated_language, train
from quire.llm.leakage import alike, blocks_left, covered, leaked, letters, qgram_hashes

R = random.Random(5)
VOCABULARY = ["".join(R.choice("abcdefghijklmnop") for _ in range(R.randint(3, 9))) for _ in range(900)]


def passage(n, seed):
    r = random.Random(seed)
    return [r.choice(VOCABULARY) for _ in range(n)]


def test_hashes_are_positional():
    c = np.frombuffer(letters("Abcabcabcabcabc").encode("utf-32-le"), np.uint32)
    h = qgram_hashes(c, 10)
    assert len(h) == 6 and h[0] == h[3] and h[0] != h[1] and len(qgram_hashes(c[:5], 10)) == 0


def test_alike():
    assert alike("road", "roaad") and alike("travellers", "travelers") and not alike("road", "dams") and not alike("cat", "cut")


def test_covered():
    item = passage(60, 1)
    assert covered(item, item, 0.1) == 60 and covered(item, item[:31], 0.1) == 31 and covered(item, passage(60, 2), 0.1) < 10 and covered([], item, 0.1) == 0


def test_leaks(spark):
    items = {k: passage(60 + k, 100 + k) for k in range(12)}
    docs, want = [], set()
    for d in range(60):
        words, k = passage(150, 1000 + d), d % 12
        if d % 3 == 0:
            part = items[k][: len(items[k]) * 2 // 3]
            for j in range(4, len(part), 11):
                part[j] = "replaced"
            words[40:40] = part
            want.add((d, k))
        elif d % 3 == 1:
            words[40:40] = items[k][: len(items[k]) // 4]
        docs.append((d, " ".join(words).replace(" ", "\n" if d % 2 else ", ").upper() if d % 5 == 0 else " ".join(words)))
    df = spark.createDataFrame(docs + [(900, None), (901, ""), docs[0]], "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    it = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()] + [(77, None), (78, "")], "item_id int, text string")
    assert {tuple(r) for r in leaked(df, it).collect()} == want
    assert {tuple(r) for r in leaked(df, it, most_items=5).collect()} == want  # in three blocks
    assert leaked(df.limit(0), it).count() == 0 and leaked(df, it.limit(0)).count() == 0


def test_no_damage_leaves_fewer_blocks():
    r = random.Random(11)
    for _ in range(40):
        lengths = [r.randint(1, 12) for _ in range(r.randint(6, 30))]
        q, n = 5, -(-len(lengths) // 2)
        ends = [0]
        for x in lengths:
            ends.append(ends[-1] + x)
        bound = blocks_left(lengths, q, 0.5, 0.1)
        for _ in range(60):
            i = r.randrange(len(lengths) - n + 1)
            bad = r.sample(range(i, i + n), -(-n // 10))
            kept = 0
            for b in range(ends[-1] // q):
                lo, hi = b * q, b * q + q
                inside = lo >= ends[i] and hi <= ends[i + n]
                kept += inside and not any(ends[j] < hi and ends[j + 1] > lo for j in bad)
            assert kept >= bound or bound == 1


EN = "the old river was near the town and we crossed it before dawn with our horses"
DE = "der alte fluss war nahe der stadt und wir überquerten ihn vor sonnenaufgang mit den pferden"
RU = "старая река была близко и мы перешли её до рассвета вместе с лошадьми"


def sample(text, n, seed):
    r = random.Random(seed)
    w = text.split()
    return [" ".join(r.choice(w) for _ in range(14)).capitalize() + "." for _ in range(n)]


def model():
    xs = [(t, lab) for lab, s in (("en", EN), ("de", DE), ("ru", RU)) for t in sample(s, 150, lab)]
    xs += [(t, "de") for t in sample(EN, 4, "noise")]  # wrong labels
    return train([t for t, _ in xs], [v for _, v in xs])


def test_language_held_out():
    m = model()
    for lab, s in (("en", EN), ("de", DE), ("ru", RU)):
        p = m.probabilities(sample(s, 40, lab + "held"))
        from quire.llm.langid import LANGUAGES

        assert (p.argmax(1) == LANGUAGES.index(lab)).mean() > 0.95
    assert m.probabilities([]).shape[0] == 0


def test_segments(spark):
    m = model()
    en, de = " ".join(sample(EN, 2, "a")), " ".join(sample(DE, 2, "b"))
    df = spark.createDataFrame([(1, f"{en}\n\n{de}\n{de}"), (2, ""), (3, None), (4, "123 —")], "doc_id long, text string").withColumn("lang", F.lit("clash"))
    got = segments(df, m, "doc_id", "text").orderBy("start_char").collect()
    assert [(r["doc_id"], r["lang"], r["start_char"], r["end_char"]) for r in got] == [(1, "en", 0, len(en)), (1, "de", len(en) + 2, len(en) + 3 + 2 * len(de))]
    assert document_languages(segments(df, m, "doc_id", "text")).first()["mixed"]
    assert segments(df.limit(0), m, "doc_id", "text").count() == 0


def test_labels_and_decoding(spark):
    df = spark.createDataFrame([(x,) for x in ("en", "EN-gb", "English", "deu", "zh_CN", "und", "", None, "xx", " fra ")], "l string")
    assert [r[0] for r in df.select(stated_language(F.col("l"))).collect()] == ["en", "en", "en", "de", "zh", None, None, None, None, "fr"]
    for t in ("déjà vu à la forêt", "старая река была", "„Wo ist der Fluß?“"):
        assert repaired(t.encode().decode("latin-1")) == t and repaired(t) == t


HI = "डॉ. ने 3.3 कोस दूर बाज़ार को देखा। 122 में से वह भी है और 45 की नदी थी"


def test_no_whole_paragraph_is_a_scrap(spark):
    assert settled(["en", "ru"], [0.99, 0.97], [EN, "мы там"], 0.6) == ["en", "ru"]  # short, but sure
    assert settled(["en", "ru"], [0.99, 0.7], [EN, "мы там"], 0.6) == ["en", "en"]
    assert settled(["en", "de"], [0.99, 0.7], [EN, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20 21 22 23 24 25 " + DE], 0.6) == ["en", "de"]
    line = "डॉ. ने 3.3 कोस दूर 122 में से 45 की नदी थी वह भी है"
    assert sum(c.isalpha() for c in line[:60]) < 24 and not is_scrap(line) and is_scrap("Mr. T.")
    m = train([t for s in (EN, HI) for t in sample(s, 150, s)], ["en"] * 150 + ["hi"] * 150)
    few = "12 13 14 15 16 17 18 19 20 21 22 23 24 25 26 27 28 29 30 की " + sample(HI, 1, "h")[0]
    assert sum(3 for c in few[:60] if c.isalpha()) < 24
    en = sample(EN, 1, "a")[0]
    got = segments(spark.createDataFrame([(1, f"{en}\n{few}\n{en}")], "doc_id long, text string"), m, "doc_id", "text").orderBy("start_char").collect()
    assert [r["lang"] for r in got] == ["en", "hi", "en"]
