import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import ocr, quality
from quire.llm.sentences import fit_boundaries, paragraphs, sentence_spans, split_sentences, train


def test_rule_list():
    rng = np.random.default_rng(1)
    x = rng.uniform(0, 1, (600, 3))
    y = (x[:, 0] > 0.7) & (x[:, 2] < 0.5) | (x[:, 1] > 0.9)
    rules = quality.induce(x, y, ("a", "b", "c"))
    got = np.zeros(len(x), bool)
    for r in rules:
        got |= quality._covers(x, [("abc".index(f), 1 if op == ">" else -1, t) for f, op, t in r])
    assert (got == y).mean() > 0.97
    assert quality.to_case([]) == "CASE WHEN n_rows = 0 THEN 'prose'  ELSE 'prose' END"


def test_quality(spark):
    r = random.Random(3)
    w = "the river was old and we crossed it before dawn with our horses near a quiet village".split()
    rows = []
    for d in range(120):
        for i in range(8):
            prose = d % 4 != 0
            rows.append((d, i, " ".join(r.choice(w) for _ in range(12)).capitalize() + "." if prose else f"{r.choice(w)}{r.choice(w)}{r.choice(w)} | {r.randint(1, 99)} | {r.randint(1, 99)}.{i}"))
    rows += [(700, i, f"{i} | {i + 3} | 17.5 | {i * 7}") for i in range(9)] + [(0, 1, None), (500, None, "x"), (600, 0, ""), rows[5]]
    df = spark.createDataFrame(rows, "doc_id long, sentence_index int, text string").withColumn("chars", F.lit("clash"))
    got = {x["doc_id"]: x["kind"] for x in quality.text_quality(df).collect()}
    assert all(got[d] == ("prose" if d % 4 else "other") for d in range(120)) and got[700] == "other" and got[600] == "other"
    assert quality.text_quality(df.limit(0)).count() == 0


def corpus():
    r = random.Random(8)
    nouns = "river ferry hut market bridge tower horse field chapel stove".split()
    names = ["Torva", "Selmi", "Oldan", "Karve", "Ulute"]

    def s():
        n = lambda: r.choice(nouns)
        return r.choice([f"The {n()} was near the {n()}.", f"We saw Capt. {r.choice(names)} at the {n()}.", f"It cost Rs. {r.randint(2, 9)}.50 at the {n()}.", f"“Is the {n()} old?” asked {r.choice(names)}.", f"Nobody left the {n()}!", f"They kept furs, etc. in the {n()}."])

    return ["\n\n".join(" ".join(s() for _ in range(r.randint(3, 6))) for _ in range(5)) for _ in range(150)]


def test_boundaries():
    m = train(corpus() + ["\n\n".join(d[0].join(p) for p in d[1]) for d in other_scripts()])
    text = "We saw Capt. Torva at the hut. The ferry was near the river. “Is the hut old?” asked Selmi. It cost Rs. 3.50 at the\nchapel. Nobody left the hut! The stove was near the field.\n\nA heading\n\nThe bridge was near the tower."
    got = [text[a:b] for a, b, _ in sentence_spans(m, text)]
    assert got == ["We saw Capt. Torva at the hut.", "The ferry was near the river.", "“Is the hut old?” asked Selmi.", "It cost Rs. 3.50 at the\nchapel.", "Nobody left the hut!", "The stove was near the field.", "A heading", "The bridge was near the tower."]
    zh = "路长三里，他卖掉了河岸！“岛屿在哪里？”他问道。我们走了。"
    assert [zh[a:b] for a, b, _ in sentence_spans(m, zh)] == ["路长三里，他卖掉了河岸！", "“岛屿在哪里？”他问道。", "我们走了。"]
    th = "ตอนเย็นเราขายสวน ก่อนรุ่งสางเราพบป่า"
    assert len(sentence_spans(m, th)) == 2 and sentence_spans(m, " \n ") == [] and paragraphs("") == []


def test_spans_are_trimmed_and_in_order():
    m = train(corpus()[:30])
    for t in corpus()[30:60]:
        spans = sentence_spans(m, "  " + t.replace("\n\n", "\r\n\r\n") + " ")
        body = "  " + t.replace("\n\n", "\r\n\r\n") + " "
        assert all(a < b and body[a:b] == body[a:b].strip() for a, b, _ in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
        assert "".join("".join(body[a:b] for a, b, _ in spans).split()) == "".join(body.split())


def test_sentences_on_tables(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(corpus()[:40])] + [(900, None), (901, ""), (902, "x" * 5000)], "id long, text string").withColumn("doc_id", F.lit("clash"))
    m = fit_boundaries(df, "id", "text")
    got = split_sentences(df, m, "id", "text")
    assert got.filter("doc_id = 902").count() == 1 and got.filter("doc_id in (900, 901)").count() == 0
    assert split_sentences(df.limit(0), m, "id", "text").count() == 0 and fit_boundaries(df.limit(0), "id", "text") is not None


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("most", [1, 2, 3])
def test_automaton_is_complete(most):
    r = random.Random(most)
    words = sorted({"".join(r.choice("abc") for _ in range(r.randint(1, 11))) for _ in range(500)})
    trie = ocr.Trie(words)
    for _ in range(150):
        w = "".join(r.choice("abcd") for _ in range(r.randint(1, 12)))
        assert sorted(trie.within(w, most)) == [v for v in words if lev(v, w) <= most]


COMMON = "the of and a we river was before dawn with great care beside old ferry crossed travellers market house measured it in as birch bark tailors towards evening from tea sold".split()


def lexicon():
    known = {w: 500 for w in COMMON} | {"birch-bark": 40, "torunok": 9}
    return ocr.Lexicon(known, {w: 500 for w in COMMON if w.isalpha()})


def test_disturbed_lines():
    text = "\n".join(["Voyage among the Far Lakes of Torunok", "", "The tailors crossed tbe river before dawn with the", "travellers. We measured the market in the eve-", "ning beside the old birch-", "bark. We sold theferry", "",
                      "VOYAGE AMONG THE FAR LAKES", "— 60 —", "", "and tea with great c are towards evening.", "~' ,^", "The ferry was 0ld."])
    got = {(i, k) for i, k, _ in ocr.inspect(text, "Smith_1890_Voyage_among_the_Far_Lakes_of_Torunok.txt", lexicon())}
    assert got == {(2, "misread"), (3, "hyphen"), (5, "misread"), (7, "header"), (8, "page_number"), (10, "misread"), (11, "speck"), (12, "misread")}
    fixed = ocr.repair(text, None, lexicon())
    assert "the river before dawn" in fixed and "in the evening beside" in fixed and "the ferry and tea with great care" in fixed and "birch-bark" in fixed and "old." in fixed and "60" not in fixed


def test_disturbed_lines_on_tables(spark):
    df = spark.createDataFrame([(1, "The river\n\n\n", None), (2, None, "a.txt"), (3, "", None), (4, "x", "a.txt"), (4, "x", "a.txt")], "id long, t string, f string").withColumn("line_no", F.lit("clash"))
    assert ocr.disturbed_lines(df, lexicon(), "id", "t", "f").count() == 0 and ocr.disturbed_lines(df.limit(0), lexicon(), "id", "t", "f").count() == 0
    assert ocr.repaired_texts(df, lexicon(), "id", "t", "f").count() == 4
    lex = ocr.fit_lexicon(df, "id", "t")
    assert lex.known == {} and ocr.fit_lexicon(df.limit(0), "id", "t").common == {}


def test_errors_of_any_kind_are_misread():
    lex = lexicon()
    assert [lex.nearest(w) for w in ("rivxr", "beforw", "wxas", "grat", "travzllerq", "xqzw")] == ["river", "before", "was", "great", "travellers", None]
    lines = ["The tailors crossed the rivxr with care", "beforw dawn. Tfe old ferry was beside the", "markzt. We sold Torvak the birch-bark, xqzw."]
    got = {(i, k, c) for i, k, c in ocr.inspect("\n".join(lines), None, lex)}
    assert got == {(0, "misread", "rivxr=river"), (1, "misread", "beforw=before"), (2, "misread", "markzt=market")}
    assert ocr.inspect("Tfe old ferry was beside the", None, lex) == [(0, "misread", "Tfe=the")]
    assert ocr.inspect("We sold Martet the old ferry", None, lex) == []  # a name


def test_whole_texts_are_learnt(spark, monkeypatch):
    from quire.llm import sentences

    long = "x" * 30_000 + " We saw Capt. Torva."
    df = spark.createDataFrame([(1, long), (2, None), (3, "It was.")], "id long, text string")
    monkeypatch.setattr(sentences, "train", lambda texts: sorted(texts))
    assert fit_boundaries(df, "id", "text") == ["It was.", long]


def other_scripts():
    """Texts (sentences by paragraph) in scripts without letter cases; questions and speech never end a paragraph."""
    r = random.Random(5)
    zh = lambda: r.choice(["我们走过石桥，看见村庄。", "商人卖掉了小屋。", "“岛屿在哪里？”他问道。", "“河水太冷了！”向导说。", "渡船很旧，没有人记得它。"])
    hi = lambda: r.choice(["हम नदी के पास गए।", "क्या पुल पुराना था? किसी ने गाँव देखा।", "भोर से पहले हमने बाज़ार देखा।"])
    th = lambda: r.choice(["ตอนเย็นเราขายสวน", "ก่อนรุ่งสางเราพบป่า", "พ่อค้ารอที่หมู่บ้าน"])
    out = []
    for one, gap in ((zh, ""), (hi, " "), (th, " ")):
        for _ in range(80):
            paragraphs_ = []
            for _ in range(4):
                said = [one() for _ in range(r.randint(2, 4))]
                paragraphs_.append([x for x in said if "？" not in x and "！" not in x] or [said[0]] if one is not zh else [*said, "商人卖掉了小屋。"])
            out.append((gap, paragraphs_))
    return out


def test_every_script_is_learnt():
    data = other_scripts()
    join = lambda d: "\n\n".join(d[0].join(p) for p in d[1])
    asked = ["\n\n".join("Was the river old? Nobody knew. The market was near the tower." for _ in range(4)) for _ in range(30)]
    m = train(corpus() + asked + [join(d) for d in data])
    want = got = both = 0
    for gap, text in data:
        t = join((gap, text))
        true = [y for p in text for x in p for y in (x.replace("? ", "?|").split("|"))]
        found = [t[a:b] for a, b, _ in sentence_spans(m, t)]
        want, got, both = want + len(true), got + len(found), both + sum(min(true.count(x), found.count(x)) for x in set(true))
    assert both / want > 0.97 and both / got > 0.97
    # what is learnt, not a rule, decides: the same marks where speech does end sentences
    swapped = train(corpus() + ["\n\n".join("“岛屿在哪里？”" + "".join(["商人卖掉了小屋。", "“河水太冷了！”"]) for _ in range(4)) for _ in range(80)])
    assert len(sentence_spans(swapped, "“岛屿在哪里？”商人卖掉了小屋。“河水太冷了！”")) == 3


VOCABULARY = "travellers mountains birchwood lanterns blankets merchants fishermen carpenters procession hospitable provisions interpreter waterfall strangers neighbours".split()


def planted(kind, seed=3, lines=300):
    """Lines with one damaged word each, and the lexicon that knows all words."""
    r = random.Random(seed)
    out = []
    for _ in range(lines):
        words = [r.choice(COMMON + VOCABULARY) for _ in range(7)]
        w = r.choice(VOCABULARY)
        if kind == "shape":
            forms = [w[:i] + y + w[i + len(x) :] for x, y in sorted(ocr.CONFUSIONS) for i in range(1, len(w)) if w.startswith(x, i) and y.isalpha()]
            bad = r.choice(forms)
        else:
            i, j = sorted(r.sample(range(1, len(w)), 2))
            bad = w[:i] + r.choice("xqzjk") + w[i + 1 : j] + r.choice("xqzjk") + w[j + 1 :]
        out.append(" ".join([*words[:3], bad, *words[3:]]))
    lex = ocr.Lexicon({w: 500 for w in COMMON + VOCABULARY}, {w: 500 for w in COMMON + VOCABULARY})
    return out, lex


@pytest.mark.parametrize("kind", ["shape", "two"])
def test_misread_words_come_from_the_trie(kind, monkeypatch):
    lines, lex = planted(kind)

    def recall():
        lex.near.clear()
        return len({i for i, k, _ in ocr.inspect("\n".join(lines), None, lex) if k == "misread"}) / len(lines)

    assert recall() > 0.97
    monkeypatch.setattr(ocr.Trie, "within", lambda self, word, most: [])
    assert recall() < 0.1


def test_neighbours_decide_between_candidates():
    known = {w: 500 for w in COMMON} | {"hand": 500, "band": 500, "land": 900}
    pairs = {ocr.pair_hash("wounded", "hand"): 9, ocr.pair_hash("brass", "band"): 9}
    lex = ocr.Lexicon(known, dict(known), pairs)
    assert lex.nearest("xand") == "land" and lex.nearest("xand", "wounded") == "hand" and lex.nearest("xand", "brass", "x") == "band"


def test_pairs_are_counted_by_the_same_hash(spark):
    df = spark.createDataFrame([(i, "A long Brass band played.") for i in range(6)] + [(9, None), (10, "w" * 60)], "id long, text string")
    lex = ocr.fit_lexicon(df, "id", "text")
    assert lex.context("brass", "band", "played") == 12 and lex.context("long", "band", "") == 0


def test_every_misread_word_of_a_line_is_noted_and_put_right(spark):
    lex = lexicon()
    text = "The tailors crossed tbe rivxr with care beforw dawn.\nTfe old ferry was beside the trav-\nzllers with great c are, theferry in tbe market."
    every = [x for x in ocr.inspect(text, None, lex, every=True) if x[1] == "misread"]
    assert [x[2] for x in every if x[0] == 0] == ["tbe=the", "rivxr=river", "beforw=before"]
    assert {x[2] for x in every if x[0]} == {"Tfe=the", "travzllers=travellers", "c are=care", "theferry=the ferry", "tbe=the"}
    assert ocr.repair(text, None, lex) == "The tailors crossed the river with care before dawn. The old ferry was beside the travellers with great care, the ferry in the market."
    notes = ocr.disturbed_lines(spark.createDataFrame([(1, text, None)], "id long, t string, f string"), lex, "id", "t", "f").filter("line_no = 0").collect()
    assert [r["note"] for r in notes] == ["tbe=the; rivxr=river; beforw=before"]


def test_broken_words_are_searched_as_wholes():
    assert [x[2] for x in ocr.inspect("We crossed the old mar-\nkzt with care", None, lexicon(), every=True)] == ["markzt", "markzt=market"]
    assert ocr.repair("beside the mar-\nkct, beforw dawn", None, lexicon()) == "beside the market, before dawn"


def test_only_whole_words_are_put_right():
    assert ocr.repair("We wxas beside wxash.", None, lexicon()).startswith("We was beside")
    assert ocr._put_right("atbe tbe", "tbe=the") == "atbe the"


def test_every_document_is_learnt(spark):
    from quire.llm import sentences

    texts = corpus() + ["\n\n".join(d[0].join(p) for p in d[1]) for d in other_scripts()]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "We saw Dr. Ulute."), (7, None)], "id long, text string").repartition(5)
    at_hand, stored = train([*texts, "We saw Dr. Ulute."]), fit_boundaries(df, "id", "text")
    assert at_hand.words == stored.words and at_hand.prior.hashes.tolist() == stored.prior.hashes.tolist() and at_hand.prior.p.tolist() == stored.prior.p.tolist()
    assert at_hand.pool == pytest.approx(stored.pool) and at_hand.marks == pytest.approx(stored.marks)
    assert [dict(x) for x in at_hand.follow] == [pytest.approx(dict(x)) for x in stored.follow]
    # of 9,000 documents three have an abbreviation that no other shows
    many = spark.range(9000).selectExpr("id", "if(id % 3000 = 17, 'They met Zq. Torva. They met Zq. Selmi at the hut.', 'Nobody left the hut. They met Torva.') text")
    tally = sentences.Texts(many, "text").show()
    assert tally.finals == 9000 and tally.middles == 9006
    assert fit_boundaries(many, "id", "text").prior.get("zq") < 0.5
