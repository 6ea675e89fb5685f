"""Fixtures whose expected values can be worked out on paper."""

import math

import pytest
from pyspark.sql import functions as F

from quire import lexicons as L
from quire.functions import text as T
from quire.functions.stats import g2, log_ratio, register_sql
from quire.operators import aggregates as A
from quire.operators import graph as G
from quire.operators import label as B
from quire.operators import mentions as M
from quire.operators import noise as N
from quire.operators import segment as S
from quire.sources import bibliography as BIB
from quire.sources import corpus as C


def one(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_position_buckets(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (3.0,), (5.0,), (4.99,), (95.0,), (None,)], "p double")
    got = one(df.select(N.position_bucket_pct(F.col("p")).alias("b"), N.position_bucket(F.col("p")).alias("n")), "b", "n")
    assert [b for b, _ in got] == [0, 0, 4, 4, 4, 96, 50]
    assert [n for _, n in got] == ["bucket_start", "bucket_start", "bucket_start", "bucket_early", "bucket_start", "bucket_end", "bucket_middle"]


def _mentions(spark, rows):
    return spark.createDataFrame(rows, "mention_id int, doc_id int, sent_idx int, sentence_text string, file_name string, doc_position_percent double")


def test_two_mentions_in_a_sentence_repeat_themselves(spark):
    m = _mentions(spark, [(1, 1, 0, "the old torvak met a young selmik near a quiet river", "a.txt", 50.0)] * 2)
    assert one(N.noise_flags(m), "is_position_header_footer") == [(True,), (True,)]
    assert one(N.noise_flags(m, unit="sentence"), "is_position_header_footer") == [(False,), (False,)]


def test_short_sentence_with_header_word(spark):
    seven, eight = "we saw the river near our camp", "we saw the river near our small camp"
    m = _mentions(spark, [(1, 1, 0, seven, None, 50.0), (2, 1, 1, eight, None, 60.0)])
    got = dict(one(N.noise_flags(m), "mention_id", "is_probable_header_footer"))
    assert got == {1: True, 2: False}


def test_title_match_and_nulls(spark):
    m = _mentions(spark, [(1, 1, 0, "here smith wrote in 1890 of his long trip abroad", "smith_1890_trip.txt", 50.0), (2, None, None, None, None, None), (3, 2, 1, "", None, 10.0)])
    got = dict(one(N.noise_flags(m), "mention_id", "is_noise"))
    assert got[1] and got[2] and got[3] and N.noise_flags(m).count() == 3


def test_representation_labels(spark):
    lex = {"negative": ["bad", "vile"], "exotic": ["odd"], "positive": ["kind"]}
    df = spark.createDataFrame([("bad vile odd",), ("bad odd",), ("plain",), (None,)], "t string")
    none = F.array().cast("array<string>")
    got = one(B.representation(df, "t", none, F.lit(0.4), lex), "r_label", "r_confidence")
    assert got == [("negative", 0.8), ("uncertain", 0.4), ("neutral", 0.3), ("neutral", 0.3)]
    assert one(B.representation(df.limit(1), "t", none, F.lit(0.8), lex), "r_confidence") == [(0.9,)]


def test_situation_labels(spark):
    lex = {"a": ["a1", "a2", "a3", "a4", "a5"], "b": ["b1", "b2", "b3"]}
    df = spark.createDataFrame([("a1 a2 a3 a4 a5 b1 b2 b3",), ("a1 a2 a3 a4 a5 b1 b2",), ("a1.",), ("x",), (None,)], "t string")
    assert one(B.situation(df, "t", lex), "o_label", "o_confidence") == [("mixed", 0.4), ("a", 0.9), ("a", 0.6), ("unknown", 0.2), ("unknown", 0.2)]


def test_keyness_by_hand(spark):
    df = spark.createDataFrame([(10.0, 0.0, 100.0, 100.0)], "f double, r double, n double, m double")
    a = [F.col(c) for c in "frnm"]
    x, y = one(df.select(g2(*a).alias("g"), log_ratio(*a).alias("l")), "g", "l")[0]
    assert math.isclose(x, 13.8629, abs_tol=1e-4) and math.isclose(y, math.log2(21), abs_tol=1e-9)
    register_sql(spark)
    assert math.isclose(spark.sql("SELECT g2(10, 0, 100, 100) g").first()["g"], x)


def test_keyness_without_reference_is_zero(spark):
    df = spark.createDataFrame([("x", "river river tea tea")], "l string, t string")
    assert {r["g2"] for r in A.keyness_against(df, "l", "t", []).collect()} == {0.0}
    assert A.keyness_against(df.limit(0), "l", "t", []).count() == 0


def test_jaccard_npmi(spark):
    sets = spark.createDataFrame([(2, ["A"]), (2, ["A", "B"]), (2, ["A", "B"]), (2, ["B"])], "w int, entities array<string>")
    assert one(G.jaccard(sets), "jaccard") == [(0.5,)]
    assert math.isclose(one(G.npmi(sets), "npmi")[0][0], math.log2(0.5 / 0.5625), abs_tol=1e-9)


def test_agency_and_rates(spark):
    e = spark.createDataFrame([("a", "b", 3), ("b", "a", 1)], "src string, dst string, n int")
    assert dict(one(A.agency(e), "entity", "agency")) == {"a": 0.5, "b": -0.5}
    m = spark.createDataFrame([(1, "x", 150)] * 3 + [(2, "x", 50)], "doc_id int, g string, doc_sent_count int")
    assert one(A.rates(m, "g"), "mean_rate", "median_rate") == [(200.0, 200.0)]


def test_contingency(spark):
    rows = [("a", "x")] * 10 + [("a", "y")] * 20 + [("b", "x")] * 20 + [("b", "y")] * 10
    df = spark.createDataFrame(rows, "a string, b string")
    assert math.isclose(A.contingency(df, "a", "b").first()["chi2"], 5.4, abs_tol=1e-9)
    assert math.isclose(A.contingency(df, "a", "b", yates=False).first()["chi2"], 6.66667, abs_tol=1e-4)


def _tok(*rows):
    return [{"text": t, "lemma": l, "pos": p, "dep": d, "head": "", "head_i": h, "i": i} for i, (t, l, p, d, h) in enumerate(rows)]


TOKENS = "array<struct<text:string,lemma:string,pos:string,dep:string,head:string,head_i:int,i:int>>"


def test_interactions_of_parsed_text(spark):
    v = {"fight": ["raid"]}
    both = _tok(("torvaks", "torvak", "NOUN", "nsubj", 1), ("raided", "raid", "VERB", "ROOT", 1), ("selmiks", "selmik", "NOUN", "dobj", 1))
    subj = _tok(("torvaks", "torvak", "NOUN", "nsubj", 1), ("raided", "raid", "VERB", "ROOT", 1), ("camps", "camp", "NOUN", "dobj", 1))
    none = _tok(("torvak", "torvak", "X", "dep", 0), ("raided", "raid", "X", "dep", 0), ("selmik", "selmik", "X", "dep", 0))
    other = _tok(("men", "man", "NOUN", "nsubj", 1), ("raided", "raid", "VERB", "ROOT", 1), ("camps", "camp", "NOUN", "dobj", 1))
    rows = [(i, 0, t, ["torvak", "selmik"]) for i, t in enumerate([both, subj, none, other])]
    df = spark.createDataFrame(rows, f"doc_id int, sent_idx int, tokens {TOKENS}, entities array<string>")
    hits = G.parsed_interactions(df, v)
    assert sorted(one(hits, "doc_id", "src", "dst", "confidence")) == [(0, "torvak", "selmik", "high"), (1, "torvak", "selmik", "medium"), (2, "torvak", "selmik", "low")]
    e = G.edges_of(hits).first()
    assert (e["n"], e["confidence"]) == (3, "high")  # ties go upward


def test_dependency_epithets(spark):
    t = _tok(("The", "the", "DET", "det", 2), ("proud", "proud", "ADJ", "amod", 2), ("Torvak", "torvak", "NOUN", "nsubj", 3), ("came", "come", "VERB", "ROOT", 3))
    c = _tok(("Torvaks", "torvak", "NOUN", "nsubj", 1), ("are", "be", "AUX", "ROOT", 1), ("brave", "brave", "ADJ", "acomp", 1))
    df = spark.createDataFrame([(t, "torvak"), (c, "torvaks"), (c, "nobody")], f"tokens {TOKENS}, s string")
    got = one(df.select(B.dependency_epithets(F.col("tokens"), F.col("s")).alias("e")), "e")
    assert got[0][0]["epithets"] == ["proud"] and got[0][0]["method"] == "amod"
    assert got[1][0]["epithets"] == ["brave"] and got[1][0]["method"] == "copula" and got[2][0] is None


def test_splitter(spark):
    df = spark.createDataFrame([(1, "Hi there. Bye now! Ok"), (2, "One.\ntwo"), (3, ""), (4, None)], "d int, t string")
    got = {}
    for d, s in one(S.split_sentences(df, "d", "t").orderBy("doc_id", "sent_idx"), "doc_id", "sentence_text"):
        got.setdefault(d, []).append(s)
    assert got == {1: ["Hi there.", "Bye now!", "Ok"], 2: ["One.", "two"]}


def test_annotator(spark):
    df = spark.createDataFrame([(1, 0, "We came"), (1, 1, None)], "d int, i int, sentence_text string")
    assert [len(r["tokens"]) for r in S.annotate(df, S.whitespace_annotator).orderBy("i").collect()] == [2, 0]


def test_bibliography(spark):
    rows = [("1", "Smith, J.", "My Long Trip to Sea", 1890, "", ""), ("2", "J. Smith", "My long trip to the sea", 1890, "", "u"), ("3", "Smith, J.", "My Long Trip to Sea", 1890, "vol1", ""), ("4", "Smith, J.", "My Long Trip to Sea", 1890, "vol2", "")]
    df = spark.createDataFrame(rows, "identifier string, creator string, title string, year int, volume_sig string, txt_url string")
    assert sorted(r[0] for r in one(BIB.deduplicate(df, ["identifier"]), "identifier")) == ["2", "3", "4"]
    t = spark.createDataFrame([("Trip, vol. 2",), ("Second volume of trips",), ("Part iv",), ("Trip",), (None,)], "t string")
    assert [r[0] for r in one(t.select(BIB.volume_signature(F.col("t")).alias("s")), "s")] == ["vol2", "vol2", "partiv", "", ""]


def test_file_names(spark):
    df = spark.createDataFrame([("Smith_1890_My_Trip.txt",), ("Notes.txt",), (None,)], "f string")
    got = [r["m"] for r in df.select(C.file_metadata(F.col("f")).alias("m")).collect()]
    assert (got[0]["author"], got[0]["year"], got[0]["title"]) == ("Smith", 1890, "My Trip")
    assert (got[1]["author"], got[1]["year"], got[1]["title"]) == ("", None, "Notes") and got[2] is None


def test_purity(spark):
    df = spark.createDataFrame([(0, "x"), (0, "x"), (0, "y"), (1, "y"), (-1, "x")], "c int, l string")
    r = A.purity(df, "c", "l").first()
    assert r["purity"] == 0.75 and r["noise_ratio"] == 0.2


def test_cleaning(spark):
    df = spark.createDataFrame([("“A ﬁne  day” for tra-\nvel, sooooo\n\n\n\nTbe end",), (None,)], "t string")
    got = [r[0] for r in one(df.select(T.clean_text(F.col("t"), [("tbe", "the")]).alias("c")), "c")]
    assert got == ['"A fine day" for travel, soo\n\nThe end', None]


def test_garbage_words(spark):
    df = spark.createDataFrame([("scjuare",), ("luxxxury",), ("ab",), ("river",)], "w string")
    assert [r[0] for r in one(df.select(T.ocr_garbage(F.col("w")).alias("g")), "g")] == [False, True, True, False]


def test_essentialising(spark):
    df = spark.createDataFrame([("All torvaks love tea and the torvaks are a proud people",), ("The men are tired",), (None,)], "t string")
    e = [r[0] for r in one(df.select(B.essentialising(F.col("t"), F.array(F.lit("torvaks"))).alias("e")), "e")]
    assert e[0]["pattern"] == "the_X_are" and e[1]["pattern"] == "" and e[2]["pattern"] == ""


def test_results_do_not_depend_on_partitions(spark):
    s = spark.createDataFrame([(d, i, f"The Torvak met a Selmik {i}.") for d in range(4) for i in range(6)], "doc_id int, sent_idx int, sentence_text string")
    groups = {"torvak": ["torvaks", "torvak"], "selmik": ["selmik"]}
    runs = [sorted(map(tuple, M.mentions_table(s.repartition(n), groups, "doc_id", "sent_idx", "sentence_text").collect())) for n in (1, 7)]
    assert runs[0] == runs[1] and len(runs[0]) == 48


def test_empty_tables(spark):
    s = spark.createDataFrame([], "doc_id int, sent_idx int, sentence_text string")
    sets = G.entity_sets(s, {"a": ["a"]}, "doc_id", "sent_idx", "sentence_text")
    assert G.pairs_of(sets).count() == 0 and G.jaccard(sets).count() == 0 and M.extract(s, {}, "sentence_text").count() == 0
    e = spark.createDataFrame([], "src string, dst string, type string, n int")
    assert A.agency(e).count() == 0 and G.degrees(e).count() == 0 and G.graph_metrics(e).first()["edges"] == 0


def test_store_and_texts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "Smith_1890_A.txt").write_bytes(b"Caf\xe9 text")
    got = C.read_texts(spark, str(tmp_path / "in"), ["smith"]).collect()
    assert [r["file_name"] for r in got] == ["Smith_1890_A.txt"] and "text" in got[0]["text"]
    assert C.read_texts(spark, str(tmp_path / "in"), ["nobody"]).count() == 0
    out = str(tmp_path / "store")
    C.write_store({"a": spark.range(3).toDF("x")}, out)
    assert C.read_store(spark, out, ("a",))["a"].count() == 3 and C.read_store(spark, out, ("b",)) is None and C.read_store(spark, out + "x") is None


def test_yaml_lexicon(spark, tmp_path):
    (tmp_path / "l.yml").write_text("bad: [Vile, mean]\nkind: [good]\n")
    lex = L.load_yaml(tmp_path / "l.yml")
    assert L.as_frame(spark, lex).count() == 3 and L.known_words(lex, targets=[("a", "The")]) == {"vile", "mean", "good", "the"}


def test_column_roles():
    assert C.column_roles(["id", "ethnos_norm", "sentence_text", "file_name", "sent_idx"]) == {"entity": "ethnos_norm", "sentence": "sentence_text", "file": "file_name", "index": "sent_idx"}


def test_stream(spark, tmp_path):
    from quire.streaming.stateless import labelled_stream

    spark.createDataFrame([(1, "The Torvak was kind. We left.")], "doc_id int, text string").write.parquet(str(tmp_path / "in"))
    docs = spark.readStream.schema("doc_id int, text string").parquet(str(tmp_path / "in"))
    q = labelled_stream(docs, {"torvak": ["torvak"]}, L.REPRESENTATION, L.SITUATION).writeStream.format("memory").queryName("labelled").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("labelled").count() == 1


def test_pos_lemmas_and_roles(spark):
    t = _tok(("Proud", "proud", "ADJ", "amod", 1), ("Torvaks", "torvak", "PROPN", "nsubj", 2), ("raided", "raid", "VERB", "ROOT", 2), ("2nd", "2nd", "NOUN", "dobj", 2), ("camps", "camp", "NOUN", "dobj", 2))
    df = spark.createDataFrame([(t,)], f"tokens {TOKENS}")
    got = df.select(S.pos_lemmas(F.col("tokens"), "content_words", []).alias("a"), S.pos_lemmas(F.col("tokens"), "verbs_only", []).alias("b"), S.pos_lemmas(F.col("tokens"), "no_proper_nouns", ["camp"]).alias("c")).first()
    assert (got["a"], got["b"], got["c"]) == (["proud", "raid", "camp"], ["raid"], ["proud", "raid"])
    r = spark.createDataFrame([("the torvaks", "soldiers"), ("soldiers", "a hut"), (None, "torvak camp")], "s string, o string")
    r = r.select(G.role_class(F.col("s"), ["torvak"], ["soldiers"]).alias("s"), G.role_class(F.col("o"), ["torvak"], ["soldiers"]).alias("o"))
    assert {x["role"]: (x["as_subject"], x["as_object"]) for x in G.role_counts(r, "s", "o").collect()} == {"ETHNOS": (1, 1), "IMPERIAL_AGENT": (1, 1), "OTHER": (1, 1)}


def test_token_costs(spark):
    log = spark.createDataFrame([(1_000_000, 0), (0, 1_000_000), (None, None)], "input_tokens long, output_tokens long")
    assert math.isclose(A.token_costs(log).first()["cost"], 1.37) and A.token_costs(log.limit(0)).first()["cost"] == 0


def test_catalogue_columns(spark):
    spark.range(1).createOrReplaceTempView("some_view")
    assert ("some_view", "id") in {(r["table_name"], r["column_name"]) for r in C.columns_of(spark).collect()}


def test_spell_fix(spark):
    known = {"river", "hut", "roads", "reads", "of"}
    # a misspelling counts however often it stands there, a known word however rarely
    df = spark.createDataFrame([(i, "The rivre, RIver Rivr ran of; a hutt, read fluß riverè") for i in range(30)] + [(30, None), (31, "")], "id int, t string")
    got = {r["id"]: r["c"] for r in df.select("id", T.clean_text(F.col("t"), known=known).alias("c")).collect()}
    # read is one from reads only, and as far from roads as two; words of other letters stay
    assert got[0] == got[29] == "The river, RIver River ran of; a hut, reads fluß riverè" and got[30] is None and got[31] == ""
    w = spark.createDataFrame([("rivre",), ("roads",), ("reaads",), ("rads",), ("xyz",), (None,)], "w string")
    got = {r["w"]: r["f"] for r in w.select("w", T.spell_fix(F.col("w"), known, words=True).alias("f")).collect()}
    assert got == {"rivre": "river", "roads": None, "reaads": "reads", "rads": None, "xyz": None, None: None}
    fix = T.Speller(known).fix
    assert [fix(x) for x in ("rivre", "roads", "reaads", "rads", "xyz", "If", "fo")] == ["river", None, "reads", None, None, "Of", "of"]


def test_r_by_entity(spark):
    df = spark.createDataFrame([(i, f"e{i % 7}", "negative" if i < 35 else "exotic") for i in range(42)] + [(99, None, "negative")], "mention_id int, ethnos_norm string, r_label string")
    got = {tuple(r) for r in A.r_by_entity(df).collect()}
    assert got == {(f"e{k}", 6, 5, 1, 3) for k in range(7)}
    assert {r[0] for r in A.r_by_entity(df, ["e2", "e6"]).collect()} == {"e2", "e6"}


def test_purity_of_real_clusters(spark, tmp_path):
    from quire.plans import catalogue

    # eight groups far apart, one vector in each of another label
    rows = [(g * 10 + i, [float(100 * (g == k)) + 0.01 * i for k in range(8)], 99 if i == 0 else g) for g in range(8) for i in range(10)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    e = {r["vec_id"]: r["cluster"] for r in catalogue.queries()["embedding_clusters"](spark, str(tmp_path)).collect()}
    most = {}
    for i, _, label in rows:
        most.setdefault(e[i], []).append(label)
    r = catalogue.queries()["embedding_purity"](spark, str(tmp_path)).first()
    assert r["purity"] == sum(max(map(x.count, x)) for x in most.values()) / 80 and r["noise_ratio"] == 0


def test_no_form_is_left_out(spark):
    lex = spark.range(100_001).selectExpr("'a' canonical", "concat('v', id) variant")
    with pytest.raises(ValueError, match="forms"):
        M.groups_of(lex)
    assert len(M.groups_of(lex.limit(100_000))["a"]) == 100_000


def test_tails_of_known_distributions():
    from quire.functions.stats import chi2_tail, t_tails

    assert abs(chi2_tail(3.841458820694124, 1) - 0.05) < 1e-9 and abs(chi2_tail(18.307038053275146, 10) - 0.05) < 1e-9 and chi2_tail(0, 3) == 1.0
    assert abs(chi2_tail(7.0, 2) - 2.718281828459045**-3.5) < 1e-12
    assert abs(t_tails(2.2281388519649385, 10) - 0.05) < 1e-9 and abs(t_tails(1.0, 1) - 0.5) < 1e-9 and t_tails(0, 5) == 1.0
    for t in (0.05, 0.4, 1.7, 6.0):
        assert abs(t_tails(t, 2) - (1 - t / math.sqrt(2 + t * t))) < 1e-12  # closed form of two degrees of freedom
        density = lambda u: math.gamma(15.5) / (math.sqrt(30 * math.pi) * math.gamma(15)) * (1 + u * u / 30) ** -15.5
        steps = 2000
        inside = sum((1 if i in (0, steps) else 4 if i % 2 else 2) * density(t * i / steps) for i in range(steps + 1)) * t / steps / 3
        assert abs(t_tails(t, 30) - (1 - 2 * inside)) < 1e-9


def test_forms_in_layers_are_found_as_one_by_one(spark):
    from quire.operators import mentions as M

    groups = {"marsh oldani": ["marsh oldani", "old marsh"], "oldani": ["oldani", "oldanee"], "ai": ["bashan-ai"], "bashan": ["bashan"]}
    assert len(M.layers(groups)) == 2
    df = spark.createDataFrame([(1, "The Marsh Oldani met Oldani, an old marsh oldanee and Bashan-ai."), (2, None), (3, "")], "doc_id long, t string")
    got = sorted((r["entity"], r["surface"]) for r in M.extract(df, groups, "t").collect())
    want = sorted([("marsh oldani", "Marsh Oldani"), ("marsh oldani", "old marsh"), ("oldani", "Oldani"), ("oldani", "Oldani"), ("oldani", "oldanee"), ("ai", "Bashan-ai"), ("bashan", "Bashan")])
    assert got == want
    text = df.first()["t"]
    places = M.text_positions(df, groups, "doc_id", "t").collect()
    assert len(places) == 7 and all(text[r["start"] : r["start"] + len(r["surface"])] == r["surface"] for r in places)
    assert M.extract(df, {}, "t").count() == 0 and M.text_positions(df, {}, "doc_id", "t").count() == 0


def test_betweenness_of_a_path_and_a_star(spark):
    from quire.operators.graph import betweenness

    df = spark.createDataFrame([(a, b, 1) for a, b in ("ab", "bc", "cd", "ba", "cb", "dc")], "src string, dst string, n int")
    assert {r["node"]: round(r["betweenness"], 6) for r in betweenness(df).collect()} == {"a": 0.0, "b": round(4 / 6, 6), "c": round(4 / 6, 6), "d": 0.0}
    assert betweenness(df.limit(0)).count() == 0


def test_latest_harvest_is_taken_whole(spark):
    from quire.sources.bibliography import latest

    df = spark.createDataFrame([("x", 1, "Zeta", "b"), ("x", 2, "Alpha", None)], "identifier string, harvested_at int, title string, publisher string")
    assert [tuple(r) for r in latest(df, "identifier", "harvested_at", ("title", "publisher")).collect()] == [("x", "Alpha", None)]


def test_a_broken_store_has_no_manifest(spark, tmp_path):
    from quire.sources.corpus import read_store, write_store

    good, at = spark.range(3).toDF("id"), str(tmp_path / "store")
    write_store({"a": good}, at)
    assert read_store(spark, at)["a"].count() == 3
    with pytest.raises(Exception):
        write_store({"a": good, "b": good.selectExpr("raise_error('broken') x")}, at)
    assert read_store(spark, at) is None and read_store(spark, str(tmp_path / "none")) is None


def test_shared_folder_is_named_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from quire import session

    fake = SimpleNamespace(sparkContext=SimpleNamespace(applicationId="none", master="spark://host:7077", getCheckpointDir=lambda: None), conf=SimpleNamespace(get=lambda *a: None))
    with pytest.raises(RuntimeError):
        session.shared_folder(fake)


def test_repeats_keep_the_smallest_ids(spark):
    from quire.operators.noise import evidence_top_repeats

    df = spark.createDataFrame([(i, "line") for i in range(3000)] + [(1, "other")], "doc_id long, sentence_text_norm string")
    got = {r["sentence_text_norm"]: r for r in evidence_top_repeats(df).collect()}
    assert got["line"]["n"] == 3000 and got["line"]["docs"] == "|".join(sorted(map(str, range(3000))))[:2000] and got["other"]["docs"] == "1"
