"""The pN_ queries: each problem's operator over its whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.cooccurrence import cooccurrence
from quire.llm.houselines import repeated_lines
from quire.llm.langid import document_languages, fit_languages, segments, stated_language
from quire.llm.leakage import leaked
from quire.llm.neardup import all_pairs, clusters, near_duplicates
from quire.llm.ocr import disturbed_lines, fit_lexicon, repaired_texts
from quire.llm.packing import pack
from quire.llm.quality import text_quality
from quire.llm.sentences import fit_boundaries, split_sentences
from quire.llm.termfreq import term_frequencies
from quire.session import table


def _pairs(spark: SparkSession, d: str, surprise: bool) -> DataFrame:
    m = table(spark, d, "mentions").select("doc_id", "context_text", "ethnos", "ethnos_raw")
    # the lexicon is a fixed table of one row per form
    lex = table(spark, d, "lexicon_entities").groupBy(F.lower("variant").alias("_v")).agg(F.min("canonical").alias("_c"))
    named = m.join(F.broadcast(lex), F.col("ethnos").isNull() & (F.lower("ethnos_raw") == F.col("_v")), "left")
    return cooccurrence(named, [F.col("doc_id"), F.md5("context_text")], F.coalesce("ethnos", "_c"), surprise)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d, surprise=True)
    case = (F.col("n_ab") >= 3) & (F.col("n_ab") * F.col("n_records") >= 2 * F.col("n_a") * F.col("n_b"))
    return p.filter(case).select(F.col("item_a").alias("ethnos_a"), F.col("item_b").alias("ethnos_b"))


def p1_surprise(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d, surprise=True)


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d, surprise=False).select("item_a", "item_b", "n_ab", "n_a", "n_b", "n_records", F.round("lift", 9).alias("lift"))


def _terms(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sentences").select("doc_id", F.from_json("tokens_json", "array<string>").alias("t"))
    return term_frequencies(s, F.col("doc_id"), F.col("t"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).filter("mark is not null").select("term", "mark")


def p2_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).select("term", "occurrences", "records", "n_records", "mark")


def _quality(spark: SparkSession, d: str) -> DataFrame:
    return text_quality(table(spark, d, "sentences"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _quality(spark, d).filter("kind = 'other'").select("doc_id")


def p4_statistics(spark: SparkSession, d: str) -> DataFrame:
    return _quality(spark, d)


def _near(spark: SparkSession, d: str):
    # TESTDATA: runs of three words (eight characters where blanks are not written), half of them shared
    return near_duplicates(table(spark, d, "corpus_documents"), "id", "raw_text", similarity=0.5, run=3, char_run=8)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return all_pairs(*_near(spark, d)).toDF("doc_id_a", "doc_id_b")


def p5_clusters(spark: SparkSession, d: str) -> DataFrame:
    return clusters(*_near(spark, d))


def _natural(spark: SparkSession, d: str, medium: str) -> DataFrame:
    """Corpus documents of one medium that are prose."""
    docs = table(spark, d, "corpus_documents").filter(F.col("medium") == medium).select("id", "raw_text", "filename")
    other = p4_found(spark, d).withColumnRenamed("doc_id", "id")
    few = other.limit(500_001).count() <= 500_000  # broadcast only while it is known to be small
    return docs.join(F.broadcast(other) if few else other, "id", "left_anti")


def _clean_words(spark: SparkSession, d: str):
    return fit_lexicon(table(spark, d, "corpus_documents").filter("medium = 'transcript'"), "id", "raw_text")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    lines = disturbed_lines(_natural(spark, d, "scan"), _clean_words(spark, d), "id", "raw_text", "filename")
    return lines.select("doc_id", "line_no", "kind").distinct()


def p3_repaired(spark: SparkSession, d: str) -> DataFrame:
    scans = table(spark, d, "corpus_documents").filter("medium = 'scan'")
    return repaired_texts(scans, _clean_words(spark, d), "id", "raw_text", "filename")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    transcripts = table(spark, d, "corpus_documents").filter("medium = 'transcript'").select("id", "raw_text")
    model = fit_boundaries(transcripts, "id", "raw_text")
    return split_sentences(_natural(spark, d, "transcript"), model, "id", "raw_text").select("doc_id", "start_char", "end_char").distinct()


def p6_sentences(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "corpus_documents").select("id", "raw_text")
    return split_sentences(docs, fit_boundaries(docs, "id", "raw_text"), "id", "raw_text")


def _house(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines(table(spark, d, "sentences"), table(spark, d, "corpus_documents"), "doc_id", "sentence_index", "text", "source", "id", "raw_text", "source")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _house(spark, d).select("doc_id", "sentence_index").distinct()


def p7_lines(spark: SparkSession, d: str) -> DataFrame:
    return _house(spark, d).groupBy("source", "line").agg(F.count_distinct("doc_id").alias("documents"))


def p7_cleaned(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sentences").select("doc_id", "sentence_index", "text").filter("text is not null").dropDuplicates(["doc_id", "sentence_index"])
    kept = s.join(p7_found(spark, d), ["doc_id", "sentence_index"], "left_anti")
    return kept.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sentence_index", "text"))), lambda x: x["text"]), " ").alias("text"))


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    return pack(table(spark, d, "documents"), table(spark, d, "containers"), "doc_id", "n_tokens").withColumnRenamed("item_id", "doc_id")


def p8_unused(spark: SparkSession, d: str) -> DataFrame:
    per = p8_pack(spark, d).groupBy("container_kind", "capacity", "container_id").agg(F.sum("size").alias("fill"))
    return per.groupBy("container_kind", "capacity").agg(F.count(F.lit(1)).alias("containers"), F.sum("fill").alias("tokens"), (1 - F.sum("fill") / F.sum("capacity")).alias("unused_share"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    """Every held-out item with the number of documents that hold it."""
    items = table(spark, d, "eval_items").select("item_id", "suite")
    found = p9_found(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))
    return items.join(found, "item_id", "left").withColumn("documents", F.coalesce("documents", F.lit(0)))


def _segments(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return segments(docs, fit_languages(docs, "doc_id", "text", stated_language(F.col("lang"))), "doc_id", "text")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    stated = table(spark, d, "documents").select("doc_id", stated_language(F.col("lang")).alias("_said"))
    named = _segments(spark, d).filter("lang is not null").select("doc_id", "lang").distinct()
    return named.join(stated, "doc_id").filter("_said is null or _said <> lang").select("doc_id", "lang").distinct()


def p10_segments(spark: SparkSession, d: str) -> DataFrame:
    return _segments(spark, d)


def p10_documents(spark: SparkSession, d: str) -> DataFrame:
    return document_languages(_segments(spark, d))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1].isdigit()}
