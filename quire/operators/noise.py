"""Noise flags of mention rows and evidence rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import blank_words, caps_ratio, count_of, sentence_norm, word_count
from quire.lexicons import HEADER_WORDS, STOP_NOISE

# Patterns that the definitions name.
PAGE_MARKER = r"(?i)^(?:(?:page\s*)?[0-9]+\s*$|p\.\s*[0-9]+\s*$|pp\.\s*[0-9]+\s*$|[ivxlcdm]+\s*$|chapter\s+[ivxlcdm0-9]+\s*$)"
INDEX_LIKE = r"(?i)^(?:[A-Z][A-Z\s]+\s+[0-9]+)\s*$|^[\s\.,0-9\-]+$|(?:,\s*[0-9]+\s*){3,}|^[0-9]+(?:\s*[\-–]\s*[0-9]+)?\s*$"
EVIDENCE_INDEX = r"(?i)\b(chapter|index|vol\.|volume|part|book|section|contents|page|pp\.)\b"
TRANSLATOR_CONTENTS = r"(?i)\b(contents?|index|chapter|page\s*[0-9]+|part\s+[ivxlcdm]+)\b"
CONTENT_HEADING = r"(?i)^\s*(Chapter|Page|Part|Book\s+[IVXLCDM0-9]+|[0-9]+\s*\.\s*[A-Z]|[IVXLCDM]+\s*\.)\s"


def position_bucket(p: Column) -> Column:
    q = F.coalesce(p.cast("double"), F.lit(50.0))
    return F.when((q < 0) | (q >= 100.01), "bucket_middle").when(q < 5, "bucket_start").when(q < 20, "bucket_early").when(q < 80, "bucket_middle").when(q < 95, "bucket_late").otherwise("bucket_end")


def position_bucket_pct(p: Column) -> Column:
    """Steps of 2 %, ties to the even step."""
    return F.bround(F.coalesce(p.cast("double"), F.lit(50.0)) / 2) * 2


def index_like(x: Column) -> Column:
    s = F.trim(F.coalesce(x, F.lit("")))
    w = blank_words(s)
    headed = (F.size(w) >= 2) & F.element_at(F.when(F.size(w) > 0, w), -1).rlike("^[0-9]+$") & F.exists(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), lambda v: v.rlike(r"^\p{L}+$")) & (caps_ratio(s) > 0.6)
    return (s != "") & (s.rlike(INDEX_LIKE) | F.coalesce(headed, F.lit(False)))


def mostly_marks(x: Column) -> Column:
    s = F.trim(F.coalesce(x, F.lit("")))
    return (s == "") | (10 * count_of(s, r"\p{L}") < 3 * F.length(s))


def title_match(sentence: Column, file_name: Column, threshold: int = 3) -> Column:
    stem = F.regexp_replace(F.lower(F.coalesce(file_name, F.lit(""))), r"\.[^.]*$", "")
    words = F.array_distinct(blank_words(F.translate(stem, "_-", "  ")))
    common = F.size(F.array_intersect(words, F.array_distinct(blank_words(F.lower(F.coalesce(sentence, F.lit("")))))))
    return (F.coalesce(sentence, F.lit("")) != "") & (F.size(words) > 0) & (common >= F.least(F.lit(threshold), F.size(words)))


def noise_flags(m: DataFrame, k: int = 2, m_global: int = 5, n_cross: int = 3, repeat: int = 10, unit: str = "mention") -> DataFrame:
    """All flags, ``is_noise`` and ``noise_reason`` on the mention rows.

    ``unit='mention'`` counts repeats over mention rows, so a sentence with two mentions repeats
    itself; ``'sentence'`` counts distinct sentences. Cross-document counts are aggregated and
    joined back: a text that stands everywhere is one row of the small side.
    """
    base = m.withColumns({
        "sentence_norm": sentence_norm(F.col("sentence_text"), STOP_NOISE),
        "position_bucket": position_bucket(F.col("doc_position_percent")),
        "position_bucket_pct": position_bucket_pct(F.col("doc_position_percent")),
    })
    named = base.filter("sentence_norm <> ''")
    one = F.count(F.lit(1)) if unit == "mention" else F.count_distinct("sent_idx")
    in_doc = named.groupBy("doc_id", "sentence_norm", "position_bucket_pct").agg(one.alias("_in_doc"))
    across = in_doc.groupBy("sentence_norm", "position_bucket_pct").agg(F.count(F.lit(1)).alias("_across"))
    counts = in_doc.join(across, ["sentence_norm", "position_bucket_pct"])
    repeats = base.groupBy("sentence_text").agg(F.count(F.lit(1)).alias("_rep"))
    keys = [base[c].eqNullSafe(counts[c]) for c in ("doc_id", "sentence_norm", "position_bucket_pct")]
    j = base.join(counts, keys[0] & keys[1] & keys[2], "left").drop(counts["doc_id"], counts["sentence_norm"], counts["position_bucket_pct"])
    j = j.join(repeats.withColumnRenamed("sentence_text", "_t"), F.col("sentence_text").eqNullSafe(F.col("_t")), "left").drop("_t")
    text, pos = F.col("sentence_text"), F.coalesce(F.col("doc_position_percent"), F.lit(50.0))
    n = word_count(text)
    probable = (
        (F.col("_rep") >= repeat) | (n < 5) | (caps_ratio(text) > 0.8) | mostly_marks(text) | F.trim(F.coalesce(text, F.lit(""))).rlike(PAGE_MARKER)
        | (F.arrays_overlap(blank_words(F.lower(F.coalesce(text, F.lit("")))), F.array(*map(F.lit, HEADER_WORDS))) & (n < 8))
        | title_match(text, F.col("file_name")) | (((pos <= 2) | (pos >= 98)) & (F.col("_rep") >= 2)) | index_like(text)
    )
    j = j.withColumns({
        "is_position_header_footer": F.coalesce(F.col("_in_doc") >= k, F.lit(False)),
        "is_global_repeat": F.coalesce(F.col("_in_doc") >= m_global, F.lit(False)),
        "is_cross_doc_header_footer": F.coalesce(F.col("_across") >= n_cross, F.lit(False)),
        "is_probable_header_footer": probable,
    }).drop("_in_doc", "_across", "_rep")
    flags = ["is_position_header_footer", "is_cross_doc_header_footer", "is_global_repeat", "is_probable_header_footer"]
    reason = F.concat_ws("; ", *[F.when(F.col(f), f[3:]) for f in flags])
    return j.withColumn("is_noise", F.col(flags[0]) | F.col(flags[1]) | F.col(flags[2]) | F.col(flags[3])).withColumn("noise_reason", reason)


def position_summary(raw: DataFrame) -> DataFrame:
    flags = ["is_position_header_footer", "is_cross_doc_header_footer", "is_global_repeat"]
    return raw.groupBy("doc_id", "sentence_norm", "position_bucket_pct").agg(F.count(F.lit(1)).alias("n"), *[F.bool_or(f).alias(f) for f in flags])


def top_repeats(df: DataFrame, key: str, limit: int = 200) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key).limit(limit)


def evidence_index_like(text: Column, norm: Column) -> Column:
    digits = count_of(text, "0-9") / F.greatest(F.length(F.coalesce(text, F.lit(""))), F.lit(1))
    return (F.trim(norm) == "") | (word_count(text) < 5) | (caps_ratio(text) > 0.7) | (digits > 0.4) | norm.rlike(EVIDENCE_INDEX) | text.rlike(EVIDENCE_INDEX)


def evidence_noise(rows: DataFrame, buckets: int = 3) -> DataFrame:
    """Positional noise (the same text in several stretches of 50 sentences) and index-like rows."""
    r = rows.withColumns({"sentence_text_norm": F.trim(F.lower(F.coalesce("sentence_text", F.lit("")))), "doc_position_bucket": F.floor(F.col("sent_idx") / 50).cast("int")})
    per = r.groupBy("doc_id", "sentence_text_norm").agg(F.count_distinct("doc_position_bucket").alias("_b"))
    j = r.join(per, ["doc_id", "sentence_text_norm"])
    repeat, index = F.col("_b") >= buckets, evidence_index_like(F.col("sentence_text"), F.col("sentence_text_norm"))
    return j.withColumns({"is_noise": repeat | index, "noise_reason": F.concat_ws("; ", F.when(repeat, "positional_repeat"), F.when(index, "index_like"))}).drop("_b")


def evidence_top_repeats(rows: DataFrame, limit: int = 500) -> DataFrame:
    """The commonest texts with the documents that have them, up to 2,000 characters of their sorted ids.

    So many characters hold at most 1,000 ids: the smallest 1,001 of every hash bucket are all that is ever collected.
    """
    top = rows.groupBy("sentence_text_norm").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "sentence_text_norm").limit(limit)
    ids = rows.select("sentence_text_norm", F.col("doc_id").cast("string").alias("d")).join(F.broadcast(top), "sentence_text_norm").groupBy("sentence_text_norm", "n", "d").agg(F.lit(1).alias("_1"))  # ``limit`` rows
    w = Window.partitionBy("sentence_text_norm", F.pmod(F.xxhash64("d"), F.lit(32))).orderBy("d")
    least = ids.withColumn("_r", F.row_number().over(w)).filter("_r <= 1001")
    docs = least.groupBy("sentence_text_norm", "n").agg(F.left(F.array_join(F.sort_array(F.collect_list("d")), "|"), F.lit(2000)).alias("docs"))
    return docs.select(F.left("sentence_text_norm", F.lit(500)).alias("sentence_text_norm"), "n", "docs")


def translator_noise(text: Column) -> Column:
    s = F.trim(F.coalesce(text, F.lit("")))
    n = F.greatest(F.length(s), F.lit(1))
    return (F.length(s) < 20) | (word_count(s) < 5) | (count_of(s, "0-9") / n > 0.3) | (count_of(s, ".,;:!?") / n > 0.25) | s.rlike(TRANSLATOR_CONTENTS) | s.rlike(r",\s*[0-9]+\s*$")


def content_sentence(text: Column) -> Column:
    s = F.trim(F.coalesce(text, F.lit("")))
    return (F.length(s) >= 25) & ~s.rlike(CONTENT_HEADING) & (count_of(s, "0-9") <= F.floor(F.length(s) / 2))


def interaction_sentence(text: Column) -> Column:
    """Fit for interactions: no index line, at least half letters, at least five words."""
    s = F.trim(F.coalesce(text, F.lit("")))
    return (s != "") & ~s.rlike(r"(?i)^(?:[A-Z][A-Z\s]+\s+[0-9]+)\s*$|^[\s\.,0-9\-]+$|(?:,\s*[0-9]+\s*){3,}") & (2 * count_of(s, r"\p{L}") >= F.length(s)) & (word_count(s) >= 5)
