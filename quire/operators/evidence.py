"""Evidence rows, packs and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.mentions import extract, sentences_around


def evidence_rows(sentences: DataFrame, groups: dict[str, list[str]], doc_id: str, index: str, text: str) -> DataFrame:
    """Mentions with the two sentences before and after, the stretch of 50 sentences and a pointer."""
    s = sentences_around(sentences, groups, doc_id, index, text, {"context_prev": (-2, -1), "context_next": (1, 2)})
    e = extract(s, groups, "sentence_text")
    return e.withColumns({"doc_position_bucket": F.floor(F.col("sent_idx") / 50).cast("int"), "pointer": F.concat(F.col("doc_id").cast("string"), F.lit("#sent="), F.col("sent_idx").cast("string"))})


def shortened(x: Column, most: int, mark: str = "...") -> Column:
    return F.when(F.length(x) > most, F.concat(F.left(x, F.lit(most)), F.lit(mark))).otherwise(x)


def evidence_pack(labelled: DataFrame, key: list[str], n: int = 10, most: int = 400) -> DataFrame:
    """The n surest mentions of each R class and of the essentialising ones; a row can stand in two."""
    cats = F.filter(F.array(F.when(F.col("r_label").isin("negative", "exotic", "positive", "neutral"), F.col("r_label")), F.when(F.col("is_essentializing"), F.lit("essentializing"))), lambda c: c.isNotNull())
    c = labelled.withColumn("category", F.explode(cats))
    w = Window.partitionBy("category").orderBy(F.desc("r_confidence"), *key)
    return c.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).withColumn("context_text", shortened(F.col("context_text"), most))


def workshop_cases(themes: dict[str, DataFrame], key: list[str], n: int = 5) -> DataFrame:
    """n rows of each theme with a running number over all."""
    out = None
    for i, (name, df) in enumerate(themes.items()):
        part = df.select(F.lit(name).alias("theme"), F.lit(i).alias("theme_no"), *key).withColumn("rn", F.row_number().over(Window.partitionBy("theme").orderBy(*key))).filter(F.col("rn") <= n)
        out = part if out is None else out.unionByName(part)
    return out.withColumn("case_id", F.row_number().over(Window.orderBy("theme_no", "rn"))).drop("theme_no", "rn")  # n rows a theme


def content_candidates(df: DataFrame, text: str, key: list[str], n: int = 10) -> DataFrame:
    from quire.operators.noise import content_sentence

    return df.filter(content_sentence(F.col(text))).orderBy(*key).limit(n)


def optional_filters(df: DataFrame, **wanted: str | None) -> DataFrame:
    for column, value in wanted.items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df


def scatter_labels(profiles: DataFrame, n: int = 10, agency: float = 0.5, oi: float = 0.6) -> DataFrame:
    """Entities to be named on a chart: the n most frequent and the extreme ones."""
    r = profiles.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mentions"), "ethnos_norm")))  # entities of the lexicon
    return r.withColumn("labelled", (F.col("rank") <= n) | (F.abs("agency") > agency) | (F.col("oi") > oi))


def reliability(n: Column, least: int = 20) -> Column:
    return F.when(n < least, "low").otherwise("ok")


def passport(raw: DataFrame) -> DataFrame:
    """One row about a run: documents, mentions, clean mentions, noise share in per cent."""
    return raw.agg(F.count_distinct("doc_id").alias("documents"), F.count(F.lit(1)).alias("mentions"), F.count_if(~F.col("is_noise")).alias("clean"),
                   F.bround(100.0 * F.count_if("is_noise") / F.greatest(F.count(F.lit(1)), F.lit(1)), 1).alias("noise_pct"))


def sanity(raw: DataFrame, keyness_top: DataFrame, edge_examples: DataFrame) -> DataFrame:
    """One row per check: noise above half, garbage among the top words, index-like edge examples."""
    from quire.functions.text import ocr_garbage
    from quire.operators.noise import index_like

    a = raw.agg((F.count_if("is_noise") / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("value")).select(F.lit("noise_ratio").alias("check_name"), "value", (F.col("value") <= 0.5).alias("passed"))
    b = keyness_top.agg(F.count_if(ocr_garbage(F.col("word"))).cast("double").alias("value")).select(F.lit("garbage_words").alias("check_name"), "value", (F.col("value") == 0).alias("passed"))
    c = edge_examples.agg(F.count_if(index_like(F.col("quote"))).cast("double").alias("value")).select(F.lit("index_examples").alias("check_name"), "value", (F.col("value") == 0).alias("passed"))
    return a.unionByName(b).unionByName(c)
