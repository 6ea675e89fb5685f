"""Reading and writing of corpora and stage tables."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STORE_VERSION = 1


def read_texts(spark: SparkSession, folder: str, selectors: list[str] = ()) -> DataFrame:
    """(file_name, text) of every *.txt below a folder, undecodable bytes replaced; selectors as for documents."""
    from quire.operators.mentions import select_documents

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return select_documents(raw.select(F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("file_name"), F.make_valid_utf8(F.col("content").cast("string")).alias("text")), "file_name", list(selectors))


def file_metadata(file_name: Column) -> Column:
    """struct<author, year, title> of Author_Year_Title.txt; without a year the stem is the title."""
    parts = F.split(F.regexp_replace(file_name, r"\.[^.]*$", ""), "_")
    at = F.array_position(F.transform(parts, lambda p: p.rlike("^[0-9]{4}$")), True).cast("int")
    join = lambda a: F.regexp_replace(F.array_join(a, " "), r"^[ _-]+|[ _-]+$", "")
    return F.when(file_name.isNotNull(), F.struct(
        F.when(at > 0, join(F.slice(parts, 1, F.greatest(at - 1, F.lit(0))))).otherwise("").alias("author"),
        F.when(at > 0, F.get(parts, at - 1).cast("int")).alias("year"),
        F.when(at > 0, join(F.slice(parts, F.greatest(at + 1, F.lit(1)), F.size(parts)))).otherwise(join(parts)).alias("title")))


def write_store(stages: dict[str, DataFrame], folder: str) -> None:
    """One Parquet table per stage and a manifest; the old manifest goes first and the new one comes last, so a broken run has none."""
    spark = next(iter(stages.values())).sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_manifest")
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    for name, df in stages.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    note = json.dumps({"version": STORE_VERSION, "stages": sorted(stages)})
    spark.createDataFrame([(note,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/_manifest")


def read_store(spark: SparkSession, folder: str, required: tuple[str, ...] = ()) -> dict[str, DataFrame] | None:
    """The stage tables, or None where the store is missing, incomplete or of another version."""
    try:
        note = json.loads(spark.read.text(f"{folder}/_manifest").first()[0])
        if note["version"] != STORE_VERSION or set(required) - set(note["stages"]):
            return None
        return {s: spark.read.parquet(f"{folder}/{s}") for s in note["stages"]}
    except (AnalysisException, ValueError, KeyError, TypeError):  # no such path, or no manifest of this kind; other errors are the caller's
        return None


def columns_of(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Tables and columns of the catalogue."""
    rows = [(t.name, c.name, c.dataType) for t in spark.catalog.listTables(database) for c in spark.catalog.listColumns(t.name if t.isTemporary else f"{t.database}.{t.name}")]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string")


def column_roles(columns: list[str]) -> dict[str, str]:
    """Which column plays which role, by what its name contains; a missing required role is an error."""
    wanted = {"entity": ("ethnos", "entity", "canonical"), "sentence": ("sentence_text", "sentence", "text"), "file": ("file_name", "filename", "doc_name", "document"), "index": ("sent_idx", "sentence_index", "sentence_id")}
    out = {}
    for role, marks in wanted.items():
        hit = next((c for m in marks for c in columns if m in c.lower() and c not in out.values()), None)
        if hit:
            out[role] = hit
    if "sentence" not in out:
        raise ValueError(f"no sentence column among {columns}")
    return out


def filled_offsets(sentences: DataFrame, doc_id: str, index: str, text: str) -> DataFrame:
    """start_char and end_char, missing ones from the running length with one separator."""
    from pyspark.sql import Window

    w = Window.partitionBy(doc_id).orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    run = F.coalesce(F.sum(F.length(text) + 1).over(w), F.lit(0))
    s = F.coalesce(F.col("start_char").cast("bigint"), run)
    return sentences.withColumn("_run", s).withColumns({"end_char": F.coalesce(F.col("end_char").cast("bigint"), F.col("_run") + F.length(text)), "start_char": F.col("_run")}).drop("_run")


def write_csv(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(folder)


def write_json(df: DataFrame, folder: str) -> None:
    """NaN and infinities become null."""
    fine = [F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), None).otherwise(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(*fine).write.mode("overwrite").json(folder)
