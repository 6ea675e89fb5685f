"""Catalogue records: normalisation, volume marks, duplicates, publishers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Marks of a volume in a title, tried in order, and what they stand for.
VOLUME = [
    ("vol", r"\bvol\.?\s*([0-9]+)\b"), ("vol", r"\bvolume\s*([0-9]+)\b"), ("part", r"\bpart\s*([0-9]+)\b"), ("part", r"\bpart\s+(i+v?|iv|v?i{1,3})\b"),
    ("tome", r"\btome\s*([0-9]+)\b"), ("book", r"\bbook\s*([0-9]+)\b"), ("vol", r"\bv\.?\s*([0-9]+)\b"), ("part", r"\bpt\.?\s*([0-9]+)\b"),
    ("vol", r"\b(second|third|fourth|first)\s+volume\b"), ("vol", r"\bvolume\s+(one|two|three|four)\b"),
]
NUMBER = {"first": "1", "second": "2", "third": "3", "fourth": "4", "one": "1", "two": "2", "three": "3", "four": "4"}


def plain(x: Column) -> Column:
    """Small letters, digits and single blanks only."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[^a-z0-9\s]", ""), r"\s+", " "))


def surname(creator: Column) -> Column:
    c = F.trim(F.coalesce(creator, F.lit("")))
    return F.when(F.contains(c, F.lit(",")), F.trim(F.split(c, ",")[0])).otherwise(F.element_at(F.split(c, r"\s+"), -1))


def title_start(title: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(plain(title), " "), 1, n), " ")


def year_of(x: Column) -> Column:
    y = F.substring(F.regexp_replace(x.cast("string"), "[^0-9]", ""), 1, 4).try_cast("int")
    return F.when(y != 0, y)


def volume_signature(title: Column) -> Column:
    t = F.lower(F.coalesce(title, F.lit("")))
    out = F.lit("")
    for kind, p in reversed(VOLUME):
        got = F.regexp_extract(t, p, 1)
        number = F.coalesce(F.create_map(*[F.lit(x) for kv in NUMBER.items() for x in kv])[got], got)
        out = F.when(got != "", F.concat(F.lit(kind), number)).otherwise(out)
    return out


def deduplicate(items: DataFrame, order: list[str], words: int = 4) -> DataFrame:
    """One record per surname, title start, year and volume; one with a text address is preferred, then the first in order."""
    sig = F.trim(F.coalesce(F.nullif("volume_sig", F.lit("")), F.lit("")))
    title = F.when(sig != "", title_start(F.col("title"), 10)).otherwise(title_start(F.col("title"), words))
    w = Window.partitionBy(plain(surname(F.col("creator"))), title, F.col("year"), sig).orderBy((F.coalesce("txt_url", F.lit("")) == "").cast("int"), *order)
    return items.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def in_years(items: DataFrame, low: int = 1850, high: int = 1917, order: list[str] = ("harvested_at",)) -> DataFrame:
    """Records of the years asked for, the first of each identifier."""
    w = Window.partitionBy("identifier").orderBy(*order)
    return items.filter(F.col("year").between(low, high)).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def latest(items: DataFrame, key: str, order: str, fields: tuple[str, ...]) -> DataFrame:
    """Each key's newest record as a whole (fields of several harvests are never mixed); ties by the fields' values."""
    ties = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    return items.groupBy(key).agg(F.max_by(F.struct(*fields), F.struct(F.col(order), *ties)).alias("_l")).select(key, "_l.*")


def enrich(items: DataFrame, metadata: DataFrame) -> DataFrame:
    """Fields overridden by item metadata where it has them; records without a text file are left out."""
    fields = ("title", "creator", "year", "publisher", "txt_url")
    m = metadata.select("identifier", *[F.col(f).alias(f"_{f}") for f in fields])
    j = items.join(m, "identifier", "left").withColumns({f: F.coalesce(f"_{f}", f) for f in fields}).drop(*[f"_{f}" for f in fields])
    return j.withColumn("volume_sig", volume_signature(F.col("title"))).filter("coalesce(txt_url, '') <> ''")


def sanitized(x: Column, most: int = 80) -> Column:
    t = F.regexp_replace(F.coalesce(x, F.lit("")), r"[^\p{L}\p{N} _-]", "")
    return F.left(F.regexp_replace(F.regexp_replace(t, r"[\s-]+", "_"), "^_+|_+$", ""), F.lit(most))


def file_name_of(creator: Column, year: Column, title: Column, volume: Column) -> Column:
    parts = [F.nullif(sanitized(surname(creator)), F.lit("")), year.cast("string"), F.nullif(sanitized(title), F.lit("")), F.nullif(F.coalesce(volume, F.lit("")), F.lit(""))]
    return F.concat(F.left(F.concat_ws("_", *parts), F.lit(196)), F.lit(".txt"))


def publisher_kept(publisher: Column, places: tuple[str, ...] = ("london", "paris", "westminster")) -> Column:
    p = F.lower(F.trim(F.coalesce(publisher, F.lit(""))))
    return (p == "") | p.rlike("|".join(places))


def match_files(items: DataFrame, files: DataFrame, key: str, file: str, prefix: int = 40) -> DataFrame:
    """Records joined to files: by their own file name, else by year, surname and the title's prefix within the name.

    The prefix, of ``prefix`` letters and digits, is what file names keep of a title.

    The second way joins on (year, surname), both taken from the file's name, and only then compares titles.
    """
    flat = lambda x: F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[^\p{L}\p{N}]", "")
    named = items.filter("coalesce(txt_filename, '') <> ''").join(files.select(F.col(file).alias("txt_filename")).distinct(), "txt_filename").select(key, F.col("txt_filename").alias("file_name"))
    f = files.select(F.col(file).alias("file_name"), F.regexp_extract(file, r"_([0-9]{4})_", 1).alias("_y"), flat(F.regexp_extract(file, r"^([^_]*)_", 1)).alias("_s"), flat(F.regexp_replace(F.col(file), r"\.txt$", "")).alias("_f"))
    i = items.filter("coalesce(txt_filename, '') = ''").select(key, F.col("year").cast("string").alias("_y"), flat(surname(F.col("creator"))).alias("_s"), F.left(flat(F.col("title")), F.lit(prefix)).alias("_t"))
    other = i.join(f, ["_y", "_s"]).filter("contains(_f, _t)").groupBy(key).agg(F.min("file_name").alias("file_name"))
    return named.unionByName(other)
