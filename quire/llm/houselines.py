"""Problem 7: lines repeated across one site's documents.

Rows are cut into chunks where a rolling hash of the last letters says so, not where lines end;
distinct documents are counted exactly per source and chunk.  Only rows made of excessively
repeated chunks are candidates; a line is then its words with at most one of them open, and a row
belongs to it if only figures, one name, case, spacing, the closing mark or a few characters differ.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.session import cut_lineage

_P = np.uint64(0x100000001B3)
_HOLE = "*"


_LETTERS = np.array([unicodedata.category(chr(x))[0] in "LM" for x in range(0x32000)])


def chunks(texts: list[str], window: int = 4, radius: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, letters) of every content-defined chunk of the texts' letters.

    A chunk ends where the rolling hash of the last ``window`` letters is the smallest within
    ``radius`` letters, so that it has ``radius`` letters or more and about twice as many, and what
    stands further away does not move its ends.
    """
    joined = "\n".join(t.replace("\n", " ") for t in texts).lower()
    c = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    row = np.cumsum(c == 10)
    letter = _LETTERS[np.minimum(c, len(_LETTERS) - 1)]
    c, row = c[letter].astype(np.uint64), row[letter]
    n = len(c)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    with np.errstate(over="ignore"):
        roll = np.zeros(n, np.uint64)
        for k in range(window):
            roll[k:] += c[: n - k] * np.uint64(pow(0x9E3779B1, k + 1, 1 << 64))
        roll = ((roll ^ (roll >> np.uint64(17))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(1)
        first = np.concatenate([[True], row[1:] != row[:-1]])
        start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        never = np.uint64((1 << 64) - 1)
        roll[np.arange(n) - start < window - 1] = never  # the window would reach into the row before
        at = np.arange(n) + radius * np.cumsum(first)  # rows stand ``radius`` cells apart, so none sees another
        spread = np.full(at[-1] + 1 + radius, never)
        spread[at] = roll
        least = roll
        for k in range(-radius, radius + 1):
            least = np.minimum(least, spread[at + k])
        last = np.concatenate([first[1:], [True]]) | ((roll == least) & (roll != never))
        end = np.flatnonzero(last)
        begin = np.concatenate([[0], end[:-1] + 1])
        mixed = (c * np.uint64(0x94D049BB133111EB)) ^ (c << np.uint64(21))
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _P)]), dtype=np.uint64)
        inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(pow(int(_P), -1, 1 << 64)))]), dtype=np.uint64)
        total = np.concatenate([[np.uint64(0)], np.cumsum(mixed * power[:n], dtype=np.uint64)])
        h = (total[end + 1] - total[begin]) * inverse[begin]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return row[end], h.view(np.int64), (end - begin + 1)


def letters_only(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", "")


def distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance, or ``most`` + 1 where it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        lo, hi = max(1, i - most), min(len(b), i + most)
        last, row[lo - 1] = row[lo - 1], i if lo == 1 else most + 1
        low = row[lo - 1]
        for j in range(lo, hi + 1):
            up = row[j] if j < i + most else most + 1
            last, row[j] = row[j], min(up + 1, row[j - 1] + 1, last + (x != b[j - 1]))
            low = min(low, row[j])
        if low > most:
            return most + 1
    return row[len(b)]


def fits(line: list[str], row: list[str]) -> bool:
    """Whether a row differs from the line only in the open word and a few characters."""
    if len(row) < 2 or abs(len(line) - len(row)) > 2:
        return False
    most = max(2, sum(map(len, line)) // 15)
    if _HOLE not in line:
        return distance("".join(line), "".join(row), most) <= most
    at = line.index(_HOLE)
    head, tail = "".join(line[:at]), "".join(line[at + 1 :])
    for k in range(max(0, at - 1), min(len(row), at + 2)):  # the hole takes one word
        d = distance(head, "".join(row[:k]), most)
        if d <= most and d + distance(tail, "".join(row[k + 1 :]), most) <= most:
            return True
    return False


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0))


def _figureless(words: Column) -> Column:
    """The words that are not mostly figures."""
    return F.filter(words, lambda w: F.length(F.regexp_replace(w, r"\p{N}", "")) * 2 >= F.length(w))


def _slices(batches: Iterator[pd.DataFrame], most: int = 200_000) -> Iterator[pd.DataFrame]:
    """Runs of rows with about ``most`` characters: the arrays over characters stay small."""
    for b in batches:
        part = np.cumsum(b["text"].str.len().to_numpy()) // most
        for _, x in b.groupby(part, sort=False):
            yield x


def _mixed(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``chunks`` with the source mixed into the hash."""
    r, h, n = chunks(b["text"].tolist())
    with np.errstate(over="ignore"):
        h = (b["src"].to_numpy()[r].view(np.uint64) * _P ^ h.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return r, (h ^ (h >> np.uint64(29))).view(np.int64), n


def chunk_documents(rows: DataFrame) -> DataFrame:
    """(h, docs, enough): exact number of distinct documents of every chunk of a source, from rows (src, enough, doc_id, text).

    Counted in two steps: the pair of chunk and document is the first key, so no chunk is a hot one.
    """

    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _slices(batches):
            r, h, _ = _mixed(b)
            yield pd.DataFrame({"h": h, "enough": b["enough"].to_numpy()[r], "doc_id": b["doc_id"].to_numpy()[r]}).drop_duplicates()

    pairs = rows.select("src", "enough", "doc_id", "text").mapInPandas(seen, f"h bigint, enough bigint, doc_id {dict(rows.dtypes)['doc_id']}")
    once = pairs.groupBy("h", "doc_id").agg(F.max("enough").alias("enough"))
    return once.groupBy("h").agg(F.count(F.lit(1)).alias("docs"), F.max("enough").alias("enough"))


def repeated_lines(sentences: DataFrame, documents: DataFrame, doc_id: str, index: str, text: str, source: str, documents_id: str, documents_text: str, documents_source: str,
                   least: int = 5, share: float = 0.04, least_words: int = 4, covered: float = 0.3, clean: float = 0.75) -> DataFrame:
    """(source, doc_id, sentence_index, line): rows that are a line repeated excessively within their source.

    A line counts if it stands in at least ``least`` documents of its source and in at least
    ``share`` of them.  Distinct documents are counted exactly for every source and chunk; a chunk
    is repeated excessively if it stands in ``clean`` of the documents that a line needs (damaged
    copies lose some chunks).  Rows with at least ``covered`` of their letters in such chunks are
    candidates, and only these are compared as lines.
    Null texts and indices are no rows, a null source is a source, repeated rows come out once,
    texts are read whole, an empty table gives no rows.
    """
    kind = dict(sentences.dtypes)[doc_id]
    rows = sentences.select(F.coalesce(F.col(source), F.lit("")).alias("source"), F.col(doc_id).alias("doc_id"), F.col(index).alias("sentence_index"), F.col(text).alias("text"))
    rows = rows.filter(F.col("text").isNotNull() & F.col("sentence_index").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") >= 2 * least_words - 1))
    totals = documents.groupBy(F.coalesce(F.col(documents_source), F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("n_docs"))
    needed = cut_lineage(totals.select("source", F.xxhash64("source").alias("src"), F.greatest(F.lit(least), F.ceil(F.col("n_docs") * share)).cast("bigint").alias("enough")))  # one row per source

    counted = chunk_documents(rows.join(needed, "source"))
    heavy = cut_lineage(counted.filter(F.col("docs") >= clean * F.col("enough")).select("h"))  # at most (chunks per document) / (share * clean) a source

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _slices(batches):
            r, h, n = _mixed(b)
            share_ = n / np.bincount(r, n, len(b))[r]
            yield pd.DataFrame({"h": h, "part": share_, "letters": b["letters"].to_numpy()[r], **{c: b[c].to_numpy()[r] for c in ("row", "source", "doc_id", "sentence_index")}})

    keyed = rows.select("source", F.xxhash64("source").alias("src"), "doc_id", "sentence_index", "text", F.xxhash64(letters_only(F.col("text"))).alias("letters"), F.monotonically_increasing_id().alias("row"))
    each = keyed.mapInPandas(parts, f"h bigint, part double, letters bigint, row bigint, source string, doc_id {kind}, sentence_index int").join(heavy, "h")
    each = each.groupBy("row", "source", "doc_id", "sentence_index", "letters").agg(F.sum("part").alias("part"))
    near = cut_lineage(each.filter(F.col("part") >= covered).select("source", "doc_id", "sentence_index", "letters"))
    # a sentence of the prose cut off by a wrong split is no line: the row must fill one of its document
    whole = documents.filter(F.col(documents_text).isNotNull()).select(F.col(documents_id).alias("doc_id"), F.explode(F.split(documents_text, "\n")).alias("line"))
    whole = whole.withColumn("letters", F.xxhash64(letters_only(F.col("line")))).join(near.select("letters").distinct(), "letters", "left_semi")
    whole = whole.groupBy("doc_id", "letters").agg(_words(F.min("line")).alias("words")).filter(F.size("words") >= least_words)
    found = cut_lineage(near.join(whole.withColumn("words", _figureless(F.col("words"))), ["doc_id", "letters"]).withColumn("w", F.xxhash64("words")).drop("letters"))
    # a line is its words, or its words with one of them open; documents are counted by hashes
    texts = found.groupBy("source", "w").agg(F.any_value("words").alias("words"))
    open_ = F.transform(F.sequence(F.lit(0), F.size("words")), lambda i: F.transform("words", lambda w, j: F.when(i == j, _HOLE).otherwise(w)))
    forms = texts.filter("size(words) >= 3").select("source", "w", F.explode(open_).alias("line")).withColumn("l", F.xxhash64("line"))
    stands = found.select("source", "w", "doc_id").distinct().join(forms.select("source", "w", "l"), ["source", "w"])
    often = stands.groupBy("source", "l", "doc_id").agg(F.lit(1).alias("_1")).groupBy("source", "l").agg(F.count(F.lit(1)).alias("docs")).join(needed.select("source", "enough"), "source")
    # the line needs half its documents as clean copies; at most (rows per document) * 2 / share lines a source
    often = often.filter("docs * 2 >= enough").select("source", "l")
    lines = forms.select("source", "l", "line").dropDuplicates(["source", "l"]).join(often, ["source", "l"]).groupBy("source").agg(F.sort_array(F.collect_list("line")).alias("lines"))

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for src, key, w, cand in zip(b["source"], b["w"], b["words"], b["lines"]):
                out += [(src, key, " ".join(x)) for x in cand if fits(list(x), list(w))]
            yield pd.DataFrame(out, columns=["source", "w", "line"])

    many = int(sentences.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work: not to be put into one task
    matched = cut_lineage(texts.join(lines, "source").repartition(many, "w").mapInPandas(match, "source string, w bigint, line string"))
    said = found.join(matched, ["source", "w"])
    full = said.groupBy("source", "line", "doc_id").agg(F.lit(1).alias("_1")).groupBy("source", "line").agg(F.count(F.lit(1)).alias("docs")).join(needed.select("source", "enough"), "source").filter("docs >= enough")
    best = matched.join(full.select("source", "line", "docs"), ["source", "line"]).groupBy("source", "w").agg(F.max_by("line", F.struct("docs", "line")).alias("line"))
    return found.join(best, ["source", "w"]).select("source", "doc_id", "sentence_index", "line").distinct()
