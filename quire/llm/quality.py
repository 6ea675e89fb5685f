"""Problem 4: per-document text quality statistics and an induced rule list.

Statistics are native column expressions.  An ordered rule list is induced by incremental
reduced-error pruning on a bounded sample of labelled documents; its thresholds become a SQL
CASE expression that labels every document natively.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.session import cut_lineage

STATISTICS = ("terminal_share", "digit_share", "symbol_share", "words_per_row", "mean_word_length", "common_share", "distinct_share", "lower_share", "enumerated_share")

#: Marks that may close a sentence, with closing quotes or brackets after them.
_TERMINAL = r"[.!?…。！？।][”’\"»“'\)\]]*\s*$"
#: A sentence that ends within a row: a row merged from several has its marks there.
_INSIDE = r"[\p{L}\p{M}]{3,}[.!?…][”’\"»“'\)]*\s+[“„«\"‘(]*\p{Lu}\p{L}"
_ENUMERATED = r"^\s*(?:\(?[0-9]+[.)]|[-•*▪])\s+\S"
_UNSPACED = r"[฀-๿㐀-鿿]"
_PLAIN = r"[\p{L}\p{M}\p{N}\s.,;:!?'\"“”‘’„«»()\[\]\-–—…。，！？、；：।]"


def skeleton(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}]+", "")


def counted_keys(rows: DataFrame) -> DataFrame:
    """(h, doc_id, word, n): rows by line of letters and document, and by word, from one pass over (doc_id, text).

    Lines of fewer than ten letters have h null; a word row has only ``word``.
    """
    line = skeleton(F.col("text"))
    with_line = rows.select("doc_id", "text", line.alias("_line"))
    h = F.when(F.length("_line") >= 10, F.xxhash64("_line"))
    words = F.filter(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{M}]+")), lambda w: w != "")
    no = F.lit(None).cast(rows.schema["doc_id"].dataType)
    each = F.concat(F.array(F.struct(h.alias("h"), F.col("doc_id").alias("doc_id"), F.lit(None).cast("string").alias("word"))),
                    F.transform(words, lambda w: F.struct(F.lit(None).cast("bigint").alias("h"), no.alias("doc_id"), w.alias("word"))))
    return with_line.select(F.explode(each).alias("k")).groupBy("k.h", "k.doc_id", "k.word").agg(F.count(F.lit(1)).alias("n"))


def row_statistics(text: Column, words: Column, common: list[str]) -> dict[str, Column]:
    """Statistics of a row and its ``words`` (letters, marks, digits, inner apostrophes and hyphens)."""
    length = F.length(text)
    native = text.rlike(_UNSPACED) & (F.length(F.regexp_replace(text, _UNSPACED + "+", "")) * 2 < length)
    terminal = text.rlike(_TERMINAL) & text.rlike(r"\S\s+\S+\s+\S+\s+\S")
    return {
        "chars": length,
        "digits": length - F.length(F.translate(text, "0123456789", "")),
        "symbols": F.length(F.regexp_replace(text, _PLAIN + "+", "")),
        "native": native,
        "terminal": native | terminal | (text.rlike(_INSIDE) & (F.size(words) >= 10)),
        "enumerated": text.rlike(_ENUMERATED),
        "n_words": F.size(words),
        "n_common": F.size(F.filter(words, lambda w: F.lower(w).isin(common))) if common else F.lit(0),
        "n_lower": F.regexp_count(text, F.lit(r"(?<![\p{L}\p{M}\p{N}'’-])[\p{Ll}\p{Lo}][\p{Ll}\p{Lo}\p{M}'’-]++(?![\p{Lu}\p{Lt}\p{Lm}\p{N}])")),
        "n_distinct": F.size(F.array_distinct(F.transform(words, F.lower))),
        "letters": F.length(F.array_join(words, "")),
    }


def document_statistics(rows: DataFrame, doc_id: str, index: str, text: str, repeated: float = 0.005, least: int = 5, common: float = 0.003) -> DataFrame:
    """One row per document: its STATISTICS, ``n_rows`` and ``natural_share``.

    Rows whose letters stand in at least ``least`` documents and ``repeated`` of all (house lines)
    do not count; a document with no other rows has n_rows 0 and is taken for prose.  A sentence row
    loaded twice counts once.  Null texts and null indices are left out; an empty text counts as a
    row without words; an empty table gives no rows.
    """
    base = rows.select(F.col(doc_id).alias("doc_id"), F.col(index).alias("i"), F.col(text).alias("text")).filter("text is not null and i is not null")
    keys = cut_lineage(counted_keys(base))
    lines = keys.filter("word is null")
    n_rows, n_docs = lines.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_distinct("doc_id")).first()
    # words standing in at least ``common`` of the rows: at most (words per row) / common of them
    words_ = keys.filter(F.col("word").isNotNull() & (F.col("n") >= max(2.0, common * n_rows))).select("word").collect()
    common_ = sorted(r["word"] for r in words_)
    by_line = lines.filter("h is not null").groupBy("h").agg(F.count(F.lit(1)).alias("docs"))
    house = cut_lineage(by_line.filter(F.col("docs") >= max(float(least), repeated * n_docs)).select("h", F.lit(0).alias("own")))  # at most (rows per document) / repeated
    own = base.withColumn("h", F.xxhash64(skeleton(F.col("text")))).join(house, "h", "left").withColumn("own", F.coalesce("own", F.lit(1)))
    own = own.withColumn("words", F.filter(F.split("text", r"[^\p{L}\p{M}\p{N}'’-]+"), lambda w: w != ""))  # split once for all that follows
    s = row_statistics(F.col("text"), F.col("words"), common_)
    r = own.select("doc_id", "i", "own", *[v.alias(k) for k, v in s.items()])
    natural = ~F.col("enumerated") & (F.col("native") & (F.col("chars") >= 6) | F.col("terminal") & (F.col("n_words") >= 5) & (F.col("n_lower") >= 3))
    r = r.withColumns({"natural": F.when(natural, F.col("chars")).otherwise(0), "n_native": F.when(F.col("native"), F.col("n_words")).otherwise(0),
                       **{c: F.when(F.col(c), F.col("chars")).otherwise(0) for c in ("terminal", "enumerated")}}).drop("native")
    r = r.groupBy("doc_id", "i").agg(*[F.max(c).alias(c) for c in r.columns if c not in ("doc_id", "i")])
    total = {c: F.sum(F.col(c) * F.col("own")) for c in ("chars", "digits", "symbols", "terminal", "natural", "enumerated", "n_words", "n_common", "n_lower", "n_distinct", "letters", "n_native")}
    chars, words = F.greatest(total["chars"], F.lit(1)), F.greatest(total["n_words"], F.lit(1))
    n_rows = F.sum("own")
    return r.groupBy("doc_id").agg(
        n_rows.alias("n_rows"), total["n_words"].alias("n_words"), (total["terminal"] / chars).alias("terminal_share"), (total["digits"] / chars).alias("digit_share"),
        (total["symbols"] / chars).alias("symbol_share"), (words / F.greatest(n_rows, F.lit(1))).alias("words_per_row"), (total["letters"] / words).alias("mean_word_length"),
        (F.greatest(total["n_common"], total["n_native"]) / words).alias("common_share"), (total["n_distinct"] / words).alias("distinct_share"),
        (F.greatest(total["n_lower"], total["n_native"]) / words).alias("lower_share"), (total["enumerated"] / chars).alias("enumerated_share"), (total["natural"] / chars).alias("natural_share"),
    )


Rule = list[tuple[str, str, float]]


def _covers(x: np.ndarray, rule: list[tuple[int, int, float]]) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for f, sign, t in rule:
        hit &= x[:, f] * sign > t * sign
    return hit


def induce(x: np.ndarray, y: np.ndarray, names: tuple[str, ...], seed: int = 5, most_rules: int = 12) -> list[Rule]:
    """Ordered rules for the positive class by incremental reduced-error pruning.

    Each rule is grown on two thirds of the rows by FOIL gain, then shortened from its end while
    that raises (p - n) / (p + n) on the rest; it is kept if it is right more often than wrong
    there, and the rows it covers are taken away.
    """
    rng = np.random.default_rng(seed)
    rules: list[Rule] = []
    left = np.ones(len(x), bool)
    while y[left].any() and len(rules) < most_rules:
        at = rng.permutation(np.flatnonzero(left))
        pos, neg = at[y[at]], at[~y[at]]
        grow = np.concatenate([pos[: -(len(pos) // 3) or None], neg[: -(len(neg) // 3) or None]])
        prune = np.concatenate([pos[len(pos) - len(pos) // 3 :], neg[len(neg) - len(neg) // 3 :]])
        if not len(pos) // 3:
            prune = at
        rule: list[tuple[int, int, float]] = []
        rows = grow
        while len(rows) and (~y[rows]).any() and len(rule) < 6:
            p0, n0 = y[rows].sum(), (~y[rows]).sum()
            best = (1e-9, 0.0, None)
            for f in range(x.shape[1]):
                order = rows[np.argsort(x[rows, f], kind="stable")]
                v, yy = x[order, f], y[order]
                cuts = np.flatnonzero(np.diff(v) > 1e-12)
                if not len(cuts):
                    continue
                below_p, below_n = np.cumsum(yy)[cuts], np.cumsum(~yy)[cuts]
                for sign, p, n in ((-1, below_p, below_n), (1, p0 - below_p, n0 - below_n)):
                    with np.errstate(divide="ignore", invalid="ignore"):
                        gain = np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), -1)
                    k = int(np.argmax(gain))
                    if gain[k] > best[0] + 1e-9 or abs(gain[k] - best[0]) <= 1e-9 and v[cuts[k] + 1] - v[cuts[k]] > best[1]:
                        best = (float(gain[k]), float(v[cuts[k] + 1] - v[cuts[k]]), (f, sign, float(v[cuts[k]] + v[cuts[k] + 1]) / 2))
            if best[2] is None:
                break
            rule.append(best[2])
            rows = grow[_covers(x[grow], rule)]

        def worth(r: list) -> float:
            hit = prune[_covers(x[prune], r)]
            return (y[hit].sum() - (~y[hit]).sum()) / max(len(hit), 1)

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        if not rule or worth(rule) <= 0:
            break
        rules.append([(names[f], ">" if s > 0 else "<", t) for f, s, t in rule])
        left &= ~_covers(x, rule)
    return rules


def to_case(rules: list[Rule], positive: str = "other", default: str = "prose") -> str:
    """The rule list as a SQL CASE expression, first match wins."""
    when = " ".join("WHEN " + " AND ".join(f"{f} {op} {t!r}" for f, op, t in r) + f" THEN '{positive}'" for r in rules)
    return f"CASE WHEN n_rows = 0 THEN '{default}' {when} ELSE '{default}' END"


def learn_rules(statistics: DataFrame, sample_rows: int = 20_000, sure: tuple[float, float] = (0.3, 0.75)) -> list[Rule]:
    """Rules from about ``sample_rows`` documents (of smallest hashed id, at most twice as many).

    A document is labelled other than prose where at most ``sure[0]`` of its characters lie in rows
    that look like whole sentences, prose from ``sure[1]``; those between teach nothing.
    """
    some = statistics.filter("n_rows > 0")
    below = -(1 << 63) + min((1 << 64) - 1, (sample_rows << 64) // max(1, some.count()))  # hashes are even over 64 bits
    pdf: pd.DataFrame = some.filter(F.xxhash64("doc_id") <= below).limit(2 * sample_rows).toPandas().sort_values("doc_id", kind="stable")
    known = pdf[(pdf["natural_share"] <= sure[0]) | (pdf["natural_share"] >= sure[1])]
    return induce(known[list(STATISTICS)].to_numpy(float), (known["natural_share"] <= sure[0]).to_numpy(), STATISTICS)


def classify(statistics: DataFrame, rules: list[Rule]) -> DataFrame:
    return statistics.withColumn("kind", F.expr(to_case(rules)))


def text_quality(rows: DataFrame, doc_id: str = "doc_id", index: str = "sentence_index", text: str = "text") -> DataFrame:
    """Statistics and ``kind`` ('prose' or 'other') of every document."""
    s = cut_lineage(document_statistics(rows, doc_id, index, text))
    return classify(s, learn_rules(s))
