"""Problem 2: frequency of every distinct term, in occurrences and in records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.session import cut_lineage

_EDGE = r"^[^\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}]+$"


def clean_term(token: Column) -> Column:
    """Lower case, freed at both ends of all that is not a letter, mark or digit."""
    return F.lower(F.regexp_replace(token, _EDGE, ""))


def term_frequencies(rows: DataFrame, record: Column, tokens: Column, rare_at_most: int = 2, common_share: float = 0.25) -> DataFrame:
    """(term, occurrences, records, n_records, mark) of every distinct term.

    Counts are first combined per task and record, then shuffled by (record, term), combined
    again per task, and only then shuffled by term: a term or a record that holds a third of
    all rows arrives as one partial sum per task.  A term in at most ``rare_at_most`` records is
    ``rare``, else one in at least ``common_share`` of the records with a term is ``common``.
    Null or empty token lists, null tokens and tokens without a letter, mark or digit give no
    term; a null record is a record of its own; an empty table gives no rows.
    """
    known = F.filter(tokens, lambda t: t.rlike(r"[\p{L}\p{M}\p{N}]"))
    # a null term in front of a row's terms counts the records in the same pass
    marked = F.when(F.size(known) > 0, F.concat(F.array(F.lit(None).cast("string")), known))
    one = rows.select(record.alias("_r"), F.explode(marked).alias("_t")).select("_r", clean_term(F.col("_t")).alias("term"))
    per_record = one.groupBy("_r", "term").agg(F.count(F.lit(1)).alias("_c"))
    terms = cut_lineage(per_record.groupBy("term").agg(F.sum("_c").alias("occurrences"), F.count(F.lit(1)).alias("records")))
    n = terms.filter(F.col("term").isNull()).agg(F.coalesce(F.max("records"), F.lit(0)).alias("n_records"))
    mark = F.when(F.col("records") <= rare_at_most, "rare").when(F.col("records") >= common_share * F.col("n_records"), "common")
    return terms.filter(F.col("term").isNotNull()).crossJoin(F.broadcast(n)).withColumn("mark", mark)  # n is one row
