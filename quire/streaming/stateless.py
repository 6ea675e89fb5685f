"""The stateless operators over a stream: cleaning, segmentation, extraction and labels need no state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import clean_text
from quire.operators.label import representation, situation
from quire.operators.mentions import extract
from quire.operators.segment import split_sentences


def labelled_stream(documents: DataFrame, groups: dict, r_lexicon: dict, o_lexicon: dict, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Mentions with sentence-level labels from a stream (or table) of documents."""
    s = split_sentences(documents.withColumn(text, clean_text(F.col(text), unicode=False)), doc_id, text)
    m = extract(s, groups, "sentence_text")
    return situation(representation(m, "sentence_text", F.array().cast("array<string>"), F.lit(0.4), r_lexicon), "sentence_text", o_lexicon)
