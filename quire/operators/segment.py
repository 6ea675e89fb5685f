"""Segmentation and contexts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A sentence ends at a mark before blanks and a capital, or before the end of a line.
SPLIT = r"(?m)(?<=[.!?])\s+(?=[A-Z])|(?<=[.!?])\s*$"


def split_sentences(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, sent_idx, sentence_text): trimmed, without empty ones. Null texts give no rows."""
    parts = F.filter(F.transform(F.split(F.col(text), SPLIT), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(parts).alias("sent_idx", "sentence_text"))


def context(sentences: DataFrame, doc_id: str, index: str, text: str, before: int, after: int) -> Column:
    """The texts of the sentences from ``before`` ahead to ``after`` behind, joined by blanks.

    Negative bounds leave the sentence itself out. One shuffle by document serves every context.
    """
    w = Window.partitionBy(doc_id).orderBy(index).rowsBetween(before, after)
    return F.concat_ws(" ", F.collect_list(text).over(w))


def annotate(sentences: DataFrame, annotator: Callable[[list[str]], list[list[dict]]], text: str = "sentence_text") -> DataFrame:
    """Adds ``tokens`` (text, lemma, pos, dep, head, head_i, i; sentence-local) from any parser, one call a batch."""
    kind = "array<struct<text:string,lemma:string,pos:string,dep:string,head:string,head_i:int,i:int>>"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sentences.schema) + f", tokens {kind}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(tokens=annotator(b[text].fillna("").tolist()))

    return sentences.mapInPandas(run, schema)


def whitespace_annotator(texts: list[str]) -> list[list[dict]]:
    """The fallback without a parser: blank-separated tokens with placeholder tags."""
    return [[{"text": w, "lemma": w.lower(), "pos": "X", "dep": "dep", "head": w, "head_i": 0, "i": i} for i, w in enumerate(t.split())] for t in texts]


#: Word classes of the keyness modes; the last one keeps all but names.
POS_MODES = {"content_words": ["NOUN", "ADJ", "VERB"], "adjectives_only": ["ADJ"], "verbs_only": ["VERB"], "no_proper_nouns": None}


def pos_lemmas(tokens: Column, mode: str, stop: list[str], least: int = 2) -> Column:
    """Lemmas of annotated tokens of the mode's word classes: letters only, no stop words, no names."""
    wanted = POS_MODES[mode]
    kept = F.filter(tokens, lambda t: t["text"].rlike(r"^\p{L}+$") & (t["pos"] != "PROPN") & (t["pos"].isin(wanted) if wanted else F.lit(True)) & ~F.lower(t["lemma"]).isin(stop) & (F.length(t["lemma"]) >= least))
    return F.transform(kept, lambda t: F.lower(t["lemma"]))
