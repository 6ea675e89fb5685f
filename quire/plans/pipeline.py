"""The whole run: documents -> sentences -> mentions -> flags -> labels -> tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire import lexicons as L
from quire.operators import aggregates as A
from quire.operators import graph as G
from quire.operators.evidence import evidence_pack, passport
from quire.operators.label import ESSENTIAL, label_mentions
from quire.operators.mentions import groups_of, mentions_table
from quire.operators.noise import interaction_sentence, noise_flags
from quire.operators.segment import split_sentences
from quire.session import cut_lineage


def run(documents: DataFrame, lexicon: DataFrame, doc_id: str = "id", text: str = "raw_text", file_name: str = "filename",
        r_lexicon: dict = L.REPRESENTATION, o_lexicon: dict = L.SITUATION, verbs: dict = L.VERBS, patterns: list = ESSENTIAL) -> dict[str, DataFrame]:
    """All stage tables by name. Sentences and labelled mentions feed several of them and are written out once."""
    groups = groups_of(lexicon)
    sentences = cut_lineage(split_sentences(documents, doc_id, text))
    names = documents.select(F.col(doc_id).alias("doc_id"), F.col(file_name).alias("file_name"))
    mentions = mentions_table(sentences, groups, "doc_id", "sent_idx", "sentence_text").join(names, "doc_id", "left")
    raw = cut_lineage(label_mentions(noise_flags(mentions), groups, r_lexicon, o_lexicon, patterns))
    clean = raw.filter(~F.col("is_noise"))
    hits = G.plain_interactions(sentences, groups, verbs, interaction_sentence(F.col("sentence_text")), "doc_id", "sent_idx", "sentence_text")
    edges = cut_lineage(G.edges_of(hits))
    essential = raw.filter("is_essentializing").groupBy("ethnos_norm").agg(F.count(F.lit(1)).alias("n"))
    n = sentences.agg(F.count(F.lit(1)).alias("n_sentences"))
    sets = G.entity_sets(sentences, groups, "doc_id", "sent_idx", "sentence_text", (1, 2, 3))
    return {
        "sentences": sentences, "raw": raw, "clean": clean, "edges": edges, "robust_edges": G.robust_edges(edges), "comentions": G.pairs_of(sets), "npmi": G.npmi(sets),
        "profiles": A.profiles(raw, essential, edges, n), "rates": A.rates(clean, "ethnos_norm"), "keyness_r": A.keyness_against(clean, "r_label", "context_text", L.STOP_KEYNESS),
        "keyness_entity": A.keyness_rest(clean, "ethnos_norm", "context_text", L.STOP_KEYNESS), "evidence": evidence_pack(clean, ["doc_id", "sent_idx", "ethnos_norm"]), "passport": passport(raw),
    }
