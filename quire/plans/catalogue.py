"""The query catalogue of the core operators, each with its DuckDB statement where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import lexicons as L
from quire.functions import stats as ST
from quire.functions import text as T
from quire.operators import aggregates as A
from quire.operators import evidence as E
from quire.operators import graph as G
from quire.operators import label as B
from quire.operators import mentions as M
from quire.operators import noise as N
from quire.operators import segment as S
from quire.plans import oracle as O
from quire.session import cut_lineage, table
from quire.sources import bibliography as BIB
from quire.sources import corpus as C

_ALL: dict[str, tuple[Callable, str | None]] = {}


class Tables:
    """The driver's tables as the operators want them."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def t(self, name: str) -> DataFrame:
        return table(self.spark, self.dir, name)

    @cached_property
    def groups(self) -> dict[str, list[str]]:
        return M.groups_of(self.t("lexicon_entities"))

    @cached_property
    def known(self) -> set[str]:
        """The words of all lexicons, for the spell fix."""
        return L.known_words(self.groups, L.REPRESENTATION, L.SITUATION, targets=L.REPLACEMENTS)

    @cached_property
    def s(self) -> DataFrame:
        """Sentences, rows loaded again counted once."""
        return self.t("sentences").groupBy("doc_id", F.col("sentence_index").alias("sent_idx")).agg(F.min("text").alias("sentence_text"))

    @cached_property
    def m(self) -> DataFrame:
        """Mention rows with canonical names."""
        lex = self.t("lexicon_entities").groupBy(F.lower("variant").alias("_v")).agg(F.min("canonical").alias("_c"))
        m = self.t("mentions").join(F.broadcast(lex), F.col("ethnos").isNull() & (F.lower("ethnos_raw") == F.col("_v")), "left")  # the lexicon: one row per form
        return m.withColumn("ethnos_norm", F.coalesce("ethnos", "_c")).drop("_v", "_c", "ethnos", "extracted_at")

    @cached_property
    def raw(self) -> DataFrame:
        return N.noise_flags(self.m)

    @cached_property
    def labelled(self) -> DataFrame:
        return B.label_mentions(self.raw, self.groups, L.REPRESENTATION, L.SITUATION, B.ESSENTIAL_PAST)

    @cached_property
    def clean(self) -> DataFrame:
        return self.labelled.filter(~F.col("is_noise"))

    def sets(self, *w: int) -> DataFrame:
        return G.entity_sets(self.s, self.groups, "doc_id", "sent_idx", "sentence_text", w)

    @cached_property
    def hits(self) -> DataFrame:
        return G.plain_interactions(self.s, self.groups, L.VERBS, N.interaction_sentence(F.col("sentence_text")), "doc_id", "sent_idx", "sentence_text")

    @cached_property
    def edges(self) -> DataFrame:
        return G.edges_of(self.hits)

    @cached_property
    def flat_edges(self) -> DataFrame:
        return self.hits.filter("src <> dst").groupBy("src", "dst", "type").agg(F.count(F.lit(1)).alias("n"))

    @cached_property
    def essential(self) -> DataFrame:
        return self.labelled.filter("is_essentializing").groupBy("ethnos_norm").agg(F.count_distinct("doc_id", "sent_idx").alias("n"))

    @cached_property
    def profiles(self) -> DataFrame:
        # five aggregates read the labels: they are written out once, without the texts
        few = cut_lineage(self.labelled.select("doc_id", "sent_idx", "ethnos_norm", "r_label", "o_label", "is_noise", "is_essentializing"))
        essential = few.filter("is_essentializing").groupBy("ethnos_norm").agg(F.count_distinct("doc_id", "sent_idx").alias("n"))
        return A.profiles(few, essential, self.flat_edges, self.s.agg(F.count(F.lit(1)).alias("n_sentences")))


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[Tables], DataFrame]) -> Callable:
        _ALL[f.__name__] = (f, sql)
        return f

    return add


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Sums of doubles depend on their order in the last digits."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- text -------------------------------------------------------------------------------------


@query(O.CLEAN_TEXT)
def clean_text_sql(t: Tables) -> DataFrame:
    x = T.squeeze(T.replace_words(T.dehyphenate(T.fold_quotes(F.col("raw_text"))), L.REPLACEMENTS))
    return t.t("corpus_documents").select("id", F.md5(x).alias("cleaned"), F.length(x).alias("n"))


@query()
def clean_text(t: Tables) -> DataFrame:
    return t.t("corpus_documents").select("id", T.clean_text(F.col("raw_text"), L.REPLACEMENTS).alias("text"))


@query(O.SENTENCE_SPLIT)
def sentence_split(t: Tables) -> DataFrame:
    return S.split_sentences(t.t("documents"), "doc_id", "text").select("doc_id", "sent_idx", F.md5("sentence_text").alias("h"))


@query(O.CONTEXT_WINDOW)
def context_window(t: Tables) -> DataFrame:
    c = lambda a, b: F.md5(S.context(t.s, "doc_id", "sent_idx", "sentence_text", a, b))
    return t.s.select("doc_id", "sent_idx", c(-4, 4).alias("around"), c(-2, -1).alias("prev"), c(1, 2).alias("next"))


@query(O.TOKENS_AZ)
def tokens_az(t: Tables) -> DataFrame:
    return t.s.select(F.explode(T.az_words(F.col("sentence_text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query(O.TOKENS_DOTTED)
def tokens_dotted(t: Tables) -> DataFrame:
    return t.m.select(F.explode(T.dotted_words(F.col("context_text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query(O.SENTENCE_NORM)
def sentence_norm(t: Tables) -> DataFrame:
    return t.m.select("mention_id", T.sentence_norm(F.col("sentence_text"), L.STOP_NOISE).alias("norm"))


@query(O.GARBAGE)
def ocr_garbage_words(t: Tables) -> DataFrame:
    return A.garbage_words(t.m, "context_text")


@query(O.KWIC)
def kwic(t: Tables) -> DataFrame:
    return A.concordance(t.s, "sentence_text", ["doc_id", "sent_idx"])


# --- mentions ---------------------------------------------------------------------------------


@query(O.MENTION_EXTRACT)
def mention_extract(t: Tables) -> DataFrame:
    return M.extract(t.s, t.groups, "sentence_text").groupBy("doc_id", "sent_idx", "entity", "surface").agg(F.count(F.lit(1)).alias("n"))


@query(O.MENTIONS_TABLE)
def mentions_table(t: Tables) -> DataFrame:
    m = M.mentions_table(t.s, t.groups, "doc_id", "sent_idx", "sentence_text")
    return m.groupBy("doc_id", "sent_idx", "ethnos_norm", "ethnos_raw", "doc_sent_count").agg(F.count(F.lit(1)).alias("n"), F.md5(F.max("context_text")).alias("context"))


@query(O.LEMMA_MENTIONS)
def lemma_mentions(t: Tables) -> DataFrame:
    s = t.s.withColumn("lemmas", T.az_words(F.col("sentence_text")))
    return M.lemma_mentions(s, sorted(t.groups), "doc_id", "sent_idx", "lemmas").groupBy("ethnos_norm").agg(F.count(F.lit(1)).alias("n"))


@query(O.RANGE_MENTIONS)
def range_mentions(t: Tables) -> DataFrame:
    hit = M.text_positions(t.t("corpus_documents"), t.groups, "id", "raw_text")
    s = t.t("sentences").filter("start_char is not null").select("doc_id", "sentence_index", "start_char", "end_char").distinct()
    return M.range_mentions(hit, s)


@query(O.DOC_SELECTOR)
def doc_selector(t: Tables) -> DataFrame:
    return M.select_documents(t.t("corpus_documents"), "filename", ["Journey_among", "copy_of_", "1890"]).select("id", "filename")


@query(O.DOC_SENTENCES)
def document_sentences(t: Tables) -> DataFrame:
    d = t.t("corpus_documents").select(F.col("id").alias("doc_id"), "filename")
    return t.t("sentences").join(d, "doc_id").select("doc_id", "filename", "id", "sentence_index")


@query(O.FIRST_ENTITY)
def first_entity(t: Tables) -> DataFrame:
    e = F.lit(None).cast("string")
    for k, forms in reversed(t.groups.items()):
        e = F.when(F.col("sentence_text").rlike(M.pattern_of(forms)), k).otherwise(e)
    return t.s.select("doc_id", "sent_idx", e.alias("entity")).filter("entity is not null")


@query(O.EVIDENCE_ROWS)
def evidence_rows(t: Tables) -> DataFrame:
    e = E.evidence_rows(t.s, t.groups, "doc_id", "sent_idx", "sentence_text")
    return e.groupBy("doc_id", "sent_idx", "entity", "doc_position_bucket", "pointer").agg(F.count(F.lit(1)).alias("n"), F.md5(F.max("context_prev")).alias("prev"), F.md5(F.max("context_next")).alias("next"))


@query(O.OFFSETS)
def filled_offsets(t: Tables) -> DataFrame:
    s = t.t("sentences").groupBy("doc_id", "sentence_index").agg(F.min("text").alias("text"), F.min("start_char").alias("start_char"), F.min("end_char").alias("end_char"))
    return C.filled_offsets(s, "doc_id", "sentence_index", "text").select("doc_id", "sentence_index", "start_char", "end_char")


# --- noise ------------------------------------------------------------------------------------


@query(O.POSITION)
def position_bucket(t: Tables) -> DataFrame:
    p = F.col("doc_position_percent")
    return t.m.select("mention_id", N.position_bucket(p).alias("bucket"), N.position_bucket_pct(p).alias("pct"))


@query(O.FLAGS)
def noise_flags(t: Tables) -> DataFrame:
    return t.raw.select("mention_id", "is_position_header_footer", "is_cross_doc_header_footer", "is_global_repeat", "is_probable_header_footer", "is_noise", "noise_reason")


@query(O.REPEAT)
def noise_position_repeat(t: Tables) -> DataFrame:
    return t.raw.filter("is_position_header_footer").select("mention_id", "sentence_norm", "position_bucket_pct")


@query(O.CROSS)
def noise_cross_doc(t: Tables) -> DataFrame:
    return t.raw.filter("is_cross_doc_header_footer").select("mention_id", "sentence_norm")


@query(O.HEADER)
def noise_header_footer(t: Tables) -> DataFrame:
    return t.raw.filter("is_probable_header_footer").select("mention_id")


@query(O.SUMMARY)
def noise_position_summary(t: Tables) -> DataFrame:
    return N.position_summary(t.raw)


@query(O.TOP_REPEATS)
def noise_top_repeats(t: Tables) -> DataFrame:
    return N.top_repeats(t.raw, "sentence_norm")


@query(O.EVIDENCE_NOISE)
def evidence_noise(t: Tables) -> DataFrame:
    return N.evidence_noise(t.s).select("doc_id", "sent_idx", "doc_position_bucket", "is_noise", "noise_reason")


@query(O.EVIDENCE_REPEATS)
def evidence_top_repeats(t: Tables) -> DataFrame:
    return N.evidence_top_repeats(N.evidence_noise(t.s))


@query(O.PREDICATES)
def sentence_predicates(t: Tables) -> DataFrame:
    x = F.col("sentence_text")
    return t.s.select("doc_id", "sent_idx", N.translator_noise(x).alias("translator"), N.content_sentence(x).alias("content"), N.interaction_sentence(x).alias("interaction"), N.index_like(x).alias("index_like"))


# --- labels -----------------------------------------------------------------------------------


@query(O.R_CLASSIFY)
def r_classify(t: Tables) -> DataFrame:
    return t.labelled.select("mention_id", "score_negative", "score_exotic", "score_positive", "r_label", "r_confidence")


@query(O.R_PRIORITY)
def r_classify_priority(t: Tables) -> DataFrame:
    return t.m.select("mention_id", B.representation_priority(F.col("context_text"), L.REPRESENTATION).alias("r"))


@query(O.O_CLASSIFY)
def o_classify(t: Tables) -> DataFrame:
    return t.labelled.select("mention_id", "o_label", "o_confidence")


@query(O.EPITHETS)
def epithets_window(t: Tables) -> DataFrame:
    return t.m.select("mention_id", F.explode(B.window_epithets(F.col("sentence_text"), F.col("ethnos_raw"))).alias("epithet"))


@query(O.ESSENTIAL)
def essentialization_detect(t: Tables) -> DataFrame:
    return t.labelled.filter("is_essentializing").select("mention_id", "essentialization_pattern", "essentialization_span")


@query(O.ESSENTIAL_TABLE)
def essentialization_table(t: Tables) -> DataFrame:
    return t.essential


@query(O.ESSENTIAL_EXAMPLES)
def essentialization_examples(t: Tables) -> DataFrame:
    x = t.labelled.filter("is_essentializing").withColumn("norm", F.trim(F.regexp_replace(F.lower("sentence_text"), r"\s+", " ")))
    return x.groupBy("ethnos_norm", "norm").agg(F.min("mention_id").alias("mention_id"))


@query(O.PATTERN_STATS)
def pattern_stats(t: Tables) -> DataFrame:
    p = B.first_pattern(F.col("sentence_text"), B.ESSENTIAL_PAST)
    return t.m.select("ethnos_norm", p.alias("pattern")).filter("pattern is not null").groupBy("ethnos_norm", "pattern").agg(F.count(F.lit(1)).alias("n"))


@query(O.PATTERN_STATS_TRANSLATOR)
def pattern_stats_translator(t: Tables) -> DataFrame:
    p = B.first_pattern(F.col("sentence_text"), B.TRANSLATOR)
    return t.m.select("ethnos_norm", p.alias("pattern")).filter("pattern is not null").groupBy("ethnos_norm", "pattern").agg(F.count(F.lit(1)).alias("n"))


@query(O.ESSENTIAL_CORPUS)
def essentialization_corpus(t: Tables) -> DataFrame:
    return B.corpus_essentialising(M.extract(t.s, t.groups, "sentence_text"), "doc_id", "sent_idx", "sentence_text").groupBy("ethnos_norm").agg(F.count(F.lit(1)).alias("n"))


@query(O.MARKERS)
def exotic_markers(t: Tables) -> DataFrame:
    return B.marker_counts(t.m, "ethnos_norm", "context_text", L.REPRESENTATION["exotic"])


@query(O.LANDSCAPE)
def landscape_cooccurrence(t: Tables) -> DataFrame:
    return B.marker_counts(t.m, "ethnos_norm", "context_text", L.LANDSCAPE)


@query(O.PITFALLS)
def pitfalls(t: Tables) -> DataFrame:
    return B.pitfall_words(t.m.select("mention_id", "context_text"), "context_text", L.REPRESENTATION["negative"]).select("mention_id", "pitfall")


@query(O.CONFIDENCE)
def global_confidence(t: Tables) -> DataFrame:
    return t.labelled.select("mention_id", B.confidence_score(F.lit("fallback_window"), F.col("r_confidence"), F.col("o_confidence"), F.col("is_essentializing"), F.lit(False)).alias("confidence"))


@query(O.PIRO)
def piro(t: Tables) -> DataFrame:
    return t.labelled.select("mention_id", "ethnos_norm", "r_label", "o_label", "is_essentializing", F.size("epithets").alias("n_epithets"), "pointer")


# --- aggregates -------------------------------------------------------------------------------


@query(O.COUNTS_BY_DOC)
def counts_by_doc(t: Tables) -> DataFrame:
    return A.document_rates(A.counts_by_document(t.m, "ethnos_norm"))


@query(O.rates("ethnos_norm"))
def rates_entity(t: Tables) -> DataFrame:
    return _rounded(A.rates(t.clean, "ethnos_norm"), "mean_rate", "median_rate")


@query(O.rates("r_label"))
def rates_r(t: Tables) -> DataFrame:
    return _rounded(A.rates(t.clean, "r_label"), "mean_rate", "median_rate")


@query(O.rates("o_label"))
def rates_o(t: Tables) -> DataFrame:
    return _rounded(A.rates(t.clean, "o_label"), "mean_rate", "median_rate")


@query()
def bootstrap_rates(t: Tables) -> DataFrame:
    return A.bootstrap_mean(A.document_rates(A.counts_by_document(t.clean, "ethnos_norm")), "group", "rate", "doc_id")


@query()
def bootstrap_oi(t: Tables) -> DataFrame:
    x = t.clean.withColumn("hit", F.col("r_label").isin("negative", "exotic").cast("int"))
    return A.bootstrap_mean(x, "ethnos_norm", "hit", "mention_id", resamples=500)


@query(O.KEYNESS_R)
def keyness_r(t: Tables) -> DataFrame:
    k = A.keyness_against(t.clean, "r_label", "context_text", L.STOP_KEYNESS)
    return k.select("comparison", "word", "freq_focus", "freq_ref", F.round("g2", 6).alias("g2"), F.round("log_ratio", 6).alias("log_ratio"))


@query(O.KEYNESS_ENTITY)
def keyness_entity(t: Tables) -> DataFrame:
    k = A.keyness_rest(t.clean, "ethnos_norm", "context_text", L.STOP_KEYNESS)
    return k.select("comparison", "word", "freq_focus", "freq_ref", F.round("g2", 6).alias("g2"), F.round("log_ratio", 6).alias("log_ratio"))


@query(O.KEYNESS_TOP)
def keyness_top(t: Tables) -> DataFrame:
    k = A.keyness_rest(t.clean, "ethnos_norm", "context_text", L.STOP_KEYNESS).withColumn("g2", F.round("g2", 6))
    return A.top_by(k, "comparison", [F.desc("g2"), "word"], 20).select("comparison", "word", "g2", "rank")


@query(O.OI)
def index_oi(t: Tables) -> DataFrame:
    return A.othering(t.clean)


@query(O.EPS)
def index_eps(t: Tables) -> DataFrame:
    return A.polarity(t.clean)


@query(O.ED)
def index_ed(t: Tables) -> DataFrame:
    return A.essential_density(t.essential, t.labelled)


@query(O.AS)
def index_as(t: Tables) -> DataFrame:
    return A.agency(t.flat_edges)


_PROFILE = ["ethnos_norm", "mentions", "mentions_norm", "oi", "eps", "ed", "agency", "uncertain_r", "unknown_o", "noise_share"]


@query(O.PROFILES)
def entity_profiles(t: Tables) -> DataFrame:
    return t.profiles.select("ethnos_norm", "mentions", *[F.round(c, 9).alias(c) for c in _PROFILE[2:]])


@query(O.DELTAS)
def profile_deltas(t: Tables) -> DataFrame:
    return t.profiles.select("ethnos_norm", *[F.round(f"{c}_delta", 6).alias(f"{c}_delta") for c in ("oi", "eps", "ed", "agency")])


@query(O.RANKING)
def profile_rankings(t: Tables) -> DataFrame:
    oi = t.clean.groupBy("ethnos_norm").agg(F.avg(F.col("r_label").isin("negative", "exotic").cast("int")).alias("oi"))
    return oi.orderBy(F.desc(F.coalesce("oi", F.lit(0.0))), "ethnos_norm").limit(15)


@query(O.chi2("r_label"))
def chi2_entity_r(t: Tables) -> DataFrame:
    c = A.contingency(t.clean, "ethnos_norm", "r_label")
    return c.select(F.round("chi2", 6).alias("chi2"), "dof", F.round("cramers_v", 9).alias("cramers_v"), "low_expected", "n")


@query(O.chi2("o_label"))
def chi2_entity_o(t: Tables) -> DataFrame:
    c = A.contingency(t.clean, "ethnos_norm", "o_label")
    return c.select(F.round("chi2", 6).alias("chi2"), "dof", F.round("cramers_v", 9).alias("cramers_v"), "low_expected", "n")


@query(O.PEARSON)
def correlations_pearson(t: Tables) -> DataFrame:
    c = A.correlations(t.profiles, ["mentions", "oi", "eps", "ed", "agency"])
    return c.select("x", "y", F.round("r", 6).alias("r"))


@query(O.SPEARMAN)
def correlations_spearman(t: Tables) -> DataFrame:
    p = t.profiles.select("ethnos_norm", "mentions", *[F.round(c, 9).alias(c) for c in ("oi", "eps", "ed", "agency")])
    return A.correlations(p, ["mentions", "oi", "eps", "ed", "agency"], ranks=True).select("x", "y", F.round("r", 6).alias("r"))


@query()
def chi2_tests(t: Tables) -> DataFrame:
    """Both contingency tests with p value and whether at most a fifth of the cells is expected below five."""
    out = None
    for label in ("r_label", "o_label"):
        c = A.contingency(t.clean, "ethnos_norm", label)
        one = c.select(F.lit(label).alias("label"), "chi2", "dof", "cramers_v", ST.chi2_p(F.col("chi2"), F.col("dof")).alias("p_value"), (F.col("low_expected") * 5 <= F.col("cells")).alias("reliable"))
        out = one if out is None else out.union(one)
    return out


@query()
def correlation_tests(t: Tables) -> DataFrame:
    """Pearson and Spearman coefficients of the profiles with their p values."""
    p = t.profiles.select("ethnos_norm", "mentions", *[F.round(c, 9).alias(c) for c in ("oi", "eps", "ed", "agency")])
    names = ["mentions", "oi", "eps", "ed", "agency"]
    n = p.agg(F.count(F.lit(1)).alias("n"))  # one row
    both = A.correlations(p, names).withColumn("kind", F.lit("pearson")).unionByName(A.correlations(p, names, ranks=True).withColumn("kind", F.lit("spearman")))
    return both.crossJoin(F.broadcast(n)).select("kind", "x", "y", "r", ST.correlation_p(F.col("r"), F.col("n")).alias("p_value"))


@query(O.RANKING_ED)
def profile_rankings_ed(t: Tables) -> DataFrame:
    return t.profiles.select("ethnos_norm", F.round("ed", 9).alias("ed")).orderBy(F.desc(F.coalesce("ed", F.lit(0.0))), "ethnos_norm").limit(15)


@query()
def bootstrap_ed(t: Tables) -> DataFrame:
    """Interval of the share of mentions with an essentialising phrase."""
    x = t.clean.withColumn("hit", F.col("is_essentializing").cast("int"))
    return A.bootstrap_mean(x, "ethnos_norm", "hit", "mention_id", resamples=500)


@query(O.PURITY)
def cluster_purity(t: Tables) -> DataFrame:
    e = t.t("embeddings").withColumn("cluster", (F.col("vec_id") % 7 - 1).cast("int"))
    return A.purity(e, "cluster", "label")


@query()
def kmeans_profiles(t: Tables) -> DataFrame:
    return A.kmeans(t.profiles, ["oi", "ed", "eps", "agency"]).select("ethnos_norm", "cluster")


@query(O.SURFACE)
def surface_forms(t: Tables) -> DataFrame:
    return A.surface_forms(t.m)


@query(O.HEATMAP_R)
def heatmap_r(t: Tables) -> DataFrame:
    return A.crosstab(t.clean, "ethnos_norm", "r_label", ["negative", "exotic", "positive", "neutral", "uncertain"])


@query(O.HEATMAP_O)
def heatmap_o(t: Tables) -> DataFrame:
    return A.crosstab(t.clean, "ethnos_norm", "o_label", [*sorted(L.SITUATION), "mixed", "unknown"])


@query(O.R_O)
def r_o_contingency(t: Tables) -> DataFrame:
    return t.clean.groupBy("r_label", "o_label").agg(F.count(F.lit(1)).alias("n"))


@query(O.DISTRIBUTION)
def distribution_counts(t: Tables) -> DataFrame:
    return A.distribution(t.labelled, ["ethnos_norm", "r_label", "o_label"])


@query(O.TOP_EPITHETS)
def top_epithets(t: Tables) -> DataFrame:
    e = t.m.select(F.explode(B.window_epithets(F.col("sentence_text"), F.col("ethnos_raw"))).alias("epithet"))
    return N.top_repeats(e, "epithet", 30)


# --- networks ---------------------------------------------------------------------------------


@query(O.COMENTION)
def comention_raw(t: Tables) -> DataFrame:
    return G.pairs_of(t.sets(2)).select("a", "b", "n")


@query(O.JACCARD)
def comention_jaccard(t: Tables) -> DataFrame:
    return G.jaccard(t.sets(2)).select("a", "b", "n", "jaccard")


@query(O.NPMI)
def comention_npmi(t: Tables) -> DataFrame:
    return G.npmi(t.sets(2)).select("a", "b", "n", F.round("npmi", 9).alias("npmi"))


@query(O.SENSITIVITY)
def comention_sensitivity(t: Tables) -> DataFrame:
    return G.window_sensitivity(t.sets(1, 2, 3))


@query(O.EDGES)
def interaction_edges(t: Tables) -> DataFrame:
    return t.edges.select("src", "dst", "type", "n", "high", "medium", "low", "confidence", F.size("examples").alias("n_examples"))


@query(O.ROBUST)
def robust_edges(t: Tables) -> DataFrame:
    return G.robust_edges(t.edges, 2, ("high", "medium", "low")).select("src", "dst", "type", "n")


@query(O.CONF_TALLY)
def edge_confidence(t: Tables) -> DataFrame:
    return t.edges.groupBy("confidence").agg(F.count(F.lit(1)).alias("n"))


@query(O.DEGREES)
def node_degrees(t: Tables) -> DataFrame:
    return G.degrees(t.flat_edges)


@query(O.METRICS)
def graph_metrics(t: Tables) -> DataFrame:
    return G.graph_metrics(t.flat_edges)


@query()
def pagerank(t: Tables) -> DataFrame:
    return G.pagerank(t.flat_edges)


@query()
def betweenness(t: Tables) -> DataFrame:
    return G.betweenness(t.flat_edges)


@query()
def edge_stability(t: Tables) -> DataFrame:
    return G.edge_stability(t.hits, confidences=("high", "medium", "low"))


# --- evidence ---------------------------------------------------------------------------------


@query(O.PACK)
def evidence_pack(t: Tables) -> DataFrame:
    return E.evidence_pack(t.clean, ["mention_id"]).select("category", "rank", "mention_id", F.md5("context_text").alias("context"))


@query(O.STRATIFIED)
def stratified_sample(t: Tables) -> DataFrame:
    return A.stratified(t.raw.filter("not is_noise and ethnos_norm is not null"), "ethnos_norm", ["mention_id"]).select("mention_id", "ethnos_norm")


@query(O.SAMPLE)
def random_sample(t: Tables) -> DataFrame:
    return A.hash_sample(t.m, "mention_id", 500).select("mention_id")


@query(O.WORKSHOP)
def workshop_cases(t: Tables) -> DataFrame:
    x = t.labelled
    return E.workshop_cases({"essential": x.filter("is_essentializing"), "negative": x.filter("r_label = 'negative'"), "trade": x.filter("o_label = 'trade'"), "exotic": x.filter("r_label = 'exotic'")}, ["mention_id"])


@query(O.CANDIDATES)
def evidence_candidates(t: Tables) -> DataFrame:
    return E.content_candidates(t.m, "sentence_text", ["mention_id"]).select("mention_id")


@query(O.SCATTER)
def scatter_labels(t: Tables) -> DataFrame:
    return E.scatter_labels(t.profiles).select("ethnos_norm", "labelled", E.reliability(F.col("mentions")).alias("reliability"))


@query(O.PASSPORT)
def run_passport(t: Tables) -> DataFrame:
    return E.passport(t.raw)


@query(O.SHARES)
def label_shares(t: Tables) -> DataFrame:
    return t.labelled.agg(F.avg((F.col("r_label") == "uncertain").cast("int")).alias("uncertain_r"), F.avg(F.col("o_label").isin("unknown", "mixed").cast("int")).alias("unclear_o"))


@query()
def sanity_checks(t: Tables) -> DataFrame:
    k = A.top_by(A.keyness_rest(t.clean, "ethnos_norm", "context_text", L.STOP_KEYNESS), "comparison", [F.desc("g2"), "word"], 20)
    return E.sanity(t.raw, k, t.hits)


# --- sources ----------------------------------------------------------------------------------


@query(O.FILENAMES)
def filename_metadata(t: Tables) -> DataFrame:
    m = C.file_metadata(F.col("filename"))
    return t.t("corpus_documents").filter("filename is not null").select("id", m["author"].alias("author"), m["year"].alias("year"), m["title"].alias("title"))


@query(O.VOLUMES)
def volume_signature(t: Tables) -> DataFrame:
    n = F.regexp_replace(F.coalesce("txt_filename", F.lit("")), r"[_.]", " ")
    return t.t("bibliography").select("identifier", "harvested_at", BIB.volume_signature(F.concat_ws(" ", F.col("title"), n)).alias("sig")).distinct()


@query(O.BIBLIO_KEYS)
def biblio_keys(t: Tables) -> DataFrame:
    c = F.col
    return t.t("bibliography").select("identifier", BIB.plain(BIB.surname(c("creator"))).alias("surname"), BIB.title_start(c("title"), 4).alias("title4"), BIB.year_of(c("year")).alias("y")).distinct()


@query(O.BIBLIO_DEDUP)
def biblio_dedup(t: Tables) -> DataFrame:
    return BIB.deduplicate(t.t("bibliography"), ["harvested_at", "identifier", "txt_filename"]).select("identifier", "harvested_at")


@query(O.BIBLIO_YEARS)
def biblio_years(t: Tables) -> DataFrame:
    return BIB.in_years(t.t("bibliography"), 1850, 1900).select("identifier", "year", "harvested_at")


@query(O.PUBLISHERS)
def publisher_filter(t: Tables) -> DataFrame:
    return t.t("bibliography").filter(BIB.publisher_kept(F.col("publisher"), ("eastport", "merrow"))).select("identifier", "publisher").distinct()


@query(O.FILE_MATCH)
def publisher_file_match(t: Tables) -> DataFrame:
    files = t.t("corpus_documents").filter("filename is not null")
    b = BIB.latest(t.t("bibliography"), "identifier", "harvested_at", ("creator", "year", "title", "txt_filename"))
    return BIB.match_files(b, files, "identifier", "filename")


@query(O.FILE_NAMES_OUT)
def biblio_file_names(t: Tables) -> DataFrame:
    n = BIB.file_name_of(F.col("creator"), F.col("year"), F.col("title"), F.col("volume_sig"))
    return t.t("bibliography").select("identifier", n.alias("file_name")).distinct()


@query()
def spell_fix(t: Tables) -> DataFrame:
    """Words outside the lexicons with exactly one word of the lexicons at distance one."""
    words = t.m.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col("context_text")), F.lit(T.PLAIN_WORD), F.lit(0)))).alias("seen")).distinct()
    return words.withColumn("known", T.spell_fix(F.col("seen"), t.known, words=True)).filter("known is not null")


@query()
def spell_fixed_texts(t: Tables) -> DataFrame:
    """The volumes after the whole cleaning chain with the spell fix."""
    return t.t("corpus_documents").select("id", T.clean_text(F.col("raw_text"), L.REPLACEMENTS, known=t.known).alias("text"))


@query()
def pipeline_passport(t: Tables) -> DataFrame:
    from quire.plans.pipeline import run

    return run(t.t("corpus_documents"), t.t("lexicon_entities"), patterns=B.ESSENTIAL_PAST)["passport"]


@query(O.ENRICH)
def biblio_enrich(t: Tables) -> DataFrame:
    """Records overridden by their latest harvest."""
    b = t.t("bibliography").select("identifier", "title", "creator", "year", "publisher", "txt_url", "harvested_at")
    fields = ("title", "creator", "year", "publisher", "txt_url")
    late = BIB.latest(b, "identifier", "harvested_at", fields)
    return BIB.enrich(b, late).select("identifier", "harvested_at", "title", "year", "publisher", "txt_url", "volume_sig").distinct()


@query(O.MIRROR)
def comention_mirrored(t: Tables) -> DataFrame:
    return G.mirrored(G.pairs_of(t.sets(2)), "n")


@query(O.ESSENTIAL_BY_O)
def essential_by_situation(t: Tables) -> DataFrame:
    return t.labelled.groupBy("o_label").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_essentializing").alias("essential"), F.avg(F.arrays_overlap(T.az_words(F.col("context_text")), F.array(*map(F.lit, L.VERBS["fight"]))).cast("int")).alias("fight_share"))


@query(O.SUMMARY_STATS)
def summary_stats(t: Tables) -> DataFrame:
    return A.summary(t.labelled, {"mentions": F.count(F.lit(1)), "entities": F.count_distinct("ethnos_norm"), "documents": F.count_distinct("doc_id"), "noise": F.count_if("is_noise"), "essential": F.count_if("is_essentializing")})


@query(O.DIGEST)
def section_digest(t: Tables) -> DataFrame:
    return A.top_values(t.clean, {"ethnos_norm": 5, "r_label": 3, "o_label": 3})


@query(O.R_BY_ENTITY)
def r_by_entity(t: Tables) -> DataFrame:
    """As the statement wants it: of the first five names only."""
    return A.r_by_entity(t.clean, sorted(t.groups)[:5])


@query()
def r_by_entity_all(t: Tables) -> DataFrame:
    return A.r_by_entity(t.clean)


@query(O.NOISE_ENTITY)
def noise_entity_rows(t: Tables) -> DataFrame:
    return t.raw.filter("is_noise and ethnos_norm is not null").select("mention_id", "doc_id", "sent_idx", "ethnos_norm", "noise_reason")


@query(O.FRAGMENTS)
def piro_fragments(t: Tables) -> DataFrame:
    """The sheet of labelled fragments, with empty columns for manual work."""
    manual = [F.lit("").alias(c) for c in ("manual_r", "manual_o", "manual_note", "manual_check")]
    return t.clean.select("mention_id", "file_name", "sent_idx", "ethnos_norm", "r_label", "r_confidence", "o_label", "o_confidence", "noise_reason", "pointer", *manual)


@query()
def embedding_clusters(t: Tables) -> DataFrame:
    return A.embedding_clusters(t.t("embeddings"), "embedding").select("vec_id", "label", "cluster", "x", "y")


@query()
def embedding_purity(t: Tables) -> DataFrame:
    """Purity of the real clusters; ``cluster_purity`` compares the operator with SQL on numbered ones."""
    return A.purity(A.embedding_clusters(t.t("embeddings"), "embedding"), "cluster", "label")


@query()
def bootstrap_eps(t: Tables) -> DataFrame:
    x = t.clean.withColumn("hit", F.when(F.col("r_label") == "negative", 1).when(F.col("r_label") == "positive", -1).otherwise(0))
    return A.bootstrap_mean(x, "ethnos_norm", "hit", "mention_id", resamples=500)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, d, f=f: f(Tables(spark, d))) for name, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
