"""Labels of mention rows: representation (R), situation (O), essentialising phrases, epithets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import az_words, blank_words, dotted_words
from quire.lexicons import EPITHET_STOP

# The patterns that mark an essentialising phrase, in the order in which they are tried.
ESSENTIAL = [
    ("the_X_are", r"\bthe\s+(\w+)\s+are\s+[\w\s,]+"), ("X_are", r"\b(\w+)\s+are\s+[\w\s,]+"), ("all_X", r"\ball\s+(\w+)\s+"),
    ("X_as_race", r"\b(\w+)\s+as\s+a\s+race\b"), ("X_as_people", r"\b(\w+)\s+as\s+a\s+people\b"), ("X_as_tribe", r"\b(\w+)\s+as\s+a\s+tribe\b"),
    ("by_nature", r"\b(\w+)\s+by\s+nature\b"), ("tend_to", r"\b(\w+)\s+tend\s+to\s+"), ("prone_to", r"\b(\w+)\s+are\s+prone\s+to\s+"),
    ("apt_to", r"\b(\w+)\s+are\s+apt\s+to\s+"), ("invariably", r"\binvariably\s+[\w\s]*\b(\w+)\b"), ("always_near", r"\balways\s+[\w\s]*\b(\w+)\b"), ("X_who", r"\b(\w+)\s+,\s*who\s+"),
]
#: The same for plain prose in the past tense: what the test travelogues write.
ESSENTIAL_PAST = [("the_X_were", r"\bthe\s+(\w+)\s+(?:were|had)\s+[\w\s,]+"), ("said_of_X", r"\bsaid\s+of\s+the\s+(\w+)\s+that\b"), ("X_who", r"\b(\w+)\s+who\s+\w+"), ("no_X", r"\bno\s+(\w+)\s+would\b")]
TRANSLATOR = [
    ("the X are", r"\bthe\s+(\w+)\s+are\b"), ("X are", r"\b(\w+)\s+are\s+"), ("all X", r"\ball\s+(\w+)\s+"), ("X were known to", r"\b(\w+)\s+were\s+known\s+to\b"),
    ("by nature", r"\bby\s+nature\b"), ("as a race/people/tribe", r"\bas\s+a\s+(?:race|people|tribe)\b"),
]
CORPUS_TABLE = r"(?i)\bthe\s+{X}\s+are\s+|\b{X}\s+are\s+|\ball\s+{X}\s+|\b{X}\s+as\s+a\s+race\b|\b{X}\s+by\s+nature\b"


def _words(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def representation_scores(text: Column, epithets: Column, lexicon: dict[str, list[str]]) -> dict[str, Column]:
    """Tenths per class: 10 for every word of the lexicon in the text, 12 if it is an epithet."""
    epi = F.transform(epithets, F.lower)
    words = F.array_union(F.array_distinct(az_words(F.coalesce(text, F.lit("")))), epi)
    out = {}
    for k, v in lexicon.items():
        hits = F.array_intersect(words, _words(sorted(set(v))))
        out[k] = (10 * F.size(hits) + 2 * F.size(F.array_intersect(hits, epi))).cast("int")
    return out


def representation(df: DataFrame, text: str, epithets: Column, epithet_confidence: Column, lexicon: dict[str, list[str]]) -> DataFrame:
    """Adds score_<class> (tenths), r_label and r_confidence.

    No hit is neutral (0.3); a lead of less than one whole hit is uncertain (0.4).
    """
    s = representation_scores(F.col(text), epithets, lexicon)
    df = df.withColumns({f"score_{k}": v for k, v in s.items()})
    names = sorted(s)
    ranked = F.sort_array(F.array(*[F.struct((-F.col(f"score_{k}")).alias("s"), F.lit(k).alias("k")) for k in names]))
    df = df.withColumn("_r", ranked)
    top, second = -F.col("_r")[0]["s"], -F.col("_r")[1]["s"]
    sure = F.least(F.lit(0.9), F.bround(0.5 + 0.15 * F.least(top / 10.0, F.lit(3.0)) + F.when(epithet_confidence >= 0.7, 0.2).otherwise(0.0), 2))
    return df.withColumns({
        "r_label": F.when(top <= 0, "neutral").when(top - second < 10, "uncertain").otherwise(F.col("_r")[0]["k"]),
        "r_confidence": F.when(top <= 0, 0.3).when(top - second < 10, 0.4).otherwise(sure),
    }).drop("_r")


def representation_priority(text: Column, lexicon: dict[str, list[str]]) -> Column:
    """Any hit decides: negative before exotic before positive, else neutral."""
    words = az_words(text)
    out = F.lit("neutral")
    for k in ("positive", "exotic", "negative"):
        out = F.when(F.arrays_overlap(words, _words(lexicon.get(k, [""]))), k).otherwise(out)
    return out


def situation(df: DataFrame, text: str, lexicon: dict[str, list[str]]) -> DataFrame:
    """Adds o_label and o_confidence: markers present count, listed twice they count twice.

    None is unknown (0.2); a second domain of at least six tenths of the first is mixed (0.4).
    """
    df = df.withColumn("_w", F.array_distinct(dotted_words(F.coalesce(F.col(text), F.lit("")))))
    ranked = [F.struct((-F.size(F.filter(_words(v), lambda x: F.array_contains("_w", x)))).alias("s"), F.lit(k).alias("k")) for k, v in sorted(lexicon.items())]
    df = df.withColumn("_o", F.sort_array(F.array(*ranked)))
    top, second = -F.col("_o")[0]["s"], -F.col("_o")[1]["s"]
    mixed = (second > 0) & (10 * second >= 6 * top)
    return df.withColumns({
        "o_label": F.when(top <= 0, "unknown").when(mixed, "mixed").otherwise(F.col("_o")[0]["k"]),
        "o_confidence": F.when(top <= 0, 0.2).when(mixed, 0.4).otherwise(F.least(F.lit(0.9), F.bround(0.5 + 0.1 * F.least(top, F.lit(4)), 2))),
    }).drop("_w", "_o")


def window_epithets(sentence: Column, surface: Column, width: int = 5, stop: list[str] = EPITHET_STOP) -> Column:
    """Words up to ``width`` on either side of the first word equal to the surface form, without stop words and articles."""
    words = blank_words(F.coalesce(sentence, F.lit("")))
    at = F.array_position(F.transform(words, F.lower), F.lower(surface)).cast("int")
    low = F.lower
    near = F.filter(F.slice(words, F.greatest(at - width, F.lit(1)), F.least(at, F.lit(width + 1)) + width), lambda w: (low(w) != low(surface)) & ~low(w).isin([*stop, "the", "a", "an"]) & ~w.rlike("^[0-9]+$") & (F.length(w) > 1))
    return F.when(at > 0, F.array_distinct(near)).otherwise(F.array().cast("array<string>"))


def dependency_epithets(tokens: Column, surface: Column) -> Column:
    """Adjectives of the entity's token: its amod children, else a copula's adjective complement, else an apposition's, else adjectives within five tokens.

    ``head_i`` and ``i`` count within the sentence. Returns struct<epithets, method, confidence>.
    """
    at = F.array_position(F.transform(tokens, lambda t: F.lower(t["text"])), F.lower(surface)).cast("int") - 1
    me = F.element_at(tokens, F.when(at >= 0, at + 1))
    text = lambda c: F.transform(c, lambda t: t["text"])
    amod = F.filter(tokens, lambda t: (t["head_i"] == at) & (t["dep"] == "amod") & ~F.lower(t["text"]).isin(EPITHET_STOP))
    copula = F.filter(tokens, lambda t: (t["head_i"] == me["head_i"]) & t["dep"].isin("acomp", "attr") & (t["pos"] == "ADJ") & F.exists(tokens, lambda h: (h["i"] == t["head_i"]) & (h["lemma"] == "be")))
    appos = F.filter(tokens, lambda t: (t["pos"] == "ADJ") & F.exists(tokens, lambda h: (h["i"] == t["head_i"]) & (h["dep"] == "appos") & (h["head_i"] == at)))
    near = F.filter(tokens, lambda t: (t["pos"] == "ADJ") & (F.abs(t["i"] - at) <= 5) & (t["i"] != at))
    out = F.struct(text(near).alias("epithets"), F.lit("fallback_window").alias("method"), F.lit(0.4).alias("confidence"))
    for found, name in ((appos, "appos"), (copula, "copula"), (amod, "amod")):
        out = F.when(F.size(found) > 0, F.struct(F.array_distinct(text(found)).alias("epithets"), F.lit(name).alias("method"), F.lit(0.85).alias("confidence"))).otherwise(out)
    return F.when(at >= 0, out)


def essentialising(text: Column, forms: Column | None, patterns: list[tuple[str, str]] = ESSENTIAL) -> Column:
    """struct<pattern, span> of the longest phrase; only each pattern's first match counts, and its
    word must be one of the entity's ``forms`` (any, if null). Spans are kept to 120 characters."""
    x = F.coalesce(text, F.lit(""))
    each = []
    for name, p in patterns:
        span = F.trim(F.regexp_extract(x, "(?i)" + p, 0))
        allowed = F.lit(True) if forms is None else F.array_contains(forms, F.lower(F.regexp_extract(x, "(?i)" + p, 1)))
        each.append(F.struct(F.lit(name).alias("pattern"), F.when(allowed, span).otherwise("").alias("span")))
    # folded over an array: nested conditions would double the expression with every pattern
    none = F.struct(F.lit("").alias("pattern"), F.lit("").alias("span"))
    return F.aggregate(F.array(*each), none, lambda best, e: F.when(F.length(e["span"]) > F.length(best["span"]), F.struct(e["pattern"].alias("pattern"), F.left(e["span"], F.lit(120)).alias("span"))).otherwise(best))


def corpus_essentialising(hits: DataFrame, doc_id: str, index: str, text: str) -> DataFrame:
    """(doc_id, sent_idx, ethnos_norm): sentences, noise or not, that say such a thing of a form standing in them.

    ``hits`` are rows of matches (entity, surface); a sentence counts once for an entity.
    """
    head, *rest = CORPUS_TABLE.split("{X}")
    pattern = F.concat(F.lit(head), *[x for r in rest for x in (F.lit("\\Q"), F.col("surface"), F.lit("\\E" + r))])
    return hits.filter(F.rlike(text, pattern)).select(F.col(doc_id).alias("doc_id"), F.col(index).alias("sent_idx"), F.col("entity").alias("ethnos_norm")).distinct()


def first_pattern(text: Column, patterns: list[tuple[str, str]] = TRANSLATOR) -> Column:
    out = F.lit(None).cast("string")
    for name, p in reversed(patterns):
        out = F.when(text.rlike("(?i)" + p), name).otherwise(out)
    return out


def confidence_score(method: Column, r: Column, o: Column, essential: Column, interaction: Column) -> Column:
    points = F.when(method.isin("amod", "copula", "appos"), 35).otherwise(0) + F.when(r >= 0.6, 20).otherwise(0) + F.when(o >= 0.6, 20).otherwise(0) + F.when(essential, 15).otherwise(0) + F.when(interaction, 10).otherwise(0)
    return F.least(points, F.lit(100)) / 100.0


def label_mentions(m: DataFrame, groups: dict[str, list[str]], r_lexicon: dict, o_lexicon: dict, patterns: list = ESSENTIAL, context: str = "context_text") -> DataFrame:
    """The labelled record of every mention in one projection: epithets, R, O, essentialising phrase, pointer."""
    forms = F.create_map(*[x for k, v in groups.items() for x in (F.lit(k), _words([f.lower() for f in v]))]) if groups else None
    out = m.withColumn("epithets", window_epithets(F.col("sentence_text"), F.col("ethnos_raw")))
    out = representation(out, context, F.col("epithets"), F.lit(0.4), r_lexicon)
    out = situation(out, context, o_lexicon)
    e = essentialising(F.col("sentence_text"), F.coalesce(forms[F.col("ethnos_norm")], F.array(F.lower("ethnos_norm"))) if groups else None, patterns)
    return out.withColumn("_e", e).withColumns({
        "is_essentializing": F.col("_e.pattern") != "", "essentialization_pattern": F.col("_e.pattern"), "essentialization_span": F.col("_e.span"),
        "pointer": F.concat_ws("#", F.coalesce("file_name", F.lit("")), F.col("sent_idx").cast("string")),
    }).drop("_e")


def marker_counts(m: DataFrame, entity: str, text: str, markers: list[str]) -> DataFrame:
    """In how many contexts of each entity every marker stands."""
    hit = F.explode(F.array_intersect(az_words(F.coalesce(F.col(text), F.lit(""))), _words(markers)))
    return m.select(F.col(entity).alias("entity"), hit.alias("marker")).groupBy("entity", "marker").agg(F.count(F.lit(1)).alias("n"))


def pitfall_words(df: DataFrame, text: str, words: list[str], most: int = 3) -> DataFrame:
    """Words of the list found as a substring of any word, sorted, at most ``most`` a row, one row each."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    hits = F.slice(F.filter(F.sort_array(_words(words)), lambda w: F.contains(low, w)), 1, most)
    return df.withColumn("pitfall", F.explode(hits))
