"""Entity mentions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def groups_of(lexicon: DataFrame, most: int = 100_000) -> dict[str, list[str]]:
    """canonical -> forms, the longest first. The lexicon is a small table: more than ``most`` rows are refused."""
    out: dict[str, set[str]] = {}
    rows = lexicon.select("canonical", "variant").filter("canonical is not null and variant is not null").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} forms in the lexicon")
    for r in rows:
        out.setdefault(r[0], set()).add(r[1])
    return {k: sorted(v, key=lambda x: (-len(x), x)) for k, v in sorted(out.items())}


def pattern_of(forms: list[str]) -> str:
    return r"(?i)\b(" + "|".join(re.sub(r"([.^$*+?()\[\]{}|\\])", r"\\\1", f) for f in forms) + r")\b"


def layers(groups: dict[str, list[str]]) -> list[dict[str, str]]:
    """Forms (lower case -> canonical) in as few sets as needed so that in none of them a form of one
    canonical can overlap one of another: each set is one alternation, one pass over a text."""
    out: list[dict[str, str]] = []
    for k, forms in groups.items():
        mine = {f.lower(): k for f in forms}
        for layer in out:
            if not any(_overlap(f.split(), g.split()) for f in mine for g in layer):
                layer.update(mine)
                break
        else:
            out.append(mine)
    return out


def _overlap(a: list[str], b: list[str]) -> bool:
    """Whether two forms can stand on common words: one within the other, or an end on a beginning."""
    if not set(a) & set(b):
        # forms within one word (as before a hyphen) are compared by letters
        return any(x in y or y in x for x in a for y in b if not (x.isalpha() and y.isalpha()))
    return True


def _pattern(layer: dict[str, str]) -> str:
    return pattern_of(sorted(layer, key=lambda f: (-len(f), f)))


def _named(layer: dict[str, str]):
    """Column function from a match to struct<entity, surface>."""
    names = F.create_map(*[F.lit(x) for kv in layer.items() for x in kv])

    def of(m: Column) -> Column:
        return F.struct(F.element_at(names, F.lower(m)).alias("entity"), m.alias("surface"))

    return of


def entity_matches(text: Column, groups: dict[str, list[str]]) -> Column:
    """array<struct<entity, surface>> of all matches, per canonical non-overlapping."""
    each = []
    for layer in layers(groups):
        found = F.regexp_extract_all(text, F.lit(_pattern(layer)), F.lit(1))
        each.append(F.transform(found, _named(layer)))
    return F.flatten(F.array(*each)) if each else F.array().cast("array<struct<entity:string,surface:string>>")


def _any_form(groups: dict[str, list[str]]) -> str:
    return "(?i)" + "|".join(re.escape(f) for forms in groups.values() for f in forms)


def extract(sentences: DataFrame, groups: dict[str, list[str]], text: str) -> DataFrame:
    """One row per match, with entity and surface; a cheap common test drops sentences without any."""
    some = sentences.filter(F.col(text).rlike(_any_form(groups))) if groups else sentences.limit(0)
    return some.withColumn("_m", F.explode(entity_matches(F.col(text), groups))).select("*", "_m.entity", "_m.surface").drop("_m")


def positions(text: Column, groups: dict[str, list[str]]) -> Column | None:
    """array<struct<entity, surface, start>> of every match, counted from 0; None without forms.

    A match's place is the length of what the pattern splits off before it and of earlier matches.
    """
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + F.length(y))
    each = []
    for layer in layers(groups):
        p, named = _pattern(layer), _named(layer)
        between, found = F.split(text, p, -1), F.regexp_extract_all(text, F.lit(p), F.lit(1))

        def place(v: Column, i: Column, named=named, between=between, found=found) -> Column:
            start = total(F.slice(between, F.lit(1), i + 1)) + total(F.slice(found, F.lit(1), i))
            return F.named_struct(F.lit("entity"), named(v)["entity"], F.lit("surface"), v, F.lit("start"), start)

        each.append(F.transform(found, _two(place)))
    return F.flatten(F.array(*each)) if each else None


def _two(f):
    """A function of exactly a value and its index, as array transformations want."""
    return lambda v, i: f(v, i)


def text_positions(documents: DataFrame, groups: dict[str, list[str]], doc_id: str, text: str) -> DataFrame:
    """(doc_id, entity, surface, start): every match in whole texts with its place, counted from 0."""
    places = positions(F.col(text), groups)
    if places is None:
        return documents.limit(0).select(F.col(doc_id).alias("doc_id"), F.lit("").alias("entity"), F.lit("").alias("surface"), F.lit(0).alias("start"))
    return documents.filter(F.col(text).rlike(_any_form(groups))).select(F.col(doc_id).alias("doc_id"), F.inline(places))


def sentences_around(sentences: DataFrame, groups: dict[str, list[str]], doc_id: str, index: str, text: str, windows: dict[str, tuple[int, int]]) -> DataFrame:
    """Sentences with any form (doc_id, sent_idx, sentence_text, doc_sent_count) and the contexts asked for.

    ``windows`` names contexts by their first and last sentence, counted from the one with the form;
    they are cut from the document's sentences for these rows only.
    """
    rows = sentences.select(F.col(doc_id).alias("doc_id"), F.col(index).alias("i"), F.col(text).alias("t"))
    docs = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("i", "t"))).alias("s"))
    has = F.col("s")["t"]
    at = F.filter(F.sequence(F.lit(1), F.size("s")), lambda k: F.coalesce(F.element_at(has, k), F.lit("")).rlike(_any_form(groups) if groups else "(?!)"))
    hit = docs.select("doc_id", "s", F.explode(at).alias("k"))
    this = F.element_at("s", F.col("k"))

    def cut(first: int, last: int) -> Column:
        lo = F.greatest(F.col("k") + first, F.lit(1))
        return F.concat_ws(" ", F.slice(F.col("s")["t"], lo, F.greatest(F.col("k") + last - lo + 1, F.lit(0))))

    return hit.select("doc_id", this["i"].alias("sent_idx"), this["t"].alias("sentence_text"), F.size("s").cast("bigint").alias("doc_sent_count"), *[cut(*w).alias(c) for c, w in windows.items()])


def mentions_table(sentences: DataFrame, groups: dict[str, list[str]], doc_id: str, index: str, text: str, window: int = 4) -> DataFrame:
    """The mention rows: doc_id, sent_idx, sentence_text, context_text, ethnos_norm, ethnos_raw, doc_sent_count, doc_position_percent."""
    s = sentences_around(sentences, groups, doc_id, index, text, {"context_text": (-window, window)})
    rows = extract(s, groups, "sentence_text").withColumnsRenamed({"entity": "ethnos_norm", "surface": "ethnos_raw"})
    return rows.withColumn("doc_position_percent", F.bround(100.0 * F.col("sent_idx") / F.col("doc_sent_count"), 2))


def lemma_mentions(tokens: DataFrame, canonicals: list[str], doc_id: str, index: str, lemmas: str) -> DataFrame:
    """Mentions where a token's lemma is a canonical name; variants are not looked at."""
    t = tokens.select(F.col(doc_id).alias("doc_id"), F.col(index).alias("sent_idx"), F.explode(lemmas).alias("lemma"))
    return t.filter(F.lower("lemma").isin([c.lower() for c in canonicals])).select("doc_id", "sent_idx", F.lower("lemma").alias("ethnos_norm"))


def range_mentions(matches: DataFrame, sentences: DataFrame) -> DataFrame:
    """Matches with a text position joined to the sentence that holds it; those in a gap are dropped."""
    j = matches.join(sentences, (matches.doc_id == sentences.doc_id) & (matches.start >= sentences.start_char) & (matches.start < sentences.end_char))
    return j.select(matches["*"], sentences.sentence_index)


def select_documents(df: DataFrame, column: str, selectors: list[str]) -> DataFrame:
    """Rows whose name contains any selector, case aside; no selector keeps all."""
    tests = [F.lower(column).contains(s.strip().lower()) for s in selectors if s.strip()]
    test = F.lit(not tests)
    for t in tests:
        test = test | t
    return df.filter(test)
