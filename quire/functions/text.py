"""Column functions on text. All are null-safe: a null text gives null (or false for tests)."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode NFKC; no built-in expression offers it."""
    return text.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def fold_quotes(x: Column) -> Column:
    return F.translate(x, "‘’“”‐‑‒–—", "''\"\"-----")


def strip_controls(x: Column) -> Column:
    return F.regexp_replace(x, r"[\p{C}&&[^\n\t\r]]", "")


def dehyphenate(x: Column) -> Column:
    return F.regexp_replace(x, r"([\p{L}\p{N}_])-\s*\n\s*([\p{L}\p{N}_])", "$1$2")


def collapse_repeats(x: Column) -> Column:
    return F.regexp_replace(x, r"(.)\1{2,}", "$1$1")


def replace_words(x: Column, pairs: list[tuple[str, str]]) -> Column:
    """Whole-word replacements in list order; a capital first letter stays one; identities are skipped."""
    for wrong, right in pairs:
        if wrong.lower() == right.lower():
            continue
        head, tail = wrong[0], wrong[1:]
        x = F.regexp_replace(x, rf"\b{head.upper()}(?i:{tail})\b", right[0].upper() + right[1:])
        x = F.regexp_replace(x, rf"\b{head.lower()}(?i:{tail})\b", right)
    return x


#: A word of plain letters, as the spell fix checks them; other scripts and accented words are left alone.
PLAIN_WORD = r"(?<![\p{L}\p{M}\p{N}_'])[a-zA-Z]+(?:'[a-zA-Z]+)*(?![\p{L}\p{M}\p{N}_])"
_PLAIN_WORD = re.compile(r"(?<![\w'])[a-zA-Z]+(?:'[a-zA-Z]+)*(?!\w)")


def _deletions(w: str) -> set[str]:
    return {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}


def _one_edit(a: str, b: str) -> bool:
    """Whether one letter put in, left out or exchanged, or two neighbours swapped, makes the difference."""
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return a != b and (x[1:] == y[1:] and x != "" != y or x[1:] == y or x == y[1:] or x[:2] == y[1::-1] and len(x) > 1 and x[2:] == y[2:])


class Speller:
    """Distance one to a known word, found by symmetric deletions as SymSpell does; known words need two letters or more."""

    def __init__(self, known: set[str]) -> None:
        self.known = {w.lower() for w in known}
        self.index: dict[str, set[str]] = {}
        self.seen: dict[str, str] = {}
        for w in self.known:
            if w.isalpha() and len(w) > 1:
                for k in _deletions(w):
                    self.index.setdefault(k, set()).add(w)

    def fix(self, word: str) -> str | None:
        """The only known word at distance one of a word that isn't known, else None."""
        w = word.lower()
        if w in self.known:
            return None
        near = {v for k in _deletions(w) for v in self.index.get(k, ()) if _one_edit(v, w)}
        if len(near) != 1:
            return None
        v = near.pop()
        return v[0].upper() + v[1:] if word[0].isupper() else v

    def fixed(self, text: str) -> str:
        def put(m: re.Match) -> str:
            w = m.group()
            if w not in self.seen:
                if len(self.seen) > 300_000:
                    self.seen.clear()
                self.seen[w] = self.fix(w) or w
            return self.seen[w]

        return _PLAIN_WORD.sub(put, text)


def spell_fix(x: Column, known: set[str], words: bool = False) -> Column:
    """The text with every misspelled word put right; with ``words`` x is a word and the result its known word or null."""
    speller = Speller(known)

    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(speller.fix if words else speller.fixed, na_action="ignore")

    # else a filter on the known word is moved ahead of a distinct() of the words
    return (run.asNondeterministic() if words else run)(x)


def squeeze(x: Column) -> Column:
    x = F.regexp_replace(x, r"[ \t]+", " ")
    x = F.regexp_replace(x, r" ?\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(x, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def clean_text(x: Column, pairs: list[tuple[str, str]] = (), unicode: bool = True, known: set[str] = frozenset()) -> Column:
    """The cleaning chain in its fixed order; the spell fix only where there are known words."""
    x = nfkc(x) if unicode else x
    x = replace_words(collapse_repeats(dehyphenate(strip_controls(fold_quotes(x)))), list(pairs))
    return squeeze(spell_fix(x, known) if known else x)


def az_words(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit("[a-z]+"), F.lit(0))


def dotted_words(x: Column) -> Column:
    """Only full stops and commas separate, besides blanks."""
    return F.filter(F.split(F.translate(F.lower(x), ".,", "  "), r"\s+"), lambda w: w != "")


def blank_words(x: Column) -> Column:
    return F.filter(F.split(x, r"\s+"), lambda w: w != "")


def word_count(x: Column) -> Column:
    return F.size(blank_words(F.coalesce(x, F.lit(""))))


def count_of(x: Column, chars: str) -> Column:
    """How many characters of a class (as in a regular expression) a text has."""
    return F.length(F.regexp_replace(F.coalesce(x, F.lit("")), f"[^{chars}]", ""))


def caps_ratio(x: Column) -> Column:
    letters = count_of(x, r"\p{L}")
    return F.when(letters > 0, count_of(x, r"\p{Lu}") / letters).otherwise(0.0)


def sentence_norm(x: Column, stop: list[str], most: int = 15) -> Column:
    """Small letters, digits and marks as blanks, stop words gone, the first ``most`` words."""
    t = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[0-9]+", " "), r"[^\p{L}\p{N}_\s]", " ")
    kept = F.filter(blank_words(t), lambda w: w.rlike(r"^\p{L}+$") & ~w.isin(stop))
    return F.array_join(F.slice(kept, 1, most), " ")


def ocr_garbage(word: Column) -> Column:
    """Shorter than three letters, not plain Latin, a letter three times, or four consonants in a row."""
    w = F.lower(word)
    return (F.length(w) < 3) | ~w.rlike("^[a-z]+$") | w.rlike(r"(.)\1{2}") | w.rlike("[^aeiouy]{4}")
