"""Problem 3: noise in text from scanned pages.

The vocabulary comes from the collection's clean volumes (document frequencies of all of them).
A word outside it is looked up by intersecting a Levenshtein automaton with the vocabulary's trie,
which yields every candidate within two edits; candidates are ranked by how scanners confuse
shapes, by the words on both sides and by frequency.  The volume's own names are searched likewise.  Page furniture is found by its
place, its repetition and its likeness to the title; what remains is joined and reflowed.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import count

import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import cut_lineage

# Shapes that character recognition confuses, true form first.
CONFUSIONS = frozenset([
    ("e", "c"), ("c", "e"), ("a", "ti"), ("d", "cl"), ("cl", "d"), ("s", "f"), ("n", "u"), ("u", "n"), ("h", "b"), ("b", "h"), ("g", "q"), ("y", "v"), ("m", "rn"),
    ("rn", "m"), ("f", "t"), ("w", "vv"), ("ri", "n"), ("li", "h"), ("h", "li"), ("tt", "ll"), ("in", "m"), ("ii", "u"), ("o", "0"), ("l", "1"), ("i", "1"), ("i", "!"),
    ("l", "!"), ("b", "6"), ("s", "5"), ("z", "2"), ("g", "9"), ("i", "l"), ("l", "i"),
])
_LONGEST = max(len(y) for _, y in CONFUSIONS)
# Words of at least so many letters may have two errors of any kind.
LONG = 8
_BREAK = "-‐‑¬\xad"
_PAGE = re.compile(r"^[^\w]*(?:page|p|pag|s|seite)?[.\s]*[^\w]*[\dlIOoSB|!]{0,4}(?:\d|(?<=[lIO])[lIO])[\dlIOoSB|!]{0,3}(?: [\dlIOoSB]{1,3}){0,2}[^\w]*$", re.I)
_ROMAN_PAGE = re.compile(r"^(?:\W*[ivxlc]{2,7}\W*|\W+[ivxlc]\W+)$")
_TOKEN = re.compile(r"[^\s—–]+")
_STRIP = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "“”‘’„«»…·¡¿•¬‐‑\xad"
_TRIPLE = re.compile(r"([^\W\d_])\1\1")
_INNER = re.compile(r"[^\W\d_][!|~^*\\/_=+<>@#$%&{}\[\]0-9]+[^\W\d_]|^[!|\\]+[^\W\d_]|[^\W\d_]\|+$")
_ORDINAL = re.compile(r"^\d+(?:st|nd|rd|th|d|s)?$|^\d+[.,:/]\d")
_ROMAN = re.compile(r"^[ivxlcdm]+$")
_MIXED = re.compile(r"[a-zà-ÿ][A-Z]")
_STARTS = re.compile(r"[.!?…:][”’\"»)\]]*$")
_END = re.compile(r"[.!?…][”’\"»)\]]*$")


class Trie:
    """The vocabulary, read forwards and backwards; ``within`` walks it together with a Levenshtein automaton."""

    def __init__(self, words: list[str]) -> None:
        self.forward: dict = {}
        self.backward: dict = {}
        for w in words:
            for node, letters in ((self.forward, w), (self.backward, w[::-1])):
                for c in letters:
                    node = node.setdefault(c, {})
                node[""] = w

    def within(self, word: str, most: int) -> list[str]:
        """All words of the vocabulary at a distance of at most ``most``.

        Of ``most`` edits either fewer fall into the word's first letters, or none into its last:
        the first case is walked forwards, with one edit less while these letters are read, the
        second backwards, without edits at first.  So no walk branches much near the root.
        """
        n = len(word)
        if n < 4 or most < 2:
            return _walk(self.forward, word, most, 0, 0)
        first = n // 2 + 1
        found = _walk(self.forward, word, most, first - most + 1, most - 1)
        return list({*found, *_walk(self.backward, word[::-1], most, n - first, 0)})


def _walk(root: dict, word: str, most: int, until: int, fewer: int) -> list[str]:
    """Words of the trie within ``most`` edits, of which at most ``fewer`` up to depth ``until``.

    A branch is left as soon as the automaton has no state for it.  Where only letters that the
    word has near this place keep it alive, only these children are looked up.
    """
    rows, steps = automaton(most)
    n, bits = len(word), 2 * most + 1
    masks: list[dict[str, int]] = []
    for depth in range(n + bits):
        near: dict[str, int] = {}
        for i in range(max(0, depth - most), min(n, depth + most + 1)):
            near[word[i]] = near.get(word[i], 0) | 1 << (i - depth + most)
        masks.append(near)
    out = []
    stack = [(root, 0, 1)]
    while stack:
        node, depth, state = stack.pop()
        if "" in node:
            k = n - depth + most
            if 0 <= k < bits and rows[state][k] <= most:
                out.append(node[""])
        near, at, step = masks[depth], state << bits, steps[fewer if depth < until else most]
        depth += 1
        if step[at]:
            for c, child in node.items():
                new = step[at | near.get(c, 0)]
                if new and c:
                    stack.append((child, depth, new))
        else:
            for c, mask in near.items():
                new = step[at | mask]
                if new and c in node:
                    stack.append((node[c], depth, new))
    return out


@cache
def automaton(most: int) -> tuple[list[tuple[int, ...]], list[list[int]]]:
    """(rows, steps): the states of the Levenshtein automaton for any word, state 1 the first, 0 none.

    A state is the row of distances of the word's prefixes within ``most`` of the diagonal, cut at
    ``most`` + 1.  Its successor depends only on which of these prefixes end with the letter read:
    ``steps[e][state << bits | mask]``, bit k of the mask for cell k, where at most ``e`` edits are left standing.
    """
    big, bits = most + 1, 2 * most + 1
    rows = [(), tuple([big] * most + list(range(most + 1)))]
    number = {rows[1]: 1}
    step = [0] * (1 << bits)
    for state in count(1):
        if state == len(rows):
            return rows, [[s if s and min(rows[s]) <= e else 0 for s in step] for e in range(most + 1)]
        row = rows[state]
        for mask in range(1 << bits):
            new: list[int] = []
            for k in range(bits):
                below = row[k + 1] + 1 if k + 1 < bits else big
                new.append(min(big, row[k] + (not mask >> k & 1), below, new[-1] + 1 if new else big))
            key = tuple(new)
            if min(key) <= most and key not in number:
                number[key] = len(rows)
                rows.append(key)
            step.append(number.get(key, 0))


def difference(true: str, seen: str) -> tuple[str, str, int]:
    """What differs once the common beginning and end are taken off, and where it begins in ``seen``."""
    i, n, m = 0, len(true), len(seen)
    while i < min(n, m) and true[i] == seen[i]:
        i += 1
    j = 0
    while j < min(n, m) - i and true[n - 1 - j] == seen[m - 1 - j]:
        j += 1
    return true[i : n - j], seen[i : m - j], i


def confusable(true: str, seen: str) -> int:
    """Where ``seen`` departs from ``true`` if one confusion of shapes explains it, else -1."""
    a, b, at = difference(true, seen)
    if (a, b) in CONFUSIONS:
        return at
    for left in (0, 1):  # a confusion may share a letter with its surroundings, as ri -> n before n
        for right in (0, 1):
            if (left or right) and at >= left:
                x = true[at - left : at + len(a) + right]
                y = seen[at - left : at + len(b) + right]
                if (x, y) in CONFUSIONS:
                    return at
    return -1


def _edits(true: str, seen: str) -> int:
    """1 where one letter put in, left out or exchanged makes the difference, else 2."""
    a, b, _ = difference(true, seen)
    return 1 if max(len(a), len(b)) <= 1 else 2


def twice(true: str, seen: str) -> bool:
    """Whether two confusions of shapes, or one, explain the difference."""
    return any(confusable(true, u) >= 0 for u in undone(seen))


def ranked(w: str, trie: Trie) -> list[tuple[float, str]]:
    """(cost, word) of all words of the trie within two edits that the length of ``w`` allows."""
    out = []
    for v in trie.within(w, 2):
        cost = 0.5 if confusable(v, w) >= 0 else 1.0 if _edits(v, w) == 1 else 2.0
        if cost > 1 and len(w) > 5 and twice(v, w):
            cost = 1.0
        if cost <= (2 if len(w) >= LONG else 1):
            out.append((cost, v))
    return sorted(out)


def pair_hash(a: str, b: str) -> int:
    """As the planner's ``xxhash64`` of both words with a blank between."""
    return xxhash.xxh64_intdigest(f"{a} {b}", seed=42)


def undone(seen: str) -> Iterator[str]:
    """Every word that one confusion turns into ``seen``."""
    for x, y in CONFUSIONS:
        at = seen.find(y)
        while at >= 0:
            yield seen[:at] + x + seen[at + len(y) :]
            at = seen.find(y, at + 1)


class Lexicon:
    """Words of the clean volumes: ``known`` of any kind, ``common`` in small letters with frequencies.

    ``pairs`` has, by hash, in how many volumes two words stand side by side.
    """

    def __init__(self, known: dict[str, int], common: dict[str, int], pairs: dict[int, int] | None = None) -> None:
        self.known, self.common, self.pairs = known, common, pairs or {}
        self.frequent = set(sorted(common, key=lambda w: (-common[w], w))[:250])
        # the parts of compounds are words as well
        self.parts = {x for w in known if "-" in w for x in w.split("-") if len(x) > 2}
        self.plain: dict[str, str] = {}
        self.near: dict[str, list[tuple[float, str]]] = {}
        # house lines bring their misreadings into clean volumes too: far rarer than what they stand for
        for w in [w for w, n in known.items() if n * 50 <= max(common.values(), default=0)]:
            if any(known.get(v, 0) >= 50 * known[w] for v in undone(w)):
                del known[w]
                common.pop(w, None)

        # nouns and peoples that are written large count too where they are as usual as the common words
        least = min(common.values(), default=0)
        self.usual = {w: n for w, n in known.items() if w.isalpha() and len(w) > 1 and (w in common or n >= least)}
        self.trie = Trie(sorted(set(known) | self.parts))
        self.trigrams = Counter(t for w in known for t in (f"^{w}$"[i : i + 3] for i in range(len(w))))
        # letters that clean names do write three times, where their parts meet
        self.tripled = {m.group(1) for w in known for m in [_TRIPLE.search(w)] if m}

    def is_known(self, w: str) -> bool:
        return w in self.known or w in self.parts or (w.endswith("s") and (w[:-1] in self.known or w.endswith("es") and w[:-2] in self.known or w.endswith("ies") and w[:-3] + "y" in self.known))

    def candidates(self, w: str) -> list[tuple[float, str]]:
        """(cost, word) of every word of the vocabulary within two edits, from the trie, least cost first.

        An edit that a confusion of shapes explains costs half, so two of these cost as much as any
        other single edit; words whose cost their length does not allow are left out.
        """
        out = self.near.get(w)
        if out is None:
            if len(self.near) > 200_000:
                self.near.clear()
            out = self.near[w] = ranked(w, self.trie)
        return out

    def inflected(self, w: str) -> list[tuple[float, str]]:
        """Forms in -s that the vocabulary has only without it."""
        out = []
        for end, stem in (("s", ""), ("es", ""), ("ies", "y")):
            if w.endswith(end) and len(w) > len(end) + 2:
                for cost, v in self.candidates(w[: len(w) - len(end)] + stem):
                    if v in self.known and (not stem or v.endswith(stem)):
                        out.append((cost, v[: len(v) - len(stem)] + end))
        return out

    def context(self, left: str, w: str, right: str) -> int:
        return sum(self.pairs.get(pair_hash(x, y), 0) for x, y in ((left, w), (w, right)) if x and y) if self.pairs else 0

    def best(self, found: list[tuple[float, str]], left: str = "", right: str = "") -> str | None:
        """The least cost first, then what stands beside such words, then the most frequent."""
        return max(((-cost, self.context(left, v, right), self.known.get(v, 0), v) for cost, v in found), default=(0, 0, 0, None))[3]

    def correction(self, w: str, deep: bool = True, left: str = "", right: str = "") -> str | None:
        """The word that ``w`` is by confusions of shapes: by one of them, with ``deep`` also by two."""
        if _TRIPLE.search(w):
            best = next((v for v in (_TRIPLE.sub(r"\1", w), _TRIPLE.sub(r"\1\1", w)) if self.is_known(v)), None)
            if best:
                return best
        if len(w) < 2:
            return None
        near = self.candidates(w)
        if len(w) == 2:  # so short a word is only trusted to be one of the most frequent
            return self.best([x for x in near if x[0] < 1 and x[1] in self.frequent], left, right)
        one = [x for x in near if x[0] < 1 and (x[1] in self.common or len(x[1]) > 4 and x[1] in self.parts)]
        if not one and w[-1] == "s":
            one = [x for x in self.inflected(w) if x[0] < 1 and len(x[1]) > 4 and x[1] not in self.known]
        if not one and deep and len(w) > 5:
            one = [(c, v) for c, v in near if c <= 1 and v in self.common and twice(v, w)]
        return self.best(one, left, right)

    def nearest(self, w: str, left: str = "", right: str = "") -> str | None:
        """The likeliest usual word that is near by edits of any kind: one edit, or two from a long word."""
        near = [(c, v) for c, v in self.candidates(w) if v in self.usual and (len(w) > 2 or v in self.frequent)]
        return self.best(near, left, right)

    def likelier(self, a: str, b: str) -> bool:
        """Whether the letters of ``a`` are more usual than those of ``b`` where the two differ."""
        return self._usual(a, b) > self._usual(b, a)

    def _usual(self, a: str, b: str) -> float:
        _, own, at = difference(b, a)
        span = f"^{a}$"[max(0, at - 1) : at + len(own) + 3]
        return min((self.trigrams.get(span[i : i + 3], 0) for i in range(len(span) - 2)), default=0)

    def run_together(self, w: str, names: set[str], capital: bool = False) -> str | None:
        """Two words without the blank between them: one of them frequent or both long."""
        for i in range(1, len(w)):
            a, b = w[:i], w[i:]
            if i == 1 and a not in ("a", "i") or len(b) == 1 and (b != "a" or len(a) < 4 and a not in self.frequent):
                continue
            first = a in self.common or capital and i > 1 and self.known.get(a, 0) >= 20
            if first and (b in self.common or i == 1 and len(b) > 3 and b in self.parts):
                often = a in self.frequent or b in self.frequent or capital and self.known[a] >= 200
                if often and (i > 1 or len(b) > 3) and (len(w) > 5 or len(b) == 1 or not capital) or len(a) > 3 and len(b) > 3:
                    return f"{a} {b}"
            if len(a) > 4 and len(b) > 1 and (a in names or capital and a in self.known) and (b in self.frequent or len(b) > 3 and b in self.common) or len(b) > 4 and a in self.frequent and b in names:
                return f"{a} {b}"
        return None


def _key(line: str) -> str:
    return "".join(c for c in line.lower() if c.isalpha())


def _near(a: str, b: str) -> bool:
    """Whether two keys are equal but for about one letter in eight."""
    if a == b:
        return True
    most = max(1, len(a) // 8)
    if abs(len(a) - len(b)) > most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return False
    return row[-1] <= most


def _title_of(filename: str | None) -> str:
    parts = re.sub(r"(?:_vol\d+|_part\d+|_book\d+)?\.txt$", "", filename or "").split("_")
    year = next((i for i, p in enumerate(parts) if re.fullmatch(r"\d{4}", p)), None)
    rest = parts[year + 1 :] if year is not None else parts[1:]
    return _key("".join(p for p in rest)) if len(rest) > 2 else ""


_NUMBERED = re.compile(r"^\W*(?:[\dlIO]*\d[\dlIO]*|[ivxlc]{1,7})(?: \d{1,2})?\s{2,}(?=[^\W\d])|(?<=[^\W\d])\s{2,}(?:[\dlIO]*\d[\dlIO]*|[ivxlc]{1,7})(?: \d{1,2})?\W*$")
_FULLSTOP = re.compile(r"[.,;:!?][”’\"»)\]]*$|\.{4,}|\d$")


def furniture(lines: list[str], filename: str | None) -> dict[int, str]:
    """line number -> 'header' or 'page_number'."""
    full = [i for i, x in enumerate(lines) if x.strip()]
    kinds: dict[int, str] = {}
    for i in full:
        s = lines[i].strip()
        if len(s) <= 16 and (any(c.isdigit() or c in "lIO" for c in s) and _PAGE.match(s) or _ROMAN_PAGE.match(s)):
            kinds[i] = "page_number"
    if full and full[0] in kinds and len(full) == 1:
        return kinds
    titles = {t for t in [_title_of(filename)] if len(t) >= 12}
    prose = next((k for k, i in enumerate(full) if len(lines[i].split()) >= 4 and k + 1 < len(full) and full[k + 1] == i + 1 and lines[i][:1].isalpha() and any(c.islower() for c in lines[i])
                  and sum(w[:1].islower() for w in lines[i].split()) * 2 >= len(lines[i].split())), 0)
    place: dict[int, int] = {i: k for k, i in enumerate(full)}
    keys = {}
    for i in full:
        s = lines[i].strip()
        if len(s) > 66 or i in kinds:
            continue
        s = _NUMBERED.sub("", s)
        k = _key(s)
        words = [w for w in s.split() if any(c.isalpha() for c in w)]
        if i not in kinds and 8 <= len(k) and len(s) <= 66 and 2 <= len(words) <= 9 and not re.search(r"\.{4,}|\|", s):
            big = sum(w.lstrip("(“‘[")[:1].isupper() for w in words)
            if big * 2 >= len(words) and (words[0].lstrip(_STRIP)[:1].isupper() or words[0][0].isdigit() or _ROMAN.match(words[0])) and not re.match(r"(?:chapter|kapitel|chapitre|cap[ií]tulo)\b", s, re.I):
                keys[i] = k
    # a title stands before the prose: a line like another's whole beginning
    for i, k in keys.items():
        if place[i] <= prose and len(k) >= 16 and any(k != o and k.startswith(o[: len(o) - 1]) and len(o) >= 10 and place[j] > place[i] for j, o in keys.items()):
            titles.add(k)

    def heads(k: str) -> bool:
        return any(_near(k, t[: len(k)]) or abs(len(k) - len(t)) <= 3 and _near(k, t) for t in titles)

    def beside_number(i: int) -> bool:
        at = place[i]
        return any(0 <= at + d < len(full) and kinds.get(full[at + d]) == "page_number" and abs(full[at + d] - i) <= 3 for d in (-1, 1))

    def numbered(i: int) -> bool:
        return bool(_NUMBERED.search(lines[i].strip()) or re.match(r"^\W*(?:[\dlIO]*\d[\dlIO]*|[ivxlc]{1,7})\W{2,}[^\W\d]|^\W*[\dlIO]*\d[\dlIO]*\W+[^\W\d]|.*[^\W\d]\W{2,}[ivxlc]{1,7}\W*$|.*[^\W\d]\W+[\dlIO]*\d[\dlIO]*\W*$", lines[i].strip()))

    first_title = next((i for i, k in keys.items() if any(abs(len(k) - len(t)) <= max(2, len(t) // 10) and _near(k, t) for t in titles) and place[i] <= prose + 3 and not beside_number(i) and not numbered(i)), None)
    counts = Counter(keys.values())
    for i, k in keys.items():
        if i == first_title:
            continue
        repeated = counts[k] > 1 or any(j != i and j != first_title and _near(k, o) for j, o in keys.items())
        whole = bool(_FULLSTOP.search(lines[i].strip())) and not numbered(i)
        if heads(k) or repeated and not whole and len(k) <= 52 or _NUMBERED.search(lines[i].strip()) and len(k) <= 52 or beside_number(i) and not whole and place[i] > 0 and len(k) <= 52:
            kinds[i] = "header"
    return kinds


def inspect(text: str, filename: str | None, lex: Lexicon, every: bool = False) -> list[tuple[int, str, str]]:
    """(line number, kind, correction) of all disturbed lines; with ``every`` of each misread word, else of a line's first.

    A word broken at a line's end is searched as a whole, in the same way as any other.
    """
    lines = [x.rstrip("\r") for x in text.split("\n")]
    kinds = furniture(lines, filename)
    out = [(i, k, "") for i, k in kinds.items()]
    body = []
    for i, x in enumerate(lines):
        if i in kinds or not x.strip():
            continue
        if not any(c.isalnum() for c in x):
            if not re.fullmatch(r"\s*(?:\*\s*){1,5}|\s*[-–—_=]{3,}\s*", x):
                out.append((i, "speck", ""))
            continue
        body.append(i)
    words: Counter = Counter()
    names: Counter = Counter()
    for i in body:
        for m in _TOKEN.finditer(lines[i]):
            w = m.group().strip(_STRIP).split("’s")[0].split("'s")[0]
            if w[:1].isalpha():
                words[w.lower()] += 1
                if w[:1].isupper():
                    names[w.lower()] += 1
    title = {w.lower() for w in re.split(r"[_.]", filename or "") if len(w) > 3}
    own = {n for n, c in names.items() if c > 1 and len(n) > 4 or n in title} | title
    # the volume's own names are a second vocabulary, searched in the same way
    volume: list[Trie] = []

    def own_shapes(w: str) -> list[str]:
        if not volume:
            volume.append(Trie(sorted(own | set(names))))
        return [v for v in volume[0].within(w, 2) if confusable(v, w) >= 0]

    def tokens(i: int) -> list[tuple[str, int, int]]:
        return [(m.group(), m.start(), m.end()) for m in _TOKEN.finditer(lines[i])]

    def checked(part: str, sides: tuple[str, str], broken: bool = False) -> str | None:
        """'seen=true' of a word misread by shapes, a letter too many or a blank too few; '' of a known one, None of an unknown one.

        A broken word is not taken for a name and another word: its halves stand among the names.
        """
        low = part.lower()
        triple = _TRIPLE.search(low)
        if triple and not _ROMAN.match(low) and low not in lex.known and low not in own:
            forms = (_TRIPLE.sub(r"\1", low), _TRIPLE.sub(r"\1\1", low))
            c = next((v for v in forms if lex.is_known(v) or v in own or v in names), None)
            right = c or lex.correction(low)
            return f"{part}={right or forms[0]}" if c or triple.group(1) not in lex.tripled or not part[0].isupper() and right else ""
        if _MIXED.search(part) and not re.match(r"Ma?c[A-Z]", part):
            return f"{part}="
        if lex.is_known(low) or low in own or _ROMAN.match(low):
            return ""
        if part[0].isupper() and not part.isupper():
            c = lex.correction(low, False, *sides) if words[low] == names[low] else None
            if (c is None or c not in lex.common) and len(low) > 3 and names[low] < 3:
                c = lex.best([x for x in lex.candidates(low) if x[0] < 1 and x[1] in lex.known], *sides)
                c = c or next((u for u in own_shapes(low) if u in names and (names[u] > names[low] or names[u] == names[low] and lex.likelier(u, low))), None)
            elif c not in lex.common:
                c = None
            if c is None:
                c = lex.run_together(low, set() if broken else own | set(names), capital=True)
        else:
            c = lex.correction(low, True, *sides) or lex.run_together(low, set() if broken else own)
            if c is None and len(low) > 4:
                c = next((u for u in own_shapes(low) if u in own), None)
        return f"{part}={c}" if c else None

    begins = {b: b - a > 1 or bool(_STARTS.search(lines[a].rstrip())) for a, b in zip(body, body[1:])}
    marked = any(lines[i].rstrip()[-1:] in "‐‑¬\xad" or lines[i][-2:] == "- " for i in body)
    fragment: dict[int, tuple[bool, bool]] = {}
    for a, b in zip(body, body[1:]):
        s = lines[a].rstrip()
        if len(s) < 2 or s[-1] not in _BREAK or not s[-2].isalpha():
            continue
        left, right = _TOKEN.findall(s[:-1])[-1], lines[b].split()[0]
        tail = right.strip(_STRIP)
        if not tail[:1].isalpha() or tail[0].isupper() and not left.isupper():
            continue
        plain = s[-1] == "-" and lines[a][-2:] != "- "
        stem = left.lstrip(_STRIP).rstrip(_STRIP)
        rest = re.split(r"[^\w'’-]", tail)[0]
        joined = (stem.rsplit("-", 1)[-1] + rest.split("-")[0]).lower()
        compound = f"{stem}-{rest}".lower()
        short = f"{stem}-{rest.split('-')[0]}".lower()
        known_compound = any(v in lex.known or v in words for v in (compound, compound.rstrip("s"), short, short.rstrip("s")))
        if plain and (marked and known_compound or known_compound and joined not in lex.known or marked and joined not in lex.known and stem.lower() in lex.common and rest.lower() in lex.common):
            fragment[a] = fragment.get(a, (False, False))[0], True
            fragment[b] = True, fragment.get(b, (False, False))[1]
            continue
        if plain and not known_compound and joined not in lex.known and stem.lower() in lex.common and rest.lower() in lex.common and lex.correction(joined) is None and len(rest) > 3 and len(stem) > 3:
            continue  # two whole words: a compound broken at its own hyphen
        out.append((a, "hyphen", joined))
        fragment[a] = fragment.get(a, (False, False))[0], True
        fragment[b] = True, fragment.get(b, (False, False))[1]
        whole = _base(stem.rsplit("-", 1)[-1] + rest.split("-")[0])
        if len(whole) > 3 and whole.isalpha():
            toks = tokens(a)
            sides = _beside(toks, len(toks) - 1)[0], _beside(tokens(b), 0)[1]
            note = checked(whole, sides, True)
            if note is None:
                note = _other_error([(whole, len(toks) - 1, *sides)], [*toks[:-1], (whole, *toks[-1][1:])], begins.get(a, True), words, names, lex)
            if note:
                seen, _, c = note.partition("=")
                seen = seen.lower()
                at = max(confusable(c, seen), 0) if c and confusable(c, seen) >= 0 else (_TRIPLE.search(seen) or re.search("$", seen)).start()
                out.append((a if at < len(stem) else b, "misread", note))
    for i in body:
        toks = tokens(i)
        first, last = fragment.get(i, (False, False))
        found: dict[int, list[str]] = {}  # by token
        apart: set[int] = set()
        cores = []
        unknown: list[tuple[str, int]] = []

        for k, (raw, s, e) in enumerate(toks):
            plain = lex.plain.get(raw)
            if plain is None:
                w = raw.rstrip(".,;:")
                plain = w if w.isalpha() and (w.islower() or w[0].isupper() and w[1:].islower()) and w.lower() in lex.known and not _TRIPLE.search(w) else ""
                if len(lex.plain) < 400_000:
                    lex.plain[raw] = plain
            if plain:
                cores.append(plain)
                continue
            core = raw.strip(_STRIP)
            base = _base(core)
            cores.append(base)
            if not base or not any(c.isalpha() for c in base):
                if _INNER.search(raw.strip(".,;:()“”‘’\"'")):
                    found[k] = [raw]
                continue
            inner = raw.strip(".,;:?()[]“”‘’\"'„«»*…").rstrip("!")
            if _INNER.search(inner) or any(c.isdigit() for c in base) and not _ORDINAL.match(base) and not re.fullmatch(r"[A-Za-z]{0,3}\d+[a-z]?", base) or re.search(r"[^\W\d_]\d|\d[^\W\d_]{3,}", base) and not _ORDINAL.match(base):
                low = base.lower()
                bare = re.sub(r"[|~^*\\/_=+<>@#$%&{}\[\]]", "", low)
                shapes = [x for x in lex.candidates(low) if x[0] < 1]
                found[k] = [f"{base}=" + (bare if bare != low and (lex.is_known(bare) or bare in own) else lex.best(shapes, *_beside(toks, k)) or next(iter(own_shapes(low)), ""))]
                continue
            parts = re.split(r"[-./]", base)
            for n, part in enumerate(parts):
                # what is broken at the line's end has been searched as a whole
                broken = k == 0 and first and n == 0 or k == len(toks) - 1 and last and n == len(parts) - 1
                if len(part) < 2 or not part.isalpha() or broken and not _TRIPLE.search(part.lower()):
                    continue
                note = checked(part, _beside(toks, k))
                if note:
                    found.setdefault(k, []).append(note)
                elif note is None and not broken and not lex.is_known(base.lower()):
                    unknown.append((part, k))
        if every or not found:
            for k in range(len(toks) - 1):
                a, b = cores[k], cores[k + 1]
                if k in found or k + 1 in found or k in apart or not a.isalpha() or not b.isalpha() or toks[k][0][-1] in ".,;:!?)”’" or toks[k + 1][1] - toks[k][2] != 1 or k == 0 and first or k + 1 == len(toks) - 1 and last or not b[0].islower() and not a.isupper():
                    continue
                la, lb = a.lower(), b.lower()
                if la in lex.common and lb in lex.common:
                    continue
                j = la + lb
                whole = j in lex.common or len(j) > 4 and (j in own or j in lex.known) and not (lex.is_known(la) and lex.is_known(lb)) or len(j) > 4 and names[j] and not lex.is_known(lb)
                if whole or a[0].isupper() and len(a) < 5 and not lex.is_known(la) and not lex.is_known(lb) and lb not in own and words[lb] == 1 and len(lb) > 3 and not a.isupper():
                    found[k] = [f"{a} {b}={j}"]
                    apart |= {k, k + 1}
                    if not every:
                        break
        for part, k in unknown:
            if k not in apart and (every or not found):
                note = _other_error([(part, k, *_beside(toks, k))], toks, begins.get(i, True), words, names, lex)
                if note:
                    found.setdefault(k, []).append(note)
        notes = [x for k in sorted(found) for x in found[k]]
        out.extend((i, "misread", x) for x in (notes if every else notes[:1]))
    return out


def _base(core: str) -> str:
    """A word without its genitive or elided ending."""
    return re.split(r"['’]", core)[0] if re.search(r"['’]s?$|['’]\w{1,2}$", core) else core


def _beside(toks: list[tuple[str, int, int]], k: int) -> tuple[str, str]:
    """The words on both sides of a token of a line."""
    return (toks[k - 1][0].strip(_STRIP).lower() if k else ""), (toks[k + 1][0].strip(_STRIP).lower() if k + 1 < len(toks) else "")


def _other_error(unknown: list[tuple[str, int, str, str]], toks: list[tuple[str, int, int]], begins: bool, words: Counter, names: Counter, lex: Lexicon) -> str:
    """The first word of a line that is near a usual word by any error, with that word, else ''.

    The volume speaks for a form that it repeats. A capital that begins no sentence is a name or
    noun, and only near such a word.
    """
    for part, k, left, right in unknown:
        low = part.lower()
        if words[low] > 2 or k == len(toks) - 1 and toks[k][0][-1] in _BREAK:
            continue
        c = lex.nearest(low, left, right)
        if c and part[0].isupper() and (k and not _STARTS.search(toks[k - 1][0]) and toks[k][0][0] == part[0] or not k and not begins):
            c = c if 2 * lex.common.get(c, 0) < lex.known[c] else None
        if c:
            return f"{part}={c}"
    return ""


def _put_right(s: str, note: str) -> str:
    """``s`` with the first such whole word put right."""
    seen, _, true = note.partition("=")
    if not true or seen not in s:
        return s
    return regex.sub(rf"(?<![\p{{L}}\p{{M}}\p{{N}}]){regex.escape(seen)}(?![\p{{L}}\p{{M}}\p{{N}}])", lambda m: true.capitalize() if seen[:1].isupper() else true, s, count=1)


def repair(text: str, filename: str | None, lex: Lexicon) -> str:
    """Continuous paragraphs: furniture and specks gone, broken words joined, misread words put right."""
    lines = [x.rstrip("\r") for x in text.split("\n")]
    notes: dict[int, dict[str, list[str]]] = {}
    for i, k, c in inspect(text, filename, lex, every=True):
        notes.setdefault(i, {}).setdefault(k, []).append(c)
    paragraphs, now, joint = [], "", " "
    halves: list[str] = []
    blank = page = False
    for i, x in enumerate(lines):
        n = notes.get(i, {})
        s = x.strip()
        if "header" in n or "page_number" in n or "speck" in n:
            page = True
            continue
        if not s:
            blank = True
            continue
        misread = n.get("misread", [])
        for note in misread:
            s = _put_right(s, note)
        # a page that ends within a sentence goes on behind its furniture
        if now and blank and not (page and (joint != " " or not _END.search(now) and s[:1].islower())):
            paragraphs.append(now)
            now, joint, halves = "", " ", []
        cut = len(now)
        broken = "hyphen" in n
        now = (now + joint + s if now else s).rstrip()
        if joint == "":  # the two halves of a word stand together now
            at = cut - len(re.search(r"\S*$", now[:cut]).group())
            end = cut + len(re.match(r"\S*", now[cut:]).group())
            mended = now[at:end]
            for note in halves + misread:
                mended = _put_right(mended, note)
            now = now[:at] + mended + now[end:]
        halves = misread
        compound = not broken and s[-1] in _BREAK and s[-2:-1].isalpha()
        if broken:
            now = now.rstrip(_BREAK)
        joint = "" if broken or compound else " "
        blank = page = False
    if now:
        paragraphs.append(now)
    return "\n\n".join(paragraphs)


def fit_lexicon(clean: DataFrame, doc_id: str, text: str, known_share: float = 1e-4, common_share: float = 0.002) -> Lexicon:
    """Document frequencies of all words of the clean volumes, and of pairs of neighbours.

    Words in at least ``known_share`` of the volumes (and three) are known, those written small in
    at least ``common_share`` (and five) are common, and so are pairs: at most (distinct words or
    pairs per volume) / share of them, whatever the collection's size.
    """
    split = clean.select(F.col(doc_id).alias("d"), F.filter(F.split(F.col(text), r"[^\p{L}\p{M}'’-]+"), lambda w: w != "").alias("v")).filter("v is not null")
    words = split.select("d", F.explode(F.array_distinct("v")).alias("w"))
    by = words.withColumns({"l": F.lower("w"), "small": F.col("w") == F.lower("w")}).groupBy("d", "l").agg(F.max("small").alias("small"))
    df = by.groupBy("l").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("small").cast("int")).alias("s"))
    n = clean.filter(F.col(text).isNotNull()).count()
    rows = df.filter(F.col("n") >= max(3.0, known_share * n)).collect()
    low = split.select("d", F.transform("v", F.lower).alias("v")).filter("size(v) > 1")
    beside = F.zip_with(F.slice("v", F.lit(1), F.size("v") - 1), F.slice("v", F.lit(2), F.size("v") - 1), lambda a, b: F.xxhash64(F.concat_ws(" ", a, b)))
    two = low.select("d", F.explode(F.array_distinct(beside)).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    pairs = {r["h"] & 0xFFFFFFFFFFFFFFFF: r["n"] for r in two.filter(F.col("n") >= max(5.0, common_share * n)).collect()}
    known: dict[str, int] = {}
    common: dict[str, int] = {}
    for r in rows:
        w, c, s = r["l"].strip("'’-"), r["n"], r["s"]
        if w:
            known[w] = max(c, known.get(w, 0))
            if s >= max(5.0, common_share * n) and w.isalpha():
                common[w] = max(s, common.get(w, 0))
    return Lexicon(known, common, pairs)


def _mapped(documents: DataFrame, lex: Lexicon, doc_id: str, text: str, filename: str, work, schema: str, columns: list[str]) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(lex)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = shared.value
        for b in batches:
            rows = [(i, *r) for i, t, f in zip(b["doc_id"].tolist(), b["text"].tolist(), b["filename"].tolist()) for r in work(t, f if isinstance(f, str) else None, lexicon)]
            yield pd.DataFrame(rows, columns=["doc_id", *columns])

    some = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(filename).alias("filename")).filter("text is not null")
    return some.mapInPandas(run, f"doc_id {documents.schema[doc_id].dataType.simpleString()}, {schema}")


def disturbed_lines(documents: DataFrame, lex: Lexicon, doc_id: str, text: str, filename: str) -> DataFrame:
    """(doc_id, line_no, kind, note) of all header, page_number, hyphen, misread and speck lines.

    A note names each misread word of its line. Null texts give no rows, null file names only say nothing of the title; repeated rows give
    their lines each; texts are read whole; an empty table gives no rows.
    """

    def lines(t: str, f: str | None, x: Lexicon) -> list:
        notes: dict[tuple[int, str], list[str]] = {}
        for i, k, c in inspect(t, f, x, every=True):
            notes.setdefault((i, k), []).append(c)
        return [(i, k, "; ".join(c)) for (i, k), c in sorted(notes.items())]

    return _mapped(documents, lex, doc_id, text, filename, lines, "line_no int, kind string, note string", ["line_no", "kind", "note"])


def repaired_texts(documents: DataFrame, lex: Lexicon, doc_id: str, text: str, filename: str) -> DataFrame:
    """(doc_id, text): the volumes as continuous, readable paragraphs."""
    return _mapped(documents, lex, doc_id, text, filename, lambda t, f, x: [(repair(t, f, x),)], "text string", ["text"])
