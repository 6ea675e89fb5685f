"""Problem 9: evaluation texts leaking into training text.

Q-gram lemma filtering.  The held-out items (a table proven small) are cut into consecutive,
non-overlapping blocks of q letters; a document's letter stream is hashed at every position and
looked up among them.  Hits are counted per item in overlapping diagonal bands: an occurrence
with at most e damaged words keeps all blocks but those the damaged words touch, so a band with
fewer blocks than the worst choice of such words leaves can hold no case.  Surviving regions are verified by a
banded alignment of words.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]+")
#: Letters of the blocks that are counted once more inside a region.
FINE = 6
_M = np.uint64(0x9E3779B97F4A7C15)


def letters(text: str) -> str:
    """The text's letters and digits only, lower case."""
    return "".join(_WORD.findall(text.lower()))


def qgram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of every window of q codes, from hashes of windows of powers of two."""
    h, have = codes.astype(np.uint64) * _M + np.uint64(1), 1
    out, done, rest = None, 0, q
    with np.errstate(over="ignore"):
        while rest:
            if rest & 1:
                n = len(codes) - q + 1
                part = h[done : done + n] if n > 0 else h[:0]
                out = part if out is None else out * _M + (part ^ (part >> np.uint64(29)))
                done += have
            rest >>= 1
            if rest:
                m = len(h) - have
                h = (h[:m] ^ (h[:m] >> np.uint64(31))) * _M + h[have:] if m > 0 else h[:0]
                have *= 2
        out = out ^ (out >> np.uint64(32))
        return out * _M


def blocks_left(lengths: list[int], q: int, share: float, damage: float) -> int:
    """The fewest blocks of q letters that an occurrence keeps, whichever stretch it is and whichever words are damaged.

    ``lengths`` are the letters of the item's words.  For every stretch of as many words as count,
    the blocks inside it less those that its most harmful words touch.
    """
    n = math.ceil(share * len(lengths))
    ends = np.concatenate([[0], np.cumsum(lengths)])
    most = math.ceil(damage * n)
    least = None
    for i in range(len(lengths) - n + 1):
        first, last = -(-ends[i] // q), ends[i + n] // q  # whole blocks of the stretch
        # whole blocks of the item end before its last full one
        last = min(last, ends[-1] // q)
        touched = sorted((min(last, -(-ends[j + 1] // q)) - max(first, ends[j] // q) for j in range(i, i + n)), reverse=True)
        left = max(0, last - first) - sum(t for t in touched[:most] if t > 0)
        least = left if least is None else min(least, left)
    return int(max(1, least or 0))


class ItemIndex:
    """The blocks of all items, sorted by hash."""

    def __init__(self, ids: list, texts: list[str], q: int, share: float, damage: float, band: int) -> None:
        self.ids, self.q, self.share, self.damage, self.band = ids, q, share, damage, band
        self.words = [_WORD.findall(t.lower()) for t in texts]
        hashes, item, pos, need, self.length, self.fine = [], [], [], [], [], []
        for k, w in enumerate(self.words):
            s = "".join(w)
            codes = np.frombuffer(s.encode("utf-32-le"), np.uint32)
            self.length.append(len(s))
            h = qgram_hashes(codes, q)[::q]
            hashes.append(h)
            item.append(np.full(len(h), k))
            pos.append(np.arange(len(h)) * q)
            lengths = [len(x) for x in w]
            need.append(blocks_left(lengths, q, share, damage))
            h = qgram_hashes(codes, FINE)[::FINE]
            by = np.argsort(h, kind="stable")
            self.fine.append((h[by], by * FINE, blocks_left(lengths, FINE, share, damage)))
        self.hash = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(self.hash, kind="stable")
        self.hash, self.item, self.pos = self.hash[order], np.concatenate(item)[order].astype(np.int64) if hashes else order, np.concatenate(pos)[order] if hashes else order
        self.need = np.array(need, np.int64)
        self._seen: np.ndarray | None = None

    @property
    def seen(self) -> np.ndarray:
        """The upper bits of all hashes; made where it is used, so that it does not travel."""
        if self._seen is None:
            self._seen = np.zeros(1 << 22, bool)
            self._seen[(self.hash >> np.uint64(42)).astype(np.int64)] = True
        return self._seen

    def candidates(self, texts: list[str]) -> list[tuple[int, int, int]]:
        """(text number, item, position in the text's letters) of every band that passes the lemma."""
        streams = [letters(t) for t in texts]
        gap = "\0" * self.q
        codes = np.frombuffer(gap.join(streams).encode("utf-32-le"), np.uint32)
        starts = np.cumsum([0] + [len(s) + self.q for s in streams])
        if len(codes) < self.q or not len(self.hash):
            return []
        h = qgram_hashes(codes, self.q)
        at = np.flatnonzero(self.seen[(h >> np.uint64(42)).astype(np.int64)])
        lo, hi = np.searchsorted(self.hash, h[at]), np.searchsorted(self.hash, h[at], "right")
        n = hi - lo
        at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
        if not len(at):
            return []
        where = np.repeat(at, n)
        entry = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        item, pos = self.item[entry], self.pos[entry]
        doc = np.searchsorted(starts, where, "right") - 1
        diag = where - pos + (1 << 20)  # the constant keeps it positive at a text's start
        out = []
        for shift in (0, self.band // 2):  # overlapping bands: shifts of up to half a band stay in one
            band = (diag + shift) // self.band
            by = np.lexsort((pos, band, item, doc))
            d, i, b, p = doc[by], item[by], band[by], pos[by]
            group = np.concatenate([[True], (d[1:] != d[:-1]) | (i[1:] != i[:-1]) | (b[1:] != b[:-1])])
            fresh = group | np.concatenate([[True], p[1:] != p[:-1]])  # a block counts once in a band
            begins = np.flatnonzero(group)
            good = begins[np.add.reduceat(fresh.astype(np.int64), begins) >= self.need[i[begins]]]
            for d, i, b in zip(d[good].tolist(), i[good].tolist(), b[good].tolist()):
                begin = b * self.band - shift - (1 << 20)  # where the item would begin in the stream, at least
                lo, hi = max(begin - self.band, int(starts[d])), min(begin + self.length[i] + 2 * self.band, int(starts[d + 1]) - self.q)
                if self._passes(codes[lo:hi], i):
                    out.append((d, i, int(begin - starts[d])))
        return sorted(set(out))

    def _passes(self, codes: np.ndarray, item: int) -> bool:
        """The lemma once more for one region, with blocks of FINE letters, of which more must be left."""
        known, pos, need = self.fine[item]
        h = qgram_hashes(codes, FINE)
        lo, hi = np.searchsorted(known, h), np.searchsorted(known, h, "right")
        at = np.flatnonzero(hi > lo)
        n = hi[at] - lo[at]
        if not len(at):
            return False
        where, entry = np.repeat(at, n), np.repeat(lo[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        p = pos[entry]
        diag = where - p + (1 << 20)
        for shift in (0, self.band // 2):
            key = np.unique((diag + shift) // self.band << 24 | p)
            if np.bincount((key >> 24) - (key[0] >> 24)).max() >= need:
                return True
        return False

    def verify(self, text_words: list[str], offsets: np.ndarray, item: int, start: int) -> bool:
        """Whether one stretch near the diagonal holds enough of the item's words in order."""
        a = self.words[item]
        lo = max(0, int(np.searchsorted(offsets, start - self.band)) - 1)
        hi = int(np.searchsorted(offsets, start + self.length[item] + 2 * self.band)) + 1
        return covered(a, text_words[lo:hi], self.damage) >= self.share * len(a)


def alike(x: str, y: str) -> bool:
    """Equal, or the one a miswriting of the other (at most a third of its letters changed)."""
    if x == y:
        return True
    if abs(len(x) - len(y)) > 2 or min(len(x), len(y)) < 4:
        return False
    most = 1 if len(x) < 6 else 2
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return row[-1] <= most


def covered(item: list[str], words: list[str], damage: float) -> int:
    """Most words of the item that lie in one aligned stretch whose damage stays in the budget.

    Local alignment in which a matching word scores 1 and a replaced, lost or added one costs
    4: a stretch is given up where damage exceeds its share by far.
    """
    if not item or not words:
        return 0
    cost, best = 4.0, 0
    index: dict[str, list[int]] = {}
    for j, w in enumerate(words):
        index.setdefault(w, []).append(j)
    width = len(words) + 1
    size = np.array([len(w) for w in words])
    prev, pstart, pgood = np.zeros(width), np.full(width, -1), np.zeros(width, int)
    for i, w in enumerate(item):
        hit = np.zeros(len(words), bool)
        hit[index.get(w, [])] = True
        if len(w) >= 4:
            for j in np.flatnonzero((prev[:-1] > 3) & ~hit & (np.abs(size - len(w)) <= 2) & (size >= 4)):
                hit[j] = alike(w, words[j])
        diag = prev[:-1] + np.where(hit, 1.0, -cost)
        start = np.where(pstart[:-1] >= 0, pstart[:-1], i)
        cur, cstart, cgood = np.zeros(width), np.full(width, -1), np.zeros(width, int)
        up, cur_ = prev[1:] - cost, np.maximum(diag, 0)
        use = up > cur_
        cur[1:] = np.where(use, up, cur_)
        cstart[1:] = np.where(use, pstart[1:], np.where(diag > 0, start, -1))
        cgood[1:] = np.where(use, pgood[1:], np.where(diag > 0, pgood[:-1] + hit, 0))
        for j in np.flatnonzero(cur[:-1] > cost):  # an added word
            if cur[j] - cost > cur[j + 1]:
                cur[j + 1], cstart[j + 1], cgood[j + 1] = cur[j] - cost, cstart[j], cgood[j]
        live = cstart >= 0
        span = np.where(live, i - cstart + 1, 0)
        ended = np.concatenate([[False], hit & ~use])  # a stretch ends with a word that both have
        ok = live & ended & (cgood >= (1 - 1.6 * damage) * span)
        best = max(best, int(np.max(np.where(ok, span, 0), initial=0)))
        prev, pstart, pgood = cur, cstart, cgood
    return best


def leaked(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
           q: int = 10, share: float = 0.5, damage: float = 0.1, band: int = 64, most_items: int = 100_000) -> DataFrame:
    """(doc_id, item_id) where one stretch of the document holds at least ``share`` of the item's words.

    Items are searched in blocks of about ``most_items``, one pass over the documents for each, so
    that what every task holds is bounded.  Null texts hold nothing and null items are not
    searched; repeated rows give a pair once; texts of any length are searched whole; an empty
    table on either side gives no rows.
    """
    kind = items.schema[item_id].dataType.simpleString()
    schema = f"doc_id {documents.schema[doc_id].dataType.simpleString()}, item_id {kind}"
    known = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).filter("t is not null")
    blocks = max(1, math.ceil(known.count() / most_items))
    some = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter("text is not null")
    found = None
    for block in range(blocks):
        part = known.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block) if blocks > 1 else known
        rows = [r for r in sorted(part.collect(), key=lambda r: (str(r[0]), r[1])) if _WORD.search(r[1])]
        index = documents.sparkSession.sparkContext.broadcast(ItemIndex([r[0] for r in rows], [r[1] for r in rows], q, share, damage, band))
        one = some.mapInPandas(_searcher(index, band), schema)
        found = one if found is None else found.union(one)
    return found.distinct()


def _searcher(index, band: int):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix = index.value
        for b in batches:
            found = []
            docs, bodies = b["doc_id"].tolist(), b["text"].tolist()
            lo = 0
            while lo < len(bodies):  # about two million letters at a time
                hi, n = lo, 0
                while hi < len(bodies) and (hi == lo or n + len(bodies[hi]) < 2_000_000):
                    n += len(bodies[hi])
                    hi += 1
                words: dict[int, tuple] = {}
                good, tried = set(), set()
                for d, i, start in ix.candidates(bodies[lo:hi]):
                    if (d, i) in good or (d, i, start) in tried:
                        continue
                    tried.add((d, i, start))
                    if d not in words:
                        w = _WORD.findall(bodies[lo + d].lower())
                        words[d] = w, np.cumsum([0] + [len(x) for x in w])[:-1]
                    if ix.verify(*words[d], i, start):
                        good.add((d, i))
                found += [(docs[lo + d], ix.ids[i]) for d, i in good]
                lo = hi
            yield pd.DataFrame(found, columns=["doc_id", "item_id"])

    return search
