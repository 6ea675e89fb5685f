"""Problem 6: sentence boundaries across languages and scripts.

A hidden-event n-gram language model: between two words a boundary token may stand.  Its counts
come from the texts themselves: the ends of paragraphs are known boundaries and show what stands
before one, their beginnings show what follows one, gaps without any mark show what follows none;
marks inside paragraphs are filled in by expectation-maximisation.  Posteriors come from the
forward-backward algorithm over a paragraph's candidate gaps.  All texts are counted, where they
lie; the driver has sums by word only of words that are frequent enough to be known.  In scripts without marks (Thai)
every blank is a candidate, in those without blanks (Chinese) every closing mark.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import cut_lineage, release

#: Characters that stand for the next word where a script has no blanks.
GRAM = 2
_COMMA = re.compile(r"[，、；：]+(?=[㐀-鿿])")
_PARAGRAPH = re.compile(r"\r?\n[ \t\r]*\n\s*|\r?\n(?=[ \t　]{2,}\S)")
_CLOSERS = r"(?:[”’\"»“'\)\]」』]|[   ]»)*"
_CANDIDATE = regex.compile(
    rf"(?P<mark>[.!?…]+)(?P<close>{_CLOSERS})(?:(?P<gap>\s+)(?=\S)|(?<=\p{{Ll}}\p{{Ll}}[.!?])(?=\p{{Lu}}(?:\p{{Ll}}|['’]?\s|\.\s|['’]\p{{L}})|[“„«‘(]\s?\p{{Lu}}|\d{{1,3}}\s\p{{L}}|[—–¿¡]\s?[¿¡]?\p{{Lu}}))"
    rf"|(?P<mark2>[。！？।]+)(?P<close2>[”’」』）)》\"]*)(?P<gap2>\s*)(?=\S)"
    r"|(?P<mark3>(?<=[ก-๛]))(?P<gap3>[  ]+)(?=[ก-๛0-9])"
)
_BEFORE = regex.compile(r"[\p{L}\p{M}\p{N}][\p{L}\p{M}\p{N}.’'\-]*$|\S$")
_AFTER = regex.compile(r"(?P<open>(?:[—–-]\s+)?[^\p{L}\p{M}\p{N}\s]*(?:(?<=«)\s+)?[^\p{L}\p{M}\p{N}\s]*)(?P<word>[\p{L}\p{M}\p{N}]+(?:\.(?=\p{L}))?)?")
_END = regex.compile(rf"(?P<mark>[.!?…]+|[。！？।]+)(?P<close>{_CLOSERS})$")
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_UNMARKED = regex.compile(r"(?<![\p{L}\p{M}.])([\p{L}\p{M}][\p{L}\p{M}’'\-]{2,})[,;:)”]*\s")
_GAP = re.compile(r"(?<=[^\s.!?…])\s+(?=(\S+))")
_NARROW = str.maketrans("。！？।", ".!?.")
_THAI = re.compile(r"[ก-๛]")


def before(text: str, end: int) -> tuple[str, str]:
    """(word, shape) that stands before a mark."""
    m = _BEFORE.search(text[max(0, end - 40) : end])
    w = m.group() if m else ""
    return w.lower(), shape(w)


def shape(w: str) -> str:
    if not w:
        return "-"
    c = w[0]
    if c.isdigit():
        return "9" if len(w) < 3 else "999"
    if "ก" <= c <= "๛":
        return "thai"
    if "㐀" <= c <= "鿿":
        return "han"
    if c.isalpha() and c.lower() == c.upper():
        return "lo"
    if len(w) == 1:
        return "X" if c.isupper() else "x"
    if "." in w:
        return "x.x"
    return "Xx" if c.isupper() else "xx"


def after(text: str, start: int) -> tuple[str, str]:
    """(word, class) of what follows: its opening marks and its shape; the word keeps its case.

    Scripts without blanks have no words to look up: there the next characters stand for one.
    """
    m = _AFTER.match(text[start : start + 40])
    w, o = (m.group("word") or "", m.group("open").strip()) if m else ("", "")
    kind = "d" if o[:1] in "—–-" and o else "q" if o else ""
    s = shape(w)
    if s in ("han", "thai"):
        w = w[:GRAM]
    return kind + w, kind + ("x" if s in ("xx", "x", "x.x") and w[:1].islower() else s)


after_token = lru_cache(100_000)(lambda token: after(token, 0))


def shape_class(w: str) -> str:
    """The class that ``after`` gives a word, told from its first result."""
    kind = w[0] if w[:1] in ("d", "q") and not w[1:2].islower() else ""
    return kind + shape(w[len(kind) :])


def script(shape_: str) -> str:
    """Shapes are compared within a script: with letter cases, without, Han, Thai."""
    s = shape_.lstrip("dq")
    return s if s in ("lo", "han", "thai") else "case"


def candidates(text: str) -> list[tuple[int, int, str, str, str]]:
    """(end of the left part, start of the right part, mark class, ...) of every gap that may hold a boundary."""
    out = []
    for m in _CANDIDATE.finditer(text):
        if m.group("mark3") is not None:
            out.append((m.start(), m.end(), " ", m.start()))
            continue
        mark, close = (m.group("mark"), m.group("close")) if m.group("mark") else (m.group("mark2"), m.group("close2"))
        at = m.start("mark") if m.group("mark") else m.start("mark2")
        end = m.end("close") if m.group("mark") else m.end("close2")
        out.append((end, m.end(), mark_class(mark, close, m.end() == end and bool(m.group("mark"))), at))
    return out


def mark_class(mark: str, close: str, tight: bool = False) -> str:
    m = "..." if mark.startswith("..") or "…" in mark else mark[-1] if len(mark) == 1 else "?!"
    c = ")" if close[:1] in (")", "]") and close else "”" if close else ""
    return m + c + ("~" if tight else "")


class Stops:
    """P(boundary | word, full stop) by the word's hash: sixteen bytes a word, whatever their number."""

    def __init__(self, hashes: np.ndarray, p: np.ndarray) -> None:
        order = np.argsort(hashes)
        self.hashes, self.p = hashes[order], p[order]

    def get(self, word: str) -> float | None:
        h = np.uint64(hashed(word))
        at = int(self.hashes.searchsorted(h))
        return float(self.p[at]) if at < len(self.p) and self.hashes[at] == h else None


def hashed(word: str) -> int:
    """As the planner's ``xxhash64``."""
    return xxhash.xxh64_intdigest(word, seed=42)


class BoundaryModel:
    """Counts of the hidden-event model, dictionaries of bounded size and arrays that travel to every task."""

    def __init__(self, prior: Stops, pool: dict, marks: dict, follow: list, shapes: list, sums: list, words: dict) -> None:
        self.prior, self.pool, self.marks, self.follow, self.shapes, self.sums, self.words = prior, pool, marks, follow, shapes, sums, words

    def p_boundary(self, word: str, shape_: str, mark: str) -> float:
        """P(boundary | word, mark), backing off from the word to its shape to the mark."""
        p = self.prior.get(word) if mark in (".", ".~") else None
        if p is None:
            p = self.pool.get((shape_, mark))
        return p if p is not None else self.marks.get(mark, 0.5)

    def p_next(self, word: str, shape_: str, event: int) -> float:
        """P(next word | event, script): its shape's probability times that of the word, where it is known, among words of its shape."""
        kind = script(shape_)
        ps = (self.shapes[event].get(shape_, 0.0) + 0.05) / (self.shapes[event].get(("*", kind), 0.0) + 1.0)
        known = self.words.get(word)
        if known is None:
            return ps * 1e-2
        w = self.follow[event].get(word, 0.0)
        return ps * (w + 2.0 * known) / (self.sums[event].get(shape_, 0.0) + 2.0)

    def posteriors(self, text: str, found: list) -> list[float]:
        """P(boundary) of each candidate, by forward-backward over the two states of its gap."""
        n = len(found)
        if not n:
            return []
        emit, link = [], []
        last = 0
        for end, start, mark, at in found:
            bw, bs = before(text, at)
            aw, as_ = after(text, start)
            p = min(max(self.p_boundary(bw, bs, mark), 1e-4), 1 - 1e-4)
            emit.append((p * self.p_next(aw, as_, 1), (1 - p) * self.p_next(aw, as_, 0)))
            # a sentence of less than two words between two boundaries is rare
            short = end - last < 60 and len(_WORD.findall(text[last:end])) < 2 and mark[0] == "."
            link.append(0.05 if short else 1.0)
            last = start
        f = []
        b, o = emit[0][0] * link[0], emit[0][1]
        for i in range(n):
            if i:
                b, o = (f[-1][0] * link[i] + f[-1][1]) * emit[i][0], (f[-1][0] + f[-1][1]) * emit[i][1]
            z = b + o or 1e-300
            b, o = b / z, o / z
            f.append((b, o))
        out, bb, bo = [0.0] * n, 1.0, 1.0
        for i in range(n - 1, -1, -1):
            x, y = f[i][0] * bb, f[i][1] * bo
            out[i] = x / (x + y or 1e-300)
            if i:
                bb, bo = link[i] * emit[i][0] * bb + emit[i][1] * bo, emit[i][0] * bb + emit[i][1] * bo
                z = bb + bo or 1e-300
                bb, bo = bb / z, bo / z
        return out


def paragraphs(text: str) -> list[tuple[int, int]]:
    """Stripped spans of the paragraphs."""
    out, at = [], 0
    for m in _PARAGRAPH.finditer(text):
        out.append((at, m.start()))
        at = m.end()
    out.append((at, len(text)))
    spans = []
    for s, e in out:
        part = text[s:e]
        left = len(part) - len(part.lstrip())
        part = part.strip()
        if part:
            spans.append((s + left, s + left + len(part)))
    return spans


#: What a text shows: kind, word before, its shape, mark, word after, its shape.
_COLUMNS = ["kind", "bw", "bs", "mark", "aw", "as"]
#: Stands for every word that is not known.
OTHER = "\0"
#: A word before a mark that is rarer shows what words of its shape do.
_RARE = 12


def observe(text: str, tally: Counter) -> None:
    """Count what a text shows: starts and final marks of paragraphs, events at marks inside them, plain gaps, words without mark."""
    for s, e in paragraphs(text):
        p = text[s:e]
        found = candidates(p)
        m = _END.search(p)
        if not m and not _THAI.search(p[-1:]):
            continue  # a heading or a line without mark shows nothing of marks
        tally["start", "", "", "", *after(p, 0)] += 1
        tally["final", *(before(p, m.start()) if m else before(p, len(p))), mark_class(m.group("mark"), m.group("close")) if m else " ", "", ""] += 1
        gaps = {f[1] for f in found}
        for f in found:
            tally["event", *before(p, f[3]), f[2], *after(p, f[1])] += 1
        for w in _UNMARKED.findall(p):
            tally["open", w.lower(), "", "", "", ""] += 1
        for g in _GAP.finditer(p):
            if g.end() not in gaps:
                token = g.group(1)  # what begins with a letter or number is told from the token alone
                tally["plain", "", "", "", *(after_token(token) if token[0].isalnum() else after(p, g.end()))] += 1
        for g in _COMMA.finditer(p):  # between clauses, where no blank shows a gap
            tally["plain", "", "", "", *after(p, g.end())] += 1


@dataclass
class Shown:
    """Sums of what all texts show, of bounded size but for sixteen bytes and some for each word before a full stop."""

    words: dict[str, float]  # known words: share among the words of their shape
    starts: dict[tuple[str, str], int]  # by next word and shape, as are plain gaps; words that are not known may stand together
    plain: dict[tuple[str, str], int]
    finals: int
    middles: int
    pools: dict[tuple[str, str], tuple[int, int, int, int]]  # by shape and mark: number, ends of paragraphs, both of rare words
    shapes: set[tuple[str, str]]  # shapes and marks that were seen together
    stops: tuple[np.ndarray, list, np.ndarray, np.ndarray, np.ndarray]  # words before two full stops or more: hash, shape, number, ends, without mark
    events: Callable[[BoundaryModel], Counter]  # by what the model tells apart


def least(total: int) -> float:
    """How often a known word stands at least: so there are at most some 17,000."""
    return max(3, 6e-5 * total)


def told_apart(model: BoundaryModel, bw: str, bs: str, mark: str, aw: str, as_: str) -> tuple[float, str, str, str, str]:
    """An event as the model sees it: (probability that never changes, shape before, mark, known word, shape)."""
    w = aw if aw in model.words else OTHER
    return (model.p_boundary(bw, bs, mark), "", ".", w, as_) if mark in (".", ".~") else (-1.0, bs, mark, w, as_)


def show(texts: Iterable[str]) -> Shown:
    """Sums of texts at hand."""
    tally: Counter = Counter()
    for text in texts:
        observe(text, tally)
    known, open_ = Counter(), Counter()
    starts, plain = Counter(), Counter()
    shapes_of: dict[tuple[str, str], Counter] = {}
    ends: Counter = Counter()
    sums: Counter = Counter()
    for (kind, bw, bs, mark, aw, as_), n in tally.items():
        sums[kind] += n
        if kind == "open":
            open_[bw] += n
        if kind in ("start", "event", "plain"):
            known[aw] += n
        if kind in ("start", "plain"):
            (starts if kind == "start" else plain)[aw, as_] += n
        if kind in ("final", "event"):
            key = bw, mark.rstrip("~")
            shapes_of.setdefault(key, Counter())[bs] += n
            ends[key] += n * (kind == "final")
    by_class: Counter = Counter()
    for w, n in known.items():
        by_class[shape_class(w)] += n
    fewest = least(sum(known.values()))
    words = {w: n / by_class[shape_class(w)] for w, n in known.items() if n >= fewest}
    pools: dict[tuple[str, str], list[int]] = {}
    stops = []
    for (w, m), c in shapes_of.items():
        n, f, s = sum(c.values()), ends[w, m], max((k, s) for s, k in c.items())[1]
        rare = n < _RARE
        pools[s, m] = [x + y for x, y in zip(pools.get((s, m), (0, 0, 0, 0)), (n, f, n * rare, f * rare))]
        if m == "." and n >= 2:
            stops.append((hashed(w), s, n, f, open_[w]))
    h, s, n, f, o = zip(*stops) if stops else ([],) * 5

    def events(model: BoundaryModel) -> Counter:
        seen: Counter = Counter()
        for key, c in tally.items():
            if key[0] == "event":
                seen[told_apart(model, *key[1:])] += c
        return seen

    seen_shapes = {(s, m) for (_, m), c in shapes_of.items() for s in c}
    return Shown(words, starts, plain, sums["final"], sums["event"], pools, seen_shapes, (np.array(h, np.uint64), list(s), np.array(n, float), np.array(f, float), np.array(o, float)), events)


class Texts:
    """All texts of a column: read one by one, or counted where they lie (the sums are those of ``show``)."""

    def __init__(self, documents: DataFrame, text: str) -> None:
        self.rows = documents.select(F.col(text).alias("text")).filter("text is not null")

    def __iter__(self) -> Iterator[str]:
        return (r["text"] for r in self.rows.toLocalIterator())

    def show(self) -> Shown:
        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tally: Counter = Counter()
            for b in batches:
                for t in b["text"].tolist():
                    observe(t, tally)
                    if len(tally) > 200_000:
                        yield rows(tally)
                        tally.clear()
            yield rows(tally)

        def rows(tally: Counter) -> pd.DataFrame:
            out = pd.DataFrame(list(tally), columns=_COLUMNS, dtype=object)
            out["class"] = [shape_class(w) for w in out["aw"]]
            out["n"] = list(tally.values())
            return out

        schema = ", ".join(f"`{c}` string" for c in [*_COLUMNS, "class"])
        counted = self.rows.mapInPandas(count, f"{schema}, n long").groupBy(*_COLUMNS, "class").agg(F.sum("n").alias("n"))
        c = self.counted = cut_lineage(counted)
        n = F.sum("n").alias("n")
        sums = {r["kind"]: r["n"] for r in c.groupBy("kind").agg(n).collect()}
        known = c.filter("kind in ('start', 'event', 'plain')")
        by_class = {r["class"]: r["n"] for r in known.groupBy("class").agg(n).collect()}
        frequent = known.groupBy("aw", "class").agg(n).filter(F.col("n") >= least(sum(by_class.values()))).collect()
        words = {r["aw"]: r["n"] / by_class[r["class"]] for r in frequent}
        spark = c.sparkSession
        kept = spark.createDataFrame([(w,) for w in sorted({*words, *(w.lower() for w in words)})], "aw string").withColumn("kept", F.lit(True))
        named = c.filter("kind in ('start', 'plain')").join(F.broadcast(kept), "aw", "left")
        follow = named.groupBy("kind", F.when(F.col("kept"), F.col("aw")).otherwise(F.lit(OTHER)).alias("aw"), "as").agg(n).collect()
        starts, plain = ({(r["aw"], r["as"]): r["n"] for r in follow if r["kind"] == kind} for kind in ("start", "plain"))
        marked = c.filter("kind in ('final', 'event')").withColumn("mark", F.regexp_replace("mark", "~+$", ""))
        shaped = marked.groupBy("bw", "mark", "bs").agg(n, F.sum(F.when(F.col("kind") == "final", F.col("n")).otherwise(0)).alias("f"))
        shapes = {(r["bs"], r["mark"]) for r in shaped.select("bs", "mark").distinct().collect()}
        per = shaped.groupBy("bw", "mark").agg(F.max(F.struct("n", "bs"))["bs"].alias("s"), n, F.sum("f").alias("f"))
        rare = F.col("n") < _RARE
        pools = per.groupBy("s", "mark").agg(n, F.sum("f").alias("f"), F.sum(F.when(rare, F.col("n")).otherwise(0)).alias("rn"), F.sum(F.when(rare, F.col("f")).otherwise(0)).alias("rf"))
        open_ = c.filter("kind = 'open'").select("bw", F.col("n").alias("o"))
        at = per.filter("mark = '.' and n >= 2").join(open_, "bw", "left").select(F.xxhash64("bw").alias("h"), "s", "n", "f", F.coalesce("o", F.lit(0)).alias("o")).toArrow()
        x = {k: at[k].to_numpy() for k in "hnfo"}
        stops = x["h"].astype(np.int64).view(np.uint64), at["s"].to_pylist(), x["n"].astype(float), x["f"].astype(float), x["o"].astype(float)
        return Shown(words, starts, plain, sums.get("final", 0), sums.get("event", 0), {(r["s"], r["mark"]): (r["n"], r["f"], r["rn"], r["rf"]) for r in pools.collect()}, shapes, stops, self.events)

    def events(self, model: BoundaryModel) -> Counter:
        shared = self.counted.sparkSession.sparkContext.broadcast(model)

        def apart(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            m = shared.value
            for b in batches:
                keys = [told_apart(m, *k) for k in zip(*(b[c].tolist() for c in _COLUMNS[1:]))]
                out = pd.DataFrame(keys, columns=["p", *_COLUMNS[2:]])
                out["n"] = b["n"]
                yield out

        seen = self.counted.filter("kind = 'event'").select(*_COLUMNS[1:], "n").mapInPandas(apart, "p double, bs string, mark string, aw string, `as` string, n long")
        rows = seen.groupBy("p", *_COLUMNS[2:]).agg(F.sum("n").alias("n")).toArrow().to_pydict()
        release(self.counted)
        return Counter(dict(zip(zip(*(rows[c] for c in ("p", *_COLUMNS[2:]))), rows["n"])))


def train(texts: Iterable[str], rounds: int = 8) -> BoundaryModel:
    """The model of all these texts."""
    shown = texts.show() if isinstance(texts, Texts) else show(texts)
    words, starts, plain = shown.words, dict(sorted(shown.starts.items())), dict(sorted(shown.plain.items()))
    rho = shown.finals / max(1, shown.finals + shown.middles * 0.8)
    marks_n, marks_f = Counter(), Counter()
    for (_, m), (n, f, _, _) in shown.pools.items():
        marks_n[m] += n
        marks_f[m] += f
    marks = {m: min(0.999, (marks_f[m] + rho * 0.5) / (rho * marks_n[m] + rho)) for m in marks_n}
    # only a full stop depends on the word before it; other marks do on its script at most
    # abbreviations are frequent words: rare ones show what a word of their shape does
    pool = {k: min(0.999, (f + rho * 3 * marks[k[1]]) / (rho * (n + 3))) for k, (_, _, n, f) in shown.pools.items() if n and k[1] == "."}
    h, s, n, f, o = shown.stops
    at = np.minimum(0.999, (f + rho * 4 * np.array([pool.get((x, "."), 0.5) for x in s])) / (rho * (n + 4))) if len(n) else np.zeros(0)
    # a word that often stands without a mark is no abbreviation
    prior = Stops(h, np.where(o > 0.1 * n, np.maximum(at, 0.995), at))
    first: dict[tuple[str, str], list[float]] = {}
    for (s, m), (n, f, _, _) in sorted(shown.pools.items()):
        if m != ".":
            x = first.setdefault((script(s), m), [0.0, 0.0])
            x[0] += f
            x[1] += n
    ended = {k: min(0.98, max(0.02, x / (rho * n))) for k, (x, n) in first.items()}
    by_script = dict(ended)
    # a shape that hardly ever begins a paragraph teaches nothing of what follows boundaries
    starts_of = Counter()
    for (_, s), c in starts.items():
        starts_of[s] += c
        starts_of["*", script(s)] += c
    begins = {s for s, c in starts_of.items() if isinstance(s, str) and c >= 0.02 * starts_of["*", script(s)]}
    shapes_seen = sorted(shown.shapes)
    pool.update({(s, m): by_script[script(s), m] for s, m in shapes_seen if m != "."})
    # a missing blank after a mark: as the mark itself
    pool.update({(k[0], k[1] + "~"): v for k, v in list(pool.items())})
    marks.update({m + "~": v for m, v in list(marks.items())})
    # a capital on a word that is written small inside sentences speaks for a boundary
    inside = Counter()
    for (w, _), c in plain.items():
        inside[w] += c
    opener = {w for w in words if w[:1].isupper() and inside[w.lower()] >= 10 and inside[w] <= 0.02 * inside[w.lower()]}
    follow = [{}, {}]
    shapes = [Counter(), Counter()]
    sums = [Counter(), Counter()]
    model = BoundaryModel(prior, pool, marks, follow, shapes, sums, words)
    fixed = [Counter(), Counter()]
    for (w, s), c in plain.items():
        fixed[0][w, s] += c
    for (w, s), c in starts.items():
        fixed[1][w, s] += c
    soft = [Counter(), Counter()]
    seen = sorted(shown.events(model).items())
    for turn in range(rounds):
        for e in (0, 1):
            follow[e], shapes[e], sums[e] = {}, Counter(), Counter()
            # what follows no boundary is known from plain gaps; marks inside paragraphs add little to it
            for src, weight in ((fixed[e], 1.0), (soft[e], 1.0 if e else 0.5)):
                for (w, s), c in src.items():
                    if e and src is soft[1] and s not in begins:
                        continue
                    c *= 0.02 if not e and src is soft[0] and w in opener else weight
                    if w in words:
                        follow[e][w] = follow[e].get(w, 0.0) + c
                        sums[e][s] += c
                    if src is fixed[e]:  # only what is seen at known places says which shapes follow
                        shapes[e][s] += c
                        shapes[e]["*", script(s)] += c
        soft = [Counter(), Counter()]
        hidden: dict[tuple[str, str], list[float]] = {}
        for (p, bs, mark, aw, as_), c in seen:
            p = min(max(p if p >= 0 else model.p_boundary("", bs, mark), 1e-4), 1 - 1e-4)
            x, y = p * model.p_next(aw, as_, 1), (1 - p) * model.p_next(aw, as_, 0)
            q = x / (x + y)
            soft[1][aw, as_] += c * q
            soft[0][aw, as_] += c * (1 - q)
            if mark.rstrip("~") != ".":
                h = hidden.setdefault((script(bs), mark.rstrip("~")), [0.0, 0.0])
                h[0] += c * q
                h[1] += c
        # marks that seldom end a paragraph are known by what follows them, first where letter cases tell it
        # clearly: bare marks mean the same in all scripts (how a sentence goes on after speech differs)
        for k, (x, n) in hidden.items():
            by_script[k] = (x + first.get(k, [0, 0])[0] + 0.5) / (n + first.get(k, [0, 0])[0] + 1)
        if turn < rounds // 2:
            clear = {m.translate(_NARROW): p for (c, m), p in by_script.items() if c == "case"}
            by_script.update({k: max(ended.get(k, 0.0), clear.get(k[1].translate(_NARROW), 0.5)) for k in hidden if k[0] != "case" and k[1][-1] in ".!?…。！？।"})
        for s, m in shapes_seen:
            if m != ".":
                model.pool[s, m] = model.pool[s, m + "~"] = by_script[script(s), m]
    return model


def sentence_spans(model: BoundaryModel, text: str, threshold: float = 0.5) -> list[tuple[int, int, float]]:
    """(start, end, confidence) of the text's sentences; offsets count characters, the end is exclusive."""
    out = []
    for s, e in paragraphs(text):
        p = text[s:e]
        found = candidates(p)
        at, conf = 0, 1.0
        for (end, start, _, _), q in zip(found, model.posteriors(p, found)):
            if q >= threshold:
                if end > at:
                    out.append((s + at, s + end, min(conf, q)))
                at, conf = start, q
            else:
                conf = min(conf, 1 - q)
        if e - s > at:
            out.append((s + at, e, conf))
    return out


def fit_boundaries(documents: DataFrame, doc_id: str, text: str) -> BoundaryModel:
    """Train on all documents, whole; null texts show nothing, repeated rows show theirs each."""
    return train(Texts(documents, text))


def split_sentences(documents: DataFrame, model: BoundaryModel, doc_id: str, text: str) -> DataFrame:
    """(doc_id, sentence_index, start_char, end_char, confidence) for every document.

    Null, empty and blank texts give no rows; repeated rows give their sentences each; texts are
    split whole; an empty table gives no rows.
    """
    kind = documents.schema[doc_id].dataType.simpleString()
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            rows = [(i, k, s, e, q) for i, t in zip(b["doc_id"].tolist(), b["text"].tolist()) for k, (s, e, q) in enumerate(sentence_spans(m, t))]
            yield pd.DataFrame(rows, columns=["doc_id", "sentence_index", "start_char", "end_char", "confidence"])

    some = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter("text is not null")
    return some.mapInPandas(split, f"doc_id {kind}, sentence_index int, start_char int, end_char int, confidence double")
