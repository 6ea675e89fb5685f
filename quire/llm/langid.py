"""Problem 10: missing or wrong document language labels.

A paragraph is the average of learned vectors of its hashed subwords (character trigrams,
four-grams and the characters' blocks of 64 codes), followed by a linear softmax; both are trained by stochastic gradient descent
in numpy on a bounded sample of labelled rows.  Because the average and the layer are linear,
a trained model is one table of class scores by bucket, and a paragraph costs one gather.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANGUAGES = ("de", "en", "es", "fr", "hi", "pt", "ru", "th", "zh")
BUCKETS = 1 << 17
# Lines with fewer letters say little beside whole paragraphs, unless their prediction is this confident.
SCRAP, SURE = 24, 0.9

# ISO 639 codes and English or own names of the languages.
CODES = {
    "en": "en eng english anglais englisch", "fr": "fr fra fre french français francais französisch", "de": "de deu ger german deutsch allemand",
    "es": "es spa spanish español espanol castellano", "pt": "pt por portuguese português portugues", "ru": "ru rus russian русский",
    "zh": "zh zho chi cmn chinese mandarin 中文 汉语", "hi": "hi hin hindi हिन्दी हिंदी", "th": "th tha thai ไทย ภาษาไทย",
}


def stated_language(label: Column) -> Column:
    """The two-letter code a label states in any usual code or name, else null."""
    base = F.lower(F.trim(F.regexp_extract(F.trim(label), r"^([^-_ ]*)", 1)))
    out = F.lit(None).cast("string")
    for code, names in CODES.items():
        out = F.when(base.isin(*names.split()), code).otherwise(out)
    return out


def repaired(text: str) -> str:
    """Undo a decoding of UTF-8 as a one-byte code page, where the text shows the marks of one."""
    if not any(m in text for m in ("Ã", "Ð", "Ñ", "â€", "à¤", "à¸", "ä¸", "å", "æ", "ç", "è")):
        return text
    for page in ("cp1252", "latin-1"):
        raw = bytearray()
        for c in text:
            try:
                raw += c.encode(page)
            except UnicodeEncodeError:
                if ord(c) > 255:
                    break
                raw.append(ord(c))
        else:
            back = raw.decode("utf-8", "replace")
            if back.count("�") <= len(back) // 50 and len(back) < len(text):
                return back
    return text


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of all texts' subwords, and where each text's begin."""
    joined = " \0 " + " \0 ".join(t.lower() for t in texts) + " \0    "
    c = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
    end = np.cumsum([len(t.lower()) + 3 for t in texts])
    begin = np.concatenate([[0], end[:-1]]) + 2
    digit = (c >= 48) & (c <= 57)
    c = np.where(digit, 48, c)
    n = len(c) - 4
    h2 = c[:n] * 0x9E3779B1 + c[1 : n + 1] * 0x85EBCA6B
    h3 = h2 + c[2 : n + 2] * 0xC2B2AE35
    h4 = h3 + c[3 : n + 3] * 0x27D4EB2F
    grams = [((h ^ (h >> 15)) * m >> 7) & (BUCKETS - 1) for h, m in (((c[:n] >> 6) * 0x9E3779B1, 0x2545F491), (h3, 0x165667B1), (h4, 0x1B873593))]
    return np.stack(grams, 1), begin


class Model:
    def __init__(self, table: np.ndarray, bias: np.ndarray, temperature: float, accept: float) -> None:
        self.table, self.bias, self.temperature, self.accept = table, bias, temperature, accept

    def logits(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros((0, len(LANGUAGES)), np.float32)
        g, begin = features(texts)
        length = np.array([len(t.lower()) + 1 for t in texts])
        score = self.table[g[:, 0]] + self.table[g[:, 1]] + self.table[g[:, 2]]
        total = np.concatenate([np.zeros((1, score.shape[1])), np.cumsum(score, 0, dtype=np.float64)])
        stop = np.minimum(begin + length, len(score))
        return (total[stop] - total[begin]) / (3 * np.maximum(length, 1))[:, None] + self.bias

    def probabilities(self, texts: list[str]) -> np.ndarray:
        z = self.logits(texts) / self.temperature
        e = np.exp(z - z.max(1, keepdims=True)) if len(z) else z
        return e / e.sum(1, keepdims=True) if len(z) else z


def train(texts: list[str], labels: list[str], dim: int = 16, epochs: int = 6, rate: float = 0.05, noise: float = 0.08, seed: int = 7) -> Model:
    """Fit the vectors and the softmax layer on the texts' paragraphs, calibrate on a held-out tenth of the texts.

    A label is taken to be wrong with probability ``noise``, and of another paragraph's language as
    often: a row that the model gives another language weighs little. The temperature minimises
    the held-out loss under the same assumption; ``accept`` is the confidence below which a
    paragraph is left without language, the least at which the accepted held-out paragraphs
    disagree with their labels no more often than the surest half does, plus half a per cent.
    """
    rng = np.random.default_rng(seed)
    k = len(LANGUAGES)
    order = rng.permutation(len(texts))
    held_texts = set(order[: len(order) // 10].tolist())
    pieces, y, held, fit = [], [], [], []
    for i, (t, lab) in enumerate(zip(texts, labels)):
        for line in t.split("\n"):
            if sum(c.isalpha() for c in line) >= 12:
                (held if i in held_texts else fit).append(len(pieces))
                pieces.append(line)
                y.append(LANGUAGES.index(lab))
    y, fit = np.array(y, np.int64), np.array(fit, np.int64)
    vec = rng.normal(0, 0.1, (BUCKETS, dim)).astype(np.float32)
    w, b = rng.normal(0, 0.5, (dim, k)).astype(np.float32), np.zeros(k, np.float32)
    # step sizes fall with the gradients a bucket has had, so that rare subwords learn as well as frequent ones
    seen, seen_w, seen_b = np.full(BUCKETS, 1e-8, np.float32), np.full_like(w, 1e-8), np.full_like(b, 1e-8)
    bags, weights = [], []
    for line in pieces:
        g, begin = features([line])
        u, c = np.unique(g[begin[0] : begin[0] + len(line.lower()) + 1], return_counts=True)
        bags.append(u)
        weights.append((c / c.sum()).astype(np.float32)[:, None])
    share = np.bincount(y[fit], minlength=k) / max(1, len(fit)) if len(fit) else np.zeros(k)
    balance = np.sqrt(1.0 / (k * np.maximum(share, 1e-3))).clip(0.3, 3)
    for e in range(epochs):
        lr = np.float32(rate * (1 - e / epochs))
        rng.shuffle(fit)
        for s in range(0, len(fit), 16):
            rows = fit[s : s + 16]
            n = np.array([len(bags[r]) for r in rows])
            part = vec[np.concatenate([bags[r] for r in rows])] * np.concatenate([weights[r] for r in rows])
            mean = np.add.reduceat(part, np.concatenate([[0], np.cumsum(n)[:-1]]), 0)
            z = mean @ w + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            at = np.arange(len(rows)), y[rows]
            trust = (1 - noise) * p[at] / ((1 - noise) * p[at] + noise / k) if e else np.ones(len(rows))
            p[at] -= 1
            p *= (trust * balance[y[rows]])[:, None]
            gm, gw, gb = (p @ w.T).astype(np.float32), mean.T @ p / len(rows), p.mean(0)
            seen_w += gw * gw
            seen_b += gb * gb
            w -= lr * (gw / np.sqrt(seen_w)).astype(np.float32)
            b -= lr * (gb / np.sqrt(seen_b)).astype(np.float32)
            for r, row in enumerate(rows):
                ix, g = bags[row], gm[r] * weights[row]
                seen[ix] += (g * g).mean(1)
                vec[ix] -= lr * g / np.sqrt(seen[ix])[:, None]
    m = Model((vec @ w).astype(np.float32), b, 1.0, 0.6)
    if len(held) >= 20:
        z, yh = m.logits([pieces[r] for r in held]), y[held]

        def loss(t: float) -> float:
            q = np.exp(z / t - (z / t).max(1, keepdims=True))
            q /= q.sum(1, keepdims=True)
            return float(-np.log((1 - noise) * q[np.arange(len(yh)), yh] + noise / k).mean())

        m.temperature = float(min(np.geomspace(0.1, 4, 30), key=loss))
        p = m.probabilities([pieces[r] for r in held])
        right, conf = p.argmax(1) == yh, p.max(1)
        sure = right[conf >= np.median(conf)].mean()
        m.accept = float(next((a for a in np.arange(0.4, 0.65, 0.05) if right[conf >= a].mean() >= sure - 0.005), 0.65))
    return m


def fit_languages(documents: DataFrame, doc_id: str, text: str, label: Column, sample_rows: int = 6000, sample_chars: int = 600) -> Model:
    """Train on about ``sample_rows`` labelled rows (those of smallest hashed id, at most twice as many), up to ``sample_chars`` of each."""
    known = documents.select(F.xxhash64(F.col(doc_id)).alias("h"), F.col(text).alias("t"), label.alias("y")).filter("y is not null and length(t) >= 20")
    n = max(1, known.count())
    below = -(1 << 63) + min((1 << 64) - 1, (sample_rows << 64) // n)  # hashes are even over 64 bits
    rows = known.filter(F.col("h") <= below).limit(2 * sample_rows).select("h", F.substring("t", 1, sample_chars).alias("t"), "y").collect()
    rows.sort(key=lambda r: (r["h"], r["t"]))
    if not rows:
        return Model(np.zeros((BUCKETS, len(LANGUAGES)), np.float32), np.zeros(len(LANGUAGES)), 1.0, 1.1)
    return train([repaired(r["t"]) for r in rows], [r["y"] for r in rows])


def is_scrap(line: str) -> bool:
    """Whether a whole line has fewer letters and marks than ``SCRAP``; a Han character counts as three."""
    n = 0
    for c in line:
        if c.isalpha() or c > "\u02ff" and unicodedata.category(c)[0] == "M":
            n += 3 if ord(c) >= 0x2E80 else 1
            if n >= SCRAP:
                return False
    return True


def settled(best: list[str], conf: list[float], lines: list[str], accept: float) -> list[str | None]:
    """The languages of a document's paragraphs.

    An uncertain paragraph follows its neighbours; so does a scrap beside whole ones, unless its
    own prediction is ``SURE``.
    """
    own: list[str | None] = [v if c >= accept else None for v, c in zip(best, conf)]
    scraps = [is_scrap(x) for x in lines]
    if not all(scraps):
        own = [None if x and c < SURE else v for v, c, x in zip(own, conf, scraps)]
    for k in range(len(own)):
        if own[k] is None:
            near = [v for v in (own[k - 1] if k else None, next((v for v in own[k + 1 :] if v), None)) if v]
            own[k] = near[0] if near else None
    return own


def segments(documents: DataFrame, model: Model, doc_id: str, text: str) -> DataFrame:
    """(doc_id, segment, start_char, end_char, lang, confidence): runs of paragraphs of one language.

    Paragraphs are the non-blank lines, weighed whole.  One too uncertain to name takes the
    language of its neighbours, and is null where there is none.  Null and empty texts give no row;
    equal ids give rows each; an empty table gives no rows.
    """
    kind = documents.schema[doc_id].dataType.simpleString()
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def name(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for batch in batches:
            ids, bodies = batch["doc_id"].tolist(), batch["text"].tolist()
            lo = 0
            while lo < len(bodies):
                hi, n = lo, 0
                while hi < len(bodies) and (hi == lo or n + len(bodies[hi]) < 300_000):
                    n += len(bodies[hi])
                    hi += 1
                pieces = []
                for k in range(lo, hi):
                    at = 0
                    for line in bodies[k].split("\n"):
                        if any(c.isalpha() for c in line):
                            pieces.append((k, at, at + len(line), line))
                        at += len(line) + 1
                plain = [repaired(x[3]) for x in pieces]
                p = m.probabilities(plain)
                best, conf = p.argmax(1), p.max(1) if len(p) else p
                out, i = [], 0
                while i < len(pieces):
                    j = i
                    while j < len(pieces) and pieces[j][0] == pieces[i][0]:
                        j += 1
                    own = settled([LANGUAGES[b] for b in best[i:j]], conf[i:j].tolist(), plain[i:j], m.accept)
                    k = i
                    while k < j:
                        e = k
                        while e < j and own[e - i] == own[k - i]:
                            e += 1
                        size = np.array([x[2] - x[1] for x in pieces[k:e]], float)
                        lang = own[k - i]
                        c = float((p[k:e, LANGUAGES.index(lang)] * size).sum() / max(size.sum(), 1)) if lang else float(conf[k:e].mean())
                        out.append((ids[pieces[i][0]], k - i, pieces[k][1], pieces[e - 1][2], lang, c))
                        k = e
                    i = j
                yield pd.DataFrame(out, columns=["doc_id", "segment", "start_char", "end_char", "lang", "confidence"])
                lo = hi

    some = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter("text is not null")
    return some.mapInPandas(name, f"doc_id {kind}, segment int, start_char int, end_char int, lang string, confidence double")


def document_languages(parts: DataFrame) -> DataFrame:
    """(doc_id, lang, confidence, mixed): the language that fills most of each document."""
    size = F.col("end_char") - F.col("start_char")
    by = parts.filter("lang is not null").groupBy("doc_id", "lang").agg(F.sum(size).alias("n"), (F.sum(size * F.col("confidence")) / F.greatest(F.sum(size), F.lit(1))).alias("c"))
    return by.groupBy("doc_id").agg(F.max_by("lang", F.struct("n", "lang")).alias("lang"), F.max_by("c", F.struct("n", "lang")).alias("confidence"), (F.count(F.lit(1)) > 1).alias("mixed"))
