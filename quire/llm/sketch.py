"""Counters of fixed size: every task counts into one array of 2^bits cells, the arrays are added up.

A key's cell holds its own count and those of the keys that share the cell: counts are never too
small, and the size does not grow with the data.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

CHUNK_BITS = 15


def pieces(sketch: np.ndarray) -> list[tuple[int, bytes]]:
    """(chunk number, compressed counters) of one task's array."""
    n = 1 << CHUNK_BITS
    return [(c, zlib.compress(sketch[c * n : (c + 1) * n].tobytes(), 1)) for c in range(len(sketch) // n)] if sketch.any() else []


def total(parts: DataFrame, bits: int) -> np.ndarray:
    """The sum of all tasks' pieces (chunk, blob): an array of 2^bits counters on the driver."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for c, blob in zip(b["chunk"], b["blob"]):
                v = np.frombuffer(zlib.decompress(blob), np.uint32)
                sums[c] = sums[c] + v if c in sums else v.copy()
        yield pd.DataFrame([(c, v.tobytes()) for c, v in sums.items()], columns=["chunk", "blob"])

    out = np.zeros(1 << bits, np.uint32)
    n = 1 << CHUNK_BITS
    for r in parts.select("chunk", "blob").repartition(8, "chunk").mapInPandas(add, "chunk int, blob binary").collect():  # 2^(bits - 15) rows
        out[r["chunk"] * n : (r["chunk"] + 1) * n] += np.frombuffer(r["blob"], np.uint32)
    return out
