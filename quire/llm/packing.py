"""Problem 8: filling fixed-capacity containers, bounded-space and online per partition."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import cut_lineage


class Windows:
    """A fixed number of open containers; best fit, and the fullest leaves when none fits."""

    def __init__(self, capacity: int, most: int, prefix: str) -> None:
        self.capacity, self.most, self.prefix = capacity, most, prefix
        self.room: list[tuple[int, int]] = []  # (room left, number), ascending
        self.made = 0

    def place(self, size: int) -> str:
        i = bisect_left(self.room, (size, -1))
        if i < len(self.room):
            left, k = self.room.pop(i)
        else:
            if len(self.room) >= self.most:
                self.room.pop(0)  # the fullest is closed
            left, k = self.capacity, self.made
            self.made += 1
        if left > size:
            insort(self.room, (left - size, k))
        return f"{self.prefix}{k}"

    def fill(self, size: int, least: int) -> tuple[str, int]:
        """A piece of an item that must be cut anyway: it fills the roomiest open container, or a new one."""
        if self.room and self.room[-1][0] >= least:
            left, k = self.room.pop()
            if left > size:
                insort(self.room, (left - size, k))
            return f"{self.prefix}{k}", min(left, size)
        self.made += 1
        return f"{self.prefix}{self.made - 1}", self.capacity

    def open(self) -> dict[str, int]:
        return {f"{self.prefix}{k}": self.capacity - left for left, k in self.room}


_PLACED = "container_kind string, capacity int, container_id string, item_id bigint, piece int, offset bigint, size bigint, open boolean"


def pack(items: DataFrame, containers: DataFrame, item_id: str, size: str, windows: int = 8192, merge_group: int = 1 << 16, least_piece: int = 64, most_kinds: int = 1000) -> DataFrame:
    """Assign every item to a container of each kind: container_kind, capacity, container_id, item_id, piece, offset, size.

    Items go, in the order in which their partition arrives (within an Arrow batch the largest
    first), into the best fitting of ``windows`` open containers of their partition; nothing is
    shuffled.  Containers still open at a partition's end are then merged as wholes, in groups of
    about ``merge_group``.  Only an item larger than the capacity is cut: its pieces, of at least
    ``least_piece``, fill the room left in open containers or whole ones, its rest is placed best fit.  A null or negative size counts as 0 and takes no room; equal ids stay separate rows.
    An empty table gives no rows.  ``containers`` holds one row per kind (a small
    fixed table); more than ``most_kinds`` are refused.
    """
    kinds = [(r[0], int(r[1])) for r in containers.select("container_kind", "capacity").distinct().orderBy("container_kind").limit(most_kinds + 1).collect()]
    if len(kinds) > most_kinds:
        raise ValueError(f"more than {most_kinds} kinds of container")

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        packs = [(k, c, Windows(c, windows, f"{k}-{part}-")) for k, c in kinds]
        kept: dict[str, list] = {}
        for b in batches:
            b = b.sort_values("size", ascending=False, kind="stable")
            rows = []
            for kind, cap, w in packs:
                each = list(zip(b["item_id"].tolist(), b["size"].tolist()))
                for i, n in [x for x in each if x[1] <= cap] + [x for x in each if x[1] > cap]:
                    at = piece = 0
                    while n - at > cap:
                        where, size = w.fill(n - at, least_piece)
                        rows.append((kind, cap, where, i, piece, at, size))
                        at, piece = at + size, piece + 1
                    rows.append((kind, cap, w.place(n - at), i, piece, at, n - at))
            still = set().union(*(w.open() for _, _, w in packs))
            done = []
            for r in rows:
                (kept.setdefault(r[2], []) if r[2] in still else done).append(r)
            for gone in [k for k in kept if k not in still]:
                done += kept.pop(gone)
            yield pd.DataFrame([(*r, False) for r in done], columns=[x.split()[0] for x in _PLACED.split(", ")])
        yield pd.DataFrame([(*r, True) for v in kept.values() for r in v], columns=[x.split()[0] for x in _PLACED.split(", ")])

    sized = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0)).alias("size"))
    placed = cut_lineage(sized.mapInPandas(first, _PLACED))
    left = placed.filter("open").groupBy("container_kind", "capacity", "container_id").agg(F.sum("size").alias("size"))
    groups = max(1, left.count() // merge_group)

    def merge(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        kind, group = key
        b = b.sort_values(["size", "container_id"], ascending=[False, True])
        w = Windows(int(b["capacity"].iloc[0]) if len(b) else 1, len(b) + 1, f"{kind}-m{group}-")
        return pd.DataFrame({"container_id": b["container_id"].tolist(), "merged_id": [w.place(int(n)) for n in b["size"]]})

    merged = (
        left.withColumn("_g", F.pmod(F.xxhash64("container_id"), F.lit(groups)))
        .groupBy("container_kind", "_g").applyInPandas(merge, "container_id string, merged_id string")
    )
    return placed.join(merged, "container_id", "left").select(
        "container_kind", "capacity", F.coalesce("merged_id", "container_id").alias("container_id"), "item_id", "piece", "offset", "size")
