"""Packing items of varying size into containers of one capacity."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


class _Sizes:
    """A multiset of sizes with its distinct sizes in order."""

    def __init__(self, sizes, capacity: int):
        self.count = np.zeros(capacity + 1, np.int64)
        for s in sizes:
            self.count[s] += 1
        self.distinct: list[int] = [int(s) for s in np.flatnonzero(self.count)]

    def take(self, size: int) -> None:
        self.count[size] -= 1
        if not self.count[size]:
            del self.distinct[bisect_left(self.distinct, size)]

    def put(self, size: int) -> None:
        if not self.count[size]:
            insort(self.distinct, size)
        self.count[size] += 1

    def largest(self, most: int) -> int:
        """The largest size up to ``most``, 0 if none."""
        i = bisect_right(self.distinct, most)
        return self.distinct[i - 1] if i else 0

    def least_sum(self, n: int) -> int:
        """Sum of the n smallest items, a huge number if there are fewer."""
        total = 0
        for s in self.distinct:
            k = min(n, int(self.count[s]))
            total, n = total + k * s, n - k
            if not n:
                return total
        return 1 << 60

    def best_pair(self, most: int) -> int:
        """The largest sum up to ``most`` of two items, 0 if none."""
        d = np.array(self.distinct)
        d = d[d <= most]
        if not len(d):
            return 0
        i = np.searchsorted(d, most - d, side="right") - 1
        alone = (i >= 0) & (d[np.maximum(i, 0)] == d) & (self.count[d] < 2)
        i = np.where(alone, i - 1, i)
        ok = i >= 0
        return int((d[ok] + d[i[ok]]).max()) if ok.any() else 0

    def best_second(self, most: int) -> int:
        """The largest size that can be the smaller of two items with a sum up to ``most``, 0 if none."""
        best = 0
        i = bisect_right(self.distinct, most // 2)
        for j in range(i - 1, -1, -1):
            s = self.distinct[j]
            if self.count[s] >= 2:
                best = s
                break
        for j in range(i - 1, -1, -1):
            if j + 1 < len(self.distinct) and self.distinct[j] + self.distinct[j + 1] <= most:
                best = max(best, self.distinct[j])
                break
        return best


def reduce_by_dominance(sizes: list[int], capacity: int) -> tuple[list[tuple[int, ...]], list[int]]:
    """Martello and Toth's reduction: (containers fixed for good, sizes left).

    Some best packing contains every fixed container, as each holds a set of up to three items that dominates all
    other ways to fill a container with its largest item."""
    left, fixed = _Sizes(sizes, capacity), []
    pivots = sorted(sizes, reverse=True)
    waiting = np.zeros(capacity + 1, np.int64)  # items that were tried and stay
    for j in pivots:
        if left.count[j] <= waiting[j]:
            continue
        left.take(j)
        room = capacity - j
        k = left.largest(room)
        chosen: tuple[int, ...] | None = None
        if not k:
            chosen = (j,)
        elif k == room or left.least_sum(2) > room:
            chosen = (j, k)
        elif left.least_sum(3) > room:
            if left.best_pair(room) <= k:
                chosen = (j, k)
            else:
                left.take(k)
                b = left.largest(room - k)
                left.put(k)
                if b and left.best_second(room) <= b:
                    chosen = (j, k, b)
        if chosen is None:
            left.put(j)
            waiting[j] += 1
            continue
        for s in chosen[1:]:
            left.take(s)
            waiting[s] = min(waiting[s], left.count[s])
        fixed.append(chosen)
    return fixed, [int(s) for s in np.repeat(np.arange(capacity + 1), left.count)]


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each item, the largest first, into the fullest container that has room for it."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0  # a bit for every room that some container has
    for s in sorted(sizes, reverse=True):
        up = rooms >> s
        if up:
            room = s + (up & -up).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, at = capacity, len(bins)
            bins.append([])
        bins[at].append(s)
        if room > s:
            by_room.setdefault(room - s, []).append(at)
            rooms |= 1 << (room - s)
    return bins


def pack(sizes: list[int], capacity: int) -> list[int]:
    """The container number of every item; sizes must be from 1 to ``capacity``."""
    fixed, rest = reduce_by_dominance(sizes, capacity)
    bins = [*map(list, fixed), *best_fit(rest, capacity)]
    places: dict[int, list[int]] = {}
    for c, items in enumerate(bins):
        for s in items:
            places.setdefault(s, []).append(c)
    return [places[s].pop() for s in sizes]


def pack_items(items: DataFrame, key_col: str, size_col: str, *, capacity: int = 2048, group_items: int = 20_000) -> DataFrame:
    """``container_id``, ``key_col``, ``piece_no``, ``first`` (offset of the piece in its item), ``size``.

    An item larger than the capacity is cut into full pieces and a rest; no other item is split. Items are dealt at random
    into groups of about ``group_items``, each packed by itself (dominance reduction, then best fit), so that no task
    grows with the input; the room lost to grouping is at most one container in each group. Items of size 0 or null get
    no row. Repeated keys and ties are fine; an empty table gives an empty result.
    """
    sized = items.select(F.col(key_col).alias("_key"), F.col(size_col).cast("bigint").alias("_n")).where("_n > 0")
    sized = cut(sized)
    groups = max(1, -(-sized.count() // group_items))
    whole = F.floor((F.col("_n") - 1) / capacity)
    pieces = sized.select("_key", "_n", F.explode(F.sequence(F.lit(0).cast("bigint"), whole)).alias("_i"))
    pieces = pieces.select("_key", F.col("_i").cast("int").alias("_i"), (F.col("_i") * capacity).alias("_first"), F.least(F.lit(capacity), F.col("_n") - F.col("_i") * capacity).cast("int").alias("_size"))
    dealt = pieces.withColumn("_g", F.pmod(F.xxhash64("_key", "_i"), F.lit(groups)).cast("bigint"))
    kind = sized.schema["_key"].dataType.simpleString()

    def one(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["_size", "_key", "_i"], kind="stable")
        at = np.array(pack(b["_size"].tolist(), capacity), np.int64)
        return pd.DataFrame({"container_id": b["_g"].to_numpy() * (1 << 32) + at, "_key": b["_key"].to_numpy(), "piece_no": b["_i"].to_numpy(), "first": b["_first"].to_numpy(), "size": b["_size"].to_numpy()})

    got = dealt.groupBy("_g").applyInPandas(one, f"container_id bigint, _key {kind}, piece_no int, first bigint, size int")
    return got.withColumnRenamed("_key", key_col)
