"""Filling containers of fixed capacity by Karmarkar-Karp multiway differencing.

Items fall into groups of bounded size by the hash of their id; every group is solved on its own. The solver merges
partial partitions into k windows, always the two of the widest spread, the heaviest window of one on the lightest of
the other, which leaves near-equal windows. Full enough windows that fit are kept, the rest is differenced again, and
where that no longer helps the number of windows rises until none exceeds the capacity.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP_WINDOWS = 768
GROUP_ITEMS = 16_384
MOST_TASKS = 20_000
#: a window filled to this share is kept while the others are differenced again
KEEP_FILL = 0.995
#: and where none is, to this much less, down to the least
FILL_STEP = 0.01
LEAST_FILL = 0.9


def difference(sizes: np.ndarray, k: int) -> np.ndarray:
    """Karmarkar-Karp: window number (0 .. k-1) of every item, for k windows of near-equal sums."""
    n = len(sizes)
    if k <= 1 or n <= 1:
        return np.zeros(n, dtype=np.int64)
    # a partition is (sums ascending, roots of the trees of items in each window, -1 for none); a single item is implicit
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    parts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    left, right = np.full(2 * n, -1, dtype=np.int64), np.full(2 * n, -1, dtype=np.int64)
    free, tag = n, n
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        if b in parts and a not in parts:
            a, b = b, a
        if a not in parts:  # two single items
            sums, roots = np.zeros(k, dtype=np.int64), np.full(k, -1, dtype=np.int64)
            sums[-1], roots[-1] = sizes[a], a
        else:
            sums, roots = parts.pop(a)
        if b in parts:
            other, trees = parts.pop(b)
            sums = sums + other[::-1]
            trees = trees[::-1]
            both = (roots >= 0) & (trees >= 0)
            new = np.arange(free, free + int(both.sum()))
            left[new], right[new] = roots[both], trees[both]
            roots = np.where(roots >= 0, roots, trees)
            roots[both] = new
            free += len(new)
            order = np.argsort(sums, kind="stable")
            sums, roots = sums[order], roots[order]
        else:  # one item onto the lightest window, which then moves to its place
            total, root = sums[0] + sizes[b], roots[0]
            if root >= 0:
                left[free], right[free] = root, b
                root, free = free, free + 1
            else:
                root = b
            to = int(np.searchsorted(sums, total)) - 1
            to = max(0, to)
            sums, roots = sums.copy(), roots.copy()
            sums[:to], roots[:to] = sums[1 : to + 1], roots[1 : to + 1]
            sums[to], roots[to] = total, root
        parts[tag] = (sums, roots)
        heapq.heappush(heap, (-int(sums[-1] - sums[0]), tag))
        tag += 1
    _, roots = parts[heap[0][1]]
    window = np.zeros(n, dtype=np.int64)
    stack = [(int(r), w) for w, r in enumerate(roots) if r >= 0]
    while stack:
        node, w = stack.pop()
        if node < n:
            window[node] = w
        else:
            stack.append((int(left[node]), w))
            stack.append((int(right[node]), w))
    return window


def fill(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of every item, none filled beyond ``capacity``; every size must be 0 .. capacity."""
    container = np.full(len(sizes), -1, dtype=np.int64)
    used = 0
    open_ = np.arange(len(sizes))
    extra, floor = 0, KEEP_FILL
    while len(open_):
        own = sizes[open_]
        k = max(1, -(-int(own.sum()) // capacity)) + extra
        window = difference(own, k)
        sums = np.bincount(window, weights=own, minlength=k)
        good = (sums <= capacity) & (sums >= floor * capacity)
        if sums.max() <= capacity:
            good[:] = True
        if good.any():
            kept = good[window]
            number = np.cumsum(good) - 1
            container[open_[kept]] = used + number[window[kept]]
            used += int(good.sum())
            open_ = open_[~kept]
        elif floor > LEAST_FILL:
            floor -= FILL_STEP
        else:  # no window can be kept: the count rises
            extra += 1 + extra // 2
    _, container = np.unique(container, return_inverse=True)
    return container


def pack(items: DataFrame, limits: list[tuple[int, int]], item: str, size: str, *, tokens: int, count: int) -> DataFrame:
    """limit_no, container_id, ``item``, part_no, start, n_tokens: every item in a container of every limit.

    ``limits`` are (limit_no, capacity); ``tokens`` and ``count`` are the total size and number of items.

    * An item within the capacity has one row (part_no 0, start 0); a longer one is cut into full containers and a rest
      that is packed like an item. An item of size 0 or null takes a place of size 0.
    * Equal items are packed each; ids must be unique, or their rows land in different places. Capacities of 0 or less
      or null give no rows. No items, no rows. Other columns are not read.
    * Groups hold about GROUP_WINDOWS containers or GROUP_ITEMS items: the memory of a task doesn't grow with the table.
    """
    parts, total = None, 0
    for limit_no, capacity in limits:
        if not capacity or capacity <= 0:
            continue
        groups = max(1, -(-tokens // (capacity * GROUP_WINDOWS)), -(-count // GROUP_ITEMS))
        total += groups
        one = items.select(
            F.lit(limit_no).cast("int").alias("limit_no"),
            F.lit(capacity).cast("long").alias("capacity"),
            F.pmod(F.xxhash64(F.lit(limit_no), F.col(item)), F.lit(groups)).alias("grp"),
            F.col(item),
            F.coalesce(F.col(size), F.lit(0)).cast("long").alias("whole"),
        )
        parts = one if parts is None else parts.unionAll(one)
    kind = items.schema[item].dataType.simpleString()
    schema = f"limit_no int, container_id string, `{item}` {kind}, part_no int, start long, n_tokens long"
    if parts is None:
        return items.sparkSession.createDataFrame([], schema)

    def solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        limit_no, capacity, group = int(key[0]), int(key[1]), int(key[2])
        whole = rows["whole"].to_numpy()
        cuts = np.where(whole > capacity, whole // capacity, 0)
        rest = whole - cuts * capacity
        packed = np.flatnonzero((rest > 0) | (cuts == 0))
        container = np.full(len(rows), -1, dtype=np.int64)
        container[packed] = fill(rest[packed], capacity)
        full = np.repeat(np.arange(len(rows)), cuts)
        part = np.arange(len(full)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        row = np.concatenate([packed, full])
        ids = np.concatenate([container[packed], container.max(initial=-1) + 1 + np.arange(len(full))])
        out = pd.DataFrame({"limit_no": limit_no, "container_id": [f"{limit_no}-{group}-{c}" for c in ids]})
        out[item] = rows[item].to_numpy()[row]
        out["part_no"] = np.concatenate([cuts[packed], part]).astype(np.int32)
        out["start"] = np.concatenate([cuts[packed] * capacity, part * capacity])
        out["n_tokens"] = np.concatenate([rest[packed], np.full(len(full), capacity)])
        return out

    # solving costs time, not bytes: the number of tasks is set here, where sizes would merge them into a few
    spread = parts.repartition(min(total, MOST_TASKS), "limit_no", "capacity", "grp")
    return spread.groupBy("limit_no", "capacity", "grp").applyInPandas(solve, schema)
