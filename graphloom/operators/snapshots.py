"""What changed between consecutive full snapshots.

The states of all snapshots are range-partitioned and sorted by (scope, key, snapshot); every range is then streamed
once, and neighbouring rows of a key are compared as a two-pointer merge of the snapshots would compare them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHANGE_SCHEMA = "scope string, snapshot_no int, key string, change string"


def _merge_range(batches: Iterator[pa.RecordBatch], names: tuple[str, ...] | None) -> Iterator[pa.RecordBatch]:
    """Sorted rows (scope, key, ord, last, no, next_no, states s0, s1 ..) to typed changes, with ``names`` also to the
    names of the states that differ.

    Each row looks at the row before and after it; the last row of a batch waits for the next batch.
    """
    held: pa.Table | None = None

    def emit(table: pa.Table, before: tuple | None, final: bool):
        n = table.num_rows
        cols = {c: table.column(c) for c in table.column_names}
        key = [cols["scope"].to_numpy(zero_copy_only=False), cols["key"].to_numpy(zero_copy_only=False)]
        at, last = (cols[c].to_numpy() for c in ("ord", "last"))
        states = [cols[c].to_numpy(zero_copy_only=False) for c in table.column_names if c.startswith("s") and c[1:].isdigit()]
        same = np.zeros(n + 1, dtype=bool)  # same[i]: rows i-1 and i have one key
        same[1:n] = (key[0][1:] == key[0][:-1]) & (key[1][1:] == key[1][:-1])
        prev_at = np.empty(n, dtype=at.dtype)
        prev_at[1:] = at[:-1]
        if n:
            same[0] = before is not None and before[0] == key[0][0] and before[1] == key[1][0]
            prev_at[0] = before[2] if before is not None else -1
        upto = n if final else n - 1  # whether the held row is followed by its key isn't known yet
        next_at = np.full(n, -1, dtype=at.dtype)
        follows = same[1:n]
        next_at[: n - 1][follows] = at[1:][follows]
        joined = same[:n] & (prev_at == at - 1)
        differ = np.zeros((len(states), n), dtype=bool)
        for k, state in enumerate(states):
            differ[k, 1:] = state[1:] != state[:-1]
            if before is not None and n:
                differ[k, 0] = state[0] != before[3][k]
        added = ~joined & (at > 1)
        changed = joined & differ.any(axis=0)
        removed = (at < last) & (next_at != at + 1)
        scan = np.arange(upto)
        for what, mask, number in (("added", added, "no"), ("changed", changed, "no"), ("removed", removed, "next_no")):
            rows = scan[mask[:upto]]
            if len(rows):
                pick = pa.array(rows)
                out = [cols["scope"].take(pick).combine_chunks(), cols[number].take(pick).combine_chunks(), cols["key"].take(pick).combine_chunks(), pa.array([what] * len(rows))]
                if names:
                    out.append(pa.array([[x for x, d in zip(names, differ[:, r], strict=True) if d] if what == "changed" else [] for r in rows], pa.list_(pa.string())))
                yield pa.RecordBatch.from_arrays(out, names=["scope", "snapshot_no", "key", "change", *(["columns"] if names else [])])

    before = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        if table.num_rows < 2:
            held = table
            continue
        yield from emit(table, before, final=False)
        row = table.slice(table.num_rows - 2, 1).to_pylist()[0]
        before = (row["scope"], row["key"], row["ord"], [v for c, v in row.items() if c.startswith("s") and c[1:].isdigit()])
        held = table.slice(table.num_rows - 1)
    if held is not None and held.num_rows:
        yield from emit(held, before, final=True)


def snapshot_changes(df: DataFrame, scope: Column, number: Column, key: Column, state: Column, loaded: Column, *, compare: dict[str, Column] | None = None, ranges: int | None = None) -> DataFrame:
    """scope, snapshot_no, key, change (``added``, ``removed``, ``changed``) against the scope's previous delivery.

    * Several rows of one key in a snapshot: the one with the greatest ``loaded`` holds; among equal ones the greatest
      state, null being the least. Repeated rows change nothing.
    * A row with a null state says that the key is not there, but still delivers its snapshot. Blank states are the
      caller's business; rows with a null scope, number, or null or empty key are ignored.
    * With ``compare`` (name to a string column) a row is changed if any of these differs too, null being a value, and
      a column ``columns`` has the names of those that differ, ``state`` among them.
    * The first snapshot of a scope gives no changes; numbers may have gaps. An empty table gives no rows. Only the
      given columns are read.
    """
    more = compare or {}
    names = ("state", *more) if compare is not None else None
    states = [f"s{k}" for k in range(1 + len(more))]
    rows = df.select(scope.alias("scope"), number.cast("int").alias("no"), key.alias("key"), *[c.cast("string").alias(s) for s, c in zip(states, (state, *more.values()), strict=True)], loaded.alias("loaded"))
    rows = rows.where(F.col("scope").isNotNull() & F.col("no").isNotNull())
    delivered = rows.groupBy("scope", "no").agg(F.count(F.lit(1)).alias("n")).drop("n")
    order = Window.partitionBy("scope").orderBy("no")  # one row per delivered snapshot
    delivered = delivered.select(
        F.col("scope").alias("d_scope"),
        F.col("no").alias("d_no"),
        F.row_number().over(order).alias("ord"),
        F.lead("no").over(order).alias("next_no"),
        F.count(F.lit(1)).over(Window.partitionBy("scope")).cast("int").alias("last"),
    )
    latest = (
        rows.where(F.col("key").isNotNull() & (F.col("key") != ""))
        .groupBy("scope", "no", "key")
        .agg(F.max(F.struct("loaded", *states)).alias("top"))
        .select("scope", "no", "key", *[F.col(f"top.{s}").alias(s) for s in states])
        .where(F.col("s0").isNotNull())
    )
    placed = latest.join(delivered, (latest["scope"] == delivered["d_scope"]) & (latest["no"] == delivered["d_no"])).select("scope", "key", "ord", "last", "no", "next_no", *states)
    spread = placed.repartitionByRange(ranges, "scope", "key") if ranges else placed.repartitionByRange("scope", "key")
    schema = CHANGE_SCHEMA + (", columns array<string>" if names else "")
    return spread.sortWithinPartitions("scope", "key", "ord").mapInArrow(lambda batches: _merge_range(batches, names), schema)
