"""Per-key aggregation that stays balanced when a handful of keys hold most rows.

Multi-level tree aggregation: rows fall into leaves of a fixed expected size by the hash of the counted member, each
leaf folds its rows into one state per key, and the states climb a tree of constant fan-in. However hot a key is, no
task folds more than ``fan_in`` states of it, and a leaf holds about ``chunk_rows`` rows of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.canonical import canonical_type, present, stripped
from graphloom.shared import Scratch, row_count


def _leaves(field: T.StructField, c: Column) -> list[Column]:
    if isinstance(field.dataType, T.StructType):
        return [x for f in field.dataType.fields for x in _leaves(f, c.getField(f.name))] + [c.isNull()]
    if isinstance(field.dataType, (T.MapType, T.VariantType)):
        return [F.to_json(F.array_sort(F.map_entries(c))) if isinstance(field.dataType, T.MapType) else c.cast("string")]
    return [c]


def row_fingerprint(df: DataFrame) -> list[Column]:
    """Two independent 64-bit hashes of the whole row; null differs from every value.

    Rows are taken as equal when both agree: for 10^12 rows a wrong match has a chance under 10^-14.
    """
    parts = [x for f in df.schema.fields for x in _leaves(f, df[f"`{f.name}`"])]
    # which values are null, as bits of as many numbers as it takes: a hash skips nulls
    nulls = [sum((F.when(x.isNull(), 1 << i).otherwise(0) for i, x in enumerate(parts[at : at + 30])), F.lit(0)) for at in range(0, len(parts), 30)]
    return [F.xxhash64(F.lit(seed), *nulls, *parts) for seed in (17, 4242)]


def tree_rounds(rows: int, chunk_rows: int, fan_in: int) -> int:
    """Levels above the leaves: the least r with fan_in^r leaves of at most chunk_rows rows each."""
    rounds, leaves = 0, 1
    while leaves * chunk_rows < rows:
        rounds, leaves = rounds + 1, leaves * fan_in
    return rounds


def tree_aggregate(
    df: DataFrame,
    keys: list[str],
    member: list[str],
    leaf_states: dict[str, Column],
    merges: dict[str, Column],
    *,
    rows: int,
    chunk_rows: int = 1 << 18,
    fan_in: int = 16,
) -> DataFrame:
    """One row per key with the merged states.

    ``member`` columns decide the leaf, so that rows of equal member meet in one leaf and per-leaf distinct counts add
    up. ``leaf_states`` fold rows of (keys, leaf), ``merges`` fold two or more states into one under the same name.
    Keys may be null (null is one key). An empty input gives no rows.
    """
    rounds = tree_rounds(rows, chunk_rows, fan_in)
    leaf = F.pmod(F.xxhash64(F.lit("leaf"), *member), F.lit(fan_in**rounds)).alias("__leaf")
    states = df.select("*", leaf).groupBy(*keys, "__leaf").agg(*[c.alias(k) for k, c in leaf_states.items()])
    for _ in range(rounds):
        up = F.expr(f"__leaf div {fan_in}").alias("__leaf")
        states = states.select(*keys, *leaf_states, up).groupBy(*keys, "__leaf").agg(*[c.alias(k) for k, c in merges.items()])
    return states.select(*keys, *leaf_states)


def edge_totals(edges: DataFrame, *, chunk_rows: int = 1 << 18, fan_in: int = 16, rows: int | None = None) -> DataFrame:
    """target, type -> edges, weight, sources for a table of edges.

    * A row equal to another in every column of the table is a repeated delivery and counts once; parallel edges stay.
    * ``type`` is brought to its usual form, ``target`` loses surrounding blanks; null, empty and blank targets form
      the one key null, which callers drop or report.
    * ``weight`` adds non-null weights (0 if there are none), ``sources`` counts distinct non-blank sources.
    * Extra columns only take part in telling repeated deliveries; an empty table gives no rows.
    """
    if rows is None:
        rows = row_count(edges)
    f1, f2 = row_fingerprint(edges)
    source = F.when(present(edges["source"]), stripped(edges["source"]))
    slim = edges.select(
        F.when(present(edges["target"]), stripped(edges["target"])).alias("target"),
        canonical_type(edges["type"]).alias("type"),
        F.when(source.isNotNull(), F.xxhash64(source)).alias("s1"),
        F.when(source.isNotNull(), F.xxhash64(F.lit(99), source)).alias("s2"),
        edges["weight"].cast("long").alias("w"),
        f1.alias("f1"),
        f2.alias("f2"),
    )
    # repeated deliveries meet by their fingerprint, an even key; parallel edges of one source are folded before the
    # next exchange, so a hot (target, type, source) moves one row per task
    once = slim.groupBy("f1", "f2").agg(*[F.first(c).alias(c) for c in ("target", "type", "s1", "s2", "w")])
    per_source = once.groupBy("target", "type", "s1", "s2").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("w"), F.lit(0)).alias("w"))
    return tree_aggregate(
        per_source,
        ["target", "type"],
        ["s1", "s2"],
        {"edges": F.sum("n"), "weight": F.sum("w"), "sources": F.count("s1")},
        {"edges": F.sum("edges"), "weight": F.sum("weight"), "sources": F.sum("sources")},
        rows=rows,
        chunk_rows=chunk_rows,
        fan_in=fan_in,
    )


def heavy_keys(totals: DataFrame, share: float) -> DataFrame:
    """Keys with a non-null target holding at least ``share`` of all edges, those without a target included in "all".

    The totals are written once, and their sum is observed while they are, so nothing is joined or computed again.
    """
    kept, seen, _ = Scratch(totals.sparkSession, "totals").cut(totals, all_edges=F.sum("edges"))
    return kept.where(F.col("target").isNotNull() & (F.col("edges") >= seen["all_edges"] * share))
