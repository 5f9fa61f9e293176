"""Keeping a stored graph current: old snapshot x new snapshot to what is created, updated, removed and kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.summaries import needs_embedding

KEPT_FROM_OLD = ("embedding", "embedding_model")


def merge_nodes(old: DataFrame, new: DataFrame, now: Column, key: str = "id") -> DataFrame:
    """Upsert of ``new`` into ``old`` by key: every row of the new snapshot with created_at, updated_at, last_seen, stale
    and status (``created`` or ``updated``), and the rows only the old one has with stale true and status ``stale``.

    Columns of ``new`` win; those only the old has are carried over. created_at of a known node stays; an unknown one
    gets ``now``. Keys must be unique on both sides.
    """
    o = old.select(*[F.col(f"`{c}`").alias(f"o_{c}") for c in old.columns])
    j = new.join(o, F.col(key) == F.col(f"o_{key}"), "full_outer")
    known, here = F.col(f"o_{key}").isNotNull(), F.col(key).isNotNull()
    stored = lambda c, kind: F.col(f"o_{c}") if c in old.columns else F.lit(None).cast(kind)
    managed = ("created_at", "updated_at", "last_seen", "stale", "status")
    cols = []
    for c in dict.fromkeys([*new.columns, *old.columns]):
        if c in managed:
            continue
        if c in new.columns:
            cols.append(F.when(here, F.col(f"`{c}`")).otherwise(stored(c, new.schema[c].dataType)).alias(c))
        else:
            cols.append(F.col(f"o_{c}").alias(c))
    return j.select(
        *cols,
        F.when(known, F.coalesce(stored("created_at", "timestamp"), now)).otherwise(now).alias("created_at"),
        F.when(known & here, now).otherwise(stored("updated_at", "timestamp")).alias("updated_at"),
        F.when(here, now).otherwise(stored("last_seen", "timestamp")).alias("last_seen"),
        (~here).alias("stale"),
        F.when(known & here, "updated").when(here, "created").otherwise("stale").alias("status"),
    )


def swept(merged: DataFrame) -> DataFrame:
    return merged.where(~F.col("stale"))


def stale_preview(merged: DataFrame) -> DataFrame:
    return merged.where(F.col("stale")).groupBy("type").agg(F.count(F.lit(1)).alias("count"))


def existing_info(nodes: DataFrame) -> DataFrame:
    """id, semantic_hash, embedding, embedding_model of stored nodes that have a hash."""
    return nodes.where(F.col("semantic_hash").isNotNull()).select("id", "semantic_hash", "embedding", "embedding_model")


def delta_embeddings(new: DataFrame, stored: DataFrame) -> DataFrame:
    """``new`` (with id and semantic_hash) with the stored vector where the hash is unchanged, and ``regenerate``."""
    s = stored.select(F.col("id").alias("s_id"), F.col("semantic_hash").alias("s_hash"), F.col("embedding").alias("s_vec"), F.col("embedding_model").alias("s_model"))
    j = new.join(s, F.col("id") == F.col("s_id"), "left")
    again = needs_embedding(F.col("semantic_hash"), F.col("s_hash"), F.col("s_vec"))
    return j.select(*[F.col(f"`{c}`") for c in new.columns if c not in KEPT_FROM_OLD], F.when(~again, F.col("s_vec")).alias("embedding"), F.when(~again, F.col("s_model")).alias("embedding_model"), again.alias("regenerate"))


def replace_workspace(stored: DataFrame, fresh: DataFrame, workspace: str) -> DataFrame:
    """All rows of other workspaces and the fresh rows of this one; used for edges, which have no key to merge by."""
    return stored.where(F.coalesce(F.col("workspace") != workspace, F.lit(True))).unionByName(fresh, allowMissingColumns=True)


def upsert_workspaces(stored: DataFrame, changed: DataFrame) -> DataFrame:
    """Workspace records by name: changed columns win, others of a known record stay."""
    s = stored.select(*[F.col(c).alias(f"o_{c}") for c in stored.columns])
    j = changed.join(s, F.col("name") == F.col("o_name"), "full_outer")
    cols = dict.fromkeys([*stored.columns, *changed.columns])
    both = lambda c: F.coalesce(*[x for x in (F.col(c) if c in changed.columns else None, F.col(f"o_{c}") if c in stored.columns else None) if x is not None])
    return j.select(*[both(c).alias(c) for c in cols])
