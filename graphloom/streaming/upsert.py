"""Keeping tables current from streams: edges and snapshots that arrive in files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from graphloom.functions.canonical import canonical_type, present
from graphloom.graph import with_missing
from graphloom.shared import Scratch
from graphloom.sources.store import TYPES, GraphStore


def stream_table(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A folder of Parquet files as a stream of its rows, with the schema of what is there."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def edge_counts(edges: DataFrame, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """Edges by type and window of created_at; rows later than ``late`` behind the newest are not counted."""
    typed = edges.where(present(F.col("target"))).select(F.col("created_at").cast("timestamp").alias("created_at"), canonical_type(F.col("type")).alias("type"))
    return typed.withWatermark("created_at", late).groupBy(F.window("created_at", window), "type").agg(F.count(F.lit(1)).alias("edges"))


def first_deliveries(edges: DataFrame, late: str = "7 days") -> DataFrame:
    """Rows without repeated deliveries within the watermark; state older than it is dropped."""
    return edges.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", late).dropDuplicatesWithinWatermark([c for c in edges.columns if c != "metadata"])


def upsert_nodes(store: GraphStore, workspace_of: str = "workspace") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: nodes of each batch are merged into the store by workspace and id, the latest created_at
    winning. Only the folders of workspaces that the batch names are read and written."""
    from graphloom.operators import merge

    def apply(batch: DataFrame, _: int) -> None:
        kept = [c for c in batch.columns if c not in ("id", workspace_of)]
        batch = batch.where(F.col("id").isNotNull() & F.col(workspace_of).isNotNull())
        latest, _, _ = Scratch(store.spark, "batch").cut(batch.groupBy(workspace_of, "id").agg(F.max_by(F.struct(*kept), "created_at").alias("s")).select("id", F.col(workspace_of).alias("workspace"), "s.*"))
        for row in latest.select("workspace").distinct().toLocalIterator():
            name = row["workspace"]
            stored = store.read("nodes", store._nodes_schema(), name)
            mine = with_missing(latest.where(F.col("workspace") == name), stored.columns, TYPES)
            merged = merge.merge_nodes(stored, mine.drop("created_at", "updated_at", "last_seen"), F.current_timestamp())
            # a batch is no full snapshot: what it lacks stays
            store.write("nodes", merged.select(*stored.columns), ("workspace", "type"), only=name)

    return apply


def start_upserts(stream: DataFrame, store: GraphStore, checkpoint: str) -> DataStreamWriter:
    return stream.writeStream.foreachBatch(upsert_nodes(store)).option("checkpointLocation", checkpoint).trigger(availableNow=True)
