"""The property graph as two DataFrames, scoped by workspace, and the pattern joins all queries are made of.

Nodes are a set keyed by id, edges a bag: parallel edges are meant, and only a row equal to another in every column is
a repeated delivery. Pattern joins drop edges without both ends, as a store that matches its end points does.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.canonical import canonical_type, present, stripped
from graphloom.operators.skew import row_fingerprint
from graphloom.shared import Scratch, modified

NODE_COLUMNS = ["id", "workspace", "label", "type", "package", "full_name", "size", "level", "position", "signature", "visibility", "documentation", "complexity", "metadata", "embedding_model", "semantic_summary", "created_at"]
EDGE_COLUMNS = ["source", "target", "type", "weight", "workspace"]


def with_missing(df: DataFrame, columns: Iterable[str], types: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(types.get(c, "string")).alias(c) for c in columns])


@dataclass(frozen=True)
class CodeGraph:
    """``nodes`` (NODE_COLUMNS) and ``edges`` (EDGE_COLUMNS) in canonical form."""

    nodes: DataFrame
    edges: DataFrame

    @classmethod
    def from_tables(cls, nodes: DataFrame, edges: DataFrame, builtins: DataFrame | None = None) -> CodeGraph:
        """From raw tables: types in their usual form, of repeated nodes the earliest, repeated edge deliveries once,
        edges without a non-blank source and target left out."""
        types = {"size": "int", "level": "int", "complexity": "int", "created_at": "timestamp", "metadata": "map<string,string>", "position": "struct<filename:string,line:int,column:int,offset:int>"}
        rows = with_missing(nodes, NODE_COLUMNS, types).where(present(F.col("id"))).withColumn("type", canonical_type(F.col("type")))
        rest = [c for c in NODE_COLUMNS if c != "id"]
        # one struct keeps the row whole; of rows equally early the least holds (a map can't be compared and comes last)
        order = F.struct(F.coalesce(F.col("created_at"), F.lit("9999-01-01").cast("timestamp")), *[F.col(c) for c in rest if c != "metadata"], F.to_json("metadata"))
        once = rows.groupBy("id").agg(F.min_by(F.struct(*rest), order).alias("row")).select("id", "row.*")
        once = once.select(*NODE_COLUMNS)
        if builtins is not None:
            b = builtins.select("id", "label", canonical_type(F.col("type")).alias("type"), "package")
            b = b.withColumns({"full_name": F.concat_ws(".", "package", "label"), "visibility": F.lit("public"), "complexity": F.lit(0), "size": F.lit(1), "level": F.lit(1)})
            once = once.unionByName(with_missing(b, NODE_COLUMNS, types))
        f1, f2 = row_fingerprint(edges)
        slim = edges.select(stripped(F.col("source")).alias("source"), stripped(F.col("target")).alias("target"), canonical_type(F.col("type")).alias("type"), "weight", "workspace", f1.alias("f1"), f2.alias("f2"))
        slim = slim.where(present(F.col("source")) & present(F.col("target")))
        distinct = slim.groupBy("type", "source", "target", "f1", "f2").agg(F.first("weight").alias("weight"), F.first("workspace").alias("workspace"))
        return cls(once, distinct.select(*EDGE_COLUMNS))

    @classmethod
    def load(cls, spark: SparkSession, sf_dir: str) -> CodeGraph:
        read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
        return cls.from_tables(read("nodes"), read("edges"), read("builtin_nodes"))

    @classmethod
    def cleaned(cls, spark: SparkSession, sf_dir: str) -> CodeGraph:
        """``load``, cleaned once a session and table version: the canonical tables are written to the shared folder, in
        ranges of (type, id) and (type, source, target), so that a type filter prunes files and row groups, a source or
        target of many edges is split, and queries start from a scan instead of a fingerprint and a shuffle of all rows."""
        state = tuple(modified(spark, f"{sf_dir}/{t}.parquet") for t in ("nodes", "edges", "builtin_nodes"))
        key = (spark.sparkContext.applicationId, sf_dir)
        held = _cleaned.get(key)
        if held is None or held[0] != state or not held[2].exists():
            raw, scratch = cls.load(spark, sf_dir), Scratch(spark, "graph", lasting=True)
            nodes, _, _ = scratch.cut(raw.nodes.repartitionByRange("type", "id").sortWithinPartitions("type", "id"))
            edges, _, _ = scratch.cut(raw.edges.repartitionByRange("type", "source", "target").sortWithinPartitions("type", "source", "target"))
            held = _cleaned[key] = (state, cls(nodes, edges), scratch)
        return held[1]

    def workspace(self, name: str | None) -> CodeGraph:
        """The graph of one workspace; built-in nodes, which have none, belong to all. None keeps everything."""
        if name is None:
            return self
        mine = F.col("workspace").isNull() | (F.col("workspace") == name)
        return CodeGraph(self.nodes.where(mine), self.edges.where(F.col("workspace") == name))

    def of(self, *types: str) -> DataFrame:
        """Nodes of the given types (all without any)."""
        return self.nodes.where(F.col("type").isin(*types)) if types else self.nodes

    def rel(self, *types: str) -> DataFrame:
        return self.edges.where(F.col("type").isin(*types)) if types else self.edges

    def _end(self, prefix: str, types: tuple[str, ...], where: Column | None) -> DataFrame:
        df = self.of(*types)
        if where is not None:
            df = df.where(where)
        return df.select(*[F.col(c).alias(f"{prefix}_{c}") for c in NODE_COLUMNS])

    def hop(self, *types: str, source: tuple[str, ...] = (), target: tuple[str, ...] = (), source_where: Column | None = None, target_where: Column | None = None) -> DataFrame:
        """(s)-[type]->(t): one row per edge with the columns s_*, t_*, type and weight."""
        e = self.rel(*types).select("source", "target", "type", "weight")
        left = e.join(self._end("s", source, source_where), F.col("source") == F.col("s_id"))
        return left.join(self._end("t", target, target_where), F.col("target") == F.col("t_id")).drop("source", "target")

    def undirected(self, *types: str) -> DataFrame:
        """(a)-[type]-(b): source, target, type of every edge in both directions; a self-loop appears once."""
        e = self.rel(*types).select("source", "target", "type")
        back = e.where(F.col("source") != F.col("target")).select(F.col("target").alias("source"), F.col("source").alias("target"), "type")
        return e.unionAll(back)

    def around(self, *types: str, source_where: Column | None = None) -> DataFrame:
        """(s)-[type]-(t) with the columns s_*, t_* and type."""
        e = self.undirected(*types)
        left = e.join(self._end("s", (), source_where), F.col("source") == F.col("s_id"))
        return left.join(self._end("t", (), None), F.col("target") == F.col("t_id")).drop("source", "target")


_cleaned: dict[tuple[str, str], tuple[tuple, CodeGraph, Scratch]] = {}


def named(name: str, prefix: str = "") -> Column:
    """id, full_name or label equals ``name``."""
    return (F.col(f"{prefix}id") == name) | (F.col(f"{prefix}full_name") == name) | (F.col(f"{prefix}label") == name)
