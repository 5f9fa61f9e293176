"""The graph store: Parquet tables in folders by workspace, with vectors in a table of their own.

    <path>/<table>/v=<version>/workspace=<name>/...     what one save wrote
    <path>/<table>/_current/workspace=<name>            which version holds for the workspace, and the one before

A save writes and points to its own workspaces only. A pointer is written beside and renamed over the old one, so a
reader sees the old state or the new one; the version before stays until the next save, for readers that still use it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.mock_embedding import Provider, embed
from graphloom.graph import EDGE_COLUMNS, NODE_COLUMNS, CodeGraph, with_missing
from graphloom.operators import merge
from graphloom.operators.summaries import hash_metadata, prefixed, semantic_summaries
from graphloom.shared import Scratch

EMBEDDINGS = "id string, workspace string, semantic_hash string, embedding array<float>, embedding_model string"
WORKSPACES = "name string, path string, nodes long, edges long, incremental boolean, analyzed_at timestamp"
EDGES = "source string, target string, type string, weight int, workspace string"
#: stored beside NODE_COLUMNS
STORED = {"updated_at": "timestamp", "last_seen": "timestamp", "content_hash": "string", "semantic_hash": "string", "type_info": "struct<kind:string,is_pointer:boolean,is_exported:boolean,field_count:int>", "tags": "array<string>"}
TYPES = {"size": "int", "level": "int", "complexity": "int", "created_at": "timestamp", "metadata": "map<string,string>", "position": "struct<filename:string,line:int,column:int,offset:int>"} | STORED
ALL = "_all"


class GraphStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # ---- pointers

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _pointers(self, table: str) -> dict[str, list[str]]:
        """Part to its versions, the current one first."""
        fs, p = self._fs(f"{self.path}/{table}/_current")
        if not fs.exists(p):
            return {}
        out = {}
        for status in fs.listStatus(p):
            name = status.getPath().getName()
            if not name.startswith("."):
                stream = fs.open(status.getPath())
                try:
                    out[name] = bytes(bytearray(stream.readAllBytes())).decode().split()
                finally:
                    stream.close()
        return out

    def _point(self, table: str, part: str, versions: list[str]) -> None:
        folder = f"{self.path}/{table}/_current"
        fs, beside = self._fs(f"{folder}/.{uuid.uuid4().hex}")
        stream = fs.create(beside, True)
        try:
            stream.write(bytearray("\n".join(versions).encode()))
        finally:
            stream.close()
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        how = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        how[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(context.makeQualified(beside), context.makeQualified(self._fs(f"{folder}/{part}")[1]), how)

    def _unpoint(self, table: str, part: str) -> None:
        fs, p = self._fs(f"{self.path}/{table}/_current/{part}")
        fs.delete(p, False)

    # ---- tables

    def write(self, table: str, df: DataFrame, by: tuple[str, ...] = (), *, only: str | None = None) -> None:
        """Replace a table, or with ``only`` the folder of one workspace, which all rows must then belong to.

        ``by`` are the folder columns, the first of them ``workspace``; without any the table is one part.
        """
        version = uuid.uuid4().hex
        writer = df.write.partitionBy(*by) if by else df.write
        writer.parquet(f"{self.path}/{table}/v={version}")
        fs, p = self._fs(f"{self.path}/{table}/v={version}")
        parts = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()] if by else [ALL]
        old = self._pointers(table)
        for part in parts:
            self._point(table, part, [version, *old.get(part, [])[:1]])
            for gone in old.get(part, [])[1:]:
                at = f"{self.path}/{table}/v={gone}" + (f"/{part}" if part != ALL else "")
                fs.delete(self._fs(at)[1], True)
        for part in old:
            if part not in parts and (only is None or part == self._part(only)):
                self._unpoint(table, part)

    def _part(self, workspace: str) -> str:
        escape = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        return f"workspace={escape(workspace)}"

    def read(self, table: str, schema: str | None = None, workspace: str | None = None) -> DataFrame:
        """A table, or the rows of one workspace, whose folder alone is then read."""
        found = self._pointers(table)
        if workspace is not None:
            found = {k: v for k, v in found.items() if k in (self._part(workspace), ALL)}
        paths = [f"{self.path}/{table}/v={v[0]}" + (f"/{part}" if part != ALL else "") for part, v in found.items()]
        if not paths:
            return self.spark.createDataFrame([], schema or "id string")
        reader = self.spark.read.option("basePath", f"{self.path}/{table}")
        if schema:
            reader = reader.schema(schema)
        df = reader.parquet(*paths).drop("v")
        return df if workspace is None or "workspace" not in df.columns else df.where(F.col("workspace") == workspace)

    # ---- graph

    def _nodes_schema(self) -> str:
        return ", ".join(f"{c} {TYPES.get(c, 'string')}" for c in [*NODE_COLUMNS, *STORED])

    def graph(self, workspace: str | None = None) -> CodeGraph:
        nodes, edges = self.read("nodes", self._nodes_schema(), workspace), self.read("edges", EDGES, workspace)
        return CodeGraph(nodes.select(*NODE_COLUMNS), edges.select(*EDGE_COLUMNS))

    def embeddings(self, workspace: str | None = None) -> DataFrame:
        return self.read("embeddings", EMBEDDINGS, workspace)

    def save(self, g: CodeGraph, workspace: str, *, now: Column | None = None, incremental: bool = False, path: str | None = None, provider: Provider | None = None, model: str = "provider") -> dict[str, int]:
        """Store the graph of one workspace: ids and edge ends get the workspace as prefix, nodes their summary and hashes.

        A full save replaces the workspace. An incremental one merges nodes by id (created_at stays, updated_at and
        last_seen are set) and sweeps what is gone. Edges are replaced either way: they have no key to merge by. With a
        ``provider``, nodes whose summary's hash changed get a new vector; the others keep the stored one.
        """
        now = F.current_timestamp() if now is None else now
        told = semantic_summaries(g).select(F.col("id").alias("s_id"), "summary", F.col("semantic_hash").alias("s_hash"), F.col("content_hash").alias("c_hash"))
        nodes = with_missing(g.nodes, [*NODE_COLUMNS, *STORED], TYPES).join(told, F.col("id") == F.col("s_id"), "left")
        has = F.lit(provider is not None) & F.col("s_id").isNotNull()
        known = F.col("s_id").isNotNull()
        fresh = nodes.withColumns(
            {
                "id": prefixed(workspace, F.col("id")),
                "workspace": F.lit(workspace),
                "semantic_summary": F.coalesce("summary", "semantic_summary"),
                "semantic_hash": F.col("s_hash"),
                "content_hash": F.col("c_hash"),
                "metadata": F.when(known, hash_metadata(F.col("metadata"), F.col("c_hash"), F.col("s_hash"), has, now)).otherwise(F.col("metadata")),
                "embedding_model": F.when(has, F.lit(model)).otherwise(F.col("embedding_model")),
            }
        ).select(*NODE_COLUMNS, *STORED)
        edges = g.edges.withColumns({"source": prefixed(workspace, F.col("source")), "target": prefixed(workspace, F.col("target")), "workspace": F.lit(workspace)})
        stored = self.read("nodes", self._nodes_schema(), workspace)
        counts = {"created": 0, "updated": 0, "stale": 0}
        if incremental:
            merged, _, _ = Scratch(self.spark, "merge").cut(merge.merge_nodes(stored, fresh.drop("created_at", "updated_at", "last_seen"), now))
            counts |= {r["status"]: r["count"] for r in merged.groupBy("status").count().collect()}
            mine = merge.swept(merged).drop("stale", "status")
        else:
            mine = fresh.withColumns({"created_at": now, "updated_at": F.lit(None).cast("timestamp"), "last_seen": now})
        self.write("nodes", mine.select(*NODE_COLUMNS, *STORED), ("workspace", "type"), only=workspace)
        self.write("edges", edges.select(*EDGE_COLUMNS), ("workspace", "type"), only=workspace)
        if provider is not None:
            counts |= self._embed(workspace, provider, model)
        saved = self.graph(workspace)
        n, e = saved.nodes.count(), saved.edges.count()
        record = self.spark.range(1).select(
            F.lit(workspace).alias("name"), F.lit(path).cast("string").alias("path"), F.lit(n).cast("long").alias("nodes"), F.lit(e).cast("long").alias("edges"), F.lit(incremental).alias("incremental"), now.alias("analyzed_at")
        )
        self.write("workspaces", merge.upsert_workspaces(self.read("workspaces", WORKSPACES), record))
        return counts | {"nodes": n, "edges": e}

    def _embed(self, workspace: str, provider: Provider, model: str) -> dict[str, int]:
        """Vectors of the workspace's nodes: kept where the hash is unchanged, made where it is not."""
        nodes = self.read("nodes", self._nodes_schema(), workspace).where("semantic_hash IS NOT NULL").select("id", "workspace", "semantic_hash", "semantic_summary")
        plan, seen, _ = Scratch(self.spark, "vectors").cut(merge.delta_embeddings(nodes, merge.existing_info(self.embeddings(workspace))), again=F.sum(F.col("regenerate").cast("int")), all=F.count(F.lit(1)))
        columns = ["id", "workspace", "semantic_hash", "embedding", "embedding_model"]
        made = embed(plan.where("regenerate").drop("embedding", "embedding_model"), "semantic_summary", provider).withColumn("embedding_model", F.when(F.col("embedding").isNotNull(), F.lit(model)))
        self.write("embeddings", plan.where("NOT regenerate").select(*columns).unionByName(made.select(*columns)), ("workspace",), only=workspace)
        return {"embedded": seen["again"], "reused": seen["all"] - seen["again"]}

    def apply(self, text: str, workspace: str, parameters: dict | None = None) -> dict[str, int]:
        """A writing Cypher query on one workspace, whose folders are then replaced; vectors and hashes stay as they are."""
        from graphloom.plans.cypher_write import apply_cypher

        after, counts = apply_cypher(self.graph(workspace), text, parameters, workspace)
        extra = self.read("nodes", self._nodes_schema(), workspace).select(F.col("id").alias("k"), *STORED)
        kept = after.nodes.join(extra, F.col("id") == F.col("k"), "left").drop("k")
        self.write("nodes", kept.select(*NODE_COLUMNS, *STORED), ("workspace", "type"), only=workspace)
        self.write("edges", after.edges.select(*EDGE_COLUMNS), ("workspace", "type"), only=workspace)
        return counts

    def workspaces(self) -> DataFrame:
        return self.read("workspaces", WORKSPACES)

    def clear_workspace(self, workspace: str) -> None:
        """Every record of the workspace goes, its own record too; no other workspace's folder is touched."""
        part = self._part(workspace)
        for table in ("nodes", "edges", "embeddings"):
            for version in self._pointers(table).get(part, []):
                self._unpoint(table, part)
                fs, p = self._fs(f"{self.path}/{table}/v={version}/{part}")
                fs.delete(p, True)
        if self._pointers("workspaces"):
            self.write("workspaces", self.workspaces().where(F.col("name") != workspace))

    def clear(self) -> None:
        fs, p = self._fs(self.path)
        fs.delete(p, True)
