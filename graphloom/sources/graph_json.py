"""Graph documents in JSON, and the package summary beside them."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.graph import CodeGraph
from graphloom.operators.patterns import package_summary

VERSION = "2.0.0"
POSITION = "struct<filename:string,line:int,column:int,offset:int>"
TYPE_INFO = (
    "struct<kind:string,is_pointer:boolean,is_slice:boolean,is_array:boolean,is_channel:boolean,channel_dir:string,is_generic:boolean,type_params:array<struct<name:string,constraint:string>>,constraints:array<string>,"
    "underlying_type:string,method_set:array<struct<name:string,params:array<string>,returns:array<string>,is_exported:boolean>>,field_count:int,is_exported:boolean,is_alias:boolean,embedded_types:array<string>>"
)
NODE = (
    f"struct<id:string,label:string,type:string,package:string,full_name:string,size:int,level:int,position:{POSITION},signature:string,type_info:{TYPE_INFO},visibility:string,documentation:string,complexity:int,"
    "metadata:map<string,string>,tags:array<string>,embedding:array<float>,embedding_model:string,semantic_summary:string,created_at:timestamp>"
)
EDGE = f"struct<id:string,source:string,target:string,type:string,weight:int,position:{POSITION},context:string,conditional:boolean,loop_depth:int,metadata:map<string,string>,created_at:timestamp>"
DOCUMENT = f"graph struct<nodes:array<{NODE}>,edges:array<{EDGE}>,stats:map<string,string>,created_at:string,version:string>"
#: fixed values of the viewer's configuration
NODE_COLORS = {"package": "#4CAF50", "struct": "#2196F3", "interface": "#FF9800", "function": "#9C27B0", "method": "#E91E63", "field": "#607D8B", "constant": "#795548", "variable": "#009688"}
EDGE_COLORS = {"calls": "#666666", "implements": "#4CAF50", "imports": "#2196F3", "embeds": "#FF5722", "has_method": "#9C27B0", "has_field": "#607D8B", "uses": "#795548", "returns": "#009688", "has_parameter": "#FFC107"}
LAYOUT = {"name": "cose", "node_repulsion": 8000, "edge_length": 100, "gravity": 0.1, "num_iter": 1000, "initial_temp": 200, "cooling_factor": 0.95, "min_temp": 1.0}


def read_graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of graph documents, as they stand there. Missing fields are null; a document without a graph
    gives no rows."""
    doc = spark.read.schema(DOCUMENT).option("multiLine", True).json(path)
    return doc.selectExpr("inline(graph.nodes)"), doc.selectExpr("inline(graph.edges)")


def write_graph_json(g: CodeGraph | None, path: str) -> None:
    """One indented JSON file with the graph and the viewer's configuration, readable by its owner only.

    Rows are streamed through the driver a partition at a time, as a single file wants it; for graphs beyond a viewer
    use the Parquet store.
    """
    if g is None:
        raise ValueError("no graph to write")
    nodes = g.nodes.orderBy("id")
    edges = g.edges.withColumn("id", F.concat("source", F.lit("->"), "target", F.lit(":"), "type")).orderBy("id")
    by_type = lambda df: {r["type"]: r["count"] for r in df.groupBy("type").count().collect()}  # noqa: E731 - a few types
    n, e = by_type(g.nodes), by_type(g.edges)
    stats = {"total_nodes": sum(n.values()), "total_edges": sum(e.values()), "nodes_by_type": n, "edges_by_type": e, "package_count": n.get("package", 0), "max_depth": 3}
    with os.fdopen(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "w", encoding="utf-8") as out:
        out.write('{\n  "graph": {\n')
        for name, df in (("nodes", nodes), ("edges", edges)):
            out.write(f'    "{name}": [')
            for i, row in enumerate(df.toJSON().toLocalIterator()):
                out.write(("," if i else "") + "\n      " + row)
            out.write("\n    ],\n")
        out.write(f'    "stats": {json.dumps(stats)},\n    "version": "{VERSION}"\n  }},\n')
        out.write(f'  "config": {json.dumps({"node_colors": NODE_COLORS, "edge_colors": EDGE_COLORS, "layout": LAYOUT})}\n}}\n')


def write_summary(g: CodeGraph | None, path: str) -> None:
    """``<path>.summary``: totals and one record a package."""
    if g is None:
        raise ValueError("no graph to summarise")
    packages = [json.loads(r) for r in package_summary(g, with_files=True).orderBy("path").toJSON().toLocalIterator()]
    totals = {"total_nodes": g.nodes.count(), "total_edges": g.edges.count(), "packages": packages}
    with open(path + ".summary", "w", encoding="utf-8") as out:
        json.dump(totals, out, indent=2)
