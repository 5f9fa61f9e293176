"""Free SQL over the graph: the views ``nodes`` and ``edges``, scoped to a workspace, with bound parameters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from graphloom.graph import CodeGraph


def sql_query(g: CodeGraph, sql: str, args: dict | None = None, workspace: str | None = None) -> DataFrame:
    """``sql`` may use the relations {nodes} and {edges} and the markers :name of ``args``.

    The views carry names of their own, so that two queries of one session don't meet.
    """
    spark = g.nodes.sparkSession
    scoped = g.workspace(workspace)
    tag = uuid.uuid4().hex
    scoped.nodes.createOrReplaceTempView(f"nodes_{tag}")
    scoped.edges.createOrReplaceTempView(f"edges_{tag}")
    try:
        return spark.sql(sql.replace("{nodes}", f"nodes_{tag}").replace("{edges}", f"edges_{tag}"), args={"workspace": workspace} | (args or {}))
    finally:
        spark.catalog.dropTempView(f"nodes_{tag}")
        spark.catalog.dropTempView(f"edges_{tag}")


def explained(df: DataFrame, mode: str = "formatted") -> str:
    jvm = df.sparkSession.sparkContext._jvm
    return df._jdf.queryExecution().explainString(jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))
