"""The nine tools, as one dispatcher: names and arguments in, a text result with rows out."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from graphloom.functions.mock_embedding import Provider, mock_provider
from graphloom.operators import impact, patterns, paths, search
from graphloom.plans.cypher import CypherError, run_cypher
from graphloom.plans.router import detect_architecture, find_patterns, route
from graphloom.plans.sql_query import explained
from graphloom.shared import scratch_scope
from graphloom.sources.go_extract import analyze_codebase, module_path
from graphloom.sources.store import GraphStore

REQUIRED = {
    "cypher_query": ("query", "workspace"), "natural_query": ("question", "workspace"), "analyze_impact": ("nodeId", "workspace"), "find_patterns": ("patternType", "workspace"), "find_implementers": ("interfaceName", "workspace"),
    "trace_call_path": ("from", "to", "workspace"), "detect_architecture": ("analysisType", "workspace"), "analyze_workspace": ("workspacePath",), "list_workspaces": (),
}


@dataclass
class Result:
    text: str
    rows: list[dict] = field(default_factory=list)
    error: bool = False

    def json(self) -> str:
        """Indented rows; none is an empty list."""
        return json.dumps(self.rows, indent=2, default=str)


class Tools:
    """Tools over a graph store. ``provider`` embeds questions; without one, questions go to the router.

    Results are what a client shows: all rows of a query come, partition by partition; only its own limit cuts them.
    """

    def __init__(self, spark: SparkSession, store: GraphStore, provider: Provider | None = None, model: str = "provider"):
        self.spark, self.store, self.provider, self.model = spark, store, provider, model

    def run(self, name: str, **args) -> Result:
        if name not in REQUIRED:
            return Result(f"unknown tool {name}", error=True)
        missing = [a for a in REQUIRED[name] if not args.get(a)]
        if missing:
            return Result(f"{name} needs {', '.join(missing)}", error=True)
        try:
            with scratch_scope():  # results are read out before it ends
                return getattr(self, f"_{name}")(**{k if k not in ("from",) else "start": v for k, v in args.items()})
        except (ValueError, OSError) as e:
            return Result(str(e), error=True)

    def _graph(self, workspace: str):
        return self.store.graph(workspace).workspace(workspace)

    def _rows(self, df: DataFrame, note: str) -> Result:
        rows = [json.loads(r) for r in df.toJSON().toLocalIterator()]
        return Result(f"{note}\nFound {len(rows)} records", rows)

    def _cypher_query(self, query: str, workspace: str, parameters: dict | None = None, explain: bool = False) -> Result:
        try:
            df = run_cypher(self.store.graph(workspace), query, parameters, workspace, self.store.embeddings(workspace))
        except CypherError as e:
            return Result(f"query failed: {e}", error=True)
        if explain:
            return Result(explained(df))
        return self._rows(df, "Query results")

    def _natural_query(self, question: str, workspace: str, context: str | None = None) -> Result:
        g = self._graph(workspace)
        if self.provider is not None:
            try:
                vector = self.provider([question])[0]
            except Exception:
                vector = None
            if vector:
                found = self._rows(search.hybrid_search(g, self.store.embeddings(workspace), vector), "Hybrid search results")
                if found.rows:  # nothing stored to compare with: the question goes to the router
                    return found
        plan = route(question)
        return self._rows(plan.run(g), f"Pattern-based query: {plan.rule}")

    def _analyze_impact(self, nodeId: str, workspace: str, changeType: str = "modify", maxDepth: int = 5) -> Result:  # noqa: N803
        """Direct impact; with a maxDepth above 1, transitive dependents and their distance beside it."""
        g = self._graph(workspace)
        direct = self._rows(impact.analyze_impact(g, nodeId, changeType), f"Impact of {changeType} on {nodeId}, depth {maxDepth}")
        if maxDepth and maxDepth > 1:
            far = paths.impact_transitive(g, nodeId, maxDepth).count()
            direct.text += f"; {far} nodes depend on it within {maxDepth} steps"
        return direct

    def _find_patterns(self, patternType: str, workspace: str, filter: str | None = None) -> Result:  # noqa: A002, N803
        return self._rows(find_patterns(self._graph(workspace), patternType), f"Pattern {patternType}")

    def _find_implementers(self, interfaceName: str, workspace: str) -> Result:  # noqa: N803
        return self._rows(impact.find_implementers(self._graph(workspace), interfaceName), f"Implementers of {interfaceName}")

    def _trace_call_path(self, start: str, to: str, workspace: str) -> Result:
        found = paths.trace_call_path(self._graph(workspace), start, to).withColumnsRenamed({"path": "callPath", "labels": "callNames", "length": "pathLength"})
        ends = found.selectExpr("callPath[0] AS fromFunction", "element_at(callPath, -1) AS toFunction", "callPath", "callNames", "pathLength").distinct()
        return self._rows(ends.orderBy("pathLength", "callPath"), f"Call paths from {start} to {to}")

    def _detect_architecture(self, analysisType: str, workspace: str) -> Result:  # noqa: N803
        return self._rows(detect_architecture(self._graph(workspace), analysisType), f"Architecture: {analysisType}")

    def _analyze_workspace(self, workspacePath: str, workspaceName: str | None = None, incremental: bool = False, allowedPackages: list[str] | None = None) -> Result:  # noqa: N803
        begun = time.time()
        name = workspaceName or workspace_label(workspacePath)
        g = analyze_codebase(self.spark, workspacePath, allowedPackages)
        counts = self.store.save(g, name, incremental=incremental, path=workspacePath, provider=self.provider, model=self.model)
        kinds = {r["nodeType"]: r["count"] for r in patterns.type_distribution(self._graph(name)).collect()}
        return Result(f"Workspace {name}: {counts['nodes']} nodes, {counts['edges']} edges in {time.time() - begun:.1f} s", [counts | kinds])

    def _list_workspaces(self) -> Result:
        return self._rows(patterns.list_workspaces(self.store.graph()), "Workspaces")


def workspace_label(path: str) -> str:
    """The name of a workspace folder: the last part of its module path, else of the folder, as an identifier."""
    import os
    import re

    base = module_path(path).rstrip("/").rsplit("/", 1)[-1] or os.path.basename(os.path.abspath(path))
    clean = re.sub(r"[^A-Za-z0-9_-]", "_", base)
    return "workspace" if not clean else f"ws_{clean}" if clean[0].isdigit() else clean


__all__ = ["Result", "Tools", "mock_provider", "workspace_label"]
