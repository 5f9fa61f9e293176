"""Write clauses of Cypher: a graph and a text to the graph as it is afterwards.

Reading clauses (MATCH, OPTIONAL MATCH, WHERE, UNWIND, WITH) give rows of bindings; each write clause turns them into new
node and edge tables, by one join. Nothing is changed in place: a store saves the result of one workspace as a whole.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import EDGE_COLUMNS, NODE_COLUMNS, CodeGraph
from graphloom.plans.cypher import CypherError, Engine, Node, Parser

WRITES = ("create", "merge", "set", "delete", "detach")
EDGE_TYPES = {"source": "string", "target": "string", "type": "string", "weight": "int", "workspace": "string"}


class Writer:
    """Carries a query out. CREATE makes what its patterns name; MERGE of a node makes it where no node has the given
    properties; SET changes single properties or those of a map; DELETE removes nodes and relationships, and of a node
    with relationships only with DETACH."""

    def __init__(self, g: CodeGraph, parameters: dict | None, workspace: str | None):
        self.engine = Engine(g, parameters, workspace)
        self.workspace = workspace
        self.counts = dict.fromkeys(("nodes_created", "relationships_created", "properties_set", "nodes_deleted", "relationships_deleted"), 0)
        self.kinds = {f.name: f.dataType for f in self.engine.nodes.schema["v"].dataType.fields}

    # ---- tables

    def _count(self, what: str, df: DataFrame) -> DataFrame:
        df, seen, _ = self.engine.scratch.cut(df, n=F.count(F.lit(1)))
        self.counts[what] += seen["n"]
        return df

    def _keep(self, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> None:
        if nodes is not None:
            self.engine.nodes = self.engine.scratch.cut(nodes)[0]
        if edges is not None:
            self.engine._edges = self.engine.scratch.cut(edges)[0]

    def _values(self, n: Node, df: DataFrame) -> dict:
        values = {}
        for key, text in n.props:
            if key not in self.kinds:
                raise CypherError(f"nodes have no property {key}")
            values[key] = self.engine._sql(text, df).cast(self.kinds[key])
        for label in n.labels:
            if label != "CodeNode":
                values.setdefault("type", F.lit(label.lower()))
        if self.workspace is not None:
            values.setdefault("workspace", F.lit(self.workspace))
        return values

    def _struct(self, values: dict):
        return F.struct(*[values.get(c, F.lit(None)).cast(self.kinds[c]).alias(c) for c in NODE_COLUMNS])

    # ---- clauses

    def _create_node(self, df: DataFrame, n: Node) -> DataFrame:
        df = self.engine.scratch.cut(df.withColumn(n.var, self._struct(self._values(n, df))))[0]
        made = self._count("nodes_created", df.select(F.col(n.var).alias("v")))
        if not made.where("v.id IS NULL").isEmpty():
            raise CypherError("a created node needs an id")
        self._keep(nodes=self.engine.nodes.unionAll(made))
        return df

    def _create(self, df: DataFrame, ps: Parser) -> DataFrame:
        while True:
            p = ps.path()
            for n in p.nodes:
                if n.var not in df.columns:
                    df = self._create_node(df, n)
            for r, a, b in zip(p.rels, p.nodes, p.nodes[1:], strict=False):
                if r.way == 0 or r.many:
                    raise CypherError("a created relationship has one direction")
                a, b = (a, b) if r.way == 1 else (b, a)
                given = {k: self.engine._sql(v, df) for k, v in r.props}
                if unknown := set(given) - set(EDGE_TYPES):
                    raise CypherError(f"relationships have no property {unknown.pop()}")
                named = [t.lower() for t in r.types if t != "RELATES_TO"]
                values = {"type": F.lit(named[0] if named else None), "weight": F.lit(1), "workspace": F.lit(self.workspace)} | given | {"source": F.col(f"{a.var}.id"), "target": F.col(f"{b.var}.id")}
                rows = df.select(*[values[c].cast(EDGE_TYPES[c]).alias(c) for c in EDGE_COLUMNS])
                old = self.engine.edges
                made = self._count("relationships_created", rows)
                self._keep(edges=old.select(*EDGE_COLUMNS).unionAll(made.select(*EDGE_COLUMNS)).withColumn("eid", F.monotonically_increasing_id()))
            if not ps.accept(","):
                return df

    def _merge(self, df: DataFrame, ps: Parser) -> DataFrame:
        p = ps.path()
        if p.rels:
            # the ends are bound; what is there already stays
            r, a, b = p.rels[0], p.nodes[0].var, p.nodes[1].var
            if len(p.rels) > 1 or a not in df.columns or b not in df.columns:
                raise CypherError("MERGE of a relationship needs both nodes bound")
            a, b = (a, b) if r.way >= 0 else (b, a)
            kinds = [t.lower() for t in r.types if t != "RELATES_TO"]
            kind = F.lit(kinds[0]) if kinds else next((self.engine._sql(v, df) for k, v in r.props if k == "type"), F.lit(None))
            rows = df.select(F.col(f"{a}.id").alias("source"), F.col(f"{b}.id").alias("target"), kind.cast("string").alias("type")).distinct()
            new = rows.join(self.engine.edges.select("source", "target", "type"), ["source", "target", "type"], "left_anti")
            made = self._count("relationships_created", new.select("source", "target", "type", F.lit(1).alias("weight"), F.lit(self.workspace).cast("string").alias("workspace")))
            self._keep(edges=self.engine.edges.select(*EDGE_COLUMNS).unionAll(made.select(*EDGE_COLUMNS)).withColumn("eid", F.monotonically_increasing_id()))
            return df
        n = p.nodes[0]
        if not n.props:
            raise CypherError("MERGE needs properties")
        df = self.engine.scratch.cut(df.withColumn("_new", self._struct(self._values(n, df))))[0]
        same = lambda left, right: [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k, _ in n.props]
        all_ = lambda conditions: reduce(and_, conditions)
        new = df.select(F.col("_new").alias("w")).distinct().join(self.engine.nodes, all_(same("w", "v")), "left_anti")
        made = self._count("nodes_created", new.select(F.col("w").alias("v")))
        self._keep(nodes=self.engine.nodes.unionAll(made))
        df = df.join(self.engine.nodes, all_(same("_new", "v"))).withColumnRenamed("v", n.var).drop("_new")
        fresh = made.select(F.col("v.id").alias("_made"))
        while ps.accept("on"):
            on_create = ps.accept("create")
            if not on_create:
                ps.expect("match")
            ps.expect("set")
            df = self._set(df, ps, only=(fresh, on_create, n.var))
        return df

    def _set(self, df: DataFrame, ps: Parser, only: tuple | None = None) -> DataFrame:
        changes: dict[str, dict] = {}
        while True:
            var = ps.name()
            if var not in df.columns:
                raise CypherError(f"{var} is not bound")
            if ps.accept("."):
                key = ps.name()
                ps.expect("=")
                changes.setdefault(var, {})[key] = self.engine._sql(ps.expression(), df)
            else:
                ps.accept("+")
                ps.expect("=")
                value = ps.expression()
                kind = df.select(self.engine._sql(value, df).alias("x")).schema["x"].dataType
                for f in kind.fields:
                    changes.setdefault(var, {})[f.name] = self.engine._sql(value, df)[f.name]
            if not ps.accept(","):
                break
        for var, values in changes.items():
            node = df.schema[var].dataType.names == NODE_COLUMNS
            known = self.kinds if node else EDGE_TYPES
            if unknown := set(values) - set(known):
                raise CypherError(f"{var} has no property {unknown.pop()}")
            rows = df
            if only is not None:
                fresh, on_create, of = only
                rows = df.join(fresh, F.col(f"{of}.id") == F.col("_made"), "left_semi" if on_create else "left_anti")
            key = f"{var}.id" if node else f"{var}.eid"
            told = rows.groupBy(F.col(key).alias("_key")).agg(*[F.first(v.cast(known[k])).alias(f"_{k}") for k, v in values.items()])
            told, seen, _ = self.engine.scratch.cut(told, n=F.count(F.lit(1)))
            self.counts["properties_set"] += seen["n"] * len(values)
            picked = lambda old, k: F.when(F.col("_key").isNotNull(), F.col(f"_{k}")).otherwise(old)  # noqa: B023, E731
            if node:
                j = self.engine.nodes.join(told, F.col("v.id") == F.col("_key"), "left")
                self._keep(nodes=j.select(F.struct(*[(picked(F.col(f"v.{c}"), c) if c in values else F.col(f"v.{c}")).alias(c) for c in NODE_COLUMNS]).alias("v")))
                df = df.join(self.engine.nodes, F.col(f"{var}.id") == F.col("v.id"), "left").withColumn(var, F.coalesce("v", var)).drop("v") if "id" not in values else df
            else:
                j = self.engine.edges.join(told, F.col("eid") == F.col("_key"), "left")
                self._keep(edges=j.select(*[(picked(F.col(c), c) if c in values else F.col(c)).alias(c) for c in EDGE_COLUMNS], "eid"))
        return df

    def _delete(self, df: DataFrame, ps: Parser, detach: bool) -> DataFrame:
        while True:
            var = ps.name()
            if var not in df.columns:
                raise CypherError(f"{var} is not bound")
            if df.schema[var].dataType.names == NODE_COLUMNS:
                gone = self._count("nodes_deleted", df.select(F.col(f"{var}.id").alias("_gone")).where("_gone IS NOT NULL").distinct())
                edges = self.engine.edges
                left = edges.join(gone, F.col("source") == F.col("_gone"), "left_anti").join(gone, F.col("target") == F.col("_gone"), "left_anti")
                before, left = edges.count(), self.engine.scratch.cut(left)[0]
                lost = before - left.count()
                if lost and not detach:
                    raise CypherError("nodes with relationships are only deleted with DETACH")
                self.counts["relationships_deleted"] += lost
                self._keep(nodes=self.engine.nodes.join(gone, F.col("v.id") == F.col("_gone"), "left_anti"), edges=left)
            else:
                gone = self._count("relationships_deleted", df.select(F.col(f"{var}.eid").alias("_gone")).where("_gone IS NOT NULL").distinct())
                self._keep(edges=self.engine.edges.join(gone, F.col("eid") == F.col("_gone"), "left_anti"))
            if not ps.accept(","):
                return df

    def run(self, text: str) -> tuple[CodeGraph, dict[str, int]]:
        e = self.engine
        ps = Parser(text, e.parameters)
        df: DataFrame | None = None
        wrote = False
        while ps.word():
            if ps.accept("optional", "match"):
                df = e._optional(df, ps)
            elif ps.accept("match"):
                df = e._match(df, ps)
            elif ps.accept("unwind"):
                x = ps.expression()
                ps.expect("as")
                df = (e.spark.range(1) if df is None else df).withColumn(ps.name(), F.explode(F.expr(x)))
            elif ps.accept("with"):
                df = e._project(df, ps, False)
            elif ps.low() in WRITES:
                # bindings are fixed before anything is written
                df, wrote = (e.spark.range(1).withColumnRenamed("id", "_one") if df is None else e.scratch.cut(df)[0]), True
                if ps.accept("create"):
                    df = self._create(df, ps)
                elif ps.accept("merge"):
                    df = self._merge(df, ps)
                elif ps.accept("set"):
                    df = self._set(df, ps)
                else:
                    detach = ps.accept("detach")
                    ps.expect("delete")
                    df = self._delete(df, ps, detach)
            elif ps.low() == "return":
                break  # the counts are the result of a write
            else:
                raise CypherError(f"unsupported clause {ps.word()!r}")
        if not wrote:
            raise CypherError("nothing is written")
        nodes = e.nodes.select("v.*").withColumn("metadata", F.from_json("metadata", "map<string,string>"))
        return CodeGraph(nodes, e.edges.select(*EDGE_COLUMNS)), self.counts


def apply_cypher(g: CodeGraph, text: str, parameters: dict | None = None, workspace: str | None = None) -> tuple[CodeGraph, dict[str, int]]:
    """The graph (of ``workspace``, if one is given) after a writing query, and how much of what it wrote."""
    return Writer(g, parameters, workspace).run(text)
