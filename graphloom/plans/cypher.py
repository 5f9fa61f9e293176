"""A read-only Cypher subset on DataFrames.

The text is parsed into clauses; every clause turns one table of bindings into the next. A node variable is a struct
column of the node's properties, a relationship variable one of source, target, type, weight and eid, a path one of
nodes and rels. Expressions become Spark SQL over those columns, so Catalyst sees through the whole query.

Supported: EXPLAIN; CALL of the vector and full-text index; MATCH and OPTIONAL MATCH with directed and undirected patterns, property maps, variable length and
shortestPath; WHERE with pattern negation; WITH, RETURN, DISTINCT, grouping, ORDER BY, SKIP, LIMIT, UNWIND; CASE, lists
and comprehensions, all / any / none, maps, parameters. Relationships of one MATCH are different edges, as in trails.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import NODE_COLUMNS, CodeGraph
from graphloom.operators import search
from graphloom.shared import Scratch

TOKEN = re.compile(r"\s+|//[^\n]*|(?P<str>'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\")|(?P<num>\d+\.\d+|\d+)|(?P<par>\$\w+)|(?P<id>`[^`]+`|[A-Za-z_]\w*)|(?P<op><>|<=|>=|=~|\.\.|->|<-|[-+*/%^=<>(){}\[\],.:|])")
FUNCTIONS = {
    "tolower": "lower({0})", "toupper": "upper({0})", "trim": "trim({0})", "tostring": "cast({0} as string)", "tointeger": "cast({0} as bigint)", "tofloat": "cast({0} as double)", "coalesce": "coalesce({*})",
    "abs": "abs({0})", "round": "round({0})", "ceil": "ceil({0})", "floor": "floor({0})", "sqrt": "sqrt({0})", "timestamp": "unix_millis(current_timestamp())", "type": "{0}.type", "id": "{0}.id", "labels": "array('CodeNode')",
    "split": "split({0}, concat('\\\\Q', {1}, '\\\\E'))", "replace": "replace({0}, {1}, {2})", "substring": "substring({0}, {1} + 1, {2})", "head": "element_at({0}, 1)", "last": "element_at({0}, -1)", "reverse": "reverse({0})",
    "startnode": "{0}.source", "endnode": "{0}.target", "nodes": "{0}.nodes", "relationships": "{0}.rels", "exists": "({0} is not null)", "range": "sequence({0}, {1})",
}
AGGREGATES = frozenset("count collect avg sum min max stdev".split())
CLAUSE = frozenset("match optional where with return order unwind limit skip union create merge delete detach set call remove".split())


class CypherError(ValueError):
    pass


@dataclass
class Node:
    var: str
    labels: list[str]
    props: list[tuple[str, str]]


@dataclass
class Rel:
    var: str
    types: list[str]
    props: list[tuple[str, str]]
    way: int  # 1 out, -1 in, 0 either
    least: int = 1
    most: int | None = 1  # None: no bound
    many: bool = False


@dataclass
class Path:
    var: str | None
    shortest: bool
    nodes: list[Node] = field(default_factory=list)
    rels: list[Rel] = field(default_factory=list)


def _lex(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if m is None:
            raise CypherError(f"unexpected {text[at : at + 10]!r}")
        if m.lastgroup:
            out.append((m.lastgroup, m.group()))
        at = m.end()
    return out


class Parser:
    def __init__(self, text: str, parameters: dict):
        self.toks, self.at, self.parameters = _lex(text), 0, parameters
        self.fresh = itertools.count()

    # ---- tokens

    def word(self, k: int = 0) -> str:
        return self.toks[self.at + k][1] if self.at + k < len(self.toks) else ""

    def low(self, k: int = 0) -> str:
        return self.word(k).lower()

    def kind(self, k: int = 0) -> str:
        return self.toks[self.at + k][0] if self.at + k < len(self.toks) else ""

    def take(self) -> str:
        w = self.word()
        if not w:
            raise CypherError("unexpected end")
        self.at += 1
        return w

    def accept(self, *words: str) -> bool:
        if all(self.low(k) == w for k, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def expect(self, w: str) -> None:
        if not self.accept(w):
            raise CypherError(f"expected {w!r}, found {self.word()!r}")

    def name(self) -> str:
        if self.kind() != "id":
            raise CypherError(f"expected a name, found {self.word()!r}")
        return self.take().strip("`")

    # ---- patterns

    def props(self) -> list[tuple[str, str]]:
        out = []
        if self.accept("{"):
            while not self.accept("}"):
                key = self.name()
                self.expect(":")
                out.append((key, self.expression()))
                self.accept(",")
        return out

    def node(self) -> Node:
        self.expect("(")
        var = self.name() if self.kind() == "id" else f"_n{next(self.fresh)}"
        labels = []
        while self.accept(":"):
            labels.append(self.name())
        n = Node(var, labels, self.props())
        self.expect(")")
        return n

    def rel(self) -> Rel:
        into = self.accept("<-")
        if not into:
            self.expect("-")
        r = Rel(f"_r{next(self.fresh)}", [], [], 0)
        if self.accept("["):
            if self.kind() == "id":
                r.var = self.name()
            if self.accept(":"):
                r.types.append(self.name())
                while self.accept("|"):
                    self.accept(":")
                    r.types.append(self.name())
            r.props = self.props()  # a property map stands before or after the hops
            if self.accept("*"):
                r.many, r.least, r.most = True, 1, None
                if self.kind() == "num":
                    r.least = r.most = int(self.take())
                    if self.accept(".."):
                        r.most = int(self.take()) if self.kind() == "num" else None
                elif self.accept(".."):
                    r.most = int(self.take()) if self.kind() == "num" else None
            r.props = r.props or self.props()
            self.expect("]")
        out = self.accept("->")
        if not out:
            self.expect("-")
        r.way = 0 if into == out else -1 if into else 1
        return r

    def path(self) -> Path:
        var = None
        if self.kind() == "id" and self.word(1) == "=":
            var = self.name()
            self.expect("=")
        short = self.low() == "shortestpath"
        if short:
            self.take()
            self.expect("(")
        p = Path(var, short)
        p.nodes.append(self.node())
        while self.word() in ("-", "<-"):
            p.rels.append(self.rel())
            p.nodes.append(self.node())
        if short:
            self.expect(")")
        return p

    # ---- expressions to Spark SQL

    def expression(self) -> str:
        left = self.xor()
        while self.accept("or"):
            left = f"({left} OR {self.xor()})"
        return left

    def xor(self) -> str:
        left = self.and_()
        while self.accept("xor"):
            left = f"({left} <> {self.and_()})"
        return left

    def and_(self) -> str:
        left = self.not_()
        while self.accept("and"):
            left = f"({left} AND {self.not_()})"
        return left

    def not_(self) -> str:
        return f"(NOT {self.not_()})" if self.accept("not") else self.comparison()

    def comparison(self) -> str:
        left = self.sum_()
        while True:
            if self.accept("is", "not", "null"):
                left = f"({left} IS NOT NULL)"
            elif self.accept("is", "null"):
                left = f"({left} IS NULL)"
            elif self.accept("contains"):
                left = f"contains({left}, {self.sum_()})"
            elif self.accept("starts", "with"):
                left = f"startswith({left}, {self.sum_()})"
            elif self.accept("ends", "with"):
                left = f"endswith({left}, {self.sum_()})"
            elif self.accept("in"):
                left = f"array_contains({self.sum_()}, {left})"
            elif self.accept("=~"):
                left = f"({left} RLIKE concat('^(?:', {self.sum_()}, ')$'))"
            elif self.word() in ("=", "<>", "<", ">", "<=", ">="):
                op = self.take()
                left = f"({left} {op} {self.sum_()})"
            else:
                return left

    def sum_(self) -> str:
        left = self.product()
        while self.word() in ("+", "-"):
            op = self.take()
            right = self.product()
            text = op == "+" and any(x.startswith(("'", "concat(", "lower(", "upper(", "cast(" if x.endswith("string)") else "'")) for x in (left, right))
            left = f"concat({left}, {right})" if text else f"({left} {op} {right})"
        return left

    def product(self) -> str:
        left = self.unary()
        while self.word() in ("*", "/", "%"):
            op = self.take()
            left = f"({left} {op} {self.unary()})"
        return left

    def unary(self) -> str:
        if self.accept("-"):
            return f"(- {self.unary()})"
        x = self.atom()
        while True:
            if self.word() == "." and self.kind(1) == "id":
                self.take()
                x = f"{x}.`{self.name()}`"
            elif self.word() == "[":
                self.take()
                if self.word() == "..":
                    raise CypherError("slices need a start")
                at = self.expression()
                if self.accept(".."):
                    end = self.expression()
                    x = f"slice({x}, {at} + 1, {end} - {at})"
                else:
                    x = f"get({x}, cast({at} as int))"
                self.expect("]")
            else:
                return x

    @staticmethod
    def literal(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, (int, float)):
            return repr(v)
        if isinstance(v, dict):
            return "named_struct(" + ", ".join(f"'{k}', {Parser.literal(x)}" for k, x in v.items()) + ")"
        if isinstance(v, (list, tuple)):
            return "array(" + ", ".join(Parser.literal(x) for x in v) + ")"
        return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"

    def atom(self) -> str:
        kind, w = self.kind(), self.word()
        if kind == "num":
            return self.take()
        if kind == "str":
            body = re.sub(r"\\(.)", r"\1", self.take()[1:-1])
            return self.literal(body)
        if kind == "par":
            self.take()
            if w[1:] not in self.parameters:
                raise CypherError(f"no parameter {w}")
            return self.literal(self.parameters[w[1:]])
        if w == "(":
            self.take()
            x = self.expression()
            self.expect(")")
            return f"({x})"
        if w == "[":
            return self.list_()
        if w == "{":
            return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in self.props()) + ")"
        low = w.lower()
        if low == "case":
            return self.case()
        if low in ("true", "false", "null"):
            self.take()
            return low.upper()
        if low in ("all", "any", "none", "single") and self.word(1) == "(" and self.low(3) == "in":
            self.at += 2
            v = self.name()
            self.expect("in")
            items = self.expression()
            self.expect("where")
            cond = self.expression()
            self.expect(")")
            return {"all": f"forall({items}, {v} -> {cond})", "any": f"exists({items}, {v} -> {cond})", "none": f"(NOT exists({items}, {v} -> {cond}))", "single": f"(size(filter({items}, {v} -> {cond})) = 1)"}[low]
        if self.word(1) == "(" and kind == "id":
            return self.function()
        return f"`{self.name()}`"

    def list_(self) -> str:
        self.take()
        if self.kind() == "id" and self.low(1) == "in":
            v = self.name()
            self.expect("in")
            items = self.expression()
            if self.accept("where"):
                items = f"filter({items}, {v} -> {self.expression()})"
            if self.accept("|"):
                items = f"transform({items}, {v} -> {self.expression()})"
            self.expect("]")
            return items
        parts = []
        while not self.accept("]"):
            parts.append(self.expression())
            self.accept(",")
        return f"array({', '.join(parts)})"

    def case(self) -> str:
        self.take()
        out = "CASE" if self.low() == "when" else f"CASE {self.expression()}"
        while self.accept("when"):
            cond = self.expression()
            self.expect("then")
            out += f" WHEN {cond} THEN {self.expression()}"
        if self.accept("else"):
            out += f" ELSE {self.expression()}"
        self.expect("end")
        return out + " END"

    def function(self) -> str:
        name = self.name().lower()
        self.expect("(")
        if name == "count" and self.accept("*"):
            self.expect(")")
            return "count(1)"
        distinct = "DISTINCT " if self.accept("distinct") else ""
        args = []
        while not self.accept(")"):
            args.append(self.expression())
            self.accept(",")
        if name in AGGREGATES:
            if name == "collect":
                return f"sort_array(collect_set({args[0]}))" if distinct else f"collect_list({args[0]})"
            return f"{'stddev' if name == 'stdev' else name}({distinct}{args[0]})"
        if name in ("size", "length"):
            return f"{SIZE}({args[0]})"
        if name not in FUNCTIONS:
            raise CypherError(f"unknown function {name}")
        return FUNCTIONS[name].replace("{*}", ", ".join(args)).format(*args)


SIZE = "__size"


class Engine:
    """Runs one query against a graph; ``workspace`` is bound as $workspace and scopes the graph."""

    def __init__(self, g: CodeGraph, parameters: dict | None = None, workspace: str | None = None, vectors: DataFrame | None = None):
        self.g = g.workspace(workspace)
        self.spark = g.nodes.sparkSession
        self.parameters = {"workspace": workspace} | (parameters or {})
        self.scratch = Scratch(self.spark, "cypher")
        # the metadata map as text: values with maps can't be grouped or compared
        self.nodes = self.g.nodes.withColumn("metadata", F.to_json("metadata")).select(F.struct(*NODE_COLUMNS).alias("v"))
        self._edges: DataFrame | None = None
        self.vectors = vectors
        self.hints: dict[str, list[str]] = {}

    @property
    def edges(self) -> DataFrame:
        """Edges with an identity, so that no relationship is met twice in a trail."""
        if self._edges is None:
            e = self.g.edges.withColumn("eid", F.monotonically_increasing_id())
            self._edges, _, _ = self.scratch.cut(e)
        return self._edges

    # ---- pieces

    def _node_table(self, n: Node) -> DataFrame:
        df = self.nodes.select(F.col("v").alias(n.var))
        for condition in self.hints.get(n.var, []):
            df = df.where(self._sql(condition, df))
        for label in n.labels:
            if label != "CodeNode":
                df = df.where(F.col(f"{n.var}.type") == label.lower())
        return self._with_props(df, n.var, n.props)

    def _with_props(self, df: DataFrame, var: str, props: list[tuple[str, str]]) -> DataFrame:
        for key, value in props:
            if key == "workspace" and value != "NULL":
                continue  # the graph is scoped already
            df = df.where(self._sql(f"`{var}`.`{key}` = {value}", df))
        return df

    def _rel_table(self, r: Rel) -> DataFrame:
        e = self.edges
        kinds = [re.sub(r"([a-z])([A-Z])", r"\1_\2", t).lower() for t in r.types if t != "RELATES_TO"]
        if kinds:
            e = e.where(F.col("type").isin(kinds))
        e = e.select(F.struct("source", "target", "type", "weight", "eid").alias("_rel"))
        for key, value in r.props:
            if key != "workspace":
                e = e.where(self._sql(f"_rel.`{key}` = {value}", e))
        out = e.select("_rel", F.col("_rel.source").alias("_from"), F.col("_rel.target").alias("_to"))
        back = e.select("_rel", F.col("_rel.target").alias("_from"), F.col("_rel.source").alias("_to"))
        if r.way == 1:
            return out
        if r.way == -1:
            return back
        return out.unionAll(back.where("_from <> _to"))

    def _sql(self, text: str, df: DataFrame):
        """The expression with size and length resolved by the type they are applied to."""
        while SIZE in text:
            at = text.rindex(SIZE)
            depth, end = 0, at + len(SIZE)
            while True:
                depth += (text[end] == "(") - (text[end] == ")")
                end += 1
                if depth == 0:
                    break
            inner = text[at + len(SIZE) + 1 : end - 1]
            try:
                kind = df.select(F.expr(inner).alias("x")).schema["x"].dataType.simpleString()
            except Exception:  # inside a lambda: the item's type isn't known here
                kind = "string"
            new = f"size({inner}.rels)" if kind.startswith("struct") else f"size({inner})" if kind.startswith("array") else f"length({inner})"
            text = text[:at] + new + text[end:]
        return F.expr(text)

    def _start(self, df: DataFrame | None, n: Node) -> DataFrame:
        if df is not None and n.var in df.columns:
            return self._with_props(df, n.var, n.props)
        own = self._node_table(n)
        return own if df is None else df.join(own, F.lit(True))  # unconnected patterns: the product the query asks for

    def _path(self, df: DataFrame | None, p: Path, used: list[str]) -> DataFrame:
        if p.shortest:
            return self._shortest(df, p)
        first = p.nodes[0]
        if df is not None and first.var not in df.columns and p.nodes[-1].var in df.columns and all(not r.many for r in p.rels):
            # begin at the end that is known already
            p = Path(p.var, False, p.nodes[::-1], [Rel(r.var, r.types, r.props, -r.way, r.least, r.most, r.many) for r in p.rels[::-1]])
            first = p.nodes[0]
        df = self._start(df, first)
        pieces = []
        for r, n in zip(p.rels, p.nodes[1:], strict=True):
            df = self._step(df, p.nodes[p.nodes.index(n) - 1].var if p.nodes.count(n) == 1 else p.nodes[len(pieces)].var, r, n, used)
            used.append(r.var)
            pieces.append(r)
        if p.var:
            parts = [f"array(`{first.var}`)"]
            for r, n in zip(p.rels, p.nodes[1:], strict=True):
                parts.append(f"`_p{r.var}`" if r.many else f"array(`{n.var}`)")
            rels = [f"`{r.var}`" if r.many else f"array(`{r.var}`)" for r in p.rels] or ["array()"]
            df = df.withColumn(p.var, F.expr(f"named_struct('nodes', concat({', '.join(parts)}), 'rels', concat({', '.join(rels)}))"))
        return df

    def _step(self, df: DataFrame, at: str, r: Rel, n: Node, used: list[str]) -> DataFrame:
        table = self._rel_table(r)
        known = n.var in df.columns
        if not r.many:
            df = df.join(table, F.col(f"{at}.id") == F.col("_from")).withColumnRenamed("_rel", r.var)
            for other in used:
                if other in df.columns and df.schema[other].dataType.simpleString().startswith("struct"):
                    df = df.where(F.col(f"{other}.eid") != F.col(f"{r.var}.eid"))
            if known:
                df = self._with_props(df.where(F.col("_to") == F.col(f"{n.var}.id")), n.var, n.props)
            else:
                df = df.join(self._node_table(n), F.col("_to") == F.col(f"{n.var}.id"))
            return df.drop("_from", "_to")
        # trails of least .. most edges
        ids = self.nodes.select("v", F.col("v.id").alias("_vid"))
        walk = df.withColumns({"_at": F.col(f"{at}.id"), r.var: F.expr("cast(array() as array<struct<source:string,target:string,type:string,weight:int,eid:bigint>>)"), f"_p{r.var}": F.array_remove(F.array(F.col(at)), F.col(at))})
        found = walk if r.least == 0 else None
        # without a bound the walk goes on until no trail can be prolonged; trails never use an edge twice, so it ends
        for length in itertools.count(1) if r.most is None else range(1, r.most + 1):
            nxt = walk.join(table, F.col("_at") == F.col("_from")).where(~F.exists(F.col(r.var), lambda x: x["eid"] == F.col("_rel.eid")))
            nxt = nxt.join(ids, F.col("_to") == F.col("_vid")).withColumns({"_at": F.col("_to"), r.var: F.concat(F.col(r.var), F.array("_rel")), f"_p{r.var}": F.concat(F.col(f"_p{r.var}"), F.array("v"))})
            walk, seen, _ = self.scratch.cut(nxt.drop("_from", "_to", "_vid", "v", "_rel"), n=F.count(F.lit(1)))
            if length >= r.least:
                found = walk if found is None else found.unionByName(walk)
            if not seen["n"]:
                break
        if known:
            found = self._with_props(found.where(F.col("_at") == F.col(f"{n.var}.id")), n.var, n.props)
        else:
            found = found.join(self._node_table(n), F.col("_at") == F.col(f"{n.var}.id"))
        return found.drop("_at")

    def _shortest(self, df: DataFrame | None, p: Path) -> DataFrame:
        """One shortest path a pair, of least ids; the ends must differ. Levels are written to the shared folder."""
        a, b, r = p.nodes[0], p.nodes[-1], p.rels[0]
        table = self._rel_table(r)
        if df is not None:
            df, _, _ = self.scratch.cut(df)
        bound = {n.var: df is not None and n.var in df.columns for n in (a, b)}
        tables = {n.var: self._with_props(df.select(n.var).distinct(), n.var, n.props) if bound[n.var] else self._node_table(n) for n in (a, b)}
        # the ends are never multiplied: the search starts at all of one kind and stops at those of the other
        aim = tables[b.var].select(F.col(f"{b.var}.id").alias("_b")).distinct()
        front = tables[a.var].select(F.col(f"{a.var}.id").alias("_a")).distinct().select("_a", F.col("_a").alias("_at"), F.expr("cast(array() as array<struct<source:string,target:string,type:string,weight:int,eid:bigint>>)").alias("_rels"), F.array("_a").alias("_ids"))
        met, hits = front.select("_a", "_at"), None
        for length in itertools.count(1) if r.most is None else range(1, r.most + 1):
            nxt = front.join(table, F.col("_at") == F.col("_from")).select("_a", F.col("_to").alias("_at"), F.concat("_rels", F.array("_rel")).alias("_rels"), F.concat("_ids", F.array("_to")).alias("_ids"))
            best = nxt.groupBy("_a", "_at").agg(F.min_by(F.struct("_rels", "_ids"), "_ids").alias("s")).select("_a", "_at", "s._rels", "s._ids").join(met, ["_a", "_at"], "left_anti")
            front, seen, _ = self.scratch.cut(best, n=F.count(F.lit(1)))
            met = met.unionAll(front.select("_a", "_at"))
            if length >= r.least:
                here = front.join(aim, F.col("_at") == F.col("_b")).where("_a <> _b").select("_a", "_b", "_rels", "_ids")
                hits = here if hits is None else hits.unionAll(here)
            if not seen["n"]:
                break
        steps = hits.select("_a", "_b", F.posexplode("_ids").alias("_k", "_id")).join(self.nodes, F.col("_id") == F.col("v.id"))
        nodes = steps.groupBy("_a", "_b").agg(F.sort_array(F.collect_list(F.struct("_k", F.col("v.id").alias("_i")))).alias("_o"), F.map_from_entries(F.collect_list(F.struct(F.col("v.id"), "v"))).alias("_m"))
        nodes = nodes.select("_a", "_b", F.expr("transform(_o, x -> _m[x._i])").alias("_nodes"))
        full = hits.drop("_ids").join(nodes, ["_a", "_b"])
        on = {a.var: "_a", b.var: "_b"}
        out = full
        if df is not None:
            keys = [F.col(f"{v}.id") == F.col(k) for v, k in on.items() if bound[v]]
            out = df.join(full, keys[0] & keys[1] if len(keys) == 2 else keys[0] if keys else F.lit(True))
        for v, k in on.items():
            if not bound[v]:
                out = out.join(tables[v], F.col(f"{v}.id") == F.col(k))
        out = out.withColumn(r.var, F.col("_rels"))
        if p.var:
            out = out.withColumn(p.var, F.struct(F.col("_nodes").alias("nodes"), F.col("_rels").alias("rels")))
        return out.drop("_a", "_b", "_rels", "_nodes")

    # ---- clauses

    def run(self, text: str) -> DataFrame:
        ps = Parser(text, self.parameters)
        if ps.accept("explain"):
            plan = self.read(ps)._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
            return self.spark.createDataFrame([(plan,)], "plan string")
        return self.read(ps)

    def read(self, ps: Parser) -> DataFrame:
        df: DataFrame | None = None
        while ps.word():
            if ps.accept("optional", "match"):
                df = self._optional(df, ps)
            elif ps.accept("match"):
                df = self._match(df, ps)
            elif ps.accept("unwind"):
                x = ps.expression()
                ps.expect("as")
                name = ps.name()
                df = (self.spark.range(1) if df is None else df).withColumn(name, F.explode(self._sql(x, df) if df is not None else F.expr(x)))
            elif ps.accept("call"):
                df = self._call(df, ps)
            elif ps.accept("with"):
                df = self._project(df, ps, False)
            elif ps.accept("return"):
                return self._project(df, ps, True)
            else:
                raise CypherError(f"unsupported clause {ps.word()!r}")
        raise CypherError("a query needs RETURN")

    def _match(self, df: DataFrame | None, ps: Parser, where: bool = True) -> DataFrame:
        used: list[str] = []
        found = [ps.path()]
        while ps.accept(","):
            found.append(ps.path())
        self.hints = self._ahead(ps, {n.var for p in found for n in p.nodes}) if where else {}
        for p in found:
            df = self._path(df, p, used)
        self.hints = {}
        return self._where(df, ps) if where else df

    def _ahead(self, ps: Parser, variables: set[str]) -> dict[str, list[str]]:
        """Conditions of the WHERE that follows which hold one node variable each: nodes meet them before any join or
        search, as those cannot be pushed through the rounds of a search."""
        mark, found = ps.at, {}
        try:
            if ps.accept("where"):
                while True:
                    ps.accept("not") if ps.low() == "not" and ps.word(1) == "(" and self._pattern_ahead_at(ps, 1) else None
                    if ps.word() == "(" and self._is_pattern(ps):
                        ps.path()
                    else:
                        cond = ps.not_()
                        bare = re.sub(r"'(?:\\.|[^'\\])*'", "", cond)
                        names = set(re.findall(r"`(\w+)`\.", bare)) | (set(re.findall(r"`(\w+)`(?!\.)", re.sub(r"\.`\w+`", "", bare))) & variables)
                        if len(names) == 1 and names <= variables and "->" not in bare and SIZE not in bare:
                            found.setdefault(names.pop(), []).append(cond)
                    if ps.low() in ("or", "xor"):
                        found = {}
                        break
                    if not ps.accept("and"):
                        break
        except CypherError:
            found = {}
        ps.at = mark
        return found

    def _pattern_ahead_at(self, ps: Parser, skip: int) -> bool:
        mark = ps.at
        ps.at += skip
        hit = ps.word() == "(" and self._is_pattern(ps)
        ps.at = mark
        return hit

    def _call(self, df: DataFrame | None, ps: Parser) -> DataFrame:
        """CALL of the vector or full-text index: YIELD node and score, the k best or all hits."""
        name = ps.name()
        while ps.accept("."):
            name += "." + ps.name()
        ps.expect("(")
        args: list = []
        while not ps.accept(")"):
            if ps.kind() == "par":
                key = ps.take()[1:]
                if key not in self.parameters:
                    raise CypherError(f"no parameter ${key}")
                args.append(self.parameters[key])
            else:
                text = ps.expression()
                args.append(self.spark.range(1).select(F.expr(text)).first()[0])
            ps.accept(",")
        if name == "db.index.vector.queryNodes":
            if self.vectors is None or len(args) != 3 or not args[2]:
                raise CypherError("the vector index needs stored vectors, a number and a vector")
            hits = search.vector_topk(self.vectors, "id", "embedding", [float(x) for x in args[2]], int(args[1])).select(F.col("id").alias("_hit"), "score")
        elif name == "db.index.fulltext.queryNodes":
            words = [w for w in str(args[1]).lower().split() if w]
            text = F.lower(F.concat_ws(" ", "v.label", "v.full_name", "v.semantic_summary"))
            score = sum((text.contains(w).cast("double") for w in words), F.lit(0.0))
            hits = self.nodes.select(F.col("v.id").alias("_hit"), score.alias("score")).where("score > 0")
        else:
            raise CypherError(f"unknown procedure {name}")
        names = {"node": "node", "score": "score"}
        if ps.accept("yield"):
            names = {}
            while True:
                given = ps.name()
                if given not in ("node", "score"):
                    raise CypherError(f"{name} has no {given}")
                names[given] = ps.name() if ps.accept("as") else given
                if not ps.accept(","):
                    break
        met = hits.join(self.nodes, F.col("_hit") == F.col("v.id")).withColumnRenamed("v", "node").select(*[F.col(a).alias(b) for a, b in names.items()])
        met = met if df is None else df.join(met, F.lit(True))
        return self._where(met, ps)

    def _where(self, df: DataFrame, ps: Parser) -> DataFrame:
        if not ps.accept("where"):
            return df
        while True:
            mark = ps.at
            negated = ps.accept("not")
            if ps.word() == "(" and self._is_pattern(ps):
                df = self._pattern_predicate(df, ps, negated)
                if ps.accept("and"):
                    continue
                return df
            ps.at = mark
            # conditions up to a pattern predicate, which only stands as a conjunct
            cond = ps.not_()
            while ps.low() in ("and", "or", "xor"):
                if ps.low() == "and" and self._pattern_ahead(ps):
                    break
                op = ps.take().upper()
                right = ps.not_()
                cond = f"({cond} <> {right})" if op == "XOR" else f"{cond} {op} {right}"
            df = df.where(self._sql(f"({cond})", df))
            if not ps.accept("and"):
                return df

    @staticmethod
    def _is_pattern(ps: Parser) -> bool:
        k = 1
        while ps.word(k) not in (")", ""):
            if ps.kind(k) not in ("id", "str", "par") and ps.word(k) not in (":", "{", "}", ","):
                return False
            k += 1
        return ps.word(k + 1) in ("-", "<-") and (ps.word(k + 2) in ("[", "-", "->") or ps.word(k + 1) == "<-")

    def _pattern_ahead(self, ps: Parser) -> bool:
        mark = ps.at
        ps.at += 1
        ps.accept("not")
        hit = ps.word() == "(" and self._is_pattern(ps)
        ps.at = mark
        return hit

    def _pattern_predicate(self, df: DataFrame, ps: Parser, negated: bool) -> DataFrame:
        p = ps.path()
        bound = [n.var for n in p.nodes if n.var in df.columns]
        keys = df.select(*[F.col(v) for v in bound]).distinct()
        met = self._path(keys, p, [])
        on = met.select(*[F.col(f"{v}.id").alias(f"_k{i}") for i, v in enumerate(bound)]).distinct()
        cond = F.lit(True)
        for i, v in enumerate(bound):
            cond = cond & (F.col(f"{v}.id") == F.col(f"_k{i}"))
        return df.join(on, cond, "left_anti" if negated else "left_semi")

    def _optional(self, df: DataFrame | None, ps: Parser) -> DataFrame:
        if df is None:
            df = self.spark.range(1).withColumnRenamed("id", "_one")
        df, _, _ = self.scratch.cut(df.withColumn("_row", F.monotonically_increasing_id()))
        met = self._match(df, ps)
        new = [c for c in met.columns if c not in df.columns]
        extra = met.select(F.col("_row").alias("_back"), *[F.col(f"`{c}`") for c in new])
        return df.join(extra, F.col("_row") == F.col("_back"), "left").drop("_row", "_back")

    def _project(self, df: DataFrame | None, ps: Parser, final: bool) -> DataFrame:
        if df is None:
            df = self.spark.range(1).withColumnRenamed("id", "_one")
        distinct = ps.accept("distinct")
        items: list[tuple[str, str]] = []
        if ps.accept("*"):
            items = [(f"`{c}`", c) for c in df.columns if not c.startswith("_")]
        while not items or ps.accept(","):
            begin = ps.at
            x = ps.expression()
            shown = "".join(w if k != "id" or i == 0 else w for i, (k, w) in enumerate(ps.toks[begin : ps.at]))
            name = ps.name() if ps.accept("as") else shown.strip("`")
            items.append((x, name))
        grouped = [re.search(r"\b(?:count|collect_set|collect_list|avg|sum|min|max|stddev)\(", x) is not None for x, _ in items]
        before = df
        if any(grouped):
            # a map literal around an aggregate is taken apart: what it holds besides are group keys
            keys = [self._sql(x, df).alias(n) for (x, n), g in zip(items, grouped, strict=True) if not g]
            aggs = [self._sql(x, df).alias(n) for (x, n), g in zip(items, grouped, strict=True) if g]
            out = (df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)).select(*[F.col(f"`{n}`") for _, n in items])
        else:
            out = df.select(*[self._sql(x, df).alias(n) for x, n in items])
        if distinct:
            out = out.distinct()
        if not final and ps.low() == "where":
            out = self._where(out, ps)
        order, hidden = [], []
        if ps.accept("order", "by"):
            while True:
                x = ps.expression()
                down = ps.accept("desc") or ps.accept("descending")
                if not down:
                    ps.accept("asc") or ps.accept("ascending")
                by = dict((a, n) for a, n in items)
                col = F.col(f"`{by[x]}`") if x in by else None
                if col is None:
                    try:
                        out.select(self._sql(x, out))
                        col = self._sql(x, out)
                    except Exception:
                        if any(grouped) or distinct:
                            raise CypherError("ORDER BY needs a returned value here") from None
                        h = f"_o{len(hidden)}"
                        hidden.append((h, x))
                        col = F.col(h)
                order.append(col.desc_nulls_first() if down else col.asc_nulls_last())
                if not ps.accept(","):
                    break
        if hidden:
            out = before.select(*[self._sql(x, before).alias(n) for x, n in items], *[self._sql(x, before).alias(h) for h, x in hidden])
        if order:
            # every returned value that can be ordered breaks ties, so that a limit has one answer
            ties = [F.col(f"`{n}`").asc_nulls_last() for _, n in items if out.schema[n].dataType.simpleString().split("<")[0].split("(")[0] in ("string", "int", "bigint", "double", "boolean", "float")]
            out = out.orderBy(*order, *ties)
        if hidden:
            out = out.drop(*[h for h, _ in hidden])
        if ps.accept("skip"):
            out = out.offset(int(ps.expression()))
        if ps.accept("limit"):
            out = out.limit(int(ps.expression().strip("'")))
        if not final and ps.low() == "where":
            out = self._where(out, ps)
        return out


def run_cypher(g: CodeGraph, text: str, parameters: dict | None = None, workspace: str | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """The result of a read-only query, or its plan after EXPLAIN. ``vectors`` (id, embedding) is the vector index that
    CALL asks. Anything outside the subset is a CypherError."""
    return Engine(g, parameters, workspace, vectors).run(text)
