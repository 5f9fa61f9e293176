"""Go sources to a code graph: facts per file in Python, everything that needs other files as joins."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.graph import EDGE_COLUMNS, NODE_COLUMNS, CodeGraph, with_missing
from graphloom.operators.patterns import external
from graphloom.shared import Scratch
from graphloom.sources.go_parser import FIELDS, file_facts

#: fixed values: the built-in types that every graph has as nodes
BUILTIN_STRUCTS = [
    "bool", "string", "int", "int8", "int16", "int32", "int64", "uint", "uint8", "uint16", "uint32", "uint64", "uintptr", "byte", "rune", "float32", "float64", "complex64", "complex128",
]
BUILTIN_INTERFACES = ("error", "any")
CHUNK = 500


def builtin_nodes(spark: SparkSession) -> DataFrame:
    rows = [(f"struct:builtin.{t}", t, "struct") for t in BUILTIN_STRUCTS] + [(f"interface:builtin.{t}", t, "interface") for t in BUILTIN_INTERFACES] + [("package:builtin", "builtin", "package")]
    return spark.createDataFrame([(*r, "builtin") for r in rows], "id string, label string, type string, package string")


def module_path(root: str) -> str:
    """The module named in go.mod, or '' without one."""
    path = os.path.join(root, "go.mod")
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            m = re.search(r"^\s*module\s+(\S+)", f.read(), re.M)
            if m:
                return m.group(1)
    return ""


def read_sources(spark: SparkSession, root: str) -> DataFrame:
    """package, filename, content of the Go files below a folder; the package is module path and folder."""
    module, base = module_path(root), os.path.abspath(root).rstrip("/")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.go").option("recursiveFileLookup", True).load(base)
    name = F.substring(F.regexp_replace("path", "^file:/*", "/"), len(base) + 2, 1 << 20)
    folder = F.regexp_replace(name, r"/?[^/]+$", "")
    package = F.when(folder == "", F.lit(module or "main")).otherwise(F.concat(F.lit(module + "/" if module else ""), folder))
    return files.where(~F.col("path").contains("/vendor/")).select(package.alias("package"), name.alias("filename"), F.decode("content", "UTF-8").alias("content"))


def allowed_packages(files: DataFrame, allow: list[str], module: str = "") -> DataFrame:
    """Files of internal packages and of external ones that are allow-listed, by path or by a ``/...`` prefix."""
    keep: Column = ~external(F.col("package"), module)
    for a in allow:
        keep = keep | (F.col("package").startswith(a[:-4]) if a.endswith("/...") else F.col("package") == a)
    return files.where(keep)


def facts(files: DataFrame) -> DataFrame:
    """Facts of every file. A package with a file that is no Go is left out whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = []
                for package, filename, content in zip(*[c.to_pylist() for c in part.columns], strict=True):
                    rows += file_facts(package, filename, content or "")
                yield pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in rows], kinds[t]) for k, t in FIELDS.items()], names=list(FIELDS))

    found = files.select("package", "filename", "content").mapInArrow(run, ", ".join(f"{k} {t}" for k, t in FIELDS.items()))
    cut, seen, _ = Scratch(files.sparkSession, "facts").cut(found, bad=F.sum((F.col("kind") == "bad").cast("long")))
    if seen["bad"]:
        cut = cut.join(cut.where("kind = 'bad'").select("package").distinct(), "package", "left_anti")
    return cut


class Extraction:
    """Nodes and edges of a table of facts."""

    def __init__(self, found: DataFrame):
        self.facts, self.spark = found, found.sparkSession

    def of(self, *kinds: str) -> DataFrame:
        return self.facts.where(F.col("kind").isin(*kinds))

    # ---- nodes

    def nodes(self) -> DataFrame:
        visible = F.when(F.col("exported"), "public").otherwise("private")
        position = F.struct("filename", "line", F.col("col").alias("column"), F.lit(0).alias("offset"))
        full = F.concat_ws(".", "package", "name")
        by = lambda *cols: F.min_by(F.struct(*cols), F.struct("filename", "ord"))  # noqa: E731 - the first in declaration order

        def node(df: DataFrame, kind: Column, level: int, size: Column, **more: Column) -> DataFrame:
            base = {
                "id": F.col("id"), "label": F.col("name"), "type": kind, "package": F.col("package"), "full_name": full, "size": size.cast("int"), "level": F.lit(level), "position": position,
                "visibility": visible, "documentation": F.col("doc"), "complexity": F.lit(0), "signature": F.lit(None).cast("string"), "metadata": F.lit(None).cast("map<string,string>"),
            }
            shaped = df.select(*[c.alias(k) for k, c in (base | more).items()], "filename", "ord")
            cols = [c for c in base if c != "id"]
            return shaped.groupBy("id").agg(by(*cols).alias("s")).select("id", "s.*")

        text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
        imports = self.of("import").groupBy(F.col("package").alias("ip")).agg(F.countDistinct("target").alias("imports"))
        packs = self.of("file").groupBy("package").agg(F.count(F.lit(1)).alias("size"), F.min("filename").alias("filename")).join(imports, F.col("package") == F.col("ip"), "left")
        packs = packs.select(
            F.concat(F.lit("package:"), "package").alias("id"), F.element_at(F.split("package", "/"), -1).alias("label"), F.lit("package").alias("type"), "package", F.col("package").alias("full_name"), F.col("size").cast("int").alias("size"),
            F.lit(0).alias("level"), F.struct("filename", F.lit(1).alias("line"), F.lit(1).alias("column"), F.lit(0).alias("offset")).alias("position"), F.lit("public").alias("visibility"), F.lit(None).cast("string").alias("documentation"),
            F.lit(0).alias("complexity"), F.lit(None).cast("string").alias("signature"), F.create_map(F.lit("path"), F.col("package"), F.lit("files"), text(F.col("size")), F.lit("imports"), text(F.coalesce("imports", F.lit(0)))).alias("metadata"),
        )
        types = node(self.of("type"), F.col("type_name"), 1, F.col("size"), metadata=F.create_map(F.lit("exported"), text(F.col("exported")), F.lit("kind"), F.col("type_name")))
        funcs = node(
            self.of("func"), F.col("type_name"), 2, F.col("size"), complexity=F.col("complexity"), signature=F.col("text"),
            metadata=F.create_map(F.lit("exported"), text(F.col("exported")), F.lit("receiver"), text(F.col("owner")), F.lit("complexity"), text(F.col("complexity"))),
        )
        fields = node(self.of("field"), F.lit("field"), 2, F.lit(3), metadata=F.create_map(F.lit("exported"), text(F.col("exported")), F.lit("embedded"), text(F.col("embedded")), F.lit("tag"), text(F.col("text")), F.lit("type_name"), text(F.col("type_name"))))
        params = node(self.of("param"), F.lit("parameter"), 3, F.lit(2), visibility=F.lit("private"), metadata=F.create_map(F.lit("index"), text(F.col("size")), F.lit("type_name"), text(F.col("type_name"))))
        out = packs
        for part in (types, funcs, fields, params):
            out = out.unionByName(part)
        b = builtin_nodes(self.spark)
        b = with_missing(b.withColumns({"full_name": F.concat_ws(".", "package", "label"), "size": F.lit(1), "level": F.lit(1), "visibility": F.lit("public"), "complexity": F.lit(0)}), out.columns, {"metadata": "map<string,string>", "position": "struct<filename:string,line:int,column:int,offset:int>"})
        return out.unionByName(b)

    # ---- edges

    def _type_ids(self) -> DataFrame:
        """named (package.Name or a basic type), type id, type of every struct and interface."""
        own = self.of("type").select(F.concat_ws(".", "package", "name").alias("named"), F.col("id").alias("tid"), F.col("type_name").alias("tkind")).distinct()
        b = builtin_nodes(self.spark).where("type <> 'package'").select(F.col("label").alias("named"), F.col("id").alias("tid"), F.col("type").alias("tkind"))
        return own.unionAll(b)

    def _typed(self, df: DataFrame, kind: str, weight: int, where: str = "true") -> DataFrame:
        t = self._type_ids().where(where)
        return df.join(t, df["target"] == t["named"]).select(F.col("owner").alias("source"), F.col("tid").alias("target"), F.lit(kind).alias("type"), F.lit(weight).alias("weight"))

    def _plain(self, df: DataFrame, source: Column, target: Column, kind: str, weight: int) -> DataFrame:
        return df.select(source.alias("source"), target.alias("target"), F.lit(kind).alias("type"), F.lit(weight).alias("weight"))

    def edges(self) -> DataFrame:
        """All edge types, a bag; every edge has both ends among the nodes."""
        f, plain, typed = self.of, self._plain, self._typed
        ids = self.nodes().select(F.col("id").alias("k"))
        funcs = f("func")
        parts = [
            plain(f("import"), F.concat(F.lit("package:"), "package"), F.col("target"), "imports", 1).distinct(),
            # embedding by pointer, and of an interface in a struct, gives no edge
            typed(f("embed").where("type_name = 'struct' AND NOT pointer"), "embeds", 3, "tkind = 'struct'"),
            typed(f("embed").where("type_name = 'interface'"), "embeds", 2, "tkind = 'interface'"),
            typed(f("parameter_type"), "parameter_type", 1),
            typed(f("result"), "returns", 1),
            typed(f("method_of"), "method_of", 1),
            typed(f("uses"), "uses", 1),
            typed(f("field_access"), "uses", 1, "tkind = 'struct'"),
            typed(f("constructs"), "constructs", 2),
            plain(f("handles_error"), F.col("owner"), F.col("owner"), "handles_error", 1),
            plain(f("wraps_error"), F.col("owner"), F.col("owner"), "wraps_error", 1),
            plain(f("field"), F.col("owner"), F.col("id"), "has_field", 1),
            plain(f("param"), F.col("owner"), F.col("id"), "has_parameter", 1),
            plain(funcs.where("type_name = 'method'"), F.concat(F.lit("struct:"), "owner"), F.col("id"), "has_method", 1),
            self._calls("call", "calls", 1),
            self._calls("spawn", "spawns_goroutine", 2),
            self.implements(),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        out = out.join(ids, F.col("source") == F.col("k"), "left_semi").join(ids, F.col("target") == F.col("k"), "left_semi")
        return out.select(*[F.col(c) if c in out.columns else F.lit(None).cast("string").alias(c) for c in EDGE_COLUMNS])

    def _calls(self, kind: str, edge: str, weight: int) -> DataFrame:
        """Calls whose target is a known function or method; candidates that are none drop out of the join."""
        known = self.of("func").select(F.col("id").alias("fid")).distinct()
        direct = self.of(kind).where(F.size("names") > 0).select("owner", "filename", "ord", F.explode("names").alias("c")).join(known, F.col("c") == F.col("fid"))
        # a method of what a constructor or any other function returned
        first = self.of("result").groupBy(F.col("owner").alias("maker")).agg(F.min_by(F.struct("target", "pointer"), "ord").alias("r"))
        held = self.of(kind).where(F.col("target").isNotNull()).select("owner", "filename", "ord", "name", "target").join(first, F.col("target") == F.col("maker"))
        pkg = F.regexp_replace("r.target", r"\.[^.]*$", "")
        pointed = F.concat(F.lit("method:"), pkg, F.lit(".*"), "r.target", F.lit("."), "name")
        plain = F.concat(F.lit("method:"), pkg, F.lit("."), "r.target", F.lit("."), "name")
        via = held.select("owner", "filename", "ord", F.explode(F.when(F.col("r.pointer"), F.array(pointed)).otherwise(F.array(plain, pointed))).alias("c")).join(known, F.col("c") == F.col("fid"))
        both = direct.unionByName(via)
        return both.select(F.col("owner").alias("source"), F.col("fid").alias("target"), F.lit(edge).alias("type"), F.lit(weight).alias("weight"))

    def implements(self) -> DataFrame:
        """Structs whose methods, their own or promoted, cover all methods of an interface; relational division by count.

        Candidates meet on (method, signature). An interface without methods is satisfied by every struct.
        """
        own = self.of("func").where("type_name = 'method'").select(F.concat(F.lit("struct:"), "owner").alias("sid"), "name", F.col("full").alias("sig")).distinct()
        iface = self.of("interface_method").select(F.col("owner").alias("iid"), "name", F.col("text").alias("sig")).distinct()
        t = self._type_ids()
        embeds = self.of("embed").join(t, F.col("target") == t["named"]).select("owner", "tid").distinct()
        sizes, cut = None, Scratch(self.spark, "methods").cut
        while True:  # promotion through embedding, until nothing new is promoted; sets of methods, so loops of embedding end too
            lifted = embeds.join(own.unionAll(iface.select(F.col("iid"), "name", "sig")), F.col("tid") == F.col("sid")).select("owner", "name", "sig")
            new_own = own.unionAll(lifted.where(F.col("owner").startswith("struct:"))).distinct()
            new_iface = iface.unionAll(embeds.join(iface, F.col("tid") == F.col("iid")).where(F.col("owner").startswith("interface:")).select("owner", "name", "sig")).distinct()
            new_own, a, _ = cut(new_own, n=F.count(F.lit(1)))
            new_iface, b, _ = cut(new_iface, n=F.count(F.lit(1)))
            own, iface, before, sizes = new_own, new_iface, sizes, (a["n"], b["n"])
            if sizes == before:
                break
        need = iface.groupBy(F.col("iid").alias("i")).agg(F.count(F.lit(1)).alias("need"))
        met = own.join(iface, ["name", "sig"]).groupBy("sid", "iid").agg(F.count(F.lit(1)).alias("has"))
        full = met.join(need, (F.col("iid") == F.col("i")) & (F.col("has") == F.col("need"))).select(F.col("sid").alias("source"), F.col("iid").alias("target"))
        types = self.of("type").select("id", "type_name").distinct()
        bare = types.where("type_name = 'interface'").join(iface.select("iid"), F.col("id") == F.col("iid"), "left_anti").select(F.col("id").alias("target"))
        structs = types.where("type_name = 'struct'").select(F.col("id").alias("source"))
        # every struct meets an empty interface: the result is that product, written as an explode of id lists
        every, chunk = None, []
        for row in [*bare.orderBy("target").toLocalIterator(), None]:
            if row is not None:
                chunk.append(row["target"])
            if chunk and (row is None or len(chunk) == CHUNK):
                one = structs.select("source", F.explode(F.array(*[F.lit(x) for x in chunk])).alias("target"))
                every, chunk = one if every is None else every.unionAll(one), []
        if every is not None:
            full = full.unionByName(every)
        kind, weight = F.lit("implements").alias("type"), F.lit(2).alias("weight")
        return full.select("source", "target", kind, weight)

    def graph(self) -> CodeGraph:
        nodes = self.nodes()
        types = {"size": "int", "level": "int", "complexity": "int", "created_at": "timestamp"}
        return CodeGraph(with_missing(nodes, NODE_COLUMNS, types), self.edges())


def analyze_codebase(spark: SparkSession, root: str, allow: list[str] | None = None) -> CodeGraph:
    """The code graph of the Go module below ``root``. A folder without Go files is an error, as is a missing one."""
    if not os.path.isdir(root):
        raise FileNotFoundError(root)
    files = read_sources(spark, root)
    if files.limit(1).count() == 0:
        raise ValueError(f"no Go packages below {root}")
    return Extraction(facts(allowed_packages(files, allow or [], module_path(root)))).graph()
