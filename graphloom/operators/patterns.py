"""Aggregating pattern queries over a code graph. Every top-k ends its order with an id, so ties have one answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.graph import CodeGraph

FUNCTIONS, TYPES = ("function", "method"), ("struct", "interface")


def _count(name: str):
    return F.count(F.lit(1)).alias(name)


def _set(c: str, name: str):
    return F.sort_array(F.collect_set(c)).alias(name)


def _structs(out: str, **fields: str):
    """A sorted set of structs of the columns given."""
    return F.sort_array(F.collect_set(F.struct(*[F.col(c).alias(k) for k, c in fields.items()]))).alias(out)


def beside(*rows: DataFrame) -> DataFrame:
    """One-row frames as one row, without a join."""
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out.agg(*[F.max(c).alias(c) for c in out.columns])


def usage(g: CodeGraph, least: int = 2) -> DataFrame:
    """Targets of more than one call."""
    sources = g.nodes.select(F.col("id").alias("sid"))
    kept = g.rel("calls").join(sources, F.col("source") == F.col("sid"), "left_semi").groupBy("target").agg(_count("usageCount")).where(F.col("usageCount") >= least)
    return kept.join(g.nodes, F.col("target") == F.col("id")).select("id", F.col("label").alias("targetName"), "package", F.col("type").alias("nodeType"), "usageCount")


def duplicate_functions(g: CodeGraph) -> DataFrame:
    """Function labels that stand in more than one package."""
    found = g.of("function").groupBy("label").agg(F.countDistinct("package").alias("duplicateCount"), _set("package", "packages"))
    return found.where(F.col("duplicateCount") > 1).select(F.col("label").alias("functionName"), "packages", "duplicateCount")


def error_handlers(g: CodeGraph) -> DataFrame:
    h = g.hop("handles_error", source=FUNCTIONS)
    return h.groupBy(F.col("s_full_name").alias("errorHandler"), F.col("s_package").alias("package")).agg(_set("t_label", "handledErrors"), F.countDistinct("t_id").alias("errorTypeCount"))


def goroutine_spawners(g: CodeGraph) -> DataFrame:
    h = g.hop("spawns_goroutine", source=FUNCTIONS)
    keys = [F.col("s_full_name").alias("spawner"), F.col("s_package").alias("package"), F.col("s_complexity").alias("spawnerComplexity")]
    return h.groupBy(*keys).agg(_set("t_label", "goroutineFunctions"), F.countDistinct("t_id").alias("goroutineCount"))


def type_constructors(g: CodeGraph) -> DataFrame:
    h = g.hop("constructs", source=FUNCTIONS, target=TYPES)
    return h.groupBy(F.col("t_full_name").alias("constructedType"), F.col("t_package").alias("typePackage")).agg(_structs("constructors", name="s_full_name", package="s_package"), F.countDistinct("s_id").alias("constructorCount"))


def embedded_types(g: CodeGraph) -> DataFrame:
    h = g.hop("embeds", source=TYPES, target=TYPES)
    return h.groupBy(F.col("s_full_name").alias("embedderType"), F.col("s_package").alias("embedderPackage")).agg(_structs("embeddedTypes", name="t_full_name", package="t_package"), F.countDistinct("t_id").alias("embeddingCount"))


def layers(g: CodeGraph) -> DataFrame:
    return g.of("struct", "interface", "function").groupBy(F.col("package").alias("layer")).agg(_count("nodeCount"))


def factory_pattern(g: CodeGraph) -> DataFrame:
    """One row, or none without a match: a literal is a group key."""
    return g.hop("constructs", source=("function",), target=("struct",)).groupBy(F.lit("Factory Pattern").alias("pattern")).agg(_count("instances"))


def type_distribution(g: CodeGraph) -> DataFrame:
    return g.nodes.groupBy(F.col("type").alias("nodeType")).agg(_count("count"))


def edge_distribution(g: CodeGraph) -> DataFrame:
    return g.edges.groupBy(F.col("type").alias("edgeType")).agg(_count("count"))


def list_workspaces(g: CodeGraph) -> DataFrame:
    return g.nodes.where(F.col("workspace").isNotNull()).groupBy("workspace").agg(_count("nodeCount"))


def store_stats(g: CodeGraph) -> DataFrame:
    """Counters of the store in one row: nodes, edges, packages, functions and distinct types."""
    kinds = ("package", "function", "method", "struct", "interface")
    n = g.nodes.agg(_count("nodes"), F.countDistinct("type").alias("node_types"), *[F.coalesce(F.sum((F.col("type") == k).cast("long")), F.lit(0)).alias(f"{k}s") for k in kinds])
    e = g.edges.agg(_count("edges"), F.countDistinct("type").alias("edge_types"))
    return beside(n, e)


def workspace_counts(g: CodeGraph) -> DataFrame:
    kinds = ("package", "struct", "interface", "function", "method", "field", "parameter")
    embedded = F.coalesce(F.sum((F.col("embedding_model").isNotNull() & (F.col("embedding_model") != "")).cast("long")), F.lit(0))
    return g.nodes.where(F.col("workspace").isNotNull()).groupBy("workspace").agg(_count("nodes"), *[F.sum((F.col("type") == k).cast("long")).alias(f"{k}s") for k in kinds], embedded.alias("embedded"))


def package_summary(g: CodeGraph, with_files: bool = False) -> DataFrame:
    """types, functions and methods of every package that has a package node; files and imports as its metadata says."""
    per = g.nodes.groupBy(F.col("package").alias("path")).agg(
        F.sum(F.col("type").isin(*TYPES).cast("long")).alias("types"), F.sum((F.col("type") == "function").cast("long")).alias("functions"), F.sum((F.col("type") == "method").cast("long")).alias("methods")
    )
    extra = [F.coalesce(F.try_element_at("metadata", F.lit(k)), F.lit("")).alias(k) for k in ("files", "imports")] if with_files else []
    own = g.of("package").select(F.col("label").alias("name"), F.col("package").alias("path"), *extra)
    return own.join(per, "path").select("name", "path", *[c for c in ("files", "imports") if with_files], "types", "functions", "methods")


def external(path, module: str = "") -> object:
    """Whether an import path leads out of the module: domain-like first segments and known vanity hosts do."""
    first = F.split_part(path, F.lit("/"), F.lit(1))
    known = path.startswith("golang.org/x/") | path.startswith("gopkg.in/") | path.startswith("go.uber.org/")
    own = (path == module) | path.startswith(module + "/") if module else F.lit(False)
    bare = ~path.contains("/") & ~path.contains(".")
    return F.when((path == "main") | own, False).when(bare | known, True).otherwise(first.contains("."))


def dependencies(g: CodeGraph) -> DataFrame:
    path = F.regexp_replace("target", "^package:", "")
    return g.rel("imports").select(path.alias("dependency")).where(external(F.col("dependency"))).distinct()


def dependency_kinds(g: CodeGraph) -> DataFrame:
    """Imports of every package path by whether they are external."""
    path = F.regexp_replace("target", "^package:", "")
    return g.rel("imports").select(path.alias("dependency")).groupBy("dependency").agg(_count("imports")).withColumn("external", external(F.col("dependency")))


# ---- router queries


def callers(g: CodeGraph, limit: int = 20) -> DataFrame:
    """Callers by label of the called, most first: how many there are, and their labels in order.

    Only the ``limit`` rows kept have their labels gathered.
    """
    top = caller_labels(g).orderBy(F.desc("callerCount"), "function").limit(limit)
    few = g.hop("calls").select(F.col("t_label").alias("f"), "s_label").distinct().join(F.broadcast(top.select("function")), F.col("f") == F.col("function"))
    labels = few.groupBy("f").agg(_set("s_label", "callers"))
    return top.join(labels, F.col("function") == F.col("f")).select("function", "callerCount", "callerLabels", "callers").orderBy(F.desc("callerCount"), "function")


def caller_labels(g: CodeGraph) -> DataFrame:
    return g.hop("calls").groupBy(F.col("t_label").alias("function")).agg(F.countDistinct("s_id").alias("callerCount"), F.countDistinct("s_label").alias("callerLabels"))


def methods_per_type(g: CodeGraph, limit: int = 20) -> DataFrame:
    per = g.hop("has_method").groupBy(F.col("s_label").alias("type"), F.col("s_type").alias("nodeType")).agg(F.sort_array(F.collect_list("t_label")).alias("methods"), _count("methodCount"))
    return per.orderBy(F.desc("methodCount"), "type", "nodeType").limit(limit)


def most_connected(g: CodeGraph, limit: int = 20) -> DataFrame:
    """Nodes with the most distinct neighbours. Neighbours are counted on the edge ends; names are joined to the few."""
    ids = g.nodes.select(F.col("id").alias("k"))
    both = g.undirected().select("source", "target").distinct().join(ids, F.col("target") == F.col("k"), "left_semi").groupBy("source").agg(_count("connections"))
    named = both.join(g.nodes, F.col("source") == F.col("id")).select(F.col("label").alias("node"), "type", "package", "connections", "id")
    return named.orderBy(F.desc("connections"), "id").limit(limit)


def _pairs(g: CodeGraph, rel: str, a: str, b: str, source: tuple[str, ...] = (), target: tuple[str, ...] = (), limit: int = 50) -> DataFrame:
    h = g.hop(rel, source=source, target=target)
    return h.select(F.col("s_id").alias(a), F.col("t_id").alias(b)).orderBy(a, b).limit(limit)


def call_pairs(g: CodeGraph) -> DataFrame:
    return _pairs(g, "calls", "caller", "callee")


def import_pairs(g: CodeGraph) -> DataFrame:
    return _pairs(g, "imports", "importer", "imported")


def implement_pairs(g: CodeGraph) -> DataFrame:
    return _pairs(g, "implements", "implementer", "interface")


def embeds_pairs(g: CodeGraph) -> DataFrame:
    return _pairs(g, "embeds", "embedder", "embedded")


def error_pairs(g: CodeGraph) -> DataFrame:
    return _pairs(g, "handles_error", "handler", "handled")


def spawn_pairs(g: CodeGraph) -> DataFrame:
    return _pairs(g, "spawns_goroutine", "spawner", "spawned")


def returns_pairs(g: CodeGraph) -> DataFrame:
    return _pairs(g, "returns", "function", "returned", source=FUNCTIONS)


def parameter_type_pairs(g: CodeGraph) -> DataFrame:
    """The reference form: edges that start at parameter nodes. Builders start them at functions, so it stays empty."""
    return _pairs(g, "parameter_type", "parameter", "parameterType", source=("parameter",))


def constructor_pairs(g: CodeGraph) -> DataFrame:
    return _pairs(g, "constructs", "constructor", "constructed")


def uses_pairs(g: CodeGraph) -> DataFrame:
    return _pairs(g, "uses", "user", "used")


def complex_functions(g: CodeGraph, above: int = 5, limit: int | None = 20) -> DataFrame:
    f = g.of(*FUNCTIONS).where(F.col("complexity") > above).select("id", "label", "package", "complexity").orderBy(F.desc("complexity"), "id")
    return f if limit is None else f.limit(limit)


def complexity_above(g: CodeGraph, above: int = 10) -> DataFrame:
    return g.of(*FUNCTIONS).where(F.col("complexity") > above).select("id", "label", "package", "complexity")


def methods_by_complexity(g: CodeGraph, limit: int = 50) -> DataFrame:
    return g.of("method").select("id", "label", "package", "complexity").orderBy(F.desc("complexity"), "id").limit(limit)


def interfaces_named(g: CodeGraph, part: str, limit: int = 20) -> DataFrame:
    return g.of("interface").where(F.lower("label").contains(part.lower())).select("id", "label", "package").orderBy("id").limit(limit)


def all_interfaces(g: CodeGraph) -> DataFrame:
    return g.of("interface").select("id", "label", "package")


def all_packages(g: CodeGraph) -> DataFrame:
    return g.of("package").select("id", "label", "package")


def error_labels(g: CodeGraph, limit: int = 50) -> DataFrame:
    hit = F.col("label").contains("error") | F.col("label").contains("Error")
    return g.nodes.where(hit).select("id", "label", "type", "package").orderBy("id").limit(limit)


# ---- quality


def _in_out(g: CodeGraph, rel: str, end: str, name: str) -> DataFrame:
    return g.rel(rel).groupBy(F.col(end).alias(f"k_{name}")).agg(_count(name))


def god_objects(g: CodeGraph, fields: int = 10, both: int = 15) -> DataFrame:
    """Structs with many fields and members; edges run from the struct to its fields and methods."""
    f, m = _in_out(g, "has_field", "source", "fieldCount"), _in_out(g, "has_method", "source", "methodCount")
    s = g.of("struct").join(f.where(F.col("fieldCount") > fields), F.col("id") == F.col("k_fieldCount")).join(m, F.col("id") == F.col("k_methodCount"), "left")
    s = s.select("id", "label", "package", "fieldCount", F.coalesce("methodCount", F.lit(0)).alias("methodCount"))
    return s.withColumn("totalComplexity", F.col("fieldCount") + F.col("methodCount")).where(F.col("totalComplexity") > both)


def god_objects_parity(g: CodeGraph, fields: int = 10) -> DataFrame:
    """With the arrow of has_method reversed, as stated by the reference: methodCount is 0 for structs."""
    f, m = _in_out(g, "has_field", "source", "fieldCount"), _in_out(g, "has_method", "target", "methodCount")
    s = g.of("struct").join(f.where(F.col("fieldCount") > fields), F.col("id") == F.col("k_fieldCount")).join(m, F.col("id") == F.col("k_methodCount"), "left")
    return s.select("id", "label", "package", "fieldCount", F.coalesce("methodCount", F.lit(0)).alias("methodCount"))


def members_product(g: CodeGraph, fields: int = 10, methods: int = 15) -> DataFrame:
    """Two matches in sequence multiply: both counts are fields x methods."""
    f, m = _in_out(g, "has_field", "source", "f"), _in_out(g, "has_method", "source", "m")
    s = g.of("struct").join(f, F.col("id") == F.col("k_f")).join(m, F.col("id") == F.col("k_m")).withColumn("n", F.col("f") * F.col("m"))
    return s.where((F.col("n") > fields) | (F.col("n") > methods)).select("id", F.col("n").alias("fieldCount"), F.col("n").alias("methodCount"))


def many_parameters(g: CodeGraph, above: int = 5) -> DataFrame:
    p = _in_out(g, "has_parameter", "source", "paramCount").where(F.col("paramCount") > above)
    return g.of(*FUNCTIONS).join(p, F.col("id") == F.col("k_paramCount")).select("id", "label", "package", "paramCount", "signature")


def _calls_in(g: CodeGraph) -> DataFrame:
    ids = g.nodes.select(F.col("id").alias("sid"))
    return g.rel("calls").join(ids, F.col("source") == F.col("sid"), "left_semi").groupBy(F.col("target").alias("k")).agg(_count("callCount"))


def hot_functions(g: CodeGraph, above: int = 10, limit: int = 20) -> DataFrame:
    h = g.of(*FUNCTIONS).join(_calls_in(g).where(F.col("callCount") > above), F.col("id") == F.col("k"))
    h = h.select("id", "label", "package", "complexity", "callCount").orderBy(F.desc(F.col("complexity") * F.col("callCount")), "id")
    return h.limit(limit)


def hotness_avg(g: CodeGraph, calls: int = 10, complexity: int = 5) -> DataFrame:
    h = g.hop("calls", target=FUNCTIONS).groupBy("t_id", "t_label", "t_package", "t_complexity").agg(_count("callCount"), F.round(F.avg("s_complexity"), 6).alias("avgCallerComplexity"))
    h = h.where((F.col("callCount") > calls) & (F.col("t_complexity") > complexity))
    return h.select(F.col("t_id").alias("id"), F.col("t_label").alias("label"), F.col("t_package").alias("package"), F.col("t_complexity").alias("complexity"), "callCount", "avgCallerComplexity", (F.col("t_complexity") * F.col("callCount")).alias("hotness"))


def hotspots_exact(g: CodeGraph, above: int = 10, connected: int = 10, limit: int | None = 15) -> DataFrame:
    """Complexity with independent counts of incoming and outgoing calls, of functions above both thresholds."""
    ids = g.nodes.select(F.col("id").alias("oid"))
    calls = g.rel("calls")
    i = calls.join(ids, F.col("source") == F.col("oid"), "left_semi").groupBy(F.col("target").alias("ki")).agg(_count("inbound"))
    o = calls.join(ids, F.col("target") == F.col("oid"), "left_semi").groupBy(F.col("source").alias("ko")).agg(_count("outbound"))
    f = g.of(*FUNCTIONS).where(F.col("complexity") > above).join(i, F.col("id") == F.col("ki"), "left").join(o, F.col("id") == F.col("ko"), "left")
    f = f.withColumns({"inbound": F.coalesce("inbound", F.lit(0)), "outbound": F.coalesce("outbound", F.lit(0))})
    total = F.col("inbound") + F.col("outbound")
    return _riskiest(f.select("id", "label", "package", "complexity", "inbound", "outbound", total.alias("total"), (F.col("complexity") * total).alias("risk")), connected, limit)


def _riskiest(spots: DataFrame, connected: int, limit: int | None) -> DataFrame:
    spots = spots.where(F.col("total") > connected)
    return spots if limit is None else spots.orderBy(F.desc("risk"), "id").limit(limit)


def hotspots_product(g: CodeGraph, above: int = 10, connected: int = 10, limit: int | None = 15) -> DataFrame:
    """As two optional matches in sequence count: rows multiply, so both counts are in x out where neither is 0."""
    e = hotspots_exact(g, above, -1, None)
    both = F.greatest("inbound", F.lit(1)) * F.greatest("outbound", F.lit(1))
    i, o = F.when(F.col("inbound") == 0, 0).otherwise(both), F.when(F.col("outbound") == 0, 0).otherwise(both)
    return _riskiest(e.select("id", "label", "package", "complexity", i.alias("inbound"), o.alias("outbound"), (i + o).alias("total"), (F.col("complexity") * (i + o)).alias("risk")), connected, limit)


def interface_counts(g: CodeGraph) -> DataFrame:
    """Implementations of every interface, none included."""
    i = g.hop("implements", target=("interface",)).groupBy("t_id").agg(_count("n"))
    return g.of("interface").join(i, F.col("id") == F.col("t_id"), "left").select("id", "label", "package", F.coalesce("n", F.lit(0)).alias("implementations"))


def interface_usage(g: CodeGraph) -> DataFrame:
    """Distinct implementers, returners and takers of every interface; counted apart, so nothing multiplies."""
    names = {"implements": "implementers", "returns": "returners", "parameter_type": "takers"}
    ids = g.nodes.select(F.col("id").alias("sid"))
    # one scan and one exchange for the three types: distinct ends first, then a count by condition
    ends = g.rel(*names).select("target", "type", "source").join(ids, F.col("source") == F.col("sid"), "left_semi").distinct()
    per = ends.groupBy(F.col("target").alias("k")).agg(*[F.sum((F.col("type") == rel).cast("long")).alias(name) for rel, name in names.items()])
    out = g.of("interface").select("id", "label", "package").join(per, F.col("id") == F.col("k"), "left").drop("k").fillna(0, list(names.values()))
    return out.withColumn("total", F.col("implementers") + F.col("returners") + F.col("takers"))


def import_strength(g: CodeGraph, above: int = 5) -> DataFrame:
    per = g.rel("imports").groupBy("source", "target").agg(_count("strength")).where(F.col("strength") > above)
    ids = g.nodes.select("id", "label")
    per = per.join(ids.select(F.col("id").alias("a"), F.col("label").alias("package")), F.col("source") == F.col("a"))
    return per.join(ids.select(F.col("id").alias("b"), F.col("label").alias("imported")), F.col("target") == F.col("b")).select("source", "target", "package", "imported", "strength")


def risk_score(g: CodeGraph, limit: int = 10) -> DataFrame:
    h = g.of("function").join(_calls_in(g), F.col("id") == F.col("k")).withColumn("risk", F.col("complexity") * F.col("callCount"))
    return h.select("id", "label", "complexity", F.col("callCount").alias("callers"), "risk").orderBy(F.desc("risk"), "id").limit(limit)


def shared_interfaces(g: CodeGraph, above: int = 1) -> DataFrame:
    h = g.hop("implements", target=("interface",)).groupBy(F.col("t_id").alias("id"), F.col("t_label").alias("interface")).agg(_count("implementers"), _set("s_label", "structs"))
    return h.where(F.col("implementers") > above)


def package_dependencies(g: CodeGraph, limit: int = 15) -> DataFrame:
    per = g.hop("imports", source=("package",)).groupBy(F.col("s_id").alias("id"), F.col("s_label").alias("package")).agg(_count("dependencies"))
    return per.orderBy(F.desc("dependencies"), "id").limit(limit)


def coupling(g: CodeGraph) -> DataFrame:
    """Afferent and efferent coupling, instability Ce / (Ca + Ce) and abstractness of every package."""
    e = g.rel("imports").select(F.regexp_replace("source", "^package:", "").alias("a"), F.regexp_replace("target", "^package:", "").alias("b")).where("a <> b").distinct()
    ce, ca = e.groupBy(F.col("a").alias("p1")).agg(_count("ce")), e.groupBy(F.col("b").alias("p2")).agg(_count("ca"))
    t = g.of(*TYPES).groupBy(F.col("package").alias("p3")).agg(_count("types"), F.sum((F.col("type") == "interface").cast("long")).alias("abstract"))
    p = g.of("package").select(F.col("package")).distinct().join(ca, F.col("package") == F.col("p2"), "left").join(ce, F.col("package") == F.col("p1"), "left").join(t, F.col("package") == F.col("p3"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    total = zero("ca") + zero("ce")
    return p.select("package", zero("ca").alias("afferent"), zero("ce").alias("efferent"), F.round(F.when(total > 0, zero("ce") / total), 6).alias("instability"), F.round(F.col("abstract") / F.col("types"), 6).alias("abstractness"))


# ---- absence


def dead_functions(g: CodeGraph) -> DataFrame:
    """Private functions that nothing calls."""
    called = g.rel("calls").join(g.nodes.select(F.col("id").alias("sid")), F.col("source") == F.col("sid"), "left_semi").select(F.col("target").alias("k"))
    f = g.of("function").where((F.col("visibility") == "private") & ~F.col("label").isin("main", "init"))
    return f.join(called, F.col("id") == F.col("k"), "left_anti").select("id", "label", "package")


def unconstructed_structs(g: CodeGraph) -> DataFrame:
    made = g.rel("constructs").join(g.nodes.select(F.col("id").alias("sid")), F.col("source") == F.col("sid"), "left_semi").select(F.col("target").alias("k"))
    return g.of("struct").join(made, F.col("id") == F.col("k"), "left_anti").select("id", "label", "package")


def unused_private(g: CodeGraph) -> DataFrame:
    """Private functions, methods and structs that nothing calls, uses or constructs, tests left out."""
    used = g.rel("calls", "uses", "constructs").join(g.nodes.select(F.col("id").alias("sid")), F.col("source") == F.col("sid"), "left_semi").select(F.col("target").alias("k"))
    f = g.of("function", "method", "struct").where((F.col("visibility") == "private") & ~F.col("label").contains("Test") & ~F.col("label").isin("main", "init"))
    return f.join(used, F.col("id") == F.col("k"), "left_anti").select("id", "label", "type", "package")


def orphan_nodes(g: CodeGraph) -> DataFrame:
    """Nodes without any edge."""
    ends = g.edges.select(F.col("source").alias("k")).unionAll(g.edges.select("target"))
    return g.nodes.join(ends, F.col("id") == F.col("k"), "left_anti").select("id", "label", "type")


# ---- viewer analytics


def viewer_overview(g: CodeGraph) -> DataFrame:
    c = F.greatest(F.coalesce(F.col("complexity"), F.lit(1)), F.lit(0))
    n = g.nodes.agg(_count("nodes"), F.coalesce(F.sum((F.col("type") == "package").cast("long")), F.lit(0)).alias("packages"), F.round(F.avg(F.when(c > 0, c)), 1).alias("avgComplexity"))
    ids = g.nodes.select(F.col("id").alias("k"))
    e = g.edges.join(ids, F.col("source") == F.col("k"), "left_semi").join(ids, F.col("target") == F.col("k"), "left_semi").agg(_count("edges"))
    return beside(n, e)


def type_histogram(g: CodeGraph) -> DataFrame:
    per = g.nodes.groupBy("type").agg(_count("count"))  # a few types: one small window
    return per.select("type", "count", F.round(F.col("count") / F.max("count").over(Window.partitionBy()), 6).alias("height"))


def complexity_buckets(g: CodeGraph) -> DataFrame:
    c = F.coalesce(F.col("complexity"), F.lit(1))
    b = F.when(c <= 2, "1-2").when(c <= 5, "3-5").when(c <= 10, "6-10").when(c <= 20, "11-20").otherwise(">20")
    return g.of(*FUNCTIONS).groupBy(b.alias("bucket")).agg(_count("count"))


def top_degree(g: CodeGraph, limit: int = 5) -> DataFrame:
    """Nodes with the most incident edges; a self-loop counts once."""
    ids = g.nodes.select(F.col("id").alias("k"))
    e = g.edges.join(ids, F.col("source") == F.col("k"), "left_semi").join(ids, F.col("target") == F.col("k"), "left_semi").select("source", "target")
    ends = e.select(F.col("source").alias("id")).unionAll(e.where(F.col("source") != F.col("target")).select("target"))
    return ends.groupBy("id").agg(_count("degree")).orderBy(F.desc("degree"), "id").limit(limit)


def node_filter(g: CodeGraph, kinds: str = "packages-types", visibility: str | None = "public", complexity: int = 0) -> DataFrame:
    n = g.nodes
    if kinds == "packages-types":
        n = n.where(F.col("type").isin("package", "struct", "interface"))
    elif kinds != "all":
        n = n.where(F.col("type") == kinds)
    if visibility:
        n = n.where(F.coalesce(F.col("visibility"), F.lit("public")) == visibility)
    return n.where(F.coalesce(F.col("complexity"), F.lit(1)) >= complexity).select("id", "label", "type")


def induced_edges(g: CodeGraph, **how) -> DataFrame:
    """Edges with both ends in the filtered nodes, per type."""
    ids = node_filter(g, **how).select(F.col("id").alias("k"))
    e = g.edges.join(ids, F.col("source") == F.col("k"), "left_semi").join(ids, F.col("target") == F.col("k"), "left_semi")
    return e.groupBy("type").agg(_count("edges"))


PERFORMANCE_EDGES = ("imports", "implements", "embeds", "calls", "has_method", "constructs")


def perf_filter(g: CodeGraph) -> DataFrame:
    """Packages, types and public functions of complexity 3 and more, with the edges of six types between them."""
    keep = F.col("type").isin("package", "struct", "interface") | (F.col("type").isin(*FUNCTIONS) & (F.col("visibility") == "public") & (F.col("complexity") >= 3))
    ids = g.nodes.where(keep).select(F.col("id").alias("k"))
    e = g.rel(*PERFORMANCE_EDGES).join(ids, F.col("source") == F.col("k"), "left_semi").join(ids, F.col("target") == F.col("k"), "left_semi")
    return beside(ids.agg(_count("nodes")), e.agg(_count("edges")))


def field_toggle(g: CodeGraph, shown: bool = False) -> CodeGraph:
    """The graph with or without its field nodes and has_field edges."""
    if shown:
        return g
    return CodeGraph(g.nodes.where(F.col("type") != "field"), g.edges.where(F.col("type") != "has_field"))


def without_fields(g: CodeGraph) -> DataFrame:
    h = field_toggle(g)
    return beside(h.nodes.agg(_count("nodes")), h.edges.agg(_count("edges")))
