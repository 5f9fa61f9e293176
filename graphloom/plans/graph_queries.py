"""Graph queries over the whole node and edge tables, each with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.canonical import canonical_hex, canonical_type, stripped
from graphloom.functions.mock_embedding import embedded_nodes, mock_provider
from graphloom.graph import CodeGraph
from graphloom.operators import impact, merge, paths, patterns, search, summaries
from graphloom.plans.cypher import run_cypher
from graphloom.plans.general import KIND
from graphloom.plans.sql_query import sql_query
from graphloom.shared import Scratch
from graphloom.sources.go_extract import Extraction, facts
from graphloom.streaming.upsert import edge_counts

COMPONENT = "function:tallyvine/core/common.Wrapf"
PACKAGE = "tallyvine/core/common"
TYPE_NAME = "error"
HOT = "Wrapf"
TERM = "merge"

BASE = rf"""
WITH RECURSIVE n AS (
  SELECT id, workspace, label, {KIND} AS type, package, full_name, size, level, signature, visibility, documentation, complexity, embedding_model, semantic_summary, created_at, position
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at) AS rn FROM nodes WHERE regexp_matches(id, '\S')) WHERE rn = 1
  UNION ALL SELECT id, NULL, label, {KIND}, package, concat_ws('.', package, label), 1, 1, NULL, 'public', NULL, 0, NULL, NULL, NULL, NULL FROM builtin_nodes),
ea AS (SELECT regexp_replace(source, '^\s+|\s+$', '', 'g') AS source, regexp_replace(target, '^\s+|\s+$', '', 'g') AS target, {KIND} AS type, weight, workspace FROM (SELECT DISTINCT * FROM edges)
  WHERE regexp_matches(source, '\S') AND regexp_matches(target, '\S')),
e AS (SELECT * FROM ea WHERE source IN (SELECT id FROM n) AND target IN (SELECT id FROM n)),
h AS (SELECT s.id AS s_id, s.label AS s_label, s.type AS s_type, s.package AS s_package, s.full_name AS s_full_name, s.complexity AS s_complexity, s.signature AS s_signature,
  t.id AS t_id, t.label AS t_label, t.type AS t_type, t.package AS t_package, t.full_name AS t_full_name, t.complexity AS t_complexity, e.type AS type
  FROM ea e JOIN n s ON s.id = e.source JOIN n t ON t.id = e.target),
u AS (SELECT source, target, type FROM ea UNION ALL SELECT target, source, type FROM ea WHERE source <> target)
"""
FUNC = "('function', 'method')"
TYPES = "('struct', 'interface')"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, build: Callable[[CodeGraph], DataFrame], sql: str | None) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(CodeGraph.cleaned(spark, sf_dir))
    if sql is not None:
        SQL[name] = BASE + sql


def _flat(names: list[str]) -> Callable[[Column], Column]:
    return lambda x: F.concat_ws(" ", *[x[k] for k in names])


def _joined(build: Callable[[CodeGraph], DataFrame], *columns: str) -> Callable[[CodeGraph], DataFrame]:
    """Lists as text, for a comparison by value: structs with blanks between their fields, items with commas."""

    def run(g: CodeGraph) -> DataFrame:
        df = build(g)
        for c in columns:
            kind = df.schema[c].dataType.elementType
            items = F.transform(c, _flat(kind.names)) if kind.typeName() == "struct" else F.col(c)
            df = df.withColumn(c, F.array_join(F.sort_array(items), ","))
        return df

    return run


def _set(c: str) -> str:
    return f"array_to_string(list_sort(list(DISTINCT {c})), ',')"


def _pairs(rel: str, a: str, b: str, more: str = "") -> str:
    return f"SELECT s_id AS {a}, t_id AS {b} FROM h WHERE type = '{rel}' {more} ORDER BY 1, 2 LIMIT 50"


_add("usage", patterns.usage, "SELECT t_id AS id, any_value(t_label) AS \"targetName\", any_value(t_package) AS package, any_value(t_type) AS \"nodeType\", count(*) AS \"usageCount\" FROM h WHERE type = 'calls' GROUP BY t_id HAVING count(*) > 1")
_add("duplicate_functions", _joined(patterns.duplicate_functions, "packages"), f"SELECT label AS \"functionName\", {_set('package')} AS packages, count(DISTINCT package) AS \"duplicateCount\" FROM n WHERE type = 'function' GROUP BY label HAVING count(DISTINCT package) > 1")
_add("error_handlers", _joined(patterns.error_handlers, "handledErrors"), f"SELECT s_full_name AS \"errorHandler\", s_package AS package, {_set('t_label')} AS \"handledErrors\", count(DISTINCT t_id) AS \"errorTypeCount\" FROM h WHERE type = 'handles_error' AND s_type IN {FUNC} GROUP BY 1, 2")
_add("goroutine_spawners", _joined(patterns.goroutine_spawners, "goroutineFunctions"), f"SELECT s_full_name AS spawner, s_package AS package, s_complexity AS \"spawnerComplexity\", {_set('t_label')} AS \"goroutineFunctions\", count(DISTINCT t_id) AS \"goroutineCount\" FROM h WHERE type = 'spawns_goroutine' AND s_type IN {FUNC} GROUP BY 1, 2, 3")
_add("type_constructors", _joined(patterns.type_constructors, "constructors"), f"SELECT t_full_name AS \"constructedType\", t_package AS \"typePackage\", {_set("concat_ws(' ', s_full_name, s_package)")} AS constructors, count(DISTINCT s_id) AS \"constructorCount\" FROM h WHERE type = 'constructs' AND s_type IN {FUNC} AND t_type IN {TYPES} GROUP BY 1, 2")
_add("embedded_types", _joined(patterns.embedded_types, "embeddedTypes"), f"SELECT s_full_name AS \"embedderType\", s_package AS \"embedderPackage\", {_set("concat_ws(' ', t_full_name, t_package)")} AS \"embeddedTypes\", count(DISTINCT t_id) AS \"embeddingCount\" FROM h WHERE type = 'embeds' AND s_type IN {TYPES} AND t_type IN {TYPES} GROUP BY 1, 2")
_add("layers", patterns.layers, "SELECT package AS layer, count(*) AS \"nodeCount\" FROM n WHERE type IN ('struct', 'interface', 'function') GROUP BY 1")
_add("factory_pattern", patterns.factory_pattern, "SELECT 'Factory Pattern' AS pattern, count(*) AS instances FROM h WHERE type = 'constructs' AND s_type = 'function' AND t_type = 'struct' HAVING count(*) > 0")
_add("type_distribution", patterns.type_distribution, "SELECT type AS \"nodeType\", count(*) AS \"count\" FROM n GROUP BY 1")
_add("edge_distribution", patterns.edge_distribution, "SELECT type AS \"edgeType\", count(*) AS \"count\" FROM ea GROUP BY 1")
_add("list_workspaces", patterns.list_workspaces, "SELECT workspace, count(*) AS \"nodeCount\" FROM n WHERE workspace IS NOT NULL GROUP BY 1")
_add(
    "store_stats",
    patterns.store_stats,
    "SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(DISTINCT type) FROM n) AS node_types, " + ", ".join(f"(SELECT count(*) FROM n WHERE type = '{k}') AS {k}s" for k in ("package", "function", "method", "struct", "interface")) + ", (SELECT count(*) FROM ea) AS edges, (SELECT count(DISTINCT type) FROM ea) AS edge_types",
)
_add(
    "workspace_counts",
    patterns.workspace_counts,
    "SELECT workspace, count(*) AS nodes, " + ", ".join(f"sum(CASE WHEN type = '{k}' THEN 1 ELSE 0 END)::BIGINT AS {k}s" for k in ("package", "struct", "interface", "function", "method", "field", "parameter")) + ", sum(CASE WHEN embedding_model <> '' THEN 1 ELSE 0 END)::BIGINT AS embedded FROM n WHERE workspace IS NOT NULL GROUP BY 1",
)
_add(
    "package_summary",
    patterns.package_summary,
    f"""SELECT p.label AS name, p.package AS path, c.types, c.functions, c.methods FROM n p JOIN (SELECT package, sum(CASE WHEN type IN {TYPES} THEN 1 ELSE 0 END)::BIGINT AS types,
  sum(CASE WHEN type = 'function' THEN 1 ELSE 0 END)::BIGINT AS functions, sum(CASE WHEN type = 'method' THEN 1 ELSE 0 END)::BIGINT AS methods FROM n GROUP BY 1) c ON c.package = p.package WHERE p.type = 'package'""",
)
EXTERNAL = "CASE WHEN d = 'main' THEN false WHEN NOT contains(d, '/') AND NOT contains(d, '.') THEN true WHEN starts_with(d, 'golang.org/x/') OR starts_with(d, 'gopkg.in/') OR starts_with(d, 'go.uber.org/') THEN true ELSE contains(split_part(d, '/', 1), '.') END"
_add("dependencies", patterns.dependencies, f"SELECT DISTINCT d AS dependency FROM (SELECT regexp_replace(target, '^package:', '') AS d FROM ea WHERE type = 'imports') WHERE {EXTERNAL}")
_add("dependency_kinds", patterns.dependency_kinds, f"SELECT d AS dependency, count(*) AS imports, {EXTERNAL} AS \"external\" FROM (SELECT regexp_replace(target, '^package:', '') AS d FROM ea WHERE type = 'imports') GROUP BY d")
CALLERS = "SELECT t_label AS \"function\", count(DISTINCT s_id) AS \"callerCount\", count(DISTINCT s_label) AS \"callerLabels\" FROM h WHERE type = 'calls' GROUP BY 1"
_add("callers", _joined(patterns.callers, "callers"), CALLERS.replace(" FROM h", f", {_set('s_label')} AS callers FROM h") + " ORDER BY 2 DESC, 1 LIMIT 20")
_add("caller_labels", patterns.caller_labels, CALLERS)
_add("methods_per_type", _joined(patterns.methods_per_type, "methods"), "SELECT s_label AS type, s_type AS \"nodeType\", array_to_string(list_sort(list(t_label)), ',') AS methods, count(*) AS \"methodCount\" FROM h WHERE h.type = 'has_method' GROUP BY s_label, s_type ORDER BY count(*) DESC, s_label, s_type LIMIT 20")
_add("most_connected", patterns.most_connected, "SELECT n.label AS node, n.type, n.package, c.connections, n.id FROM n JOIN (SELECT source, count(DISTINCT target) AS connections FROM u WHERE target IN (SELECT id FROM n) GROUP BY 1) c ON c.source = n.id ORDER BY connections DESC, id LIMIT 20")
for _name, _build, _sql in (
    ("call_pairs", patterns.call_pairs, _pairs("calls", "caller", "callee")),
    ("import_pairs", patterns.import_pairs, _pairs("imports", "importer", "imported")),
    ("implement_pairs", patterns.implement_pairs, _pairs("implements", "implementer", "interface")),
    ("embeds_pairs", patterns.embeds_pairs, _pairs("embeds", "embedder", "embedded")),
    ("error_pairs", patterns.error_pairs, _pairs("handles_error", "handler", "handled")),
    ("spawn_pairs", patterns.spawn_pairs, _pairs("spawns_goroutine", "spawner", "spawned")),
    ("returns_pairs", patterns.returns_pairs, _pairs("returns", '"function"', "returned", f"AND s_type IN {FUNC}")),
    ("parameter_type_pairs", patterns.parameter_type_pairs, _pairs("parameter_type", '"parameter"', '"parameterType"', "AND s_type = 'parameter'")),
    ("constructor_pairs", patterns.constructor_pairs, _pairs("constructs", "constructor", "constructed")),
    ("uses_pairs", patterns.uses_pairs, _pairs("uses", '"user"', "used")),
):
    _add(_name, _build, _sql)
_add("complex_functions", patterns.complex_functions, f"SELECT id, label, package, complexity FROM n WHERE type IN {FUNC} AND complexity > 5 ORDER BY complexity DESC, id LIMIT 20")
_add("complexity_above", lambda g: patterns.complexity_above(g, 3), f"SELECT id, label, package, complexity FROM n WHERE type IN {FUNC} AND complexity > 3")
_add("methods_by_complexity", patterns.methods_by_complexity, "SELECT id, label, package, complexity FROM n WHERE type = 'method' ORDER BY complexity DESC NULLS LAST, id LIMIT 50")
_add("interfaces_named", lambda g: patterns.interfaces_named(g, "Sink"), "SELECT id, label, package FROM n WHERE type = 'interface' AND contains(lower(label), 'sink') ORDER BY id LIMIT 20")
_add("all_interfaces", patterns.all_interfaces, "SELECT id, label, package FROM n WHERE type = 'interface'")
_add("all_packages", patterns.all_packages, "SELECT id, label, package FROM n WHERE type = 'package'")
_add("error_labels", patterns.error_labels, "SELECT id, label, type, package FROM n WHERE contains(label, 'error') OR contains(label, 'Error') ORDER BY id LIMIT 50")
FIELDS = "f AS (SELECT source, count(*) AS c FROM ea WHERE type = 'has_field' GROUP BY 1)"
_add("god_objects", lambda g: patterns.god_objects(g, 2, 3), f", {FIELDS}, m AS (SELECT source, count(*) AS c FROM ea WHERE type = 'has_method' GROUP BY 1) SELECT id, label, package, f.c AS \"fieldCount\", coalesce(m.c, 0) AS \"methodCount\", f.c + coalesce(m.c, 0) AS \"totalComplexity\" FROM n JOIN f ON f.source = id LEFT JOIN m ON m.source = id WHERE type = 'struct' AND f.c > 2 AND f.c + coalesce(m.c, 0) > 3")
_add("god_objects_parity", lambda g: patterns.god_objects_parity(g, 2), f", {FIELDS}, m AS (SELECT target, count(*) AS c FROM ea WHERE type = 'has_method' GROUP BY 1) SELECT id, label, package, f.c AS \"fieldCount\", coalesce(m.c, 0) AS \"methodCount\" FROM n JOIN f ON f.source = id LEFT JOIN m ON m.target = id WHERE type = 'struct' AND f.c > 2")
_add("members_product", lambda g: patterns.members_product(g, 3, 3), "SELECT n.id, count(*) AS \"fieldCount\", count(*) AS \"methodCount\" FROM n JOIN ea f ON f.source = n.id AND f.type = 'has_field' JOIN ea m ON m.source = n.id AND m.type = 'has_method' WHERE n.type = 'struct' GROUP BY 1 HAVING count(*) > 3")
_add("many_parameters", lambda g: patterns.many_parameters(g, 2), f"SELECT n.id, any_value(n.label) AS label, any_value(n.package) AS package, count(*) AS \"paramCount\", any_value(n.signature) AS signature FROM n JOIN ea p ON p.source = n.id AND p.type = 'has_parameter' WHERE n.type IN {FUNC} GROUP BY n.id HAVING count(*) > 2")
_add("hot_functions", lambda g: patterns.hot_functions(g, 5), f"SELECT t_id AS id, any_value(t_label) AS label, any_value(t_package) AS package, any_value(t_complexity) AS complexity, count(*) AS \"callCount\" FROM h WHERE type = 'calls' AND t_type IN {FUNC} GROUP BY t_id HAVING count(*) > 5 ORDER BY any_value(t_complexity) * count(*) DESC, t_id LIMIT 20")
_add("hotness_avg", lambda g: patterns.hotness_avg(g, 2, 1), f"SELECT t_id AS id, t_label AS label, t_package AS package, t_complexity AS complexity, count(*) AS \"callCount\", round(avg(s_complexity), 6) AS \"avgCallerComplexity\", t_complexity * count(*) AS hotness FROM h WHERE type = 'calls' AND t_type IN {FUNC} GROUP BY 1, 2, 3, 4 HAVING count(*) > 2 AND t_complexity > 1")
INOUT = f", i AS (SELECT t_id, count(*) AS c FROM h WHERE type = 'calls' GROUP BY 1), o AS (SELECT s_id, count(*) AS c FROM h WHERE type = 'calls' GROUP BY 1), x AS (SELECT id, label, package, complexity, coalesce(i.c, 0) AS a, coalesce(o.c, 0) AS b FROM n LEFT JOIN i ON t_id = id LEFT JOIN o ON s_id = id WHERE type IN {FUNC} AND complexity > 2)"
_add("hotspots_exact", lambda g: patterns.hotspots_exact(g, 2, -1, None), INOUT + " SELECT id, label, package, complexity, a AS inbound, b AS outbound, a + b AS total, complexity * (a + b) AS risk FROM x")
_add(
    "hotspots_product",
    lambda g: patterns.hotspots_product(g, 2, -1, None),
    f", p AS (SELECT n.id, n.label, n.package, n.complexity, count(i.source) AS a, count(o.source) AS b FROM n LEFT JOIN e i ON i.target = n.id AND i.type = 'calls' LEFT JOIN e o ON o.source = n.id AND o.type = 'calls' WHERE n.type IN {FUNC} AND n.complexity > 2 GROUP BY 1, 2, 3, 4) SELECT id, label, package, complexity, a AS inbound, b AS outbound, a + b AS total, complexity * (a + b) AS risk FROM p",
)
_add("interface_counts", patterns.interface_counts, "SELECT n.id, n.label, n.package, count(e.source) AS implementations FROM n LEFT JOIN e ON e.target = n.id AND e.type = 'implements' WHERE n.type = 'interface' GROUP BY 1, 2, 3")
_add(
    "interface_usage",
    patterns.interface_usage,
    "SELECT n.id, n.label, n.package, count(DISTINCT CASE WHEN e.type = 'implements' THEN source END) AS implementers, count(DISTINCT CASE WHEN e.type = 'returns' THEN source END) AS returners, count(DISTINCT CASE WHEN e.type = 'parameter_type' THEN source END) AS takers, "
    "count(DISTINCT CASE WHEN e.type = 'implements' THEN source END) + count(DISTINCT CASE WHEN e.type = 'returns' THEN source END) + count(DISTINCT CASE WHEN e.type = 'parameter_type' THEN source END) AS total FROM n LEFT JOIN e ON e.target = n.id WHERE n.type = 'interface' GROUP BY 1, 2, 3",
)
_add("import_strength", lambda g: patterns.import_strength(g, 1), "SELECT s_id AS source, t_id AS target, any_value(s_label) AS package, any_value(t_label) AS imported, count(*) AS strength FROM h WHERE type = 'imports' GROUP BY 1, 2 HAVING count(*) > 1")
_add("risk_score", patterns.risk_score, "SELECT t_id AS id, any_value(t_label) AS label, any_value(t_complexity) AS complexity, count(*) AS callers, any_value(t_complexity) * count(*) AS risk FROM h WHERE type = 'calls' AND t_type = 'function' GROUP BY t_id ORDER BY 5 DESC NULLS LAST, 1 LIMIT 10")
_add("shared_interfaces", _joined(patterns.shared_interfaces, "structs"), f"SELECT t_id AS id, any_value(t_label) AS interface, count(*) AS implementers, {_set('s_label')} AS structs FROM h WHERE type = 'implements' AND t_type = 'interface' GROUP BY t_id HAVING count(*) > 1")
_add("package_dependencies", patterns.package_dependencies, "SELECT s_id AS id, any_value(s_label) AS package, count(*) AS dependencies FROM h WHERE type = 'imports' AND s_type = 'package' GROUP BY s_id ORDER BY 3 DESC, 1 LIMIT 15")
_add(
    "coupling",
    patterns.coupling,
    f""", im AS (SELECT DISTINCT regexp_replace(source, '^package:', '') AS a, regexp_replace(target, '^package:', '') AS b FROM ea WHERE type = 'imports' AND regexp_replace(source, '^package:', '') <> regexp_replace(target, '^package:', '')),
pk AS (SELECT DISTINCT package FROM n WHERE type = 'package'), ty AS (SELECT package, count(*) AS t, sum(CASE WHEN type = 'interface' THEN 1 ELSE 0 END) AS a FROM n WHERE type IN {TYPES} GROUP BY 1),
x AS (SELECT pk.package, (SELECT count(*) FROM im WHERE im.b = pk.package) AS ca, (SELECT count(*) FROM im WHERE im.a = pk.package) AS ce FROM pk)
SELECT x.package, ca AS afferent, ce AS efferent, CASE WHEN ca + ce > 0 THEN round(ce / (ca + ce), 6) END AS instability, round(a / t, 6) AS abstractness FROM x LEFT JOIN ty ON ty.package = x.package""",
)
_add("dead_functions", patterns.dead_functions, "SELECT id, label, package FROM n WHERE type = 'function' AND visibility = 'private' AND label NOT IN ('main', 'init') AND id NOT IN (SELECT target FROM e WHERE type = 'calls')")
_add("unconstructed_structs", patterns.unconstructed_structs, "SELECT id, label, package FROM n WHERE type = 'struct' AND id NOT IN (SELECT target FROM e WHERE type = 'constructs')")
_add("unused_private", patterns.unused_private, "SELECT id, label, type, package FROM n WHERE type IN ('function', 'method', 'struct') AND visibility = 'private' AND NOT contains(label, 'Test') AND label NOT IN ('main', 'init') AND id NOT IN (SELECT target FROM e WHERE type IN ('calls', 'uses', 'constructs'))")
_add("orphan_nodes", patterns.orphan_nodes, "SELECT id, label, type FROM n WHERE id NOT IN (SELECT source FROM ea UNION ALL SELECT target FROM ea)")
_add("viewer_overview", patterns.viewer_overview, "SELECT count(*) AS nodes, sum(CASE WHEN type = 'package' THEN 1 ELSE 0 END)::BIGINT AS packages, round(avg(CASE WHEN coalesce(complexity, 1) > 0 THEN coalesce(complexity, 1) END), 1) AS \"avgComplexity\", (SELECT count(*) FROM e) AS edges FROM n")
_add("type_histogram", patterns.type_histogram, "SELECT type, count(*) AS \"count\", round(count(*) / max(count(*)) OVER (), 6) AS height FROM n GROUP BY type")
_add("complexity_buckets", patterns.complexity_buckets, f"SELECT CASE WHEN c <= 2 THEN '1-2' WHEN c <= 5 THEN '3-5' WHEN c <= 10 THEN '6-10' WHEN c <= 20 THEN '11-20' ELSE '>20' END AS bucket, count(*) AS \"count\" FROM (SELECT coalesce(complexity, 1) AS c FROM n WHERE type IN {FUNC}) GROUP BY 1")
_add("top_degree", patterns.top_degree, "SELECT id, count(*) AS degree FROM (SELECT source AS id FROM e UNION ALL SELECT target FROM e WHERE source <> target) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
VISIBLE = "SELECT id FROM n WHERE type IN ('package', 'struct', 'interface') AND coalesce(visibility, 'public') = 'public'"
_add("node_filter", patterns.node_filter, f"SELECT id, label, type FROM n WHERE id IN ({VISIBLE})")
_add("induced_edges", patterns.induced_edges, f"SELECT type, count(*) AS edges FROM e WHERE source IN ({VISIBLE}) AND target IN ({VISIBLE}) GROUP BY 1")
KEPT = f"SELECT id FROM n WHERE type IN ('package', 'struct', 'interface') OR (type IN {FUNC} AND visibility = 'public' AND complexity >= 3)"
_add("perf_filter", patterns.perf_filter, f"SELECT (SELECT count(*) FROM ({KEPT})) AS nodes, (SELECT count(*) FROM e WHERE type IN ('imports', 'implements', 'embeds', 'calls', 'has_method', 'constructs') AND source IN ({KEPT}) AND target IN ({KEPT})) AS edges")
_add("without_fields", patterns.without_fields, "SELECT (SELECT count(*) FROM n WHERE type <> 'field') AS nodes, (SELECT count(*) FROM ea WHERE type <> 'has_field') AS edges")

# ---- impact
IS = lambda name, p="t": f"({p}.id = '{name}' OR {p}.full_name = '{name}' OR {p}.label = '{name}')"
_broken = "CASE h.type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in impact.IMPACT_NAMES.items()) + f" ELSE '{impact.OTHER_IMPACT}' END"
_kinds = lambda ts: "(" + ", ".join(f"'{t}'" for t in ts) + ")"
_hit = lambda name, p: f"{p}_id IN (SELECT t.id FROM n t WHERE {IS(name)})"
_add("impact_delete", lambda g: impact.impact_delete(g, COMPONENT), f"SELECT DISTINCT s_id AS \"affectedNode\", s_type AS \"nodeType\", s_label AS name, s_package AS package, h.type AS dependency_type, {_broken} AS impact_type FROM h WHERE h.type IN {_kinds(impact.DELETE_TYPES)} AND {_hit(COMPONENT, 't')} ORDER BY \"nodeType\", dependency_type, \"affectedNode\" LIMIT 50")
AROUND = ", w AS (SELECT u.source, u.type AS type, t.id, t.type AS node_type, t.label, t.package FROM u JOIN n s ON s.id = u.source JOIN n t ON t.id = u.target)"
_near = lambda name: f"w.source IN (SELECT t.id FROM n t WHERE {IS(name)})"
_add("impact_general", lambda g: impact.impact_general(g, COMPONENT), AROUND + f" SELECT DISTINCT id AS \"relatedNode\", node_type AS \"nodeType\", label AS name, package, type AS relationship_type FROM w WHERE type IN {_kinds(impact.GENERAL_TYPES)} AND {_near(COMPONENT)} ORDER BY \"nodeType\", \"relatedNode\", relationship_type LIMIT 50")
_add("find_implementers", impact.find_implementers, "SELECT DISTINCT s_full_name AS implementer, s_package AS package, s_label AS name, t_full_name AS interface FROM h WHERE type = 'implements' AND s_type = 'struct' AND t_type = 'interface'")
_add("neighbourhood", lambda g: impact.neighbourhood(g, COMPONENT), AROUND + f" SELECT DISTINCT id AS neighbour, label, type AS relationship FROM w WHERE source = '{COMPONENT}'")
_add("incident_types", lambda g: impact.incident_types(g, COMPONENT), AROUND + f" SELECT type, count(*) AS edges FROM w WHERE {_near(COMPONENT)} GROUP BY 1")
_add("component_callers", lambda g: impact.component_callers(g, HOT), f"SELECT DISTINCT s_id AS caller, s_package AS package, t_id AS callee FROM h WHERE type = 'calls' AND ({_hit(HOT, 't')} OR ends_with(t_full_name, '.{HOT}'))")
_add("interface_impact", lambda g: impact.interface_impact(g, TYPE_NAME), AROUND + f" SELECT DISTINCT id AS related, node_type AS \"nodeType\", type AS relationship FROM w WHERE type IN ('implements', 'uses', 'parameter_type', 'returns') AND w.source IN (SELECT t.id FROM n t WHERE t.type = 'interface' AND {IS(TYPE_NAME)})")
_add("type_dependents", lambda g: impact.type_dependents(g, TYPE_NAME), f"SELECT DISTINCT s_id AS dependent, s_type AS \"nodeType\", type AS relationship FROM h WHERE type IN ('uses', 'parameter_type', 'returns', 'field_type', 'embeds', 'constructs') AND {_hit(TYPE_NAME, 't')}")
_add("forward_imports", lambda g: impact.forward_imports(g, "store"), "SELECT DISTINCT s_package AS package, t_package AS imports FROM h WHERE type = 'imports' AND contains(s_package, 'store') AND s_package <> t_package")
_add("reverse_imports", lambda g: impact.reverse_imports(g, PACKAGE), f"SELECT DISTINCT s_package AS importer, t_package AS package FROM h WHERE type = 'imports' AND contains(t_package, '{PACKAGE}') AND s_package <> t_package")
_add("interface_returners", impact.interface_returners, "SELECT DISTINCT s_id AS \"function\", s_signature AS signature, t_label AS interface FROM h WHERE type = 'returns' AND t_type = 'interface'")
_add("interface_takers", impact.interface_takers, "SELECT DISTINCT s_id AS \"function\", s_signature AS signature, t_label AS interface FROM h WHERE type = 'parameter_type' AND t_type = 'interface'")
_add("test_callers", lambda g: impact.test_callers(g, "Check"), "SELECT t_id AS tested, count(DISTINCT s_id) AS tests FROM h WHERE type = 'calls' AND starts_with(lower(s_label), 'check') GROUP BY 1")
_add("public_functions", impact.public_functions, f"SELECT id, label, package, complexity, signature FROM n WHERE type IN {FUNC} AND visibility = 'public'")
_add("dependency_suffix", impact.dependency_suffix, "SELECT DISTINCT s_package AS importer FROM h WHERE type = 'imports' AND ends_with(t_package, '/common')")

# ---- paths
CALLS = f", c AS (SELECT DISTINCT source, target FROM e WHERE type = 'calls'), f AS (SELECT id, label, full_name FROM n WHERE type IN {FUNC}), fc AS (SELECT * FROM c WHERE source IN (SELECT id FROM f) AND target IN (SELECT id FROM f))"
_add("trace_distances", lambda g: paths.distances_to(g, HOT), CALLS + f", r AS (SELECT id AS fin, id AS node, 0 AS d FROM f WHERE label = '{HOT}' OR full_name = '{HOT}' UNION SELECT r.fin, fc.source, r.d + 1 FROM r JOIN fc ON fc.target = r.node WHERE r.d < 10) SELECT node AS id, min(d) AS length FROM r WHERE node <> fin GROUP BY 1")
_add("call_cycles", paths.on_cycles, CALLS + ", l AS (SELECT * FROM c WHERE source <> target), w AS (SELECT source AS v, target AS node, 1 AS d FROM l UNION SELECT w.v, l.target, w.d + 1 FROM w JOIN l ON l.source = w.node WHERE w.d < 5) SELECT DISTINCT v AS id FROM w WHERE v = node AND d BETWEEN 2 AND 5 UNION SELECT source FROM e WHERE type = 'calls' AND source = target GROUP BY 1 HAVING count(*) > 1")
_add("import_cycles", lambda g: paths.on_cycles(g, "imports"), ", l AS (SELECT DISTINCT source, target FROM e WHERE type = 'imports' AND source <> target), w AS (SELECT source AS v, target AS node, 1 AS d FROM l UNION SELECT w.v, l.target, w.d + 1 FROM w JOIN l ON l.source = w.node WHERE w.d < 5) SELECT DISTINCT v AS id FROM w WHERE v = node AND d BETWEEN 2 AND 5 UNION SELECT source FROM e WHERE type = 'imports' AND source = target GROUP BY 1 HAVING count(*) > 1")
_add("import_chains", paths.import_chains, ", l AS (SELECT DISTINCT source, target FROM e WHERE type = 'imports'), w AS (SELECT source AS v, target AS node, 1 AS d FROM l UNION SELECT w.v, l.target, w.d + 1 FROM w JOIN l ON l.source = w.node WHERE w.d < 6) SELECT v AS start, node AS \"end\", d AS length FROM w WHERE d >= 3 AND v <> node ORDER BY 3 DESC, 1, 2 LIMIT 10")
_add(
    "reachability",
    lambda g: paths.reachable(g, F.lower("label").startswith("check") & F.col("type").isin("function", "method"), F.col("label").contains("Wrapf"), 5).drop("path"),
    CALLS + f", r AS (SELECT id AS s, id AS node, 0 AS d FROM n WHERE type IN {FUNC} AND starts_with(lower(label), 'check') UNION SELECT r.s, c.target, d + 1 FROM r JOIN c ON c.source = r.node WHERE d < 5), m AS (SELECT s, node, min(d) AS d FROM r GROUP BY 1, 2) SELECT s AS start, m.node, d AS distance FROM m JOIN n ON n.id = m.node WHERE d > 0 AND contains(n.label, 'Wrapf')",
)
_add(
    "impact_transitive",
    lambda g: paths.impact_transitive(g, COMPONENT, 5),
    f", l AS (SELECT DISTINCT source, target FROM e WHERE type IN {_kinds(impact.DELETE_TYPES)}), r AS (SELECT id AS node, 0 AS d FROM n t WHERE {IS(COMPONENT)} UNION SELECT l.source, d + 1 FROM r JOIN l ON l.target = r.node WHERE d < 5), m AS (SELECT node, min(d) AS d FROM r GROUP BY 1) SELECT node AS id, d AS distance FROM m WHERE d > 0",
)


def _trace(g: CodeGraph) -> DataFrame:
    """From the name that is farthest from the hot function to it."""
    far = paths.distances_to(g, HOT).orderBy(F.desc("length"), "id").join(g.nodes.select("id", "full_name"), "id").orderBy(F.desc("length"), "id").first()
    found = paths.trace_call_path(g, far["full_name"] if far else HOT, HOT)
    return found.select("start", "end", F.array_join("labels", " > ").alias("labels"), "length")


_add(
    "trace_call_path",
    _trace,
    # distances to each node of the name, then from the farthest a walk that always takes the least next id
    CALLS
    + f""", r AS (SELECT id AS fin, id AS node, 0 AS d FROM f WHERE label = '{HOT}' OR full_name = '{HOT}' UNION SELECT r.fin, fc.source, r.d + 1 FROM r JOIN fc ON fc.target = r.node WHERE r.d < 10),
m AS (SELECT fin, node, min(d) AS d FROM r GROUP BY 1, 2),
far AS (SELECT full_name FROM (SELECT node, min(d) AS d FROM m WHERE node <> fin GROUP BY 1) x JOIN n ON n.id = node ORDER BY d DESC, node LIMIT 1),
s AS (SELECT id AS start FROM f WHERE full_name = (SELECT full_name FROM far) OR label = (SELECT full_name FROM far)),
p AS (SELECT start, fin, d AS length FROM s JOIN m ON m.node = s.start WHERE d > 0 ORDER BY d, start, fin LIMIT 5),
hop AS (SELECT m.fin, c.source, m.d + 1 AS d, min(c.target) AS target FROM fc c JOIN m ON m.node = c.target JOIN m o ON o.fin = m.fin AND o.node = c.source AND o.d = m.d + 1 GROUP BY 1, 2, 3),
w AS (SELECT start, fin, length, start AS node, length AS left_, (SELECT label FROM n WHERE n.id = start) AS labels FROM p
  UNION ALL SELECT w.start, w.fin, w.length, hop.target, w.left_ - 1, w.labels || ' > ' || n.label FROM w JOIN hop ON hop.fin = w.fin AND hop.source = w.node AND hop.d = w.left_ JOIN n ON n.id = hop.target WHERE w.left_ > 0)
SELECT start, fin AS "end", labels, length FROM w WHERE left_ = 0""",
)

# ---- search
SCORE = f"CASE WHEN lower(label) = '{TERM}' THEN 100 ELSE 0 END + CASE WHEN starts_with(lower(label), '{TERM}') THEN 50 ELSE 0 END + CASE WHEN lower(type) = '{TERM}' THEN 80 ELSE 0 END + 2 * CASE WHEN coalesce(complexity, 0) = 0 THEN 1 ELSE complexity END + CASE WHEN coalesce(size, 0) = 0 THEN 1 ELSE size END"
MATCH = f"(contains(lower(label), '{TERM}') OR contains(lower(type), '{TERM}') OR contains(lower(package), '{TERM}') OR contains(lower(signature), '{TERM}'))"
_add("search_scores", lambda g: search.search_scores(g, TERM), f"SELECT id, label, {SCORE} AS score FROM n WHERE {MATCH}")
_add("search", lambda g: search.search(g, TERM), f"SELECT id, label, {SCORE} AS score FROM n WHERE {MATCH} ORDER BY 3 DESC, 1 LIMIT 10")
_add("fulltext", lambda g: search.fulltext(g, "snapshot merge"), "SELECT id, label, type FROM n WHERE contains(lower(concat_ws(' ', label, full_name, semantic_summary)), 'snapshot') AND contains(lower(concat_ws(' ', label, full_name, semantic_summary)), 'merge')")


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The vector asked for: that of the least vec_id."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").first()["embedding"]


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search.vector_topk(rows, "vec_id", "embedding", _query_vector(spark, sf_dir), 10).withColumn("score", F.round("score", 6))


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/existing_nodes.parquet")
    found = search.hybrid_search(CodeGraph.cleaned(spark, sf_dir), vectors, _query_vector(spark, sf_dir))
    related = F.array_sort(F.transform("related", lambda x: F.concat_ws("|", x["id"], x["label"], x["type"], x["relationship"])))
    return found.withColumns({"score": F.round("score", 6), "related": F.array_join(related, ",")})


QUERIES["vector_topk"], QUERIES["hybrid_search"] = vector_topk, hybrid_search
COSINE = "round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)::DOUBLE[]), 6)"
SQL["vector_topk"] = f"SELECT vec_id AS id, {COSINE} AS score FROM embeddings ORDER BY 2 DESC, 1 LIMIT 10"

NEAR = f"""SELECT id, max(score) AS score FROM (SELECT id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)::DOUBLE[]) AS score FROM existing_nodes
  WHERE len(embedding) = (SELECT len(embedding) FROM embeddings ORDER BY vec_id LIMIT 1)) WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""
SQL["hybrid_search"] = (
    BASE
    + f""", best AS ({NEAR}), m AS (SELECT u.source AS id, concat_ws('|', o.id, o.label, o.type, u.type) AS r FROM u JOIN n o ON o.id = u.target WHERE u.source IN (SELECT id FROM best)),
a AS (SELECT id, array_to_string(list_sort(list(DISTINCT r)), ',') AS related, count(*) AS connectivity FROM m GROUP BY 1)
SELECT n.id, n.label, n.type, n.package, round(best.score, 6) AS score, coalesce(a.related, '') AS related, coalesce(a.connectivity, 0) AS connectivity FROM best JOIN n ON n.id = best.id LEFT JOIN a ON a.id = best.id"""
)

# ---- text and hashes


def clean_documentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.col("text").isNotNull())
    return d.select("doc_id", summaries.clean_documentation(F.col("text")).alias("doc"))


def workspace_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = spark.read.parquet(f"{sf_dir}/workspaces.parquet")
    return w.select("name", summaries.workspace_name(F.lit(None).cast("string"), F.col("path")).alias("identifier"))


def rel_names(g: CodeGraph) -> DataFrame:
    return g.edges.select("type").distinct().select("type", summaries.rel_name(F.col("type")).alias("rel"))


def hash_nodes(g: CodeGraph) -> DataFrame:
    f = g.of("function", "method", "struct", "interface")
    return f.select("id", summaries.content_hash().alias("content_hash"), summaries.semantic_hash(F.col("semantic_summary")).alias("semantic_hash"))


def called_lists(g: CodeGraph) -> DataFrame:
    r = summaries.related_labels(g)
    return r.select(F.col("sid").alias("id"), summaries.summarize_list(F.col("l_calls")).alias("calls"))


QUERIES["clean_documentation"], QUERIES["workspace_names"] = clean_documentation, workspace_names
#: d0 (id, one) to d3 (id, doc): whole characters that fit in 200 bytes, cut after the last full stop before a blank
CLEAN = """d1 AS (SELECT id, one, strlen(one) AS bytes, left(one, 200) AS front FROM d0),
d2 AS (SELECT *, left(front, list_max(list_filter(range(0, 201), lambda k: strlen(left(front, k)) <= 200))) AS head, left(front, list_max(list_filter(range(0, 201), lambda k: strlen(left(front, k)) <= 197))) AS short FROM d1),
d3 AS (SELECT id, CASE WHEN bytes <= 200 THEN one WHEN strpos(reverse(head), ' .') > 0 AND length(head) - strpos(reverse(head), ' .') > 1 THEN left(head, length(head) - strpos(reverse(head), ' .')) ELSE short || '...' END AS doc FROM d2)"""
SQL["clean_documentation"] = f"WITH d0 AS (SELECT doc_id AS id, trim(regexp_replace(text, '[ \\n\\t\\r]+', ' ', 'g')) AS one FROM documents WHERE text IS NOT NULL), {CLEAN} SELECT id AS doc_id, doc FROM d3"
SQL["workspace_names"] = "SELECT name, CASE WHEN c = '' THEN 'workspace' WHEN regexp_matches(c, '^[0-9]') THEN 'ws_' || c ELSE c END AS identifier FROM (SELECT name, regexp_replace(coalesce(list_extract(string_split(regexp_replace(path, '/+$', ''), '/'), -1), ''), '[^A-Za-z0-9_-]', '_', 'g') AS c FROM workspaces)"
_add("rel_names", rel_names, "SELECT DISTINCT type, array_to_string([upper(w[1]) || w[2:] for w in string_split(type, '_')], '') AS rel FROM ea")
_add("hash_nodes", hash_nodes, "SELECT id, sha256(concat_ws('|', coalesce(signature, ''), type, coalesce(visibility, ''), coalesce(size::VARCHAR, ''), coalesce(complexity::VARCHAR, ''), coalesce(position.filename, ''))) AS content_hash, sha256(coalesce(semantic_summary, '')) AS semantic_hash FROM n WHERE type IN ('function', 'method', 'struct', 'interface')")
_add("called_lists", called_lists, ", l AS (SELECT source, list_sort(list(DISTINCT CASE WHEN e.type = 'calls' THEN n.label END)) AS c FROM e JOIN n ON n.id = e.target WHERE e.type IN ('calls', 'uses', 'returns', 'implements', 'handles_error', 'spawns_goroutine') GROUP BY 1), k AS (SELECT source, [x for x in c if x IS NOT NULL] AS c FROM l) SELECT source AS id, CASE WHEN len(c) <= 5 THEN array_to_string(c, ', ') ELSE array_to_string(c[1:5], ', ') || ' and ' || (len(c) - 5)::VARCHAR || ' more' END AS calls FROM k")
LISTED = "CASE WHEN len({0}) <= 5 THEN array_to_string({0}, ', ') ELSE array_to_string({0}[1:5], ', ') || ' and ' || (len({0}) - 5) || ' more' END"
CALLED = "type IN ('function', 'method')"
_add(
    "semantic_summary",
    summaries.semantic_summaries,
    f""", d0 AS (SELECT id, trim(regexp_replace(coalesce(documentation, ''), '[ \\n\\t\\r]+', ' ', 'g')) AS one FROM n), {CLEAN},
l AS (SELECT source, """
    + ", ".join(f"list_sort(list(DISTINCT n.label) FILTER (e.type = '{k}')) AS {k}" for k in ("calls", "uses", "returns", "implements"))
    + f""", bool_or(e.type = 'handles_error') AS errors, bool_or(e.type = 'spawns_goroutine') AS spawns FROM e JOIN n ON n.id = e.target WHERE e.type IN ('calls', 'uses', 'returns', 'implements', 'handles_error', 'spawns_goroutine') GROUP BY 1),
t AS (SELECT n.*, concat_ws('. ', concat_ws(' ', type, label, 'in', coalesce(package, '')), nullif(doc, ''), CASE WHEN {CALLED} THEN nullif(signature, '') END, 'calls: ' || CASE WHEN len(calls) > 0 THEN {LISTED.format('calls')} END,
  'uses: ' || CASE WHEN len(uses) > 0 THEN {LISTED.format('uses')} END, 'returns: ' || CASE WHEN len("returns") > 0 THEN array_to_string("returns", ', ') END, 'implements: ' || CASE WHEN len(implements) > 0 THEN array_to_string(implements, ', ') END,
  CASE WHEN errors THEN 'handles errors' END, CASE WHEN spawns THEN 'spawns goroutines' END, CASE WHEN {CALLED} AND complexity > 10 THEN 'complexity ' || complexity END) AS summary
  FROM n LEFT JOIN l ON l.source = n.id JOIN d3 USING (id) WHERE type IN ('function', 'method', 'struct', 'interface'))
SELECT id, summary, sha256(summary) AS semantic_hash, sha256(concat_ws('|', coalesce(signature, ''), type, coalesce(visibility, ''), coalesce(size::VARCHAR, ''), coalesce(complexity::VARCHAR, ''), coalesce(position.filename, ''))) AS content_hash FROM t""",
)

# ---- merging: the first and last snapshot of every workspace as old and new store


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = spark.read.parquet(f"{sf_dir}/node_snapshots.parquet").where("workspace IS NOT NULL AND snapshot_no IS NOT NULL")
    ends = rows.groupBy(F.col("workspace").alias("w")).agg(F.min("snapshot_no").alias("lo"), F.max("snapshot_no").alias("hi"))
    state = rows.join(ends, F.col("workspace") == F.col("w")).withColumn("id", stripped(F.col("id"))).where("id <> ''")
    pick = state.groupBy("id", "snapshot_no", "lo", "hi").agg(F.max(F.struct("loaded_at", canonical_hex(F.col("semantic_hash")).alias("h"))).alias("s"))
    pick = pick.select("id", "snapshot_no", "lo", "hi", F.col("s.h").alias("semantic_hash"), F.split_part("id", F.lit(":"), F.lit(1)).alias("type"), F.lit(None).cast("timestamp").alias("created_at")).where("semantic_hash IS NOT NULL")
    cols = ["id", "type", "semantic_hash", "created_at"]
    return pick.where("snapshot_no = lo").select(*cols), pick.where("snapshot_no = hi").select(*cols)


def merge_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _snapshots(spark, sf_dir)
    return merge.merge_nodes(old, new.drop("created_at"), F.lit("2026-01-01").cast("timestamp")).select("id", "type", "status", "stale")


def stale_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _snapshots(spark, sf_dir)
    return merge.stale_preview(merge.merge_nodes(old, new.drop("created_at"), F.lit("2026-01-01").cast("timestamp")))


def merge_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which ids of the last snapshots keep a stored vector and which need a new one."""
    _, new = _snapshots(spark, sf_dir)
    stored = spark.read.parquet(f"{sf_dir}/existing_nodes.parquet").where("id IS NOT NULL").withColumn("semantic_hash", canonical_hex(F.col("semantic_hash")))
    stored = stored.groupBy("id").agg(F.max(F.struct("last_seen", "semantic_hash", "embedding", "embedding_model")).alias("s")).select("id", "s.semantic_hash", "s.embedding", "s.embedding_model")
    out = merge.delta_embeddings(new.select("id", "type", "semantic_hash"), merge.existing_info(stored))
    return out.groupBy("type", "regenerate").agg(F.count(F.lit(1)).alias("ids"))


QUERIES |= {"merge_status": merge_status, "stale_preview": stale_preview, "merge_embeddings": merge_embeddings}
HEX = r"nullif(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(semantic_hash, '^\s+|\s+$', '', 'g')), '^[a-z0-9_-]+:', ''), '^0x', ''), '[\s:-]+', '', 'g'), '')"
SNAP = rf"""
WITH r AS (SELECT workspace, snapshot_no, loaded_at, regexp_replace(id, '^\s+|\s+$', '', 'g') AS id, {HEX} AS h FROM node_snapshots WHERE workspace IS NOT NULL AND snapshot_no IS NOT NULL),
b AS (SELECT workspace, min(snapshot_no) AS lo, max(snapshot_no) AS hi FROM r GROUP BY 1),
p AS (SELECT r.*, lo, hi, row_number() OVER (PARTITION BY id, snapshot_no, lo, hi ORDER BY loaded_at DESC NULLS LAST, h DESC NULLS LAST) AS rn FROM r JOIN b USING (workspace) WHERE id <> ''),
o AS (SELECT id, h FROM p WHERE rn = 1 AND snapshot_no = lo AND h IS NOT NULL), w AS (SELECT id, h FROM p WHERE rn = 1 AND snapshot_no = hi AND h IS NOT NULL),
m AS (SELECT coalesce(w.id, o.id) AS id, CASE WHEN o.id IS NULL THEN 'created' WHEN w.id IS NULL THEN 'stale' ELSE 'updated' END AS status FROM o FULL JOIN w ON o.id = w.id)
"""
SQL["merge_status"] = SNAP + "SELECT id, split_part(id, ':', 1) AS type, status, status = 'stale' AS stale FROM m"
SQL["stale_preview"] = SNAP + "SELECT split_part(id, ':', 1) AS type, count(*) AS \"count\" FROM m WHERE status = 'stale' GROUP BY 1"
SQL["merge_embeddings"] = (
    SNAP
    + rf""", s AS (SELECT id, {HEX} AS h, embedding, row_number() OVER (PARTITION BY id ORDER BY last_seen DESC NULLS LAST, {HEX} DESC NULLS LAST) AS k FROM existing_nodes WHERE id IS NOT NULL),
j AS (SELECT split_part(w.id, ':', 1) AS type, coalesce(NOT (s.h = w.h AND len(s.embedding) > 0), true) AS regenerate FROM w LEFT JOIN s ON s.id = w.id AND s.k = 1 AND s.h IS NOT NULL)
SELECT type, regenerate, count(*) AS ids FROM j GROUP BY 1, 2"""
)

# ---- Cypher and SQL texts, as users write them


def _cypher(name: str, text: str, sql: str) -> None:
    _add(name, lambda g: run_cypher(g, text), sql)


_cypher("cypher_usage", "MATCH (a)-[:RELATES_TO {type: 'calls'}]->(t:CodeNode) WITH t, count(*) AS n WHERE n > 1 RETURN t.id AS id, n", "SELECT t_id AS id, count(*) AS n FROM h WHERE type = 'calls' GROUP BY 1 HAVING count(*) > 1")
_cypher("cypher_unused_private", "MATCH (f:CodeNode {type: 'function', visibility: 'private'}) WHERE NOT (f)<-[:RELATES_TO {type: 'calls'}]-() RETURN f.id AS id", "SELECT id FROM n WHERE type = 'function' AND visibility = 'private' AND id NOT IN (SELECT target FROM e WHERE type = 'calls')")
_cypher(
    "cypher_interface_counts",
    "MATCH (i:CodeNode {type: 'interface'}) OPTIONAL MATCH (s)-[:RELATES_TO {type: 'implements'}]->(i) RETURN i.id AS id, count(s) AS n",
    "SELECT n.id, count(e.source) AS n FROM n LEFT JOIN e ON e.target = n.id AND e.type = 'implements' WHERE n.type = 'interface' GROUP BY 1",
)
_cypher("cypher_incident", "MATCH (a:CodeNode {type: 'package'})-[r]-(b) RETURN a.id AS id, r.type AS kind, count(DISTINCT b.id) AS n", ", w AS (SELECT u.source, u.target, u.type FROM u WHERE source IN (SELECT id FROM n WHERE type = 'package') AND target IN (SELECT id FROM n)) SELECT source AS id, type AS kind, count(DISTINCT target) AS n FROM w GROUP BY 1, 2")
_cypher("cypher_two_hops", "MATCH (p:CodeNode {type: 'struct'})-[:RELATES_TO {type: 'has_method'}]->(m)-[:RELATES_TO {type: 'has_parameter'}]->(x) RETURN p.id AS id, count(*) AS n", "SELECT a.s_id AS id, count(*) AS n FROM h a JOIN h b ON b.s_id = a.t_id WHERE a.type = 'has_method' AND a.s_type = 'struct' AND b.type = 'has_parameter' GROUP BY 1")
_add(
    "sql_query",
    lambda g: sql_query(g, "SELECT n.package, count(*) AS calls FROM {edges} e JOIN {nodes} n ON n.id = e.source WHERE e.type = :kind GROUP BY n.package", {"kind": "calls"}),
    "SELECT n.package, count(*) AS calls FROM ea e JOIN n ON n.id = e.source WHERE e.type = 'calls' GROUP BY 1",
)

# ---- streams and sources


def stream_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges by type and month, kept by a stream over the files of the edge table until they are all read."""
    schema = spark.read.parquet(f"{sf_dir}/edges.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/edges.parq*")
    typed = stream.select(F.date_trunc("month", "created_at").alias("month"), canonical_type(F.col("type")).alias("type")).groupBy("month", "type").agg(F.count(F.lit(1)).alias("edges"))
    name = f"counts_{uuid.uuid4().hex}"
    run = typed.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", Scratch(spark, "stream").path()).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name)


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges by day and type of a stream with event-time windows and a watermark wide enough for all late rows."""
    stream = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/edges.parquet").schema).parquet(f"{sf_dir}/edges.parq*")
    name = f"windows_{uuid.uuid4().hex}"
    run = edge_counts(stream, "1 day", "36500 days").writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", Scratch(spark, "stream").path()).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name).select(F.col("window.start").cast("timestamp_ntz").alias("day"), "type", "edges")


def go_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of all source files by package and type."""
    files = spark.read.parquet(f"{sf_dir}/source_files.parquet").groupBy("package", "filename").agg(F.max_by("content", "file_id").alias("content"))
    nodes = Extraction(facts(files)).nodes()
    return nodes.where("package <> 'builtin'").groupBy("package", "type").agg(F.count(F.lit(1)).alias("nodes"))


def go_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = spark.read.parquet(f"{sf_dir}/source_files.parquet").groupBy("package", "filename").agg(F.max_by("content", "file_id").alias("content"))
    return Extraction(facts(files)).edges().groupBy("type").agg(F.count(F.lit(1)).alias("edges"))


def go_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions and methods that the Go reader finds in every file."""
    files = spark.read.parquet(f"{sf_dir}/source_files.parquet").where("content IS NOT NULL")
    found = facts(files.select("package", "filename", "content", "file_id").groupBy("package", "filename").agg(F.max_by("content", "file_id").alias("content"))).where("kind = 'func'")
    return found.groupBy("package", "filename").agg(F.count(F.when(F.col("type_name") == "function", 1)).alias("functions"), F.count(F.when(F.col("type_name") == "method", 1)).alias("methods"))


def mock_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = CodeGraph.cleaned(spark, sf_dir).nodes
    return embedded_nodes(nodes, mock_provider(64)).select("id", F.size("embedding").alias("dimensions"))


QUERIES |= {"stream_type_counts": stream_type_counts, "stream_windows": stream_windows, "go_extract": go_extract, "go_edges": go_edges, "go_functions": go_functions, "mock_embedding": mock_vectors}
SQL["stream_type_counts"] = f"SELECT date_trunc('month', created_at)::TIMESTAMP AS month, {KIND} AS type, count(*) AS edges FROM edges GROUP BY 1, 2"
SQL["stream_windows"] = rf"SELECT date_trunc('day', created_at)::TIMESTAMP AS day, {KIND} AS type, count(*) AS edges FROM edges WHERE created_at IS NOT NULL AND regexp_matches(target, '\S') GROUP BY 1, 2"
SQL["mock_embedding"] = BASE + "SELECT id, CASE WHEN semantic_summary <> '' THEN 64 END AS dimensions FROM n WHERE type IN ('function', 'method', 'struct', 'interface')"
#: lines that begin a function outside comments and raw strings, in the last delivery of each file
SQL["go_functions"] = r"""
WITH x AS (SELECT package, filename, file_id, string_split(replace(replace(arg_max(content, file_id), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS l
  FROM (SELECT package, filename, content, file_id FROM source_files WHERE content IS NOT NULL) GROUP BY ALL),
y AS (SELECT package, filename, arg_max(l, file_id) AS l FROM x GROUP BY 1, 2),
r0 AS (SELECT package, filename, unnest(l) AS s, generate_subscripts(l, 1) AS n FROM y),
r1 AS (SELECT *, regexp_replace(regexp_replace(s, '"(?:\\.|[^"\\])*"|''(?:\\.|[^''\\])*''', '_', 'g'), '//.*$', '') AS z FROM r0),
r AS (SELECT *, coalesce(sum(len(regexp_extract_all(z, '/\*')) - len(regexp_extract_all(z, '\*/'))) OVER w, 0) AS comments, coalesce(sum(len(regexp_extract_all(z, '`'))) OVER w, 0) % 2 AS raw
  FROM r1 WINDOW w AS (PARTITION BY package, filename ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT package, filename, count(*) FILTER (NOT regexp_matches(s, '^func\s*\(')) AS functions, count(*) FILTER (regexp_matches(s, '^func\s*\(')) AS methods FROM r WHERE regexp_matches(s, '^func\b') AND comments = 0 AND raw = 0 GROUP BY 1, 2"""
