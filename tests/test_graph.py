import pytest
from pyspark.sql import functions as F

from graphloom.graph import CodeGraph
from graphloom.operators import impact, paths, patterns, search, summaries
from graphloom.plans.cypher import CypherError, run_cypher
from graphloom.plans.prompts import PROMPTS
from graphloom.plans.router import find_patterns, name_part, route

#: a graph small enough to check by hand: f* functions, S a struct, I an interface
EDGES = [("f1", "f2", "calls"), ("f1", "f2", "Calls"), ("f2", "f3", "CALLS"), ("f3", "f1", "calls"), ("f3", "f4", "calls"), ("f4", "f4", "calls"), ("f1", "S", "constructs"), ("S", "I", "implements"), ("f2", "f2", "handles_error"), ("f1", "gone", "calls"), (None, "f1", "calls"), ("f1", " ", "calls")]


@pytest.fixture(scope="module")
def g(spark):
    nodes = [(f"f{i}", "w", f"Fn{i}", " FUNCTION" if i == 1 else "function", "p" if i < 4 else "q", "private" if i == 5 else "public", i, f"Fn{i}() error") for i in range(1, 6)]
    nodes += [("S", "w", "Store", "struct", "p", "public", 0, None), ("I", "w", "Sink", "Interface", "q", "public", 0, None), ("f1", "w", "Later", "function", "p", "public", 9, None)]
    n = spark.createDataFrame([(*x, i) for i, x in enumerate(nodes)], "id string, workspace string, label string, type string, package string, visibility string, complexity int, signature string, o int")
    n = n.withColumns({"full_name": F.concat_ws(".", "package", "label"), "created_at": F.timestamp_seconds(F.col("o")), "size": F.lit(3)})
    e = spark.createDataFrame([(*x, 1, "w", i) for i, x in enumerate([*EDGES])] + [("f1", "f2", "calls", 1, "w", 0)], "source string, target string, type string, weight int, workspace string, line int")
    return CodeGraph.from_tables(n, e)


def col(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_nodes_and_bag(g):
    assert g.nodes.count() == 7 and g.edges.count() == 10  # a repeated delivery counts once, a parallel edge stays
    assert col(g.nodes.where("id = 'f1'"), "label", "type") == [("Fn1", "function")]
    assert g.hop("calls").count() == 6 and g.workspace("none").nodes.count() == 0


def test_patterns(g):
    assert col(patterns.usage(g), "id", "usageCount") == [("f2", 2), ("f4", 2)]
    assert col(patterns.dead_functions(g), "id") == [("f5",)]
    assert col(patterns.most_connected(g), "id", "connections")[:4] == [("I", 1), ("S", 2), ("f1", 3), ("f2", 3)]
    assert col(patterns.error_handlers(g), "handledErrors", "errorTypeCount") == [(["Fn2"], 1)]
    assert col(patterns.orphan_nodes(g), "id") == [("f5",)]
    exact = {r["id"]: r for r in patterns.hotspots_exact(g, 0, -1, None).collect()}
    assert (exact["f3"]["inbound"], exact["f3"]["outbound"], exact["f3"]["risk"]) == (1, 2, 9)
    product = {r["id"]: r for r in patterns.hotspots_product(g, 0, -1, None).collect()}
    assert (product["f1"]["inbound"], product["f1"]["outbound"]) == (2, 2) and (product["f5"]["inbound"], product["f5"]["outbound"]) == (0, 0)
    assert patterns.factory_pattern(g.workspace("none")).count() == 0 and patterns.factory_pattern(g).first()["instances"] == 1
    assert patterns.parameter_type_pairs(g).count() == 0
    with pytest.raises(ValueError):
        find_patterns(g, "unheard of")


def test_lists_and_structs(g):
    """Sets come as arrays, pairs in them as structs; defaults are the thresholds of the documented questions."""
    made = patterns.type_constructors(g).first()
    assert [c.asDict() for c in made["constructors"]] == [{"name": c["name"], "package": c["package"]} for c in made["constructors"]]
    top = patterns.callers(g).first()
    assert top["callers"] == sorted(top["callers"]) and len(top["callers"]) == top["callerLabels"]
    assert patterns.hotspots_exact(g).count() == patterns.god_objects(g).count() == patterns.hot_functions(g).count() == 0


def test_prompt_steps_run(g):
    for p in PROMPTS.values():
        values = {a: "Fn2" for a in p.required} | {"change_type": "modify", "pattern": "orphan"}
        for why, df in p.run(g, **values):
            assert why and df.columns
    quality = PROMPTS["assess_code_quality"]
    assert [s.why for s in quality.chosen({"focus_area": "duplicates"})] == ["duplicates", "what matters here"] and len(quality.chosen({})) == 5
    inside = dict(PROMPTS["find_code_patterns"].run(g, workspace="w", pattern="orphan", package_filter="q"))["the pattern"]
    assert inside.columns and "include_external=yes" in PROMPTS["analyze_dependencies"].render(workspace="w", source_package="p", include_external="yes")


def test_paths(g):
    got = paths.trace_call_path(g, "Fn1", "Fn4").collect()
    assert [(r["path"], r["length"]) for r in got] == [(["p.Fn1", "p.Fn2", "p.Fn3", "q.Fn4"], 3)]
    assert paths.trace_call_path(g, "Fn4", "Fn1").count() == 0 and paths.trace_call_path(g, "Fn1", "Fn1").count() == 0
    assert col(paths.on_cycles(g), "id") == [("f1",), ("f2",), ("f3",)]
    assert col(paths.distances_to(g, "Fn4"), "id", "length") == [("f1", 3), ("f2", 2), ("f3", 1)]
    assert col(paths.path_nodes(g, "Fn1", "Fn3"), "label") == [("Fn1",), ("Fn2",), ("Fn3",)]
    assert ("f3", 2) in col(paths.impact_transitive(g, "Fn2", 3), "id", "distance")
    assert paths.path_goroutines(g, "Fn1", "Fn4").count() == 4


def test_reach_gives_paths(g):
    got = paths.reachable(g, F.col("label") == "Fn1", F.col("label").isin("Fn4", "Fn1"), 5).collect()
    assert [(r["node"], r["distance"], r["path"]) for r in got] == [("f4", 3, ["f1", "f2", "f3", "f4"])]


def test_impact(g):
    assert col(impact.impact_delete(g, "f2"), "affectedNode", "dependency_type") == [("f1", "calls")]
    assert col(impact.find_implementers(g, "Sink"), "name") == [("Store",)]
    assert ("S", "constructs") in col(impact.impact_general(g, "f1"), "relatedNode", "relationship_type")
    assert col(impact.neighbourhood(g, "f4"), "neighbour", "relationship") == [("f3", "calls"), ("f4", "calls")]


def test_search(g, spark):
    assert search.search(g, "fn2").first()["id"] == "f2" and search.search(g, "absent").count() == 0
    rows = spark.createDataFrame([("f1", [1.0, 0.0]), ("f2", [0.9, 0.1]), ("f3", [0.0, 0.0]), ("f4", None), ("f5", [1.0]), ("S", [float("nan"), 1.0])], "id string, embedding array<float>")
    assert [r["id"] for r in search.vector_topk(rows, "id", "embedding", [1.0, 0.0], 5).collect()] == ["f1", "f2"]
    found = {r["id"]: r["connectivity"] for r in search.hybrid_search(g, rows, [1.0, 0.0]).collect()}
    assert found == {"f1": 4, "f2": 4}


def test_summaries(g, spark):
    docs = [("a\n\tb  c", "a b c"), ("x" * 250, "x" * 197 + "..."), (("ab. " * 60), ("ab. " * 50)[:-1]), (None, "")]
    got = spark.createDataFrame(docs, "d string, want string").select(summaries.clean_documentation(F.col("d")).alias("g"), "want").collect()
    assert [r["g"] for r in got][:2] == [d[1] for d in docs][:2] and len(got[2]["g"].encode()) <= 200 and got[2]["g"].endswith(".")
    s = {r["id"]: r["summary"] for r in summaries.semantic_summaries(g).collect()}
    assert s["f2"] == "function Fn2 in p. Fn2() error. calls: Fn3. handles errors"
    names = [("my_function", "MyFunction"), ("123function", "Function"), ("", ""), ("a-b c", "ABC")]
    got = spark.createDataFrame(names, "n string, want string").select(summaries.rel_name(F.col("n")).alias("g"), "want").collect()
    assert all(r["g"] == r["want"] for r in got)
    w = spark.createDataFrame([("a.b/c/my.mod", "x", "my_mod"), (None, "/src/9lives/", "ws_9lives"), ("", "", "workspace")], "m string, d string, want string")
    assert all(r["g"] == r["want"] for r in w.select(summaries.workspace_name(F.col("m"), F.col("d")).alias("g"), "want").collect())


CYPHER = [
    ("MATCH (f:CodeNode {type: 'function', workspace: $workspace}) WHERE f.complexity > 2 RETURN f.label AS l ORDER BY f.complexity DESC LIMIT 2", [("Fn5",), ("Fn4",)]),
    ("MATCH (a)-[r:RELATES_TO {type: 'calls'}]->(b) WITH b, count(*) AS n WHERE n > 1 RETURN b.id AS i, n ORDER BY i", [("f2", 2), ("f4", 2)]),
    ("MATCH (f:CodeNode {type: 'function'}) WHERE NOT (f)<-[:RELATES_TO {type: 'calls'}]-() RETURN f.id", [("f5",)]),
    ("MATCH (f:CodeNode) WHERE f.type = 'function' AND NOT (f)-[:CALLS]->() RETURN f.id", [("f5",)]),
    ("MATCH p = shortestPath((a:CodeNode {label: 'Fn1'})-[:RELATES_TO*1..10 {type: 'calls'}]->(b:CodeNode {label: 'Fn4'})) WHERE all(r IN relationships(p) WHERE r.type = 'calls') RETURN [n IN nodes(p) | n.label] AS path, length(p) AS len", [(["Fn1", "Fn2", "Fn3", "Fn4"], 3)]),
    ("MATCH (f:CodeNode)-[:RELATES_TO*2..5 {type: 'calls'}]->(f) RETURN DISTINCT f.id AS i ORDER BY i", [("f1",), ("f2",), ("f3",)]),
    ("MATCH (i:CodeNode {type: 'interface'}) OPTIONAL MATCH (s)-[:RELATES_TO {type: 'implements'}]->(i) RETURN i.label AS l, count(s) AS n", [("Sink", 1)]),
    ("MATCH (s:CodeNode {id: 'f5'}) OPTIONAL MATCH (s)-[r]-(x) RETURN s.id AS i, x.id AS x, count(r) AS n", [("f5", None, 0)]),
    ("MATCH (n) WHERE n.id IN ['f4', 'S'] RETURN n.id AS i, CASE n.type WHEN 'struct' THEN 'T' ELSE 'F' END AS k ORDER BY i", [("S", "T"), ("f4", "F")]),
    ("MATCH (a {id: 'f1'})-[r]-(b) RETURN r.type AS t, collect(DISTINCT b.id) AS ids, count(*) AS n ORDER BY t", [("calls", ["f2", "f3"], 3), ("constructs", ["S"], 1)]),
    ("MATCH (a {id: 'f1'})-[:RELATES_TO {type: 'calls'}]->(b)-[:RELATES_TO {type: 'calls'}]->(c) RETURN count(*) AS n", [(2,)]),
    ("UNWIND [1, 2, 3] AS x WITH x WHERE x > 1 RETURN sum(x) AS s", [(5,)]),
    ("MATCH (a:Struct), (b:Interface) RETURN toLower(a.label) + '/' + b.label AS x, size(b.label) AS n", [("store/Sink", 4)]),
    ("MATCH (f) WHERE f.label STARTS WITH 'Fn' AND f.label ENDS WITH $end RETURN f.id AS i", [("f3",)]),
]


@pytest.mark.parametrize("text, want", CYPHER)
def test_cypher(g, text, want):
    got = [tuple(r) for r in run_cypher(g, text, {"end": "3"}, "w").collect()]
    assert got == want


@pytest.mark.parametrize("text", ["MATCH (a) DELETE a", "RETURN", "MATCH (a RETURN a", "MATCH (a) RETURN $missing", "CREATE (a)", ""])
def test_cypher_errors(g, text):
    with pytest.raises(CypherError):
        run_cypher(g, text).collect()


ROUTES = [
    ("Which functions are most complex?", "R1"), ("interfaces with Sink in their name", "R2a"), ("show the repository interface", "R2b"), ("who implements the interface", "R2c"), ("all interfaces", "R2d"), ("which packages import which", "R3a"),
    ("packages", "R3b"), ("who calls Run", "R4a"), ("calls", "R4b"), ("embedded", "R5"), ("which functions handle errors", "R6"), ("concurrent code", "R7"), ("return types", "R8"), ("parameter types", "R9"), ("types with methods", "R10a"),
    ("methods", "R10b"), ("what creates it", "R11"), ("unused", "R12"), ("most popular", "R13"), ("errors", "R14"), ("", "R15"),
]


def test_router(g):
    assert [(q, route(q).rule) for q, _ in ROUTES] == ROUTES
    assert name_part("functions containing abc") == "abc" and name_part("nothing") is None
    assert col(route("interfaces containing sink").run(g), "id") == [("I",)]
