import pytest
from pyspark.sql import functions as F

from graphloom.functions.mock_embedding import mock_provider
from graphloom.graph import EDGE_COLUMNS, NODE_COLUMNS, CodeGraph, with_missing
from graphloom.plans.cypher import CypherError, run_cypher
from graphloom.plans.cypher_write import apply_cypher
from graphloom.sources.store import TYPES, GraphStore


def small(spark, n=4):
    nodes = spark.createDataFrame([(f"f{i}", f"Fn{i}", "function", "p", i) for i in range(n)], "id string, label string, type string, package string, complexity int")
    edges = spark.createDataFrame([(f"f{i}", f"f{i + 1}", "calls", 1, None) for i in range(n - 1)], "source string, target string, type string, weight int, workspace string")
    return CodeGraph(with_missing(nodes, NODE_COLUMNS, TYPES), edges.select(*EDGE_COLUMNS))


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_create_merge_set_delete(spark):
    g = small(spark)
    g, n = apply_cypher(g, "UNWIND $batch AS x CREATE (n:CodeNode {id: x.id, label: x.label, type: 'struct', complexity: 7})", {"batch": [{"id": "s1", "label": "S1"}, {"id": "s2", "label": "S2"}]})
    assert n["nodes_created"] == 2 and g.nodes.where("type = 'struct' AND complexity = 7").count() == 2
    g, n = apply_cypher(g, "MATCH (a:CodeNode {type: 'function'}), (b:CodeNode {id: 's1'}) WHERE a.complexity > 1 CREATE (a)-[:RELATES_TO {type: 'uses', weight: 3}]->(b)")
    assert n["relationships_created"] == 2 and rows(g.edges.where("type = 'uses'").select("source", "target", "weight")) == [("f2", "s1", 3), ("f3", "s1", 3)]
    g, n = apply_cypher(g, "UNWIND ['s1', 's9'] AS x MERGE (n:CodeNode {id: x}) ON CREATE SET n.label = 'new' ON MATCH SET n.label = 'old' SET n.package = 'q'")
    assert n["nodes_created"] == 1 and rows(g.nodes.where("package = 'q'").select("id", "label")) == [("s1", "old"), ("s9", "new")]
    g, n = apply_cypher(g, "MATCH (a {id: 'f0'}), (b {id: 'f1'}) MERGE (a)-[:RELATES_TO {type: 'calls'}]->(b) MERGE (b)-[:RELATES_TO {type: 'calls'}]->(a)")
    assert n["relationships_created"] == 1
    g, n = apply_cypher(g, "MATCH (a)-[r:RELATES_TO {type: 'uses'}]->(b) SET r.weight = 9")
    assert n["properties_set"] == 2 and g.edges.where("weight = 9").count() == 2
    with pytest.raises(CypherError):
        apply_cypher(g, "MATCH (n {id: 's1'}) DELETE n")
    g, n = apply_cypher(g, "MATCH (n {id: 's1'}) DETACH DELETE n")
    assert (n["nodes_deleted"], n["relationships_deleted"]) == (1, 2) and g.nodes.where("id = 's1'").isEmpty() and g.edges.where("target = 's1'").isEmpty()
    g, n = apply_cypher(g, "MATCH (a {id: 'f0'})-[r]->(b) DELETE r")
    assert n["relationships_deleted"] == 1 and g.nodes.count() == 6
    for bad in ("CREATE (n {label: 'x'})", "MATCH (n) SET n.nothing = 1", "MATCH (n) RETURN n", "MERGE (n)", "CREATE (n {id: 'x', foo: 1})"):
        with pytest.raises(CypherError):
            apply_cypher(g, bad)


def test_hops_without_a_bound(spark):
    """No silent limit: a chain of 25 is walked to its end, by both forms of the pattern."""
    g = small(spark, 26)
    for form in ("{type: 'calls'}*", "*1.. {type: 'calls'}", "{type: 'calls'}*2..", "{type: 'calls'}*..40"):
        got = run_cypher(g, f"MATCH (a {{id: 'f0'}})-[r:RELATES_TO {form}]->(b) RETURN count(b) AS n").first()["n"]
        assert got == (24 if "*2" in form else 25)
    p = run_cypher(g, "MATCH p = shortestPath((a)-[:RELATES_TO {type: 'calls'}*]->(b)) WHERE a.id = 'f1' AND b.label = 'Fn22' RETURN length(p) AS n, a.id AS a").collect()
    assert [tuple(r) for r in p] == [(21, "f1")]


def test_explain_and_call(spark):
    g = small(spark)
    assert "Physical Plan" in run_cypher(g, "EXPLAIN MATCH (n) RETURN n.id").first()["plan"]
    vectors = spark.createDataFrame([("f0", [1.0, 0.0]), ("f1", [0.6, 0.8]), ("f2", [0.0, 1.0])], "id string, embedding array<float>")
    got = run_cypher(g, "CALL db.index.vector.queryNodes('code', 2, $v) YIELD node AS n, score WHERE score > 0.1 OPTIONAL MATCH (n)-[r]-(m) RETURN n.id AS id, count(m) AS near ORDER BY id", {"v": [1.0, 0.1]}, vectors=vectors)
    assert [tuple(r) for r in got.collect()] == [("f0", 1), ("f1", 2)]
    assert rows(run_cypher(g, "CALL db.index.fulltext.queryNodes('code', 'fn2') YIELD node, score RETURN node.id AS id")) == [("f2",)]
    for bad in ("CALL no.such() YIELD node RETURN node", "CALL db.index.vector.queryNodes('code', 2, $v) YIELD node RETURN node.id"):
        with pytest.raises(CypherError):
            run_cypher(g, bad, {"v": [1.0]})


def test_store_keeps_workspaces_apart(spark, tmp_path):
    s = GraphStore(spark, str(tmp_path / "store"))
    s.save(small(spark), "one", provider=mock_provider(16), model="mock")
    s.save(small(spark, 3), "w 2/x", provider=mock_provider(16), model="mock")
    before = {p: v for p, v in s._pointers("nodes").items()}
    held = s.graph("one").nodes  # a reader that is still at work
    n = s.apply("MATCH (n {id: 'one:f0'}) SET n.label = 'Changed' WITH n CREATE (m:CodeNode {id: 'one:m', type: 'method'})", "one")
    after = s._pointers("nodes")
    assert n["properties_set"] == 1 and n["nodes_created"] == 1
    assert [p for p in after if after[p] != before[p]] == ["workspace=one"]  # the other folder isn't touched
    assert held.where("label = 'Changed'").isEmpty() and s.graph("one").nodes.where("label = 'Changed'").count() == 1
    assert s.graph("w 2/x").nodes.count() == 3 and s.graph().nodes.count() == 8
    stored = s.read("nodes", s._nodes_schema(), "one").where("type = 'function'")
    assert stored.where("semantic_hash IS NULL OR content_hash IS NULL OR semantic_summary IS NULL OR metadata['semantic_hash'] <> semantic_hash").isEmpty()
    assert s.embeddings("one").where(F.size("embedding") == 16).count() == 4
    again = s.save(small(spark), "one", incremental=True, provider=mock_provider(16), model="mock")
    assert (again["embedded"], again["reused"]) == (0, 4)  # nothing changed, so every vector is kept
    s.clear_workspace("one")
    assert s.graph("one").nodes.isEmpty() and s.embeddings().count() == 3


def test_questions_meet_stored_vectors(spark, tmp_path):
    """Ingest embeds what it stores; a question then finds its nearest nodes, and goes to the router where nothing is stored."""
    from graphloom.plans.tools import Tools

    src = tmp_path / "src"
    src.mkdir()
    (src / "go.mod").write_text("module example.com/my-mod\n")
    (src / "a.go").write_text("package main\n\n// Run starts it.\nfunc Run() { NewS() }\n\ntype S struct{}\n\nfunc NewS() *S { return &S{} }\n")
    t = Tools(spark, GraphStore(spark, str(tmp_path / "store")), mock_provider(16), "mock")
    first = t.run("analyze_workspace", workspacePath=str(src)).rows[0]
    assert first["embedded"] == 3 + 21 and first["reused"] == 0  # the built-in types have summaries too
    found = t.run("natural_query", question="what starts", workspace="my-mod")
    assert found.text.startswith("Hybrid") and len(found.rows) == 10 and all(-1 <= r["score"] <= 1.000001 for r in found.rows)
    assert t.run("natural_query", question="who calls Run", workspace="none").text.startswith("Pattern-based")
    (src / "a.go").write_text("package main\n\n// Run starts it all.\nfunc Run() { NewS() }\n\ntype S struct{}\n\nfunc NewS() *S { return &S{} }\n")
    again = t.run("analyze_workspace", workspacePath=str(src), incremental=True).rows[0]
    assert (again["embedded"], again["reused"], again["updated"]) == (1, 23, again["nodes"])
    by_vector = t.run("cypher_query", query="CALL db.index.vector.queryNodes('code', 1, $v) YIELD node, score RETURN node.label AS l", workspace="my-mod", parameters={"v": mock_provider(16)(["x"])[0]})
    assert len(by_vector.rows) == 1
