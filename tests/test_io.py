import json
import os
import stat

import pytest
from pyspark.sql import functions as F

from graphloom.functions.mock_embedding import embed, mock_embedding, mock_provider
from graphloom.graph import CodeGraph
from graphloom.operators import merge
from graphloom.plans.prompts import PROMPTS, render
from graphloom.plans.tools import REQUIRED, Tools, workspace_label
from graphloom.sources.graph_json import read_graph_json, write_graph_json, write_summary
from graphloom.sources.store import GraphStore


def graph(spark, labels="ab"):
    nodes = [(f"function:p.{x}", x, "function", "p", 2) for x in labels] + [("package:p", "p", "package", "p", 0)]
    n = spark.createDataFrame(nodes, "id string, label string, type string, package string, complexity int").withColumn("full_name", F.concat_ws(".", "package", "label"))
    e = spark.createDataFrame([(f"function:p.{labels[0]}", f"function:p.{x}", "calls", 1, None, i) for i, x in enumerate(labels)], "source string, target string, type string, weight int, workspace string, k int")
    return CodeGraph.from_tables(n, e)


def test_json_round_trip(spark, tmp_path):
    g = graph(spark)
    path = str(tmp_path / "g.json")
    write_graph_json(g, path)
    write_summary(g, path)
    assert stat.S_IMODE(os.stat(path).st_mode) == 0o600
    with open(path) as f:
        doc = json.load(f)
    assert doc["graph"]["stats"]["total_nodes"] == 3 and doc["graph"]["version"] == "2.0.0" and "node_colors" in doc["config"]
    nodes, edges = read_graph_json(spark, path)
    assert sorted(r["id"] for r in nodes.collect()) == sorted(r["id"] for r in g.nodes.collect()) and edges.count() == 2
    with open(path + ".summary") as f:
        assert json.load(f)["packages"] == [{"name": "p", "path": "p", "files": "", "imports": "", "types": 0, "functions": 2, "methods": 0}]
    for bad in (write_graph_json, write_summary):
        with pytest.raises(ValueError):
            bad(None, path)
    with pytest.raises(OSError):
        write_graph_json(g, str(tmp_path / "no" / "g.json"))


def test_store(spark, tmp_path):
    s = GraphStore(spark, str(tmp_path / "store"))
    assert s.graph().nodes.count() == 0 and s.workspaces().count() == 0
    t1, t2 = (F.lit(f"2025-01-0{i}").cast("timestamp") for i in (1, 2))
    s.save(graph(spark, "ab"), "one", now=t1)
    s.save(graph(spark, "xy"), "two", now=t1)
    counts = s.save(graph(spark, "bc"), "one", now=t2, incremental=True)
    assert (counts["created"], counts["updated"], counts["stale"], counts["nodes"], counts["edges"]) == (1, 2, 1, 3, 2)
    nodes = {r["id"]: r for r in s.read("nodes").collect()}
    assert set(nodes) == {"one:function:p.b", "one:function:p.c", "one:package:p", "two:function:p.x", "two:function:p.y", "two:package:p"}
    assert nodes["one:function:p.b"]["created_at"].day == 1 and nodes["one:function:p.b"]["updated_at"].day == 2 and nodes["one:function:p.c"]["created_at"].day == 2
    s.save(graph(spark, "bc"), "one", now=t2, incremental=True)
    assert s.graph().workspace("one").edges.count() == 2  # saved again, edges don't double
    s.clear_workspace("one")
    assert {r["workspace"] for r in s.graph().nodes.collect()} == {"two"} and [r["name"] for r in s.workspaces().collect()] == ["two"]
    s.clear()
    assert s.graph().nodes.count() == 0


def test_delta_embeddings(spark):
    new = spark.createDataFrame([("a", "h1"), ("b", "h2"), ("c", "h3"), ("d", None)], "id string, semantic_hash string")
    stored = spark.createDataFrame([("a", "h1", [1.0], "m"), ("b", "old", [1.0], "m"), ("c", "h3", [], "m")], "id string, semantic_hash string, embedding array<float>, embedding_model string")
    got = {r["id"]: (r["regenerate"], r["embedding"]) for r in merge.delta_embeddings(new, stored).collect()}
    assert got == {"a": (False, [1.0]), "b": (True, None), "c": (True, None), "d": (True, None)}
    assert merge.upsert_workspaces(spark.createDataFrame([("w", "/a", 1)], "name string, path string, nodes int"), spark.createDataFrame([("w", 5), ("v", 2)], "name string, nodes int")).count() == 2


def test_embedding(spark):
    v = mock_embedding("hello", 64)
    assert len(v) == 64 and abs(sum(x * x for x in v) - 1) < 1e-5 and v == mock_embedding("hello", 64) != mock_embedding("world", 64)
    assert len(mock_embedding("x", 300)) == 300
    with pytest.raises(ValueError):
        mock_embedding("")
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "")], "i int, t string")
    assert {r["i"]: r["embedding"] is None for r in embed(df, "t", mock_provider(8), parallelism=2).collect()} == {1: False, 2: True, 3: True}

    def fails(texts):
        if "bad" in texts:
            raise RuntimeError("no")
        return [[1.0] for _ in texts]

    df = spark.createDataFrame([(1, "bad"), (2, "good")], "i int, t string")
    assert {r["i"]: r["embedding"] for r in embed(df, "t", fails, parallelism=1).collect()} == {1: None, 2: [1.0]}


def test_tools(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "go.mod").write_text("module ex.am/my-mod\n")
    (src / "a.go").write_text("package a\n\ntype I interface{ M() }\ntype S struct{}\n\nfunc (s S) M() {}\nfunc NewS() S { return S{} }\nfunc Run() { s := NewS(); s.M() }\n")
    t = Tools(spark, GraphStore(spark, str(tmp_path / "store")))
    assert workspace_label(str(src)) == "my-mod" and workspace_label(str(tmp_path)) != ""
    first = t.run("analyze_workspace", workspacePath=str(src))
    assert not first.error and first.rows[0]["struct"] == 20
    w = {"workspace": "my-mod"}
    assert [r["name"] for r in t.run("find_implementers", interfaceName="I", **w).rows] == ["S"]
    assert t.run("trace_call_path", **{"from": "Run", "to": "M"}, **w).rows[0]["pathLength"] == 1
    assert t.run("cypher_query", query="MATCH (f:CodeNode {type: 'function'}) RETURN f.label AS l ORDER BY l", **w).rows == [{"l": "NewS"}, {"l": "Run"}]
    assert "Physical Plan" in t.run("cypher_query", query="MATCH (f) RETURN f.label", explain=True, **w).text
    assert t.run("cypher_query", query="DROP ALL", **w).error
    assert "R4a" in t.run("natural_query", question="who calls M", **w).text
    assert t.run("analyze_impact", nodeId="M", changeType="delete", **w).rows[0]["name"] == "Run"
    assert t.run("detect_architecture", analysisType="layers", **w).rows and t.run("list_workspaces").rows[0]["workspace"] == "my-mod"
    assert t.run("find_patterns", patternType="orphan", **w).text.startswith("Pattern")
    assert t.run("find_patterns", patternType="none", **w).error and t.run("unknown").error
    for name, needed in REQUIRED.items():
        assert not needed or t.run(name).error
    assert t.run("find_implementers", interfaceName="none", **w).json() == "[]"
    assert t.run("analyze_workspace", workspacePath=str(src), incremental=True).rows[0]["updated"] > 0


def test_prompts():
    assert len(PROMPTS) == 15
    for p in PROMPTS.values():
        text = p.render(**{a: "val" for a in p.required})
        assert "{{" not in text and text.startswith("Goal:")
        with pytest.raises(ValueError):
            p.render()
    assert render("a{{#if x}}b{{/if}}{{#unless x}}c{{/unless}}{{x}}", {"x": ""}) == "ac"
    assert render("a{{#if x}}b{{/if}}{{#unless x}}c{{/unless}}{{x}}", {"x": "1"}) == "ab1"
    assert render("a{{#if y}}b{{/if}}{{z}}", {}) == "ab"  # an absent key keeps the body


def test_tools_return_all_rows(spark, tmp_path):
    n, store = 10_050, str(tmp_path / "store")
    ids = spark.range(n).select(F.format_string("ws_function:p.f%05d", "id").alias("id"), F.format_string("f%05d", "id").alias("label"))
    nodes = ids.select("id", "label", F.lit("function").alias("type"), F.lit("p").alias("package"), F.lit("ws").alias("workspace"))
    edges = ids.where("label <> 'f00000'").select(F.col("id").alias("source"), F.lit("ws_function:p.f00000").alias("target"), F.lit("calls").alias("type"), F.lit(1).alias("weight"), F.lit("ws").alias("workspace"))
    s = GraphStore(spark, store)
    s.write("nodes", s.read("nodes", s._nodes_schema()).unionByName(nodes, allowMissingColumns=True), ("workspace", "type"))
    s.write("edges", edges, ("workspace", "type"))
    t = Tools(spark, s)
    got = t.run("cypher_query", query="MATCH (f:CodeNode {type: 'function'}) RETURN f.label AS l ORDER BY l", workspace="ws")
    assert f"Found {n} records" in got.text and [r["l"] for r in got.rows] == [f"f{i:05d}" for i in range(n)]
    assert f"{n - 1} nodes depend on it" in t.run("analyze_impact", nodeId="f00000", workspace="ws", maxDepth=2).text
