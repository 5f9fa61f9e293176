import threading
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from graphloom.graph import CodeGraph
from graphloom.plans.sql_query import explained, sql_query
from graphloom.sources.go_parser import type_descriptor
from graphloom.sources.http_view import make_server
from graphloom.sources.store import GraphStore
from graphloom.streaming.upsert import edge_counts, first_deliveries, start_upserts, stream_table


def test_http(tmp_path):
    file = tmp_path / "g.json"
    file.write_text('{"graph": {"nodes": []}}')
    server = make_server(str(file), 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    try:
        with urllib.request.urlopen(base + "/api/graph") as r:
            assert r.status == 200 and r.headers["Access-Control-Allow-Origin"] == "*" and r.headers["Content-Type"] == "application/json" and b"nodes" in r.read()
        for path in ("/api/summary", "/nothing"):
            with pytest.raises(urllib.error.HTTPError) as e:
                urllib.request.urlopen(base + path)
            assert e.value.code == 404
    finally:
        server.shutdown()


def test_sql_query(spark):
    n = spark.createDataFrame([("a", "w", "A", "function"), ("b", "v", "B", "struct")], "id string, workspace string, label string, type string")
    e = spark.createDataFrame([("a", "b", "calls", 1, "w")], "source string, target string, type string, weight int, workspace string")
    g = CodeGraph.from_tables(n, e)
    df = sql_query(g, "SELECT id FROM {nodes} WHERE type = :t", {"t": "function"}, "w")
    assert [r["id"] for r in df.collect()] == ["a"] and "Scan" in explained(df)
    assert sql_query(g, "SELECT * FROM {nodes}").count() == 2


@pytest.mark.parametrize("text, kind, flags", [("*p.T", "pointer", {"is_pointer": True}), ("[]int", "slice", {"is_slice": True}), ("[4]byte", "array", {"is_array": True}), ("<-chan int", "chan", {"channel_dir": "receive"}), ("map[string][]T", "map", {}), ("func(int) error", "func", {}), ("T[int]", "named", {"is_generic": True}), ("struct{ A, B int; C }", "struct", {"field_count": 3}), ("interface{ M() }", "interface", {"method_set": ["M"]}), ("", "", {})])
def test_type_descriptor(text, kind, flags):
    d = type_descriptor("p", text)
    assert d["kind"] == kind and all(d[k] == v for k, v in flags.items())


def test_streams(spark, tmp_path):
    rows = [("a", "x", "Calls", f"2025-01-0{d}") for d in (1, 1, 2)] + [("a", " ", "calls", "2025-01-01")]
    df = spark.createDataFrame(rows, "source string, target string, type string, day string").withColumn("created_at", F.to_timestamp("day")).drop("day")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = edge_counts(stream_table(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("t_counts").outputMode("complete").trigger(availableNow=True).start()
    out.awaitTermination()
    assert sorted(r["edges"] for r in spark.table("t_counts").collect()) == [1, 2]
    one = first_deliveries(stream_table(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("t_once").trigger(availableNow=True).start()
    one.awaitTermination()
    assert spark.table("t_once").count() == 3


def test_stream_upserts(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "store"))
    cols = "id string, label string, type string, workspace string, created_at timestamp"
    make = lambda *rows: spark.createDataFrame([(*r, None) for r in rows], cols).withColumn("created_at", F.timestamp_seconds(F.monotonically_increasing_id()))
    make(("a", "A", "function", "w"), ("b", "B", "function", "w"), ("a", "A2", "function", "w")).coalesce(1).write.parquet(str(tmp_path / "in"))
    start_upserts(stream_table(spark, str(tmp_path / "in")), store, str(tmp_path / "cp")).start().awaitTermination()
    make(("b", "B2", "function", "w"), ("c", "C", "function", "w")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    start_upserts(stream_table(spark, str(tmp_path / "in")), store, str(tmp_path / "cp")).start().awaitTermination()
    assert {r["id"]: r["label"] for r in store.read("nodes").collect()} == {"a": "A2", "b": "B2", "c": "C"}
