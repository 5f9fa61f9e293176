import random
from collections import defaultdict

from pyspark.sql import functions as F

from graphloom.operators.skew import edge_totals, heavy_keys, tree_aggregate, tree_rounds

SCHEMA = "id string, source string, target string, type string, weight int, position struct<filename:string,line:int>, created_at string, extra map<string,string>"


def rows(n=600, seed=3):
    r = random.Random(seed)
    out = []
    for i in range(n):
        target = r.choice(["hot"] * 6 + ["a", "b", " b ", None, "", "  "])
        out.append((f"e{i % 50}", r.choice(["x", "y", "z", None, " "]), target, r.choice(["calls", "Calls", "CALLS", "HasField", "has_field", None]), r.choice([1, 2, None]), (f"f{r.randint(0, 2)}", r.choice([0, 1, None])), r.choice(["t1", "t2", None]), {"k": "v"}))
    return out + out[: n // 4]


def brute(data):
    kinds = {"calls": "calls", "Calls": "calls", "CALLS": "calls", "HasField": "has_field", "has_field": "has_field", None: None}
    once = {repr(x): x for x in data}.values()
    n, w, s = defaultdict(int), defaultdict(int), defaultdict(set)
    for _, src, t, k, weight, *_ in once:
        key = ((t or "").strip() or None, kinds[k])
        n[key] += 1
        w[key] += weight or 0
        if src and src.strip():
            s[key].add(src.strip())
    return {k: (n[k], w[k], len(s[k])) for k in n}


def test_totals_match_brute_force_at_any_tree_height(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    want = brute(data)
    for chunk, fan in ((1 << 18, 16), (50, 2), (7, 4)):
        got = {(r["target"], r["type"]): (r["edges"], r["weight"], r["sources"]) for r in edge_totals(df, chunk_rows=chunk, fan_in=fan).collect()}
        assert got == want


def test_null_positions_are_told_apart(spark):
    a = ("e", "x", "t", "calls", 1, ("f", None), None, None)
    b = ("e", "x", "t", "calls", 1, (None, None), "f", None)
    c = ("e", "x", "t", "calls", 1, None, "f", None)
    got = edge_totals(spark.createDataFrame([a, b, c, a], SCHEMA)).collect()
    assert got[0]["edges"] == 3


def test_heavy_keys_count_all_edges(spark):
    data = [("i", "s", "big", "calls", 1, None, str(i), None) for i in range(50)] + [("i", "s", None, "calls", 1, None, str(i), None) for i in range(50)] + [("i", "s", "small", "calls", 1, None, "0", None)]
    keys = heavy_keys(edge_totals(spark.createDataFrame(data, SCHEMA)), 0.01).collect()
    assert [r["target"] for r in keys] == ["big"]  # 1 of 101 is below a hundredth


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert edge_totals(df).count() == 0 and heavy_keys(edge_totals(df), 0.01).count() == 0


def test_rounds():
    assert [tree_rounds(n, 10, 2) for n in (0, 10, 11, 20, 21, 80, 81)] == [0, 0, 1, 1, 2, 3, 4]


def test_generic_states(spark):
    df = spark.range(1000).select(F.lit("k").alias("k"), F.col("id"))
    got = tree_aggregate(df, ["k"], ["id"], {"top": F.max("id"), "n": F.count("id")}, {"top": F.max("top"), "n": F.sum("n")}, rows=1000, chunk_rows=10, fan_in=3).first()
    assert (got["top"], got["n"]) == (999, 1000)


def test_clashing_columns(spark):
    df = spark.createDataFrame(rows(200), SCHEMA)
    extra = df.withColumns({c: F.lit(1) for c in ("s1", "s2", "f1", "f2", "w", "n", "edges", "sources", "__leaf", "all_edges")})
    assert sorted(map(str, edge_totals(extra, chunk_rows=20, fan_in=2).collect())) == sorted(map(str, edge_totals(df).collect()))
