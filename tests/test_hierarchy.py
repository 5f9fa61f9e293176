import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import hierarchy
from graphloom.operators.hierarchy import Forest, parent_child


def brute(links):
    parent = {}
    for p, c in links:
        if p and p.strip() and c and c.strip():
            parent[c] = min(p, parent.get(c, p))
    nodes = set(parent) | set(parent.values())
    out = {}
    for n in nodes:
        seen, x = [], n
        while x in parent and x not in seen:
            seen.append(x)
            x = parent[x]
        out[n] = (min(seen[seen.index(x) :]), -1) if x in seen else (x, len(seen))
    return parent, out


def forest(spark, links):
    return Forest(spark.createDataFrame(links, "p string, c string"), F.col("p"), F.col("c"))


def mixed(seed):
    r = random.Random(seed)
    links = []
    for t in range(5):
        nodes = [f"t{t}n{i}" for i in range(r.randint(2, 30))]
        links += [(r.choice(nodes[:i]), nodes[i]) for i in range(1, len(nodes))]
    chain = [f"c{i}" for i in range(70)]
    links += list(zip(chain, chain[1:], strict=False))
    loop = [f"l{i}" for i in range(9)]
    links += [(loop[i], loop[(i + 1) % 9]) for i in range(9)] + [("l3", "tail0")] + [(f"tail{i}", f"tail{i + 1}") for i in range(20)]
    links += [("self", "self"), ("self", "under"), ("two", "one"), ("one", "two")]
    links += [("star", f"s{i}") for i in range(120)]
    links += [(None, "x"), ("x", ""), (" ", "y")] + links[:10]
    r.shuffle(links)
    return links


@pytest.mark.parametrize("seed", [1, 2])
def test_depths_roots_and_loops(spark, seed):
    links = mixed(seed)
    parent, want = brute(links)
    f = forest(spark, links)
    assert {r["node_id"]: (r["root_id"], r["depth"]) for r in f.depths().collect()} == want
    nodes = {r["node_id"]: r for r in f.nodes().collect()}
    assert set(nodes) == set(want)
    for n, r in nodes.items():
        assert r["parent_id"] == parent.get(n)
        if r["depth"] >= 0:
            below = [m for m, o in nodes.items() if o["root_id"] == r["root_id"] and o["depth"] >= 0 and r["entry"] < o["entry"] < r["exit"]]
            up = lambda m: m if m == n or m not in parent else up(parent[m])  # noqa: E731, B023
            assert sorted(below) == sorted(m for m in nodes if m != n and nodes[m]["depth"] >= 0 and up(m) == n)
        else:
            assert r["entry"] is None and r["exit"] is None


def test_paths(spark):
    links = mixed(3)
    parent, want = brute(links)
    got = {r["node_id"]: r["path"] for r in forest(spark, links).paths().collect()}
    assert set(got) == {n for n, (_, d) in want.items() if d >= 0}
    for n, path in got.items():
        walk = [n]
        while walk[0] in parent:
            walk.insert(0, parent[walk[0]])
        assert path == walk


def test_descendants_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "BLOCK", 16)
    links = mixed(4)
    parent, want = brute(links)
    asked = [(1, "c0", 5), (2, "c10", None), (3, "star", 1), (4, "unknown", 3), (5, "l0", 3), (6, "c69", 9), (6, "c69", 9)]
    got = forest(spark, links).descendants(spark.createDataFrame(asked, "request_id int, node string, most int"), F.col("node"), F.col("most"), ["request_id"])
    found = sorted((r["request_id"], r["descendant_id"], r["distance"]) for r in got.collect())
    expect = [(1, f"c{i}", i) for i in range(1, 6)] + [(2, f"c{i}", i - 10) for i in range(11, 70)] + [(3, f"s{i}", 1) for i in range(120)]
    assert found == sorted(expect)


def test_empty_and_only_loops(spark):
    e = forest(spark, [(None, None)])
    assert e.depths().count() == 0 and e.nodes().count() == 0 and e.paths().count() == 0
    f = forest(spark, [("a", "b"), ("b", "a")])
    assert sorted(map(tuple, f.depths().collect())) == [("a", "a", -1), ("b", "a", -1)]
    asked = spark.createDataFrame([(1, "a", 2)], "request_id int, node string, most int")
    assert f.descendants(asked, F.col("node"), F.col("most"), ["request_id"]).count() == 0


def test_extra_parents_are_told(spark):
    f = forest(spark, [("a", "c"), ("b", "c"), ("b", "c"), ("c", "d"), ("a", "c")])
    assert f.extra == 1 and [tuple(r) for r in f.extra_parents().collect()] == [("c", "b", "a")]
    assert forest(spark, [("a", "b")]).extra_parents().count() == 0


def test_link_direction(spark):
    rows = [("s", "f", "HasField"), ("m", "s", "METHOD_OF"), ("e", "s", "embeds"), ("a", "b", "calls")]
    df, p, c = parent_child(spark.createDataFrame(rows, "source string, target string, type string"))
    assert sorted(map(tuple, df.select(p, c).collect())) == [("s", "e"), ("s", "f"), ("s", "m")]


def test_clashing_columns(spark):
    links = [("a", "b"), ("b", "c"), ("a", "d")]
    df = spark.createDataFrame(links, "p string, c string").withColumns({x: F.lit("x") for x in ("parent", "child", "n", "id", "kind", "low", "e", "nxt")})
    f = Forest(df, F.col("p"), F.col("c"))
    assert sorted(map(tuple, f.depths().collect())) == [("a", "a", 0), ("b", "a", 1), ("c", "a", 2), ("d", "a", 1)]
    asked = spark.createDataFrame([(1, "a", 9, "x")], "id int, node string, most int, descendant string")
    got = f.descendants(asked, F.col("node"), F.col("most"), ["id", "node"]).collect()
    assert sorted((r["id"], r["node"], r["descendant_id"], r["distance"]) for r in got) == [(1, "a", "b", 1), (1, "a", "c", 2), (1, "a", "d", 1)]


def reached(links, start, most):
    """Each node once, at its least number of steps down from ``start``; brute force."""
    parent, _ = brute(links)
    found, front = {start: 0}, [start]
    for k in range(1, len(parent) + 1 if most is None else most + 1):
        front = [c for c, p in parent.items() if p in front and c not in found]
        found.update(dict.fromkeys(front, k))
    return {n: k for n, k in found.items() if n != start}


def test_descendants_on_and_below_loops(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "BLOCK", 16)
    links = mixed(5) + [("l7", "twig"), ("twig", "leaf")]
    nodes = ["l0", "l3", "l8", "tail0", "tail20", "self", "under", "one", "two", "twig", "c10", "star", "unknown"]
    asked = [(i, n, most) for i, (n, most) in enumerate((n, most) for n in nodes for most in (1, 3, 9, 500, None))]
    got = forest(spark, links).descendants(spark.createDataFrame(asked, "request_id int, node string, most int"), F.col("node"), F.col("most"), ["request_id"], loops=True)
    found = sorted((r["request_id"], r["descendant_id"], r["distance"]) for r in got.collect())
    assert found == sorted((i, d, k) for i, n, most in asked for d, k in reached(links, n, most).items())
    only = forest(spark, [("a", "b"), ("b", "a")])
    asked = spark.createDataFrame([(1, "a", 2)], "request_id int, node string, most int")
    assert [tuple(r) for r in only.descendants(asked, F.col("node"), F.col("most"), ["request_id"], loops=True).collect()] == [(1, "b", 1)]


def test_impact_query_covers_loops(spark, tmp_path):
    from graphloom.plans.general import p4_impact

    links = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d")]
    spark.createDataFrame([(p, c, "has_field") for p, c in links], "source string, target string, type string").write.parquet(f"{tmp_path}/edges.parquet")
    spark.createDataFrame([(1, "a", 2), (2, "c", None)], "request_id long, node_id string, max_depth int").write.parquet(f"{tmp_path}/impact_requests.parquet")
    assert sorted(map(tuple, p4_impact(spark, str(tmp_path)).collect())) == [(1, "b", 1), (1, "c", 2), (2, "d", 1)]


def test_nodes_and_paths_with_loops(spark):
    links = mixed(6)
    parent, want = brute(links)
    f = forest(spark, links)
    nodes = {r["node_id"]: r for r in f.nodes(loops=True).collect()}
    assert {n: (r["root_id"], r["depth"], r["descendants"]) for n, r in nodes.items()} == {n: (*o, len(reached(links, n, None))) for n, o in want.items()}
    paths = {r["node_id"]: r for r in f.paths(loops=True).collect()}
    assert set(paths) == set(want)
    for n, (root, depth) in want.items():
        walk = [n]
        while walk[0] != root:
            walk.insert(0, parent[walk[0]])
        assert paths[n]["path"] == walk
        assert paths[n]["ring"] == (0 if depth >= 0 else sum(root in reached(links, x, None) or x == root for x in walk))


def test_path_query_marks_loops(spark, tmp_path):
    from graphloom.plans.general import p4_nodes, p4_paths

    links = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("t", "u")]
    spark.createDataFrame([(p, c, "has_field") for p, c in links], "source string, target string, type string").write.parquet(f"{tmp_path}/edges.parquet")
    want = {"a": "loop(a)", "b": "loop(a > b)", "c": "loop(a > b) > c", "d": "loop(a > b) > c > d", "t": "t", "u": "t > u"}
    assert dict(map(tuple, p4_paths(spark, str(tmp_path)).collect())) == want
    assert {r["node_id"]: r["descendants"] for r in p4_nodes(spark, str(tmp_path)).collect()} == {"a": 3, "b": 3, "c": 1, "d": 0, "t": 1, "u": 0}
