import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import neighbours as nb

SCHEMA = "id string, m string, v array<float>, other int"


def data(seed, groups=40, size=6, dim=16, noise=300):
    r = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        c = r.standard_normal(dim)
        for i in range(size):
            out.append((f"g{g}i{i}", "m1" if g % 3 else "m2", c + r.standard_normal(dim) * 0.15))
    out += [(f"n{i}", "m1", r.standard_normal(dim)) for i in range(noise)]
    out += [(f"copy{i}", "m1", np.arange(dim) * 0.5 + 1) for i in range(9)]
    return [(i, m, [float(np.float32(x)) * 3 for x in v], 1) for i, m, v in out]


def brute(rows, k, floor):
    pairs = set()
    for model in {x[1] for x in rows}:
        mine = sorted({x[0]: x[2] for x in rows if x[1] == model}.items())
        ids, v = [x[0] for x in mine], np.array([x[1] for x in mine], dtype=np.float32).astype(float)
        u = v / np.linalg.norm(v, axis=1, keepdims=True)
        s = u @ u.T
        np.fill_diagonal(s, -2)
        for a in range(len(ids)):
            for b in np.lexsort((np.arange(len(ids)), -np.round(s[a], 9)))[:k]:
                if s[a, b] >= floor:
                    pairs.add((ids[a], ids[b]))
    return pairs


def search(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA)
    return {(r["id"], r["other"]) for r in nb.Neighbours(df, F.col("id"), F.col("m"), F.col("v")).top(5, 0.9, **how).collect()}


def test_quantisation_bound():
    v = np.random.default_rng(1).standard_normal((200, 48))
    q, scale, error = nb.quantise(v)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert (np.linalg.norm(unit - scale[:, None] * q, axis=1) <= error).all()
    true, near = unit @ unit.T, (q.astype(float) @ q.T.astype(float)) * scale[:, None] * scale
    assert (np.abs(true - near) <= error[:, None] + (1 + error[:, None]) * error + 1e-6).all()


@pytest.mark.parametrize("leaf", [4096, 64])
def test_recall_against_brute_force(spark, leaf):
    rows = data(5)
    want = brute(rows, 5, 0.9)
    got = search(spark, rows + rows[:50], leaf=leaf, trees=8)
    plain = {p for p in want if not p[0].startswith("copy")}
    assert len(got & plain) >= 0.95 * len(plain) and len({p for p in got if not p[0].startswith("copy")} - want) <= 0.05 * len(want)
    if leaf == 4096:
        assert got == want


def test_copies_name_each_other(spark):
    got = search(spark, data(6, groups=1, noise=3))
    copies = [p for p in got if p[0].startswith("copy")]
    assert len(copies) == 9 * 5 and all(b.startswith("copy") and a != b for a, b in copies)


def test_bad_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", "m", [1.0, 0.0], 1), ("b", "m", [2.0, 0.1], 1), ("a", "m", [1.0, 0.0], 2), ("z", "m", [0.0, 0.0], 1), ("n", "m", [nan, 1.0], 1), ("i", "m", [inf, 1.0], 1), ("e", "m", [], 1), ("u", "m", None, 1),
            ("w", "m", [1.0, None], 1), (None, "m", [1.0, 0.0], 1), (" ", "m", [1.0, 0.0], 1), ("o", None, [1.0, 0.0], 1), ("x", "other", [1.0, 0.0], 1), ("d", "m", [1.0, 0.0, 0.0], 1)]
    assert search(spark, rows) == {("a", "b"), ("b", "a")}


def test_empty(spark):
    assert search(spark, []) == set()
    assert search(spark, [("a", "m", None, 1)]) == set()


def test_trees_split_evenly():
    q, _, _ = nb.quantise(np.random.default_rng(3).standard_normal((4000, 32)) + 4.0)  # far from centred
    t = nb.ProjectionTrees({"m": q}, 1.0, 3, 250)
    for tree in range(3):
        assert np.bincount(t.leaves("m", q, tree)).max() <= 300


def test_exact_tiling_is_complete(spark):
    """Every pair of tiles is a block: all true pairs, whatever the leaf size and the data."""
    rows = data(8, groups=30, noise=150)
    plain = lambda pairs: {p for p in pairs if not p[0].startswith("copy")}
    assert plain(search(spark, rows, leaf=50, exact=True)) == plain(brute(rows, 5, 0.9))


def near_duplicates(n, dim=16, noise=3e-3, seed=2):
    r = np.random.default_rng(seed)
    c = r.standard_normal(dim)
    return [(f"d{i}", "m", [float(x) for x in (c + r.standard_normal(dim) * noise).astype(np.float32)], 1) for i in range(n)]


def test_near_duplicates_give_k_pairs_a_row(spark):
    """int8 can't tell the members apart, so all pairs of a block survive; only the k best of each row leave the task."""
    rows = near_duplicates(1500)
    df = spark.createDataFrame(rows, SCHEMA)
    n = nb.Neighbours(df, F.col("id"), F.col("m"), F.col("v"))
    pairs, dense = n.candidates(5, 0.9)
    assert dense is not None and pairs.count() <= nb.DENSE * len(rows) and dense.count() <= len(rows)
    assert n.dense_similarities(dense, 5).count() <= 5 * len(rows)
    got, want = search(spark, rows), brute(rows, 5, 0.9)
    assert len(got) == 5 * len(rows) and len({a for a, _ in got}) == len(rows)
    assert len({(min(p), max(p)) for p in got} & {(min(p), max(p)) for p in want}) >= 0.9 * len({(min(p), max(p)) for p in want})


def test_a_third_of_rows_in_one_cluster_splits():
    """No group or block grows with a cluster: split points fall inside it, ties are dealt by hash."""
    r = np.random.default_rng(4)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    v = unit(np.concatenate([r.standard_normal((4000, 16)), r.standard_normal(16) + r.standard_normal((2000, 16)) * 1e-6]))
    keys = r.integers(-(2**63), 2**63 - 1, len(v))
    t = nb.ProjectionTrees({"m": v}, 1.0, 2, 250)
    assert max(np.bincount(t.leaves("m", v, k, keys)).max() for k in range(2)) <= 700
    same = np.repeat(v[:1], 3000, axis=0)
    parts = nb.halves(np.zeros((3000, 8), np.int8), 200)
    assert max(map(len, parts)) <= 200 and sorted(np.concatenate(parts)) == list(range(3000))
    assert np.bincount(t.leaves("m", same, 0, r.integers(-(2**63), 2**63 - 1, len(same)))).max() <= 3000


def test_k_best_lists_over_tiles():
    r = np.random.default_rng(9)
    s = np.round(r.random((40, 300)), 1)  # many ties
    best = nb.KBest(40, 5)
    for j in range(0, 300, 64):
        best.push(slice(0, 40), s[:, j : j + 64], np.arange(j, min(300, j + 64)))
    for i in range(40):
        want = np.lexsort((np.arange(300), -s[i]))[:5]
        assert list(best.column[i]) == list(want)


def test_trees_grow_with_depth():
    assert [nb.trees_for(d) for d in (0, 6, 7, 13)] == [5, 5, 6, 12]
    assert nb.levels(100, 4096) == 0 and nb.levels(8193, 4096) == 2
