import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions.canonical import canonical_hex, canonical_type
from graphloom.operators.snapshots import snapshot_changes

SCHEMA = "w string, n int, id string, h string, t int, note string"


def changes(df, **how):
    got = snapshot_changes(df, F.col("w"), F.col("n"), F.col("id"), F.col("h"), F.col("t"), **how).collect()
    return sorted((r["scope"], r["snapshot_no"], r["key"], r["change"]) for r in got)


def brute(data):
    out = []
    for w in {x[0] for x in data if x[0]}:
        state = {}
        for x in data:
            if x[0] == w and x[1] is not None:
                snap = state.setdefault(x[1], {})
                if x[2]:
                    rank = (x[4] is not None, x[4] or 0, x[3] is not None, x[3] or "")
                    if x[2] not in snap or rank > snap[x[2]][0]:
                        snap[x[2]] = (rank, x[3])
        order = sorted(state)
        for a, b in zip(order, order[1:], strict=False):
            old, new = ({k: h for k, (_, h) in state[s].items() if h is not None} for s in (a, b))
            out += [(w, b, k, "added") for k in new.keys() - old.keys()] + [(w, b, k, "removed") for k in old.keys() - new.keys()]
            out += [(w, b, k, "changed") for k in new.keys() & old.keys() if new[k] != old[k]]
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_matches_brute_force(spark, seed):
    r = random.Random(seed)
    data = [(r.choice(["big"] * 8 + ["b", "c", None]), r.choice([1, 2, 4, 7, None]), r.choice([f"k{i}" for i in range(60)] + [None, ""]), r.choice(["aa", "bb", "cc", None]), r.choice([1, 2, 3, None]), "x") for _ in range(1500)]
    df = spark.createDataFrame(data + data[:200], SCHEMA)
    assert changes(df) == brute(data)
    assert changes(df, ranges=7) == brute(data)


def test_small_batches_keep_neighbours(spark):
    data = [("w", n, f"k{i:03d}", str((i * n) % 3), 1, "") for n in (1, 2, 3) for i in range(97) if (i + n) % 5]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        one = changes(spark.createDataFrame(data, SCHEMA))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert one == brute(data)


def test_first_and_missing_snapshots(spark):
    data = [("w", 1, "a", "x", 1, ""), ("w", 3, "a", "x", 1, ""), ("w", 5, "b", None, 1, ""), ("v", 2, "only", "x", 1, "")]
    assert changes(spark.createDataFrame(data, SCHEMA)) == [("w", 5, "a", "removed")]
    assert changes(spark.createDataFrame([], SCHEMA)) == []


def test_notations(spark):
    rows = [("ABCDEF0123456789ab", "abcdef0123456789ab"), (" sha256:abcdef0123456789 \n", "abcdef0123456789"), ("0xAB-CD", "abcd"), ("  ", None), (None, None)]
    got = spark.createDataFrame(rows, "h string, want string").select(canonical_hex(F.col("h")).alias("g"), "want").collect()
    assert all(r["g"] == r["want"] for r in got)
    kinds = [("HasMethod", "has_method"), ("HAS_METHOD", "has_method"), (" has-method ", "has_method"), ("calls", "calls"), (None, None)]
    got = spark.createDataFrame(kinds, "k string, want string").select(canonical_type(F.col("k")).alias("g"), "want").collect()
    assert all(r["g"] == r["want"] for r in got)


def test_clashing_columns(spark):
    data = [("w", n, f"k{i}", str(i * n % 3), 1, "") for n in (1, 2, 3) for i in range(20) if (i + n) % 4]
    df = spark.createDataFrame(data, SCHEMA)
    extra = df.withColumns({c: F.lit("x") for c in ("scope", "key", "ord", "last", "state", "no", "next_no", "change", "loaded", "top")})
    assert changes(extra) == changes(df) == brute(data)


def test_several_columns(spark):
    """A change of any compared column counts, null is a value, and the names tell which; presence goes by the state."""
    data = [("w", 1, "a", "x", 1, "m"), ("w", 2, "a", "x", 1, "n"), ("w", 3, "a", "y", 1, None), ("w", 4, "a", "y", 1, None), ("w", 5, "a", None, 1, "n"), ("w", 2, "b", "x", 1, "m"), ("w", 3, "b", "x", 1, "m")]
    got = snapshot_changes(spark.createDataFrame(data, SCHEMA), F.col("w"), F.col("n"), F.col("id"), F.col("h"), F.col("t"), compare={"note": F.col("note")})
    found = sorted((r["snapshot_no"], r["key"], r["change"], tuple(r["columns"])) for r in got.collect())
    assert found == [(2, "a", "changed", ("note",)), (2, "b", "added", ()), (3, "a", "changed", ("state", "note")), (4, "b", "removed", ()), (5, "a", "removed", ())]
