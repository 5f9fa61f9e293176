import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm.packing import difference, fill, pack


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 100), max_size=60), st.integers(1, 9))
def test_difference_places_every_item(sizes, k):
    window = difference(np.array(sizes, dtype=np.int64), k)
    assert len(window) == len(sizes) and (len(sizes) == 0 or 0 <= window.min() <= window.max() < max(1, k))


def test_difference_balances():
    assert sorted(np.bincount(difference(np.array([8, 7, 6, 5, 4]), 2), weights=[8, 7, 6, 5, 4])) == [14, 16]
    sizes = np.random.default_rng(1).integers(1, 1000, 500)
    sums = np.bincount(difference(sizes, 20), weights=sizes)
    assert sums.max() - sums.min() <= 10


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 64), max_size=80))
def test_fill_never_exceeds(sizes):
    sizes = np.array(sizes, dtype=np.int64)
    container = fill(sizes, 64)
    if len(sizes):
        assert container.min() >= 0 and np.bincount(container, weights=sizes).max() <= 64


def test_fill_is_near_the_bound():
    sizes = np.random.default_rng(2).integers(1, 300, 3000)
    assert fill(sizes, 2048).max() + 1 <= np.ceil(sizes.sum() / 2048) * 1.02


def rows(df, **how):
    s = [r["n_tokens"] or 0 for r in df.collect()]
    return pack(df, how.pop("limits", [(1, 10), (2, 25)]), "doc_id", "n_tokens", tokens=sum(s), count=len(s)).collect()


def test_pack(spark):
    items = [(i, s, "x") for i, s in enumerate([3, 7, 10, 0, None, 24, 25, 26, 50, 51, 1, 1, 1])]
    df = spark.createDataFrame(items, "doc_id long, n_tokens long, container_id string")
    got = rows(df)
    for limit, cap in ((1, 10), (2, 25)):
        mine = [r for r in got if r["limit_no"] == limit]
        room = {}
        for r in mine:
            room[r["container_id"]] = room.get(r["container_id"], 0) + r["n_tokens"]
        assert max(room.values()) <= cap
        for i, s, _ in items:
            parts = sorted((r["part_no"], r["start"], r["n_tokens"]) for r in mine if r["doc_id"] == i)
            s = s or 0
            assert sum(p[2] for p in parts) == s
            assert len(parts) == (1 if s <= cap else -(-s // cap))  # only what exceeds the capacity is split
            assert [p[1] for p in parts] == list(np.cumsum([0] + [p[2] for p in parts])[:-1])


def test_pack_empty_and_bad_limits(spark):
    df = spark.createDataFrame([], "doc_id long, n_tokens long")
    assert rows(df) == []
    assert rows(spark.createDataFrame([(1, 5)], "doc_id long, n_tokens long"), limits=[(1, 0), (2, None)]) == []


@pytest.mark.parametrize("copies", [1, 300])
def test_equal_sizes(copies):
    container = fill(np.full(copies, 5), 10)
    assert container.max() + 1 == -(-copies // 2)
