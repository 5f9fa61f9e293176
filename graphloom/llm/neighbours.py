"""The k most similar vectors of every vector, by a block matrix join over int8 tiles.

Vectors are scaled to unit length and quantised to int8. Tiles of integer products give every cosine of a block with a
proven bound on its quantisation error; pairs that may still be among the k best of one end survive and are recomputed in
float. Rows that keep more than DENSE survivors stand among near-duplicates: instead of emitting all pairs, their blocks
are joined with the float vectors once, and a k-best list a row (an array heap, kept over the tiles of the block) is all
that leaves the task. Between blocks a row_number window with its partial limit merges the k best of each row.

Blocks are all pairs (tile i, tile j) of a fixed tiling (``exact``), or, for a threshold search at scale, the leaves of
random projection trees: split points are medians of a bounded sample, rows at a split point are dealt by their hash, a
group that is still too large is halved at its own medians, so that no block has more than 2 LEAF rows. The number of trees
grows with their depth, since a pair must survive every split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.shared import Scratch

LEAF = 4096
#: trees up to DEPTH_FREE levels of splits; each further level adds one
TREES = 5
DEPTH_FREE = 6
#: the sample that split points are fitted on: rows and bytes at most
SAMPLE_ROWS, SAMPLE_BYTES = 16_384, 1 << 26
#: sample rows a node needs for a split point; levels beyond are left to the groups, which halve themselves
NODE_SAMPLE = 8
TILE = 1024
DENSE = 64


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, scales and error norms of unit rows: |x - scale q| <= error."""
    unit = vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors, dtype=np.float64))[:, None]
    scale = np.abs(unit).max(axis=1) / 127.0
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(unit - scale[:, None] * q, axis=1)
    return q, scale.astype(np.float32), (error * 1.0001 + 1e-6).astype(np.float32)


def tile_pairs(qa: np.ndarray, sa: np.ndarray, ea: np.ndarray, qb: np.ndarray, sb: np.ndarray, eb: np.ndarray, k: int, floor: float, own: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a and b that may be among the k best of the row of a, with a cosine that may reach ``floor``. With
    ``own``, a are the rows of b from there on, and no row meets itself.

    Products of int8 values are summed exactly in float32 (below 2^24 for up to 1,040 dimensions, in float64 beyond).
    """
    kind = np.float32 if qa.shape[1] <= 1040 else np.float64
    product = qa.astype(kind) @ qb.astype(kind).T
    near = product * sa[:, None] * sb[None, :]
    # |x.y - x'.y'| <= |x-x'||y| + |x'||y-y'| <= ea + (1 + ea) eb
    slack = ea[:, None] + (1 + ea[:, None]) * eb[None, :] + 1e-6
    if own is not None:
        near[np.arange(len(qa)), own + np.arange(len(qa))] = -9
    upper = near + slack
    rows, cols = np.nonzero(upper >= floor)
    if not len(rows):
        return rows, cols
    # the k-th greatest lower bound of each row; counts are small behind a floor, so only survivors are sorted
    lower = (near[rows, cols] - slack[rows, cols]).astype(np.float64)
    order = np.lexsort((-lower, rows))
    sorted_rows = rows[order]
    first = np.searchsorted(sorted_rows, sorted_rows)
    rank = np.arange(len(order)) - first
    least = np.full(len(qa), -np.inf)
    at_k = order[rank == k - 1]
    least[rows[at_k]] = lower[at_k]
    keep = upper[rows, cols] >= least[rows]
    return rows[keep], cols[keep]


def levels(rows: float, leaf: int) -> int:
    return max(0, int(np.ceil(np.log2(max(1.0, rows / leaf)))))


def trees_for(depth: int) -> int:
    return TREES + max(0, depth - DEPTH_FREE)


class ProjectionTrees:
    """Leaf numbers of rows in random projection trees with sample medians as split points.

    ``sample`` has unit rows of each model, a ``share`` of all. Rows at a split point, up to rounding, go by their key.
    """

    def __init__(self, sample: dict[str, np.ndarray], share: float, trees: int | None, leaf: int, seed: int = 5):
        self.seed, self.split, self.depth, self.trees = seed, {}, {}, {}
        for model, rows in sample.items():
            depth = levels(len(rows) / share, leaf)
            self.trees[model] = 1 if not depth else trees or trees_for(depth)  # without splits all trees are one block
            self.depth[model] = depth = min(depth, max(0, int(np.log2(max(1, len(rows) // NODE_SAMPLE)))))
            self.split[model] = []
            keys = np.arange(len(rows))
            for t in range(self.trees[model]):
                node = np.zeros(len(rows), dtype=np.int64)
                middles = []
                for level in range(depth):
                    height = self._heights(rows, t, level)
                    middle = np.zeros(1 << level, dtype=np.float32)
                    order = np.lexsort((height, node))
                    start = np.searchsorted(node[order], np.arange(1 << level))
                    end = np.searchsorted(node[order], np.arange(1 << level), side="right")
                    full = end > start
                    middle[full] = height[order][((start + end) // 2)[full]]
                    middles.append(middle)
                    node = self._down(node, height, middle, keys, level)
                self.split[model].append(middles)

    def _heights(self, rows: np.ndarray, tree: int, level: int) -> np.ndarray:
        direction = np.random.default_rng([self.seed, tree, level, rows.shape[1]]).standard_normal(rows.shape[1]).astype(np.float32)
        return rows.astype(np.float32) @ direction

    @staticmethod
    def _down(node: np.ndarray, height: np.ndarray, middle: np.ndarray, keys: np.ndarray, level: int) -> np.ndarray:
        apart = height - middle[node]
        coin = ((keys * np.int64(-7046029254386353131)) >> np.int64(40 - level)) & 1
        return node * 2 + np.where(np.abs(apart) <= 1e-6 * (1 + np.abs(height)), coin, apart > 0)

    def leaves(self, model: str, rows: np.ndarray, tree: int, keys: np.ndarray | None = None) -> np.ndarray:
        keys = np.arange(len(rows)) if keys is None else keys
        node = np.zeros(len(rows), dtype=np.int64)
        for level in range(self.depth.get(model, 0)):
            node = self._down(node, self._heights(rows, tree, level), self.split[model][tree][level], keys, level)
        return node


def halves(q: np.ndarray, leaf: int, seed: int = 17) -> list[np.ndarray]:
    """Row numbers in parts of at most ``leaf`` rows, each split at its own median along a random direction."""
    parts, done, level = [np.arange(len(q))], [], 0
    while parts:
        direction = np.random.default_rng([seed, level, q.shape[1]]).standard_normal(q.shape[1]).astype(np.float32)
        nxt = []
        for rows in parts:
            if len(rows) <= leaf:
                done.append(rows)
            else:
                order = rows[np.argsort(q[rows].astype(np.float32) @ direction, kind="stable")]
                nxt += [order[: len(order) // 2], order[len(order) // 2 :]]
        parts, level = nxt, level + 1
    return done


class KBest:
    """The k best columns of each row, kept over tiles: an array heap of (similarity down, column up)."""

    def __init__(self, rows: int, k: int):
        self.value, self.column, self.k = np.full((rows, k), -np.inf), np.full((rows, k), -1, dtype=np.int64), k

    def push(self, at: slice, value: np.ndarray, columns: np.ndarray) -> None:
        if value.shape[1] > self.k:
            # ties at the k-th place go to the smaller column, so all of them are looked at
            least = np.partition(value, value.shape[1] - self.k, axis=1)[:, -self.k]
            width = int((value >= least[:, None]).sum(axis=1).max())
            pick = np.argsort(-value, axis=1, kind="stable")[:, :width] if width > self.k else np.argpartition(-value, self.k - 1, axis=1)[:, : self.k]
            value, columns = np.take_along_axis(value, pick, axis=1), columns[pick]
        else:
            columns = np.broadcast_to(columns, value.shape)
        value = np.concatenate([self.value[at], value], axis=1)
        columns = np.concatenate([self.column[at], columns], axis=1)
        order = np.lexsort((columns, -value), axis=1)[:, : self.k]
        self.value[at], self.column[at] = np.take_along_axis(value, order, axis=1), np.take_along_axis(columns, order, axis=1)


def block_survivors(q: np.ndarray, scale: np.ndarray, error: np.ndarray, other: tuple | None, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the block and columns of ``other`` (or of the block itself) that may be among the k best of the row."""
    qb, sb, eb = other or (q, scale, error)
    rows, cols = [], []
    for i in range(0, len(q), TILE):
        at = slice(i, i + TILE)
        x, y = tile_pairs(q[at], scale[at], error[at], qb, sb, eb, k, floor, i if other is None else None)
        rows.append(x + i)
        cols.append(y)
    return np.concatenate(rows), np.concatenate(cols)


def _decode(table: pa.Table) -> tuple[np.ndarray, ...]:
    q = np.frombuffer(b"".join(table.column("q").to_pylist()), dtype=np.int8).reshape(table.num_rows, -1)
    return table.column("c").to_numpy(), q, table.column("scale").to_numpy(), table.column("error").to_numpy()


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors, dtype=np.float64))[:, None]


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[str, int, np.ndarray, np.ndarray]]:
    """(model, dimension, rows, vectors as doubles) of each model of a batch with the columns model and v."""
    model, vectors = batch.column("model").to_numpy(zero_copy_only=False), batch.column("v")
    width = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy()
    ends = np.cumsum(width)
    for m in sorted(set(model)):
        at = np.flatnonzero(model == m)
        w = int(width[at[0]])
        yield m, w, at, flat[(ends[at] - w)[:, None] + np.arange(w)[None, :]].astype(np.float64)


def _valid(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0)


class HashCollision(RuntimeError):
    """Two vectors share a 64-bit number under every seed tried."""


class Neighbours:
    """k nearest vectors of the same model by cosine similarity.

    * Null or blank ids or null models, and null, empty, all-zero vectors and those with null, NaN or infinity take no
      part. A model's vectors must have one dimension; several dimensions count as models of their own.
    * Repeated rows of an id count once. Ids with exactly equal vectors are one class: only classes are compared, and
      ids of a class come first among each other's neighbours. Ties are decided by the smaller class and id.
    * No valid vector, no rows. Only the three given columns are read.
    """

    def __init__(self, rows: DataFrame, id_: Column, model: Column, vector: Column):
        self.spark = rows.sparkSession
        self.scratch = Scratch(self.spark, "neighbours")
        vector = vector.cast("array<float>")
        base = rows.select(id_.alias("id"), model.alias("m"), vector.alias("v")).where(F.col("id").rlike(r"\S") & F.col("m").isNotNull() & _valid(F.col("v")))
        base = base.select("id", F.concat_ws("/", F.col("m"), F.size("v").cast("string")).alias("model"), "v")
        for seed in (0, 1, 2):
            # a class is known by a 64-bit hash; a second one tells whether two different vectors met in it
            self.rows = base.withColumn("c", F.xxhash64(F.lit(seed), "model", "v"))
            told = self.rows.select("c", F.hash("model", "v").alias("h"), F.size("v").alias("width")).groupBy("c").agg(F.min("h").alias("x"), F.max("h").alias("y"), F.max("width").alias("width"))
            seen = told.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("x") != F.col("y")).cast("int")).alias("clash"), F.max("width").alias("width")).first()
            if not seen["clash"]:
                self.count, self.width = seen["n"], seen["width"] or 1
                return
        raise HashCollision("three seeds gave equal numbers to different vectors")

    # ---- candidates

    def _forest(self, trees: int | None, leaf: int) -> ProjectionTrees:
        """Trees fitted on a sample of rows chosen by hash: about SAMPLE_ROWS or SAMPLE_BYTES, at most twice as much."""
        most = min(SAMPLE_ROWS, max(1, SAMPLE_BYTES // (4 * self.width)))
        share = min(1.0, most / max(1, self.count))
        part = self.rows.where(F.pmod(F.xxhash64(F.lit(3), "c"), F.lit(1 << 20)) < int(share * (1 << 20))).dropDuplicates(["c"])
        sample: dict[str, list] = {}
        table = part.select("model", "v").limit(2 * most).toArrow()
        for batch in table.to_batches():
            for m, w, at, block in _blocks(batch):
                sample.setdefault(m, []).append(_unit(block).astype(np.float32))
        return ProjectionTrees({m: np.concatenate(v) for m, v in sample.items()}, share, trees, leaf)

    def _coded(self, forest: ProjectionTrees | None) -> DataFrame:
        """c, model, q, scale, error of every class, with its leaf in each tree."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = ["c", "model", "q", "scale", "error", "leaves"]
            for batch in batches:
                for m, _, at, block in _blocks(batch):
                    q, scale, error = quantise(block)
                    c = batch.column("c").take(pa.array(at))
                    leaves = np.empty((len(at), 0), dtype=np.int64)
                    if forest is not None and m in forest.depth:
                        unit, keys = _unit(block).astype(np.float32), c.to_numpy()
                        leaves = np.stack([forest.leaves(m, unit, t, keys) for t in range(forest.trees[m])], axis=1)
                    elif forest is not None:  # a model that the sample missed has a single block
                        leaves = np.zeros((len(at), 1), dtype=np.int64)
                    offsets = pa.array(np.arange(len(at) + 1, dtype=np.int32) * leaves.shape[1])
                    yield pa.RecordBatch.from_arrays(
                        [c, pa.array([m] * len(at)), pa.array([r.tobytes() for r in q], pa.binary()), pa.array(scale), pa.array(error), pa.ListArray.from_arrays(offsets, pa.array(leaves.ravel()))], names=names
                    )

        coded = self.rows.select("c", "model", "v").mapInArrow(run, "c long, model string, q binary, scale float, error float, leaves array<long>")
        firsts = [F.first(x).alias(x) for x in ("q", "scale", "error", "leaves")]
        return self.scratch.cut(coded.groupBy("c", "model").agg(*firsts))[0]

    def candidates(self, k: int, floor: float, *, trees: int | None = None, leaf: int = LEAF, exact: bool = False) -> tuple[DataFrame, DataFrame | None]:
        """a, b (a < b): pairs of classes of a block that may be of interest to a or b; and block, c, dense: the members
        of blocks with rows of more than DENSE survivors (None if there are none)."""
        if self.count == 0:
            return self.spark.createDataFrame([], "a long, b long"), None
        if exact:
            tiles = max(1, -(-self.count // leaf))
            rows = self._coded(None)
            mine = F.pmod(F.xxhash64(F.lit(29), "c"), F.lit(tiles))
            # a row of tile i meets tile j in the block (least, greatest): every pair of tiles is one task
            spread = rows.withColumn("i", mine).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
            low, high = F.least("i", "j"), F.greatest("i", "j")
            placed = spread.select("model", (low * tiles + high).alias("block"), (F.col("i") > F.col("j")).alias("side"), "c", "q", "scale", "error")
        else:
            rows = self._coded(self._forest(trees, leaf))
            spread = rows.select("*", F.posexplode("leaves").alias("tree", "node"))
            placed = spread.select("model", (F.col("node") * 4096 + F.col("tree")).alias("block"), F.lit(False).alias("side"), "c", "q", "scale", "error")

        def join(table: pa.Table) -> pa.Table:
            block = table.column("block")[0].as_py()
            side = table.column("side").to_numpy()
            c, q, scale, error = _decode(table)
            pairs, dense = [], []

            def note(part: int, a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
                """Pairs of places x and y; rows with too many go to the float join of the block with all they met."""
                many = np.bincount(x, minlength=len(a)) > DENSE
                full = many[x]
                pairs.append(np.stack([np.minimum(a[x], b[y]), np.maximum(a[x], b[y])], axis=1)[~full])
                if full.any():
                    told = np.concatenate([np.stack([a[many], np.ones(many.sum(), np.int64)], axis=1), np.stack([b[np.unique(y[full])], np.zeros(len(np.unique(y[full])), np.int64)], axis=1)])
                    dense.append(np.concatenate([np.full((len(told), 1), part), told], axis=1))

            if exact and side.any():
                a, b = np.flatnonzero(~side), np.flatnonzero(side)
                for part, (p, r) in enumerate(((a, b), (b, a))):
                    note(part, c[p], c[r], *block_survivors(q[p], scale[p], error[p], (q[r], scale[r], error[r]), k, floor))
            else:
                for part, rows in enumerate([np.arange(len(q))] if exact else halves(q, 2 * leaf)):
                    note(part, c[rows], c[rows], *block_survivors(q[rows], scale[rows], error[rows], None, k, floor))
            found = np.unique(np.concatenate(pairs), axis=0)
            close = np.concatenate(dense) if dense else np.empty((0, 3), np.int64)
            n, m = len(found), len(close)
            name = f"{table.column('model')[0].as_py()}/{block}/"
            return pa.table(
                {
                    "a": pa.array(np.concatenate([found[:, 0], close[:, 1]])),
                    "b": pa.array(np.concatenate([found[:, 1], close[:, 2]])),
                    "block": pa.array([None] * n + [f"{name}{x}" for x in close[:, 0]], pa.string()),
                }
            )

        found, seen, _ = self.scratch.cut(placed.groupBy("model", "block").applyInArrow(join, "a long, b long, block string"), dense=F.count("block"))
        pairs = found.where(F.col("block").isNull()).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).select("a", "b")
        if not seen["dense"]:
            return pairs, None
        return pairs, found.where(F.col("block").isNotNull()).groupBy("block", F.col("a").alias("c")).agg(F.max("b").alias("dense"))

    def dense_similarities(self, members: DataFrame, k: int) -> DataFrame:
        """a, b, similarity: the k best members of its block for every dense row, from the float vectors."""

        def run(table: pa.Table) -> pa.Table:
            c, dense = table.column("c").to_numpy(), table.column("dense").to_numpy() > 0
            order = np.argsort(c, kind="stable")
            unit = np.concatenate([_unit(block)[:, :] for batch in table.combine_chunks().to_batches() for _, _, _, block in _blocks(batch)])[order]
            c, dense = c[order], dense[order]
            rows = np.flatnonzero(dense)
            best = KBest(len(rows), k)
            for i in range(0, len(rows), TILE):
                own = rows[i : i + TILE]
                for j in range(0, len(c), TILE):
                    value = np.round(unit[own] @ unit[j : j + TILE].T, 12)
                    inside = (own >= j) & (own < j + value.shape[1])
                    value[np.flatnonzero(inside), own[inside] - j] = -np.inf
                    best.push(slice(i, i + TILE), value, np.arange(j, j + value.shape[1]))
            x, y = np.nonzero(np.isfinite(best.value))
            a, b = c[rows[x]], c[best.column[x, y]]
            return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b)), "similarity": pa.array(best.value[x, y])})

        wanted = members.select("c").distinct()
        vectors = self.rows.select("c", "model", "v").join(wanted, "c", "left_semi").groupBy("c").agg(F.first("model").alias("model"), F.first("v").alias("v"))
        found = members.join(vectors, "c").groupBy("block").applyInArrow(run, "a long, b long, similarity double")
        return found.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))

    # ---- similarities

    def similarities(self, pairs: DataFrame) -> DataFrame:
        """a, b, similarity recomputed from the float vectors."""
        ends = pairs.select(F.col("a").alias("c")).unionAll(pairs.select(F.col("b").alias("c"))).groupBy("c").agg(F.count(F.lit(1)).alias("n")).select("c")
        vectors = self.rows.select("c", "v").join(ends, "c", "left_semi").groupBy("c").agg(F.first("v").alias("v"))
        both = pairs.join(vectors.withColumnRenamed("c", "a").withColumnRenamed("v", "x"), "a").join(vectors.withColumnRenamed("c", "b").withColumnRenamed("v", "y"), "b")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, y = batch.column("x"), batch.column("y")
                starts = x.offsets.to_numpy()[:-1] - x.offsets[0].as_py()
                fx, fy = x.flatten().to_numpy().astype(np.float64), y.flatten().to_numpy().astype(np.float64)
                if len(starts):
                    total = lambda v: np.add.reduceat(v, starts)
                    cosine = total(fx * fy) / np.sqrt(total(fx * fx) * total(fy * fy))
                else:
                    cosine = np.empty(0)
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(cosine)], names=["a", "b", "similarity"])

        return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, similarity double")

    def top(self, k: int, floor: float, **how) -> DataFrame:
        """id, other, similarity, place (1 .. k): the k best others of every id with a similarity of ``floor`` or more."""
        pairs, dense = self.candidates(k, floor, **how)
        pairs, _, _ = self.scratch.cut(pairs)  # read three times below
        sims = self.similarities(pairs)
        if dense is not None:
            sims = sims.unionAll(self.dense_similarities(self.scratch.cut(dense)[0], k)).groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
        sims, _, _ = self.scratch.cut(sims.where(F.col("similarity") >= floor))
        names = self.rows.select("c", "id").groupBy("c", "id").agg(F.count(F.lit(1)).alias("n")).select("c", "id")
        inside = Window.partitionBy("c").orderBy("id")
        # of a class only its first k + 1 ids can be anyone's neighbours; the limit is applied before the exchange
        front, _, _ = self.scratch.cut(names.withColumn("nth", F.row_number().over(inside)).where(F.col("nth") <= k + 1))
        directed = sims.select(F.col("a").alias("c"), F.col("b").alias("d"), "similarity").unionAll(sims.select("b", "a", "similarity"))
        best = Window.partitionBy("c").orderBy(F.desc("similarity"), "d")
        directed = directed.withColumn("p", F.row_number().over(best)).where(F.col("p") <= k).select("c", "d", "similarity")
        across = directed.join(front.select(F.col("c").alias("d"), F.col("id").alias("other"), F.col("nth")).where(F.col("nth") <= k), "d").select("c", "other", "similarity", F.lit(1).alias("tier"), "nth")
        copies = front.where(F.col("nth") == 2).select("c")
        own = front.join(copies, "c", "left_semi").select("c", F.col("id").alias("other"), F.lit(1.0).alias("similarity"), F.lit(0).alias("tier"), "nth")
        # similarities that differ by rounding alone are ties
        shared = Window.partitionBy("c").orderBy("tier", F.round("similarity", 9).desc(), "other")
        lists = across.unionAll(own).withColumn("p", F.row_number().over(shared)).where(F.col("p") <= k + 1).select("c", "other", "similarity", "p")
        each = Window.partitionBy("id").orderBy("p")
        met = names.join(lists, "c").where(F.col("id") != F.col("other")).withColumn("place", F.row_number().over(each)).where(F.col("place") <= k)
        return met.select("id", "other", "similarity", "place")
