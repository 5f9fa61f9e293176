"""Byte-level BPE of whole corpora with a public tokenizer's rank file.

A batch of texts is cut into pieces by the tokenizer's pattern; pieces not met before are encoded together. They are
bucketed by length into padded numpy matrices of token ids, and in every round each row merges its leftmost pair of
least rank: ranks come from a hashed pair table, finished rows are compacted away. A piece's ids are then gathered for
all its occurrences, so that the Python interpreter never touches a token.
"""

from __future__ import annotations

import base64
import heapq
import os
import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZER_DIR = "/opt/tokenizers"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: the same over ASCII text, for the standard library's faster engine
ASCII_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"""
NONE = np.int32(2**31 - 1)
MATRIX_WIDTH = 1024
CACHE_PIECES = 400_000


class PairTable:
    """Open-addressing hash table from a pair of ids to the id, and rank, of their merge."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(left)) * 4))))
        size = 1 << self.bits
        self.keys = np.full(size, 2**64 - 1, dtype=np.uint64)
        self.values = np.full(size, NONE, dtype=np.int32)
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slot, todo, self.probes = self._slot(keys), np.arange(len(keys)), 1
        while len(todo):
            free = self.keys[slot[todo]] == np.uint64(2**64 - 1)
            take = todo[free]
            _, first = np.unique(slot[take], return_index=True)
            won = take[first]
            self.keys[slot[won]], self.values[slot[won]] = keys[won], merged[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            taken = self.keys[slot[todo]] != keys[todo]
            slot[todo[taken]] = (slot[todo[taken]] + 1) & (size - 1)
            if len(todo):
                self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], NONE)
        open_ = np.flatnonzero((found != keys) & (found != np.uint64(2**64 - 1)))
        mask = len(self.keys) - 1
        where = slot[open_]
        while len(open_):
            where = (where + 1) & mask
            found = self.keys[where]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[where[hit]]
            more = ~hit & (found != np.uint64(2**64 - 1))
            open_, where = open_[more], where[more]
        return out


class ByteBpe:
    """The tokenizer of one rank file (lines of base64 token and rank)."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(rank)
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.table = PairTable(*(np.array(x, dtype=np.int64) for x in (left, right, merged)))
        self._split, self._split_ascii = regex.compile(PATTERN), re.compile(ASCII_PATTERN, re.ASCII)

    @cached_property
    def pairs(self) -> dict[int, int]:
        """The pair table as a dictionary, for single look-ups."""
        full = self.table.keys != np.uint64(2**64 - 1)
        return dict(zip(self.table.keys[full].tolist(), self.table.values[full].tolist(), strict=True))

    def pieces(self, text: str) -> list[str]:
        # \s without re.ASCII knows \x1c-\x1f as blanks, as the full pattern does not
        return self._split_ascii.findall(text) if text.isascii() else self._split.findall(text)

    # ---- encoding of pieces

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece, in order."""
        out: list = [None] * len(pieces)
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        width = 1
        while width <= MATRIX_WIDTH:
            rows = np.flatnonzero((lengths <= width) & (lengths > width // 2))
            step = max(64, (1 << 19) // width)
            for at in range(0, len(rows), step):
                self._matrix([pieces[i] for i in rows[at : at + step]], rows[at : at + step], width, out)
            width *= 2
        for i in np.flatnonzero(lengths > MATRIX_WIDTH):
            out[i] = self._long(pieces[i])
        for i in np.flatnonzero(lengths == 0):
            out[i] = np.empty(0, dtype=np.int32)
        return out

    def _matrix(self, pieces: list[bytes], rows: np.ndarray, width: int, out: list) -> None:
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(len(pieces), width)
        used = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        ids = self.byte_ids[raw]
        columns = np.arange(width)
        ids[columns[None, :] >= used[:, None]] = -1
        if width > 1:
            ranks = self._ranks(ids)
        live = np.arange(len(pieces))
        final: dict[int, np.ndarray] = {}
        while width > 1 and len(live):
            best = ranks.argmin(axis=1)  # the first of equals: leftmost
            least = ranks[np.arange(len(live)), best]
            going = least != NONE
            if not going.all():
                for k in np.flatnonzero(~going):
                    final[live[k]] = ids[k, : used[k]].copy()
                ids, ranks, used, live, best, least = (x[going] for x in (ids, ranks, used, live, best, least))
                if not len(live):
                    break
            n = np.arange(len(live))
            # close the gap after the merged pair, in ids and in the ranks that stay valid
            wide = int(used.max())
            source = np.minimum(columns[None, :wide] + (columns[None, :wide] > best[:, None]), wide - 1)
            ids, ranks = np.take_along_axis(ids[:, :wide], source, axis=1), np.take_along_axis(ranks[:, :wide], source, axis=1)
            ids[n, best] = least
            used -= 1
            ids[n, used], ranks[n, used] = -1, NONE
            ranks[n, used - 1] = NONE
            for shift in (-1, 0):  # only the two pairs beside the new token change
                at = best + shift
                ok = (at >= 0) & (at + 1 < used)
                r, c = n[ok], at[ok]
                ranks[r, c] = self.table(ids[r, c], ids[r, c + 1])
        if width == 1:
            final = {k: ids[k] for k in range(len(pieces))}
        for k, got in final.items():
            out[rows[k]] = got

    def _ranks(self, ids: np.ndarray) -> np.ndarray:
        ranks = np.full(ids.shape, NONE, dtype=np.int32)
        pairs = ids[:, 1:] >= 0
        ranks[:, :-1][pairs] = self.table(ids[:, :-1][pairs], ids[:, 1:][pairs])
        return ranks

    def _long(self, piece: bytes) -> np.ndarray:
        """The same merges for one piece of any length, by a heap over a linked list: O(n log n), where the rounds of a
        matrix of one row would be quadratic."""
        ids = self.byte_ids[np.frombuffer(piece, dtype=np.uint8)]
        first = self.table(ids[:-1], ids[1:])
        heap = [(int(first[i]), int(i)) for i in np.flatnonzero(first != NONE)]
        heapq.heapify(heap)
        ids = ids.tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        known = first.tolist() + [int(NONE)]
        get, none = self.pairs.get, int(NONE)

        def look(i: int, j: int) -> int:
            return get(ids[i] << 32 | ids[j], none)

        while heap:
            rank, i = heapq.heappop(heap)
            if known[i] != rank:
                continue
            j = after[i]
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            known[j] = int(NONE)
            if after[i] < n:
                before[after[i]] = i
                known[i] = look(i, after[i])
                if known[i] != NONE:
                    heapq.heappush(heap, (known[i], i))
            else:
                known[i] = int(NONE)
            if (h := before[i]) >= 0:
                known[h] = look(h, i)
                if known[h] != NONE:
                    heapq.heappush(heap, (known[h], h))
        return np.array([x for x in ids if x >= 0], dtype=np.int32)


class _Known(dict):
    """Piece to its number; new ones are queued."""

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        return n


class CorpusEncoder:
    """Encodes batches of texts and remembers pieces; the memory is bounded by CACHE_PIECES pieces and one batch."""

    def __init__(self, bpe: ByteBpe):
        self.bpe = bpe
        self._forget()

    def _forget(self) -> None:
        self.known, self.done = _Known(), 0
        self.flat, self.start, self.count = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Piece numbers of all texts in one array, and how many pieces each text has."""
        if len(self.known) > CACHE_PIECES:
            self._forget()
        number = self.known.__getitem__
        parts, sizes = [], np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            if text:
                got = self.bpe.pieces(text)
                sizes[i] = len(got)
                parts.append(np.fromiter(map(number, got), dtype=np.int64, count=len(got)))
        if len(self.known) > self.done:
            new = list(self.known)[self.done :]
            ids = self.bpe.encode_pieces([p.encode("utf-8", "replace") for p in new])
            count = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
            start = len(self.flat) + np.cumsum(count) - count
            self.flat, self.start, self.count = np.concatenate([self.flat, *ids]), np.concatenate([self.start, start]), np.concatenate([self.count, count])
            self.done = len(self.known)
        return (np.concatenate(parts) if parts else np.empty(0, np.int64)), sizes

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and the offsets of the texts in it (one more than texts)."""
        pieces, sizes = self._numbers(texts)
        count = self.count[pieces]
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.start[pieces] - (ends - count), count) + np.arange(total)]
        return ids, np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])]

    def counts(self, texts: list[str | None]) -> np.ndarray:
        pieces, sizes = self._numbers(texts)
        ends = np.concatenate([[0], np.cumsum(self.count[pieces])])[np.concatenate([[0], np.cumsum(sizes)])]
        return np.diff(ends)


_encoders: dict[str, CorpusEncoder] = {}


def encoder(path: str) -> CorpusEncoder:
    """The encoder of this Python worker: kept from task to task. Where ``path`` isn't on this machine, the file that
    ``ship`` sent along is read."""
    if path not in _encoders:
        _encoders[path] = CorpusEncoder(ByteBpe(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))))
    return _encoders[path]


def ship(df: DataFrame, path: str) -> str:
    """Sends the rank file to the executors of a cluster, once; they need not have the folder."""
    context = df.sparkSession.sparkContext
    if not context.master.startswith("local[") and os.path.exists(path) and not any(f.endswith("/" + os.path.basename(path)) for f in context.listFiles):
        context.addFile(path)
    return path


def _groups(texts: pa.Array, most: int = 1 << 22) -> Iterator[tuple[int, list]]:
    """Slices of about ``most`` characters: what is worked on at once doesn't grow with the length of the texts."""
    values, at, held, size = texts.to_pylist(), 0, [], 0
    for v in values:
        held.append(v)
        size += len(v or "")
        if size >= most:
            yield at, held
            at, held, size = at + len(held), [], 0
    if held:
        yield at, held


def encode_texts(df: DataFrame, text: str, out: str = "ids", tokenizer: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """``df`` with the column ``out`` (array<int>) in place of ``text``: the token ids without special tokens.

    A null or empty text has the empty list; blank text has the ids of its blanks; lone surrogates can't occur in Spark
    strings. Texts of any length are encoded whole. Rows, repeated ones too, stay as they are; a column that is already
    named ``out`` is replaced. No shuffle.
    """
    path = ship(df, f"{tokenizer_dir}/{tokenizer}.tiktoken")
    keep = [f for f in df.schema.fields if f.name not in (text, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for at, texts in _groups(batch.column(batch.num_columns - 1)):
                ids, offsets = enc.encode(texts)
                rest = [batch.column(i).slice(at, len(texts)) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*rest, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))], names=[*[f.name for f in keep], out])

    schema = T.StructType([*keep, T.StructField(out, T.ArrayType(T.IntegerType(), True), True)])
    return df.select(*[F.col(f"`{f.name}`") for f in keep], F.col(f"`{text}`").alias("__text")).mapInArrow(run, schema)


def decode_texts(df: DataFrame, ids: str, out: str = "text", tokenizer: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """``df`` with the text of a column of token ids in place of it. Null ids have a null text, an empty list an empty
    one; ids that do not add up to UTF-8 have replacement characters; unknown ids are an error."""
    path = ship(df, f"{tokenizer_dir}/{tokenizer}.tiktoken")
    keep = [f for f in df.schema.fields if f.name not in (ids, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path).bpe.tokens
        for batch in batches:
            lists = batch.column(batch.num_columns - 1).to_pylist()
            texts = [None if x is None else b"".join([tokens[i] for i in x]).decode("utf-8", "replace") for x in lists]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(texts, pa.string())], names=[*[f.name for f in keep], out])

    schema = T.StructType([*keep, T.StructField(out, T.StringType(), True)])
    return df.select(*[F.col(f"`{f.name}`") for f in keep], F.col(f"`{ids}`").alias("__ids")).mapInArrow(run, schema)


def count_tokens(df: DataFrame, text: str, out: str = "n_tokens", tokenizer: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """As ``encode_texts``, with the number of ids (bigint) only; null and empty texts have 0."""
    path = ship(df, f"{tokenizer_dir}/{tokenizer}.tiktoken")
    keep = [f for f in df.schema.fields if f.name not in (text, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for at, texts in _groups(batch.column(batch.num_columns - 1)):
                rest = [batch.column(i).slice(at, len(texts)) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(enc.counts(texts), pa.int64())], names=[*[f.name for f in keep], out])

    schema = T.StructType([*keep, T.StructField(out, T.LongType(), True)])
    return df.select(*[F.col(f"`{f.name}`") for f in keep], F.col(f"`{text}`").alias("__text")).mapInArrow(run, schema)
