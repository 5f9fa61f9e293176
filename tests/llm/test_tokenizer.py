import base64
import os

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import tokenizer as tk

PATH = f"{tk.TOKENIZER_DIR}/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no tokenizer files")


@pytest.fixture(scope="module")
def bpe():
    return tk.ByteBpe(PATH)


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=tk.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["", " ", "a", "Hello, world's end", "a" * 5000, " " * 3000 + "x", "漢字" * 2000, "\x1c\x1d a\x1fb", "½ Ⅷ 三 ٣", "\n\n\n a\r\n\t", "<|endoftext|>", "don't DON'T ’s", "é" * 700, "x" * 1025, "ab" * 512 + " ", "1234567890" * 300]


@pytest.mark.parametrize("text", TEXTS)
def test_equals_reference_encoder(bpe, reference, text):
    ids, offsets = tk.CorpusEncoder(bpe).encode([text, None, text])
    want = reference.encode_ordinary(text)
    assert ids.tolist() == want * 2 and offsets.tolist() == [0, len(want), len(want), 2 * len(want)]


def test_long_and_matrix_paths_agree(bpe):
    piece = ("abcdefgh" * 90 + "the end of all" * 20).replace(" ", "").encode()
    assert len(piece) < tk.MATRIX_WIDTH
    assert bpe._long(piece).tolist() == bpe.encode_pieces([piece])[0].tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=80), max_size=8))
def test_property(bpe, reference, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    enc = tk.CorpusEncoder(bpe)
    ids, offsets = enc.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == [reference.encode_ordinary(t) for t in texts]
    assert enc.counts(texts).tolist() == np.diff(offsets).tolist()


def test_forgets_without_error(bpe, reference, monkeypatch):
    monkeypatch.setattr(tk, "CACHE_PIECES", 3)
    enc = tk.CorpusEncoder(bpe)
    for t in ("one two three four five", "six seven eight", "one two"):
        assert enc.encode([t])[0].tolist() == reference.encode_ordinary(t)


def test_dataframe(spark, reference):
    rows = [(1, "a b", "k"), (2, None, None), (3, "", "k"), (1, "a b", "k"), (4, "long " * 30000, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = tk.encode_texts(df, "text").collect()
    assert sorted((r["doc_id"], len(r["ids"])) for r in got) == [(1, 2), (1, 2), (2, 0), (3, 0), (4, len(reference.encode_ordinary("long " * 30000)))]
    counts = tk.count_tokens(df, "text")
    assert counts.columns == ["doc_id", "ids", "n_tokens"] and sorted(r["n_tokens"] for r in counts.collect())[:2] == [0, 0]
    assert tk.encode_texts(df.limit(0), "text").count() == 0


def test_decodes_back(bpe, reference):
    text = "Round trip: naïve café № 42 → ∀x\n\tend"
    assert reference.decode(tk.CorpusEncoder(bpe).encode([text])[0].tolist()) == text


def test_decoding_gives_the_text_back(spark):
    texts = ["", "a b", "don't 漢字 ½", "x" * 3000, None]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id int, text string, ids string")
    got = tk.decode_texts(tk.encode_texts(df, "text"), "ids").orderBy("doc_id").collect()
    assert [r["text"] for r in got] == [t or "" for t in texts]
    odd = spark.createDataFrame([(1, None), (2, [])], "k int, ids array<int>")
    assert [r["text"] for r in tk.decode_texts(odd, "ids").orderBy("k").collect()] == [None, ""]


def test_long_pieces_equal_the_reference(bpe, reference):
    import random

    r = random.Random(3)
    text = "".join(r.choice("abcdefgABCDEFG") for _ in range(20_000))
    assert tk.CorpusEncoder(bpe).encode([text])[0].tolist() == reference.encode_ordinary(text)
