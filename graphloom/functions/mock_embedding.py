"""A deterministic stand-in for an embedding service, and the interface a real one has to meet."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Provider = Callable[[list[str]], list["list[float] | None"]]


def mock_embedding(text: str, dimensions: int = 128) -> list[float]:
    """Unit vector of a text from its length, vowels, SHA-256 bytes and a sine; an empty text is an error.

    Slots that would need another language's random generator (every fourth beyond 130 dimensions) take further bytes of
    a hash chain instead.
    """
    if not text:
        raise ValueError("text is empty")
    raw = text.encode()
    digest = hashlib.sha256(raw).digest()
    seed = int.from_bytes(digest[:8], "big") & 0x7FFF_FFFF_FFFF_FFFF
    chain = digest
    while len(chain) * 4 < dimensions:
        chain += hashlib.sha256(chain).digest()
    vowels = sum(c in "aeiouAEIOU" for c in text)
    # fixed values: the four kinds of slots and their ranges of -1 to 1
    i = np.arange(dimensions)
    slots = np.empty(dimensions)
    slots[0::4] = (len(raw) % 100) / 100.0 * 2.0 - 1.0
    slots[1::4] = (vowels % 50) / 50.0 * 2.0 - 1.0
    slots[2::4] = np.frombuffer(chain, dtype=np.uint8)[: len(slots[2::4])] / 255.0 * 2.0 - 1.0
    slots[3::4] = np.sin(i[3::4] * 0.1 + (seed % 1000) * 0.01)
    out = slots.astype(np.float32)
    norm = float(np.sqrt((out * out).astype(np.float64).sum()))
    return (out / np.float32(norm)).tolist() if norm else out.tolist()


def mock_provider(dimensions: int = 128) -> Provider:
    return lambda texts: [mock_embedding(t, dimensions) if t else None for t in texts]


def embed(df: DataFrame, text: str, provider: Provider, *, parallelism: int = 5, out: str = "embedding") -> DataFrame:
    """``df`` with a vector of ``text``; rows whose text is null or empty, or which the provider fails on, have null.

    At most ``parallelism`` tasks call the provider at once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b[text].tolist()
            try:
                got = provider(texts)
            except Exception:  # one at a time: a bad row must not take the batch with it
                got = []
                for t in texts:
                    try:
                        got += provider([t])
                    except Exception:
                        got.append(None)
            yield b.assign(**{out: got})

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields], f"`{out}` array<float>"])
    return df.repartition(parallelism).mapInPandas(run, schema)


def embedded_nodes(nodes: DataFrame, provider: Provider, **how) -> DataFrame:
    """Vectors for functions, methods, structs and interfaces from their summaries."""
    return embed(nodes.where(F.col("type").isin("function", "method", "struct", "interface")).select("id", "semantic_summary"), "semantic_summary", provider, **how)
