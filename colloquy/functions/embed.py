"""Embedders: what turns texts into unit vectors.

The engine takes any object with ``name``, ``dimension`` and ``embed(texts) -> array``.  The default hashes words into signed
dimensions, so it knows equal words and nothing of meaning; a model is put in its place by the caller.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .text import embedded_text, query_terms


class Embedder(Protocol):
    name: str
    dimension: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedder:
    def __init__(self, dimension: int = 64):
        self.name, self.dimension = f"hash-{dimension}", dimension

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension), np.float32)
        for i, text in enumerate(texts):
            for t in query_terms(text):
                h = zlib.crc32(t.encode())
                out[i, h % self.dimension] += 1 if h >> 31 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embed_exchanges(exchanges: DataFrame, embedder: Embedder) -> DataFrame:
    """(id, embedding) of all exchanges that aren't of a side chain."""
    texts = exchanges.filter("not coalesce(is_sidechain, false)").select("id", embedded_text(exchanges.user_message, exchanges.assistant_message).alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"id": f.id, "embedding": list(embedder.embed(f.text.fillna("").tolist()))})

    return texts.mapInPandas(run, "id long, embedding array<float>")
