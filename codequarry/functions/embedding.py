"""Embedding as a pluggable batch function, with a deterministic one that needs no network."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], np.ndarray]
#: Texts a request holds.
BATCH = 128


def hashed(dim: int = 64) -> Embedder:
    """An embedder for tests: one component, chosen by a hash of the text, is 1."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for i, text in enumerate(texts):
            h = 2166136261
            for c in text:
                # Of characters beyond the basic plane the first UTF-16 unit counts.
                unit = ord(c) if ord(c) < 0x10000 else 0xD800 + ((ord(c) - 0x10000) >> 10)
                h = ((h ^ unit) * 16777619) & 0xFFFFFFFF
            signed = h - (1 << 32) if h >> 31 else h
            out[i, abs(signed) % dim] = 1
        return out

    return embed


def embedded(rows: DataFrame, text: Column, embedder: Embedder, id_col: str = "chunk_id") -> DataFrame:
    """``id_col, embedding``: unit vectors of texts, in requests of up to 128; null texts count as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["text"].fillna("").tolist()
            parts = [embedder(texts[s : s + BATCH]) for s in range(0, len(texts), BATCH)]
            x = np.concatenate(parts) if parts else np.zeros((0, 1), np.float32)
            norm = np.linalg.norm(x, axis=1, keepdims=True)
            yield pd.DataFrame({id_col: b[id_col], "embedding": list(np.where(norm == 0, x, x / np.where(norm == 0, 1, norm)).astype(np.float32))})

    return rows.select(F.col(id_col).cast("long"), text.alias("text")).mapInPandas(run, f"{id_col} long, embedding array<float>")
