"""Vectors as arrays, and a deterministic text embedder."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in doubles; null where a vector is null or has no length."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


#: Anything from texts to one unit vector each can stand in for the embedder.
Embedder = Callable[[list[str]], np.ndarray]


class HashedNgrams:
    """Signed counts of hashed character n-grams, scaled to length 1. The same text always gives the same vector, on any machine."""

    def __init__(self, dim: int = 256, lo: int = 3, hi: int = 5):
        self.dim, self.lo, self.hi = dim, lo, hi

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for i, t in enumerate(texts):
            s = f" {' '.join((t or '').lower().split())} ".encode()
            for n in range(self.lo, self.hi + 1):
                for k in range(len(s) - n + 1):
                    h = xxhash.xxh32_intdigest(s[k : k + n])
                    out[i, (h >> 1) % self.dim] += 1.0 if h & 1 else -1.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)


class LetterCounts:
    """How often each letter and figure occurs; with ``unit`` scaled to length 1. Small enough to be said in SQL."""

    SIGNS = "abcdefghijklmnopqrstuvwxyz0123456789"

    def __init__(self, unit: bool = False):
        self.unit = unit

    def __call__(self, texts: list[str]) -> np.ndarray:
        x = np.array([[t.lower().count(c) for c in self.SIGNS] for t in texts], np.float64).reshape(len(texts), len(self.SIGNS))
        if self.unit:
            n = np.sqrt((x * x).sum(1, keepdims=True))
            x /= np.where(n > 0, n, 1)
        return x


def embed(embedder: Embedder | None = None):
    """A vectorised UDF from text to array<float>; a null text gives null. Apply it to distinct texts."""
    use = embedder or HashedNgrams()

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        have = texts.notna()
        made = iter(use(texts[have].tolist()) if have.any() else ())
        return pd.Series([next(made) if h else None for h in have], index=texts.index, dtype=object)

    return run
