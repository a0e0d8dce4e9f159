"""Texts to vectors: the protocol of an embedder, batches of like length, pooling, and a deterministic embedder for tests and examples.

An embedder has `tokens(text)` (a list of ids, or None where it fails) and `forward(ids, mask)` (batch x length arrays to batch x length x dim).
`embed` sorts each Arrow batch by length, runs bounded batches, pools over the mask, scales to length one and puts rows back in order; rows
whose tokenisation fails or is empty get an empty vector, which `usable` drops. Any model that fits the protocol can be plugged in; it is
pickled to the executors and should load its weights on first use.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekspark.functions import vectors as V

BATCH, MAX_TOKENS = 64, 512


class Embedder(Protocol):
    dim: int

    def tokens(self, text: str) -> list[int] | None: ...

    def forward(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray: ...


class LengthEmbedder:
    """Each word is the unit vector of its length modulo dim: no model, the same everywhere, and expressible in SQL."""

    def __init__(self, dim: int = 8):
        self.dim = dim

    def tokens(self, text: str) -> list[int]:
        return [len(w) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]

    def forward(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        return np.eye(self.dim)[ids % self.dim] * mask[:, :, None]


def pooled(states: np.ndarray, mask: np.ndarray, pooling: str) -> np.ndarray:
    """Mean over the mask (zero where it is empty) or the first token, scaled to length one."""
    out = states[:, 0] if pooling == "cls" else (states * mask[:, :, None]).sum(1) / np.maximum(mask.sum(1), 1)[:, None]
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, size, out=np.zeros_like(out), where=size > 0)


def embed_batch(model: Embedder, texts: list, pooling: str = "mean", batch: int = BATCH, max_tokens: int = MAX_TOKENS) -> list[np.ndarray]:
    """Vectors of texts in their order. Longest first, so that a batch holds like lengths and the largest memory is asked for at once."""
    ids = [(model.tokens(t) if t is not None else None) or [] for t in texts]
    ids = [x[:max_tokens] if max_tokens else x for x in ids]
    out: list[np.ndarray] = [np.zeros(0)] * len(texts)
    order = sorted((i for i in range(len(ids)) if ids[i]), key=lambda i: -len(ids[i]))
    for k in range(0, len(order), batch):
        mine = order[k : k + batch]
        width = len(ids[mine[0]])
        padded, mask = np.zeros((len(mine), width), np.int64), np.zeros((len(mine), width))
        for row, i in enumerate(mine):
            padded[row, : len(ids[i])], mask[row, : len(ids[i])] = ids[i], 1
        for i, v in zip(mine, pooled(model.forward(padded, mask), mask, pooling)):
            out[i] = v
    return out


def embed(docs: DataFrame, text: str, model: Embedder, pooling: str = "mean", batch: int = BATCH, max_tokens: int = MAX_TOKENS, name: str = "embedding") -> DataFrame:
    """docs with their vectors; failed rows have an empty one."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(embed_batch(model, texts.tolist(), pooling, batch, max_tokens), dtype=object)

    return docs.withColumn(name, run(F.col(text)))


def usable(rows: DataFrame, name: str = "embedding") -> DataFrame:
    return rows.where(F.size(name) > 0)


def embed_query(model: Embedder, text: str, pooling: str = "mean", max_tokens: int = MAX_TOKENS) -> list[float]:
    """The vector of a query, by the same model and without a prefix."""
    return [float(x) for x in embed_batch(model, [text], pooling, 1, max_tokens)[0]]


def mean_pool(states: Column, mask: Column) -> Column:
    """Mask-weighted mean of an array of vectors; zeros where the mask is empty."""
    n = F.greatest(V.total(mask), F.lit(1.0))
    width = F.size(F.get(states, F.lit(0)))
    return F.transform(F.sequence(F.lit(0), width - 1), lambda d: V.total(F.zip_with(states, mask, lambda s, m: F.get(s, d) * m)) / n)


def cls_pool(states: Column) -> Column:
    return F.get(states, F.lit(0))


def rotation(dim: int, seed: int = 42) -> np.ndarray:
    """A seeded random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def rotated(rows: DataFrame, column: str, dim: int, seed: int = 42) -> DataFrame:
    """column turned by the rotation; rows of another dimension get null."""
    turn = rows.sparkSession.sparkContext.broadcast(rotation(dim, seed))  # dim x dim, whatever the data

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([turn.value @ np.asarray(v, float) if v is not None and len(v) == dim else None for v in b], dtype=object)

    return rows.withColumn(column, run(V.doubles(F.col(column))))


def quantisable(n: int, dim: int) -> bool:
    """Whether a corpus is worth quantising."""
    return n >= 4096 and dim >= 64 and dim % 2 == 0


def encoded(vectors: DataFrame, id_col: str, column: str, dim: int, path: str, levels: int = 16, seed: int = 42) -> DataFrame:
    """Write the corpus' codes once (id, vector, polar codes of the rotated vector) and read them back for any number of queries."""
    turned = rotated(vectors.select(id_col, F.col(column).alias("vector"), F.col(column).alias("turned")), "turned", dim, seed)
    turned.select(id_col, "vector", V.polar_codes(F.col("turned"), levels).alias("codes")).write.mode("overwrite").parquet(path)
    return vectors.sparkSession.read.parquet(path)
