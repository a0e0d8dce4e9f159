"""Approximate nearest neighbours by multi-index hashing over learned rotated binary codes.

Rotations are learned by iterative quantisation on a bounded sample: of the centred vectors, ROTATIONS different orthogonal
rotations each turn the signs into as many bits as there are dimensions. A code is split into substrings of PIECE bits, each of which has
an index from substring value to the rows that hold it. For a Hamming radius r, a code within r of the query agrees with it within
r_j bits in some substring j if the sum of (r_j + 1) exceeds r; probing all values within those r_j of every substring therefore
retrieves every code within r. Where the probed buckets hold more entries than there are rows, the codes themselves are read instead, which
retrieves the same. What is retrieved is checked on the full code, and the floats are ranked in double precision.
The radius is the one that held TARGET of the true neighbours of sample queries in the sample; as the data grow denser, neighbours
come nearer, so recall rises.

Index rows are dealt by hash into shards of about SHARD rows and queries into blocks of about BLOCK rows; each shard meets each
block in a task of bounded memory and returns at most k neighbours a query, which are merged. No row is dropped and no bucket is capped.

Defined results: vectors that are null, zero, of another length than most, or with null or non-finite components take no part. Null ids take no part.
A score is the sum of products in order of the components, so equal vectors have equal scores; ties go to the smaller id. Repeated vectors
are separate candidates; a query never finds its own id. Rows that share an id and a vector count once. Fewer than k candidates are all found.
An empty table gives no rows. Other columns are not returned, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekspark.llm import common

SAMPLE, SAMPLE_QUERIES, ROTATIONS, STEPS, PIECE, TARGET = 8000, 400, 4, 30, 8, 0.985
SHARD, BLOCK, K = 1 << 16, 1 << 14, 20
POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


@dataclass
class Codes:
    mean: np.ndarray
    rotation: np.ndarray  # dim x bits
    radius: int

    def of(self, x: np.ndarray) -> np.ndarray:
        """Codes as bytes, one substring a byte."""
        return np.packbits((x - self.mean) @ self.rotation > 0, axis=1)


def learn(x: np.ndarray, k: int = K, seed: int = 3) -> Codes:
    rng, dim = np.random.default_rng(seed), x.shape[1]
    mean = x.mean(0)
    z, parts = x - mean, []
    basis = np.linalg.eigh(z.T @ z)[1].T[::-1]  # principal directions, from a dim x dim matrix
    for _ in range(ROTATIONS):
        r = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        p = z @ basis.T
        for _ in range(STEPS):  # iterative quantisation: alternate signs and the best rotation onto them
            u, _, vt = np.linalg.svd(np.sign(p @ r).T @ p)
            r = (u @ vt).T
        parts.append(basis.T @ r)
    rotation = np.concatenate(parts, 1)
    rotation = np.pad(rotation, ((0, 0), (0, -rotation.shape[1] % PIECE)))
    codes = Codes(mean, rotation, rotation.shape[1])
    held = codes.of(x)
    seen = []
    for i in range(0, len(x), max(1, len(x) // SAMPLE_QUERIES)):
        s = x @ x[i]
        s[i] = -np.inf
        near = np.argsort(-s, kind="stable")[: min(k, len(x) - 1)]
        seen.append(POPCOUNT[held[near] ^ held[i]].sum(1))
    if seen and sum(map(len, seen)):
        codes.radius = int(np.quantile(np.concatenate(seen), TARGET, method="higher"))
    return codes


class MultiIndex:
    """One substring index for each byte of the codes of a shard."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.wide = codes, wide(codes)
        self.order = [np.argsort(codes[:, j], kind="stable").astype(np.int32) for j in range(codes.shape[1])]
        self.cuts = np.stack([np.searchsorted(codes[o, j], np.arange(257)) for j, o in enumerate(self.order)])
        self.near = POPCOUNT[np.arange(256)[:, None] ^ np.arange(256)[None]]  # query byte x bucket

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """The rows whose code is within radius of code: pigeonhole probing, then a check of the full code."""
        m = len(self.order)
        base, more = divmod(radius, m)
        reach = np.where(np.arange(m) <= more, base, base - 1)  # the sum of (reach + 1) is radius + 1
        hits = self.near[code] <= reach[:, None]  # substring x bucket
        rows: np.ndarray | slice = slice(None)
        if (np.diff(self.cuts, axis=1) * hits).sum() < len(self.codes):
            found = np.zeros(len(self.codes), bool)
            for j, v in zip(*np.nonzero(hits)):
                found[self.order[j][self.cuts[j, v] : self.cuts[j, v + 1]]] = True
            rows = np.flatnonzero(found)
        away = np.bitwise_count(self.wide[rows] ^ wide(code[None])).sum(1, dtype=np.int32)
        near = np.flatnonzero(away <= radius)
        return near if isinstance(rows, slice) else rows[near]


def wide(codes: np.ndarray) -> np.ndarray:
    """Codes as 64-bit words."""
    return np.ascontiguousarray(np.pad(codes, ((0, 0), (0, -codes.shape[1] % 8)))).view(np.uint64)


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products, each summed in order of the components: equal rows give equal results wherever they stand."""
    out = np.zeros(len(x))
    for j in range(len(q)):
        out += x[:, j] * q[j]
    return out


def best(x: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k rows nearest to q. A fast product finds all that may be among them, with a margin for its rounding."""
    rough = x @ q
    if len(rough) > k:
        edge = np.partition(rough, len(rough) - k)[len(rough) - k]
        some = np.flatnonzero(rough >= edge - 1e-9 * max(1.0, float(np.abs(rough).max())))
        x, ids = x[some], ids[some]
    score = products(x, q)
    top = np.lexsort((ids, -score))[:k]
    return ids[top], score[top]


def usable(vectors: DataFrame, id_col: str, column: str) -> DataFrame:
    v = F.col(column)
    sane = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).alias("id"), v.cast("array<double>").alias("v")).where(F.col("id").isNotNull() & v.isNotNull() & F.coalesce(sane, F.lit(False)))


def neighbours(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", column: str = "embedding", k: int = K) -> DataFrame:
    """query_id, rank, id_col, score: each query's k nearest by inner product among vectors. queries: rows of the same columns."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, column)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    out = f"query_id long, rank int, {id_col} long, score double"
    if not sizes:
        return spark.createDataFrame([], out)
    dim, n = sizes[0].d, sizes[0]["count"]
    rows, asked = (x.where(F.size("v") == dim) for x in (rows, usable(queries, id_col, column)))
    sample = np.array([r.v for r in common.bounded_sample(rows, "id", SAMPLE).select("v").collect()])
    codes = learn(sample, k)
    shards, blocks = max(8, -(-n // SHARD)), max(1, -(-asked.count() // BLOCK))
    shared = spark.sparkContext.broadcast((codes.mean, codes.rotation, codes.radius))  # dim x bits, whatever the data
    # every shard meets every block: index rows go to each block, query rows to each shard
    index = rows.withColumns({"shard": F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"), "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    asking = asked.withColumns({"block": F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(blocks)).cast("int"), "shard": F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))})

    def meet(held: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        learned, found = Codes(*shared.value), [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(held) and len(block):
            x, q = np.stack(held["v"].to_numpy()), np.stack(block["v"].to_numpy())
            ids, index_, asked_codes = held["id"].to_numpy(np.int64), MultiIndex(learned.of(x)), learned.of(q)
            for i, me in enumerate(block["id"].to_numpy(np.int64)):
                near = index_.within(asked_codes[i], learned.radius)
                near = near[ids[near] != me]
                if len(near) < min(k, len(ids)):  # the radius holds too few here: the whole shard is ranked
                    near = np.flatnonzero(ids != me)
                top, score = best(x[near], ids[near], q[i], k)
                found.append((np.full(len(top), me), top, score))
        return pd.DataFrame(dict(zip(("query_id", "cand", "score"), map(np.concatenate, zip(*found)))))

    part = asking.groupBy("shard", "block").cogroup(index.groupBy("shard", "block")).applyInPandas(lambda b, h: meet(h, b), "query_id long, cand long, score double")
    # merging: at most k x shards rows a query
    merged = part.distinct().groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "cand"))), 1, k).alias("b"))
    ranked = merged.select("query_id", F.posexplode("b").alias("pos", "b"))
    return ranked.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("b.cand").alias(id_col), (-F.col("b.s")).alias("score"))


def op10(spark, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return neighbours(vectors, vectors.where(F.col("vec_id") % 20 == 0))
