"""Every vector against every other, by blocks of rows in numpy: similar pairs, and the nearest of many queries.

Vectors are packed into rows of at most BLOCK each, dealt out once; a nested loop then meets each block with each, without a shuffle. A task
holds two blocks and a strip of their products. Products by BLAS only choose candidates: what is compared and returned are sums in the order
of dimensions, as SQL takes them, so that equal vectors tie. The work is that of all pairs; memory, shuffle and the driver's share are not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seekspark.plans.scratch import saved

BLOCK, STRIP = 4096, 512


def packed(vectors: DataFrame, id_col: str, column: str, block: int = BLOCK) -> DataFrame:
    """(b, dim, ids, v): a block's number, ids and matrix as bytes. Rows without an id or a vector are left out; a block holds one dimension."""
    kind = "float32" if vectors.schema[column].dataType.simpleString() == "array<float>" else "float64"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(column).cast("array<float>" if kind == "float32" else "array<double>").alias("v")).where("id IS NOT NULL AND size(v) > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict = {}
        made = TaskContext.get().partitionId() << 32

        def row(dim: int, n: int) -> pa.RecordBatch:
            nonlocal made
            ids, m = (np.concatenate(x) for x in zip(*held[dim]))
            held[dim] = [(ids[n:], m[n:])]
            made += 1
            return pa.RecordBatch.from_pydict({"b": [made], "dim": pa.array([dim], pa.int32()), "ids": [ids[:n].tobytes()], "v": [m[:n].tobytes()]})

        for batch in batches:
            ids, v = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            dims = pc.list_value_length(v).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                here = dims == dim
                m = v.filter(pa.array(here)).flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, dim)
                held.setdefault(dim, []).append((ids[here], m))
                while sum(len(x) for x, _ in held[dim]) >= block:
                    yield row(dim, block)
        for dim in list(held):
            if sum(len(x) for x, _ in held[dim]):
                yield row(dim, block)

    blocks = rows.mapInArrow(run, "b long, dim int, ids binary, v binary").withColumn("kind", F.lit(kind))
    # dealt out evenly, once: a single file of few row groups would be met by a single task
    return saved(blocks.repartition(max(1, vectors.sparkSession.sparkContext.defaultParallelism)), "packed")


def _met(left: DataFrame, right: DataFrame, condition: str) -> DataFrame:
    side = lambda df, x: df.select(*[F.col(c).alias(f"{c}_{x}") for c in ("b", "dim", "ids", "v", "kind")])
    return side(left, "a").join(side(right, "c").hint("shuffle_replicate_nl"), F.expr(f"dim_a = dim_c AND {condition}"))


def _block(row: dict, x: str) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row[f"ids_{x}"], np.int64), np.frombuffer(row[f"v_{x}"], row[f"kind_{x}"]).reshape(-1, row[f"dim_{x}"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _summed(a: np.ndarray, c: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows x of a and y of c, added in the order of dimensions."""
    out = np.zeros(len(x))
    for k in range(a.shape[1]):
        out += a[x, k].astype(np.float64) * c[y, k].astype(np.float64)
    return out


def _slack(a: np.ndarray, c: np.ndarray) -> float:
    """More than BLAS can be off by, in the precision of the blocks."""
    largest = lambda m: np.sqrt(np.max((m.astype(np.float64) ** 2).sum(1), where=np.isfinite(m).all(1), initial=0.0))
    return float(2 * np.finfo(a.dtype).eps * a.shape[1] * largest(a) * largest(c))


def similar_pairs(vectors: DataFrame, id_col: str, threshold: float, limit: int | None = None, column: str = "embedding", block: int = BLOCK) -> DataFrame:
    """id_a < id_b with similarity at least the threshold, best first."""
    blocks = packed(vectors, id_col, column, block)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            (ids_a, a), (ids_c, c) = _block(r, "a"), _block(r, "c")
            with np.errstate(all="ignore"):
                slack = _slack(a, c)
                for at in range(0, len(a), STRIP):
                    x, y = np.nonzero(~(a[at : at + STRIP] @ c.T < np.float64(threshold - slack)))  # NaN counts as the greatest, as in SQL
                    x = x + at
                    keep = ids_a[x] < ids_c[y] if r["b_a"] == r["b_c"] else ids_a[x] != ids_c[y]
                    x, y = x[keep], y[keep]
                    s = _summed(a, c, x, y)
                    keep = ~(s < threshold)
                    p, q = ids_a[x[keep]], ids_c[y[keep]]
                    if len(p):
                        yield pa.RecordBatch.from_pydict({"id_a": np.minimum(p, q), "id_b": np.maximum(p, q), "similarity": s[keep]})

    found = _met(blocks, blocks, "b_a <= b_c").mapInArrow(meet, "id_a long, id_b long, similarity double")
    best = [F.desc("similarity"), "id_a", "id_b"]
    # a sort looks at its input twice, to find ranges: the pairs are kept, so that they are met once
    return saved(found.orderBy(*best).limit(limit) if limit else found, "pairs").orderBy(*best)


def nearest(queries: DataFrame, vectors: DataFrame, id_col: str, k: int, dims: int | None = None, column: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(query_id, full, vec_id, score): the k best of all vectors for each query by inner product (full) and, where dims is given, by the
    cosine of the first dims dimensions. Ties go to the smaller id; a cosine that is not defined comes first, as in SQL."""
    asked, held = packed(queries, id_col, column, block), packed(vectors, id_col, column, block)

    def cosine(a: np.ndarray, c: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        na, nc = (_summed(m, m, i, i) for m, i in ((a, np.arange(len(a))), (c, np.arange(len(c)))))
        return np.clip(_summed(a, c, x, y) / np.sqrt(na[x] * nc[y]), -1.0, 1.0)

    def unit(m: np.ndarray) -> np.ndarray:
        return m / np.sqrt((m * m).sum(1, keepdims=True))

    def best(state: tuple, q: np.ndarray, s: np.ndarray, ids: np.ndarray) -> tuple:
        q, s, ids = (np.concatenate(z) for z in zip(state, (q, s, ids)))
        order = np.lexsort((ids, -s, ~np.isnan(s), q))
        q, s, ids = q[order], s[order], ids[order]
        first = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, bool)
        place = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0)) if len(q) else np.zeros(0, int)
        return q[place < k], s[place < k], ids[place < k]

    def bound(state: tuple, n: int) -> np.ndarray:
        """The k-th best of each query so far, minus infinity where there are fewer."""
        out, (q, s, _) = np.full(n, -np.inf), state
        many = np.bincount(q, minlength=n)
        last = np.cumsum(many) - 1
        full = many >= k
        out[full] = s[last[full]]
        return out

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        now, states, ids_q = None, {}, None

        def told() -> Iterator[pa.RecordBatch]:
            for full, (q, s, ids) in states.items():
                if len(q):
                    yield pa.RecordBatch.from_pydict({"query_id": ids_q[q], "full": np.full(len(q), full), "vec_id": ids, "score": s})

        for r in _rows(batches):
            if r["b_a"] != now:  # the loop ends one block of queries before the next
                yield from told()
                now, states = r["b_a"], {True: none} | ({False: none} if dims else {})
                ids_q, a = _block(r, "a")
            ids_c, c = _block(r, "c")
            with np.errstate(all="ignore"):
                for full, state in states.items():
                    m, n = (a, c) if full else (a[:, :dims], c[:, :dims])
                    fast = (m, n) if full else (unit(m), unit(n))
                    slack = _slack(m, n) if full else 4 * float(np.finfo(m.dtype).eps) * m.shape[1]
                    for at in range(0, len(m), STRIP):
                        s = fast[0][at : at + STRIP] @ fast[1].T
                        limit = bound(state, len(m))[at : at + STRIP]
                        if np.isneginf(limit).any() and s.shape[1] > k:
                            limit = np.fmax(limit, np.partition(s, -k, axis=1)[:, -k])
                        x, y = np.nonzero(~(s < (limit - slack)[:, None]))
                        x = x + at
                        state = best(state, x, (_summed if full else cosine)(m, n, x, y), ids_c[y])
                    states[full] = state
        yield from told()

    found = _met(asked, held, "TRUE").mapInArrow(search, "query_id long, full boolean, vec_id long, score double")
    place = F.row_number().over(W.partitionBy("query_id", "full").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("place", place).where(F.col("place") <= k).drop("place")
