"""Keyword and vector ranking, fusion, normalisation, boosts and pages. Ties always go to the smaller id."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from seekspark.functions import text as T
from seekspark.functions import vectors as V

K1, B = 1.2, 0.75
#: Weights of name, path and body, as the reference's search effectively applies them.
FIELD_WEIGHTS = (9.0, 2.25, 1.0)


def bm25(docs: DataFrame, id_col: str, fields: dict[str, float], terms: list[str], k: int | None, tokens=T.plain_tokens, k1: float = K1, b: float = B) -> DataFrame:
    """The k best rows for any of the terms, without an index: texts are read and tokenised twice, for the statistics and for the scores.
    `postings` reads an index instead. Only one row of corpus statistics is joined back.

    A term may hold a space: it is then a phrase, counted where its words follow each other, with the rarity of its words together.
    """
    # one generator row holds the token arrays, so that the optimiser does not copy the splitting into each of their uses
    rows = docs.select(id_col, F.explode(F.array(F.struct(*[tokens(F.col(f)).alias(f"t_{i}") for i, f in enumerate(fields)]))).alias("_t")).select(id_col, "_t.*")
    tf: dict[tuple[int, int], Column] = {}
    seen: dict[tuple[int, int, int], Column] = {}
    for i, _ in enumerate(fields):
        toks = F.col(f"t_{i}")
        for j, term in enumerate(terms):
            words = term.split(" ")
            at = F.filter(F.transform(toks, lambda x, p: F.when(x == words[0], p)), lambda p: p.isNotNull())
            if len(words) > 1:
                at = F.filter(at, _follows(toks, words))
            tf[i, j] = F.size(at)
            for d, w in enumerate(words):
                seen[i, j, d] = F.array_contains(toks, w)
    counted = rows.select(id_col, *[F.size(f"t_{i}").alias(f"len_{i}") for i, _ in enumerate(fields)], *[c.alias(f"tf_{i}_{j}") for (i, j), c in tf.items()], *[c.cast("int").alias(f"has_{i}_{j}_{d}") for (i, j, d), c in seen.items()])
    stats = counted.agg(F.count("*").alias("n"), *[F.avg(f"len_{i}").alias(f"avg_{i}") for i, _ in enumerate(fields)], *[F.sum(f"has_{i}_{j}_{d}").alias(f"df_{i}_{j}_{d}") for i, j, d in seen])
    scored = counted.where(_any([F.col(f"tf_{i}_{j}") > 0 for i, j in tf])).crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i, (_, weight) in enumerate(fields.items()):
        for j, term in enumerate(terms):
            idf = F.lit(0.0)
            for d in range(len(term.split(" "))):
                df = F.col(f"df_{i}_{j}_{d}")
                idf = idf + F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
            f = F.col(f"tf_{i}_{j}")
            score = score + weight * idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col(f"len_{i}") / F.greatest(F.col(f"avg_{i}"), F.lit(1e-9))))
    return top(scored.select(id_col, score.alias("score")), "score", id_col, k)


def _follows(toks: Column, words: list[str]):
    return lambda p: _all([F.get(toks, p + d) == w for d, w in enumerate(words)])


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & F.coalesce(c, F.lit(False))
    return out


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def top(rows: DataFrame, score: str, id_col: str, k: int | None) -> DataFrame:
    """Ordered by score and id; k None or 0: all."""
    out = rows.orderBy(F.desc(score), id_col)
    return out.limit(k) if k else out


def vector_of(vectors: DataFrame, id_col: str, value: int, column: str = "embedding") -> list[float] | None:
    """One row's vector (point lookup)."""
    row = vectors.where(F.col(id_col) == value).select(V.doubles(F.col(column)).alias("v")).first()
    return row.v if row else None


def literal(query: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in query])


def exact_rank(vectors: DataFrame, id_col: str, query: list[float], threshold: float | None = None, k: int | None = None, column: str = "embedding") -> DataFrame:
    """Rows whose inner product with the query reaches the threshold, best first. Other dimensions: no match."""
    scored = vectors.select(id_col, V.dot(F.col(column), literal(query)).alias("score")).where(F.col("score").isNotNull())
    return top(scored.where(F.col("score") >= threshold) if threshold is not None else scored, "score", id_col, k)


def similar(vectors: DataFrame, id_col: str, value: int, k: int = 10, offset: int = 0) -> DataFrame:
    """The neighbours of a row but for itself, at least at right angles, by page."""
    found = exact_rank(vectors.where(F.col(id_col) != value), id_col, vector_of(vectors, id_col, value), 0.0, offset + k)
    return found.offset(offset) if offset else found


def cascade_rank(vectors: DataFrame, id_col: str, query: list[float], d: int, k: int, threshold: float = 0.0, column: str = "embedding") -> DataFrame:
    """First max(100, 3k) by truncated layer-normalised vectors, then exact scores."""
    short = lambda c: V.truncated(V.layer_norm(c), d)
    first = vectors.select(id_col, column, V.dot(short(F.col(column)), short(literal(query))).alias("rough"))
    first = top(first, "rough", id_col, max(100, 3 * k))
    return exact_rank(first, id_col, query, threshold, k, column)


def quantised_rank(vectors: DataFrame, id_col: str, query: list[float], k: int, levels: int = 16, threshold: float = 0.0, column: str = "embedding", centre: bool = False) -> DataFrame:
    """First 10k by polar codes, then exact scores."""
    first = vectors.select(id_col, column, V.quantised_dot(V.polar_codes(F.col(column), levels), query, levels, centre).alias("rough"))
    return exact_rank(top(first, "rough", id_col, 10 * k), id_col, query, threshold, k, column)


def ranked(rows: DataFrame, id_col: str, score: str = "score") -> DataFrame:
    """A 0-based rank; for lists that a limit bounds."""
    return rows.withColumn("rank", F.row_number().over(W.orderBy(F.desc(score), id_col)) - 1)


def reciprocal_rank_fusion(lists: list[DataFrame], id_col: str, k0: int = 60) -> DataFrame:
    """Sum of 1 / (k0 + rank + 1) over bounded lists."""
    parts = [ranked(x, id_col).select(id_col, (1.0 / (k0 + F.col("rank") + 1)).alias("s")) for x in lists]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(id_col).agg(F.sum("s").alias("score")).orderBy(F.desc("score"), id_col)


def min_max(rows: DataFrame, score: str = "score") -> DataFrame:
    """Scores between 0 and 1 over the candidate list; all 1 if they are equal."""
    ends = rows.agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
    span = F.col("hi") - F.col("lo")
    return rows.crossJoin(F.broadcast(ends)).withColumn(score, F.when(span <= 1.1920929e-07, 1.0).otherwise((F.col(score) - F.col("lo")) / span)).drop("lo", "hi")


def thresholded(rows: DataFrame, id_col: str, threshold: float | None, k: int | None, score: str = "score") -> DataFrame:
    return top(rows.where(F.col(score) >= threshold) if threshold is not None else rows, score, id_col, k)


def saturated_boost(score: Column, rank: Column, alpha: Column | float) -> Column:
    """Score lifted by a log-saturated structural rank."""
    return score * (1 + alpha * F.log(1 + 10 * rank) / math.log(11))


def boosted(rows: DataFrame, id_col: str, ranks: DataFrame, keys: list[str], alpha: float) -> DataFrame:
    """Boost by the first of several keys that ranks (key, rank) holds; rows without one keep their score."""
    out, found = rows, F.lit(None).cast("double")
    for i, key in enumerate(keys):
        out = out.join(ranks.select(F.col("key").alias(f"_k{i}"), F.col("rank").alias(f"_r{i}")), F.col(key) == F.col(f"_k{i}"), "left")
    found = F.coalesce(*[F.col(f"_r{i}") for i in range(len(keys))], F.lit(0.0))
    return out.withColumn("score", saturated_boost(F.col("score"), found, alpha)).select(rows.columns).orderBy(F.desc("score"), id_col)


def additive_boost(rows: DataFrame, rank: str, alpha: float, score: str = "score") -> DataFrame:
    """Min-max score plus alpha times a rank column."""
    return min_max(rows, score).withColumn(score, F.col(score) + alpha * F.col(rank))


def page(rows: DataFrame, offset: int, k: int) -> DataFrame:
    return rows.offset(offset).limit(k)


def mean_recall(recalls: DataFrame, semantic: float = 0.9, hybrid: float = 0.98) -> DataFrame:
    """One row: how many queries, their mean recall, and whether it passes either mark."""
    mean = F.avg("recall")
    return recalls.agg(F.count("*").alias("queries"), mean.alias("recall"), (mean >= semantic).alias("semantic_pass"), (mean >= hybrid).alias("hybrid_pass"))


def recall(rows: DataFrame, expected: str, got: str) -> DataFrame:
    """rows with recall: the share of the distinct expected items found."""
    want = F.array_distinct(expected)
    return rows.withColumn("recall", F.size(F.array_intersect(want, F.array_distinct(got))) / F.size(want))
