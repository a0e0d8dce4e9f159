"""An inverted index as Parquet tables, and keyword search that reads only the terms asked for.

`postings` (seg, field, term, n, rows, ids, lens, tfs, pos) is made where the documents lie: each batch of documents is a segment, and a row of it
holds all that a term has there, a list over the n documents with it: place in the segment, id, tokens of the field, how often and where.
A segment's rows are sorted by term, so a search skips pages; those of the empty term list all of its documents. `stats` holds one row a
field. A build reads texts once and shuffles nothing. A search counts documents of its terms from n and then scores in one aggregation by
document; no text is read again.

Query syntax: bare words (any of them), "quoted phrases", AND between clauses that must both match, field:word. A word or phrase of several
tokens is a phrase. A query that does not parse (an open quote, a field that is not there, an operator without a side) matches every
document with score 1.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seekspark.functions import text as T
from seekspark.operators.ranking import B, K1, top

#: Rows of a Parquet page, the least that a search reads of a segment, and bytes of a row group.
PAGE_ROWS, GROUP_BYTES = 1000, 32 << 20
#: Parts tokens on their way to Python, where one string a document is far cheaper than an array; no token holds it.
MARK = "\x1f"
CLAUSE = re.compile(r'\s*(?:(\w+):)?(?:"([^"]*)"|([^\s"]+))')


@dataclass
class Index:
    """Where an index lies, its fields with their weights, its tokenizer, and what builds it when it is first read, if it is not there yet."""

    spark: SparkSession
    path: str
    weights: dict[str, float]
    tokens: object = T.code_tokens
    make: Callable[[], object] | None = None

    def table(self, name: str) -> DataFrame:
        if self.make:
            self.make()
            self.make = None
        return self.spark.read.parquet(f"{self.path}/{name}")


@dataclass(frozen=True)
class Clause:
    words: tuple[str, ...]
    field: str | None = None
    must: bool = False


def build(docs: DataFrame, id_col: str, fields: dict[str, Column | str], weights: dict[str, float], path: str, tokens=T.code_tokens) -> Index:
    """Write the index of docs. Null fields are empty; repeated ids are documents of their own, whose scores a search adds."""
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    names, kind = list(fields), docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), *[F.array_join(tokens(F.coalesce(as_column(c), F.lit(""))), MARK).alias(f"t{i}") for i, c in enumerate(fields.values())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seg = TaskContext.get().partitionId() << 32
        for batch in batches:
            seg += 1
            for i, name in enumerate(names):
                for part in _segment(batch.column(0), batch.column(i + 1)):
                    n = part.num_rows
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, seg)), pa.array([name] * n, pa.string()), *part.columns], ["seg", "field", *part.schema.names])

    schema = f"seg long, field string, term string, n int, rows array<int>, ids array<{kind}>, lens array<int>, tfs array<int>, pos array<array<int>>"
    made = rows.mapInArrow(run, schema).write.mode("overwrite").option("compression", "zstd")
    made.option("parquet.page.row.count.limit", PAGE_ROWS).option("parquet.block.size", GROUP_BYTES).parquet(f"{path}/postings")
    all_of = docs.sparkSession.read.parquet(f"{path}/postings").where("term = ''")
    total = all_of.groupBy("field").agg(F.sum("n").alias("n"), F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("len"))
    total.select("field", "n", (F.col("len") / F.col("n")).alias("avg_len")).coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
    return Index(docs.sparkSession, path, weights, tokens)


def _segment(ids: pa.Array, joined: pa.Array) -> Iterator[pa.RecordBatch]:
    """The rows of one field of a batch of documents: the empty term's, then those of its terms in their order."""
    n = len(ids)
    tokens = pc.split_pattern(joined, MARK)
    lens = np.where(pc.binary_length(joined).to_numpy(zero_copy_only=False) > 0, pc.list_value_length(tokens).to_numpy(zero_copy_only=False), 0).astype(np.int32)

    def batch(terms: pa.Array, cuts: np.ndarray, doc: np.ndarray, tf: np.ndarray, ends: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
        lists = lambda values: pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), values)
        where = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(pos, pa.int32()))
        columns = [terms, pa.array(np.diff(cuts), pa.int32()), lists(pa.array(doc, pa.int32())), lists(ids.take(pa.array(doc))), lists(pa.array(lens[doc], pa.int32())), lists(pa.array(tf, pa.int32())), lists(where)]
        return pa.RecordBatch.from_arrays(columns, ["term", "n", "rows", "ids", "lens", "tfs", "pos"])

    all_docs, none = np.arange(n), np.zeros(0, np.int64)
    yield batch(pa.array([""], pa.string()), np.array([0, n]), all_docs, np.zeros(n, np.int32), np.zeros(n + 1, np.int32), none)
    coded = tokens.filter(pa.array(lens > 0)).flatten().dictionary_encode()
    total = len(coded)
    if not total:
        return
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    doc = np.repeat(all_docs, lens)
    pos = np.arange(total) - np.repeat(np.cumsum(lens) - lens, lens)
    both = np.sort(rank[coded.indices.to_numpy()] << 32 | np.arange(total))  # by term, then as the tokens stand
    term, at = both >> 32, both & 0xFFFFFFFF
    doc, pos = doc[at], pos[at]
    starts = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])])
    first = np.flatnonzero(np.r_[True, term[starts][1:] != term[starts][:-1]])
    ends = np.r_[starts, total]
    yield batch(coded.dictionary.take(pa.array(order)), np.r_[first, len(starts)], doc[starts], np.diff(ends), ends, pos)


def split(index: Index, phrase: str) -> tuple[str, ...]:
    """The index's tokens of a query word or phrase (a constant expression: no job runs)."""
    return tuple(index.spark.range(1).select(index.tokens(F.lit(phrase)).alias("t")).first().t)


def parsed(index: Index, query: str) -> list[Clause] | None:
    """The clauses of a query, or None where it does not parse."""
    if query.count('"') % 2:
        return None
    out: list[Clause] = []
    both = False
    for field, quoted, word in CLAUSE.findall(query):
        if word in ("AND", "OR") and not field:
            if not out or both:
                return None
            both = word == "AND"
            if both:
                out[-1] = Clause(out[-1].words, out[-1].field, True)
            continue
        if field and field not in index.weights:
            return None
        words = split(index, quoted or word)
        if words:
            out.append(Clause(words, field or None, both))
            both = False
    return None if both else out


def search(index: Index, query: str | list[Clause], k: int | None = None, id_name: str = "id", k1: float = K1, b: float = B) -> DataFrame:
    """(id_name, score) of the k best; k None or 0: all. A blank query finds nothing."""
    clauses = parsed(index, query) if isinstance(query, str) else query
    postings = index.table("postings")
    if clauses is None:
        found = postings.where("term = ''").select("seg", F.explode(F.arrays_zip("rows", "ids", "lens")).alias("p")).where("p.lens > 0").select("seg", F.col("p.rows").alias("row"), F.col("p.ids").alias("id"))
        found = found.distinct() if len(index.weights) > 1 else found
        return top(found.select(F.col("id").alias(id_name), F.lit(1.0).alias("score")), "score", id_name, k)
    words = sorted({w for c in clauses for w in c.words})
    if not words:
        return postings.limit(0).select(F.get("ids", F.lit(0)).alias(id_name), F.lit(0.0).alias("score"))
    stats = {r.field: r for r in index.table("stats").collect()}  # one row a field
    asked_for = postings.where(F.col("term").isin(*words))
    df = {(r.field, r.term): r.df for r in asked_for.groupBy("field", "term").agg(F.sum("n").alias("df")).collect()}  # at most words x fields rows
    phrased = sorted({w for c in clauses if len(c.words) > 1 for w in c.words})
    names = [name for name in index.weights if name in stats]
    cell = lambda name, w: (F.col("field") == name) & (F.col("term") == w)
    at = {(name, w): f"{i}_{j}" for i, name in enumerate(names) for j, w in enumerate(words)}
    lengths = [F.max(F.when(F.col("field") == name, F.col("p.lens"))).alias(f"l{i}") for i, name in enumerate(names)]
    counts = [F.max(F.when(cell(*x), F.col("p.tfs"))).alias(f"c{n}") for x, n in at.items()]
    places = [F.first(F.when(cell(*x), F.col("p.pos")), ignorenulls=True).alias(f"p{n}") for x, n in at.items() if x[1] in phrased]
    each = asked_for.select("seg", "field", "term", F.explode(F.arrays_zip("rows", "ids", "lens", "tfs", *(["pos"] if phrased else []))).alias("p"))
    rows = each.groupBy("seg", F.col("p.rows").alias("row"), F.col("p.ids").alias("id")).agg(*lengths, *counts, *places)
    scores = []
    for c in clauses:
        score = F.lit(0.0)
        for i, name in enumerate(names):
            if c.field and c.field != name:
                continue
            s, tf = stats[name], F.col(f"c{at[name, c.words[0]]}")
            if len(c.words) > 1:
                there = lambda w: F.coalesce(F.col(f"p{at[name, w]}"), F.array().cast("array<int>"))  # noqa: B023, E731
                first = there(c.words[0])
                for d, w in enumerate(c.words[1:], 1):
                    first = F.transform(F.array_intersect(F.transform(first, lambda p: p + d), there(w)), lambda p: p - d)  # noqa: B023
                tf = F.size(first)
            idf = sum(_idf(s.n, df.get((name, w), 0)) for w in c.words)
            one = index.weights[name] * idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col(f"l{i}") / max(s.avg_len or 0.0, 1e-9)))
            score = score + F.when(tf > 0, one).otherwise(0.0)
        scores.append(score)
    out = rows.select("id", *[x.alias(f"m{i}") for i, x in enumerate(scores)])
    for i, c in enumerate(clauses):
        if c.must:
            out = out.where(F.col(f"m{i}") > 0)
    total = sum((F.col(f"m{i}") for i in range(len(clauses))), F.lit(0.0))
    out = out.groupBy("id").agg(F.sum(total).alias("score")).where("score > 0")
    return top(out.select(F.col("id").alias(id_name), "score"), "score", id_name, k)


def _idf(n: int, df: int) -> float:
    import math

    return math.log(1 + (n - df + 0.5) / (df + 0.5))
