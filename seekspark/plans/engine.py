"""One object for the queries of an indexed collection: search by mode, neighbours, duplicates, structure, navigation, status.

It holds a chunk table (chunk_id, path, name, kind, start_line, end_line, content), a vector table (chunk_id, embedding), an inverted index of the
chunks and, where they are known, structural ranks (path, rank). Nothing is collected but single rows that are looked up.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekspark.functions import embedding as E
from seekspark.functions import text as T
from seekspark.operators import chunks as C
from seekspark.operators import graph as G
from seekspark.operators import navigation as N
from seekspark.operators import pairs as P
from seekspark.operators import postings as X
from seekspark.operators import ranking as R

SEMANTIC, KEYWORD, HYBRID = "semantic", "keyword", "hybrid"
CANDIDATES, TOP_K, THRESHOLD, MAP_TOKENS = 100, 10, 0.3, 2000


def number(value: int | float | str) -> int | float:
    """A parameter that comes as a number or as its text."""
    if isinstance(value, str):
        value = float(value)
    return int(value) if float(value).is_integer() else value


def effective_k(k: int | str | None, total: int | None = None) -> int | None:
    """0 or None: all, at most `total`."""
    k = number(k or 0)
    return (total if not k else min(k, total)) if total is not None else (k or None)


def effective_threshold(threshold: float | str | None, default: float = THRESHOLD) -> float:
    """A threshold that is not given, or 0, is the default."""
    value = number(threshold) if threshold is not None else 0
    return float(value) if value else default


@dataclass
class Engine:
    chunks: DataFrame
    vectors: DataFrame
    index: X.Index
    embedder: E.Embedder | None = None
    ranks: DataFrame | None = None
    alpha: float = 0.3

    def ranked(self, mode: str, query: str | list[X.Clause], vector: list[float] | None = None, k: int | None = TOP_K, threshold: float | None = None) -> DataFrame:
        """(chunk_id, score): by vectors, by words, or both fused by reciprocal ranks; scores between 0 and 1, those under the threshold left out, best first.

        A blank query finds nothing. The semantic and the keyword list hold max(k, CANDIDATES) candidates each, all where k is 0.
        """
        if mode not in (SEMANTIC, KEYWORD, HYBRID):
            raise ValueError(f"no such mode: {mode}")
        k = effective_k(k)
        wide = max(k, CANDIDATES) if k else None
        empty = self.chunks.select("chunk_id", F.lit(0.0).alias("score")).limit(0)
        if isinstance(query, str) and not query.strip() and vector is None:
            return empty
        lists = []
        if mode != KEYWORD:
            vector = vector if vector is not None else E.embed_query(self.embedder, query)
            lists.append(R.exact_rank(self.vectors, "chunk_id", vector, 0.0, wide))
        if mode != SEMANTIC:
            lists.append(X.search(self.index, query, wide, "chunk_id"))
        found = lists[0] if len(lists) == 1 else R.reciprocal_rank_fusion(lists, "chunk_id")
        return R.thresholded(R.min_max(found), "chunk_id", threshold, k)

    def search(self, query: str, mode: str = HYBRID, k: int | str = TOP_K, threshold: float | str | None = None, offset: int | str = 0, vector: list[float] | None = None) -> DataFrame:
        """The page of results with their chunks, boosted by structural rank where there are ranks."""
        k, offset = number(k), number(offset)
        found = self.ranked(mode, query, vector, k + offset if k else 0, effective_threshold(threshold))
        rows = found.join(self.chunks, "chunk_id")
        if self.ranks is not None:
            keyed = rows.withColumn("_at", F.concat_ws("::", "path", "name"))
            rows = R.boosted(keyed, "chunk_id", self.ranks.select(F.col("path").alias("key"), "rank"), ["_at", "path"], self.alpha).drop("_at")
        rows = rows.orderBy(F.desc("score"), "chunk_id")
        return R.page(rows, offset, k) if k else rows.offset(offset)

    def at(self, path: str, line: int) -> DataFrame:
        """The first chunk of a path, or of one that ends with it, that holds a 0-based line."""
        here = (F.col("path") == path) | F.col("path").endswith(path)
        return self.chunks.where(here & (F.col("start_line") <= line + 1) & (F.col("end_line") >= line + 1)).orderBy("chunk_id").limit(1)

    def similar(self, path: str, line: int, k: int = TOP_K, offset: int = 0) -> DataFrame:
        """Chunks like the one at a place, without itself; none where there is no chunk."""
        row = self.at(path, line).select("chunk_id").first()
        if row is None:
            return self.chunks.withColumn("score", F.lit(0.0)).limit(0)
        return R.similar(self.vectors, "chunk_id", row.chunk_id, k, offset).join(self.chunks, "chunk_id").orderBy(F.desc("score"), "chunk_id")

    def duplicates(self, threshold: float = 0.85, most: int = 20) -> DataFrame:
        """The most similar pairs with both chunks, and `total`, how many pairs are shown."""
        pairs = P.similar_pairs(self.vectors.withColumnRenamed("chunk_id", "id"), "id", threshold, most)
        side = lambda x: self.chunks.select(F.col("chunk_id").alias(f"id_{x}"), F.col("path").alias(f"path_{x}"), F.col("start_line").alias(f"line_{x}"))
        rows = pairs.withColumn("similarity", F.round("similarity", 3)).join(side("a"), "id_a").join(side("b"), "id_b")
        return rows.crossJoin(F.broadcast(pairs.agg(F.count("*").alias("total")))).orderBy(F.desc("similarity"), "id_a", "id_b")

    def definition(self, word: str) -> DataFrame:
        """Where a word is defined: of the best keyword hits the one of that name, else the best. Implementations are found alike."""
        hits = X.search(self.index, [X.Clause(X.split(self.index, word))], CANDIDATES // 2, "chunk_id").join(self.chunks, "chunk_id")
        return N.goto(hits, "name", word, "chunk_id")

    implementation = definition

    def references(self, word: str) -> DataFrame:
        hits = X.search(self.index, [X.Clause(X.split(self.index, word))], CANDIDATES // 2, "chunk_id").join(self.chunks, "chunk_id")
        return N.references(hits, word, ["name", "content"])

    def hover(self, path: str, line: int) -> DataFrame:
        """The narrowest chunk at a 0-based line, fenced with its language."""
        row = N.narrowest(self.chunks.where(F.col("path") == path), line + 1, "chunk_id")
        fence = F.lit("`" * 3)
        return row.withColumn("markdown", F.concat(fence, C.language(F.col("path")), F.lit("\n"), "content", F.lit("\n"), fence))

    def symbols(self, path: str) -> DataFrame:
        return N.document_symbols(self.chunks, path)

    def items(self, rows: DataFrame) -> DataFrame:
        """Results as 0-based places with previews."""
        return rows.select("path", "name", F.greatest(F.col("start_line") - 1, F.lit(0)).alias("start"), F.greatest(F.col("end_line") - 1, F.lit(0)).alias("end"), T.preview(F.col("content")).alias("preview"), "score")

    def repo_map(self, edges: DataFrame, focus: str | None = None, budget: int = MAP_TOKENS) -> str:
        """The collection's files by rank over edges (src, dst, weight) of paths, as much as the budget holds."""
        files = self.chunks.select(F.col("path").alias("node")).distinct()
        hit = G.focused(files.withColumnRenamed("node", "path"), focus).first() if focus else None
        ranks = G.pagerank(files, edges, focus=F.col("node") == hit.path if hit else None)
        names = self.chunks.groupBy(F.col("path").alias("node")).agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("names"))
        placed = G.tiers(ranks).join(names, "node")
        full = F.when(F.col("tier") == "path", F.concat("node", F.lit("\n"))).otherwise(F.concat("node", F.lit(": "), "names", F.lit("\n")))
        return G.rendered(placed.select("place", full.alias("full"), F.col("node").alias("path")), budget)


def first_of(*roots: DataFrame | None) -> DataFrame | None:
    """The first source of rows that is there and has any: the default index, other roots, a cached one, then what is parsed directly."""
    for df in roots:
        if df is not None and not df.isEmpty():
            return df
    return None
