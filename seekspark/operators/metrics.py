"""Histograms, percentiles by index, sanity counts and the atlas grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from seekspark.functions import vectors as V

EDGES = (16, 32, 64, 128, 256, 512, 1024)
PERCENTILES = (25, 50, 75, 90, 95, 99)


def histogram(rows: DataFrame, value: str) -> DataFrame:
    bucket = F.lit(len(EDGES))
    for i in reversed(range(len(EDGES))):
        bucket = F.when(F.col(value) < EDGES[i], i).otherwise(bucket)
    return rows.groupBy(bucket.cast("int").alias("bucket")).agg(F.count("*").alias("n"))


def index_percentiles(rows: DataFrame, value: str) -> DataFrame:
    """(p, value): the value at index n p / 100 of the sorted column, found from counts of distinct values."""
    counts = rows.groupBy(value).agg(F.count("*").alias("c"))
    run = counts.withColumn("upto", F.sum("c").over(W.orderBy(value)))
    n = rows.agg(F.count("*").alias("n"))
    want = n.select("n", F.explode(F.array(*map(F.lit, PERCENTILES))).alias("p")).withColumn("i", F.least(F.floor(F.col("n") * F.col("p") / 100), F.col("n") - 1))
    return want.join(run, (F.col("i") < F.col("upto")) & (F.col("i") >= F.col("upto") - F.col("c"))).select(F.col("p").cast("int").alias("p"), F.col(value).alias("value"))


def embedding_sanity(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    d = V.doubles(F.col(column))
    bad = lambda f: F.exists(d, f)
    norm = F.sqrt(V.total(F.transform(d, lambda x: x * x)))
    return vectors.agg(F.count("*").alias("n"), F.count_if(F.col(column).isNull() | (F.size(column) == 0)).alias("empty"), F.count_if(bad(lambda x: F.isnan(x))).alias("nans"), F.count_if(bad(lambda x: F.abs(x) == float("inf"))).alias("infs"), F.round(F.min(norm), 5).alias("min_norm"), F.round(F.max(norm), 5).alias("max_norm"))


def squashed(c: Column) -> Column:
    return (F.tanh(1.4 * c) + 1) / 2


def density(n: Column) -> Column:
    out = F.lit(5)
    for i, edge in reversed([*enumerate((0, 2, 5, 10, 20))]):
        out = F.when(n <= edge, i).otherwise(out)
    return out


def axis(rows: DataFrame, value: str) -> DataFrame:
    """A padded 0 to 1 axis: span at least 0.02, 8 % more on either side."""
    ends = rows.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    span = F.greatest(F.col("hi") - F.col("lo"), F.lit(0.02)) * 1.16
    mid = (F.col("hi") + F.col("lo")) / 2
    return rows.crossJoin(F.broadcast(ends)).withColumn(value, F.least(F.greatest((F.col(value) - (mid - span / 2)) / span, F.lit(0.0)), F.lit(1.0))).drop("lo", "hi")


def grid(points: DataFrame, n: int = 10) -> DataFrame:
    """points (x, y, z): count, mean z and density of each cell."""
    cell = lambda c: F.round(F.col(c) * (n - 1)).cast("int")
    return points.groupBy(cell("x").alias("cx"), cell("y").alias("cy")).agg(F.count("*").alias("n"), F.avg("z").alias("mean_z")).withColumn("density", density(F.col("n")))


def latest(points: DataFrame, order: list[str], value: str, n: int = 100_000) -> DataFrame:
    """The last n points, with the least and greatest value that any point ever had."""
    ends = points.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))  # one row
    return points.orderBy(*[F.desc(c) for c in order]).limit(n).crossJoin(F.broadcast(ends))


def skew(rows: DataFrame) -> DataFrame:
    """Rows of the fullest and emptiest task, and how many tasks have rows."""
    each = rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"))
    return each.agg(F.count("*").alias("active"), F.min("n").alias("least"), F.max("n").alias("most"))


FAMILIES = {"rs": "rust", "py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "java": "java", "c": "c", "h": "c", "cpp": "c++", "md": "markdown", "toml": "toml", "json": "json", "yaml": "yaml", "yml": "yaml", "txt": "text"}


def family(ext: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in FAMILIES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(ext)), F.lit("other"))


def boundary(kind: Column) -> Column:
    return F.when(kind.isin("file", "window"), "text windows").when(kind == "rdf_statements", "rdf").otherwise("tree-sitter")
