"""Reading a tree of files and writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekspark.operators.chunks import language

#: Names of lock files that are never indexed, and extensions of file types.
LOCK_FILES = ("Cargo.lock", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "Gemfile.lock", "go.sum")
FILE_TYPES = {"rust": ("rs",), "python": ("py", "pyi"), "py": ("py", "pyi"), "js": ("js", "jsx", "mjs", "cjs"), "ts": ("ts", "tsx"), "go": ("go",), "java": ("java",), "c": ("c", "h"), "cpp": ("cpp", "hpp", "cc"), "md": ("md", "markdown"), "json": ("json",), "yaml": ("yaml", "yml"), "toml": ("toml",)}


def ignored(patterns: list[str]) -> str:
    """Ignore-file patterns (*, **, ?, leading or trailing /) as one regular expression over relative paths."""
    import re

    out = []
    for p in (p.strip() for p in patterns):
        if not p or p.startswith(("#", "!")):
            continue
        anchored = "/" in p.rstrip("/")
        body = re.escape(p.strip("/")).replace(r"\*\*/", "(?:.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
        out.append(f"{'^' if anchored else '(?:^|/)'}{body}(?:/|$)")
    return "|".join(out)


def scan(spark: SparkSession, root: str, file_type: str | None = None, ignore: list[str] | None = None) -> DataFrame:
    """path (relative), ext, mtime, size, text of readable files: no hidden ones, lock files, binaries (a zero byte in the first 8 KiB) or invalid UTF-8."""
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    path = F.regexp_extract("path", f"^(?:file:/*)?/?{base.lstrip('/')}/(.*)$", 1)
    rows = files.select(path.alias("path"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), "content")
    rows = rows.withColumns({"name": F.regexp_extract("path", "[^/]*$", 0), "ext": F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))})
    rows = rows.where(~F.col("name").isin(*LOCK_FILES) & ~F.col("path").rlike(r"(^|/)\."))
    if file_type in FILE_TYPES:  # an unknown type filters nothing
        rows = rows.where(F.col("ext").isin(*FILE_TYPES[file_type]))
    if ignore and (pattern := ignored(ignore)):
        rows = rows.where(~F.col("path").rlike(pattern))
    zero = F.locate("\u0000", F.substring("content", 1, 8192).cast("string"))
    return rows.where((zero == 0) & F.is_valid_utf8(F.col("content").cast("string"))).select("path", "ext", "mtime", "size", F.col("content").cast("string").alias("text"))


def write_objects(df: DataFrame, path: str, digest: str = "hash") -> None:
    """Content-addressed rows under the first two digits of their hash; only the prefixes written are replaced."""
    df.withColumn("prefix", F.substring(digest, 1, 2)).write.partitionBy("prefix").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").mode("overwrite").parquet(path)


def read_objects(spark: SparkSession, path: str, digests: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if digests is None else df.where(F.col("prefix").isin(*{d[:2] for d in digests}) & F.col("hash").isin(*digests))


def plain(results: DataFrame) -> DataFrame:
    """results (rank, name, path, start_line, end_line, score, content) as text lines."""
    head = F.format_string("%d. %s (%s:%d-%d) [%.3f]", F.col("rank") + 1, "name", "path", "start_line", "end_line", "score")
    return results.select("rank", F.concat(head, F.lit("\n"), F.coalesce("content", F.lit(""))).alias("line"))


def json_lines(results: DataFrame) -> DataFrame:
    """One JSON object a row, with the language of its path."""
    return results.select(F.to_json(F.struct(*results.columns, language(F.col("path")).alias("language"))).alias("value"))
