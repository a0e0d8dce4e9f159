"""The life of an index over files: snapshot, manifest, full and incremental runs, garbage, rebuild, status.

An index is a folder of Parquet tables: `objects` (hash, prefix, path, name, kind, start_line, end_line, content) holds the chunks of each
content once, partitioned by the first two digits of its hash; `manifest` (path, mtime, size, hash, chunks) names the content of each
path; `about` holds version and model. Objects are only added or removed whole, so a run rewrites the manifest and touches no unchanged object.

Runs work on keys (path, mtime, size, hash), which are kept without the texts. Contents are never sorted to be joined or grouped: files that
are wanted or not are told by a list of keys, broadcast while it is short, and what is left goes once to its prefix.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekspark.operators import incremental as I
from seekspark.plans.scratch import saved

VERSION = 3
#: Rows of a list of keys that is still broadcast.
SHORT = 100_000


def snapshot(files: DataFrame) -> DataFrame:
    """files (path, mtime, text) as (path, mtime, size, hash, text)."""
    return files.select("path", "mtime", F.octet_length("text").alias("size"), F.sha2(F.col("text"), 256).alias("hash"), "text")


def _write(df: DataFrame, path: str, *partitions: str) -> None:
    """Write beside and swap, since df may read what it replaces."""
    spark = df.sparkSession
    beside = f"{path}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(beside)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(fs_path(path), True)
    fs.rename(fs_path(beside), fs_path(path))
    spark.catalog.refreshByPath(path)


def manifest_of(snap: DataFrame, objects: DataFrame) -> DataFrame:
    n = objects.groupBy("hash").agg(F.count("*").alias("chunks"))
    return snap.select("path", "mtime", "size", "hash").join(n, "hash", "left").select("path", "mtime", "size", "hash", F.coalesce("chunks", F.lit(0)).alias("chunks"))


def _by(rows: DataFrame, keys: DataFrame, how: str, *on: str) -> DataFrame:
    """rows that keys (kept, distinct) name, or do not name, without a sort of rows."""
    return rows.join(keys.hint("broadcast" if keys.count() <= SHORT else "shuffle_hash"), list(on), how)


def _objects(files: DataFrame, chunk: Callable[[DataFrame], DataFrame], keys: DataFrame) -> DataFrame:
    """Chunks of files (path, hash, text), whose keys are kept."""
    chunks = chunk(files)
    if "hash" not in chunks.columns:
        chunks = chunks.join(keys.select("path", "hash").distinct().hint("shuffle_hash"), "path")
    chunks = chunks.select("path", "name", "kind", "start_line", "end_line", "content", "hash")
    once = keys.groupBy("path", "hash").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    return (chunks if once else chunks.dropDuplicates()).withColumn("prefix", F.substring("hash", 1, 2))


def full(files: DataFrame, path: str, chunk: Callable[[DataFrame], DataFrame], model: str = "none") -> DataFrame:
    """Index everything anew; returns the statistics."""
    spark, snap = files.sparkSession, snapshot(files)
    keys = saved(snap.drop("text"), "keys")
    first = keys.groupBy("hash").agg(F.min("path").alias("first"))
    copies = saved(keys.join(first, "hash").where("path <> first").select("path", "hash").distinct(), "copies")  # a content's objects are those of the first path that holds it
    objects = _by(_objects(snap.select("path", "hash", "text"), chunk, keys), copies, "left_anti", "path", "hash")
    _write(objects.repartition("prefix"), f"{path}/objects", "prefix")
    _write(manifest_of(keys, spark.read.parquet(f"{path}/objects")), f"{path}/manifest")
    _write(spark.createDataFrame([(VERSION, model)], "version int, model string"), f"{path}/about")
    return keys.agg(F.count("*").alias("new"), F.lit(0).cast("long").alias("modified"), F.lit(0).cast("long").alias("deleted"), F.lit(0).cast("long").alias("unchanged"))


def compatible(spark: SparkSession, path: str, model: str = "none") -> bool:
    """Whether the index there has this version and model."""
    try:
        row = spark.read.parquet(f"{path}/about").first()
    except Exception:  # no index, or none that can be read
        return False
    return row is not None and (row.version, row.model) == (VERSION, model)


def reindex(files: DataFrame, path: str, chunk: Callable[[DataFrame], DataFrame], model: str = "none") -> DataFrame:
    """Bring the index to files: incrementally where it is compatible, else in full. Unchanged files are not chunked again."""
    spark = files.sparkSession
    if not compatible(spark, path, model):
        return full(files, path, chunk, model)
    snap, old = snapshot(files), spark.read.parquet(f"{path}/manifest")
    keys = saved(snap.drop("text"), "keys")
    changes = saved(I.diff(old, keys), "changes")
    stats = spark.createDataFrame([I.stats(changes).first()], "new long, modified long, deleted long, unchanged long")  # one row, before the manifest changes
    have = spark.read.parquet(f"{path}/objects").select("hash").distinct()
    moved = keys.join(changes.where("status IN ('new', 'modified')").select("path"), "path", "left_semi")
    dirty = saved(moved.join(have, "hash", "left_anti").groupBy("hash").agg(F.min("path").alias("path")).where("hash IS NOT NULL"), "dirty")
    if not dirty.isEmpty():
        fresh = _objects(_by(snap.select("path", "hash", "text"), dirty, "left_semi", "path", "hash"), chunk, moved)
        fresh.repartition("prefix").write.mode("append").option("compression", "zstd").partitionBy("prefix").parquet(f"{path}/objects")
        spark.catalog.refreshByPath(f"{path}/objects")
    kept = I.healed(old.join(changes.where("status = 'unchanged'").select("path"), "path", "left_semi"), keys)  # touched files get their new time
    fresh = manifest_of(moved, spark.read.parquet(f"{path}/objects"))
    _write(kept.select("path", "mtime", "size", "hash", "chunks").unionByName(fresh), f"{path}/manifest")
    collect_garbage(spark, path)
    return stats


def collect_garbage(spark: SparkSession, path: str) -> int:
    """Delete objects that no manifest row names, rewriting only the prefixes that hold some; how many contents went."""
    objects, manifest = spark.read.parquet(f"{path}/objects"), spark.read.parquet(f"{path}/manifest")
    gone = saved(I.unreferenced(objects.select("hash", "prefix").distinct(), manifest), "gone")
    prefixes = [r.prefix for r in gone.select("prefix").distinct().collect()]  # at most 256
    if not prefixes:
        return 0
    n = gone.count()
    kept = _by(objects.where(F.col("prefix").isin(*prefixes)), gone.select("hash"), "left_anti", "hash")
    beside = f"{path}/kept-{uuid.uuid4().hex}"
    kept.repartition("prefix").write.option("compression", "zstd").partitionBy("prefix").parquet(beside)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for p in prefixes:
        fs.delete(fs_path(f"{path}/objects/prefix={p}"), True)
        if fs.exists(fs_path(f"{beside}/prefix={p}")):
            fs.rename(fs_path(f"{beside}/prefix={p}"), fs_path(f"{path}/objects/prefix={p}"))
    fs.delete(fs_path(beside), True)
    spark.catalog.refreshByPath(f"{path}/objects")
    return n


def rebuilt(spark: SparkSession, path: str, files: DataFrame) -> DataFrame:
    """The manifest from objects and what lies on disk, where the manifest is lost: files whose content has objects."""
    objects = spark.read.parquet(f"{path}/objects")
    return manifest_of(snapshot(files), objects).where("chunks > 0")


def load(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, kind, start_line, end_line, content) of every file, dangling manifest rows left out; nothing is written or chunked."""
    manifest, objects = spark.read.parquet(f"{path}/manifest"), spark.read.parquet(f"{path}/objects")
    return manifest.select("path", "hash").join(objects.drop("path", "prefix"), "hash").drop("hash")


def hashes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/objects").select("hash").distinct()


def status(spark: SparkSession, path: str, files: DataFrame | None = None) -> DataFrame:
    """One row: ready (`true`, `verifying` if files differ from the manifest, `false` without an index), files and chunks."""
    try:
        manifest = spark.read.parquet(f"{path}/manifest")
    except Exception:  # no index there
        return spark.createDataFrame([("false", 0, 0)], "ready string, files long, chunks long")
    stale = files is not None and not I.diff(manifest, snapshot(files)).where("status <> 'unchanged'").isEmpty()
    return manifest.agg(F.lit("verifying" if stale else "true").alias("ready"), F.count("*").alias("files"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"))


def extensions(manifest: DataFrame) -> DataFrame:
    """(ext, files, chunks)."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    return manifest.groupBy(ext.alias("ext")).agg(F.count("*").alias("files"), F.sum("chunks").alias("chunks"))


def freshness(manifest: DataFrame, built: object) -> DataFrame:
    """The newest file and whether it is newer than `built`."""
    return manifest.agg(F.max_by("path", F.struct("mtime", "path")).alias("newest"), F.max("mtime").alias("mtime")).withColumn("up_to_date", F.coalesce(F.col("mtime") <= F.lit(built), F.lit(True)))


def clear(spark: SparkSession, path: str) -> bool:
    """Delete the index; whether there was one."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    return bool(fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration()).delete(fs_path(path), True))
