"""Snapshots, hashes of trees, referenced objects and index status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, status) of two snapshots (path, mtime, size, hash): equal times and sizes are unchanged without a look at the hash."""
    o, n = (x.select("path", *[F.col(c).alias(f"{p}_{c}") for c in ("mtime", "size", "hash")], F.lit(True).alias(f"{p}_is")) for p, x in (("o", old), ("n", new)))
    j = o.join(n, "path", "full")
    same = ((F.col("o_mtime") == F.col("n_mtime")) & (F.col("o_size") == F.col("n_size"))) | (F.col("o_hash") == F.col("n_hash"))
    return j.select("path", F.when(F.col("o_is").isNull(), "new").when(F.col("n_is").isNull(), "deleted").when(same, "unchanged").otherwise("modified").alias("status"))


def healed(manifest: DataFrame, disk: DataFrame) -> DataFrame:
    """The manifest with current times."""
    return manifest.join(disk.select("path", F.col("mtime").alias("_m")), "path", "left").withColumn("mtime", F.coalesce("_m", "mtime")).drop("_m")


def reindexed(old_rows: DataFrame, changes: DataFrame, fresh_rows: DataFrame, key: str = "path") -> DataFrame:
    """Rows after an incremental run: those of unchanged paths and the fresh ones."""
    return old_rows.join(changes.where("status <> 'unchanged'").select(key), key, "left_anti").unionByName(fresh_rows)


def stats(changes: DataFrame) -> DataFrame:
    return changes.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("new", "modified", "deleted", "unchanged")])


def folder_hashes(files: DataFrame, path: str = "path", digest: str = "hash") -> DataFrame:
    """(dir, digest): each folder's hash over the sorted hashes of all files below it; `` is the root."""
    parts = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    dirs = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    rows = files.select(F.explode(dirs).alias("dir"), digest)
    return rows.groupBy("dir").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(digest)), ""), 256).alias("digest"))


def unreferenced(objects: DataFrame, manifest: DataFrame, key: str = "hash") -> DataFrame:
    """Objects that no manifest row names."""
    return objects.join(manifest.select(key).distinct(), key, "left_anti")


def dangling(manifest: DataFrame, objects: DataFrame, key: str = "hash") -> DataFrame:
    return manifest.join(objects.select(key).distinct(), key, "left_anti")


def status(chunks: DataFrame, path: str, ext: str) -> DataFrame:
    """Chunks and files for each extension."""
    return chunks.groupBy(ext).agg(F.count("*").alias("chunks"), F.countDistinct(path).alias("files"))
