"""Shared helpers of the training-data operators: session settings, scratch tables, distributed prefix sums."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Where scratch tables go if the session names no shared folder (tests only).
FALLBACK_DIR = "/tmp/checkpoints/seekspark"
LIBC = ctypes.CDLL(None)
#: Arrow batches stay this small, since texts may be long.
BATCH_ROWS, BATCH_BYTES = 1024, 4 << 20


def tune(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches that reach Python workers, by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    with contextlib.suppress(Exception):  # a setting of newer Spark versions
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once for each context, so that workers can import it wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_seekspark_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp()) / "seekspark.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(str(target))
    context._seekspark_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may leave it unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(found or FALLBACK_DIR).rstrip('/')}/tables"


def saved(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("error").option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables from `saved` that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._saved_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def tidy(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of finished steps, which it does for plans that the driver has collected as garbage, and
    give the driver's freed Python memory back to the system where its C library can."""
    gc.collect()
    if hasattr(LIBC, "malloc_trim"):
        LIBC.malloc_trim(0)
    spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


#: A key filter is a bit map of so many 64-bit words, at least and at most: what is broadcast has at most that many rows, whatever the data.
FILTER_WORDS, MOST_FILTER_WORDS = 1 << 17, 1 << 21


def maybe_in(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """df without most of the rows whose key is not in wanted[key] (rows whose key is there all stay), before a join shuffles them.

    The keys of wanted become a hashed bit map, one row a word, of 32 bits a key. It grows to MOST_FILTER_WORDS (67 million keys at two
    bits); beyond that it fills up and takes less and less away, so that at worst the join shuffles df once, in proportion.
    """
    words = min(max(FILTER_WORDS, 1 << (wanted.count() // 2).bit_length()), MOST_FILTER_WORDS)
    h = F.xxhash64(F.lit(5), F.col(key))
    word, bit = F.pmod(h, F.lit(words)).cast("int"), F.pmod(F.shiftright(h, 24), F.lit(64)).cast("int")
    bits = wanted.select(word.alias("_word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    held = df.withColumns({"_word": word, "_at": bit}).join(F.broadcast(bits), "_word")
    return held.where(F.call_function("shiftright", F.col("_bits"), F.col("_at")).bitwiseAND(F.lit(1)) == 1).select(*df.columns)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n (null ids: 0)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(0))


def bounded_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """At most n rows, those of the least hash of key; tasks send the driver little more than n rows together."""
    total = df.count()
    h = F.xxhash64(F.col(key).cast("string"))
    if total > n:  # a hash bound that some 1.2 n rows pass, with a margin for small n
        df = df.where(F.pmod(h, F.lit(1 << 30)) < int(((1 << 30) - 1) * min(1.0, (1.2 * n + 200) / total)))
    return df.orderBy(h, key).limit(n)


def prefixed(df: DataFrame, group: str, order: list[str], weight: str, name: str) -> DataFrame:
    """Add `before` (exclusive prefix sum of weight) and `rank` (rows before), within group in the given order.

    The rows are range-partitioned on (group, order), so one group of any size spreads over many tasks; only one
    sum for each partition and group crosses partitions. The sorted table is written, so partition numbers are
    fixed before they are used.
    """
    spark = df.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = df.repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order).withColumn("_part", F.spark_partition_id())
    placed = saved(placed, name)
    sums = placed.groupBy("_part", group).agg(F.sum(weight).alias("_w"), F.count("*").alias("_n"))
    earlier = W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("_part", group, F.coalesce(F.sum("_w").over(earlier), F.lit(0)).alias("_w0"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"))
    inside = W.partitionBy("_part", group).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = placed.withColumns({"_wi": F.sum(weight).over(inside) - F.col(weight), "_ni": F.count(F.lit(1)).over(inside) - 1})
    return out.join(sums, ["_part", group]).withColumns({"before": F.col("_wi") + F.col("_w0"), "rank": F.col("_ni") + F.col("_n0")}).drop("_part", "_wi", "_ni", "_w0", "_n0")


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    while name in df.columns:
        name += "_"
    return name
