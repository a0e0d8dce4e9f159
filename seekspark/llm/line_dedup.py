"""Line dedup: levelled sorted runs of line hashes, compacted periodically. DataFrame operations only.

A line's key is the line without white space at both ends, A-Z in lower case. Lines are cut into batches of
ascending doc_id. For each batch the distinct keys are merge-anti-joined with the runs written so far (each run is a
bucketed, sorted table, so the merge reads the run without a shuffle), and what is new becomes a run of level 0.
`FANOUT` runs of one level are compacted into one of the next. A key's owner is its smallest doc_id; since batches ascend,
an owner in a run never changes.

Defined results: null or empty text is one empty line. Rows with a null doc_id come last in the order and count as one
document. Rows with the same doc_id are one document. Repeated rows each get the same result. Texts of any length and an
empty table work; other columns pass through, but for columns of the names that are added, which are replaced.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekspark.llm import common

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_KEY, BATCHES, BATCH_BYTES, FANOUT = 10, 4, 256 << 30, 2
ADDED = ("kept_text", "n_lines", "n_dropped")
LAST = 2**63 - 1


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(BLANKS)), UPPER, LOWER)


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


class LineRuns:
    """The levelled runs: levels[i] lists the tables of level i; each holds (h1, h2, owner), bucketed and sorted by key."""

    def __init__(self, spark, buckets: int):
        self.spark, self.buckets, self.levels, self.id = spark, buckets, [], uuid.uuid4().hex

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        (rows.repartition(self.buckets, "h1", "h2").write.format("parquet").option("compression", "zstd")
         .option("path", f"{common.shared_dir(self.spark)}/{name}").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").saveAsTable(name))
        return name

    def all(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def add(self, keys: DataFrame) -> None:
        """keys (h1, h2, owner), distinct: what no run holds becomes a run of level 0; full levels are compacted."""
        for run in self.all():
            keys = keys.join(run.hint("merge"), ["h1", "h2"], "left_anti")
        new, level = self._write(keys), 0
        while True:
            if len(self.levels) == level:
                self.levels.append([])
            self.levels[level].append(new)
            if len(self.levels[level]) < FANOUT:
                return
            full, self.levels[level] = self.levels[level], []
            merged = self.spark.table(full[0])
            for name in full[1:]:
                merged = merged.unionByName(self.spark.table(name))
            new, level = self._write(merged), level + 1
            for name in full:
                self._remove(name)

    def drop(self) -> None:
        """Remove all runs, once their owners are written elsewhere."""
        for level in self.levels:
            for name in level:
                self._remove(name)
        self.levels = []

    def _remove(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{common.shared_dir(self.spark)}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def owners(self) -> DataFrame:
        found = self.all()
        out = found[0]
        for run in found[1:]:
            out = out.unionByName(run)
        return out


def _hashed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """One row for each line with a key that counts: document, the text's hash, position, two 64-bit hashes of the key."""
    key = F.col("_k")
    return (
        docs.select(F.coalesce(F.col(id_col), F.lit(LAST)).alias("did"), F.xxhash64(F.lit(3), text).alias("th"), F.posexplode(_lines(text)).alias("pos", "_l"))
        .select("did", "th", "pos", line_key(F.col("_l")).alias("_k"))
        .where(F.length(key) >= MIN_KEY)
        .select("did", "th", "pos", F.xxhash64(F.lit(1), key).alias("h1"), F.xxhash64(key, F.lit(2)).alias("h2"))
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", batches: int | None = None) -> DataFrame:
    """docs with kept_text (lines that stay, joined by \\n), n_lines and n_dropped. Batches hold about BATCH_BYTES each, and are BATCHES at least."""
    spark = docs.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ids = F.coalesce(F.col(id_col), F.lit(LAST))
    if batches is None:
        batches = max(BATCHES, -(-(docs.select(F.sum(F.octet_length(text))).first()[0] or 0) // BATCH_BYTES))
    cuts = docs.select(F.percentile_approx(ids, [i / batches for i in range(1, batches)], 100 * batches).alias("c")).first().c or []
    cuts = sorted(set(cuts))
    batch = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: F.col("did") > c)) if cuts else F.lit(0)
    lines = common.saved(_hashed(docs, id_col, text).withColumn("batch", batch), "lines", "batch")
    runs, again = LineRuns(spark, parts), []
    for i in range(len(cuts) + 1):
        mine = lines.where(F.col("batch") == i)
        keys = mine.groupBy("h1", "h2").agg(F.min("did").alias("owner"), F.max("did").alias("last"))
        keys = common.saved(keys, "batch_keys")
        # keys that this batch shares: held by two of its own documents, or by a run
        shared = keys.where("owner < last").select("h1", "h2")
        for run in runs.all():
            shared = shared.unionByName(keys.join(run.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_semi").select("h1", "h2"))
        again.append(common.saved(shared, "shared_keys"))
        runs.add(keys.select("h1", "h2", "owner"))
    shared = common.saved(reduce(DataFrame.unionByName, again).distinct().join(runs.owners(), ["h1", "h2"]), "owners")
    runs.drop()
    drops = lines.join(shared, ["h1", "h2"]).where("did > owner").groupBy("did", "th").agg(F.array_sort(F.collect_set("pos")).alias("drop"))
    return _rebuilt(docs, drops, id_col, text)


def _rebuilt(docs: DataFrame, drops: DataFrame, id_col: str, text: str) -> DataFrame:
    """Take the dropped positions out of each text, in time linear in its lines. The row travels as one column, so its names clash with nothing."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ADDED])
    keyed = docs.select(row.alias("row"), F.coalesce(F.col(id_col), F.lit(LAST)).alias("did"), F.xxhash64(F.lit(3), text).alias("th"), F.col(text).alias("text"))
    gone = keyed.join(drops, ["did", "th"], "left")
    before = lambda i: F.when(i == 0, F.lit(-1)).otherwise(F.get(F.col("drop"), i - 1))
    flags = F.flatten(F.transform("drop", lambda p, i: F.concat(F.array_repeat(F.lit(False), p - before(i) - 1), F.array(F.lit(True)))))
    n = F.when(F.col("drop").isNull(), F.lit(0)).otherwise(F.size("drop"))
    kept = F.when(F.col("drop").isNull(), F.coalesce(F.col("text"), F.lit(""))).otherwise(F.array_join(_kept("lines", "flags"), "\n"))
    out = gone.withColumns({"lines": _lines("text"), "flags": F.when(F.col("drop").isNotNull(), flags)})
    return out.select("row.*", kept.alias("kept_text"), F.size("lines").cast("long").alias("n_lines"), n.cast("long").alias("n_dropped"))


def _kept(lines: str, flags: str) -> Column:
    pairs = F.arrays_zip(F.col(lines), F.col(flags))
    return F.transform(F.filter(pairs, lambda s: ~F.coalesce(s[flags], F.lit(False))), lambda s: s[lines])


SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT k.doc_id, k.pos, k.line, s.owner IS NOT NULL AND k.doc_id <> s.owner AS gone FROM k LEFT JOIN s USING (key))
"""
ORACLE_SQL = SQL + """
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id
"""


def op1(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))
