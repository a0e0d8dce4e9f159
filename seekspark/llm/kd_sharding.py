"""Sharding by a k-d tree: nodes are split at distributed weighted medians along their widest metadata dimension.

The weight of a row is its size in bytes. A node that is to give k leaves is cut where the left side holds floor(k/2)/k of its
bytes, along the dimension whose spread, relative to the whole table's, is widest in it, until leaves reach the target. Dimensions are the
size, the lines, the bytes a character, the share of blanks, and the language and source as ordered codes. Rows are range-partitioned and
sorted by (node, dimension, group, id), and prefix sums over partitions place each row. Law `bytes`: sizes near equal.

Equal texts are one group: they have equal dimensions (language and source: the least of the group) and stand together in every order. A
cut that falls into a group of at most 1 / PARTED of a leaf's bytes moves to the group's nearer end; a larger group is parted where the cut
falls, to within one row. So a cut misses its share by at most half a row and 1 / (2 PARTED) of a leaf.

Nothing but the number of leaves is decided on the driver: cuts are a table of one row a node.
Defined results: null texts have size 1 and checksum 0; null ids order first, null languages and sources have code 0. Rows that are equal
in everything are separate rows; ties in all dimensions go by the text's checksum and hash, then the id. An empty table gives no rows.
Texts of any length work. Other columns are not returned, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekspark.llm import common

LEAVES, PARTED = 8, 100
DIMENSIONS = ("size", "n_lines", "char_bytes", "blank_share", "lang_code", "source_code")
CODE_BYTES = 7


def code(c: Column) -> Column:
    """A number in the order of strings, from their first CODE_BYTES bytes."""
    head = F.substring(F.rpad(F.hex(F.encode(F.coalesce(c.cast("string"), F.lit("")), "UTF-8")), 2 * CODE_BYTES, "0"), 1, 2 * CODE_BYTES)
    return F.conv(head, 16, 10).cast("double")


def measured(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The narrow table that is sharded: id, size, checksum, group and dimensions of each row, but no text."""
    t = F.coalesce(F.col(text), F.lit(""))
    size, chars = (F.octet_length(t) + 1).cast("long"), F.length(t) + 1
    optional = {f"{c}_code": code(F.col(c)) if c in docs.columns else F.lit(0.0) for c in ("lang", "source")}
    rows = docs.select(F.col(id_col).alias("doc_id"), size.alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), F.xxhash64(t).alias("group"),
                       (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))).cast("double").alias("n_lines"), (size / chars).alias("char_bytes"),
                       ((F.length(t) - F.length(F.translate(t, " \t\n", ""))) / chars).alias("blank_share"), *[v.alias(k) for k, v in optional.items()])
    if not {"lang", "source"} & set(docs.columns):
        return rows
    rows = common.saved(rows, "rows")
    same = ["group", "size", "text_crc32"]
    least = rows.groupBy(*same).agg(F.count("*").alias("n"), *[F.min(c).alias(f"least_{c}") for c in optional]).where("n > 1").drop("n")
    return rows.join(least, same, "left").withColumns({c: F.coalesce(f"least_{c}", c) for c in optional}).drop(*[f"least_{c}" for c in optional])


def shard(docs: DataFrame, leaves: int | None = LEAVES, target_bytes: int | None = None, id_col: str = "doc_id", text: str = "text", dimensions: tuple = DIMENSIONS) -> DataFrame:
    """doc_id, size, text_crc32, dimensions, shard and slot. Either leaves or target_bytes says how many shards there are."""
    rows = common.saved(measured(docs, id_col, text), "measured")
    ends = [F.max(F.col(d).cast("double")) - F.min(F.col(d).cast("double")) for d in dimensions]
    whole = rows.agg(F.sum("size").alias("w"), *[e.alias(f"r{i}") for i, e in enumerate(ends)]).first()
    if leaves is None:
        leaves = max(1, -(-(whole.w or 0) // target_bytes))
    tolerance = (whole.w or 0) / leaves / PARTED
    spread = [max(whole[f"r{i}"] or 0.0, 1e-9) for i in range(len(dimensions))]
    # node: the first of the leaves that it gives; gives: how many
    rows = rows.withColumns({"node": F.lit(0).cast("int"), "gives": F.lit(leaves).cast("int"), "slot": F.lit(0).cast("long")})
    small = F.broadcast if leaves <= 100_000 else lambda df: df  # tables of one row a node
    once = leaves == 1
    while once or leaves > 1:
        once = False
        widths = F.array(*[F.struct((e / s).alias("wide"), F.lit(-i).alias("i")) for i, (e, s) in enumerate(zip(ends, spread))])
        nodes = rows.groupBy("node").agg(F.max("gives").alias("_k"), F.sum("size").alias("_w"), (-F.array_max(widths)["i"]).alias("_d"))
        nodes = common.saved(nodes, "kd_nodes")
        axis = F.get(F.array(*[F.col(d).cast("double") for d in dimensions]), F.col("_d"))
        placed = rows.drop("slot").join(small(nodes.select("node", "_d")), "node").withColumn("axis", axis).drop("_d")
        ordered = common.saved(common.prefixed(placed, "node", ["axis", "text_crc32", "group", "doc_id"], "size", "kd"), "kd_order")
        # the cut: the goal, or the nearer end of the group that it falls into, if that is small enough
        goals = nodes.select("node", (F.col("_w") * F.floor(F.col("_k") / 2) / F.col("_k")).alias("_goal"))
        hit = ordered.groupBy("node", "axis", "text_crc32", "group").agg(F.min("before").alias("_a"), F.max(F.col("before") + F.col("size")).alias("_b"))
        hit = hit.join(small(goals), "node").where("_a < _goal AND _goal < _b")
        edge = F.when(F.col("_b") - F.col("_a") > tolerance, F.col("_goal")).when(F.col("_goal") - F.col("_a") < F.col("_b") - F.col("_goal"), F.col("_a")).otherwise(F.col("_b"))
        moved = hit.groupBy("node").agg(F.min(edge.cast("double")).alias("_edge"))
        cuts = common.saved(goals.join(moved, "node", "left").select("node", F.coalesce("_edge", "_goal").alias("_cut")), "kd_cuts")
        half = F.floor(F.col("gives") / 2).cast("int")
        right = (F.col("gives") > 1) & (F.col("before") + F.col("size") / 2 > F.col("_cut"))
        done = common.saved(ordered.join(small(cuts), "node").withColumn("_right", right).drop("_cut", "axis"), "kd_cut")
        first = done.where("_right").groupBy("node").agg(F.min("rank").alias("_first"))
        done = done.join(small(first), "node", "left")
        rows = done.select("doc_id", "text_crc32", "group", *dict.fromkeys(("size", *dimensions)), F.when(F.col("_right"), F.col("node") + half).otherwise(F.col("node")).cast("int").alias("node"),
                           F.when(F.col("_right"), F.col("gives") - half).when(F.col("gives") > 1, half).otherwise(F.col("gives")).cast("int").alias("gives"),
                           F.when(F.col("_right"), F.col("rank") - F.col("_first")).otherwise(F.col("rank")).cast("long").alias("slot"))
        leaves = -(-leaves // 2)
    return rows.drop("gives", "group").withColumnRenamed("node", "shard")


def op4(spark, sf_dir: str) -> DataFrame:
    out = shard(common.table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
