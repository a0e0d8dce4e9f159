"""Raw documents to packed training sequences. Part of subpackage seekspark.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, with n_chars kept true.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekspark.llm import common, langid, line_dedup, minhash, packing, toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those that calibration rejects go."""
    common.tune(spark)
    model = langid.train(docs, common.fold(F.col("doc_id"), 3) != 1)
    return langid.identify(docs.select(*COLUMNS), model).where("NOT rejected").select(*COLUMNS)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not flag."""
    labels = common.table(spark, sf_dir, "labels", "doc_id", "toxic")
    model = toxicity.train(docs, labels, common.fold(F.col("doc_id"), 5) != 0)
    return toxicity.scored(docs.select(*COLUMNS), model).where("score < 0.5").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that a document of a smaller id holds."""
    out = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (0.8 of five-word shingles), that of the smallest id."""
    common.tune(spark)
    # rows are told apart by id and text, since ids may be null or shared; texts without words are all kept
    row = F.xxhash64("doc_id", F.col("doc_id").isNull(), "text").alias("row")
    rows = docs.select(*COLUMNS, row)
    found = minhash.linked(rows, "row", "text", 80, order="doc_id").where("n_shingles > 0")
    found = common.saved(found.groupBy(F.col("did").alias("row")).agg(F.first("component_id").alias("c"), F.first("ord").alias("ord"), F.count("*").alias("n")), "near_rows")
    # the first of a component: the smallest id, nulls last
    first = found.groupBy("c").agg(F.min(F.struct(F.col("ord").isNull().alias("none"), "ord", "row")).alias("f"), F.count("*").alias("m")).where("m > 1")
    gone = found.join(first, "c").where(F.col("row") != F.col("f.row")).select("row")
    left = common.saved(rows.join(gone, "row", "left_anti"), "near_left")
    twice = found.where("n > 1").select("row")
    once = left.join(twice, "row", "left_anti").unionByName(left.join(twice, "row", "left_semi").dropDuplicates(["row"]))
    return once.select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences."""
    common.tune(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("toxicity", clean), ("line_dedup", lines), ("minhash", near), ("packing", packed)]

#: Two stages learn models, which SQL cannot express; tests compare each stage with brute force on its own input, and run() with the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents", *COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = common.saved(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
