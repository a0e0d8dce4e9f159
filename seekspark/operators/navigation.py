"""Lookups: definitions, references, hover, symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Symbol kinds of node kinds; everything else is VARIABLE.
SYMBOL_KINDS = {"function_item": "FUNCTION", "function_definition": "FUNCTION", "function_declaration": "FUNCTION", "method_definition": "METHOD", "method_declaration": "METHOD", "method": "METHOD", "class_definition": "CLASS", "class_declaration": "CLASS", "class": "CLASS", "struct_item": "STRUCT", "enum_item": "ENUM", "trait_item": "INTERFACE", "interface_declaration": "INTERFACE", "mod_item": "MODULE", "impl_item": "NAMESPACE", "table": "NAMESPACE", "pair": "PROPERTY", "atx_heading": "STRING"}


def kind_of(c):
    table = F.create_map(*[F.lit(x) for kv in SYMBOL_KINDS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, c), F.lit("VARIABLE"))


def goto(ranked: DataFrame, name: str, word: str, id_col: str) -> DataFrame:
    """The best row of that very name, else the best."""
    return ranked.orderBy((F.col(name) == word).desc(), F.desc("score"), id_col).limit(1)


def references(ranked: DataFrame, word: str, columns: list[str]) -> DataFrame:
    """Rows that hold the word, case and all."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.col(c), F.lit(word)), F.lit(False))
    return ranked.where(hit)


def narrowest(spans: DataFrame, line: int, id_col: str) -> DataFrame:
    """The narrowest span around a line; of equal ones the first."""
    return spans.where((F.col("start_line") <= line) & (F.col("end_line") >= line)).orderBy(F.col("end_line") - F.col("start_line"), id_col).limit(1)


def document_symbols(chunks: DataFrame, path: str) -> DataFrame:
    return chunks.where((F.col("path") == path) & ~F.col("kind").isin("window", "file")).select("name", kind_of(F.col("kind")).alias("symbol"), F.greatest(F.col("start_line") - 1, F.lit(0)).alias("start"), F.greatest(F.col("end_line") - 1, F.lit(0)).alias("end")).orderBy("start", "name")


def workspace_symbols(parts: list[DataFrame], keys: list[str], limit: int = 20) -> DataFrame:
    """The union of roots' results, each place once, best first."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*keys).agg(F.max("score").alias("score")).orderBy(F.desc("score"), *keys).limit(limit)


def call_line(start, end, offset, start_byte):
    """Estimated line of a call, at 40 bytes a line."""
    return F.least(start + F.floor((offset - start_byte) / 40), end)
