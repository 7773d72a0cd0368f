"""Queries over documents (problems 8, 9 and 10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..queries.base import table
from . import leakage as L
from . import sentences as S
from . import tokenize as T


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return T.encode_corpus(table(spark, d, "documents").select("doc_id", "text"), "text")


def p8_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Number of ids of each document, and whether they decode to its text."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    held = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("text", F.lit("")).alias("original"))
    back = T.decode_corpus(T.encode_corpus(held, "text").withColumn("n_ids", F.size("ids")), "ids")
    return back.select("doc_id", "n_ids", (F.col("text") == F.col("original")).alias("same"))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return L.find_leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("item_id", "doc_id").distinct()


def p9_passages(spark: SparkSession, d: str) -> DataFrame:
    """The leaked passages with their offsets in the documents."""
    return _leaks(spark, d).distinct()


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return S.sentence_units(table(spark, d, "documents"), "doc_id", "text", "lang", with_text=False).select("doc_id", "end_pos")


def p10_units(spark: SparkSession, d: str) -> DataFrame:
    """The sentence units themselves, numbered in each document."""
    return S.sentence_units(table(spark, d, "documents"), "doc_id", "text", "lang")


QUERIES = {"p10_found": p10_found, "p10_units": p10_units, "p8_ids": p8_ids, "p8_roundtrip": p8_roundtrip, "p9_found": p9_found, "p9_passages": p9_passages}
SQL: dict[str, str] = {}
