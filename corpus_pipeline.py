"""From raw documents to packed training sequences: each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catchment.llm.common import cut, table
from catchment.llm.line_dedup import drop_repeated_lines
from catchment.llm.near_dedup import drop_near_duplicates
from catchment.llm.packing import pack
from catchment.llm.pii import replace_pii
from catchment.llm.queries import with_lengths
from catchment.llm.toxicity import drop_toxic

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go."""
    return drop_toxic(docs.select(COLUMNS), table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that nearly repeat an earlier line go, and with them a document that has no other words; one without words before stays."""
    left = drop_repeated_lines(docs.select(COLUMNS), counts=True)
    emptied = (F.col("n_removed") > 0) & ~F.col("text").rlike(r"[^ \t-\r]")
    return with_lengths(left.filter(~F.coalesce(emptied, F.lit(False)))).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the first document stays."""
    return drop_near_duplicates(docs.select(COLUMNS), words=5, percent=80).select(COLUMNS)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes surrogates."""
    return with_lengths(replace_pii(docs.select(COLUMNS))).select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences."""
    return pack(docs)


STAGES = [("toxicity", toxicity), ("line dedup", lines), ("near dedup", near_duplicates), ("pii", private_data), ("packing", packing)]

#: SQL expresses neither the classifier nor MinHash; tests/llm/test_pipeline.py holds run() against the stages in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
