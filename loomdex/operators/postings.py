"""Cleaning of raw posting rows into counting postings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The term grammar: one or more ASCII letters and digits and nothing else.
TERM_PATTERN = r"\A[A-Za-z0-9]+\z"


def counting_rows(postings: DataFrame) -> DataFrame:
    """Rows that count: both ids present, a grammatical term, a frequency of at least 1.

    Rows with a null in any of the four columns never count. Other columns of the
    input are pruned from the scan. An empty table gives an empty result.
    """
    return postings.select("segment_id", "term", "document_id", "term_frequency").where(
        F.col("segment_id").isNotNull()
        & F.col("document_id").isNotNull()
        & (F.col("term_frequency") >= 1)
        & F.col("term").rlike(TERM_PATTERN)
    )


def counting_postings(postings: DataFrame) -> DataFrame:
    """One row per (segment_id, term, document_id) with the greatest term_frequency.

    Repeated rows collapse on the map side before the single shuffle, which is keyed
    by all three columns, so neither a hot term nor a hot document lands in one task.
    """
    return (
        counting_rows(postings)
        .groupBy("segment_id", "term", "document_id")
        .agg(F.max("term_frequency").alias("term_frequency"))
    )
