"""Posting counts per segment and term, held against the published dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.postings import counting_rows
from ..operators.salted import salted_counts, salted_partials

KEYS = ("segment_id", "term")


def posting_counts(postings: DataFrame) -> DataFrame:
    """Counting postings per (segment_id, term) as ``postings``: repeated rows count once.

    Two-stage salted aggregation; see ``salted_counts``. Rows with nulls, ungrammatical
    terms or frequencies below 1 don't count; an empty table gives an empty result.
    """
    counted = salted_counts(counting_rows(postings), KEYS, distinct="document_id")
    return counted.select(*KEYS, F.col("n_distinct").alias("postings"))


def dictionary_conflicts(postings: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(segment_id, term) whose dictionary records and counting postings disagree, each once.

    A record disagrees if its document_frequency is null or not the number of counting
    postings (0 without any); so does a key with postings but no record. If one of
    several records of a key disagrees, the key is a case. Null keys are compared like
    other keys. The partial counts of stage 1 and the records are merged by key together,
    in one shuffle instead of a merge and a join.
    """
    counted = salted_partials(counting_rows(postings), KEYS, distinct="document_id").select(
        *KEYS, F.col("n_distinct").alias("postings"), *[F.lit(None).cast("bigint").alias(c) for c in ("_low", "_high", "_nulls", "_records")]
    )
    records = dictionary.groupBy(*KEYS).agg(
        F.lit(None).cast("bigint").alias("postings"),
        F.min("document_frequency").alias("_low"),
        F.max("document_frequency").alias("_high"),
        F.count_if(F.col("document_frequency").isNull()).alias("_nulls"),
        F.count(F.lit(1)).alias("_records"),
    )
    both = counted.unionByName(records).groupBy(*KEYS).agg(
        F.coalesce(F.sum("postings"), F.lit(0)).alias("postings"),
        F.min("_low").alias("_low"),
        F.max("_high").alias("_high"),
        F.coalesce(F.sum("_nulls"), F.lit(0)).alias("_nulls"),
        F.coalesce(F.sum("_records"), F.lit(0)).alias("_records"),
    )
    wrong = (
        (F.col("_records") == 0)
        | (F.col("_nulls") > 0)
        | (F.col("_low") != F.col("postings"))
        | (F.col("_high") != F.col("postings"))
    )
    return both.where(wrong).select(*KEYS)
