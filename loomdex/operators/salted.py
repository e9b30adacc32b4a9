"""Aggregation per key without imbalance: two stages, heavy keys salted.

A key is heavy if it holds at least ``1 / HEAVY_SHARE`` of the rows (and at least
``HEAVY_ROWS`` of them), so there are never more than ``HEAVY_SHARE`` heavy keys and
the table of them, which is broadcast, has a bound that doesn't grow with the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAVY_SHARE = 10_000
HEAVY_ROWS = 1_000
#: Most salts of one key.
SALTS_MAX = 4_096


def heavy_keys(rows: DataFrame, keys: Sequence[str], share: int = HEAVY_SHARE, least: int = HEAVY_ROWS) -> DataFrame:
    """The heavy keys of ``rows`` with their exact row counts in ``_rows`` and all rows in ``_all``.

    Counts are combined on the map side, so the shuffle carries one row per key and
    map task. At most ``share`` keys can hold ``1 / share`` of the rows. An empty
    table has no heavy keys.
    """
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    total = counts.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("_all"))
    limit = F.greatest(F.lit(least).cast("bigint"), F.ceil(total.scalar() / F.lit(share)))
    return counts.where(F.col("_rows") >= limit)


def add_salt(rows: DataFrame, keys: Sequence[str], spread: Sequence[str], heavy: DataFrame, per_salt: int) -> DataFrame:
    """Add ``_salt``: 0 for light keys, one of ``ceil(_rows / per_salt)`` values for heavy ones.

    The salt is a hash of ``spread`` and so the same whenever a lost task runs again;
    equal ``spread`` values of a key share a salt, which keeps distinct counts additive.
    Null keys are keys like any other.
    """
    few = F.broadcast(
        heavy.select(
            *[F.col(k).alias(f"_h_{k}") for k in keys],
            F.least(F.lit(SALTS_MAX), F.ceil(F.col("_rows") / F.lit(per_salt))).cast("int").alias("_salts"),
        )
    )
    on = None
    for k in keys:
        match = F.col(k).eqNullSafe(F.col(f"_h_{k}"))
        on = match if on is None else on & match
    joined = rows.join(few, on, "left").drop(*[f"_h_{k}" for k in keys])
    salt = F.when(F.col("_salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*spread), F.col("_salts")).cast("int"))
    return joined.withColumn("_salt", salt).drop("_salts")


def salted_partials(
    rows: DataFrame,
    keys: Sequence[str],
    distinct: str,
    per_salt: int = HEAVY_ROWS,
    share: int = HEAVY_SHARE,
    least: int = HEAVY_ROWS,
) -> DataFrame:
    """Stage 1: rows ``n_rows`` and distinct non-null values ``n_distinct`` for every key and ``_salt``.

    Repeated rows are combined before they are shuffled, by key, salt and value, so that
    even a value repeated without end is one row. Equal values share a salt, so counts add up.
    """
    kept = rows.select(*keys, F.col(distinct).alias("_value"))
    heavy = heavy_keys(kept, keys, share, least)
    salted = add_salt(kept, keys, ["_value"], heavy, per_salt)
    return salted.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("_value").alias("n_distinct"))


def salted_counts(
    rows: DataFrame,
    keys: Sequence[str],
    distinct: str,
    per_salt: int = HEAVY_ROWS,
    share: int = HEAVY_SHARE,
    least: int = HEAVY_ROWS,
) -> DataFrame:
    """Rows and distinct non-null values of ``distinct`` for every key: ``n_rows``, ``n_distinct``.

    Stage 1 salts heavy keys by a hash of ``distinct`` and computes partial results per
    (key, salt), see ``salted_partials``; stage 2 merges the partials by key. Null keys
    form groups of their own; an empty table gives an empty result; other columns are
    ignored, also ones that bear this function's output names.
    """
    partial = salted_partials(rows, keys, distinct, per_salt, share, least)
    return partial.groupBy(*keys).agg(F.sum("n_rows").alias("n_rows"), F.sum("n_distinct").alias("n_distinct"))
