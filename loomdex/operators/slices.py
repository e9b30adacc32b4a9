"""Range slices: a globally ordered, skew-free split of rows by one ordering column.

``repartitionByRange`` draws its bounds anew in every job, so two uses of it in one
plan may disagree, and it keeps equal values together however many there are. Slices
have their bounds fixed once as literals: every use and every rerun of a lost task
places a row alike, and a value that fills several slices is dealt out among them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from itertools import accumulate

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Entries of the quantile sketch for each slice, so that no slice is off by more than a twentieth.
SKETCH_EACH = 20


def _array(values: Sequence[float]) -> str:
    """An array of numbers as SQL text, which is made at once however long it is."""
    return f"array({','.join(map(repr, values))})"


def quantiles_of(value: str, slices: int) -> Column:
    """Aggregate: the ``slices - 1`` bounds that split the rows by ``value`` about evenly; null without a value."""
    wanted = [i / slices for i in range(1, slices)] or [0.5]
    return F.expr(f"percentile_approx({value}, {_array(wanted)}, {max(1_000, SKETCH_EACH * slices)})")


def slice_bounds(rows: DataFrame, value: str, slices: int) -> list[float]:
    """``slices - 1`` ascending bounds that split ``rows`` by ``value`` about evenly.

    A mergeable sketch over all rows, as much finer as there are more slices; only the
    bounds reach the driver. Nulls are ignored; without any value there are no bounds, so
    all rows form one slice.
    """
    if slices < 2:
        return []
    return list(rows.agg(quantiles_of(value, slices).alias("b")).first()["b"] or [])


def with_slice(rows: DataFrame, value: Column, bounds: Sequence[float], spread: Sequence[str] = (), name: str = "_slice") -> DataFrame:
    """Add the slice number of ``value``; slices are ordered as their values, nulls lie in slice 0.

    A slice is the number of bounds that are at most the value, found by a binary search
    in one array, whatever their number. Values equal to a repeated bound may lie in any
    slice between its copies: they are dealt out by a hash of ``spread``, the rest of the
    row's identity. So within one slice order, equal values may span several slices,
    never unequal ones.
    """
    copies = Counter(float(b) for b in bounds)
    if not copies:
        return rows.withColumn(name, F.lit(0))
    distinct = sorted(copies)
    splits = [float("-inf"), *distinct, float("inf")]
    search = Bucketizer(splits=splits, inputCol="_value_", outputCol="_at_", handleInvalid="keep")
    found = search.transform(rows.withColumn("_value_", value.cast("double")))
    at = F.when(F.col("_value_").isNull(), F.lit(0)).otherwise(F.least(F.col("_at_").cast("int"), F.lit(len(distinct))))
    if len(copies) == len(bounds):
        return found.withColumn(name, at).drop("_value_", "_at_")
    upto = list(accumulate((copies[b] for b in distinct), initial=0))
    high = F.expr(f"{_array(upto)}")
    # A value in the place of a repeated bound may go to as many slices as it has copies.
    repeated = F.expr(_array([0] + [copies[b] if copies[b] > 1 else 0 for b in distinct]))
    bound = F.expr(_array([0.0, *distinct]))
    places = F.when(F.col("_value_") == F.get(bound, at), F.get(repeated, at)).otherwise(F.lit(0))
    back = F.pmod(F.xxhash64(*spread), (places + 1).cast("bigint")).cast("int") if spread else F.lit(0)
    return found.withColumn(name, (F.get(high, at) - back).cast("int")).drop("_value_", "_at_")


def deal(rows: DataFrame, width: int) -> DataFrame:
    """Rows dealt to ``width`` partitions by ``_slice``, the slices in turn, so each gets as many.

    What is grouped by ``_slice`` afterwards needs no further shuffle.
    """
    return rows.repartitionById(width, F.col("_slice"))


def with_offsets(totals: DataFrame, groups: Sequence[str], amount: str) -> DataFrame:
    """Add to one total per (groups, ``_slice``) the ``_before`` of earlier slices and the group's ``_whole``.

    ``totals`` has at most one row per group and slice, however many rows they stand for.
    """
    by = Window.partitionBy(*groups)
    earlier = by.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumns(
        {"_before": F.coalesce(F.sum(amount).over(earlier), F.lit(0)), "_whole": F.sum(amount).over(by)}
    )


def running_total(rows: DataFrame, groups: Sequence[str], order: Sequence[str], amount: str, name: str, width: int) -> DataFrame:
    """Running total of the whole numbers in ``amount`` within ``groups`` in ``order``, for rows that have ``_slice``.

    ``_slice`` must follow ``order`` within each group. Each slice is sorted and summed
    by itself; the sum of a group's earlier slices enters as one more row that sorts
    first, so the rows are shuffled once and no group has to fit into one task. Null
    amounts add nothing; ``order`` should be unique within a group for a reproducible
    result. Null groups are groups like any other.
    """
    totals = rows.groupBy(*groups, "_slice").agg(F.sum(amount).alias("_amount"))
    kept = [c for c in rows.columns if c not in {*groups, "_slice"}]
    starts = with_offsets(totals, groups, "_amount").select(
        *groups, "_slice", *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in kept], F.col("_before").alias("_start")
    )
    every = rows.withColumn("_start", F.lit(None).cast("bigint")).unionByName(starts)
    local = Window.partitionBy("_slice", *groups).orderBy(F.col("_start").asc_nulls_last(), *order)
    total = F.sum(F.coalesce("_start", amount, F.lit(0))).over(local.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return deal(every, width).withColumn(name, total).where(F.col("_start").isNull()).drop("_start")
