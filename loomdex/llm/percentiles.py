"""Percentiles per group by cumulative frequencies over group-value counts.

The state of a percentile is a table of counts per group and value. Counts of separate
partitions, days or runs combine by addition, so a longer period is the sum of its days
and nothing is estimated: the rank error is 0. Values are put in order by range slices,
each slice sums its counts by itself, the sums of earlier slices are added, and the
first value whose cumulative count reaches the rank is the percentile.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from fractions import Fraction
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.slices import deal, quantiles_of, slice_bounds, with_offsets, with_slice
from ..runtime import cut, ship, shuffle_width

#: Slices for each partition; more than one, as no two are of quite the same size.
SLICES_EACH = 2
#: Most days of periods in a table from days to periods that is broadcast, some 230 bytes for each term, access and day
#: (71 MB for 951,700 days of 312,480 of them); a larger one is joined by a shuffle.
BROADCAST_DAYS = 1_000_000
#: Parts that the rows of a day are split into by that shuffle.
DAY_PARTS = 32
METRICS = ("segment_open", "total")


class Rank:
    """A wanted rank: the first value whose share of values up to it is at least ``share``.

    With ``beyond`` the share up to it must be above ``share``.
    """

    def __init__(self, name: str, share: str, beyond: bool = False) -> None:
        self.name, self.share, self.beyond = name, Fraction(share), beyond

    def place(self, whole: np.ndarray) -> np.ndarray:
        """The least cumulative count that reaches the rank among ``whole`` values, in whole numbers."""
        top, bottom = self.share.numerator, self.share.denominator
        if self.beyond:
            return whole * top // bottom + 1
        return np.maximum(-(-whole * top // bottom), 1)


#: The two published statistics and the bounds of one hundredth of rank around them.
PUBLISHED = {
    "median": (Rank("median", "1/2"), Rank("median_low", "49/100"), Rank("median_high", "51/100", beyond=True)),
    "p95": (Rank("p95", "19/20"), Rank("p95_low", "94/100"), Rank("p95_high", "96/100", beyond=True)),
}


def value_counts(rows: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """The mergeable state (groups, value, n). Null, NaN and negative values are no measurements."""
    good = F.col(value).isNotNull() & ~F.isnan(value) & (F.col(value) >= 0)
    return rows.where(good).groupBy(*groups, F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def merge_counts(states: DataFrame, groups: Sequence[str]) -> DataFrame:
    """One state of the rows of several, for any coarser ``groups``: counts add up."""
    return states.groupBy(*groups, "value").agg(F.sum("n").alias("n"))


_PICKED = pa.schema(
    [("gid", pa.int64()), ("metric", pa.int32()), ("rank", pa.int32()), ("value", pa.float64()), ("size", pa.int64())]
)


def _ranks_of_slice(rows: pa.Table, ranks: Sequence[Rank]) -> pa.RecordBatch:
    """First values of one slice that reach the ranks; rows come in the order of value, starts first."""
    lists = rows.column("gids").combine_chunks()
    offsets = lists.offsets.to_numpy()
    which = np.repeat(np.arange(rows.num_rows), np.diff(offsets))
    metric = rows.column("metric").to_numpy()[which].astype(np.int64)
    key = lists.values.to_numpy()[offsets[0] : offsets[-1]] * 2 + metric
    amount = rows.column("n").to_numpy()[which]
    start = rows.column("_whole").is_valid().to_numpy()[which]
    # The one start of each group: the count of earlier slices and the size of the group.
    order = np.argsort(key[start])
    groups, before = key[start][order], amount[start][order]
    whole = rows.column("_whole").fill_null(0).to_numpy()[which][start][order]
    order = np.flatnonzero(~start)
    order = order[np.argsort(key[order], kind="stable")]
    key, amount, which = key[order], amount[order], which[order]
    value = rows.column("value").fill_null(0.0).to_numpy()
    upto = np.cumsum(amount)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    at = np.searchsorted(groups, key[first])
    lengths = np.diff(np.r_[first, len(key)])
    upto += np.repeat(before[at] - (upto[first] - amount[first]), lengths)
    parts = []
    for i, rank in enumerate(ranks):
        place = np.repeat(rank.place(whole[at]), lengths)
        hit = np.flatnonzero((upto >= place) & (upto - amount < place))
        parts.append((key[hit], np.full(len(hit), i, np.int32), value[which[hit]], whole[np.searchsorted(groups, key[hit])]))
    keys, numbers, values, sizes = (np.concatenate(p) for p in zip(*parts, strict=True))
    return pa.RecordBatch.from_arrays(
        [pa.array(keys >> 1), pa.array((keys & 1).astype(np.int32)), pa.array(numbers), pa.array(values), pa.array(sizes)],
        schema=_PICKED,
    )


def _slices(batches: Iterator[pa.RecordBatch], ranks: Sequence[Rank]) -> Iterator[pa.RecordBatch]:
    """One slice after another; only one is held."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        numbers = batch.column("_slice").to_numpy()
        cuts = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), len(numbers)]
        for low, high in zip(cuts, cuts[1:], strict=False):
            if high > low:
                if held and held[0].column("_slice")[0].as_py() != numbers[low]:
                    yield _ranks_of_slice(pa.Table.from_batches(held), ranks)
                    held = []
                held.append(batch.slice(low, high - low))
    if held:
        yield _ranks_of_slice(pa.Table.from_batches(held), ranks)


def _pick(rows: DataFrame, ranks: Sequence[Rank]) -> DataFrame:
    """(gid, metric, size, one column per rank): first values that reach the ranks.

    ``rows`` are (_slice, gids, metric, value, n, _whole), dealt out by ``_slice``: counts,
    each with the groups it belongs to and a null _whole, and for every group and slice
    one start, whose n is the count of earlier slices and whose _whole is the group's
    size. A row counts for all its groups without being copied or sorted for each. No
    group has to fit into one task.
    """
    ordered = rows.select("_slice", "gids", "metric", "value", "n", "_whole").sortWithinPartitions(
        "_slice", F.col("value").asc_nulls_first()
    )
    ship(rows.sparkSession)
    found = ordered.mapInArrow(partial(_slices, ranks=list(ranks)), "gid bigint, metric int, rank int, value double, size bigint")
    # Equal values may lie in several slices, so a rank can only ever be reached in one.
    return found.groupBy("gid", "metric").agg(
        F.first("size").alias("size"), *[F.min(F.when(F.col("rank") == i, F.col("value"))).alias(r.name) for i, r in enumerate(ranks)]
    )


def _starts(totals: DataFrame) -> DataFrame:
    """The starts of ``_pick`` from totals (gid, metric, _slice, n)."""
    return with_offsets(totals, ["gid", "metric"], "n").select(
        "_slice", F.array("gid").alias("own"), "metric", F.lit(None).cast("double").alias("value"), F.col("_before").alias("n"), "_whole"
    )


def percentiles(state: DataFrame, groups: Sequence[str], ranks: Sequence[Rank], slices: int | None = None) -> DataFrame:
    """One row (groups, size, one column per rank) for every group of a state (groups, value, n).

    ``state`` may hold a value of a group in several rows, for example of several days.
    Exact for groups of any size: nothing is sampled and no group is gathered. Null
    groups are groups like any other; an empty state gives an empty result; equal values
    count as often as they come. Other columns are ignored.
    """
    width = shuffle_width(state.sparkSession)
    bounds = slice_bounds(state, "value", slices or width * SLICES_EACH)
    names = cut(state.select(*groups).distinct().withColumn("gid", F.monotonically_increasing_id()))
    known = names.select(*[F.col(g).alias(f"_g_{g}") for g in groups], "gid")
    on = None
    for g in groups:
        match = F.col(g).eqNullSafe(F.col(f"_g_{g}"))
        on = match if on is None else on & match
    merged = merge_counts(state, groups).join(known, on)
    rows = with_slice(merged, F.col("value"), bounds, ["gid"]).select(
        "_slice", F.array("gid").alias("own"), "gid",
        F.lit(0).alias("metric"), F.col("value").cast("double").alias("value"), "n", F.lit(None).cast("bigint").alias("_whole"),
    )
    totals = rows.groupBy("gid", "metric", "_slice").agg(F.sum("n").alias("n"))
    placed = deal(rows.drop("gid").unionByName(_starts(totals)), width)
    picked = _pick(placed.withColumnRenamed("own", "gids"), ranks)
    return names.join(picked.drop("metric"), "gid").select(*groups, "size", *[r.name for r in ranks])


def distinct_samples(samples: DataFrame) -> DataFrame:
    """Each sample_id once: the row that arrived first, one without a time coming last.

    Rows without a sample_id can't be told to be repeats and all stay. Gives (day, term,
    segment_access, segment_open_ms, total_ms); a recorded_on that is no date gives a
    null day.
    """
    day = F.unix_date(F.try_to_date("recorded_on", "yyyy-MM-dd"))
    kept = samples.select(
        "sample_id",
        F.when(F.col("sample_id").isNull(), F.monotonically_increasing_id()).alias("_row"),
        F.coalesce(F.unix_micros(F.col("arrived_at").cast("timestamp")), F.lit(2**63 - 1)).alias("_at"),
        F.struct(day.alias("day"), "term", "segment_access", "segment_open_ms", "total_ms").alias("s"),
    )
    return kept.groupBy("sample_id", "_row").agg(F.min(F.struct("_at", "s")).alias("m")).select("m.s.*")


def duration_counts(samples: DataFrame) -> DataFrame:
    """Daily state of the samples: (metric, term, segment_access, day, value, n).

    ``metric`` is the place in ``METRICS``. Days combine into longer periods by ``merge_counts``.
    """
    both = F.array(*[F.struct(F.lit(i).alias("metric"), F.col(f"{m}_ms").alias("value")) for i, m in enumerate(METRICS)])
    long = distinct_samples(samples).select("term", "segment_access", "day", F.explode(both).alias("at"))
    return value_counts(
        long.select("term", "segment_access", "day", "at.metric", F.col("at.value").alias("duration")),
        ["metric", "term", "segment_access", "day"],
        "duration",
    )


def summary_percentiles(samples: DataFrame, summaries: DataFrame) -> DataFrame:
    """Percentiles of the samples of every published period, term (``*``: all) and segment access.

    One row for each distinct (period_start, period_days, term, segment_access) of
    ``summaries`` and metric with samples: those columns, metric, size, and the ranks of
    ``PUBLISHED``. Daily counts are summed into the periods after they have been dealt
    out by value, so what is shuffled doesn't grow with the number of periods a day is
    part of. Groups with a null or no samples are absent.
    """
    spark = samples.sparkSession
    width = shuffle_width(spark)
    names = ["period_start", "period_days", "term", "segment_access"]
    measured = samples.select(
        F.unix_date(F.try_to_date("recorded_on", "yyyy-MM-dd")).alias("day"),
        F.explode(F.array("segment_open_ms", "total_ms")).alias("value"),
    ).where(F.col("value").isNotNull() & ~F.isnan("value") & (F.col("value") >= 0))
    slices = width * SLICES_EACH
    seen = measured.agg(
        F.min("day").alias("low"), F.max("day").alias("high"),
        quantiles_of("value", slices).alias("bounds"),
    ).first()
    low, high = (seen["low"], seen["high"]) if seen["low"] is not None else (0, -1)
    bounds = list(seen["bounds"] or [])

    start = F.unix_date(F.try_to_date("period_start", "yyyy-MM-dd"))
    spans = (
        summaries.select(*names).dropna().distinct()
        .withColumns({"_from": F.greatest(start, F.lit(low)), "_to": F.least(start + F.col("period_days") - 1, F.lit(high))})
        .where(F.col("_from") <= F.col("_to"))
        .withColumn("gid", F.monotonically_increasing_id())
    )
    groups = cut(spans)
    length, star = F.col("_to") - F.col("_from") + 1, F.col("term") == "*"
    days = groups.agg(*[F.coalesce(F.sum(F.when(c, length)), F.lit(0)).alias(n) for n, c in (("one", ~star), ("every", star))]).first()
    of_day = groups.withColumn("day", F.explode(F.sequence("_from", "_to")))
    one = of_day.where(~star).groupBy("term", "segment_access", "day").agg(F.collect_list("gid").alias("_one"))
    every = of_day.where(star).groupBy("segment_access", "day").agg(F.collect_list("gid").alias("_every"))
    few = days["one"] <= BROADCAST_DAYS and days["every"] <= BROADCAST_DAYS

    def with_days(rows: DataFrame, periods: DataFrame, on: Sequence[str], days: int) -> DataFrame:
        """``rows`` with the groups of their day, by a broadcast of the ``periods`` if these have few ``days``."""
        if days <= BROADCAST_DAYS:
            return rows.join(F.broadcast(periods), list(on), "left")
        # A day and access hold many rows: they are split by slice, and the few rows of periods copied to each part.
        # Spark takes the size of the periods for that of the file they are unfolded from, and would broadcast them.
        copies = periods.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(DAY_PARTS - 1))))
        split = rows.withColumn("_part", F.pmod("_slice", F.lit(DAY_PARTS)))
        return split.join(copies.hint("merge"), [*on, "_part"], "left").drop("_part")

    def with_groups(rows: DataFrame) -> DataFrame:
        """``gids``: the groups that rows belong to, besides those in ``own``."""
        none = F.array().cast("array<bigint>")
        joined = with_days(rows, one, ["term", "segment_access", "day"], days["one"])
        joined = with_days(joined, every, ["segment_access", "day"], days["every"])
        gids = F.concat(*[F.coalesce(c, none) for c in ("_one", "_every", "own")])
        return joined.withColumn("gids", gids).where(F.size("gids") > 0)

    nothing = F.lit(None).cast("array<bigint>")
    counts = with_slice(duration_counts(samples), F.col("value"), bounds, ["term", "day"])
    cells = counts.groupBy("metric", "term", "segment_access", "day", "_slice").agg(F.sum("n").alias("n"))
    of_groups = with_groups(cells.withColumn("own", nothing)).select("metric", "_slice", "n", F.explode("gids").alias("gid"))
    starts = _starts(of_groups.groupBy("gid", "metric", "_slice").agg(F.sum("n").alias("n")))
    daily = counts.withColumns({"own": nothing, "_whole": F.lit(None).cast("bigint")})
    ranks = [r for some in PUBLISHED.values() for r in some]
    # A broadcast join leaves the slices in place; one by a shuffle must come before they are dealt out.
    if few:
        placed = with_groups(deal(daily.unionByName(starts, allowMissingColumns=True), width))
    else:
        grouped = with_groups(daily).select("_slice", "gids", "metric", "value", "n", "_whole")
        placed = deal(grouped.unionByName(starts.withColumnRenamed("own", "gids")), width)
    picked = _pick(placed, ranks)
    named = groups.select("gid", *names)
    return picked.join(named if few else named.hint("merge"), "gid").withColumn(
        "metric", F.element_at(F.array(*[F.lit(m) for m in METRICS]), F.col("metric") + 1)
    ).drop("gid")


def monthly_percentiles(samples: DataFrame) -> DataFrame:
    """(metric, segment_access, month, size, median, p95): the daily states of all terms merged into calendar months.

    Samples without a date or access are groups of their own, with nulls.
    """
    month = F.trunc(F.date_from_unix_date("day"), "month").alias("month")
    daily = duration_counts(samples).select("metric", "segment_access", month, "value", "n")
    groups = ["metric", "segment_access", "month"]
    state = cut(merge_counts(daily, groups))
    ranks = [PUBLISHED[s][0] for s in PUBLISHED]
    name = F.element_at(F.array(*[F.lit(m) for m in METRICS]), F.col("metric") + 1)
    return percentiles(state, groups, ranks).withColumn("metric", name)


def unfit_figures(samples: DataFrame, summaries: DataFrame) -> DataFrame:
    """(summary_id, metric, stat) of published figures that don't fit their samples, each once.

    A figure is unfit if it is below the value at one hundredth of rank under the
    statistic, or above the value at one hundredth of rank over it. A null or NaN figure
    is no case, nor is one without samples.
    """
    names = ["period_start", "period_days", "term", "segment_access"]
    figures = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), F.lit(s).alias("stat"), F.col(f"{m}_{s}_ms").alias("v"))
            for m in METRICS
            for s in PUBLISHED
        ]
    )
    published = summaries.select("summary_id", *names, F.explode(figures).alias("f")).select(
        "summary_id", *names, "f.metric", "f.stat", "f.v"
    ).where(F.col("v").isNotNull() & ~F.isnan("v"))
    true = summary_percentiles(samples, summaries).hint("merge")
    low = F.when(F.col("stat") == "median", F.col("median_low")).otherwise(F.col("p95_low"))
    high = F.when(F.col("stat") == "median", F.col("median_high")).otherwise(F.col("p95_high"))
    wrong = published.join(true, [*names, "metric"]).where((F.col("v") < low) | (F.col("v") > high))
    return wrong.select("summary_id", "metric", "stat").distinct()
