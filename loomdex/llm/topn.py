"""Top N items within every group: hot groups by salted range sorting, the rest by windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.postings import counting_postings, counting_rows
from ..operators.salted import HEAVY_ROWS, HEAVY_SHARE, heavy_keys
from ..operators.slices import slice_bounds, with_slice
from ..runtime import shuffle_width

#: Least ranges that the items of hot groups are split into, and salts among equal scores.
RANGES = 64


def _ranked(rows: DataFrame, groups: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    window = Window.partitionBy(*groups).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(window)).where(F.col("place") <= n)


def top_n(
    rows: DataFrame,
    groups: Sequence[str],
    score: str,
    ties: Sequence[str],
    n: int,
    counted: DataFrame | None = None,
    share: int = HEAVY_SHARE,
    least: int = HEAVY_ROWS,
) -> DataFrame:
    """The ``n`` rows of highest ``score`` in every group, with ``place`` from 1.

    Equal scores are ordered by the ``ties`` columns, ascending; a null score comes
    last. With ties that are unique in a group the result is reproducible. Exact counts
    of ``counted`` (rows that may still hold duplicates; ``rows`` if not given) tell
    hot groups from light ones. A light group is one partition of an ordinary window. A
    hot group is dealt out by score range and a salt among equal scores, each part keeps
    its own best ``n``, and these few are ranked again. Null groups are groups like any
    other; groups smaller than ``n`` come whole; an empty table gives an empty result.
    The result has the groups, score, ties and place; other columns are dropped, whatever
    their names.
    """
    names = list(dict.fromkeys([*groups, score, *ties]))
    rows = rows.select(*names)
    order = [F.col(score).desc_nulls_last(), *[F.col(t).asc_nulls_first() for t in ties]]
    hot = heavy_keys((rows if counted is None else counted).select(*groups), groups, share, least)
    # At most `share` rows, whatever the size of the data.
    keys = F.broadcast(hot.select(*[F.col(g).alias(f"_h_{g}") for g in groups], F.lit(True).alias("_hot")))
    on = None
    for g in groups:
        match = F.col(g).eqNullSafe(F.col(f"_h_{g}"))
        on = match if on is None else on & match
    marked = rows.join(keys, on, "left").drop(*[f"_h_{g}" for g in groups])
    light = _ranked(marked.where(F.col("_hot").isNull()), groups, order, n)
    ranges = max(RANGES, shuffle_width(rows.sparkSession))
    # The bounds are those of the hot groups alone, whose scores they are to split.
    hot_rows = (rows if counted is None else counted).join(keys, on, "left_semi")
    bounds = sorted(set(slice_bounds(hot_rows, f"`{score}`", ranges)))
    salted = with_slice(marked.where(F.col("_hot").isNotNull()), F.col(score), bounds, name="_range").withColumn(
        "_salt", F.pmod(F.xxhash64(*ties), F.lit(ranges))
    )
    parts = _ranked(salted, [*groups, "_range", "_salt"], order, n)
    heavy = _ranked(parts.drop("place"), groups, order, n)
    return light.select(*names, "place").unionByName(heavy.select(*names, "place"))


def top_postings(postings: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` counting postings of highest term_frequency of every segment and term.

    Gives (segment_id, term, place, document_id), ties by lower document_id.
    """
    best = top_n(
        counting_postings(postings),
        ["segment_id", "term"],
        "term_frequency",
        ["document_id"],
        n,
        counted=counting_rows(postings),
    )
    return best.select("segment_id", "term", "place", "document_id")
