"""Items that appear together: stripes of co-occurring neighbours and log-likelihood ratios."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.index import with_ordinals
from ..operators.postings import counting_rows
from ..runtime import cut, ship, shuffle_width
from .frequencies import document_count

#: Log-likelihood ratio of a chance of one in a thousand (chi-squared, one degree of freedom).
SIGNIFICANT = 10.83
#: Most items whose dictionary is broadcast; beyond it the dictionary is joined by a shuffle.
BROADCAST_ITEMS = 500_000
#: Pairs that one partition holds before it passes on its stripes.
PAIRS_HELD = 4_000_000
#: Neighbours of an item that make one range: a stripe is cut into ranges, so that of no item all stripes meet in one task.
RANGE_BITS = 12
#: Items of a record above which its pairs are dealt out to several tasks.
LONG_RECORD = 2_048
_STRIPES = "item bigint, range int, neighbours array<int>, counts array<bigint>"
_ARROW = pa.schema([("item", pa.int64()), ("range", pa.int32()), ("neighbours", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])


def _sum_pairs(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pair codes with the sums of their counts."""
    codes, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    return codes[starts], np.add.reduceat(counts.astype(np.int64), starts)


def _pair_codes(items: np.ndarray, lengths: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[np.ndarray]:
    """Codes ``a << 32 | b`` with a <= b of records given as runs of sorted items.

    Of a record the items from place ``low`` to before ``high`` are taken as a. Records of
    one length are handled together as a matrix. A pass takes at most some ``PAIRS_HELD``
    codes, also of a single very long record.
    """
    starts = np.cumsum(lengths) - lengths
    whole = (low == 0) & (high >= lengths) & (lengths * (lengths + 1) // 2 <= PAIRS_HELD)
    for length in np.unique(lengths[whole]).tolist():
        at, pairs = starts[whole & (lengths == length)], length * (length + 1) // 2
        records = max(1, PAIRS_HELD // pairs)
        a, b = np.triu_indices(length)
        for first in range(0, len(at), records):
            matrix = items[at[first : first + records, None] + np.arange(length)]
            yield ((matrix[:, a] << 32) | matrix[:, b]).ravel()
    for i in np.flatnonzero(~whole).tolist():
        record = items[starts[i] : starts[i] + lengths[i]]
        for place in range(int(low[i]), int(min(high[i], lengths[i]))):
            yield (record[place] << 32) | record[place:]


def _as_stripes(codes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Stripes (item, range, neighbours, counts) of sorted distinct codes."""
    ranges = codes >> RANGE_BITS
    starts = np.flatnonzero(np.r_[True, ranges[1:] != ranges[:-1]]) if len(codes) else np.zeros(0, np.int64)
    offsets = pa.array(np.r_[starts, len(codes)].astype(np.int32))
    neighbours = codes & 0xFFFFFFFF
    return pa.RecordBatch.from_arrays(
        [
            pa.array(codes[starts] >> 32),
            pa.array((neighbours[starts] >> RANGE_BITS).astype(np.int32)),
            pa.ListArray.from_arrays(offsets, pa.array(neighbours.astype(np.int32))),
            pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int64))),
        ],
        schema=_ARROW,
    )


def _stripes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stripes of one partition: for each item and range its neighbours of higher or equal number.

    The neighbour equal to the item itself carries the item's number of records.
    """
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        lists = batch.column("items")
        offsets = lists.offsets.to_numpy()
        items = lists.values.to_numpy()[offsets[0] : offsets[-1]].astype(np.int64)
        some = np.diff(offsets) > 0
        low, high = (batch.column(c).to_numpy()[some] for c in ("low", "high"))
        for codes in _pair_codes(items, np.diff(offsets)[some], low, high):
            distinct, counts = np.unique(codes, return_counts=True)
            held.append((distinct, counts))
            size += len(distinct)
            if size > 2 * PAIRS_HELD:
                held = [_sum_pairs(held)]
                size = len(held[0][0])
                if size > PAIRS_HELD:
                    yield _as_stripes(*held[0])
                    held, size = [], 0
    if held:
        yield _as_stripes(*_sum_pairs(held))


def _merged(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """One stripe for each item and range out of several, which come in the order of both.

    The arrays are added; neighbours in fewer than ``least`` records are then left out.
    """

    def done(codes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        enough = counts >= least
        return _as_stripes(codes[enough], counts[enough])

    codes = counts = np.zeros(0, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = [batch.column(c) for c in ("neighbours", "counts")]
        offsets = lists[0].offsets.to_numpy()
        neighbours, amounts = (x.values.to_numpy()[x.offsets[0].as_py() : x.offsets[len(x)].as_py()] for x in lists)
        new = (np.repeat(batch.column("item").to_numpy(), np.diff(offsets)) << 32) | neighbours
        codes, counts = _sum_pairs([(codes, counts), (new, amounts)])
        # The last range may go on in the next batch.
        last = int(np.searchsorted(codes, (codes[-1] >> RANGE_BITS) << RANGE_BITS))
        yield done(codes[:last], counts[:last])
        codes, counts = codes[last:], counts[last:]
    if len(codes):
        yield done(codes, counts)


def log_likelihood_ratio(both: Column, a: Column, b: Column, n: Column) -> Column:
    """Log-likelihood ratio of the 2 x 2 table of two items in ``n`` records.

    ``both`` records hold both items, ``a`` and ``b`` hold each. 0 if independent.
    """

    def term(observed: Column, rows: Column, columns: Column) -> Column:
        expected = rows * columns / n
        return F.when(observed > 0, observed * F.log(observed / expected)).otherwise(F.lit(0.0))

    total = (
        term(both, a, b)
        + term(a - both, a, n - b)
        + term(b - both, n - a, b)
        + term(n - a - b + both, n - a, n - b)
    )
    return 2 * total


def record_stripes(records: DataFrame) -> DataFrame:
    """Stripes of records (items), which come as sorted arrays; the pairs of long ones are dealt out first."""
    size = F.size("items")
    short = records.where(size <= LONG_RECORD).select("items", F.lit(0).alias("low"), size.alias("high"))
    steps = F.sequence(F.lit(0), size - 1, F.lit(LONG_RECORD // 2))
    long = records.where(size > LONG_RECORD).select("items", F.explode(steps).alias("low"))
    spread_out = long.select("items", "low", (F.col("low") + LONG_RECORD // 2).alias("high")).repartition(
        shuffle_width(records.sparkSession), F.xxhash64("items"), "low"
    )
    return short.unionByName(spread_out).mapInArrow(_stripes, _STRIPES)


def cooccurring(
    rows: DataFrame,
    record: str,
    item: str,
    n: Column | int,
    least_records: int,
    significant: float = SIGNIFICANT,
) -> DataFrame:
    """Pairs of items that appear in the same record significantly more often than by chance.

    Gives (item_a, item_b, records_a, records_b, together, ratio, llr) with item_a < item_b
    in byte order, for pairs in at least ``least_records`` common records, with a ratio
    to chance above 1 and a log-likelihood ratio of at least ``significant``. ``n`` is
    the number of all records.

    A pair is in no more records than either of its items, so items in fewer than
    ``least_records`` rows are dropped before anything is shuffled; that loses no pair.
    The rest are numbered in byte order by range slices; their number is at most all rows
    divided by ``least_records``. Each partition turns its records into stripes, cut into
    ranges of neighbours; the arrays of one item and range are added in one task, so an
    item with any number of neighbours is spread. A record is held as one array of its
    distinct numbered items; the pairs of one with more than ``LONG_RECORD`` items are dealt
    out to several tasks. Repeated rows count once; rows with a null record or item don't
    count; an empty table gives an empty result.
    """
    spark = rows.sparkSession
    width = shuffle_width(spark)
    known = rows.select(F.col(record).alias("record"), F.col(item).alias("item")).dropna()
    often = known.groupBy("item").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") >= least_records)
    # Items are numbered by slices and the dictionary cut, so that its size can be checked.
    terms = cut(often.select(F.lit(0).alias("segment_id"), F.col("item").alias("term")))
    numbered = cut(with_ordinals(terms).select(F.col("term").alias("item"), F.col("term_ordinal").cast("int").alias("number")))
    small = numbered.count() <= BROADCAST_ITEMS
    dictionary = F.broadcast(numbered) if small else numbered
    encoded = known.join(dictionary, "item").select("record", "number").distinct()
    records = (
        encoded.repartition(width, "record")
        .groupBy("record")
        .agg(F.sort_array(F.collect_list("number")).alias("items"))
        .select("items")
    )
    ship(spark)
    stripes = record_stripes(records).repartition(width, "item", "range").sortWithinPartitions("item", "range")
    merged = stripes.mapInArrow(partial(_merged, least=least_records), _STRIPES)
    # Each pair is in one merged stripe, so what comes out is final.
    counts = merged.select("item", F.explode(F.arrays_zip("neighbours", "counts")).alias("at")).select(
        "item", F.col("at.neighbours").cast("bigint").alias("other"), F.col("at.counts").alias("together")
    )
    single = counts.where(F.col("item") == F.col("other")).select("item", F.col("together").alias("records"))
    items = numbered.join(single, numbered["number"] == single["item"]).select(
        "number", numbered["item"].alias("name"), "records"
    )
    side = (lambda d: F.broadcast(d)) if small else (lambda d: d)
    first = items.select(F.col("number").alias("item"), F.col("name").alias("item_a"), F.col("records").alias("records_a"))
    second = items.select(F.col("number").alias("other"), F.col("name").alias("item_b"), F.col("records").alias("records_b"))
    pairs = (
        counts.where(F.col("item") != F.col("other"))
        .join(side(first), "item")
        .join(side(second), "other")
    )
    total = F.lit(n) if isinstance(n, int) else n
    chance = F.col("records_a") * F.col("records_b") / total
    llr = log_likelihood_ratio(F.col("together"), F.col("records_a"), F.col("records_b"), total)
    measured = pairs.select(
        "item_a", "item_b", "records_a", "records_b", "together", (F.col("together") / chance).alias("ratio"), llr.alias("llr")
    )
    return measured.where((F.col("ratio") > 1) & (F.col("llr") >= significant))


def term_pairs(postings: DataFrame, least: int = 8, one_in: int = 2_000) -> DataFrame:
    """Significant pairs of terms in the same document of the counting postings.

    A pair is in at least ``least`` common documents and in at least one of ``one_in``
    of all documents. Columns as of ``cooccurring``, and ``n``, the number of documents.
    """
    n = document_count(postings).first()["n"]
    wanted = max(least, -(-n // one_in))
    rows = counting_rows(postings)
    return cooccurring(rows, "document_id", "term", n, wanted).withColumn("n", F.lit(n).cast("bigint"))


def strong_pairs(postings: DataFrame, ratio: int = 5) -> DataFrame:
    """(term_a, term_b) found together at least ``ratio`` times as often as by chance.

    Of pairs from ``term_pairs``. With 8 common documents or more and a ratio of 5, the
    log-likelihood ratio is at least 2 * (8 ln 5 - 6.4) = 12.9, so its threshold takes
    none of them away. The ratio is compared in whole numbers.
    """
    pairs = term_pairs(postings)
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    enough = wide("together") * wide("n") >= F.lit(ratio) * wide("records_a") * wide("records_b")
    return pairs.where(enough).select(F.col("item_a").alias("term_a"), F.col("item_b").alias("term_b"))
