"""Frequency of every distinct term: a global integer dictionary and blockwise count arrays.

The distinct terms get whole numbers from 0 in byte order. Rows are encoded by this
dictionary and dealt out by blocks of ``BLOCK`` consecutive numbers, a block with many rows
to several tasks. Each task adds its rows to two count arrays of a block, one for
occurrences and one for record presence, and the arrays of a block are then summed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.index import with_ordinals
from ..operators.postings import counting_rows
from ..operators.salted import HEAVY_ROWS, SALTS_MAX, heavy_keys
from ..runtime import cut, ship, shuffle_width

#: Identifiers in a block of count arrays.
BLOCK = 1_024
#: Most terms whose dictionary is broadcast; of a larger one only the heavy terms are.
BROADCAST_TERMS = 500_000
#: Parts of a block's rows for each partition of a shuffle, so that no part fills one.
PARTS_EACH = 4
_BLOCKS = "block bigint, occurrences array<bigint>, documents array<bigint>"
_LISTS = pa.list_(pa.int64())
_ARROW = pa.schema([("block", pa.int64()), ("occurrences", _LISTS), ("documents", _LISTS)])


def _arrays(block: int, occurrences: np.ndarray, documents: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([occurrences], _LISTS), pa.array([documents], _LISTS)], schema=_ARROW)


def _block_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count arrays of one partition from rows (id, occurrences), one for each record, in the order of blocks.

    One block is held at a time.
    """
    held: int | None = None
    occurrences = documents = np.zeros(BLOCK, np.int64)
    for batch in batches:
        ids, amounts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        blocks = ids // BLOCK
        cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
        for low, high in zip(cuts, cuts[1:], strict=False):
            if low == high:
                continue
            if blocks[low] != held:
                if held is not None:
                    yield _arrays(held, occurrences, documents)
                held, occurrences, documents = int(blocks[low]), np.zeros(BLOCK, np.int64), np.zeros(BLOCK, np.int64)
            places = ids[low:high] - held * BLOCK
            # Whole numbers are added as such: sums of floats would lose the last digits.
            np.add.at(occurrences, places, amounts[low:high])
            documents += np.bincount(places, minlength=BLOCK)
    if held is not None:
        yield _arrays(held, occurrences, documents)


def _block_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the arrays of each block, which come in the order of blocks."""
    held: int | None = None
    occurrences = documents = np.zeros(0, np.int64)
    for batch in batches:
        parts = [batch.column(i).values.to_numpy().reshape(-1, BLOCK) for i in (1, 2)] if batch.num_rows else []
        first = batch.column(1).offsets[0].as_py() // BLOCK if batch.num_rows else 0
        for at, block in enumerate(batch.column(0).to_pylist()):
            if block != held:
                if held is not None:
                    yield _arrays(held, occurrences, documents)
                held, occurrences, documents = block, np.zeros(BLOCK, np.int64), np.zeros(BLOCK, np.int64)
            occurrences = occurrences + parts[0][first + at]
            documents = documents + parts[1][first + at]
    if held is not None:
        yield _arrays(held, occurrences, documents)


def term_dictionary(rows: DataFrame) -> DataFrame:
    """(term, term_id, parts) of the distinct terms of ``rows``, numbered from 0 in byte order.

    ``parts`` tells over how many tasks the rows of the term's block are dealt out. Numbers
    come from range slices; nothing is gathered. The table is written once.
    """
    width = shuffle_width(rows.sparkSession)
    counts = cut(rows.groupBy("term").agg(F.count(F.lit(1)).alias("_rows")).withColumn("segment_id", F.lit(0)))
    numbered = cut(with_ordinals(counts).select("term", F.col("term_ordinal").alias("term_id"), "_rows"))
    block = F.floor(F.col("term_id") / BLOCK).alias("block")
    total = numbered.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("n")).first()["n"]
    each = max(HEAVY_ROWS, -(-total // (width * PARTS_EACH)))
    # One row for each block, so far fewer than terms.
    blocks = numbered.groupBy(block).agg(F.least(F.lit(SALTS_MAX), F.ceil(F.sum("_rows") / F.lit(each))).cast("int").alias("parts"))
    return cut(numbered.withColumn("block", block).join(blocks, "block").select("term", "term_id", "parts"))


def encoded_postings(postings: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(segment_id, term_id, parts, document_id, term_frequency) of the counting rows, by the dictionary.

    A dictionary of up to ``BROADCAST_TERMS`` terms is broadcast. Of a larger one the heavy
    terms are, and only rows of light terms move to it, so no term fills a task.
    """
    rows = counting_rows(postings)
    names = ["segment_id", "term_id", "parts", "document_id", "term_frequency"]
    if dictionary.count() <= BROADCAST_TERMS:
        return rows.join(F.broadcast(dictionary), "term").select(*names)
    heavy = F.broadcast(heavy_keys(rows.select("term"), ["term"]).join(dictionary, "term").select("term", "term_id", "parts"))
    light = rows.join(heavy.select("term"), "term", "left_anti").join(dictionary, "term")
    return rows.join(heavy, "term").select(*names).unionByName(light.select(*names))


def count_blocks(encoded: DataFrame) -> DataFrame:
    """Count arrays (block, occurrences, documents), one row for each block of identifiers.

    Repeated postings are combined before they are shuffled, and a record's postings of
    several segments meet in one task, as its part of the block depends on its id alone.
    """
    width = shuffle_width(encoded.sparkSession)
    once = encoded.groupBy("segment_id", "term_id", "parts", "document_id").agg(F.max("term_frequency").alias("n"))
    dealt = once.select(
        F.floor(F.col("term_id") / BLOCK).alias("block"),
        F.pmod(F.xxhash64("document_id"), F.col("parts")).alias("part"),
        "term_id",
        "document_id",
        "n",
    ).repartition(width, "block", "part")
    records = dealt.groupBy("block", "part", "term_id", "document_id").agg(F.sum("n").alias("occurrences"))
    ship(encoded.sparkSession)
    arrays = records.sortWithinPartitions("block").select("term_id", "occurrences").mapInArrow(_block_counts, _BLOCKS)
    return arrays.repartition(width, "block").sortWithinPartitions("block").mapInArrow(_block_sums, _BLOCKS)


def term_frequencies(postings: DataFrame) -> DataFrame:
    """Every distinct term of the counting postings with its identifier and counts.

    Gives (term_id, term, occurrences, documents): the sum of term_frequency over the
    counting postings and the number of distinct document_id. Identifiers are whole
    numbers from 0 in byte order of the terms. Repeated rows count once with their
    greatest frequency; a document in two segments is one document. Rows with nulls or
    ungrammatical terms don't count; an empty table gives an empty result.
    """
    dictionary = term_dictionary(counting_rows(postings).select("term"))
    flat = count_blocks(encoded_postings(postings, dictionary)).select(
        "block", F.posexplode(F.arrays_zip("occurrences", "documents")).alias("place", "at")
    )
    counts = flat.where(F.col("at.documents") > 0).select(
        (F.col("block") * BLOCK + F.col("place")).alias("term_id"), "at.occurrences", "at.documents"
    )
    # Both sides have one row for each term.
    return counts.join(dictionary.select("term_id", "term"), "term_id").select("term_id", "term", "occurrences", "documents")


def document_count(postings: DataFrame) -> DataFrame:
    """One row with ``n``, the number of distinct document_id among the counting rows."""
    return counting_rows(postings).select("document_id").distinct().agg(F.count(F.lit(1)).alias("n"))


def marked_terms(postings: DataFrame, rare_below: int = 3, common_one_in: int = 10) -> DataFrame:
    """Every term with its counts and ``mark``: rare, common or null.

    Rare: in fewer than ``rare_below`` documents. Common: in at least one of
    ``common_one_in`` documents. In a collection so small that a term is both, it gets
    a row for each mark.
    """
    n = document_count(postings).scalar()
    rare = F.when(F.col("documents") < rare_below, F.lit("rare"))
    common = F.when(F.col("documents") * common_one_in >= n, F.lit("common"))
    marks = F.array_compact(F.array(rare, common))
    return term_frequencies(postings).withColumn("mark", F.explode_outer(marks))


def useless_terms(postings: DataFrame) -> DataFrame:
    """(term, mark) of the terms that are too rare or too common to be useful."""
    return marked_terms(postings).where(F.col("mark").isNotNull()).select("term", "mark")
