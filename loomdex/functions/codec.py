"""Variable-length integers and posting bytes: Column expressions, and a decoder that tells what is wrong.

A number is written in groups of 7 bits, lowest first, the top bit of a byte telling
that more follow. A posting list is, for each posting, the distance to the document
before (the first: the document itself) and the frequency.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import ship
from ..schemas import U32_MAX


#: Documents of a term whose postings lie in one row or window.
DOCUMENT_RANGE = 1 << 16


class CodecError(ValueError):
    """A fault; the kinds are fixed values, the names of what can be wrong with encoded postings.

    ``kind`` names what is wrong; ``at`` is the number it is about, if any."""

    def __init__(self, kind: str, at: int | None = None) -> None:
        super().__init__(kind if at is None else f"{kind}: {at}")
        self.kind, self.at = kind, at


def varint_length(value: Column) -> Column:
    """Bytes that a number from 0 to 2^32 - 1 takes: 1 to 5. Null for null."""
    length = F.when(value.isNull(), F.lit(None).cast("int"))
    for n in range(1, 5):
        length = length.when(value < 2 ** (7 * n), F.lit(n))
    return length.otherwise(F.lit(5))


def varint_hex(value: Column) -> Column:
    """Bytes of a number as hexadecimal digits; null for null and for numbers that aren't unsigned 32-bit."""
    last = varint_length(F.when(value.between(0, U32_MAX), value)) - 1

    def group(i: Column) -> Column:
        bits = F.call_function("shiftright", value, i * 7).bitwiseAND(F.lit(127))
        return F.lpad(F.hex(bits + F.when(i < last, F.lit(128)).otherwise(F.lit(0))), 2, "0")

    return F.array_join(F.transform(F.sequence(F.lit(0), last), group), "")


def varint(value: Column) -> Column:
    """Bytes of a number."""
    return F.unhex(varint_hex(value))


def varint_value(data: Column) -> Column:
    """Number of bytes that hold one well-formed number; for others use ``decode_varint``."""
    places = F.sequence(F.lit(0), F.octet_length(data) - 1)
    byte = lambda i: F.conv(F.hex(F.substring(data, i + 1, F.lit(1))), 16, 10).cast("bigint")
    return F.aggregate(
        places, F.lit(0).cast("bigint"), lambda s, i: s + F.call_function("shiftleft", byte(i).bitwiseAND(F.lit(127)), i * 7)
    )


def document_block(document: str | Column) -> Column:
    """Number of the document range of a posting."""
    return F.floor((F.col(document) if isinstance(document, str) else document) / DOCUMENT_RANGE)


def with_deltas(postings: DataFrame, keys: Sequence[str] = ("segment_id", "term"), document: str = "local_document_id") -> DataFrame:
    """Postings with ``delta``, the distance to the document before within the keys.

    The last document of the earlier ranges enters each document range as one more row, so
    no key has to fit into one task.
    """
    ranged = postings.withColumns({"_block": document_block(document), "_start": F.lit(False)})
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each key and document range.
    last = ranged.groupBy(*keys, "_block").agg(F.max(document).alias("_max")).withColumn(document, F.max("_max").over(earlier))
    starts = last.where(F.col(document).isNotNull()).select(*keys, "_block", document, F.lit(True).alias("_start"))
    rows = ranged.unionByName(starts, allowMissingColumns=True)
    by = Window.partitionBy(*keys, "_block").orderBy(document, F.col("_start").desc())
    delta = F.col(document) - F.coalesce(F.lag(document).over(by), F.lit(0))
    return rows.withColumn("delta", delta).where(~F.col("_start")).drop("_block", "_start")


def with_documents(deltas: DataFrame, keys: Sequence[str], order: str, name: str) -> DataFrame:
    """The inverse: ``name`` is the running sum of ``delta`` in ``order`` within the keys, which are cut into ranges of ``order``."""
    sliced = deltas.withColumn("_slice", document_block(order))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sliced.groupBy(*keys, "_slice").agg(F.sum("delta").alias("_sum"))
    starts = sums.select(*keys, "_slice", F.sum("_sum").over(earlier).alias("_before")).where(F.col("_before").isNotNull())
    every = sliced.withColumn("_before", F.lit(None).cast("bigint")).unionByName(starts, allowMissingColumns=True)
    by = Window.partitionBy(*keys, "_slice").orderBy(F.col("_before").asc_nulls_last(), order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return every.withColumn(name, F.sum(F.coalesce("_before", "delta")).over(by)).where(F.col("_before").isNull()).drop("_slice", "_before")


def encoded_postings(postings: DataFrame) -> DataFrame:
    """(segment_id, term, block, document_frequency, before, encoded BINARY): posting bytes of every term by document range.

    The bytes of a term's blocks, one after the other, are its posting list; ``before`` is
    the last document of the earlier blocks, null for the first. A block has at most
    ``DOCUMENT_RANGE`` postings, so a row stays small however common the term.
    ``check_postings`` tells of rows that can't be encoded.
    """
    pairs = with_deltas(postings).withColumns(
        {"block": document_block("local_document_id"), "_hex": F.concat(varint_hex(F.col("delta")), varint_hex(F.col("term_frequency")))}
    )
    ordered = F.array_sort(F.collect_list(F.struct("local_document_id", "_hex", "delta")))
    first = F.get("_o", F.lit(0))
    lists = pairs.groupBy("segment_id", "term", "block").agg(F.count(F.lit(1)).alias("document_frequency"), ordered.alias("_o"))
    before = F.col("_first.local_document_id") - F.col("_first.delta")
    earlier = F.min("block").over(Window.partitionBy("segment_id", "term"))
    return lists.select(
        "segment_id", "term", "block", "document_frequency", first.alias("_first"),
        F.unhex(F.array_join(F.transform("_o", lambda p: p["_hex"]), "")).alias("encoded"),
    ).select("segment_id", "term", "block", "document_frequency", F.when(F.col("block") > earlier, before).alias("before"), "encoded")


def decode_varint(data: bytes, at: int = 0) -> tuple[int, int]:
    """(number, bytes taken) at a place; raises CodecError Truncated, Overflow or NonCanonical."""
    value = 0
    for n, byte in enumerate(data[at : at + 5]):
        if n == 4 and byte & 0x7F > 0x0F:
            raise CodecError("Overflow")
        value |= (byte & 0x7F) << 7 * n
        if byte < 0x80:
            if n and not byte:
                raise CodecError("NonCanonical")
            return value, n + 1
    raise CodecError("Truncated" if len(data) - at < 5 else "Overflow")


def decode_postings(data: bytes, count: int, before: int | None = None) -> Iterator[tuple[int, int]]:
    """The (document, frequency) pairs one by one, after document ``before`` if there is one.

    Raises CodecError at the first thing that is wrong.
    """
    at, document = 0, before
    for _ in range(count):
        try:
            delta, taken = decode_varint(data, at)
        except CodecError as e:
            raise CodecError(f"InvalidDocumentDelta({e.kind})") from None
        at += taken
        if document is not None:
            if not delta:
                raise CodecError("ZeroDelta", document)
            if document + delta > U32_MAX:
                raise CodecError("DocumentIdOverflow")
        document = delta + (document or 0)
        try:
            frequency, taken = decode_varint(data, at)
        except CodecError as e:
            raise CodecError(f"InvalidTermFrequency({e.kind})") from None
        if not frequency:
            raise CodecError("ZeroFrequency", document)
        at += taken
        yield document, frequency
    if at < len(data):
        raise CodecError("TrailingBytes")


def check_postings(postings: Sequence[tuple[int, int]]) -> None:
    """Raise CodecError if (document, frequency) pairs can't be encoded."""
    before = None
    for document, frequency in postings:
        if before is not None and before >= document:
            raise CodecError("DocumentIdsNotStrictlyIncreasing", document)
        if not frequency:
            raise CodecError("ZeroFrequency", document)
        before = document


def decoded_postings(encoded: DataFrame) -> DataFrame:
    """(segment_id, term, local_document_id, term_frequency, error) of rows from ``encoded_postings``.

    Pairs before a fault are given; the fault itself is one row with its kind in ``error``.
    """

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for segment, term, count, before, data in batch.itertuples(index=False):
                try:
                    start = None if pd.isna(before) else int(before)
                    rows += ((segment, term, *pair, None) for pair in decode_postings(data, count, start))
                except CodecError as e:
                    rows.append((segment, term, None, None, e.kind))
            yield pd.DataFrame(rows, columns=["segment_id", "term", "local_document_id", "term_frequency", "error"])

    ship(encoded.sparkSession)
    schema = "segment_id bigint, term string, local_document_id bigint, term_frequency bigint, error string"
    # Encoded lists of other makers have no blocks.
    before = F.col("before") if "before" in encoded.columns else F.lit(None).cast("bigint")
    return encoded.select("segment_id", "term", "document_frequency", before.alias("before"), "encoded").mapInPandas(decode, schema)
