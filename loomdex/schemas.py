"""Schemas of the engine's relations. Unsigned 32-bit numbers are BIGINT, checked where they are made."""

from __future__ import annotations

from pyspark.sql import types as T

U32_MAX = 4_294_967_295


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_L, _S, _D = T.LongType(), T.StringType(), T.DoubleType()

POSTINGS = _schema(segment_id=_L, term=_S, local_document_id=_L, term_frequency=_L)
#: Postings as stored: with the range slice, and the bytes of the posting after another of its slice and term.
SORTED_POSTINGS = T.StructType([*POSTINGS.fields, T.StructField("part", T.IntegerType()), T.StructField("posting_bytes", T.IntegerType())])
DICTIONARY = _schema(segment_id=_L, term=_S, term_ordinal=_L, document_frequency=_L, postings_bytes=_L)
MANIFEST = _schema(
    generation=_L, segment_id=_L, file_name=_S, document_count=_L, term_count=_L, length_bytes=_L, checksum=_L
)
LOOKUP = _schema(segment_id=_L, local_document_id=_L, term_frequency=_L)
CREATION_STATS = _schema(
    input_bytes=_L, document_count=_L, token_count=_L, unique_term_count=_L, posting_count=_L, segment_bytes=_L,
    validation_ms=_D, indexing_ms=_D, finalization_ms=_D, segment_write_ms=_D, total_ms=_D,
)
LOOKUP_STATS = _schema(
    manifest_generation=_L, segment_count=_L, total_segment_bytes=_L, total_document_count=_L, total_term_entries=_L,
    searched_segment_count=_L, matching_segment_count=_L, dictionary_comparisons=_L, matched_document_count=_L,
    encoded_postings_bytes=_L, dictionary_lookup_ms=_D, postings_decode_ms=_D, total_ms=_D,
)
