"""Building segments from text corpora and making them visible."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import words
from ..operators.index import number_documents, postings_of, term_frequencies
from ..schemas import CREATION_STATS, U32_MAX
from ..sources.corpus import CorpusError, CorpusScan, input_bytes
from ..sources.manifest import SegmentMetadata
from ..sources.storage import IndexStorage
from .snapshot import IndexSnapshot


@dataclass(frozen=True)
class CreationStats:
    """Figures of one build, with the fields of ``schemas.CREATION_STATS``."""

    input_bytes: int
    document_count: int
    token_count: int
    unique_term_count: int
    posting_count: int
    segment_bytes: int
    validation_ms: float
    indexing_ms: float
    finalization_ms: float
    segment_write_ms: float
    total_ms: float

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(asdict(self).values())], CREATION_STATS)


def corpus_postings(lines: DataFrame, segment_id: int) -> DataFrame:
    """Postings of valid lines, numbered by line."""
    corpus = lines.select(F.lit(segment_id).cast("bigint").alias("segment_id"), F.col("line_no").alias("local_document_id"), "value")
    # In a valid line the runs of letters and digits are its tokens.
    return term_frequencies(corpus, words(F.col("value")))


def create_index(storage: IndexStorage, corpus: str | Sequence[str], segment_id: int | None = None) -> tuple[SegmentMetadata, CreationStats]:
    """Write one segment from text files, numbered on in the given order; it isn't visible yet.

    The whole corpus is checked first: CorpusError with the first fault leaves nothing
    behind. An empty file is a valid corpus; an empty line isn't.
    """
    spark = storage.spark
    paths = [corpus] if isinstance(corpus, str) else list(corpus)
    began = time.perf_counter()
    size = sum(input_bytes(spark, p) for p in paths)
    scan = CorpusScan(spark, paths, check=True)
    found = scan.checked()
    if found.error:
        raise CorpusError(found.error)
    checked = time.perf_counter()
    if found.document_count > U32_MAX:
        raise CorpusError("document count exceeds u32")
    if segment_id is None:
        segment_id = storage.reserve_segment_id()
    took: dict[str, float] = {}
    metadata = storage.write_segment(segment_id, corpus_postings(scan.lines(), segment_id), found.document_count, took)
    stats = CreationStats(
        size, found.document_count, int(took["tokens"]), metadata.term_count, int(took["postings"]), metadata.length_bytes,
        (checked - began) * 1e3, took["indexing_ms"], took["finalization_ms"], took["segment_write_ms"], (time.perf_counter() - began) * 1e3,
    )
    return metadata, stats


def build_segment(storage: IndexStorage, snapshot: IndexSnapshot, corpus: str | Sequence[str]) -> CreationStats:
    """Write a segment, publish the next manifest, which makes it visible, and move the snapshot to it."""
    # The number is taken first: a build that fails leaves a gap.
    metadata, stats = create_index(storage, corpus, storage.reserve_segment_id())
    manifest = snapshot.manifest_with_segment(storage.load_segment_metadata(metadata.segment_id))
    snapshot.refresh(storage.publish_manifest(manifest), manifest)
    return stats


def publish_table_segment(storage: IndexStorage, snapshot: IndexSnapshot, documents: DataFrame, text: str = "text", key: str = "doc_id") -> SegmentMetadata:
    """The same for a table of texts, which are cut as the cleaner would and numbered in the order of the key."""
    segment_id = storage.reserve_segment_id()
    some = documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).where(F.col("text").rlike("[A-Za-z0-9]"))
    corpus = number_documents(some.withColumn("segment_id", F.lit(segment_id).cast("bigint")))
    metadata = storage.write_segment(segment_id, postings_of(corpus), some.count())
    manifest = snapshot.manifest_with_segment(metadata)
    snapshot.refresh(storage.publish_manifest(manifest), manifest)
    return metadata
