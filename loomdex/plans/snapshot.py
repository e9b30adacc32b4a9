"""Snapshots of the index and exact-term lookups."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.probing import comparisons
from ..functions.text import check_query_term
from ..schemas import LOOKUP, LOOKUP_STATS
from ..sources.manifest import Manifest, SegmentMetadata
from ..sources.storage import IndexStorage, StorageError

#: Most terms of a batch that are broadcast; more are joined by a shuffle.
BROADCAST_TERMS = 1_000_000


def lookup_rows(postings: DataFrame, term: str) -> DataFrame:
    """(segment_id, local_document_id, term_frequency) of a term, in that order.

    Byte-exact and case-sensitive; the equality reaches the Parquet scan. A term that
    breaks the grammar is a ValueError before any plan is built; one that isn't there
    gives no rows.
    """
    check_query_term(term)
    return postings.where(F.col("term") == term).select(*LOOKUP.names).orderBy("segment_id", "local_document_id")


def lookup_stats(dictionary: DataFrame, segments: DataFrame, terms: str | Sequence[str]) -> DataFrame:
    """One row (term, searched, matching, comparisons, matched, bytes) for each given term.

    ``segments`` has (segment_id, term_count) of every visible segment; one without terms
    is searched with no comparison. Of a stored dictionary, which has ``term_ordinal``, only
    the row groups with terms from the least one asked for are read: the rank of a term is
    the ordinal of the first term of its segment that isn't below it.
    """
    asked = [check_query_term(t) for t in ([terms] if isinstance(terms, str) else terms)]
    figures = []
    for i, term in enumerate(asked):
        beyond, here = F.col("term") >= term, F.col("term") == term
        figures += [
            F.min(F.when(beyond, F.col("term_ordinal"))).alias(f"rank{i}"),
            F.max(here).alias(f"found{i}"),
            F.sum(F.when(here, F.col("document_frequency"))).alias(f"df{i}"),
            F.sum(F.when(here, F.col("postings_bytes"))).alias(f"pb{i}"),
        ]
    some = dictionary.where(F.col("term") >= min(asked))
    each = segments.select("segment_id", "term_count").join(some.groupBy("segment_id").agg(*figures), "segment_id", "left")
    zero = F.lit(0).cast("bigint")
    rows = F.array(
        *[
            F.struct(
                F.lit(term).alias("term"),
                F.coalesce(f"found{i}", F.lit(False)).alias("found"),
                F.coalesce(f"rank{i}", "term_count").alias("rank"),
                F.coalesce(f"df{i}", zero).alias("df"),
                F.coalesce(f"pb{i}", zero).alias("pb"),
            )
            for i, term in enumerate(asked)
        ]
    )
    probed = each.select("term_count", F.explode(rows).alias("p")).select("term_count", "p.*")
    counted = probed.withColumn("asked", comparisons(F.col("term_count"), F.col("rank"), F.col("found")))
    found = counted.groupBy("term").agg(
        F.count(F.lit(1)).alias("searched"),
        F.count_if("found").alias("matching"),
        F.sum("asked").alias("comparisons"),
        F.sum("df").alias("matched"),
        F.sum("pb").alias("bytes"),
    )
    # An index without segments is searched too, with nothing to find.
    wanted = dictionary.sparkSession.createDataFrame([(t,) for t in dict.fromkeys(asked)], "term string")
    return wanted.join(found, "term", "left").na.fill(0)


def batch_lookup(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings of many terms at once: (term, segment_id, local_document_id, term_frequency).

    An addition for throughput. Terms without postings come with nulls; a repeated term
    counts once; null terms are dropped.
    """
    wanted = terms.select("term").dropna().distinct()
    # The smaller side is broadcast only if its size is known to be small.
    few = wanted.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    rows = postings.select("term", *LOOKUP.names)
    hits = rows.join(F.broadcast(wanted) if few else wanted, "term")
    missing = wanted.join(hits.select("term").distinct(), "term", "left_anti")
    return hits.unionByName(missing, allowMissingColumns=True)


@dataclass(frozen=True)
class LookupStats:
    """Figures of one lookup, with the fields of ``schemas.LOOKUP_STATS``."""

    manifest_generation: int | None
    segment_count: int
    total_segment_bytes: int
    total_document_count: int
    total_term_entries: int
    searched_segment_count: int
    matching_segment_count: int
    dictionary_comparisons: int
    matched_document_count: int
    encoded_postings_bytes: int
    dictionary_lookup_ms: float
    postings_decode_ms: float
    total_ms: float

    @property
    def term_found(self) -> bool:
        return self.matching_segment_count > 0

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(asdict(self).values())], LOOKUP_STATS)


@dataclass(frozen=True)
class LookupResult:
    """Rows of a lookup, as a lazy DataFrame in the order of address, and its figures."""

    postings: DataFrame
    stats: LookupStats


class IndexSnapshot:
    """The index as of one manifest generation; later builds show only after ``refresh``."""

    def __init__(self, storage: IndexStorage) -> None:
        self.storage = storage
        latest = storage.open_latest_manifest()
        self.generation: int | None = None
        self._open(*(latest or (None, Manifest())))

    def _open(self, generation: int | None, manifest: Manifest) -> None:
        for segment in manifest.segments:
            if self.storage.load_segment_metadata(segment.segment_id, verify=False) != segment:
                raise StorageError(f"segment {segment.segment_id} isn't the one that the manifest lists")
        self.postings, self.dictionary = self.storage.segment_tables(manifest)
        self.generation, self.manifest = generation, manifest

    def refresh(self, generation: int, manifest: Manifest) -> None:
        """Move to another generation; if a segment can't be opened, the snapshot stays as it was."""
        self._open(generation, manifest)

    def manifest_with_segment(self, segment: SegmentMetadata) -> Manifest:
        return self.manifest.with_segment(segment)

    @property
    def segments(self) -> DataFrame:
        """The visible segments as rows."""
        return self.manifest.to_df(self.storage.spark, self.generation)

    def query_term(self, term: str) -> DataFrame:
        """Postings of a term over all visible segments."""
        return lookup_rows(self.postings, term)

    def term_at(self, segment_id: int, ordinal: int) -> str:
        """The ordinal-th term of a segment in byte order; IndexError beyond the last."""
        found = self.dictionary.where((F.col("segment_id") == segment_id) & (F.col("term_ordinal") == ordinal)).first()
        if found is None:
            raise IndexError("term index out of range")
        return found["term"]

    def postings_at(self, segment_id: int, ordinal: int) -> DataFrame:
        """Postings of the ordinal-th term of a segment."""
        return self.query_term(self.term_at(segment_id, ordinal)).where(F.col("segment_id") == segment_id)

    def lookup(self, term: str) -> LookupResult:
        """Rows and figures of one term. The rows stay lazy; their number is in the dictionary."""
        began = time.perf_counter()
        rows = self.query_term(term)
        query = lookup_stats(self.dictionary, self.segments, term).first()
        probed = time.perf_counter()
        # Document frequencies are counts of postings, so the rows needn't run for them.
        matched = query["matched"]
        ended = time.perf_counter()
        m = self.manifest
        return LookupResult(
            rows,
            LookupStats(
                self.generation, m.segment_count, m.total_segment_bytes, m.total_document_count, m.total_term_entries,
                query["searched"], query["matching"], query["comparisons"], matched, query["bytes"],
                (probed - began) * 1e3, (ended - probed) * 1e3, (ended - began) * 1e3,
            ),
        )
