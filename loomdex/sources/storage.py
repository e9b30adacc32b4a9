"""The index folder: write-once segments and manifests, and the counters that name them."""

from __future__ import annotations

import json
import threading
import time
import zlib
from dataclasses import asdict

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.index import SEGMENT_BYTES, dictionary_of_parts, invalid_records, ordinals_of_parts, sorted_postings, term_bytes, term_number
from ..schemas import DICTIONARY, POSTINGS, SORTED_POSTINGS, U32_MAX
from .files import Files
from .manifest import (
    MANIFEST_NAME,
    SEGMENT_NAME,
    U64_MAX,
    Manifest,
    SegmentMetadata,
    decode_manifest,
    encode_manifest,
    manifest_number,
    segment_number,
)

INDEX_FOLDER, MANIFESTS, SEGMENTS = "index", "manifests", "segments"
POSTINGS_TABLE, DICTIONARY_TABLE, METADATA_FILE, FILES = "postings", "dictionary", "segment.json", "files"


class StorageError(RuntimeError):
    """An index folder that can't be used as asked."""


class _Counter:
    """Gives each number once; a number that was given isn't taken back."""

    def __init__(self, following: int, what: str) -> None:
        if following > U64_MAX:
            raise StorageError(f"{what} counter exhausted")
        self._next, self._what, self._lock = following, what, threading.Lock()

    def reserve(self) -> int:
        with self._lock:
            if self._next >= U64_MAX:
                raise StorageError(f"{self._what} counter exhausted")
            self._next += 1
            return self._next - 1


class IndexStorage:
    """An index folder. Counters go on after the highest published number, also of segments that no manifest lists."""

    def __init__(self, spark: SparkSession, folder: str = INDEX_FOLDER) -> None:
        self.spark, self.files, self.folder = spark, Files(spark), folder.rstrip("/")
        for sub in (self.manifest_folder, self.segment_folder):
            self.files.make_dirs(sub)
        self._generations = _Counter(self._highest_manifest() + 1, "manifest generation")
        numbers = [segment_number(n) or 0 for n, is_file in self.files.names(self.segment_folder) if not is_file]
        self._segments = _Counter(max(numbers, default=0) + 1, "segment ID")

    @property
    def manifest_folder(self) -> str:
        return f"{self.folder}/{MANIFESTS}"

    @property
    def segment_folder(self) -> str:
        return f"{self.folder}/{SEGMENTS}"

    def manifest_path(self, generation: int) -> str:
        return f"{self.manifest_folder}/{MANIFEST_NAME.format(generation)}"

    def segment_path(self, segment_id: int) -> str:
        return f"{self.segment_folder}/{SEGMENT_NAME.format(segment_id)}"

    def reserve_segment_id(self) -> int:
        return self._segments.reserve()

    def reserve_manifest_generation(self) -> int:
        return self._generations.reserve()

    def _highest_manifest(self) -> int:
        return max((manifest_number(n) or 0 for n, is_file in self.files.names(self.manifest_folder) if is_file), default=0)

    def open_latest_manifest(self) -> tuple[int, Manifest] | None:
        """(generation, manifest) of the highest generation, null if there is none; a damaged one is an error."""
        generation = self._highest_manifest()
        return (generation, decode_manifest(self.files, self.manifest_path(generation))) if generation else None

    def publish_manifest(self, manifest: Manifest) -> int:
        """Make a manifest the latest; gives its generation."""
        generation = self.reserve_manifest_generation()
        encode_manifest(self.files, self.manifest_path(generation), manifest)
        return generation

    def write_segment(self, segment_id: int, postings: DataFrame, document_count: int, took: dict[str, float] | None = None) -> SegmentMetadata:
        """Publish postings (segment_id, term, local_document_id, term_frequency) as one immutable segment.

        ``postings`` is worked out once, unsorted, into a temporary table; what follows
        reads that. Postings lie in Parquet in the order of term and document, so a lookup
        reads the few row groups whose term range holds the term; a common term takes
        several files. ``took`` gets the milliseconds of indexing, finalization and writing,
        and the numbers of postings and tokens.
        """
        if document_count > U32_MAX:
            raise StorageError("document count exceeds u32")
        took = {} if took is None else took
        path = self.segment_path(segment_id)
        with self.files.written_once(path, "segment") as temporary:
            raw, terms, clock = f"{temporary}/raw", f"{temporary}/terms", time.perf_counter()

            def lap(name: str) -> None:
                nonlocal clock
                took[name], clock = (time.perf_counter() - clock) * 1e3, time.perf_counter()

            postings.select(*POSTINGS.names, term_number(F.col("term")).alias("_number")).write.parquet(raw)
            unsorted = self.spark.read.parquet(raw)
            figures = unsorted.agg(F.count(F.lit(1)).alias("postings"), F.sum("term_frequency").alias("tokens"), F.max("term_frequency").alias("most")).first()
            took |= {k: figures[k] or 0 for k in ("postings", "tokens")}
            if (figures["most"] or 0) > U32_MAX:
                raise StorageError("frequency exceeds u32")
            lap("indexing_ms")
            sorted_postings(unsorted).write.parquet(f"{temporary}/{POSTINGS_TABLE}")
            lap("segment_write_ms")
            stored = self.spark.read.schema(SORTED_POSTINGS).parquet(f"{temporary}/{POSTINGS_TABLE}")
            # Ordinals read the terms twice, so these are written before they are numbered.
            dictionary_of_parts(stored).write.parquet(terms)
            ranked = ordinals_of_parts(self.spark.read.parquet(terms)).select(*DICTIONARY.names)
            ranked.sortWithinPartitions("term").write.parquet(f"{temporary}/{DICTIONARY_TABLE}")
            self.files.delete(raw)
            self.files.delete(terms)
            metadata = self._measure(temporary, segment_id, document_count)
            content = asdict(metadata) | {FILES: self._sizes(temporary)}
            self.files.write(f"{temporary}/{METADATA_FILE}", json.dumps(content).encode())
            lap("finalization_ms")
        return metadata

    def _sizes(self, path: str) -> dict[str, int]:
        """Bytes of every table file of a segment."""
        found = {}
        for table in (POSTINGS_TABLE, DICTIONARY_TABLE):
            for name, is_file in self.files.names(f"{path}/{table}"):
                if is_file and name.endswith(".parquet"):
                    found[f"{table}/{name}"] = self.files.size(f"{path}/{table}/{name}")
        return found

    def segment_digest(self, path: str) -> dict[str, int]:
        """What a segment's tables hold: rows, bytes in the segment format, invalid term records, and the checksum over both tables.

        Every row of either table counts: the checksum is of sums of row hashes and numbers of
        rows, so one more, one less, one twice and one altered all show.
        """
        found: dict[str, int] = {}
        for name, schema in ((DICTIONARY_TABLE, DICTIONARY), (POSTINGS_TABLE, POSTINGS)):
            row = F.xxhash64(*schema.names)
            figures = [F.count(F.lit(1)).alias("rows"), F.sum(row.bitwiseAND(F.lit(2**31 - 1))).alias("low"), F.sum(F.shiftrightunsigned(row, 32)).alias("high")]
            if schema is DICTIONARY:
                figures += [F.sum(term_bytes()).alias("bytes"), F.count_if(invalid_records()).alias("invalid")]
            row = self.spark.read.schema(schema).parquet(f"{path}/{name}").agg(*figures).first()
            found |= {f"{name}_{k}": v or 0 for k, v in row.asDict().items()}
        text = ":".join(str(found[f"{t}_{c}"]) for t in (DICTIONARY_TABLE, POSTINGS_TABLE) for c in ("rows", "low", "high"))
        return found | {"checksum": zlib.crc32(text.encode())}

    def _measure(self, path: str, segment_id: int, document_count: int) -> SegmentMetadata:
        """Metadata as worked out from the tables; StorageError for a term record that breaks a rule."""
        found = self.segment_digest(path)
        if found[f"{DICTIONARY_TABLE}_invalid"]:
            raise StorageError(f"segment {segment_id} has {found[f'{DICTIONARY_TABLE}_invalid']} invalid term record(s)")
        length = SEGMENT_BYTES + found[f"{DICTIONARY_TABLE}_bytes"]
        return SegmentMetadata(segment_id, SEGMENT_NAME.format(segment_id), document_count, found[f"{DICTIONARY_TABLE}_rows"], length, found["checksum"])

    def load_segment_metadata(self, segment_id: int, verify: bool = True) -> SegmentMetadata:
        """Metadata of a published segment, whose files must all be there in their sizes.

        With ``verify`` both tables are read, and counts, length and checksum worked out
        again and compared.
        """
        path = self.segment_path(segment_id)
        try:
            content = json.loads(self.files.read(f"{path}/{METADATA_FILE}"))
            sizes = content.pop(FILES)
            stored = SegmentMetadata(**content)
        except (FileNotFoundError, ValueError, TypeError, KeyError, AttributeError) as e:
            raise StorageError(f"segment {segment_id} can't be read: {e}") from e
        try:
            same = self._sizes(path) == sizes
        except Py4JJavaError as e:
            raise StorageError(f"segment {segment_id} can't be read: {e}") from e
        if not same:
            raise StorageError(f"segment {segment_id} files mismatch")
        if stored.segment_id != segment_id or verify and self._measure(path, segment_id, stored.document_count) != stored:
            raise StorageError(f"segment {segment_id} checksum mismatch")
        return stored

    def segment_tables(self, manifest: Manifest) -> tuple[DataFrame, DataFrame]:
        """(postings, dictionary) over exactly the segments that a manifest lists."""
        both = []
        for name, schema in ((POSTINGS_TABLE, POSTINGS), (DICTIONARY_TABLE, DICTIONARY)):
            paths = [f"{self.segment_folder}/{s.file_name}/{name}" for s in manifest.segments]
            both.append(self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema))
        return both[0], both[1]
