"""Manifests: which segments are visible, one write-once file for each generation."""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

from ..schemas import MANIFEST, U32_MAX
from .files import Files

U64_MAX = 2**64 - 1
#: How files are named.
MANIFEST_NAME, SEGMENT_NAME = "manifest-{:020d}.json", "segment-{:020d}"
_MANIFEST, _SEGMENT = (re.compile(p, re.ASCII) for p in (r"manifest-(\d{20})\.json", r"segment-(\d{20})"))
FORMAT, VERSION = "loomdex manifest", 1


class ManifestError(ValueError):
    """A manifest that breaks a rule; ``kind`` names the rule (fixed values)."""

    def __init__(self, kind: str, detail: str = "") -> None:
        super().__init__(f"{kind}: {detail}" if detail else kind)
        self.kind = kind


def file_number(pattern: re.Pattern, name: str) -> int | None:
    """Number in a published name, null if the name isn't one: exactly 20 digits, not 0, within 64 bits."""
    match = pattern.fullmatch(name)
    number = int(match[1]) if match else 0
    return number if 0 < number <= U64_MAX else None


def manifest_number(name: str) -> int | None:
    return file_number(_MANIFEST, name)


def segment_number(name: str) -> int | None:
    return file_number(_SEGMENT, name)


def is_safe_file_name(name: str) -> bool:
    """Whether a name stays within its folder."""
    return bool(name) and "/" not in name and "\\" not in name and name not in (".", "..")


@dataclass(frozen=True)
class SegmentMetadata:
    segment_id: int
    file_name: str
    document_count: int
    term_count: int
    length_bytes: int
    checksum: int


@dataclass(frozen=True)
class Manifest:
    """Segments in strictly increasing order of id; may be empty."""

    segments: tuple[SegmentMetadata, ...] = ()

    def __post_init__(self) -> None:
        names: set[str] = set()
        before = 0
        for s in self.segments:
            if not 0 < s.segment_id <= U64_MAX:
                raise ManifestError("InvalidSegmentId", str(s.segment_id))
            if s.segment_id <= before:
                raise ManifestError("SegmentIdsNotStrictlyIncreasing", f"{before}, {s.segment_id}")
            if not is_safe_file_name(s.file_name):
                raise ManifestError("UnsafeFileName", s.file_name)
            if s.file_name in names:
                raise ManifestError("DuplicateFileName", s.file_name)
            if not (0 <= s.document_count <= U32_MAX and 0 <= s.term_count <= U32_MAX and 0 <= s.checksum <= U32_MAX):
                raise ManifestError("CountOverflow", s.file_name)
            before = s.segment_id
            names.add(s.file_name)
        for kind, total in (
            ("TotalDocumentCountOverflow", self.total_document_count),
            ("TotalSegmentBytesOverflow", self.total_segment_bytes),
            ("TotalTermEntriesOverflow", self.total_term_entries),
        ):
            if total > U64_MAX:
                raise ManifestError(kind)

    @property
    def segment_count(self) -> int:
        return len(self.segments)

    @property
    def total_document_count(self) -> int:
        return sum(s.document_count for s in self.segments)

    @property
    def total_segment_bytes(self) -> int:
        return sum(s.length_bytes for s in self.segments)

    @property
    def total_term_entries(self) -> int:
        """Sum of the dictionaries' sizes; a term in two segments counts twice."""
        return sum(s.term_count for s in self.segments)

    def with_segment(self, segment: SegmentMetadata) -> Manifest:
        """These segments and one more, validated again."""
        return Manifest((*self.segments, segment))

    def to_df(self, spark: SparkSession, generation: int | None) -> DataFrame:
        """The manifest as rows."""
        rows = [(generation, *asdict(s).values()) for s in self.segments]
        return spark.createDataFrame(rows, MANIFEST)


def encode_manifest(files: Files, path: str, manifest: Manifest) -> None:
    """Write a manifest once; its generation is the number in its name."""
    generation = manifest_number(path.rpartition("/")[2])
    if generation is None:
        raise ManifestError("InvalidManifestName", path)
    body = json.dumps(
        {"format": FORMAT, "version": VERSION, "generation": generation, "segments": [asdict(s) for s in manifest.segments]}
    ).encode()
    with files.written_once(path, "manifest") as temporary:
        files.write(temporary, body + b"\n%08x\n" % zlib.crc32(body))


def decode_manifest(files: Files, path: str) -> Manifest:
    """Read a manifest; ManifestError tells the first thing that is wrong: size, checksum, format, version, content."""
    data = files.read(path)
    if len(data) < 11 or data[-10:-9] != b"\n" or data[-1:] != b"\n":
        raise ManifestError("manifest too small")
    body = data[:-10]
    try:
        expected = int(data[-9:-1], 16)
    except ValueError:
        expected = -1
    if zlib.crc32(body) != expected:
        raise ManifestError("manifest checksum mismatch")
    try:
        content = json.loads(body)
    except ValueError as e:
        raise ManifestError("invalid manifest format") from e
    if content.get("format") != FORMAT:
        raise ManifestError("invalid manifest format")
    if content.get("version") != VERSION:
        raise ManifestError("unsupported manifest format version", str(content.get("version")))
    if content.get("generation") != manifest_number(path.rpartition("/")[2]):
        raise ManifestError("manifest generation does not match its name", str(content.get("generation")))
    try:
        return Manifest(tuple(SegmentMetadata(**s) for s in content["segments"]))
    except (KeyError, TypeError) as e:
        raise ManifestError("invalid manifest content", str(e)) from e
