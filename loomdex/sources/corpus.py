"""Text corpora: one document per line, strict grammar, numbered in file order."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import WHITE_SPACE, clean_text, is_term, tokens
from ..runtime import cut
from .files import Files

BOM = b"\xef\xbb\xbf"
#: Most file blocks whose table of starts is broadcast: one row for each task of a scan, 100 TB in blocks of 128 MB.
BROADCAST_BLOCKS = 1_000_000


class CorpusError(ValueError):
    """A corpus that can't be read or breaks the grammar."""


def _glob_escaped(path: str) -> str:
    """The literal path, for a reader that expands patterns."""
    return "".join(f"\\{c}" if c in "{}[]*?\\" else c for c in path)


def input_bytes(spark: SparkSession, path: str) -> int:
    """Size of a corpus file."""
    try:
        return Files(spark).size(path)
    except FileNotFoundError as e:
        raise CorpusError(f"failed to read document file metadata: {path} not found") from e


@dataclass(frozen=True)
class CorpusCheck:
    """What one pass over a corpus found."""

    document_count: int
    #: Null if the tokens weren't counted on the way.
    token_count: int | None
    error: str | None


#: What nearly every valid line looks like, matched without a step back; and a character that no valid line holds.
USUAL, FOREIGN = r"\A[A-Za-z0-9][A-Za-z0-9 ]*+\z", r"[^A-Za-z0-9\p{IsWhite_Space}]"


def line_faults(value: Column) -> Column:
    """Struct (kind, token) of the first fault of a line: 0 invalid UTF-8, 1 empty, 2 a bad token; else null.

    Only lines with a foreign character are cut into tokens, and only unusual ones looked at more than once.
    """
    bad = F.get(F.filter(tokens(value), lambda t: ~is_term(t)), F.lit(0))
    fault = lambda kind, token: F.struct(F.lit(kind).alias("kind"), token.alias("token"))
    none = F.lit(None).cast("string")
    return (
        F.when(value.rlike(USUAL), F.lit(None))
        .when(~F.is_valid_utf8(value), fault(0, none))
        .when(value.rlike(FOREIGN), fault(2, bad))
        .when(~value.rlike("[A-Za-z0-9]"), fault(1, none))
    )


def _error(line: int, kind: int, token: str | None) -> str:
    return (
        f"failed to read line {line}: stream did not contain valid UTF-8",
        f"document on line {line} is empty",
        f"token '{token}' on line {line} is not ASCII alphanumeric",
    )[kind]


def check_lines(lines: DataFrame) -> CorpusCheck:
    """Documents, tokens and the first fault by line and place, in one pass without a shuffle of lines."""
    found = lines.select(
        "line_no", F.size(tokens(F.col("value"))).alias("n"), line_faults(F.col("value")).alias("fault")
    ).agg(
        F.count(F.lit(1)).alias("documents"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"),
        F.min(F.when(F.col("fault").isNotNull(), F.struct("line_no", "fault"))).alias("first"),
    ).first()
    first = found["first"]
    error = None if first is None else _error(first["line_no"] + 1, first["fault"]["kind"], first["fault"]["token"])
    return CorpusCheck(found["documents"], found["tokens"], error)


class CorpusScan:
    """Text files whose lines count from 0 through the files in the given order.

    Lines end at a newline only; a carriage return before it stays, being white space. A
    byte order mark is part of the first line of its file. An empty file has no lines. Lines
    keep their place: one pass counts the lines of each file block where they are read, and
    on request checks them; the starts of the blocks, one small row each, are written once
    and added to the lines of later passes. The text itself is never shuffled or sorted.
    """

    def __init__(self, spark: SparkSession, paths: str | Sequence[str], check: bool = False) -> None:
        files, paths = Files(spark), [paths] if isinstance(paths, str) else list(paths)
        parts, self._any_marked = [], False
        for ordinal, path in enumerate(paths):
            if not files.exists(path):
                raise CorpusError(f"failed to open document file: {path} not found")
            marked = files.read(path, 3) == BOM
            self._any_marked |= marked
            text = spark.read.text(_glob_escaped(path), lineSep="\n")
            part = text.select("value", F.col("_metadata.file_block_start").alias("_block"), F.lit(ordinal).alias("_file"))
            parts.append(part.withColumn("_marked", F.lit(marked)))
        lines = parts[0]
        for part in parts[1:]:
            lines = lines.unionByName(part)
        # Ids grow by one from line to line of a block, whatever else the task reads.
        self._lines = lines.withColumn("_id", F.monotonically_increasing_id())
        self._starts = cut(self._counted(check))
        self._few = self._starts.count() <= BROADCAST_BLOCKS

    def _counted(self, check: bool) -> DataFrame:
        """(_file, _block, _first, _lines, _start) of every block, and what the check found in it."""
        lines = self._lines
        figures = [F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_lines"), F.max("_marked").alias("_marked")]
        if check:
            figures.append(F.min(F.when(F.col("fault").isNotNull(), F.struct("_id", "fault"))).alias("_fault"))
            lines = lines.withColumn("fault", line_faults(F.col("value")))
            if self._any_marked:
                # The reader takes the mark away, so the first line of the file is looked at apart.
                figures.append(F.min(F.when(F.col("_marked") & (F.col("_block") == 0), F.struct("_id", "value"))).alias("_head"))
        earlier = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
        # One row for each block: the only thing that is put in order.
        return lines.groupBy("_file", "_block").agg(*figures).withColumn("_start", F.coalesce(F.sum("_lines").over(earlier), F.lit(0)))

    def checked(self) -> CorpusCheck:
        """What the first pass found, if it was asked to check."""
        place = F.col("_start") - F.col("_first")
        faults = [F.when(F.col("_fault").isNotNull(), F.struct((F.col("_fault._id") + place).alias("line"), "_fault.fault.kind", "_fault.fault.token"))]
        if self._any_marked:
            token = F.concat(F.lit("\ufeff"), F.coalesce(F.get(F.split("_head.value", WHITE_SPACE, 2), F.lit(0)), F.lit("")))
            head = F.struct((F.col("_head._id") + place).alias("line"), F.lit(2).alias("kind"), token.alias("token"))
            faults.insert(0, F.when(F.col("_head").isNotNull(), head))
        first = F.array_min(F.array_compact(F.array(*faults)))
        found = self._starts.agg(
            F.coalesce(F.sum("_lines"), F.lit(0)).alias("documents"), F.min(first).alias("first")
        ).first()
        error = None if found["first"] is None else _error(found["first"]["line"] + 1, found["first"]["kind"], found["first"]["token"])
        return CorpusCheck(found["documents"], None, error)

    def lines(self) -> DataFrame:
        """(line_no BIGINT, value STRING)."""
        starts = self._starts.select("_file", "_block", "_first", "_lines", "_start")
        numbered = self._lines.join(F.broadcast(starts) if self._few else starts, ["_file", "_block"], "left")
        place = F.col("_id") - F.col("_first")
        # A file that changed or is cut into other blocks than in the first pass must not be numbered wrongly.
        number = F.when((place >= 0) & (place < F.col("_lines")), place + F.col("_start")).otherwise(
            F.raise_error(F.lit("the blocks of a text file changed between two reads"))
        )
        first = (F.col("_block") == 0) & F.col("_marked") & (place == 0)
        return numbered.select(
            number.alias("line_no"), F.when(first, F.concat(F.lit("\ufeff"), "value")).otherwise(F.col("value")).alias("value")
        )


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(line_no BIGINT, value STRING) of text files; see ``CorpusScan``."""
    return CorpusScan(spark, paths).lines()


def validate_corpus(spark: SparkSession, path: str) -> CorpusCheck:
    """Check a corpus file; CorpusError with the first fault."""
    scan = CorpusScan(spark, path, check=True)
    found = scan.checked()
    if found.error:
        raise CorpusError(found.error)
    return found


def corpus_faults(rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, n_bad, first_bad) of every row's text under the strict grammar; null texts have no tokens."""
    toks = F.coalesce(tokens(F.col(text)), F.array().cast("array<string>"))
    counted = rows.select(key, toks.alias("t")).select(key, "t", F.filter("t", lambda t: ~is_term(t)).alias("bad"))
    return counted.select(
        key,
        F.size("t").cast("bigint").alias("n_tokens"),
        F.size("bad").cast("bigint").alias("n_bad"),
        F.get("bad", F.lit(0)).alias("first_bad"),
    )


def lines_of_texts(rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, local_document_id, c): every line of a text as a document of its own, cleaned, without those left empty.

    Lines are numbered inside their row, so nothing is shuffled.
    """
    lines = F.filter(F.transform(F.split(text, "\n"), clean_text), lambda c: c != "")
    return rows.select(key, F.posexplode(lines).alias("n", "c")).select(key, F.col("n").cast("bigint").alias("local_document_id"), "c")


@dataclass(frozen=True)
class CleanReport:
    lines_read: int
    lines_written: int


def clean_corpus(spark: SparkSession, source: str, target: str) -> CleanReport:
    """Write the cleaned lines of a text file, without those left empty, in their order, to a new folder of text files.

    ValueError if both paths are the same, FileExistsError if the target exists.
    """
    files = Files(spark)
    if files.qualified(source).lower() == files.qualified(target).lower():
        raise ValueError("source and target must be different")
    lines = read_lines(spark, source)
    seen = lines.agg(F.count(F.lit(1)), F.count_if(clean_text(F.col("value")) != "")).first()
    with files.written_once(target, "output") as temporary:
        kept = lines.select("line_no", clean_text(F.col("value")).alias("value")).where(F.col("value") != "")
        kept.sortWithinPartitions("line_no").select("value").write.text(temporary, lineSep="\n")
    return CleanReport(seen[0], seen[1])
