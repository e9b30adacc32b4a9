"""Interactive commands: build, lookup, lookup-stats."""

from __future__ import annotations

import sys
from typing import TextIO

from pyspark.sql import SparkSession

from .plans.build import CreationStats, build_segment
from .plans.snapshot import IndexSnapshot, LookupStats
from .sources.storage import INDEX_FOLDER, IndexStorage

#: Fixed value: the text for a command that isn't known.
USAGE = """usage:
  build <corpus>
  lookup <term>
  lookup-stats <term>"""


def creation_lines(stats: CreationStats, path: str) -> list[str]:
    """What is printed after a build; the labels are fixed values."""
    return [
        f"built {stats.document_count} document(s), {stats.unique_term_count} term(s), {stats.posting_count} posting(s) into {path}",
        "index creation statistics:",
        f"  input bytes: {stats.input_bytes}",
        f"  tokens: {stats.token_count}",
        f"  segment bytes: {stats.segment_bytes}",
        f"  validation: {stats.validation_ms:.3f} ms",
        f"  indexing: {stats.indexing_ms:.3f} ms",
        f"  finalization: {stats.finalization_ms:.3f} ms",
        f"  segment write: {stats.segment_write_ms:.3f} ms",
        f"  total: {stats.total_ms:.3f} ms",
    ]


def lookup_lines(stats: LookupStats) -> list[str]:
    """What is printed after a lookup; the labels are fixed values."""
    generation = "none" if stats.manifest_generation is None else stats.manifest_generation
    return [
        "lookup statistics:",
        f"  manifest generation: {generation}",
        f"  indexed segments: {stats.segment_count}",
        f"  segment bytes: {stats.total_segment_bytes}",
        f"  indexed documents: {stats.total_document_count}",
        f"  term entries: {stats.total_term_entries}",
        f"  segments searched: {stats.searched_segment_count}",
        f"  matching segments: {stats.matching_segment_count}",
        f"  term found: {str(stats.term_found).lower()}",
        f"  dictionary comparisons: {stats.dictionary_comparisons}",
        f"  matched documents: {stats.matched_document_count}",
        f"  postings bytes: {stats.encoded_postings_bytes}",
        f"  dictionary lookup: {stats.dictionary_lookup_ms:.3f} ms",
        f"  postings decode: {stats.postings_decode_ms:.3f} ms",
        f"  total: {stats.total_ms:.3f} ms",
    ]


def run_command(line: str, storage: IndexStorage, snapshot: IndexSnapshot, out: TextIO, err: TextIO) -> None:
    """Run one line; errors are told and end nothing. A blank line does nothing."""
    words = line.split()
    try:
        match words:
            case []:
                return
            case ["build", corpus]:
                stats = build_segment(storage, snapshot, corpus)
                path = storage.segment_path(snapshot.manifest.segments[-1].segment_id)
                print(*creation_lines(stats, path), sep="\n", file=out)
            case ["lookup" | "lookup-stats", term]:
                result = snapshot.lookup(term)
                print(f"{result.stats.matched_document_count} matching document(s)", file=out)
                if words[0] == "lookup":
                    for row in result.postings.toLocalIterator():
                        print(f"segment {row[0]}, document {row[1]}: frequency {row[2]}", file=out)
                print(*lookup_lines(result.stats), sep="\n", file=out)
            case _:
                print(USAGE, file=err)
    except ValueError as e:
        print(f"failed to query index: {e}" if words[0] != "build" else e, file=err)
    except (RuntimeError, OSError) as e:
        print(e, file=err)


def main(folder: str = INDEX_FOLDER, lines: TextIO = sys.stdin, out: TextIO = sys.stdout, err: TextIO = sys.stderr) -> int:
    """Read commands until the input ends; 1 if the index can't be opened."""
    spark = SparkSession.builder.appName("loomdex").getOrCreate()
    try:
        storage = IndexStorage(spark, folder)
        snapshot = IndexSnapshot(storage)
    except Exception as e:
        print(f"failed to open index storage: {e}", file=err)
        return 1
    while True:
        print("> ", end="", file=out, flush=True)
        line = lines.readline()
        if not line:
            return 0
        run_command(line, storage, snapshot, out, err)


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:2]))
