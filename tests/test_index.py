"""Building, storing and looking up segments."""

import io
import json
import os
import random
import shutil

import pytest

from loomdex import cli
from loomdex.operators.index import (
    dictionary_of,
    dictionary_of_parts,
    invalid_records,
    number_documents,
    ordinals_of_parts,
    sorted_postings,
    term_number,
    unordered_lists,
    with_ordinals,
)
from loomdex.plans.build import build_segment, create_index
from loomdex.plans.snapshot import IndexSnapshot, batch_lookup, lookup_stats
from loomdex.schemas import DICTIONARY, POSTINGS, U32_MAX
from loomdex.sources.files import Files
from loomdex.sources.manifest import (
    Manifest,
    ManifestError,
    SegmentMetadata,
    decode_manifest,
    encode_manifest,
    is_safe_file_name,
    manifest_number,
    segment_number,
)
from loomdex.sources.storage import IndexStorage, StorageError
from pyspark.sql import functions as F
from tests.conftest import rows


@pytest.fixture
def storage(spark, tmp_path):
    return IndexStorage(spark, str(tmp_path / "index"))


def corpus(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def found(snapshot, term):
    return [tuple(r) for r in snapshot.query_term(term).collect()]


def test_build_lookup_refresh_and_restart(spark, storage, tmp_path):
    snapshot = IndexSnapshot(storage)
    assert (snapshot.generation, snapshot.manifest.segment_count, found(snapshot, "rust")) == (None, 0, [])
    stats = build_segment(storage, snapshot, corpus(tmp_path, "a", "rust rust search\nsearch engine\n"))
    assert (stats.input_bytes, stats.document_count, stats.token_count, stats.unique_term_count, stats.posting_count) == (31, 2, 5, 3, 4)
    pinned = IndexSnapshot(storage)
    build_segment(storage, snapshot, corpus(tmp_path, "b", "rust\nx\nrust rust rust Rust\n"))
    assert found(pinned, "rust") == [(1, 0, 2)]
    assert found(snapshot, "rust") == [(1, 0, 2), (2, 0, 1), (2, 2, 3)]
    assert found(snapshot, "Rust") == [(2, 2, 1)]
    again = IndexSnapshot(IndexStorage(spark, storage.folder))
    assert (again.generation, found(again, "rust")) == (2, found(snapshot, "rust"))
    assert again.manifest.total_term_entries == 6
    assert [again.term_at(2, i) for i in range(3)] == ["Rust", "rust", "x"]
    assert [tuple(r) for r in again.postings_at(2, 1).collect()] == [(2, 0, 1), (2, 2, 3)]
    with pytest.raises(IndexError):
        again.term_at(2, 3)
    result = again.lookup("rust").stats
    assert (result.searched_segment_count, result.matching_segment_count, result.matched_document_count, result.encoded_postings_bytes) == (2, 2, 3, 6)
    assert result.term_found and not again.lookup("zebra").stats.term_found
    assert result.to_df(spark).count() == 1 and stats.to_df(spark).count() == 1
    with pytest.raises(ValueError):
        again.lookup("a b")


def test_several_files_number_on(storage, tmp_path):
    metadata, stats = create_index(storage, [corpus(tmp_path, "a", "alpha rust\nbeta rust\n"), corpus(tmp_path, "b", "gamma rust\n")])
    postings, _ = storage.segment_tables(Manifest((metadata,)))
    assert rows(postings.where("term = 'rust'"), "local_document_id", "term_frequency") == [(0, 1), (1, 1), (2, 1)]
    assert stats.token_count == 6


def test_segment_bytes_of_known_indexes(spark, storage):
    two = spark.createDataFrame([(1, "rust", 0, 2), (1, "rust", 3, 1), (1, "search", 1, 1)], POSTINGS)
    # Header 26, two offsets, records 1+4+1+16 and 1+6+1+16, six posting bytes, footer 4.
    assert storage.write_segment(1, two, 4).length_bytes == 26 + 16 + 22 + 24 + 6 + 4
    empty = storage.write_segment(2, two.limit(0), 0)
    assert (empty.length_bytes, empty.term_count) == (30, 0)


def test_failed_builds_leave_a_gap_and_orphans_stay_hidden(spark, storage, tmp_path):
    snapshot = IndexSnapshot(storage)
    with pytest.raises(ValueError):
        build_segment(storage, snapshot, corpus(tmp_path, "bad", "a\n\n"))
    create_index(storage, corpus(tmp_path, "orphan", "hidden\n"))
    assert found(IndexSnapshot(storage), "hidden") == []
    assert IndexStorage(spark, storage.folder).reserve_segment_id() == 3
    build_segment(storage, snapshot, corpus(tmp_path, "good", "a\n"))
    assert found(snapshot, "a") == [(3, 0, 1)]


def test_a_segment_is_written_once_and_no_temporary_stays(spark, storage):
    rows_ = spark.createDataFrame([(1, "a", 0, 1)], POSTINGS)
    storage.write_segment(1, rows_, 1)
    with pytest.raises(FileExistsError, match="segment path already exists"):
        storage.write_segment(1, rows_, 1)
    with pytest.raises(Exception, match="boom"):
        storage.write_segment(2, rows_.withColumn("term", F.raise_error(F.lit("boom"))), 1)
    assert os.listdir(storage.segment_folder) == ["segment-00000000000000000001"]


def test_publishing_onto_a_taken_name_fails(spark, tmp_path):
    files = Files(spark)
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
    with pytest.raises(FileExistsError):
        files.publish(str(tmp_path / "a"), str(tmp_path / "b"))
    assert os.listdir(tmp_path / "b") == []


def test_damaged_segments_are_refused(storage, tmp_path):
    snapshot = IndexSnapshot(storage)
    build_segment(storage, snapshot, corpus(tmp_path, "a", "a b\n"))
    path = f"{storage.segment_path(1)}/segment.json"
    content = json.loads(open(path).read())
    os.remove(f"{storage.segment_path(1)}/.segment.json.crc")
    with open(path, "w") as f:
        json.dump(content | {"term_count": 7}, f)
    with pytest.raises(StorageError):
        IndexSnapshot(storage)
    with pytest.raises(StorageError, match="mismatch"):
        storage.load_segment_metadata(1)
    with pytest.raises(StorageError):
        storage.load_segment_metadata(9)


def replaced(spark, storage, name, change):
    """Put other rows into a table of segment 1, with the sizes of its files written anew."""
    folder = storage.segment_path(1)
    altered = change(spark.read.parquet(f"{folder}/{name}"))
    altered.coalesce(1).write.parquet(f"{folder}/altered")
    shutil.rmtree(f"{folder}/{name}")
    os.rename(f"{folder}/altered", f"{folder}/{name}")


@pytest.mark.parametrize("name", ["postings", "dictionary"])
@pytest.mark.parametrize(
    "change",
    [
        lambda df: df.where("term <> 'e'"),
        lambda df: df.unionByName(df.limit(1)),
        lambda df: df.unionByName(df),
        lambda df: df.withColumn(df.columns[3], F.lit(99).cast("bigint")),
        lambda df: df.limit(0),
    ],
)
def test_altered_tables_are_refused(spark, storage, tmp_path, name, change):
    """Lost, repeated and changed rows of either table, at opening by the files and on loading by the content."""
    snapshot = IndexSnapshot(storage)
    build_segment(storage, snapshot, corpus(tmp_path, "a", "a b c d\nb c e c\n"))
    assert storage.load_segment_metadata(1) == snapshot.manifest.segments[0]
    replaced(spark, storage, name, change)
    with pytest.raises(StorageError, match="files mismatch"):
        IndexSnapshot(storage)
    file = f"{storage.segment_path(1)}/segment.json"
    content = json.loads(open(file).read())
    os.remove(f"{storage.segment_path(1)}/.segment.json.crc")
    with open(file, "w") as f:
        json.dump(content | {"files": storage._sizes(storage.segment_path(1))}, f)
    with pytest.raises(StorageError, match="checksum mismatch"):
        storage.load_segment_metadata(1)


def test_invalid_term_records_are_refused(spark, storage, tmp_path):
    snapshot = IndexSnapshot(storage)
    build_segment(storage, snapshot, corpus(tmp_path, "a", "a b\n"))
    path = storage.segment_path(1)
    for change in ({"term": F.lit("a-b")}, {"term": F.lit("")}, {"document_frequency": F.lit(0)}, {"postings_bytes": F.lit(None)}):
        df = spark.createDataFrame([(1, "a", 0, 1, 2)], DICTIONARY).withColumns(change)
        assert df.where(invalid_records()).count() == 1, change
    replaced(spark, storage, "dictionary", lambda df: df.withColumn("term", F.lit("a b")))
    with pytest.raises(StorageError, match="invalid term record"):
        storage._measure(path, 1, 1)


def test_unordered_lists(spark):
    data = [(1, "a", [(1, 1), (2, 1)]), (1, "b", [(1, 1), (1, 2)]), (2, "c", [(5, 1), (7, 1), (6, 1), (2, 1)]), (2, "d", [(9, 9)]), (2, "e", [])]
    df = spark.createDataFrame(data, "segment_id bigint, term string, postings array<struct<local_document_id:bigint,term_frequency:bigint>>")
    assert rows(unordered_lists(df)) == [(1, "b", 1, 1), (2, "c", 6, 7)]


def test_hot_terms_span_parts_in_order(spark, monkeypatch):
    """A hot term, alone or with others of the same first bytes, is cut by document; parts are in the order of term and document."""
    rnd = random.Random(4)
    data = [(1, t, d, rnd.randrange(1, 300)) for t, n in (("hot", 900), ("hottest1x", 2000), ("hottest1a", 30), ("hottest1z", 30), ("cold", 3)) for d in rnd.sample(range(200_000), n)]
    df = spark.createDataFrame(data, POSTINGS)
    stored = sorted_postings(df).cache()
    assert stored.where("term = 'hottest1x'").select("part").distinct().count() > 2
    found = [tuple(r)[:5] for r in stored.orderBy("part", "term", "local_document_id").collect()]
    assert [r[:4] for r in found] == sorted(data, key=lambda r: (r[1], r[2]))
    dictionary = ordinals_of_parts(dictionary_of_parts(stored))
    wanted = with_ordinals(dictionary_of(df))
    names = ["segment_id", "term", "term_ordinal", "document_frequency", "postings_bytes"]
    assert rows(dictionary, *names) == rows(wanted, *names)


@pytest.mark.parametrize("generation", [None, 7])
def test_names(generation):
    assert manifest_number("manifest-00000000000000000007.json") == 7
    for name in ("manifest-7.json", "manifest-00000000000000000000.json", "manifest-00000000000000000007.json.tmp", "manifest-99999999999999999999.json"):
        assert manifest_number(name) is None
    assert segment_number("segment-00000000000000000001") == 1
    assert segment_number("segment-0000000000000000000١") is None
    assert is_safe_file_name("a.b") and not any(map(is_safe_file_name, ("", ".", "..", "a/b", "a\\b", "../x")))


def segment(i, name=None, documents=10, size=10):
    return SegmentMetadata(i, name or f"segment-{i}", documents, 5, size, 1)


def test_manifest_rules():
    totals = Manifest((segment(1), segment(2, size=20)))
    assert (totals.total_document_count, totals.total_segment_bytes, totals.total_term_entries) == (20, 30, 10)
    assert Manifest().segment_count == 0
    for kind, segments in {
        "SegmentIdsNotStrictlyIncreasing": (segment(2), segment(1)),
        "InvalidSegmentId": (segment(0),),
        "DuplicateFileName": (segment(1, "x"), segment(2, "x")),
        "UnsafeFileName": (segment(1, "../segment.idx"),),
        "TotalSegmentBytesOverflow": (segment(1, size=2**64 - 1), segment(2)),
        "CountOverflow": (segment(1, documents=U32_MAX + 1),),
    }.items():
        with pytest.raises(ManifestError) as e:
            Manifest(segments)
        assert e.value.kind == kind
    with pytest.raises(ManifestError):
        Manifest((segment(1),)).with_segment(segment(1, "y"))


def test_manifest_files(spark, tmp_path):
    files, path = Files(spark), str(tmp_path / "manifest-00000000000000000003.json")
    manifest = Manifest((segment(1), segment(5)))
    encode_manifest(files, path, manifest)
    assert decode_manifest(files, path) == manifest
    with pytest.raises(FileExistsError):
        encode_manifest(files, path, manifest)
    data = open(path, "rb").read()
    other = tmp_path / "manifest-00000000000000000004.json"
    broken = [data[:n] for n in range(0, len(data), 7)] + [data[:30] + b"#" + data[31:], data]
    for content in broken:
        other.write_bytes(content)
        with pytest.raises(ManifestError):
            decode_manifest(files, str(other))
    with pytest.raises(ManifestError):
        encode_manifest(files, str(tmp_path / "manifest.json"), manifest)


def test_a_damaged_latest_manifest_is_an_error(storage, tmp_path):
    snapshot = IndexSnapshot(storage)
    build_segment(storage, snapshot, corpus(tmp_path, "a", "a\n"))
    with open(storage.manifest_path(2), "w") as f:
        f.write("{}")
    with pytest.raises(ManifestError):
        IndexSnapshot(storage)


def test_distances_of_a_hot_term_span_document_ranges(spark):
    wide = spark.range(3000).selectExpr("1L segment_id", "'hot' term", "id * 1000 local_document_id", "200L term_frequency")
    few = spark.createDataFrame([(1, "cold", 5, 1), (1, "cold", 1000000, 1)], POSTINGS)
    sizes = {r["term"]: (r["document_frequency"], r["postings_bytes"]) for r in dictionary_of(wide.unionByName(few)).collect()}
    assert sizes == {"hot": (3000, 1 + 2 + 2999 * 4), "cold": (2, 1 + 1 + 3 + 1)}


def test_numbers_and_ordinals(spark):
    documents = spark.createDataFrame([(5, 1), (3, 1), (9, 2), (4, 1), (1, 2)], "doc_id bigint, segment_id bigint")
    numbered = number_documents(documents)
    assert rows(numbered, "segment_id", "doc_id", "local_document_id") == [(1, 3, 0), (1, 4, 1), (1, 5, 2), (2, 1, 0), (2, 9, 1)]
    words = ["Z", "a", "aaaaaaaa", "aaaaaaab", "b", "0", "zzzzzzzzzz", "zzzzzzzzzzz"]
    ranked = with_ordinals(spark.createDataFrame([(1, w) for w in words], "segment_id bigint, term string"))
    assert [r["term"] for r in ranked.orderBy("term_ordinal").collect()] == sorted(words)
    numbers = [r[0] for r in ranked.orderBy("term").select(term_number(F.col("term"))).collect()]
    assert numbers == sorted(numbers)
    assert number_documents(documents.limit(0)).count() == 0


def test_batches(spark):
    postings = spark.createDataFrame([(1, "a", 0, 1), (2, "a", 0, 2), (1, "b", 3, 1)], POSTINGS)
    terms = spark.createDataFrame([("a",), ("a",), ("none",), (None,)], "term string")
    assert rows(batch_lookup(postings, terms)) == sorted([("a", 1, 0, 1), ("a", 2, 0, 2), ("none", None, None, None)], key=repr)


def py_comparisons(terms, sought):
    low, high, n = 0, len(terms), 0
    while low < high:
        n, middle = n + 1, (low + high) // 2
        if terms[middle] == sought:
            break
        low, high = (middle + 1, high) if terms[middle] < sought else (low, middle)
    return n


@pytest.mark.parametrize("size", [0, 1, 2, 7, 100])
def test_comparisons(spark, size):
    terms = sorted(f"t{i * 3}" for i in range(size))
    dictionary = spark.createDataFrame([(1, t, i, 1, 2) for i, t in enumerate(terms)], DICTIONARY)
    segments = spark.createDataFrame([(1, size), (2, 0)], "segment_id bigint, term_count bigint")
    asked = ["t0", "t1", "t9", "t297", "A", "z"]
    got = {r["term"]: (r["searched"], r["comparisons"], r["matched"]) for r in lookup_stats(dictionary, segments, asked).collect()}
    assert got == {t: (2, py_comparisons(terms, t), int(t in terms)) for t in asked}


def test_commands(spark, tmp_path):
    text = corpus(tmp_path, "a", "rust is fast\nrust\n")
    out, err = io.StringIO(), io.StringIO()
    typed = f"build {text}\nlookup rust\nlookup-stats fast\n\nwhat\nlookup a-b\nbuild {tmp_path}/none\nbuild\n"
    assert cli.main(str(tmp_path / "index"), io.StringIO(typed), out, err) == 0
    said = out.getvalue()
    assert "> built 2 document(s), 3 term(s), 4 posting(s) into " in said
    assert "> 2 matching document(s)\nsegment 1, document 0: frequency 1\nsegment 1, document 1: frequency 1\nlookup statistics:\n" in said
    assert "> 1 matching document(s)\nlookup statistics:\n  manifest generation: 1\n" in said
    assert err.getvalue().count(cli.USAGE) == 2
    assert "failed to query index: query must be one ASCII-alphanumeric word" in err.getvalue()
    assert "failed to read document file metadata" in err.getvalue()
