"""Text corpora: lines, numbering, grammar and cleaning."""

import pytest
from pyspark.sql import functions as F

from loomdex.functions.text import check_query_term, clean_text, tokens
from loomdex.sources import corpus
from loomdex.sources.corpus import CorpusError, clean_corpus, check_lines, corpus_faults, lines_of_texts, read_lines, validate_corpus
from tests.conftest import rows


def write(tmp_path, name, data):
    path = tmp_path / name
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


def test_lines_end_at_newlines_only(spark, tmp_path):
    path = write(tmp_path, "a", "a\rb c\r\nd\n")
    assert rows(read_lines(spark, path)) == [(0, "a\rb c\r"), (1, "d")]


def test_lines_are_numbered_over_blocks_and_files(spark, tmp_path):
    big = write(tmp_path, "big", "".join(f"line{i}\n" for i in range(20_000)))
    small = write(tmp_path, "small", "first\nsecond\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000b")
    try:
        found = {r["line_no"]: r["value"] for r in read_lines(spark, [small, big, small]).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == dict(enumerate(["first", "second", *(f"line{i}" for i in range(20_000)), "first", "second"]))


def test_many_blocks_are_joined_the_other_way(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus, "BROADCAST_BLOCKS", 0)
    path = write(tmp_path, "a", "".join(f"line{i}\n" for i in range(5_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5k")
    try:
        found = {r["line_no"]: r["value"] for r in read_lines(spark, path).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == {i: f"line{i}" for i in range(5_000)}


def test_pattern_signs_in_names_are_literal(spark, tmp_path):
    path = write(tmp_path, "a[1]{b}.txt", "x\n")
    assert rows(read_lines(spark, path)) == [(0, "x")]


@pytest.mark.parametrize(
    ("data", "error"),
    [
        ("fine\n\nbad-token\n", "document on line 2 is empty"),
        ("fine\n \t \n", "document on line 2 is empty"),
        ("one\ntwo bäd x-y\n", "token 'bäd' on line 2 is not ASCII alphanumeric"),
        ("﻿first\n", "token '﻿first' on line 1 is not ASCII alphanumeric"),
        ("a\x1cb\n", "token 'a\x1cb' on line 1 is not ASCII alphanumeric"),
        ("a​b\n", "token 'a​b' on line 1 is not ASCII alphanumeric"),
        (b"ok\n\xff\xfe\n", "failed to read line 2: stream did not contain valid UTF-8"),
    ],
)
def test_first_fault(spark, tmp_path, data, error):
    with pytest.raises(CorpusError) as e:
        validate_corpus(spark, write(tmp_path, "a", data))
    assert str(e.value) == error


def test_valid_corpora(spark, tmp_path):
    assert validate_corpus(spark, write(tmp_path, "empty", "")).document_count == 0
    found = validate_corpus(spark, write(tmp_path, "a", "rust rust search\nsearch engine x\r\n"))
    assert (found.document_count, found.error) == (2, None)


def test_missing_file(spark, tmp_path):
    with pytest.raises(CorpusError):
        read_lines(spark, str(tmp_path / "none"))


def test_white_space_classes(spark):
    df = spark.createDataFrame([("a\x0bb\x0cc\x85d e f　g\x1ch᠎i",), ("",), (None,)], "v string")
    assert [r[0] for r in df.select(tokens(F.col("v"))).collect()] == [["a", "b", "c", "d", "e", "f", "g\x1ch᠎i"], [], None]


def test_cleaning(spark, tmp_path):
    df = spark.createDataFrame([("--A, béc 1--",), ("...",), (None,)], "v string")
    assert [r[0] for r in df.select(clean_text(F.col("v"))).collect()] == ["A b c 1", "", None]
    source, target = write(tmp_path, "in", "a-b\n...\nc\n"), str(tmp_path / "out")
    report = clean_corpus(spark, source, target)
    assert (report.lines_read, report.lines_written) == (3, 2)
    assert sorted(r[0] for r in spark.read.text(target).collect()) == ["a b", "c"]
    with pytest.raises(FileExistsError):
        clean_corpus(spark, source, target)
    with pytest.raises(ValueError):
        clean_corpus(spark, source, source)


def test_tables_with_nulls_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, 7, 1), (2, "", 7, 1), (None, "a b-c\n\nd", 7, 1)], "doc_id bigint, text string, c int, n_tokens int")
    assert rows(corpus_faults(df)) == sorted([(1, 0, 0, None), (2, 0, 0, None), (None, 3, 1, "b-c")], key=repr)
    assert rows(lines_of_texts(df)) == sorted([(None, 0, "a b c"), (None, 1, "d")], key=repr)
    assert check_lines(spark.createDataFrame([], "line_no bigint, value string")).document_count == 0


@pytest.mark.parametrize("term", ["", "a b", "a-b", "ä", "a\n", None])
def test_query_terms(term):
    with pytest.raises(ValueError, match="one ASCII-alphanumeric word"):
        check_query_term(term)
