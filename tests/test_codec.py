"""Variable-length integers and posting bytes."""

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomdex.functions.codec import (
    CodecError,
    check_postings,
    decode_postings,
    decode_varint,
    decoded_postings,
    encoded_postings,
    varint,
    varint_hex,
    varint_length,
    varint_value,
)
from loomdex.schemas import POSTINGS, U32_MAX
from tests.conftest import rows

GOLDEN = {
    0: "00", 1: "01", 127: "7F", 128: "8001", 300: "AC02", 16383: "FF7F", 16384: "808001",
    2097151: "FFFF7F", 2097152: "80808001", 268435455: "FFFFFF7F", 268435456: "8080808001", U32_MAX: "FFFFFFFF0F",
}


def py_varint(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes([*out, value])


def test_golden_numbers(spark):
    df = spark.createDataFrame([(v,) for v in GOLDEN], "v bigint")
    found = df.select("v", varint_hex(F.col("v")), varint_length(F.col("v")), varint_value(varint(F.col("v")))).collect()
    for v, digits, length, again in found:
        assert (digits, length, again) == (GOLDEN[v], len(GOLDEN[v]) // 2, v)
        assert decode_varint(bytes.fromhex(digits)) == (v, length)


def test_null_stays_null(spark):
    assert spark.createDataFrame([(None,)], "v bigint").select(varint_length(F.col("v"))).first()[0] is None


@pytest.mark.parametrize(
    ("digits", "kind"),
    [
        ("", "Truncated"), ("80", "Truncated"), ("FFFFFFFF", "Truncated"), ("FFFFFFFF10", "Overflow"),
        ("808080808000", "Overflow"), ("8000", "NonCanonical"), ("8100", "NonCanonical"),
    ],
)
def test_broken_numbers(digits, kind):
    with pytest.raises(CodecError) as e:
        decode_varint(bytes.fromhex(digits))
    assert e.value.kind == kind


@given(st.integers(0, U32_MAX), st.binary(max_size=3))
def test_number_round_trip(value, rest):
    data = py_varint(value)
    assert decode_varint(data + rest) == (value, len(data))


@given(st.lists(st.tuples(st.integers(0, U32_MAX), st.integers(1, U32_MAX)), unique_by=lambda p: p[0]))
def test_posting_round_trip_and_every_prefix(pairs):
    pairs = sorted(pairs)
    check_postings(pairs)
    data, before = b"", 0
    for document, frequency in pairs:
        data += py_varint(document - before) + py_varint(frequency)
        before = document
    assert list(decode_postings(data, len(pairs))) == pairs
    for n in range(len(data)):
        with pytest.raises(CodecError):
            list(decode_postings(data[:n], len(pairs)))


@pytest.mark.parametrize(
    ("digits", "count", "kind"),
    [
        ("80", 1, "InvalidDocumentDelta(Truncated)"), ("0080", 1, "InvalidTermFrequency(Truncated)"), ("01010001", 2, "ZeroDelta"),
        ("FFFFFFFF0F010101", 2, "DocumentIdOverflow"), ("0000", 1, "ZeroFrequency"), ("000100", 1, "TrailingBytes"),
        ("0001", 2, "InvalidDocumentDelta(Truncated)"), ("00", 0, "TrailingBytes"),
    ],
)
def test_broken_postings(digits, count, kind):
    with pytest.raises(CodecError) as e:
        list(decode_postings(bytes.fromhex(digits), count))
    assert e.value.kind == kind


def test_postings_that_cannot_be_encoded():
    for pairs, kind in (([(1, 1), (1, 1)], "DocumentIdsNotStrictlyIncreasing"), ([(1, 0)], "ZeroFrequency")):
        with pytest.raises(CodecError) as e:
            check_postings(pairs)
        assert e.value.kind == kind


def test_columns_round_trip(spark):
    pairs = [(1, "a", 0, 1), (1, "a", 127, 2), (1, "a", 255, 3), (2, "a", U32_MAX, U32_MAX), (2, "b", 5, 1)]
    encoded = encoded_postings(spark.createDataFrame(pairs, POSTINGS))
    assert encoded.where("segment_id = 1").first()["encoded"].hex() == "00017f02800103"
    decoded = decoded_postings(encoded)
    assert rows(decoded, *POSTINGS.names) == sorted(pairs, key=repr)
    assert decoded.where("error is not null").count() == 0


def test_faults_come_as_rows(spark):
    broken = spark.createDataFrame([(1, "a", 2, bytearray(b"\x00\x01"))], "segment_id bigint, term string, document_frequency bigint, encoded binary")
    assert [r["error"] for r in decoded_postings(broken).orderBy("error").collect()] == [None, "InvalidDocumentDelta(Truncated)"]
