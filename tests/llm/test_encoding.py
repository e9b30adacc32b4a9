"""The transducer against a public library, decoding, and mixing against plain Python."""

import itertools
import random
from collections import defaultdict

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from loomdex.llm import bpe, encoding
from loomdex.llm.encoding import BYTE_BPE, count_tokens, decode_ids, encode_texts
from loomdex.llm.mixing import _targets, budgets, mix, mix_report, mixed_documents, short_sources
from tests.conftest import SF_DIR, rows

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(bpe.tokenizer_path(BYTE_BPE))
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def odd_texts():
    rnd = random.Random(9)
    some = ["".join(rnd.choice("aeinrst ") for _ in range(200)) for _ in range(50)]
    some += ["".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(0x80, 0x3000), rnd.randrange(0x1F000, 0x1FFFF)])) for _ in range(60)) for _ in range(100)]
    return some + ["", " ", "\n\n  x", "a" * 5000, "the" * 4000, "é" * 999, "<|endoftext|>a<|endoftext|>", "I'LL don't 'S", "\x00﻿​", "12345678901234567890", "👩‍💻✅"]


def test_same_as_the_library(spark, library):
    texts = odd_texts() + [r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect() if r["text"] is not None]
    e = bpe.encoder(BYTE_BPE)
    found = [e.encode(t) for t in texts]
    assert found == library(texts)
    assert [e.count(t) for t in texts] == [len(f) for f in found]
    assert [bpe.decode(BYTE_BPE, f) for f in found] == texts


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_any_text(text):
    ids = bpe.encoder(BYTE_BPE).encode(text.encode("utf-8", "ignore").decode())
    assert bpe.decode(BYTE_BPE, ids) == text.encode("utf-8", "ignore").decode()


def test_full_tables_start_over(monkeypatch, library):
    monkeypatch.setattr(bpe, "STATES_KEPT", 50)
    monkeypatch.setattr(bpe, "PIECES_KEPT", 10)
    e = bpe.Encoder(BYTE_BPE)
    assert [e.encode(t) for t in odd_texts()] == library(odd_texts())
    assert len(e) <= 10


@given(st.binary(max_size=40))
def test_utf8_machine(data):
    machine = bpe.Utf8Machine()
    assert "".join([*(machine.feed(data[i : i + 1]) for i in range(len(data))), machine.end()]) == data.decode("utf-8", "replace")


def test_batches_are_cut_by_ids(library, monkeypatch):
    monkeypatch.setattr(encoding, "IDS_HELD", 100)
    texts = [None, "", *odd_texts(), ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    out = list(encoding._encode(iter([batch, batch.slice(0, 0)]), BYTE_BPE))
    assert len(out) > 3
    assert [r["doc_id"] for b in out for r in b.to_pylist()] == list(range(len(texts)))
    assert [r["ids"] for b in out for r in b.to_pylist()] == library([t or "" for t in texts])


def test_rows(spark, library):
    texts = [None, "", "a b", "x" * 3000, *odd_texts()]
    data = [(i if i else None, t, 5) for i, t in enumerate(texts)] + [(7, "again", 5), (7, "again", 5)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, ids int").repartition(3)
    wanted = sorted(((i, tuple(library([t or ""])[0])) for i, t, _ in data), key=repr)
    assert rows(encode_texts(df)) == wanted
    assert encode_texts(df).dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    assert rows(decode_ids(encode_texts(df))) == sorted(((i, t or "") for i, t, _ in data), key=repr)
    assert rows(count_tokens(df.select("doc_id", "text", F.lit("x").alias("tokens")))) == sorted(((i, len(ids)) for i, ids in wanted), key=repr)
    assert encode_texts(df.limit(0)).count() == 0


def test_only_the_needed_columns_are_read(spark):
    plan = encode_texts(spark.read.parquet(f"{SF_DIR}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan and "Exchange" not in plan


TARGETS = "mix_name string, source string, target_share double, max_repeats int"
GOALS = [("m", "a", 0.5, 2), ("m", "b", 0.3, 50), ("m", "c", 0.2, 1), ("m", "zero", 0.0, 1), ("n", "a", 0.9, 1), ("n", "gone", 0.1, 9), ("n", "gone", 0.1, 9), (None, "a", 1.0, 1)]


def documents(spark, n=600):
    rnd = random.Random(10)
    names = ["a"] * 60 + [" A", "a\t"] + ["b"] * 3 + ["C ", "c", "zero", "other", None]
    data = [(i, rnd.choice(names), rnd.choice([None, "", "one two", "a longer text of some words " * rnd.randrange(1, 9)]), 1) for i in range(n)]
    return data + [(3, "a", "repeated row", 1)] * 3, spark.createDataFrame(data + [(3, "a", "repeated row", 1)] * 3, "doc_id bigint, source string, text string, tokens int")


def test_mixes(spark, library):
    data, df = documents(spark)
    sizes, copies = defaultdict(int), defaultdict(int)
    for i, s, t, _ in data:
        if s is not None and t is not None:
            sizes[s.strip().lower()] += len(library([t])[0])
            copies[s.strip().lower(), i] += 1
    goals = spark.createDataFrame(GOALS, TARGETS)
    report = {(r["mix_name"], r["source"]): r for r in mix_report(df, goals).collect()}
    assert set(report) == {g[:2] for g in GOALS if g[0]}
    for mix in ("m", "n"):
        own = {g[1]: g for g in GOALS if g[0] == mix}
        budget = sum(sizes[s] for s, g in own.items() if g[2] > 0)
        for s, (_, _, share, most) in own.items():
            r = report[mix, s]
            assert (r["size"], r["budget"], r["short"]) == (sizes[s], budget, share * budget > most * sizes[s])
            assert r["most_uses"] <= most and r["tokens"] <= most * sizes[s]
        total = sum(report[mix, s]["tokens"] for s in own)
        assert total <= budget and (total > budget - 300 or all(report[mix, s]["tokens"] == g[3] * sizes[s] for s, g in own.items() if g[2] > 0))
        # Where no source is short each has its share, but for the last document.
        if not any(report[mix, s]["short"] for s in own):
            assert all(abs(report[mix, s]["tokens"] - own[s][2] * budget) < 100 for s in own)
    wanted = [k for k, r in report.items() if r["short"]]
    assert wanted and rows(short_sources(df, goals)) == sorted(wanted, key=repr)
    used = mixed_documents(df, goals).collect()
    uses = defaultdict(int)
    for r in used:
        uses[r["mix_name"], r["source"], r["doc_id"]] += 1
    most = {g[:2]: g[3] for g in GOALS}
    assert all(n <= most[m, s] * copies[s, i] for (m, s, i), n in uses.items())
    assert sum(r["tokens"] for r in used if r["mix_name"] == "m") == sum(report["m", s]["tokens"] for s in ("a", "b", "c"))
    # The order is that of virtual time, and it is the same every time.
    again = rows(mixed_documents(df.repartition(5), goals), "mix_name", "source", "doc_id", "repeat")
    assert again == sorted(((r["mix_name"], r["source"], r["doc_id"], r["repeat"]) for r in used), key=repr)


def test_all_targets_are_met_without_a_short_source(spark):
    _, df = documents(spark, 2000)
    goals = spark.createDataFrame([("x", "a", 0.6, 5), ("x", "b", 0.4, 60)], TARGETS)
    report = {r["source"]: r for r in mix_report(df, goals).collect()}
    assert not any(r["short"] for r in report.values())
    for r in report.values():
        assert abs(r["share"] - r["target_share"]) < 0.02


def test_documents_fit_beside_a_long_unfinished_one(spark):
    """A mix is the longest ordered prefix within the budget, however long its documents are."""
    rnd = random.Random(4)
    queues = {"a": [100] * 2_000, "b": [100] * 500 + [150_000]}
    queues |= {f"s{i}": [rnd.choice([0, 1, 5, rnd.randrange(1, 3_000)]) for _ in range(rnd.randrange(1, 30))] for i in range(12)}
    goals = [("m", "a", 0.3, 3), ("m", "b", 0.7, 3)]
    for k in range(20):
        names, shares = rnd.sample([f"s{i}" for i in range(12)], 3), [rnd.random() for _ in range(3)]
        goals += [(f"m{k}", n, w / sum(shares), rnd.randrange(1, 9)) for n, w in zip(names, shares, strict=True)]
    data = [(s, i, i, t, sum(q[: i + 1])) for s, q in queues.items() for i, t in enumerate(q)]
    df = spark.createDataFrame(data, "_source string, doc_id bigint, copy bigint, tokens bigint, upto bigint")
    targets = _targets(spark.createDataFrame(goals, TARGETS))
    wanted = []
    for m in {g[0] for g in goals}:
        own = [g for g in goals if g[0] == m]
        size = {s: sum(queues[s]) for _, s, _, _ in own}
        every = sorted(
            ((r * size[s] + upto) / share, s, r, i, t) for _, s, share, most in own for r in range(most) for name, i, _, t, upto in data if name == s
        )
        totals = itertools.accumulate(row[4] for row in every)
        wanted += [(m, s, i, r) for (_, s, r, i, _), total in zip(every, totals, strict=True) if total <= sum(size.values())]
    found = mix(df, budgets(df, targets)).cache()
    assert rows(found, "mix_name", "source", "doc_id", "repeat") == sorted(wanted, key=repr)
    assert found.where("mix_name = 'm'").agg(F.sum("tokens")).first()[0] == 400_000


def test_empty_tables(spark):
    _, df = documents(spark)
    goals = spark.createDataFrame(GOALS, TARGETS)
    assert mix_report(df, goals.limit(0)).count() == 0
    assert mixed_documents(df.limit(0), goals).count() == 0
    assert short_sources(df.limit(0), goals).count() == 0
