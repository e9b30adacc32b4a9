"""Frequencies, pairs and top items of postings against plain Python."""

import math
import random
from collections import Counter, defaultdict
from itertools import combinations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomdex.llm import cooccurrence, frequencies
from loomdex.llm.cooccurrence import cooccurring, strong_pairs, term_pairs
from loomdex.llm.frequencies import marked_terms, term_frequencies, useless_terms
from loomdex.llm.topn import top_n, top_postings
from loomdex.operators.postings import counting_rows
from tests.conftest import rows

SCHEMA = "segment_id bigint, term string, local_document_id bigint, document_id bigint, term_frequency bigint, documents int, item int"


def made(n=6000, documents=300, seed=4):
    rnd = random.Random(seed)
    terms = ["the"] * 30 + ["of"] * 8 + [f"w{i}" for i in range(60)] + ["bad-term", "", None, "Zed", "zed", "ä"]
    out = []
    for _ in range(n):
        d = rnd.choice([7] * 40 + [None] + list(range(documents)))
        t = rnd.choice(terms) if rnd.random() < 0.7 else f"w{(d or 0) % 20}"
        out.append((rnd.choice([1, 1, 2, None]), t, 0, d, rnd.choice([1, 1, 2, 9, 0, None]), 1, 1))
    # Pairs of terms that share their documents.
    out += [(1, f"{t}{d % 8}", 0, d, 1, 1, 1) for d in range(documents) for t in ("ping", "pong")]
    return out + out[:500]


def counting(data):
    best = {}
    for s, t, _, d, f, *_ in data:
        if s is not None and d is not None and f and f >= 1 and t and t.isascii() and t.isalnum():
            best[s, t, d] = max(f, best.get((s, t, d), 0))
    return best


@pytest.fixture(scope="module")
def data():
    return made()


def test_frequencies(spark, data):
    occurrences, documents = Counter(), defaultdict(set)
    for (_, t, d), f in counting(data).items():
        occurrences[t] += f
        documents[t].add(d)
    found = term_frequencies(spark.createDataFrame(data, SCHEMA))
    assert rows(found, "term", "occurrences", "documents") == sorted(((t, n, len(documents[t])) for t, n in occurrences.items()), key=repr)
    assert found.select("term_id").distinct().count() == len(occurrences)


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_blocks_of_partitions(monkeypatch, size):
    """Arrays of two partitions, then their sums by block, against plain counts."""
    monkeypatch.setattr(frequencies, "BLOCK", 4)
    rnd = random.Random(2)
    flat = [(rnd.randrange(40), rnd.choice([1, 3, 2**55])) for _ in range(300)]
    arrays = []
    for part in (flat[:200], flat[200:]):
        part = sorted(part, key=lambda r: r[0] // 4)
        batches = [pa.RecordBatch.from_arrays([pa.array([i for i, _ in p]), pa.array([n for _, n in p])], ["id", "n"]) for p in (part[i : i + size] for i in range(0, len(part), size))]
        found = [r for b in frequencies._block_counts(iter(batches)) for r in b.to_pylist()]
        assert [r["block"] for r in found] == sorted({i // 4 for i, _ in part})
        arrays += found
    arrays.sort(key=lambda r: r["block"])
    batches = [pa.RecordBatch.from_pylist(arrays[i : i + size], frequencies._ARROW) for i in range(0, len(arrays), size)]
    found = [r for b in frequencies._block_sums(iter([b.slice(0, 0) for b in batches[:1]] + batches)) for r in b.to_pylist()]
    assert len({r["block"] for r in found}) == len(found)
    got = {r["block"] * 4 + i: (o, d) for r in found for i, (o, d) in enumerate(zip(r["occurrences"], r["documents"], strict=True)) if d}
    assert got == {i: (sum(n for x, n in flat if x == i), sum(x == i for x, _ in flat)) for i, _ in flat}


def test_identifiers_are_global(spark, data):
    """The dictionary numbers the terms in byte order; blocks with many rows are dealt out."""
    rows_of = counting_rows(spark.createDataFrame(data, SCHEMA)).select("term")
    found = frequencies.term_dictionary(rows_of).collect()
    assert [r["term"] for r in sorted(found, key=lambda r: r["term_id"])] == sorted({t for _, t, _ in counting(data)})
    assert sorted(r["term_id"] for r in found) == list(range(len(found))) and all(r["parts"] >= 1 for r in found)


def test_a_dictionary_too_large_to_broadcast(spark, data, monkeypatch):
    df = spark.createDataFrame(data, SCHEMA)
    wanted = rows(term_frequencies(df))
    monkeypatch.setattr(frequencies, "BROADCAST_TERMS", 0)
    assert rows(term_frequencies(df)) == wanted


def stripe_batches(records, low=0, high=1 << 30, size=30):
    for i in range(0, len(records), size):
        some = records[i : i + size]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.list_(pa.int32())), pa.array([low] * len(some)), pa.array([high] * len(some))], ["items", "low", "high"])


@pytest.mark.parametrize("held", [3, 40, 4_000_000])
def test_stripes_of_partitions(monkeypatch, held):
    """Stripes of two partitions, one record's pairs dealt out to both, merged by item and range."""
    monkeypatch.setattr(cooccurrence, "PAIRS_HELD", held)
    monkeypatch.setattr(cooccurrence, "RANGE_BITS", 2)
    rnd = random.Random(3)
    records = [sorted(rnd.sample(range(30), rnd.randrange(12))) for _ in range(100)] + [[]]
    parts = [[*stripe_batches(records[:60]), *stripe_batches([records[1]], 0, 2)], [*stripe_batches(records[60:]), *stripe_batches([records[1]], 2, 9)]]
    stripes = [r for part in parts for b in cooccurrence._stripes(iter(part)) for r in b.to_pylist()]
    assert all({x >> 2 for x in r["neighbours"]} == {r["range"]} for r in stripes)
    stripes.sort(key=lambda r: (r["item"], r["range"]))
    batches = [pa.RecordBatch.from_pylist(stripes[i : i + 7], cooccurrence._ARROW) for i in range(0, len(stripes), 7)]
    merged = [r for b in cooccurrence._merged(iter(batches), 2) for r in b.to_pylist()]
    assert len({(r["item"], r["range"]) for r in merged}) == len(merged)
    found = {(r["item"], other): n for r in merged for other, n in zip(r["neighbours"], r["counts"], strict=True)}
    extra = Counter(p for p in [*combinations(records[1], 2), *((x, x) for x in records[1])] if p[0] in records[1][9:])
    wanted = Counter(p for r in [*records, records[1]] for p in [*combinations(r, 2), *((x, x) for x in r)]) - extra
    assert found == {p: n for p, n in wanted.items() if n >= 2}


def test_long_records_are_dealt_out(spark, data, monkeypatch):
    df = spark.createDataFrame(data, SCHEMA)
    wanted = rows(term_pairs(df))
    monkeypatch.setattr(cooccurrence, "LONG_RECORD", 4)
    monkeypatch.setattr(cooccurrence, "RANGE_BITS", 3)
    assert rows(term_pairs(df)) == wanted


def test_marks(spark, data):
    documents = defaultdict(set)
    for _, t, d in counting(data):
        documents[t].add(d)
    n = len(set.union(*documents.values()))
    wanted = [(t, "rare") for t, d in documents.items() if len(d) < 3] + [(t, "common") for t, d in documents.items() if len(d) * 10 >= n]
    df = spark.createDataFrame(data, SCHEMA)
    assert rows(useless_terms(df)) == sorted(wanted, key=repr)
    assert useless_terms(df.limit(0)).count() == 0
    tiny = spark.createDataFrame([(1, "a", 0, 1, 1, 1, 1)], SCHEMA)
    assert rows(marked_terms(tiny), "term", "mark") == [("a", "common"), ("a", "rare")]


def pair_counts(data):
    terms = defaultdict(set)
    for _, t, d in counting(data):
        terms[d].add(t)
    both, single = Counter(), Counter()
    for some in terms.values():
        single.update(some)
        both.update(combinations(sorted(some), 2))
    return both, single, len(terms)


def g2(c, a, b, n):
    cells = ((c, a * b), (a - c, a * (n - b)), (b - c, (n - a) * b), (n - a - b + c, (n - a) * (n - b)))
    return 2 * sum(o * math.log(o * n / e) for o, e in cells if o)


def test_pairs(spark, data):
    both, single, n = pair_counts(data)
    df = spark.createDataFrame(data, SCHEMA)
    wanted = [
        (a, b, single[a], single[b], c)
        for (a, b), c in both.items()
        if c >= 8 and c * 2000 >= n and c * n > single[a] * single[b] and g2(c, single[a], single[b], n) >= 10.83
    ]
    assert len(wanted) > 5
    assert rows(term_pairs(df), "item_a", "item_b", "records_a", "records_b", "together") == sorted(wanted, key=repr)
    strong = [(a, b) for (a, b), c in both.items() if c >= 8 and c * 2000 >= n and c * n >= 5 * single[a] * single[b]]
    assert rows(strong_pairs(df)) == sorted(strong, key=repr)


def test_pairs_of_other_tables(spark, monkeypatch):
    monkeypatch.setattr(cooccurrence, "BROADCAST_ITEMS", 0)
    baskets = [(b, i) for b in range(40) for i in (("x", "y") if b % 2 else ("z", None))] * 3
    found = cooccurring(spark.createDataFrame(baskets, "basket bigint, item string"), "basket", "item", 40, 5)
    assert rows(found, "item_a", "item_b", "together") == [("x", "y", 20)]
    none = spark.createDataFrame([], "basket bigint, item string")
    assert cooccurring(none, "basket", "item", 0, 5).count() == 0
    empty = spark.createDataFrame([], SCHEMA)
    assert term_pairs(empty).count() == 0 and strong_pairs(empty).count() == 0


def test_the_llr_threshold_takes_no_strong_pair():
    for c in range(8, 60):
        for a in range(c, 6 * c, 3):
            for n in range(5 * a, 60 * a, 7 * a):
                b = c * n // (5 * a)
                if c <= b <= n and 5 * a * b <= c * n and a + b - c <= n:
                    assert g2(c, a, b, n) >= cooccurrence.SIGNIFICANT


@pytest.mark.parametrize(("share", "least"), [(10_000, 1_000), (200, 5), (10, 1)])
def test_top_items(spark, data, share, least):
    rnd = random.Random(6)
    items = [(rnd.choice(["hot"] * 20 + [None, *"abcdef"]), rnd.choice([None, 1.0, 2.0, 2.0, rnd.random()]), i, i) for i in range(3000)]
    groups = defaultdict(list)
    for g, x, i, _ in items:
        groups[g].append((x is None, -(x or 0), i))
    wanted = [(g, p + 1, i) for g, some in groups.items() for p, (_, _, i) in enumerate(sorted(some)[:4])]
    df = spark.createDataFrame([(*t, 1, 2, 3) for t in items], "g string, x double, i bigint, place int, _salt int, _range int, _hot int")
    assert rows(top_n(df, ["g"], "x", ["i"], 4, share=share, least=least), "g", "place", "i") == sorted(wanted, key=repr)
    assert top_n(df.limit(0), ["g"], "x", ["i"], 4).count() == 0


def test_top_postings(spark, data):
    groups = defaultdict(list)
    for (s, t, d), f in counting(data).items():
        groups[s, t].append((-f, d))
    wanted = [(s, t, p + 1, d) for (s, t), some in groups.items() for p, (_, d) in enumerate(sorted(some)[:3])]
    df = spark.createDataFrame(data, SCHEMA)
    assert rows(top_postings(df)) == sorted(wanted, key=repr)
    assert top_postings(df.withColumn("place", F.lit(1)).limit(0)).count() == 0
