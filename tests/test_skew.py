"""Salted aggregation and range slices against plain Python."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loomdex.operators.salted import heavy_keys, salted_counts, salted_partials
from loomdex.operators.slices import running_total, slice_bounds, with_slice
from loomdex.plans.skew import dictionary_conflicts, posting_counts
from tests.conftest import rows

SCHEMA = "k string, v bigint, n_rows int, _salt int"


def skewed(n=4000, seed=1):
    rnd = random.Random(seed)
    keys = ["hot"] * 10 + [None] * 5 + [f"k{i}" for i in range(40)]
    return [(rnd.choice(keys), rnd.choice([None, *range(300)]), 0, 0) for _ in range(n)]


@pytest.mark.parametrize(("share", "least", "per_salt"), [(10_000, 1_000, 1_000), (50, 10, 7), (5, 1, 1)])
def test_salted_counts(spark, share, least, per_salt):
    data = skewed()
    wanted = defaultdict(lambda: [0, set()])
    for k, v, *_ in data:
        wanted[k][0] += 1
        wanted[k][1].add(v)
    found = salted_counts(spark.createDataFrame(data, SCHEMA), ["k"], "v", per_salt=per_salt, share=share, least=least)
    assert rows(found) == sorted([(k, n, len(s - {None})) for k, (n, s) in wanted.items()], key=repr)


def test_heavy_keys_are_few_and_really_heavy(spark):
    df = spark.createDataFrame(skewed(), SCHEMA)
    found = heavy_keys(df, ["k"], share=20, least=10)
    assert {r["k"] for r in found.collect()} == {"hot", None}
    assert found.count() <= 20
    assert heavy_keys(df.limit(0), ["k"]).count() == 0
    assert salted_counts(df.limit(0), ["k"], "v").count() == 0


def test_one_row_repeated_and_one_key_only(spark):
    df = spark.createDataFrame([("hot", 7, 0, 0)] * 5000, SCHEMA)
    assert rows(salted_counts(df, ["k"], "v", per_salt=10)) == [("hot", 5000, 1)]


POSTINGS = "segment_id bigint, term string, local_document_id bigint, document_id bigint, term_frequency bigint, postings int"


def test_posting_counts_and_conflicts(spark):
    data = [
        (1, "a", 0, 1, 1, 0), (1, "a", 0, 1, 9, 0), (1, "a", 0, 2, 1, 0), (2, "a", 0, 1, 1, 0), (1, "A", 0, 1, 1, 0),
        (1, "x-y", 0, 1, 1, 0), (1, "", 0, 1, 1, 0), (1, None, 0, 1, 1, 0), (None, "a", 0, 1, 1, 0), (1, "a", 0, None, 1, 0),
        (1, "b", 0, 1, 0, 0), (1, "b", 0, 1, None, 0), (1, "c\n", 0, 1, 1, 0),
    ]
    postings = spark.createDataFrame(data, POSTINGS)
    assert rows(posting_counts(postings)) == sorted([(1, "a", 2), (2, "a", 1), (1, "A", 1)], key=repr)
    records = [(1, "a", 2), (1, "a", 2), (2, "a", 1), (2, "a", 3), (1, "b", 0), (1, "gone", 4), (1, "c", None), (None, None, 1)]
    dictionary = spark.createDataFrame(records, "segment_id bigint, term string, document_frequency bigint")
    conflicts = sorted([(2, "a"), (1, "gone"), (1, "c"), (None, None), (1, "A")], key=repr)
    assert rows(dictionary_conflicts(postings, dictionary)) == conflicts
    assert dictionary_conflicts(postings.limit(0), dictionary.limit(0)).count() == 0
    assert rows(dictionary_conflicts(postings, dictionary.limit(0))) == rows(posting_counts(postings), "segment_id", "term")


@pytest.mark.parametrize("spread", [(), ("i",)])
def test_slices_keep_the_order(spark, spread):
    rnd = random.Random(2)
    data = [(i, float(rnd.choice([0, 0, 0, 0, 5, rnd.random() * 10]))) for i in range(3000)]
    df = spark.createDataFrame(data, "i bigint, x double")
    bounds = slice_bounds(df, "x", 16)
    assert bounds == sorted(bounds) and len(bounds) == 15
    seen = sorted((r["s"], r["x"]) for r in with_slice(df, F.col("x"), bounds, spread, "s").collect())
    assert [x for _, x in seen] == sorted(x for _, x in seen)
    assert max(sum(s == k for s, _ in seen) for k in range(16)) < (1000 if spread else 3001)
    alone = sorted(set(bounds))
    plain = with_slice(df, F.col("x"), alone, (), "a").collect()
    assert all(r["a"] == sum(b <= r["x"] for b in alone) for r in plain)


def test_nulls_and_nan_have_a_slice(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (1.0,), (7.0,)], "x double")
    assert {repr(r["x"]): r["_slice"] for r in with_slice(df, F.col("x"), [2.0, 5.0]).collect()} == {"None": 0, "nan": 2, "1.0": 0, "7.0": 2}
    assert {r["_slice"] for r in with_slice(df, F.col("x"), []).collect()} == {0}


def test_slices_at_the_width_of_a_large_shuffle(spark):
    """10,000 bounds are all distinct, make even slices and don't outgrow generated code."""
    df = spark.range(200_000).select((F.hash("id") / 7.0).alias("x"), "id")
    bounds = slice_bounds(df, "x", 10_000)
    assert len(set(bounds)) == 9_999
    sliced = with_slice(df, F.col("x"), bounds)
    assert sliced.groupBy("_slice").count().agg(F.max("count")).first()[0] < 80
    generated = sliced._jdf.queryExecution().debug().codegenToSeq().toString()
    assert len(generated) < 60_000
    repeated = with_slice(df, F.round("x", -7), slice_bounds(df.withColumn("x", F.round("x", -7)), "x", 10_000), ["id"])
    assert repeated.groupBy("_slice").count().agg(F.max("count")).first()[0] < 200


def test_stage_one_counts_by_key_and_salt(spark):
    """Repeated rows meet by key, salt and value; what is counted then moves by key and salt, never by key alone."""
    df = spark.createDataFrame(skewed(), SCHEMA)
    plan = salted_partials(df, ["k"], "v")._jdf.queryExecution().executedPlan().toString()
    wide = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "_salt" in line]
    assert ["_value" in line for line in wide] == [False, True]
    salts = salted_partials(df, ["k"], "v", per_salt=50, share=20, least=10).groupBy("k").count().collect()
    assert {r["k"] for r in salts if r["count"] > 1} == {"hot", None}


def test_running_totals(spark):
    rnd = random.Random(3)
    data = [(rnd.choice(["a", "b", None]), i, rnd.choice([None, 1, 5])) for i in range(2000)]
    rnd.shuffle(data)
    df = spark.createDataFrame(data, "g string, i bigint, n bigint")
    sliced = with_slice(df, F.col("i"), slice_bounds(df, "i", 7))
    found = {(r["g"], r["i"]): r["t"] for r in running_total(sliced, ["g"], ["i"], "n", "t", 4).collect()}
    sums, wanted = defaultdict(int), {}
    for g, i, n in sorted(data, key=lambda r: r[1]):
        sums[g] += n or 0
        wanted[g, i] = sums[g]
    assert found == wanted
    assert running_total(sliced.limit(0), ["g"], ["i"], "n", "t", 4).count() == 0
    assert slice_bounds(df.limit(0), "i", 7) == []
