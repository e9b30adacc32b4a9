"""Percentiles against plain Python."""

import datetime as dt
import math
import random
from collections import defaultdict

import pytest

from loomdex.llm import percentiles as P
from loomdex.llm.percentiles import Rank, distinct_samples, merge_counts, percentiles, summary_percentiles, unfit_figures, value_counts
from tests.conftest import rows

RANKS = [Rank("p0", "0"), Rank("p50", "1/2"), Rank("p95", "19/20"), Rank("p100", "1"), Rank("over", "24/25", beyond=True)]


def reached(values, share, beyond=False):
    values, n = sorted(values), len(values)
    at = math.floor(share * n + 1e-9) + 1 if beyond else max(1, math.ceil(share * n - 1e-9))
    return values[at - 1]


@pytest.mark.parametrize("slices", [1, 3, 40])
def test_percentiles_of_groups(spark, slices):
    rnd = random.Random(5)
    data = [(rnd.choice(["hot"] * 9 + ["b", None]), rnd.choice([0.001] * 5 + [rnd.lognormvariate(0, 2), None, float("nan"), -1.0]), 1, "x") for _ in range(4000)]
    groups = defaultdict(list)
    for g, x, *_ in data:
        if x is not None and x >= 0:
            groups[g].append(x)
    wanted = [(g, len(v), *(reached(v, float(r.share), r.beyond) for r in RANKS)) for g, v in groups.items()]
    state = value_counts(spark.createDataFrame(data, "g string, x double, n int, size string"), ["g"], "x")
    assert rows(percentiles(state, ["g"], RANKS, slices)) == sorted(((w[0], w[1], *(round(x, 6) for x in w[2:])) for w in wanted), key=repr)


def test_states_combine(spark):
    rnd = random.Random(6)
    data = [(d, rnd.random()) for d in range(5) for _ in range(200)]
    df = spark.createDataFrame(data, "day int, x double")
    days = value_counts(df, ["day"], "x").selectExpr("'all' g", "value", "n")
    whole = merge_counts(days, ["g"])
    assert rows(percentiles(days, ["g"], RANKS)) == rows(percentiles(whole, ["g"], RANKS))
    assert percentiles(days.limit(0), ["g"], RANKS).count() == 0


SAMPLES = "sample_id bigint, recorded_on string, term string, segment_access string, segment_open_ms double, total_ms double, arrived_at timestamp_ntz"
FIGURES = ["segment_open_median_ms", "segment_open_p95_ms", "total_median_ms", "total_p95_ms"]
SUMMARIES = "summary_id bigint, period_start string, period_days int, term string, segment_access string, " + ", ".join(f"{f} double" for f in FIGURES)


def day(n):
    return (dt.date(2020, 1, 1) + dt.timedelta(n)).isoformat()


def made():
    rnd = random.Random(7)
    samples = []
    for i in range(3000):
        access = rnd.choice(["opened", "reused"])
        opened = None if access == "reused" else rnd.choice([None, float("nan"), -3.0, round(rnd.lognormvariate(3, 1), 3)])
        at = dt.datetime(2020, 1, 20) + dt.timedelta(seconds=i)
        row = (i, day(rnd.randrange(10)), rnd.choice(["the"] * 5 + ["a", None]), access, opened, rnd.choice([0.001, 0.001, round(rnd.random(), 2)]), at)
        samples.append(row)
        if i % 50 == 0:
            samples += [row, (*row[:5], 99.0, at + dt.timedelta(days=1)), (*row[:5], 98.0, None)]
    samples += [(None, day(0), "the", "reused", None, 0.5, None)] * 2 + [(9999, "no date", "the", "reused", None, 0.5, None)]
    return samples


def python_groups(samples, summaries):
    first = {}
    for k, s in enumerate(samples):
        key = (s[0] if s[0] is not None else ("row", k))
        at = s[6] or dt.datetime.max
        if key not in first or at < first[key][0]:
            first[key] = (at, s)
    out = defaultdict(list)
    for start, days, term, access in summaries:
        if None in (start, days, term, access):
            continue
        covered = {(dt.date.fromisoformat(start) + dt.timedelta(n)).isoformat() for n in range(days)}
        for _, s in first.values():
            if s[1] in covered and s[3] == access and (term == "*" or s[2] == term):
                for metric, x in (("segment_open", s[4]), ("total", s[5])):
                    if x is not None and x >= 0:
                        out[start, days, term, access, metric].append(x)
    return out


def test_summaries(spark):
    samples = made()
    periods = [(day(a), n, t, s) for a, n in ((0, 1), (3, 1), (0, 7), (0, 10), (8, 400), (50, 3), (2, 0)) for t in ("the", "a", "*", "none") for s in ("opened", "reused")]
    groups = python_groups(samples, periods)
    rnd = random.Random(8)
    summaries, wanted = [], set()
    for i, p in enumerate(periods):
        figures = []
        for metric in ("segment_open", "total"):
            for stat, q in (("median", 0.5), ("p95", 0.95)):
                values = groups.get((*p, metric))
                v = reached(values, q) if values else 1.0
                v = rnd.choice([v, v, None, v * 1.4, v * 0.7, float("nan"), reached(values, min(q + 0.01, 1)) if values else 2.0])
                figures.append(v)
                if values and v is not None and v == v:
                    n = len(values)
                    if sum(x <= v for x in values) * 100 < n * round(q * 100 - 1) or sum(x < v for x in values) * 100 > n * round(q * 100 + 1):
                        wanted.add((i, metric, stat))
        summaries.append((i, *p, *figures))
    summaries += [summaries[3], (900, None, 1, "the", "reused", *[1.0] * 4), (901, day(0), None, "the", "reused", *[1.0] * 4), (902, day(0), 1, None, None, *[1.0] * 4)]
    left, right = spark.createDataFrame(samples, SAMPLES), spark.createDataFrame(summaries, SUMMARIES)
    found = {tuple(r[:5]): (r["size"], r["median"], r["p95"]) for r in summary_percentiles(left, right).select("period_start", "period_days", "term", "segment_access", "metric", "size", "median", "p95").collect()}
    assert found == {k: (len(v), reached(v, 0.5), reached(v, 0.95)) for k, v in groups.items()}
    assert len(wanted) > 10
    assert rows(unfit_figures(left, right)) == sorted(wanted, key=repr)
    assert unfit_figures(left.limit(0), right).count() == 0
    assert unfit_figures(left, right.limit(0)).count() == 0


def test_large_day_tables_are_joined_the_other_way(spark, monkeypatch):
    left, right = spark.createDataFrame(made(), SAMPLES), spark.createDataFrame([(1, day(0), 9, "*", "reused", *[7.0] * 4)], SUMMARIES)
    before = rows(unfit_figures(left, right))
    monkeypatch.setattr(P, "BROADCAST_DAYS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert rows(unfit_figures(left, right)) == before == [(1, "total", "median"), (1, "total", "p95")]
        many = spark.createDataFrame([(i, day(i % 9), 1 + i % 3, t, a, *[7.0] * 4) for i, (t, a) in enumerate((t, a) for t in ("*", "the", "a") for a in ("opened", "reused"))], SUMMARIES)
        groups = python_groups(made(), [tuple(r[1:5]) for r in many.collect()])
        found = {tuple(r[:5]): (r["size"], r["median"]) for r in summary_percentiles(left, many).select("period_start", "period_days", "term", "segment_access", "metric", "size", "median").collect()}
        assert found == {k: (len(v), reached(v, 0.5)) for k, v in groups.items()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_many_days_are_not_broadcast(spark, monkeypatch):
    """Spark takes the days of long periods for as large as the file of the periods; its default threshold must not broadcast them."""
    monkeypatch.setattr(P, "BROADCAST_DAYS", 1_000)
    samples = [(i, day(i % 600), "the", "reused", None, 0.5, None) for i in range(1200)]
    periods = [(i, day(0), 500 + i, t, "reused", *[7.0] * 4) for i, t in enumerate(["the"] * 3 + ["*"] * 3)]
    found = unfit_figures(spark.createDataFrame(samples, SAMPLES), spark.createDataFrame(periods, SUMMARIES))
    assert rows(found) == [(i, "total", stat) for i in range(6) for stat in ("median", "p95")]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_first_arrival_counts(spark):
    t = dt.datetime(2020, 1, 1)
    data = [(1, day(0), "a", "x", 1.0, 1.0, None), (1, day(0), "a", "x", 2.0, 2.0, t), (1, day(0), "a", "x", 3.0, 3.0, t + dt.timedelta(1))]
    assert rows(distinct_samples(spark.createDataFrame(data, SAMPLES)), "total_ms") == [(2.0,)]
