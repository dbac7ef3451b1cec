"""Stored quantile states against exact ranks."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from forja.operators import states as s

PROBS = {"p25": 0.25, "p50": 0.5, "p99": 0.99}


def rows(spark, n, seed=3):
    r = random.Random(seed)
    return spark.createDataFrame([(r.choice(["a", "b", None]), i % 30, r.choice([r.gauss(0, 9), float(r.randint(0, 5))])) for i in range(n)],
                                 "k string, d int, v double")


def within(values, got, p, error):
    values = sorted(values)
    below, upto = sum(v < got for v in values), sum(v <= got for v in values)
    return below <= (p + error) * len(values) + 1 and upto >= (p - error) * len(values) - 1


def test_small_groups_are_exact(spark):
    df = rows(spark, 900)
    got = s.state_quantiles(s.merged_states(s.quantile_states(df, ["k", "d"], "v"), ["k"]), PROBS)
    for r in got.collect():
        values = [x["v"] for x in df.collect() if x["k"] == r["k"]]
        assert r["n"] == len(values) <= s.K
        assert all(within(values, r[name], p, 0) and r[name] in values for name, p in PROBS.items())


def test_merged_days_stay_within_the_bound(spark):
    df = spark.range(200_000).select((F.col("id") % 50).alias("d"), F.pow(F.rand(5), 3).alias("v")).cache()
    days = s.quantile_states(df, ["d"], "v", k=200)
    total = s.state_quantiles(s.merged_states(days, []), PROBS).first()
    values = [r["v"] for r in df.select("v").collect()]
    assert total["n"] == 200_000
    assert all(within(values, total[name], p, 2 * s.rank_error(200)) for name, p in PROBS.items())
    assert days.agg(F.max(F.octet_length("estado"))).first()[0] < 3 * 200 * 8 + 200  # a state does not grow with its rows
    df.unpersist()


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([("a", None), ("a", float("nan")), ("b", 1.0)], "k string, v double")
    states = s.quantile_states(df, ["k"], "v")
    assert [(r["k"], r["n"], r["p50"]) for r in s.state_quantiles(states, {"p50": 0.5}).collect()] == [("b", 1, 1.0)]
    assert s.merged_states(states.limit(0), []).count() == 0
