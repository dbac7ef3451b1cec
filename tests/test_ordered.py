"""Bucketed operators against plain windows, with one hot key."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from forja.operators import ordered as o


def skewed(spark, n=3000, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if r.random() < 0.5 else r.choice(["a", "b", None])
        v = None if r.random() < 0.05 else r.choice([r.gauss(0, 50), float(r.randint(-3, 3)), r.random()])
        rows.append((key, i, r.randint(0, 40), v))
    return spark.createDataFrame(rows, "k string, i int, d int, v double")


def test_running_totals_match_window(spark):
    df = skewed(spark)
    got = o.running_totals(df, ["k"], F.col("d"), [F.col("i").asc()], {"s": F.col("i"), "n": F.lit(1)})
    w = W.partitionBy("k").orderBy("d", "i").rowsBetween(W.unboundedPreceding, 0)
    want = df.withColumns({"s": F.sum("i").over(w), "n": F.count("*").over(w)})
    cols = ["k", "i", "s", "n"]
    assert sorted(map(str, got.select(*cols).collect())) == sorted(map(str, want.select(*cols).collect()))


def test_running_totals_without_keys(spark):
    df = skewed(spark, 300)
    got = o.row_numbers(df, [], F.col("d"), [F.col("i").asc()])
    want = [r["i"] for r in df.orderBy("d", "i").collect()]
    assert [r["i"] for r in got.orderBy("rn").collect()] == want


def test_neighbor_matches_lag_and_lead(spark):
    df = skewed(spark)
    for after, fn in ((False, F.lag), (True, F.lead)):
        got = o.neighbor(df, ["k"], F.floor(F.col("i") / 100), [F.col("i")], ["i"], "n", after).select("k", "i", "n.i")
        want = df.select("k", "i", fn("i", 1).over(W.partitionBy("k").orderBy("i")).alias("n"))
        assert sorted(map(tuple, got.na.fill("~", ["k"]).na.fill(-1).collect())) == sorted(map(tuple, want.na.fill("~", ["k"]).na.fill(-1).collect()))


def test_exact_quantiles_match_numpy(spark):
    df = skewed(spark)
    probs = {"p0": 0.0, "p10": 0.1, "p25": 0.25, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = {r["k"]: r for r in o.quantiles(df, ["k"], "v", probs).collect()}
    data = df.collect()
    for key in {r["k"] for r in data}:
        values = [r["v"] for r in data if r["k"] == key and r["v"] is not None]
        for name, p in probs.items():
            assert np.isclose(got[key][name], np.quantile(values, p), rtol=1e-12, atol=1e-12), (key, name)


def test_quantiles_of_weighted_rows_and_of_one_band(spark):
    rows = [("k", 45.0 + i * 1e-7, i % 3 + 1) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, v double, n int")
    assert df.select(o.value_bucket(F.col("v"))).distinct().count() == 1
    got = o.quantiles(df, ["k"], "v", {"a": 0.25, "b": 0.5, "c": 0.999}, weight="n").first()
    want = np.quantile(np.repeat([v for _, v, _ in rows], [n for *_, n in rows]), [0.25, 0.5, 0.999])
    assert np.allclose([got["a"], got["b"], got["c"]], want, rtol=1e-14)


def test_join_spread_deals_a_hot_and_a_null_key(spark):
    df = spark.range(20000).select(F.when(F.col("id") % 10 == 0, F.lit(None)).otherwise("hot").alias("k"), "id")
    dim = spark.createDataFrame([("hot", 1), (None, 2), ("other", 3)], "k string, w int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = o.join_spread(df, dim, ["k"], 16)
        assert {(r["k"], r["w"]): r["n"] for r in got.groupBy("k", "w").agg(F.count("*").alias("n")).collect()} == {("hot", 1): 18000, (None, 2): 2000}
        sizes = [r["n"] for r in got.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
        assert len(sizes) > 1 and max(sizes) < 0.6 * 20000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_value_bucket_follows_the_order(spark):
    r = random.Random(3)
    values = sorted([r.gauss(0, 1) * 10 ** r.randint(-6, 9) for _ in range(2000)] + [0.0])
    df = spark.createDataFrame([(v,) for v in values], "v double")
    b = [r["b"] for r in df.select("v", o.value_bucket(F.col("v")).alias("b")).orderBy("v").collect()]
    assert b == sorted(b)


def written(spark, df):
    """Rows that each exchange of the plan writes, after it has run."""
    df.collect()
    found, plans = [], [df._jdf.queryExecution().executedPlan()]
    while plans:
        plan = plans.pop()
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            plans.append(plan.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            plans.append(plan.plan())
        if name == "ShuffleExchangeExec":
            found.append(plan.metrics().apply("shuffleRecordsWritten").value())
        plans += [plan.children().apply(i) for i in range(plan.children().size())]
    return found


def test_hot_keys_give_the_same_as_light_ones(spark, monkeypatch):
    df = skewed(spark)
    probs = {"p25": 0.25, "p50": 0.5}

    def all_of():
        return [sorted(map(str, rows.select(*cols).collect())) for rows, cols in (
            (o.running_totals(df, ["k"], F.col("d"), [F.col("i").asc()], {"s": F.col("i")}), ["k", "i", "s"]),
            (o.neighbor(df, ["k"], F.floor(F.col("i") / 100), [F.col("i")], ["i"], "n"), ["k", "i", "n"]),
            (o.quantiles(df, ["k"], "v", probs).select("k", *[F.round(p, 9).alias(p) for p in probs]), ["k", *probs]))]

    light = all_of()
    for most in (0, 1000):  # all keys hot; only the largest
        monkeypatch.setattr(o, "PART_ROWS", most)
        assert all_of() == light


def test_split_hot_keeps_every_row_once(spark, monkeypatch):
    monkeypatch.setattr(o, "PART_ROWS", 1000)
    df = skewed(spark)
    light, hot = o.split_hot(df, ["k"])
    assert {r["k"] for r in hot.select("k").distinct().collect()} == {"hot"}
    assert sorted(r["i"] for r in light.unionByName(hot).collect()) == list(range(3000))


def test_light_keys_are_shuffled_once(spark):
    df = skewed(spark)
    for got in (o.row_numbers(df, ["k"], F.col("d"), [F.col("i").asc()]),
                o.neighbor(df, ["k"], F.col("d"), [F.col("i")], ["i"], "n")):
        assert sum(n >= 3000 for n in written(spark, got)) == 1
    assert sum(written(spark, o.quantiles(df, ["k"], "v", {"p50": 0.5}))) < 3000
