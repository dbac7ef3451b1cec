"""Regression forests grown from cells of equal bins, against plain trees over rows and against Spark's own scoring."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from forja.ml import forest, metrics, trees


def rows(spark, n=2000):
    df = spark.range(n, numPartitions=3).selectExpr("rand(1) * 10 AS a", "cast(rand(2) * 7 as int) AS b", "cast(rand(3) > 0.6 as int) AS c",
                                                    "cast(rand(4) > 0.1 as int) AS d", "1 AS e", "randn(5) AS z")
    return df.selectExpr("a", "b", "c", "d", "e", "a * c + b * b * d + z AS y").localCheckpoint()


def leaves(model):
    node = trees._stored_nodes(model.stages[-1], None).column("nodeData").combine_chunks()
    return node.field("rawCount").to_numpy()[node.field("leftChild").to_numpy() < 0]


def test_leaves_do_not_depend_on_the_number_of_rows(spark):
    """Leaves of six rows are grown whatever the table's size: 1 / 512 of 12,000 rows is four times as much."""
    df = spark.range(12_000).selectExpr("rand(1) AS a", "rand(2) AS b", "rand(3) AS y")
    found = leaves(forest.fit_regressor(df, ["a", "b"], "y", trees=2))
    assert found.min() in (5, 6) and found.max() > 5


def plain_tree(x, y, w, cuts, depth, leaf):
    """Nodes (feature, cut, draws, sum) of one tree over rows, by trying every cut of every feature."""
    out = {}

    def grow(node, at, level):
        out[node] = (-1, 0, w[at].sum(), (w * y)[at].sum())
        best = (1e-9, None)
        for f, of in enumerate(cuts):
            for k, c in enumerate(of):
                left, right = at & (x[:, f] <= c), at & (x[:, f] > c)
                if min(w[left].sum(), w[right].sum()) >= leaf:
                    s, t = (w * y)[left].sum(), (w * y)[right].sum()
                    gain = s * s / w[left].sum() + t * t / w[right].sum() - (s + t) ** 2 / w[at].sum()
                    if gain > best[0] + 1e-9:
                        best = (gain, (f, k, c, left, right))
        if level < depth and best[1]:
            f, k, c, left, right = best[1]
            out[node] = (f, k, *out[node][2:])
            grow(2 * node, left, level + 1)
            grow(2 * node + 1, right, level + 1)

    grow(1, np.ones(len(y), bool), 0)
    return out


@pytest.mark.parametrize("names", [["b", "c", "d", "e"], ["a", "c"], ["a", "b"], ["c", "d"]])
def test_trees_equal_plain_ones(spark, monkeypatch, names):
    x = rows(spark, 400).toPandas()
    y, x = x["y"].to_numpy() - x["y"].mean(), x[names].to_numpy(float)
    cuts = [np.quantile(np.unique(v), [0.2, 0.4, 0.7])[: max(0, len(np.unique(v)) - 1)] for v in x.T]
    at = trees.Layout.of(cuts)
    batch = pa.table({**{f"f{k}": v for k, v in enumerate(x.T)}, "y": y}).to_batches()
    [binned] = trees._binned([f"f{k}" for k in range(len(names))], "y", cuts, at)(iter(batch))
    raw = np.array([np.frombuffer(c, np.uint8) for c in binned.column("cell").to_pylist()])
    order = np.lexsort(raw.T[::-1])
    starts = np.flatnonzero(np.append(True, (raw[order][1:] != raw[order][:-1]).any(axis=1))).astype(np.int32)
    values = [(3, 1, len(starts), raw[order][starts].tobytes(), starts.tobytes(), y[order].tobytes())]
    grown = trees._grown(spark.createDataFrame(values, trees.BLOCK), at, 2, 4, 3, 7)
    assert len(starts) < len(y) or names[0] == "a"
    for t in range(2):
        w = trees._drawn(7, 3, 1, t, len(y)).astype(float)
        plain = plain_tree(x[order], y[order], w, cuts, 4, 3)
        for node, (f, k, n, s) in plain.items():
            got = [grown[c][t, node] for c in ("feature", "cut", "w", "s")]
            assert got[0] == f and got[2] == n and got[3] == pytest.approx(s, abs=1e-9) and (f < 0 or got[1] == k)


def test_draws_are_poisson():
    w = trees._drawn(1, 2, 3, 4, 400_001)
    assert len(w) == 400_001 and abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs((w == 0).mean() - np.exp(-1)) < 0.01
    assert (w == trees._drawn(1, 2, 3, 4, 400_001)).all() and (w != trees._drawn(1, 2, 3, 5, 400_001)).any()


def test_many_two_valued_features_take_groups():
    bits = np.random.default_rng(0).integers(2, size=(500, 13)).astype(np.uint8)
    found = trees._patterns(bits)
    assert [g.shape[1] for _, g in found] == [5, 5, 3]
    assert (np.concatenate([g[of] for of, g in found], axis=1) == 1 - bits).all()
    [(of, lower)] = trees._patterns(np.repeat(bits[:20], 3, axis=0))
    assert len(lower) == 20 and (lower[of] == 1 - np.repeat(bits[:20], 3, axis=0)).all()


def test_cuts(spark):
    """Few values lie in bins of their own; of many, bins hold about equal shares of the rows of all partitions."""
    df = spark.range(64_000, numPartitions=5).selectExpr("cast(id % 32 as double) AS few", "power(id / 64000, 3) AS many", "if(id < 32000, 0D, cast(id as double)) AS heavy", "1D AS one")
    few, many, heavy, one = trees.cut_points(df, ["few", "many", "heavy", "one"])
    assert few.tolist() == [k + 0.5 for k in range(31)] and len(one) == 0
    shares = np.diff([0.0, *np.cbrt(many), 1.0])
    assert len(many) == 31 and shares.min() > 0.7 / 32 and shares.max() < 1.3 / 32
    assert heavy[0] > 0 and np.diff(heavy).min() > 0 and 14 <= len(heavy) <= 31


def test_forest_is_as_good_as_sparks(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    names, df = ["a", "b", "c", "d", "e"], rows(spark, 6000)
    train, test = df.where("a * 1000 % 1 < 0.7"), df.where("a * 1000 % 1 >= 0.7")
    own = forest.fit_regressor(train, names, "y", trees=10)
    sparks = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"),
                              RandomForestRegressor(labelCol="y", predictionCol="pred", numTrees=10, maxDepth=10, minInstancesPerNode=5, featureSubsetStrategy="all", seed=1)]).fit(train)
    a, b = (metrics.regression_metrics(m.transform(test), "y", "pred").first()["rmse"] for m in (own, sparks))
    assert a < 1.03 * b
    p, q = own.stages[-1].featureImportances.toArray(), sparks.stages[-1].featureImportances.toArray()
    assert np.abs(p - q).max() < 0.03


def test_scoring_equals_sparks(spark, monkeypatch):
    names, df = ["a", "b", "c"], rows(spark, 3000)
    model = forest.fit_regressor(df, names, "y", trees=5)
    here = lambda d: d.orderBy("a").select("pred").toPandas()["pred"].tolist()
    sparks = here(model.transform(df))
    assert here(forest.predict_regression(model, df)) == sparks
    monkeypatch.setattr(trees._Scorer, "FRESH", 50)
    monkeypatch.setattr(trees._Scorer, "KEPT", 300)
    score = trees._Scorer(trees._stored_nodes(model.stages[-1], spark), 3)
    x = df.orderBy("a").toPandas()[names].to_numpy(float).T
    got = [v for k in range(0, 3000, 100) for v in score(x[:, k: k + 100])]
    assert got == sparks and list(score(x)) == sparks and len(score.main[0]) <= 300 + 3000


def test_a_forest_needs_numbers_and_rows(spark):
    df = rows(spark, 50)
    with pytest.raises(Exception, match="NULL or NaN"):
        forest.fit_regressor(df.withColumn("a", F.when(F.col("a") > 5, F.col("a"))), ["a"], "y", trees=1)
    with pytest.raises(ValueError, match="at least one row"):
        forest.fit_regressor(df.where("false"), ["a"], "y", trees=1)
    flat = forest.fit_regressor(df, ["e"], "y", trees=2)
    assert [t.numNodes for t in flat.stages[-1].trees] == [1, 1]
    assert forest.predict_regression(flat, df).select("pred").distinct().count() == 1
