"""Density clustering against the plain algorithm over all distances."""

from __future__ import annotations

import numpy as np
import pytest

from forja.ml import density
from forja.ml.density import density_clusters
from forja.operators.graph import components
from forja.staging import clear_temporary


def plain(points, eps, least):
    keys = sorted(points)
    p = np.array([points[k] for k in keys], dtype=float)
    d2 = np.zeros((len(p), len(p)))
    for i in range(p.shape[1]):
        d2 = d2 + (p[:, None, i] - p[None, :, i]) ** 2
    near = d2 <= eps * eps
    core, label, c = near.sum(1) >= least, [-1] * len(p), 0
    for i in range(len(p)):
        if not core[i] or label[i] != -1:
            continue
        label[i], todo = c, [i]
        while todo:
            at = todo.pop()
            for j in np.flatnonzero(near[at]) if core[at] else ():
                if label[j] == -1:
                    label[j] = c
                    todo.append(j)
        c += 1
    return {k: (x, bool(y)) for k, x, y in zip(keys, label, core, strict=True)}


def table(spark, points):
    d = len(next(iter(points.values())))
    return spark.createDataFrame([(k, *v) for k, v in points.items()], "key string, " + ", ".join(f"c{i} double" for i in range(d))), [f"c{i}" for i in range(d)]


def got(df):
    return {r["key"]: (r["cluster"], r["es_nucleo"]) for r in df.collect()}


@pytest.mark.parametrize(("d", "eps", "least"), [(2, 0.5, 4), (4, 0.7, 3)])
def test_equals_all_distances(spark, d, eps, least):
    rng = np.random.default_rng(d)
    centres = rng.normal(size=(5, d)) * 2
    points = {f"k{i:04d}": [float(x) for x in np.round(centres[rng.integers(5)] + rng.normal(size=d) * rng.choice([0.2, 0.6]), 2 if i % 2 else 6)]
              for i in range(400)}
    points |= {f"k{i:04d}": points["k0003"] for i in range(400, 430)}
    want = plain(points, eps, least)
    assert -1 in {x for x, _ in want.values()} and len({x for x, _ in want.values()}) > 2
    df, cols = table(spark, points)
    assert got(density_clusters(df, "key", cols, eps, least)) == want


def test_distances_of_exactly_eps(spark):
    points = {f"k{i}{j}": [0.5 * i, 0.5 * j] for i in range(5) for j in range(5)} | {"far": [4.0, 0.0], "a": [2.5, 0.0]}
    df, cols = table(spark, points)
    assert got(density_clusters(df, "key", cols, 0.5, 4)) == plain(points, 0.5, 4)


def test_crowded_cells(spark):
    """A cell of 100,000 equal points and two cells of 20,000 different ones, linked across a border: boxes settle them, not pairs."""
    equal = spark.range(100_000).selectExpr("concat('e', id) AS key", "0D AS x", "0D AS y")
    crowd = spark.range(40_000).selectExpr("concat('c', id) AS key", "3D + (id % 199) / 199D * 0.6D AS x", "(id % 211) / 211D * 0.3D AS y")
    lone = spark.createDataFrame([("n1", 0.4, 0.0), ("n2", 9.0, 9.0), ("n3", None, 1.0), ("n4", float("nan"), 1.0)], "key string, x double, y double")
    out = density_clusters(equal.unionAll(crowd).unionAll(lone), "key", ["x", "y"], 0.5, 1000)
    rows = {(r["g"], r["cluster"], r["es_nucleo"]): r["count"] for r in out.selectExpr("left(key, 1) AS g", "cluster", "es_nucleo").groupBy("g", "cluster", "es_nucleo").count().collect()}
    assert rows == {("e", 1, True): 100_000, ("c", 0, True): 40_000, ("n", 1, True): 1, ("n", -1, False): 1}


def test_no_points(spark):
    df, cols = table(spark, {"a": [1.0]})
    assert density_clusters(df.where("false"), "key", cols, 1.0, 2).count() == 0
    assert got(density_clusters(df, "key", cols, 1.0, 2)) == {"a": (-1, False)}
    assert got(density_clusters(df, "key", cols, 1.0, 1)) == {"a": (0, True)}


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3), (140, 139), (300, 200)]
    found = {r["a"]: r["b"] for r in components(spark, spark.createDataFrame(edges, "x long, y long")).collect()}
    assert found == {i: 0 for i in range(1, 51)} | {i: 100 for i in range(101, 141)} | {300: 200}
    clear_temporary(spark)


def test_no_table_of_points_is_built_by_the_driver(spark):
    """Tables with arrays pass for smaller than they are: joins of such tables are sorted, whatever size is guessed."""
    a, b = (spark.range(5).selectExpr("array(id) AS cell", "id AS v").withColumnRenamed("v", v) for v in ("x", "y"))
    joined = density._join(a, b, "cell")
    assert joined.count() == 5 and "SortMergeJoin" in joined._jdf.queryExecution().executedPlan().toString()
    points = spark.createDataFrame([("a", 0.0), ("b", 0.1), ("c", 0.2), ("d", 9.0)], "id string, x double")
    out = density.density_clusters(points, "id", ["x"], 0.5, 2)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("strategy=merge") >= 4
    assert {r["id"]: r["cluster"] for r in out.collect()} == {"a": 0, "b": 0, "c": 0, "d": -1}
