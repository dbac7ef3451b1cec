"""Micro clusters: Euclidean silhouette and the hierarchy from below, against plain versions over all points."""

from __future__ import annotations

import numpy as np
import pytest

from forja.ml import micro


def cloud(n, seed=3, d=2):
    rng = np.random.default_rng(seed)
    centre = np.array([[0.0] * d, [4.0] * d, [9.0] + [0.0] * (d - 1)])
    label = rng.integers(3, size=n)
    return label, np.round(centre[label] + rng.normal(size=(n, d)), 3)


def table(spark, label, points):
    return spark.createDataFrame([(i, int(c), *map(float, p)) for i, (c, p) in enumerate(zip(label, points, strict=True))], "id int, cluster int, x double, y double")


def plain_silhouette(label, points):
    dist = np.sqrt(((points[:, None, :] - points[None, :, :]) ** 2).sum(-1))
    out = []
    for i in range(len(points)):
        own = label == label[i]
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = dist[i][own].sum() / (own.sum() - 1)
        b = min(dist[i][label == c].mean() for c in set(label) - {label[i]})
        out.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return np.mean(out)


def test_silhouette_is_exact_on_few_points(spark):
    label, points = cloud(300)
    label, points = np.append(label, [7, 1, 1]), np.vstack([points, [[50.0, 50.0], points[0], points[0]]])
    noisy = table(spark, np.append(label, -1), np.vstack([points, [[0.0, 0.0]]]))
    row = micro.silhouette_euclidean(noisy, ["x", "y"]).first()
    assert row["silhouette"] == pytest.approx(plain_silhouette(label, points)) and row["cota_error"] == 0.0


def test_silhouette_keeps_its_bound(spark):
    label, points = cloud(1500)
    row = micro.silhouette_euclidean(table(spark, label, points), ["x", "y"], cells=200).first()
    off = abs(row["silhouette"] - plain_silhouette(label, points))
    assert off <= row["cota_error"] < 1 and off < 0.02


def test_silhouette_measures_all_pairs_at_every_size(spark, monkeypatch):
    """More positions than CELLS, in several blocks, some of them repeated, and clusters of one point."""
    monkeypatch.setattr(micro, "SIDE", 500)
    label, points = cloud(2600)
    label, points = np.append(label, [7, 8, 1, 1]), np.vstack([points, [[50.0, 50.0], [50.0, 50.0], points[0], points[0]]])
    row = micro.silhouette_euclidean(table(spark, label, points).repartition(5), ["x", "y"]).first()
    assert row["silhouette"] == pytest.approx(plain_silhouette(label, points), abs=1e-12) and row["cota_error"] == 0.0
    named = table(spark, label, points).selectExpr("if(cluster = 1, 'b', 'a') AS kind", "x", "0D AS y")
    row = micro.silhouette_euclidean(named, ["x", "y"], "kind", None).first()
    assert row["silhouette"] == pytest.approx(plain_silhouette(label == 1, points * [1, 0]), abs=1e-12)


def test_silhouette_needs_two_clusters(spark):
    label, points = cloud(20)
    assert micro.silhouette_euclidean(table(spark, np.zeros(20, int), points), ["x", "y"]).first()["silhouette"] is None
    assert micro.silhouette_euclidean(table(spark, label, points).where("false"), ["x", "y"]).first()["silhouette"] is None


def plain_hierarchy(points, k, linkage):
    """Merge the two nearest groups, distances taken over all members."""
    groups = [[i] for i in range(len(points))]
    dist = np.sqrt(((points[:, None, :] - points[None, :, :]) ** 2).sum(-1))

    def between(a, b):
        if linkage == "ward":
            return len(a) * len(b) / (len(a) + len(b)) * ((points[a].mean(0) - points[b].mean(0)) ** 2).sum()
        part = dist[np.ix_(a, b)]
        return {"complete": part.max(), "single": part.min(), "average": part.mean()}[linkage]

    while len(groups) > k:
        _, i, j = min((between(a, b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        groups[i] += groups.pop(j)
    return {frozenset(g) for g in groups}


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["cluster"], set()).add(r["id"])
    return {frozenset(g) for g in out.values()}


@pytest.mark.parametrize("linkage", ["ward", "complete", "average", "single"])
def test_hierarchy_equals_merging_points(spark, linkage):
    label, points = cloud(60, seed=8)
    df = table(spark, label, points).drop("cluster")
    assert found(micro.fit_agglomerative(df, ["x", "y"], 4, linkage)) == plain_hierarchy(points, 4, linkage)


def test_hierarchy_beyond_the_bound_and_edges(spark):
    label, points = cloud(3000, seed=9)
    points = np.where(label[:, None] == 1, points + 20, points)
    df = table(spark, label, points).withColumnRenamed("cluster", "kind")
    out = micro.fit_agglomerative(df, ["x", "y"], 2, cells=150)
    assert out.count() == 3000 and out.groupBy("cluster").agg({"kind": "max"}).count() == 2
    far = out.where("kind = 1").select("cluster").distinct().collect()
    assert len(far) == 1 and out.where("kind <> 1").where(f"cluster = {far[0][0]}").count() == 0
    assert micro.fit_agglomerative(df.where("false"), ["x", "y"], 3).count() == 0
    one = micro.fit_agglomerative(df.where("id < 5").selectExpr("id", "1D AS x", "2D AS y"), ["x", "y"], 3)
    assert {r["cluster"] for r in one.collect()} == {0}
    with pytest.raises(ValueError):
        micro.agglomerate(points[:3], np.ones(3), 1, "other")
