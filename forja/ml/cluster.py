"""Machine clustering on spark.ml."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import BisectingKMeans, KMeans, KMeansModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forja.ml.metrics import scaler_stats, standardise
from forja.operators.ordered import attach_row
from forja.plans.features import CLUSTER_FEATURES

SEED = 42


def scaled_points(metrics: DataFrame, cols: Sequence[str] = CLUSTER_FEATURES) -> DataFrame:
    """Machines with every feature known, plus scaled columns and a vector."""
    z = standardise(metrics.dropna(subset=list(cols)), cols)
    return VectorAssembler(inputCols=[f"z_{c}" for c in cols], outputCol="features").transform(z)


def fit_kmeans(points: DataFrame, k: int, n_init: int = 10, max_iter: int = 300) -> KMeansModel:
    """Best of ``n_init`` seeds by training cost; ``points`` should be cached."""
    best = None
    for i in range(n_init):
        model = KMeans(k=k, seed=SEED + i, maxIter=max_iter, predictionCol="cluster").fit(points)
        if best is None or model.summary.trainingCost < best.summary.trainingCost:
            best = model
    return best


def fit_hierarchical(points: DataFrame, k: int):
    """Divisive hierarchy cut at k groups."""
    return BisectingKMeans(k=k, seed=SEED, predictionCol="cluster").fit(points)


#: Rows of which the sweep draws its first centres; all rows take part in every round.
START_ROWS = 4096


def _first_centres(points: DataFrame, cols: Sequence[str], ks: Sequence[int], n_init: int) -> list[tuple[int, int, list[list[float]]]]:
    """(k, seed, centres) for every k and seed, spread out over at most START_ROWS rows (the first by a hash of their values)."""
    z = F.array(*[F.col(c).cast("double") for c in cols])
    rows = points.select(z.alias("z")).orderBy(F.xxhash64("z"), "z").limit(START_ROWS).collect()
    some = np.array([r["z"] for r in rows], dtype=float).reshape(len(rows), len(cols))
    out = []
    for k in ks:
        for seed in range(n_init):
            rng = np.random.default_rng([SEED, k, seed])
            picked = [int(rng.integers(len(some)))]
            near = ((some - some[picked[0]]) ** 2).sum(1)
            while len(picked) < k:
                total = near.sum()
                picked.append(int(rng.choice(len(some), p=near / total) if total > 0 else rng.integers(len(some))))
                near = np.minimum(near, ((some - some[picked[-1]]) ** 2).sum(1))
            out.append((k, seed, some[picked].tolist()))
    return out


def _near(v: Column, centres: Column) -> Column:
    """(squared distance, number) of the nearest centre, the first of equals."""
    return F.array_min(F.transform(centres, lambda c, i: F.struct(
        F.aggregate(F.zip_with(v, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x).alias("d"), i.alias("c"))))


def _assigned(points: DataFrame, cols: Sequence[str], models: dict[tuple[int, int], list[list[float]]], extra: Sequence[str] = ()) -> DataFrame:
    """Every point once per model with its nearest centre; a model is k short vectors, so all of them are one broadcast row."""
    spark = points.sparkSession
    one = spark.createDataFrame([([(k, seed, c) for (k, seed), c in models.items()],)], "m array<struct<k int, seed int, centres array<array<double>>>>")
    rows = attach_row(points.select(F.array(*[F.col(c).cast("double") for c in cols]).alias("v"), *extra), one)
    rows = rows.select("v", *extra, F.explode("m").alias("m"))
    return rows.select("v", *extra, "m.k", "m.seed", _near(F.col("v"), F.col("m.centres")).alias("n")).select("v", *extra, "k", "seed", "n.d", "n.c")


def _moves(points: DataFrame, cols: Sequence[str], models: dict[tuple[int, int], list[list[float]]]) -> DataFrame:
    """(k, seed, c, n, s): rows and column sums of every cluster of every model, each point at its nearest centre (the first of equals).

    A task returns one row per model and cluster, which Spark merges.
    """
    width, names = len(cols), [*models]
    centres = [np.array(models[m], dtype=float) for m in names]

    def partial(batches):
        sums = [np.zeros((len(c), width + 1)) for c in centres]
        for batch in batches:
            v = np.column_stack([batch.column(j).to_numpy(zero_copy_only=False) for j in range(width)])
            for c, s in zip(centres, sums, strict=True):
                far = sum((v[:, j, None] - c[None, :, j]) ** 2 for j in range(width))
                own = far.argmin(1)
                s[:, 0] += np.bincount(own, minlength=len(c))
                for j in range(width):
                    s[:, j + 1] += np.bincount(own, weights=v[:, j], minlength=len(c))
        rows = [(k, seed, i, int(r[0]), r[1:].tolist()) for (k, seed), s in zip(names, sums, strict=True) for i, r in enumerate(s) if r[0] > 0]
        yield pa.RecordBatch.from_pydict(dict(zip(shape.names, zip(*rows, strict=True), strict=True)) if rows else {n: [] for n in shape.names}, schema=shape)

    shape = pa.schema([("k", pa.int32()), ("seed", pa.int32()), ("c", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.float64()))])
    rows = points.select(*[F.col(c).cast("double").alias(f"v{j}") for j, c in enumerate(cols)])
    parts = rows.mapInArrow(partial, "k int, seed int, c int, n long, s array<double>")
    n = F.sum("n")
    return parts.groupBy("k", "seed", "c").agg(*[(F.sum(F.col("s")[j]) / n).alias(f"m{j}") for j in range(width)])


def fit_sweep(points: DataFrame, cols: Sequence[str], ks: Sequence[int], n_init: int = 10, max_iter: int = 100,
              tol: float = 1e-6) -> dict[int, tuple[float, list[list[float]]]]:
    """k -> (cost, centres) of the best of ``n_init`` K-Means fits, all k and seeds moved by one job per round.

    A round sends back one row per model and cluster, whatever the number of
    points.  A model whose centres move by less than ``tol`` rests; an empty
    cluster keeps its centre.  Rows with a NULL feature take no part.
    """
    points = points.dropna(subset=list(cols))
    moving = {(k, seed): c for k, seed, c in _first_centres(points, cols, ks, n_init)}
    resting = {}
    for _ in range(max_iter):
        if not moving:
            break
        sums = _moves(points, cols, moving)
        new = {m: [list(c) for c in cs] for m, cs in moving.items()}
        for r in sums.collect():
            new[r["k"], r["seed"]][r["c"]] = [r[f"m{j}"] for j in range(len(cols))]
        still = {}
        for m, cs in new.items():
            moved = max(((np.array(cs) - np.array(moving[m])) ** 2).sum(1))
            (still if moved > tol * tol else resting)[m] = cs
        moving = still
    resting |= moving
    if not resting:
        return {}
    costs = _assigned(points, cols, resting).groupBy("k", "seed").agg(F.sum("d").alias("cost")).collect()
    best = {}
    for r in sorted(costs, key=lambda r: (r["k"], r["cost"], r["seed"])):
        best.setdefault(r["k"], (float(r["cost"]), resting[r["k"], r["seed"]]))
    return best


def sweep(points: DataFrame, cols: Sequence[str] = CLUSTER_FEATURES, max_k: int = 10, n_init: int = 10) -> DataFrame:
    """Cost and silhouette (squared distance) for k = 2..min(max_k, n-1); marks the best k, the smallest of equals.

    All fits share their jobs, and so do the silhouettes: they need the size,
    centre and mean squared norm of each cluster, which one job gathers for
    every k.  The points are cached for the rounds.
    """
    z = [f"z_{c}" for c in cols]
    points = points.select(*z).persist()
    try:
        n = points.count()
        found = fit_sweep(points, z, range(2, min(max_k + 1, n)), n_init) if n > 2 else {}
        if not found:
            return points.sparkSession.createDataFrame([], "k int, coste double, silhouette double, mejor boolean")
        rows = _assigned(points, z, {(k, 0): c for k, (_, c) in found.items()})
        norm = F.aggregate(F.transform("v", lambda a: a * a), F.lit(0.0), lambda s, a: s + a)
        per = rows.groupBy("k", "c").agg(
            F.count("*").alias("n"), F.array(*[F.avg(F.col("v")[j]) for j in range(len(z))]).alias("m"), F.avg(norm).alias("q"))
        # at most max_k rows of max_k clusters each
        per = per.groupBy("k").agg(F.collect_list(F.struct("c", "n", "m", "q")).alias("cs"))
        rows = rows.join(F.broadcast(per), "k").withColumn("norm", norm)

        def far(c: Column) -> Column:
            return F.col("norm") + c["q"] - 2 * F.aggregate(F.zip_with("v", c["m"], lambda a, b: a * b), F.lit(0.0), lambda s, a: s + a)

        own = F.filter("cs", lambda x: x["c"] == F.col("c"))[0]
        other = F.array_min(F.transform(F.filter("cs", lambda x: x["c"] != F.col("c")), far))
        rows = rows.select("k", own["n"].alias("n"), (far(own) * own["n"] / F.nullif(own["n"] - 1, F.lit(0))).alias("a"), other.alias("b"))
        s = F.when(F.col("n") == 1, 0.0).otherwise(F.coalesce((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)), F.lit(0.0)))
        marks = {r["k"]: r["s"] for r in rows.groupBy("k").agg(F.avg(F.when(F.col("b").isNotNull(), s)).alias("s")).collect()}
    finally:
        points.unpersist()
    best = max((k for k in found if marks.get(k) is not None), key=lambda k: (marks[k], -k), default=None)
    data = [(k, cost, marks.get(k), k == best) for k, (cost, _) in sorted(found.items())]
    return points.sparkSession.createDataFrame(data, "k int, coste double, silhouette double, mejor boolean")


def assign(model: KMeansModel, points: DataFrame, stats: DataFrame, cols: Sequence[str] = CLUSTER_FEATURES) -> DataFrame:
    """Cluster, distance to its centre and the centre in original units.

    The centres are model parameters (k short vectors), so they travel as a
    literal.
    """
    centres = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in model.clusterCenters()])
    out = model.transform(points).withColumn("__c", F.get(centres, F.col("cluster")))
    z = F.array(*[F.col(f"z_{c}") for c in cols])
    d2 = F.aggregate(F.zip_with(z, "__c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    out = attach_row(out.withColumn("distancia_al_centro", F.sqrt(d2)), stats)
    real = {f"centro_{c}": F.col("__c")[i] * F.col(f"desv_{c}") + F.col(f"media_{c}") for i, c in enumerate(cols)}
    return out.withColumns(real).drop("__c", "features", *[f"{p}_{c}" for p in ("media", "desv") for c in cols])


def cluster_centres(model: KMeansModel, stats: DataFrame, cols: Sequence[str] = CLUSTER_FEATURES) -> DataFrame:
    """One row per cluster: its centre in original units."""
    items = F.array(*[F.struct(F.lit(i).alias("cluster"), F.array(*[F.lit(float(v)) for v in c]).alias("c"))
                      for i, c in enumerate(model.clusterCenters())])
    e = stats.select("*", F.explode(items).alias("i"))
    return e.select("i.cluster", *[(F.col("i.c")[j] * F.col(f"desv_{c}") + F.col(f"media_{c}")).alias(c) for j, c in enumerate(cols)])


def stats_of(metrics: DataFrame, cols: Sequence[str] = CLUSTER_FEATURES) -> DataFrame:
    return scaler_stats(metrics.dropna(subset=list(cols)), cols)
