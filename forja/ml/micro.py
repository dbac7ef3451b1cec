"""Micro clusters: a bounded number of small boxes that stand for all points.

Points are summed up by the cells of a grid, the finest whose cells stay under
a bound; with fewer different points than that, each is a cell of its own and
what is computed from the cells is exact.  Sums are combined before the
shuffle, so the cost is that of an aggregate whatever the points.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from forja.ml.metrics import _dist2
from forja.operators.ordered import attach_row
from forja.staging import temporary

CELLS = 1_024
DEEPEST = 24


def with_cells(points: DataFrame, cols: Sequence[str], by: Sequence[str] = (), cells: int = CELLS) -> tuple[DataFrame, bool]:
    """Points plus ``__cell`` (a grid cell, or the point itself), and whether cells are single positions.

    One aggregate estimates how many cells each grid would have; about
    ``cells`` is the bound (the estimate is off by a few percent).
    """
    v = F.array(*[F.col(c).cast("double") + F.lit(0.0) for c in cols])
    span = points.agg(*[F.min(c).alias(f"__lo_{c}") for c in cols], *[(F.max(c) - F.min(c)).alias(f"__span_{c}") for c in cols])
    placed = attach_row(points, span)

    def cell(depth: int) -> Column:
        return F.array(*[F.floor((F.col(c) - F.col(f"__lo_{c}")) / F.nullif(F.col(f"__span_{c}"), F.lit(0.0)) * 2.0**depth).cast("double") for c in cols])

    grids = {f"d{k}": F.approx_count_distinct(F.struct(*by, cell(k)), 0.02) for k in range(1, DEEPEST + 1)}
    sizes = placed.agg(F.approx_count_distinct(F.struct(*by, v), 0.02).alias("points"), *[c.alias(n) for n, c in grids.items()]).first()
    exact = (sizes["points"] or 0) <= cells
    depth = max((k for k in range(1, DEEPEST + 1) if (sizes[f"d{k}"] or 0) <= cells), default=0)
    placed = placed.withColumn("__cell", v if exact else cell(depth))
    return placed.drop(*[f"__{p}_{c}" for p in ("lo", "span") for c in cols]), exact


def micro_clusters(points: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, __cell, n, centre, radius) of points with cells; no point is further than ``radius`` from the centre."""
    sums = [F.count("*").alias("n"), F.array(*[F.avg(F.col(c).cast("double")) for c in cols]).alias("centre"),
            F.array(*[F.min(F.col(c).cast("double")) for c in cols]).alias("lo"), F.array(*[F.max(F.col(c).cast("double")) for c in cols]).alias("hi")]
    return points.groupBy(*by, "__cell").agg(*sums).withColumn("radius", F.sqrt(_dist2(F.col("lo"), F.col("hi")))).drop("lo", "hi")


def silhouette_euclidean(points: DataFrame, cols: Sequence[str], label: str = "cluster", noise: int | None = -1, cells: int | None = None) -> DataFrame:
    """One row: mean silhouette over Euclidean distance, noise left out, and ``cota_error``, how far it may be off.

    All pairs of points are measured, in blocks, and the bound is 0.  That
    takes time in proportion to the square of the points; with ``cells`` every
    point meets about as many micro clusters of all clusters instead: a
    distance is then off by a micro cluster's radius at most.  NULL with fewer
    than two clusters.
    """
    p = points.where(F.col(label) != noise) if noise is not None else points
    p = p.dropna(subset=[label, *cols])
    if cells is None:
        return _all_pairs(p, cols, label)
    placed, exact = with_cells(p, cols, [label], cells)
    small = micro_clusters(placed, cols, [label])
    ball = F.struct(F.col("n").cast("double").alias("n"), "centre", (F.lit(0.0) if exact else F.col("radius")).alias("r"))
    per = small.groupBy(label).agg(F.collect_list(ball).alias("balls"), F.sum("n").alias("n"), F.sum(F.col("n") * ball["r"]).alias("e"))
    one = per.agg(F.collect_list(F.struct(F.col(label).alias("c"), "n", (F.col("e") / F.col("n")).alias("e"), "balls")).alias("cs"))
    v = F.array(*[F.col(c).cast("double") for c in cols])
    j = attach_row(p.select(F.col(label).alias("c0"), v.alias("v")), one)

    def total(c: Column) -> Column:
        return F.aggregate(c["balls"], F.lit(0.0), lambda s, b: s + b["n"] * F.sqrt(_dist2(F.col("v"), b["centre"])))

    own = F.filter("cs", lambda c: c["c"] == F.col("c0"))[0]
    others = F.filter("cs", lambda c: c["c"] != F.col("c0"))
    rest = F.nullif(own["n"] - 1, F.lit(0))
    j = j.select(own["n"].alias("n0"), (total(own) / rest).alias("a"), F.array_min(F.transform(others, lambda c: total(c) / c["n"])).alias("b"),
                 (own["e"] * own["n"] / rest).alias("ea"), F.array_max(F.transform(others, lambda c: c["e"])).alias("eb"))
    s = F.when(F.col("n0") == 1, 0.0).otherwise((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)))
    # s changes by no more than 1 / max(a, b) along either distance
    left = F.greatest("a", "b") - F.greatest("ea", "eb")
    off = F.col("ea") + F.col("eb")
    bound = F.when((F.col("n0") == 1) | (off == 0), 0.0).otherwise(F.least(F.lit(2.0), F.coalesce(F.when(left > 0, off / left), F.lit(2.0))))
    j = j.where(F.col("b").isNotNull())
    return j.agg(F.avg(F.coalesce(s, F.lit(0.0))).alias("silhouette"), F.avg(bound).alias("cota_error"))


#: Points of a block, and the most numbers that a block keeps of its points and all clusters.
SIDE, SUMS = 1 << 14, 1 << 23
PACKED = "i int, n int, spots binary"
MEASURED = "i int, j int, sums binary, own binary"


def _packed(d: int):
    """The points of a block as one row of numbers: cluster, weight, coordinates."""
    def run(table: pa.Table) -> pa.Table:
        rows = np.stack([table.column(c).to_numpy().astype(float) for c in ("c", "n", *[f"x{k}" for k in range(d)])], axis=1)
        rows = rows[np.lexsort(rows.T[::-1])]  # in one order, whatever the order in which rows came
        return pa.table({"i": pa.array([table.column("i")[0].as_py()], pa.int32()), "n": pa.array([len(rows)], pa.int32()), "spots": [rows.tobytes()]})

    return run


def _measured(d: int, clusters: int):
    """Of two blocks: the distances of each point to all points of the other block, summed up per cluster."""
    def unpacked(table: pa.Table, name: str) -> np.ndarray:
        return np.frombuffer(table.column(name)[0].as_buffer(), float).reshape(-1, d + 2)

    def weights(spots: np.ndarray) -> np.ndarray:
        out = np.zeros((len(spots), clusters))
        out[np.arange(len(spots)), spots[:, 0].astype(int)] = spots[:, 1]
        return out

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        i, j = (k.as_py() for k in key)
        a, b = unpacked(left, "spots"), unpacked(right, "others")
        wa, wb = weights(a), weights(b)
        sums, back = np.zeros((len(a), clusters)), np.zeros((len(b), clusters))
        step = max(1, (1 << 17) // max(len(b), 1))
        dist, one = np.empty((step, len(b))), np.empty((step, len(b)))
        for k in range(0, len(a), step):
            m = min(step, len(a) - k)
            total, diff = dist[:m], one[:m]
            total.fill(0.0)
            for x in range(2, d + 2):
                np.subtract(a[k: k + m, x, None], b[None, :, x], out=diff)
                np.multiply(diff, diff, out=diff)
                np.add(total, diff, out=total)
            np.sqrt(total, out=total)
            sums[k: k + m] = total @ wb
            if i != j:
                back += total.T @ wa[k: k + m]
        rows = [(i, j, sums.tobytes(), a[:, :2].tobytes() if i == j else b"")] + ([(j, i, back.tobytes(), b"")] if i != j else [])
        return pa.table({c: pa.array([r[k] for r in rows], t) for k, (c, t) in enumerate((("i", pa.int32()), ("j", pa.int32()), ("sums", pa.binary()), ("own", pa.binary())))})

    return run


def _scored(sizes: np.ndarray):
    """Sum of the silhouettes of a block and the points that have one."""
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("j").to_pylist(), table.column("sums"), table.column("own"), strict=True), key=lambda r: r[0])
        total = sum(np.frombuffer(r[1].as_buffer(), float) for r in rows).reshape(-1, len(sizes))
        own = np.frombuffer(next(r[2] for r in rows if len(r[2].as_buffer())).as_buffer(), float).reshape(-1, 2)
        c, n, at = own[:, 0].astype(int), own[:, 1], np.arange(len(own))
        with np.errstate(divide="ignore", invalid="ignore"):
            a = total[at, c] / (sizes[c] - 1)
            mean = total / sizes
        mean[at, c] = np.inf
        b = mean.min(axis=1)
        far = np.maximum(a, b)
        s = np.where((sizes[c] == 1) | (far == 0), 0.0, (b - a) / np.where(far > 0, far, 1.0))
        return pa.table({"s": [float((s * n).sum())], "n": [float(n.sum())]})

    return run


def _all_pairs(p: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """The silhouette over all pairs of points.

    Equal points of a cluster are one of a weight; blocks of SIDE of them meet
    in pairs, each pair of blocks once and in one task, whose memory is
    bounded by the block.  A block is sent once per block, some 2 n^2 / SIDE points in all.
    """
    x = [f"x{k}" for k in range(len(cols))]
    spots = p.groupBy(F.col(label).alias("label"), *[F.col(c).cast("double").alias(k) for c, k in zip(cols, x, strict=True)]).agg(F.count("*").alias("n"))
    spots = temporary(p.sparkSession, spots, "silhouette-spots")
    sizes = spots.groupBy("label").agg(F.count("*").alias("spots"), F.sum("n").alias("n")).orderBy("label").collect()
    if len(sizes) < 2:
        return spots.agg(F.lit(None).cast("double").alias("silhouette"), F.lit(None).cast("double").alias("cota_error"))
    clusters = p.sparkSession.createDataFrame([(r["label"], c) for c, r in enumerate(sizes)], spots.select("label").schema.add("c", IntegerType()))
    side = min(SIDE, max(1, SUMS // len(sizes)))
    blocks = -(-sum(r["spots"] for r in sizes) // side)
    placed = spots.join(clusters, "label").withColumn("i", F.pmod(F.xxhash64("label", *x), F.lit(blocks)).cast("int"))
    packed = placed.select("i", "c", "n", *x).groupBy("i").applyInArrow(_packed(len(cols)), PACKED)
    packed = temporary(p.sparkSession, packed, "silhouette-blocks")
    parts = min(blocks * (blocks + 1) // 2, 4 * p.sparkSession.sparkContext.defaultParallelism + blocks)
    left = packed.withColumn("j", F.explode(F.sequence(F.col("i"), F.lit(blocks - 1)))).repartition(parts, "i", "j")
    right = packed.select(F.col("i").alias("j"), F.col("spots").alias("others"))
    right = right.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("j")))).repartition(parts, "i", "j")
    met = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(_measured(len(cols), len(sizes)), MEASURED)
    per = met.groupBy("i").applyInArrow(_scored(np.array([r["n"] for r in sizes], float)), "s double, n double")
    return per.agg((F.sum("s") / F.sum("n")).alias("silhouette"), F.lit(0.0).alias("cota_error"))


def agglomerate(centres: np.ndarray, weights: np.ndarray, k: int, linkage: str = "ward") -> np.ndarray:
    """Cluster of each of a bounded number of weighted points, merged from below until ``k`` are left.

    The two nearest are merged again and again (of equal distances the first
    pair), the distances to the rest follow by the rule of the linkage.
    Clusters are numbered by their first member.
    """
    n = len(centres)
    size = weights.astype(float).copy()
    d2 = ((centres[:, None, :] - centres[None, :, :]) ** 2).sum(-1)
    # Ward: what the merge adds to the squared deviations
    dist = d2 * (size[:, None] * size[None, :] / (size[:, None] + size[None, :])) if linkage == "ward" else np.sqrt(d2)
    np.fill_diagonal(dist, np.inf)
    near = dist.argmin(axis=1) if n else np.zeros(0, int)
    alive, owner = np.ones(n, bool), np.arange(n)
    for _ in range(n - max(k, 1)):
        rows = np.flatnonzero(alive)
        i = rows[dist[rows, near[rows]].argmin()]
        i, j = sorted((int(i), int(near[i])))
        a, b = dist[i], dist[j]
        if linkage == "ward":
            new = ((size[i] + size) * a + (size[j] + size) * b - size * dist[i, j]) / (size[i] + size[j] + size)
        elif linkage == "average":
            new = (size[i] * a + size[j] * b) / (size[i] + size[j])
        elif linkage in ("complete", "single"):
            new = (np.maximum if linkage == "complete" else np.minimum)(a, b)
        else:
            raise ValueError(f"unknown linkage {linkage!r}")
        new[~alive] = np.inf
        new[[i, j]] = np.inf
        size[i] += size[j]
        alive[j] = False
        owner[owner == j] = i
        dist[i], dist[:, i], dist[j], dist[:, j] = new, new, np.inf, np.inf
        stale = np.flatnonzero(alive & ((near == i) | (near == j)))
        near[stale] = dist[stale].argmin(axis=1)
        near[i] = dist[i].argmin()
        closer = alive & (dist[:, i] < dist[np.arange(n), near])
        near[closer] = i
    return np.unique(owner, return_inverse=True)[1]


def fit_agglomerative(points: DataFrame, cols: Sequence[str], k: int, linkage: str = "ward", label: str = "cluster", cells: int = CELLS) -> DataFrame:
    """``points`` plus ``label``: the hierarchy from below, cut at ``k`` groups (fewer if there are fewer positions).

    Micro clusters (count, mean) are what is merged, at most about ``cells``
    of them, which the driver does; with no more different points than that
    this is the hierarchy of the points themselves, equal ones merged first.
    Beyond it no point moves further than its cell's diagonal.
    """
    known = points.dropna(subset=list(cols))
    placed, _ = with_cells(known, cols, (), cells)
    small = sorted(micro_clusters(placed, cols).collect(), key=lambda r: [(x is not None, x or 0.0) for x in r["__cell"]])
    found = agglomerate(np.array([r["centre"] for r in small], float).reshape(len(small), len(cols)), np.array([r["n"] for r in small]), k, linkage)
    rows = [(list(r["__cell"]), int(c)) for r, c in zip(small, found, strict=True)]
    of = points.sparkSession.createDataFrame(rows, f"of array<double>, `{label}` int")
    same = F.coalesce(F.transform("of", lambda x: F.coalesce(x, F.lit(-1.0)))) == F.transform("__cell", lambda x: F.coalesce(x, F.lit(-1.0)))
    return placed.join(F.broadcast(of), same).drop("__cell", "of")  # about ``cells`` rows
