"""Density clustering on a grid, without pairs inside a dense cell.

Equal points are one row with a weight.  Cells have the side eps / sqrt(d), so
all points of a cell are neighbours: a cell with ``min_samples`` points is core
as a whole, and only the few points of the other cells count their neighbours.
Two sets of points are compared by their bounding boxes first; boxes that lie
wholly within eps, or wholly beyond it, are settled, the rest is divided into
finer boxes and only at the end into points.  Components are those of cells.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forja.operators.graph import components
from forja.operators.ordered import row_numbers, value_bucket
from forja.staging import temporary

#: Cells are divided by 2^FINER along each axis before single points are compared.
FINER = 3
#: Axes by which neighbouring cells are looked up; the others are settled by the boxes.
KEY_AXES = 3


def _boxes(spots: DataFrame, keys: Sequence[str], d: int) -> DataFrame:
    """Weight and tight bounds of the points of each group."""
    return spots.groupBy(*keys).agg(F.sum("n").alias("n"), F.expr(f"array({', '.join(f'min(get(lo, {i}))' for i in range(d))})").alias("lo"),
                                    F.expr(f"array({', '.join(f'max(get(hi, {i}))' for i in range(d))})").alias("hi"))


def _join(left: DataFrame, right: DataFrame, on: str | Sequence[str], how: str = "inner") -> DataFrame:
    """A join of two tables that grow with the points: sorted, never broadcast.

    Sizes of tables with arrays are underestimated, so many a side would pass
    for small, and all of them are built by the driver.
    """
    return left.join(right.hint("merge"), on, how)


def _verdict(d: int, eps: float) -> Column:
    """TRUE if all points of two boxes are neighbours, FALSE if none is, NULL if that is open."""
    low = [f"(get(lo_a, {i}) - get(hi_b, {i}))" for i in range(d)]
    high = [f"(get(lo_b, {i}) - get(hi_a, {i}))" for i in range(d)]
    far = " + ".join(f"power(greatest(-{x}, -{y}), 2)" for x, y in zip(low, high, strict=True))
    near = " + ".join(f"power(greatest({x}, {y}, 0D), 2)" for x, y in zip(low, high, strict=True))
    limit = f"power({float(eps)!r}D, 2)"
    return F.expr(f"CASE WHEN {far} <= {limit} THEN true WHEN {near} > {limit} THEN false END")


def _side(df: DataFrame, side: str, *keep: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{c}_{side}") for c in (*keep, "lo", "hi")])


def _neighbour_cells(cells: DataFrame, others: DataFrame, d: int, eps: float) -> DataFrame:
    """(cell_a, cell_b, open) of different cells whose boxes come within eps; ``open`` unless all their points are neighbours."""
    axes, r = min(d, KEY_AXES), math.ceil(math.sqrt(d))
    steps = [o for o in itertools.product(range(-r, r + 1), repeat=axes) if sum(max(0, abs(s) - 1) ** 2 for s in o) <= d]
    offsets = F.expr("array(" + ", ".join(f"array({', '.join(map(str, o))})" for o in steps) + ")")
    key = F.slice("cell", 1, axes)
    a = cells.withColumn("o", F.explode(offsets)).select(F.col("cell").alias("cell_a"), F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"),
                                                         F.zip_with(key, "o", lambda c, s: c + s).alias("k"))
    b = others.select(F.col("cell").alias("cell_b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"), key.alias("k"))
    pairs = _join(a, b, "k").where("cell_a <> cell_b").withColumn("v", _verdict(d, eps))
    return pairs.where(F.coalesce("v", F.lit(True))).select("cell_a", "cell_b", F.col("v").isNull().alias("open"))


def _touching(pairs: DataFrame, left: list[DataFrame], right: list[DataFrame], own: Sequence[str], d: int, eps: float) -> DataFrame:
    """(own, cell_b, n) of the rows of ``left`` and how many points of the cell they are near to.

    ``left`` and ``right`` hold the finer boxes and the points of both sides;
    ``pairs`` (own, cell_b) are still open.  With ``own`` a point, n counts its
    neighbours; with a cell, any n > 0 says that some points are neighbours.
    """
    found = None
    for level, (a, b) in enumerate(zip(left, right, strict=True)):
        keys_a, keys_b = ([*own], ["cell_b"]) if not level else ([*own, "box_a"], ["cell_b", "box_b"])
        open_pairs = _join(_join(pairs, a, keys_a), b, keys_b).withColumn("v", _verdict(d, eps))
        sure = open_pairs.where("v").groupBy(*own, "cell_b").agg(F.sum("n_b").alias("n"))
        found = sure if found is None else found.unionAll(sure)
        pairs = open_pairs.where("v IS NULL").select(*own, "cell_b", "box_a", "box_b") if not level else pairs
    return found.groupBy(*own, "cell_b").agg(F.sum("n").alias("n"))


def density_clusters(points: DataFrame, key: str, cols: Sequence[str], eps: float, min_samples: int, label: str = "cluster") -> DataFrame:
    """(key, label, es_nucleo): the cluster of each point, -1 for outliers, and whether it is a core point.

    A point is core if ``min_samples`` points, itself included, lie within
    ``eps`` (Euclidean).  Clusters are numbered by their smallest core key; a
    border point near several belongs to the first of them.  Points with a
    NULL or NaN coordinate are left out; keys should be unique.
    """
    spark, d = points.sparkSession, len(cols)
    # a hair less than eps / sqrt(d), so that rounding never puts two points of a cell out of reach
    side = float(eps) / math.sqrt(d) * (1 - 1e-9)
    v = F.array(*[F.col(c).cast("double") for c in cols])
    own = points.select(F.col(key).alias("key"), v.alias("lo")).where(F.forall("lo", lambda c: c.isNotNull() & ~F.isnan(c)))
    own = temporary(spark, own, "density-points")
    spots = own.groupBy("lo").agg(F.count("*").alias("n"), F.min("key").alias("first"))
    spots = spots.select(F.xxhash64("lo").alias("spot"), "first", "n", "lo", F.col("lo").alias("hi"),
                         F.transform("lo", lambda c: F.floor(c / side)).alias("cell"),
                         F.transform("lo", lambda c: F.floor(c / (side / 2**FINER))).alias("box"))
    spots = temporary(spark, spots, "density-spots")
    cells = temporary(spark, _boxes(spots, ["cell"], d), "density-cells")

    # which points are core
    sparse = cells.where(F.col("n") < min_samples)
    near = _neighbour_cells(sparse, cells, d, eps)
    few = _join(spots, sparse.select("cell", F.col("n").alias("n_cell")), "cell")
    some = few.select(F.col("first").alias("first_a"), F.col("cell").alias("cell_a"), F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"), "n_cell")
    others = cells.select(F.col("cell").alias("cell_b"), F.col("n").alias("n_b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"))
    to_cells = _join(_join(some, near, "cell_a"), others, "cell_b").withColumn("v", _verdict(d, eps))
    to_cells = temporary(spark, to_cells.where(F.coalesce("v", F.lit(True))).select("first_a", "cell_b", "n_cell", "n_b", "v"), "density-near")
    sure = to_cells.groupBy("first_a").agg(F.sum(F.when(F.col("v"), F.col("n_b")).otherwise(0)).alias("sure"), F.max("n_cell").alias("n_cell"))
    short = sure.where(F.col("sure") + F.col("n_cell") < min_samples).select("first_a")
    open_pairs = _join(to_cells.where("v IS NULL"), short, "first_a", "left_semi").select("first_a", "cell_b")
    as_a = some.select("first_a", "lo_a", "hi_a", F.lit(0).alias("box_a"))
    boxes = temporary(spark, _boxes(spots, ["cell", "box"], d), "density-boxes")
    level_b = [_side(boxes, "b", "cell", "box", "n"), _side(spots, "b", "cell", "box", "n")]
    open_pairs = temporary(spark, open_pairs, "density-open")
    more = _touching(open_pairs, [as_a, as_a], level_b, ["first_a"], d, eps).groupBy("first_a").agg(F.sum("n").alias("more"))
    counts = _join(_join(some.select("first_a", "n_cell"), sure.select("first_a", "sure"), "first_a", "left"), more, "first_a", "left")
    total = F.col("n_cell") + F.coalesce("sure", F.lit(0)) + F.coalesce("more", F.lit(0))
    core_few = temporary(spark, counts.where(total >= min_samples).select(F.col("first_a").alias("first")), "density-core-few")
    dense = cells.where(F.col("n") >= min_samples).select("cell")
    core = _join(spots, dense, "cell", "left_semi").unionByName(_join(few.drop("n_cell"), core_few, "first", "left_semi"))
    core = temporary(spark, core, "density-core")

    # which cells hang together
    core_cells = temporary(spark, _boxes(core, ["cell"], d), "density-core-cells")
    core_boxes = temporary(spark, _boxes(core, ["cell", "box"], d), "density-core-boxes")
    between = temporary(spark, _neighbour_cells(core_cells, core_cells, d, eps).where("cell_a < cell_b"), "density-between")
    left = [_side(core_boxes, "a", "cell", "box"), _side(core, "a", "cell", "box")]
    right = [_side(core_boxes, "b", "cell", "box", "n"), _side(core, "b", "cell", "box", "n")]
    linked = _touching(between.where("open").select("cell_a", "cell_b"), left, right, ["cell_a"], d, eps).select("cell_a", "cell_b")
    edges = between.where("NOT open").select("cell_a", "cell_b").unionAll(linked)
    least = components(spark, edges).select(F.col("a").alias("cell"), F.col("b").alias("of"))
    home = _join(core.groupBy("cell").agg(F.min("first").alias("first")), least, "cell", "left").select("cell", F.coalesce("of", "cell").alias("of"), "first")
    names = home.groupBy("of").agg(F.min("first").alias("name"))
    of_cell = temporary(spark, _join(home, names, "of").select("cell", "name"), "density-names")

    # border points: the first cluster with a core point in reach
    border = _join(few.drop("n_cell"), core_few, "first", "left_anti")
    to_core = _neighbour_cells(_boxes(border, ["cell"], d), core_cells, d, eps).select("cell_a", "cell_b")
    at = border.select(F.col("first").alias("first_a"), F.col("cell").alias("cell_a"), F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"))
    reach = _join(at, to_core, "cell_a").select("first_a", "cell_b")
    near_core = _touching(reach, [at.select("first_a", "lo_a", "hi_a", F.lit(0).alias("box_a"))] * 2, right, ["first_a"], d, eps)
    inside = at.select("first_a", F.col("cell_a").alias("cell_b"))
    choices = _join(near_core.select("first_a", "cell_b").unionAll(inside), of_cell.withColumnRenamed("cell", "cell_b"), "cell_b")
    of_border = choices.groupBy("first_a").agg(F.min("name").alias("name")).select(F.col("first_a").alias("first"), "name")

    of_spot = _join(core, of_cell, "cell").select("lo", "name", F.lit(True).alias("es_nucleo")).unionByName(
        _join(border, of_border, "first").select("lo", "name", F.lit(False).alias("es_nucleo")))
    ranked = _numbered(of_cell.select("name").distinct())
    out = _join(own, _join(of_spot, ranked, "name"), "lo", "left")
    return out.select(F.col("key").alias(key), F.coalesce("number", F.lit(-1)).cast("int").alias(label), F.coalesce("es_nucleo", F.lit(False)).alias("es_nucleo"))


def _numbered(names: DataFrame) -> DataFrame:
    """Cluster names with their position (0, 1, ...) in the order of names."""
    text = names.schema["name"].dataType.typeName() == "string"
    bucket = F.substring("name", 1, 6) if text else value_bucket(F.col("name"))
    return row_numbers(names, [], bucket, [F.col("name")], "number").withColumn("number", F.col("number") - 1)
