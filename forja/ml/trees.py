"""Regression forests over data of any size.

Rows are binned as in Spark's own forest (32 bins a feature, a tree draws each
row a Poisson(1) number of times) and laid together by their bins.  A tree
cannot tell rows of equal bins apart, so a pass draws every row for every tree,
sums draws and labels up per set of equal bins, a cell, and only cells walk the
trees and enter the histograms.  Where no two rows share their bins, cells are
rows.  Each level of all trees is one job: tasks send the histograms of the
nodes they met, and one row per split node comes back to the driver.

The result is a forest of Spark's own, written in its format and read back.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forja.staging import drop_temporary, temporary, temporary_path

#: Bins of a feature; values of a feature with no more are bins of their own.
BINS = 32
#: Points that stand for a task's values of a feature where the cuts between bins are sought.
POINTS = 256
#: Rows of a block, the unit that numpy works on; the least rows of a task, while there are fewer tasks than cores, and the most.
BLOCK_ROWS, LEAST_ROWS, TASK_ROWS = 1 << 18, 1 << 15, 1 << 22
#: Two-valued features that share a histogram.
PACKED = 5
#: Bytes of histograms that a task holds; more trees than that are grown in several jobs a level.
HELD = 256 << 20

BLOCK = "part int, seq int, cells int, codes binary, starts binary, y binary"
MET = "tree int, nodes binary, w binary, s binary"
SPLIT = "tree int, node int, w double, s double, feature int, cut int, gain double, wl double, sl double"

_limits = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 20)]))
#: Draws of a row for each value of 16 random bits.
_DRAWS = np.searchsorted(_limits, (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


@dataclass(frozen=True)
class Layout:
    """Where the bins of each feature lie in a code and in a histogram."""

    wide: list[int]  # features of several cuts
    bins: list[int]  # and their bins
    two: list[int]  # features of one cut
    split: list[int] = field(default_factory=list)  # feature of each column of a histogram; the first column is the node's total
    cut: list[int] = field(default_factory=list)

    @staticmethod
    def of(cuts: Sequence[np.ndarray]) -> Layout:
        wide = [f for f, c in enumerate(cuts) if len(c) > 1]
        two = [f for f, c in enumerate(cuts) if len(c) == 1]
        at = Layout(wide, [len(cuts[f]) + 1 for f in wide], two)
        at.split.append(-1)
        at.cut.append(-1)
        for f, n in zip(at.wide, at.bins, strict=True):
            at.split.extend([f] * n)
            at.cut.extend(range(n))
        at.split.extend(two)
        at.cut.extend([0] * len(two))
        return at

    @property
    def width(self) -> int:
        return len(self.split)

    @property
    def code(self) -> int:
        """Bytes of a row's bins."""
        return len(self.wide) + -(-len(self.two) // 8)


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(name)
    out = column.to_numpy(zero_copy_only=False)
    if column.null_count or np.isnan(out).any():
        raise ValueError(f"{name} has NULL or NaN values, a forest needs numbers")
    return out


def _thinned(values: np.ndarray, n: np.ndarray, points: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``points`` of the sorted values at equal ranks, of the same weight in all."""
    ends = np.cumsum(n)
    at = np.searchsorted(ends, (np.arange(points) + 0.5) * (ends[-1] / points))
    at, times = np.unique(at, return_counts=True)
    return values[at], times * (ends[-1] / points)


def _value_points(names: Sequence[str]):
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0), np.empty(0)) for _ in names]

        def merge(k: int, parts: list[np.ndarray]) -> None:
            v, back = np.unique(np.concatenate([kept[k][0], *parts]), return_inverse=True)
            n = np.concatenate([kept[k][1], np.ones(sum(map(len, parts)))])
            kept[k] = v, np.bincount(back, n, len(v))
            if len(v) > 64 * POINTS:
                kept[k] = _thinned(*kept[k], 8 * POINTS)

        waiting: list[list[np.ndarray]] = [[] for _ in names]
        rows = 0
        for batch in batches:
            rows += batch.num_rows
            for k, name in enumerate(names):
                waiting[k].append(_numbers(batch, name) + 0.0)  # -0.0 is 0.0
            if rows >= BLOCK_ROWS:
                for k in range(len(names)):
                    merge(k, waiting[k])
                waiting, rows = [[] for _ in names], 0
        for k in range(len(names)):
            merge(k, waiting[k])
            v, n = kept[k] if len(kept[k][0]) <= 2 * BINS else _thinned(*kept[k], POINTS)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), k, np.int32)), pa.array(v), pa.array(n)], ["f", "v", "n"])

    return summed


def cut_points(rows: DataFrame, names: Sequence[str]) -> list[np.ndarray]:
    """Cuts between the bins of each feature, from all rows: between all values if they are few, else at equal ranks.

    A task's values are kept as they are if they are no more than twice the
    bins, else as POINTS values at equal ranks: a cut is off by less than one
    POINTS-th of the rows.
    """
    seen = rows.select(*names).mapInArrow(_value_points(names), "f int, v double, n double")
    got = seen.groupBy("f", "v").agg(F.sum("n").alias("n")).toArrow()
    f, v, n = (got.column(c).to_numpy() for c in ("f", "v", "n"))
    out = []
    for k in range(len(names)):
        order = np.argsort(v[f == k])
        values, weight = v[f == k][order], n[f == k][order]
        ends = np.cumsum(weight)[:-1]  # rows up to each gap between two values
        gaps = np.arange(len(ends))
        if len(values) > BINS:
            wanted = np.arange(1, BINS) * (weight.sum() / BINS)
            after = np.clip(np.searchsorted(ends, wanted), 0, len(ends) - 1)
            before = np.maximum(after - 1, 0)
            gaps = np.unique(np.where(wanted - ends[before] < np.abs(ends[after] - wanted), before, after))
        out.append((values[gaps] + values[gaps + 1]) / 2 if len(gaps) else np.empty(0))
    return out


def _binned(names: Sequence[str], label: str, cuts: Sequence[np.ndarray], at: Layout):
    """Rows as (cell, y): the bins of the features, one byte each and a bit for those of two."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            code = np.zeros((n, at.code), np.uint8)
            for k, f in enumerate(at.wide):
                code[:, k] = np.searchsorted(cuts[f], _numbers(batch, names[f]))
            if at.two:
                bits = np.stack([_numbers(batch, names[f]) > cuts[f][0] for f in at.two], axis=1)
                code[:, len(at.wide):] = np.packbits(bits, axis=1)
            ends = pa.py_buffer(np.arange(0, (n + 1) * at.code, at.code, dtype=np.int32) if at.code else np.zeros(n + 1, np.int32))
            cell = pa.Array.from_buffers(pa.binary(), n, [None, ends, pa.py_buffer(code.tobytes())])
            yield pa.RecordBatch.from_arrays([cell, pa.array(_numbers(batch, label))], ["cell", "y"])

    return run


def _blocks(mean: float, width: int):
    """Rows in the order of their cells as blocks: the cells, where each begins, and the labels."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, waiting, rows = TaskContext.get().partitionId(), 0, [], 0

        def block() -> pa.RecordBatch:
            code = np.concatenate([c for c, _ in waiting])
            y = np.concatenate([v for _, v in waiting]) - mean
            new = np.ones(len(y), bool)
            new[1:] = (code[1:] != code[:-1]).any(axis=1)
            starts = np.flatnonzero(new).astype(np.int32)
            values = [part, seq, len(starts), code[starts].tobytes(), starts.tobytes(), y.tobytes()]
            types = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], [c.split()[0] for c in BLOCK.split(", ")])

        for batch in batches:
            if not batch.num_rows:
                continue
            cell = batch.column("cell")
            ends = np.frombuffer(cell.buffers()[1], np.int32)[cell.offset: cell.offset + batch.num_rows + 1]
            raw = cell.buffers()[2]
            code = np.frombuffer(raw, np.uint8)[ends[0]: ends[-1]] if raw is not None else np.empty(0, np.uint8)
            waiting.append((code.reshape(batch.num_rows, width).copy(), batch.column("y").to_numpy(zero_copy_only=False).copy()))
            rows += batch.num_rows
            if rows >= BLOCK_ROWS:
                yield block()
                seq, waiting, rows = seq + 1, [], 0
        if rows:
            yield block()

    return run


def _drawn(seed: int, part: int, seq: int, tree: int, n: int) -> np.ndarray:
    """How often a tree draws each row of a block, the same in every pass."""
    bits = np.random.SFC64([seed, part, seq, tree]).random_raw(-(-n // 4))
    return _DRAWS.take(bits.view(np.uint16)[:n])


def _patterns(bits: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The two-valued features as groups: the pattern of each cell, and (pattern, feature) 1 where it has the lower value.

    One group of the patterns that occur, or groups of PACKED features if they are many.
    """
    def lower(patterns: np.ndarray, n: int) -> np.ndarray:
        return 1.0 - ((patterns[:, None] >> np.arange(n)) & 1)

    def joined(k: int, n: int) -> np.ndarray:
        out = np.zeros(len(bits), np.int64)
        for p in range(n):
            out |= bits[:, k + p].astype(np.int64) << p
        return out

    width = bits.shape[1]
    if 0 < width < 64:
        seen, of = np.unique(joined(0, width), return_inverse=True)
        if len(seen) <= 2 << PACKED:
            return [(of, lower(seen, width))]
    sizes = [min(PACKED, width - k) for k in range(0, width, PACKED)]
    return [(joined(k * PACKED, n), lower(np.arange(1 << n), n)) for k, n in enumerate(sizes)]


def _histograms(at: Layout, seed: int, trees: Sequence[int], feature: np.ndarray, cut: np.ndarray, level: int):
    """Draws and labels per tree, node of the level and bin, summed over the blocks of a task."""
    column = {f: k for k, f in enumerate((*at.wide, *at.two))}
    # in a leaf no bin is over the cut: what came there goes on to the left, to nodes that nobody asks for
    place = np.vectorize(lambda f: column.get(f, 0), otypes=[np.int64])(feature[:, : 1 << level])
    over = np.where(feature[:, : 1 << level] < 0, 255, cut[:, : 1 << level]).astype(np.uint8)
    nodes = first = 1 << level
    asked = feature[:, nodes >> 1: nodes].repeat(2, axis=1) >= 0 if level else np.ones((len(feature), 1), bool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.zeros((len(trees), 2, nodes, at.width))

        def add(batch: pa.RecordBatch, r: int) -> None:
            part, seq, cells = (batch.column(c)[r].as_py() for c in ("part", "seq", "cells"))
            raw, starts, y = (np.frombuffer(batch.column(c)[r].as_buffer(), d) for c, d in (("codes", np.uint8), ("starts", np.int32), ("y", np.float64)))
            code = raw.reshape(cells, at.code)
            bits = np.unpackbits(code[:, len(at.wide):], axis=1, count=len(at.two))
            flat = np.concatenate([code[:, : len(at.wide)], bits, np.zeros((cells, 1), np.uint8)], axis=1)
            base = np.arange(cells) * flat.shape[1]
            flat = np.ascontiguousarray(flat).ravel()
            of = np.repeat(np.arange(cells), np.diff(np.append(starts, len(y))))
            wide = [code[:, k].astype(np.int64) for k in range(len(at.wide))]
            patterns = _patterns(bits)
            key, bin_, limit, beyond = np.empty(cells, np.int64), np.empty(cells, np.uint8), np.empty(cells, np.uint8), np.empty(cells, bool)
            for t, h in zip(trees, met, strict=True):
                w = _drawn(seed, part, seq, t, len(y))
                w, s = np.bincount(of, w, cells), np.bincount(of, w * y, cells)
                node = np.ones(cells, np.int64)
                for _ in range(level):
                    np.take(place[t], node, out=key, mode="clip")
                    np.add(key, base, out=key)
                    np.take(flat, key, out=bin_, mode="clip")
                    np.take(over[t], node, out=limit, mode="clip")
                    np.greater(bin_, limit, out=beyond)
                    np.left_shift(node, 1, out=node)
                    np.add(node, beyond, out=node)
                node -= first
                for k, v in enumerate((w, s)):
                    h[k, :, 0] += np.bincount(node, v, nodes)
                c = 1
                for x, n in zip(wide, at.bins, strict=True):
                    np.add(np.multiply(node, n, out=key), x, out=key)
                    for k, v in enumerate((w, s)):
                        h[k, :, c: c + n] += np.bincount(key, v, nodes * n).reshape(nodes, n)
                    c += n
                for x, lower in patterns:  # draws of the lower value, as for the first bin of the others
                    n, g = lower.shape
                    np.add(np.multiply(node, n, out=key), x, out=key)
                    for k, v in enumerate((w, s)):
                        h[k, :, c: c + g] += np.bincount(key, v, nodes * n).reshape(nodes, n) @ lower
                    c += g

        for batch in batches:
            for r in range(batch.num_rows):
                add(batch, r)
        for t, (w, s) in zip(trees, met, strict=True):
            here = np.flatnonzero(asked[t] & (w[:, 0] > 0))
            if len(here):
                values = [t, (here + first).astype(np.int32).tobytes(), np.rint(w[here]).astype(np.int64).tobytes(), s[here].tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([v], x) for v, x in zip(values, (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)],
                                                 [c.split()[0] for c in MET.split(", ")])

    return run


def _splits(at: Layout, leaf: int):
    """Best split of each node of a tree, from the histograms of all tasks; feature -1 where none leaves both sides ``leaf`` draws."""
    def run(table: pa.Table) -> pa.Table:
        tree = table.column("tree")[0].as_py()
        rows = [[np.frombuffer(x.as_buffer(), d) for x, d in zip(r, (np.int32, np.int64, np.float64), strict=True)]
                for r in zip(*(table.column(c) for c in ("nodes", "w", "s")), strict=True)]
        nodes = np.unique(np.concatenate([n for n, _, _ in rows]))
        w, s = np.zeros((len(nodes), at.width)), np.zeros((len(nodes), at.width))
        # in one order, whatever the order in which tasks ended
        for n, v, u in sorted(rows, key=lambda r: (r[0].tobytes(), r[1].tobytes(), r[2].tobytes())):
            k = np.searchsorted(nodes, n)
            w[k] += v.reshape(len(n), at.width)
            s[k] += u.reshape(len(n), at.width)
        tw, ts = w[:, :1].copy(), s[:, :1].copy()
        c = 1
        for n in at.bins:
            for h in (w, s):
                h[:, c: c + n] = np.cumsum(h[:, c: c + n], axis=1)
            c += n
        with np.errstate(divide="ignore", invalid="ignore"):
            sides = s * s / w + (ts - s) ** 2 / (tw - w)
            gain = sides - ts * ts / tw
        ok = (w >= max(leaf, 1)) & (tw - w >= max(leaf, 1)) & (gain > 1e-12 * sides)
        ok[:, 0] = False
        gain = np.where(ok, gain, -np.inf)
        best, row = gain.argmax(axis=1), np.arange(len(nodes))
        sure = ok[row, best]
        found = {"tree": np.full(len(nodes), tree, np.int32), "node": nodes, "w": tw[:, 0], "s": ts[:, 0],
                 "feature": np.where(sure, np.array(at.split, np.int32)[best], -1).astype(np.int32), "cut": np.array(at.cut, np.int32)[best],
                 "gain": np.where(sure, gain[row, best], 0.0), "wl": w[row, best], "sl": s[row, best]}
        return pa.table({c: pa.array(v) for c, v in found.items()})

    return run


def _grown(blocks: DataFrame, at: Layout, trees: int, depth: int, leaf: int, seed: int) -> dict[str, np.ndarray]:
    """Trees as arrays (tree, node): the children of node i are 2 i and 2 i + 1, the root is 1."""
    size = 2 << depth
    out = {"feature": np.full((trees, size), -1, np.int32), "cut": np.zeros((trees, size), np.int32),
           **{c: np.zeros((trees, size)) for c in ("w", "s", "gain")}}
    growing = list(range(trees))
    for level in range(depth):
        held = max(1, HELD // ((16 << level) * at.width))
        again = []
        for k in range(0, len(growing), held):
            some = growing[k: k + held]
            met = blocks.mapInArrow(_histograms(at, seed, some, out["feature"], out["cut"], level), MET)
            got = met.groupBy("tree").applyInArrow(_splits(at, leaf), SPLIT).toArrow()
            r = {c: got.column(c).to_numpy() for c in got.column_names}
            t, node = r["tree"], r["node"]
            if not level:
                out["w"][t, node], out["s"][t, node] = r["w"], r["s"]
            on = r["feature"] >= 0
            t, node = t[on], node[on]
            for c in ("feature", "cut", "gain"):
                out[c][t, node] = r[c][on]
            out["w"][t, 2 * node], out["s"][t, 2 * node] = r["wl"][on], r["sl"][on]
            out["w"][t, 2 * node + 1], out["s"][t, 2 * node + 1] = r["w"][on] - r["wl"][on], r["s"][on] - r["sl"][on]
            again += sorted(set(t.tolist()))
        growing = again
    return out


def _nodes(grown: dict[str, np.ndarray], cuts: Sequence[np.ndarray], mean: float) -> pa.Table:
    """The trees in Spark's format: nodes in the order of a walk that takes the left side first.

    The spread inside a node is not kept (NaN): predictions and importances do not use it.
    """
    made = {c: [] for c in ("tree", "id", "prediction", "w", "gain", "left", "right", "feature", "cut")}
    for t in range(len(grown["w"])):
        feature, cut, w, s, gain = (grown[c][t].tolist() for c in ("feature", "cut", "w", "s", "gain"))
        begin = len(made["id"])
        stack = [(1, -1, False)]
        while stack:
            node, above, right = stack.pop()
            k = len(made["id"]) - begin
            if above >= 0:
                made["right" if right else "left"][begin + above] = k
            f = feature[node]
            values = (t, k, mean + (s[node] / w[node] if w[node] else 0.0), w[node], gain[node] / w[node] if f >= 0 else -1.0, -1, -1, f,
                      [float(cuts[f][cut[node]])] if f >= 0 else [])
            for c, v in zip(made, values, strict=True):
                made[c].append(v)
            if f >= 0:
                stack += [(2 * node + 1, k, True), (2 * node, k, False)]
    i4, f8, n = pa.int32(), pa.float64(), len(made["id"])
    w = np.array(made["w"])
    stats = pa.ListArray.from_arrays(np.arange(0, 3 * n + 1, 3, dtype=np.int32), np.stack([w, w * np.array(made["prediction"]), np.full(n, np.nan)], axis=1).ravel())
    split = pa.StructArray.from_arrays([pa.array(made["feature"], i4), pa.array(made["cut"], pa.list_(f8)), pa.array([-1] * n, i4)],
                                       ["featureIndex", "leftCategoriesOrThreshold", "numCategories"])
    data = pa.StructArray.from_arrays(
        [pa.array(made["id"], i4), pa.array(made["prediction"], f8), pa.array(np.full(n, np.nan)), stats, pa.array(w.astype(np.int64)),
         pa.array(made["gain"], f8), pa.array(made["left"], i4), pa.array(made["right"], i4), split],
        ["id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild", "split"])
    return pa.table({"treeID": pa.array(made["tree"], i4), "nodeData": data})


def fit(train: DataFrame, assembler: VectorAssembler, forest: RandomForestRegressor) -> PipelineModel:
    """The pipeline of ``assembler`` and ``forest`` fitted to ``train``: numeric features, all of them tried at each split.

    NULL or NaN in a feature or the label is an error, as is a table without rows.
    """
    spark, names, label = train.sparkSession, assembler.getInputCols(), forest.getLabelCol()
    paths = {n: temporary_path(spark, f"forest-{n}") for n in ("rows", "binned", "blocks", "model")}
    try:
        columns = [f"f{k}" for k in range(len(names))]
        rows = train.select(*[F.col(c).cast("double").alias(k) for c, k in zip(names, columns, strict=True)], F.col(label).cast("double").alias("y"))
        rows = temporary(spark, rows, "rows", paths["rows"])
        known = rows.agg(F.count("*").alias("n"), F.avg("y").alias("mean")).first()
        if not known["n"]:
            raise ValueError("a forest needs at least one row")
        cuts = cut_points(rows, columns)
        at = Layout.of(cuts)
        binned = temporary(spark, rows.mapInArrow(_binned(columns, "y", cuts, at), "cell binary, y double"), "binned", paths["binned"])
        tasks = max(min(spark.sparkContext.defaultParallelism, -(-known["n"] // LEAST_ROWS)), -(-known["n"] // TASK_ROWS))
        dealt = binned.repartitionByRange(tasks, "cell", "y") if tasks > 1 else binned.coalesce(1)
        ordered = dealt.sortWithinPartitions("cell", "y")
        blocks = temporary(spark, ordered.mapInArrow(_blocks(known["mean"], at.code), BLOCK), "blocks", paths["blocks"])
        grown = _grown(blocks, at, forest.getNumTrees(), forest.getMaxDepth(), forest.getMinInstancesPerNode(), forest.getSeed())
        return PipelineModel([assembler, _as_spark(spark, _nodes(grown, cuts, known["mean"]), assembler, forest, paths["model"])])
    finally:
        for path in paths.values():
            drop_temporary(spark, path)


def _as_spark(spark: SparkSession, nodes: pa.Table, assembler: VectorAssembler, forest: RandomForestRegressor, path: str) -> RandomForestRegressionModel:
    """A model of Spark with these nodes; one fitted to a single row gives all but the trees."""
    names = (*assembler.getInputCols(), forest.getLabelCol())
    one = spark.createDataFrame([(0.0,) * len(names)], ", ".join(f"`{c}` double" for c in names))
    shell = forest.copy({forest.maxDepth: 0, forest.minInstancesPerNode: 1}).fit(assembler.transform(one))
    shell._set(maxDepth=forest.getMaxDepth(), minInstancesPerNode=forest.getMinInstancesPerNode())
    shell.write().overwrite().save(path)
    spark.createDataFrame(nodes).write.mode("overwrite").parquet(f"{path}/data")
    model = RandomForestRegressionModel.load(path)
    model._forja_nodes = nodes
    return model


# --- scoring ----------------------------------------------------------------


def _stored_nodes(model: RandomForestRegressionModel, spark: SparkSession) -> pa.Table:
    """The trees of a forest of Spark as it stores them."""
    if not hasattr(model, "_forja_nodes"):
        path = temporary_path(spark, "forest-nodes")
        try:
            model.write().overwrite().save(path)
            model._forja_nodes = spark.read.parquet(f"{path}/data").toArrow()
        finally:
            drop_temporary(spark, path)
    return model._forja_nodes


class _Scorer:
    """Mean of the trees for rows of features, in the order in which Spark adds them up.

    Rows are binned by the cuts of the forest; rows of equal bins have one
    result, which is kept (up to KEPT of them), so only new bins walk the trees.
    """

    KEPT, FRESH = 1 << 21, 1 << 16

    def __init__(self, nodes: pa.Table, width: int):
        data = nodes.column("nodeData").combine_chunks()
        get = lambda c: data.field(c).to_numpy(zero_copy_only=False)
        tree, own = nodes.column("treeID").to_numpy(), get("id")
        order = np.lexsort((own, tree))
        split = data.field("split")
        feature = split.field("featureIndex").to_numpy(zero_copy_only=False)[order]
        value = np.full(len(tree), np.nan)
        value[split.field("featureIndex").to_numpy(zero_copy_only=False) >= 0] = split.field("leftCategoriesOrThreshold").flatten().to_numpy(zero_copy_only=False)
        value = value[order]
        self.roots = np.searchsorted(tree[order], np.arange(tree.max() + 1))
        begin = np.repeat(self.roots, np.diff(np.append(self.roots, len(tree))))
        here = np.arange(len(tree))
        inner = feature >= 0
        sides = [np.where(inner, begin + get(c)[order], here) for c in ("leftChild", "rightChild")]
        self.next = np.stack(sides, axis=1).ravel().astype(np.int32)
        self.feature = np.where(inner, feature, 0).astype(np.int64)
        self.value = get("prediction")[order]
        self.cuts = [np.unique(value[feature == f]) for f in range(width)]
        self.cut = np.zeros(len(tree), np.uint16)
        for f, cuts in enumerate(self.cuts):
            self.cut[feature == f] = np.searchsorted(cuts, value[feature == f])
        self.depth, at = 0, np.flatnonzero(inner[self.roots])
        at = self.roots[at]
        while len(at):
            self.depth += 1
            at = np.concatenate([self.next[2 * at], self.next[2 * at + 1]])
            at = at[inner[at]]
        sizes = [len(c) + 1 for c in self.cuts]
        self.radix = [math.prod(sizes[:f]) for f in range(width + 1)]
        self.clear()

    def clear(self) -> None:
        empty = np.empty(0, np.int64), np.empty(0)
        self.main, self.fresh = empty, empty

    def walked(self, code: np.ndarray) -> np.ndarray:
        m, width = code.shape
        flat, base, total = code.ravel(), np.arange(m) * width, np.zeros(m)
        for root in self.roots:
            node = np.full(m, root, np.int64)
            for _ in range(self.depth):
                right = flat.take(base + self.feature.take(node)) > self.cut.take(node)
                node = self.next.take(2 * node + right)
            total += self.value.take(node)
        return total / len(self.roots)

    def __call__(self, columns: Sequence[np.ndarray]) -> np.ndarray:
        code = np.stack([np.searchsorted(c, x) for c, x in zip(self.cuts, columns, strict=True)], axis=1).astype(np.uint16)
        if self.radix[-1] >= 1 << 62:
            return self.walked(code)
        key = sum(code[:, f].astype(np.int64) * r for f, r in enumerate(self.radix[:-1]))
        keys, first, back = np.unique(key, return_index=True, return_inverse=True)
        out, known = np.empty(len(keys)), np.zeros(len(keys), bool)
        for have, value in (self.main, self.fresh):
            if len(have):
                at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
                hit = have[at] == keys
                out[hit], known = value[at[hit]], known | hit
        new = np.flatnonzero(~known)
        if len(new):
            out[new] = self.walked(np.ascontiguousarray(code[first[new]]))
            self.fresh = _merged(self.fresh, (keys[new], out[new]))
            if len(self.fresh[0]) > self.FRESH:
                self.main, self.fresh = _merged(self.main, self.fresh), (np.empty(0, np.int64), np.empty(0))
                if len(self.main[0]) > self.KEPT:
                    self.clear()
        return out[back]


def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, values = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    order = np.argsort(keys, kind="stable")
    return keys[order], values[order]


def predict(model: RandomForestRegressionModel, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """``rows`` plus the forest's prediction, the same numbers as by ``model.transform``.

    NULL or NaN in a feature is an error.
    """
    names = list(features)
    score = _Scorer(_stored_nodes(model, rows.sparkSession), len(names))

    def scored(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            batch = pa.RecordBatch.from_arrays(list(columns) if isinstance(columns, tuple) else [columns], names)
            yield pa.array(score([_numbers(batch, c) for c in names]))

    # not deterministic for the optimizer: a filter on the result would otherwise score every row once more
    udf = F.arrow_udf(scored, "double", F.ArrowUDFType.SCALAR_ITER).asNondeterministic()
    return rows.withColumn(model.getPredictionCol(), udf(*[F.col(f"`{c}`").cast("double") for c in names]))
