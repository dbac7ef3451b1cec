"""Approximate nearest neighbours by learned partitions.

A bounded sample of the vectors gives a neighbour graph, which is cut into
equal parts with few edges between them (recursive halving, each half improved
by swaps).  A small network learns, from a vector, how its neighbours spread
over the parts.  Every row is indexed in its most probable part; a query goes
to its most probable parts until their probability reaches a mass that was
found on the sample, and all rows there are ranked by their exact cosine.
Parts that hold too many rows are divided again, each by a router fitted on a
bounded sample of its own, so a part's size does not grow with the table.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from forja.llm.common import table, written
from forja.llm.registry import register

#: Bound of the sample that the index is fitted on, and the sample rows of a part.
SAMPLE = 8192
PART_ROWS = 256
GRAPH_DEGREE = 10
HIDDEN = 128
#: Share of a sample vector's neighbours that the probed parts are to hold.
COVERAGE = 0.97
EVERY = 50
TOP = 5
#: Rows of a block of candidates and of a block of queries; two blocks meet in one task.
BLOCK = 512
QUERY_BLOCK = 4096
#: Rows beyond which a part is divided again, rows that a task divides at once, and the most routers above a row.
PART_LIMIT = 16_384
DIVIDED = 4096
LEVELS = 8
#: Children of a part are numbered part * FAN + 1, …; a router has fewer than FAN parts.
FAN = 64


def neighbour_graph(x: np.ndarray, degree: int) -> np.ndarray:
    """Indices of the ``degree`` nearest rows of every unit vector, itself left out."""
    out = np.empty((len(x), degree), np.int32)
    for a in range(0, len(x), 1024):
        near = x[a : a + 1024] @ x.T
        near[np.arange(len(near)), np.arange(a, a + len(near))] = -np.inf
        out[a : a + 1024] = np.argpartition(-near, degree - 1, axis=1)[:, :degree]
    return out


def halve(x: np.ndarray, edges: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of ``rows`` (sizes differ by one at most) with few graph edges between them."""
    own = x[rows] - x[rows].mean(axis=0)
    _, vectors = np.linalg.eigh(own.T @ own)
    order = np.argsort(own @ vectors[:, -1], kind="stable")
    side = np.zeros(len(rows), bool)
    side[order[len(rows) // 2 :]] = True
    place = np.full(len(x), -1)
    place[rows] = np.arange(len(rows))
    ends = place[edges[rows]]
    source = np.repeat(np.arange(len(rows)), edges.shape[1])[ends.reshape(-1) >= 0]
    target = ends.reshape(-1)[ends.reshape(-1) >= 0]
    a, b = np.concatenate([source, target]), np.concatenate([target, source])
    best, least = side.copy(), np.inf
    for _ in range(20):
        cut = int((side[a] != side[b]).sum())
        if cut < least:
            best, least = side.copy(), cut
        gain = np.bincount(a, weights=np.where(side[a] != side[b], 1.0, -1.0), minlength=len(rows))
        left, right = np.flatnonzero(~side), np.flatnonzero(side)
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        n = min(len(left), len(right))
        good = int((gain[left[:n]] + gain[right[:n]] > 0).sum())
        if not good:
            break
        swap = max(1, good // 2)  # half of the gainful swaps: neighbours that move together would undo each other
        side[left[:swap]], side[right[:swap]] = True, False
    return rows[~best], rows[best]


@dataclass
class Router:
    """Network from a unit vector to the probabilities of the parts, and the mass to probe."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    mass: float = 1.0

    @property
    def parts(self) -> int:
        return len(self.b2)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def probes(self, x: np.ndarray, sizes: np.ndarray, least: int) -> list[np.ndarray]:
        """The most probable parts of each vector, up to the mass and until they hold ``least`` rows; ``sizes`` are the parts' rows."""
        p = self.probabilities(x)
        order = np.argsort(-p, axis=1, kind="stable")
        reached = np.cumsum(np.take_along_axis(p, order, axis=1), axis=1)
        held = np.cumsum(sizes[order], axis=1)
        counts = np.minimum(((reached < self.mass) | (held < least)).sum(axis=1) + 1, self.parts)
        return [row[:n] for row, n in zip(order, counts, strict=True)]


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def fit(vectors: np.ndarray, coverage: float = COVERAGE) -> Router:
    """Router of a sample of vectors; equal vectors count once, and few vectors make one part."""
    x = np.unique(unit(vectors), axis=0) if len(vectors) else vectors.astype(np.float32)
    width = vectors.shape[1] if vectors.ndim == 2 else 0
    depth = max(0, int(np.log2(max(len(x) / PART_ROWS, 1))))
    parts = 1 << depth
    rng = np.random.default_rng(3)
    w1 = rng.normal(0, np.sqrt(2 / max(width, 1)), (width, HIDDEN)).astype(np.float32)
    net = [w1, np.zeros(HIDDEN, np.float32), np.zeros((HIDDEN, parts), np.float32), np.zeros(parts, np.float32)]
    if parts == 1:
        return Router(*net)
    x = x[rng.permutation(len(x))]
    edges = neighbour_graph(x, GRAPH_DEGREE)
    groups = [np.arange(len(x))]
    for _ in range(depth):
        groups = [half for rows in groups for half in halve(x, edges, rows)]
    part = np.empty(len(x), np.int64)
    for k, rows in enumerate(groups):
        part[rows] = k
    target = np.zeros((len(x), parts), np.float32)
    for j in range(GRAPH_DEGREE):
        np.add.at(target, (np.arange(len(x)), part[edges[:, j]]), 0.5 / GRAPH_DEGREE)
    target[np.arange(len(x)), part] += 0.5
    moment = [(np.zeros_like(p), np.zeros_like(p)) for p in net]
    held = len(x) // 8  # kept back to set the mass
    fitting = np.arange(held, len(x))
    t = 0
    for _ in range(30):
        for rows in np.array_split(rng.permutation(fitting), max(1, len(fitting) // 256)):
            t += 1
            xb = x[rows]
            h = np.maximum(xb @ net[0] + net[1], 0)
            z = h @ net[2] + net[3]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            d = (p / p.sum(axis=1, keepdims=True) - target[rows]) / len(rows)
            back = (d @ net[2].T) * (h > 0)
            for i, g in enumerate((xb.T @ back, back.sum(axis=0), h.T @ d, d.sum(axis=0))):
                m, v = moment[i]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                net[i] -= 0.003 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    router = Router(*net)
    # the smallest mass at which the probed parts hold that coverage of the true neighbours, as rows will be indexed
    indexed = router.probabilities(x).argmax(axis=1)
    p = router.probabilities(x[:held])
    order = np.argsort(-p, axis=1, kind="stable")
    before = np.cumsum(np.take_along_axis(p, order, axis=1), axis=1) - np.take_along_axis(p, order, axis=1)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.broadcast_to(np.arange(parts), order.shape).copy(), axis=1)
    seat = np.take_along_axis(rank, indexed[edges[:held]][:, :TOP], axis=1)
    needed = np.sort(np.take_along_axis(before, seat, axis=1).reshape(-1))
    # a part is probed if the probability before it is below the mass
    router.mass = float(np.nextafter(needed[min(len(needed) - 1, int(np.ceil(coverage * len(needed))))], 2))
    return router


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): rows that can take part, repeated ones once.

    Left out are null ids, and vectors that are null, empty or zero or hold a
    null or non-finite component, or whose length is not the commonest.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = rows.select(F.col(key).alias("id"), F.col(vector).alias("v")).filter(
        F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", finite) & F.exists("v", lambda x: x != 0))
    width = good.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).limit(1).collect()
    return good.filter(F.size("v") == (width[0][0] if width else 0)).dropDuplicates(["id", "v"])


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def children(frame: pd.DataFrame, part: np.ndarray, row: np.ndarray | None = None) -> pd.DataFrame:
    """(id, v, part) of the rows of a frame in the parts given by their place among their parent's."""
    own = frame if row is None else frame.iloc[row]
    return pd.DataFrame({"id": own["id"].to_numpy(), "v": own["v"].to_numpy(), "part": own["part"].to_numpy() * FAN + 1 + part.astype(np.int64)})


def rows_in(frame: pd.DataFrame, router: Router) -> pd.DataFrame:
    """Every row in its most probable part."""
    return children(frame, router.probabilities(unit(np.array(frame["v"].tolist(), np.float64))).argmax(axis=1))


def queries_in(frame: pd.DataFrame, router: Router, sizes: np.ndarray, least: int) -> pd.DataFrame:
    """Every query once for each part to probe."""
    probes = router.probes(unit(np.array(frame["v"].tolist(), np.float64)), sizes, least)
    return children(frame, np.concatenate(probes), np.repeat(np.arange(len(frame)), [len(p) for p in probes]))


def by_router(frame: DataFrame, routers: DataFrame, count: str, schema: str, work) -> DataFrame:
    """``work(rows, router, sizes)`` for slices of the rows of each router's part; ``count`` names the part's rows of this frame."""
    slices = F.ceil(F.greatest(F.col(count), F.lit(1)) / DIVIDED).cast("int")
    left = frame.join(routers.select("part", slices.alias("slices")), "part").withColumn("slice", F.pmod(F.xxhash64("id", "v", F.lit("s")), "slices").cast("int"))
    right = routers.withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1))).select("part", "slice", "router", "sizes")

    def pair(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"id": pd.Series(dtype="int64"), "v": pd.Series(dtype="object"), "part": pd.Series(dtype="int64")})
        return work(rows, pickle.loads(own["router"].iloc[0]), np.array(own["sizes"].iloc[0], np.int64))

    return left.select("id", "v", "part", "slice").groupBy("part", "slice").cogroup(right.groupBy("part", "slice")).applyInPandas(pair, schema)


def sizes_of(routers: DataFrame, index: DataFrame) -> DataFrame:
    """``routers`` with ``sizes``, the rows of each of their parts (fewer than FAN numbers)."""
    held = index.groupBy("part").count().select(
        F.floor((F.col("part") - 1) / FAN).alias("part"), F.struct(F.pmod(F.col("part") - 1, F.lit(FAN)).alias("k"), "count").alias("s"))
    held = held.groupBy("part").agg(F.map_from_entries(F.collect_list("s")).alias("held"))
    sizes = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.coalesce(F.col("held")[k.cast("long")], F.lit(0).cast("long")))
    return routers.drop("sizes").join(held, "part", "left").withColumn("sizes", sizes).drop("held")


def partitioned(rows: DataFrame, queries: DataFrame, sample: int, limit: int, least: int, coverage: float) -> tuple[DataFrame, DataFrame]:
    """(id, v, part) of all rows, in one part each, and of all queries, in each part to probe.

    The root's router is fitted on the first ``sample`` rows by the hash of
    their id, that of a large part on about as many of its rows, chosen by
    hash.  A part whose router knows only one part (of equal vectors, say)
    stays as it is.
    """
    spark = rows.sparkSession
    schema = f"id bigint, v {rows.schema['v'].dataType.simpleString()}, part bigint"
    fitting = [r[0] for r in rows.orderBy(F.xxhash64("id", F.lit(9)), "id").limit(sample).select("v").collect()]
    root = fit(np.array(fitting, dtype=np.float64), coverage)
    shared = spark.sparkContext.broadcast(root)  # (width + parts) x HIDDEN numbers

    def rows_of_root(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield rows_in(f.assign(part=0), shared.value)

    index = written(spark, rows.select("id", "v").mapInPandas(rows_of_root, schema), "index")
    sizes = np.zeros(root.parts, np.int64)
    for part, n in index.groupBy("part").count().collect():  # a row for each part of the root
        sizes[part - 1] = n

    def queries_of_root(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield queries_in(f.assign(part=0), shared.value, sizes, least)

    asked = written(spark, queries.select("id", "v").mapInPandas(queries_of_root, schema), "routed")
    done_index, done_asked = [], []
    for level in range(1, LEVELS):
        large = index.groupBy("part").agg(F.count("*").alias("n")).filter(F.col("n") > limit)
        large = written(spark, large.join(asked.groupBy("part").agg(F.count("*").alias("m")), "part"), "large")
        chance = F.pmod(F.xxhash64("id", "v", F.lit(level)), F.lit(1 << 30)) / float(1 << 30) < float(sample) / F.col("n")
        chosen = index.join(large, "part").filter(chance).select("part", "v")

        def fitted(f: pd.DataFrame) -> pd.DataFrame:
            router = fit(np.array(f["v"].tolist(), np.float64), coverage)
            return pd.DataFrame({"part": [f["part"].iloc[0]], "router": [pickle.dumps(router)], "parts": [router.parts]})

        routers = chosen.groupBy("part").applyInPandas(fitted, "part long, router binary, parts int").filter("parts > 1")
        routers = written(spark, routers.join(large, "part"), "routers")
        if routers.isEmpty():
            break
        divided = routers.select("part")
        done_index.append(index.join(divided, "part", "left_anti").select("id", "v", "part"))
        done_asked.append(asked.join(divided, "part", "left_anti").select("id", "v", "part"))
        index = written(spark, by_router(index, routers.withColumn("sizes", F.array().cast("array<bigint>")), "n", schema, lambda f, r, _: rows_in(f, r)), "index")
        asked = written(spark, by_router(asked, sizes_of(routers, index), "m", schema, lambda f, r, s: queries_in(f, r, s, least)), "routed")
    for frame in done_index:
        index = index.unionByName(frame)
    for frame in done_asked:
        asked = asked.unionByName(frame)
    return index, asked


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that their squares neither overflow nor vanish; cosines stay the same to the bit."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def rank_block(queries: pd.DataFrame, rows: pd.DataFrame, top: int) -> pd.DataFrame:
    """The ``top`` rows of a block for each query of a block, by cosine in double precision, ties to the smaller id."""
    none = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
    if not len(queries) or not len(rows):
        return none
    q, x = (scaled(np.array(f["v"].tolist(), dtype=np.float64)) for f in (queries, rows))
    q_id, x_id = queries["id"].to_numpy(), rows["id"].to_numpy()
    q_norm, x_norm = np.sqrt((q * q).sum(axis=1)), np.sqrt((x * x).sum(axis=1))
    rough = (q / q_norm[:, None]) @ (x / x_norm[:, None]).T
    rough[q_id[:, None] == x_id[None, :]] = -np.inf
    k = min(top, len(x)) - 1
    limit = -np.partition(-rough, k, axis=1)[:, k] - 1e-9
    a, b = np.nonzero((rough >= limit[:, None]) & (rough > -np.inf))
    score = (q[a] * x[b]).sum(axis=1) / (q_norm[a] * x_norm[b])
    order = np.lexsort((x_id[b], -score, a))
    a, b, score = a[order], b[order], score[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    keep = place < top
    return pd.DataFrame({"query_id": q_id[a[keep]], "vec_id": x_id[b[keep]], "score": score[keep]})


def search(rows: DataFrame, queries: DataFrame, top: int = TOP, sample: int = SAMPLE, limit: int = PART_LIMIT) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest rows found for every query; both inputs are (id, v) as ``usable`` makes them.

    Every row but those with the query's own id is a candidate.  A router is
    fitted on about ``sample`` rows, and parts of more than ``limit`` rows have
    routers of their own.  A query goes on to its next parts until they hold
    ``top`` candidates, so it gets fewer only if the table has fewer.  Ties go
    to the smaller id; without rows or queries the result is empty.
    """
    sizes = rows.groupBy("id").agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
    own, total = sizes[0] or 0, sizes[1] or 0
    levels = 1 if total <= limit else 1 + int(np.ceil(np.log(total / limit) / np.log(max(2, sample / PART_ROWS))))
    index, asked = partitioned(rows, queries, sample, limit, top + own, COVERAGE ** (1 / levels))
    parts = index.groupBy("part").agg(F.count("*").alias("n")).join(asked.groupBy("part").agg(F.count("*").alias("m")), "part")
    parts = parts.select("part", F.ceil(F.col("n") / BLOCK).cast("int").alias("rbs"), F.ceil(F.col("m") / QUERY_BLOCK).cast("int").alias("qbs"))
    parts = written(rows.sparkSession, parts, "parts")
    spread = lambda name, n: F.pmod(F.xxhash64("id", "v", F.lit(name)), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(parts, "part").withColumn("qb", spread("q", F.col("qbs"))).withColumn("rb", every("rbs")).drop("rbs", "qbs")
    right = index.join(parts, "part").withColumn("rb", spread("r", F.col("rbs"))).withColumn("qb", every("qbs")).drop("rbs", "qbs")
    keys = ["part", "rb", "qb"]
    best = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        lambda q, x: rank_block(q, x, top), "query_id bigint, vec_id bigint, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", place).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


@register()
def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest vectors of every fiftieth vector."""
    rows = usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return search(rows, rows.filter(F.pmod("id", F.lit(EVERY)) == 0))
