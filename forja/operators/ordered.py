"""Ordered operators that stay parallel when one key holds most of the rows.

A plain ``partitionBy(machine).orderBy(ts)`` window sends every row of a hot
machine to one task.  Here each key is cut into buckets that follow the
order (a day, a month, a score band): windows run inside (key, bucket), and
only one small row per bucket is carried along the whole key.  That costs
several shuffles, so only hot keys take that way: the others are worked on
whole, in one (``split_hot``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys match; the right key columns are dropped."""
    r = right
    for k in keys:
        r = r.withColumnRenamed(k, f"__r_{k}")
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"__r_{k}"])
        cond = c if cond is None else cond & c
    return left.join(r, cond, how).drop(*[f"__r_{k}" for k in keys])


def attach_row(df: DataFrame, *one_row: DataFrame) -> DataFrame:
    """Every row plus the columns of frames that have exactly one row.

    One row is a proven size, so it is broadcast whatever the settings; a
    join on a constant must never be allowed to shuffle.
    """
    out = df.withColumn("__k", F.lit(1))
    for r in one_row:
        out = out.join(F.broadcast(r.withColumn("__k", F.lit(1))), "__k", "left")
    return out.drop("__k")


#: Parts of the key space, and the most rows of a part whose keys are worked on whole, each in one task.
PARTS, PART_ROWS = 1 << 16, 1 << 17


def key_part(keys: Sequence[str]) -> Column:
    """The part of the key space a key lies in (NULL is a value like others)."""
    return F.pmod(F.xxhash64(*keys), F.lit(PARTS))


def split_hot(df: DataFrame, keys: Sequence[str], counted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows of light keys, rows of hot ones): a key is hot if its part of the key space has over PART_ROWS rows.

    The hot parts, at most PARTS numbers, are broadcast; no row is shuffled.
    ``counted`` is a frame that has at least as many rows of each key and is
    cheaper to read.
    """
    sizes = (df if counted is None else counted).groupBy(key_part(keys).alias("__p")).agg(F.count("*").alias("__n"))
    hot = F.broadcast(sizes.where(F.col("__n") > PART_ROWS).select("__p"))
    marked = df.withColumn("__p", key_part(keys))
    return marked.join(hot, "__p", "left_anti").drop("__p"), marked.join(hot, "__p", "left_semi").drop("__p")


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    totals: Mapping[str, Column],
    counted: DataFrame | None = None,
) -> DataFrame:
    """Add running totals per ``keys`` in the order (bucket, *order).

    ``bucket`` must not decrease along the order (NULL last).  Buckets per
    key are few: they are the only rows a hot key puts into one task.
    ``counted``: see ``split_hot``.
    """
    if not keys:
        return _bucket_totals(df, keys, bucket, order, totals)
    light, hot = split_hot(df, keys, counted)
    upto = W.partitionBy(*keys).orderBy(bucket.asc_nulls_last(), *order).rowsBetween(W.unboundedPreceding, 0)
    whole = light.withColumns({n: F.sum(c).over(upto) for n, c in totals.items()})
    return whole.unionByName(_bucket_totals(hot, keys, bucket, order, totals))


def _bucket_totals(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], totals: Mapping[str, Column]) -> DataFrame:
    """``running_totals`` by windows inside (key, bucket) and one row per bucket along the key."""
    keyed = df.withColumns({"__b": bucket, **{f"__v_{n}": c for n, c in totals.items()}})
    inside = W.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = keyed.withColumns({f"__l_{n}": F.sum(f"__v_{n}").over(inside) for n in totals})
    sizes = keyed.groupBy(*keys, "__b").agg(*[F.sum(f"__v_{n}").alias(f"__s_{n}") for n in totals])
    before = W.partitionBy(*keys).orderBy(F.col("__b").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys, "__b",
        *[F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in totals],
    )
    out = join_null_safe(local, offsets, [*keys, "__b"])
    out = out.withColumns({n: F.col(f"__l_{n}") + F.col(f"__o_{n}") for n in totals})
    return out.drop("__b", *[f"__{p}_{n}" for n in totals for p in "vlo"])


def row_numbers(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column],
                name: str = "rn") -> DataFrame:
    """1-based position of each row in its key."""
    return running_totals(df, keys, bucket, order, {name: F.lit(1).cast("long")})


def neighbor(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column],
             cols: Sequence[str], name: str, after: bool = False, counted: DataFrame | None = None) -> DataFrame:
    """Add struct ``name`` of ``cols`` from the previous (or next) row of the key.

    Like lag/lead over the whole key, but for a hot key the window runs inside
    (key, bucket); only the edge row of each bucket travels along the key.
    NULL where there is no such row.  ``order`` must be total and without
    NULLs.  ``counted``: see ``split_hot``.
    """
    if not keys:
        return _bucket_neighbor(df, keys, bucket, order, cols, name, after)
    light, hot = split_hot(df, keys, counted)
    along = W.partitionBy(*keys).orderBy(bucket.asc_nulls_last(), *order)
    whole = light.withColumn(name, (F.lead if after else F.lag)(F.struct(*cols), 1).over(along))
    return whole.unionByName(_bucket_neighbor(hot, keys, bucket, order, cols, name, after))


def _bucket_neighbor(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column],
                     cols: Sequence[str], name: str, after: bool) -> DataFrame:
    """``neighbor`` by windows inside (key, bucket) and the edge row of each bucket."""
    rec, pos = F.struct(*cols), F.struct(*order)
    keyed = df.withColumn("__b", bucket)
    inside = W.partitionBy(*keys, "__b").orderBy(*order)
    local = keyed.withColumn("__near", (F.lead if after else F.lag)(rec, 1).over(inside))
    edge = (F.min_by if after else F.max_by)(rec, pos)
    edges = keyed.groupBy(*keys, "__b").agg(edge.alias("__e"))
    along = W.partitionBy(*keys).orderBy(F.col("__b").asc_nulls_last())
    edges = edges.select(*keys, "__b", (F.lead if after else F.lag)("__e", 1).over(along).alias("__far"))
    out = join_null_safe(local, edges, [*keys, "__b"])
    return out.withColumn(name, F.coalesce("__near", "__far")).drop("__b", "__near", "__far")


def value_bucket(value: Column, per_doubling: int = 256) -> Column:
    """Order-preserving band of a number, finer near zero (about 0.3 % wide by default)."""
    band = F.floor(F.log2(1 + F.abs(value)) * per_doubling)
    return F.when(value < 0, -band).otherwise(band)


def _wanted(rows: DataFrame, within: Sequence[str], band: str, probs: Mapping[str, float]) -> DataFrame:
    """(within, band, __start, __tot) of the bands of ``rows`` that hold a wanted rank.

    ``rows`` carry ``__n`` and, for their group, ``__from`` (rows before it in
    the key) and ``__tot`` (rows of the key).
    """
    sizes = rows.groupBy(*within, band).agg(F.sum("__n").alias("__bn"), F.max("__from").alias("__from"), F.max("__tot").alias("__tot"))
    upto = W.partitionBy(*within).orderBy(band).rowsBetween(W.unboundedPreceding, 0)
    bands = sizes.withColumn("__end", F.sum("__bn").over(upto) + F.col("__from"))
    bands = bands.withColumn("__start", F.col("__end") - F.col("__bn"))
    hit = F.lit(False)
    for p in probs.values():
        for r in (_low(p), _high(p)):
            hit = hit | ((r >= F.col("__start")) & (r < F.col("__end")))
    return bands.where(hit).select(*within, band, "__start", "__tot")


def _position(p: float) -> Column:
    return F.lit(float(p)) * (F.col("__tot") - 1)


def _low(p: float) -> Column:
    return F.floor(_position(p))


def _high(p: float) -> Column:
    return F.ceil(_position(p))


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    weight: str | None = None,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Exact linear-interpolation quantiles per key, one row per key.

    A light key is one aggregate with a map-side combine, a hot one takes
    ``band_quantiles``, so no task ever holds all values of a hot key, and the
    plan is the same at every size.  NULL values are skipped.  ``counted``:
    see ``split_hot``.
    """
    keys = list(keys)
    if not keys:
        return band_quantiles(df, keys, value, probs, weight)
    light, hot = split_hot(df.where(F.col(value).isNotNull()), keys, counted)
    whole = light.groupBy(*keys).agg(percentiles(value, probs, weight).alias("__q")).select(*keys, *picked_percentiles("__q", probs))
    return whole.unionByName(band_quantiles(hot, keys, value, probs, weight))


def percentiles(value: str, probs: Mapping[str, float], weight: str | None = None) -> Column:
    """Exact quantiles as one aggregate, an array: its state holds the different values of the group."""
    return F.percentile(F.col(value), [float(p) for p in probs.values()], *([F.col(weight)] if weight else []))


def picked_percentiles(column: str, probs: Mapping[str, float]) -> list[Column]:
    """The array of ``percentiles`` as a column per name."""
    return [F.col(column)[i].alias(name) for i, name in enumerate(probs)]


def band_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], weight: str | None = None) -> DataFrame:
    """``quantiles`` of keys with any number of rows.

    Equal values are merged by a map-side combine, the ranks wanted are
    located among band totals, the bands that hold such a rank are cut again
    into bands 65,536 times finer, and only those that hold one are sorted.
    """
    keys = list(keys)
    n = F.sum(weight) if weight else F.count(F.lit(1))
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(n.alias("__n"))
    counts = counts.withColumns({"__b": value_bucket(F.col(value)), "__f": value_bucket(F.col(value), 256 << 16)})
    bands = counts.groupBy(*keys, "__b").agg(F.sum("__n").alias("__n"))
    totals = bands.withColumns({"__tot": F.sum("__n").over(W.partitionBy(*keys)), "__from": F.lit(0)})
    coarse = _wanted(totals, keys, "__b", probs).withColumnRenamed("__start", "__from")
    near = join_null_safe(counts, coarse, [*keys, "__b"])
    fine = _wanted(near, [*keys, "__b"], "__f", probs).drop("__tot")
    near = join_null_safe(near, fine, [*keys, "__b", "__f"])
    inside = W.partitionBy(*keys, "__b", "__f").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    near = near.withColumn("__hi", F.sum("__n").over(inside) + F.col("__start"))
    near = near.withColumn("__lo", F.col("__hi") - F.col("__n"))

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("__lo")) & (rank < F.col("__hi")), F.col(value)))

    aggs = [F.max("__tot").alias("__tot")]
    for name, p in probs.items():
        aggs += [at(_low(p)).alias(f"__a_{name}"), at(_high(p)).alias(f"__z_{name}")]
    picked = near.groupBy(*keys).agg(*aggs)
    outs = []
    for name, p in probs.items():
        a, z = F.col(f"__a_{name}"), F.col(f"__z_{name}")
        outs.append((a + (z - a) * (_position(p) - _low(p))).alias(name))
    return picked.select(*keys, *outs)


def join_spread(left: DataFrame, right: DataFrame, keys: Sequence[str], pieces: int = 16, deal: Sequence[str] = ()) -> DataFrame:
    """Left join with a small unique right side; rows of a hot (or NULL) key are dealt over ``pieces`` tasks.

    The right side is repeated ``pieces`` times, so it should be an aggregate
    or a dimension, much smaller than the left one.  NULL keys match as groups.
    ``deal`` names the columns that deal the rows (by default all), so that no others need be read.
    """
    dealt = left.withColumn("__s", F.pmod(F.xxhash64(*(deal or left.columns)), F.lit(pieces)).cast("int"))
    copies = right.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
    return join_null_safe(dealt, copies, [*keys, "__s"], "left").drop("__s")


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The k first rows of a report; ``order`` must end in a unique column."""
    return df.orderBy(*order).limit(k)
