"""Mergeable quantile states: sketches stored at a fine grain and merged to any coarser one.

The opt-in companion of ``ordered.quantiles``: a KLL sketch of each group is a
column of its table, so a month, a plant or a year follows from the states of
its days without the fact.  Spark builds and merges them with map-side
combines, and a state holds at most some 3 K values however many rows it saw.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Size of a sketch: groups of at most so many values are exact.
K = 1024
# --- fixed values: published rank error of a KLL sketch of size k, at 99 % confidence ---
ERROR_FACTOR, ERROR_POWER = 2.296, 0.9723
# ----------------------------------------------------------------------------------------


def rank_error(k: int = K) -> float:
    """Share of a group's rows by which a quantile's rank is off at most, with 99 % confidence; merging keeps it."""
    return ERROR_FACTOR / k**ERROR_POWER


def quantile_states(df: DataFrame, keys: Sequence[str], value: str, k: int = K) -> DataFrame:
    """(keys, n, estado): a sketch of ``value`` for each group.

    NULL and NaN values are skipped; a group without any other value has no
    state.  NULL keys are groups.
    """
    v = F.col(value).cast("double")
    usable = df.where(v.isNotNull() & ~F.isnan(v))
    return usable.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(v, F.lit(k)).alias("estado"))


def merged_states(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The states of coarser groups, one row in all without ``keys``; no states give no row."""
    merged = states.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("estado").alias("estado"))
    return merged.where(F.col("n") > 0)


def state_quantiles(states: DataFrame, probs: Mapping[str, float]) -> DataFrame:
    """``states`` with one column for each wanted quantile in place of the sketch.

    A quantile is the smallest seen value with at least that share of the rows
    up to it, within ``rank_error``; exact for groups of at most K values.
    """
    got = {name: F.kll_sketch_get_quantile_double("estado", F.lit(float(p))) for name, p in probs.items()}
    return states.withColumns(got).drop("estado")
