"""The last valid operation of each work order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forja.functions.scalar import pieces

TIE_COLUMNS = ("ts_ini", "op_id", "machine_name", "ref_id_str", "piezas_ok", "piezas_scrap")


def last_op_struct(extra: Sequence[str] = ()) -> Column:
    """Sortable record of an operation: a missing end counts as the latest.

    The record carries its own tie-break and payload, so ``max`` of it needs
    no window and is combined on the map side, also for a hot order.
    """
    fields = [F.col("ts_fin").isNull().alias("abierta"), F.col("ts_fin").alias("ts_fin")]
    names = [*TIE_COLUMNS, *[c for c in extra if c not in TIE_COLUMNS]]
    return F.struct(*fields, *[F.col(c) for c in names])


def last_valid_ops(ops: DataFrame, by: Sequence[str] = (), extra: Sequence[str] = ()) -> DataFrame:
    """One row per (by, work order): its latest operation with pieces > 0."""
    keys = [*by, *([] if "work_order_id" in by else ["work_order_id"])]
    valid = ops.where(pieces() > 0).dropna(subset=keys)
    last = valid.groupBy(*keys).agg(F.max(last_op_struct(extra)).alias("__last"))
    names = ["ts_fin", *TIE_COLUMNS, *[c for c in extra if c not in TIE_COLUMNS]]
    return last.select(*keys, *[F.col(f"__last.{c}").alias(c) for c in names if c not in keys])
