"""Tool-change cycles: counters between changes and time to the next one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forja.functions import scalar as x
from forja.operators.ordered import neighbor, running_totals


def _day(ts: str) -> Column:
    return F.col(ts).cast("date")


def recorded_cutting(ops: DataFrame) -> DataFrame:
    """Cutting operations as recorded; of each machine at least as many as ``cutting_ops`` has."""
    return ops.where(x.has_text("op_id", "TALL") & F.col("machine_id").isNotNull())


def cutting_ops(ops: DataFrame) -> DataFrame:
    """Cutting operations reduced to what the counters need.

    Within one instant of a machine, work comes before the tool change that
    closes its cycle.  All work of an instant is summed before any shuffle;
    tool changes keep their own rows, equal ones as often as recorded.
    """
    change = F.coalesce(F.col("tipo_incidencia") == x.TOOL_CHANGE, F.lit(False))
    tall = recorded_cutting(ops).select(
        "machine_id", "ts_ini", change.alias("es_cambio"),
        F.coalesce("piezas_ok", F.lit(0.0)).alias("ok"), F.coalesce("piezas_scrap", F.lit(0.0)).alias("sc"),
        F.when(change, F.col("machine_name")).alias("machine_name"), F.when(change, F.col("ts_fin")).alias("ts_fin"))
    own = [F.when(F.col("es_cambio"), F.col(c)).alias(f"{c}_cambio") for c in ("ok", "sc")]
    g = tall.groupBy("machine_id", "ts_ini", "es_cambio", "machine_name", "ts_fin", *own).agg(
        F.sum("ok").alias("ok"), F.sum("sc").alias("sc"), F.count("*").alias("n"))
    copies = F.when(F.col("es_cambio"), F.sequence(F.lit(1).cast("bigint"), F.col("n"))).otherwise(F.array(F.lit(1).cast("bigint")))
    g = g.withColumn("copia", F.explode(copies))
    return g.select(
        "machine_id", "machine_name", "ts_ini", "ts_fin", "es_cambio", "copia",
        F.coalesce("ok_cambio", "ok").alias("ok"), F.coalesce("sc_cambio", "sc").alias("sc"),
        F.when(F.col("es_cambio"), F.lit(1).cast("bigint")).otherwise(F.col("n")).alias("n"))


def machine_counters(ops: DataFrame) -> DataFrame:
    """Running pieces, scrap and operations per machine, a day at a time."""
    order = [F.col("ts_ini").asc_nulls_last(), F.col("es_cambio").asc(), F.col("ts_fin").asc_nulls_last(),
             F.col("machine_name").asc(), F.col("ok").asc(), F.col("sc").asc(), F.col("copia").asc()]
    return running_totals(cutting_ops(ops), ["machine_id"], _day("ts_ini"), order,
                          {"cum_piezas": F.col("ok"), "cum_scrap": F.col("sc"), "cum_ops": F.col("n")}, counted=recorded_cutting(ops))


def tool_changes(ops: DataFrame) -> DataFrame:
    """One row per tool change with what was made since the previous one."""
    changes = machine_counters(ops).where("es_cambio")
    cums = ["cum_piezas", "cum_scrap", "cum_ops"]
    c = neighbor(changes, ["machine_id"], _day("ts_ini"), [F.col("cum_ops")], cums, "antes", counted=recorded_cutting(ops))

    def since(name: str) -> Column:
        return F.col(name) - F.coalesce(F.col(f"antes.{name}"), F.lit(0))

    return c.select(
        "machine_id", "machine_name", F.col("ts_ini").alias("ts_cambio"),
        since("cum_piezas").alias("piezas_hasta_cambio"), since("cum_scrap").alias("scrap_hasta_cambio"),
        x.minutes_between("ts_ini", "ts_fin").alias("duracion_cambio_min"), since("cum_ops").alias("ops_hasta_cambio"))


def next_change(changes: DataFrame) -> DataFrame:
    """Changes with the minutes to the next one; a machine's last is dropped."""
    known = changes.where(F.col("ts_cambio").isNotNull())
    order = [F.col("ts_cambio"), F.col("ops_hasta_cambio"), F.col("piezas_hasta_cambio"), F.col("scrap_hasta_cambio"),
             F.coalesce("duracion_cambio_min", F.lit(-1.0))]
    out = neighbor(known, ["machine_id"], F.trunc(_day("ts_cambio"), "MM"), order, ["ts_cambio"], "sig", after=True)
    out = out.withColumns({
        "next_ts": F.col("sig.ts_cambio"),
        "minutes_to_next_change": x.minutes_between("ts_cambio", F.col("sig.ts_cambio")),
    }).drop("sig")
    return out.where(F.col("minutes_to_next_change").isNotNull())


def operation_numbers(ops: DataFrame) -> DataFrame:
    """1-based position of each operation in its machine by start time."""
    order = [F.col("ts_ini").asc_nulls_last(), F.col("ts_fin").asc_nulls_last(), F.col("work_order_id").asc(),
             F.col("op_id").asc(), F.col("piezas_ok").asc(), F.col("piezas_scrap").asc()]
    return running_totals(ops.where(F.col("machine_id").isNotNull()), ["machine_id"], _day("ts_ini"), order,
                          {"num_op": F.lit(1).cast("bigint")})
