"""From recorded tables to clean ones: ids, types, NULLs, derived columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forja.functions import scalar as x
from forja.operators.ordered import attach_row


def conform_refs(raw: DataFrame) -> DataFrame:
    return raw.withColumns({
        "ref_id_str": x.norm_ref("ref_id"),
        "peso_neto_kg": F.col("peso_neto_kg").cast("double"),
    })


def conform_rates(raw: DataFrame) -> DataFrame:
    """Rates per (reference, machine); tolerates files with fewer columns.

    Both sides of the rate join use the same normalised id, and a pair listed
    twice keeps its highest rate, so the join can never multiply operations.
    """
    have = set(raw.columns)
    ref = F.col("ref_id_str") if "ref_id_str" in have else F.lit(None).cast("string")
    if "ref_id" in have:
        ref = F.coalesce(ref, F.col("ref_id").cast("string"))
    machine = F.coalesce(F.col("machine_name"), F.lit("")) if "machine_name" in have else F.lit("")
    rate = F.col("piezas_hora_teorico").cast("double") if "piezas_hora_teorico" in have else F.lit(None).cast("double")
    if "ciclo_teorico_seg" in have:
        from_cycle = x.ratio0(F.lit(3600.0), F.col("ciclo_teorico_seg").cast("double"))
        rate = F.coalesce(rate, from_cycle)
    if "piezas_hora_teorico" not in have:
        rate = F.coalesce(rate, F.lit(0.0))
    out = raw.select(x.norm_ref(ref).alias("ref_id_str"), machine.alias("machine_name"), rate.alias("piezas_hora_teorico"))
    return out.groupBy("ref_id_str", "machine_name").agg(F.max("piezas_hora_teorico").alias("piezas_hora_teorico"))


def default_rates(refs: DataFrame) -> DataFrame:
    """Zero rates per reference, used when there is no rate file."""
    return refs.select("ref_id_str").distinct().select(
        "ref_id_str", F.lit("").alias("machine_name"), F.lit(0.0).alias("piezas_hora_teorico"))


def fallback_rates(rates: DataFrame, ops: DataFrame) -> DataFrame:
    """``rates``, or zero rates for every produced pair if none names a machine."""
    named = rates.where(F.col("machine_name") != "").limit(1).agg(F.count("*").alias("__n"))
    pairs = ops.select("ref_id_str", "machine_name").dropna().distinct()
    pairs = pairs.select("ref_id_str", "machine_name", F.lit(0.0).alias("piezas_hora_teorico"))
    tagged = rates.withColumn("__from", F.lit("rates")).unionByName(pairs.withColumn("__from", F.lit("pairs")))
    choice = named.select(F.when(F.col("__n") > 0, "rates").otherwise("pairs").alias("__pick"))
    return attach_row(tagged, choice).where(F.col("__from") == F.col("__pick")).select(
        "ref_id_str", "machine_name", "piezas_hora_teorico")


def conform_orders(raw: DataFrame) -> DataFrame:
    out = raw.withColumnRenamed("familia", "familia_of")
    return out.withColumns({
        "ref_id_str": x.norm_ref("ref_id"),
        "fecha_lanzamiento": x.to_ts("fecha_lanzamiento"),
        "due_date": x.to_date("due_date"),
        "qty_plan": F.col("qty_plan").cast("bigint"),
    })


def unique_orders(orders: DataFrame) -> DataFrame:
    """One row per (order, reference): the header with the largest plan."""
    record = F.struct("qty_plan", "cliente", "planta_inicio", "familia_of", "fecha_lanzamiento")
    best = orders.groupBy("work_order_id", "ref_id_str").agg(F.max(record).alias("h"))
    return best.select("work_order_id", "ref_id_str", "h.*")


def conform_ops(raw: DataFrame) -> DataFrame:
    """Clean operations: typed times, numeric NULLs are 0, state and shift known."""
    types = dict(raw.dtypes)
    num = {c: x.to_number0(c) if types[c] == "string" else F.coalesce(F.col(c), F.lit(0.0))
           for c in ("duracion_min", "piezas_ok", "piezas_scrap")}
    start = x.to_ts("ts_ini") if types["ts_ini"] == "string" else F.col("ts_ini")
    end = x.to_ts("ts_fin") if types["ts_fin"] == "string" else F.col("ts_fin")
    return raw.withColumns({
        "ref_id_str": x.norm_ref("ref_id"),
        "ts_ini": start,
        "ts_fin": end,
        **num,
        "total_piezas": num["piezas_ok"] + num["piezas_scrap"],
        "estado": x.state_of("evento"),
        "fecha": start.cast("date"),
        "turno": x.shift_of(start),
    })


def conform_purchases(raw: DataFrame) -> DataFrame:
    return raw.withColumns({
        "ref_materia_str": x.norm_ref("ref_materia"),
        "fecha_recepcion_ts": x.to_ts("fecha_recepcion_ts"),
        "qty_recibida": F.col("qty_recibida").cast("string").try_cast("double"),
    })


def conform_stock(raw: DataFrame) -> DataFrame:
    return raw.withColumns({"item_ref_id_str": x.norm_ref("item_ref_id"), "fecha_ts": x.to_ts("fecha_ts")})


def conform_labour(raw: DataFrame) -> DataFrame:
    month = F.concat(F.btrim(F.col("año_mes")), F.lit("-01"))
    return raw.withColumn("año_mes", x.to_date(month))
