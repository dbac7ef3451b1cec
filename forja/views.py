"""Shop-floor tables derived from the order/line-item test tables.

The production fact, work orders, rates, references, purchases, stock
movements and labour months all come from whole tables; every plan then
works on them exactly as it would on factory files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REFS = 40  # catalogue size of the derived data
LINE_PHASES = ("CURV10", "TALL20", "TALL30", "SOLD40", "TEMP50", "RECT60")
EVENTS = ("Preparación", "PREPARACION", "Incidencia", None, "PRODUCCION", *["Producción"] * 5)
PHASES = (*LINE_PHASES, "Control final", "Producción", "PRODUCCION", "Preparación", "PREPARACION")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _order_id(c: str) -> Column:
    return F.lpad(F.col(c).cast("string"), 12, "0")


def _machine(c: str) -> Column:
    return F.concat(F.lit("M"), F.lpad(F.col(c).cast("string"), 8, "0"))


def raw_ops(spark: SparkSession, sf_dir: str, plant: DataFrame | None = None) -> DataFrame:
    """Production operations as recorded: ids unpadded, NULLs kept; ``plant`` (see ``plants``) adds the plant of the machine."""
    li = table(spark, sf_dir, "lineitem")
    k, line, sup, s = (F.col(c) for c in ("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey"))
    m = 1 + F.floor(F.col("l_extendedprice") / 1000)
    q, d, t = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    scrap = F.floor(q * d * 10).cast("double")
    no_count = (t == 0) & (s % 2 == 0)
    incident = (s % 10).isin(2, 3)

    def minutes(n: Column) -> Column:
        return F.make_dt_interval(F.lit(0), F.lit(0), n.cast("int"), F.lit(0))

    phase = F.element_at(F.array(*[F.lit(p) for p in LINE_PHASES], F.lit(None)), line)
    out = li.select(
        _order_id("l_orderkey").alias("work_order_id"),
        (k % REFS).cast("string").alias("ref_id"),
        F.when(s % 4 != 0, F.concat(F.lit("L"), s.cast("string"))).alias("material_lot_id"),
        phase.alias("op_id"),
        F.when((line == 7) & (s % 2 == 0), " Control final ").alias("op_text"),
        sup.alias("machine_id"),
        _machine("l_suppkey").alias("machine_name"),
        F.element_at(F.array(*[F.lit(e) for e in EVENTS]), (s % 10 + 1).cast("int")).alias("evento"),
        F.when(incident & line.isin(2, 3) & (sup % 2 == 0), "CAMBIO DE FRESA")
        .when(incident, F.concat(F.lit("AVERIA "), (s % 7).cast("string"))).alias("tipo_incidencia"),
        F.when(s % 6 != 0, F.concat(F.lit("OP"), (s % 50).cast("string"))).alias("operario_nombre"),
        (F.col("l_shipdate") + minutes((s * 7 + line) % 1440)).alias("ts_ini"),
        F.when(k % 97 != 0, F.col("l_shipdate") + minutes((s * 7 + line) % 1440 + m)).alias("ts_fin"),
        F.when(s % 101 != 0, F.when(t == 0.08, m * 60).otherwise(m)).cast("double").alias("duracion_min"),
        F.when(no_count, None).when(t == 0, 0.0).otherwise(q * 10 - scrap).alias("piezas_ok"),
        F.when(no_count, None).when(t == 0, 0.0).otherwise(scrap).alias("piezas_scrap"),
    )
    if plant is None:
        return out
    return out.join(plant, "machine_id", "left")


def plants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """machine_id -> plant (the region of its maker)."""
    sup = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("machine_id"), "s_nationkey")
    nat = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
    reg = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("planta"))
    return sup.join(nat, "s_nationkey").join(reg, "n_regionkey").select("machine_id", "planta")


def raw_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    r = F.col("p_partkey") % REFS
    g = p.groupBy(r.alias("r")).agg(F.min("p_type").alias("f"), F.max("p_size").alias("w"), F.count("*").alias("n"))
    return g.select(
        F.col("r").cast("string").alias("ref_id"),
        F.when(F.col("r") % 9 != 4, F.col("f")).alias("familia"),
        ((F.col("w") + F.col("n") % 7) / F.lit(10.0)).alias("peso_neto_kg"),
    )


def raw_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    sup = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("m"))
    pairs = sup.select("m", F.explode(F.sequence(F.lit(0), F.lit(REFS - 1))).alias("r"))
    pairs = pairs.where((F.col("r") + F.col("m")) % 2 == 0)
    return pairs.select(
        F.col("r").cast("string").alias("ref_id"),
        _machine("m").alias("machine_name"),
        (60 + (F.col("r") * 7 + F.col("m")) % 200).cast("double").alias("piezas_hora_teorico"),
    )


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    k = F.col("o_orderkey")
    return o.join(c, "o_custkey", "left").select(
        _order_id("o_orderkey").alias("work_order_id"),
        ((k + F.when(k % 17 == 3, 1).otherwise(0)) % REFS).cast("string").alias("ref_id"),
        F.when(k % 5 != 0, F.concat(F.lit("FAM "), (k % 6).cast("string"))).alias("familia"),
        F.col("c_mktsegment").alias("cliente"),
        F.when(k % 13 != 0, F.floor(F.col("o_totalprice") / 100)).cast("bigint").alias("qty_plan"),
        F.col("o_orderdate").alias("fecha_lanzamiento"),
        F.lit("PENDING").alias("due_date"),
        F.lit("PENDING").alias("planta_inicio"),
    )


def raw_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where(F.col("event_type") == "purchase")
    i = F.col("event_id")
    return e.select(
        F.concat(F.lit("L"), (i - i % 3).cast("string")).alias("material_lot_id"),
        F.col("user_id").cast("string").alias("ref_materia"),
        F.when(i % 50 != 3, F.col("value")).alias("qty_recibida"),
        F.col("ts").alias("fecha_recepcion_ts"),
    )


def raw_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("signup", "click"))
    return e.select(
        (F.col("user_id") % REFS).cast("string").alias("item_ref_id"),
        F.col("ts").alias("fecha_ts"),
        F.when(F.col("event_type") == "signup", "IN").otherwise("OUT").alias("movimiento"),
        F.col("value").alias("cantidad"),
    )


def raw_labour(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    n = F.col("n")
    g = o.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("año_mes")).agg(F.count("*").alias("n"))
    g = g.select(
        "año_mes", (160 * (1 + n % 50)).alias("horas_teoricas"), (8 * (n % 5)).alias("reduccion_tco"),
        (n % 23).alias("horas_enfermedad"), (n % 7).alias("horas_accidente"), (n % 11).alias("horas_permiso"),
    )
    lost = F.col("horas_enfermedad") + F.col("horas_accidente") + F.col("horas_permiso")
    adj = F.col("horas_teoricas") - F.col("reduccion_tco")
    return g.select(
        "año_mes", "horas_teoricas", "reduccion_tco", adj.alias("horas_ajustadas"),
        "horas_enfermedad", "horas_accidente", "horas_permiso", (adj - lost).alias("horas_netas"),
    )
