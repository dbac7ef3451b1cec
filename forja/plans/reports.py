"""Production, warehouse and labour reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forja.functions import scalar as x
from forja.operators.lastop import last_valid_ops
from forja.operators.ordered import attach_row, top_k

DETAIL_COLUMNS = (
    "work_order_id", "op_id", "ref_id_str", "familia", "cliente", "machine_name", "op_text", "planta",
    "ts_ini", "ts_fin", "duracion_min", "piezas_ok", "piezas_scrap", "scrap_rate", "turno",
)


def _scrap_rate() -> Column:
    return x.ratio(F.col("piezas_scrap"), F.col("piezas_ok") + F.col("piezas_scrap"))


def _sums(*cols: str) -> list[Column]:
    return [F.sum(c).alias(c) for c in cols]


# --- production -------------------------------------------------------------


def production_kpis(fact: DataFrame) -> DataFrame:
    """Final-operation pieces, scrap, pace and kilos; distinct orders and steps.

    Minutes count only events spelled with the accent.
    """
    last = last_valid_ops(fact, extra=["peso_neto_kg"]).agg(
        x.sum0("piezas_ok").cast("bigint").alias("total_ok"),
        x.sum0("piezas_scrap").cast("bigint").alias("total_scrap"),
        x.sum0(F.col("piezas_ok") * F.coalesce("peso_neto_kg", F.lit(0.0))).alias("kg_ok"))
    accented = F.when(F.lower("evento") == x.PRODUCTION_EVENTS[0], F.col("duracion_min"))
    mins = fact.agg(x.sum0(accented).alias("min_produccion"))
    orders = fact.where(F.col("work_order_id").isNotNull()).groupBy("work_order_id").agg(F.lit(1).alias("u"))
    orders = orders.agg(F.count("*").alias("ordenes_activas"))
    steps = fact.where(F.col("op_id").isNotNull()).groupBy("op_id").agg(F.lit(1).alias("u"))
    steps = steps.agg(F.count("*").alias("ops_activas"))
    out = attach_row(last, mins, orders, steps)
    total = F.col("total_ok") + F.col("total_scrap")
    return out.withColumns({
        "scrap_rate": x.ratio(F.col("total_scrap"), total),
        "uph_real": x.ratio(F.col("total_ok"), F.col("min_produccion") / 60),
    })


def daily_volume(ops: DataFrame) -> DataFrame:
    g = ops.where(F.col("fecha").isNotNull()).groupBy("fecha").agg(*_sums("piezas_ok", "piezas_scrap", "duracion_min"))
    return g.withColumn("scrap_rate", _scrap_rate())


def product_mix(fact: DataFrame, k: int = 12) -> DataFrame:
    g = fact.dropna(subset=["ref_id_str", "familia"]).groupBy("ref_id_str", "familia").agg(*_sums("piezas_ok", "piezas_scrap"))
    top = top_k(g, k, F.desc("piezas_ok"), F.col("ref_id_str"), F.col("familia"))
    return top.withColumns({"scrap_rate": _scrap_rate(), "ref_label": x.ref_label("ref_id_str", "familia")})


def machine_pace(ops: DataFrame) -> DataFrame:
    g = ops.where(F.col("machine_name").isNotNull()).groupBy("machine_name").agg(
        *_sums("piezas_ok", "piezas_scrap", "duracion_min"))
    return g.withColumns({"uph_real": x.ratio(60 * F.col("piezas_ok"), F.col("duracion_min")), "scrap_rate": _scrap_rate()})


def scrap_by_machine(ops: DataFrame, k: int = 10) -> DataFrame:
    return top_k(machine_pace(ops), k, F.col("scrap_rate").desc_nulls_last(), F.col("machine_name"))


def scrap_by_reference(ops: DataFrame, k: int = 12) -> DataFrame:
    g = ops.where(F.col("ref_id_str").isNotNull()).groupBy("ref_id_str").agg(
        F.sum("piezas_scrap").alias("piezas_scrap"), F.sum("total_piezas").alias("total"))
    g = g.withColumn("scrap_rate", x.ratio(F.col("piezas_scrap"), F.col("total")))
    return top_k(g, k, F.col("scrap_rate").desc_nulls_last(), F.col("ref_id_str"))


def order_progress(fact: DataFrame, k: int | None = 50) -> DataFrame:
    """Orders against plan, newest start first; ``k`` None keeps all."""
    keys = ["work_order_id", "cliente", "ref_id_str"]
    g = fact.dropna(subset=keys).groupBy(*keys).agg(
        F.max("qty_plan").alias("qty_plan"), *_sums("piezas_ok", "piezas_scrap"),
        F.min("ts_ini").alias("ts_ini"), F.max("ts_fin").alias("ts_fin"))
    g = g.withColumns({"progreso": x.ratio(F.col("piezas_ok"), F.col("qty_plan")), "scrap_rate": _scrap_rate()})
    order = (F.col("ts_ini").desc_nulls_last(), *[F.col(c) for c in keys])
    return g.orderBy(*order) if k is None else top_k(g, k, *order)


def operation_detail(fact: DataFrame) -> DataFrame:
    return fact.select(*DETAIL_COLUMNS)


# --- warehouse --------------------------------------------------------------


def _received(purchases: DataFrame) -> DataFrame:
    return purchases.withColumn("qty_recibida", F.coalesce("qty_recibida", F.lit(0.0)))


def purchase_kpis(purchases: DataFrame) -> DataFrame:
    kg = _received(purchases).agg(x.sum0("qty_recibida").alias("kg_recibidos"))
    lots = purchases.where(F.col("material_lot_id").isNotNull()).groupBy("material_lot_id").agg(F.lit(1).alias("u"))
    out = attach_row(kg, lots.agg(F.count("*").alias("lotes")))
    return out.withColumn("lote_medio_kg", x.ratio0(F.col("kg_recibidos"), F.col("lotes")))


def top_materials(purchases: DataFrame, k: int = 5) -> DataFrame:
    g = _received(purchases).where(F.col("ref_materia_str").isNotNull()).groupBy("ref_materia_str").agg(*_sums("qty_recibida"))
    return top_k(g, k, F.desc("qty_recibida"), F.col("ref_materia_str"))


def receipts_by_day(purchases: DataFrame) -> DataFrame:
    p = _received(purchases).withColumn("fecha", F.col("fecha_recepcion_ts").cast("date"))
    return p.dropna(subset=["fecha", "ref_materia_str"]).groupBy("fecha", "ref_materia_str").agg(*_sums("qty_recibida"))


def lot_map(purchases: DataFrame) -> DataFrame:
    return _received(purchases).where(F.col("qty_recibida") > 0).select(
        "fecha_recepcion_ts", "qty_recibida", "ref_materia_str", "material_lot_id")


def finished_kpis(fact: DataFrame) -> DataFrame:
    kg = F.col("piezas_ok") * F.coalesce("peso_neto_kg", F.lit(0.0))
    by_ref = fact.groupBy("ref_id_str").agg(F.sum("piezas_ok").alias("p"), F.sum(kg).alias("kg"))
    return by_ref.agg(x.sum0("p").alias("piezas_ok"), x.sum0("kg").alias("kg_piezas_ok"),
                      F.count("ref_id_str").alias("refs_activas"))


def top_finished(ops: DataFrame, k: int = 10) -> DataFrame:
    g = ops.where(F.col("ref_id_str").isNotNull()).groupBy("ref_id_str").agg(*_sums("piezas_ok"))
    return top_k(g, k, F.desc("piezas_ok"), F.col("ref_id_str"))


def finished_by_day(ops: DataFrame) -> DataFrame:
    return ops.where(F.col("ts_fin").isNotNull()).groupBy(F.col("ts_fin").cast("date").alias("fecha")).agg(*_sums("piezas_ok"))


# --- labour -----------------------------------------------------------------


def _lost() -> Column:
    return F.col("horas_enfermedad") + F.col("horas_accidente") + F.col("horas_permiso")


def labour_totals(labour: DataFrame) -> DataFrame:
    adjusted = "horas_ajustadas" if "horas_ajustadas" in labour.columns else "horas_teoricas"
    g = labour.agg(*_sums("horas_teoricas", "horas_netas"), F.sum(_lost()).alias("horas_absentismo"), F.sum(adjusted).alias("base"))
    return g.select(
        "horas_teoricas", "horas_netas", "horas_absentismo",
        x.ratio0(F.col("horas_absentismo"), F.col("base")).alias("tasa_absentismo"),
        x.ratio0(F.col("horas_netas"), F.col("horas_teoricas")).alias("tasa_disponibilidad"))


def hours_waterfall(labour: DataFrame) -> DataFrame:
    """Theoretical hours down to net, recomputed from the parts."""
    cols = ("horas_teoricas", "reduccion_tco", "horas_enfermedad", "horas_accidente", "horas_permiso")
    g = labour.agg(*[x.sum0(c).alias(c) for c in cols])
    t, r, e, a, p = (F.col(c) for c in cols)
    bars = [("Teóricas", t), ("TCO (Ajuste)", -r), ("Enfermedad", -e), ("Accidentes", -a), ("Permisos", -p),
            ("Disponibles (Netas)", t - r - e - a - p)]
    items = F.array(*[F.struct(F.lit(i).alias("paso"), F.lit(n).alias("concepto"), v.alias("horas"))
                      for i, (n, v) in enumerate(bars, 1)])
    return g.select(F.explode(items).alias("b")).select("b.*")


def monthly_production(ops: DataFrame) -> DataFrame:
    return ops.where(F.col("ts_ini").isNotNull()).groupBy(x.month_of("ts_ini").alias("año_mes")).agg(
        *_sums("piezas_ok", "duracion_min"))


def labour_by_month(labour: DataFrame, ops: DataFrame) -> DataFrame:
    """Labour months with production, productivity, gap and saturation."""
    j = labour.join(monthly_production(ops), "año_mes", "left").fillna(0)
    hours = F.col("duracion_min") / 60
    net = F.col("horas_netas")
    return j.withColumns({
        "productividad": x.ratio0(F.col("piezas_ok"), net),
        "horas_prod": hours,
        "horas_gap": net - hours,
        "pct_uso": x.ratio0(hours, net),
    })


def total_gap(labour: DataFrame, ops: DataFrame) -> DataFrame:
    return labour_by_month(labour, ops).agg(F.sum("horas_gap").alias("gap_total"))


def absence_long(labour: DataFrame) -> DataFrame:
    return labour.unpivot(["año_mes"], ["horas_enfermedad", "horas_accidente", "horas_permiso"], "tipo", "horas")


def context_summary(fact: DataFrame, orders: DataFrame, labour: DataFrame, purchases: DataFrame) -> DataFrame:
    """One row of figures about what is on screen, all tables together."""
    def distinct(df: DataFrame, c: str, name: str) -> DataFrame:
        return df.where(F.col(c).isNotNull()).groupBy(c).agg(F.lit(1).alias("u")).agg(F.count("*").alias(name))

    prod = fact.agg(x.sum0("piezas_ok").alias("piezas_ok"), x.sum0("piezas_scrap").alias("piezas_scrap"),
                    F.min("ts_ini").alias("periodo_ini"), F.max("ts_fin").alias("periodo_fin"))
    plan = orders.agg(x.sum0("qty_plan").alias("piezas_planificadas"))
    hr = labour.agg(x.sum0("horas_netas").alias("horas_netas"), x.sum0(_lost()).alias("horas_perdidas"))
    buy = purchases.agg(x.sum0("qty_recibida").alias("mp_kg"), F.count("*").alias("mp_lotes"))
    out = attach_row(prod, plan, hr, buy, distinct(fact, "machine_name", "maquinas"), distinct(fact, "ref_id_str", "referencias"),
                 distinct(orders, "work_order_id", "ordenes"), distinct(purchases, "ref_materia_str", "mp_referencias"))
    lost, net = F.col("horas_perdidas"), F.col("horas_netas")
    return out.withColumns({
        "scrap_pct": 100 * x.ratio0(F.col("piezas_scrap"), F.col("piezas_ok") + F.col("piezas_scrap")),
        "tasa_absentismo_pct": 100 * x.ratio0(lost, net + lost),
    })
