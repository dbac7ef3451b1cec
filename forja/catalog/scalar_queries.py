"""Scalar rules, filters, scans and audits."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from forja import views
from forja.catalog import inputs as i
from forja.catalog.base import last_op_sql, register
from forja.functions import scalar as x
from forja.operators.ordered import quantiles
from forja.operators.states import merged_states, quantile_states, rank_error, state_quantiles
from forja.plans import fact as pf
from forja.plans import quality as q
from forja.sources import conform

# --- scans over the derived tables ------------------------------------------


@register("S1_refs", ("refs",), "SELECT ref_id, ref_id_str, familia, peso_neto_kg FROM refs")
def s1(spark, sf):
    return conform.conform_refs(views.raw_refs(spark, sf)).select("ref_id", "ref_id_str", "familia", "peso_neto_kg")


@register("S2_rates", ("rates",), "SELECT ref_id_str, machine_name, piezas_hora_teorico FROM rates")
def s2(spark, sf):
    return conform.conform_rates(views.raw_rates(spark, sf))


@register("S2_default_rates", ("refs",), "SELECT DISTINCT ref_id_str, '' AS machine_name, 0.0::DOUBLE AS piezas_hora_teorico FROM refs")
def s2b(spark, sf):
    return conform.default_rates(i.refs(spark, sf))


@register("S3_fallback_rates", ("ops",), """
    SELECT DISTINCT ref_id_str, machine_name, 0.0::DOUBLE AS piezas_hora_teorico FROM ops WHERE machine_name IS NOT NULL""")
def s3(spark, sf):
    return conform.fallback_rates(conform.default_rates(i.refs(spark, sf)), i.ops(spark, sf))


@register("S4_orders", ("orders_h",), """
    SELECT work_order_id, ref_id_str, familia_of, cliente, qty_plan, fecha_lanzamiento, CAST(NULL AS DATE) AS due_date FROM orders_h""")
def s4(spark, sf):
    return conform.conform_orders(views.raw_orders(spark, sf)).select(
        "work_order_id", "ref_id_str", "familia_of", "cliente", "qty_plan", "fecha_lanzamiento", "due_date")


@register("S5_operations", ("ops",), """
    SELECT work_order_id, ref_id_str, op_id, machine_name, evento, ts_ini, ts_fin, duracion_min, piezas_ok, piezas_scrap FROM ops""")
def s5(spark, sf):
    return conform.conform_ops(views.raw_ops(spark, sf)).select(
        "work_order_id", "ref_id_str", "op_id", "machine_name", "evento", "ts_ini", "ts_fin", "duracion_min", "piezas_ok", "piezas_scrap")


@register("S6_purchases", ("compras",), "SELECT material_lot_id, ref_materia_str, qty_recibida, fecha_recepcion_ts FROM compras")
def s6(spark, sf):
    return conform.conform_purchases(views.raw_purchases(spark, sf)).select(
        "material_lot_id", "ref_materia_str", "qty_recibida", "fecha_recepcion_ts")


@register("S7_stock", ("almacen",), "SELECT item_ref_id_str, fecha_ts, movimiento, cantidad FROM almacen")
def s7(spark, sf):
    return conform.conform_stock(views.raw_stock(spark, sf)).select("item_ref_id_str", "fecha_ts", "movimiento", "cantidad")


@register("S8_labour", ("rrhh",), 'SELECT * FROM rrhh')
def s8(spark, sf):
    return conform.conform_labour(views.raw_labour(spark, sf))


@register("S10_text_ids", ("raw_ops",), """
    SELECT work_order_id, ref_id, material_lot_id, CAST(machine_id AS VARCHAR) AS machine_id, count(*) AS n FROM raw_ops GROUP BY ALL""")
def s10(spark, sf):
    ids = ["work_order_id", "ref_id", "material_lot_id", "machine_id"]
    return i.raw_ops(spark, sf).select(*[F.col(c).cast("string").alias(c) for c in ids]).groupBy(*ids).agg(F.count("*").alias("n"))


@register("S14_date_bounds", ("ops", "almacen", "compras"), """
    SELECT CAST(min(a) AS DATE) AS fecha_min, CAST(max(b) AS DATE) AS fecha_max FROM (
    SELECT least(min(ts_ini), min(ts_fin)) AS a, greatest(max(ts_ini), max(ts_fin)) AS b FROM ops
    UNION ALL SELECT min(fecha_ts), max(fecha_ts) FROM almacen
    UNION ALL SELECT min(fecha_recepcion_ts), max(fecha_recepcion_ts) FROM compras)""")
def s14(spark, sf):
    return pf.date_bounds(i.ops(spark, sf), i.stock(spark, sf), i.purchases(spark, sf))


# --- scalar rules -----------------------------------------------------------


@register("P1_norm_ref", (), """
    SELECT DISTINCT t AS ref_id, lpad(regexp_replace(t, '\\.0$', ''), CAST(greatest(6, length(regexp_replace(t, '\\.0$', ''))) AS INTEGER), '0') AS ref_id_str
    FROM (SELECT CAST(l_partkey AS VARCHAR) || CASE WHEN l_linenumber % 2 = 0 THEN '.0' WHEN l_linenumber = 7 THEN 'GJ1000' ELSE '' END AS t FROM lineitem)""")
def p1(spark, sf):
    line = F.col("l_linenumber")
    tail = F.when(line % 2 == 0, ".0").when(line == 7, "GJ1000").otherwise("")
    t = views.table(spark, sf, "lineitem").select(F.concat(F.col("l_partkey").cast("string"), tail).alias("ref_id")).distinct()
    return t.withColumn("ref_id_str", x.norm_ref("ref_id"))


@register("P2_shift", ("ops",), "SELECT turno, hour(ts_ini) AS hora, count(*) AS n FROM ops GROUP BY 1, 2")
def p2(spark, sf):
    return i.raw_ops(spark, sf).groupBy(x.shift_of("ts_ini").alias("turno"), F.hour("ts_ini").cast("bigint").alias("hora")).agg(F.count("*").alias("n"))


@register("P3_state", ("ops",), "SELECT evento, estado, count(*) AS n FROM ops GROUP BY 1, 2")
def p3(spark, sf):
    return i.raw_ops(spark, sf).groupBy("evento", x.state_of("evento").alias("estado")).agg(F.count("*").alias("n"))


@register("P4_safe_ratio", ("ops",), """
    SELECT work_order_id, machine_name, sum(piezas_scrap) AS s, CASE WHEN sum(total_piezas) > 0 THEN sum(piezas_scrap)/sum(total_piezas) END AS scrap_rate
    FROM ops GROUP BY 1, 2""")
def p4(spark, sf):
    return i.ops(spark, sf).groupBy("work_order_id", "machine_name").agg(
        F.sum("piezas_scrap").alias("s"), x.ratio(F.sum("piezas_scrap"), F.sum("total_piezas")).alias("scrap_rate"))


@register("P5_safe_ratio0", ("ops",), """
    SELECT work_order_id, machine_name, CASE WHEN sum(duracion_min) > 0 THEN 60*sum(piezas_ok)/sum(duracion_min) ELSE 0 END AS uph
    FROM ops GROUP BY 1, 2""")
def p5(spark, sf):
    return i.ops(spark, sf).groupBy("work_order_id", "machine_name").agg(
        x.ratio0(60 * F.sum("piezas_ok"), F.sum("duracion_min")).alias("uph"))


@register("P6_operation_rates", ("ops",), """
    SELECT work_order_id, machine_name, ts_ini, total_piezas,
      CASE WHEN total_piezas > 0 THEN piezas_scrap/total_piezas END AS scrap_rate,
      CASE WHEN total_piezas > 0 THEN piezas_ok/total_piezas END AS calidad,
      CASE WHEN duracion_min > 0 THEN 60*piezas_ok/duracion_min END AS throughput_uph,
      CASE WHEN duracion_min > 0 THEN 60*piezas_ok/duracion_min ELSE 0 END AS uph_real FROM ops""")
def p6(spark, sf):
    uph = 60 * F.col("piezas_ok")
    return i.ops(spark, sf).select(
        "work_order_id", "machine_name", "ts_ini", "total_piezas",
        x.ratio(F.col("piezas_scrap"), F.col("total_piezas")).alias("scrap_rate"),
        x.ratio(F.col("piezas_ok"), F.col("total_piezas")).alias("calidad"),
        x.ratio(uph, F.col("duracion_min")).alias("throughput_uph"), x.ratio0(uph, F.col("duracion_min")).alias("uph_real"))


@register("P7_calendar", ("ops",), """
    SELECT fecha, CAST(hour(ts_ini) AS INTEGER) AS hora, CAST(isodow(ts_ini) - 1 AS INTEGER) AS dia_semana, CAST(month(ts_ini) AS INTEGER) AS mes,
      CASE WHEN isodow(ts_ini) >= 6 THEN 1 ELSE 0 END AS es_fin_semana, count(*) AS n FROM ops GROUP BY ALL""")
def p7(spark, sf):
    return i.raw_ops(spark, sf).groupBy(
        F.col("ts_ini").cast("date").alias("fecha"), F.hour("ts_ini").alias("hora"), x.weekday_mon0("ts_ini").alias("dia_semana"),
        F.month("ts_ini").alias("mes"), x.is_weekend("ts_ini").alias("es_fin_semana")).agg(F.count("*").alias("n"))


@register("P8_iso_week", ("ops",), "SELECT periodo, min(fecha) AS desde, max(fecha) AS hasta, count(*) AS n FROM ops GROUP BY 1")
def p8(spark, sf):
    return i.ops(spark, sf).groupBy(x.iso_week_label("ts_ini").alias("periodo")).agg(
        F.min("fecha").alias("desde"), F.max("fecha").alias("hasta"), F.count("*").alias("n"))


@register("P9_family_fallback", ("fact",), "SELECT ref_id_str, familia_of, familia, count(*) AS n FROM fact GROUP BY 1, 2, 3")
def p9(spark, sf):
    return i.fact(spark, sf).groupBy("ref_id_str", "familia_of", "familia").agg(F.count("*").alias("n"))


@register("P10_label", ("refs",), "SELECT ref_id_str || ' (' || coalesce(familia, 'sin familia') || ')' AS etiqueta FROM refs")
def p10(spark, sf):
    return i.refs(spark, sf).select(x.ref_label("ref_id_str", "familia").alias("etiqueta"))


@register("P12_to_number", (), """
    SELECT o_orderkey, coalesce(try_cast(t AS DOUBLE), 0) AS valor FROM (SELECT o_orderkey,
      CASE WHEN o_orderkey % 7 = 0 THEN 'n/d' WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderkey AS VARCHAR) || '.5' END AS t FROM orders)""")
def p12(spark, sf):
    k = F.col("o_orderkey")
    t = F.when(k % 7 == 0, "n/d").when(k % 11 == 0, F.lit(None).cast("string")).otherwise(F.concat(k.cast("string"), F.lit(".5")))
    return views.table(spark, sf, "orders").select("o_orderkey", x.to_number0(t).alias("valor"))


@register("P13_to_timestamp", (), """
    SELECT o_orderkey, try_cast(t AS TIMESTAMP) AS ts FROM (SELECT o_orderkey,
      CASE WHEN o_orderkey % 5 = 0 THEN 'PENDING' ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS t FROM orders)""")
def p13(spark, sf):
    t = F.when(F.col("o_orderkey") % 5 == 0, "PENDING").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return views.table(spark, sf, "orders").select("o_orderkey", x.to_ts(t).alias("ts"))


@register("P14_duration_drift", ("raw_ops",), """
    WITH d AS (SELECT abs(duracion_min - date_diff('second', ts_ini, ts_fin)/60.0) AS d FROM raw_ops)
    SELECT count(*) AS filas, count(d) AS comparables, round(sum(d)/count(d), 6) AS diferencia_media, count_if(d > 1)::BIGINT AS mas_de_1_min,
      round(100.0*count_if(d > 1)/count(*), 2) AS mas_de_1_min_pct FROM d""")
def p14(spark, sf):
    return i.rounded(q.duration_drift(i.raw_ops(spark, sf)))


@register("P15_zero_as_null", ("ops",), "SELECT work_order_id, round(sum(piezas_scrap/nullif(total_piezas, 0)), 6) AS s, count(nullif(total_piezas, 0)) AS n FROM ops GROUP BY 1")
def p15(spark, sf):
    t = x.zero_as_null("total_piezas")
    return i.rounded(i.ops(spark, sf).groupBy("work_order_id").agg(F.sum(F.col("piezas_scrap") / t).alias("s"), F.count(t).alias("n")))


@register("P16_slug", ("raw_ops",), """
    SELECT DISTINCT f AS texto, lower(trim(regexp_replace(f, '[^0-9a-zA-Z]+', '_', 'g'), '_')) AS slug
    FROM (SELECT coalesce(op_id, op_text, evento) AS f FROM raw_ops UNION SELECT tipo_incidencia FROM raw_ops) WHERE f IS NOT NULL""")
def p16(spark, sf):
    r = i.raw_ops(spark, sf)
    t = r.select(F.explode(F.array(F.coalesce("op_id", "op_text", "evento"), "tipo_incidencia")).alias("texto")).where(F.col("texto").isNotNull())
    return t.distinct().withColumn("slug", x.slug("texto"))


@register("P17_phase", ("raw_ops",), """
    SELECT coalesce(nullif(trim(coalesce(op_id, op_text, evento)), ''), 'SIN_OP') AS fase, count(*) AS n FROM raw_ops GROUP BY 1""")
def p17(spark, sf):
    return i.raw_ops(spark, sf).groupBy(x.phase_of().alias("fase")).agg(F.count("*").alias("n"))


@register("P18_text_tests", ("raw_ops",), """
    SELECT op_id, evento, coalesce(contains(op_id, 'TALL'), false) AS tallado, coalesce(contains(lower(evento), 'incid'), false) AS incid,
      coalesce(starts_with(upper(op_id), 'CURV'), false) AS curvado, count(*) AS n FROM raw_ops GROUP BY ALL""")
def p18(spark, sf):
    return i.raw_ops(spark, sf).groupBy("op_id", "evento", x.has_text("op_id", "TALL").alias("tallado"),
                                        x.has_text("evento", "incid", True).alias("incid"),
                                        x.starts_with("op_id", "curv").alias("curvado")).agg(F.count("*").alias("n"))


@register("P21_change_risk", ("ops",), """
    SELECT CASE WHEN r < 0.7 THEN 'verde' WHEN r < 0.9 THEN 'amarillo' ELSE 'rojo' END AS riesgo, count(*) AS n
    FROM (SELECT piezas_ok/500 AS r FROM ops) GROUP BY 1""")
def p21(spark, sf):
    return i.ops(spark, sf).groupBy(x.change_risk(F.col("piezas_ok") / 500).alias("riesgo")).agg(F.count("*").alias("n"))


@register("P23_one_hot", ("ops",), """
    SELECT work_order_id, ts_ini, CASE WHEN estado = 'produccion' THEN 1 ELSE 0 END AS estado_produccion,
      CASE WHEN estado = 'preparacion' THEN 1 ELSE 0 END AS estado_preparacion, CASE WHEN estado = 'incidencia' THEN 1 ELSE 0 END AS estado_incidencia,
      CASE WHEN turno = 'mañana' THEN 1 ELSE 0 END AS "turno_mañana", CASE WHEN turno = 'tarde' THEN 1 ELSE 0 END AS turno_tarde,
      CASE WHEN turno = 'noche' THEN 1 ELSE 0 END AS turno_noche FROM ops""")
def p23(spark, sf):
    cols = {**x.one_hot("estado", "estado", x.STATES), **x.one_hot("turno", "turno", x.SHIFTS)}
    return i.ops(spark, sf).select("work_order_id", "ts_ini", *[c.alias(n) for n, c in cols.items()])


# --- filters ----------------------------------------------------------------

RANGE = pf.Filters(date(1997, 3, 1), date(1998, 10, 15))
EVENT_RANGE = pf.Filters(date(2024, 1, 5), date(2024, 1, 20))


def between(ts: str, f: pf.Filters = RANGE) -> str:
    return f"{ts} BETWEEN TIMESTAMP '{f.start} 00:00:00' AND TIMESTAMP '{f.end} 23:59:59'"


@register("F1_date_range", ("ops", "orders_h", "compras", "almacen"), f"""
    SELECT 'produccion' AS tabla, count(*) AS n FROM ops WHERE {between('ts_ini')}
    UNION ALL SELECT 'ordenes', count(*) FROM orders_h WHERE {between('fecha_lanzamiento')}
    UNION ALL SELECT 'compras', count(*) FROM compras WHERE {between('fecha_recepcion_ts', EVENT_RANGE)}
    UNION ALL SELECT 'almacen', count(*) FROM almacen WHERE {between('fecha_ts', EVENT_RANGE)}""")
def f1(spark, sf):
    n = F.count("*").alias("n")
    t = pf.apply_filters(pf.Tables(produccion=i.ops(spark, sf), ordenes=i.orders(spark, sf)), RANGE)
    e = pf.apply_filters(pf.Tables(compras=i.purchases(spark, sf), almacen=i.stock(spark, sf)), EVENT_RANGE)
    parts = [("produccion", t.produccion), ("ordenes", t.ordenes), ("compras", e.compras), ("almacen", e.almacen)]
    out = None
    for name, df in parts:
        one = df.agg(n).select(F.lit(name).alias("tabla"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@register("F2_plant_machine", ("ops",), f"""
    SELECT planta, machine_name, count(*) AS n FROM ops WHERE {between('ts_ini')} AND planta IN ('ASIA','EUROPE')
    AND machine_name = 'M00000003' GROUP BY 1, 2
    UNION ALL SELECT planta, 'todas', count(*) FROM ops WHERE {between('ts_ini')} AND planta IN ('ASIA','EUROPE') GROUP BY 1""")
def f2(spark, sf):
    ops = i.ops(spark, sf)
    both = pf.Filters(RANGE.start, RANGE.end, ("ASIA", "EUROPE"), "M00000003")
    one = pf.filter_ops(ops, both).groupBy("planta", "machine_name").agg(F.count("*").alias("n"))
    every = pf.filter_ops(ops, pf.Filters(RANGE.start, RANGE.end, ("ASIA", "EUROPE"))).groupBy("planta").agg(F.count("*").alias("n"))
    return one.unionByName(every.select("planta", F.lit("todas").alias("machine_name"), "n"))


@register("F3_labour_months", ("rrhh",), """SELECT "año_mes", horas_netas FROM rrhh WHERE "año_mes" BETWEEN DATE '1997-03-01' AND DATE '1998-10-01'""")
def f3(spark, sf):
    return pf.filter_labour(i.labour(spark, sf), RANGE).select("año_mes", "horas_netas")


@register("F4_week_presets", ("ops",), """
    WITH b AS (SELECT min(fecha) AS a, max(fecha) AS z FROM ops),
    s AS (SELECT z, CAST(a - CAST(dayofweek(a) AS INTEGER) AS DATE) AS s0 FROM b),
    w AS (SELECT z, g AS n, CAST(s0 + CAST(7*(g-1) AS INTEGER) AS DATE) AS inicio FROM s, range(1, 100000) t(g) WHERE s0 + CAST(7*(g-1) AS INTEGER) <= z)
    SELECT CAST(n AS INTEGER) AS n, 'Semana ' || n || ' (' || inicio || ' a ' || CAST(inicio + 5 AS DATE) || ')' AS etiqueta, inicio,
      least(CAST(inicio + 5 AS DATE), z) AS fin FROM w""")
def f4(spark, sf):
    b = i.ops(spark, sf).agg(F.min("fecha").alias("fecha_min"), F.max("fecha").alias("fecha_max"))
    return pf.week_presets(b)


@register("F5_clamped_range", ("ops",), """
    WITH b AS (SELECT min(fecha) AS a, max(fecha) AS z FROM ops)
    SELECT CAST(greatest(a, least(DATE '1990-01-01', z)) AS DATE) AS inicio, CAST(greatest(a, least(DATE '1996-06-30', z)) AS DATE) AS fin FROM b""")
def f5(spark, sf):
    b = i.ops(spark, sf).agg(F.min("fecha").alias("a"), F.max("fecha").alias("z")).first()
    got = pf.Filters(date(1990, 1, 1), date(1996, 6, 30)).clamp(b["a"], b["z"])
    return spark.createDataFrame([(got.start, got.end)], "inicio date, fin date")


@register("F6_plants_by_machine", ("ops",), """
    SELECT machine_name, string_agg(DISTINCT planta, ',' ORDER BY planta) AS plantas FROM ops WHERE machine_name IS NOT NULL GROUP BY 1""")
def f6(spark, sf):
    return pf.plants_by_machine(i.ops(spark, sf)).select("machine_name", F.array_join("plantas", ",").alias("plantas"))


@register("F7_dimension_values", ("ops",), """
    SELECT DISTINCT 'planta' AS dimension, planta AS valor FROM ops WHERE planta IS NOT NULL
    UNION ALL SELECT DISTINCT 'machine_name', machine_name FROM ops WHERE machine_name IS NOT NULL""")
def f7(spark, sf):
    ops = i.ops(spark, sf)
    a, b = (pf.dimension_values(ops, c).select(F.lit(c).alias("dimension"), "valor") for c in ("planta", "machine_name"))
    return a.unionByName(b)


@register("F8_range_summary", ("ops",), f"""
    WITH r AS (SELECT * FROM ops WHERE {between('ts_ini')} AND planta IN ('ASIA','EUROPE'))
    SELECT (SELECT count(DISTINCT ref_id_str) FROM r WHERE regexp_matches(ref_id_str, '^[0-9]+$')) AS referencias,
      (SELECT count(*) FROM r WHERE regexp_matches(ref_id_str, '^[0-9]+$')) AS filas_con_referencia,
      (SELECT sum(total_piezas) FROM {last_op_sql('r')}) AS piezas""")
def f8(spark, sf):
    return pf.range_summary(i.ops(spark, sf), pf.Filters(RANGE.start, RANGE.end, ("ASIA", "EUROPE")))


# --- audits -----------------------------------------------------------------

RAW_COLS = ("work_order_id", "ref_id", "material_lot_id", "op_id", "op_text", "machine_id", "machine_name", "evento",
            "tipo_incidencia", "operario_nombre", "ts_ini", "ts_fin", "duracion_min", "piezas_ok", "piezas_scrap", "planta")
NULLS = " UNION ALL ".join(
    f"SELECT '{c}' AS columna, count(*) - count({c}) AS faltantes, count(*) AS n FROM raw_ops" for c in RAW_COLS)


@register("A27_null_profile", ("raw_ops",), f"""
    SELECT columna, faltantes, round(100.0*faltantes/n, 2) AS porcentaje FROM ({NULLS}) WHERE faltantes > 0""")
def a27(spark, sf):
    return q.null_profile(i.raw_ops(spark, sf).select(*RAW_COLS))


@register("A28_duplicates", ("raw_ops",), """
    SELECT count(*) AS filas, CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT machine_name, fecha FROM
      (SELECT machine_name, CAST(ts_ini AS DATE) AS fecha FROM raw_ops))) AS BIGINT) AS duplicadas FROM raw_ops""")
def a28(spark, sf):
    return q.duplicate_count(i.raw_ops(spark, sf).select("machine_name", F.col("ts_ini").cast("date").alias("fecha")))


NUMERIC = ("duracion_min", "piezas_ok", "piezas_scrap")
RANGES = " UNION ALL ".join(
    f"SELECT '{c}' AS columna, min({c}) AS minimo, max({c}) AS maximo, count_if({c} < 0)::BIGINT AS negativos, count_if({c} = 0)::BIGINT AS ceros, "
    f"round(100.0*count_if({c} = 0)/count(*), 2) AS ceros_pct FROM raw_ops" for c in NUMERIC)


@register("A29_range_audit", ("raw_ops",), RANGES)
def a29(spark, sf):
    return q.range_audit(i.raw_ops(spark, sf), NUMERIC)


IDS = ("work_order_id", "ref_id", "machine_name")
ID_AUDIT = " UNION ALL ".join(
    f"SELECT '{c}' AS columna, count(DISTINCT {c}) AS distintos, CAST(min(length({c})) AS INTEGER) AS largo_min, CAST(max(length({c})) AS INTEGER) AS largo_max FROM raw_ops" for c in IDS)


@register("A30_id_audit", ("raw_ops",), ID_AUDIT)
def a30(spark, sf):
    return q.id_audit(i.raw_ops(spark, sf), IDS)


@register("A30_id_lengths", ("raw_ops",), "SELECT CAST(length(ref_id) AS INTEGER) AS largo, count(*) AS n FROM raw_ops GROUP BY 1")
def a30b(spark, sf):
    return q.id_lengths(i.raw_ops(spark, sf), "ref_id")


@register("A30_id_name_pairs", ("raw_ops",), "SELECT DISTINCT machine_id, machine_name FROM raw_ops")
def a30c(spark, sf):
    return q.id_name_pairs(i.raw_ops(spark, sf), "machine_id", "machine_name")


@register("A31_counts_by_time", ("ops",), """
    SELECT 'fecha' AS parte, CAST(fecha AS VARCHAR) AS valor, count(*) AS n FROM ops GROUP BY 2
    UNION ALL SELECT 'hora', CAST(hour(ts_ini) AS VARCHAR), count(*) FROM ops GROUP BY 2
    UNION ALL SELECT 'dia_semana', CAST(isodow(ts_ini) - 1 AS VARCHAR), count(*) FROM ops GROUP BY 2""")
def a31(spark, sf):
    return q.counts_by_time(i.ops(spark, sf))


@register("A32_scrap_by_shift", ("fact",), "SELECT turno, round(avg(scrap_rate), 6) AS scrap_rate_medio FROM fact GROUP BY 1")
def a32(spark, sf):
    return i.rounded(q.mean_by(i.fact(spark, sf), "turno", "scrap_rate"))


@register("A33_frequency", ("ops",), """
    SELECT work_order_id, machine_name, ref_id_str, ts_ini, count(*) OVER (PARTITION BY ref_id_str) AS ref_frequency,
      count(*) OVER (PARTITION BY machine_name) AS machine_frequency FROM ops""")
def a33(spark, sf):
    df = i.ops(spark, sf).select("work_order_id", "machine_name", "ref_id_str", "ts_ini")
    return q.frequency(q.frequency(df, "ref_id_str", "ref_frequency"), "machine_name", "machine_frequency")


DESCRIBE = " UNION ALL ".join(
    f"SELECT '{c}' AS columna, count({c}) AS n, round(avg({c}), 6) AS media, round(stddev_samp({c}), 6) AS desviacion, round(min({c}), 6) AS minimo, "
    f"round(max({c}), 6) AS maximo, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, "
    f"round(quantile_cont({c}, 0.75), 6) AS q75 FROM fact" for c in ("scrap_rate", "throughput_uph", "duracion_min"))


@register("A34_describe", ("fact",), DESCRIBE)
def a34(spark, sf):
    return i.rounded(q.describe(i.fact(spark, sf), ["scrap_rate", "throughput_uph", "duracion_min"]))


@register("A34_exact_quantiles", ("fact",), " UNION ALL ".join(
    f"SELECT '{c}' AS columna, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.9), 6) AS q90 FROM fact"
    for c in ("scrap_rate", "throughput_uph", "duracion_min")))
def a34b(spark, sf):
    """Exact quantiles of several columns at once: the column is the key."""
    cols = ["scrap_rate", "throughput_uph", "duracion_min"]
    long = i.fact(spark, sf).select(*cols).unpivot([], cols, "columna", "valor")
    return i.rounded(quantiles(long, ["columna"], "valor", {"q25": 0.25, "q90": 0.9}))


@register("A34_quantile_states", ("fact",), " UNION ALL ".join(
    f"SELECT '{c}' AS columna, '{n}' AS cuantil, count({c}) AS n, TRUE AS en_cota FROM fact"
    for c in ("scrap_rate", "throughput_uph", "duracion_min") for n in ("q25", "q90")))
def a34c(spark, sf):
    """Quantiles merged from daily states, and whether their true rank lies within twice the 99 % rank error."""
    cols, probs = ["scrap_rate", "throughput_uph", "duracion_min"], {"q25": 0.25, "q90": 0.9}
    long = i.fact(spark, sf).select("fecha", *cols).unpivot(["fecha"], cols, "columna", "valor")
    merged = merged_states(quantile_states(long, ["fecha", "columna"], "valor"), ["columna"])
    got = state_quantiles(merged, probs).unpivot(["columna", "n"], list(probs), "cuantil", "estimado")
    # six rows against the column's rows; below and upto enclose the estimate's true rank
    ranks = long.join(F.broadcast(got), "columna").groupBy("columna", "cuantil", "n").agg(
        F.count(F.when(F.col("valor") < F.col("estimado"), 1)).alias("below"), F.count(F.when(F.col("valor") <= F.col("estimado"), 1)).alias("upto"))
    at = F.create_map(*[F.lit(v) for item in probs.items() for v in item])[F.col("cuantil")] * F.col("n")
    slack = 2 * rank_error() * F.col("n") + 1
    return ranks.select("columna", "cuantil", "n", ((F.col("below") <= at + slack) & (F.col("upto") >= at - slack)).alias("en_cota"))


CATS = ("evento", "estado", "planta", "turno", "machine_name")
CAT_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS columna, {c} AS valor, count(*) AS n, (SELECT count(DISTINCT {c}) FROM ops) AS distintos FROM ops WHERE {c} IS NOT NULL GROUP BY {c}" for c in CATS)


@register("A35_categorical_profile", ("ops",), CAT_SQL)
def a35(spark, sf):
    return q.categorical_profile(i.ops(spark, sf), CATS)


@register("K18_quality_report", ("raw_ops",), f"""
    SELECT 'produccion' AS tabla, 'faltantes' AS prueba, columna, CAST(faltantes AS DOUBLE) AS valor FROM ({NULLS}) WHERE faltantes > 0
    UNION ALL SELECT 'produccion', 'duplicadas', '*', (SELECT count(*) FROM raw_ops) - (SELECT count(*) FROM (SELECT DISTINCT {', '.join(RAW_COLS)} FROM raw_ops))
    UNION ALL SELECT 'produccion', 'minimo', columna, minimo FROM ({RANGES})
    UNION ALL SELECT 'produccion', 'maximo', columna, maximo FROM ({RANGES})
    UNION ALL SELECT 'produccion', 'negativos', columna, negativos FROM ({RANGES})
    UNION ALL SELECT 'produccion', 'ceros', columna, ceros FROM ({RANGES})
    UNION ALL SELECT 'produccion', 'distintos', columna, distintos FROM ({ID_AUDIT})
    UNION ALL SELECT 'produccion', 'mas_de_1_min', 'duracion_min', (SELECT count_if(abs(duracion_min - date_diff('second', ts_ini, ts_fin)/60.0) > 1) FROM raw_ops)""")
def k18(spark, sf):
    return q.quality_report(i.raw_ops(spark, sf).select(*RAW_COLS), "produccion", NUMERIC, IDS)


@register("K19_clean", ("raw_ops",), f"""
    SELECT DISTINCT {', '.join(RAW_COLS)}, lpad(ref_id, 6, '0') AS ref_id_str FROM raw_ops
    WHERE coalesce(duracion_min >= 0, true) AND coalesce(piezas_ok >= 0, true) AND coalesce(piezas_scrap >= 0, true)""")
def k19(spark, sf):
    return q.clean(i.raw_ops(spark, sf).select(*RAW_COLS))


@register("T1_sorted", ("ops",), "SELECT machine_name, ts_ini, work_order_id FROM ops ORDER BY machine_name, ts_ini, work_order_id")
def t1(spark, sf):
    return i.ops(spark, sf).select("machine_name", "ts_ini", "work_order_id").orderBy(
        F.col("machine_name").asc_nulls_last(), F.col("ts_ini").asc_nulls_last(), "work_order_id")


@register("T3_distinct_subset", ("ops",), "SELECT DISTINCT ref_id_str, machine_name, planta FROM ops")
def t3(spark, sf):
    return i.ops(spark, sf).select("ref_id_str", "machine_name", "planta").distinct()


@register("T4_drop_duplicates", ("raw_ops",), f"SELECT DISTINCT {', '.join(RAW_COLS)} FROM raw_ops")
def t4(spark, sf):
    return i.raw_ops(spark, sf).select(*RAW_COLS).dropDuplicates()


@register("T10_drop_nulls", ("raw_ops",), """
    SELECT work_order_id, op_id, ts_fin, piezas_ok FROM raw_ops WHERE op_id IS NOT NULL AND ts_fin IS NOT NULL AND piezas_ok IS NOT NULL""")
def t10(spark, sf):
    return i.raw_ops(spark, sf).select("work_order_id", "op_id", "ts_fin", "piezas_ok").dropna(subset=["op_id", "ts_fin", "piezas_ok"])
