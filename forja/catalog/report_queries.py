"""Report family."""

from __future__ import annotations

from pyspark.sql import functions as F

from forja.catalog import inputs as i
from forja.catalog.base import last_op_sql, register
from forja.functions import scalar as x
from forja.plans import fact as pf
from forja.plans import reports as r

SCRAP = "CASE WHEN sum(piezas_ok) + sum(piezas_scrap) > 0 THEN sum(piezas_scrap)/(sum(piezas_ok)+sum(piezas_scrap)) END AS scrap_rate"
OKSC = "sum(piezas_ok) AS piezas_ok, sum(piezas_scrap) AS piezas_scrap"


@register("A4_daily_volume", ("ops",), f"SELECT fecha, {OKSC}, sum(duracion_min) AS duracion_min, {SCRAP} FROM ops GROUP BY fecha")
def a4(spark, sf):
    return r.daily_volume(i.ops(spark, sf))


@register("A5_product_mix", ("fact",), f"""
    SELECT *, ref_id_str || ' (' || familia || ')' AS ref_label FROM (
    SELECT ref_id_str, familia, {OKSC}, {SCRAP} FROM fact WHERE familia IS NOT NULL
    GROUP BY ref_id_str, familia ORDER BY piezas_ok DESC, ref_id_str, familia LIMIT 12)""")
def a5(spark, sf):
    return r.product_mix(i.fact(spark, sf))


PACE = f"""SELECT machine_name, {OKSC}, sum(duracion_min) AS duracion_min,
    CASE WHEN sum(duracion_min) > 0 THEN 60*sum(piezas_ok)/sum(duracion_min) END AS uph_real, {SCRAP}
    FROM ops GROUP BY machine_name"""


@register("A6_machine_pace", ("ops",), PACE)
def a6(spark, sf):
    return r.machine_pace(i.ops(spark, sf))


@register("A7_scrap_by_reference", ("ops",), """
    SELECT ref_id_str, sum(piezas_scrap) AS piezas_scrap, sum(total_piezas) AS total,
      CASE WHEN sum(total_piezas) > 0 THEN sum(piezas_scrap)/sum(total_piezas) END AS scrap_rate
    FROM ops GROUP BY ref_id_str ORDER BY scrap_rate DESC NULLS LAST, ref_id_str LIMIT 12""")
def a7(spark, sf):
    return r.scrap_by_reference(i.ops(spark, sf))


@register("A8_scrap_by_machine", ("ops",), f"SELECT * FROM ({PACE}) ORDER BY scrap_rate DESC NULLS LAST, machine_name LIMIT 10")
def a8(spark, sf):
    return r.scrap_by_machine(i.ops(spark, sf))


@register("A9_production_kpis", ("fact",), f"""
    WITH l AS {last_op_sql('fact')},
    a AS (SELECT CAST(sum(piezas_ok) AS BIGINT) AS total_ok, CAST(sum(piezas_scrap) AS BIGINT) AS total_scrap,
      sum(piezas_ok*coalesce(peso_neto_kg, 0)) AS kg_ok FROM l),
    b AS (SELECT sum(CASE WHEN lower(evento) = 'producción' THEN duracion_min ELSE 0 END) AS min_produccion,
      count(DISTINCT work_order_id) AS ordenes_activas, count(DISTINCT op_id) AS ops_activas FROM fact)
    SELECT total_ok, total_scrap, round(kg_ok, 2) AS kg_ok, min_produccion, ordenes_activas, ops_activas,
      round(total_scrap/(total_ok + total_scrap), 6) AS scrap_rate, round(total_ok/(min_produccion/60), 6) AS uph_real FROM a, b""")
def a9(spark, sf):
    return i.rounded(r.production_kpis(i.fact(spark, sf)), kg_ok=2)


@register("A10_order_progress", ("fact",), f"""
    SELECT *, CASE WHEN qty_plan > 0 THEN piezas_ok/qty_plan END AS progreso FROM (
    SELECT work_order_id, cliente, ref_id_str, max(qty_plan) AS qty_plan, {OKSC}, {SCRAP}, min(ts_ini) AS ts_ini, max(ts_fin) AS ts_fin
    FROM fact WHERE cliente IS NOT NULL GROUP BY work_order_id, cliente, ref_id_str
    ORDER BY ts_ini DESC NULLS LAST, work_order_id, cliente, ref_id_str LIMIT 50)""")
def a10(spark, sf):
    return r.order_progress(i.fact(spark, sf))


@register("A11_operation_detail", ("fact",), """
    SELECT work_order_id, op_id, ref_id_str, familia, cliente, machine_name, op_text, planta, ts_ini, ts_fin,
      duracion_min, piezas_ok, piezas_scrap, scrap_rate, turno FROM fact""")
def a11(spark, sf):
    return r.operation_detail(i.fact(spark, sf))


@register("A12_purchase_kpis", ("compras",), """
    SELECT round(sum(coalesce(qty_recibida, 0)), 2) AS kg_recibidos, count(DISTINCT material_lot_id) AS lotes,
      round(sum(coalesce(qty_recibida, 0))/count(DISTINCT material_lot_id), 6) AS lote_medio_kg FROM compras""")
def a12(spark, sf):
    return i.rounded(r.purchase_kpis(i.purchases(spark, sf)), kg_recibidos=2)


@register("A13_top_materials", ("compras",), """
    SELECT ref_materia_str, round(sum(coalesce(qty_recibida, 0)), 2) AS qty_recibida FROM compras
    GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""")
def a13(spark, sf):
    return i.rounded(r.top_materials(i.purchases(spark, sf)), 2)


@register("A14_receipts_by_day", ("compras",), """
    SELECT CAST(fecha_recepcion_ts AS DATE) AS fecha, ref_materia_str, round(sum(coalesce(qty_recibida, 0)), 2) AS qty_recibida
    FROM compras GROUP BY 1, 2""")
def a14(spark, sf):
    return i.rounded(r.receipts_by_day(i.purchases(spark, sf)), 2)


@register("A15_lot_map", ("compras",), """
    SELECT fecha_recepcion_ts, qty_recibida, ref_materia_str, material_lot_id FROM compras WHERE qty_recibida > 0""")
def a15(spark, sf):
    return r.lot_map(i.purchases(spark, sf))


@register("A16_finished_kpis", ("fact",), """
    SELECT sum(piezas_ok) AS piezas_ok, round(sum(piezas_ok*coalesce(peso_neto_kg, 0)), 2) AS kg_piezas_ok,
      count(DISTINCT ref_id_str) AS refs_activas FROM fact""")
def a16(spark, sf):
    return i.rounded(r.finished_kpis(i.fact(spark, sf)), 2)


@register("A17_top_finished", ("ops",), "SELECT ref_id_str, sum(piezas_ok) AS piezas_ok FROM ops GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def a17(spark, sf):
    return r.top_finished(i.ops(spark, sf))


@register("A18_finished_by_day", ("ops",), """
    SELECT CAST(ts_fin AS DATE) AS fecha, sum(piezas_ok) AS piezas_ok FROM ops WHERE ts_fin IS NOT NULL GROUP BY 1""")
def a18(spark, sf):
    return r.finished_by_day(i.ops(spark, sf))


LOST = "horas_enfermedad + horas_accidente + horas_permiso"


@register("A19_labour_totals", ("rrhh",), f"""
    SELECT CAST(sum(horas_teoricas) AS BIGINT) AS horas_teoricas, CAST(sum(horas_netas) AS BIGINT) AS horas_netas,
      CAST(sum({LOST}) AS BIGINT) AS horas_absentismo,
      CAST(sum({LOST}) AS DOUBLE)/CAST(sum(horas_ajustadas) AS DOUBLE) AS tasa_absentismo,
      CAST(sum(horas_netas) AS DOUBLE)/CAST(sum(horas_teoricas) AS DOUBLE) AS tasa_disponibilidad FROM rrhh""")
def a19(spark, sf):
    return r.labour_totals(i.labour(spark, sf))


@register("A20_hours_waterfall", ("rrhh",), """
    WITH s AS (SELECT CAST(sum(horas_teoricas) AS BIGINT) AS t, CAST(sum(reduccion_tco) AS BIGINT) AS r,
      CAST(sum(horas_enfermedad) AS BIGINT) AS e, CAST(sum(horas_accidente) AS BIGINT) AS a, CAST(sum(horas_permiso) AS BIGINT) AS p FROM rrhh)
    SELECT 1 AS paso, 'Teóricas' AS concepto, t AS horas FROM s UNION ALL SELECT 2, 'TCO (Ajuste)', -r FROM s
    UNION ALL SELECT 3, 'Enfermedad', -e FROM s UNION ALL SELECT 4, 'Accidentes', -a FROM s
    UNION ALL SELECT 5, 'Permisos', -p FROM s UNION ALL SELECT 6, 'Disponibles (Netas)', t-r-e-a-p FROM s""")
def a20(spark, sf):
    return r.hours_waterfall(i.labour(spark, sf))


@register("A21_monthly_production", ("ops",), """
    SELECT mes AS "año_mes", sum(piezas_ok) AS piezas_ok, sum(duracion_min) AS duracion_min FROM ops GROUP BY 1""")
def a21(spark, sf):
    return r.monthly_production(i.ops(spark, sf))


LABOUR_MONTHS = """WITH m AS (SELECT mes AS "año_mes", sum(piezas_ok) AS piezas_ok, sum(duracion_min) AS duracion_min FROM ops GROUP BY 1),
    j AS (SELECT rrhh.*, coalesce(piezas_ok, 0) AS piezas_ok, coalesce(duracion_min, 0) AS duracion_min
      FROM rrhh LEFT JOIN m USING ("año_mes"))"""


@register("A22_labour_by_month", ("rrhh", "ops"), LABOUR_MONTHS + """
    SELECT "año_mes", horas_teoricas, horas_netas, piezas_ok, duracion_min,
      CASE WHEN horas_netas > 0 THEN piezas_ok/horas_netas ELSE 0 END AS productividad, duracion_min/60 AS horas_prod,
      horas_netas - duracion_min/60 AS horas_gap, CASE WHEN horas_netas > 0 THEN duracion_min/60/horas_netas ELSE 0 END AS pct_uso FROM j""")
def a22(spark, sf):
    df = r.labour_by_month(i.labour(spark, sf), i.ops(spark, sf))
    return df.select("año_mes", "horas_teoricas", "horas_netas", "piezas_ok", "duracion_min", "productividad",
                     "horas_prod", "horas_gap", "pct_uso")


@register("A22_total_gap", ("rrhh", "ops"), LABOUR_MONTHS + "SELECT round(sum(horas_netas - duracion_min/60), 3) AS gap_total FROM j")
def a22b(spark, sf):
    return i.rounded(r.total_gap(i.labour(spark, sf), i.ops(spark, sf)), 3)


@register("A23_context_summary", ("fact", "orders_h", "rrhh", "compras"), f"""
    SELECT f.*, o.*, h.*, c.*, 100*piezas_scrap/(piezas_ok+piezas_scrap) AS scrap_pct,
      100*(horas_perdidas::DOUBLE/(horas_netas+horas_perdidas)::DOUBLE) AS tasa_absentismo_pct FROM
    (SELECT sum(piezas_ok) AS piezas_ok, sum(piezas_scrap) AS piezas_scrap, min(ts_ini) AS periodo_ini, max(ts_fin) AS periodo_fin,
      count(DISTINCT machine_name) AS maquinas, count(DISTINCT ref_id_str) AS referencias FROM fact) f,
    (SELECT count(DISTINCT work_order_id) AS ordenes, CAST(sum(qty_plan) AS BIGINT) AS piezas_planificadas FROM orders_h) o,
    (SELECT CAST(sum(horas_netas) AS BIGINT) AS horas_netas, CAST(sum({LOST}) AS BIGINT) AS horas_perdidas FROM rrhh) h,
    (SELECT round(sum(qty_recibida), 2) AS mp_kg, count(*) AS mp_lotes, count(DISTINCT ref_materia_str) AS mp_referencias FROM compras) c""")
def a23(spark, sf):
    df = r.context_summary(i.fact(spark, sf), i.orders(spark, sf), i.labour(spark, sf), i.purchases(spark, sf))
    return df.withColumns({"mp_kg": F.round("mp_kg", 2),
                           "scrap_pct": 100 * F.col("piezas_scrap") / (F.col("piezas_ok") + F.col("piezas_scrap"))})


@register("J1_with_reference", ("ops", "refs"), """
    SELECT ops.work_order_id, op_id, machine_name, ts_ini, ref_id_str, familia, peso_neto_kg FROM ops LEFT JOIN refs USING (ref_id_str)""")
def j1(spark, sf):
    base = i.ops(spark, sf).select("work_order_id", "op_id", "machine_name", "ts_ini", "ref_id_str")
    return pf.with_reference(base, i.refs(spark, sf))


@register("J2_with_order", ("ops", "orders_h"), """
    SELECT o.work_order_id, o.ref_id_str, o.op_id, o.machine_name, o.ts_ini, cliente, qty_plan, planta_inicio, familia_of
    FROM ops o LEFT JOIN orders_h h ON h.work_order_id = o.work_order_id AND h.ref_id_str = o.ref_id_str""")
def j2(spark, sf):
    base = i.ops(spark, sf).select("work_order_id", "ref_id_str", "op_id", "machine_name", "ts_ini")
    return pf.with_order(base, i.orders(spark, sf))


@register("J3_with_rate", ("ops", "rates"), """
    SELECT o.machine_name, o.ref_id_str, o.work_order_id, o.ts_ini, piezas_hora_teorico FROM ops o
    LEFT JOIN rates r ON r.ref_id_str = o.ref_id_str AND r.machine_name = o.machine_name""")
def j3(spark, sf):
    from forja.plans.oee import with_rate

    return with_rate(i.ops(spark, sf).select("machine_name", "ref_id_str", "work_order_id", "ts_ini"), i.rates(spark, sf))


@register("J4_with_benchmark", ("ops",), """
    WITH b AS (SELECT machine_name, ref_id_str, quantile_cont(c, 0.25) AS ciclo_p25, quantile_cont(c, 0.5) AS ciclo_mediana
      FROM (SELECT *, duracion_min*60/total_piezas AS c FROM ops WHERE estado = 'produccion' AND duracion_min > 0 AND total_piezas > 0)
      WHERE c BETWEEN 1 AND 600 GROUP BY 1, 2)
    SELECT machine_name, ref_id_str, work_order_id, ts_ini, round(ciclo_p25, 6) AS ciclo_p25, round(ciclo_mediana, 6) AS ciclo_mediana
    FROM ops LEFT JOIN b USING (machine_name, ref_id_str)""")
def j4(spark, sf):
    from forja.plans.oee import cycle_benchmarks

    ops = i.ops(spark, sf)
    base = ops.select("machine_name", "ref_id_str", "work_order_id", "ts_ini")
    return i.rounded(base.join(cycle_benchmarks(ops), ["machine_name", "ref_id_str"], "left"))


@register("J8_labour_with_production", ("rrhh", "ops"), LABOUR_MONTHS + """
    SELECT "año_mes", horas_netas, piezas_ok, duracion_min FROM j""")
def j8(spark, sf):
    return r.labour_by_month(i.labour(spark, sf), i.ops(spark, sf)).select("año_mes", "horas_netas", "piezas_ok", "duracion_min")


@register("J9_weight_if_absent", ("ops", "refs"), """
    SELECT ref_id_str, machine_name, sum(piezas_ok) AS piezas_ok, round(sum(piezas_ok*coalesce(peso_neto_kg, 0)), 2) AS kg
    FROM ops LEFT JOIN refs USING (ref_id_str) GROUP BY 1, 2""")
def j9(spark, sf):
    bare = i.ops(spark, sf).select("ref_id_str", "machine_name", "piezas_ok")
    df = pf.with_reference(bare, i.refs(spark, sf))
    return i.rounded(df.groupBy("ref_id_str", "machine_name").agg(
        F.sum("piezas_ok").alias("piezas_ok"), F.sum(F.col("piezas_ok") * F.coalesce("peso_neto_kg", F.lit(0.0))).alias("kg")), 2)


@register("T2_top_clients", ("fact",), f"""
    SELECT cliente, {OKSC} FROM fact WHERE cliente IS NOT NULL GROUP BY 1 ORDER BY piezas_ok DESC, cliente LIMIT 8""")
def t2(spark, sf):
    from forja.operators.ordered import top_k

    g = i.fact(spark, sf).where(F.col("cliente").isNotNull()).groupBy("cliente").agg(
        F.sum("piezas_ok").alias("piezas_ok"), F.sum("piezas_scrap").alias("piezas_scrap"))
    return top_k(g, 8, F.desc("piezas_ok"), F.col("cliente"))


@register("T5_absence_long", ("rrhh",), """
    SELECT "año_mes", 'horas_enfermedad' AS tipo, horas_enfermedad AS horas FROM rrhh
    UNION ALL SELECT "año_mes", 'horas_accidente', horas_accidente FROM rrhh
    UNION ALL SELECT "año_mes", 'horas_permiso', horas_permiso FROM rrhh""")
def t5(spark, sf):
    return r.absence_long(i.labour(spark, sf))


@register("K1_production_fact", ("fact",), """
    SELECT work_order_id, ref_id, ref_id_str, material_lot_id, op_id, op_text, machine_id, machine_name, planta, evento,
      tipo_incidencia, operario_nombre, ts_ini, ts_fin, duracion_min, piezas_ok, piezas_scrap, total_piezas, estado, fecha,
      turno, familia, peso_neto_kg, cliente, qty_plan, planta_inicio, familia_of, scrap_rate, throughput_uph FROM fact""")
def k1(spark, sf):
    return i.build_fact(spark, sf)
