"""Routes, order flow, tool changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from forja import schemas, views
from forja.catalog import inputs as i
from forja.catalog.base import register
from forja.functions import scalar as x
from forja.operators.ordered import quantiles
from forja.plans import routes as p
from forja.plans import tooling as t
from forja.sources import files
from forja.staging import out_dir, staged

ORD = "ts_ini NULLS LAST, ts_fin NULLS LAST, fase, op_id NULLS FIRST, ref_id_str"
PH = """WITH ph AS (SELECT *, coalesce(nullif(trim(coalesce(op_id, op_text, evento)), ''), 'SIN_OP') AS fase,
    coalesce(contains(lower(evento), 'incid'), false) OR tipo_incidencia IS NOT NULL AS incidente
    FROM ops WHERE work_order_id IS NOT NULL),
  pos AS (SELECT *, row_number() OVER (PARTITION BY work_order_id ORDER BY """ + ORD + """) AS rn FROM ph)"""


def life(spark, sf):
    """Order documents, staged once for the feature queries."""
    return staged(spark, sf, "of_vida", lambda: p.order_life(p.order_flow(i.ops(spark, sf), i.orders(spark, sf))))


@register("K9_order_routes", ("ops",), PH + """
  SELECT work_order_id, min(CASE WHEN rn = 1 THEN ref_id_str END) AS ref_id_str, min(CASE WHEN rn = 1 THEN fase END) AS fase_inicio,
    arg_max(fase, rn) AS fase_fin, string_agg(fase, ' -> ' ORDER BY rn) AS ruta_fases, sum(duracion_min) AS dur_total_min,
    count(*) AS n_ops, string_agg(coalesce(op_id, '-'), ',' ORDER BY rn) AS ops_seq FROM pos GROUP BY 1""")
def k9(spark, sf):
    return p.order_routes(i.ops(spark, sf)).withColumn("ops_seq", F.array_join("ops_seq", ",", "-"))


@register("K9_route_steps", ("ops",), PH + "SELECT work_order_id, rn AS paso, fase FROM pos")
def k9b(spark, sf):
    return p.route_steps(i.ops(spark, sf))


@register("K10_order_pieces", ("ops",), PH + """,
  f AS (SELECT work_order_id, fase, min(rn) AS r, sum(piezas_ok) AS ok, sum(piezas_scrap) AS sc FROM pos GROUP BY 1, 2)
  SELECT f.work_order_id, min(ref) AS ref_id_str, string_agg(fase, ' -> ' ORDER BY r) AS fases_unicas, CAST(count(*) AS INTEGER) AS n_fases,
    sum(ok) AS piezas_ok_sum, sum(sc) AS piezas_scrap_sum, sum(ok) + sum(sc) AS piezas_lanzadas
  FROM f JOIN (SELECT work_order_id, ref_id_str AS ref FROM pos WHERE rn = 1) USING (work_order_id) GROUP BY 1""")
def k10(spark, sf):
    return p.order_pieces(i.ops(spark, sf))


FLOW = PH + """,
  made AS (SELECT *, row_number() OVER (PARTITION BY work_order_id ORDER BY rn) AS rm FROM pos WHERE NOT incidente),
  sel AS (SELECT work_order_id FROM made WHERE rm = 1 AND starts_with(upper(fase), 'CURV')),
  head AS (SELECT work_order_id, max(qty_plan)::DOUBLE AS plan FROM orders_h GROUP BY 1),
  tot AS (SELECT work_order_id, sum(piezas_ok + piezas_scrap) AS contadas, sum(duracion_min) AS mins, count(*) AS n_ops,
    min(ts_ini) AS ini, max(ts_fin) AS fin, string_agg(fase, ' -> ' ORDER BY rm) AS seq FROM made GROUP BY 1),
  inc AS (SELECT work_order_id, sum(duracion_min) AS inc_min FROM pos WHERE incidente GROUP BY 1),
  base AS (SELECT tot.*, coalesce(plan, contadas) AS lanzadas, coalesce(inc_min, 0) AS inc_min FROM tot
    JOIN sel USING (work_order_id) JOIN head USING (work_order_id) LEFT JOIN inc USING (work_order_id)),
  fa AS (SELECT work_order_id, fase, sum(piezas_scrap) AS scrap, sum(duracion_min) AS mins, max(rm) AS ult, min(rm) AS pri
    FROM made GROUP BY 1, 2),
  fl AS (SELECT fa.*, lanzadas, sum(scrap) OVER w AS acum, row_number() OVER w AS orden FROM fa JOIN base USING (work_order_id)
    WINDOW w AS (PARTITION BY work_order_id ORDER BY ult ROWS UNBOUNDED PRECEDING)),
  flow AS (SELECT *, CASE WHEN orden = 1 THEN lanzadas ELSE greatest(lanzadas - (acum - scrap), 0) END AS entrada,
    greatest(lanzadas - acum, 0) AS salida FROM fl),
  ag AS (SELECT work_order_id, sum(scrap) AS scrap_t, string_agg(fase, ' -> ' ORDER BY pri) AS unicas FROM flow GROUP BY 1),
  refs1 AS (SELECT work_order_id, ref_id_str FROM pos WHERE rn = 1),
  vida AS (SELECT b.work_order_id, ref_id_str, lanzadas AS cantidad_lanzada, greatest(lanzadas - scrap_t, 0) AS cantidad_final_ok,
    scrap_t AS scrap_total, mins AS tiempo_total_min, ini AS primera_fase_ts, fin AS ultima_fase_ts,
    date_diff('second', ini, fin)/60.0 AS fabricacion_duracion_min, inc_min AS incidencias_duracion_total, n_ops, seq, unicas
    FROM base b JOIN ag USING (work_order_id) JOIN refs1 USING (work_order_id))"""
FLOW_T = ("ops", "orders_h")


@register("K11_order_flow", FLOW_T, FLOW + """
  SELECT work_order_id, ref_id_str, unicas AS fases_unicas, n_ops, cantidad_lanzada AS piezas_lanzadas, cantidad_final_ok AS piezas_ok_total,
    scrap_total AS piezas_scrap_total, tiempo_total_min AS duracion_total_min, primera_fase_ts, ultima_fase_ts,
    round(fabricacion_duracion_min, 6) AS fabricacion_duracion_min, incidencias_duracion_total FROM vida""")
def k11(spark, sf):
    f = p.order_flow(i.ops(spark, sf), i.orders(spark, sf))
    return i.rounded(f.drop("flow_por_fase").withColumns({
        "fases_unicas": F.array_join("fases_unicas", " -> "), "n_ops": F.col("n_ops").cast("bigint")}))


@register("K11_phase_steps", ("ops",), PH + """
  SELECT work_order_id, row_number() OVER (PARTITION BY work_order_id ORDER BY rn) AS paso, fase FROM pos WHERE NOT incidente""")
def k11b(spark, sf):
    """The non-incident steps of every order in long form."""
    return p.route_steps(i.ops(spark, sf), incidents=False)


@register("W9_phase_flow", FLOW_T, FLOW + """
  SELECT work_order_id, CAST(orden AS INTEGER) AS orden, fase, entrada AS entrada_estimada, salida AS salida_estimada,
    scrap AS piezas_scrap, mins AS duracion_min FROM flow""")
def w9(spark, sf):
    f = p.phase_flow(i.ops(spark, sf), i.orders(spark, sf))
    return f.select("work_order_id", "orden", "fase", F.col("entrada").alias("entrada_estimada"), F.col("salida").alias("salida_estimada"),
                    F.col("scrap").alias("piezas_scrap"), F.col("mins").alias("duracion_min"))


@register("K12_order_life", FLOW_T, FLOW + """
  SELECT work_order_id, ref_id_str, cantidad_lanzada, cantidad_final_ok, scrap_total, tiempo_total_min, primera_fase_ts, ultima_fase_ts,
    round(fabricacion_duracion_min, 6) AS fabricacion_duracion_min, incidencias_duracion_total, ops AS operaciones FROM vida JOIN
    (SELECT work_order_id, string_agg(fase || ':' || CAST(entrada AS BIGINT) || '>' || CAST(salida AS BIGINT), ';' ORDER BY pri) AS ops FROM flow GROUP BY 1)
    USING (work_order_id)""")
def k12(spark, sf):
    v = p.order_life(p.order_flow(i.ops(spark, sf), i.orders(spark, sf)))
    text = F.transform("operaciones", lambda o: F.concat(
        o["op"], F.lit(":"), o["piezas_lanzadas"].cast("bigint").cast("string"), F.lit(">"), o["salida_estimada"].cast("bigint").cast("string")))
    return i.rounded(v.withColumn("operaciones", F.array_join(text, ";")))


ONE = "000000000001"  # an order of every data size


@register("K13_lookup_order", ("ops",), PH + """
  SELECT work_order_id, fase, sum(piezas_ok) AS piezas_ok_sum, sum(piezas_scrap) AS piezas_scrap_sum, sum(duracion_min) AS duracion_min_sum,
    sum(piezas_ok) + sum(piezas_scrap) AS piezas_lanzadas FROM ph WHERE work_order_id = '""" + ONE + """' GROUP BY 1, 2""")
def k13(spark, sf):
    return p.lookup_order(i.ops(spark, sf), ONE)


@register("K13_lookup_steps", ("ops",), PH + f"SELECT work_order_id, rn AS paso, fase FROM pos WHERE work_order_id = '{ONE}'")
def k13b(spark, sf):
    return p.lookup_steps(i.ops(spark, sf), ONE)


@register("K13_lookup_totals", ("ops",), PH + f""",
  f AS (SELECT work_order_id, fase, min(rn) AS r FROM pos GROUP BY 1, 2)
  SELECT work_order_id, min(CASE WHEN rn = 1 THEN ref_id_str END) AS ref_id_str,
    (SELECT string_agg(fase, ' -> ' ORDER BY r) FROM f WHERE f.work_order_id = '{ONE}') AS fases, min(CASE WHEN rn = 1 THEN fase END) AS fase_inicio,
    arg_max(fase, rn) AS fase_fin, count(*) AS n_ops, sum(piezas_ok) AS piezas_ok_sum, sum(piezas_scrap) AS piezas_scrap_sum,
    sum(duracion_min) AS duracion_min_sum, sum(piezas_ok) + sum(piezas_scrap) AS piezas_lanzadas
  FROM pos WHERE work_order_id = '{ONE}' GROUP BY 1""")
def k13c(spark, sf):
    return p.lookup_totals(i.ops(spark, sf), ONE).withColumn("fases", F.array_join("fases", p.ARROW))


METRICS = """round(scrap_total/nullif(cantidad_final_ok + scrap_total, 0), 6) AS scrap_rate, round(cantidad_final_ok/nullif(cantidad_lanzada, 0), 6) AS yield_ok,
    round(fabricacion_duracion_min/1440, 6) AS fabricacion_dias, round(incidencias_duracion_total/60, 6) AS incidencias_horas,
    round(fabricacion_duracion_min/nullif(cantidad_lanzada, 0), 6) AS duracion_min_por_ud"""


@register("K14_order_metrics", FLOW_T, FLOW + f"SELECT work_order_id, {METRICS} FROM vida")
def k14(spark, sf):
    return i.rounded(p.order_metrics(life(spark, sf)).select(
        "work_order_id", "scrap_rate", "yield_ok", "fabricacion_dias", "incidencias_horas", "duracion_min_por_ud"))


OUT = "fase NOT IN (" + ", ".join(f"'{o}'" for o in views.PHASES) + ")"
OPS_SUM = """(SELECT work_order_id, count(fase) AS ops_count, CAST(count(DISTINCT fase) AS INTEGER) AS ops_unique, sum(mins) AS duracion_ops_min,
    sum(scrap) AS scrap_ops_total, string_agg(fase, ' > ' ORDER BY pri) AS op FROM flow GROUP BY 1)"""
CASES = [*((x.slug_text(o), f"fase = '{o}'") for o in views.PHASES), ("otras", OUT)]
PIVOT_COLS = ", ".join(
    [f"sum(CASE WHEN {c} THEN mins END) AS dur_min_{n}" for n, c in CASES]
    + [f"round(sum(CASE WHEN {c} THEN mins END)/nullif(max(lanzadas), 0), 6) AS dur_min_{n}_por_ud" for n, c in CASES]
    + [f"sum(CASE WHEN {c} THEN scrap END) AS scrap_{n}" for n, c in CASES])
PIVOT = f"(SELECT work_order_id, {PIVOT_COLS} FROM flow GROUP BY 1)"


@register("T7_exploded_ops", FLOW_T, FLOW + """
  SELECT work_order_id, lanzadas AS cantidad_lanzada, CAST(row_number() OVER (PARTITION BY work_order_id ORDER BY pri) - 1 AS INTEGER) AS orden_op,
    fase AS op, entrada AS piezas_lanzadas, salida AS salida_estimada, scrap AS piezas_scrap, mins AS duracion_min FROM flow""")
def t7(spark, sf):
    return p.exploded_ops(life(spark, sf)).drop("ref_id_str")


@register("A41_op_summary", FLOW_T, FLOW + f"SELECT * FROM {OPS_SUM}")
def a41(spark, sf):
    return p.op_summary(life(spark, sf))


@register("A42_op_pivots", FLOW_T, FLOW + f"SELECT * FROM {PIVOT}")
def a42(spark, sf):
    return i.rounded(p.op_pivots(life(spark, sf), views.PHASES))


MODEL_SQL = FLOW + f"""
  SELECT v.work_order_id, ref_id_str, cantidad_lanzada, cantidad_final_ok, scrap_total, tiempo_total_min, primera_fase_ts, ultima_fase_ts,
    round(fabricacion_duracion_min, 6) AS y_fabricacion_min, incidencias_duracion_total, {METRICS},
    s.* EXCLUDE (work_order_id), q.* EXCLUDE (work_order_id) FROM vida v LEFT JOIN {OPS_SUM} s USING (work_order_id) LEFT JOIN {PIVOT} q USING (work_order_id)"""


@register("K15_model_table", FLOW_T, MODEL_SQL)
def k15(spark, sf):
    return i.rounded(p.model_table(life(spark, sf), views.PHASES))


@register("J10_orders_with_features", FLOW_T, FLOW + f"""
  SELECT v.work_order_id, cantidad_lanzada, s.* EXCLUDE (work_order_id) FROM vida v LEFT JOIN {OPS_SUM} s USING (work_order_id)""")
def j10(spark, sf):
    return life(spark, sf).select("work_order_id", "cantidad_lanzada", *[c.alias(n) for n, c in p.summary_columns().items()])


@register("J11_pivots_joined", FLOW_T, FLOW + f"SELECT s.*, q.* EXCLUDE (work_order_id) FROM {OPS_SUM} s JOIN {PIVOT} q USING (work_order_id)")
def j11(spark, sf):
    v = p.model_table(life(spark, sf).where(F.size("operaciones") > 0), views.PHASES)
    return i.rounded(v.select("work_order_id", *p.summary_columns(), *p.pivot_columns(views.PHASES)))


@register("J5_ops_with_header", ("ops", "orders_h"), """
  SELECT ops.work_order_id, op_id, machine_name, ts_ini, ops.ref_id_str, h.ref_id_str AS ref_id_str_hdr, qty_plan, fecha_lanzamiento
  FROM ops LEFT JOIN orders_h h ON h.work_order_id = ops.work_order_id""")
def j5(spark, sf):
    base = i.ops(spark, sf).select("work_order_id", "op_id", "machine_name", "ts_ini", "ref_id_str")
    return p.ops_with_header(base, i.orders(spark, sf)).drop("due_date")


@register("J12_orders_in_header", ("ops", "orders_h"), """
  SELECT work_order_id, count(*) AS n FROM ops WHERE work_order_id IN (SELECT work_order_id FROM orders_h WHERE qty_plan IS NOT NULL) GROUP BY 1""")
def j12(spark, sf):
    known = i.orders(spark, sf).where(F.col("qty_plan").isNotNull()).select("work_order_id")
    return i.ops(spark, sf).groupBy("work_order_id").agg(F.count("*").alias("n")).join(known, "work_order_id", "left_semi")


TOPREF = "(SELECT ref_id_str FROM vida GROUP BY 1 ORDER BY count(*) DESC, ref_id_str LIMIT 10)"


@register("J13_top_reference_orders", FLOW_T, FLOW + f"""
  SELECT work_order_id, ref_id_str, cantidad_lanzada FROM vida WHERE ref_id_str IN {TOPREF}""")
def j13(spark, sf):
    return p.top_references(life(spark, sf)).select("work_order_id", "ref_id_str", "cantidad_lanzada")


@register("A39_reference_times", FLOW_T, FLOW + """
  SELECT ref_id_str, count(*) AS n_of, round(avg(fabricacion_duracion_min), 4) AS media_min,
    round(quantile_cont(fabricacion_duracion_min, 0.5), 4) AS mediana_min FROM vida GROUP BY 1""")
def a39(spark, sf):
    return i.rounded(p.reference_times(life(spark, sf), quantiles), 4)


@register("A40_reference_cycle", FLOW_T, FLOW + """
  SELECT ref_id_str, count(*) AS of_count, sum(cantidad_final_ok) AS uds_ok, round(coalesce(sum(fabricacion_duracion_min), 0), 4) AS dur_total_min,
    round(sum(fabricacion_duracion_min)/nullif(sum(cantidad_final_ok), 0), 4) AS ciclo_min_por_ud FROM vida GROUP BY 1""")
def a40(spark, sf):
    return i.rounded(p.reference_cycle(life(spark, sf)), 4)


@register("A43_start_end_counts", ("ops",), PH + """,
  r AS (SELECT work_order_id, min(CASE WHEN rn = 1 THEN fase END) AS fase_inicio, arg_max(fase, rn) AS fase_fin FROM pos GROUP BY 1)
  SELECT fase_inicio, fase_fin, count(*) AS n FROM r GROUP BY 1, 2""")
def a43(spark, sf):
    return p.start_end_counts(i.ops(spark, sf))


@register("A44_catalogues", ("raw_ops",), """
  SELECT * FROM (SELECT 'op_id' AS columna, op_id AS valor, count(*) AS n FROM raw_ops WHERE op_id IS NOT NULL GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 20)
  UNION ALL SELECT * FROM (SELECT 'op_text', op_text, count(*) FROM raw_ops WHERE op_text IS NOT NULL GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 20)""")
def a44(spark, sf):
    ops = i.raw_ops(spark, sf)
    a, b = (p.catalogue(ops, c).select(F.lit(c).alias("columna"), "valor", "n") for c in ("op_id", "op_text"))
    return a.unionByName(b)


@register("W8_unique_phases", ("ops",), PH + """
  SELECT work_order_id, string_agg(fase, '|' ORDER BY r) AS fases FROM (SELECT work_order_id, fase, min(rn) AS r FROM pos GROUP BY 1, 2) GROUP BY 1""")
def w8(spark, sf):
    return p.order_phases(i.ops(spark, sf)).select("work_order_id", F.array_join("fases", "|").alias("fases"))


@register("T8_expanded_steps", ("ops",), PH + """,
  made AS (SELECT work_order_id, fase, row_number() OVER (PARTITION BY work_order_id ORDER BY rn) AS rm FROM pos WHERE NOT incidente)
  SELECT work_order_id, CAST(count(*) AS INTEGER) AS n_pasos, max(CASE WHEN rm = 1 THEN fase END) AS OP1, max(CASE WHEN rm = 2 THEN fase END) AS OP2,
    max(CASE WHEN rm = 3 THEN fase END) AS OP3, arg_max(fase, rm) AS ultima FROM made GROUP BY 1""")
def t8(spark, sf):
    return p.expand_steps(i.ops(spark, sf), 3)


@register("T9_side_by_side", ("ops",), """
  SELECT work_order_id, ts_ini, CAST(hour(ts_ini) AS INTEGER) AS hora_del_dia, CAST(isodow(ts_ini) - 1 AS INTEGER) AS dia_semana,
    CASE WHEN estado = 'produccion' THEN 1 ELSE 0 END AS estado_produccion FROM ops""")
def t9(spark, sf):
    return i.ops(spark, sf).select("work_order_id", "ts_ini", "estado").withColumns({
            "hora_del_dia": F.hour("ts_ini"), "dia_semana": F.weekday("ts_ini"),
            "estado_produccion": F.when(F.col("estado") == "produccion", 1).otherwise(0)}).drop("estado")


# --- tool changes -----------------------------------------------------------

CUT = """WITH tall AS (SELECT *, coalesce(tipo_incidencia = 'CAMBIO DE FRESA', false) AS es_cambio FROM ops WHERE contains(op_id, 'TALL')),
  cum AS (SELECT *, sum(piezas_ok) OVER w AS cum_piezas, sum(piezas_scrap) OVER w AS cum_scrap, count(*) OVER w AS cum_ops FROM tall
    WINDOW w AS (PARTITION BY machine_id ORDER BY ts_ini NULLS LAST, es_cambio, ts_fin NULLS LAST, piezas_ok, piezas_scrap ROWS UNBOUNDED PRECEDING)),
  ch AS (SELECT machine_id, machine_name, ts_ini AS ts_cambio, date_diff('second', ts_ini, ts_fin)/60.0 AS duracion_cambio_min, cum_ops, cum_piezas, cum_scrap,
    cum_piezas - coalesce(lag(cum_piezas) OVER m, 0) AS piezas_hasta_cambio, cum_scrap - coalesce(lag(cum_scrap) OVER m, 0) AS scrap_hasta_cambio,
    cum_ops - coalesce(lag(cum_ops) OVER m, 0) AS ops_hasta_cambio FROM cum WHERE es_cambio WINDOW m AS (PARTITION BY machine_id ORDER BY cum_ops)),
  nx AS (SELECT *, lead(ts_cambio) OVER (PARTITION BY machine_id ORDER BY ts_cambio, ops_hasta_cambio, piezas_hasta_cambio, scrap_hasta_cambio,
    coalesce(duracion_cambio_min, -1)) AS next_ts FROM ch)"""


@register("W2_running_totals", ("ops",), CUT + """
  SELECT machine_id, ts_ini, max(cum_piezas) AS cum_piezas, max(cum_scrap) AS cum_scrap, max(cum_ops) AS cum_ops FROM cum GROUP BY 1, 2""")
def w2(spark, sf):
    c = t.machine_counters(i.ops(spark, sf))
    return c.groupBy("machine_id", "ts_ini").agg(*[F.max(n).alias(n) for n in ("cum_piezas", "cum_scrap", "cum_ops")])


@register("W3_operation_numbers", ("ops",), """
  SELECT machine_id, work_order_id, ts_ini, row_number() OVER (PARTITION BY machine_id ORDER BY ts_ini NULLS LAST, ts_fin NULLS LAST, work_order_id,
    op_id NULLS FIRST, piezas_ok, piezas_scrap) AS num_op FROM ops""")
def w3(spark, sf):
    return t.operation_numbers(i.ops(spark, sf)).select("machine_id", "work_order_id", "ts_ini", "num_op")


@register("W4_change_deltas", ("ops",), CUT + "SELECT machine_id, sum(piezas_hasta_cambio) AS piezas, sum(ops_hasta_cambio)::BIGINT AS ops, count(*) AS cambios FROM ch GROUP BY 1")
def w4(spark, sf):
    return t.tool_changes(i.ops(spark, sf)).groupBy("machine_id").agg(
        F.sum("piezas_hasta_cambio").alias("piezas"), F.sum("ops_hasta_cambio").alias("ops"), F.count("*").alias("cambios"))


@register("K16_tool_changes", ("ops",), CUT + """
  SELECT machine_id, machine_name, ts_cambio, piezas_hasta_cambio, scrap_hasta_cambio, duracion_cambio_min, ops_hasta_cambio FROM ch""")
def k16(spark, sf):
    return t.tool_changes(i.ops(spark, sf))


@register("S9_tool_changes", ("ops",), CUT + "SELECT machine_id, ts_cambio, piezas_hasta_cambio, ops_hasta_cambio FROM ch")
def s9(spark, sf):
    """The stored tool-change table, as the models read it."""
    return changes(spark, sf).select("machine_id", "ts_cambio", "piezas_hasta_cambio", "ops_hasta_cambio")


def changes(spark, sf):
    return staged(spark, sf, "fresa", lambda: t.tool_changes(i.ops(spark, sf)))


@register("K17_next_change", ("ops",), CUT + """
  SELECT machine_id, machine_name, ts_cambio, piezas_hasta_cambio, scrap_hasta_cambio, duracion_cambio_min, ops_hasta_cambio, next_ts,
    date_diff('second', ts_cambio, next_ts)/60.0 AS minutes_to_next_change FROM nx WHERE next_ts IS NOT NULL""")
def k17(spark, sf):
    return t.next_change(changes(spark, sf))


@register("W5_time_to_next", ("ops",), CUT + """
  SELECT machine_id, count(*) AS n, round(avg(date_diff('second', ts_cambio, next_ts)/60.0), 6) AS media_min FROM nx WHERE next_ts IS NOT NULL GROUP BY 1""")
def w5(spark, sf):
    return i.rounded(t.next_change(changes(spark, sf)).groupBy("machine_id").agg(
        F.count("*").alias("n"), F.avg("minutes_to_next_change").alias("media_min")))


# --- sinks and back ---------------------------------------------------------


@register("S12_order_life_json", FLOW_T, FLOW + """
  SELECT work_order_id, cantidad_lanzada, scrap_total, primera_fase_ts, ultima_fase_ts, CAST(n AS INTEGER) AS operaciones FROM vida JOIN
    (SELECT work_order_id, count(*) AS n FROM flow GROUP BY 1) USING (work_order_id)""")
def s12(spark, sf):
    """Written as JSON documents and read back with an explicit schema (S11)."""
    path = f"{out_dir(spark, sf)}/of_vida_json"
    files.write_order_life(life(spark, sf), path)
    return files.read_order_life(spark, path).select(
        "work_order_id", "cantidad_lanzada", "scrap_total", "primera_fase_ts", "ultima_fase_ts", F.size("operaciones").alias("operaciones"))


@register("S11_order_life_scan", FLOW_T, FLOW + """, doc AS (
    SELECT CAST(work_order_id AS BIGINT) % 50 AS r, cantidad_lanzada, n FROM vida JOIN (SELECT work_order_id, count(*) AS n FROM flow GROUP BY 1) USING (work_order_id))
  SELECT CASE r WHEN 0 THEN 'ilegible' WHEN 1 THEN 'tipo' WHEN 2 THEN 'sin_of' WHEN 3 THEN 'sin_operaciones' END AS motivo,
    count(*) AS documentos, CAST(sum(CASE WHEN r NOT IN (0, 3) THEN n ELSE 0 END) AS BIGINT) AS operaciones,
    round(coalesce(sum(CASE WHEN r > 0 THEN cantidad_lanzada END), 0), 6) AS lanzadas FROM doc GROUP BY 1""")
def s11(spark, sf):
    """Order documents of which some are cut off, hold text for a number, or lack id or operations, scanned and quarantined."""
    rest = F.pmod(F.col("work_order_id").cast("long"), F.lit(50))
    docs = life(spark, sf).select(rest.alias("r"), *schemas.ORDER_LIFE.names)
    docs = docs.withColumns({"work_order_id": F.when(F.col("r") != 2, F.col("work_order_id")),
                             "operaciones": F.when(F.col("r") != 3, F.col("operaciones"))})
    line = F.to_json(F.struct(*schemas.ORDER_LIFE.names), {"ignoreNullFields": "false", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss"})
    line = F.when(F.col("r") == 0, F.substr(line, F.lit(1), F.length(line) - 1)).when(
        F.col("r") == 1, F.regexp_replace(line, r'"scrap_total":[^,}]*', '"scrap_total":"n/a"')).otherwise(line)
    path = f"{out_dir(spark, sf)}/of_vida_sucia"
    docs.select(line.alias("value")).write.mode("overwrite").text(path)
    scanned = files.scan_order_life(spark, path, f"{path}_leida")
    return i.rounded(scanned.groupBy("motivo").agg(
        F.count("*").alias("documentos"), F.sum(F.greatest(F.coalesce(F.size("operaciones"), F.lit(0)), F.lit(0))).alias("operaciones"),
        x.sum0("cantidad_lanzada").alias("lanzadas")))


@register("S13_model_orders_csv", FLOW_T, MODEL_SQL)
def s13b(spark, sf):
    """The model-ready orders written as CSV and read back by name and type."""
    path = f"{out_dir(spark, sf)}/of_modelo_csv"
    rows = k15(spark, sf)
    files.write_csv(rows, path)
    return files.read_csv(spark, path, rows.schema)


@register("A42_operation_totals", FLOW_T, FLOW + """
  SELECT work_order_id, fase AS op, sum(mins) AS duracion_min, sum(scrap) AS piezas_scrap,
    round(sum(mins)/nullif(max(lanzadas), 0), 6) AS min_por_ud FROM flow GROUP BY 1, 2""")
def a42b(spark, sf):
    """The pivots in long form, which needs no list of operations."""
    return i.rounded(p.operation_totals(life(spark, sf)), 6)


@register("S13_tool_changes_csv", ("ops",), CUT + """
  SELECT CAST(machine_id AS VARCHAR) AS machine_id, machine_name, ts_cambio, piezas_hasta_cambio, scrap_hasta_cambio, duracion_cambio_min, ops_hasta_cambio FROM ch""")
def s13(spark, sf):
    """Written as CSV and read back with text ids."""
    path = f"{out_dir(spark, sf)}/fresa_csv"
    files.write_csv(changes(spark, sf), path)
    return files.read_tool_changes(spark, path)
