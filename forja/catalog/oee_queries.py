"""OEE family."""

from __future__ import annotations

from pyspark.sql import functions as F

from forja.catalog import inputs as i
from forja.catalog.base import last_op_sql, register
from forja.functions import scalar as x
from forja.operators.lastop import last_valid_ops
from forja.operators.states import merged_states, state_quantiles
from forja.plans import oee as p
from forja.staging import staged


def oee_sql(by: str = "", where: str = "", prefix: str = "") -> str:
    """CTEs ending in ``kpi``: the OEE record per ``by`` (a column or '')."""
    b = f"{by}, " if by else ""
    on = f"USING ({by})" if by else "ON true"
    notnull = f"AND {by} IS NOT NULL" if by else ""
    keys = ", ".join(dict.fromkeys([*([by] if by else []), "machine_name", "ref_id_str"]))
    return f"""WITH src AS (SELECT * FROM ops WHERE true {notnull} {where}),
    bench AS (SELECT {keys}, quantile_cont(c, 0.25) AS p25, quantile_cont(c, 0.5) AS med FROM (
        SELECT {keys}, duracion_min*60/total_piezas AS c FROM src
        WHERE estado = 'produccion' AND duracion_min > 0 AND total_piezas > 0)
      WHERE c BETWEEN 1 AND 600 GROUP BY {keys}),
    overall AS (SELECT {b} quantile_cont(med, 0.5) AS gmed FROM bench {'GROUP BY ' + by if by else ''}),
    tgt AS (SELECT s.*, coalesce(CASE WHEN piezas_hora_teorico > 0 THEN 3600/piezas_hora_teorico END, p25, med,
        CASE WHEN gmed > 0 THEN gmed WHEN gmed IS NOT NULL THEN 45 END) AS ciclo,
        p25, med, gmed, piezas_hora_teorico
      FROM src s LEFT JOIN rates r ON r.ref_id_str = s.ref_id_str AND r.machine_name = s.machine_name
      LEFT JOIN bench b ON b.machine_name = s.machine_name AND b.ref_id_str = s.ref_id_str
        {f'AND b.{by} = s.{by}' if by and by != 'machine_name' else ''}
      LEFT JOIN overall g {f'ON g.{by} = s.{by}' if by else 'ON true'}),
    mins AS (SELECT {b}
        coalesce(sum(CASE WHEN estado = 'produccion' THEN duracion_min END), 0) AS min_produccion,
        coalesce(sum(CASE WHEN estado = 'preparacion' THEN duracion_min END), 0) AS min_preparacion,
        coalesce(sum(CASE WHEN estado = 'incidencia' THEN duracion_min END), 0) AS min_incidencia,
        coalesce(sum(CASE WHEN estado = 'produccion' AND ciclo > 0 THEN 3600/ciclo*duracion_min/60 END), 0) AS ideal_output,
        avg(CASE WHEN estado = 'produccion' AND ciclo > 0 THEN 3600/ciclo END) AS uph_teorico
      FROM tgt {'GROUP BY ' + by if by else ''}),
    okp AS (SELECT * FROM tgt WHERE estado = 'produccion' AND ciclo > 0),
    fin AS (SELECT {b} sum(piezas_ok) AS ok, sum(piezas_scrap) AS sc
      FROM {last_op_sql('okp', by)} {'GROUP BY ' + by if by else ''}),
    parts AS (SELECT {b} min_produccion, min_preparacion, min_incidencia, ideal_output, uph_teorico,
        coalesce(ok, 0) AS ok, coalesce(sc, 0) AS sc FROM mins LEFT JOIN fin {on}),
    kpi0 AS (SELECT *, CAST(ok AS BIGINT) AS total_ok, CAST(sc AS BIGINT) AS total_scrap,
        CAST(ok + sc AS BIGINT) AS total_piezas, ok + sc AS actual_output,
        CASE WHEN min_produccion + min_preparacion + min_incidencia > 0
          THEN min_produccion / (min_produccion + min_preparacion + min_incidencia) END AS availability,
        CASE WHEN ok + sc > 0 AND ideal_output > 0 THEN (ok + sc) / ideal_output END AS performance,
        CASE WHEN ok + sc > 0 THEN ok / (ok + sc) END AS quality,
        CASE WHEN min_produccion > 0 THEN (ok + sc) / (min_produccion / 60) END AS uph_real FROM parts),
    kpi AS (SELECT *, availability*performance*quality AS oee FROM kpi0)
    """


KPI_COLS = """round(availability, 6) AS availability, round(performance, 6) AS performance,
    round(quality, 6) AS quality, round(oee, 6) AS oee, min_produccion, min_preparacion, min_incidencia,
    total_ok, total_scrap, total_piezas, round(uph_real, 6) AS uph_real, round(uph_teorico, 6) AS uph_teorico,
    actual_output, round(ideal_output, 3) AS ideal_output"""

OPS_RATES = ("ops", "rates")


def _kpi(spark, sf, by=()):
    return i.rounded(p.oee(i.ops(spark, sf), i.rates(spark, sf), by), ideal_output=3)


@register("K2_oee", OPS_RATES, oee_sql() + f"SELECT {KPI_COLS} FROM kpi")
def k2(spark, sf):
    return _kpi(spark, sf)


@register("K3_target_cycle", OPS_RATES, oee_sql() + """
    SELECT machine_name, ref_id_str, round(max(ciclo), 6) AS ciclo_objetivo_s, count(*) AS operaciones
    FROM tgt GROUP BY machine_name, ref_id_str""")
def k3(spark, sf):
    ops = i.ops(spark, sf)
    t = p.targets(ops, i.rates(spark, sf)).select("machine_name", "ref_id_str", "ciclo_objetivo_s")
    n = ops.groupBy("machine_name", "ref_id_str").agg(F.count("*").alias("operaciones"))
    return i.rounded(t.join(n, ["machine_name", "ref_id_str"]))


@register("K4_oee_daily", OPS_RATES, oee_sql("fecha") + """
    SELECT fecha, round(oee, 6) AS oee, round(availability, 6) AS availability,
      round(performance, 6) AS performance, round(quality, 6) AS quality FROM kpi""")
def k4(spark, sf):
    return i.rounded(p.oee_daily(i.ops(spark, sf), i.rates(spark, sf)))


@register("K5_oee_by_shift", OPS_RATES,
          oee_sql("turno", "AND turno IN ('mañana','tarde','noche')") + f"SELECT turno, {KPI_COLS} FROM kpi")
def k5(spark, sf):
    return i.rounded(p.oee_by_shift(i.ops(spark, sf), i.rates(spark, sf)), ideal_output=3)


@register("K6_oee_by_machine", OPS_RATES, oee_sql("machine_name") + f"SELECT machine_name, {KPI_COLS} FROM kpi")
def k6(spark, sf):
    return _kpi(spark, sf, ["machine_name"])


@register("K7_loss_waterfall", OPS_RATES, oee_sql("turno") + """,
    f AS (SELECT turno, coalesce(availability, 0) AS a, coalesce(performance, 0) AS p, coalesce(quality, 0) AS q,
      coalesce(oee, 0) AS o FROM kpi)
    SELECT turno, 1 AS paso, 'Inicial' AS concepto, 1.0::DOUBLE AS valor FROM f
    UNION ALL SELECT turno, 2, 'Pérdida Disponibilidad', round(-(1-a), 6) FROM f
    UNION ALL SELECT turno, 3, 'Pérdida Rendimiento', round(-(a*(1-p)), 6) FROM f
    UNION ALL SELECT turno, 4, 'Pérdida Calidad', round(-(a*p*(1-q)), 6) FROM f
    UNION ALL SELECT turno, 5, 'OEE Final', round(o, 6) FROM f""")
def k7(spark, sf):
    return i.rounded(p.loss_waterfall(p.oee(i.ops(spark, sf), i.rates(spark, sf), ["turno"]), ["turno"]))


@register("K8_cycle_equivalents", OPS_RATES, oee_sql("turno") + """
    SELECT turno, round(3600/uph_real, 6) AS ciclo_real_s, round(3600/uph_teorico, 6) AS ciclo_objetivo_s,
      round(3600/uph_real - 3600/uph_teorico, 6) AS ciclo_diferencia_s,
      CASE WHEN performance IS NULL THEN 'sin datos' WHEN performance > 1 THEN 'supera objetivo'
        WHEN performance >= 0.9 THEN 'excelente' WHEN performance >= 0.8 THEN 'bueno'
        WHEN performance >= 0.6 THEN 'mejorable' ELSE 'bajo' END AS banda_rendimiento FROM kpi""")
def k8(spark, sf):
    df = p.cycle_equivalents(p.oee(i.ops(spark, sf), i.rates(spark, sf), ["turno"]))
    return i.rounded(df.select("turno", "ciclo_real_s", "ciclo_objetivo_s", "ciclo_diferencia_s", "banda_rendimiento"))


@register("P19_kpi_lights", OPS_RATES, oee_sql("fecha") + """
    SELECT fecha,
      CASE WHEN oee IS NULL THEN '#4b5563' WHEN oee >= 0.75 THEN '#22c55e' WHEN oee >= 0.60 THEN '#fbbf24' ELSE '#ef4444' END AS color_oee,
      CASE WHEN availability IS NULL THEN '#4b5563' WHEN availability >= 0.85 THEN '#22c55e' WHEN availability >= 0.75 THEN '#fbbf24' ELSE '#ef4444' END AS color_availability,
      CASE WHEN performance IS NULL THEN '#4b5563' WHEN performance >= 0.90 THEN '#22c55e' WHEN performance >= 0.80 THEN '#fbbf24' ELSE '#ef4444' END AS color_performance,
      CASE WHEN quality IS NULL THEN '#4b5563' WHEN quality >= 0.97 THEN '#22c55e' WHEN quality >= 0.95 THEN '#fbbf24' ELSE '#ef4444' END AS color_quality
    FROM kpi""")
def p19(spark, sf):
    df = p.kpi_lights(p.oee_daily(i.ops(spark, sf), i.rates(spark, sf)))
    return df.select("fecha", "color_oee", "color_availability", "color_performance", "color_quality")


@register("P20_performance_band", OPS_RATES, oee_sql("fecha") + """
    SELECT CASE WHEN performance IS NULL THEN 'sin datos' WHEN performance > 1 THEN 'supera objetivo'
        WHEN performance >= 0.9 THEN 'excelente' WHEN performance >= 0.8 THEN 'bueno'
        WHEN performance >= 0.6 THEN 'mejorable' ELSE 'bajo' END AS banda, count(*) AS dias FROM kpi GROUP BY 1""")
def p20(spark, sf):
    df = p.oee_daily(i.ops(spark, sf), i.rates(spark, sf))
    return df.groupBy(x.performance_band("performance").alias("banda")).agg(F.count("*").alias("dias"))


@register("A1_state_minutes", ("ops",), """
    SELECT machine_name,
      sum(CASE WHEN estado = 'produccion' THEN duracion_min ELSE 0 END) AS min_produccion,
      sum(CASE WHEN estado = 'preparacion' THEN duracion_min ELSE 0 END) AS min_preparacion,
      sum(CASE WHEN estado = 'incidencia' THEN duracion_min ELSE 0 END) AS min_incidencia,
      CASE WHEN sum(duracion_min) > 0 THEN sum(CASE WHEN estado = 'produccion' THEN duracion_min ELSE 0 END) / sum(duracion_min) END AS availability
    FROM ops GROUP BY machine_name""")
def a1(spark, sf):
    made = [F.sum(F.when(F.col("estado") == s, F.col("duracion_min")).otherwise(0.0)).alias(f"min_{s}") for s in x.STATES]
    df = i.ops(spark, sf).groupBy("machine_name").agg(*made)
    total = F.col("min_produccion") + F.col("min_preparacion") + F.col("min_incidencia")
    return df.withColumn("availability", x.ratio(F.col("min_produccion"), total))


@register("A2_cycle_benchmarks", ("ops",), """
    SELECT machine_name, ref_id_str, round(quantile_cont(c, 0.25), 6) AS ciclo_p25, round(quantile_cont(c, 0.5), 6) AS ciclo_mediana
    FROM (SELECT *, duracion_min*60/total_piezas AS c FROM ops
      WHERE estado = 'produccion' AND duracion_min > 0 AND total_piezas > 0) WHERE c BETWEEN 1 AND 600
    GROUP BY machine_name, ref_id_str""")
def a2(spark, sf):
    return i.rounded(p.cycle_benchmarks(i.ops(spark, sf)))


@register("A2_cycle_states", ("ops",), """
    SELECT mes, machine_name, ref_id_str, count(*) AS n, round(quantile_disc(c, 0.25), 6) AS ciclo_p25, round(quantile_disc(c, 0.5), 6) AS ciclo_mediana
    FROM (SELECT *, duracion_min*60/total_piezas AS c FROM ops
      WHERE estado = 'produccion' AND duracion_min > 0 AND total_piezas > 0) WHERE c BETWEEN 1 AND 600 AND mes IS NOT NULL
    GROUP BY mes, machine_name, ref_id_str""")
def a2_states(spark, sf):
    """Monthly benchmarks from the stored states of the days: exact up to K operations a group, beyond that within the rank error."""
    month = F.trunc("fecha", "MM")
    days = staged(spark, sf, "cycle_states", lambda: p.cycle_states(i.ops(spark, sf).withColumn("mes", month), ["mes", "fecha"]), by="mes")
    months = merged_states(days, ["mes", "machine_name", "ref_id_str"])
    return i.rounded(state_quantiles(months, p.BENCHMARKS))


@register("A3_global_cycle", ("ops",), """
    SELECT round(quantile_cont(m, 0.5), 6) AS ciclo_global FROM (SELECT quantile_cont(c, 0.5) AS m
    FROM (SELECT *, duracion_min*60/total_piezas AS c FROM ops
      WHERE estado = 'produccion' AND duracion_min > 0 AND total_piezas > 0) WHERE c BETWEEN 1 AND 600
    GROUP BY machine_name, ref_id_str)""")
def a3(spark, sf):
    return i.rounded(p.global_cycle(p.cycle_benchmarks(i.ops(spark, sf))))


@register("W1_last_valid_op", ("ops",), f"""
    SELECT work_order_id, ts_fin, ts_ini, op_id, machine_name, ref_id_str, piezas_ok, piezas_scrap
    FROM {last_op_sql('ops')}""")
def w1(spark, sf):
    return last_valid_ops(i.ops(spark, sf))


@register("A24_daily_pace", OPS_RATES, """
    WITH made AS (SELECT o.*, piezas_hora_teorico FROM ops o LEFT JOIN rates r
        ON r.ref_id_str = o.ref_id_str AND r.machine_name = o.machine_name WHERE estado = 'produccion'),
    hist AS (SELECT machine_name, ref_id_str, least(greatest(sum(piezas_ok)/(sum(duracion_min)/60), 30), 180) AS uph_hist
      FROM made GROUP BY ALL HAVING sum(duracion_min) > 0),
    d AS (SELECT fecha, sum(piezas_ok) AS piezas_ok, sum(duracion_min) AS duracion_min,
        sum(coalesce(nullif(piezas_hora_teorico, 0), uph_hist, 80) * duracion_min/60) AS ideal_piezas
      FROM made LEFT JOIN hist USING (machine_name, ref_id_str) GROUP BY fecha)
    SELECT fecha, piezas_ok, duracion_min, round(ideal_piezas, 2) AS ideal_piezas,
      round(piezas_ok/(duracion_min/60), 6) AS uph_real, round(ideal_piezas/(duracion_min/60), 6) AS uph_ideal
    FROM d WHERE duracion_min > 0""")
def a24(spark, sf):
    return i.rounded(p.daily_pace(i.ops(spark, sf), i.rates(spark, sf)), ideal_piezas=2)


@register("P11_clip", ("ops",), """
    SELECT machine_name, ref_id_str, round(least(greatest(sum(piezas_ok)/(sum(duracion_min)/60), 30), 180), 6) AS uph_hist
    FROM ops WHERE estado = 'produccion' GROUP BY ALL HAVING sum(duracion_min) > 0""")
def p11(spark, sf):
    g = i.ops(spark, sf).where(F.col("estado") == "produccion").groupBy("machine_name", "ref_id_str").agg(
        F.sum("piezas_ok").alias("ok"), F.sum("duracion_min").alias("m")).where(F.col("m") > 0)
    return i.rounded(g.select("machine_name", "ref_id_str", x.clip(F.col("ok") / (F.col("m") / 60), 30, 180).alias("uph_hist")))


AVAIL = """SELECT machine_name, fecha, CASE WHEN sum(duracion_min) > 0
      THEN sum(CASE WHEN estado = 'produccion' THEN duracion_min ELSE 0 END) / sum(duracion_min) ELSE 0 END AS disponibilidad
    FROM ops GROUP BY machine_name, fecha"""


@register("A25_machine_day_availability", ("ops",), AVAIL)
def a25(spark, sf):
    return p.machine_day_availability(i.ops(spark, sf))


@register("A26_distributions", OPS_RATES, oee_sql() + """
    SELECT 'tiempo' AS grupo, 'Producción' AS nombre, min_produccion AS valor FROM kpi
    UNION ALL SELECT 'tiempo', 'Preparación', min_preparacion FROM kpi
    UNION ALL SELECT 'tiempo', 'Incidencias', min_incidencia FROM kpi
    UNION ALL SELECT 'calidad', 'OK', total_ok FROM kpi
    UNION ALL SELECT 'calidad', 'Scrap', total_scrap FROM kpi""")
def a26(spark, sf):
    return p.distributions(p.oee(i.ops(spark, sf), i.rates(spark, sf)))


@register("T5_components_long", OPS_RATES, oee_sql("fecha") + """
    SELECT fecha, 'Disponibilidad' AS componente, round(availability, 6) AS valor FROM kpi WHERE oee IS NOT NULL
    UNION ALL SELECT fecha, 'Rendimiento', round(performance, 6) FROM kpi WHERE oee IS NOT NULL
    UNION ALL SELECT fecha, 'Calidad', round(quality, 6) FROM kpi WHERE oee IS NOT NULL""")
def t5(spark, sf):
    return i.rounded(p.components_long(p.oee_daily(i.ops(spark, sf), i.rates(spark, sf)), "fecha"))


@register("W6_incident_pareto", ("ops",), """
    WITH t AS (SELECT tipo_incidencia, sum(duracion_min) AS duracion_min FROM ops
      WHERE estado = 'incidencia' AND tipo_incidencia IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)
    SELECT tipo_incidencia, duracion_min, round(100*duracion_min/sum(duracion_min) OVER (), 6) AS pct,
      round(100*sum(duracion_min) OVER (ORDER BY duracion_min DESC, tipo_incidencia) / sum(duracion_min) OVER (), 6) AS pct_acum
    FROM t""")
def w6(spark, sf):
    return i.rounded(p.incident_pareto(i.ops(spark, sf)))
