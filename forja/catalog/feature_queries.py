"""Feature tables, splits and metrics over fixed predictions."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from forja.catalog import inputs as i
from forja.catalog.base import last_op_sql, register
from forja.catalog.route_queries import CUT, FLOW, FLOW_T, changes, life
from forja.functions import scalar as x
from forja.ml import metrics as m
from forja.plans import features as f
from forja.plans import oee
from forja.plans.tooling import next_change
from forja.staging import staged

MINS = ", ".join(f"sum(CASE WHEN estado = '{s}' THEN duracion_min ELSE 0 END) AS {n}"
                 for s, n in (("produccion", "dur_prod"), ("preparacion", "dur_prep"), ("incidencia", "dur_inci")))
RATIOS = """dur_prod + dur_prep + dur_inci AS total_dur,
    CASE WHEN dur_prod + dur_prep + dur_inci > 0 THEN dur_prod/(dur_prod + dur_prep + dur_inci) END AS disponibilidad,
    piezas_ok + piezas_scrap AS total_piezas, CASE WHEN piezas_ok + piezas_scrap > 0 THEN piezas_scrap/(piezas_ok + piezas_scrap) END AS scrap_rate,
    CASE WHEN dur_prod > 0 THEN 60*piezas_ok/dur_prod END AS uph_real,
    CASE WHEN dur_prod > 0 THEN dur_prep/dur_prod END AS prep_ratio, CASE WHEN dur_prod > 0 THEN dur_inci/dur_prod END AS inci_ratio"""


def metric_sql(keys: str) -> str:
    return f"""mt AS (SELECT {keys}, {MINS}, count(work_order_id) AS n_operaciones, max(ts_ini) AS hasta FROM ops GROUP BY {keys}),
    mp AS (SELECT {keys}, sum(piezas_ok) AS ok, sum(piezas_scrap) AS sc FROM {last_op_sql('ops')} GROUP BY {keys}),
    mj AS (SELECT mt.*, coalesce(ok, 0) AS piezas_ok, coalesce(sc, 0) AS piezas_scrap FROM mt LEFT JOIN mp USING ({keys})),
    met AS (SELECT *, {RATIOS} FROM mj)"""


def state_sql(t: dict | None = None) -> str:
    v = {**x.STATE_THRESHOLDS, **(t or {})}
    return (f"CASE WHEN disponibilidad >= {v['exc_disp']} AND scrap_rate <= {v['exc_scrap']} AND uph_real >= {v['exc_uph']} THEN 'EXCELENTE' "
            f"WHEN disponibilidad >= {v['buena_disp']} AND scrap_rate <= {v['buena_scrap']} AND uph_real >= {v['buena_uph']} THEN 'BUENA' "
            f"WHEN disponibilidad < {v['crit_disp']} OR scrap_rate > {v['crit_scrap']} THEN 'CRITICA' ELSE 'REQUIERE_ATENCION' END")


ALT = {"exc_disp": 0.80, "buena_disp": 0.60, "buena_scrap": 0.06, "crit_disp": 0.45}
MACH = "WITH " + metric_sql("machine_name")
WEEK = "WITH " + metric_sql("machine_name, periodo") + f""",
    weeks AS (SELECT *, {state_sql()} AS estado, {state_sql(ALT)} AS estado_alt FROM met
      WHERE total_dur > 60 AND disponibilidad IS NOT NULL AND scrap_rate IS NOT NULL AND uph_real IS NOT NULL)"""
A36_COLS = "machine_name, dur_prod, dur_prep, dur_inci, piezas_ok, piezas_scrap, total_dur, disponibilidad, total_piezas, scrap_rate, uph_real"
A37_COLS = A36_COLS + ", periodo, n_operaciones, prep_ratio, inci_ratio"


@register("A36_machine_metrics", ("ops",), MACH + f"SELECT {A36_COLS} FROM met WHERE total_dur > 0")
def a36(spark, sf):
    return f.machine_features(i.ops(spark, sf))


@register("J6_minutes_with_pieces", ("ops",), MACH + "SELECT machine_name, dur_prod, piezas_ok, piezas_scrap FROM mj")
def j6(spark, sf):
    return f.machine_metrics(i.ops(spark, sf)).select("machine_name", "dur_prod", "piezas_ok", "piezas_scrap")


def weeks(spark, sf):
    """Machine weeks, staged once for the queries that build on them."""
    return staged(spark, sf, "semanas", lambda: f.machine_weeks(i.ops(spark, sf)))


@register("A37_machine_weeks", ("ops",), WEEK + f"SELECT {A37_COLS} FROM weeks")
def a37(spark, sf):
    return f.machine_weeks(i.ops(spark, sf)).drop("hasta")


@register("J7_week_minutes_with_pieces", ("ops",), WEEK + "SELECT machine_name, periodo, dur_prod, piezas_ok, piezas_scrap FROM mj")
def j7(spark, sf):
    return f.machine_metrics(i.ops(spark, sf), ["machine_name", "periodo"]).select("machine_name", "periodo", "dur_prod", "piezas_ok", "piezas_scrap")


@register("K20_machine_states", ("ops",), WEEK + f"SELECT {A37_COLS}, estado FROM weeks")
def k20(spark, sf):
    return f.with_state(f.machine_weeks(i.ops(spark, sf))).drop("hasta")


@register("P24_custom_thresholds", ("ops",), WEEK + "SELECT estado, estado_alt, count(*) AS n FROM weeks GROUP BY 1, 2")
def p24(spark, sf):
    w = weeks(spark, sf)
    return w.groupBy(x.machine_state().alias("estado"), x.machine_state(thresholds=ALT).alias("estado_alt")).agg(F.count("*").alias("n"))


@register("P26_state_code", ("ops",), WEEK + """
    SELECT machine_name, periodo, CASE estado WHEN 'EXCELENTE' THEN 3 WHEN 'BUENA' THEN 2 WHEN 'REQUIERE_ATENCION' THEN 1 ELSE 0 END AS codigo FROM weeks""")
def p26(spark, sf):
    return f.with_state(weeks(spark, sf)).select("machine_name", "periodo", x.state_code("estado").alias("codigo"))


@register("A45_state_distribution", ("ops",), WEEK + """SELECT estado, count(*) AS n, count(CASE WHEN estado = estado_alt THEN 1 END) AS iguales,
      (SELECT count(*) FROM weeks w WHERE w.estado_alt = weeks.estado) AS n_predichas FROM weeks GROUP BY 1""")
def a45(spark, sf):
    """Real states and, for a stated rule as the prediction, the predicted ones."""
    w = weeks(spark, sf).select(x.machine_state().alias("estado"), x.machine_state(thresholds=ALT).alias("predicho"))
    return m.state_counts(w, "estado", "predicho")


@register("W7_latest_period", ("ops",), WEEK + """
    SELECT machine_name, periodo, hasta, estado FROM weeks QUALIFY row_number() OVER (PARTITION BY machine_name ORDER BY hasta DESC, periodo DESC) = 1""")
def w7(spark, sf):
    return f.latest_period(f.with_state(weeks(spark, sf))).select("machine_name", "periodo", "hasta", "estado")


ZW = WEEK + """, st AS (SELECT """ + ", ".join(f"avg({c}) AS a_{c}, CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1 END AS d_{c}" for c in f.CLUSTER_FEATURES) + """ FROM weeks),
    zw AS (SELECT machine_name, periodo, estado AS cluster, """ + ", ".join(f"({c} - a_{c})/d_{c} AS z_{c}" for c in f.CLUSTER_FEATURES) + " FROM weeks, st)"
ZCOLS = [f"z_{c}" for c in f.CLUSTER_FEATURES]


def z_weeks(spark, sf):
    w = f.with_state(weeks(spark, sf)).withColumnRenamed("estado", "cluster")
    return m.standardise(w, f.CLUSTER_FEATURES)


@register("M1_standardised", ("ops",), ZW + "SELECT machine_name, periodo, " + ", ".join(f"round({c}, 5) AS {c}" for c in ZCOLS) + " FROM zw")
def m1(spark, sf):
    return i.rounded(z_weeks(spark, sf).select("machine_name", "periodo", *ZCOLS), 5)


SUMMARY = """SELECT cluster, count(*) AS n_maquinas, avg(disponibilidad) AS disp_media, avg(scrap_rate) AS scrap_medio, avg(uph_real) AS uph_media
    FROM (SELECT *, estado AS cluster FROM weeks) GROUP BY 1"""


@register("A38_cluster_summary", ("ops",), WEEK + f"SELECT cluster, n_maquinas, round(disp_media, 6) AS disp_media, round(scrap_medio, 6) AS scrap_medio, round(uph_media, 4) AS uph_media FROM ({SUMMARY})")
def a38(spark, sf):
    return i.rounded(f.cluster_summary(f.with_state(weeks(spark, sf)).withColumnRenamed("estado", "cluster")), uph_media=4)


@register("P25_cluster_meaning", ("ops",), WEEK + f"""SELECT cluster, CASE WHEN disp_media >= 0.80 AND scrap_medio <= 0.03 THEN 'mejor rendimiento'
    WHEN disp_media < 0.60 THEN 'baja disponibilidad' WHEN scrap_medio > 0.08 THEN 'alto scrap' WHEN n_maquinas <= 2 THEN 'atipico'
    ELSE 'rendimiento normal' END AS significado FROM ({SUMMARY})""")
def p25(spark, sf):
    s = f.cluster_summary(f.with_state(weeks(spark, sf)).withColumnRenamed("estado", "cluster"))
    return s.select("cluster", x.cluster_meaning("n_maquinas", "disp_media", "scrap_medio").alias("significado"))


def dot(a: str, b: str) -> str:
    return "(" + " + ".join(f"{a.format(c)}*{b.format(c)}" for c in ZCOLS) + ")"


CEN = ZW + """, cs AS (SELECT cluster, count(*) AS n, """ + ", ".join(f"avg({c}) AS c_{c}" for c in ZCOLS) + f", avg({dot('{}', '{}')}) AS q FROM zw GROUP BY 1)"


@register("M5_silhouette", ("ops",), CEN + f""",
    d AS (SELECT machine_name, periodo, p.cluster AS c0, cs.cluster AS c1, cs.n, {dot('p.{}', 'p.{}')} + q - 2*{dot('p.{}', 'c_{}')} AS md FROM zw p, cs),
    ab AS (SELECT machine_name, periodo, max(CASE WHEN c0 = c1 THEN n END) AS n0, max(CASE WHEN c0 = c1 AND n > 1 THEN md*n/(n-1) END) AS a,
      min(CASE WHEN c0 <> c1 THEN md END) AS b FROM d GROUP BY 1, 2)
    SELECT round(avg(CASE WHEN n0 = 1 THEN 0 ELSE coalesce((b-a)/nullif(greatest(a, b), 0), 0) END), 5) AS silhouette FROM ab WHERE b IS NOT NULL""")
def m5(spark, sf):
    return i.rounded(m.silhouette(z_weeks(spark, sf), ZCOLS, noise=None), 5)


@register("M6_davies_bouldin", ("ops",), CEN + """,
    sp AS (SELECT p.cluster, avg(sqrt(""" + " + ".join(f"(p.{c}-cs.c_{c})**2" for c in ZCOLS) + """)) AS s FROM zw p JOIN cs USING (cluster) GROUP BY 1),
    k AS (SELECT * FROM cs JOIN sp USING (cluster)),
    r AS (SELECT a.cluster, max((a.s + b.s)/sqrt(""" + " + ".join(f"(a.c_{c}-b.c_{c})**2" for c in ZCOLS) + """)) AS r FROM k a JOIN k b ON a.cluster <> b.cluster GROUP BY 1)
    SELECT round(avg(r), 5) AS davies_bouldin FROM r""")
def m6(spark, sf):
    return i.rounded(m.davies_bouldin(z_weeks(spark, sf), ZCOLS, noise=None), 5)


@register("M7_calinski_harabasz", ("ops",), CEN + """,
    w AS (SELECT sum(""" + " + ".join(f"(p.{c}-cs.c_{c})**2" for c in ZCOLS) + """) AS w FROM zw p JOIN cs USING (cluster)),
    t AS (SELECT count(*) AS n, """ + ", ".join(f"avg({c}) AS g_{c}" for c in ZCOLS) + """ FROM zw),
    b AS (SELECT sum(cs.n*(""" + " + ".join(f"(c_{c}-g_{c})**2" for c in ZCOLS) + """)) AS b, count(*) AS k FROM cs, t)
    SELECT round((b/(k-1))/(w/(n-k)), 3) AS calinski_harabasz FROM w, b, (SELECT n FROM t)""")
def m7(spark, sf):
    return i.rounded(m.calinski_harabasz(z_weeks(spark, sf), ZCOLS, noise=None), 3)


BAND = "CASE WHEN {v} > {a} THEN 'alta' WHEN {v} > {b} THEN 'media' ELSE 'baja' END"


@register("M30_silhouette_band", ("ops",), CEN + f""",
    d AS (SELECT machine_name, periodo, p.cluster AS c0, cs.cluster AS c1, cs.n, {dot('p.{}', 'p.{}')} + q - 2*{dot('p.{}', 'c_{}')} AS md FROM zw p, cs),
    ab AS (SELECT machine_name, periodo, max(CASE WHEN c0 = c1 THEN n END) AS n0, max(CASE WHEN c0 = c1 AND n > 1 THEN md*n/(n-1) END) AS a,
      min(CASE WHEN c0 <> c1 THEN md END) AS b FROM d GROUP BY 1, 2),
    v AS (SELECT avg(CASE WHEN n0 = 1 THEN 0 ELSE coalesce((b-a)/nullif(greatest(a, b), 0), 0) END) AS v FROM ab WHERE b IS NOT NULL)
    SELECT {BAND.format(v='v', a=0.5, b=0.3)} AS banda FROM v""")
def m30b(spark, sf):
    return m.silhouette(z_weeks(spark, sf), ZCOLS, noise=None).select(x.quality_band("silhouette", "silhouette").alias("banda"))


@register("M30_accuracy_band", ("ops",), WEEK + f""", v AS (SELECT avg(CASE WHEN estado = estado_alt THEN 1.0 ELSE 0 END) AS v FROM weeks)
    SELECT {BAND.format(v='v', a=0.85, b=0.7)} AS banda FROM v""")
def m30c(spark, sf):
    w = weeks(spark, sf).select(x.machine_state().alias("estado"), x.machine_state(thresholds=ALT).alias("predicho"))
    hit = w.agg(F.avg(F.when(F.col("estado") == F.col("predicho"), 1.0).otherwise(0.0)).alias("v"))
    return hit.select(x.quality_band("accuracy", "v").alias("banda"))


# --- scrap features and regression metrics ----------------------------------

SCRAP = """WITH v AS (SELECT * FROM ops WHERE total_piezas > 0),
    top AS (SELECT machine_name FROM v GROUP BY 1 ORDER BY count(*) DESC, machine_name LIMIT 10),
    ft AS (SELECT work_order_id, machine_name, ts_ini, ref_id_str, op_id, duracion_min, CAST(hour(ts_ini) AS INTEGER) AS hora_del_dia,
      CAST(isodow(ts_ini) - 1 AS INTEGER) AS dia_semana, count(*) OVER (PARTITION BY ref_id_str) AS ref_frequency, piezas_scrap/total_piezas AS scrap_rate,
      CASE WHEN estado = 'produccion' THEN 1 ELSE 0 END AS estado_produccion, CASE WHEN estado = 'preparacion' THEN 1 ELSE 0 END AS estado_preparacion,
      CASE WHEN estado = 'incidencia' THEN 1 ELSE 0 END AS estado_incidencia,
      CASE WHEN machine_name IN (SELECT machine_name FROM top) THEN machine_name ELSE 'otras' END AS machine_group FROM v)"""
PRED = SCRAP + """, hist AS (SELECT machine_name, avg(scrap_rate) AS pred FROM ft GROUP BY 1), refh AS (SELECT ref_id_str, avg(scrap_rate) AS pred2 FROM ft GROUP BY 1),
    pr AS (SELECT ft.*, pred, pred2 FROM ft JOIN hist USING (machine_name) JOIN refh USING (ref_id_str))"""


def top_machines(spark, sf):
    """The machines that are a group of their own, staged once."""
    return staged(spark, sf, "maquinas_top", lambda: f.machine_groups(i.ops(spark, sf).where(F.col("total_piezas") > 0)))


def features(spark, sf):
    ops = i.ops(spark, sf)
    freq = staged(spark, sf, "frecuencia_ref", lambda: f.reference_frequency(ops))
    return f.scrap_features(ops, freq=freq, top=top_machines(spark, sf))


def baseline(spark, sf):
    """Mean scrap of the machine and of the reference, as two predictions.

    The means are stored: their size is known, so that no operation is
    shuffled while they are few, and none carries more than its own columns.
    """
    rows = f.scrap_rows(i.ops(spark, sf)).select("machine_name", "ref_id_str", "hora_del_dia", "dia_semana", "scrap_rate")
    a = staged(spark, sf, "scrap_maquina", lambda: rows.groupBy("machine_name").agg(F.avg("scrap_rate").alias("pred")))
    b = staged(spark, sf, "scrap_ref", lambda: rows.groupBy("ref_id_str").agg(F.avg("scrap_rate").alias("pred2")))
    known = rows.where(F.col("machine_name").isNotNull() & F.col("ref_id_str").isNotNull())
    return known.join(a, "machine_name", "left").join(b, "ref_id_str", "left")


@register("M10_scrap_features", ("ops",), SCRAP + "SELECT * FROM ft")
def m10(spark, sf):
    return features(spark, sf)


@register("P22_machine_groups", ("ops",), SCRAP + "SELECT machine_group, count(*) AS n FROM ft GROUP BY 1")
def p22(spark, sf):
    return features(spark, sf).groupBy("machine_group").agg(F.count("*").alias("n"))


@register("M13_aligned", ("ops",), SCRAP + """
    SELECT work_order_id, ts_ini, CAST(hora_del_dia AS DOUBLE) AS hora_del_dia, 0.0::DOUBLE AS no_existe, duracion_min, CAST(ref_frequency AS DOUBLE) AS ref_frequency FROM ft""")
def m13(spark, sf):
    return f.align(features(spark, sf), ["hora_del_dia", "no_existe", "duracion_min", "ref_frequency"], keep=["work_order_id", "ts_ini"])


RMET = """count(*) AS n, avg(abs({y}-{p})) AS mae, sqrt(avg(({y}-{p})**2)) AS rmse, 1 - sum(({y}-{p})**2)/(var_pop({y})*count(*)) AS r2"""


@register("M12_regression_metrics", ("ops",), PRED + "SELECT n, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(r2, 6) AS r2 FROM (SELECT " + RMET.format(y="scrap_rate", p="pred") + " FROM pr)")
def m12(spark, sf):
    return i.rounded(m.regression_metrics(baseline(spark, sf), "scrap_rate", "pred"))


@register("M27_intervals", ("ops",), PRED + """
    SELECT machine_name, count(*) AS n, round(sum(greatest(pred - 1.96*0.02, 0)), 4) AS inferior, round(sum(least(pred + 1.96*0.02, 1)), 4) AS superior FROM pr GROUP BY 1""")
def m27(spark, sf):
    p = m.with_interval(baseline(spark, sf), "pred")
    return i.rounded(p.groupBy("machine_name").agg(F.count("*").alias("n"), F.sum("inferior").alias("inferior"), F.sum("superior").alias("superior")), 4)


@register("M28_compare_models", ("ops",), PRED + """, a AS (SELECT """ + RMET.format(y="scrap_rate", p="pred") + " FROM pr), b AS (SELECT " + RMET.format(y="scrap_rate", p="pred2") + """ FROM pr)
    SELECT """ + ", ".join(f"round(a.{c}, 6) AS {c}_nuevo, round(b.{c}, 6) AS {c}_guardado, round(a.{c} - b.{c}, 6) AS {c}_delta" for c in ("mae", "rmse", "r2")) + " FROM a, b")
def m28(spark, sf):
    return i.rounded(m.compare_models(baseline(spark, sf), "scrap_rate", "pred", "pred2"))


@register("M30_quality_bands", ("ops",), PRED + """, r AS (SELECT dia_semana, """ + RMET.format(y="scrap_rate", p="pred") + """ FROM pr GROUP BY 1)
    SELECT dia_semana, CASE WHEN r2 > 0.7 THEN 'alta' WHEN r2 > 0.5 THEN 'media' ELSE 'baja' END AS banda_r2,
      CASE WHEN abs(r2) > 0.1 THEN 'sobreajuste' ELSE 'generaliza' END AS banda_gap FROM r""")
def m30(spark, sf):
    r = m.regression_metrics(baseline(spark, sf), "scrap_rate", "pred", ["dia_semana"])
    return r.select("dia_semana", x.quality_band("r2", "r2").alias("banda_r2"), x.quality_band("gap", F.abs("r2")).alias("banda_gap"))


@register("M32_error_histogram", ("ops",), PRED + """, e AS (SELECT abs(scrap_rate - pred2) AS e FROM pr)
    SELECT CAST(least(floor(e/(SELECT max(e) FROM e)*30), 29) AS INTEGER) AS barra, count(*) AS n FROM e GROUP BY 1""")
def m32(spark, sf):
    return m.error_histogram(baseline(spark, sf), "scrap_rate", "pred2")


@register("A46_error_by_hour", ("ops",), PRED + """
    SELECT hora_del_dia, round(avg(scrap_rate), 6) AS "real", round(avg(pred), 6) AS predicho, round(avg(abs(scrap_rate - pred)), 6) AS error_medio, count(*) AS n_operaciones FROM pr GROUP BY 1""")
def a46(spark, sf):
    return i.rounded(m.error_by(baseline(spark, sf), "hora_del_dia", "scrap_rate", "pred"))


@register("A46_error_by_machine", ("ops",), PRED + """
    SELECT machine_name, round(avg(scrap_rate), 6) AS "real", round(avg(pred2), 6) AS predicho, round(avg(abs(scrap_rate - pred2)), 6) AS error_medio, count(*) AS n_operaciones
    FROM pr GROUP BY 1 ORDER BY avg(abs(scrap_rate - pred2)) DESC, machine_name LIMIT 10""")
def a46b(spark, sf):
    from forja.operators.ordered import top_k

    return i.rounded(top_k(m.error_by(baseline(spark, sf), "machine_name", "scrap_rate", "pred2"), 10, F.desc("error_medio"), F.col("machine_name")))


# --- classification metrics -------------------------------------------------


@register("M16_classification_report", ("ops",), WEEK + """,
    cl AS (SELECT estado AS clase FROM weeks UNION SELECT estado_alt FROM weeks),
    g AS (SELECT clase, (SELECT count(*) FROM weeks WHERE estado = clase) AS s, (SELECT count(*) FROM weeks WHERE estado_alt = clase) AS p,
      (SELECT count(*) FROM weeks WHERE estado = clase AND estado_alt = clase) AS tp FROM cl),
    h AS (SELECT clase, s AS soporte, tp, CASE WHEN p > 0 THEN tp::DOUBLE/p ELSE 0 END AS precision, CASE WHEN s > 0 THEN tp::DOUBLE/s ELSE 0 END AS recall FROM g),
    r AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2*precision*recall/(precision + recall) ELSE 0 END AS f1 FROM h)
    SELECT clase, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, soporte FROM r
    UNION ALL SELECT 'macro', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(soporte)::BIGINT FROM r
    UNION ALL SELECT 'ponderada', round(sum(precision*soporte)/sum(soporte), 6), round(sum(recall*soporte)/sum(soporte), 6), round(sum(f1*soporte)/sum(soporte), 6), sum(soporte)::BIGINT FROM r
    UNION ALL SELECT 'exactitud', round(sum(tp)/sum(soporte), 6), round(sum(tp)/sum(soporte), 6), round(sum(tp)/sum(soporte), 6), sum(soporte)::BIGINT FROM r""")
def m16(spark, sf):
    w = weeks(spark, sf).select(x.machine_state().alias("real_"), x.machine_state(thresholds=ALT).alias("pred_"))
    return i.rounded(m.classification_report(w, "real_", "pred_"))


@register("M16_confusion", ("ops",), WEEK + 'SELECT estado AS "real", estado_alt AS predicho, count(*) AS n FROM weeks GROUP BY 1, 2')
def m16b(spark, sf):
    w = weeks(spark, sf).select(x.machine_state().alias("real_"), x.machine_state(thresholds=ALT).alias("pred_"))
    return m.confusion(w, "real_", "pred_")


SCORES = {"EXCELENTE": "disponibilidad", "BUENA": "1 - scrap_rate", "CRITICA": "1 - disponibilidad", "REQUIERE_ATENCION": "scrap_rate"}
ROC = WEEK + ", sc AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS clase, round({e}, 3) AS score, estado = '{c}' AS pos FROM weeks" for c, e in SCORES.items()) + """),
    g AS (SELECT clase, score, count_if(pos)::BIGINT AS p, count_if(NOT pos)::BIGINT AS f FROM sc GROUP BY 1, 2),
    r AS (SELECT *, CAST(sum(p) OVER w AS BIGINT) AS tp, CAST(sum(f) OVER w AS BIGINT) AS fp, sum(p) OVER c AS np, sum(f) OVER c AS nf FROM g
      WINDOW w AS (PARTITION BY clase ORDER BY score DESC ROWS UNBOUNDED PRECEDING), c AS (PARTITION BY clase))"""


def roc(spark, sf):
    w = f.with_state(weeks(spark, sf))
    items = F.array(*[F.struct(F.lit(c).alias("clase"), F.round(F.expr(e), 3).alias("score"), (F.col("estado") == c).alias("positivo")) for c, e in SCORES.items()])
    return m.roc_points(w.select(F.explode(items).alias("i")).select("i.*"))


@register("M17_roc_points", ("ops",), ROC + "SELECT clase, score, tp, fp, round(fp::DOUBLE/nf::DOUBLE, 6) AS fpr, round(tp::DOUBLE/np::DOUBLE, 6) AS tpr FROM r")
def m17(spark, sf):
    return i.rounded(roc(spark, sf).select("clase", "score", "tp", "fp", "fpr", "tpr"))


@register("M17_auc", ("ops",), ROC + "SELECT clase, round(sum(f*(2*tp - p)/2.0)::DOUBLE/(max(np)*max(nf))::DOUBLE, 6) AS auc FROM r GROUP BY 1")
def m17b(spark, sf):
    return i.rounded(m.auc(roc(spark, sf)))


# --- splits and order times -------------------------------------------------


@register("M18_hash_split", FLOW_T, FLOW + "SELECT work_order_id, substr(md5(work_order_id), 1, 8) < '33333333' AS es_test FROM vida")
def m18(spark, sf):
    return f.hash_split(life(spark, sf), f.split_key("work_order_id")).select("work_order_id", "es_test")


@register("M19_stratified_split", ("ops",), WEEK + """,
    k AS (SELECT machine_name, periodo, estado, md5(machine_name || '|' || periodo) AS k FROM weeks),
    r AS (SELECT *, row_number() OVER (PARTITION BY estado ORDER BY k) AS rn, count(*) OVER (PARTITION BY estado) AS n FROM k)
    SELECT machine_name, periodo, estado, rn <= ceil(n*0.2::DOUBLE) AS es_test FROM r""")
def m19(spark, sf):
    w = f.with_state(weeks(spark, sf)).select("machine_name", "periodo", "estado")
    return f.stratified_split(w, "estado", f.split_key("machine_name", "periodo"))


@register("M20_temporal_split", ("ops",), CUT + """, mod AS (SELECT * FROM nx WHERE next_ts IS NOT NULL),
    r AS (SELECT *, row_number() OVER (ORDER BY ts_cambio, machine_id, next_ts, piezas_hasta_cambio, ops_hasta_cambio) AS rn, count(*) OVER () AS n FROM mod)
    SELECT machine_id, ts_cambio, rn > floor(n*0.8::DOUBLE) AS es_test FROM r""")
def m20(spark, sf):
    d = next_change(changes(spark, sf))
    return f.temporal_split(d, "ts_cambio", ["machine_id", "next_ts", "piezas_hasta_cambio", "ops_hasta_cambio"]).select("machine_id", "ts_cambio", "es_test")


TIMES = FLOW + """, tm AS (SELECT work_order_id, ref_id_str, cantidad_lanzada, fabricacion_duracion_min + incidencias_duracion_total AS tiempo_total_min FROM vida),
    tp AS (SELECT *, avg(tiempo_total_min) OVER (PARTITION BY ref_id_str) AS pred FROM tm)"""


def order_times(spark, sf):
    from forja.ml.linear import total_time

    return total_time(life(spark, sf)).select("work_order_id", "ref_id_str", "cantidad_lanzada", "tiempo_total_min")


@register("M22_total_time", FLOW_T, TIMES + "SELECT work_order_id, round(tiempo_total_min, 4) AS tiempo_total_min FROM tm")
def m22(spark, sf):
    return i.rounded(order_times(spark, sf).select("work_order_id", "tiempo_total_min"), 4)


@register("M23_duration_metrics", FLOW_T, TIMES + """, e AS (SELECT tiempo_total_min AS y, pred AS p FROM tp WHERE tiempo_total_min IS NOT NULL)
    SELECT n, round(mae, 4) AS mae_min, round(mae/60, 4) AS mae_horas, round(mae/1440, 4) AS mae_dias, round(rmse, 4) AS rmse_min, round(r2, 5) AS r2, round(mape, 4) AS mape_pct FROM
    (SELECT """ + RMET.format(y="y", p="p") + ", 100*avg(CASE WHEN y <> 0 THEN abs(y-p)/abs(y) END) AS mape FROM e)")
def m23(spark, sf):
    t = order_times(spark, sf)
    mean = t.groupBy("ref_id_str").agg(F.avg("tiempo_total_min").alias("pred"))
    return i.rounded(m.duration_metrics(t.join(mean, "ref_id_str"), "tiempo_total_min", "pred"), 4, r2=5)


T6_DAYS = 7


@register("T6_availability_pivot", ("ops",), """WITH d AS (SELECT machine_name, fecha, CASE WHEN sum(duracion_min) > 0
      THEN sum(CASE WHEN estado = 'produccion' THEN duracion_min ELSE 0 END)/sum(duracion_min) ELSE 0 END AS v
      FROM ops WHERE machine_name IS NOT NULL AND fecha IS NOT NULL GROUP BY 1, 2),
    n AS (SELECT machine_name, v, date_diff('day', fecha, (SELECT max(fecha) FROM d)) AS hace FROM d)
    SELECT machine_name, """ + ", ".join(f"max(CASE WHEN hace = {k} THEN v END) AS hace_{k}" for k in range(T6_DAYS)) + f""",
      count(CASE WHEN hace >= {T6_DAYS} THEN 1 END) AS dias_fuera FROM n GROUP BY 1""")
def t6(spark, sf):
    """Machine x date over the last days with data; the days outside are counted."""
    days = oee.machine_day_availability(i.ops(spark, sf))
    last = days.agg(F.max("fecha").alias("f")).first()["f"]
    if last is None:
        last = date(1970, 1, 1)
    wide = oee.availability_pivot(days, last - timedelta(days=T6_DAYS - 1), last)
    names = {str(last - timedelta(days=k)): f"hace_{k}" for k in range(T6_DAYS)}
    return wide.select("machine_name", *[F.col(f"`{d}`").alias(n) for d, n in names.items()], "dias_fuera")
