"""Rules that only unclean tables can show: the shop-floor tables with repeats, negative values, missing keys and a hot key.

The unclean tables are whole tables too: every operation once more for one
order in 29, negative minutes or pieces for some lots, NULL orders, machines,
references and starts for others, and half of all rows on one machine and one
reference; headers and rates are repeated with other values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forja import views
from forja.catalog import inputs as i
from forja.catalog.base import CTES, register
from forja.catalog.scalar_queries import NUMERIC, RAW_COLS
from forja.functions import scalar as x
from forja.ml import metrics
from forja.operators.ordered import attach_row, join_spread
from forja.plans import fact as pf
from forja.plans import features as f
from forja.plans import oee
from forja.plans import quality as q
from forja.plans import routes as p
from forja.sources import conform
from forja.staging import temporary

HOT_MACHINE, HOT_REF = "M00000001", "7"

_KEPT = [c for c in RAW_COLS if c not in ("work_order_id", "machine_name", "ref_id", "ts_ini", "duracion_min", "piezas_scrap")]
CTES["raw_dirty"] = (("raw_ops",), f"""
    SELECT {', '.join(_KEPT)},
      CASE WHEN CAST(work_order_id AS BIGINT) % 37 <> 5 THEN work_order_id END AS work_order_id,
      CASE WHEN CAST(work_order_id AS BIGINT) % 41 = 6 THEN NULL WHEN CAST(work_order_id AS BIGINT) % 2 = 0 THEN '{HOT_MACHINE}' ELSE machine_name END AS machine_name,
      CASE WHEN CAST(work_order_id AS BIGINT) % 43 = 8 THEN NULL WHEN CAST(work_order_id AS BIGINT) % 2 = 0 THEN '{HOT_REF}' ELSE ref_id END AS ref_id,
      CASE WHEN CAST(work_order_id AS BIGINT) % 47 <> 9 THEN ts_ini END AS ts_ini,
      CASE WHEN CAST(work_order_id AS BIGINT) % 53 = 3 THEN -duracion_min ELSE duracion_min END AS duracion_min,
      CASE WHEN CAST(work_order_id AS BIGINT) % 59 = 4 THEN -1 - piezas_scrap ELSE piezas_scrap END AS piezas_scrap
    FROM raw_ops, range(2) t(n) WHERE n = 0 OR CAST(work_order_id AS BIGINT) % 29 = 0""")
CTES["ops_dirty"] = (("raw_dirty",), """
    SELECT work_order_id, lpad(ref_id, 6, '0') AS ref_id_str, op_id, machine_name, evento, tipo_incidencia, ts_ini, ts_fin,
      coalesce(duracion_min, 0) AS duracion_min, coalesce(piezas_ok, 0) AS piezas_ok, coalesce(piezas_scrap, 0) AS piezas_scrap,
      coalesce(piezas_ok, 0) + coalesce(piezas_scrap, 0) AS total_piezas,
      CASE WHEN lower(evento) IN ('producción','produccion') THEN 'produccion'
        WHEN lower(evento) IN ('preparación','preparacion') THEN 'preparacion' ELSE 'incidencia' END AS estado,
      CASE WHEN ts_ini IS NULL THEN 'desconocido' WHEN hour(ts_ini) BETWEEN 6 AND 13 THEN 'mañana'
        WHEN hour(ts_ini) BETWEEN 14 AND 21 THEN 'tarde' ELSE 'noche' END AS turno
    FROM raw_dirty""")
CTES["orders_dirty"] = (("orders_h",), """
    SELECT work_order_id, ref_id_str, cliente, qty_plan + 1000*n AS qty_plan, planta_inicio, familia_of || CAST(n AS VARCHAR) AS familia_of
    FROM orders_h, range(3) t(n) WHERE n = 0 OR CAST(work_order_id AS BIGINT) % 4 = 1""")
CTES["rates_dirty"] = (("rates",), """
    SELECT ref_id_str, machine_name, piezas_hora_teorico + n AS piezas_hora_teorico FROM rates, range(3) t(n)""")


def raw_dirty(spark, sf) -> DataFrame:
    o = F.col("work_order_id").cast("bigint")
    base = i.raw_ops(spark, sf).select(*RAW_COLS)
    twice = F.when(o % 29 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return base.withColumn("__n", F.explode(twice)).drop("__n").withColumns({
        "machine_name": F.when(o % 41 == 6, None).when(o % 2 == 0, HOT_MACHINE).otherwise(F.col("machine_name")),
        "ref_id": F.when(o % 43 == 8, None).when(o % 2 == 0, HOT_REF).otherwise(F.col("ref_id")),
        "ts_ini": F.when(o % 47 != 9, F.col("ts_ini")),
        "duracion_min": F.when(o % 53 == 3, -F.col("duracion_min")).otherwise(F.col("duracion_min")),
        "piezas_scrap": F.when(o % 59 == 4, -1 - F.col("piezas_scrap")).otherwise(F.col("piezas_scrap")),
        "work_order_id": F.when(o % 37 != 5, F.col("work_order_id"))})


def ops_dirty(spark, sf) -> DataFrame:
    return conform.conform_ops(raw_dirty(spark, sf))


def orders_dirty(spark, sf) -> DataFrame:
    o = F.col("work_order_id").cast("bigint")
    n = F.explode(F.when(o % 4 == 1, F.sequence(F.lit(0), F.lit(2))).otherwise(F.array(F.lit(0))))
    rows = i.orders(spark, sf).withColumn("__n", n)
    return rows.withColumns({"qty_plan": F.col("qty_plan") + 1000 * F.col("__n"),
                             "familia_of": F.concat("familia_of", F.col("__n").cast("string"))}).drop("__n")


@register("T4_dirty_duplicates", ("raw_dirty",), f"""
    SELECT (SELECT count(*) FROM raw_dirty) AS filas, (SELECT count(*) FROM (SELECT DISTINCT {', '.join(RAW_COLS)} FROM raw_dirty)) AS unicas""")
def t4(spark, sf):
    raw = raw_dirty(spark, sf)
    return attach_row(raw.agg(F.count("*").alias("filas")), raw.dropDuplicates().agg(F.count("*").alias("unicas")))


@register("K19_dirty_clean", ("raw_dirty",), f"""
    SELECT DISTINCT {', '.join(RAW_COLS)}, lpad(ref_id, 6, '0') AS ref_id_str FROM raw_dirty
    WHERE coalesce(duracion_min >= 0, true) AND coalesce(piezas_ok >= 0, true) AND coalesce(piezas_scrap >= 0, true)""")
def k19(spark, sf):
    return q.clean(raw_dirty(spark, sf))


@register("K18_dirty_report", ("raw_dirty",), f"""
    SELECT prueba, columna, valor FROM (
      SELECT 'duplicadas' AS prueba, '*' AS columna,
        ((SELECT count(*) FROM raw_dirty) - (SELECT count(*) FROM (SELECT DISTINCT {', '.join(RAW_COLS)} FROM raw_dirty)))::DOUBLE AS valor
      """ + " ".join(f"UNION ALL SELECT 'negativos', '{c}', (SELECT count_if({c} < 0) FROM raw_dirty)::DOUBLE" for c in NUMERIC)
          + " ".join(f" UNION ALL SELECT 'faltantes', '{c}', (SELECT count_if({c} IS NULL) FROM raw_dirty)::DOUBLE" for c in ("machine_name", "ref_id", "ts_ini", "work_order_id")) + ")")
def k18(spark, sf):
    r = q.quality_report(raw_dirty(spark, sf), "produccion", NUMERIC, ["work_order_id"])
    keys = ("machine_name", "ref_id", "ts_ini", "work_order_id")
    return r.where(F.col("prueba").isin("duplicadas", "negativos") | (F.col("prueba") == "faltantes") & F.col("columna").isin(*keys)).drop("tabla")


BEST = "(SELECT work_order_id, ref_id_str, arg_max({c}, coalesce(qty_plan, -1)) AS {c}, max(qty_plan) AS qty_plan FROM orders_dirty GROUP BY 1, 2)"


@register("J2_dirty_headers", ("ops_dirty", "orders_dirty"), f"""
    SELECT count(*) AS filas, count(qty_plan) AS con_plan, sum(qty_plan)::DOUBLE AS plan, count(familia_of) AS con_familia,
      count(CASE WHEN ends_with(familia_of, '2') AND qty_plan IS NOT NULL THEN 1 END) AS de_la_mayor
    FROM ops_dirty o LEFT JOIN {BEST.format(c='familia_of')} h ON h.work_order_id = o.work_order_id AND h.ref_id_str = o.ref_id_str""")
def j2(spark, sf):
    """Repeated headers neither multiply operations nor hide the largest plan."""
    unique = conform.unique_orders(orders_dirty(spark, sf))
    j = pf.with_order(ops_dirty(spark, sf).select("work_order_id", "ref_id_str"), unique, unique=True)
    return j.agg(F.count("*").alias("filas"), F.count("qty_plan").alias("con_plan"), F.sum("qty_plan").cast("double").alias("plan"),
                 F.count("familia_of").alias("con_familia"), F.count(F.when(F.col("familia_of").endswith("2") & F.col("qty_plan").isNotNull(), 1)).alias("de_la_mayor"))


@register("J5_dirty_headers", ("ops_dirty", "orders_dirty"), """
    SELECT count(*) AS filas, sum(h.qty_plan)::DOUBLE AS plan FROM ops_dirty o
    LEFT JOIN (SELECT work_order_id, max(qty_plan) AS qty_plan FROM orders_dirty GROUP BY 1) h USING (work_order_id)""")
def j5(spark, sf):
    j = p.ops_with_header(ops_dirty(spark, sf).select("work_order_id"), orders_dirty(spark, sf))
    return j.agg(F.count("*").alias("filas"), F.sum("qty_plan").cast("double").alias("plan"))


@register("S2_dirty_rates", ("rates_dirty",), "SELECT ref_id_str, machine_name, max(piezas_hora_teorico) AS piezas_hora_teorico FROM rates_dirty GROUP BY 1, 2")
def s2(spark, sf):
    rates = views.raw_rates(spark, sf).withColumn("__n", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return conform.conform_rates(rates.withColumn("piezas_hora_teorico", F.col("piezas_hora_teorico") + F.col("__n")).drop("__n"))


@register("A33_dirty_frequency", ("ops_dirty",), """
    SELECT ref_id_str, n, count(*) AS filas FROM (SELECT ref_id_str, CASE WHEN ref_id_str IS NOT NULL THEN count(*) OVER (PARTITION BY ref_id_str) END AS n FROM ops_dirty)
    GROUP BY 1, 2""")
def a33(spark, sf):
    """Frequencies with half of all rows on one reference and some without."""
    return q.frequency(ops_dirty(spark, sf), "ref_id_str", "n").groupBy("ref_id_str", "n").agg(F.count("*").alias("filas"))


@register("M10_dirty_features", ("ops_dirty",), """
    SELECT ref_id_str, n AS ref_frequency, count(*) AS filas FROM (SELECT *, count(*) OVER (PARTITION BY ref_id_str) AS n FROM ops_dirty WHERE total_piezas > 0)
    WHERE ts_ini IS NOT NULL GROUP BY 1, 2""")
def m10(spark, sf):
    rows = f.scrap_features(ops_dirty(spark, sf))
    return rows.groupBy("ref_id_str", "ref_frequency").agg(F.count("*").alias("filas"))


@register("A37_dirty_shifts", ("ops_dirty",), """
    SELECT turno, machine_name IS NULL AS sin_maquina, count(*) AS filas, round(sum(duracion_min), 4) AS minutos FROM ops_dirty GROUP BY 1, 2""")
def a37(spark, sf):
    g = ops_dirty(spark, sf).groupBy("turno", F.col("machine_name").isNull().alias("sin_maquina"))
    return i.rounded(g.agg(F.count("*").alias("filas"), F.sum("duracion_min").alias("minutos")), 4)


@register("A2_dirty_benchmarks", ("ops_dirty",), """
    SELECT machine_name, ref_id_str, round(quantile_cont(c, 0.25), 6) AS ciclo_p25, round(quantile_cont(c, 0.5), 6) AS ciclo_mediana FROM
      (SELECT *, duracion_min*60/total_piezas AS c FROM ops_dirty WHERE estado = 'produccion' AND duracion_min > 0 AND total_piezas > 0)
    WHERE c BETWEEN 1 AND 600 AND machine_name IS NOT NULL AND ref_id_str IS NOT NULL GROUP BY 1, 2""")
def a2(spark, sf):
    """Quantiles with half of all rows in one group.

    What a cycle is made of is derived once and stored: a filter on the cycle
    would otherwise derive every column many times a row, in each of the passes.
    """
    parts = ops_dirty(spark, sf).select("machine_name", "ref_id_str", "estado", "duracion_min", "total_piezas")
    return i.rounded(oee.cycle_benchmarks(temporary(spark, parts, "dirty-cycles")))


@register("M12_dirty_metrics", ("ops_dirty",), """
    WITH v AS (SELECT ref_id_str, piezas_scrap/total_piezas AS y FROM ops_dirty WHERE total_piezas > 0 AND ref_id_str IS NOT NULL),
    e AS (SELECT y, avg(y) OVER (PARTITION BY ref_id_str) AS p FROM v)
    SELECT count(*) AS n, round(avg(abs(y-p)), 6) AS mae FROM e""")
def m12(spark, sf):
    rows = ops_dirty(spark, sf).where((F.col("total_piezas") > 0) & F.col("ref_id_str").isNotNull())
    rows = rows.select("ref_id_str", x.ratio(F.col("piezas_scrap"), F.col("total_piezas")).alias("y"))
    mean = rows.groupBy("ref_id_str").agg(F.avg("y").alias("p"))
    return i.rounded(metrics.regression_metrics(join_spread(rows, mean, ["ref_id_str"]), "y", "p").select("n", "mae"))
