"""Query registry and the SQL form of the shop-floor tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Tables as WITH entries; each names the entries it needs.
_M = "(1 + CAST(floor(l_extendedprice/1000) AS BIGINT))"
_START = "(l_partkey*7 + l_linenumber) % 1440"
_SCRAP = "floor(l_quantity*l_discount*10)"

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "plants": ((), """
        SELECT s_suppkey AS machine_id, r_name AS planta FROM supplier
        JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey"""),
    "raw_ops": (("plants",), f"""
        SELECT lpad(CAST(l_orderkey AS VARCHAR), 12, '0') AS work_order_id,
          CAST(l_orderkey % 40 AS VARCHAR) AS ref_id,
          CASE WHEN l_partkey % 4 <> 0 THEN 'L' || CAST(l_partkey AS VARCHAR) END AS material_lot_id,
          CASE l_linenumber WHEN 1 THEN 'CURV10' WHEN 2 THEN 'TALL20' WHEN 3 THEN 'TALL30'
            WHEN 4 THEN 'SOLD40' WHEN 5 THEN 'TEMP50' WHEN 6 THEN 'RECT60' END AS op_id,
          CASE WHEN l_linenumber = 7 AND l_partkey % 2 = 0 THEN ' Control final ' END AS op_text,
          l_suppkey AS machine_id,
          'M' || lpad(CAST(l_suppkey AS VARCHAR), 8, '0') AS machine_name,
          CASE l_partkey % 10 WHEN 0 THEN 'Preparación' WHEN 1 THEN 'PREPARACION' WHEN 2 THEN 'Incidencia'
            WHEN 3 THEN NULL WHEN 4 THEN 'PRODUCCION' ELSE 'Producción' END AS evento,
          CASE WHEN l_partkey % 10 IN (2,3) AND l_linenumber IN (2,3) AND l_suppkey % 2 = 0 THEN 'CAMBIO DE FRESA'
            WHEN l_partkey % 10 IN (2,3) THEN 'AVERIA ' || CAST(l_partkey % 7 AS VARCHAR) END AS tipo_incidencia,
          CASE WHEN l_partkey % 6 <> 0 THEN 'OP' || CAST(l_partkey % 50 AS VARCHAR) END AS operario_nombre,
          CAST(l_shipdate AS TIMESTAMP) + to_minutes(CAST({_START} AS INTEGER)) AS ts_ini,
          CASE WHEN l_orderkey % 97 <> 0 THEN
            CAST(l_shipdate AS TIMESTAMP) + to_minutes(CAST({_START} + {_M} AS INTEGER)) END AS ts_fin,
          CAST(CASE WHEN l_partkey % 101 <> 0 THEN CASE WHEN l_tax = 0.08::DOUBLE THEN {_M}*60 ELSE {_M} END END AS DOUBLE) AS duracion_min,
          CAST(CASE WHEN l_tax = 0 AND l_partkey % 2 = 0 THEN NULL WHEN l_tax = 0 THEN 0 ELSE l_quantity*10 - {_SCRAP} END AS DOUBLE) AS piezas_ok,
          CAST(CASE WHEN l_tax = 0 AND l_partkey % 2 = 0 THEN NULL WHEN l_tax = 0 THEN 0 ELSE {_SCRAP} END AS DOUBLE) AS piezas_scrap,
          planta
        FROM lineitem LEFT JOIN plants ON machine_id = l_suppkey"""),
    "refs": ((), """
        SELECT ref_id, lpad(ref_id, 6, '0') AS ref_id_str, familia, peso_neto_kg FROM (
          SELECT CAST(p_partkey % 40 AS VARCHAR) AS ref_id,
            CASE WHEN (p_partkey % 40) % 9 <> 4 THEN min(p_type) END AS familia,
            (max(p_size) + count(*) % 7) / 10.0::DOUBLE AS peso_neto_kg
          FROM part GROUP BY p_partkey % 40)"""),
    "rates": ((), """
        SELECT lpad(CAST(r AS VARCHAR), 6, '0') AS ref_id_str,
          'M' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS machine_name,
          CAST(60 + (r*7 + s_suppkey) % 200 AS DOUBLE) AS piezas_hora_teorico
        FROM supplier, range(40) t(r) WHERE (r + s_suppkey) % 2 = 0"""),
    "orders_h": ((), """
        SELECT lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS work_order_id,
          lpad(CAST((o_orderkey + CASE WHEN o_orderkey % 17 = 3 THEN 1 ELSE 0 END) % 40 AS VARCHAR), 6, '0') AS ref_id_str,
          CASE WHEN o_orderkey % 5 <> 0 THEN 'FAM ' || CAST(o_orderkey % 6 AS VARCHAR) END AS familia_of,
          c_mktsegment AS cliente,
          CASE WHEN o_orderkey % 13 <> 0 THEN CAST(floor(o_totalprice/100) AS BIGINT) END AS qty_plan,
          CAST(o_orderdate AS TIMESTAMP) AS fecha_lanzamiento, 'PENDING' AS planta_inicio
        FROM orders LEFT JOIN customer ON c_custkey = o_custkey"""),
    "compras": ((), """
        SELECT 'L' || CAST(event_id - event_id % 3 AS VARCHAR) AS material_lot_id,
          lpad(CAST(user_id AS VARCHAR), CAST(greatest(6, length(CAST(user_id AS VARCHAR))) AS INTEGER), '0') AS ref_materia_str,
          CASE WHEN event_id % 50 <> 3 THEN value END AS qty_recibida, ts AS fecha_recepcion_ts
        FROM events WHERE event_type = 'purchase'"""),
    "almacen": ((), """
        SELECT lpad(CAST(user_id % 40 AS VARCHAR), 6, '0') AS item_ref_id_str, ts AS fecha_ts,
          CASE WHEN event_type = 'signup' THEN 'IN' ELSE 'OUT' END AS movimiento, value AS cantidad
        FROM events WHERE event_type IN ('signup','click')"""),
    "rrhh": ((), """
        SELECT mes AS "año_mes", 160*(1 + n % 50) AS horas_teoricas, 8*(n % 5) AS reduccion_tco,
          160*(1 + n % 50) - 8*(n % 5) AS horas_ajustadas,
          n % 23 AS horas_enfermedad, n % 7 AS horas_accidente, n % 11 AS horas_permiso,
          160*(1 + n % 50) - 8*(n % 5) - n % 23 - n % 7 - n % 11 AS horas_netas
        FROM (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS mes, count(*) AS n FROM orders GROUP BY 1)"""),
    # conformed operations: clean ids, numeric NULLs are 0, state known
    "ops": (("raw_ops",), """
        SELECT work_order_id, ref_id, lpad(ref_id, 6, '0') AS ref_id_str, material_lot_id, op_id,
          op_text, machine_id, machine_name, evento, tipo_incidencia, operario_nombre, ts_ini, ts_fin, planta,
          coalesce(duracion_min, 0) AS duracion_min, coalesce(piezas_ok, 0) AS piezas_ok,
          coalesce(piezas_scrap, 0) AS piezas_scrap,
          coalesce(piezas_ok, 0) + coalesce(piezas_scrap, 0) AS total_piezas,
          CASE WHEN lower(evento) IN ('producción','produccion') THEN 'produccion'
            WHEN lower(evento) IN ('preparación','preparacion') THEN 'preparacion' ELSE 'incidencia' END AS estado,
          CAST(ts_ini AS DATE) AS fecha, CAST(date_trunc('month', ts_ini) AS DATE) AS mes,
          CASE WHEN ts_ini IS NULL THEN 'desconocido' WHEN hour(ts_ini) BETWEEN 6 AND 13 THEN 'mañana'
            WHEN hour(ts_ini) BETWEEN 14 AND 21 THEN 'tarde' ELSE 'noche' END AS turno,
          CAST(year(ts_ini) AS VARCHAR) || '-W' || CAST(week(ts_ini) AS VARCHAR) AS periodo
        FROM raw_ops"""),
    # conformed operations with reference and order columns
    "fact": (("ops", "refs", "orders_h"), """
        SELECT o.*, coalesce(r.familia, h.familia_of) AS familia, r.peso_neto_kg, h.cliente, h.qty_plan,
          h.planta_inicio, h.familia_of,
          CASE WHEN total_piezas > 0 THEN piezas_scrap / total_piezas END AS scrap_rate,
          CASE WHEN duracion_min > 0 THEN 60*piezas_ok / duracion_min END AS throughput_uph
        FROM ops o LEFT JOIN refs r USING (ref_id_str)
        LEFT JOIN orders_h h ON h.work_order_id = o.work_order_id AND h.ref_id_str = o.ref_id_str"""),
}


def with_tables(body: str, *names: str) -> str:
    """``body`` preceded by the WITH entries it reads, in dependency order."""
    order: list[str] = []

    def visit(n: str) -> None:
        for d in CTES[n][0]:
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    head = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order)
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}" if head else body


def last_op_sql(source: str, by: str = "") -> str:
    """Rows of ``source`` (with pieces) that are last in their order."""
    part = f"{by}, work_order_id" if by else "work_order_id"
    return f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY
        CASE WHEN ts_fin IS NULL THEN 1 ELSE 0 END DESC, ts_fin DESC NULLS LAST, ts_ini DESC NULLS LAST,
        op_id DESC NULLS LAST, machine_name DESC NULLS LAST, ref_id_str DESC NULLS LAST,
        piezas_ok DESC, piezas_scrap DESC) AS rn_last
        FROM {source} WHERE total_piezas > 0 AND work_order_id IS NOT NULL) WHERE rn_last = 1)"""


def register(name: str, tables: tuple[str, ...] = (), sql: str | None = None):
    """Decorator: register a Spark query and, if given, its SQL."""

    def wrap(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_tables(sql, *tables)
        return fn

    return wrap
