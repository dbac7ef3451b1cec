"""Work-order routes, per-phase flow and order feature tables.

Rows are first reduced to (order, phase), which is small for any order;
only the literal route text of an order needs its whole operation list.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from forja.functions import scalar as x
from forja.operators.ordered import row_numbers, top_k
from forja.sources.files import write_order_life

ARROW = " -> "


def unique_headers(orders: DataFrame) -> DataFrame:
    """One header per order: the one with the largest plan."""
    rec = F.struct("qty_plan", F.col("ref_id_str").alias("ref_id_str_hdr"), "fecha_lanzamiento", "due_date")
    return orders.where(F.col("work_order_id").isNotNull()).groupBy("work_order_id").agg(F.max(rec).alias("h")).select("work_order_id", "h.*")


def ops_with_header(ops: DataFrame, orders: DataFrame) -> DataFrame:
    """ops plus plan and dates of its order, by order id alone."""
    return ops.join(unique_headers(orders), "work_order_id", "left")


def phased(ops: DataFrame) -> DataFrame:
    """Operations of known orders with phase, incident flag and sort record.

    Missing times sort last; equal times are ordered by phase.
    """
    pos = F.struct(
        F.col("ts_ini").isNull().alias("sin_ini"), F.col("ts_ini").alias("ini"), F.col("ts_fin").isNull().alias("sin_fin"),
        F.col("ts_fin").alias("fin"), F.col("fase").alias("fase"), F.col("op_id").alias("op_id"), F.col("ref_id_str").alias("ref"))
    known = ops.where(F.col("work_order_id").isNotNull())
    return known.withColumns({"fase": x.phase_of(), "incidente": x.is_incident_row()}).withColumn("pos", pos)


def order_routes(ops: DataFrame) -> DataFrame:
    """Full phase route of each order with first, last, minutes and steps."""
    g = phased(ops).groupBy("work_order_id").agg(
        F.sort_array(F.collect_list("pos")).alias("s"), x.sum0("duracion_min").alias("dur_total_min"),
        F.count("*").alias("n_ops"))
    names = F.transform("s", lambda p: p["fase"])
    return g.select(
        "work_order_id", F.col("s")[0]["ref"].alias("ref_id_str"), F.col("s")[0]["fase"].alias("fase_inicio"),
        F.element_at("s", -1)["fase"].alias("fase_fin"), F.array_join(names, ARROW).alias("ruta_fases"),
        "dur_total_min", "n_ops", F.transform("s", lambda p: p["op_id"]).alias("ops_seq"))


def route_steps(ops: DataFrame, incidents: bool = True) -> DataFrame:
    """The route in long form: (order, step, phase), for orders of any length.

    Steps are numbered inside (order, day), so no order has to fit one task.
    Without ``incidents`` only the other operations are steps.
    """
    rows = phased(ops) if incidents else phased(ops).where(~F.col("incidente"))
    order = [F.col("pos").asc(), *[F.col(c).asc() for c in ("machine_name", "piezas_ok", "piezas_scrap")]]
    return row_numbers(rows, ["work_order_id"], F.col("ts_ini").cast("date"), order, "paso").select("work_order_id", "paso", "fase")


def phase_totals(ops: DataFrame) -> DataFrame:
    """(order, phase, incident) totals with first and last position."""
    return phased(ops).groupBy("work_order_id", "fase", "incidente").agg(
        F.min("pos").alias("primera"), F.max("pos").alias("ultima"), F.count("*").alias("n"),
        x.sum0("piezas_ok").alias("ok"), x.sum0("piezas_scrap").alias("scrap"), x.sum0("duracion_min").alias("mins"),
        F.min("ts_ini").alias("ini"), F.max("ts_fin").alias("fin"))


def order_phases(ops: DataFrame) -> DataFrame:
    """Distinct phases of each order in order of first appearance; only (order, phase) rows meet."""
    per_phase = phase_totals(ops).groupBy("work_order_id", "fase").agg(
        F.min("primera").alias("primera"), F.max("ultima").alias("ultima"), F.sum("n").alias("n"), F.sum("ok").alias("ok"),
        F.sum("scrap").alias("scrap"), F.sum("mins").alias("mins"))
    return per_phase.groupBy("work_order_id").agg(
        F.sort_array(F.collect_list(F.struct("primera", "fase"))).alias("s"), F.max("ultima").alias("z"), F.sum("n").alias("n_ops"),
        F.sum("ok").alias("piezas_ok_sum"), F.sum("scrap").alias("piezas_scrap_sum"), F.sum("mins").alias("duracion_min_sum")).select(
        "work_order_id", F.col("s")[0]["primera"]["ref"].alias("ref_id_str"), F.transform("s", lambda p: p["fase"]).alias("fases"),
        F.col("s")[0]["fase"].alias("fase_inicio"), F.col("z.fase").alias("fase_fin"), "n_ops", "piezas_ok_sum", "piezas_scrap_sum", "duracion_min_sum")


def order_pieces(ops: DataFrame) -> DataFrame:
    """Distinct phases in order of first appearance and piece totals."""
    return order_phases(ops).select(
        "work_order_id", "ref_id_str", F.array_join("fases", ARROW).alias("fases_unicas"), F.size("fases").alias("n_fases"),
        "piezas_ok_sum", "piezas_scrap_sum", (F.col("piezas_ok_sum") + F.col("piezas_scrap_sum")).alias("piezas_lanzadas"))


def phase_flow(ops: DataFrame, orders: DataFrame, prefix: str = "CURV") -> DataFrame:
    """Rows (order, phase): pieces in and out, scrap and minutes.

    Orders with a header whose first non-incident phase starts with
    ``prefix``.  Phases are ordered by last appearance; what leaves a phase
    enters the next.  Launched pieces are the plan, else all pieces counted.
    """
    head = unique_headers(orders).select("work_order_id", F.col("qty_plan").cast("double").alias("plan"))
    t = phase_totals(ops).join(head, "work_order_id")  # orders without header go
    whole = W.partitionBy("work_order_id")
    made = ~F.col("incidente")
    t = t.withColumns({
        "inicio": F.min(F.when(made, F.col("primera"))).over(whole),
        "ref_orden": F.min("primera").over(whole),
        "min_incidencias": F.sum(F.when(F.col("incidente"), F.col("mins")).otherwise(0.0)).over(whole),
        "contadas": F.sum(F.when(made, F.col("ok") + F.col("scrap")).otherwise(0.0)).over(whole),
    })
    t = t.where(made & x.starts_with(F.col("inicio.fase"), prefix))
    base = F.coalesce("plan", "contadas")
    upto = whole.orderBy("ultima").rowsBetween(W.unboundedPreceding, 0)
    t = t.withColumns({"lanzadas": base, "acum": F.sum("scrap").over(upto), "orden": F.row_number().over(whole.orderBy("ultima"))})
    return t.withColumns({
        "entrada": F.when(F.col("orden") == 1, F.col("lanzadas")).otherwise(F.greatest(F.col("lanzadas") - (F.col("acum") - F.col("scrap")), F.lit(0.0))),
        "salida": F.greatest(F.col("lanzadas") - F.col("acum"), F.lit(0.0)),
    })


def order_flow(ops: DataFrame, orders: DataFrame, prefix: str = "CURV") -> DataFrame:
    """One row per order with totals, lead time and the flow per phase; ``route_steps`` has the single steps."""
    item = F.struct(
        "orden", F.col("fase").alias("fase"), F.col("entrada").alias("entrada_estimada"), F.col("salida").alias("salida_estimada"),
        F.col("scrap").alias("piezas_scrap"), F.col("mins").alias("duracion_min"))
    f = phase_flow(ops, orders, prefix)
    g = f.groupBy("work_order_id").agg(
        F.first("ref_orden").alias("r"), F.first("lanzadas").alias("piezas_lanzadas"),
        F.sum("scrap").alias("piezas_scrap_total"), F.sum("mins").alias("duracion_total_min"), F.sum("n").alias("n_ops"),
        F.min("ini").alias("primera_fase_ts"), F.max("fin").alias("ultima_fase_ts"),
        F.first("min_incidencias").alias("incidencias_duracion_total"),
        F.sort_array(F.collect_list(item)).alias("flujo"),
        F.sort_array(F.collect_list(F.struct("primera", "fase"))).alias("u"))
    return g.select(
        "work_order_id", F.col("r.ref").alias("ref_id_str"), F.transform("u", lambda p: p["fase"]).alias("fases_unicas"), "n_ops",
        "piezas_lanzadas", F.greatest(F.col("piezas_lanzadas") - F.col("piezas_scrap_total"), F.lit(0.0)).alias("piezas_ok_total"),
        "piezas_scrap_total", "duracion_total_min", "primera_fase_ts", "ultima_fase_ts",
        x.minutes_between("primera_fase_ts", "ultima_fase_ts").alias("fabricacion_duracion_min"), "incidencias_duracion_total",
        F.transform("flujo", lambda p: p.dropFields("orden")).alias("flow_por_fase"))


def order_life(flow: DataFrame) -> DataFrame:
    """Order documents: phases in order of first appearance."""
    by_name = F.map_from_entries(F.transform("flow_por_fase", lambda p: F.struct(p["fase"].alias("k"), p.alias("v"))))
    ops = F.transform("fases_unicas", lambda f: F.struct(
        f.alias("op"), F.col("m")[f]["entrada_estimada"].alias("piezas_lanzadas"),
        F.col("m")[f]["salida_estimada"].alias("salida_estimada"), F.col("m")[f]["piezas_scrap"].alias("piezas_scrap"),
        F.col("m")[f]["duracion_min"].alias("duracion_min")))
    return flow.withColumn("m", by_name).select(
        "work_order_id", "ref_id_str", F.col("piezas_lanzadas").alias("cantidad_lanzada"), ops.alias("operaciones"),
        F.col("piezas_ok_total").alias("cantidad_final_ok"), F.col("piezas_scrap_total").alias("scrap_total"),
        F.col("duracion_total_min").alias("tiempo_total_min"), "primera_fase_ts", "ultima_fase_ts",
        "fabricacion_duracion_min", "incidencias_duracion_total")


def export_order_life(flow: DataFrame, path: str) -> None:
    write_order_life(order_life(flow), path)


def lookup_order(ops: DataFrame, order_id: str) -> DataFrame:
    """Per-phase totals of one order."""
    one = ops.where(F.col("work_order_id") == order_id).withColumn("fase", x.phase_of())
    g = one.groupBy("work_order_id", "fase").agg(
        x.sum0("piezas_ok").alias("piezas_ok_sum"), x.sum0("piezas_scrap").alias("piezas_scrap_sum"), x.sum0("duracion_min").alias("duracion_min_sum"))
    return g.withColumn("piezas_lanzadas", F.col("piezas_ok_sum") + F.col("piezas_scrap_sum"))


def lookup_totals(ops: DataFrame, order_id: str) -> DataFrame:
    """One order in one row: distinct phases, first and last phase, operations, pieces and minutes."""
    return order_phases(ops.where(F.col("work_order_id") == order_id)).withColumn(
        "piezas_lanzadas", F.col("piezas_ok_sum") + F.col("piezas_scrap_sum"))


def lookup_steps(ops: DataFrame, order_id: str) -> DataFrame:
    """The operations of one order, in order."""
    return route_steps(ops.where(F.col("work_order_id") == order_id))


def expand_steps(ops: DataFrame, n: int) -> DataFrame:
    """Columns OP1..OPn of the first non-incident steps, the number of steps and the last phase.

    ``n_pasos`` tells whether an order has more steps than columns; the long
    form has them all.
    """
    steps = route_steps(ops, incidents=False)
    cols = [F.max(F.when(F.col("paso") == i, F.col("fase"))).alias(f"OP{i}") for i in range(1, n + 1)]
    return steps.groupBy("work_order_id").agg(
        F.count("*").cast("int").alias("n_pasos"), *cols, F.max_by("fase", "paso").alias("ultima"))


def start_end_counts(ops: DataFrame) -> DataFrame:
    """Orders by first and last phase; an order is only its two ends."""
    ends = phased(ops).groupBy("work_order_id").agg(F.min("pos").alias("a"), F.max("pos").alias("z"))
    g = ends.groupBy(F.col("a.fase").alias("fase_inicio"), F.col("z.fase").alias("fase_fin")).agg(F.count("*").alias("n"))
    return g.orderBy(F.desc("n"), "fase_inicio", "fase_fin")


def catalogue(ops: DataFrame, column: str, k: int = 20) -> DataFrame:
    g = ops.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("valor")).agg(F.count("*").alias("n"))
    return top_k(g, k, F.desc("n"), F.col("valor"))


# --- order features ---------------------------------------------------------


def order_metrics(life: DataFrame) -> DataFrame:
    made = F.col("cantidad_final_ok") + F.col("scrap_total")
    launched = x.zero_as_null("cantidad_lanzada")
    return life.withColumns({
        "scrap_rate": F.col("scrap_total") / F.nullif(made, F.lit(0.0)),
        "yield_ok": F.col("cantidad_final_ok") / launched,
        "fabricacion_dias": F.col("fabricacion_duracion_min") / 1440,
        "incidencias_horas": F.col("incidencias_duracion_total") / 60,
        "duracion_min_por_ud": F.col("fabricacion_duracion_min") / launched,
    })


def exploded_ops(life: DataFrame) -> DataFrame:
    """One row per (order, operation) with its 0-based position."""
    return life.select("work_order_id", "ref_id_str", "cantidad_lanzada", F.posexplode("operaciones").alias("orden_op", "o")).select(
        "work_order_id", "ref_id_str", "cantidad_lanzada", "orden_op", "o.op",
        F.col("o.piezas_lanzadas").alias("piezas_lanzadas"), F.col("o.salida_estimada").alias("salida_estimada"),
        F.col("o.piezas_scrap").alias("piezas_scrap"), F.col("o.duracion_min").alias("duracion_min"))


def _total(column: str, cond) -> Column:
    """Sum of a field over the operations of the row that meet ``cond``; NULL if none has a value."""
    known = F.filter("operaciones", lambda o: cond(o) & o[column].isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(F.transform(known, lambda o: o[column]), F.lit(0.0), lambda a, v: a + v))


def _every(o: Column) -> Column:
    return F.lit(True)


def summary_columns() -> dict[str, Column]:
    """Operation counts and totals of an order document, computed inside its row."""
    names = F.filter(F.transform("operaciones", lambda o: o["op"]), lambda n: n.isNotNull())
    some = F.size("operaciones") > 0
    return {
        "ops_count": F.when(some, F.size(names).cast("bigint")), "ops_unique": F.when(some, F.size(F.array_distinct(names))),
        "duracion_ops_min": _total("duracion_min", _every), "scrap_ops_total": _total("piezas_scrap", _every),
        "op": F.when(some, F.array_join(names, " > ")),
    }


def op_summary(life: DataFrame) -> DataFrame:
    return life.where(F.size("operaciones") > 0).select("work_order_id", *[c.alias(n) for n, c in summary_columns().items()])


#: Most operations that may become columns; more are an error, never a cut.
MOST_OPERATIONS = 256


def operations_of(life: DataFrame) -> list[str]:
    """The operations that occur, sorted: a catalogue of phases.

    More than ``MOST_OPERATIONS`` raise a ValueError: such data need the
    caller's own list, or ``operation_totals``, which has no columns by name.
    """
    names = life.select(F.explode("operaciones.op").alias("op")).where("op IS NOT NULL").distinct()
    found = [r[0] for r in names.limit(MOST_OPERATIONS + 1).collect()]
    if len(found) > MOST_OPERATIONS:
        raise ValueError(f"over {MOST_OPERATIONS} operations: pass a list of them or use operation_totals")
    return sorted(found)


def operation_totals(life: DataFrame) -> DataFrame:
    """Minutes, minutes per unit and scrap by (order, operation): the pivots in long form, for any number of operations."""
    unit = F.nullif(F.col("cantidad_lanzada"), F.lit(0.0))
    names = F.array_distinct(F.transform("operaciones", lambda o: o["op"]))
    each = F.transform(F.filter(names, lambda n: n.isNotNull()), lambda n: F.struct(
        n.alias("op"), _total("duracion_min", lambda o: o["op"] == n).alias("duracion_min"),
        _total("piezas_scrap", lambda o: o["op"] == n).alias("piezas_scrap")))
    rows = life.select("work_order_id", unit.alias("unidades"), F.explode(each).alias("t")).select("work_order_id", "unidades", "t.*")
    return rows.withColumn("min_por_ud", F.col("duracion_min") / F.col("unidades")).drop("unidades")


def pivot_columns(ops: Sequence[str]) -> dict[str, Column]:
    """Minutes, minutes per unit and scrap by operation; what is not in the list adds up under ``otras``."""
    unit = F.nullif(F.col("cantidad_lanzada"), F.lit(0.0))
    listed = {x.slug_text(op): (lambda o, op=op: o["op"] == op) for op in ops}
    if len(listed) < len(ops) or "otras" in listed:
        raise ValueError("two operations would share a column")
    groups = {**listed, "otras": lambda o: ~F.coalesce(o["op"].isin(*ops) if ops else F.lit(False), F.lit(False))}
    cols = {f"dur_min_{n}": _total("duracion_min", g) for n, g in groups.items()}
    cols |= {f"dur_min_{n}_por_ud": F.col(f"dur_min_{n}") / unit for n in groups}
    return cols | {f"scrap_{n}": _total("piezas_scrap", g) for n, g in groups.items()}


def _with_pivots(life: DataFrame, ops: Sequence[str]) -> DataFrame:
    cols = pivot_columns(ops)
    rates = {n: c for n, c in cols.items() if n.endswith("_por_ud")}
    return life.withColumns({n: c for n, c in cols.items() if n not in rates}).withColumns(rates)


def op_pivots(life: DataFrame, ops: Sequence[str] | None = None) -> DataFrame:
    """Pivots of the listed operations (by default of all that occur), inside the row of each order."""
    ops = operations_of(life) if ops is None else list(ops)
    rows = _with_pivots(life.where(F.size("operaciones") > 0), ops)
    return rows.select("work_order_id", *pivot_columns(ops))


def model_table(life: DataFrame, ops: Sequence[str] | None = None) -> DataFrame:
    """Order metrics with operation features; the target is renamed.  No row leaves its task."""
    ops = operations_of(life) if ops is None else list(ops)
    out = _with_pivots(order_metrics(life).withColumns(summary_columns()), ops).drop("operaciones")
    return out.withColumnRenamed("fabricacion_duracion_min", "y_fabricacion_min")


def reference_times(life: DataFrame, quantile_fn) -> DataFrame:
    """Orders, mean and median fabrication minutes per reference."""
    g = life.where(F.col("ref_id_str").isNotNull()).groupBy("ref_id_str").agg(
        F.count("*").alias("n_of"), F.avg("fabricacion_duracion_min").alias("media_min"))
    med = quantile_fn(life.where(F.col("ref_id_str").isNotNull()), ["ref_id_str"], "fabricacion_duracion_min", {"mediana_min": 0.5})
    return g.join(med, "ref_id_str", "left")


def reference_cycle(life: DataFrame) -> DataFrame:
    """Minutes per good unit of each reference, fastest first."""
    g = life.where(F.col("ref_id_str").isNotNull()).groupBy("ref_id_str").agg(
        F.count("work_order_id").alias("of_count"), F.sum("cantidad_final_ok").alias("uds_ok"),
        x.sum0("fabricacion_duracion_min").alias("dur_total_min"))
    return g.withColumn("ciclo_min_por_ud", F.col("dur_total_min") / F.nullif(F.col("uds_ok"), F.lit(0.0))).orderBy(
        F.col("ciclo_min_por_ud").asc_nulls_last(), "ref_id_str")


def top_references(life: DataFrame, k: int = 10) -> DataFrame:
    """Orders of the k references with most orders."""
    n = life.where(F.col("ref_id_str").isNotNull()).groupBy("ref_id_str").agg(F.count("*").alias("n"))
    return life.join(F.broadcast(top_k(n, k, F.desc("n"), F.col("ref_id_str"))), "ref_id_str", "left_semi")
