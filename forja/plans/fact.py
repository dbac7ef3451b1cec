"""The integrated production fact and the filters over all tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forja.functions import scalar as x
from forja.operators.lastop import last_valid_ops
from forja.operators.ordered import attach_row, join_spread
from forja.sources.conform import unique_orders


#: Month of an operation, where the stored fact is divided by it.
MONTH = "mes_ini"


@dataclass(frozen=True)
class Tables:
    """All tables of a plant; any of them may be absent."""

    produccion: DataFrame | None = None
    ordenes: DataFrame | None = None
    compras: DataFrame | None = None
    almacen: DataFrame | None = None
    rrhh: DataFrame | None = None
    fresa: DataFrame | None = None
    refs: DataFrame | None = None
    ciclos: DataFrame | None = None

    def as_views(self) -> None:
        """Make every table queryable by SQL under its own name."""
        for name, df in vars(self).items():
            if df is not None:
                df.createOrReplaceTempView(name)


def with_reference(ops: DataFrame, refs: DataFrame) -> DataFrame:
    """ops plus family and net weight; kept as is where the weight is present."""
    if "peso_neto_kg" in ops.columns:
        return ops
    dim = refs.where(F.col("ref_id_str").isNotNull()).groupBy("ref_id_str").agg(F.max("familia").alias("familia"), F.max("peso_neto_kg").alias("peso_neto_kg"))
    deal = [c for c in ("work_order_id", "ts_ini") if c in ops.columns]
    return join_spread(ops, dim, ["ref_id_str"], deal=deal)


def with_order(ops: DataFrame, orders: DataFrame, unique: bool = False) -> DataFrame:
    """ops plus client, planned quantity, plant and family of its order.

    Headers are deduplicated first.  Pass a stored ``unique_orders`` table
    with ``unique=True`` at scale: then both join sides are plain scans and
    the runtime can split a hot order.
    """
    dim = orders if unique else unique_orders(orders)
    cols = ("work_order_id", "ref_id_str", "cliente", "qty_plan", "planta_inicio", "familia_of")
    return ops.join(dim.select(*cols), ["work_order_id", "ref_id_str"], "left")


def production_fact(ops: DataFrame, refs: DataFrame, orders: DataFrame, unique: bool = False) -> DataFrame:
    """Conformed operations with reference, order and per-operation rates."""
    out = with_order(with_reference(ops, refs), orders, unique)
    return out.withColumns({
        "familia": F.coalesce("familia", "familia_of"),
        "scrap_rate": x.ratio(F.col("piezas_scrap"), F.col("total_piezas")),
        "throughput_uph": x.ratio(60 * F.col("piezas_ok"), F.col("duracion_min")),
    })


# --- filters ----------------------------------------------------------------


def in_range(ts: str | Column, start: date, end: date) -> Column:
    """From the start of the first day to the last whole second of the last."""
    lo = datetime.combine(start, datetime.min.time())
    hi = datetime.combine(end, datetime.min.time()) + timedelta(days=1) - timedelta(seconds=1)
    c = x.col(ts)
    # as text: a datetime literal would pass through the session's time zone
    return (c >= F.lit(str(lo)).cast("timestamp_ntz")) & (c <= F.lit(str(hi)).cast("timestamp_ntz"))


@dataclass(frozen=True)
class Filters:
    start: date
    end: date
    plants: Sequence[str] = ()
    machine: str | None = None

    def clamp(self, low: date, high: date) -> Filters:
        """The same filters inside the dates that have data."""
        return replace(self, start=max(low, min(self.start, high)), end=max(low, min(self.end, high)))


def filter_ops(ops: DataFrame, f: Filters) -> DataFrame:
    out = ops.where(in_range("ts_ini", f.start, f.end))
    if MONTH in ops.columns:  # leaves the folders of other months unread
        out = out.where(F.col(MONTH).between(F.lit(f.start.replace(day=1)), F.lit(f.end.replace(day=1))))
    if f.plants:
        out = out.where(F.col("planta").isin(*f.plants))
    if f.machine:
        out = out.where(F.col("machine_name") == f.machine)
    return out


def filter_orders(orders: DataFrame, f: Filters) -> DataFrame:
    out = orders.where(in_range("fecha_lanzamiento", f.start, f.end))
    if f.plants:
        out = out.where(F.col("planta_inicio").isin(*f.plants))
    if f.machine and "machine_name" in orders.columns:
        out = out.where(F.col("machine_name") == f.machine)
    return out


def filter_labour(labour: DataFrame, f: Filters) -> DataFrame:
    """Months that overlap the range."""
    m = F.trunc("año_mes", "MM")
    return labour.where((m >= F.lit(f.start.replace(day=1))) & (m <= F.lit(f.end.replace(day=1))))


def apply_filters(t: Tables, f: Filters) -> Tables:
    def opt(df: DataFrame | None, ts: str) -> DataFrame | None:
        return None if df is None else df.where(in_range(ts, f.start, f.end))

    return Tables(
        produccion=None if t.produccion is None else filter_ops(t.produccion, f),
        ordenes=None if t.ordenes is None else filter_orders(t.ordenes, f),
        compras=opt(t.compras, "fecha_recepcion_ts"),
        almacen=opt(t.almacen, "fecha_ts"),
        rrhh=None if t.rrhh is None else filter_labour(t.rrhh, f),
        fresa=opt(t.fresa, "ts_cambio"),
    )


def week_presets(bounds: DataFrame) -> DataFrame:
    """Numbered weeks, Sunday to Friday, over ``bounds`` (fecha_min, fecha_max).

    A week starts on the Sunday on or before the first day; its end is cut to
    the last day with data, its label shows the uncut Friday.
    """
    first = F.date_sub("fecha_min", F.pmod(F.weekday("fecha_min") + 1, F.lit(7)))
    weeks = bounds.select("fecha_max", F.posexplode(F.sequence(first, F.col("fecha_max"), F.expr("interval 7 days"))).alias("i", "inicio"))
    friday = F.date_add("inicio", 5)
    n = F.col("i") + 1
    return weeks.select(
        n.alias("n"),
        F.concat(F.lit("Semana "), n.cast("string"), F.lit(" ("), F.col("inicio").cast("string"), F.lit(" a "),
                 friday.cast("string"), F.lit(")")).alias("etiqueta"),
        "inicio", F.least(friday, F.col("fecha_max")).alias("fin"),
    )


def date_bounds(ops: DataFrame, stock: DataFrame, purchases: DataFrame) -> DataFrame:
    """First and last day over the time columns of the three tables."""
    def ends(df: DataFrame, *cols: str) -> DataFrame:
        lows = [F.min(c) for c in cols]
        highs = [F.max(c) for c in cols]
        return df.agg((F.least(*lows) if len(cols) > 1 else lows[0]).alias("lo"),
                      (F.greatest(*highs) if len(cols) > 1 else highs[0]).alias("hi"))

    all_ends = ends(ops, "ts_ini", "ts_fin").unionByName(ends(stock, "fecha_ts")).unionByName(
        ends(purchases, "fecha_recepcion_ts"))
    return all_ends.agg(F.min("lo").cast("date").alias("fecha_min"), F.max("hi").cast("date").alias("fecha_max"))


def plants_by_machine(ops: DataFrame) -> DataFrame:
    """Plants each machine works in, sorted; one small set per machine."""
    return ops.where(F.col("machine_name").isNotNull()).groupBy("machine_name").agg(
        F.array_sort(F.collect_set("planta")).alias("plantas"))


def dimension_values(ops: DataFrame, column: str) -> DataFrame:
    return ops.select(F.col(column).alias("valor")).where(F.col(column).isNotNull()).distinct().orderBy("valor")


def range_summary(ops: DataFrame, f: Filters) -> DataFrame:
    """Numeric references present and pieces of the last valid operations."""
    inside = filter_ops(ops, f)
    numeric = F.when(F.col("ref_id_str").rlike("^[0-9]+$"), F.col("ref_id_str"))
    refs = inside.select(numeric.alias("r")).groupBy("r").agg(F.count("*").alias("n")).where(F.col("r").isNotNull())
    refs = refs.agg(F.count("*").alias("referencias"), F.sum("n").alias("filas_con_referencia"))
    done = last_valid_ops(inside).agg(x.sum0(F.col("piezas_ok") + F.col("piezas_scrap")).alias("piezas"))
    return attach_row(refs, done)
