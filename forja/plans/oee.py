"""Equipment effectiveness: availability x performance x quality.

One function computes the record for any grouping (plant, day, shift,
machine).  Benchmarks and last operations are always taken inside the group.
Targets depend only on (group, machine, reference), so the fact is reduced to
that grain first and never joined back to its own benchmarks.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from forja.functions import scalar as x
from forja.operators.lastop import last_op_struct
from forja.operators.ordered import attach_row, band_quantiles, join_null_safe, key_part, percentiles, picked_percentiles, quantiles, split_hot
from forja.operators.states import quantile_states

# --- fixed values -----------------------------------------------------------
CYCLE_MIN_S, CYCLE_MAX_S = 1.0, 600.0
DEFAULT_CYCLE_S = 45.0
UPH_LOW, UPH_HIGH, UPH_DEFAULT = 30.0, 180.0, 80.0
# ----------------------------------------------------------------------------


def with_rate(ops: DataFrame, rates: DataFrame) -> DataFrame:
    """ops plus the listed pieces per hour of (reference, machine)."""
    return ops.join(rates, ["ref_id_str", "machine_name"], "left")


def cycle_seconds() -> Column:
    """Seconds per piece of a production operation, NULL if not usable."""
    c = F.col("duracion_min") * 60 / F.col("total_piezas")
    made = (F.col("estado") == "produccion") & (F.col("duracion_min") > 0) & (F.col("total_piezas") > 0)
    cycle = F.when(made, c)
    return F.when(cycle.between(CYCLE_MIN_S, CYCLE_MAX_S), cycle)


def pair_keys(by: Sequence[str]) -> list[str]:
    return [*by, *[k for k in ("machine_name", "ref_id_str") if k not in by]]


BENCHMARKS = {"ciclo_p25": 0.25, "ciclo_mediana": 0.5}


def cycle_benchmarks(ops: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Exact p25 and median seconds per piece of each (by, machine, reference).

    Production operations with time and pieces, cycles between 1 and 600 s.
    """
    keys = pair_keys(by)
    cycles = ops.select(*keys, cycle_seconds().alias("ciclo_s"))
    return quantiles(cycles.dropna(subset=[*keys, "ciclo_s"]), keys, "ciclo_s", BENCHMARKS)


def cycle_states(ops: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mergeable states of the seconds per piece of each (by, machine, reference), for benchmarks without the fact."""
    keys = pair_keys(by)
    return quantile_states(ops.select(*keys, cycle_seconds().alias("ciclo_s")).dropna(subset=keys), keys, "ciclo_s")


def global_cycle(benchmarks: DataFrame, by: Sequence[str] = (), counted: DataFrame | None = None) -> DataFrame:
    """Median of the group medians, the last resort of the cascade; ``counted`` as in ``split_hot``."""
    return quantiles(benchmarks, list(by), "ciclo_mediana", {"ciclo_global": 0.5}, counted=counted)


def last_resort(overall: Column) -> Column:
    """The overall median; one that is not positive gives the default cycle."""
    return F.when(overall > 0, overall).when(overall.isNotNull(), F.lit(DEFAULT_CYCLE_S))


def target_cycle(rate: Column, p25: Column, median: Column, overall: Column) -> Column:
    """Listed rate, else p25, else median, else the overall median.

    Without any history ``overall`` is NULL and so is the target; an overall
    median that is not positive gives the default cycle.
    """
    return F.coalesce(F.when(rate > 0, 3600 / rate), p25, median, last_resort(overall))


def join_group(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Left join on the group keys, or with the only row when there are none."""
    if by:
        return left.join(right, list(by), "left")
    return attach_row(left, right)


def with_cycle(ops: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Operations of known groups with the seconds per piece that count for a benchmark."""
    usable = F.when(F.col("machine_name").isNotNull() & F.col("ref_id_str").isNotNull(), cycle_seconds())
    return (ops.dropna(subset=list(by)) if by else ops).withColumn("ciclo_s", usable)


def cycle_grain(base: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Minutes, production rows and benchmarks of each (by, machine, reference) of ``with_cycle`` rows.

    The fact is read down to that grain in one aggregate; only hot keys first
    go down to (by, machine, reference, cycle), with quantiles of their own.
    """
    keys = pair_keys(by)
    light, hot = split_hot(base, keys)
    minutes = [f"min_{s}" for s in x.STATES]
    sums = [*[F.sum(F.when(F.col("estado") == s, F.col("duracion_min")).otherwise(0.0)).alias(f"min_{s}") for s in x.STATES],
            F.count(F.when(F.col("estado") == "produccion", 1)).alias("ops_produccion")]
    whole = light.groupBy(*keys).agg(*sums, percentiles("ciclo_s", BENCHMARKS).alias("__q"))
    whole = whole.select(*keys, *minutes, "ops_produccion", *picked_percentiles("__q", BENCHMARKS))
    fine = hot.groupBy(*keys, "ciclo_s").agg(*sums, F.count(F.lit(1)).alias("filas"))
    bench = band_quantiles(fine, keys, "ciclo_s", BENCHMARKS, weight="filas")
    rest = fine.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in (*minutes, "ops_produccion")])
    return whole.unionByName(join_null_safe(rest, bench, keys, "left"))


def targets(ops: DataFrame, rates: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Minutes, production rows and target of each (by, machine, reference)."""
    base = with_cycle(ops, by)
    grain = cycle_grain(base, by)
    overall = global_cycle(grain, by, counted=base)
    out = join_group(with_rate(grain, rates), overall, by)
    cycle = target_cycle(F.col("piezas_hora_teorico"), F.col("ciclo_p25"), F.col("ciclo_mediana"), F.col("ciclo_global"))
    return out.withColumn("ciclo_objetivo_s", cycle)


def without_history(rows: DataFrame, base: DataFrame, by: Sequence[str]) -> DataFrame:
    """The rows of all groups in which no operation of ``base`` has a cycle, and of some others.

    Groups are named by their part of the key space, so what is broadcast is bounded.
    """
    none = base.groupBy(*by).agg(F.max("ciclo_s").alias("__h"))
    if not by:
        return attach_row(rows, none).where(F.col("__h").isNull()).drop("__h")
    parts = none.where(F.col("__h").isNull()).select(key_part(by).alias("__p")).distinct()
    return rows.withColumn("__p", key_part(by)).join(F.broadcast(parts), "__p", "left_semi").drop("__p")


def oee(ops: DataFrame, rates: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The OEE record, one row per group (one row in all without ``by``).

    Minutes count every operation; pieces only the last valid production
    operation of each order.  What has no target of its own takes the last
    resort of its group, so it is summed up before that is known.
    """
    by = list(by)
    base = with_cycle(ops, by)
    grain = cycle_grain(base, by)
    own = target_cycle(F.col("piezas_hora_teorico"), F.col("ciclo_p25"), F.col("ciclo_mediana"), F.lit(None).cast("double"))
    cycle = F.col("ciclo_propio_s")
    uph = F.when(cycle > 0, 3600 / cycle)
    time = with_rate(grain, rates).withColumn("ciclo_propio_s", own).groupBy(*by).agg(
        *[x.sum0(f"min_{s}").alias(f"min_{s}") for s in x.STATES],
        x.sum0(uph * F.col("min_produccion") / 60).alias("ideal_propio"),
        x.sum0(uph * F.col("ops_produccion")).alias("uph_propio"),
        x.sum0(F.when(uph > 0, F.col("ops_produccion"))).alias("filas_propias"),
        x.sum0(F.when(cycle.isNull(), F.col("min_produccion"))).alias("min_sin"),
        x.sum0(F.when(cycle.isNull(), F.col("ops_produccion"))).alias("filas_sin"),
    )
    time = join_group(time, global_cycle(grain, by, counted=base), by)
    rest = F.coalesce(3600 / last_resort(F.col("ciclo_global")), F.lit(0.0))
    time = time.withColumns({
        "ideal_output": F.col("ideal_propio") + rest * F.col("min_sin") / 60,
        "uph_suma": F.col("uph_propio") + rest * F.col("filas_sin"),
        "uph_filas": F.col("filas_propias") + F.when(rest > 0, F.col("filas_sin")).otherwise(0),
    })

    made = ops.where((F.col("estado") == "produccion") & (F.col("total_piezas") > 0))
    made = made.dropna(subset=["work_order_id", *by])
    # where the group has no history at all, operations without a listed rate do not count
    rated = with_rate(without_history(made, base, by), rates).where(F.col("piezas_hora_teorico") > 0)

    def pieces(rows: DataFrame, name: str) -> DataFrame:
        last = rows.groupBy("work_order_id", *by).agg(F.max(last_op_struct()).alias("u"))
        return last.groupBy(*by).agg(*[x.sum0(F.col(f"u.{c}")).alias(f"{name}_{c}") for c in ("piezas_ok", "piezas_scrap")])

    j = join_group(join_group(time, pieces(made, "una"), by), pieces(rated, "con_tasa"), by)
    hist = F.col("ciclo_global").isNotNull()
    j = j.withColumns({
        c: F.coalesce(F.when(hist, F.col(f"una_{c}")).otherwise(F.col(f"con_tasa_{c}")), F.lit(0.0))
        for c in ("piezas_ok", "piezas_scrap")
    })
    ok, scrap = F.col("piezas_ok"), F.col("piezas_scrap")
    plan = F.col("min_produccion") + F.col("min_preparacion") + F.col("min_incidencia")
    j = j.withColumns({
        "total_ok": ok.cast("bigint"), "total_scrap": scrap.cast("bigint"),
        "total_piezas": (ok + scrap).cast("bigint"), "actual_output": ok + scrap,
        "availability": x.ratio(F.col("min_produccion"), plan),
        "performance": F.when(ok + scrap > 0, x.ratio(ok + scrap, F.col("ideal_output"))),
        "quality": x.ratio(ok, ok + scrap),
        "uph_real": x.ratio(ok + scrap, F.col("min_produccion") / 60),
        "uph_teorico": x.ratio(F.col("uph_suma"), F.col("uph_filas")),
    })
    j = j.withColumn("oee", F.col("availability") * F.col("performance") * F.col("quality"))
    return j.select(
        *by, "availability", "performance", "quality", "oee",
        *[f"min_{s}" for s in x.STATES], "total_ok", "total_scrap", "total_piezas",
        "uph_real", "uph_teorico", "actual_output", "ideal_output",
    )


def oee_daily(ops: DataFrame, rates: DataFrame) -> DataFrame:
    return oee(ops, rates, ["fecha"]).select("fecha", "oee", "availability", "performance", "quality")


def oee_by_shift(ops: DataFrame, rates: DataFrame) -> DataFrame:
    named = ops.where(F.col("turno").isin(*x.SHIFTS))
    return oee(named, rates, ["turno"])


def oee_by_machine(ops: DataFrame, rates: DataFrame) -> DataFrame:
    return oee(ops, rates, ["machine_name"])


def loss_waterfall(records: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """1, the three losses in points, and the final OEE, as rows."""
    a, p, q, o = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("availability", "performance", "quality", "oee"))
    bars = [("Inicial", F.lit(1.0)), ("Pérdida Disponibilidad", -(1 - a)), ("Pérdida Rendimiento", -(a * (1 - p))),
            ("Pérdida Calidad", -(a * p * (1 - q))), ("OEE Final", o)]
    items = F.array(*[F.struct(F.lit(i).alias("paso"), F.lit(n).alias("concepto"), v.alias("valor"))
                      for i, (n, v) in enumerate(bars, 1)])
    return records.select(*keys, F.explode(items).alias("b")).select(*keys, "b.*")


def cycle_equivalents(records: DataFrame) -> DataFrame:
    """Seconds per piece behind the real and the target pace."""
    real = x.ratio(F.lit(3600.0), F.col("uph_real"))
    goal = x.ratio(F.lit(3600.0), F.col("uph_teorico"))
    return records.withColumns({
        "ciclo_real_s": real, "ciclo_objetivo_s": goal, "ciclo_diferencia_s": real - goal,
        "banda_rendimiento": x.performance_band("performance"),
    })


def kpi_lights(records: DataFrame) -> DataFrame:
    return records.withColumns({f"color_{k}": x.kpi_color(k, k) for k in x.KPI_GOOD_WARNING})


def distributions(records: DataFrame) -> DataFrame:
    """Minutes by state and pieces by quality, as rows."""
    bars = [("tiempo", "Producción", "min_produccion"), ("tiempo", "Preparación", "min_preparacion"),
            ("tiempo", "Incidencias", "min_incidencia"), ("calidad", "OK", "total_ok"), ("calidad", "Scrap", "total_scrap")]
    items = F.array(*[F.struct(F.lit(g).alias("grupo"), F.lit(n).alias("nombre"), F.col(c).cast("double").alias("valor"))
                      for g, n, c in bars])
    return records.select(F.explode(items).alias("b")).select("b.*")


def components_long(records: DataFrame, key: str) -> DataFrame:
    """Unpivoted components of rows that have an OEE."""
    named = records.where(F.col("oee").isNotNull()).select(
        key, F.col("availability").alias("Disponibilidad"), F.col("performance").alias("Rendimiento"),
        F.col("quality").alias("Calidad"))
    return named.unpivot([key], ["Disponibilidad", "Rendimiento", "Calidad"], "componente", "valor").where(
        F.col("valor").isNotNull())


def daily_pace(ops: DataFrame, rates: DataFrame) -> DataFrame:
    """Real against ideal pieces per hour by day.

    Ideal: listed rate, else the historical pace of (machine, reference)
    clipped to 30-180, else 80.
    """
    keys = ["machine_name", "ref_id_str"]
    made = ops.where(F.col("estado") == "produccion")
    day = made.groupBy("fecha", *keys).agg(F.sum("piezas_ok").alias("ok"), F.sum("duracion_min").alias("mins"))
    hist = day.groupBy(*keys).agg(F.sum("ok").alias("h_ok"), F.sum("mins").alias("h_min"))
    hist = hist.where(F.col("h_min") > 0).select(*keys, x.clip(F.col("h_ok") / (F.col("h_min") / 60), UPH_LOW, UPH_HIGH).alias("uph_hist"))
    goal = F.coalesce(x.zero_as_null("piezas_hora_teorico"), F.col("uph_hist"), F.lit(UPH_DEFAULT))
    j = with_rate(day, rates).join(hist, keys, "left").withColumn("ideal", goal * (F.col("mins") / 60))
    out = j.where(F.col("fecha").isNotNull()).groupBy("fecha").agg(
        F.sum("ok").alias("piezas_ok"), F.sum("mins").alias("duracion_min"), F.sum("ideal").alias("ideal_piezas"))
    out = out.where(F.col("duracion_min") > 0)
    hours = F.col("duracion_min") / 60
    return out.withColumns({"uph_real": F.col("piezas_ok") / hours, "uph_ideal": F.col("ideal_piezas") / hours})


def machine_day_availability(ops: DataFrame) -> DataFrame:
    made = F.when(F.col("estado") == "produccion", F.col("duracion_min")).otherwise(0)
    return ops.dropna(subset=["machine_name", "fecha"]).groupBy("machine_name", "fecha").agg(
        x.ratio0(F.sum(made), F.sum("duracion_min")).alias("disponibilidad"))


def availability_pivot(days: DataFrame, start: date, end: date) -> DataFrame:
    """Machine x date: one column per day of the range, and ``dias_fuera``, the days of the machine outside it."""
    wanted = [start + timedelta(days=k) for k in range((end - start).days + 1)]
    cols = [F.max(F.when(F.col("fecha") == F.lit(d), F.col("disponibilidad"))).alias(str(d)) for d in wanted]
    return days.groupBy("machine_name").agg(*cols, F.count_if(~F.col("fecha").between(start, end)).alias("dias_fuera"))


def incident_pareto(ops: DataFrame, k: int = 10) -> DataFrame:
    """Top incident types by minutes with share of the top and running share."""
    kinds = ops.where((F.col("estado") == "incidencia") & F.col("tipo_incidencia").isNotNull())
    top = kinds.groupBy("tipo_incidencia").agg(F.sum("duracion_min").alias("duracion_min"))
    top = top.orderBy(F.desc("duracion_min"), "tipo_incidencia").limit(k)
    # at most k rows from here on
    every = W.partitionBy(F.lit(1))
    run = every.orderBy(F.desc("duracion_min"), "tipo_incidencia").rowsBetween(W.unboundedPreceding, 0)
    total = F.sum("duracion_min").over(every)
    return top.withColumns({
        "pct": 100 * F.col("duracion_min") / total,
        "pct_acum": 100 * F.sum("duracion_min").over(run) / total,
    })
