"""Feature tables of the models, and the splits that train them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from forja.functions import scalar as x
from forja.operators.lastop import last_valid_ops
from forja.operators.ordered import attach_row, join_null_safe, join_spread, row_numbers, top_k

# --- fixed values -----------------------------------------------------------
CLUSTER_FEATURES = ("disponibilidad", "scrap_rate", "uph_real", "dur_prod")
STATE_FEATURES = ("disponibilidad", "scrap_rate", "uph_real", "dur_prod", "dur_prep", "dur_inci",
                  "prep_ratio", "inci_ratio", "n_operaciones")
SCRAP_FEATURES = ("duracion_min", "hora_del_dia", "dia_semana", "ref_frequency")
CHANGE_FEATURES = ("piezas_hasta_cambio", "scrap_hasta_cambio", "ops_hasta_cambio", "duracion_cambio_min")
OTHER_MACHINES = "otras"
TOP_MACHINES = 10
# ----------------------------------------------------------------------------


def _state_minutes() -> list[Column]:
    names = {"produccion": "dur_prod", "preparacion": "dur_prep", "incidencia": "dur_inci"}
    return [F.sum(F.when(F.col("estado") == s, F.col("duracion_min")).otherwise(0.0)).alias(n) for s, n in names.items()]


def machine_metrics(ops: DataFrame, keys: Sequence[str] = ("machine_name",)) -> DataFrame:
    """Minutes by state and final-operation pieces per machine (and period).

    Missing piece totals are 0.  Pieces of an order go to the machine and
    period of its last valid operation.
    """
    keys = list(keys)
    if "periodo" in keys:
        ops = ops.withColumn("periodo", x.iso_week_label("ts_ini"))
    aggs = [*_state_minutes(), F.count("work_order_id").alias("n_operaciones"), F.max("ts_ini").alias("hasta")]
    time = ops.dropna(subset=keys).groupBy(*keys).agg(*aggs)
    last = last_valid_ops(ops, extra=[k for k in keys if k != "machine_name"]).dropna(subset=keys)
    made = last.groupBy(*keys).agg(F.sum("piezas_ok").alias("piezas_ok"), F.sum("piezas_scrap").alias("piezas_scrap"))
    j = time.join(made, keys, "left").fillna(0.0, subset=["piezas_ok", "piezas_scrap"])
    ok, sc, prod = F.col("piezas_ok"), F.col("piezas_scrap"), F.col("dur_prod")
    total = prod + F.col("dur_prep") + F.col("dur_inci")
    return j.withColumns({
        "total_dur": total,
        "disponibilidad": x.ratio(prod, total),
        "total_piezas": ok + sc,
        "scrap_rate": x.ratio(sc, ok + sc),
        "uph_real": x.ratio(60 * ok, prod),
        "prep_ratio": x.ratio(F.col("dur_prep"), prod),
        "inci_ratio": x.ratio(F.col("dur_inci"), prod),
    })


def machine_features(ops: DataFrame) -> DataFrame:
    """One row per machine with any recorded time."""
    return machine_metrics(ops).where(F.col("total_dur") > 0).drop("hasta", "n_operaciones", "prep_ratio", "inci_ratio")


def machine_weeks(ops: DataFrame) -> DataFrame:
    """One row per machine and ISO-week label with over an hour of time."""
    m = machine_metrics(ops, ["machine_name", "periodo"]).where(F.col("total_dur") > 60)
    return m.dropna(subset=["disponibilidad", "scrap_rate", "uph_real"])


def with_state(metrics: DataFrame, thresholds: Mapping[str, float] | None = None) -> DataFrame:
    return metrics.withColumn("estado", x.machine_state(thresholds=thresholds))


def latest_period(weeks: DataFrame) -> DataFrame:
    """The most recent row of each machine, by time and not by label text."""
    cols = [c for c in weeks.columns if c not in ("machine_name", "hasta", "periodo")]
    rec = F.struct("hasta", "periodo", *cols)
    return weeks.groupBy("machine_name").agg(F.max(rec).alias("r")).select("machine_name", "r.*")


def cluster_summary(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("cluster").agg(
        F.count("*").alias("n_maquinas"), F.avg("disponibilidad").alias("disp_media"),
        F.avg("scrap_rate").alias("scrap_medio"), F.avg("uph_real").alias("uph_media"))


def machine_groups(ops: DataFrame, k: int = TOP_MACHINES) -> DataFrame:
    """The k machines with most rows; everything else is one group."""
    freq = ops.where(F.col("machine_name").isNotNull()).groupBy("machine_name").agg(F.count("*").alias("n"))
    return top_k(freq, k, F.desc("n"), F.col("machine_name")).select("machine_name")


def scrap_rows(ops: DataFrame, only_valid: bool = True) -> DataFrame:
    """Operations that count for the scrap model, with the target and what their own columns say."""
    rows = ops.where(F.col("total_piezas") > 0) if only_valid else ops
    return rows.select(
        "work_order_id", "machine_name", "ts_ini", "ref_id_str", "op_id",
        "duracion_min", F.hour("ts_ini").alias("hora_del_dia"), F.weekday("ts_ini").alias("dia_semana"),
        x.ratio(F.col("piezas_scrap"), F.col("total_piezas")).alias("scrap_rate"),
        *[c.alias(n) for n, c in x.one_hot("estado", "estado", x.STATES).items()],
    ).dropna(subset=["duracion_min", "hora_del_dia", "scrap_rate"] if only_valid else ["ts_ini"])


def reference_frequency(ops: DataFrame, only_valid: bool = True) -> DataFrame:
    """Operations of each reference; those without one share a frequency, as a reference of their own."""
    rows = ops.where(F.col("total_piezas") > 0) if only_valid else ops
    return rows.groupBy("ref_id_str").agg(F.count("*").alias("ref_frequency"))


def scrap_features(ops: DataFrame, only_valid: bool = True, freq: DataFrame | None = None, top: DataFrame | None = None) -> DataFrame:
    """Per-operation features of the scrap model with the target.

    ``freq`` and ``top`` are stored tables of ``reference_frequency`` and
    ``machine_groups`` of the same rows: their size is known, so that no
    operation is shuffled while the references are few.
    """
    valid = ops.where(F.col("total_piezas") > 0) if only_valid else ops
    groups = (machine_groups(valid) if top is None else top).withColumn("machine_group", F.col("machine_name"))
    rows = scrap_rows(ops, only_valid)
    if freq is None:
        j = join_spread(rows, reference_frequency(ops, only_valid), ["ref_id_str"])
    else:
        j = join_null_safe(rows, freq, ["ref_id_str"], "left")
    j = j.join(F.broadcast(groups), "machine_name", "left")  # TOP_MACHINES rows
    states = [c for c in rows.columns if c.startswith("estado_")]
    return j.select("work_order_id", "machine_name", "ts_ini", "ref_id_str", "op_id", "duracion_min", "hora_del_dia", "dia_semana", "ref_frequency",
                    "scrap_rate", *states, F.coalesce("machine_group", F.lit(OTHER_MACHINES)).alias("machine_group"))


def with_machine_dummies(features: DataFrame, groups: Sequence[str]) -> DataFrame:
    return features.withColumns(x.one_hot("machine_group", "machine", groups))


def align(features: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Exactly ``names``, in order; what is missing or NULL is 0."""
    have = set(features.columns)
    cols = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in have else F.lit(0.0).alias(c) for c in names]
    return features.select(*keep, *cols)


# --- splits -----------------------------------------------------------------


def split_key(*cols: str) -> Column:
    """Hex digest of the row's key: the same on any engine and partitioning."""
    return F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]))


def hash_split(df: DataFrame, key: Column, test_share: float = 0.2) -> DataFrame:
    """Adds ``es_test``: about ``test_share`` of the keys, chosen by digest."""
    cut = f"{int(test_share * 16 ** 8):08x}"
    return df.withColumn("es_test", F.substring(key, 1, 8) < cut)


def stratified_split(df: DataFrame, label: str, key: Column, test_share: float = 0.2) -> DataFrame:
    """Adds ``es_test``: exactly ceil(share x n) rows of each class."""
    keyed = df.withColumn("__k", key)
    ranked = row_numbers(keyed, [label], F.substring("__k", 1, 3), [F.col("__k").asc()], "__r")
    sizes = df.groupBy(label).agg(F.count("*").alias("__n"))
    out = ranked.join(sizes, label)
    return out.withColumn("es_test", F.col("__r") <= F.ceil(F.col("__n") * F.lit(test_share))).drop("__k", "__r", "__n")


def _located(histogram: DataFrame, wanted: Column) -> DataFrame:
    """One row (cut, rest) of (b, n, wanted): the bucket that holds the wanted rank, and the rank inside it.

    The buckets, a fixed number of days or of minutes, are summed up inside one array.
    """
    row = histogram.groupBy().agg(F.sort_array(F.collect_list(F.struct("b", "n"))).alias("all"), F.max(wanted).alias("w"))
    return row.select(F.expr("""aggregate(all, struct(cast(null AS timestamp_ntz) AS cut, w AS rest), (a, x) -> CASE
        WHEN a.cut IS NOT NULL THEN a WHEN a.rest <= x.n THEN struct(x.b AS cut, a.rest AS rest) ELSE struct(a.cut AS cut, a.rest - x.n AS rest) END)""").alias("c")).select("c.*")


def temporal_split(df: DataFrame, ts: str, tie: Sequence[str], train_share: float = 0.8) -> DataFrame:
    """Adds ``es_test``: all but the first int(share x n) rows by time (NULL last) and ``tie``.

    The cut is located among days, then among the minutes of its day; only
    rows of one minute are ever ranked.
    """
    at = F.coalesce(F.col(ts).cast("timestamp_ntz"), F.lit("9999-12-31").cast("timestamp_ntz"))
    day, minute = F.date_trunc("day", at).cast("timestamp_ntz"), F.date_trunc("minute", at).cast("timestamp_ntz")
    keyed = df.withColumns({"__day": day, "__minute": minute})
    days = keyed.groupBy(F.col("__day").alias("b")).agg(F.count("*").alias("n"))
    total = days.agg(F.floor(F.sum("n") * F.lit(train_share)).cast("long").alias("w"))
    first = _located(attach_row(days, total), F.col("w")).select(F.col("cut").alias("__d"), F.col("rest").alias("__r"))
    keyed = attach_row(keyed, first)
    inside = keyed.where("__day = __d").groupBy(F.col("__minute").alias("b")).agg(F.count("*").alias("n"), F.max("__r").alias("w"))
    second = _located(inside, F.col("w")).select(F.col("cut").alias("__m"), F.col("rest").alias("__rest"))
    keyed = attach_row(keyed, second)
    order = W.partitionBy("__minute").orderBy(F.col(ts).asc_nulls_last(), *[F.col(c).asc() for c in tie])
    apart = keyed.where("__minute <> __m").withColumn("es_test", F.col("__minute") > F.col("__m"))
    last = keyed.where("__minute = __m").withColumn("es_test", F.row_number().over(order) > F.col("__rest"))
    return apart.unionByName(last).drop("__day", "__minute", "__d", "__r", "__m", "__rest")
