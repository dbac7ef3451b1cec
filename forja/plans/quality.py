"""Data-quality audits and the cleaning policy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forja.functions import scalar as x
from forja.operators.ordered import join_spread, quantiles


def null_profile(df: DataFrame) -> DataFrame:
    """Columns with missing values: count and percentage, in one pass."""
    counts = df.agg(F.count("*").alias("__n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    long = counts.unpivot(["__n"], list(df.columns), "columna", "faltantes")
    pct = F.round(100.0 * F.col("faltantes") / F.col("__n"), 2)
    return long.where(F.col("faltantes") > 0).select("columna", "faltantes", pct.alias("porcentaje"))


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row in every column."""
    g = df.groupBy(*df.columns).agg(F.count("*").alias("__n"))
    return g.agg(x.sum0("__n").alias("filas"), x.sum0(F.col("__n") - 1).alias("duplicadas"))


def range_audit(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    aggs = [F.count("*").alias("__n")]
    for c in cols:
        v = F.col(c)
        aggs.append(F.struct(F.min(v).alias("minimo"), F.max(v).alias("maximo"), F.count_if(v < 0).alias("negativos"),
                             F.count_if(v == 0).alias("ceros")).alias(c))
    items = F.array(*[F.struct(F.lit(c).alias("columna"), F.col(c).alias("a")) for c in cols])
    one = df.agg(*aggs).select("__n", F.explode(items).alias("i"))
    return one.select("i.columna", "i.a.*", F.round(100.0 * F.col("i.a.ceros") / F.col("__n"), 2).alias("ceros_pct"))


def id_audit(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct values and shortest/longest text of identifiers."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], list(cols), "columna", "valor")
    seen = long.where(F.col("valor").isNotNull()).groupBy("columna", "valor").agg(F.count("*").alias("n"))
    return seen.groupBy("columna").agg(
        F.count("*").alias("distintos"), F.min(F.length("valor")).alias("largo_min"), F.max(F.length("valor")).alias("largo_max"))


def id_lengths(df: DataFrame, c: str) -> DataFrame:
    return df.where(F.col(c).isNotNull()).groupBy(F.length(c).alias("largo")).agg(F.count("*").alias("n"))


def id_name_pairs(df: DataFrame, id_col: str, name_col: str) -> DataFrame:
    return df.select(id_col, name_col).distinct()


def duration_drift(df: DataFrame) -> DataFrame:
    """Recorded minutes against end minus start."""
    diff = F.abs(F.col("duracion_min") - x.minutes_between("ts_ini", "ts_fin"))
    g = df.select(diff.alias("d")).agg(
        F.count("*").alias("filas"), F.count("d").alias("comparables"), F.sum("d").alias("s"), F.count_if(F.col("d") > 1).alias("mas_de_1_min"))
    return g.select("filas", "comparables", x.ratio(F.col("s"), F.col("comparables")).alias("diferencia_media"), "mas_de_1_min",
                    F.round(100.0 * F.col("mas_de_1_min") / F.col("filas"), 2).alias("mas_de_1_min_pct"))


def counts_by_time(ops: DataFrame) -> DataFrame:
    """Operations per day, hour and weekday in one long table."""
    known = ops.where(F.col("ts_ini").isNotNull())
    g = known.groupBy(F.col("ts_ini").cast("date").alias("d"), F.hour("ts_ini").alias("h")).agg(F.count("*").alias("n"))
    parts = F.array(
        F.struct(F.lit("fecha").alias("parte"), F.col("d").cast("string").alias("valor")),
        F.struct(F.lit("hora").alias("parte"), F.col("h").cast("string").alias("valor")),
        F.struct(F.lit("dia_semana").alias("parte"), F.weekday("d").cast("string").alias("valor")))
    return g.select("n", F.explode(parts).alias("p")).groupBy("p.parte", "p.valor").agg(F.sum("n").alias("n"))


def mean_by(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.avg(value).alias(f"{value}_medio"))


def frequency(df: DataFrame, key: str, name: str) -> DataFrame:
    """Each row with the number of rows that share its key (NULL keys: NULL)."""
    freq = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(name))
    return join_spread(df, freq, [key])


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count, mean, sample deviation, minimum, quartiles and maximum."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], list(cols), "columna", "valor")
    long = long.where(F.col("valor").isNotNull())
    basic = long.groupBy("columna").agg(
        F.count("valor").alias("n"), F.avg("valor").alias("media"), F.stddev_samp("valor").alias("desviacion"),
        F.min("valor").alias("minimo"), F.max("valor").alias("maximo"))
    q = quantiles(long, ["columna"], "valor", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return basic.join(q, "columna")


def categorical_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows per value of each category, with the cardinality of the column."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], list(cols), "columna", "valor")
    dist = long.where(F.col("valor").isNotNull()).groupBy("columna", "valor").agg(F.count("*").alias("n"))
    card = dist.groupBy("columna").agg(F.count("*").alias("distintos"))
    return dist.join(card, "columna")


def quality_report(df: DataFrame, name: str, ranges: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """All audits of a table in one long (tabla, prueba, columna, valor) table.

    Nulls, ranges and drift come from one pass; duplicates and identifiers
    need their own grouping.
    """
    drift = F.abs(F.col("duracion_min") - x.minutes_between("ts_ini", "ts_fin"))
    tests = [("faltantes", c, F.count_if(F.col(c).isNull())) for c in df.columns]
    for c in ranges:
        v = F.col(c)
        tests += [("minimo", c, F.min(v)), ("maximo", c, F.max(v)), ("negativos", c, F.count_if(v < 0)), ("ceros", c, F.count_if(v == 0))]
    tests.append(("mas_de_1_min", "duracion_min", F.count_if(drift > 1)))
    one = df.agg(*[a.cast("double").alias(f"v{k}") for k, (_, _, a) in enumerate(tests)])
    items = F.array(*[F.struct(F.lit(t).alias("prueba"), F.lit(c).alias("columna"), F.col(f"v{k}").alias("valor")) for k, (t, c, _) in enumerate(tests)])
    long = one.select(F.explode(items).alias("i")).select("i.*").where((F.col("prueba") != "faltantes") | (F.col("valor") > 0))

    def rows(audit: DataFrame, test: str, col, value) -> DataFrame:
        return audit.select(F.lit(test).alias("prueba"), col.alias("columna"), value.cast("double").alias("valor"))

    long = long.unionByName(rows(duplicate_count(df), "duplicadas", F.lit("*"), F.col("duplicadas")))
    long = long.unionByName(rows(id_audit(df, ids), "distintos", F.col("columna"), F.col("distintos")))
    return long.select(F.lit(name).alias("tabla"), "prueba", "columna", "valor")


def clean(raw: DataFrame) -> DataFrame:
    """Declared policy: exact duplicates and negative values go, ids normalised."""
    ok = F.lit(True)
    for c in ("duracion_min", "piezas_ok", "piezas_scrap"):
        ok = ok & F.coalesce(F.col(c) >= 0, F.lit(True))
    return raw.dropDuplicates().where(ok).withColumn("ref_id_str", x.norm_ref("ref_id"))
