"""Model metrics as DataFrame aggregations over predictions or labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forja.functions import scalar as x
from forja.operators.ordered import attach_row, running_totals


# --- scaling ----------------------------------------------------------------


def scaler_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row with mean and population deviation (0 becomes 1) per column."""
    return df.agg(*[F.avg(c).alias(f"media_{c}") for c in cols],
                  *[F.when(F.stddev_pop(c) > 0, F.stddev_pop(c)).otherwise(1.0).alias(f"desv_{c}") for c in cols])


def standardise(df: DataFrame, cols: Sequence[str], stats: DataFrame | None = None) -> DataFrame:
    """Adds ``z_<col>`` columns."""
    j = attach_row(df, stats if stats is not None else scaler_stats(df, cols))
    z = {f"z_{c}": (F.col(c) - F.col(f"media_{c}")) / F.col(f"desv_{c}") for c in cols}
    return j.withColumns(z).drop(*[f"{p}_{c}" for p in ("media", "desv") for c in cols])


# --- regression -------------------------------------------------------------


def _sums(truth: str, pred: str) -> list[Column]:
    """n, mae, rmse, sse and v of the rows that have both values."""
    both = F.col(truth).isNotNull() & F.col(pred).isNotNull()
    y, e = F.when(both, F.col(truth)), F.col(truth) - F.col(pred)
    return [F.count(y).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.sum(e * e).alias("sse"), F.var_pop(y).alias("v")]


def _r2(side: str = "") -> Column:
    sse, v, n = (F.col(f"{c}{side}") for c in ("sse", "v", "n"))
    return 1 - sse / F.nullif(v * n, F.lit(0.0))


def regression_metrics(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """n, MAE, RMSE and R2 in one pass."""
    g = df.where(F.col(truth).isNotNull() & F.col(pred).isNotNull()).groupBy(*by).agg(*_sums(truth, pred))
    return g.select(*by, "n", "mae", "rmse", _r2().alias("r2"))


def duration_metrics(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """MAE in minutes, hours and days, RMSE, R2 and MAPE without zero truths."""
    m = regression_metrics(df, truth, pred)
    y = F.col(truth)
    mape = df.agg((100 * F.avg(F.when(y != 0, F.abs(y - F.col(pred)) / F.abs(y)))).alias("mape"))
    return attach_row(m, mape).select(
        "n", F.col("mae").alias("mae_min"), (F.col("mae") / 60).alias("mae_horas"), (F.col("mae") / 1440).alias("mae_dias"),
        F.col("rmse").alias("rmse_min"), "r2", F.col("mape").alias("mape_pct"))


def with_interval(df: DataFrame, pred: str, sigma: float = 0.02, z: float = 1.96) -> DataFrame:
    """Constant-width interval around a predicted rate, inside [0, 1]."""
    p = F.col(pred)
    return df.withColumns({"inferior": F.greatest(p - z * sigma, F.lit(0.0)), "superior": F.least(p + z * sigma, F.lit(1.0))})


def error_histogram(df: DataFrame, truth: str, pred: str, bins: int = 30) -> DataFrame:
    """Rows per equal-width bin of the absolute error."""
    e = df.select(F.abs(F.col(truth) - F.col(pred)).alias("e")).where(F.col("e").isNotNull())
    span = e.agg(F.max("e").alias("m"))
    j = attach_row(e, span)
    b = F.when(F.col("m") > 0, F.least(F.floor(F.col("e") / F.col("m") * bins), F.lit(bins - 1))).otherwise(F.lit(0))
    return j.groupBy(b.cast("int").alias("barra")).agg(F.count("*").alias("n"))


def compare_models(df: DataFrame, truth: str, candidate: str, stored: str) -> DataFrame:
    """Metrics of two prediction columns on the same rows, and the deltas, in one pass: predicting is what is dear."""
    sides = {"_nuevo": candidate, "_guardado": stored}
    names = ("n", "mae", "rmse", "sse", "v")
    sums = [F.struct(*_sums(truth, pred)).alias(side) for side, pred in sides.items()]
    g = df.agg(*sums).select(*[F.col(f"{side}.{c}").alias(f"{c}{side}") for side in sides for c in names])
    g = g.select(*[c for side in sides for c in (F.col(f"mae{side}"), F.col(f"rmse{side}"), _r2(side).alias(f"r2{side}"))])
    return g.withColumns({f"{c}_delta": F.col(f"{c}_nuevo") - F.col(f"{c}_guardado") for c in ("mae", "rmse", "r2")})


def compare_clusterings(candidate: DataFrame, stored: DataFrame, cols: Sequence[str], label: str = "cluster") -> DataFrame:
    """Silhouette and Davies-Bouldin of two assignments of the same rows, and the deltas."""
    sides = []
    for side, df in (("nuevo", candidate), ("guardado", stored)):
        sides += [silhouette(df, cols, label, None).select(F.col("silhouette").alias(f"silhouette_{side}")),
                  davies_bouldin(df, cols, label, None).select(F.col("davies_bouldin").alias(f"davies_bouldin_{side}"))]
    j = attach_row(sides[0], *sides[1:])
    return j.withColumns({f"{c}_delta": F.col(f"{c}_nuevo") - F.col(f"{c}_guardado") for c in ("silhouette", "davies_bouldin")})


def compare_classifiers(df: DataFrame, truth: str, candidate: str, stored: str) -> DataFrame:
    """Accuracy of two prediction columns on the same rows, and the delta."""
    hit = lambda c: F.avg(F.when(F.col(truth) == F.col(c), 1.0).otherwise(0.0))
    g = df.agg(F.count("*").alias("n"), hit(candidate).alias("exactitud_nuevo"), hit(stored).alias("exactitud_guardado"))
    return g.withColumn("exactitud_delta", F.col("exactitud_nuevo") - F.col("exactitud_guardado"))


def error_by(df: DataFrame, key: str, truth: str, pred: str) -> DataFrame:
    e = F.abs(F.col(truth) - F.col(pred))
    return df.groupBy(key).agg(F.avg(truth).alias("real"), F.avg(pred).alias("predicho"), F.avg(e).alias("error_medio"), F.count(e).alias("n_operaciones"))


# --- classification ---------------------------------------------------------


def confusion(df: DataFrame, truth: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("real"), F.col(pred).alias("predicho")).agg(F.count("*").alias("n"))


def state_counts(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Per true class: its rows, those predicted as it, and rows predicted as it in all."""
    c = confusion(df, truth, pred)
    real = c.groupBy(F.col("real").alias("estado")).agg(
        F.sum("n").alias("n"), x.sum0(F.when(F.col("real") == F.col("predicho"), F.col("n"))).alias("iguales"))
    guess = c.groupBy(F.col("predicho").alias("estado")).agg(F.sum("n").alias("n_predichas"))
    return real.join(guess, "estado", "left").fillna(0, subset=["n_predichas"])


def classification_report(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Precision, recall, F1 and support per class, accuracy, macro, weighted.

    Only the confusion counts, at most classes squared rows, go further.
    """
    c = confusion(df, truth, pred)
    side = F.array(F.struct(F.col("real").alias("clase"), F.col("n").alias("s"), F.lit(0).cast("bigint").alias("p"),
                            F.when(F.col("real") == F.col("predicho"), F.col("n")).otherwise(0).alias("tp")),
                   F.struct(F.col("predicho").alias("clase"), F.lit(0).cast("bigint").alias("s"), F.col("n").alias("p"), F.lit(0).cast("bigint").alias("tp")))
    g = c.select(F.explode(side).alias("i")).select("i.*").groupBy("clase").agg(
        F.sum("s").alias("soporte"), F.sum("p").alias("predichas"), F.sum("tp").alias("aciertos"))
    precision, recall = x.ratio0(F.col("aciertos"), F.col("predichas")), x.ratio0(F.col("aciertos"), F.col("soporte"))
    g = g.withColumns({"precision": precision, "recall": recall})
    g = g.withColumn("f1", x.ratio0(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    stats = ("precision", "recall", "f1")
    rows = g.select("clase", *stats, "soporte")
    s = F.col("soporte")
    macro = g.agg(*[F.avg(c).alias(c) for c in stats], F.sum("soporte").alias("soporte")).select(F.lit("macro").alias("clase"), *stats, "soporte")
    weighted = g.agg(*[(F.sum(F.col(c) * s) / F.sum(s)).alias(c) for c in stats], F.sum("soporte").alias("soporte")).select(
        F.lit("ponderada").alias("clase"), *stats, "soporte")
    acc = g.agg((F.sum("aciertos") / F.sum("soporte")).alias("a"), F.sum("soporte").alias("soporte")).select(
        F.lit("exactitud").alias("clase"), F.col("a").alias("precision"), F.col("a").alias("recall"), F.col("a").alias("f1"), "soporte")
    return rows.unionByName(macro).unionByName(weighted).unionByName(acc)


def roc_points(scores: DataFrame, cls: str = "clase", truth: str = "positivo", score: str = "score") -> DataFrame:
    """False and true positive rates after each distinct score, per class.

    Scores lie in [0, 1]; equal scores are merged before anything is ordered,
    and cumulation runs inside score bands.
    """
    pos = F.when(F.col(truth), 1).otherwise(0)
    g = scores.where(F.col(score).isNotNull()).groupBy(cls, score).agg(F.sum(pos).alias("p"), F.sum(1 - pos).alias("f"))
    r = running_totals(g, [cls], F.floor(-F.col(score) * 4096), [F.col(score).desc()], {"tp": F.col("p"), "fp": F.col("f")})
    tot = g.groupBy(cls).agg(F.sum("p").alias("np"), F.sum("f").alias("nf"))
    return r.join(tot, cls).select(
        cls, score, "tp", "fp", "p", "f", "np", "nf",
        (F.col("fp") / F.nullif(F.col("nf"), F.lit(0))).alias("fpr"), (F.col("tp") / F.nullif(F.col("np"), F.lit(0))).alias("tpr"))


def auc(points: DataFrame, cls: str = "clase") -> DataFrame:
    """Area under each ROC curve: trapezoids from each point's own step."""
    # the previous point is (fp - f, tp - p), so no ordering is needed
    area = (F.col("f") * (2 * F.col("tp") - F.col("p"))) / F.lit(2.0)
    g = points.groupBy(cls).agg(F.sum(area).alias("a"), F.max("np").alias("np"), F.max("nf").alias("nf"))
    return g.select(cls, (F.col("a") / F.nullif((F.col("np") * F.col("nf")).cast("double"), F.lit(0.0))).alias("auc"))


# --- clustering -------------------------------------------------------------


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def _dist2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)


def cluster_stats(points: DataFrame, cols: Sequence[str], label: str = "cluster") -> DataFrame:
    """Per cluster: size, centre, mean squared norm and mean distance to centre."""
    g = points.groupBy(label).agg(
        F.count("*").alias("n"), F.array(*[F.avg(c) for c in cols]).alias("centro"),
        F.avg(sum((F.col(c) * F.col(c) for c in cols[1:]), F.col(cols[0]) * F.col(cols[0]))).alias("norma2"))
    v = F.array(*[F.col(c) for c in cols])
    spread = points.join(g.select(label, "centro"), label).groupBy(label).agg(F.avg(F.sqrt(_dist2(v, F.col("centro")))).alias("dispersion"))
    return g.join(spread, label)


def _as_array(stats: DataFrame, label: str) -> DataFrame:
    """The k clusters (k is a model parameter) as one array in one row."""
    rec = F.struct(F.col(label).alias("c"), "n", "centro", "norma2", "dispersion")
    return stats.agg(F.sort_array(F.collect_list(rec)).alias("cs"))


def silhouette(points: DataFrame, cols: Sequence[str], label: str = "cluster", noise: int | None = -1) -> DataFrame:
    """Mean silhouette over squared Euclidean distance, noise left out.

    The mean squared distance to a cluster follows from its size, centre and
    mean squared norm, so no pair of points is ever formed.
    """
    p = points.where(F.col(label) != noise) if noise is not None else points
    one = _as_array(cluster_stats(p, cols, label), label)
    v = F.array(*[F.col(c) for c in cols])
    j = attach_row(p.select(F.col(label).alias("c0"), v.alias("v")), one)
    norm = _dot(F.col("v"), F.col("v"))

    def mean_d(c: Column) -> Column:
        return norm + c["norma2"] - 2 * _dot(F.col("v"), c["centro"])

    own = F.filter("cs", lambda c: c["c"] == F.col("c0"))[0]
    others = F.transform(F.filter("cs", lambda c: c["c"] != F.col("c0")), mean_d)
    j = j.select(own["n"].alias("n0"), (mean_d(own) * own["n"] / F.nullif(own["n"] - 1, F.lit(0))).alias("a"), F.array_min(others).alias("b"))
    s = F.when(F.col("n0") == 1, 0.0).otherwise((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)))
    return j.where(F.col("b").isNotNull()).agg(F.avg(F.coalesce(s, F.lit(0.0))).alias("silhouette"))


def davies_bouldin(points: DataFrame, cols: Sequence[str], label: str = "cluster", noise: int | None = -1) -> DataFrame:
    p = points.where(F.col(label) != noise) if noise is not None else points
    one = _as_array(cluster_stats(p, cols, label), label)
    worst = F.transform("cs", lambda a: F.array_max(F.transform(
        F.filter("cs", lambda b: b["c"] != a["c"]),
        lambda b: (a["dispersion"] + b["dispersion"]) / F.nullif(F.sqrt(_dist2(a["centro"], b["centro"])), F.lit(0.0)))))
    total = F.aggregate(worst, F.lit(0.0), lambda s, w: s + F.coalesce(w, F.lit(0.0)))
    return one.select(F.when(F.size("cs") > 1, total / F.size("cs")).alias("davies_bouldin"))


def calinski_harabasz(points: DataFrame, cols: Sequence[str], label: str = "cluster", noise: int | None = -1) -> DataFrame:
    """Between- over within-cluster variance, each by its degrees of freedom."""
    p = points.where(F.col(label) != noise) if noise is not None else points
    per = p.groupBy(label).agg(F.count("*").alias("n"), *[F.sum(c).alias(f"s_{c}") for c in cols],
                               sum((F.sum(F.col(c) * F.col(c)) for c in cols[1:]), F.sum(F.col(cols[0]) * F.col(cols[0]))).alias("q"))
    centre2 = sum((F.col(f"s_{c}") * F.col(f"s_{c}") for c in cols[1:]), F.col(f"s_{cols[0]}") * F.col(f"s_{cols[0]}")) / F.col("n")
    t = per.withColumn("m", centre2).agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("q").alias("q"), F.sum("m").alias("m"),
        *[F.sum(f"s_{c}").alias(f"s_{c}") for c in cols])
    grand = sum((F.col(f"s_{c}") * F.col(f"s_{c}") for c in cols[1:]), F.col(f"s_{cols[0]}") * F.col(f"s_{cols[0]}")) / F.col("n")
    between, within = F.col("m") - grand, F.col("q") - F.col("m")
    return t.select(F.when(F.col("k") > 1, (between / (F.col("k") - 1)) / F.nullif(within / (F.col("n") - F.col("k")), F.lit(0.0))).alias("calinski_harabasz"))
