"""Trained models (checked by invariants in the tests, not by SQL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from forja.catalog import inputs as i
from forja.catalog.base import register
from forja.catalog.feature_queries import MACH, state_sql
from forja.catalog.feature_queries import features as scrap_rows
from forja.catalog.feature_queries import order_times, top_machines, weeks
from forja.catalog.route_queries import changes
from forja.ml import cluster as c
from forja.ml import density, forest, linear, metrics, micro, store
from forja.plans import features as f
from forja.plans.tooling import next_change
from forja.session import shared_dir
from forja.staging import fingerprint, staged

_fitted: dict[tuple[str, str, str], object] = {}


def once(spark, sf, name, build):
    """Fitted model kept for the application and the state of the sources: several queries use it."""
    key = (spark.sparkContext.applicationId, fingerprint(spark, sf), name)
    if key not in _fitted:
        _fitted[key] = build()
    return _fitted[key]


# --- clustering -------------------------------------------------------------


def machines(spark, sf):
    """Machine features, staged once: a fit reads them many times."""
    return staged(spark, sf, "maquinas", lambda: f.machine_features(i.ops(spark, sf)))


def kmeans(spark, sf):
    def build():
        points = c.scaled_points(machines(spark, sf)).persist()
        try:
            return c.fit_kmeans(points, 3)
        finally:
            points.unpersist()

    return once(spark, sf, "kmeans", build)


@register("M2_kmeans")
def m2(spark, sf):
    return kmeans(spark, sf).transform(c.scaled_points(machines(spark, sf))).select("machine_name", *f.CLUSTER_FEATURES, "cluster")


EPS, MIN_SAMPLES = 0.5, 3
DENSE = MACH + """, mm AS (SELECT * FROM met WHERE total_dur > 0 AND """ + " AND ".join(f"{n} IS NOT NULL" for n in f.CLUSTER_FEATURES) + """),
    st AS (SELECT """ + ", ".join(f"avg({n}) AS a_{n}, CASE WHEN stddev_pop({n}) > 0 THEN stddev_pop({n}) ELSE 1 END AS d_{n}" for n in f.CLUSTER_FEATURES) + """ FROM mm),
    z AS (SELECT machine_name, """ + ", ".join(f"({n} - a_{n})/d_{n} AS z_{n}" for n in f.CLUSTER_FEATURES) + """ FROM mm, st),
    nb AS (SELECT a.machine_name AS a, b.machine_name AS b FROM z a, z b WHERE """ + " + ".join(
    f"(a.z_{n} - b.z_{n})*(a.z_{n} - b.z_{n})" for n in f.CLUSTER_FEATURES) + f""" <= {EPS * EPS}),
    core AS (SELECT a FROM nb GROUP BY a HAVING count(*) >= {MIN_SAMPLES}),
    names AS (WITH RECURSIVE r(root, a) AS (SELECT a, a FROM core UNION SELECT root, nb.b FROM r JOIN nb ON nb.a = r.a JOIN core c ON c.a = nb.b)
      SELECT a, min(root) AS name FROM r GROUP BY a),
    own AS (SELECT machine_name, coalesce(min(n1.name), min(n2.name)) AS name, count(n1.name) > 0 AS es_nucleo
      FROM z LEFT JOIN names n1 ON n1.a = machine_name LEFT JOIN nb ON nb.a = machine_name LEFT JOIN names n2 ON n2.a = nb.b GROUP BY machine_name)
    SELECT machine_name, CASE WHEN name IS NULL THEN -1 ELSE CAST(dense_rank() OVER (ORDER BY name NULLS LAST) - 1 AS INTEGER) END AS cluster, es_nucleo FROM own"""


@register("M3_density", ("ops",), DENSE)
def m3(spark, sf):
    points = metrics.standardise(machines(spark, sf).dropna(subset=list(f.CLUSTER_FEATURES)), f.CLUSTER_FEATURES)
    return density.density_clusters(points, "machine_name", [f"z_{n}" for n in f.CLUSTER_FEATURES], EPS, MIN_SAMPLES)


@register("M4_hierarchical")
def m4(spark, sf):
    points = c.scaled_points(machines(spark, sf))
    return c.fit_hierarchical(points, 3).transform(points).select("machine_name", *f.CLUSTER_FEATURES, "cluster")


@register("M4_agglomerative")
def m4b(spark, sf):
    """The hierarchy from below (Ward), cut at three groups."""
    points = metrics.standardise(machines(spark, sf).dropna(subset=list(f.CLUSTER_FEATURES)), f.CLUSTER_FEATURES)
    return micro.fit_agglomerative(points, [f"z_{n}" for n in f.CLUSTER_FEATURES], 3).select("machine_name", *f.CLUSTER_FEATURES, "cluster")


ZDIST = "sqrt(" + " + ".join(f"(a.z_{n} - b.z_{n})*(a.z_{n} - b.z_{n})" for n in f.CLUSTER_FEATURES) + ")"


@register("M5_silhouette_euclidean", ("ops",), MACH + f""", mm AS (SELECT *, {state_sql()} AS cluster FROM met WHERE total_dur > 0 AND """ + " AND ".join(f"{n} IS NOT NULL" for n in f.CLUSTER_FEATURES) + """),
    st AS (SELECT """ + ", ".join(f"avg({n}) AS a_{n}, CASE WHEN stddev_pop({n}) > 0 THEN stddev_pop({n}) ELSE 1 END AS d_{n}" for n in f.CLUSTER_FEATURES) + """ FROM mm),
    z AS (SELECT machine_name, cluster, """ + ", ".join(f"({n} - a_{n})/d_{n} AS z_{n}" for n in f.CLUSTER_FEATURES) + f""" FROM mm, st),
    d AS (SELECT a.machine_name, a.cluster AS c0, b.cluster AS c1, sum({ZDIST}) AS s, count(*) AS n FROM z a, z b GROUP BY 1, 2, 3),
    ab AS (SELECT machine_name, max(CASE WHEN c0 = c1 THEN n END) AS n0, max(CASE WHEN c0 = c1 AND n > 1 THEN s/(n-1) END) AS a,
      min(CASE WHEN c0 <> c1 THEN s/n END) AS b FROM d GROUP BY 1)
    SELECT round(avg(CASE WHEN n0 = 1 THEN 0 ELSE coalesce((b-a)/nullif(greatest(a, b), 0), 0) END), 5) AS silhouette FROM ab WHERE b IS NOT NULL""")
def m5b(spark, sf):
    """Machines by their state, over all pairs of them."""
    points = f.with_state(machines(spark, sf).dropna(subset=list(f.CLUSTER_FEATURES))).withColumnRenamed("estado", "cluster")
    points = metrics.standardise(points, f.CLUSTER_FEATURES)
    return i.rounded(micro.silhouette_euclidean(points, [f"z_{n}" for n in f.CLUSTER_FEATURES], noise=None).select("silhouette"), 5)


@register("M8_k_sweep")
def m8(spark, sf):
    return c.sweep(c.scaled_points(machines(spark, sf)))


@register("M9_assignments")
def m9(spark, sf):
    m = machines(spark, sf)
    out = c.assign(kmeans(spark, sf), c.scaled_points(m), c.stats_of(m))
    return out.select("machine_name", "cluster", "distancia_al_centro", *[f"centro_{n}" for n in f.CLUSTER_FEATURES])


@register("M9_centres")
def m9b(spark, sf):
    return c.cluster_centres(kmeans(spark, sf), c.stats_of(machines(spark, sf)))


# --- scrap regression -------------------------------------------------------


def scrap_data(spark, sf):
    """Aligned features, target and split; the feature list is returned too."""
    rows = scrap_rows(spark, sf)
    groups = sorted(r["machine_name"] for r in top_machines(spark, sf).collect()) + [f.OTHER_MACHINES]
    names = [*f.SCRAP_FEATURES, *[f"estado_{s}" for s in ("incidencia", "preparacion", "produccion")], *[f"machine_{g}" for g in groups]]
    key = f.split_key("work_order_id", "op_id", "machine_name", "ts_ini")
    split = f.hash_split(f.with_machine_dummies(rows, groups), key)
    keep = ["machine_name", "scrap_rate", "es_test"]
    return f.align(split, names, keep), names


def scrap_model(spark, sf):
    def build():
        data, names = scrap_data(spark, sf)
        stats = metrics.scaler_stats(data.where(~F.col("es_test")), names)
        stats = spark.createDataFrame([stats.first()], stats.schema)  # one row, computed once for all that scale by it
        train = metrics.standardise(data.where(~F.col("es_test")), names, stats).drop(*names)
        return forest.fit_regressor(train, [f"z_{n}" for n in names], "scrap_rate"), names, stats

    return once(spark, sf, "scrap", build)


def scrap_predictions(spark, sf, tested=False):
    """All rows with their prediction, or those of the test."""
    model, names, stats = scrap_model(spark, sf)
    data, _ = scrap_data(spark, sf)
    data = data.where("es_test") if tested else data
    return forest.predict_regression(model, metrics.standardise(data, names, stats))


@register("M11_scrap_forest")
def m11(spark, sf):
    p = scrap_predictions(spark, sf)
    return metrics.regression_metrics(p, "scrap_rate", "pred", ["es_test"])


@register("M26_scrap_importances")
def m26(spark, sf):
    model, names, _ = scrap_model(spark, sf)
    return forest.importances(model, names, i.ops(spark, sf))


@register("M27_scored_intervals")
def m27(spark, sf):
    p = metrics.with_interval(scrap_predictions(spark, sf, tested=True), "pred")
    return p.select("machine_name", "scrap_rate", "pred", "inferior", "superior")


@register("M31_scrap_report")
def m31(spark, sf):
    model, names, _ = scrap_model(spark, sf)
    p = scrap_predictions(spark, sf, tested=True)
    return forest.report(p, "scrap_rate", "pred", metrics.regression_metrics(p, "scrap_rate", "pred"),
                         forest.importances(model, names, i.ops(spark, sf)))


# --- machine state ----------------------------------------------------------


def state_rows(spark, sf):
    rows = f.with_state(weeks(spark, sf))
    split = f.stratified_split(rows, "estado", f.split_key("machine_name", "periodo"))
    return f.align(split, f.STATE_FEATURES, ["machine_name", "periodo", "estado", "es_test"])


def state_model(spark, sf):
    return once(spark, sf, "estado", lambda: forest.fit_classifier(
        state_rows(spark, sf).where(~F.col("es_test")), f.STATE_FEATURES, "estado"))


@register("M14_state_forest")
def m14(spark, sf):
    p = forest.predict_state(state_model(spark, sf), state_rows(spark, sf).where("es_test"))
    return metrics.classification_report(p, "estado", "estado_predicho")


@register("M15_state_probabilities")
def m15(spark, sf):
    p = forest.predict_state(state_model(spark, sf), state_rows(spark, sf))
    return p.select("machine_name", "periodo", "estado", "estado_predicho", "confianza", "probabilidades.*")


# --- order duration ---------------------------------------------------------


def duration_split(spark, sf):
    return f.hash_split(order_times(spark, sf), f.split_key("work_order_id"))


def duration_model(spark, sf):
    return once(spark, sf, "duracion", lambda: linear.fit_duration(duration_split(spark, sf).where(~F.col("es_test"))))


@register("M21_duration_regression")
def m21(spark, sf):
    p = linear.predict_duration(duration_model(spark, sf), duration_split(spark, sf).where("es_test"))
    return metrics.duration_metrics(p, "tiempo_total_min", "pred_tiempo_total_min")


@register("M24_scenarios")
def m24(spark, sf):
    """Every catalogue reference, and one that is unknown, at its mean quantity."""
    rows = duration_split(spark, sf)
    known = linear.known_references(rows.where(~F.col("es_test")))
    mean = rows.groupBy("ref_id_str").agg(F.avg("cantidad_lanzada").alias("cantidad_lanzada"))
    other = rows.agg(F.avg("cantidad_lanzada").alias("cantidad_lanzada")).select(F.lit("999999").alias("ref_id_str"), "cantidad_lanzada")
    return linear.predict_scenarios(duration_model(spark, sf), mean.unionByName(other), known)


# --- next tool change -------------------------------------------------------


@register("M25_next_change_forest")
def m25(spark, sf):
    d = next_change(changes(spark, sf)).fillna(0.0, subset=["duracion_cambio_min"])
    s = f.temporal_split(d, "ts_cambio", ["machine_id", "next_ts", "piezas_hasta_cambio", "ops_hasta_cambio"])
    model = forest.fit_regressor(s.where(~F.col("es_test")), f.CHANGE_FEATURES, "minutes_to_next_change", trees=200, depth=forest.DEEPEST, leaf=1)
    p = forest.predict_regression(model, s.where("es_test"))
    return metrics.regression_metrics(p, "minutes_to_next_change", "pred")


# --- model store ------------------------------------------------------------


def model_root(spark):
    return f"{shared_dir(spark)}/models-{spark.sparkContext.applicationId}"


def stored(spark, sf, name, kind, features, build, classes=()):
    """Fits and saves a model once per application and data folder; returns the reloaded one."""
    def save():
        model = build()
        version = store.save_model(spark, model_root(spark), name, model, features, {}, classes, kind)
        return store.load_model(spark, model_root(spark), name, version)[0]

    return once(spark, sf, f"guardado_{name}", save)


def stored_kmeans(spark, sf):
    return stored(spark, sf, "maquinas", "kmeans", f.CLUSTER_FEATURES, lambda: store.scaled_model(
        c.stats_of(machines(spark, sf)), f.CLUSTER_FEATURES, kmeans(spark, sf), assemble=True))


def stored_scrap(spark, sf):
    def build():
        model, names, stats = scrap_model(spark, sf)
        return store.scaled_model(stats, names, model)

    return stored(spark, sf, "scrap", "forest", scrap_model(spark, sf)[1], build)


def stored_state(spark, sf):
    return stored(spark, sf, "estado", "forest", f.STATE_FEATURES, lambda: state_model(spark, sf), forest.classes(state_model(spark, sf)))


@register("M29_stored_kmeans")
def m29b(spark, sf):
    """Clusters by the reloaded scaler and K-Means, beside those of the model in memory."""
    m = machines(spark, sf).dropna(subset=list(f.CLUSTER_FEATURES))
    again = stored_kmeans(spark, sf).transform(m).select("machine_name", F.col("cluster").alias("guardado"))
    return m2(spark, sf).select("machine_name", "cluster").join(again, "machine_name")


@register("M29_stored_scrap")
def m29c(spark, sf):
    """Scrap rates by the reloaded scaler and forest."""
    data, _ = scrap_data(spark, sf)
    p = forest.predict_regression(stored_scrap(spark, sf), data)
    return metrics.regression_metrics(p, "scrap_rate", "pred", ["es_test"])


@register("M29_stored_state")
def m29d(spark, sf):
    """States by the reloaded forest."""
    p = forest.predict_state(stored_state(spark, sf), state_rows(spark, sf))
    return p.groupBy("estado", "estado_predicho").agg(F.count("*").alias("n"))


@register("M28_stored_clustering")
def m28b(spark, sf):
    """A candidate with one more cluster against the stored model, on the same machines."""
    points = c.scaled_points(machines(spark, sf))
    kept = points.persist()
    try:
        candidate = c.fit_kmeans(kept, 4).transform(points)
    finally:
        kept.unpersist()
    old = stored_kmeans(spark, sf).transform(points.select("machine_name", *f.CLUSTER_FEATURES))
    return metrics.compare_clusterings(candidate, old, [f"z_{n}" for n in f.CLUSTER_FEATURES])


@register("M28_stored_regression")
def m28c(spark, sf):
    """A candidate forest without the machine columns against the stored one, on the test rows."""
    data, _ = scrap_data(spark, sf)
    names = list(f.SCRAP_FEATURES)
    candidate = forest.fit_regressor(data.where(~F.col("es_test")), names, "scrap_rate", prediction="nuevo")
    rows = forest.predict_regression(candidate, data.where("es_test"))
    return metrics.compare_models(forest.predict_regression(stored_scrap(spark, sf), rows), "scrap_rate", "nuevo", "pred")


@register("M28_stored_classification")
def m28d(spark, sf):
    """A shallower candidate forest against the stored one, on the test rows."""
    rows = state_rows(spark, sf)
    candidate = forest.fit_classifier(rows.where(~F.col("es_test")), f.STATE_FEATURES, "estado", depth=4)
    p = forest.predict_state(candidate, rows.where("es_test")).select(
        "machine_name", "periodo", "estado", *f.STATE_FEATURES, F.col("estado_predicho").alias("nuevo"))
    p = forest.predict_state(stored_state(spark, sf), p)
    return metrics.compare_classifiers(p, "estado", "nuevo", "estado_predicho")


@register("M29_model_store")
def m29(spark, sf):
    """Saves the duration model, reads it back and scores with it."""
    root = model_root(spark)
    rows = duration_split(spark, sf)
    m = metrics.duration_metrics(linear.predict_duration(duration_model(spark, sf), rows.where("es_test")), "tiempo_total_min", "pred_tiempo_total_min").first()
    version = store.save_model(spark, root, "duracion", duration_model(spark, sf), ["ref_id_str", "cantidad_lanzada"],
                               {"mae_min": m["mae_min"] or 0.0, "r2": m["r2"] or 0.0}, kind="linear")
    model, _ = store.load_model(spark, root, "duracion", version)
    p = linear.predict_duration(model, rows)
    return p.select("work_order_id", "ref_id_str", "cantidad_lanzada", "pred_tiempo_total_min", F.lit(version).alias("version"))
