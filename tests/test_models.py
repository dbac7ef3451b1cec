from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from frames import as_dicts, at, ops

from forja.ml import cluster, forest, linear, metrics, store
from forja.plans import features as f


def preds(spark):
    rows = [(0.0, 1.0), (2.0, 1.0), (4.0, 5.0), (0.0, 0.5), (8.0, 8.0), (10.0, 7.0)]
    return rows, spark.createDataFrame(rows, "y double, p double")


def test_regression_metrics(spark):
    rows, df = preds(spark)
    y, p = np.array(rows).T
    [m] = as_dicts(metrics.regression_metrics(df, "y", "p"))
    assert m["mae"] == pytest.approx(np.abs(y - p).mean())
    assert m["rmse"] == pytest.approx(np.sqrt(((y - p) ** 2).mean()))
    assert m["r2"] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    [d] = as_dicts(metrics.duration_metrics(df, "y", "p"))
    k = y != 0
    assert d["mape_pct"] == pytest.approx(100 * (np.abs(y - p)[k] / y[k]).mean())
    assert d["mae_dias"] == pytest.approx(m["mae"] / 1440)


def test_classification_report(spark):
    truth, guess = list("aaabbc"), list("aabbcc")
    df = spark.createDataFrame(list(zip(truth, guess)), "t string, p string")
    got = {r["clase"]: r for r in as_dicts(metrics.classification_report(df, "t", "p"))}
    assert got["a"]["precision"] == 1.0 and got["a"]["recall"] == pytest.approx(2 / 3)
    assert got["b"]["f1"] == pytest.approx(0.5) and got["exactitud"]["f1"] == pytest.approx(4 / 6)
    assert got["macro"]["soporte"] == 6


def test_auc_with_ties_equals_pair_count(spark):
    r = random.Random(5)
    rows = [("c", r.randint(0, 8) / 8, r.random() < 0.4) for _ in range(200)]
    df = spark.createDataFrame(rows, "clase string, score double, positivo boolean")
    pos = [s for _, s, t in rows if t]
    neg = [s for _, s, t in rows if not t]
    want = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    [got] = as_dicts(metrics.auc(metrics.roc_points(df)))
    assert got["auc"] == pytest.approx(want)


def blobs(spark, n=40):
    r = random.Random(2)
    rows = [(i % 2, r.gauss(10 * (i % 2), 1), r.gauss(0, 1)) for i in range(n)] + [(2, 50.0, 50.0)]
    return rows, spark.createDataFrame(rows, "cluster int, x double, y double")


def test_cluster_metrics_against_numpy(spark):
    rows, df = blobs(spark)
    lab, pts = np.array([r[0] for r in rows]), np.array([r[1:] for r in rows])
    d2 = ((pts[:, None, :] - pts[None, :, :]) ** 2).sum(-1)
    sil = []
    for i in range(len(pts)):
        own = lab == lab[i]
        if own.sum() == 1:
            sil.append(0.0)
            continue
        a = d2[i][own].sum() / (own.sum() - 1)
        b = min(d2[i][lab == c].mean() for c in set(lab) - {lab[i]})
        sil.append((b - a) / max(a, b))
    assert metrics.silhouette(df, ["x", "y"]).first()[0] == pytest.approx(np.mean(sil))
    cen = {c: pts[lab == c].mean(0) for c in set(lab)}
    s = {c: np.sqrt(((pts[lab == c] - cen[c]) ** 2).sum(1)).mean() for c in cen}
    db = np.mean([max((s[a] + s[b]) / np.linalg.norm(cen[a] - cen[b]) for b in cen if b != a) for a in cen])
    assert metrics.davies_bouldin(df, ["x", "y"]).first()[0] == pytest.approx(db)
    bt = sum((lab == c).sum() * ((cen[c] - pts.mean(0)) ** 2).sum() for c in cen)
    wi = sum(((pts[lab == c] - cen[c]) ** 2).sum() for c in cen)
    assert metrics.calinski_harabasz(df, ["x", "y"]).first()[0] == pytest.approx((bt / 2) / (wi / (len(pts) - 3)))


def test_cluster_metrics_need_two_clusters(spark):
    _, df = blobs(spark)
    one = df.where("cluster = 0")
    assert metrics.silhouette(one, ["x", "y"]).first()[0] is None
    assert metrics.davies_bouldin(one, ["x", "y"]).first()[0] is None
    assert metrics.calinski_harabasz(one, ["x", "y"]).first()[0] is None


def test_scaler_with_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert sorted((r["z_a"], r["z_b"]) for r in metrics.standardise(df, ["a", "b"]).collect()) == [(-1.0, 0.0), (1.0, 0.0)]


def test_histogram_counts_everything(spark):
    _, df = preds(spark)
    got = as_dicts(metrics.error_histogram(df, "y", "p", 3))
    assert sum(r["n"] for r in got) == 6 and max(r["barra"] for r in got) == 2


def test_intervals_are_clipped(spark):
    df = spark.createDataFrame([(0.01,), (0.5,), (0.99,)], "p double")
    got = as_dicts(metrics.with_interval(df, "p"), "p")
    assert got[0]["inferior"] == 0.0 and got[2]["superior"] == 1.0 and got[1]["inferior"] == pytest.approx(0.5 - 0.0392)


def week_ops(spark):
    rows = [{"work_order_id": "A", "ts_ini": datetime(2024, 12, 30, 8), "ts_fin": datetime(2024, 12, 30, 9)},
            {"work_order_id": "B", "ts_ini": datetime(2025, 2, 26, 8), "ts_fin": datetime(2025, 2, 26, 9), "duracion_min": 90.0},  # W9
            {"work_order_id": "C", "ts_ini": datetime(2025, 3, 5, 8), "ts_fin": datetime(2025, 3, 5, 9), "duracion_min": 90.0},  # W10
            {"work_order_id": "D", "evento": "x", "piezas_ok": 0.0, "ts_ini": datetime(2025, 3, 5, 8), "duracion_min": 30.0}]
    return ops(spark, *rows)


def test_machine_weeks_and_latest(spark):
    w = f.machine_weeks(week_ops(spark))
    got = {r["periodo"]: r for r in as_dicts(w)}
    assert set(got) == {"2025-W9", "2025-W10"}  # one hour is not over an hour
    assert got["2025-W10"]["disponibilidad"] == pytest.approx(0.75) and got["2025-W10"]["n_operaciones"] == 2
    [last] = as_dicts(f.latest_period(w))
    assert last["periodo"] == "2025-W10"


def test_machine_without_counted_pieces_has_null_scrap(spark):
    [m] = as_dicts(f.machine_features(ops(spark, {"piezas_ok": 0.0})))
    assert m["piezas_ok"] == 0.0 and m["scrap_rate"] is None and m["uph_real"] == 0.0


def test_scrap_features_group_rare_machines(spark):
    rows = [{"work_order_id": str(i), "machine_name": f"M{i % 12:02d}", "ts_fin": at(6, 9)} for i in range(30)]
    got = f.scrap_features(ops(spark, *rows))
    names = {r["machine_group"] for r in got.collect()}
    assert len(names) == 11 and "otras" in names and "M00" in names
    wide = f.align(f.with_machine_dummies(got, ["M00", "otras"]), ["machine_M00", "no_existe"])
    assert wide.columns == ["machine_M00", "no_existe"] and wide.agg({"machine_M00": "sum"}).first()[0] == 3.0


def test_splits(spark):
    rows = [(i, "a" if i % 10 else "b", datetime(2025, 1, 1 + i % 20, 0, i % 60)) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, c string, ts timestamp_ntz")
    s = f.stratified_split(df, "c", f.split_key("id"))
    assert {(r["c"], r["n"]) for r in s.where("es_test").groupBy("c").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()} == {("a", 36), ("b", 4)}
    again = f.stratified_split(df.repartition(5), "c", f.split_key("id"))
    assert {r["id"] for r in s.where("es_test").collect()} == {r["id"] for r in again.where("es_test").collect()}
    t = f.temporal_split(df, "ts", ["id"]).collect()
    assert sum(r["es_test"] for r in t) == 40
    assert max(r["ts"] for r in t if not r["es_test"]) <= min(r["ts"] for r in t if r["es_test"])
    h = f.hash_split(df, f.split_key("id")).where("es_test").count()
    assert 20 <= h <= 60


def machines(spark):
    r = random.Random(7)
    rows = [(f"M{i}", (0.8 if i % 2 else 0.3) + 0.01 * r.random(), 0.05 * (i % 2) + 0.001 * r.random(), 50.0 + i % 2 * 100 + r.random(), 100.0)
            for i in range(20)]  # two tight groups
    return spark.createDataFrame(rows, "machine_name string, disponibilidad double, scrap_rate double, uph_real double, dur_prod double")


def test_kmeans_sweep_and_assignment(spark):
    m = machines(spark)
    points = cluster.scaled_points(m)
    got = as_dicts(cluster.sweep(points, max_k=4), "k")
    costs = [r["coste"] for r in got]
    assert [r["k"] for r in got] == [2, 3, 4] and costs == sorted(costs, reverse=True)
    assert [r["k"] for r in got if r["mejor"]] == [2]
    model = cluster.fit_kmeans(points, 2, n_init=2)
    a = as_dicts(cluster.assign(model, points, cluster.stats_of(m)))
    assert len({r["cluster"] for r in a}) == 2 and all(r["distancia_al_centro"] >= 0 for r in a)
    centres = {round(r["disponibilidad"], 1) for r in as_dicts(cluster.cluster_centres(model, cluster.stats_of(m)))}
    assert centres == {0.3, 0.8}
    assert {r["cluster"] for r in cluster.fit_hierarchical(points, 2).transform(points).collect()} == {0, 1}


def test_sweep_equals_single_fits(spark):
    r = random.Random(3)
    rows = [(x + r.gauss(0, 0.2), y + r.gauss(0, 0.2)) for x, y in [(0, 0), (4, 0), (0, 5), (6, 6)] for _ in range(40)]
    rows += rows[:20]  # repeated points
    points = spark.createDataFrame(rows, "z_a double, z_b double")
    got = {x["k"]: x for x in as_dicts(cluster.sweep(points, ["a", "b"], max_k=6, n_init=5))}
    assert sorted(got) == [2, 3, 4, 5, 6] and [k for k in got if got[k]["mejor"]] == [4]
    for k, (cost, centres) in cluster.fit_sweep(points, ["z_a", "z_b"], [2, 4], n_init=5).items():
        near = [min((sum((a - b) ** 2 for a, b in zip(p, c, strict=True)), i) for i, c in enumerate(centres)) for p in rows]
        assert cost == pytest.approx(sum(d for d, _ in near)) == pytest.approx(got[k]["coste"])
        for i, c in enumerate(centres):  # a fixed point: every centre is the mean of its points
            own = [p for p, (_, j) in zip(rows, near, strict=True) if i == j]
            assert c == pytest.approx([sum(v) / len(own) for v in zip(*own, strict=True)])
        labelled = spark.createDataFrame([(*p, i) for p, (_, i) in zip(rows, near, strict=True)], "z_a double, z_b double, cluster int")
        assert got[k]["silhouette"] == pytest.approx(metrics.silhouette(labelled, ["z_a", "z_b"], noise=None).first()[0])


def test_sweep_of_few_or_equal_points(spark):
    def swept(rows):
        return as_dicts(cluster.sweep(spark.createDataFrame(rows, "z_a double"), ["a"], max_k=4, n_init=2), "k")

    assert swept([]) == [] and swept([(1.0,), (2.0,)]) == []
    same = swept([(1.0,)] * 6)
    assert [(r["k"], r["coste"], r["silhouette"], r["mejor"]) for r in same] == [(k, 0.0, None, False) for k in (2, 3, 4)]


def test_forests(spark):
    r = random.Random(9)
    rows = []
    for _ in range(120):
        a = r.random()
        rows.append((a, r.random(), "alta" if a > 0.5 else "baja", a * 2))
    df = spark.createDataFrame(rows, "a double, b double, estado string, y double")
    model = forest.fit_classifier(df, ["a", "b"], "estado", trees=10, depth=4)
    assert forest.classes(model) == ["alta", "baja"]
    p = forest.predict_state(model, df.drop("estado")).collect()
    assert all(abs(x["probabilidades"]["alta"] + x["probabilidades"]["baja"] - 1) < 1e-9 and 0.5 <= x["confianza"] <= 1 for x in p)
    reg = forest.fit_regressor(df, ["a", "b"], "y", trees=10, depth=5, leaf=1)
    ranks = as_dicts(forest.importances(reg, ["a", "b"], df))
    assert ranks[0]["feature"] == "a" and sum(x["importance"] for x in ranks) == pytest.approx(1.0)
    pred = forest.predict_regression(reg, df)
    rep = as_dicts(forest.report(pred, "y", "pred", metrics.regression_metrics(pred, "y", "pred"), forest.importances(reg, ["a", "b"], df)))
    assert {x["seccion"] for x in rep} == {"metricas", "predicciones", "importancia"}


def test_duration_model_scenarios_and_store(spark, tmp_path):
    rows = [(f"R{i % 3}", float(i), 10.0 * (i % 3) + 2 * i) for i in range(30)]
    train = spark.createDataFrame(rows, "ref_id_str string, cantidad_lanzada double, tiempo_total_min double")
    model = linear.fit_duration(train)
    known = linear.known_references(train)
    asked = spark.createDataFrame([("R1", 100.0), ("999999", 5.0)], "ref_id_str string, cantidad_lanzada double")
    got = {r["ref_id_str"]: r for r in as_dicts(linear.predict_scenarios(model, asked, known))}
    assert got["R1"]["pred_tiempo_total_min"] == pytest.approx(210.0, abs=1.0)
    assert got["999999"]["pred_tiempo_total_min"] is None and got["999999"]["error"]
    with pytest.raises(ValueError, match="999999"):
        linear.predict_scenarios(model, asked, known, strict=True)
    root = str(tmp_path)
    assert store.list_models(spark, root).count() == 0
    assert store.save_model(spark, root, "d", model, ["ref_id_str"], {"r2": 1.0}) == 1
    assert store.save_model(spark, root, "d", model, ["ref_id_str", "cantidad_lanzada"], {"r2": 0.5}) == 2
    back, names = store.load_model(spark, root, "d")
    assert names == ["ref_id_str", "cantidad_lanzada"]
    a, b = (linear.predict_duration(m, train).agg({"pred_tiempo_total_min": "sum"}).first()[0] for m in (model, back))
    assert a == pytest.approx(b)
    with pytest.raises(KeyError):
        store.load_model(spark, root, "other")


def test_stored_scaler_scores_as_before(spark, tmp_path):
    m = machines(spark)
    points = cluster.scaled_points(m)
    model = cluster.fit_kmeans(points, 2, n_init=2)
    whole = store.scaled_model(cluster.stats_of(m), f.CLUSTER_FEATURES, model, assemble=True)
    store.save_model(spark, str(tmp_path), "m", whole, f.CLUSTER_FEATURES, {})
    back, _ = store.load_model(spark, str(tmp_path), "m")
    a = {r["machine_name"]: r["cluster"] for r in model.transform(points).collect()}
    b = {r["machine_name"]: r["cluster"] for r in back.transform(m).collect()}
    assert a == b
    cols = [f"z_{c}" for c in f.CLUSTER_FEATURES]
    [d] = as_dicts(metrics.compare_clusterings(model.transform(points), back.transform(m), cols))
    assert d["silhouette_delta"] == pytest.approx(0) and d["davies_bouldin_delta"] == pytest.approx(0)
    rows = spark.createDataFrame([("x", "x", "y"), ("y", "y", "y")], "t string, a string, b string")
    [k] = as_dicts(metrics.compare_classifiers(rows, "t", "a", "b"))
    assert (k["exactitud_nuevo"], k["exactitud_guardado"], k["exactitud_delta"]) == (1.0, 0.5, 0.5)


def test_temporal_split_is_the_sorted_prefix(spark):
    r = random.Random(1)
    rows = [(i, None if r.random() < 0.05 else datetime(2024, 1, 1) + timedelta(seconds=r.choice([0, 30, 60, 3600, 86400]) * r.randint(0, 40)), r.randint(0, 3))
            for i in range(300)]
    df = spark.createDataFrame(rows, "id int, ts timestamp_ntz, t int")
    order = sorted(rows, key=lambda x: (x[1] is None, x[1] or 0, x[2], x[0]))
    for share in (0.8, 0.0, 1.0, 0.97, 0.3):
        got = {x["id"]: x["es_test"] for x in f.temporal_split(df, "ts", ["t", "id"], share).collect()}
        assert got == {x[0]: i >= int(300 * share) for i, x in enumerate(order)}
    assert f.temporal_split(df.where("false"), "ts", ["id"]).count() == 0


def test_temporal_split_ranks_rows_of_one_minute_only(spark):
    df = spark.createDataFrame([(1, datetime(2024, 1, 1))], "id int, ts timestamp_ntz")
    plan = f.temporal_split(df, "ts", ["id"])._jdf.queryExecution().analyzed().toString()
    windows = [line for line in plan.splitlines() if " Window [" in line]
    assert windows and all("[__minute" in line for line in windows)


def test_forest_leaves_are_bounded(spark):
    rows = spark.range(3000).selectExpr("cast(id as double) AS x", "rand(1) AS y")
    assert forest.leaf_rows(rows, 1) == 6 and forest.leaf_rows(rows, 50) == 50 and forest.leaf_rows(rows.limit(10), 1) == 1
    model = forest.fit_regressor(rows, ["x"], "y", trees=2, depth=forest.DEEPEST, leaf=1)
    assert all(t.numNodes <= 2 * forest.LEAVES for t in model.stages[-1].trees)


def test_savers_at_once_get_versions_of_their_own(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    points = cluster.scaled_points(machines(spark))
    model = store.scaled_model(cluster.stats_of(machines(spark)), f.CLUSTER_FEATURES, cluster.fit_kmeans(points, 2, n_init=1))
    root = str(tmp_path)
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda n: store.save_model(spark, root, "m", model, [str(n)], {}), range(4)))
    assert sorted(got) == [1, 2, 3, 4]
    stored = {r["version"]: r["features"] for r in store.list_models(spark, root).collect()}
    assert stored == {v: [str(n)] for n, v in enumerate(got)}
    assert store.save_model(spark, root, "other", model, [], {}) == 1


def test_shallow_forests_keep_no_node_ids(spark):
    """Node ids take four bytes a row and tree, in several copies; only deep trees are worth them."""
    df = spark.createDataFrame([(float(i % 7), float(i % 3)) for i in range(60)], "a double, y double")
    kept = {depth: forest.fit_regressor(df, ["a"], "y", trees=2, depth=depth).stages[-1].getOrDefault("cacheNodeIds") for depth in (10, 30)}
    assert kept == {10: False, 30: True}


def test_sweep_rounds_make_no_row_per_point_and_model(spark):
    points = spark.createDataFrame([(0.0, 1.0), (2.0, 1.0), (1.0, 3.0), (9.0, 9.0)], "a double, b double")
    models = {(2, 0): [[0.0, 0.0], [2.0, 0.0]], (2, 1): [[8.0, 8.0], [8.0, 8.0]]}  # ties go to the first centre
    moves = cluster._moves(points, ["a", "b"], models)
    got = {(r["seed"], r["c"]): (r["m0"], r["m1"]) for r in moves.collect()}
    assert got == {(0, 0): (0.5, 2.0), (0, 1): (5.5, 5.0), (1, 0): (3.0, 3.5)}
    assert "Generate" not in moves._jdf.queryExecution().optimizedPlan().toString()
