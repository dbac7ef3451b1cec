"""Scrap features and mean predictions over stored tables."""

from __future__ import annotations

import pytest
from frames import as_dicts
from test_inputs import TABLES

from forja.catalog import dirty_queries, feature_queries, inputs
from forja.ml import metrics
from forja.plans import features as f


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    for name, (schema, rows) in TABLES.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{at}/{name}.parquet")
    return str(at)


def test_mean_predictions_shuffle_no_operation(spark, sf):
    """Means are read from stored tables; while they are few, every join with them is a broadcast."""
    base = feature_queries.baseline(spark, sf)
    got = {(r["machine_name"], r["ref_id_str"]): (r["scrap_rate"], r["pred"], r["pred2"]) for r in base.collect()}
    rate = 10 / 50
    assert got == {("M00000001", "000001"): (0.1, pytest.approx((0.1 + rate) / 2), pytest.approx(0.05)),
                   ("M00000002", "000001"): (0.0, 0.0, pytest.approx(0.05)), ("M00000001", "000002"): (rate, pytest.approx((0.1 + rate) / 2), rate)}
    plan = base._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_scrap_features_shuffle_no_operation(spark, sf):
    stored = feature_queries.features(spark, sf)
    assert "hashpartitioning" not in stored._jdf.queryExecution().executedPlan().toString()
    keys = ("work_order_id", "machine_name")
    assert as_dicts(stored, *keys) == as_dicts(f.scrap_features(inputs.ops(spark, sf)), *keys)


def test_rows_without_a_reference_share_a_stored_frequency(spark):
    ops = spark.createDataFrame([("M1", None), ("M1", None), ("M2", "A"), (None, "A"), ("M2", "B")], "machine_name string, ref_id_str string").selectExpr(
        "*", "'o' AS work_order_id", "timestamp_ntz'2024-03-05 06:00:00' AS ts_ini", "'p' AS op_id", "1D AS duracion_min", "1D AS piezas_scrap", "4D AS total_piezas",
        "'produccion' AS estado")
    with_stored = f.scrap_features(ops, freq=f.reference_frequency(ops), top=f.machine_groups(ops, 1))
    assert sorted((str(r["ref_id_str"]), r["ref_frequency"]) for r in with_stored.collect()) == [("A", 2), ("A", 2), ("B", 1), ("None", 2), ("None", 2)]


def test_models_are_compared_in_one_pass(spark):
    df = spark.createDataFrame([(0.0, 1.0, 0.5), (2.0, None, 2.0), (4.0, 5.0, None), (None, 1.0, 1.0), (8.0, 8.0, 7.0)], "y double, a double, b double")
    [got] = as_dicts(metrics.compare_models(df, "y", "a", "b"))
    for side, pred in (("nuevo", "a"), ("guardado", "b")):
        [m] = as_dicts(metrics.regression_metrics(df, "y", pred))
        assert {c: got[f"{c}_{side}"] for c in ("mae", "rmse", "r2")} == pytest.approx({c: m[c] for c in ("mae", "rmse", "r2")})
    plan = metrics.compare_models(df, "y", "a", "b")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate") == 1


def test_cycles_of_unclean_operations_are_derived_once(spark, sf):
    """A filter on the cycle derives no column again: the quantiles read what was stored."""
    plan = dirty_queries.a2(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "regexp_replace" not in plan and "ciclo" in plan
