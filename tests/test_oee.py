from __future__ import annotations

import pytest
from frames import as_dicts, at, ops, rates
from pyspark.sql import functions as F

from forja.operators.lastop import last_valid_ops
from forja.plans import fact as pf
from forja.plans import oee as p
from forja.sources import conform

NO_RATES = ()


def record(spark, rows, rate_rows=NO_RATES, by=()):
    return as_dicts(p.oee(ops(spark, *rows), rates(spark, *rate_rows), by), *by)


def test_last_valid_operation(spark):
    df = ops(
        spark,
        {"ts_fin": at(6, 9), "piezas_ok": 1.0},
        {"ts_fin": None, "ts_ini": at(1), "piezas_ok": 2.0},  # missing end is the latest
        {"ts_fin": at(7, 9), "piezas_ok": 0.0},  # no pieces: skipped
        {"work_order_id": "B", "ts_fin": at(6, 9), "ts_ini": at(6, 7), "piezas_ok": 3.0},
        {"work_order_id": "B", "ts_fin": at(6, 9), "ts_ini": at(6, 8), "piezas_ok": 4.0},  # tie: later start
        {"work_order_id": None, "piezas_ok": 9.0},
    )
    got = {r["work_order_id"]: r["piezas_ok"] for r in last_valid_ops(df).collect()}
    assert got == {"A": 2.0, "B": 4.0}


def test_minutes_from_all_operations_pieces_from_the_last(spark):
    rows = [{"ts_fin": at(6, 9), "duracion_min": 30.0, "piezas_ok": 100.0},
            {"ts_fin": at(6, 10), "duracion_min": 30.0, "piezas_ok": 90.0, "piezas_scrap": 10.0},
            {"evento": None, "duracion_min": 40.0, "piezas_ok": 0.0}]
    [r] = record(spark, rows, [("000001", "M1", 120.0)])
    assert (r["min_produccion"], r["min_incidencia"]) == (60.0, 40.0)
    assert (r["total_ok"], r["total_scrap"], r["total_piezas"]) == (90, 10, 100)
    assert r["ideal_output"] == pytest.approx(120.0)
    assert r["availability"] == pytest.approx(0.6)
    assert r["performance"] == pytest.approx(100 / 120)
    assert r["quality"] == pytest.approx(0.9)
    assert r["oee"] == pytest.approx(0.6 * 100 / 120 * 0.9)


def test_cascade(spark):
    """Listed rate, p25 of the pair, and the median of medians for the rest."""
    rows = [{"work_order_id": f"A{i}", "duracion_min": m, "piezas_ok": 60.0} for i, m in enumerate([10.0, 20.0, 30.0, 40.0, 50.0])]
    rows += [{"work_order_id": "B", "machine_name": "M2", "duracion_min": 30.0, "piezas_ok": 60.0},
             {"work_order_id": "C", "machine_name": "M3", "duracion_min": 0.5, "piezas_ok": 60.0},  # 0.5 s: no history
             {"work_order_id": "D", "machine_name": "M4", "duracion_min": 700.0, "piezas_ok": 60.0}]  # 700 s: no history
    t = {r["machine_name"]: r["ciclo_objetivo_s"] for r in p.targets(ops(spark, *rows), rates(spark, ("000001", "M2", 100.0), ("000001", "M4", 0.0))).collect()}
    assert t["M1"] == pytest.approx(20.0)
    assert t["M2"] == pytest.approx(36.0)
    assert t["M3"] == pytest.approx(30.0)  # medians: M1 30, M2 30
    assert t["M4"] == pytest.approx(30.0)


def test_no_history_at_all_leaves_performance_null(spark):
    [r] = record(spark, [{"duracion_min": 700.0, "piezas_ok": 1.0}])
    assert r["ideal_output"] == 0 and r["performance"] is None and r["oee"] is None
    assert r["total_piezas"] == 0  # nothing with a target


def test_no_history_but_a_listed_rate(spark):
    rows = [{"work_order_id": "A", "duracion_min": 700.0, "piezas_ok": 1.0},
            {"work_order_id": "A", "machine_name": "M2", "duracion_min": 700.0, "piezas_ok": 2.0, "ts_fin": at(1)}]
    [r] = record(spark, rows, [("000001", "M2", 60.0)])
    assert r["total_ok"] == 2 and r["ideal_output"] == pytest.approx(700.0)


def test_group_has_its_own_benchmarks_and_last_operations(spark):
    rows = [{"ts_ini": at(6), "ts_fin": at(6, 9), "duracion_min": 10.0, "piezas_ok": 60.0},
            {"ts_ini": at(7), "ts_fin": at(7, 9), "duracion_min": 20.0, "piezas_ok": 60.0}]
    days = record(spark, rows, by=["fecha"])
    assert [d["total_ok"] for d in days] == [60, 60]  # the order counts on both days
    assert [d["performance"] for d in days] == [pytest.approx(1.0), pytest.approx(1.0)]
    [whole] = record(spark, rows)
    assert whole["total_ok"] == 60
    assert whole["ideal_output"] == pytest.approx(30 * 60 / 12.5)  # p25 of 10 s and 20 s is 12.5 s


def test_group_of_one_value_equals_no_group(spark):
    rows = [{"work_order_id": str(i % 3), "duracion_min": 5.0 + i, "piezas_ok": 10.0 + i, "ts_fin": at(6, 9, i)} for i in range(12)]
    [a] = record(spark, rows)
    [b] = record(spark, rows, by=["planta"])
    assert {k: v for k, v in b.items() if k != "planta"} == pytest.approx(a)


def test_plans_are_built_without_running_anything(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    o, r = ops(spark, {}), rates(spark, *NO_RATES)

    def ran(*_):
        raise AssertionError("a job ran while the plan was built")

    for name in ("first", "collect", "count", "head", "take", "toPandas"):
        monkeypatch.setattr(DataFrame, name, ran)
    for by in ([], ["fecha"], ["turno"], ["machine_name"]):
        p.oee(o, r, by)


def test_empty_input(spark):
    [r] = as_dicts(p.oee(ops(spark, {}).limit(0), rates(spark, *NO_RATES)))
    assert r["total_piezas"] == 0 and r["oee"] is None and r["min_produccion"] == 0


def test_shift_report_leaves_out_unknown(spark):
    rows = [{"ts_ini": at(6, 8)}, {"work_order_id": "B", "ts_ini": None}]
    got = as_dicts(p.oee_by_shift(ops(spark, *rows), rates(spark, *NO_RATES)))
    assert [r["turno"] for r in got] == ["mañana"]


def test_duplicate_dimensions_do_not_multiply_facts(spark):
    o = ops(spark, {"ref_id": "1.0"}, {"work_order_id": "B", "ref_id": "1"})
    raw_rates = spark.createDataFrame([("1.0", "M1", 60.0), ("000001", "M1", 90.0)], "ref_id string, machine_name string, piezas_hora_teorico double")
    r = conform.conform_rates(raw_rates)
    assert as_dicts(r) == [{"ref_id_str": "000001", "machine_name": "M1", "piezas_hora_teorico": 90.0}]
    assert p.with_rate(o, r).count() == 2
    orders = conform.conform_orders(spark.createDataFrame(
        [("A", "1", "F", "c1", 5, "2025-01-01", "PENDING", "PENDING"), ("A", "1", "F", "c2", 7, "2025-01-01", "PENDING", "PENDING")],
        "work_order_id string, ref_id string, familia string, cliente string, qty_plan long, fecha_lanzamiento string, due_date string, planta_inicio string"))
    refs = conform.conform_refs(spark.createDataFrame([("1", None, 2.0), ("1", None, 2.0)], "ref_id string, familia string, peso_neto_kg double"))
    f = pf.production_fact(o, refs, orders)
    assert f.count() == 2
    a = f.where("work_order_id = 'A'").first()
    assert (a["qty_plan"], a["familia"], a["cliente"]) == (7, "F", "c2")


def test_rows_in_any_order_and_partitioning(spark):
    rows = [{"work_order_id": str(i % 4), "duracion_min": 3.0 + i, "piezas_ok": 5.0 + i, "ts_fin": at(6, 9, i % 2)} for i in range(20)]
    df = ops(spark, *rows)
    a = p.oee(df, rates(spark, *NO_RATES)).first()
    b = p.oee(df.repartition(7, F.rand(1)), rates(spark, *NO_RATES)).first()
    assert a.asDict() == pytest.approx(b.asDict())


def test_pareto_shares_are_of_the_top(spark):
    rows = [{"evento": "Incidencia", "tipo_incidencia": f"T{i:02d}", "duracion_min": 12.0 - i} for i in range(12)]
    got = as_dicts(p.incident_pareto(ops(spark, *rows)), "tipo_incidencia")
    assert len(got) == 10 and got[-1]["pct_acum"] == pytest.approx(100.0)


def test_hot_keys_give_the_same_record(spark, monkeypatch):
    from forja.operators import ordered

    rows = [{"work_order_id": f"O{i % 7}", "machine_name": f"M{i % 3}" if i % 11 else None, "ref_id": str(i % 2), "ts_ini": at(6 + i % 3, i % 24),
             "ts_fin": at(10, i % 24, i % 60), "duracion_min": float(i % 17), "piezas_ok": float(i % 13 * 5), "evento": None if i % 5 == 0 else "Producción"}
            for i in range(120)]
    rows += [{"ts_ini": at(20), "duracion_min": 0.0, "work_order_id": f"N{i}", "machine_name": f"M{i}"} for i in range(2)]  # a day without history
    listed = [("000001", "M1", 120.0)]

    def all_of():
        return [[{k: round(v, 9) if isinstance(v, float) else v for k, v in r.items()} for r in record(spark, rows, listed, by)]
                for by in ((), ("fecha",), ("machine_name",))]

    light = all_of()
    day = [r for r in light[1] if r["fecha"].day == 20]
    assert [(r["total_ok"], r["ideal_output"], r["uph_teorico"]) for r in day] == [(10, 0.0, 120.0)]
    monkeypatch.setattr(ordered, "PART_ROWS", 0)
    assert all_of() == light
