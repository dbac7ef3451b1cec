from __future__ import annotations

from datetime import datetime

import pytest
from frames import as_dicts, at, ops

from forja.functions import scalar as x
from forja.plans import routes as p
from forja.plans import tooling as t
from forja.sources import files

HEAD = "work_order_id string, ref_id_str string, qty_plan long, fecha_lanzamiento timestamp_ntz, due_date date"


def header(spark, *rows):
    return spark.createDataFrame([(o, "000001", q, None, None) for o, q in rows], HEAD)


def route(spark, plan=100):
    rows = [
        {"op_id": "CURV10", "ts_ini": at(6, 8), "piezas_scrap": 5.0, "duracion_min": 10.0},
        {"op_id": "TALL20", "ts_ini": at(6, 9), "piezas_scrap": 3.0, "duracion_min": 20.0},
        {"op_id": "CURV10", "ts_ini": at(6, 10), "piezas_scrap": 2.0, "duracion_min": 5.0},
        {"op_id": "RECT60", "ts_ini": None, "ts_fin": None, "piezas_scrap": 200.0, "duracion_min": 1.0},
        {"op_id": "CURV10", "ts_ini": at(6, 7), "evento": "Incidencia", "tipo_incidencia": "AVERIA", "duracion_min": 7.0},
    ]
    return ops(spark, *rows), header(spark, ("A", plan))


def test_route_sorts_missing_times_last(spark):
    o, _ = route(spark)
    [r] = as_dicts(p.order_routes(o))
    assert r["ruta_fases"] == "CURV10 -> CURV10 -> TALL20 -> CURV10 -> RECT60"
    assert (r["fase_inicio"], r["fase_fin"], r["n_ops"], r["dur_total_min"]) == ("CURV10", "RECT60", 5, 43.0)


def test_flow_orders_by_last_and_lists_by_first_appearance(spark):
    o, h = route(spark)
    [r] = as_dicts(p.order_flow(o, h))
    assert r["fases_unicas"] == ["CURV10", "TALL20", "RECT60"]
    steps = [s["fase"] for s in as_dicts(p.route_steps(o, incidents=False), "paso")]
    assert steps == ["CURV10", "TALL20", "CURV10", "RECT60"]
    flow = [(f["fase"], f["entrada_estimada"], f["salida_estimada"], f["piezas_scrap"]) for f in r["flow_por_fase"]]
    assert flow == [("TALL20", 100.0, 97.0, 3.0), ("CURV10", 97.0, 90.0, 7.0), ("RECT60", 90.0, 0.0, 200.0)]
    assert (r["piezas_ok_total"], r["incidencias_duracion_total"], r["n_ops"]) == (0.0, 7.0, 4)
    assert r["primera_fase_ts"] == at(6, 8)


def test_missing_plan_launches_all_counted_pieces(spark):
    o, h = route(spark, None)
    [r] = as_dicts(p.order_flow(o, h))
    assert r["piezas_lanzadas"] == 40.0 + 210.0


def test_orders_without_header_or_other_start_are_left_out(spark):
    o = ops(spark, {"op_id": "CURV1", "work_order_id": "X"}, {"op_id": "TALL20", "work_order_id": "A"}, {"op_id": "curv9", "work_order_id": "B"})
    got = as_dicts(p.order_flow(o, header(spark, ("A", 1), ("B", 1))))
    assert [r["work_order_id"] for r in got] == ["B"]


def test_pieces_per_order_and_null_orders(spark):
    o = ops(spark, {"op_id": "B", "ts_ini": at(6, 9)}, {"op_id": "A", "ts_ini": at(6, 8)}, {"op_id": "B", "ts_ini": at(6, 7)}, {"work_order_id": None})
    [r] = as_dicts(p.order_pieces(o))
    assert (r["fases_unicas"], r["n_fases"], r["piezas_lanzadas"]) == ("B -> A", 2, 30.0)


def test_life_document_round_trip(spark, tmp_path):
    o, h = route(spark)
    flow = p.order_flow(o, h)
    p.export_order_life(flow, str(tmp_path / "vida"))
    back = files.read_order_life(spark, str(tmp_path / "vida"))
    assert as_dicts(back) == as_dicts(p.order_life(flow))
    assert [x["op"] for x in back.first()["operaciones"]] == ["CURV10", "TALL20", "RECT60"]


def test_model_table(spark):
    o, h = route(spark)
    life = p.order_life(p.order_flow(o, h))
    [r] = as_dicts(p.model_table(life, ["CURV10", "TALL20", "SOLD40"]))
    assert r["op"] == "CURV10 > TALL20 > RECT60" and r["ops_count"] == 3
    assert r["dur_min_curv10"] == 15.0 and r["dur_min_curv10_por_ud"] == pytest.approx(0.15)
    assert r["dur_min_sold40"] is None and r["scrap_tall20"] == 3.0
    assert "y_fabricacion_min" in r and r["scrap_rate"] == 1.0
    assert r["dur_min_otras"] == 1.0 and r["scrap_otras"] == 200.0  # RECT60 is not listed
    [w] = as_dicts(p.model_table(life))
    assert w["dur_min_rect60"] == 1.0 and w["dur_min_otras"] is None
    assert sum(v or 0 for k, v in w.items() if k.startswith("dur_min_") and not k.endswith("por_ud")) == w["duracion_ops_min"] == 36.0
    assert "Exchange" not in p.model_table(spark.createDataFrame(life.collect(), life.schema), ["CURV10"])._jdf.queryExecution().toString()


def test_slug():
    assert x.slug_text("Control final") == "control_final"
    assert x.slug_text("__Producción 2!") == "producci_n_2"


def test_expand_and_lookup(spark):
    o, _ = route(spark)
    [r] = as_dicts(p.expand_steps(o, 5))
    assert [r[f"OP{i}"] for i in range(1, 6)] == ["CURV10", "TALL20", "CURV10", "RECT60", None] and (r["n_pasos"], r["ultima"]) == (4, "RECT60")
    assert [s["fase"] for s in as_dicts(p.lookup_steps(o, "A"), "paso")] == ["CURV10", "CURV10", "TALL20", "CURV10", "RECT60"]
    [t] = as_dicts(p.lookup_totals(o, "A"))
    assert t["fases"] == ["CURV10", "TALL20", "RECT60"] and (t["fase_inicio"], t["fase_fin"], t["n_ops"]) == ("CURV10", "RECT60", 5)
    [n] = as_dicts(p.start_end_counts(o))
    assert (n["fase_inicio"], n["fase_fin"], n["n"]) == ("CURV10", "RECT60", 1)
    assert {x["fase"] for x in as_dicts(p.lookup_order(o, "A"))} == {"CURV10", "TALL20", "RECT60"}
    assert p.lookup_order(o, "none").count() == 0


def cut(day, hour, ok, change=False, machine="m1", minutes=10):
    fin = datetime(2025, 1, day, hour, minutes)
    return {"machine_id": machine, "machine_name": machine.upper(), "ts_ini": at(day, hour), "ts_fin": fin, "piezas_ok": ok,
            "tipo_incidencia": "CAMBIO DE FRESA" if change else None}


def test_tool_change_cycles(spark):
    rows = [cut(6, 8, 5.0), cut(6, 9, 7.0), cut(6, 10, 0.0, True), cut(8, 8, 4.0), cut(9, 8, 1.0, True), cut(9, 9, 3.0),
            cut(6, 8, 2.0, machine="m2"), cut(7, 8, 0.0, True, machine="m2"), {**cut(6, 9, 99.0), "op_id": "CURV10"}]
    got = as_dicts(t.tool_changes(ops(spark, *rows)), "machine_id", "ts_cambio")
    assert [(r["machine_id"], r["piezas_hasta_cambio"], r["ops_hasta_cambio"], r["duracion_cambio_min"]) for r in got] == [
        ("m1", 12.0, 3, 10.0), ("m1", 5.0, 2, 10.0), ("m2", 2.0, 2, 10.0)]
    nxt = as_dicts(t.next_change(t.tool_changes(ops(spark, *rows))))
    assert [(r["machine_id"], r["minutes_to_next_change"]) for r in nxt] == [("m1", 70 * 60.0)]


def test_tool_changes_repeat_equal_rows_and_order_work_first(spark):
    rows = [cut(6, 8, 1.0, True), cut(6, 8, 1.0, True), cut(6, 8, 4.0), cut(6, 8, 4.0)]
    got = as_dicts(t.tool_changes(ops(spark, *rows)), "ops_hasta_cambio")
    assert [(r["piezas_hasta_cambio"], r["ops_hasta_cambio"]) for r in got] == [(1.0, 1), (9.0, 3)]


def test_operations_as_columns_are_bounded(spark, monkeypatch):
    schema = "work_order_id string, cantidad_lanzada double, operaciones array<struct<op string, duracion_min double, piezas_scrap double>>"
    life = spark.createDataFrame([("A", 4.0, [("X", 1.0, 0.0), ("Y", 3.0, None), ("X", 1.0, 2.0), (None, 9.0, 9.0)]), ("B", 0.0, [("Z", 1.0, 1.0)]),
                                  ("C", 1.0, []), ("D", 1.0, None)], schema)
    assert p.operations_of(life) == ["X", "Y", "Z"]
    monkeypatch.setattr(p, "MOST_OPERATIONS", 2)
    with pytest.raises(ValueError, match="operation_totals"):
        p.op_pivots(life)
    assert sorted(map(tuple, p.operation_totals(life).collect())) == [
        ("A", "X", 2.0, 2.0, 0.5), ("A", "Y", 3.0, None, 0.75), ("B", "Z", 1.0, 1.0, None)]
