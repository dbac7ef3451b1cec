from __future__ import annotations

from datetime import date, datetime

import pytest
from frames import as_dicts, ops
from pyspark.sql import functions as F

from forja.plans import fact as pf
from forja.plans import quality as q
from forja.plans import reports as r
from forja.sources import conform, files


def write(tmp_path, name, text):
    f = tmp_path / name
    f.write_text(text, encoding="utf-8")
    return str(f)


def test_references(spark, tmp_path):
    path = write(tmp_path, "refs.csv", "ref_id,familia,peso_neto_kg\n0042,F1,1.5\n123456789,,\n")
    assert as_dicts(files.read_refs(spark, path), "ref_id") == [
        {"ref_id": "0042", "familia": "F1", "peso_neto_kg": 1.5, "ref_id_str": "000042"},
        {"ref_id": "123456789", "familia": None, "peso_neto_kg": None, "ref_id_str": "123456789"}]


def test_rates_file_variants(spark, tmp_path):
    refs = conform.conform_refs(spark.createDataFrame([("7", None, 1.0)], "ref_id string, familia string, peso_neto_kg double"))
    full = write(tmp_path, "a.csv", "ref_id,ref_id_str,machine_name,piezas_hora_teorico\n12.0,12.0,M1,60\n081GJ1,081GJ1,M1,30\n")
    got = {(x["ref_id_str"], x["machine_name"]): x["piezas_hora_teorico"] for x in files.read_rates(spark, full, refs).collect()}
    assert got == {("000012", "M1"): 60.0, ("081GJ1", "M1"): 30.0}
    seconds = write(tmp_path, "b.csv", "ref_id,ciclo_teorico_seg\n12,36\n13,0\n")
    got = {x["ref_id_str"]: (x["machine_name"], x["piezas_hora_teorico"]) for x in files.read_rates(spark, seconds, refs).collect()}
    assert got == {"000012": ("", 100.0), "000013": ("", 0.0)}
    bare = write(tmp_path, "c.csv", "ref_id\n12\n")
    assert as_dicts(files.read_rates(spark, bare, refs)) == [{"ref_id_str": "000012", "machine_name": "", "piezas_hora_teorico": 0.0}]
    missing = files.read_rates(spark, str(tmp_path / "none.csv"), refs)
    assert as_dicts(missing) == [{"ref_id_str": "000007", "machine_name": "", "piezas_hora_teorico": 0.0}]
    made = ops(spark, {}, {"machine_name": "M2"}, {"machine_name": None})
    assert as_dicts(conform.fallback_rates(missing, made), "machine_name") == [
        {"ref_id_str": "000001", "machine_name": m, "piezas_hora_teorico": 0.0} for m in ("M1", "M2")]
    named = files.read_rates(spark, full, refs)
    assert sorted(map(tuple, conform.fallback_rates(named, made).collect())) == sorted(map(tuple, named.collect()))


def test_orders_with_pending_dates(spark, tmp_path):
    path = write(tmp_path, "o.csv", "work_order_id,ref_id,familia,cliente,qty_plan,fecha_lanzamiento,due_date,planta_inicio\n"
                                    "24/0001,55,PENDING,C,10,2025-01-02,PENDING,PENDING\n")
    [o] = as_dicts(files.read_orders(spark, path))
    assert o["due_date"] is None and o["fecha_lanzamiento"] == datetime(2025, 1, 2) and o["familia_of"] == "PENDING" and o["ref_id_str"] == "000055"


def test_labour_header_with_spaces(spark, tmp_path):
    path = write(tmp_path, "r.csv", "año_mes, horas_teoricas, reduccion_tco, horas_ajustadas, horas_enfermedad, horas_accidente, horas_permiso, horas_netas\n"
                                    "2025-04, 100, 10, 95, 5, 1, 4, 80\n2025-05, 0, 0, 0, 0, 0, 0, 0\n")
    df = files.read_labour(spark, path)
    assert [x["año_mes"] for x in as_dicts(df, "año_mes")] == [date(2025, 4, 1), date(2025, 5, 1)]
    [t] = as_dicts(r.labour_totals(df))
    assert t["tasa_absentismo"] == pytest.approx(10 / 95) and t["tasa_disponibilidad"] == pytest.approx(0.8)
    net = [x["horas"] for x in as_dicts(r.hours_waterfall(df), "paso")]
    assert net == [100, -10, -5, -1, -4, 80]
    months = as_dicts(r.labour_by_month(df, ops(spark, {"ts_ini": datetime(2025, 4, 3), "duracion_min": 120.0})), "año_mes")
    assert [(m["productividad"], m["pct_uso"], m["horas_gap"]) for m in months] == [(10 / 80, 2 / 80, 78.0), (0.0, 0.0, 0.0)]


def test_purchases_with_quoted_commas(spark, tmp_path):
    path = write(tmp_path, "c.csv", 'material_lot_id,laminado_id,ref_materia,qty_recibida,udm,peso_bruto,uds,fecha_recepcion_ts\n'
                                    'L1,"a, b",918506/118506,10.5,kg,11,1,2025-01-02 10:00:00\nL1,x,77,,kg,1,1,2025-01-03 10:00:00\n')
    df = files.read_purchases(spark, path)
    got = as_dicts(df, "ref_materia")
    assert [g["ref_materia_str"] for g in got] == ["000077", "918506/118506"] and got[1]["laminado_id"] == "a, b"
    [k] = as_dicts(r.purchase_kpis(df))
    assert (k["kg_recibidos"], k["lotes"], k["lote_medio_kg"]) == (10.5, 1, 10.5)


def test_operations_keep_zeros_and_survive_bad_cells(spark, tmp_path):
    path = write(tmp_path, "p.csv", "work_order_id,ref_id,op_id,machine_name,evento,ts_ini,ts_fin,duracion_min,piezas_ok,piezas_scrap\n"
                                    "0012,007,TALL20,M1,Producción,2025-01-06 08:00:00,mal,,5,x\n")
    [o] = as_dicts(conform.conform_ops(files.read_operations(spark, path)))
    assert (o["work_order_id"], o["ref_id_str"], o["ts_fin"], o["duracion_min"], o["piezas_ok"], o["piezas_scrap"]) == ("0012", "000007", None, 0.0, 5.0, 0.0)


def test_csv_and_table_sinks(spark, tmp_path):
    df = ops(spark, {}, {"work_order_id": "B"}).select("work_order_id", "fecha", "piezas_ok")
    files.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2
    files.write_table(df.withColumn("mes", F.trunc("fecha", "MM")), str(tmp_path / "t"), ["mes"])
    assert spark.read.parquet(str(tmp_path / "t")).where("mes = '2025-01-01'").count() == 2


def test_date_range_ends_at_last_whole_second(spark):
    df = ops(spark, {"ts_ini": datetime(2025, 1, 6)}, {"ts_ini": datetime(2025, 1, 7, 23, 59, 59)},
             {"ts_ini": datetime(2025, 1, 7, 23, 59, 59, 500000)}, {"ts_ini": None})
    assert pf.filter_ops(df, pf.Filters(date(2025, 1, 6), date(2025, 1, 7))).count() == 2


def test_date_range_ignores_the_session_time_zone(spark):
    df = ops(spark, {"ts_ini": datetime(2025, 1, 6)}, {"ts_ini": datetime(2025, 1, 6, 23, 59)})
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        n = pf.filter_ops(df, pf.Filters(date(2025, 1, 6), date(2025, 1, 6))).count()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert n == 2


def test_plant_filter_empties_pending_orders(spark):
    o = spark.createDataFrame([(datetime(2025, 1, 6), "PENDING")], "fecha_lanzamiento timestamp_ntz, planta_inicio string")
    assert pf.filter_orders(o, pf.Filters(date(2025, 1, 1), date(2025, 2, 1), ("P",))).count() == 0
    assert pf.filter_orders(o, pf.Filters(date(2025, 1, 1), date(2025, 2, 1))).count() == 1


def test_week_presets_run_sunday_to_friday(spark):
    b = spark.createDataFrame([(date(2025, 1, 8), date(2025, 1, 20))], "fecha_min date, fecha_max date")
    got = as_dicts(pf.week_presets(b), "n")
    assert [(g["inicio"], g["fin"]) for g in got] == [
        (date(2025, 1, 5), date(2025, 1, 10)), (date(2025, 1, 12), date(2025, 1, 17)), (date(2025, 1, 19), date(2025, 1, 20))]
    assert got[2]["etiqueta"] == "Semana 3 (2025-01-19 a 2025-01-24)"


def test_clamp():
    f = pf.Filters(date(2020, 1, 1), date(2030, 1, 1)).clamp(date(2025, 1, 1), date(2025, 2, 1))
    assert (f.start, f.end) == (date(2025, 1, 1), date(2025, 2, 1))


def test_views_are_queryable(spark):
    pf.Tables(produccion=ops(spark, {})).as_views()
    assert spark.sql("SELECT sum(piezas_ok) AS s FROM produccion").first()["s"] == 10.0


def test_audits(spark):
    df = ops(spark, {}, {}, {"piezas_ok": -1.0, "op_id": None})
    nulls = {n["columna"]: n["faltantes"] for n in q.null_profile(df.select("op_id", "op_text", "piezas_ok")).collect()}
    assert nulls == {"op_id": 1, "op_text": 3}
    assert as_dicts(q.duplicate_count(df)) == [{"filas": 3, "duplicadas": 1}]
    [a] = as_dicts(q.range_audit(df, ["piezas_ok"]))
    assert (a["minimo"], a["negativos"], a["ceros"]) == (-1.0, 1, 0)
    assert q.clean(df.drop("ref_id_str")).count() == 1


def test_accented_minutes_only_in_production_kpis(spark):
    df = ops(spark, {"evento": "PRODUCCION"}, {"work_order_id": "B", "evento": "PRODUCCIÓN", "piezas_ok": 5.0}).withColumn("peso_neto_kg", F.lit(2.0))
    [k] = as_dicts(r.production_kpis(df))
    assert k["min_produccion"] == 60.0 and k["kg_ok"] == 30.0 and k["ordenes_activas"] == 2


def test_order_documents_with_errors(spark, tmp_path):
    good = '{"work_order_id":"A","cantidad_lanzada":5,"operaciones":[{"op":"CURV10","piezas_scrap":1}],"extra":[1]}'
    lines = [good, good[:-1], good.replace('"cantidad_lanzada":5', '"cantidad_lanzada":"many"'), good.replace('"A"', '" "'),
             '{"work_order_id":"B","operaciones":[]}', '{"work_order_id":"C"}', "no json", "[]", "{}"]
    write(tmp_path, "vida.json", "\n".join(lines) + "\n\n")
    got = files.scan_order_life(spark, str(tmp_path / "vida.json"), str(tmp_path / "out"))
    assert sorted((r["motivo"] or "", r["work_order_id"] or "", r["registro"] is not None) for r in got.collect()) == sorted([
        ("", "A", False), ("ilegible", "", True), ("tipo", "A", True), ("sin_of", " ", False), ("sin_operaciones", "B", False),
        ("sin_operaciones", "C", False), ("ilegible", "", True), ("sin_of", "", False)])
    [sound] = files.sound_order_life(got).collect()
    assert (sound["cantidad_lanzada"], sound["operaciones"][0]["op"]) == (5.0, "CURV10")
    bad = files.quarantine(got)
    assert bad.count() == 7 and all(r["archivo"].endswith("vida.json") for r in bad.collect())
    typed = bad.where("motivo = 'tipo'").first()
    assert typed["cantidad_lanzada"] is None and typed["operaciones"][0]["op"] == "CURV10" and "many" in typed["registro"]


def test_order_documents_as_one_array(spark, tmp_path):
    one = '{"work_order_id":"%s",\n "operaciones":[{"op":"X"}]}'
    (tmp_path / "in").mkdir()
    write(tmp_path / "in", "a.json", "[" + ",".join(one % n for n in "AB") + "]")
    write(tmp_path / "in", "b.json", "[" + one % "C" + ", {]")
    write(tmp_path / "in", "c.json", "")
    got = files.scan_order_life(spark, str(tmp_path / "in"), str(tmp_path / "out"), multiline=True)
    assert {r["work_order_id"] for r in files.sound_order_life(got).collect()} == {"A", "B"}
    assert [(r["motivo"], r["archivo"][-6:]) for r in got.where("motivo IS NOT NULL").collect()] == [("ilegible", "b.json")]
