from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from forja.functions import scalar as x


def one(spark, expr, **cols):
    names = list(cols)
    types = ", ".join(f"{n} {t}" for n, (t, _) in cols.items())
    return spark.createDataFrame([tuple(v for _, v in cols.values())], types).select(expr.alias("r")).first()["r"]


@pytest.mark.parametrize("raw, want", [("7", "000007"), ("123.0", "000123"), ("081GJ1", "081GJ1"), ("123456789", "123456789"),
                                       ("10.05", "010.05"), (None, None), ("1234567.0", "1234567")])
def test_norm_ref_pads_but_never_cuts(spark, raw, want):
    assert one(spark, x.norm_ref("c"), c=("string", raw)) == want


@pytest.mark.parametrize("event, want", [("Producción", "produccion"), ("PRODUCCION", "produccion"), ("PREPARACIÓN", "preparacion"),
                                         ("preparacion", "preparacion"), ("Averia", "incidencia"), (None, "incidencia")])
def test_state(spark, event, want):
    assert one(spark, x.state_of("c"), c=("string", event)) == want


@pytest.mark.parametrize("hour, want", [(5, "noche"), (6, "mañana"), (13, "mañana"), (14, "tarde"), (21, "tarde"), (22, "noche")])
def test_shift_edges(spark, hour, want):
    assert one(spark, x.shift_of("c"), c=("timestamp_ntz", datetime(2025, 1, 1, hour, 59))) == want


def test_shift_of_null(spark):
    assert one(spark, x.shift_of("c"), c=("timestamp_ntz", None)) == "desconocido"


def test_week_label_keeps_calendar_year(spark):
    assert one(spark, x.iso_week_label("c"), c=("timestamp_ntz", datetime(2024, 12, 30))) == "2024-W1"


def test_ratios(spark):
    assert one(spark, x.ratio(F.col("a"), F.col("b")), a=("double", 1.0), b=("double", 0.0)) is None
    assert one(spark, x.ratio0(F.col("a"), F.col("b")), a=("double", 1.0), b=("double", 0.0)) == 0.0
    assert one(spark, x.ratio0(F.col("a"), F.col("b")), a=("double", 1.0), b=("double", None)) == 0.0


@pytest.mark.parametrize("op, text, event, want", [(" CURV ", None, None, "CURV"), (None, "x", "e", "x"), (None, None, "e", "e"),
                                                  ("  ", "x", "e", "SIN_OP"), (None, None, None, "SIN_OP")])
def test_phase(spark, op, text, event, want):
    got = one(spark, x.phase_of("a", "b", "c"), a=("string", op), b=("string", text), c=("string", event))
    assert got == want


def test_bad_text_becomes_zero_or_null(spark):
    assert one(spark, x.to_number0("c"), c=("string", "n/d")) == 0.0
    assert one(spark, x.to_date("c"), c=("string", "PENDING")) is None
    assert one(spark, x.to_ts("c"), c=("string", "2025-01-02 03:04:05")) == datetime(2025, 1, 2, 3, 4, 5)


def test_minutes_between_ignores_time_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Madrid")
    try:
        got = one(spark, x.minutes_between("a", "b"), a=("timestamp_ntz", datetime(2025, 3, 30, 1, 0)), b=("timestamp_ntz", datetime(2025, 3, 30, 4, 30)))
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got == 210.0


def test_clip_keeps_null(spark):
    assert one(spark, x.clip(F.col("c"), 30, 180), c=("double", None)) is None
    assert one(spark, x.clip(F.col("c"), 30, 180), c=("double", 500.0)) == 180.0


@pytest.mark.parametrize("d, s, u, want", [(0.9, 0.01, 120.0, "EXCELENTE"), (0.9, 0.01, 99.0, "BUENA"), (0.4, 0.01, 120.0, "CRITICA"),
                                           (0.6, 0.2, 10.0, "CRITICA"), (0.6, 0.06, 10.0, "REQUIERE_ATENCION")])
def test_machine_state(spark, d, s, u, want):
    assert one(spark, x.machine_state("a", "b", "c"), a=("double", d), b=("double", s), c=("double", u)) == want


def test_colors_and_bands(spark):
    assert one(spark, x.kpi_color("v", "quality"), v=("double", 0.97)) == "#22c55e"
    assert one(spark, x.kpi_color("v", "quality"), v=("double", 0.96)) == "#fbbf24"
    assert one(spark, x.kpi_color("v", "quality"), v=("double", None)) == "#4b5563"
    assert one(spark, x.performance_band("v"), v=("double", 1.2)) == "supera objetivo"
    assert one(spark, x.change_risk("v"), v=("double", 0.9)) == "rojo"
