"""Hand-made frames."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from forja.sources.conform import conform_ops

OPS = ("work_order_id string, ref_id string, op_id string, op_text string, machine_id string, machine_name string, planta string, "
       "evento string, tipo_incidencia string, ts_ini timestamp_ntz, ts_fin timestamp_ntz, duracion_min double, piezas_ok double, piezas_scrap double")
NAMES = [c.split()[0] for c in OPS.split(", ")]
BASE = {"work_order_id": "A", "ref_id": "1", "op_id": "TALL20", "op_text": None, "machine_id": "m1", "machine_name": "M1", "planta": "P",
        "evento": "Producción", "tipo_incidencia": None, "ts_ini": datetime(2025, 1, 6, 8), "ts_fin": datetime(2025, 1, 6, 9),
        "duracion_min": 60.0, "piezas_ok": 10.0, "piezas_scrap": 0.0}


def at(day: int, hour: int = 8, minute: int = 0) -> datetime:
    return datetime(2025, 1, day, hour, minute)


def raw_ops(spark: SparkSession, *rows: dict) -> DataFrame:
    data = [tuple({**BASE, **r}[n] for n in NAMES) for r in rows]
    return spark.createDataFrame(data, OPS)


def ops(spark: SparkSession, *rows: dict) -> DataFrame:
    return conform_ops(raw_ops(spark, *rows))


def rates(spark: SparkSession, *rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), "ref_id_str string, machine_name string, piezas_hora_teorico double")


def as_dicts(df: DataFrame, *sort: str) -> list[dict]:
    rows = [r.asDict(recursive=True) for r in df.collect()]
    return sorted(rows, key=lambda r: tuple(str(r[s]) for s in sort)) if sort else rows
