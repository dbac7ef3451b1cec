"""Explicit schemas of the factory files; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _s(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


S, D, L, TS = T.StringType(), T.DoubleType(), T.LongType(), T.TimestampNTZType()

REFS = _s(("ref_id", S), ("familia", S), ("peso_neto_kg", D))
RATES = _s(("ref_id", S), ("ref_id_str", S), ("machine_name", S), ("piezas_hora_teorico", D), ("ciclo_teorico_seg", D))
ORDERS = _s(("work_order_id", S), ("ref_id", S), ("familia", S), ("cliente", S), ("qty_plan", L),
            ("fecha_lanzamiento", S), ("due_date", S), ("planta_inicio", S))
OPERATIONS = _s(
    ("work_order_id", S), ("work_order_id_raw", S), ("ref_id", S), ("ref_id_raw", S), ("material_lot_id", S),
    ("op_id", S), ("op_text", S), ("machine_id", S), ("machine_name", S), ("planta", S), ("evento", S),
    ("tipo_incidencia", S), ("operario_nombre", S), ("ts_ini", S), ("ts_fin", S),
    ("duracion_min", S), ("piezas_ok", S), ("piezas_scrap", S))
PURCHASES = _s(("material_lot_id", S), ("laminado_id", S), ("ref_materia", S), ("qty_recibida", S), ("udm", S),
               ("peso_bruto", D), ("uds", D), ("fecha_recepcion_ts", S))
STOCK = _s(("item_ref_id", S), ("fecha_ts", S))
LABOUR = _s(("año_mes", S), ("horas_teoricas", L), ("reduccion_tco", L), ("horas_ajustadas", L),
            ("horas_enfermedad", L), ("horas_accidente", L), ("horas_permiso", L), ("horas_netas", L))
TOOL_CHANGES = _s(("machine_id", S), ("machine_name", S), ("ts_cambio", TS), ("piezas_hasta_cambio", D),
                  ("scrap_hasta_cambio", D), ("duracion_cambio_min", D), ("ops_hasta_cambio", L))
_OPERATION = _s(("op", S), ("piezas_lanzadas", D), ("salida_estimada", D), ("piezas_scrap", D), ("duracion_min", D))
ORDER_LIFE = _s(
    ("work_order_id", S), ("ref_id_str", S), ("cantidad_lanzada", D), ("operaciones", T.ArrayType(_OPERATION)),
    ("cantidad_final_ok", D), ("scrap_total", D), ("tiempo_total_min", D), ("primera_fase_ts", TS),
    ("ultima_fase_ts", TS), ("fabricacion_duracion_min", D), ("incidencias_duracion_total", D))
