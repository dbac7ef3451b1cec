"""Row-level rules as built-in column expressions (no Python UDFs)."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
PRODUCTION_EVENTS = ("producción", "produccion")
SETUP_EVENTS = ("preparación", "preparacion")
STATES = ("produccion", "preparacion", "incidencia")
SHIFTS = ("mañana", "tarde", "noche")
TOOL_CHANGE = "CAMBIO DE FRESA"
NO_PHASE = "SIN_OP"
WHITESPACE = " \t\n\r\f\v"
KPI_GOOD_WARNING = {
    "oee": (0.75, 0.60),
    "availability": (0.85, 0.75),
    "performance": (0.90, 0.80),
    "quality": (0.97, 0.95),
}
KPI_COLORS = {"good": "#22c55e", "warning": "#fbbf24", "bad": "#ef4444", "none": "#4b5563"}
STATE_THRESHOLDS = {
    "exc_disp": 0.85, "exc_scrap": 0.02, "exc_uph": 100.0,
    "buena_disp": 0.70, "buena_scrap": 0.05, "buena_uph": 60.0,
    "crit_disp": 0.50, "crit_scrap": 0.10,
}
MACHINE_STATES = ("EXCELENTE", "BUENA", "REQUIERE_ATENCION", "CRITICA")
STATE_CODES = {"EXCELENTE": 3, "BUENA": 2, "REQUIERE_ATENCION": 1, "CRITICA": 0}
PERFORMANCE_BANDS = (0.90, 0.80, 0.60)
CHANGE_RISK = (0.7, 0.9)
CLUSTER_BEST = (0.80, 0.03)
CLUSTER_LOW_AVAILABILITY, CLUSTER_HIGH_SCRAP, CLUSTER_FEW = 0.60, 0.08, 2
QUALITY_BANDS = {"silhouette": (0.5, 0.3), "r2": (0.7, 0.5), "accuracy": (0.85, 0.70)}
OVERFIT_GAP = 0.1
NAME_GAP = "[^0-9a-zA-Z]+"
# ----------------------------------------------------------------------------


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: Column, den: Column) -> Column:
    """num/den, NULL unless the denominator is positive."""
    return F.when(den > 0, num / den)


def ratio0(num: Column, den: Column) -> Column:
    """num/den, 0 unless the denominator is positive."""
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def sum0(c: Column | str) -> Column:
    """Sum that is 0, not NULL, when there is nothing to add."""
    return F.coalesce(F.sum(c), F.lit(0))


def norm_ref(c: str | Column) -> Column:
    """Reference id as text: trailing ``.0`` off, zero-padded to 6, never cut."""
    text = F.regexp_replace(col(c).cast("string"), r"\.0$", "")
    return F.lpad(text, F.greatest(F.length(text), F.lit(6)), F.lit("0"))


def shift_of(ts: str | Column) -> Column:
    h = F.hour(col(ts))
    return (
        F.when(h.isNull(), "desconocido")
        .when((h >= 6) & (h < 14), "mañana")
        .when((h >= 14) & (h < 22), "tarde")
        .otherwise("noche")
    )


def state_of(event: str | Column) -> Column:
    """Event text to machine state; unknown and NULL events are incidents."""
    e = F.lower(col(event))
    return (
        F.when(e.isin(*PRODUCTION_EVENTS), "produccion")
        .when(e.isin(*SETUP_EVENTS), "preparacion")
        .otherwise("incidencia")
    )


def pieces(ok: str = "piezas_ok", scrap: str = "piezas_scrap") -> Column:
    return F.col(ok) + F.col(scrap)


def weekday_mon0(ts: str | Column) -> Column:
    return F.weekday(col(ts))


def is_weekend(ts: str | Column) -> Column:
    return F.when(F.weekday(col(ts)) >= 5, 1).otherwise(0)


def month_of(ts: str | Column) -> Column:
    return F.trunc(col(ts).cast("date"), "MM")


def iso_week_label(ts: str | Column) -> Column:
    """``year-Wweek`` with the calendar year and the ISO week number."""
    t = col(ts)
    return F.concat(F.year(t).cast("string"), F.lit("-W"), F.weekofyear(t).cast("string"))


def ref_label(ref: str | Column, family: str | Column) -> Column:
    return F.concat(
        F.coalesce(col(ref), F.lit("")), F.lit(" ("),
        F.coalesce(col(family), F.lit("sin familia")), F.lit(")"),
    )


def clip(c: Column, low: float, high: float) -> Column:
    """Clamp that keeps NULL."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(float(low))), F.lit(float(high))))


def to_number0(c: str | Column) -> Column:
    """Text to double; anything unreadable becomes 0."""
    return F.coalesce(col(c).cast("string").try_cast("double"), F.lit(0.0))


def to_ts(c: str | Column) -> Column:
    """Text to timestamp without zone; anything unreadable becomes NULL."""
    return col(c).try_cast("timestamp_ntz")


def to_date(c: str | Column) -> Column:
    return col(c).try_cast("date")


def minutes_between(start: str | Column, end: str | Column) -> Column:
    """Minutes from start to end of zone-less timestamps."""
    seconds = (col(end) - col(start)).cast("interval second").cast("decimal(18,6)")
    return seconds.cast("double") / 60


def zero_as_null(c: str | Column) -> Column:
    return F.nullif(col(c), F.lit(0))


def slug(c: str | Column) -> Column:
    """Column-name form of a text."""
    return F.lower(F.btrim(F.regexp_replace(col(c), NAME_GAP, "_"), F.lit("_")))


def slug_text(text: str) -> str:
    """``slug`` of a Python string, for columns named after values."""
    return re.sub(NAME_GAP, "_", text).strip("_").lower()


def phase_of(op_id: str | Column = "op_id", op_text: str | Column = "op_text",
             event: str | Column = "evento") -> Column:
    """Phase name: operation id, else its text, else the event."""
    raw = F.coalesce(col(op_id), col(op_text), col(event))
    stripped = F.btrim(raw, F.lit(WHITESPACE))
    return F.coalesce(F.nullif(stripped, F.lit("")), F.lit(NO_PHASE))


def has_text(c: str | Column, needle: str, ignore_case: bool = False) -> Column:
    """Substring test; NULL is false."""
    text = F.lower(col(c)) if ignore_case else col(c)
    return F.coalesce(text.contains(needle.lower() if ignore_case else needle), F.lit(False))


def starts_with(c: str | Column, prefix: str) -> Column:
    return F.coalesce(F.upper(col(c)).startswith(prefix.upper()), F.lit(False))


def is_incident_row(event: str | Column = "evento", kind: str | Column = "tipo_incidencia") -> Column:
    return has_text(event, "incid", ignore_case=True) | col(kind).isNotNull()


def kpi_color(value: str | Column, kpi: str) -> Column:
    """Traffic-light colour of one KPI."""
    good, warning = KPI_GOOD_WARNING[kpi]
    v = col(value)
    return (
        F.when(v.isNull(), KPI_COLORS["none"])
        .when(v >= good, KPI_COLORS["good"])
        .when(v >= warning, KPI_COLORS["warning"])
        .otherwise(KPI_COLORS["bad"])
    )


def performance_band(value: str | Column) -> Column:
    v = col(value)
    return (
        F.when(v.isNull(), "sin datos")
        .when(v > 1, "supera objetivo")
        .when(v >= PERFORMANCE_BANDS[0], "excelente")
        .when(v >= PERFORMANCE_BANDS[1], "bueno")
        .when(v >= PERFORMANCE_BANDS[2], "mejorable")
        .otherwise("bajo")
    )


def change_risk(value: str | Column) -> Column:
    v = col(value)
    return F.when(v < CHANGE_RISK[0], "verde").when(v < CHANGE_RISK[1], "amarillo").otherwise("rojo")


def machine_state(disp: str | Column = "disponibilidad", scrap: str | Column = "scrap_rate",
                  uph: str | Column = "uph_real", thresholds: Mapping[str, float] | None = None) -> Column:
    """Health class of a machine; rules are tested in this order."""
    t = {**STATE_THRESHOLDS, **(thresholds or {})}
    d, s, u = col(disp), col(scrap), col(uph)
    return (
        F.when((d >= t["exc_disp"]) & (s <= t["exc_scrap"]) & (u >= t["exc_uph"]), "EXCELENTE")
        .when((d >= t["buena_disp"]) & (s <= t["buena_scrap"]) & (u >= t["buena_uph"]), "BUENA")
        .when((d < t["crit_disp"]) | (s > t["crit_scrap"]), "CRITICA")
        .otherwise("REQUIERE_ATENCION")
    )


def state_code(state: str | Column) -> Column:
    out = None
    for name, code in STATE_CODES.items():
        cond = col(state) == name
        out = F.when(cond, code) if out is None else out.when(cond, code)
    return out


def cluster_meaning(n: str | Column, disp: str | Column, scrap: str | Column) -> Column:
    n, d, s = col(n), col(disp), col(scrap)
    return (
        F.when((d >= CLUSTER_BEST[0]) & (s <= CLUSTER_BEST[1]), "mejor rendimiento")
        .when(d < CLUSTER_LOW_AVAILABILITY, "baja disponibilidad")
        .when(s > CLUSTER_HIGH_SCRAP, "alto scrap")
        .when(n <= CLUSTER_FEW, "atipico")
        .otherwise("rendimiento normal")
    )


def one_hot(c: str | Column, prefix: str, values: Sequence[str]) -> dict[str, Column]:
    """0/1 columns for an explicit value list, named ``prefix_value``."""
    return {
        f"{prefix}_{v}": F.when(col(c) == v, 1).otherwise(0)
        for v in values
    }


def quality_band(metric: str, value: str | Column) -> Column:
    """Fit-quality words for silhouette, r2, accuracy and the train-test gap."""
    v = col(value)
    if metric == "gap":
        return F.when(v > OVERFIT_GAP, "sobreajuste").otherwise("generaliza")
    high, low = QUALITY_BANDS[metric]
    return F.when(v > high, "alta").when(v > low, "media").otherwise("baja")
