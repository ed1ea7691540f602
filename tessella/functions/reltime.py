"""Relative times in words ("hace 2 semanas") as approximate days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days of a unit, written with or without accents (fixed values).
UNIT_DAYS = {
    "segundo": 1 / 86400, "segundos": 1 / 86400, "minuto": 1 / 1440, "minutos": 1 / 1440, "hora": 1 / 24, "horas": 1 / 24,
    "dia": 1.0, "dias": 1.0, "día": 1.0, "días": 1.0, "semana": 7.0, "semanas": 7.0, "mes": 30.44, "meses": 30.44,
    "ano": 365.25, "anos": 365.25, "año": 365.25, "años": 365.25,
}
#: Upper bounds in days and the labels below them (fixed values).
BUCKETS = ((7, "<1 semana"), (31, "1 sem - 1 mes"), (366, "1 mes - 1 ano"), (731, "1 - 2 anos"))
#: The mark of an edited text, at the end (fixed pattern).
_EDITED = r"(?i)\s*\(editado\)\s*$"
_PATTERN = r"(?i)^\s*hace\s+([0-9]+)\s+([a-zá-úñ]+)"


def relative_days(text: Column) -> Column:
    """Approximate days, three decimals; null if the text is something else."""
    unit = F.lower(F.regexp_extract(text, _PATTERN, 2))
    factor = F.lit(None).cast("double")
    for name, days in UNIT_DAYS.items():
        factor = F.when(unit == name, F.lit(days)).otherwise(factor)
    return F.round(F.regexp_extract(text, _PATTERN, 1).try_cast("double") * factor, 3)


def relative_bucket(text: Column) -> Column:
    """One of five age classes, or ``desconocido``."""
    days = relative_days(text)
    out = F.when(days.isNull(), "desconocido")
    for bound, label in BUCKETS:
        out = out.when(days < bound, label)
    return out.otherwise(">2 anos")


def is_edited(text: Column) -> Column:
    """Whether a relative time says that the text was edited."""
    return F.coalesce(text.rlike(_EDITED), F.lit(False))


def without_edited(text: Column) -> Column:
    """A relative time without that mark and the space before it."""
    return F.regexp_replace(text, _EDITED, "")


def coerced_timestamp(text: Column) -> Column:
    """A timestamp as text; null, never an error, if it can't be read."""
    return F.trim(text).try_cast("timestamp")
