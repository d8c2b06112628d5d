"""Payloads of clinical values as JSON text: partial dates, codes, quantities; null for a null value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _json(test: Column, **fields: Column) -> Column:
    return F.when(test.isNotNull(), F.to_json(F.struct(*(v.alias(k) for k, v in fields.items()))))


def partial_date(day: Column) -> Column:
    """Of a date: to the day."""
    return _json(day, value=day.cast("date").cast("string"), precision=F.lit("day"))


def coded(code: Column, system: str, display: Column) -> Column:
    return _json(code, code=code, system=F.lit(system), display=display)


def quantity(value: Column, unit: Column) -> Column:
    return _json(value, value=value.cast("double"), unit=unit)
