"""Units of measurement, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitalspark.functions.bind import bind

#: Canonical unit -> factors to it. Searched in this order.
LINEAR = {
    "g": {"mg": 1e-3, "g": 1.0, "kg": 1e3, "ug": 1e-6, "mcg": 1e-6},
    "L": {"mL": 1e-3, "ml": 1e-3, "L": 1.0, "l": 1.0},
    "m": {"mm": 1e-3, "cm": 1e-2, "m": 1.0, "in": 0.0254},
    "kg": {"kg": 1.0, "lb": 0.45359237},
}
#: Units that are canonical themselves and only convert for an analyte.
PASSTHROUGH = ("mmHg", "mEq/L", "U/L", "%", "percent", "ng/mL", "pg/mL", "10*3/uL", "10*6/uL", "cells/uL", "mg/dL", "mmol/L", "umol/L", "g/dL")
#: Factors from mg/dL, by target unit and analyte.
ANALYTES = {"mmol/L": {"glucose": 0.0555, "creatinine": 1.0 / 88.4}, "umol/L": {"creatinine": 88.4}}
#: Temperature scales.
TO_CELSIUS = (("[degF]", "Cel"), ("degF", "Cel"), ("F", "C"))
TO_FAHRENHEIT = (("Cel", "[degF]"), ("C", "F"))

KNOWN = tuple(sorted({*PASSTHROUGH, *(u for g in LINEAR.values() for u in g), *(u for p in (*TO_CELSIUS, *TO_FAHRENHEIT) for u in p)}))


def _numbers(values: dict[str, float]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def _pair(source: Column, target: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    return F.struct(source, target).isin([F.struct(F.lit(a), F.lit(b)) for a, b in pairs])


def known_unit(unit: Column) -> Column:
    return unit.isin(*KNOWN)


def canonical_for(unit: Column) -> Column:
    """Canonical unit, null for units without one."""
    out = F.when(unit.isin(*PASSTHROUGH), unit)
    for canonical, group in LINEAR.items():
        out = out.when(unit.isin(*group), canonical)
    return out


def convert(value: Column, source: Column, target: Column, analyte: Column | None = None) -> Column:
    """struct(value, error): identity, temperatures, analytes, then factors of one group; else an error."""
    analyte = F.lit(None).cast("string") if analyte is None else analyte
    out = F.when(source == target, value).when(_pair(source, target, TO_CELSIUS), (value - 32.0) * 5.0 / 9.0).when(_pair(source, target, TO_FAHRENHEIT), value * 9.0 / 5.0 + 32.0)
    for unit, factors in ANALYTES.items():
        factor = F.try_element_at(_numbers(factors), analyte)
        out = out.when((source == "mg/dL") & (target == unit) & analyte.isin(*factors), value * factor)
        out = out.when((source == unit) & (target == "mg/dL") & analyte.isin(*factors), value / factor)
    out = out.when(source.isin(*PASSTHROUGH), None)
    for group in LINEAR.values():
        factors = _numbers(group)
        out = out.when(source.isin(*group) & target.isin(*group), value * F.try_element_at(factors, source) / F.try_element_at(factors, target))
    missing = F.when(~known_unit(source), "unknown unit").when(~known_unit(target), "unknown unit").otherwise("no conversion")
    return bind(out, lambda x: F.struct(x.alias("value"), F.when(x.isNull() & value.isNotNull(), missing).alias("error")))
