"""Values coerced to logical types: struct(value, error) columns; complex values are JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitalspark.functions import dates, units
from vitalspark.functions.bind import bind

QUANTITY = "struct<value:string,unit:string>"
CODED = "struct<code:string,system:string,display:string>"


def _no(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def parse_vocabulary(spec: Column) -> Column:
    """Codes of a pipe-separated vocabulary; null (anything goes) if it is null or blank."""
    return F.when(F.trim(spec) != "", F.filter(F.transform(F.split(spec, r"\|"), lambda x: F.trim(x)), lambda x: x != ""))


def canonical_code(code: Column, spec: Column) -> Column:
    """The vocabulary's spelling of a code, whatever its case; the code itself without a vocabulary or a match."""
    return F.coalesce(F.get(F.filter(parse_vocabulary(spec), lambda x: F.lower(x) == F.lower(F.trim(code))), F.lit(0)), code)


def is_allowed(code: Column, spec: Column) -> Column:
    found = parse_vocabulary(spec)
    return found.isNull() | F.exists(found, lambda x: F.lower(x) == F.lower(F.trim(code)))


def _or_error(fields: dict[str, Column], error: Column) -> Column:
    """struct of the fields and error; the fields are null if there is an error."""
    whole = F.struct(*(v.alias(k) for k, v in fields.items()), error.alias("error"))
    return bind(whole, lambda x: F.struct(*(F.when(x["error"].isNull(), x[k]).alias(k) for k in fields), x["error"].alias("error")))


def to_quantity(value: Column, canonical_unit: Column, analyte: Column) -> Column:
    """struct(value, unit, canonical_value, canonical_unit, error) of "<number> <unit>" or {"value", "unit"}."""
    text = F.trim(value)
    halves = F.split(text, r"\s+", 2)
    pair = F.when(text.startswith("{"), F.from_json(text, QUANTITY)).when(F.size(halves) == 2, F.struct(F.get(halves, F.lit(0)).alias("value"), F.get(halves, F.lit(1)).alias("unit")))

    def converted(x: Column) -> Column:
        done = units.convert(x["value"], x["unit"], x["target"], analyte)
        error = F.when(F.coalesce(x["unit"], F.lit("")) == "", "expected a number and a unit").when(x["value"].isNull(), "non-numeric value").when(~units.known_unit(x["unit"]), "unknown unit")
        return bind(done, lambda d: _or_error({"value": x["value"], "unit": x["unit"], "canonical_value": d["value"], "canonical_unit": x["target"]}, F.coalesce(error, d["error"])))

    return bind(pair, lambda p: bind(F.struct(p["value"].try_cast("double").alias("value"), p["unit"].alias("unit"), F.coalesce(canonical_unit, units.canonical_for(p["unit"]), p["unit"]).alias("target")), converted))


def to_coded(value: Column, vocabulary: Column, code_system: Column) -> Column:
    """struct(code, system, display, error) of a code or {"code", "system", "display"}."""
    text = F.trim(value)
    parts = F.when(text.startswith("{"), F.from_json(text, CODED)).otherwise(F.from_json(F.to_json(F.struct(text.alias("code"))), CODED))

    def checked(x: Column) -> Column:
        code, system = F.trim(x["code"]), F.coalesce(F.nullif(x["system"], F.lit("")), code_system)
        error = F.when(F.coalesce(code, F.lit("")) == "", "missing code").when(~is_allowed(code, vocabulary), "not in the vocabulary").when(system.isNull(), "no code system")
        return _or_error({"code": canonical_code(code, vocabulary), "system": system, "display": F.nullif(x["display"], F.lit(""))}, error)

    return bind(parts, checked)


def normalize(value: Column, source: Column, target: Column, canonical_unit: Column | None = None, vocabulary: Column | None = None, analyte: Column | None = None, code_system: Column | None = None) -> Column:
    """struct(value, error): text `value` of logical type `source` as logical type `target`.

    The three healthcare types always run; otherwise the same type passes, nine pairs convert, and any other pair is an error.
    A null value is null without an error.
    """
    unit, vocabulary, analyte, code_system = (_no() if x is None else x for x in (canonical_unit, vocabulary, analyte, code_system))
    integer = F.when(F.trim(value).rlike(r"^[+-]?\d+(_\d+)*$"), F.replace(F.trim(value), F.lit("_"), F.lit("")).try_cast("bigint"))

    def written(x: Column, names: str) -> Column:
        json = F.to_json(F.struct(*(x[n].alias(n) for n in names.split())), {"ignoreNullFields": "false"})
        return F.struct(F.when(x["error"].isNull(), json).alias("value"), x["error"].alias("error"))

    def pair(a: str, b: str) -> Column:
        return (source == a) & (target == b)

    plain = (
        F.when(source == target, value)
        .when(pair("integer", "text") | pair("numeric", "text") | pair("text", "jsonb") | pair("string[]", "jsonb"), value)
        .when(pair("text", "string[]"), F.to_json(F.array(value)))
        .when(pair("text", "integer"), integer.cast("string"))
        .when(pair("integer", "timestamp"), dates.millis_to_iso(value.try_cast("bigint")))
        .when(pair("timestamp", "integer"), dates.iso_to_millis(value).cast("string"))
        .when(pair("text", "timestamp"), dates.iso_timestamp(F.try_to_timestamp(value)))
    )
    return (
        F.when(value.isNull(), F.struct(_no().alias("value"), _no().alias("error")))
        .when(target == "partial_date", bind(dates.text_to_partial_date(value), lambda x: written(x, "year month day precision")))
        .when(target == "quantity_with_unit", bind(to_quantity(value, unit, analyte), lambda x: written(x, "value unit canonical_value canonical_unit")))
        .when(target == "coded_value", bind(to_coded(value, vocabulary, code_system), lambda x: written(x, "code system display")))
        .otherwise(bind(plain, lambda x: F.struct(x.alias("value"), F.when(x.isNull(), "unsafe coercion").alias("error"))))
    )
