import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from vitalspark.functions import coerce, dates, drugs, registries, units


def one(spark, column, **values):
    """A column over one row of text values."""
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


PARTIAL = (
    [
        ("2020-04-09", dt.date(2020, 4, 9), "day", False), ("2020-4-9", dt.date(2020, 4, 9), "day", False), ("2020-04", dt.date(2020, 4, 15), "month", True), ("2020", dt.date(2020, 7, 1), "year", True), ("2020-04-09T10:00:00", dt.date(2020, 4, 9), "day", False),
        (" 2020-04-09 10:00 ", dt.date(2020, 4, 9), "day", False), ("2020-02-30", None, "unknown", False), ("NaN", None, "unknown", False), ("", None, "unknown", False), (None, None, "unknown", False), ("soon", None, "unknown", False), ("2020-123", None, "unknown", False),
    ]
)


def test_partial_dates(spark):
    rows = spark.createDataFrame([(i, x[0]) for i, x in enumerate(PARTIAL)], "i int, t string")
    got = {r.i: (r.x.date, r.x.precision, bool(r.x.assumed)) for r in rows.select("i", dates.parse_partial_date(F.col("t")).alias("x")).collect()}
    assert got == {i: x[1:] for i, x in enumerate(PARTIAL)}


TEXTS = (
    [
        ("2024-06-15", (2024, 6, 15, "day")), ("2024-6", (2024, 6, None, "month")), ("2024", (2024, None, None, "year")), ("06/2024", (2024, 6, None, "month")), ("Sept 2024", (2024, 9, None, "month")), ("q2 2024", (2024, 6, None, "month")),
        ("2024-06-15T12:00:00Z", (2024, 6, 15, "day")), ("2024-02-31", (2024, 2, 31, "day")), ("2024-13", None), ("2024-01-32", None), ("Foo 2024", None), ("x", None),
    ]
)


def test_partial_date_of_text(spark):
    rows = spark.createDataFrame([(i, x[0]) for i, x in enumerate(TEXTS)], "i int, t string")
    for r in rows.select("i", dates.text_to_partial_date(F.col("t")).alias("x")).select("i", "x", dates.partial_date_text(F.col("x")).alias("again")).collect():
        want = TEXTS[r.i][1]
        assert (want is None) == (r.x.error is not None) and (want is None or (r.x.year, r.x.month, r.x.day, r.x.precision) == want)
        assert want is None or r.again == "-".join(f"{x:0{4 if i == 0 else 2}d}" for i, x in enumerate(want[:3]) if x)


def test_dates_and_times(spark):
    assert one(spark, dates.resolve_date_by_length(F.col("t")), t="2020-04") == dt.date(2020, 4, 15)
    assert one(spark, dates.resolve_date_by_length(F.col("t")), t="2020-04-31xyz") is None
    assert one(spark, dates.millis_to_iso(F.col("t").cast("long")), t="1700000000123") == "2023-11-14T22:13:20.123Z"
    assert one(spark, dates.iso_to_millis(F.col("t")), t="2023-11-14T22:13:20.123Z") == 1700000000123
    assert one(spark, dates.months(F.lit(-3)), t="") == 0 and one(spark, dates.months(F.lit(100)), t="") == 3.29


UNITS = (
    [
        (500, "mg", "g", None, 0.5), (150, "lb", "kg", None, 68.0388555), (98.6, "degF", "Cel", None, 37.0), (37, "Cel", "[degF]", None, 98.6), (100, "mg/dL", "mmol/L", "glucose", 5.55), (1, "mg/dL", "umol/L", "creatinine", 88.4),
        (88.4, "umol/L", "mg/dL", "creatinine", 1.0), (70, "in", "cm", None, 177.8), (1, "mg/dL", "mmol/L", "creatinine", 1 / 88.4), (3, "furlong", "furlong", None, 3), (1, "mg/dL", "mmol/L", None, None), (1, "mg", "L", None, None), (1, "mmHg", "kPa", None, None),
    ]
)


def test_units(spark):
    rows = spark.createDataFrame([(i, float(x[0]), *x[1:4]) for i, x in enumerate(UNITS)], "i int, v double, s string, t string, a string")
    for r in rows.select("i", units.convert(F.col("v"), F.col("s"), F.col("t"), F.col("a")).alias("x")).collect():
        want = UNITS[r.i][4]
        assert r.x.value == (pytest.approx(want) if want is not None else None) and (r.x.error is None) == (want is not None)


def test_canonical_units(spark):
    assert [one(spark, units.canonical_for(F.col("u")), u=u) for u in ("kg", "lb", "mmHg", "ml", "degF", "x")] == ["g", "kg", "mmHg", "L", None, None]
    assert [one(spark, units.known_unit(F.col("u")), u=u) for u in ("degF", "g/dL", "x")] == [True, True, False]


def normal(spark, value, source, target, **context):
    got = one(spark, coerce.normalize(F.col("v"), F.lit(source), F.lit(target), **{k: F.lit(x) for k, x in context.items()}), v=value)
    return got.value, got.error


def test_coercions(spark):
    assert normal(spark, " 42 ", "text", "integer") == ("42", None) and normal(spark, "4_2", "text", "integer")[0] == "42" and normal(spark, "x", "text", "integer")[1]
    assert json.loads(normal(spark, "12.5 mg", "text", "quantity_with_unit")[0]) == {"value": 12.5, "unit": "mg", "canonical_value": 0.0125, "canonical_unit": "g"}
    assert json.loads(normal(spark, '{"value": 100, "unit": "mg/dL"}', "jsonb", "quantity_with_unit", canonical_unit="mmol/L", analyte="glucose")[0])["canonical_value"] == pytest.approx(5.55)
    assert all(normal(spark, v, "text", "quantity_with_unit")[1] for v in ("12", "x mg", "12 parsec", '{"value": 1}'))
    assert json.loads(normal(spark, "POSITIVE", "text", "coded_value", vocabulary="positive | negative", code_system="s")[0]) == {"code": "positive", "system": "s", "display": None}
    assert normal(spark, "maybe", "text", "coded_value", vocabulary="positive|negative", code_system="s")[1] and normal(spark, "a", "text", "coded_value")[1] == "no code system"
    assert json.loads(normal(spark, "Q1 2020", "text", "partial_date")[0])["month"] == 3
    assert normal(spark, "x", "text", "text") == ("x", None) and normal(spark, "x", "coded_value", "text")[1] == "unsafe coercion" and normal(spark, "x", "text", "string[]")[0] == '["x"]'
    assert normal(spark, "2020-01-02", "text", "timestamp")[0] == "2020-01-02T00:00:00.000Z" and normal(spark, None, "text", "integer") == (None, None)


def test_drugs(spark):
    kinds = {n: one(spark, drugs.drug_class(F.col("n"), F.col("c")), n=n, c=c) for n, c in ((" Osimertinib", None), ("nivolumab", None), ("new", "io_pd1"), ("other", "tki_met"), ("odd", None))}
    assert list(kinds.values()) == ["tki", "io", "io", "tki", "chemo"]
    classes = {("tki", "io", "chemo"): "tki+io", ("tki", "chemo"): "tki+chemo", ("io", "chemo"): "chemo+io", ("io",): "io", ("chemo",): "chemo", ("tki",): "tki"}
    for held, want in classes.items():
        assert one(spark, drugs.regimen_class(F.array(*map(F.lit, held))), t="") == want


LOOKUPS = (
    [
        ("x", ["718-7", " 718-7 "], ("hemoglobin", "LOINC", "718-7")), ("x", ["718-7", "2345-7"], None), ("dx", ["C34.2", "C34.11"], ("diagnosis_code", "ICD-10", "C34.11")), ("dx", ["C34.2", "C34.30"], None), ("Drug-Name", ["Keytruda", "pembrolizumab", "1547545"], ("drug_name", "RxNorm", "1547545")),
        ("drug", ["Keytruda", "Opdivo"], None), ("name", ["Keytruda"], ("sodium", "LOINC", "2951-2")), ("Glucose level", ["101"], ("glucose", "LOINC", "2345-7")), ("ecog_performance_status", ["1"], None), ("white blood", [None, ""], ("wbc_count", "LOINC", "26464-8")), ("zip", [], None),
    ]
)


def test_lookup(spark):
    """Also what looks odd: "na" inside a name is sodium."""
    rows = spark.createDataFrame([(i, x[0], x[1]) for i, x in enumerate(LOOKUPS)], "i int, c string, s array<string>")
    for r in rows.select("i", registries.lookup(F.col("c"), F.col("s")).alias("v")).collect():
        assert (r.v and (r.v.canonical_name, r.v.registry, r.v.code)) == LOOKUPS[r.i][2]
