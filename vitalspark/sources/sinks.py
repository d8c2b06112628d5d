"""Sinks: bundles, HL7 messages, flat extracts, JSON lines and reports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code systems.
ICD10, LOINC, RXNORM, PATIENT_ID = "http://hl7.org/fhir/sid/icd-10-cm", "http://loinc.org", "http://www.nlm.nih.gov/research/umls/rxnorm", "urn:patient-id"


def _resource(kind: str, **fields: Column) -> Column:
    return F.to_json(F.struct(F.lit(kind).alias("resourceType"), *(v.alias(k) for k, v in fields.items())))


def _concept(system: str, code: Column, display: Column) -> Column:
    return F.struct(F.array(F.struct(F.lit(system).alias("system"), code.alias("code"), display.alias("display"))).alias("coding"), display.alias("text"))


def bundles(patients: DataFrame, conditions: DataFrame | None = None, observations: DataFrame | None = None, medications: DataFrame | None = None) -> DataFrame:
    """patient_id, bundle: JSON text of a bundle for each patient, resources in order of type, then id.

    patients: patient_id, sex, date_of_birth; conditions: condition_id, patient_id, condition_code, histology, onset_date;
    observations: observation_id, patient_id, loinc_code, display, observation_date, value, unit; medications: medication_id, patient_id, rxnorm_code, display, start_date, end_date.
    """
    subject = F.struct(F.concat(F.lit("Patient/"), "patient_id").alias("reference"))
    parts = [patients.select("patient_id", F.lit(0).alias("o"), F.col("patient_id").alias("i"), _resource("Patient", id=F.col("patient_id"), identifier=F.array(F.struct(F.lit(PATIENT_ID).alias("system"), F.col("patient_id").alias("value"))), gender=F.col("sex"), birthDate=F.col("date_of_birth")).alias("r"))]
    if conditions is not None:
        parts.append(conditions.select("patient_id", F.lit(1), "condition_id", _resource("Condition", id=F.col("condition_id"), subject=subject, code=_concept(ICD10, F.col("condition_code"), F.col("histology")), onsetDateTime=F.col("onset_date"))))
    if observations is not None:
        quantity = F.struct(F.col("value").cast("double").alias("value"), F.col("unit").alias("unit"))
        parts.append(observations.select("patient_id", F.lit(2), "observation_id", _resource("Observation", id=F.col("observation_id"), subject=subject, code=_concept(LOINC, F.col("loinc_code"), F.col("display")), effectiveDateTime=F.col("observation_date"), valueQuantity=quantity)))
    if medications is not None:
        period = F.struct(F.col("start_date").alias("start"), F.col("end_date").alias("end"))
        parts.append(medications.select("patient_id", F.lit(3), "medication_id", _resource("MedicationAdministration", id=F.col("medication_id"), subject=subject, medicationCodeableConcept=_concept(RXNORM, F.col("rxnorm_code"), F.col("display")), effectivePeriod=period)))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.union(part)
    entries = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "i", "r"))), lambda x: F.concat(F.lit('{"resource":'), x["r"], F.lit("}"))), ",")
    return rows.groupBy("patient_id").agg(F.concat(F.lit('{"resourceType":"Bundle","type":"collection","entry":['), entries, F.lit("]}")).alias("bundle"))


def escape(value: Column) -> Column:
    """HL7 escapes."""
    for plain, code in (("|", "\\F\\"), ("^", "\\S\\"), ("\n", "\\X000D\\")):
        value = F.replace(value, F.lit(plain), F.lit(code))
    return value


def _segment(*fields: Column | str) -> Column:
    return F.concat_ws("|", *(F.lit(f) if isinstance(f, str) else F.coalesce(f.cast("string"), F.lit("")) for f in fields))


def hl7_messages(patients: DataFrame, conditions: DataFrame, observations: DataFrame, medications: DataFrame) -> DataFrame:
    """patient_id, message: an ADT, an ORU and an RDE block for each patient, a blank line between two."""
    digits = lambda c: F.replace(F.col(c), F.lit("-"), F.lit(""))
    code = lambda c, d, s: F.concat_ws("^", F.coalesce(F.col(c), F.lit("")), escape(F.coalesce(F.col(d), F.lit(""))), F.lit(s))
    pid = _segment("PID", "1", "", F.col("patient_id"), "", "", "", digits("date_of_birth"), F.upper(F.left("sex", F.lit(1))))
    parts = [
        patients.select("patient_id", F.lit(0).alias("o"), F.lit("").alias("i"), F.concat_ws("\r", _segment("MSH", "^~\\&", "app", "fac", "app", "fac", "", "", "ADT^A01", F.col("patient_id"), "P", "2.5.1"), pid).alias("s")),
        conditions.select("patient_id", F.lit(1), "condition_id", _segment("DG1", "1", "", F.col("condition_code"), escape(F.concat(F.lit("NSCLC "), F.col("histology"))), digits("onset_date"))),
        observations.select("patient_id", F.lit(3), "observation_id", _segment("OBX", "1", "NM", code("loinc_code", "display", "LN"), "", F.col("value"), F.col("unit"), "", "", "", "", "", "", "", digits("observation_date"))),
        medications.select("patient_id", F.lit(5), "medication_id", _segment("RXA", "0", "1", digits("start_date"), digits("end_date"), code("rxnorm_code", "display", "RXN"))),
    ]
    for o, kind, rows in ((2, "ORU^R01", observations), (4, "RDE^O11", medications)):
        head = F.concat(F.lit("\r"), _segment("MSH", "^~\\&", "app", "fac", "app", "fac", "", "", kind, F.col("patient_id"), "P", "2.5.1"))
        parts.append(rows.select("patient_id").distinct().select("patient_id", F.lit(o), F.lit(""), head))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.union(part)
    return rows.groupBy("patient_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "i", "s"))), lambda x: x["s"]), "\r").alias("message"))


def flat(rows: DataFrame) -> DataFrame:
    """Rows as a flat extract has them: arrays joined by bars, structs, maps and variants as JSON text."""

    def cell(c: str) -> Column:
        kind = rows.schema[c].dataType
        if kind.typeName() == "array" and kind.elementType.typeName() == "string":
            return F.array_join(c, "|").alias(c)
        return F.to_json(c).alias(c) if kind.typeName() in ("array", "struct", "map", "variant") else F.col(c)

    return rows.select(*map(cell, rows.columns))


def write_extracts(tables: Mapping[str, DataFrame], folder: str) -> None:
    """Each table as a folder of CSV files with a header."""
    for name, rows in tables.items():
        flat(rows).write.mode("overwrite").option("header", "true").csv(f"{folder.rstrip('/')}/{name}")


def write_json(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines."""
    rows.write.mode("overwrite").json(path)


def write_texts(rows: DataFrame, column: str, path: str) -> None:
    """One text column, a line each."""
    rows.select(F.replace(column, F.lit("\n"), F.lit(" ")).alias("value")).write.mode("overwrite").text(path)
