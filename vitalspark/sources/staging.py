"""Raw payloads as variants, and their projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Resource type -> projected column -> (path, type).
RESOURCES: dict[str, dict[str, tuple[str, str]]] = {
    "Patient": {"patient_id": ("$.id", "string"), "gender": ("$.gender", "string"), "birth_date": ("$.birthDate", "string"), "state": ("$.address[0].state", "string"), "deceased_at": ("$.deceasedDateTime", "string"), "deceased": ("$.deceasedBoolean", "boolean")},
    "Condition": {"condition_id": ("$.id", "string"), "subject": ("$.subject.reference", "string"), "code": ("$.code.coding[0].code", "string"), "display": ("$.code.coding[0].display", "string"), "onset": ("$.onsetDateTime", "string")},
    "Observation": {"observation_id": ("$.id", "string"), "subject": ("$.subject.reference", "string"), "code": ("$.code.coding[0].code", "string"), "display": ("$.code.coding[0].display", "string"), "effective": ("$.effectiveDateTime", "string"), "value": ("$.valueQuantity.value", "double"), "unit": ("$.valueQuantity.unit", "string"), "value_integer": ("$.valueInteger", "int")},
    "MedicationAdministration": {"medication_id": ("$.id", "string"), "subject": ("$.subject.reference", "string"), "code": ("$.medicationCodeableConcept.coding[0].code", "string"), "display": ("$.medicationCodeableConcept.coding[0].display", "string"), "start": ("$.effectivePeriod.start", "string"), "end": ("$.effectivePeriod.end", "string"), "dose": ("$.dosage.dose.value", "double"), "dose_unit": ("$.dosage.dose.unit", "string")},
    "Procedure": {"procedure_id": ("$.id", "string"), "subject": ("$.subject.reference", "string"), "code": ("$.code.coding[0].code", "string"), "performed": ("$.performedDateTime", "string")},
    "Encounter": {"encounter_id": ("$.id", "string"), "subject": ("$.subject.reference", "string"), "class": ("$.class.code", "string"), "start": ("$.period.start", "string"), "end": ("$.period.end", "string")},
    "DiagnosticReport": {"report_id": ("$.id", "string"), "subject": ("$.subject.reference", "string"), "code": ("$.code.coding[0].code", "string"), "issued": ("$.issued", "string"), "conclusion": ("$.conclusion", "string")},
}
#: Extract file's stem -> column -> (header, type).
EXTRACTS: dict[str, dict[str, tuple[str, str]]] = {
    "patients": {"patient_id": ("patient_id", "string"), "sex": ("sex", "string"), "state": ("state_of_residence", "string"), "vital_status": ("vital_status", "string")},
    "conditions": {"condition_id": ("condition_id", "string"), "patient_id": ("patient_id", "string"), "code": ("condition_code", "string"), "onset": ("onset_date", "string")},
    "observations": {"observation_id": ("observation_id", "string"), "patient_id": ("patient_id", "string"), "code": ("loinc_code", "string"), "display": ("display", "string"), "value": ("value", "double"), "unit": ("unit", "string")},
    "medication_administrations": {"medication_id": ("medication_id", "string"), "patient_id": ("patient_id", "string"), "code": ("rxnorm_code", "string"), "display": ("display", "string"), "start": ("start_date", "string"), "end": ("end_date", "string"), "dose": ("dose_value", "double")},
    "procedures": {"procedure_id": ("procedure_id", "string"), "patient_id": ("patient_id", "string"), "code": ("code", "string")},
    "encounters": {"encounter_id": ("encounter_id", "string"), "patient_id": ("patient_id", "string"), "date": ("encounter_date", "string"), "type": ("encounter_type", "string")},
}


def raw_bundles(files: DataFrame) -> DataFrame:
    """name, bundle (variant; null if it is no JSON)."""
    return files.where("format = 'fhir'").select("name", F.try_parse_json("text").alias("bundle"))


def raw_extract(rows: DataFrame, stem: str) -> DataFrame:
    """source_table, row_data (variant) of a table's rows."""
    return rows.select(F.lit(stem).alias("source_table"), F.to_variant_object(F.struct(*rows.columns)).alias("row_data"))


def _path(column: str, path: str, kind: str) -> Column:
    return F.try_variant_get(column, path, kind)


def resources(bundles: DataFrame, kind: str) -> DataFrame:
    """name and the projected columns of a bundle's resources of a type; a missing path is null."""
    entries = F.explode(F.expr("try_variant_get(bundle, '$.entry', 'array<variant>')"))
    rows = bundles.select("name", entries.alias("e")).where(_path("e", "$.resource.resourceType", "string") == kind)
    return rows.select("name", *(_path("e", "$.resource" + path[1:], t).alias(c) for c, (path, t) in RESOURCES[kind].items()))


def extract_rows(raw: DataFrame, stem: str) -> DataFrame:
    rows = raw.where(F.col("source_table") == stem)
    text = {c: _path("row_data", f"$.{header}", "string") for c, (header, _) in EXTRACTS[stem].items()}
    return rows.select(*(F.nullif(text[c], F.lit("")).try_cast(t).alias(c) for c, (_, t) in EXTRACTS[stem].items()))


def hl7_patients(files: DataFrame) -> DataFrame:
    """name, patient_id, family, given, birth, sex of files with an ADT message."""
    from vitalspark.sources.files import hl7_segments

    rows = files.where("format = 'hl7v2'").select("name", hl7_segments(F.col("text")).alias("s")).where(F.exists("s", lambda x: (x[0] == "MSH") & F.coalesce(F.get(x, F.lit(8)), F.lit("")).startswith("ADT")))
    pid = rows.select("name", F.get(F.filter("s", lambda x: x[0] == "PID"), F.lit(0)).alias("p")).where("p IS NOT NULL")
    part = lambda i, k: F.nullif(F.get(F.split(F.get("p", F.lit(i)), r"\^"), F.lit(k)), F.lit(""))
    return pid.select("name", F.nullif(F.trim(F.get("p", F.lit(3))), F.lit("")).alias("patient_id"), part(5, 0).alias("family"), part(5, 1).alias("given"), F.get("p", F.lit(7)).alias("birth"), F.get("p", F.lit(8)).alias("sex"))


def hl7_observations(files: DataFrame) -> DataFrame:
    """name, place, code, display, value, unit, date of the observations in result messages (ORU) of HL7 files."""
    from vitalspark.sources.files import hl7_date, hl7_segments, unescape

    # Of the messages of a file only those of results tell observations: a segment belongs to the header before it.
    segments = hl7_segments(F.col("text"))
    kinds = F.aggregate(
        segments, F.array().cast("array<string>"),
        lambda done, x: F.concat(done, F.array(F.when(x[0] == "MSH", F.coalesce(F.get(x, F.lit(8)), F.lit(""))).otherwise(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(""))))),
    )
    rows = files.where("format = 'hl7v2'").select("name", F.posexplode(F.arrays_zip(segments.alias("s"), kinds.alias("kind"))).alias("place", "x"))
    rows = rows.select("name", "place", "x.s", "x.kind").where((F.col("s")[0] == "OBX") & F.col("kind").startswith("ORU"))
    code = F.split(F.get("s", F.lit(3)), r"\^")
    return rows.select("name", "place", F.get(code, F.lit(0)).alias("code"), unescape(F.get(code, F.lit(1))).alias("display"), unescape(F.get("s", F.lit(5))).alias("value"), F.get("s", F.lit(6)).alias("unit"), hl7_date(F.coalesce(F.get("s", F.lit(14)), F.lit(""))).alias("date"))
