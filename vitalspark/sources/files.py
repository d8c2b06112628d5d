"""Files of any supported format read as rows of source records, and their columns as tall values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitalspark.session import scratch_folder

#: Formats, the labels of their sources, and code systems and codes that are looked for.
LABELS = {"fhir": "epic_fhir_r4", "hl7v2": "legacy_hl7v2", "csv": "registry_csv_export"}
LOINC_SYSTEM, ECOG_CODE, HISTOLOGY_PREFIX = "http://loinc.org", "89247-1", "NSCLC "
#: Headers that date a row of a flat extract, first one first.
DATE_HEADERS = ("observation_date", "start_date", "onset_date", "advanced_diagnosis_date", "result_date", "event_date")
#: Ingest column -> (type, description).
COLUMNS = {
    "lab_test_code": ("coded_value", "Coded lab result"),
    "medication": ("coded_value", "Administered systemic therapy"),
    "diagnosis_code": ("coded_value", "Primary cancer diagnosis (ICD-10-CM)"),
    "ecog_performance_status": ("integer", "Clinician-recorded performance status"),
    "tumor_histology_text": ("text", "Free-text histology from the pathology narrative"),
}
FIELDS = "name string, pkey string, source string, external_id string, occurred_at string"


def read(spark: SparkSession, path: str) -> DataFrame:
    """name, text, format of each file; of one whose format can't be told, format is null."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("name"), F.decode("content", "UTF-8").alias("text"))
    return files.withColumn("format", detect(F.col("name"), F.col("text")))


def detect(name: Column, text: Column) -> Column:
    """Format by extension, else by the first 4096 characters."""
    name, head = F.lower(name), F.ltrim(F.left(text, F.lit(4096)))
    bundle = F.get_json_object(text, "$.resourceType") == "Bundle"
    return (
        F.when(name.endswith(".json"), "fhir").when(name.endswith(".hl7") | name.endswith(".hl7v2"), "hl7v2").when(name.endswith(".csv"), "csv")
        .when(head.rlike(r"^[{\[]") & bundle, "fhir").when(head.startswith("MSH|"), "hl7v2").when(F.contains(F.split(head, r"\r\n|\r|\n")[0], F.lit(",")), "csv")
    )


def staged(files: DataFrame) -> DataFrame:
    """name, text, format as written to a scratch folder: files are read, or made, once, however many formats and errors are looked for in them; of other formats little more is read than the format."""
    folder = scratch_folder(files.sparkSession)
    files.select("name", "text", "format").write.parquet(folder)
    return files.sparkSession.read.schema("name string, text string, format string").parquet(folder)


def _kept(rows: DataFrame, test: Column) -> DataFrame:
    """rows.where(test) with each column made once: a filter is pushed below what makes the columns, and makes there again what it asks for."""
    return rows.select(F.inline(F.when(test, F.array(F.struct(*rows.columns)))))


def _record(rows: DataFrame, label: str) -> DataFrame:
    """Rows (name, pkey, occurred_at, loinc, lab_display, drug, icd10, ecog, histology) as source records with their columns."""
    values = {"lab_test_code": "loinc", "medication": "drug", "diagnosis_code": "icd10", "ecog_performance_status": "ecog", "tumor_histology_text": "histology"}
    described = lambda c: F.concat(F.lit("Coded lab result ("), F.coalesce("lab_display", "loinc"), F.lit(")")) if c == "lab_test_code" else F.lit(COLUMNS[c][1])
    entries = [F.struct(F.lit(c).alias("key"), F.struct(F.nullif(F.col(v).cast("string"), F.lit("")).alias("value"), F.lit(COLUMNS[c][0]).alias("source_data_type"), described(c).alias("source_description")).alias("value")) for c, v in values.items()]
    columns = F.map_from_entries(F.filter(F.array(*entries), lambda x: x["value"]["value"].isNotNull()))
    source = F.lit(LABELS[label])
    return _kept(rows.select("name", "pkey", source.alias("source"), F.concat(source, F.lit(":"), "pkey").alias("external_id"), "occurred_at", columns.alias("columns")), F.size("columns") > 0)


#: SQL: a bundle's resources in order, as variants with their types.
_RESOURCES = "transform(transform(coalesce(try_variant_get(bundle, '$.entry', 'array<variant>'), array()), e -> try_variant_get(e, '$.resource', 'variant')), r -> named_struct('kind', try_variant_get(r, '$.resourceType', 'string'), 'x', r))"


def _resources(of: str, **fields: str) -> Column:
    """Array of the fields, SQL over the variant x, of a bundle's resources of a type, in order."""
    made = ", ".join(f"'{k}', {v}" for k, v in fields.items())
    return F.expr(f"transform(transform(filter(resources, r -> r.kind = '{of}'), r -> r.x), x -> named_struct({made}))")


def _first(rows: str, test: str, value: str) -> Column:
    """A value of the first element of an array that passes a test; both are SQL over x."""
    return F.expr(f"get(transform(filter({rows}, x -> {test}), x -> {value}), 0)")


def _coding(concept: str, system: str, field: str) -> str:
    """SQL: a field of a concept's first coding whose system contains a text."""
    codings = f"coalesce(try_variant_get(x, '{concept}.coding', 'array<struct<system:string,code:string,display:string>>'), array())"
    return f"get(filter({codings}, c -> contains(coalesce(c.system, ''), '{system}')), 0).{field}"


def fhir_records(files: DataFrame) -> DataFrame:
    """At most one source record of each bundle; files that aren't bundles, or name no patient, give none (see errors())."""
    rows = _kept(_bundles(files), F.expr("is_bundle AND pkey IS NOT NULL"))
    icd, icdo = _coding("$.code", "icd-10", "code"), f"coalesce(nullif({_coding('$.code', 'icd-o-3', 'display')}, ''), try_variant_get(x, '$.code.text', 'string'))"
    loinc = f"get(filter(coalesce(try_variant_get(x, '$.code.coding', 'array<struct<system:string,code:string,display:string>>'), array()), c -> contains(coalesce(c.system, ''), '{LOINC_SYSTEM}')), 0)"
    codings = "coalesce(try_variant_get(x, '$.medicationCodeableConcept.coding', 'array<struct<display:string>>'), array())"
    drug = f"coalesce(nullif(try_variant_get(x, '$.medicationCodeableConcept.text', 'string'), ''), get(filter(transform({codings}, c -> c.display), d -> d <> ''), 0))"
    # What is looked at of each resource is read from its variant once.
    rows = rows.select(
        "name", "pkey", F.try_variant_get("bundle", "$.timestamp", "string").alias("stamp"),
        _resources("Condition", onset="try_variant_get(x, '$.onsetDateTime', 'string')", icd=icd, icdo=icdo).alias("conditions"),
        _resources("Observation", loinc=loinc, measured="try_variant_get(x, '$.valueQuantity', 'variant') IS NOT NULL", n="try_variant_get(x, '$.valueInteger', 'int')").alias("observations"),
        _resources("MedicationAdministration", drug=drug).alias("medications"),
    )
    known, lab = "coalesce(nullif(x.icd, ''), nullif(x.icdo, '')) IS NOT NULL", "x.measured AND nullif(x.loinc.code, '') IS NOT NULL"
    rows = rows.select(
        "name", "pkey", F.coalesce(F.left(_first("conditions", "x.onset <> ''", "x.onset"), F.lit(10)), F.left("stamp", F.lit(10)), F.lit("")).alias("occurred_at"),
        _first("observations", lab, "x.loinc.code").alias("loinc"), _first("observations", lab, "x.loinc.display").alias("lab_display"), _first("medications", "x.drug IS NOT NULL", "x.drug").alias("drug"),
        _first("conditions", known, "x.icd").alias("icd10"), _first("conditions", known, "x.icdo").alias("histology"),
        _first("observations", f"x.loinc.code = '{ECOG_CODE}' AND x.n IS NOT NULL", "x.n").alias("ecog"),
    )
    return _record(rows, "fhir")


def _bundles(files: DataFrame) -> DataFrame:
    rows = files.where("format = 'fhir'").select("name", F.try_parse_json("text").alias("bundle"))
    rows = rows.withColumn("resources", F.expr(_RESOURCES))
    ids = "coalesce(try_variant_get(x, '$.identifier', 'array<struct<system:string,value:string>>'), array())"
    rows = rows.withColumn("patient", F.get(_resources("Patient", ids=ids, id="try_variant_get(x, '$.id', 'string')"), F.lit(0)))
    pkey = F.expr("coalesce(get(transform(filter(patient.ids, i -> contains(coalesce(i.system, ''), 'patient-id') AND i.value <> ''), i -> i.value), 0), nullif(patient.id, ''))")
    return rows.withColumns({"pkey": pkey, "is_bundle": F.coalesce(F.try_variant_get("bundle", "$.resourceType", "string") == "Bundle", F.lit(False))})


def unescape(value: Column) -> Column:
    """HL7 escapes for a bar, a caret and a line break."""
    for escape, plain in (("\\F\\", "|"), ("\\S\\", "^"), ("\\X000D\\", "\n")):
        value = F.replace(value, F.lit(escape), F.lit(plain))
    return value


def hl7_date(value: Column) -> Column:
    digits = F.left(F.trim(value), F.lit(8))
    return F.when(digits.rlike(r"^\d{8}$"), F.concat_ws("-", F.left(digits, F.lit(4)), F.substring(digits, 5, 2), F.substring(digits, 7, 2))).otherwise("")


def hl7_segments(text: Column) -> Column:
    """Array of segments, each the array of its fields, without blank lines."""
    lines = F.filter(F.transform(F.split(text, r"\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(lines, lambda x: F.split(x, r"\|"))


def hl7_fields(segments: Column) -> Column:
    """struct(pkey, icd10, histology, occurred_at, loinc, lab_display, drug): the first segment of each kind that tells."""

    def first(kind: str, test, value) -> Column:
        return F.get(F.transform(F.filter(segments, lambda s: (s[0] == kind) & test(s)), value), F.lit(0))

    def field(s: Column, i: int) -> Column:
        return F.coalesce(F.get(s, F.lit(i)), F.lit(""))

    def component(s: Column, i: int, k: int) -> Column:
        return F.get(F.split(field(s, i), r"\^"), F.lit(k))

    # Diagnoses are read until one has a code: of those, the last description and the first date.
    dg1 = F.filter(segments, lambda s: s[0] == "DG1")
    coded = F.transform(dg1, lambda s: F.trim(field(s, 3)) != "")
    until = F.when(F.array_contains(coded, True), F.array_position(coded, True).cast("int")).otherwise(F.size(dg1))
    read = F.slice(dg1, 1, until)
    words = F.filter(F.transform(read, lambda s: F.trim(unescape(field(s, 4)))), lambda x: x != "")
    phrase = F.try_element_at(words, F.lit(-1))
    day = F.get(F.filter(F.transform(read, lambda s: hl7_date(field(s, 5))), lambda x: x != ""), F.lit(0))
    some_obx = lambda s: F.coalesce(component(s, 3, 0) != "", F.lit(False))
    return F.struct(
        first("PID", lambda s: F.trim(field(s, 3)) != "", lambda s: F.trim(field(s, 3))).alias("pkey"),
        first("DG1", lambda s: F.trim(field(s, 3)) != "", lambda s: F.trim(field(s, 3))).alias("icd10"),
        F.when(phrase.startswith(HISTOLOGY_PREFIX), F.substr(phrase, F.lit(len(HISTOLOGY_PREFIX) + 1))).otherwise(phrase).alias("histology"),
        F.coalesce(day, F.lit("")).alias("occurred_at"),
        first("OBX", some_obx, lambda s: F.trim(component(s, 3, 0))).alias("loinc"),
        first("OBX", some_obx, lambda s: F.trim(unescape(component(s, 3, 1)))).alias("lab_display"),
        first("RXA", lambda s: F.coalesce(component(s, 5, 1) != "", F.lit(False)), lambda s: F.trim(unescape(component(s, 5, 1)))).alias("drug"),
    )


def hl7_records(files: DataFrame) -> DataFrame:
    rows = files.where("format = 'hl7v2'").select("name", hl7_segments(F.col("text")).alias("segments"))
    rows = _kept(rows.select("name", hl7_fields(F.col("segments")).alias("f")), F.col("f.pkey").isNotNull())
    return _record(rows.select("name", "f.*", F.lit(None).cast("int").alias("ecog")), "hl7v2")


_CELL = r'(?:"(?:[^"]++|"")*+"[^,\r\n]*+|"[^\r\n]*+|[^",\r\n][^,\r\n]*+)?+'
#: A line of a flat extract: cells, of which quoted ones may hold commas, doubled quotes and line breaks.
LINE = f"{_CELL}(?:,{_CELL})*+"


def csv_cells(line: Column | str) -> Column:
    """Array of the trimmed cells of a line of a flat extract, without their quotes."""
    cells = F.regexp_extract_all(line, F.lit(f"(?:^|,)({_CELL})"), F.lit(1))
    plain = F.transform(cells, lambda x: F.when(x.startswith('"'), F.replace(F.regexp_replace(x, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(x))
    return F.transform(plain, lambda x: F.trim(x))


#: Files of flat extracts up to which their headers are broadcast.
FEW_FILES = 100_000


def csv_rows(files: DataFrame) -> DataFrame:
    """name, line (its place), row (map of lower-case header to trimmed value) of flat extracts; a byte order mark is no part of the first header.

    A file's lines are dealt over tasks, each with its file's header; a file is one value of Spark's, so of 2 GB at most: splits.read_extract_rows() takes larger ones, in parts.
    """
    text = F.regexp_replace("text", "^\ufeff", "")
    lines = files.where("format = 'csv'").select("name", "text").repartition("name")
    lines = _kept(lines.select("name", F.filter(F.regexp_extract_all(text, F.lit(LINE), F.lit(0)), lambda x: F.trim(x) != "").alias("lines")), F.size("lines") > 0)
    lines = lines.select("name", F.transform(csv_cells(F.get("lines", F.lit(0))), F.lower).alias("head"), "lines")  # made before lines are rows: once for a file
    lines = lines.select("name", "head", F.posexplode("lines").alias("line", "text")).where("line > 0")
    body = lines.repartition("name", "line").withColumn("cells", csv_cells("text"))
    return body.select("name", "line", F.map_from_entries(F.filter(F.arrays_zip("head", "cells"), lambda x: x["head"].isNotNull())).alias("row"))


def read_extract(spark: SparkSession, path: str) -> DataFrame:
    """A flat extract of any size as a table of text columns, its headers trimmed and in lower case; empty cells are null.  Only files without line breaks in cells are split over tasks by Spark."""
    rows = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').option("ignoreLeadingWhiteSpace", "true").option("ignoreTrailingWhiteSpace", "true").csv(path)
    return rows.toDF(*(c.strip().lstrip("\ufeff").lower() for c in rows.columns))


def csv_records(files: DataFrame) -> DataFrame:
    """One source record of each patient of a file: the first value that isn't empty of each field, in the file's order."""
    return extract_records(csv_rows(files))


def extract_records(rows: DataFrame) -> DataFrame:
    """csv_records() of rows (name, line, row)."""
    row = F.col("row")

    def cell(c: str) -> Column:
        return F.nullif(F.try_element_at(row, F.lit(c)), F.lit(""))

    drug_file = F.map_contains_key(row, "rxnorm_code") | F.map_contains_key(row, "drug_class")
    ecog = cell("ecog_at_advanced_diagnosis").try_cast("double").try_cast("int")
    values = {
        "loinc": F.when(cell("loinc_code").isNotNull(), F.struct(cell("loinc_code").alias("a"), cell("display").alias("b"))),
        "drug": F.when(drug_file, cell("display")),
        "icd10": F.coalesce(cell("icd10_code"), cell("condition_code")),
        "ecog": ecog,
        "histology": cell("histology"),
        "occurred_at": F.coalesce(*map(cell, DATE_HEADERS)),
    }
    rows = rows.select("name", "line", cell("patient_id").alias("pkey"), *(v.alias(k) for k, v in values.items())).where("pkey IS NOT NULL")
    first = rows.groupBy("name", "pkey").agg(*(F.min_by(k, F.when(F.col(k).isNotNull(), F.col("line"))).alias(k) for k in values))
    return _record(first.select("name", "pkey", F.col("loinc.a").alias("loinc"), F.col("loinc.b").alias("lab_display"), "drug", "icd10", "ecog", "histology", F.coalesce("occurred_at", F.lit("")).alias("occurred_at")), "csv")


def records(files: DataFrame) -> DataFrame:
    """Source records of all files."""
    return fhir_records(files).unionByName(hl7_records(files)).unionByName(csv_records(files))


def errors(files: DataFrame) -> DataFrame:
    """name, error of files that can't be read; the others aren't touched by them."""
    unknown = files.where("format IS NULL").select("name", F.lit("unknown format").alias("error"))
    bundles = _bundles(files)
    bad = bundles.where("NOT is_bundle").select("name", F.lit("not a bundle")).union(bundles.where("is_bundle AND pkey IS NULL").select("name", F.lit("no patient")))
    nobody = files.where("format = 'hl7v2'").select("name", hl7_fields(hl7_segments(F.col("text")))["pkey"].alias("p")).where("p IS NULL").select("name", F.lit("no patient"))
    return unknown.union(bad).union(nobody)


def line_errors(rows: DataFrame) -> DataFrame:
    """name, line, error of lines of flat extracts (name, line, row) of which something can't be taken; the rest of such a line is.

    A line without a patient is left out whole; a cell that is no number leaves its line without the ECOG.
    """
    row = F.col("row")
    ecog = F.nullif(F.try_element_at(row, F.lit("ecog_at_advanced_diagnosis")), F.lit(""))
    error = F.when(F.coalesce(F.try_element_at(row, F.lit("patient_id")), F.lit("")) == "", "no patient").when(ecog.isNotNull() & ecog.try_cast("double").try_cast("int").isNull(), "ECOG is no number")
    return rows.select("name", "line", error.alias("error")).where("error IS NOT NULL")


def tall(found: DataFrame, workspace: str = "default") -> DataFrame:
    """One row for each value of source records: what routing works on."""
    return found.select(F.lit(workspace).alias("workspace_key"), "pkey", "source", "external_id", "occurred_at", F.explode("columns").alias("source_column", "x")).select("workspace_key", "pkey", "source", "external_id", "occurred_at", "source_column", "x.value", "x.source_data_type", "x.source_description")


def notes(spark: SparkSession, path: str) -> DataFrame:
    """patient_id, note_name, note_order, text of <patient>/notes/*.txt; folders whose name starts with a dot or underscore, and blank notes, are left out."""
    rows = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    part = F.regexp_extract("file", r"/([^/]+)/notes/([^/]+)\.txt$", 1)
    rows = rows.select(part.alias("patient_id"), F.regexp_extract("file", r"/notes/([^/]+)\.txt$", 1).alias("note_name"), "text").where("patient_id <> '' AND patient_id NOT LIKE '.%' AND patient_id NOT LIKE '\\\\_%' AND trim(text) <> ''")
    return rows.withColumn("note_order", F.row_number().over(Window.partitionBy("patient_id").orderBy("note_name")))
