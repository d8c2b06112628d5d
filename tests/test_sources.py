import json

import pytest
from pyspark.sql import functions as F

from vitalspark import types
from vitalspark.operators import notes as note_rules
from vitalspark.operators import quality_gate, reconcile, survival, therapy
from vitalspark.sources import files, sinks, staging, store, synthetic
from vitalspark.streaming import ingest as stream

BUNDLE = {
    "resourceType": "Bundle", "timestamp": "2021-01-01T00:00:00Z",
    "entry": [
        {"resource": {"resourceType": "Patient", "id": "x", "identifier": [{"system": "urn:other", "value": "no"}, {"system": "urn:patient-id", "value": "P1"}]}},
        {"resource": {"resourceType": "Condition", "onsetDateTime": "2020-05-06T01:00:00Z"}},
        {"resource": {"resourceType": "Condition", "code": {"coding": [{"system": "x/icd-o-3", "display": "Adeno"}, {"system": "x/icd-10-cm", "code": "C34.2"}]}}},
        {"resource": {"resourceType": "Observation", "code": {"coding": [{"system": "http://loinc.org", "code": "89247-1"}]}, "valueInteger": 1}},
        {"resource": {"resourceType": "Observation", "code": {"coding": [{"system": "http://loinc.org", "code": "718-7", "display": "Hgb"}]}, "valueQuantity": {"value": 12.5, "unit": "g/dL"}}},
        {"resource": {"resourceType": "MedicationAdministration", "medicationCodeableConcept": {"coding": [{"display": "Keytruda"}]}}},
    ],
}
HL7 = "MSH|^~\\&|a|b|c|d|ts||ADT^A01\r\nPID|1||P2||Doe^Jo||197001|M\rDG1|1||C34.11|NSCLC Squamous \\S\\ cell|20200203\nMSH|^~\\&|a|b|c|d|ts||ORU^R01\nOBX|1|NM|26464-8^WBC \\F\\ count^LN||4.5|10*3/uL\nRXA|0|1|20200301|20200301|40048^Carboplatin^RXN\n"
CSV = '﻿Patient_ID, loinc_code ,display,drug_class,ecog_at_advanced_diagnosis,histology,start_date\nP3,,"Alimta, new",chemo,,,2020-01-05\nP3,718-7,Hgb,,2.0,"a ""b""",2019-01-01\n\n,x,,,,,\nP4,,,,x,,\nP5,,,,,"adeno\ncarcinoma",2019-01-01\n'


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("files")
    for name, text in {"a.json": json.dumps(BUNDLE), "b.hl7": HL7, "c.csv": CSV, "d.json": "{bad", "e.json": '{"resourceType": "Bundle"}', "f.txt": "MSH|x", "g": "no format here", "h": "x,y\n1,2"}.items():
        (path / name).write_bytes(text.encode())
    return str(path)


def test_files(spark, folder):
    found = files.read(spark, folder)
    kinds = {r.name.rsplit("/", 1)[1]: r.format for r in found.collect()}
    assert kinds == {"a.json": "fhir", "b.hl7": "hl7v2", "c.csv": "csv", "d.json": "fhir", "e.json": "fhir", "f.txt": "hl7v2", "g": None, "h": "csv"}
    errors = {r.name.rsplit("/", 1)[1]: r.error for r in files.errors(found).collect()}
    assert errors == {"d.json": "not a bundle", "e.json": "no patient", "f.txt": "no patient", "g": "unknown format"}
    got = {r.pkey: (r.occurred_at, {k: v.value for k, v in r.columns.items()}) for r in files.records(found).collect()}
    assert got["P1"] == ("2020-05-06", {"lab_test_code": "718-7", "medication": "Keytruda", "diagnosis_code": "C34.2", "ecog_performance_status": "1", "tumor_histology_text": "Adeno"})
    assert got["P2"] == ("2020-02-03", {"lab_test_code": "26464-8", "medication": "Carboplatin", "diagnosis_code": "C34.11", "tumor_histology_text": "Squamous ^ cell"})
    assert got["P3"] == ("2020-01-05", {"lab_test_code": "718-7", "medication": "Alimta, new", "ecog_performance_status": "2", "tumor_histology_text": 'a "b"'}) and set(got) == {"P1", "P2", "P3", "P5"}
    assert got["P5"][1] == {"tumor_histology_text": "adeno\ncarcinoma"}
    assert files.tall(files.records(found)).count() == 14
    table = {r.patient_id: r for r in files.read_extract(spark, f"{folder}/c.csv").collect()}
    assert table["P5"].histology == "adeno\ncarcinoma" and table["P3"].histology == 'a "b"' and table["P4"].histology is None


def test_staging(spark, folder):
    found = files.read(spark, folder)
    raw = staging.raw_bundles(found)
    rows = {k: staging.resources(raw, k).collect() for k in staging.RESOURCES}
    assert len(rows["Observation"]) == 2 and rows["Observation"][1].value == 12.5 and rows["Patient"][0].patient_id == "x" and rows["Encounter"] == []
    assert staging.hl7_patients(found).first().family == "Doe" and staging.hl7_observations(found).first().display == "WBC | count"
    table = spark.createDataFrame([("o1", "p", "718-7", "Hgb", "12.5", "")], "observation_id string, patient_id string, loinc_code string, display string, value string, unit string")
    one = staging.extract_rows(staging.raw_extract(table, "observations"), "observations").first()
    assert one.value == 12.5 and one.unit is None


@pytest.fixture
def dictionary(spark):
    rows = [("hemoglobin", "text", "", [], None, None, None, None), ("note", "integer", "", [], None, None, None, None), ("diagnosis_code", "coded_value", "", [], None, None, None, "icd")]
    return spark.createDataFrame(rows, types.DICTIONARY)


def tall(spark, rows):
    return spark.createDataFrame([("ws", p, s, x, t, c, v, "text", "") for p, s, x, t, c, v in rows], types.TALL)


def test_store(spark, tmp_path, dictionary):
    s = store.Store(spark, str(tmp_path))
    s.replace("dictionary", dictionary)
    rows = [("p", "s", "x1", "2020-01-01", "lab", "718-7"), ("p", "s", "x2", "2020-01-02", "note", "many"), ("p", "s", "x2", "2020-01-02", "other", "1"), ("p", "s", "x3", "2020-01-03", "dx", "C34.2")]
    tallies = {r.key: r.n for r in store.ingest(s, tall(spark, rows), reconcile.rule_router(dictionary)).collect()}
    assert tallies == {"lookup": 2, "rule": 2, "normalizer": 1, "verdict:join": 4, "verdict:append": 1}
    first = {r.source_column: r.id for r in s.table("decisions").where("decided_by <> 'normalizer'").collect()}
    again = {r.key: r.n for r in store.ingest(s, tall(spark, rows), reconcile.rule_router(dictionary)).collect()}
    assert again == tallies and {r.source_column: r.id for r in s.table("decisions").where("decided_by <> 'normalizer'").collect()} == first
    assert s.table("decisions").where("needs_review").first().source_column == "note"
    merged = {r.canonical_name: r.value for r in s.merged().collect()}
    assert merged["hemoglobin"] == "718-7" and merged["other"] == "1" and "note" not in merged and json.loads(merged["diagnosis_code"])["system"] == "icd"
    assert s.table("signals").count() == 3 and s.latest_row().first().external_id == "x3" and [r.external_id for r in s.timeline("p", "2020-01-02").collect()] == ["x3", "x2"]
    assert {r.canonical_name: r.data_type for r in s.table("schema_rows").collect()}["note"] == "integer"
    assert all(r.status == "PASS" for r in quality_gate.run({n: s.table(n) for n in store.Store.SCHEMAS}, quality_gate.STORE_CHECKS).collect())
    s.reset()
    assert s.table("decisions").count() == s.table("signals").count() == 0


def test_offline(spark, tmp_path, dictionary):
    s = store.Store(spark, str(tmp_path))
    rows = [("p", "s", "x1", "2020-01-01", "lab", "718-7"), ("p", "s", "x1", "2020-01-01", "other", "1")]
    assert {r.key: r.n for r in store.ingest(s, tall(spark, rows)).collect()} == {"lookup": 1, "verdict:join": 1}
    kept, held = reconcile.offline(tall(spark, rows))
    assert [r.source_column for r in held.collect()] == ["other"] and kept.count() == 1


def test_unsound_verdicts_are_unclear(spark):
    rows = [("join", "a", 0.9), ("join", None, 0.9), ("maybe", "a", 0.9), ("append", "a", 1.5), (None, "a", 0.1), ("unclear", None, 0.2)]
    got = reconcile.sound_verdicts(spark.createDataFrame(rows, "verdict string, canonical_name string, similarity_score double")).collect()
    assert [r.verdict for r in got] == ["join"] + ["unclear"] * 5


def test_stream(spark, tmp_path, dictionary):
    s = store.Store(spark, str(tmp_path / "store"))
    s.replace("dictionary", dictionary)
    for i in range(2):
        tall(spark, [("p", "s", f"x{i}", f"2020-01-0{i + 1}", "lab", "718-7")]).write.mode("append").parquet(str(tmp_path / "in"))
        query = stream.start(stream.tall_stream(spark, str(tmp_path / "in")), s, str(tmp_path / "check"))
        assert query.awaitTermination(120) and query.exception() is None
    assert s.table("decisions").count() == 1 and s.table("signals").count() == 2


@pytest.fixture(scope="module")
def people(spark):
    return synthetic.patients(spark, 200).cache()


def test_synthetic_invariants(spark, people):
    share = lambda test: people.where(test).count() / 200
    assert 0.05 <= share("egfr_status = 'positive'") <= 0.25 and 0.15 <= share("kras_status = 'positive'") <= 0.35 and 0.15 <= share("pdl1_status = 'high'") <= 0.45 and 0.2 <= share("vital_status = 'deceased'") <= 0.4
    meds, progs = synthetic.medications(people), synthetic.progressions(people)
    assert 0.55 <= meds.select("patient_id").distinct().count() / 200 <= 0.85
    text = meds.select("patient_id", "display", F.lit(None).cast("string").alias("drug_name"), F.lit(None).cast("string").alias("medication_code"), "start_date", "end_date", "drug_class")
    lines = therapy.lines_of_therapy(therapy.administrations(text), therapy.progressions(progs), people.where("dead").select("patient_id", F.col("date_of_death").cast("date").alias("death_date")))
    first = people.withColumn("initial_nsclc_diagnosis_date", F.col("advanced_diagnosis_date"))
    tables = {"patients": first, "progressions": progs, "medications": meds, "biomarkers": synthetic.biomarkers(people), "lines": lines, "survival": survival.survival_records(people)}
    assert all(r.status == "PASS" for r in quality_gate.run(tables, quality_gate.COHORT_CHECKS).collect())
    assert therapy.validate(lines, people.select("patient_id", F.col("dx").alias("index_date"))).count() == 0
    assert sorted(map(str, synthetic.patients(spark, 50).repartition(7).collect())) == sorted(map(str, synthetic.patients(spark, 50).collect())) and synthetic.manifest(people).first().n_patients == 200
    found = {r.patient_id: r for r in note_rules.abstract(synthetic.note_texts(people)).collect()}
    assert all(found[r.patient_id].stage == r.stage_at_advanced_diagnosis and found[r.patient_id].ecog == r.ecog_at_advanced_diagnosis and found[r.patient_id].histology in (r.histology, None) and found[r.patient_id].egfr_status == r.egfr_status for r in people.collect())


def test_sinks_round_trip(spark, people, tmp_path):
    some = people.limit(5)
    tables = synthetic.conditions(some), synthetic.observations(some), synthetic.medications(some)
    texts = sinks.bundles(some, *tables).select(F.concat("patient_id", F.lit(".json")).alias("name"), F.col("bundle").alias("text"), F.lit("fhir").alias("format"))
    hl7 = sinks.hl7_messages(some, *tables).select(F.concat("patient_id", F.lit(".hl7")).alias("name"), F.col("message").alias("text"), F.lit("hl7v2").alias("format"))
    for made in (texts, hl7):
        got = {r.pkey: {k: v.value for k, v in r.columns.items()} for r in files.records(made).collect()}
        for r in some.collect():
            assert got[r.patient_id]["diagnosis_code"] == "C34.11" and got[r.patient_id]["tumor_histology_text"] == r.histology and got[r.patient_id]["lab_test_code"] == "2160-0"
    sinks.write_extracts({"patients": some, "progressions": synthetic.progressions(people)}, str(tmp_path))
    back = spark.read.option("header", "true").csv(str(tmp_path / "progressions"))
    assert back.first().new_metastatic_sites == "bone|liver" and spark.read.option("header", "true").csv(str(tmp_path / "patients")).count() == 5
    sinks.write_json(some, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 5


def test_notes_source(spark, tmp_path):
    for who, name, text in (("P1", "progress_note", "b"), ("P1", "initial_consult", "a"), ("_x", "n", "c"), (".y", "n", "c"), ("P2", "n", "  ")):
        (tmp_path / who / "notes").mkdir(parents=True, exist_ok=True)
        (tmp_path / who / "notes" / f"{name}.txt").write_text(text)
    assert [tuple(r) for r in files.notes(spark, str(tmp_path)).orderBy("note_order").collect()] == [("P1", "initial_consult", "a", 1), ("P1", "progress_note", "b", 2)]


def test_cohort_folder(spark, people, tmp_path):
    from vitalspark import derive

    sinks.write_extracts({"patients.csv": people, "medication_administrations.csv": synthetic.medications(people)}, str(tmp_path))
    found = derive.derive(spark, str(tmp_path))
    one = found.summary.first()
    assert one.n_patients == 200 and 100 < one.n_treated < 180 and found.warnings.count() == 0 and found.records.count() == 200
    assert found.first_line_classes.agg(F.sum("n")).first()[0] == one.n_treated
    with pytest.raises(FileNotFoundError):
        derive.derive(spark, str(tmp_path / "nothing"))
