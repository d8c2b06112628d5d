import json

import pytest
from pyspark.sql import functions as F

from vitalspark import types
from vitalspark.operators import definition
from vitalspark.sources import readers, store


def test_definition(spark, tmp_path):
    rows = spark.createDataFrame([(1, 40, "adeno", "positive"), (2, None, "adeno", None), (3, 70, "squamous", "negative"), (4, 50, None, "positive")], "id int, age int, histology string, egfr_status string")
    ids = lambda tree: [r.id for r in definition.select(rows, tree).orderBy("id").collect()]
    assert ids({"all": []}) == [1, 2, 3, 4] and ids({"any": []}) == [] and ids({"field": "histology", "in": []}) == []
    assert ids({"field": "age", "between": [40, 50]}) == [1, 4] and ids({"field": "age", "between": [None, None]}) == [1, 3, 4] and ids({"field": "age", "known": False}) == [2]
    assert ids({"not": {"field": "egfr_status", "in": ["positive"]}}) == [2, 3]
    flat = {"age_range": [30, 60], "histology": ["adeno", "squamous"], "egfr_status": [], "n_patients": 1}
    assert ids(definition.from_state(flat)) == [1]
    (tmp_path / "flat.json").write_text(json.dumps(flat, indent=2))
    assert definition.load(spark, str(tmp_path / "flat.json")) == (definition.from_state(flat), 1)
    definition.save(spark, definition.from_state(flat), str(tmp_path / "tree"), 1)
    assert definition.load(spark, str(tmp_path / "tree")) == (definition.from_state(flat), 1)
    with pytest.raises(ValueError):
        definition.save(spark, {"field": "age"}, str(tmp_path / "bad"))


def test_jsonl(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"patient_id": "p", "n": 1}\n\n{bad\n{"patient_id": "q", "n": "x"}\n{"other": 1}\n')
    good, bad = readers.read_jsonl(spark, str(tmp_path / "r.jsonl"), "patient_id string, n int")
    assert sorted(map(tuple, good.collect()), key=str) == [("p", 1), (None, None)] and bad.count() == 2


def test_load_bundle(spark, tmp_path):
    (tmp_path / "fhir").mkdir()
    for name, text in {"a": '{"resourceType": "Bundle", "entry": []}', "b": "{not: valid json", "c": "", "d": '{"resourceType": "Patient"}'}.items():
        (tmp_path / "fhir" / f"{name}.json").write_text(text)
    got = {i: readers.load_bundle(spark, i, str(tmp_path)) for i in "abcde"}
    assert {i: s for i, (s, _) in got.items()} == {"a": "found", "b": "malformed", "c": "empty", "d": "no bundle", "e": "missing"}
    assert json.loads(got["a"][1])["resourceType"] == "Bundle" and all(b is None for i, (_, b) in got.items() if i != "a")


def test_load_patients(spark, tmp_path):
    for name, text in {"none": "patient_id,sex\n", "some": 'patient_id,note\np1,"two\nlines"\np2,x\n'}.items():
        (tmp_path / name / "csv").mkdir(parents=True)
        (tmp_path / name / "csv" / "patients.csv").write_text(text)
    none, some, absent = (str(tmp_path / x) for x in ("none", "some", "absent"))
    found = readers.load_patients(spark, absent, none, some)
    assert found.origin == some and sorted(r.patient_id for r in found.rows.collect()) == ["p1", "p2"]
    built_in = readers.load_patients(spark, absent, none)
    assert built_in.origin == "built-in" and built_in.rows.count() == readers.BUILT_IN and readers.load_patients(spark).rows.count() > 0


def test_load_decisions(spark, tmp_path):
    kept = store.Store(spark, str(tmp_path / "store"))
    row = ("i", "w", "p", "s", "c", "text", "", [], "join", "n", False, 0.5, 'says "a, b"', False, "lookup")
    rows = spark.createDataFrame([row], types.DECISION.rpartition(", ")[0]).withColumn("decided_at", F.lit("2024-01-02 03:04:05").cast("timestamp"))
    kept.append_decisions(rows)
    from_store = readers.load_decisions(spark, str(tmp_path / "no.csv"), kept)
    readers.write_snapshot(rows.withColumn("decided_at", F.col("decided_at").cast("string")), str(tmp_path / "d.csv"))
    from_csv = readers.load_decisions(spark, str(tmp_path / "d.csv"), kept)
    assert (from_store.origin, from_csv.origin) == ("store", "snapshot") and from_store.rows.collect() == from_csv.rows.collect()
