import json
import time

from pyspark.sql import functions as F

from vitalspark.operators import external, write_gate
from vitalspark.sources import core
from vitalspark.sources.versions import VersionedTable

QUICK = external.Policy(backoff=0.0, tasks=2, timeout=5.0)


class Logged:
    """Writes down each call; fails as the texts say."""

    def __init__(self, path):
        self.path = str(path)

    def __call__(self, text):
        with open(self.path, "a") as f:
            f.write(text + "\n")
        if text.startswith("slow"):
            time.sleep(3)
        if text.startswith("never"):
            raise ConnectionError("down")
        if text.startswith("bad"):
            raise KeyError(text)
        return text.upper()


def calls(path):
    return sorted(path.read_text().split("\n")[:-1]) if path.exists() else []


def test_each_text_is_asked_for_once(spark, tmp_path):
    log = tmp_path / "calls"
    kept = external.answers_table(spark, str(tmp_path / "answers"), 2)
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, ""), (6, "never"), (7, "bad")], "id long, text string")
    ask = lambda rows: {r.id: (r.answer, r.error and r.error.split(":")[0], r.attempts) for r in external.ask(rows, "upper/1", Logged(log), kept, QUICK).collect()}
    want = {1: ("A", None, 1), 2: ("B", None, 1), 3: ("A", None, 1), 4: (None, None, None), 5: ("", None, 1), 6: (None, "ConnectionError", 3), 7: (None, "KeyError", 1)}
    assert ask(rows) == want and calls(log) == ["", "a", "b", "bad", "never", "never", "never"]
    log.unlink()
    more = rows.union(spark.createDataFrame([(8, "c")], rows.schema))
    assert ask(more) == want | {8: ("C", None, 1)} and calls(log) == ["bad", "c", "never", "never", "never"]
    log.unlink()
    external.ask(rows.where("id < 6"), "upper/2", Logged(log), kept, QUICK)  # another service: nothing is known of it
    assert calls(log) == ["", "a", "b"]
    assert ask(rows.limit(0)) == {}


def test_timeout_and_waves(spark, tmp_path):
    kept = external.answers_table(spark, str(tmp_path / "answers"), 2)
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(20)] + [(99, "slow")], "id long, text string")
    got = {r.id: r for r in external.ask(rows, "x", Logged(tmp_path / "calls"), kept, QUICK._replace(timeout=0.5, attempts=2, wave=6)).collect()}
    assert got[99].error.startswith("TimeoutError") and got[99].attempts == 2 and all(got[i].answer == f"T{i}" for i in range(20))
    assert len(kept.history()) == 4  # a commit for each wave


def test_backoff_doubles(monkeypatch):
    slept = []
    monkeypatch.setattr(external.time, "sleep", slept.append)
    assert external.attempt(Logged("/dev/null"), "never", external.Policy()) == (None, "ConnectionError: down", 3) and slept == [0.5, 1.0]


def test_gate(spark, tmp_path):
    schema = "id string, a string, n int, flag boolean"
    c = write_gate.Constraints({"flag": "false"}, ("id", "a"), {"n is negative": "n >= 0"}, (("id",), ("a", "n")), ("n", "id"))
    table, quarantine = VersionedTable(spark, str(tmp_path / "t"), schema, ("id",), 2), VersionedTable(spark, str(tmp_path / "q"), f"{schema}, reasons array<string>")
    first = [("1", "x", 1, None), ("2", "x", 2, True), (None, "y", 3, None), ("3", None, -1, None), ("1", "z", 9, None), ("4", "x", 1, None), ("5", "w", None, None), ("6", "w", None, None)]
    assert write_gate.write(table, quarantine, spark.createDataFrame(first, schema), c, str(tmp_path / "s1")) == {"written": 4, "rejected": 4}
    assert sorted(map(tuple, table.read().collect())) == [("1", "x", 1, False), ("2", "x", 2, True), ("5", "w", None, False), ("6", "w", None, False)]
    assert {(r.id, r.a, *r.reasons) for r in quarantine.read().collect()} == {(None, "y", "id is missing"), ("3", None, "a is missing", "n is negative"), ("1", "z", "id stands twice"), ("4", "x", "a, n stands twice")}
    second = [("1", "q", 1, None), ("7", "x", 2, None), ("8", "new", 2, None)]
    assert write_gate.write(table, quarantine, spark.createDataFrame(second, schema), c, str(tmp_path / "s2")) == {"written": 1, "rejected": 2}
    assert {(r.id, *r.reasons) for r in quarantine.read().where("id in ('1', '7') AND a <> 'z'").collect()} == {("1", "id is taken"), ("7", "a, n is taken")}
    assert write_gate.write(table, quarantine, spark.createDataFrame([], schema), c, str(tmp_path / "s3")) == {"written": 0, "rejected": 0}


def test_core_load(spark, tmp_path):
    whole = {
        "patient_id": "p1", "source_format": "fhir", "date_of_birth": "1950-01-02", "date_of_death": None, "sex": "F", "ecog_at_advanced_diagnosis": 1, "pdl1_tps_value": 12.5, "advanced_diagnosis_date": "2020-02-03", "not_in_the_schema": {"x": 1},
        "drug_administrations": [{"medication_id": "m1", "rxnorm_code": "40048", "display": "carboplatin", "start_date": "2020-03-01", "dose_value": 5, "dose_unit": "AUC"}, {"medication_id": "m2", "rxnorm_code": None, "display": "x"}],
        "progression_events": [{"progression_id": "g1", "event_date": "2020-09-01", "new_metastatic_sites": ["bone", "liver"]}], "biomarker_results": [],
    }
    lines = [json.dumps(whole), json.dumps({"patient_id": "p2"}), "{bad", json.dumps({"sex": "M"}), json.dumps({"patient_id": "p3", "ecog_at_advanced_diagnosis": "one"}), "", "[]"]
    (tmp_path / "in.jsonl").write_text("\n".join(lines))
    got = core.load(core.read_profiles(spark, str(tmp_path / "in.jsonl")), "2024-12-31")
    core.write(got, str(tmp_path / "core"))
    rows = {n: spark.read.parquet(str(tmp_path / "core" / n)).collect() for n in core.Core._fields}
    people = {r.patient_id: r for r in rows["patient"]}
    assert set(people) == {"p1", "p2"} and json.loads(people["p1"].date_of_birth) == {"value": "1950-01-02", "precision": "day"} and people["p1"].date_of_death is None and str(people["p1"].advanced_diagnosis_date_iso) == "2020-02-03" and people["p1"].pdl1_tps_value == 12.5
    assert json.loads(people["p1"]._meta_source_records) == [{"source": "fhir", "external_id": "p1"}]
    meds = {r.medication_id: r for r in rows["medication_administration"]}
    assert json.loads(meds["m1"].medication_code) == {"code": "40048", "system": "rxnorm", "display": "carboplatin"} and json.loads(meds["m1"].dose) == {"value": 5.0, "unit": "AUC"} and meds["m2"].medication_code is None and meds["m1"].end_date is None
    assert rows["progression_event"][0].new_metastatic_sites == ["bone", "liver"] and rows["biomarker_result"] == []
    assert sorted(r.reason for r in rows["rejected"]) == ["no patient_id", "no profile", "no profile", "no profile"]
