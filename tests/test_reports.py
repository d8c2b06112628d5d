from vitalspark import derive
from vitalspark.operators import notes, quality_gate
from vitalspark.sources import reports, sinks, synthetic


def test_derived_reports(spark, tmp_path):
    people = synthetic.patients(spark, 60)
    given = synthetic.medications(people)
    sinks.write_extracts({"patients.csv": people, "medication_administrations.csv": given}, str(tmp_path / "in"))
    found = derive.derive(spark, str(tmp_path / "in"))
    reports.write_derived(found, str(tmp_path / "out"))
    lines = spark.read.json(str(tmp_path / "out" / "lines_of_therapy.json")).collect()
    assert {r.patient_id for r in lines} == {r.patient_id for r in given.select("patient_id").distinct().collect()} and all(r.lines and r.warnings == [] for r in lines)
    assert sum(len(r.lines) for r in lines) == found.lines.count()
    assert spark.read.json(str(tmp_path / "out" / "survival.json")).count() == 60 and spark.read.json(str(tmp_path / "out" / "summary.json")).first().n_patients == 60
    assert spark.read.json(str(tmp_path / "out" / "km.json")).count() == found.curve.count()


def test_texts(spark):
    table = spark.createDataFrame([(1, "a"), (2, None)], "id int, who string")
    checks = quality_gate.run({"t": table}, {"a name": quality_gate.missing("t", "who"), "key": quality_gate.repeated("t", "id")})
    assert reports.checks_text(checks) == "check   status  failures\n------------------------\na name    FAIL         1\nkey       PASS         0\n\none or more checks failed"
    assert reports.checks_text(checks.where("status = 'PASS'")).endswith("\nall checks passed")
    found = notes.merge_notes(notes.abstract(spark.createDataFrame([("p", 1, "Advanced adenocarcinoma, stage IVB. ECOG 2. Given carboplatin.")], "patient_id string, note_order int, text string")))
    scores = notes.scalar_scores(found, found, "patient_id"), notes.numeric_accuracy(found, found, "patient_id"), notes.set_scores(found, found, "patient_id")
    text = reports.scores_text(*scores, notes.macro_accuracy(*scores)).split("\n")
    assert text[0] == "macro accuracy: 1.000" and any(x.split() == ["stage", "1.000", "0.000"] for x in text) and any(x.split() == ["treatments_mentioned", "1.000", "1.000", "1.000"] for x in text)
