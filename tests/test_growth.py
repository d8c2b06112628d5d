"""What a task holds, and how often a row is worked on, as tables grow."""

import threading

from vitalspark import types
from vitalspark.operators import external
from vitalspark.sources import files, report, store, synthetic


def test_patients_of_one_file_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(synthetic, "TASK_PATIENTS", 50)
    people = synthetic.patients_of(spark.range(1000).coalesce(1))
    tasks = people.rdd.glom().map(len).collect()
    assert len(tasks) == 20 and max(tasks) < 200 and sum(tasks) == 1000
    # What is grouped by patient stays there: the one shuffle is that of the ids.
    plan = people.groupBy("patient_id").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_what_is_read_of_a_file_is_read_once(spark):
    """Filters for files without a patient, or values, aren't pushed below what reads these."""
    found = spark.createDataFrame([("a.json", "{}", "fhir"), ("b.csv", "patient_id,icd10_code\nP1,C34.2\n\nP2,\n", "csv"), ("c.csv", "\n\n", "csv")], "name string, text string, format string")
    plan = lambda rows: rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan(files.tall(files.fhir_records(found))).count("$.resourceType, StringType") <= 3  # of the bundle and of its resources
    rows = files.csv_rows(found)
    assert "Join" not in plan(rows) and plan(rows).count("regexp_extract_all") <= 3  # of the file's lines, the header's and a line's cells
    assert sorted((r.name, r.line, r.row["patient_id"], r.row["icd10_code"]) for r in rows.collect()) == [("b.csv", 1, "P1", "C34.2"), ("b.csv", 2, "P2", "")]
    assert sorted(map(tuple, files.staged(found).collect())) == sorted(map(tuple, found.collect()))


def test_ingest_makes_its_files_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    found = spark.createDataFrame([("b.csv", "patient_id,icd10_code\nP1,C34.2", "csv")], "name string, text string, format string")
    kept = store.Store(spark, str(tmp_path), 2)
    kept.replace("dictionary", spark.createDataFrame([], types.DICTIONARY))
    told = report.ingest_files(kept, found.mapInArrow(count, found.schema))
    assert [r.n_records for r in told.files.collect()] == [1] and made.value == 1


def test_waves_of_calls_share_what_they_cost(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = spark.range(90).selectExpr("id", "'t' || id AS text")
    kept = external.answers_table(spark, str(tmp_path), 2)
    external.ask(rows.mapInArrow(count, rows.schema), "thread", lambda text: threading.current_thread().name, kept, external.Policy(tasks=2, wave=40))
    assert made.value == 90  # however many waves there are
    assert [v.change for v in kept.history()] == ["append", "append", "upsert"]  # kept answers are merged once
    assert kept.log.read().appended == [] and kept.read().count() == 90
    # A call has no thread of its own; names are numbered in each Python worker.
    assert kept.read().select("answer").distinct().count() <= 3 * 2 * external.Policy().concurrency


def test_answers_of_a_run_that_failed_are_kept(spark, tmp_path):
    """Its waves were appended and not merged yet: the last row of a text counts, and the next run merges them."""
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, text string")
    kept = external.answers_table(spark, str(tmp_path), 2)
    for text, answer, error, at in (("a", None, "down", 1), ("a", "A", None, 2), ("b", None, "down", 3)):
        kept.append(spark.sql(f"SELECT '{text}' AS text").select(external.text_id("s").alias("id"), *(external.F.lit(v).cast(t).alias(c) for v, t, c in ((answer, "string", "answer"), (error, "string", "error"), (7, "int", "attempts"), (at, "timestamp", "answered_at")))))
    got = external.ask(rows, "s", str.upper, kept)
    assert sorted((r.id, r.answer, r.error, r.attempts) for r in got.collect()) == [(1, "A", None, 7), (2, "B", None, 1), (3, "C", None, 1)]
    assert kept.log.read().appended == [] and kept.read().count() == 3
