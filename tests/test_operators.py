import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from vitalspark.operators import audit, cohort, notes, quality_gate, reconcile, survival, therapy

D = dt.date


def curve(spark, rows):
    return survival.kaplan_meier(spark.createDataFrame(rows, "os_days int, event int"))


def test_kaplan_meier_goldens(spark):
    ten = curve(spark, [(d, 1) for d in range(10, 101, 10)])
    assert survival.median_with_ci(ten).first().median == 50
    ties = {r.time: r for r in curve(spark, [(100, 1), (100, 1), (200, 1), (300, 0)]).collect()}
    assert (ties[100].survival, ties[100].n_risk, ties[100].n_event) == (0.5, 4, 2)
    assert curve(spark, [(5, 1)]).first().survival == 0
    censored = curve(spark, [(5, 0), (9, 0)])
    assert {r.survival for r in censored.collect()} == {1.0} and survival.median_with_ci(censored).first().median is None
    variance = survival.greenwood_variance(curve(spark, [(100, 1), (100, 1), (200, 1), (300, 0)]), 150).first().variance
    assert variance == pytest.approx(0.25 * 2 / (4 * 2))
    assert survival.greenwood_variance(ten, 1).first().variance == 0
    anchored = survival.with_anchor(ten).where("time = 0").first()
    assert (anchored.survival, anchored.n_risk) == (1.0, 10)


def test_kaplan_meier_against_a_loop(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(60), rng.randrange(2)) for _ in range(300)]
    left, s, g, want = len(rows), 1.0, 0.0, {}
    for t in sorted({t for t, _ in rows}):
        d, n = sum(1 for x, e in rows if x == t and e), sum(1 for x, _ in rows if x == t)
        s *= 1 - d / left
        g += d / (left * (left - d)) if d and left > d else 0
        want[t] = (left, d, s, g)
        left -= n
    for r in curve(spark, rows).collect():
        assert (r.n_risk, r.n_event) == want[r.time][:2] and r.survival == pytest.approx(want[r.time][2]) and r.greenwood == pytest.approx(want[r.time][3])
    low = [t for t, (_, _, s, g) in sorted(want.items()) if (min(s ** math.exp(survival.Z_95 * math.sqrt(g) / math.log(s)), s ** math.exp(-survival.Z_95 * math.sqrt(g) / math.log(s))) if 0 < s < 1 and g > 0 else s) <= 0.5]
    assert survival.median_with_ci(curve(spark, rows)).first().ci_lower == low[0]


def test_survival_records(spark):
    rows = [("a", "2020-01", "Deceased", "2020-03-01", "2020-02-01", "61.0"), ("b", "2020-01-10", "deceased", None, "2020-02-10", "x"), ("c", "2020-06-01", "alive", None, "2020-05-01", None), ("d", None, "alive", None, "2020-05-01", "1"), ("e", "2020-01-01", None, None, None, "1")]
    frame = spark.createDataFrame(rows, "patient_id string, advanced_diagnosis_date string, vital_status string, date_of_death string, last_known_alive_date string, age_at_advanced_diagnosis string")
    got = {r.patient_id: r for r in survival.survival_records(frame).collect()}
    assert set(got) == {"a", "b", "c"}
    assert (got["a"].os_days, got["a"].event, got["a"].index_date_precision, got["a"].index_date_assumed, got["a"].age_at_index) == (46, 1, "month", True, 61)
    assert (got["b"].os_days, got["b"].event, got["b"].age_at_index) == (31, 0, None) and (got["c"].os_days, got["c"].event_date) == (0, D(2020, 6, 1))
    mart = {r.patient_id: r for r in survival.survival_mart(frame).collect()}
    assert mart["a"].event == 0 and mart["b"].rwos_months == 1.02
    assert survival.plot_records(frame.withColumn("data_cutoff_date", F.lit("2021-01-01"))).where("event = 1").count() == 2


def lines(spark, meds, progs=(), death=None):
    m = spark.createDataFrame([("p", d, None, None, s, e, None) for d, s, e in meds], "patient_id string, display string, drug_name string, medication_code string, start_date string, end_date string, drug_class string")
    p = spark.createDataFrame([("p", d, k) for d, k in progs], "patient_id string, event_date string, progression_type string")
    deaths = spark.createDataFrame([("p", D.fromisoformat(death))], "patient_id string, death_date date") if death else None
    return therapy.lines_of_therapy(therapy.administrations(m), therapy.progressions(p), deaths).orderBy("line_number").collect()


def test_lines_of_therapy_goldens(spark):
    (one,) = lines(spark, [("Carboplatin", "2020-01-01", None), ("pemetrexed", "2020-01-01", None), ("pembrolizumab ", "2020-01-01", "")])
    assert one.drug_class == "chemo+io" and one.regimen_label == "carboplatin + pembrolizumab + pemetrexed" and one.end_reason == "unknown"
    assert len(lines(spark, [("osimertinib", "2020-01-01", "2020-02-01"), ("osimertinib", "2020-04-01", "2020-05-01")])) == 1
    two = lines(spark, [("osimertinib", "2020-01-01", "2020-03-01"), ("carboplatin", "2020-04-01", "2020-05-01")], [("2020-03-20", None)])
    assert [x.end_reason for x in two] == ["progression", "unknown"]
    assert len(lines(spark, [("carboplatin", "2020-01-01", "2020-03-01"), ("bevacizumab", "2020-01-25", "2020-03-01")])) == 1
    assert len(lines(spark, [("a", "2020-01-01", None), ("b", "2020-06-01", None), ("c", "2021-01-01", None)], [("2019-01-01", "to_advanced")])) == 3
    (kept,) = lines(spark, [("carboplatin", "2020-01-01", "2020-02-01"), ("pemetrexed", "2020-01-01", "2020-06-01")])
    assert kept.is_maintenance
    (dead,) = lines(spark, [("carboplatin", "2020-01-01", "2020-02-01")], death="2020-04-30")
    assert dead.end_reason == "death"


def test_lines_against_a_loop(spark):
    """The fold against a loop over the five rules."""
    rng = random.Random(9)
    meds = [(f"p{rng.randrange(12)}", rng.choice("abcd"), D(2020, 1, 1) + dt.timedelta(rng.randrange(500))) for _ in range(300)]
    progs = [(f"p{rng.randrange(12)}", D(2020, 1, 1) + dt.timedelta(rng.randrange(500))) for _ in range(15)]
    admins = spark.createDataFrame([(p, d, s, s + dt.timedelta(5), None) for p, d, s in meds], "patient_id string, drug string, start date, end date, drug_class string")
    progressed = spark.createDataFrame(progs, "patient_id string, date date")
    got = sorted((r.patient_id, r.start, r.drug, r.end, r.line) for r in therapy.line_numbers(therapy.episodes(admins), progressed).collect())
    want = []
    for p in {m[0] for m in meds}:
        eps = []
        for drug in "abcd":
            for s in sorted(s for q, d, s in meds if q == p and d == drug):
                e = s + dt.timedelta(5)
                if eps and eps[-1][1] == drug and (s - eps[-1][2]).days <= 90:
                    eps[-1][2] = max(e, eps[-1][2])
                else:
                    eps.append([s, drug, e])
        n, held, start, end = 0, set(), None, None
        for s, drug, e in sorted(map(tuple, eps)):
            new = n == 0 or drug in held or any(q == p and start <= d <= s for q, d in progs) or not ((s - start).days <= 28 or (s - end).days <= 28)
            n, held, start, end = (n + 1, {drug}, s, e) if new else (n, held | {drug}, start, max(end, e))
            want.append((p, s, drug, e, n))
    assert got == sorted(want)


def test_mart_follows_not_in(spark):
    """New drugs as NOT IN has it, nulls included."""
    rows = [("p", "a", 1), ("p", "b", 3), ("p", None, 200), ("p", "c", 400), ("q", None, 1), ("q", "a", 300), ("r", "a", 1), ("r", "a", 1), ("r", "b", 300)]
    admins = spark.createDataFrame([(p, d, D(2020, 1, 1) + dt.timedelta(s), D(2020, 1, 1) + dt.timedelta(s), None) for p, d, s in rows], "patient_id string, drug string, start date, end date, drug_class string")
    found = therapy.lines_mart(admins, spark.createDataFrame([], "patient_id string, date date"))
    assert {r.patient_id: r.n for r in found.groupBy("patient_id").agg(F.max("line_number").alias("n")).collect()} == {"p": 1, "q": 1, "r": 2}


def test_validate(spark):
    rows = [("p", 1, ["carboplatin", "aspirin"], D(2020, 1, 1), D(2019, 1, 1)), ("p", 3, ["cisplatin"], D(2020, 2, 1), D(2035, 1, 1))]
    found = spark.createDataFrame(rows, "patient_id string, line_number int, drugs array<string>, start_date date, end_date date")
    codes = sorted((r.code, r.line_number) for r in therapy.validate(found, spark.createDataFrame([("p", D(2020, 5, 1))], "patient_id string, index_date date")).collect() if r.line_number is not None)
    assert codes == [("end_before_start", 1), ("implausible_duration", 3), ("treatment_before_diagnosis", 1), ("unrecognized_drug", 1)]
    assert therapy.validate(found, spark.createDataFrame([], "patient_id string, index_date date")).where("code = 'non_sequential_line_numbers'").count() == 1


def test_nearest_against_a_loop(spark):
    rng = random.Random(2)
    left = [(rng.randrange(5), D(2020, 1, 1) + dt.timedelta(rng.randrange(400))) for _ in range(40)]
    right = [(rng.randrange(5), D(2020, 1, 1) + dt.timedelta(rng.randrange(400)), rng.randrange(9)) for _ in range(40)]
    got = cohort.nearest(spark.createDataFrame(left, "k int, at date").distinct(), spark.createDataFrame(right, "k int, seen date, v int"), "k", "at", "seen", 30, ("v",)).collect()
    for r in got:
        fits = [(abs((s - r["at"]).days), s, v) for k, s, v in right if k == r.k and abs((s - r["at"]).days) <= 30]
        assert (r.seen, r.v) == (min(fits)[1:] if fits else (None, None))
    assert len(got) == len(set(left))


def test_cohort(spark):
    rows = spark.createDataFrame([(1, 40, "a", 2), (2, 50, "b", None), (3, 60, "a", 1)], "id int, age int, seg string, ecog int")
    assert [r.id for r in cohort.cohort_filter(rows, age_min=40, age_max=60, seg=["a"], ecog=["1", 2]).collect()] == [1, 3] and cohort.cohort_filter(rows, seg=None).count() == 3 and cohort.cohort_filter(rows, seg=[]).count() == 0
    counts = {(r.field, r.value): (r.n, r.pct) for r in cohort.value_counts(rows, ["seg", "ecog"]).collect()}
    assert counts["seg", "a"] == (2, pytest.approx(200 / 3)) and counts["ecog", "1"] == (1, pytest.approx(100 / 3)) and len(counts) == 4
    log = cohort.event_log({"x": (rows, F.lit("2020-01-02"), F.col("seg")), "y": (rows.limit(1), F.lit(None), F.col("seg"))}).collect()
    assert [r.type for r in log] == ["x", "x", "x", "y"]
    words = spark.createDataFrame([("Stage", "d", None, "x|y"), ("ecog", "the STAGE", "v", "z")], "name string, description string, controlled_vocabulary string, semantic_tags string")
    assert cohort.dictionary_search(words, "stage").count() == 2 and cohort.dictionary_search(words, "stage", ["z"]).count() == 1 and [r.tag for r in cohort.dictionary_tags(words).collect()] == ["x", "y", "z"]


def test_notes(spark):
    text = "Advanced adenocarcinoma, stage ivb. ECOG performance status: 2\nEGFR: positive; exon 19. EGFR negative. PD-L1: High (TPS 62.5%). KRAS G12C. progression documented on 2021-03-04 with new involvement at: bone, liver. nab-paclitaxel"
    got = notes.abstract(spark.createDataFrame([("p", 1, text), ("p", 2, ""), ("p", 3, "osimertinib, stage IIIB")], "patient_id string, note_order int, text string"))
    first = got.where("note_order = 1").first()
    assert (first.histology, first.stage, first.ecog, first.egfr_status, first.egfr_mutation, first.pdl1_status, first.pdl1_tps, first.kras_variant, first.progression_date) == ("adenocarcinoma", "IVB", 2, "negative", "exon19_deletion", "high", 62.5, "G12C", "2021-03-04")
    assert first.new_metastatic_sites == ["bone", "liver"] and first.treatments_mentioned == ["paclitaxel", "nab-paclitaxel"] and first.extraction_confidence == "high" and got.where("note_order = 2").first().uncertain_fields == ["stage", "histology"]
    merged = notes.merge_notes(got)
    row = merged.first()
    assert row.stage == "IVB" and row.treatments_mentioned == ["paclitaxel", "nab-paclitaxel", "osimertinib"] and row.progression_mentioned
    truth = merged.withColumn("stage", F.lit("IIIB")).withColumn("new_metastatic_sites", F.array(F.lit("bone"), F.lit("brain")))
    scores = {r.field: r for r in notes.scalar_scores(truth, merged, "patient_id").collect()}
    assert scores["stage"].accuracy == 0 and scores["ecog"].accuracy == 1 and scores["stage"].miss_rate == 0
    sets = {r.field: r for r in notes.set_scores(truth, merged, "patient_id").collect()}
    assert (sets["new_metastatic_sites"].tp, sets["new_metastatic_sites"].fp, sets["new_metastatic_sites"].fn) == (1, 1, 1) and sets["treatments_mentioned"].f1 == 1
    none = notes.set_scores(truth.limit(0), merged, "patient_id").collect()
    assert none == [] and notes.numeric_accuracy(truth, merged, "patient_id").first().accuracy == 1
    assert {(r.truth, r.found) for r in notes.confusion(truth, merged, "patient_id").collect() if r.field == "stage"} == {("iiib", "ivb")}
    types = spark.createDataFrame([("progress_note",), ("my_radiology_2",), ("x",)], "n string").select(notes.note_type(F.col("n")).alias("t")).collect()
    assert [r.t for r in types] == ["progress", "radiology", "unknown"]


def test_log(spark):
    log = spark.createDataFrame([(1, "k", "lookup", "join", "2024-01-01"), (2, "k", "llm", "append", "2024-01-01"), (3, "j", "operator", "unclear", None)], "id int, key string, decided_by string, verdict string, decided_at string").withColumn("decided_at", F.to_timestamp("decided_at"))
    assert {r.key: r.id for r in reconcile.latest(log, ("key",)).collect()} == {"k": 2, "j": 3}
    assert tuple(audit.tier_counts(log).first()) == (1, 1, 1) and audit.per_day(log).count() == 2 and {r.key: r.n for r in audit.tallies(log).collect()}["verdict:join"] == 1
    assert audit.filtered(log, ["llm"]).count() == 1 and [r.verdict for r in audit.options(log, "verdict").collect()] == ["append", "join", "unclear"]
    values = spark.createDataFrame([("p", "a", "1"), ("p", "b", "2"), ("p", "c", "1"), ("q", "a", "1")], "k string, source string, value string")
    assert {(r.source_a, r.source_b) for r in reconcile.conflicts(values, ("k",)).collect()} == {("a", "b"), ("b", "c")}
    several = spark.createDataFrame([("p", "a", 1), ("p", "a", 5), ("p", "b", 1), ("q", "a", 2), ("q", "a", 7), ("q", "b", 1), ("q", "b", 5), ("q", "b", 5)], "k string, source string, value int")
    assert sorted((r.k, r.value_a, r.value_b) for r in reconcile.conflicts(several, ("k",)).collect()) == [("p", 5, 1), ("q", 2, 1), ("q", 2, 5), ("q", 7, 1), ("q", 7, 5)]
    gate = {r.check: (r.n_fail, r.status) for r in quality_gate.run({"t": log}, {"null": quality_gate.missing("t", "decided_at"), "key": quality_gate.repeated("t", "id"), "who": quality_gate.outside("t", "decided_by", ("lookup",))}).collect()}
    assert gate == {"null": (1, "FAIL"), "key": (0, "PASS"), "who": (2, "FAIL")}


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1, 1, 1), (None, 1, 1, 1)], "k string, v int, t int, first int")
    new = spark.createDataFrame([("a", 2, 5, 5), (None, 3, 5, 5), ("b", 1, 5, 5)], "k string, v int, t int, first int")
    got = sorted(map(tuple, reconcile.upsert(old, new, ("k",), "t", ("first",)).collect()), key=str)
    assert got == sorted([("a", 2, 5, 1), ("b", 1, 5, 5), (None, 1, 1, 1), (None, 3, 5, 5)], key=str)
