"""Queries over the driver's tables, one or more for each operator: name -> function of (spark, folder)."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalspark.functions import coerce, dates, drugs, registries, units
from vitalspark.operators import audit, cohort, definition, external, notes, quality_gate, reconcile, survival, therapy, write_gate
from vitalspark import types
from vitalspark.derive import derive
from vitalspark.plans import bindings as b
from vitalspark.session import scratch_folder, table
from vitalspark.sources import core, files, readers, report, sinks, splits, staging, store, synthetic
from vitalspark.sources.versions import VersionedTable
from vitalspark.streaming import state

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: Diagnosis codes that the registries know.
MANY_CODES = ("C34.00", "C34.10", "C34.2", "C34.90", "J44")
SEGMENT, NATION = ("c_mktsegment",), "c_nationkey"


def query(function: Query) -> Query:
    """Register a query; dates leave it as ISO text, which compares alike everywhere."""

    @functools.wraps(function)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        out = function(spark, folder)
        return out.withColumns({c: F.col(c).cast("string") for c, kind in out.dtypes if kind == "date"})

    QUERIES[function.__name__] = run
    return run


def _records(spark: SparkSession, folder: str) -> DataFrame:
    return survival.survival_records(b.patients(spark, folder))


def _stratified(spark: SparkSession, folder: str) -> DataFrame:
    return _records(spark, folder).join(b.patients(spark, folder).select("patient_id", *SEGMENT), "patient_id")


# ---- survival


@query
def rwos_records(spark, folder):
    return _records(spark, folder).select("patient_id", "index_date", "event_date", "os_days", "event", "vital_status", "index_date_precision", "index_date_assumed", "age_at_index")


@query
def rwos_months(spark, folder):
    return survival.survival_mart(b.patients(spark, folder)).select("patient_id", "os_days", "rwos_months", "event", "event_observed")


@query
def rwos_plot_months(spark, folder):
    rows = b.patients(spark, folder).withColumn("data_cutoff_date", F.lit("2001-12-31"))
    return survival.plot_records(rows).select("patient_id", F.round("months", 6).alias("months"), "event")


@query
def km_overall(spark, folder):
    return survival.kaplan_meier(_records(spark, folder)).select("time", "n_risk", "n_event", F.round("survival", 9).alias("survival"), F.round("greenwood", 12).alias("greenwood"))


@query
def km_median_ci(spark, folder):
    return survival.median_with_ci(survival.kaplan_meier(_records(spark, folder)))


@query
def km_by_segment(spark, folder):
    curve = survival.kaplan_meier(_stratified(spark, folder), strata=SEGMENT)
    return survival.with_anchor(curve, SEGMENT).select(*SEGMENT, "time", "n_risk", "n_event", F.round("survival", 9).alias("survival"))


@query
def km_segment_medians(spark, folder):
    return survival.median_with_ci(survival.kaplan_meier(_stratified(spark, folder), strata=SEGMENT), SEGMENT)


@query
def km_greenwood_at(spark, folder):
    curve = survival.kaplan_meier(_stratified(spark, folder), strata=SEGMENT)
    return survival.greenwood_variance(curve, 1500, SEGMENT).select(*SEGMENT, F.round("variance", 12).alias("variance"))


@query
def at_risk_table(spark, folder):
    rows = survival.plot_records(b.patients(spark, folder).withColumn("data_cutoff_date", F.lit("2001-12-31")))
    rows = rows.join(b.patients(spark, folder).select("patient_id", *SEGMENT), "patient_id")
    return survival.at_risk(rows, SEGMENT)


@query
def followup_median(spark, folder):
    return survival.follow_up(_stratified(spark, folder), SEGMENT)


# ---- lines of therapy


@query
def episodes_gap_islands(spark, folder):
    return therapy.episodes(b.administrations(spark, folder)).select("patient_id", "drug", "start", "end", "n_admins")


def _numbered(spark: SparkSession, folder: str) -> DataFrame:
    return therapy.line_numbers(therapy.episodes(b.administrations(spark, folder)), b.progressions(spark, folder))


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return therapy.lines(_numbered(spark, folder), b.progressions(spark, folder), b.deaths(spark, folder))


@query
def lot_greedy(spark, folder):
    return _numbered(spark, folder).select("patient_id", "drug", "start", "end", "line")


@query
def lot_lines(spark, folder):
    return _lines(spark, folder).select("patient_id", "line_number", F.array_join("drugs", ",").alias("drugs"), "start_date", "end_date", "end_reason", "is_maintenance", "regimen_label", "drug_class")


@query
def lot_sql_mart(spark, folder):
    found = therapy.lines_mart(b.administrations(spark, folder), b.progressions(spark, folder))
    return found.select("patient_id", "line_number", "line_start_date", "line_end_date", F.array_join("drugs", ",").alias("drugs"), "n_administrations")


@query
def lot_summary(spark, folder):
    return therapy.summary(b.patients(spark, folder), _lines(spark, folder))


@query
def lot_validate(spark, folder):
    index = b.patients(spark, folder).select("patient_id", F.date_add(F.col("advanced_diagnosis_date").cast("date"), 1).alias("index_date"))
    return therapy.validate(_lines(spark, folder), index).groupBy("code").agg(F.count("*").alias("n"))


@query
def lot_first_line_class(spark, folder):
    names = F.array(*map(F.lit, drugs.ONCOLOGY))
    admins = b.administrations(spark, folder).withColumn("drug", F.element_at(names, F.ascii("drug") * 7 % len(drugs.ONCOLOGY) + 1))
    numbered = therapy.line_numbers(therapy.episodes(admins), b.progressions(spark, folder))
    return therapy.first_line_classes(therapy.lines(numbered, b.progressions(spark, folder)))


@query
def new_drug_not_in(spark, folder):
    from pyspark.sql import Window

    admins = b.administrations(spark, folder)
    new = F.col("start") == F.min("start").over(Window.partitionBy("patient_id", "drug"))
    return admins.groupBy("patient_id", "drug", "start").agg(F.count("*").alias("n")).withColumn("is_new", new.cast("int"))


@query
def progressed_exists(spark, folder):
    """Orders with a progression of the customer in the 90 days up to them: a semi-join on equal slots of 90 days, then the dates."""
    admins = b.administrations(spark, folder).select("patient_id", "start").distinct().withColumn("slot", F.explode(F.array(F.floor(F.unix_date("start") / 90), F.floor(F.unix_date("start") / 90) - 1)))
    progressed = b.progressions(spark, folder).withColumn("slot", F.floor(F.unix_date("date") / 90))
    hit = (admins.patient_id == progressed.patient_id) & (admins.slot == progressed.slot) & (progressed.date <= admins.start) & (F.datediff(admins.start, progressed.date) < 90)
    return admins.join(progressed, hit, "left_semi").select("patient_id", "start").distinct()


@query
def nearest_within_30d(spark, folder):
    left = b.progressions(spark, folder).groupBy("patient_id", "date").agg(F.count("*").alias("n"))
    right = b.administrations(spark, folder).select("patient_id", F.col("end").alias("dose_end"), "drug")
    return cohort.nearest(left, right, "patient_id", "date", "dose_end", 30, ("drug",))


@query
def anti_never_ordered(spark, folder):
    return table(spark, folder, "customer").join(table(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_name")


@query
def derived_pipeline(spark, folder):
    """The whole derived run in one row: counts, percentages, median with its interval."""
    median = survival.median_with_ci(survival.kaplan_meier(_records(spark, folder)))
    return therapy.summary(b.patients(spark, folder), _lines(spark, folder), median)


@query
def derived_folder(spark, folder):
    """The derived run over a cohort folder: the tables written as flat extracts and read back."""
    place = scratch_folder(spark)
    given = b.administrations(spark, folder).select("patient_id", F.col("drug").alias("display"), F.col("start").alias("start_date"), F.col("end").alias("end_date"))
    progressed = b.progressions(spark, folder).select("patient_id", F.col("date").alias("event_date"), F.lit("on_treatment_progression").alias("progression_type"))
    sinks.write_extracts({"patients.csv": b.patients(spark, folder), "medication_administrations.csv": given, "progression_events.csv": progressed}, f"{place}/csv")
    return derive(spark, place).summary


# ---- decision log and records

DECISION = ("pkey", "source_column")


@query
def latest_decision(spark, folder):
    return reconcile.latest(b.decisions(spark, folder), DECISION).select(*DECISION, "id", "decided_by", "verdict")


@query
def decision_history(spark, folder):
    """Every key's decisions, newest first, with their place."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(*DECISION).orderBy(F.col("decided_at").desc(), F.col("id").desc()))
    return reconcile.history(b.decisions(spark, folder)).select("pkey", "source_column", "id", "decided_by", place.alias("place"))


@query
def decision_cache(spark, folder):
    """Which requests of the last week the log of the weeks before answers."""
    log = b.decisions(spark, folder)
    cached = reconcile.latest(log.where("decided_at < '2024-01-22'"), DECISION).select(*DECISION, F.col("id").alias("cached_id"))
    return log.where("decided_at >= '2024-01-22'").select(*DECISION).distinct().join(cached, list(DECISION), "left")


@query
def signal_upsert(spark, folder):
    rows = b.signals(spark, folder)
    old, new = rows.where("id % 2 = 0"), rows.where("id % 2 = 1")
    return reconcile.upsert(old, new, ("pkey", "source"), "id").select("pkey", "source", "id", "k")


@query
def schema_upsert(spark, folder):
    rows = b.decisions(spark, folder).select("pkey", "canonical_name", "id", F.col("id").alias("first_seen"))
    return reconcile.upsert(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), ("pkey", "canonical_name"), "id", keep_first=("first_seen",)).select("pkey", "canonical_name", "id", "first_seen")


def _event_signals(spark, folder):
    k = F.col("k").cast("string")
    return b.signals(spark, folder).select(
        F.col("id").cast("string").alias("id"), F.lit("default").alias("workspace_key"), F.col("pkey").cast("string").alias("pkey"), "source", F.col("pkey").cast("string").alias("external_id"),
        F.col("occurred_at").cast("string").alias("occurred_at"), F.create_map(F.lit("k"), k).alias("columns"), F.timestamp_seconds("id").alias("ingested_at"),
    )


@query
def store_signals(spark, folder):
    """Signals upserted into a store in three batches, the newest of each record staying, and what a subject's last record is."""
    kept, rows = store.Store(spark, scratch_folder(spark)), _event_signals(spark, folder)
    for part in (1, 0, 2):
        kept.upsert("signals", rows.where(F.col("id").cast("long") % 3 == part))
    last = kept.latest_row().select("pkey", F.col("id").alias("last_id"))
    return kept.table("signals").join(last, "pkey").select("pkey", "source", F.col("id").cast("long").alias("id"), F.col("columns")["k"].alias("k"), F.col("last_id").cast("long").alias("last_id"))


@query
def store_decisions(spark, folder):
    """A log of decisions appended week by week, compacted, and the last decision of each column in it."""
    kept = store.Store(spark, scratch_folder(spark))
    rows = b.decisions(spark, folder).select(
        F.col("id").cast("string").alias("id"), "workspace_key", F.col("pkey").cast("string").alias("pkey"), "source", "source_column", F.lit("text").alias("source_data_type"), F.lit("").alias("source_description"), F.array(F.lit("x")).alias("source_samples"),
        "verdict", "canonical_name", F.lit(False).alias("is_global_target"), "similarity_score", F.lit("").alias("reason"), (F.col("verdict") == "unclear").alias("needs_review"), "decided_by", F.col("decided_at").cast("timestamp").alias("decided_at"), F.col("id").alias("n"),
    )
    for week in (("2024-01-01", "2024-01-08"), ("2024-01-08", "2024-01-15"), ("2024-01-15", "2100-01-01"), ("1900-01-01", "2024-01-01")):
        kept.append_decisions(rows.where(F.col("decided_at").between(*map(F.lit, week)) & (F.col("decided_at") < week[1])))
    kept.tables["decisions"].compact()
    counts = kept.table("decisions").groupBy("pkey", "source_column").agg(F.count("*").alias("n"))
    return kept.latest_decisions().join(counts, ["pkey", "source_column"]).select("pkey", "source_column", F.col("id").cast("long").alias("id"), "verdict", "n")


@query
def merged_record(spark, folder):
    rows = b.signals(spark, folder).select(
        F.lit("default").alias("workspace_key"), "pkey", "source", F.col("occurred_at").cast("string").alias("occurred_at"), F.col("id").alias("ingested_at"),
        F.create_map(F.lit("k"), F.col("k").cast("string"), F.col("source"), F.format_string("%.2f", "value")).alias("columns"),
    )
    return reconcile.merged(rows).select("pkey", "canonical_name", "value")


@query
def value_conflicts(spark, folder):
    """As its SQL defines it, of each source's least value only; conflicts() itself compares all values."""
    least = b.signals(spark, folder).where("k IS NOT NULL").groupBy("pkey", "source").agg(F.min("k").alias("k"))
    return reconcile.conflicts(least, ("pkey",), value="k")


@query
def decisions_per_day(spark, folder):
    return audit.per_day(b.decisions(spark, folder))


@query
def decision_tallies(spark, folder):
    return audit.tallies(b.decisions(spark, folder))


@query
def tier_counts(spark, folder):
    return audit.tier_counts(b.decisions(spark, folder))


@query
def audit_filter(spark, folder):
    return audit.filtered(b.decisions(spark, folder), ("lookup", "llm"), ("join",)).groupBy("decided_by", "verdict").agg(F.count("*").alias("n"))


@query
def audit_options(spark, folder):
    return audit.options(b.decisions(spark, folder), "decided_by")


@query
def timeline_since(spark, folder):
    return b.signals(spark, folder).where("occurred_at >= '2024-01-25'").select("pkey", "source", "id").orderBy(F.col("id").desc())


@query
def offline_hold(spark, folder):
    """Event types as column names: which the registries know, which are held."""
    names = F.create_map(*(F.lit(x) for p in {"view": "glucose_mg", "click": "alk_result", "purchase": "drug_name", "signup": "visit_no", "error": "performance_status"}.items() for x in p))
    samples = F.create_map(*(F.lit(x) for p in {"purchase": "Keytruda", "view": "101", "click": "positive", "signup": "4", "error": "1"}.items() for x in p))
    tall = table(spark, folder, "events").select(
        F.lit("default").alias("workspace_key"), F.col("user_id").cast("string").alias("pkey"), F.lit("events").alias("source"), F.col("event_id").cast("string").alias("external_id"), F.col("ts").cast("string").alias("occurred_at"),
        names[F.col("event_type")].alias("source_column"), samples[F.col("event_type")].alias("value"), F.lit("text").alias("source_data_type"), F.lit("").alias("source_description"),
    )
    kept, held = reconcile.offline(tall)
    return kept.groupBy("source_column").agg(F.count("*").alias("n")).withColumn("held", F.lit(False)).unionByName(held.withColumns({"n": F.lit(0).cast("bigint"), "held": F.lit(True)}))


@query
def offline_many_values(spark, folder):
    """Columns of many values: a nation's diagnoses, padded in many ways, are held if one order of it has a text behind the codes."""
    codes = F.array(*map(F.lit, MANY_CODES))
    orders = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    k, odd = F.col("o_orderkey"), (F.col("c_nationkey") % 3 == 0) & (F.col("o_orderkey") % 5 == 0)
    code = F.concat(F.repeat(F.lit(" "), (k % 30).cast("int")), F.get(codes, (k % len(MANY_CODES)).cast("int")))
    tall = orders.select(
        F.lit("default").alias("workspace_key"), F.col("c_nationkey").cast("string").alias("pkey"), F.lit("orders").alias("source"), k.cast("string").alias("external_id"), F.lit("").alias("occurred_at"), F.lit("reason").alias("source_column"),
        F.when(odd, F.concat(F.lit("told: "), k.cast("string"))).otherwise(code).alias("value"), F.lit("text").alias("source_data_type"), F.lit("").alias("source_description"),
    )
    kept, _ = reconcile.offline(tall)
    asked = reconcile.requests(tall).select("pkey", F.size("source_samples").cast("long").alias("n_samples"), F.col("source_samples")[0].alias("first_sample"))
    return asked.join(kept.groupBy("pkey").agg(F.count("*").alias("n_kept")), "pkey", "left")


@query
def all_conflicts(spark, folder):
    """All values of all sources against each other."""
    return reconcile.conflicts(b.signals(spark, folder).where("k IS NOT NULL"), ("pkey",), value="k")


@query
def journey_checks(spark, folder):
    """A journey of up to three lines drawn for each customer: what must not be in journeys, and whether each line is reached by the shares that it should be."""
    people = synthetic.patients_of(table(spark, folder, "customer").select(F.col("c_custkey").alias("id")))
    drugs = synthetic.medications(people)
    found = synthetic.journey_faults(people, drugs, synthetic.progressions(people))
    reached = drugs.groupBy("patient_id").agg(F.count_distinct("regimen_id").alias("n")).agg(F.count("*").alias("one"), F.count_if(F.col("n") >= 2).alias("two"), F.count_if(F.col("n") >= 3).alias("three"))
    total = people.agg(F.count("*").alias("all"))
    shares = total.crossJoin(reached).select(F.lit("shares of lines").alias("check"), F.when(F.expr("one / all BETWEEN 0.6 AND 0.9 AND two / one BETWEEN 0.25 AND 0.7 AND three > 0 AND three < two"), 0).otherwise(1).cast("long").alias("n_fail"))
    return found.union(shares).union(total.select(F.lit("patients"), F.col("all")))


@query
def core_load(spark, folder):
    """Customers as nested profiles, some of them broken, loaded into the CORE tables."""
    orders = table(spark, folder, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct(
        F.col("o_orderkey").cast("string").alias("medication_id"), F.when(F.col("o_orderkey") % 3 > 0, F.lit("40048")).alias("rxnorm_code"), F.lower(F.trim("o_orderpriority")).alias("display"), F.to_date("o_orderdate").cast("string").alias("start_date"), (F.col("o_orderkey") % 7).alias("dose_value"), F.lit("mg").alias("dose_unit"),
    )).alias("drug_administrations"))
    rows = table(spark, folder, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    k = F.col("c_custkey")
    profile = F.to_json(F.struct(F.when(k % 11 > 0, F.concat(F.lit("C"), k.cast("string"))).alias("patient_id"), F.lit("fhir").alias("source_format"), F.lit("2020-01-02").alias("advanced_diagnosis_date"), F.col("c_mktsegment").alias("practice_type"), "drug_administrations"))
    got = core.load(rows.select(F.when(k % 13 == 0, F.left(profile, F.lit(20))).otherwise(profile).alias("text")), "2024-12-31")
    people = got.patient.groupBy(F.lit("patient").alias("what"), F.col("practice_type").alias("id"), F.col("advanced_diagnosis_date").alias("detail"), F.lit(None).cast("string").alias("dose")).agg(F.count("*").alias("n"))
    drugs = got.medication_administration.select(F.lit("medication"), F.col("medication_id"), F.concat_ws(" ", "patient_id", "medication_code", "start_date"), "dose", F.lit(1).cast("long"))
    none = F.lit(None).cast("string")
    return people.union(drugs).union(got.rejected.groupBy("reason").agg(F.count("*").alias("n")).select(F.lit("rejected"), "reason", none, none, "n"))


@query
def saved_definition(spark, folder):
    """Patients of a cohort definition that was stored as JSON and read back."""
    at = scratch_folder(spark)
    tree = {"all": [{"field": "age", "between": [30, None]}, {"any": [{"field": "vital_status", "in": ["deceased"]}, {"field": "c_nationkey", "in": [3, 4, 5]}]}, {"not": {"field": "c_mktsegment", "in": ["BUILDING"]}}, {"field": "date_of_death", "known": False}]}
    tree["all"][-1] = {"any": [tree["all"][-1], {"field": "age", "between": [None, 60]}]}
    definition.save(spark, tree, f"{at}/cohort.json")
    rows = b.patients(spark, folder).withColumn("age", F.col("age_at_advanced_diagnosis").cast("int"))
    return definition.select(rows, definition.load(spark, f"{at}/cohort.json")[0]).select("patient_id", "age", "vital_status")


@query
def bundle_by_patient(spark, folder):
    """What is found of each customer's bundle: a third have one, some of these broken or empty."""
    ids = table(spark, folder, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("patient_id"))
    k = F.regexp_extract("name", "[0-9]+", 0).cast("long")
    found = b.bundles(spark, folder).select("name", F.when(k % 5 == 0, "{bad").when(k % 7 == 0, " ").when(k % 11 == 0, "[]").otherwise(F.col("text")).alias("text"))
    rows = readers.bundles_of(ids, found)
    return rows.groupBy("status").agg(F.count("*").alias("n"), F.count("bundle").alias("n_bundles"), F.min("patient_id").alias("first"))


@query
def decision_snapshot(spark, folder):
    """Decisions written as a CSV snapshot and read back."""
    at = scratch_folder(spark)
    readers.write_snapshot(b.decisions(spark, folder).withColumns({"reason": F.concat(F.lit('says "so", '), F.col("id").cast("string")), "decided_at": F.col("decided_at").cast("string")}), f"{at}/decisions.csv")
    rows = readers.load_decisions(spark, f"{at}/decisions.csv", store.Store(spark, f"{at}/store")).rows
    return rows.groupBy("source_column", "decided_by", "verdict", "canonical_name").agg(F.count("*").alias("n"), F.max("reason").alias("reason"), F.max(F.left("decided_at", F.lit(19))).alias("last"), F.round(F.sum("similarity_score"), 2).alias("score"))


@query
def gated_decisions(spark, folder):
    """Decisions through the gate in two batches: what is written, and why others are turned away."""
    at = scratch_folder(spark)
    kept = VersionedTable(spark, f"{at}/decisions", types.DECISION)
    quarantine = VersionedTable(spark, f"{at}/quarantine", f"{types.DECISION}, reasons array<string>")
    n = F.col("n")
    rows = b.decisions(spark, folder).withColumn("n", F.col("id")).select(
        F.when(n % 50 == 0, F.lit(None)).when(n % 40 == 1, n - 1).otherwise(n).cast("string").alias("id"), F.when(n % 3 == 0, F.lit(None)).otherwise(F.col("workspace_key")).alias("workspace_key"), F.col("pkey").cast("string").alias("pkey"), "source", "source_column",
        F.lit("text").alias("source_data_type"), F.lit("").alias("source_description"), F.array().cast("array<string>").alias("source_samples"), F.when(n % 70 == 0, "perhaps").otherwise(F.col("verdict")).alias("verdict"), "canonical_name", F.lit(None).cast("boolean").alias("is_global_target"),
        F.when(n % 90 == 0, 2.0).otherwise(0.5).alias("similarity_score"), F.lit("").alias("reason"), (F.col("verdict") == "unclear").alias("needs_review"), "decided_by", F.timestamp_seconds(n).alias("decided_at"), n,
    )
    for part in (0, 1):
        write_gate.write(kept, quarantine, rows.where(n % 2 == part), write_gate.TABLES["decisions"], f"{at}/judged{part}")
    good = kept.read().groupBy(F.lit("written").alias("what"), "workspace_key", "is_global_target").agg(F.count("*").alias("n"), F.min(F.col("id").cast("long")).alias("least"))
    bad = quarantine.read().groupBy(F.array_join("reasons", "; ").alias("what"), "workspace_key", "is_global_target").agg(F.count("*").alias("n"), F.min(F.unix_timestamp("decided_at")).alias("least"))
    return good.union(bad)


@query
def asked_notes(spark, folder):
    """Notes answered by a service that fails at first, for some always: each different note once, and nothing again in a second run."""
    kept = external.answers_table(spark, scratch_folder(spark), 4)
    notes_ = table(spark, folder, "documents").select("doc_id", "text")
    policy = external.Policy(backoff=0.0, tasks=4)
    for _ in range(2):
        got = external.ask(notes_, "length", external.FlakyLength(), kept, policy)
    return got.select("doc_id", "answer", F.element_at(F.split("error", ":"), 1).alias("error"), "attempts")


# ---- streams: each runs, ends, and goes on from its checkpoint with what has come meanwhile


@query
def stream_latest(spark, folder):
    """The last signal of each subject, of a stream whose second part is older than its first."""
    at, rows = scratch_folder(spark), _event_signals(spark, folder)
    kept = store.Store(spark, f"{at}/store")
    for late in (False, True):
        rows.where((F.col("occurred_at") < "2024-01-16") == late).write.mode("append").parquet(f"{at}/signals")
        run = state.start_latest(spark.readStream.schema(types.SIGNAL).parquet(f"{at}/signals"), kept, f"{at}/checkpoint")
        run.awaitTermination()
    return kept.table("signals").select("pkey", F.col("id").cast("long").alias("id"), F.col("columns")["k"].alias("k"))


@query
def stream_routing(spark, folder):
    """Values that wait for the decision on their column: a third of the subjects have theirs at once, a third later, a third never."""
    at = scratch_folder(spark)
    log = b.decisions(spark, folder).select("workspace_key", F.col("pkey").cast("string").alias("pkey"), "source", "source_column", "verdict", "canonical_name", "decided_by", F.col("decided_at").cast("timestamp").alias("decided_at"), F.col("id").cast("string").alias("id"))
    values = log.select(*reconcile.CACHE_KEY, F.col("id").alias("external_id"), F.col("decided_at").cast("string").alias("occurred_at"), F.col("id").alias("value"))
    first = reconcile.latest(log, reconcile.CACHE_KEY)
    for part, part_of in ((1, values["occurred_at"] < "2024-01-16"), (2, values["occurred_at"] >= "2024-01-16")):
        values.where(part_of).write.mode("append").parquet(f"{at}/values")
        first.where(F.col("pkey").cast("long") % 3 == part).write.mode("append").parquet(f"{at}/decisions")
        run = state.start_routing(*(spark.readStream.schema(x.schema).parquet(f"{at}/{n}") for x, n in ((values, "values"), (first, "decisions"))), f"{at}/routed", f"{at}/checkpoint")
        run.awaitTermination()
    routed = spark.read.schema(state.ROUTED).parquet(f"{at}/routed")
    return routed.groupBy("pkey", "source_column", "kind", "verdict", "canonical_name").agg(F.count("*").alias("n"), F.max(F.when(F.col("kind") == "routed", F.col("value").cast("long"))).alias("last_value"))


# ---- sources


def _tall(spark: SparkSession, folder: str) -> DataFrame:
    found = b.bundles(spark, folder).unionByName(b.messages(spark, folder)).unionByName(b.extracts(spark, folder))
    return files.tall(files.records(files.staged(found)))


@query
def source_records(spark, folder):
    """Customers written as bundles, messages and flat extracts, and read back as values of source records."""
    return _tall(spark, folder).select("pkey", "source", "external_id", "occurred_at", "source_column", "value", "source_data_type", "source_description")


@query
def split_sources(spark, folder):
    """Messages and flat extracts written as files of many records, and read back in parts of a file."""
    at = scratch_folder(spark)
    b.messages(spark, folder).select("text").write.text(f"{at}/messages")
    b.extracts(spark, folder).select("name", "text").write.partitionBy("name").text(f"{at}/extracts")
    found = files.hl7_records(splits.read_messages(spark, f"{at}/messages")).unionByName(files.extract_records(splits.read_extract_rows(spark, f"{at}/extracts")))
    return files.tall(found).select("pkey", "source", "external_id", "occurred_at", "source_column", "value", "source_data_type", "source_description")


def _broken_files(spark: SparkSession) -> DataFrame:
    lines = "patient_id,ecog_at_advanced_diagnosis,icd10_code\n,1,C34.2\nX1,2.0,C34.2\nX2,high,C34.3\n\nX3,,\n,,"
    score = '{"resourceType": "Observation", "code": {"coding": [{"system": "http://loinc.org", "code": "89247-1"}]}, "valueInteger": 2}'
    ecog = '{"resourceType": "Bundle", "entry": [{"resource": {"resourceType": "Patient", "id": "X9"}}, {"resource": ' + score + "}]}"
    rows = [("a.json", "{bad"), ("b.json", '{"resourceType": "Bundle"}'), ("c", "MSH|x"), ("d", "no format here"), ("e.csv", lines), ("f.json", ecog)]
    broken = spark.createDataFrame(rows, "name string, text string")
    return broken.withColumn("format", files.detect(F.col("name"), F.col("text")))


@query
def ingest_report(spark, folder):
    """What becomes of customers' files and of some broken ones beside, without a router."""
    found = b.bundles(spark, folder).unionByName(b.messages(spark, folder)).unionByName(b.extracts(spark, folder)).unionByName(_broken_files(spark))
    kept = store.Store(spark, scratch_folder(spark))
    kept.replace("dictionary", spark.createDataFrame([("diagnosis_code", "coded_value", "", [], None, None, None, "icd-10")], types.DICTIONARY))
    told = report.ingest_files(kept, found).rows()
    # Files without an error by format: the rest is told file by file.
    return told.groupBy("part", F.when(F.col("detail").isNotNull() | (F.col("part") != "file") | (F.col("name") == "e.csv"), F.col("name")).alias("name"), "what", "detail").agg(F.sum("n").alias("n"))


@query
def source_formats(spark, folder):
    """Files by the format told, and what can't be read of them with some broken ones beside."""
    broken = spark.createDataFrame([("a.json", "{bad"), ("b.json", '{"resourceType": "Bundle"}'), ("c", "MSH|x"), ("d", "no format here")], "name string, text string")
    found = b.bundles(spark, folder).unionByName(b.messages(spark, folder)).unionByName(b.extracts(spark, folder)).unionByName(broken.withColumn("format", files.detect(F.col("name"), F.col("text"))))
    told = found.groupBy(F.coalesce("format", F.lit("none")).alias("what")).agg(F.count("*").alias("n"))
    return told.unionByName(files.errors(found).groupBy(F.col("error").alias("what")).agg(F.count("*").alias("n")))


@query
def staged_resources(spark, folder):
    """Bundles as variants, and the projections of their resources."""
    raw = staging.raw_bundles(b.bundles(spark, folder))
    parts = {"Patient": ("patient_id", "birth_date", "gender"), "Condition": ("condition_id", "onset", "code"), "Observation": ("observation_id", "effective", "code"), "MedicationAdministration": ("medication_id", "start", "display")}
    rows = [staging.resources(raw, kind).select(F.lit(kind).alias("kind"), F.col("name"), *(F.col(c).alias(n) for c, n in zip(columns, ("id", "date", "detail"), strict=True))) for kind, columns in parts.items()]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3])


@query
def staged_messages(spark, folder):
    """Patients and observations of HL7 files."""
    found = b.messages(spark, folder)
    seen = staging.hl7_observations(found).groupBy("name").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("code").alias("code"), F.max("display").alias("display"))
    return staging.hl7_patients(found).join(seen, "name", "left").select("name", "patient_id", "birth", "sex", F.coalesce("n", F.lit(0)).alias("n_observations"), "first", "code", "display")


@query
def staged_extracts(spark, folder):
    """Rows of a flat extract as variants, and their projection: empty cells and numbers that are none are null."""
    k = F.col("l_orderkey")
    rows = table(spark, folder, "lineitem").select(
        F.concat_ws("-", k, "l_linenumber").alias("observation_id"), F.concat(F.lit("C"), k.cast("string")).alias("patient_id"), F.lit("718-7").alias("loinc_code"), F.when(k % 3 == 0, "").otherwise("Hemoglobin").alias("display"),
        F.when(k % 5 == 0, "many").when(k % 5 == 1, "").otherwise(F.col("l_quantity").cast("decimal(10,1)").cast("string")).alias("value"), F.lit("g/dL").alias("unit"),
    )
    return staging.extract_rows(staging.raw_extract(rows, "observations"), "observations")


@query
def routing_decisions(spark, folder):
    """Columns of source records routed by the registries, then by name, and the decision of each."""
    known = spark.createDataFrame([("hemoglobin", "numeric", "", [], "g/dL", None, None, None)], types.DICTIONARY)
    log = spark.createDataFrame([], types.DECISION)
    found = reconcile.decide(_tall(spark, folder), log, known, reconcile.rule_router(known), F.lit("2024-01-01").cast("timestamp"))
    return found.select("pkey", "source", "source_column", "decided_by", "verdict", "canonical_name", "similarity_score", "is_global_target", "needs_review", F.size("source_samples").alias("n_samples"))


@query
def note_types(spark, folder):
    names = ("progress_note", "Initial_Consult", "my_pathology_report_2", "radiology", "odd", "pathology")
    name = F.get(F.array(*map(F.lit, names)), (F.col("doc_id") % len(names)).cast("int"))
    return table(spark, folder, "documents").select("doc_id", notes.note_type(name).alias("note_type"))


@query
def medication_timeline(spark, folder):
    """Orders as administrations, some with dates that are none."""
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate").cast("string")
    rows = table(spark, folder, "orders").select(F.col("o_custkey").alias("patient_id"), F.col("o_orderpriority").alias("display"), F.when(k % 11 == 0, "2020-13-01").otherwise(day).alias("start_date"), F.when(k % 3 == 0, "").when(k % 3 == 1, F.date_add("o_orderdate", 7).cast("string")).alias("end_date"))
    return cohort.medication_timeline(rows)


@query
def patient_tables(spark, folder):
    """Every table's rows of one patient."""
    tables = {"administrations": b.administrations(spark, folder), "progressions": b.progressions(spark, folder), "deaths": b.deaths(spark, folder)}
    found = cohort.patient_events(tables, 7)
    return functools.reduce(DataFrame.unionByName, (rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("events"), "n") for name, rows in found.items()))


# ---- lookup tier


@query
def code_regex(spark, folder):
    parts = table(spark, folder, "part")
    code = F.when(F.col("p_partkey") % 3 == 0, F.concat((F.col("p_partkey") % 99999).cast("string"), F.lit("-"), (F.col("p_size") % 10).cast("string"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("C"), (F.col("p_size") + 10).cast("string"), F.lit(".1"))).otherwise(F.col("p_partkey").cast("string"))
    return parts.select("p_partkey", code.rlike(registries.LOINC_CODE).alias("is_loinc"), code.rlike(registries.ICD10_CODE).alias("is_icd10"), code.rlike(registries.RXNORM_CODE).alias("is_rxnorm"))


@query
def alias_theta_join(spark, folder):
    """Words of the first line of parts' names as column names: aliases inside them, and the one entry if it is alone."""
    names = table(spark, folder, "part").select("p_partkey", registries.column_name(F.concat("p_name", F.lit(" "), F.col("p_type"), F.when(F.col("p_partkey") % 5 == 0, " ALT level").when(F.col("p_partkey") % 5 == 1, " Hgb").otherwise(""))).alias("name"))
    codes = registries.alias_codes(F.col("name"))
    return names.select("p_partkey", F.size(codes).alias("n_entries"), F.when(F.size(codes) == 1, F.get(codes, F.lit(0))).alias("code"))


def _brands(key):
    options = ["Keytruda", "OPDIVO", "cisplatin", "40048", "Unknownib", "Alimta"]
    return F.element_at(F.array(*map(F.lit, options)), (key % len(options) + 1).cast("int"))


@query
def brand_lookup(spark, folder):
    keys = table(spark, folder, "part").select("p_partkey", F.lower(F.trim(_brands(F.col("p_partkey")))).alias("key"))
    return keys.join(F.broadcast(registries.drug_names(spark)), "key", "left").select("p_partkey", "key", "drug", "drug_class")


@query
def lookup_tiers(spark, folder):
    """All strategies on requests made from parts: loinc code, diagnosis codes, brand, alias, ambiguous alias, none."""
    k = F.col("p_partkey") % 6
    column = F.when(k == 0, "lab code").when(k == 1, "dx").when(k == 2, "Drug-Name").when(k == 3, "Glucose level").when(k == 4, "ecog_performance_status").otherwise("zip")
    samples = F.when(k == 0, F.array(F.lit("718-7"), F.lit(" 718-7 "))).when(k == 1, F.array(F.lit("c34.2"), F.lit("C34.11"))).when(k == 2, F.array(F.lit("Keytruda"), F.lit("pembrolizumab"))).otherwise(F.array(F.col("p_size").cast("string")))
    samples = F.when(k == 1, F.transform(samples, F.upper)).otherwise(samples)
    v = registries.lookup(column, samples)
    return table(spark, folder, "part").select("p_partkey", v["canonical_name"].alias("canonical_name"), v["registry"].alias("registry"), v["code"].alias("code"), v["matched_on"].alias("matched_on"))


# ---- cohort


@query
def cohort_filter(spark, folder):
    rows = b.patients(spark, folder).withColumn("age", F.col("age_at_advanced_diagnosis").cast("int"))
    return cohort.cohort_filter(rows, age_min=30, age_max=55, vital_status=["deceased"], c_mktsegment=["BUILDING", "MACHINERY"], c_nationkey=None).select("patient_id", "age", "c_mktsegment")


@query
def cohort_flags(spark, folder):
    rows = table(spark, folder, "customer").withColumn("seg", F.when(F.col("c_custkey") % 7 > 0, F.col("c_mktsegment"))).withColumn("stage", F.element_at(F.array(*map(F.lit, ["IVA", "IIIB", "II"])), (F.col("c_custkey") % 3 + 1).cast("int")))
    return cohort.eligibility(rows, "seg", "c_name", "stage", histologies=("BUILDING", "FURNITURE")).select("c_custkey", "inc_histology", "inc_advanced_date", "inc_stage", "exc_other_primary", "exc_trial_only", "is_eligible")


@query
def value_counts_pct(spark, folder):
    rows = b.patients(spark, folder).withColumn("seg", F.when(F.col("patient_id") % 7 > 0, F.col("c_mktsegment")))
    return cohort.value_counts(rows, ["seg", "vital_status", "c_nationkey"]).withColumn("pct", F.round("pct", 6))


@query
def cooccurrence(spark, folder):
    kinds = ["click", "error", "purchase", "signup", "view"]
    rows = table(spark, folder, "events").where("value > 50").groupBy("user_id").agg(*(F.count_if(F.col("event_type") == k).alias(k) for k in kinds))
    return cohort.cooccurrence(rows, {k: F.col(k) > 5 for k in kinds})


@query
def event_log_union(spark, folder):
    orders, items = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    return cohort.event_log({"order": (orders, F.col("o_orderdate"), F.col("o_orderpriority")), "shipment": (items, F.col("l_shipdate"), F.col("l_returnflag"))}).groupBy("date", "type", "detail").agg(F.count("*").alias("n"))


@query
def dictionary_search(spark, folder):
    rows = table(spark, folder, "part").select(F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.col("p_brand").alias("controlled_vocabulary"), F.concat_ws("|", "p_brand", F.col("p_size").cast("string")).alias("semantic_tags"), "p_partkey")
    return cohort.dictionary_search(rows, "BRASS", ["7", "12", "Brand#13", "Brand#32"]).select("p_partkey", "name")


@query
def dictionary_tags(spark, folder):
    return cohort.dictionary_tags(table(spark, folder, "part").select(F.concat_ws("|", "p_brand", F.col("p_size").cast("string")).alias("semantic_tags")))


@query
def patient_card(spark, folder):
    return cohort.patient_card(b.patients(spark, folder))


@query
def patient_events(spark, folder):
    """Each patient's events by table."""
    orders = b.administrations(spark, folder).groupBy("patient_id").agg(F.count("*").alias("n_administrations"))
    return orders.join(b.progressions(spark, folder).groupBy("patient_id").agg(F.count("*").alias("n")), "patient_id", "left").select("patient_id", "n_administrations", F.coalesce("n", F.lit(0)).alias("n_progressions"))


@query
def dq_gate(spark, folder):
    orders, items, customers = (table(spark, folder, t) for t in ("orders", "lineitem", "customer"))
    tables = {"orders": orders, "lineitem": items, "customer": customers, "lines": _lines(spark, folder), "survival": _records(spark, folder)}
    checks = {
        "order_status": quality_gate.outside("orders", "o_orderstatus", ("F", "O")),
        "customer_name": quality_gate.missing("customer", "c_name"),
        "order_key": quality_gate.repeated("orders", "o_orderkey"),
        "order_customer": quality_gate.orphans("orders", "o_custkey", "customer", "c_custkey"),
        "item_order": quality_gate.orphans("lineitem", "l_orderkey", "orders", "o_orderkey"),
        "line_order": quality_gate.unordered("lines", "patient_id", "line_number", "start_date"),
        "survival": quality_gate.COHORT_CHECKS["survival_not_negative"],
    }
    return quality_gate.run(tables, checks)


@query
def cohort_gate(spark, folder):
    """All cohort checks, on orders as events: some of each fail."""
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    orders = table(spark, folder, "orders").select(F.col("o_custkey").alias("patient_id"), k, "o_orderstatus", day.alias("day"))
    pid = F.col("patient_id")
    patients = b.patients(spark, folder).select(
        F.when(pid % 97 != 0, pid).alias("patient_id"), F.when(pid % 89 != 0, F.col("advanced_diagnosis_date").cast("date")).alias("advanced_diagnosis_date"), F.date_add(F.col("advanced_diagnosis_date").cast("date"), F.when(pid % 41 == 0, 5).otherwise(-30)).alias("initial_nsclc_diagnosis_date"),
        "vital_status", F.when(pid % 31 != 0, F.date_sub(F.col("date_of_death").cast("date"), F.when(pid % 37 == 0, 9000).otherwise(0))).alias("date_of_death"), F.element_at(F.array(*map(F.lit, ("IIIB", "IIIC", "IVA", "IVB", "II"))), (pid % 5 + 1).cast("int")).alias("stage_at_advanced_diagnosis"),
    )
    tables = {
        "patients": patients, "lines": _lines(spark, folder), "survival": _records(spark, folder), "progressions": orders.select("patient_id", F.date_sub("day", 40).alias("event_date")), "medications": orders.select("patient_id", F.date_sub("day", 20).alias("start_date")),
        "biomarkers": orders.select("patient_id", F.element_at(F.array(*map(F.lit, ("positive", "negative", "maybe", "high"))), (k % 4 + 1).cast("int")).alias("result")),
    }
    return quality_gate.run(tables, quality_gate.COHORT_CHECKS)


@query
def cohort_selection(spark, folder):
    """The written algorithm over customers, with their orders as conditions, events and visits, and records from 1993 on."""
    pick = lambda by, *xs: F.get(F.array(*map(F.lit, xs)), (by % len(xs)).cast("int"))
    c, k = F.col("c_custkey"), F.col("o_orderkey")
    patients = table(spark, folder, "customer").select(c.alias("patient_id"), (c % 50 == 0).alias("is_test"), pick(c, "male", "Female", "unknown", "female", None, "female").alias("sex"), F.make_date(1950 + c % 40, 1 + c % 12, 1 + c % 28).alias("date_of_birth"))
    orders = table(spark, folder, "orders").select(F.col("o_custkey").alias("patient_id"), k, "o_orderstatus", F.to_date("o_orderdate").alias("day"))
    rank = F.floor(k / 4)
    conditions = orders.where(k % 4 == 1).select("patient_id", pick(rank, "C34.1", "C34.90", "C50.9", "162.5", "C39.9", "C39.1", "C340").alias("code"), pick(rank, "8140/3", "8070/3", None, "8500/3", "8046/3", "8012/3", "8140/3", "8033/3", "8255/3", "8560/3", "8041/3").alias("morphology"), pick(F.col("patient_id"), "IVA", "IIIB", "II", "IB", None).alias("stage"), F.col("day").alias("onset_date"))
    progressions = orders.where(k % 4 == 2).select("patient_id", F.col("day").alias("event_date"), pick(rank, "to_advanced", "on_treatment_progression", "metastatic_recurrence").alias("progression_type"), pick(rank, "IVA", "IVB").alias("stage"))
    encounters = orders.where(k % 4 != 3).select("patient_id", F.date_add("day", 15).alias("encounter_date"))
    ecog = orders.select("patient_id", F.date_add("day", 10).alias("measured_on"), (rank % 5).alias("ecog"))
    return cohort.select_cohort(patients, conditions, progressions, encounters, ecog, since="1993-01-01")


# ---- values


@query
def flatten_json(spark, folder):
    """A bundle of entries made of each event's props, flattened again by path."""
    bundle = F.concat(F.lit('{"entry":[{"resource":{"resourceType":"Event","props":'), "props", F.lit('}},{"resource":{"resourceType":"Other"}}]}'))
    rows = table(spark, folder, "events").select("event_id", F.parse_json(bundle).alias("bundle"))
    entries = rows.select("event_id", F.expr("try_variant_get(bundle, '$.entry', 'array<variant>')").alias("entries")).select("event_id", F.posexplode("entries").alias("pos", "e"))
    kind = F.try_variant_get("e", "$.resource.resourceType", "string")
    return entries.select("event_id", "pos", kind.alias("resource_type"), F.try_variant_get("e", "$.resource.props.k", "bigint").alias("k")).where("resource_type = 'Event'")


def _odd_dates(spark: SparkSession, folder: str) -> DataFrame:
    day = F.to_date("o_orderdate").cast("string")
    k = F.col("o_orderkey") % 8
    text = F.when(k == 0, day).when(k == 1, F.left(day, F.lit(7))).when(k == 2, F.left(day, F.lit(4))).when(k == 3, F.concat(day, F.lit("T10:00:00"))).when(k == 4, "unknown").when(k == 5, F.concat(F.left(day, F.lit(8)), F.lit("32"))).when(k == 6, "")
    return table(spark, folder, "orders").select("o_orderkey", text.alias("text"))


@query
def partial_date_parse(spark, folder):
    parsed = dates.parse_partial_date(F.col("text"))
    return _odd_dates(spark, folder).select("o_orderkey", F.coalesce(parsed["date"]).alias("date"), F.when(F.col("text").isNull(), "unknown").otherwise(parsed["precision"]).alias("precision"), F.coalesce(parsed["assumed"], F.lit(False)).alias("assumed"))


@query
def resolve_date_length(spark, folder):
    return _odd_dates(spark, folder).select("o_orderkey", dates.resolve_date_by_length(F.col("text")).alias("date"))


@query
def partial_date_text(spark, folder):
    day = F.to_date("o_orderdate")
    k = F.col("o_orderkey") % 7
    y, m = F.date_format(day, "yyyy"), F.date_format(day, "M")
    text = F.when(k == 0, F.date_format(day, "yyyy-MM-dd")).when(k == 1, F.concat_ws("-", y, m)).when(k == 2, y).when(k == 3, F.concat_ws("/", m, y)).when(k == 4, F.concat_ws(" ", F.lit("June"), y)).when(k == 5, F.concat(F.lit("Q3 "), y)).otherwise(F.concat(y, F.lit("-13")))
    p = dates.text_to_partial_date(text)
    return table(spark, folder, "orders").select("o_orderkey", *(p[c].alias(c) for c in ("year", "month", "day", "precision", "error")))


@query
def epoch_ms_roundtrip(spark, folder):
    iso = dates.iso_timestamp(F.col("ts"))
    return table(spark, folder, "events").select("event_id", iso.alias("iso"), dates.iso_to_millis(iso).alias("ms"), dates.millis_to_iso(dates.iso_to_millis(iso)).alias("again"))


def _units(spark: SparkSession, folder: str) -> DataFrame:
    pairs = [("mg", "g", None), ("lb", "kg", None), ("degF", "Cel", None), ("mg/dL", "mmol/L", "glucose"), ("mg/dL", "umol/L", "creatinine"), ("in", "cm", None), ("mg/dL", "mmol/L", None), ("stone", "kg", None), ("mL", "L", None), ("C", "F", None)]
    case = lambda i: F.element_at(F.array(*(F.lit(p[i]) for p in pairs)), (F.col("l_partkey") % len(pairs) + 1).cast("int"))
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("value"), case(0).alias("source"), case(1).alias("target"), case(2).alias("analyte"))


@query
def unit_convert(spark, folder):
    done = units.convert(F.col("value"), F.col("source"), F.col("target"), F.col("analyte"))
    return _units(spark, folder).select("l_orderkey", "l_linenumber", F.round(done["value"], 6).alias("converted"), done["error"].alias("error"), units.canonical_for(F.col("source")).alias("canonical"))


@query
def coded_vocab(spark, folder):
    spec = F.lit("Building| Machinery |AUTOMOBILE")
    return table(spark, folder, "customer").select("c_custkey", coerce.is_allowed(F.col("c_mktsegment"), spec).alias("allowed"), coerce.canonical_code(F.col("c_mktsegment"), spec).alias("code"))


@query
def coerce_matrix(spark, folder):
    k = F.col("p_partkey") % 6
    value = F.when(k == 0, F.concat(F.col("p_size").cast("string"), F.lit(" mg"))).when(k == 1, "stage").when(k == 2, F.col("p_size").cast("string")).when(k == 3, "BUILDING").when(k == 4, F.concat(F.lit("19"), F.lpad((F.col("p_size") % 90 + 10).cast("string"), 2, "0"))).otherwise("12 parsec")
    target = F.when(k.isin(0, 5), "quantity_with_unit").when(k.isin(1, 2), "integer").when(k == 3, "coded_value").otherwise("partial_date")
    done = coerce.normalize(value, F.lit("text"), target, vocabulary=F.lit("building|machinery"), code_system=F.lit("local"))
    return table(spark, folder, "part").select("p_partkey", target.alias("target"), done["error"].alias("error"), done["value"].isNotNull().alias("sound"), F.get_json_object(done["value"], "$.code").alias("code"), F.get_json_object(done["value"], "$.year").cast("int").alias("year"))


# ---- notes


@query
def note_regex(spark, folder):
    found = notes.abstract(b.notes(spark, folder))
    lists = ("new_metastatic_sites", "treatments_mentioned", "uncertain_fields")
    return found.select("note_order", *(F.array_join(c, ",").alias(c) if c in lists else F.col(c) for c in found.columns if c not in ("patient_id", "note_order")))


def _merged_notes(spark: SparkSession, folder: str) -> DataFrame:
    return notes.merge_notes(notes.abstract(b.notes(spark, folder)))


@query
def note_merge(spark, folder):
    found = _merged_notes(spark, folder)
    return found.select("patient_id", *(F.array_join(c, ",").alias(c) if c in notes.LISTS else F.col(c) for c in found.columns if c != "patient_id"))


def _truth(spark: SparkSession, folder: str) -> DataFrame:
    """Each patient's first note as the truth that the merge is held against."""
    first = b.notes(spark, folder).groupBy("patient_id").agg(F.min_by("text", "note_order").alias("text"))
    return notes.abstract(first)


def _profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Truth of customers, their orders as administrations, progressions and biomarkers."""
    pick = lambda by, *xs: F.get(F.array(*map(F.lit, xs)), (by % len(xs)).cast("int"))
    c, k = F.col("c_custkey"), F.col("o_orderkey")
    states = {f"{g}_status": pick(c + i, "positive", "negative", "not_tested") for i, g in enumerate((*notes.GENES, "pdl1"))}
    patients = table(spark, folder, "customer").select(c.alias("patient_id"), pick(c, *notes.HISTOLOGIES).alias("histology"), pick(c, "IVA", "IIIB").alias("stage_at_advanced_diagnosis"), *(v.alias(n) for n, v in states.items()), (c % 100).cast("double").alias("pdl1_tps"), (c % 5).cast("int").alias("ecog"))
    orders = table(spark, folder, "orders").select(F.col("o_custkey").alias("patient_id"), k, k.alias("place"), F.to_date("o_orderdate").alias("day"), F.floor(k / 4).alias("r"))
    given = orders.select("patient_id", pick(F.col("r"), *notes.TREATMENTS).alias("display"), "place")
    progressions = orders.where(k % 4 != 3).select("patient_id", F.col("day").alias("event_date"), pick(F.col("r"), "to_advanced", "on_treatment_progression").alias("progression_type"), F.slice(F.array(*map(F.lit, notes.SITES)), 1, (F.col("r") % 4).cast("int")).alias("new_metastatic_sites"), "place")
    markers = orders.select("patient_id", pick(F.col("r"), "egfr", "kras", "alk").alias("biomarker_name"), pick(k, "positive", "positive", "negative").alias("result"), pick(F.floor(F.col("r") / 3), "Exon 19 deletion", "L858R", "p.G12C", "g12d and G12V", "wild type", None).alias("result_value"), "place")
    return notes.ground_truth(patients, given, progressions, markers)


@query
def note_truth(spark, folder):
    found = _profiles(spark, folder)
    return found.select(*(F.array_join(c, ",").alias(c) if c in notes.LISTS else F.col(c) for c in found.columns))


@query
def eval_scalar(spark, folder):
    return notes.scalar_scores(_truth(spark, folder), _merged_notes(spark, folder), "patient_id").select("field", "n", F.round("accuracy", 9).alias("accuracy"), F.round("miss_rate", 9).alias("miss_rate"))


@query
def eval_set_prf(spark, folder):
    found = notes.set_scores(_truth(spark, folder), _merged_notes(spark, folder), "patient_id")
    return found.select("field", "tp", "fp", "fn", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


@query
def eval_confusion(spark, folder):
    return notes.confusion(_truth(spark, folder), _merged_notes(spark, folder), "patient_id")


@query
def eval_labels(spark, folder):
    """labels.quality against a rule on the text: the share of letters."""
    docs = table(spark, folder, "documents").select("doc_id", (F.regexp_count("text", F.lit("[*#$%&!|]")) * 20 < F.char_length("text")).cast("string").alias("quality"))
    truth = table(spark, folder, "labels").where("quality IS NOT NULL").select("doc_id", (F.col("quality") == 1).cast("string").alias("quality"))
    return notes.confusion(truth, docs, "doc_id", ("quality",))


@query
def macro_accuracy(spark, folder):
    truth, found = _truth(spark, folder), _merged_notes(spark, folder)
    out = notes.macro_accuracy(notes.scalar_scores(truth, found, "patient_id"), notes.numeric_accuracy(truth, found, "patient_id"), notes.set_scores(truth, found, "patient_id"))
    return out.select(F.round("macro_accuracy", 9).alias("macro_accuracy"))
