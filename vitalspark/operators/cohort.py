"""Cohort filters, eligibility, counts and event logs."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Diagnosis codes of the disease, morphology codes that confirm it and that exclude, stages and events that make it advanced, and when records begin.
DISEASE_CODE = r"^(C34(\.[0-9]+)?|C39\.9|162(\.[0-9]+)?)$"
MORPHOLOGIES, SMALL_CELL = ("8046/3", "8140/3", "8070/3", "8012/3", "8560/3", "8033/3", "8255/3"), ("8041/3", "8042/3", "8043/3", "8044/3", "8045/3")
ADVANCED_STAGES, ADVANCED_EVENTS, RECORDS_SINCE = ("IIIB", "IIIC", "IVA", "IVB"), ("to_advanced", "metastatic_recurrence"), "2011-01-01"
#: Histologies that the cohort includes.
HISTOLOGIES = ("adenocarcinoma", "squamous_cell_carcinoma", "large_cell_carcinoma", "adenosquamous_carcinoma", "sarcomatoid_carcinoma", "nsclc_nos")


def cohort_filter(rows: DataFrame, age: str = "age", age_min: int | None = None, age_max: int | None = None, **fields: Iterable | None) -> DataFrame:
    """Rows whose age is in the inclusive range, and whose every named field, as text, is one of the given values; None asks nothing."""
    if age_min is not None:
        rows = rows.where(F.col(age) >= age_min)
    if age_max is not None:
        rows = rows.where(F.col(age) <= age_max)
    for name, values in fields.items():
        if values is not None:
            rows = rows.where(F.col(name).cast("string").isin(*map(str, values)))
    return rows


def eligibility(patients: DataFrame, histology: str = "histology", diagnosed: str = "advanced_diagnosis_date", stage: str = "stage_at_advanced_diagnosis", histologies: tuple[str, ...] = HISTOLOGIES, stages: tuple[str, ...] = ("IIIB", "IIIC", "IVA", "IVB")) -> DataFrame:
    """patients with three inclusion flags, two exclusions that are never true, and is_eligible (which asks only for a known histology); null where a value is null."""
    known = F.col(histology).isNotNull() & F.col(diagnosed).isNotNull() & F.col(stage).isin(*stages)
    return patients.withColumns(
        {
            "inc_histology": F.col(histology).isin(*histologies),
            "inc_advanced_date": F.col(diagnosed).isNotNull(),
            "inc_stage": F.col(stage).isin(*stages),
            "exc_other_primary": F.lit(False),
            "exc_trial_only": F.lit(False),
            "is_eligible": known,
        }
    )


def value_counts(rows: DataFrame, fields: Iterable[str]) -> DataFrame:
    """field, value, n, pct: counts of each non-null value, percent of all rows, the most frequent of a field first."""
    fields = list(fields)
    tall = rows.select(*(F.col(f).cast("string").alias(f) for f in fields)).unpivot([], fields, "field", "value")
    counts = tall.groupBy("field", "value").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("field"))
    return counts.withColumn("pct", 100.0 * F.col("n") / total).where("value IS NOT NULL").orderBy("field", F.col("n").desc(), "value")


def cooccurrence(rows: DataFrame, flags: Mapping[str, Column]) -> DataFrame:
    """a, b, n: rows on which both of two flags hold, for each pair (a <= b) of their names, in one pass."""
    names = sorted(flags)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    one = rows.agg(*(F.count_if(flags[a] & flags[b]).alias(f"{a}|{b}") for a, b in pairs))
    tall = one.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "n")
    return tall.select(F.split("pair", r"\|")[0].alias("a"), F.split("pair", r"\|")[1].alias("b"), "n")


def nearest(left: DataFrame, right: DataFrame, key: str, at: str, when: str, days: int, keep: tuple[str, ...]) -> DataFrame:
    """left with `keep` of the row of right of the same key that lies nearest in time, at most `days` away; of two as near the earlier, then the least values.

    Each right row is sent to the at most three stretches of `days` days that it can serve, so that the join is on equal keys.
    """
    slot = F.floor(F.unix_date(F.col(at)) / F.lit(days))
    # Equal rows are matched once and come back as often as they were there.
    l = left.groupBy(*left.columns).agg(F.count("*").alias("_times")).withColumn("_slot", slot)
    other = right.select(key, F.col(when).alias("_when"), *keep, F.floor(F.unix_date(F.col(when)) / F.lit(days)).alias("_base"))
    other = other.select(key, "_when", *keep, F.explode(F.array(F.col("_base") - 1, F.col("_base"), F.col("_base") + 1)).alias("_slot"))
    near = l.join(other, [key, "_slot"], "left").withColumn("_far", F.abs(F.datediff("_when", F.col(at))))
    fits = F.when(F.col("_far") <= days, F.struct("_far", "_when", *keep))
    best = near.groupBy(*left.columns, "_times").agg(F.min(fits).alias("_best")).withColumn("_time", F.explode(F.sequence(F.lit(1), "_times")))
    return best.select(*left.columns, F.col("_best._when").alias(when), *(F.col(f"_best.{c}").alias(c) for c in keep))


def select_cohort(patients: DataFrame, conditions: DataFrame, progressions: DataFrame, encounters: DataFrame, ecog: DataFrame, since: str = RECORDS_SINCE) -> DataFrame:
    """patient_id, advanced_diagnosis_date, histology, stage_at_advanced_diagnosis, age_at_advanced_diagnosis, ecog_at_advanced_diagnosis of the patients that meet all criteria.

    patients: patient_id, is_test, sex, date_of_birth. conditions: patient_id, code, morphology, stage, onset_date. progressions: patient_id, event_date,
    progression_type, stage. encounters: patient_id, encounter_date. ecog: patient_id, measured_on, ecog.
    The disease is diagnosed at the earliest onset of one of its codes (of equal ones the least stage), advanced then by its stage or else by the earliest event
    that says so; a morphology has to confirm it, and none may be of small cells. One diagnosed before `since` needs a later event. Patients are of age, of
    known sex, with two visits since then, one of them in the 90 days from the advanced diagnosis. A null never meets a criterion.
    """
    ours = F.coalesce(F.col("code").rlike(DISEASE_CODE), F.lit(False)) & F.col("onset_date").isNotNull()
    per = conditions.groupBy("patient_id").agg(
        F.min(F.when(ours, F.struct("onset_date", "stage"))).alias("first"), F.min(F.when(F.col("morphology").isin(*MORPHOLOGIES), F.struct("onset_date", "morphology"))).alias("confirmed"),
        F.coalesce(F.bool_or(F.col("morphology").isin(*SMALL_CELL)), F.lit(False)).alias("small"),
    )
    later = progressions.where(F.col("progression_type").isin(*ADVANCED_EVENTS)).groupBy("patient_id").agg(F.min(F.struct("event_date", "stage")).alias("later"))
    at_first = F.coalesce(F.col("first.stage").isin(*ADVANCED_STAGES), F.lit(False))
    found = per.where("first IS NOT NULL AND confirmed IS NOT NULL AND NOT small").join(later, "patient_id", "left")
    found = found.where((F.col("first.onset_date") >= F.lit(since).cast("date")) | F.col("later").isNotNull()).select(
        "patient_id", F.when(at_first, F.col("first.onset_date")).otherwise(F.col("later.event_date")).alias("advanced_diagnosis_date"), F.col("confirmed.morphology").alias("histology"),
        F.when(at_first, F.col("first.stage")).otherwise(F.col("later.stage")).alias("stage_at_advanced_diagnosis"),
    ).where("advanced_diagnosis_date IS NOT NULL")
    age = F.floor(F.months_between("advanced_diagnosis_date", "date_of_birth") / 12).cast("int")
    known = patients.where(~F.coalesce("is_test", F.lit(False)) & F.lower("sex").isin("male", "female")).select("patient_id", "date_of_birth")
    found = found.join(known, "patient_id").withColumn("age_at_advanced_diagnosis", age).where("age_at_advanced_diagnosis >= 18").drop("date_of_birth")
    days = F.datediff("encounter_date", "advanced_diagnosis_date")
    active = encounters.where(F.col("encounter_date") >= F.lit(since).cast("date")).join(found.select("patient_id", "advanced_diagnosis_date"), "patient_id")
    active = active.groupBy("patient_id").agg(F.count("*").alias("n"), F.bool_or(days.between(0, 90)).alias("soon")).where("n >= 2 AND soon")
    found = found.join(active.select("patient_id"), "patient_id", "left_semi")
    found = nearest(found, ecog.select("patient_id", "measured_on", "ecog"), "patient_id", "advanced_diagnosis_date", "measured_on", 30, ("ecog",))
    return found.withColumnRenamed("ecog", "ecog_at_advanced_diagnosis").drop("measured_on")


def event_log(parts: Mapping[str, tuple[DataFrame, Column, Column]]) -> DataFrame:
    """date, type, detail of several event tables, oldest first, rows without a date last. parts: type -> (rows, date, detail)."""
    out = None
    for kind, (rows, date, detail) in parts.items():
        one = rows.select(date.cast("date").alias("date"), F.lit(kind).alias("type"), detail.cast("string").alias("detail"))
        out = one if out is None else out.unionByName(one)
    return out.orderBy(F.col("date").asc_nulls_last(), "type", "detail")


def medication_timeline(medications: DataFrame) -> DataFrame:
    """patient_id, drug, start, end: rows with a sound start, end defaulting to it, by start."""
    start = F.try_to_date(F.col("start_date"), "yyyy-MM-dd")
    end = F.try_to_date(F.coalesce(F.nullif(F.col("end_date"), F.lit("")), F.col("start_date")), "yyyy-MM-dd")
    return medications.select("patient_id", F.col("display").alias("drug"), start.alias("start"), end.alias("end")).where("start IS NOT NULL AND end IS NOT NULL").orderBy("start", "drug")


def patient_card(patients: DataFrame) -> DataFrame:
    """patient_id, label, date: date of death, or last known alive."""
    dead = F.lower("vital_status") == "deceased"
    return patients.select("patient_id", F.when(dead, "Date of death").otherwise("Last known alive").alias("label"), F.coalesce(F.nullif(F.col("date_of_death"), F.lit("")), F.col("last_known_alive_date")).alias("date"))


def patient_events(tables: Mapping[str, DataFrame], patient_id: str) -> dict[str, DataFrame]:
    """Each event table's rows of one patient."""
    return {name: rows.where(F.col("patient_id") == patient_id) for name, rows in tables.items()}


def dictionary_search(rows: DataFrame, text: str = "", tags: Iterable[str] = ()) -> DataFrame:
    """Dictionary rows with `text`, in any case, in name, description or vocabulary, and one of `tags` (pipe-separated in semantic_tags)."""
    if text:
        parts = [F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(text.lower())) for c in ("name", "description", "controlled_vocabulary")]
        rows = rows.where(parts[0] | parts[1] | parts[2])
    tags = list(tags)
    if tags:
        rows = rows.where(F.arrays_overlap(F.split("semantic_tags", r"\|"), F.array(*map(F.lit, tags))))
    return rows


def dictionary_tags(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode(F.split("semantic_tags", r"\|")).alias("tag")).where("tag <> ''").distinct().orderBy("tag")
