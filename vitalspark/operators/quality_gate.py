"""Checks of a population: one row with the number of failures for each."""

from __future__ import annotations

import functools
from collections.abc import Callable, Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitalspark.types import LOGICAL_TYPES, VERDICTS

class Failing(NamedTuple):
    """A check of single rows: those of a table that meet an SQL condition fail."""

    table: str
    condition: str


#: A check of rows, or a function that gives the rows that fail.
Check = Failing | Callable[[Mapping[str, DataFrame]], DataFrame]


def run(tables: Mapping[str, DataFrame], checks: Mapping[str, Check]) -> DataFrame:
    """check, n_fail, status (PASS or FAIL).  All checks of single rows of a table are one pass over it."""
    parts, rows = [], {}
    for name, check in checks.items():
        if isinstance(check, Failing):
            rows.setdefault(check.table, {})[name] = check.condition
        else:
            parts.append(check(tables).agg(F.count("*").alias("n_fail")).select(F.lit(name).alias("check"), "n_fail"))
    for table, conditions in rows.items():
        counts = tables[table].agg(*(F.count_if(F.expr(x)).alias(name) for name, x in conditions.items()))
        parts.append(counts.unpivot([], list(conditions), "check", "n_fail"))
    out = functools.reduce(DataFrame.unionByName, parts)
    return out.withColumn("status", F.when(F.col("n_fail") == 0, "PASS").otherwise("FAIL"))


def _listed(values: tuple) -> str:
    return ", ".join(f"'{x}'" for x in values)


def missing(table: str, column: str) -> Check:
    return Failing(table, f"{column} IS NULL")


def outside(table: str, column: str, values: tuple[str, ...], null: bool = False) -> Check:
    """Rows with another value; with null also those without one."""
    return Failing(table, f"{column} NOT IN ({_listed(values)})" + f" OR {column} IS NULL" * null)


def before(table: str, earlier: str, later: str) -> Check:
    """Rows whose later date lies before the earlier one."""
    return Failing(table, f"{later} < {earlier}")


def repeated(table: str, *key: str) -> Check:
    return lambda t: t[table].groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: str, key: str, parent: str, parent_key: str) -> Check:
    return lambda t: t[child].join(t[parent].select(F.col(parent_key).alias(key)), key, "left_anti")


def unordered(table: str, key: str, place: str, start: str) -> Check:
    """Rows that start before the row before them."""
    return lambda t: t[table].withColumn("_before", F.lag(start).over(Window.partitionBy(key).orderBy(place))).where(F.col(start) < F.col("_before"))


#: Checks of the decision store's constraints.
STORE_CHECKS: dict[str, Check] = {
    "verdict": outside("decisions", "verdict", tuple(VERDICTS)),
    "data_type": outside("dictionary", "data_type", tuple(LOGICAL_TYPES)),
    "dictionary_key": lambda t: t["dictionary"].groupBy("name").agg(F.count("*").alias("n")).where("n > 1"),
    "signal_key": lambda t: t["signals"].where("external_id IS NOT NULL").groupBy("workspace_key", "source", "external_id").agg(F.count("*").alias("n")).where("n > 1"),
}

#: Results that a biomarker can have, and stages at the advanced diagnosis.
BIOMARKER_RESULTS, STAGES = ("positive", "negative", "not_tested", "unknown", "high", "low"), ("IIIB", "IIIC", "IVA", "IVB")


def _with_diagnosis(t: Mapping[str, DataFrame], table: str) -> DataFrame:
    return t[table].join(t["patients"].select("patient_id", "advanced_diagnosis_date"), "patient_id")


#: Checks of a cohort: tables patients, medications, progressions, biomarkers, lines, survival.
COHORT_CHECKS: dict[str, Check] = {
    "non_null_ids": Failing("patients", "patient_id IS NULL OR cast(patient_id AS string) = '' OR advanced_diagnosis_date IS NULL"),
    "initial_before_advanced": before("patients", "initial_nsclc_diagnosis_date", "advanced_diagnosis_date"),
    "progressions_after_advanced": lambda t: _with_diagnosis(t, "progressions").where("event_date < advanced_diagnosis_date"),
    "biomarker_vocab": outside("biomarkers", "result", BIOMARKER_RESULTS, null=True),
    "stage_vocab": outside("patients", "stage_at_advanced_diagnosis", STAGES, null=True),
    "death_date": Failing("patients", "vital_status = 'deceased' AND date_of_death IS NULL"),
    "death_after_diagnosis": before("patients", "advanced_diagnosis_date", "date_of_death"),
    "treatment_after_diagnosis": lambda t: _with_diagnosis(t, "medications").where("start_date < advanced_diagnosis_date"),
    "biomarker_patient": orphans("biomarkers", "patient_id", "patients", "patient_id"),
    "survival_not_negative": Failing("survival", "os_days < 0"),
    "lot_ordering": unordered("lines", "patient_id", "line_number", "start_date"),
    "lot_numbers": lambda t: t["lines"].groupBy("patient_id").agg(F.count("*").alias("n"), F.max("line_number").alias("m")).where("n <> m"),
}
