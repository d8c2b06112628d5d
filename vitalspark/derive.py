"""Derived variables of a cohort folder: lines of therapy, their warnings, overall survival and a summary.

    python -m vitalspark.derive FOLDER

A cohort folder, or its subfolder csv, holds patients.csv, and can hold medication_administrations.csv and progression_events.csv.
"""

from __future__ import annotations

import json
import sys
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalspark.functions.dates import resolve_date
from vitalspark.operators import survival, therapy
from vitalspark.session import exists, session
from vitalspark.sources.files import read_extract


class Derived(NamedTuple):
    """Frames of a run; summary is one row: patients, treated ones, percent that reach later lines, median survival with its interval."""

    patients: DataFrame
    lines: DataFrame
    warnings: DataFrame
    records: DataFrame
    curve: DataFrame
    first_line_classes: DataFrame
    summary: DataFrame


def cohort_folder(spark: SparkSession, folder: str) -> str:
    """Where the extracts are: the folder itself or its subfolder csv."""
    for place in (folder.rstrip("/"), f"{folder.rstrip('/')}/csv"):
        if exists(spark, f"{place}/patients.csv"):
            return place
    raise FileNotFoundError(f"no patients.csv in {folder} or its subfolder csv")


def _extract(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """An extract with at least these columns, those that it lacks null; without the file no rows."""
    rows = read_extract(spark, path) if exists(spark, path) else spark.createDataFrame([], ", ".join(f"{c} string" for c in columns))
    return rows.withColumns({c: F.lit(None).cast("string") for c in columns if c not in rows.columns})


def derive(spark: SparkSession, folder: str) -> Derived:
    place = cohort_folder(spark, folder)
    patients = _extract(spark, f"{place}/patients.csv", ("patient_id", "advanced_diagnosis_date", "vital_status", "date_of_death", "last_known_alive_date", "age_at_advanced_diagnosis"))
    given = _extract(spark, f"{place}/medication_administrations.csv", ("patient_id", "display", "drug_name", "medication_code", "start_date", "end_date", "drug_class"))
    progressed = therapy.progressions(_extract(spark, f"{place}/progression_events.csv", ("patient_id", "event_date", "progression_type")))
    deaths = patients.where(F.lower("vital_status") == "deceased").select("patient_id", resolve_date(F.col("date_of_death")).alias("death_date"))
    lines = therapy.lines_of_therapy(therapy.administrations(given), progressed, deaths)
    index = patients.select("patient_id", resolve_date(F.col("advanced_diagnosis_date")).alias("index_date"))
    records = survival.survival_records(patients)
    curve = survival.kaplan_meier(records)
    return Derived(patients, lines, therapy.validate(lines, index), records, curve, therapy.first_line_classes(lines), therapy.summary(patients, lines, survival.median_with_ci(curve)))


def main(folder: str) -> None:
    spark = session("derive")
    found = derive(spark, folder)
    classes = {r["drug_class"]: r["n"] for r in found.first_line_classes.collect()}  # as many as there are classes
    print(json.dumps(found.summary.first().asDict() | {"line1_drug_class_distribution": classes}, default=str))


if __name__ == "__main__":
    main(sys.argv[1])
