"""CORE load: nested patient profiles (JSON lines) as four flat tables, with the profiles that can't be read beside them.

The profiles are read once, with a schema: what is not in it is not parsed.  Each table is an explode of its own
over what was read; a profile without events has no rows in their tables.  A line that is no JSON, or whose
types don't fit, is kept as text; so is a profile without patient_id.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalspark.functions import payloads

_ADMINISTRATION = "medication_id string, rxnorm_code string, display string, drug_class string, start_date date, end_date date, dose_value double, dose_unit string, route string, regimen_id string"
_PROGRESSION = "progression_id string, event_date date, progression_type string, evidence_source string, new_metastatic_sites array<string>"
_BIOMARKER = "biomarker_id string, biomarker_name string, result string, result_date date, test_method string"
#: Dates of a patient that are stored as payloads, and columns that are stored as they are.
DATES = ("date_of_birth", "date_of_death", "last_known_alive_date", "initial_nsclc_diagnosis_date", "advanced_diagnosis_date")
PLAIN = (
    "sex string", "race string", "ethnicity string", "vital_status string", "state_of_residence string", "practice_type string", "practice_id string", "smoking_status string", "advanced_diagnosis_pathway string", "histology string", "stage_at_initial_diagnosis string",
    "stage_at_advanced_diagnosis string", "ajcc_edition string", "ecog_at_advanced_diagnosis int", "age_at_advanced_diagnosis int", "egfr_status string", "alk_status string", "ros1_status string", "kras_status string", "braf_status string", "pdl1_status string", "pdl1_tps_value double",
)
CORRUPT = "_corrupt"
PROFILE = ", ".join(["patient_id string", "source_format string", *(f"{d} date" for d in DATES), *PLAIN, f"drug_administrations array<struct<{_ADMINISTRATION.replace(' ', ':').replace(',:', ', ')}>>", f"progression_events array<struct<{_PROGRESSION.replace(' ', ':').replace(',:', ', ')}>>", f"biomarker_results array<struct<{_BIOMARKER.replace(' ', ':').replace(',:', ', ')}>>"])


class Core(NamedTuple):
    """The four tables, and rejected: (text, reason)."""

    patient: DataFrame
    medication_administration: DataFrame
    progression_event: DataFrame
    biomarker_result: DataFrame
    rejected: DataFrame


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """text of each line."""
    return spark.read.text(path).select(F.col("value").alias("text")).where(F.trim("text") != "")


def load(lines: DataFrame, cutoff: str) -> Core:
    """CORE tables of profiles (text); cutoff: the day up to which the data goes."""
    corrupt = F.from_json("text", f"{PROFILE}, {CORRUPT} string", {"columnNameOfCorruptRecord": CORRUPT, "mode": "PERMISSIVE", "dateFormat": "yyyy-MM-dd"})
    parsed = lines.select("text", corrupt.alias("p"))
    bad = F.when(F.col("p").isNull() | F.col(f"p.{CORRUPT}").isNotNull(), "no profile").when(F.col("p.patient_id").isNull(), "no patient_id")
    parsed = parsed.withColumn("reason", bad)
    good = parsed.where("reason IS NULL").select("p.*").drop(CORRUPT)
    day = F.lit(cutoff).cast("date")
    patient = good.select(
        "patient_id", *(payloads.partial_date(F.col(d)).alias(d) for d in DATES), F.col("advanced_diagnosis_date").alias("advanced_diagnosis_date_iso"), *(c.split()[0] for c in PLAIN), day.alias("data_cutoff_date"),
        F.to_json(F.array(F.struct(F.col("source_format").alias("source"), F.col("patient_id").alias("external_id")))).alias("_meta_source_records"),
    )

    def events(column: str) -> DataFrame:
        return good.select("patient_id", F.explode(column).alias("e")).select("patient_id", "e.*")

    drugs, steps, tests = map(events, ("drug_administrations", "progression_events", "biomarker_results"))
    return Core(
        patient,
        drugs.select("medication_id", "patient_id", payloads.coded(F.col("rxnorm_code"), "rxnorm", F.col("display")).alias("medication_code"), "drug_class", *(payloads.partial_date(F.col(c)).alias(c) for c in ("start_date", "end_date")), payloads.quantity(F.col("dose_value"), F.col("dose_unit")).alias("dose"), "route", "regimen_id"),
        steps.select("progression_id", "patient_id", payloads.partial_date(F.col("event_date")).alias("event_date"), "progression_type", "evidence_source", "new_metastatic_sites"),
        tests.select("biomarker_id", "patient_id", "biomarker_name", "result", payloads.partial_date(F.col("result_date")).alias("result_date"), "test_method"),
        parsed.where("reason IS NOT NULL").select("text", "reason"),
    )


def write(core: Core, folder: str) -> None:
    """Each table as a Parquet folder, written anew."""
    for name, rows in core._asdict().items():
        rows.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")
