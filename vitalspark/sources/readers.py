"""Readers that tell what is missing, malformed and empty apart, and fall back along a chain of places."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalspark.session import exists
from vitalspark.sources import synthetic
from vitalspark.sources.store import Store

CORRUPT = "_corrupt"
#: What a snapshot of decisions holds.
SNAPSHOT = "source string, source_column string, canonical_name string, decided_by string, similarity_score double, verdict string, reason string, decided_at string"
#: Patients of the built-in cohort, where no other is found.
BUILT_IN = 12


class Read(NamedTuple):
    """rows, and where they came from."""

    rows: DataFrame
    origin: str


def read_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows of the schema, (text) of lines that are none); blank lines are neither."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", f"{schema}, {CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("x"))
    bad = F.col("x").isNull() | F.col(f"x.{CORRUPT}").isNotNull()
    return parsed.where(~bad).select("x.*").drop(CORRUPT), parsed.where(bad).select(F.col("value").alias("text"))


def bundles_of(patients: DataFrame, files: DataFrame) -> DataFrame:
    """patient_id, status (found, missing, empty, malformed, no bundle), bundle (variant; null unless found) for each patient_id of patients.

    files: (name, text), a file <patient_id>.json for each; of several with one name the least text counts.
    """
    named = files.select(F.regexp_extract("name", r"([^/]+)\.json$", 1).alias("patient_id"), F.coalesce("text", F.lit("")).alias("text")).groupBy("patient_id").agg(F.min("text").alias("text"))
    rows = patients.select("patient_id").join(named, "patient_id", "left").withColumn("parsed", F.try_parse_json("text"))
    kind = F.try_variant_get("parsed", "$.resourceType", "string")
    status = F.when(F.col("text").isNull(), "missing").when(F.trim("text") == "", "empty").when(F.col("parsed").isNull(), "malformed").when(kind.eqNullSafe("Bundle"), "found").otherwise("no bundle")
    return rows.select("patient_id", status.alias("status"), F.when(status == "found", F.col("parsed")).alias("bundle"))


def load_bundle(spark: SparkSession, patient_id: str, folder: str) -> tuple[str, str | None]:
    """(status, JSON text or None) of one patient's <folder>/fhir/<patient_id>.json."""
    path = f"{folder.rstrip('/')}/fhir/{patient_id}.json"
    if not exists(spark, path):
        return "missing", None
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("name"), F.decode("content", "UTF-8").alias("text"))
    row = bundles_of(spark.createDataFrame([(patient_id,)], "patient_id string"), files).select("status", F.to_json("bundle").alias("bundle")).first()
    return ("empty" if row["status"] == "missing" else row["status"]), row["bundle"]  # Spark gives no row for a file without bytes


def load_patients(spark: SparkSession, *folders: str) -> Read:
    """Patients of the first folder that has any in csv/patients.csv; the built-in cohort if none has: never no patients."""
    for folder in folders:
        path = f"{folder.rstrip('/')}/csv/patients.csv"
        if exists(spark, path):
            rows = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
            if "patient_id" in rows.columns and rows.where("patient_id IS NOT NULL").limit(1).count():
                return Read(rows.where("patient_id IS NOT NULL"), folder)
    return Read(synthetic.patients(spark, BUILT_IN), "built-in")


def write_snapshot(decisions: DataFrame, path: str) -> None:
    """Decisions as a CSV snapshot."""
    decisions.select(*(c.split()[0] for c in SNAPSHOT.split(", "))).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def load_decisions(spark: SparkSession, snapshot: str, store: Store) -> Read:
    """Decisions, oldest first, of a CSV snapshot (origin 'snapshot'); of the store (origin 'store') if there is none."""
    columns = [c.split()[0] for c in SNAPSHOT.split(", ")]
    if exists(spark, snapshot):
        rows = spark.read.schema(SNAPSHOT).option("header", "true").option("escape", '"').option("multiLine", "true").csv(snapshot)
        return Read(rows.orderBy("decided_at"), "snapshot")
    return Read(store.table("decisions").orderBy("decided_at").select(*(F.col(c).cast("string").alias(c) if c == "decided_at" else c for c in columns)), "store")
