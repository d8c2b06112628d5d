"""A gate before a table: rows get their defaults, are held against the table's constraints and its keys, and go to the table or to quarantine.

All constraints of single rows are one pass; keys are checked within the batch and against what is stored.
A row is turned away with every reason it has.  Of rows of one key in a batch the first by `order` is taken.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitalspark.operators import reconcile
from vitalspark.sources.versions import BUCKET, NEW, VersionedTable
from vitalspark.types import LOGICAL_TYPES, VERDICTS


def _listed(values) -> str:
    return ", ".join(f"'{x}'" for x in values)


class Constraints(NamedTuple):
    """defaults: column -> SQL for its nulls; required: columns that can't be null; checks: reason -> SQL that must not be false; keys: each a tuple of columns that no two rows share; order: columns by which the first row of a key is told."""

    defaults: Mapping[str, str] = {}
    required: tuple[str, ...] = ()
    checks: Mapping[str, str] = {}
    keys: tuple[tuple[str, ...], ...] = ()
    order: tuple[str, ...] = ()


_TYPE = {"unknown data type": f"data_type IN ({_listed(LOGICAL_TYPES)})"}
WORKSPACE = {"workspace_key": "'default'"}
#: Of the engine's own tables.
TABLES = {
    "dictionary": Constraints(required=("name", "data_type"), checks=_TYPE, keys=(("name",),), defaults={"semantic_tags": "array()"}, order=("name",)),
    "schema_rows": Constraints(WORKSPACE | {"is_global": "false"}, ("id", "workspace_key", "pkey", "canonical_name", "data_type", "first_seen_at", "updated_at"), _TYPE, (("id",), ("workspace_key", "pkey", "canonical_name")), ("first_seen_at", "id")),
    "decisions": Constraints(WORKSPACE | {"is_global_target": "false", "needs_review": "false"}, ("id", "workspace_key", "pkey", "source", "source_column", "verdict", "decided_by", "decided_at"), {"unknown verdict": f"verdict IN ({_listed(VERDICTS)})", "score outside 0 to 1": "similarity_score BETWEEN 0 AND 1"}, (("id",),), ("decided_at", "id")),
    "signals": Constraints(WORKSPACE, ("id", "workspace_key", "pkey", "source", "external_id", "ingested_at"), {}, (("id",), ("workspace_key", "source", "external_id")), ("ingested_at", "id")),
}


def judged(rows: DataFrame, constraints: Constraints, stored: DataFrame | None = None) -> DataFrame:
    """rows with their defaults, and _reasons: why a row can't be written, in a fixed order; empty for one that can.

    A row with a null in a key doesn't share that key with any other.
    """
    c = constraints
    rows = rows.withColumns({k: F.coalesce(k, F.expr(v).cast(rows.schema[k].dataType)) for k, v in c.defaults.items()}) if c.defaults else rows
    reasons = [F.when(F.col(k).isNull(), F.lit(f"{k} is missing")) for k in c.required] + [F.when(~F.coalesce(F.expr(v), F.lit(True)), F.lit(k)) for k, v in c.checks.items()]
    rows = rows.withColumn("_reasons", F.filter(F.array(*reasons, F.lit(None).cast("string")), lambda x: x.isNotNull()))
    sound = F.size("_reasons") == 0  # a row that is turned away anyway takes no key from another
    order = [F.col(x).asc_nulls_last() for x in c.order or rows.columns[:1]]
    for key in c.keys:
        whole = F.lit(True)
        for k in key:
            whole = whole & F.col(k).isNotNull()
        place = F.row_number().over(Window.partitionBy(*key, sound).orderBy(*order))
        name = ", ".join(key)
        rows = rows.withColumn("_again", F.when(sound & whole & (place > 1), F.lit(f"{name} stands twice")))
        if stored is not None:
            taken = stored.select(*key).where(" AND ".join(f"`{k}` IS NOT NULL" for k in key)).distinct().withColumn("_taken", F.lit(True))
            rows = rows.join(taken, list(key), "left").withColumn("_again", F.coalesce(F.when(F.col("_taken"), F.lit(f"{name} is taken")), "_again")).drop("_taken")
        rows = rows.withColumn("_reasons", F.when(F.col("_again").isNotNull(), F.array_append("_reasons", F.col("_again"))).otherwise(F.col("_reasons"))).drop("_again")
    return rows


def write(table: VersionedTable, quarantine: VersionedTable, rows: DataFrame, constraints: Constraints, staged: str) -> dict[str, int]:
    """Insert the rows that pass into the table, append the others to quarantine (the table's columns and `reasons`); how many of either.  staged: a folder for the rows as judged, so that they are judged once.

    A writer that takes a key between check and commit keeps it.
    """
    spark = rows.sparkSession
    judged(rows.select(*table.columns), constraints, table.read()).write.parquet(staged)
    done = spark.read.parquet(staged)
    good, bad = done.where(F.size("_reasons") == 0).drop("_reasons"), done.where(F.size("_reasons") > 0).withColumnRenamed("_reasons", "reasons")
    counts = {"written": good.count(), "rejected": bad.count()}
    if counts["rejected"]:
        quarantine.append(bad)
    if counts["written"]:
        if table.key:
            table.upsert(good, lambda x: reconcile.newest(x.withColumn("_old", (~F.col(NEW)).cast("int")), (BUCKET, *table.key), "_old"))
        else:
            table.append(good)
    return counts
