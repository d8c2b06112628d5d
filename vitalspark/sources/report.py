"""Ingest of files with a report: what became of each file, line and column.

A file that can't be read, a line that can't be taken and a value that can't be coerced are told, and the
others go on.  Files are staged once; records and errors are made in one pass over them, written once, and counted as they are written; the
report is made from what was written, not from the files again.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from vitalspark.operators import reconcile
from vitalspark.session import scratch_folder
from vitalspark.sources import files
from vitalspark.sources.store import Store, ingest

#: Why a column is held back when no router is there.
HELD = "no registry knows it, and there is no router"


class IngestReport(NamedTuple):
    """files: name, format, n_records, n_line_errors, error; lines: name, line, error; held: source, source_column, source_data_type, reason, n; values: source, source_column, error, n; tallies: key, n; counts: totals, from the pass itself."""

    files: DataFrame
    lines: DataFrame
    held: DataFrame
    values: DataFrame
    tallies: DataFrame
    counts: dict[str, int]

    def rows(self) -> DataFrame:
        """The whole report as one table: part, name, what, detail, n."""
        text = lambda c: F.col(c).cast("string")
        none = F.lit(None).cast("string")
        parts = [
            self.files.select(F.lit("file").alias("part"), "name", F.col("format").alias("what"), F.col("error").alias("detail"), F.col("n_records").alias("n")),
            self.lines.groupBy("name", "error").agg(F.count("*").alias("n")).select(F.lit("line"), "name", F.col("error"), none, "n"),
            self.held.select(F.lit("held"), F.col("source"), "source_column", "source_data_type", "n"),
            self.values.select(F.lit("value"), F.col("source"), "source_column", "error", "n"),
            self.tallies.select(F.lit("tally"), none, "key", none, "n"),
        ]
        out = parts[0]
        for part in parts[1:]:
            out = out.union(part)
        return out.union(out.sparkSession.createDataFrame([(k, v) for k, v in self.counts.items()], "k string, n long").select(F.lit("total"), none, text("k"), none, "n"))


def parsed(found: DataFrame) -> DataFrame:
    """name, line, error, or a source record without them: all that files (name, text, format) give."""
    rows = files.csv_rows(found)
    records = files.fhir_records(found).unionByName(files.hl7_records(found)).unionByName(files.extract_records(rows))
    records = records.withColumns({"line": F.lit(None).cast("long"), "error": F.lit(None).cast("string")})
    wrong = files.errors(found).withColumn("line", F.lit(None).cast("long")).unionByName(files.line_errors(rows).withColumn("line", F.col("line").cast("long")))
    return records.unionByName(wrong, allowMissingColumns=True)


def ingest_files(store: Store, found: DataFrame, router: reconcile.Router | None = None) -> IngestReport:
    """Store the values of files (name, text, format), routed by registries and, if there is one, a router, and report on it.

    Without a router columns that no registry knows are held back, not stored.
    """
    spark, found = found.sparkSession, files.staged(found)
    folder, seen = scratch_folder(spark), Observation("parsed")
    bad, whole = F.col("error").isNotNull(), F.col("line").isNull()
    outcome = parsed(found).observe(seen, F.count_if(~bad).alias("records"), F.count_if(bad & whole).alias("file_errors"), F.count_if(bad & ~whole).alias("line_errors"))
    outcome.write.parquet(folder)
    outcome = spark.read.schema(outcome.schema).parquet(folder)
    good = outcome.where("error IS NULL")
    values = files.tall(good)
    kept = values if router is not None else reconcile.offline(values)[0]
    rest = values.join(kept.select(*reconcile.CACHE_KEY).distinct(), list(reconcile.CACHE_KEY), "left_anti")
    held = rest.groupBy("source", "source_column").agg(F.min("source_data_type").alias("source_data_type"), F.lit(HELD).alias("reason"), F.count("*").alias("n"))
    tallies = ingest(store, kept, router if router is not None else reconcile.rule_router(store.table("dictionary")))
    coerced = reconcile.normalise(kept, store.latest_decisions(), store.table("dictionary"))
    wrong = coerced.where("error IS NOT NULL").groupBy("source", "source_column", "error").agg(F.count("*").alias("n"))

    taken = kept.select("external_id", "source").distinct().join(good.select("name", "external_id", "source"), ["external_id", "source"]).groupBy("name").agg(F.count("*").alias("n_records"))
    errors = outcome.where("error IS NOT NULL").groupBy("name").agg(F.min(F.when(F.col("line").isNull(), F.col("error"))).alias("error"), F.count("line").alias("n_line_errors"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    per_file = found.select("name", "format").join(taken, "name", "left").join(errors, "name", "left").select("name", "format", zero("n_records"), zero("n_line_errors"), "error")
    lines = outcome.where("error IS NOT NULL AND line IS NOT NULL").select("name", "line", "error")
    return IngestReport(per_file, lines, held, wrong, tallies, {k: int(v) for k, v in seen.get.items()})
