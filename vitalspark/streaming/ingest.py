"""Incremental ingest: values from a stream of files, routed and stored batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from vitalspark import types
from vitalspark.operators import reconcile
from vitalspark.sources.store import Store, ingest


def tall_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Tall values from Parquet files as they arrive in a folder."""
    return spark.readStream.schema(types.TALL).parquet(folder)


def start(values: DataFrame, store: Store, checkpoint: str, router: reconcile.Router | None = None) -> StreamingQuery:
    """Store each micro-batch; one that is run again after a failure meets its own decisions in the log and adds none."""
    return values.writeStream.foreachBatch(lambda batch, _: ingest(store, batch, router) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
