"""Streams that keep state by key: the last signal of each subject, and values that wait for the decision on their column.

- latest_signals() is Spark's own streaming aggregation: rows may come in any order and late, as what counts is
  when they happened, not when they came.
- start_routing() joins values with decisions that come on a stream of their own, before or after them.  Its state
  is two tables: the last decision of each cache key, and the values that wait for one; each value leaves once.
  A key whose first value has no decision leaves a request, once.  A batch is a few joins of all its keys, so
  that a key costs a row, not calls of its own, and one with many waiting values needs no memory for all.

State is in the checkpoint: after a restart a stream goes on as if it had never ended.  Nulls in a key are a
key of their own.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vitalspark.operators.reconcile import CACHE_KEY
from vitalspark.sources.store import Store

DECISION = ("verdict", "canonical_name", "decided_by", "decided_at", "id")
VALUE = ("external_id", "occurred_at", "value")
ROUTED = "workspace_key string, pkey string, source string, source_column string, external_id string, occurred_at string, value string, verdict string, canonical_name string, decided_by string, kind string"
#: State of start_routing(); batch: the one that a waiting value came with.
KNOWN = "workspace_key string, pkey string, source string, source_column string, verdict string, canonical_name string, decided_by string, decided_at timestamp, id string"
WAITING = "workspace_key string, pkey string, source string, source_column string, external_id string, occurred_at string, value string, batch long"


def latest_signals(signals: DataFrame, key: tuple[str, ...] = ("workspace_key", "pkey"), time: str = "occurred_at", tie: str = "id") -> DataFrame:
    """The last signal of each subject by (time, tie), as the stream stands; for output mode complete or update."""
    rest = [c for c in signals.columns if c not in key]
    last = signals.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(time, tie)).alias("last"))
    return last.select(*key, "last.*")


def route(values: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(values that wait, ROUTED values): by whether a decision on their column is known (KNOWN, a row for each key)."""
    last = known.select(*(F.col(k).alias(f"_{k}") for k in CACHE_KEY), *DECISION[:3])
    same = functools.reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in CACHE_KEY))
    return values.join(last, same, "left_anti"), values.join(last, same).select(*CACHE_KEY, *VALUE, *DECISION[:3], F.lit("routed").alias("kind"))


def asked(waiting: DataFrame, batch: int) -> DataFrame:
    """A request (ROUTED, with the least value) for each key whose values wait since a batch."""
    first = waiting.groupBy(*CACHE_KEY).agg(F.min("batch").alias("since"), F.min(F.struct(*VALUE)).alias("least")).where(F.col("since") == batch)
    return first.select(*CACHE_KEY, "least.*", *(F.lit(None).cast("string").alias(c) for c in DECISION[:3]), F.lit("request").alias("kind"))


def _route_batch(rows: DataFrame, batch: int, out: str, state: str) -> None:
    """Route a batch, and what waits, on the state that the batch before it left; run again after a failure it makes the same files.

    rows: values and decisions, told apart by is_decision.  Values are routed by the last decision that came before them or with them.
    """
    spark = rows.sparkSession
    load = lambda name, n, schema: spark.read.schema(schema).parquet(f"{state}/{n}/{name}") if n >= 0 else spark.createDataFrame([], schema)
    decisions = load("known", batch - 1, KNOWN).unionByName(rows.where("is_decision").select(*CACHE_KEY, *DECISION))
    known = decisions.groupBy(*CACHE_KEY).agg(F.max_by(F.struct(*DECISION), F.struct("decided_at", "id")).alias("last")).select(*CACHE_KEY, "last.*")
    known.write.mode("overwrite").parquet(f"{state}/{batch}/known")
    values = load("waiting", batch - 1, WAITING).unionByName(rows.where("NOT is_decision").select(*CACHE_KEY, *VALUE, F.lit(batch).cast("long").alias("batch")))
    waiting, routed = route(values, load("known", batch, KNOWN))
    waiting.write.mode("overwrite").parquet(f"{state}/{batch}/waiting")
    routed.unionByName(asked(load("waiting", batch, WAITING), batch)).write.mode("overwrite").parquet(f"{out}/batch={batch}")
    old = spark._jvm.org.apache.hadoop.fs.Path(f"{state}/{batch - 2}")  # this batch may run again, the one before it can't
    old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


def start_routing(values: DataFrame, decisions: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Add ROUTED rows of what streams have now to a Parquet folder, a partition for each batch: each value with the decision on its column (kind 'routed'), and a request for each column that has none when its first value comes (kind 'request').

    values: TALL columns; decisions: those of the log.  Run again to go on with what has come since.
    """
    empty = lambda columns: [F.lit(None).cast("timestamp" if c == "decided_at" else "string").alias(c) for c in columns]
    left = values.select(*CACHE_KEY, *VALUE, *empty(DECISION), F.lit(False).alias("is_decision"))
    right = decisions.select(*CACHE_KEY, *empty(VALUE), *DECISION, F.lit(True).alias("is_decision"))
    write = left.unionByName(right).writeStream.foreachBatch(lambda rows, n: _route_batch(rows, n, out, f"{checkpoint}/routing"))
    return write.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_latest(signals: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """latest_signals() of what a stream has now, upserted into a store's signals under the name of their subject; a batch that runs again changes nothing."""
    last = latest_signals(signals).withColumns({"source": F.lit("latest"), "external_id": F.col("pkey")})
    return last.writeStream.outputMode("update").foreachBatch(lambda rows, _: store.upsert("signals", rows)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
