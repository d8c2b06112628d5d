"""The engine's tables: decisions only ever grow, signals and schema rows are upserted; all under a log of versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalspark import types
from vitalspark.operators import audit, reconcile
from vitalspark.sources.versions import BUCKET, BUCKETS, VersionedTable


class Store:
    """decisions, signals, schema_rows and dictionary of a folder on any file system that Spark writes to."""

    SCHEMAS = {"decisions": types.DECISION, "signals": types.SIGNAL, "schema_rows": types.SCHEMA_ROW, "dictionary": types.DICTIONARY}
    KEYS = {"signals": ("workspace_key", "source", "external_id"), "schema_rows": ("workspace_key", "pkey", "canonical_name")}
    #: Column by which the newest row of a key is told, and columns that keep their first value.
    ORDERS = {"signals": ("ingested_at", ()), "schema_rows": ("updated_at", ("first_seen_at",))}

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.tables = {name: VersionedTable(spark, f"{self.folder}/{name}", schema, self.KEYS.get(name, ()), buckets) for name, schema in self.SCHEMAS.items()}

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """A table, or a version of it; empty if nothing was written."""
        return self.tables[name].read(version)

    def append_decisions(self, rows: DataFrame) -> None:
        """The only way to write decisions."""
        self.tables["decisions"].append(rows)

    def replace(self, name: str, rows: DataFrame) -> None:
        """A new version of a table; readers of the old one are not disturbed.  Decisions can't be replaced."""
        if name == "decisions":
            raise ValueError("decisions are append-only")
        self.tables[name].replace(rows)

    def upsert(self, name: str, rows: DataFrame) -> None:
        """Rows into the buckets of their keys, the newest of a key staying."""
        order, first = self.ORDERS[name]
        self.tables[name].upsert(rows, lambda rows: reconcile.newest(rows, (BUCKET, *self.KEYS[name]), order, first))

    def latest_decisions(self) -> DataFrame:
        return reconcile.latest(self.table("decisions"), reconcile.CACHE_KEY)

    def latest_row(self) -> DataFrame:
        """The last signal of each subject."""
        return reconcile.latest(self.table("signals"), ("workspace_key", "pkey"), time="occurred_at")

    def timeline(self, pkey: str, since: str | None = None) -> DataFrame:
        rows = self.table("signals").where(F.col("pkey") == pkey)
        rows = rows if since is None else rows.where(F.col("occurred_at") >= since)
        return rows.orderBy(F.col("occurred_at").desc(), F.col("id").desc())

    def merged(self) -> DataFrame:
        return reconcile.merged(self.table("signals"))

    def decision_history(self, **key: object) -> DataFrame:
        """All decisions of a key, newest first."""
        return reconcile.history(self.table("decisions"), **key)

    def reset(self) -> None:
        """A version without rows of signals, schema rows and decisions; the log of versions keeps what was there."""
        for name in ("signals", "schema_rows", "decisions"):
            self.tables[name].replace(self.table(name).limit(0))


def ingest(store: Store, tall: DataFrame, router: reconcile.Router | None = None) -> DataFrame:
    """Route, normalise and store tall values; returns tallies (key, n) of the log.

    Without a router only columns that the registries know are taken, and the rest is held back.
    """
    dictionary = store.table("dictionary")
    if router is None:
        tall, _ = reconcile.offline(tall)
        router = reconcile.rule_router(dictionary)
    store.append_decisions(reconcile.decide(tall, store.latest_decisions(), dictionary, router))
    # The normaliser's decisions repeat the target of the one before: either says where a column goes.
    values = reconcile.normalise(tall, store.latest_decisions(), dictionary)
    known = store.table("decisions").where("decided_by = 'normalizer'").select(*reconcile.CACHE_KEY)
    store.append_decisions(reconcile.review_decisions(values, store.latest_decisions(), F.current_timestamp()).join(known, list(reconcile.CACHE_KEY), "left_anti"))
    store.upsert("signals", reconcile.signals(values))
    store.upsert("schema_rows", reconcile.schema_rows(store.table("decisions"), dictionary))
    return audit.tallies(store.table("decisions"))
