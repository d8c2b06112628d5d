"""Reconciliation: source columns routed to canonical ones, with an append-only log, and values normalised on the way."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalspark.functions import coerce, registries

#: A router takes requests (workspace_key, pkey, source, source_column, source_data_type, samples) and gives verdict, canonical_name, similarity_score, reason for each.
Router = Callable[[DataFrame], DataFrame]
CACHE_KEY = ("workspace_key", "pkey", "source", "source_column")


def latest(log: DataFrame, key: tuple[str, ...], time: str = "decided_at", tie: str = "id") -> DataFrame:
    """The last row of each key by time; of equal times the one of the greater id."""
    order = Window.partitionBy(*key).orderBy(F.col(time).desc(), F.col(tie).desc())
    return log.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def history(log: DataFrame, **key: object) -> DataFrame:
    """All rows of a key, newest first."""
    for name, value in key.items():
        log = log.where(F.col(name) == value)
    return log.orderBy(F.col("decided_at").desc(), F.col("id").desc())


def upsert(old: DataFrame, new: DataFrame, key: tuple[str, ...], order: str, keep_first: tuple[str, ...] = ()) -> DataFrame:
    """newest() of both."""
    return newest(old.unionByName(new), key, order, keep_first)


def newest(both: DataFrame, key: tuple[str, ...], order: str, keep_first: tuple[str, ...] = ()) -> DataFrame:
    """The newest row by `order` for each key; columns of keep_first hold the key's least value.

    A row with a null in the key replaces nothing and is replaced by nothing.
    """
    whole = F.lit(True)
    for k in key:
        whole = whole & F.col(k).isNotNull()
    first = Window.partitionBy(*key)
    ranked = both.where(whole).withColumns({c: F.min(c).over(first) for c in keep_first}).withColumn("_n", F.row_number().over(first.orderBy(F.col(order).desc(), *(F.col(c).desc() for c in both.columns if c not in (*key, order) and both.schema[c].dataType.typeName() in ("string", "long", "integer")))))
    return ranked.where("_n = 1").drop("_n").unionByName(both.where(~whole))


def rule_router(known: DataFrame) -> Router:
    """A router without a model: a column named like a canonical one joins it, any other is appended. known: (name)."""

    def route(requests: DataFrame) -> DataFrame:
        names = known.select(F.col("name").alias("canonical_name"), F.lit(True).alias("hit"))
        found = requests.withColumn("canonical_name", registries.column_name(F.col("source_column"))).join(names, "canonical_name", "left")
        return found.withColumns({"verdict": F.when(F.col("hit"), "join").otherwise("append"), "similarity_score": F.when(F.col("hit"), 1.0).otherwise(0.0), "reason": F.lit("name"), "decided_by": F.lit("rule")}).drop("hit")

    return route


def sound_verdicts(verdicts: DataFrame) -> DataFrame:
    """Verdicts of a router as the log takes them: an unknown verdict, a join without a target or a score outside 0 to 1 is unclear."""
    bad = ~F.coalesce(F.col("verdict").isin("join", "append", "unclear"), F.lit(False)) | ~F.coalesce(F.col("similarity_score").between(0, 1), F.lit(False)) | ((F.col("verdict") == "join") & F.col("canonical_name").isNull())
    return verdicts.withColumns({"verdict": F.when(bad, "unclear").otherwise(F.col("verdict")), "similarity_score": F.when(bad, 0.0).otherwise(F.col("similarity_score"))})


def requests(tall: DataFrame, samples: int = 20) -> DataFrame:
    """One request for each cache key of tall values: type and description of its first value, what all its values tell the registries (evidence), and its `samples` least distinct values, for a router to look at."""
    first = F.struct("occurred_at", "external_id")
    asked = tall.groupBy(*CACHE_KEY).agg(F.min_by("source_data_type", first).alias("source_data_type"), F.min_by("source_description", first).alias("source_description"), registries.evidence(F.col("value")).alias("evidence"))
    # Spark keeps the least values of each partition before it shuffles them.
    least = F.row_number().over(Window.partitionBy(*CACHE_KEY).orderBy("value"))
    shown = tall.where("value IS NOT NULL").select(*CACHE_KEY, "value").distinct().withColumn("_n", least).where(F.col("_n") <= samples)
    shown = shown.groupBy(*(F.col(k).alias(f"_{k}") for k in CACHE_KEY)).agg(F.array_sort(F.collect_list("value")).alias("source_samples"))
    same = functools.reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in CACHE_KEY))
    return asked.join(shown, same, "left").select(*asked.columns, F.coalesce("source_samples", F.array().cast("array<string>")).alias("source_samples"))


def offline(tall: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(values whose columns the registries know, (source_column) held back): what can be routed without a router."""
    asked = tall.groupBy(*CACHE_KEY).agg(registries.evidence(F.col("value")).alias("evidence"))
    known = asked.where(registries.lookup_evidence(F.col("source_column"), F.col("evidence")).isNotNull()).select(*CACHE_KEY)
    return tall.join(known, list(CACHE_KEY), "left_semi"), tall.join(known, list(CACHE_KEY), "left_anti").select("source_column").distinct()


def decide(tall: DataFrame, log: DataFrame, dictionary: DataFrame, router: Router, now: Column | None = None) -> DataFrame:
    """New decisions for the cache keys that the log has none for: registries first, then the router."""
    now = F.current_timestamp() if now is None else now
    asked = requests(tall).join(log.select(*CACHE_KEY).distinct(), list(CACHE_KEY), "left_anti")
    asked = asked.withColumn("hit", registries.lookup_evidence(F.col("source_column"), F.col("evidence"))).drop("evidence")
    known = asked.where("hit IS NOT NULL").select(*CACHE_KEY, "source_data_type", "source_description", "source_samples", F.lit("join").alias("verdict"), F.col("hit.canonical_name").alias("canonical_name"), F.lit(1.0).alias("similarity_score"), F.concat_ws(" ", "hit.registry", "hit.code", "hit.matched_on").alias("reason"), F.lit("lookup").alias("decided_by"))
    routed = sound_verdicts(router(asked.where("hit IS NULL").drop("hit"))).select(*known.columns)
    both = known.unionByName(routed).join(dictionary.select(F.col("name").alias("canonical_name"), F.lit(True).alias("is_global")), "canonical_name", "left")
    return both.select(
        F.sha2(F.concat_ws("|", *CACHE_KEY, "decided_by"), 256).alias("id"), *CACHE_KEY, "source_data_type", "source_description", "source_samples", "verdict", "canonical_name",
        F.coalesce("is_global", F.lit(False)).alias("is_global_target"), "similarity_score", "reason", (F.col("verdict") == "unclear").alias("needs_review"), "decided_by", now.alias("decided_at"),
    )


def normalise(tall: DataFrame, decisions: DataFrame, dictionary: DataFrame) -> DataFrame:
    """tall with canonical_name, normalised value and error; values of unclear columns have neither."""
    target = decisions.select(*CACHE_KEY, "canonical_name", "verdict")
    rows = tall.join(target, list(CACHE_KEY)).join(dictionary.withColumnRenamed("name", "canonical_name").drop("description", "semantic_tags"), "canonical_name", "left")
    kind = F.coalesce("data_type", "source_data_type")
    done = coerce.normalize(F.col("value"), F.col("source_data_type"), kind, F.col("canonical_unit"), F.col("controlled_vocabulary"), F.col("analyte"), F.col("code_system"))
    return rows.where("verdict <> 'unclear'").withColumn("done", done).select(*tall.columns, "canonical_name", F.col("done.value").alias("normalised"), F.col("done.error").alias("error"))


def review_decisions(normalised: DataFrame, decisions: DataFrame, now: Column | None = None) -> DataFrame:
    """A second decision, by the normaliser and to be reviewed, for each cache key with a value that couldn't be coerced."""
    now = F.current_timestamp() if now is None else now
    wrong = normalised.where("error IS NOT NULL").groupBy(*CACHE_KEY).agg(F.min("error").alias("error"))
    return decisions.join(wrong, list(CACHE_KEY)).select(*(
        {"id": F.sha2(F.concat_ws("|", *CACHE_KEY, F.lit("normalizer")), 256).alias("id"), "reason": F.col("error").alias("reason"), "needs_review": F.lit(True).alias("needs_review"), "decided_by": F.lit("normalizer").alias("decided_by"), "decided_at": now.alias("decided_at")}.get(c, F.col(c)) for c in decisions.columns
    ))


def signals(normalised: DataFrame, now: Column | None = None) -> DataFrame:
    """One row for each source record: its normalised values by canonical name."""
    now = F.current_timestamp() if now is None else now
    good = normalised.where("error IS NULL AND normalised IS NOT NULL")
    one = good.groupBy("workspace_key", "pkey", "source", "external_id", "occurred_at", "canonical_name").agg(F.min("normalised").alias("value"))
    rows = one.groupBy("workspace_key", "pkey", "source", "external_id", "occurred_at").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("canonical_name", "value")))).alias("columns"))
    return rows.select(F.sha2(F.concat_ws("|", "workspace_key", "source", "external_id"), 256).alias("id"), "workspace_key", "pkey", "source", "external_id", "occurred_at", "columns", now.alias("ingested_at"))


def merged(found: DataFrame) -> DataFrame:
    """workspace_key, pkey, canonical_name, value: the last value of each canonical column by (occurred_at, ingested_at, source)."""
    rows = found.select("workspace_key", "pkey", "source", "occurred_at", "ingested_at", F.explode("columns").alias("canonical_name", "value"))
    return rows.where("value IS NOT NULL").groupBy("workspace_key", "pkey", "canonical_name").agg(F.max_by("value", F.struct("occurred_at", "ingested_at", "source", "value")).alias("value"))


def conflicts(values: DataFrame, key: tuple[str, ...], source: str = "source", value: str = "value", salts: int = 8) -> DataFrame:
    """key, source_a, value_a, source_b, value_b: values of two sources that differ for one key, each pair once. The rows of a key are dealt over `salts` tasks."""
    one = values.select(*key, F.col(source).alias("source"), F.col(value).alias("value")).distinct()
    a, b = (one.select(*key, F.col("source").alias(f"source_{x}"), F.col("value").alias(f"value_{x}")) for x in "ab")
    a = a.withColumn("_salt", F.pmod(F.hash("source_a", "value_a"), F.lit(salts)))
    b = b.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return a.join(b, [*key, "_salt"]).where((F.col("source_a") < F.col("source_b")) & ~F.col("value_a").eqNullSafe(F.col("value_b"))).drop("_salt")


def schema_rows(decisions: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Canonical columns that the subjects of decisions have, with the first and last time of a decision for each."""
    known = dictionary.select(F.col("name").alias("canonical_name"), "data_type", "description", F.lit(True).alias("is_global"))
    rows = decisions.where("verdict <> 'unclear'").groupBy("workspace_key", "pkey", "canonical_name").agg(F.min("decided_at").alias("first_seen_at"), F.max("decided_at").alias("updated_at"), F.min_by("source", "decided_at").alias("source_origin"), F.min_by("source_data_type", "decided_at").alias("source_data_type"))
    rows = rows.join(known, "canonical_name", "left")
    return rows.select(F.sha2(F.concat_ws("|", "workspace_key", "pkey", "canonical_name"), 256).alias("id"), "workspace_key", "pkey", "canonical_name", F.coalesce("data_type", "source_data_type").alias("data_type"), "description", F.coalesce("is_global", F.lit(False)).alias("is_global"), "source_origin", "first_seen_at", "updated_at")
