"""Counts over the decision log."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Who decides without a model, and with one.
DETERMINISTIC, MODEL = ("lookup", "normalizer"), ("haiku", "llm")


def tallies(log: DataFrame) -> DataFrame:
    """key, n: decisions by who decided, and by verdict as verdict:<verdict>."""
    who = log.groupBy(F.col("decided_by").alias("key")).agg(F.count("*").alias("n"))
    return who.unionByName(log.groupBy(F.concat(F.lit("verdict:"), "verdict").alias("key")).agg(F.count("*").alias("n")))


def tier_counts(log: DataFrame) -> DataFrame:
    return log.agg(F.count_if(F.col("decided_by").isin(*DETERMINISTIC)).alias("deterministic"), F.count_if(F.col("decided_by").isin(*MODEL)).alias("model"), F.count_if(F.col("verdict") == "append").alias("appended"))


def per_day(log: DataFrame) -> DataFrame:
    """day, decided_by, n; decisions without a sound time are left out."""
    return log.groupBy(F.to_date("decided_at").alias("day"), "decided_by").agg(F.count("*").alias("n")).where("day IS NOT NULL")


def filtered(log: DataFrame, decided_by: Iterable[str] = (), verdict: Iterable[str] = ()) -> DataFrame:
    for name, values in (("decided_by", list(decided_by)), ("verdict", list(verdict))):
        if values:
            log = log.where(F.col(name).isin(*values))
    return log


def options(log: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column, without null, in order."""
    return log.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)
