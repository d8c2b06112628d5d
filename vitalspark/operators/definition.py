"""Cohort definitions: a tree of filters that is stored as JSON and compiled to a column.

    {"all": [...]}, {"any": [...]}, {"not": {...}}
    {"field": name, "in": [values]}       the field, as text, is one of the values
    {"field": name, "between": [a, b]}    inclusive; null leaves an end open
    {"field": name, "known": true}        the field has a value

A row is in if the tree is true of it; what is unknown because of a null is not true, also under "not".
"""

from __future__ import annotations

import functools
import json
import operator
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys of a flat definition that are no field, and those that are a range of a field.
NO_FIELDS, RANGES = ("n_patients",), {"age_range": "age"}


def compiled(tree: Mapping) -> Column:
    """The tree as a column that is true or false."""
    match tree:
        case {"all": parts}:
            return functools.reduce(operator.and_, map(compiled, parts), F.lit(True))
        case {"any": parts}:
            return functools.reduce(operator.or_, map(compiled, parts), F.lit(False))
        case {"not": part}:
            return ~compiled(part)
        case {"field": name, "in": values}:
            return F.coalesce(F.col(name).cast("string").isin(*map(str, values)), F.lit(False)) if values else F.lit(False)
        case {"field": name, "between": [low, high]}:
            ends = [F.col(name) >= low] * (low is not None) + [F.col(name) <= high] * (high is not None)
            return F.coalesce(functools.reduce(operator.and_, ends, F.col(name).isNotNull()), F.lit(False))
        case {"field": name, "known": known}:
            return F.col(name).isNotNull() if known else F.col(name).isNull()
    raise ValueError(f"no filter: {tree!r}")


def from_state(state: Mapping) -> dict:
    """The tree of a flat definition (field: values, age_range: [a, b]): all of it holds; a field without values asks nothing."""
    parts: list[dict] = []
    for key, values in state.items():
        if key in RANGES:
            parts.append({"field": RANGES[key], "between": list(values)})
        elif key not in NO_FIELDS and values:
            parts.append({"field": key, "in": list(values)})
    return {"all": parts}


def select(rows: DataFrame, tree: Mapping) -> DataFrame:
    return rows.where(compiled(tree))


def save(spark: SparkSession, tree: Mapping, path: str, n_patients: int | None = None) -> None:
    """Store a definition, checked, and how many patients it selected."""
    compiled(tree)
    spark.createDataFrame([(json.dumps({"filter": tree, "n_patients": n_patients}),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load(spark: SparkSession, path: str) -> tuple[dict, int | None]:
    """(tree, n_patients) of a stored definition, tree or flat."""
    state = json.loads(spark.read.text(path, wholetext=True).first()["value"])
    return (state["filter"] if "filter" in state else from_state(state)), state.get("n_patients")
