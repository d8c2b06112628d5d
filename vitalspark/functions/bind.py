"""A name for a value inside a column: the value is written, planned and evaluated once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value; without it, a column that uses a long expression often has a copy of it for each use."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))
