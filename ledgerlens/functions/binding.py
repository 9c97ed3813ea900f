"""Naming a value inside an expression, so that what is used often is computed and planned once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value evaluated once. The end of a fold over nothing: what the body gives is not copied, as an
    element of a transformed array would be at each level of nesting."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda held, _: held, body)
