"""Aggregate expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_null(column: str | Column) -> Column:
    """The number of null values."""
    return F.count_if((F.col(column) if isinstance(column, str) else column).isNull())
