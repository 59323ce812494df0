"""Threshold histograms: one conditional sum per bin in a single aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framekit.names import backticks


def histogram(df: DataFrame, thresholds: Sequence, value: str | Column, *by: str | Column) -> DataFrame:
    """Counts per bin ``≤t0``, ``≤t1`` (over t0), ..., ``>tn``, grouped by the given columns or global.

    Thresholds must be ascending; neighbours must differ. Null values fall in no bin.
    """
    if not thresholds:
        raise ValueError("give at least one threshold")
    if any(a == b for a, b in zip(thresholds, thresholds[1:], strict=False)):
        raise ValueError(f"thresholds must not repeat: {', '.join(map(str, thresholds))}")
    v = F.col(backticks(value)) if isinstance(value, str) else value
    bins = [(f"≤{thresholds[0]}", v <= F.lit(thresholds[0]))]
    bins += [(f"≤{b}", (v > F.lit(a)) & (v <= F.lit(b))) for a, b in zip(thresholds, thresholds[1:], strict=False)]
    bins.append((f">{thresholds[-1]}", v > F.lit(thresholds[-1])))
    keys = [F.col(backticks(k)) if isinstance(k, str) else k for k in by]
    return df.groupBy(*keys).agg(*[F.sum(F.when(test, 1).otherwise(0)).alias(name) for name, test in bins])
