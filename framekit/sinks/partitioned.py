"""Partition-aware writing: one ordered file per partition value, more only where it is large."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, DataFrameWriter
from pyspark.sql import functions as F

from framekit.names import backticks

Named = str | tuple[str, Column]


def write_partitioned_by(
    df: DataFrame,
    partition_columns: Sequence[Named],
    more_file_columns: Sequence[Named] = (),
    more_file_order: Sequence[str | Column] = (),
    partitions: int | None = None,
    written_projection: Sequence[str | Column] | None = None,
) -> DataFrameWriter:
    """Range-partition by the partition and file columns, sort within, and write by partition.

    A ``(name, expression)`` pair is added as a column first. ``more_file_columns`` split large
    partition values into files; ``more_file_order`` only orders rows inside files.
    """
    if not partition_columns:
        raise ValueError("give at least one partition column")
    for c in (*partition_columns, *more_file_columns):
        if not isinstance(c, str) and not (isinstance(c, tuple) and len(c) == 2 and isinstance(c[0], str)):
            raise ValueError(f"partition columns are names or (name, expression) pairs, not {c!r}")
    added = dict(c for c in (*partition_columns, *more_file_columns) if isinstance(c, tuple))
    df = df.withColumns(added) if added else df
    names = [c if isinstance(c, str) else c[0] for c in (*partition_columns, *more_file_columns)]
    spread = [F.col(backticks(n)) for n in names]
    laid = df.repartitionByRange(partitions, *spread) if partitions else df.repartitionByRange(*spread)
    laid = laid.sortWithinPartitions(*spread, *more_file_order)
    if written_projection is not None:
        laid = laid.select(*written_projection)
    return laid.write.partitionBy(*names[: len(partition_columns)])
