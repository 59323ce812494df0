"""Gap-free, 1-based row numbers over a whole table without moving it into one partition.

``monotonically_increasing_id`` numbers rows within their partition; the running sum of all
preceding partitions' row counts, a frame with one row per partition, supplies the offsets.
Empty partitions simply have no row there, so they leave no gap.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framekit.names import as_column, backticks, free_prefix

_LOCAL_BITS = 33


class UnpersistHandle:
    """Releases the intermediate table of an operator once its result is used.

    The operator sets the table, once; the caller calls the handle. Called before, it raises,
    unless ``silent``.
    """

    def __init__(self, silent: bool = False) -> None:
        self.silent = silent
        self._df: DataFrame | None = None

    def set_data_frame(self, df: DataFrame) -> DataFrame:
        if self._df is not None:
            raise RuntimeError("a table has been set already")
        self._df = df
        return df

    def __call__(self, blocking: bool | None = None) -> None:
        if self._df is None:
            if self.silent:
                return
            raise RuntimeError("no table has been set")
        self._df.unpersist() if blocking is None else self._df.unpersist(blocking)

    def __enter__(self) -> UnpersistHandle:
        return self

    def __exit__(self, *_) -> None:
        if self._df is not None:
            self()


class NoopUnpersistHandle(UnpersistHandle):
    """Never keeps or releases anything."""

    def __init__(self) -> None:
        super().__init__(silent=True)

    def set_data_frame(self, df: DataFrame) -> DataFrame:
        return df


def with_row_numbers(
    df: DataFrame,
    name: str = "row_number",
    order: str | Column | Sequence[str | Column] = (),
    ascending: bool | Sequence[bool] = True,
    storage_level: StorageLevel = StorageLevel.MEMORY_AND_DISK,
    handle: UnpersistHandle | None = None,
) -> DataFrame:
    """Append ``name``; an existing column of that name is replaced.

    Without ``order`` rows keep their present order. The ordered table is persisted, as it is read
    twice and a non-deterministic input must not change in between; ``handle`` releases it.
    """
    if storage_level == StorageLevel.NONE:
        raise ValueError("row numbers need the table persisted; storage level NONE is not supported")
    order = [as_column(df, c) for c in ([order] if isinstance(order, (str, Column)) else order)]
    if order:
        df = df.orderBy(*order, ascending=ascending)
    mark = free_prefix([*df.columns, name])
    row, part, before = f"{mark}row", f"{mark}part", f"{mark}before"
    numbered = df.withColumn(row, F.monotonically_increasing_id()).persist(storage_level)
    (handle or NoopUnpersistHandle()).set_data_frame(numbered)
    local = F.col(row).bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)) + 1
    partition = F.shiftrightunsigned(row, _LOCAL_BITS)
    preceding = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        numbered.groupBy(partition.alias(part)).agg(F.count("*").alias("n")).select(part, F.coalesce(F.sum("n").over(preceding), F.lit(0)).alias(before))
    )
    # One row per partition of the input: small by construction, whatever the table's size.
    return (
        numbered.withColumn(part, partition)
        .join(F.broadcast(offsets), part)
        .withColumn(name, local + F.col(before))
        .select(*[backticks(c) for c in df.columns if c.lower() != name.lower()], backticks(name))
    )


class RowNumbers:
    """Fluent form: ``RowNumbers().order_by("id").named("n").of(df)``."""

    def __init__(self, **kw) -> None:
        self._kw = kw

    def _with(self, **kw) -> RowNumbers:
        return RowNumbers(**{**self._kw, **kw})

    def named(self, name: str) -> RowNumbers:
        return self._with(name=name)

    def order_by(self, *order: str | Column, ascending: bool | Sequence[bool] = True) -> RowNumbers:
        return self._with(order=list(order), ascending=ascending)

    def stored_at(self, level: StorageLevel) -> RowNumbers:
        return self._with(storage_level=level)

    def released_by(self, handle: UnpersistHandle) -> RowNumbers:
        return self._with(handle=handle)

    def of(self, df: DataFrame) -> DataFrame:
        return with_row_numbers(df, **self._kw)
