"""Sorted groups: every group of rows as one lazily read iterator in a given order.

The table is hash-partitioned by the keys and sorted within partitions, so a group streams
through the worker in Arrow batches and is never held in memory as a whole.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import types as T

from framekit.names import as_column, free_prefix

Key = str | Column


def _normal(v):
    """A key value under which null, NaN and nested values group as in Spark."""
    if isinstance(v, float) and math.isnan(v):
        return ("nan",)
    if isinstance(v, (list, tuple)):
        return tuple(map(_normal, v))
    return tuple(sorted((k, _normal(x)) for k, x in v.items())) if isinstance(v, dict) else v


class SortedGroups:
    """Rows grouped by ``keys``, each group ordered by ``order``."""

    def __init__(self, df: DataFrame, keys: Sequence[Key], order: Sequence[Key] = (), partitions: int | None = None) -> None:
        if not keys:
            raise ValueError("give at least one key column")
        self.columns = df.columns
        mark = free_prefix(df.columns)
        self._keys = [f"{mark}key{i}" for i in range(len(keys))]
        as_col = lambda c: as_column(df, c)
        keyed = df.withColumns(dict(zip(self._keys, map(as_col, keys), strict=True)))
        keyed = keyed.repartition(partitions, *self._keys) if partitions else keyed.repartition(*self._keys)
        self._df = keyed.sortWithinPartitions(*self._keys, *map(as_col, order))

    def flat_map(self, function: Callable[[tuple, Iterator[Row]], Iterable], schema: str | T.StructType) -> DataFrame:
        """``function(key, rows)`` yields any number of result tuples; it may leave rows unread."""
        keys, columns = len(self._keys), self.columns
        # Functions over Arrow batches look columns up by name, so these are plain on the way.
        plain = self._df.toDF(*[f"c{i}" for i in range(len(self._df.columns))])

        def run(batches):
            import pyarrow as pa

            row = Row(*columns)

            def rows():
                for batch in batches:
                    values = [c.to_pylist() for c in batch.columns]
                    k = list(zip(*values[-keys:], strict=True))
                    yield from zip(k, map(row, *values[:-keys]) if columns else k, strict=True)

            def results():
                for _, group in itertools.groupby(rows(), key=lambda x: _normal(x[0])):
                    first = next(group)
                    yield from function(first[0], itertools.chain([first[1]], (x[1] for x in group)))

            found = results()
            while part := list(itertools.islice(found, 4096)):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), arrow, strict=True)], schema=arrow)

        if isinstance(schema, str):
            schema = T.StructType.fromDDL(schema)
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        return plain.mapInArrow(run, schema)

    def flat_map_with_state(self, state: Callable[[tuple], object], function: Callable[[object, Row], tuple[object, Iterable]], schema: str | T.StructType) -> DataFrame:
        """``state(key)`` starts a group; ``function(state, row)`` returns the next state and result tuples."""

        def run(key, rows):
            now = state(key)
            for row in rows:
                now, out = function(now, row)
                yield from out

        return self.flat_map(run, schema)


def group_by_sorted(df: DataFrame, *keys: Key, order: Sequence[Key] = (), partitions: int | None = None) -> SortedGroups:
    return SortedGroups(df, keys, order, partitions)


def group_by_key_sorted(df: DataFrame, key: Key, order: Key, partitions: int | None = None, reverse: bool = False) -> SortedGroups:
    """One key and one order expression; ``reverse`` turns the order around, not the key."""
    by = as_column(df, order)
    return SortedGroups(df, [key], [by.desc() if reverse else by.asc()], partitions)


def group_by_key(df: DataFrame, *keys: Key):
    """Grouping by column expressions, which the optimizer sees; use ``agg`` or ``applyInPandas`` on it."""
    return df.groupBy(*[as_column(df, k) for k in keys])
