"""The operators as methods of Spark's own classes, for those who ask for it: ``framekit.methods.enable()``."""

from __future__ import annotations

import warnings
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.readwriter import DataFrameReader

from framekit.operators import diff as _diff
from framekit.operators.groups import group_by_key_sorted, group_by_sorted
from framekit.operators.histogram import histogram
from framekit.operators.options import DiffOptions
from framekit.operators.row_numbers import with_row_numbers
from framekit.session import append_job_description, create_temporary_dir, install_pip_package, install_poetry_project, job_description
from framekit.sinks.partitioned import write_partitioned_by
from framekit.sources import parquet_meta


def _split(ids_or_lists: tuple) -> tuple[list[str], list[str]]:
    """Ids, or a list of ids and one of ignored columns."""
    if any(not isinstance(x, str) for x in ids_or_lists):
        lists = [[x] if isinstance(x, str) else list(x) for x in ids_or_lists]
        if len(lists) > 2:
            raise ValueError("give ids, or one list of ids and one of ignored columns")
        return lists[0], lists[1] if len(lists) == 2 else []
    return list(ids_or_lists), []


def diff_with_options(left: DataFrame, right: DataFrame, options: DiffOptions, *ids: str | Iterable[str]) -> DataFrame:
    """An older name of ``diff``."""
    warnings.warn("use diff(left, right, *ids, options=...)", DeprecationWarning, stacklevel=2)
    own, ignore = _split(ids)
    return _diff.diff(left, right, *own, options=options, ignore=ignore)


def diffwith_with_options(left: DataFrame, right: DataFrame, options: DiffOptions, *ids: str | Iterable[str]) -> DataFrame:
    """An older name of ``diff_with``."""
    warnings.warn("use diff_with(left, right, *ids, options=...)", DeprecationWarning, stacklevel=2)
    own, ignore = _split(ids)
    return _diff.diff_with(left, right, *own, options=options, ignore=ignore)


def session(df: DataFrame) -> SparkSession:
    return df.sparkSession


def _of_session(operator):
    return lambda reader, *paths, **kw: operator(reader._spark, *paths, **kw)


#: What each class gets.
_METHODS = {
    DataFrame: {
        "diff": _diff.diff, "diffwith": _diff.diff_with, "diff_as": _diff.diff_as, "diff_with_options": diff_with_options, "diffwith_with_options": diffwith_with_options,
        "histogram": histogram, "with_row_numbers": with_row_numbers, "group_by_sorted": group_by_sorted, "group_by_key_sorted": group_by_key_sorted,
        "write_partitioned_by": write_partitioned_by, "session": session, "session_or_ctx": session,
    },
    SparkSession: {
        "job_description": job_description, "append_job_description": append_job_description, "create_temporary_dir": create_temporary_dir,
        "install_pip_package": install_pip_package, "install_poetry_project": install_poetry_project,
    },
    DataFrameReader: {n: _of_session(getattr(parquet_meta, n)) for n in ("parquet_metadata", "parquet_schema", "parquet_blocks", "parquet_block_columns", "parquet_partitions")},
}


def enable() -> None:
    """Attach the methods; a name that Spark itself has is left alone."""
    for cls, methods in _METHODS.items():
        for name, operator in methods.items():
            if not hasattr(cls, name):
                setattr(cls, name, operator)


def disable() -> None:
    """Take off what ``enable`` attached."""
    for cls, methods in _METHODS.items():
        for name, operator in methods.items():
            if cls.__dict__.get(name) is operator:
                delattr(cls, name)
