"""Comparing, numbering, summarising and laying out tables, in plain PySpark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to executors carry the library's code along, so that it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from framekit.fluent import On, call, transform_if
from framekit.functions.aggregates import count_null
from framekit.functions.ticks import (
    dotnet_ticks_to_timestamp,
    dotnet_ticks_to_unix_epoch,
    dotnet_ticks_to_unix_epoch_nanos,
    timestamp_to_dotnet_ticks,
    unix_epoch_nanos_to_dotnet_ticks,
    unix_epoch_to_dotnet_ticks,
)
from framekit.names import backticks, free_prefix
from framekit.operators.comparators import Comparator, Comparators
from framekit.operators.diff import Differ, against, diff, diff_as, diff_with
from framekit.operators.groups import SortedGroups, group_by_key, group_by_key_sorted, group_by_sorted
from framekit.operators.histogram import histogram
from framekit.operators.options import DiffMode, DiffOptions
from framekit.operators.row_numbers import NoopUnpersistHandle, RowNumbers, UnpersistHandle, with_row_numbers
from framekit.session import (
    append_job_description,
    create_temporary_dir,
    install_pip_package,
    install_poetry_project,
    job_description,
    set_job_description,
    version_info,
)
from framekit.sinks.partitioned import write_partitioned_by
from framekit.sources.parquet_meta import parquet_block_columns, parquet_blocks, parquet_metadata, parquet_partitions, parquet_schema

__all__ = [n for n in dir() if not n.startswith("_")]
