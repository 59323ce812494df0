"""Command line: compare two tables and write the result.

    python -m framekit.cli --format parquet --id id left.parquet right.parquet diff.parquet
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from framekit.names import backticks
from framekit.operators.diff import Differ
from framekit.operators.options import DiffMode, DiffOptions


def _pair(text: str) -> tuple[str, str]:
    key, eq, value = text.partition("=")
    if not eq:
        raise argparse.ArgumentTypeError(f"expected key=value, got {text!r}")
    return key, value


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("framekit-diff", description="Compare two tables row by row.")
    for name in ("left", "right", "diff"):
        p.add_argument(name, help="path if a format is given, else a table name")
    session = p.add_argument_group("session")
    session.add_argument("--master")
    session.add_argument("--app-name", default="Diff App")
    session.add_argument("--hive", action="store_true")
    io = p.add_argument_group("input and output")
    io.add_argument("-f", "--format")
    io.add_argument("-s", "--schema", help="DDL of both inputs")
    for side in ("left", "right"):
        io.add_argument(f"--{side}-format")
        io.add_argument(f"--{side}-schema")
        io.add_argument(f"--{side}-option", type=_pair, action="append", default=[])
    io.add_argument("--output-format")
    io.add_argument("--output-option", type=_pair, action="append", default=[])
    io.add_argument("--id", action="append", default=[])
    io.add_argument("--ignore", action="append", default=[])
    io.add_argument("--save-mode", choices=["append", "overwrite", "error", "errorifexists", "ignore"], default="errorifexists")
    io.add_argument("--filter", action="append", default=[], help="keep only rows with this action")
    io.add_argument("--statistics", action="store_true", help="write the number of rows of each action")
    d = DiffOptions()
    o = p.add_argument_group("comparison")
    o.add_argument("--diff-column", default=d.diff_column)
    o.add_argument("--left-prefix", default=d.left_prefix)
    o.add_argument("--right-prefix", default=d.right_prefix)
    o.add_argument("--insert-value", default=d.insert_value)
    o.add_argument("--change-value", default=d.change_value)
    o.add_argument("--delete-value", default=d.delete_value)
    o.add_argument("--no-change-value", default=d.nochange_value)
    o.add_argument("--change-column")
    o.add_argument("--diff-mode", type=DiffMode.by_name, default=d.mode)
    o.add_argument("--sparse", action="store_true")
    return p


def _options(a: argparse.Namespace) -> DiffOptions:
    return DiffOptions(
        a.diff_column, a.left_prefix, a.right_prefix, a.insert_value, a.change_value, a.delete_value, a.no_change_value, a.change_column, a.diff_mode, a.sparse
    )


def _read(spark: SparkSession, name: str, form: str | None, schema: str | None, options: list[tuple[str, str]]) -> DataFrame:
    reader = spark.read.options(**dict(options))
    reader = reader.schema(schema) if schema else reader
    return reader.format(form).load(name) if form else reader.table(name)


def run(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    p = parser()
    a = p.parse_args(arguments)
    options = _options(a)
    if unknown := [f for f in a.filter if f not in options.labels]:
        p.error(f"unknown filter {', '.join(unknown)}; one of {', '.join(options.labels)}")
    if spark is None:
        builder = SparkSession.builder.appName(a.app_name)
        builder = builder.master(a.master) if a.master else builder
        spark = (builder.enableHiveSupport() if a.hive else builder).getOrCreate()
    left = _read(spark, a.left, a.left_format or a.format, a.left_schema or a.schema, a.left_option)
    right = _read(spark, a.right, a.right_format or a.format, a.right_schema or a.schema, a.right_option)
    out = Differ(options).diff(left, right, *a.id, ignore=a.ignore, actions=a.filter or None)
    action = backticks(options.diff_column)
    if a.statistics:
        out = out.groupBy(action).count().orderBy(action)
    writer = out.write.mode(a.save_mode).options(**dict(a.output_option))
    form = a.output_format or a.format
    writer.format(form).save(a.diff) if form else writer.saveAsTable(a.diff)


if __name__ == "__main__":
    run()
