"""Registered queries over the driver's tables, each with the same result in plain SQL.

The right side of a comparison is a deterministic mutation of the left one, written once for
Spark and once for SQL from the same rules.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import framekit as fk

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Orders and their mutation

_SHIFT = 10_000_000


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")


def _orders_changed(left: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    kept = left.where(k % 97 != 0)
    new = left.where(k % 101 == 0).withColumn("o_orderkey", k + _SHIFT)
    return kept.withColumns(
        {
            "o_totalprice": F.when(k % 89 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")),
            "o_orderpriority": F.when(k % 83 != 0, F.col("o_orderpriority")),
        }
    ).unionByName(new)


_ORDERS = f"""l AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders),
r AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 89 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
        CASE WHEN o_orderkey % 83 <> 0 THEN o_orderpriority END AS o_orderpriority FROM l WHERE o_orderkey % 97 <> 0
      UNION ALL SELECT o_orderkey + {_SHIFT}, o_custkey, o_totalprice, o_orderpriority FROM l WHERE o_orderkey % 101 = 0)"""


def _action(key: str, values: dict[str, str] | list[str], joined_on: str | None = None) -> str:
    """SQL of the action; values: names, or names with their own test of equality."""
    tests = values if isinstance(values, dict) else {v: f"l.{v} IS NOT DISTINCT FROM r.{v}" for v in values}
    differs = " OR ".join(f"NOT COALESCE({t}, FALSE)" for t in tests.values()) or "FALSE"
    return f"CASE WHEN l.{key} IS NULL THEN 'I' WHEN r.{key} IS NULL THEN 'D' WHEN {differs} THEN 'C' ELSE 'N' END"


def _orders_sql(select: str, values: tuple[str, ...] = ("o_custkey", "o_totalprice", "o_orderpriority")) -> str:
    return f"""WITH {_ORDERS}
SELECT {_action("o_orderkey", list(values))} AS diff, COALESCE(l.o_orderkey, r.o_orderkey) AS o_orderkey, {select}
FROM l FULL JOIN r ON l.o_orderkey = r.o_orderkey"""


_VALUES = ("o_custkey", "o_totalprice", "o_orderpriority")
_BOTH = ", ".join(f"l.{v} AS left_{v}, r.{v} AS right_{v}" for v in _VALUES)


@_query(_orders_sql(_BOTH))
def diff_default(spark, d):
    left = _orders(spark, d)
    return fk.diff(left, _orders_changed(left), "o_orderkey")


@_query(f"""SELECT diff, COUNT(*) AS "count" FROM ({_orders_sql("1 AS one")}) GROUP BY diff""")
def diff_stats(spark, d):
    left = _orders(spark, d)
    return fk.Differ().statistics(left, _orders_changed(left), "o_orderkey")


@_query(f"SELECT * FROM ({_orders_sql(_BOTH)}) WHERE diff <> 'N'")
def diff_changes_only(spark, d):
    left = _orders(spark, d)
    return fk.Differ().changes_only(left, _orders_changed(left), "o_orderkey")


@_query(_orders_sql(_BOTH))
def diff_side_by_side(spark, d):
    left = _orders(spark, d)
    return fk.diff(left, _orders_changed(left), "o_orderkey", options=fk.DiffOptions(mode=fk.DiffMode.SIDE_BY_SIDE))


@_query(_orders_sql(", ".join(f"l.{v}" for v in _VALUES)))
def diff_left_side(spark, d):
    left = _orders(spark, d)
    return fk.diff(left, _orders_changed(left), "o_orderkey", options=fk.DiffOptions(mode=fk.DiffMode.LEFT_SIDE))


@_query(_orders_sql(", ".join(f"r.{v}" for v in _VALUES)))
def diff_right_side(spark, d):
    left = _orders(spark, d)
    return fk.diff(left, _orders_changed(left), "o_orderkey", options=fk.DiffOptions(mode=fk.DiffMode.RIGHT_SIDE))


@_query(
    _orders_sql(
        ", ".join(
            f"CASE WHEN l.{v} IS DISTINCT FROM r.{v} THEN l.{v} END AS left_{v}, CASE WHEN l.{v} IS DISTINCT FROM r.{v} THEN r.{v} END AS right_{v}"
            for v in _VALUES
        )
    )
)
def diff_sparse(spark, d):
    left = _orders(spark, d)
    return fk.diff(left, _orders_changed(left), "o_orderkey", options=fk.DiffOptions(sparse=True))


@_query(_orders_sql(_BOTH, ("o_custkey", "o_totalprice")))
def diff_ignored(spark, d):
    left = _orders(spark, d)
    return fk.diff(left, _orders_changed(left), "o_orderkey", ignore=["o_orderpriority"])


@_query(
    _orders_sql(
        "CASE WHEN l.o_orderkey IS NOT NULL AND r.o_orderkey IS NOT NULL THEN concat_ws(',', "
        + ", ".join(f"CASE WHEN l.{v} IS DISTINCT FROM r.{v} THEN '{v}' END" for v in _VALUES)
        + ") END AS changes"
    )
)
def diff_change_column(spark, d):
    left = _orders(spark, d)
    out = fk.diff(left, _orders_changed(left), "o_orderkey", options=fk.DiffOptions(change_column="changes"))
    return out.select("diff", "o_orderkey", F.array_join("changes", ",").alias("changes"))


@_query(
    """WITH l AS (SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer),
r AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN upper(c_name) || '!' ELSE c_name END AS c_name, c_nationkey, c_mktsegment FROM l WHERE c_custkey % 11 <> 0)
SELECT CASE WHEN l.c_custkey IS NULL THEN 'I' WHEN r.c_custkey IS NULL THEN 'D' ELSE 'N' END AS diff, COALESCE(l.c_custkey, r.c_custkey) AS c_custkey,
  COALESCE(l.c_name, r.c_name) AS c_name, COALESCE(l.c_nationkey, r.c_nationkey) AS c_nationkey, COALESCE(l.c_mktsegment, r.c_mktsegment) AS c_mktsegment
FROM l FULL JOIN r ON l.c_custkey IS NOT DISTINCT FROM r.c_custkey AND l.c_name IS NOT DISTINCT FROM r.c_name
  AND l.c_nationkey IS NOT DISTINCT FROM r.c_nationkey AND l.c_mktsegment IS NOT DISTINCT FROM r.c_mktsegment"""
)
def diff_no_ids(spark, d):
    left = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    k = F.col("c_custkey")
    right = left.where(k % 11 != 0).withColumn("c_name", F.when(k % 7 == 0, F.concat(F.upper("c_name"), F.lit("!"))).otherwise(F.col("c_name")))
    return fk.diff(left, right)


_EVENTS = """l AS (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE user_id END AS user_id, event_type, value FROM events),
r AS (SELECT event_id, user_id, event_type, CASE WHEN event_id % 17 = 0 THEN value + 1 ELSE value END AS value FROM l WHERE event_id % 19 <> 0)"""


@_query(
    f"""WITH {_EVENTS}
SELECT {_action("event_id", ["event_type", "value"])} AS diff, COALESCE(l.event_id, r.event_id) AS event_id, COALESCE(l.user_id, r.user_id) AS user_id,
  l.event_type AS left_event_type, r.event_type AS right_event_type, l.value AS left_value, r.value AS right_value
FROM l FULL JOIN r ON l.event_id IS NOT DISTINCT FROM r.event_id AND l.user_id IS NOT DISTINCT FROM r.user_id"""
)
def diff_two_ids(spark, d):
    k = F.col("event_id")
    left = table(spark, d, "events").select("event_id", F.when(k % 13 != 0, F.col("user_id")).alias("user_id"), "event_type", "value")
    right = left.where(k % 19 != 0).withColumn("value", F.when(k % 17 == 0, F.col("value") + 1).otherwise(F.col("value")))
    return fk.diff(left, right, "event_id", "user_id")


@_query(
    """WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem), r AS (SELECT * FROM l WHERE l_linenumber <> 3)
SELECT CASE WHEN l.l_orderkey IS NULL THEN 'I' WHEN r.l_orderkey IS NULL THEN 'D' WHEN l.l_quantity IS DISTINCT FROM r.l_quantity THEN 'C' ELSE 'N' END AS diff,
  COALESCE(l.l_orderkey, r.l_orderkey) AS l_orderkey, COALESCE(l.l_linenumber, r.l_linenumber) AS l_linenumber, l.l_quantity AS left_l_quantity, r.l_quantity AS right_l_quantity
FROM l FULL JOIN r ON l.l_orderkey = r.l_orderkey AND l.l_linenumber = r.l_linenumber"""
)
def diff_duplicate_ids(spark, d):
    """Rows with equal ids pair up as in any join."""
    left = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return fk.diff(left, left.where("l_linenumber <> 3"), "l_orderkey", "l_linenumber")


# Comparators


def _part(spark, d):
    left = table(spark, d, "part").select("p_partkey", "p_retailprice")
    k, p = F.col("p_partkey"), F.col("p_retailprice")
    return left, left.withColumn("p_retailprice", F.when(k % 3 == 0, p + 0.25).when(k % 5 == 0, p + 4).when(k % 7 != 0, p))


def _part_sql(test: str) -> str:
    test = f"CASE WHEN l.p_retailprice IS NULL AND r.p_retailprice IS NULL THEN TRUE WHEN l.p_retailprice IS NULL OR r.p_retailprice IS NULL THEN FALSE ELSE {test} END"
    return f"""WITH l AS (SELECT p_partkey, p_retailprice FROM part), r AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice + 0.25::DOUBLE
  WHEN p_partkey % 5 = 0 THEN p_retailprice + 4 WHEN p_partkey % 7 <> 0 THEN p_retailprice END AS p_retailprice FROM l)
SELECT {_action("p_partkey", {"p_retailprice": test})} AS diff, COALESCE(l.p_partkey, r.p_partkey) AS p_partkey, l.p_retailprice AS left_p_retailprice, r.p_retailprice AS right_p_retailprice
FROM l FULL JOIN r ON l.p_partkey = r.p_partkey"""


@_query(_part_sql("abs(l.p_retailprice - r.p_retailprice) <= greatest(abs(l.p_retailprice), abs(r.p_retailprice)) * 0.001::DOUBLE"))
def diff_epsilon_rel(spark, d):
    options = fk.DiffOptions().with_default_comparator(fk.Comparators.epsilon(0.001))
    return fk.diff(*_part(spark, d), "p_partkey", options=options)


@_query(_part_sql("abs(l.p_retailprice - r.p_retailprice) < 1.5::DOUBLE"))
def diff_epsilon_abs(spark, d):
    options = fk.DiffOptions().with_column_name_comparator(fk.Comparators.epsilon(1.5).as_absolute().as_exclusive(), "p_retailprice")
    return fk.diff(*_part(spark, d), "p_partkey", options=options)


@_query(_part_sql("floor(l.p_retailprice) = floor(r.p_retailprice)"))
def diff_custom(spark, d):
    same = fk.Comparators.custom(lambda a, b: F.floor(a).eqNullSafe(F.floor(b)))
    return fk.diff(*_part(spark, d), "p_partkey", options=fk.DiffOptions().with_default_comparator(same))


@_query(_part_sql("floor(l.p_retailprice) = floor(r.p_retailprice)"))
def diff_python_comparator(spark, d):
    same = fk.Comparators.python(lambda a, b: a // 1 == b // 1)
    return fk.diff(*_part(spark, d), "p_partkey", options=fk.DiffOptions().with_default_comparator(same))


_SQUEEZE = r"regexp_replace(regexp_replace({}, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')"


@_query(
    f"""WITH l AS (SELECT doc_id, text FROM documents), r AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '  ' || replace(text, ' ', chr(10) || ' ') WHEN doc_id % 5 = 0 THEN text || '.' ELSE text END AS text FROM l)
SELECT {_action("doc_id", {"text": f"{_SQUEEZE.format('l.text')} IS NOT DISTINCT FROM {_SQUEEZE.format('r.text')}"})} AS diff, COALESCE(l.doc_id, r.doc_id) AS doc_id, length(l.text) AS left_length, length(r.text) AS right_length
FROM l FULL JOIN r ON l.doc_id = r.doc_id"""
)
def diff_whitespace(spark, d):
    left = table(spark, d, "documents").select("doc_id", "text")
    k, t = F.col("doc_id"), F.col("text")
    right = left.withColumn("text", F.when(k % 3 == 0, F.concat(F.lit("  "), F.replace(t, F.lit(" "), F.lit("\n ")))).when(k % 5 == 0, F.concat(t, F.lit("."))).otherwise(t))
    out = fk.diff(left, right, "doc_id", options=fk.DiffOptions().with_data_type_comparator(fk.Comparators.string()))
    return out.select("diff", "doc_id", F.length("left_text").cast("long").alias("left_length"), F.length("right_text").cast("long").alias("right_length"))


@_query(
    f"""WITH l AS (SELECT event_id, ts FROM events), r AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 60 SECOND WHEN event_id % 5 = 0 THEN ts + INTERVAL 61 SECOND ELSE ts END AS ts FROM l)
SELECT {_action("event_id", {"ts": "abs(epoch_us(l.ts) - epoch_us(r.ts)) <= 60000000"})} AS diff, COALESCE(l.event_id, r.event_id) AS event_id, epoch_us(l.ts) AS left_us, epoch_us(r.ts) AS right_us
FROM l FULL JOIN r ON l.event_id = r.event_id"""
)
def diff_duration(spark, d):
    left = _utc(table(spark, d, "events")).select("event_id", "ts")
    k = F.col("event_id")
    moved = lambda s: F.col("ts") + F.lit(timedelta(seconds=s))
    right = left.withColumn("ts", F.when(k % 3 == 0, moved(60)).when(k % 5 == 0, moved(61)).otherwise(F.col("ts")))
    out = fk.diff(left, right, "event_id", options=fk.DiffOptions().with_default_comparator(fk.Comparators.duration(timedelta(minutes=1))))
    return out.select("diff", "event_id", F.unix_micros("left_ts").alias("left_us"), F.unix_micros("right_ts").alias("right_us"))


@_query(
    f"""WITH l AS (SELECT event_id, user_id AS a, event_id % 4 AS b FROM events), r AS (SELECT event_id, a, CASE WHEN event_id % 6 = 0 THEN b + 1 ELSE b END AS b FROM l)
SELECT {_action("event_id", ["a", "b"])} AS diff, COALESCE(l.event_id, r.event_id) AS event_id, l.b AS left_b, r.b AS right_b FROM l FULL JOIN r ON l.event_id = r.event_id"""
)
def diff_map(spark, d):
    e = table(spark, d, "events")
    k = F.col("event_id")
    left = e.select("event_id", F.create_map(F.lit("a"), F.col("user_id"), F.lit("b"), k % 4).alias("m"))
    right = e.select("event_id", F.create_map(F.lit("b"), F.when(k % 6 == 0, k % 4 + 1).otherwise(k % 4), F.lit("a"), F.col("user_id")).alias("m"))
    out = fk.diff(left, right, "event_id", options=fk.DiffOptions().with_column_name_comparator(fk.Comparators.map(), "m"))
    return out.select("diff", "event_id", F.col("left_m")["b"].alias("left_b"), F.col("right_m")["b"].alias("right_b"))


# Pairs, contracts

_NATION = """l AS (SELECT * FROM nation), r AS (SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN lower(n_name) ELSE n_name END AS n_name, n_regionkey FROM nation WHERE n_nationkey <> 3
  UNION ALL SELECT 100, 'NOWHERE', 1)"""


def _nation(spark, d):
    left = table(spark, d, "nation")
    k = F.col("n_nationkey")
    right = left.where(k != 3).withColumn("n_name", F.when(k % 4 == 0, F.lower("n_name")).otherwise(F.col("n_name")))
    new = left.where(k == 0).select(*[F.lit(v).cast(left.schema[c].dataType).alias(c) for c, v in (("n_nationkey", 100), ("n_name", "NOWHERE"), ("n_regionkey", 1))])
    return left, right.unionByName(new)


@_query(
    f"""WITH {_NATION} SELECT {_action("n_nationkey", ["n_name", "n_regionkey"])} AS diff, l.n_nationkey AS left_key, l.n_name AS left_name, r.n_nationkey AS right_key, r.n_name AS right_name
FROM l FULL JOIN r ON l.n_nationkey = r.n_nationkey"""
)
def diff_with_structs(spark, d):
    out = fk.diff_with(*_nation(spark, d), "n_nationkey")
    return out.select("diff", *[F.col(f"{s}.n_{c}").alias(f"{s}_{a}") for s in ("left", "right") for c, a in (("nationkey", "key"), ("name", "name"))])


@_query(
    f"""WITH {_NATION} SELECT {_action("n_nationkey", ["n_name", "n_regionkey"])} AS diff, CAST(COALESCE(l.n_nationkey, r.n_nationkey) AS BIGINT) AS n_nationkey, r.n_name AS right_n_name
FROM l FULL JOIN r ON l.n_nationkey = r.n_nationkey"""
)
def diff_as_contract(spark, d):
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("diff string, n_nationkey long, right_n_name string")
    return fk.diff_as(schema, *_nation(spark, d), "n_nationkey")


# Histogram, counts


def _bins(column: str, thresholds: list[int], key: str = "") -> str:
    cases = [(f"≤{thresholds[0]}", f"{column} <= {thresholds[0]}")]
    cases += [(f"≤{b}", f"{column} > {a} AND {column} <= {b}") for a, b in zip(thresholds, thresholds[1:], strict=False)]
    cases += [(f">{thresholds[-1]}", f"{column} > {thresholds[-1]}")]
    return key + ", ".join(f'CAST(SUM(CASE WHEN {test} THEN 1 ELSE 0 END) AS BIGINT) AS "{name}"' for name, test in cases)


@_query(f"SELECT {_bins('l_quantity', [10, 20, 30, 40])} FROM lineitem")
def histogram_global(spark, d):
    return fk.histogram(table(spark, d, "lineitem"), [10, 20, 30, 40], "l_quantity")


@_query(f"SELECT {_bins('value', [10, 50, 100], 'event_type, ')} FROM events GROUP BY event_type")
def histogram_by_key(spark, d):
    return fk.histogram(table(spark, d, "events"), [10, 50, 100], "value", "event_type")


@_query("SELECT o_orderstatus, COUNT(*) - COUNT(CASE WHEN o_orderkey % 83 <> 0 THEN o_orderpriority END) AS missing FROM orders GROUP BY o_orderstatus")
def count_null(spark, d):
    some = F.when(F.col("o_orderkey") % 83 != 0, F.col("o_orderpriority"))
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(fk.count_null(some).alias("missing"))


# Row numbers


@_query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS n FROM orders")
def row_numbers_ordered(spark, d):
    return fk.with_row_numbers(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "n", ["o_totalprice", "o_orderkey"]).select("o_orderkey", "n")


@_query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey DESC) AS n FROM orders")
def row_numbers_desc(spark, d):
    return fk.with_row_numbers(table(spark, d, "orders").select("o_orderkey"), "n", "o_orderkey", ascending=False)


@_query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders WHERE o_orderstatus = 'F'")
def row_numbers_filtered(spark, d):
    few = table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey")
    return fk.RowNumbers().named("n").order_by("o_orderkey").of(few)


# Sorted groups


@_query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events")
def sorted_groups_index(spark, d):
    def number(key, rows):
        for n, row in enumerate(rows, 1):
            yield key[0], row.event_id, n

    e = table(spark, d, "events").select("user_id", "event_id", "ts")
    return fk.group_by_sorted(e, "user_id", order=["ts", "event_id"]).flat_map(number, "user_id long, event_id long, n long")


@_query("SELECT user_id, event_id, CAST(SUM(event_id % 10) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS running FROM events")
def sorted_groups_running_state(spark, d):
    def step(total, row):
        total += row.event_id % 10
        return total, [(row.user_id, row.event_id, total)]

    e = table(spark, d, "events").select("user_id", "event_id", "ts")
    return fk.group_by_sorted(e, "user_id", order=["ts", "event_id"]).flat_map_with_state(lambda key: 0, step, "user_id long, event_id long, running long")


@_query("SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def sorted_groups_latest(spark, d):
    e = table(spark, d, "events").select("event_type", "event_id")
    return fk.group_by_key_sorted(e, "event_type", "event_id", reverse=True).flat_map(lambda key, rows: [(key[0], next(rows).event_id)], "event_type string, event_id long")


@_query("SELECT event_id % 10 AS digit, COUNT(*) AS n FROM events GROUP BY event_id % 10")
def group_by_key(spark, d):
    return fk.group_by_key(table(spark, d, "events"), (F.col("event_id") % 10).alias("digit")).agg(F.count("*").alias("n"))


# Ticks


def _utc(e: DataFrame) -> DataFrame:
    """The events' wall-clock time as UTC instants, whatever the session's time zone."""
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    return e.withColumn("ts", F.timestamp_micros(micros))


def _ticks(spark, d) -> DataFrame:
    return _utc(table(spark, d, "events")).select("event_id", (fk.timestamp_to_dotnet_ticks("ts") + F.col("event_id") % 10).alias("ticks"))


_TICKS = "(SELECT event_id, epoch_us(ts) * 10 + 621355968000000000 + event_id % 10 AS ticks FROM events)"


@_query("SELECT event_id, epoch_us(ts) * 10 + 621355968000000000 AS ticks FROM events")
def ticks_from_timestamp(spark, d):
    return _utc(table(spark, d, "events")).select("event_id", fk.timestamp_to_dotnet_ticks("ts").alias("ticks"))


@_query(f"SELECT event_id, (ticks - 621355968000000000) // 10 AS micros FROM {_TICKS}")
def ticks_to_timestamp(spark, d):
    return _ticks(spark, d).select("event_id", F.unix_micros(fk.dotnet_ticks_to_timestamp("ticks")).alias("micros"))


@_query(f"SELECT event_id, (ticks - 621355968000000000) * 100 AS nanos FROM {_TICKS}")
def ticks_to_unix_epoch(spark, d):
    return _ticks(spark, d).select("event_id", (fk.dotnet_ticks_to_unix_epoch("ticks") * 1_000_000_000).cast("long").alias("nanos"))


@_query(f"SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN (ticks - 621355968000000000) * 100 END AS nanos FROM {_TICKS}")
def ticks_to_unix_epoch_nanos(spark, d):
    some = F.when(F.col("event_id") % 7 != 0, F.col("ticks")).otherwise(F.lit(3155378975999999999))
    return _ticks(spark, d).select("event_id", fk.dotnet_ticks_to_unix_epoch_nanos(some).alias("nanos"))


@_query(f"SELECT event_id, ticks FROM {_TICKS}")
def ticks_from_unix_epoch(spark, d):
    return _ticks(spark, d).select("event_id", fk.unix_epoch_to_dotnet_ticks(fk.dotnet_ticks_to_unix_epoch("ticks")).alias("ticks"))


@_query(f"SELECT event_id, ticks FROM {_TICKS}")
def ticks_from_unix_epoch_nanos(spark, d):
    return _ticks(spark, d).select("event_id", fk.unix_epoch_nanos_to_dotnet_ticks(fk.dotnet_ticks_to_unix_epoch_nanos("ticks")).alias("ticks"))


# Writer, Parquet structure


def _scratch(spark: SparkSession, what: str) -> str:
    """A new folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base}/framekit/{what}-{uuid.uuid4().hex}"


@_query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def partitioned_write_roundtrip(spark, d):
    path = _scratch(spark, "orders")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    fk.write_partitioned_by(orders, ["o_orderstatus"], more_file_order=["o_orderkey"]).parquet(path)
    return spark.read.parquet(path).select("o_orderkey", "o_custkey", "o_orderstatus")


#: A flat table and one with a nested column.
_TABLES = {"orders": "o_totalprice", "embeddings": "embedding"}
#: The files that hold the registered tables, told by a column's values, as ``f``; what DuckDB reads in their footers as ``m`` and ``s``.
_FILES = "f AS (" + " UNION ALL ".join(
    f"""SELECT '{t}' AS name, file_name, num_rows, num_row_groups, created_by FROM parquet_file_metadata('/root/testdata/sf*/{t}.parquet')
  WHERE file_name IN (SELECT filename FROM read_parquet('/root/testdata/sf*/{t}.parquet', filename = true) GROUP BY filename HAVING bit_xor(hash({c})) = (SELECT bit_xor(hash({c})) FROM {t}))"""
    for t, c in _TABLES.items()
) + """),
m AS (SELECT f.name, x.* FROM parquet_metadata('/root/testdata/sf*/*.parquet') x JOIN f USING (file_name)),
s AS (SELECT f.name AS table_name, x.* FROM parquet_schema('/root/testdata/sf*/*.parquet') x JOIN f USING (file_name))"""


def _paths(d: str) -> list[str]:
    return [f"{d}/{t}.parquet" for t in _TABLES]


def _of_tables(read: Callable[..., DataFrame], spark: SparkSession, d: str) -> DataFrame:
    """What ``read`` finds, with the table's name; the names of its files need not tell it, as a table may be a folder."""
    first, *others = (read(spark, path).withColumn("name", F.lit(t)).drop("filename") for t, path in zip(_TABLES, _paths(d), strict=True))
    for df in others:
        first = first.unionByName(df)
    return first


@_query(
    f"""WITH {_FILES} SELECT f.name, num_row_groups::INT AS blocks, c.compressed, g.bytes AS uncompressed, num_rows AS rows, c.columns::INT AS columns, c.n_values, c.nulls, created_by, 'UNENCRYPTED' AS encryption
FROM f JOIN (SELECT name, SUM(total_compressed_size)::BIGINT AS compressed, COUNT(DISTINCT path_in_schema) AS columns, SUM(num_values)::BIGINT AS n_values, SUM(stats_null_count)::BIGINT AS nulls FROM m GROUP BY name) c USING (name)
JOIN (SELECT name, SUM(row_group_bytes)::BIGINT AS bytes FROM (SELECT DISTINCT name, row_group_id, row_group_bytes FROM m) GROUP BY name) g USING (name)"""
)
def parquet_metadata(spark, d):
    found = _of_tables(fk.parquet_metadata, spark, d).withColumnsRenamed({"compressedBytes": "compressed", "uncompressedBytes": "uncompressed", "values": "n_values", "createdBy": "created_by"})
    return found.select("name", "blocks", "compressed", "uncompressed", "rows", "columns", "n_values", "nulls", "created_by", "encryption")


@_query(
    f"""WITH {_FILES} SELECT s.table_name, s.name AS column_name, p.path, repetition_type AS repetition, replace(s.type, 'BYTE_ARRAY', 'BINARY') AS type, COALESCE(converted_type, '-') AS original,
  CASE WHEN logical_type LIKE 'String%' OR converted_type = 'UTF8' THEN 'STRING' WHEN logical_type LIKE 'Date%' THEN 'DATE' WHEN logical_type LIKE 'Timestamp%' THEN 'TIMESTAMP' WHEN logical_type IS NULL THEN '-' ELSE logical_type END AS logical
FROM s JOIN (SELECT DISTINCT name AS table_name, replace(path_in_schema, ', ', '/') AS path FROM m) p ON p.table_name = s.table_name AND (p.path = s.name OR ends_with(p.path, '/' || s.name)) WHERE s.type IS NOT NULL AND num_children IS NULL"""
)
def parquet_schema(spark, d):
    found = _of_tables(fk.parquet_schema, spark, d)
    return found.select(
        F.col("name").alias("table_name"), F.col("columnName").alias("column_name"), F.array_join("columnPath", "/").alias("path"), "repetition", "type",
        F.coalesce("originalType", F.lit("-")).alias("original"), F.coalesce(F.regexp_extract("logicalType", r"^\w+", 0), F.lit("-")).alias("logical"),
    )


@_query(
    f"""WITH {_FILES} SELECT name, (row_group_id + 1)::INT AS block, MIN(CASE WHEN COALESCE(dictionary_page_offset, 0) > 0 THEN least(dictionary_page_offset, data_page_offset) ELSE data_page_offset END) AS start,
  SUM(total_compressed_size)::BIGINT AS compressed, MAX(row_group_bytes) AS uncompressed, MAX(row_group_num_rows) AS rows, COUNT(*)::INT AS columns, SUM(num_values)::BIGINT AS n_values, SUM(stats_null_count)::BIGINT AS nulls
FROM m GROUP BY name, row_group_id"""
)
def parquet_blocks(spark, d):
    found = _of_tables(fk.parquet_blocks, spark, d).withColumnsRenamed({"blockStart": "start", "compressedBytes": "compressed", "uncompressedBytes": "uncompressed", "values": "n_values"})
    return found.select("name", "block", "start", "compressed", "uncompressed", "rows", "columns", "n_values", "nulls")


@_query(
    f"""WITH {_FILES} SELECT name, (row_group_id + 1)::INT AS block, replace(path_in_schema, ', ', '/') AS path, compression AS codec, replace(type, 'BYTE_ARRAY', 'BINARY') AS type,
  array_to_string(list_sort(list_distinct(string_split(encodings, ', '))), ',') AS encodings, CASE WHEN type LIKE 'INT%' AND stats_min_value NOT LIKE '%-%-%' THEN stats_min_value END AS low,
  CASE WHEN type LIKE 'INT%' AND stats_max_value NOT LIKE '%-%-%' THEN stats_max_value END AS high,
  CASE WHEN COALESCE(dictionary_page_offset, 0) > 0 THEN least(dictionary_page_offset, data_page_offset) ELSE data_page_offset END AS start,
  total_compressed_size AS compressed, total_uncompressed_size AS uncompressed, num_values AS n_values, stats_null_count AS nulls FROM m"""
)
def parquet_block_columns(spark, d):
    found = _of_tables(fk.parquet_block_columns, spark, d).withColumnsRenamed({"columnStart": "start", "compressedBytes": "compressed", "uncompressedBytes": "uncompressed", "values": "n_values"})
    physical = F.upper(F.element_at(F.split("type", " "), 2))
    whole = lambda c: F.when(physical.startswith("INT") & ~F.col(c).like("%-%-%"), F.col(c))
    return found.select(
        "name", "block", F.array_join("column", "/").alias("path"), "codec", physical.alias("type"), F.array_join("encodings", ",").alias("encodings"), whole("minValue").alias("low"),
        whole("maxValue").alias("high"), "start", "compressed", "uncompressed", "n_values", "nulls",
    )


@_query(
    f"""WITH {_FILES} SELECT name, COUNT(DISTINCT row_group_id)::BIGINT AS blocks, SUM(total_compressed_size)::BIGINT AS compressed, (SELECT MAX(num_rows) FROM f WHERE f.name = m.name) AS rows,
  SUM(num_values)::BIGINT AS n_values, SUM(stats_null_count)::BIGINT AS nulls FROM m GROUP BY name"""
)
def parquet_partitions(spark, d):
    """Each row group lies in one split, so the splits of a file add up to it."""
    found = _of_tables(fk.parquet_partitions, spark, d)
    return found.groupBy("name").agg(
        F.sum("blocks").alias("blocks"), F.sum("compressedBytes").alias("compressed"), F.sum("rows").alias("rows"), F.sum("values").alias("n_values"), F.sum("nulls").alias("nulls")
    )


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
