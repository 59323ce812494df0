"""Shared pieces: tables written to the cluster's shared folder, numbering within groups, samples, names."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framekit.names import backticks, free_prefix

#: Rows that one numbering bucket holds on average, and the least number of buckets (a power of two).
BUCKET_ROWS, LEAST_BUCKETS = 1 << 20, 64
#: A bucket is looked through for rows with equal hashes, and these are split, from so many rows on.
CROWDED = 4 * BUCKET_ROWS
#: Rows of a narrow table that is broadcast: some megabytes in memory.
BROADCAST_ROWS = 200_000


def columns(df: DataFrame, names: Iterable[str] | None = None) -> list[Column]:
    """Columns by their exact names (all by default), whatever characters these hold."""
    return [F.col(backticks(c)) for c in (df.columns if names is None else names)]


def append_columns(df: DataFrame, keep: Iterable[str] | None, value: Column, made: Sequence[T.StructField], start: Callable[[], Callable[[list], list]]) -> DataFrame:
    """The kept columns (all by default), as they are, and new ones that Python computes from one value of each row.

    ``start()`` is called once in each task and returns a function from a batch's values to the new columns, as Arrow arrays.
    A kept column with the name of a new one is replaced.
    """
    names = [f.name for f in made]
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in {n.lower() for n in names}]
    # Functions over Arrow batches look columns up by name, so these are plain on the way.
    plain = [f"c{i}" for i in range(len(kept) + 1)]
    inputs = df.select(*(c.alias(p) for c, p in zip([*columns(df, kept), value], plain, strict=True)))
    added = [T.StructField(f"n{i}", f.dataType) for i, f in enumerate(made)]
    schema = T.StructType([*inputs.schema.fields[:-1], *added])

    def run(batches):
        import pyarrow as pa

        compute = start()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *compute(batch.columns[-1].to_pylist())], names=[*plain[:-1], *(f.name for f in added)])

    return inputs.mapInArrow(run, schema).toDF(*kept, *names)


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, one in the warehouse, which executors share as well."""
    return spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"


def _new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/framekit/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str, path: str | None = None) -> DataFrame:
    """The table, written to the shared folder and read again: its lineage ends there.

    A lost executor then costs only the tasks that read the files, not the work before. The file
    names are unique to the call.
    """
    path = path or _new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables written on the way to a result; their files are deleted at the end of the ``with`` block.

    What the block returns must not read them: write it elsewhere first, or bring it to the driver.
    """

    def __init__(self, spark: SparkSession) -> None:
        self._spark, self._paths = spark, {}

    def write(self, df: DataFrame, what: str) -> DataFrame:
        path = _new_path(self._spark, what)
        out = written(df, what, path)
        self._paths[id(out)] = (out, path)
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete one table before the end."""
        _, path = self._paths.pop(id(df))
        jvm, conf = self._spark.sparkContext._jvm, self._spark.sparkContext._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for df, _ in list(self._paths.values()):
            self.drop(df)


def small(df: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """A narrow table, written; broadcast in joins if it has at most ``BROADCAST_ROWS`` rows, joined by shuffle beyond."""
    return sized(written(df, "keys") if scratch is None else scratch.write(df, "keys"))


def sized(ready: DataFrame) -> DataFrame:
    """A narrow table that has been written, to be broadcast if it has at most ``BROADCAST_ROWS`` rows."""
    return F.broadcast(ready) if ready.count() <= BROADCAST_ROWS else ready


def number_within(df: DataFrame, name: str, by: Sequence[str], hashed: Column, order: Sequence[str | Column]) -> DataFrame:
    """Append gapless numbers from 0 within each group of ``by``, in the order of (hashed, order), however large the group.

    ``hashed`` is a long that spreads the rows; ``by`` holds no nulls. A task sorts one group's rows in one range of hashes
    and spills; only a count for each range goes to the offsets. The number of ranges does not show in the result. Where
    a range holds more than ``CROWDED`` rows, hashes that fill it are looked for, and their rows, which are equal
    or nearly so, are dealt to as many tasks as they need, in some order.
    """
    mark = free_prefix([*df.columns, name])
    h, b, before, n, hot, part, salt = (f"{mark}{x}" for x in ("hash", "bucket", "before", "n", "hot", "part", "salt"))
    own = [backticks(c) for c in by]
    bits = (max(LEAST_BUCKETS, -(-df.count() // BUCKET_ROWS)) - 1).bit_length()
    # The top bits of the hash, smallest first.
    keyed = df.withColumn(h, hashed).withColumn(b, F.shiftrightunsigned(F.col(h).bitwiseXOR(F.lit(-(2**63))), 64 - bits))
    keyed = keyed.withColumn(part, F.lit(0)).withColumn(salt, F.lit(0))
    counts = written(keyed.groupBy(*own, b, part, salt).agg(F.count("*").alias(n)), "counts")
    crowded = counts.where(F.col(n) > CROWDED).select(*own, b)
    if not crowded.isEmpty():
        # At most one range and one hash for every CROWDED rows: small beside the table.
        inside = keyed.join(F.broadcast(crowded), [*by, b], "left_semi")
        most = inside.groupBy(*own, b, h).agg(F.count("*").alias(n)).where(F.col(n) > CROWDED)
        hots = written(most.groupBy(*own, b).agg(F.array_sort(F.collect_list(h)).alias(hot), F.max(n).alias(n)), "hot")
        widest = hots.agg(F.max(n)).first()[0] or 0
        below = F.size(F.filter(hot, lambda x: x < F.col(h)))
        mine = F.coalesce(F.array_contains(hot, F.col(h)), F.lit(False))
        joined = keyed.drop(part, salt).join(F.broadcast(hots.drop(n)), [*by, b], "left")
        split = joined.withColumn(part, 2 * F.coalesce(F.when(F.col(hot).isNotNull(), below), F.lit(0)) + mine.cast("int"))
        split = split.withColumn(salt, F.when(mine, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(-(-widest // BUCKET_ROWS) + 1)).cast("int")).otherwise(0))
        # Written once: the salts must be the same in both uses.
        keyed = written(split.drop(hot), "salted")
        counts = written(keyed.groupBy(*own, b, part, salt).agg(F.count("*").alias(n)), "counts")
    preceding = Window.partitionBy(*own).orderBy(b, part, salt).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*own, b, part, salt, F.coalesce(F.sum(n).over(preceding), F.lit(0)).alias(before))
    local = F.row_number().over(Window.partitionBy(*own, b, part, salt).orderBy(h, *order)) - 1
    out = keyed.withColumn(name, local.cast("long")).join(offsets, [*by, b, part, salt]).withColumn(name, F.col(backticks(name)) + F.col(before))
    return out.select(*columns(df), backticks(name))


def spread_hash(keys: Sequence[Column]) -> Column:
    """A long, spread over all longs, from the MD5 of the columns as text: in the order of its first 15 hexadecimal digits."""
    text = F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("-")) for c in keys])
    return (F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") - F.lit(1 << 59)) * 16


def hashable(df: DataFrame) -> list[Column]:
    """The columns that a hash can be taken of."""
    return [F.col(backticks(f.name)) for f in df.schema if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]


def hashed_sample(df: DataFrame, keys: Sequence[str | Column], n: int) -> DataFrame:
    """At most ``n`` rows of bounded width, those with the smallest hashes of the keys: the same rows whatever the partitioning.

    Keys should tell rows apart: rows with equal keys come or stay away together.

    A first cut by hash keeps what reaches the last task in proportion to ``n``, not to the table.
    """
    mark = free_prefix(df.columns) + "hash"
    share = min(1.0, 4.0 * n / max(df.count(), 1))
    hashed = df.withColumn(mark, F.xxhash64(*keys))
    if share < 1:
        hashed = hashed.where(F.col(mark) < int(-(2**63) + share * 2**64))
    return hashed.orderBy(mark).limit(n).drop(mark)


def sample_in_place(df: DataFrame, keys: Sequence[str | Column], n: int) -> DataFrame:
    """At most ``n`` rows, those with the smallest hashes of the keys, each read in its own task.

    Only hashes meet in one task, ``n`` + 1 from each, so wide rows may be drawn from a table of any size. Rows with equal
    keys come or stay away together; where one such group has over ``n`` rows and the smallest hash, ``n`` of it come.
    """
    rows = df.count()
    if rows <= n:
        return df
    mark = free_prefix(df.columns) + "hash"
    hashed = df.withColumn(mark, F.xxhash64(*keys))
    cut = hashed.where(F.col(mark) < int(-(2**63) + min(1.0, 4.0 * n / rows) * 2**64)) if rows > 4 * n else hashed
    low, high, found = cut.select(mark).orderBy(mark).limit(n + 1).agg(F.min(mark), F.max(mark), F.count("*")).first()
    if found <= n:
        return cut.drop(mark)
    if low == high:
        return hashed.where(F.col(mark) == low).limit(n).drop(mark)
    return hashed.where(F.col(mark) < high).drop(mark)
