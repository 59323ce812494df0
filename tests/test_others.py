import datetime as dt
import os
import subprocess
import sys
import zipfile
from decimal import Decimal

import pytest
from pyspark import StorageLevel
from pyspark.sql import functions as F

import framekit as fk
from framekit import cli
from framekit.sources import parquet_footer, parquet_meta


def test_histogram(spark):
    df = spark.createDataFrame([(1, "a", -300), (2, "a", -200), (3, "b", 0), (4, "b", 201), (5, "b", None)], "id int, title string, value int")
    got = fk.histogram(df, [-200, 0, 200], "value")
    assert got.columns == ["≤-200", "≤0", "≤200", ">200"] and tuple(got.first()) == (2, 1, 0, 1)
    assert {tuple(r) for r in fk.histogram(df, [0], F.col("value") * 2, "title").collect()} == {("a", 2, 0), ("b", 1, 1)}
    for bad in ([], [1, 1]):
        with pytest.raises(ValueError):
            fk.histogram(df, bad, "value")


def test_count_null(spark):
    df = spark.createDataFrame([(1, None), (2, "a"), (3, None)], "id int, s string")
    assert tuple(df.agg(fk.count_null("id"), fk.count_null(df.s)).first()) == (0, 2)


@pytest.mark.parametrize("asc", [True, False])
@pytest.mark.parametrize("parts", [1, 10, 100])
def test_row_numbers(spark, asc, parts):
    df = spark.range(1, 2001, 1, 10).withColumn("r", F.rand(1)).repartition(parts)
    with fk.UnpersistHandle() as handle:
        got = fk.with_row_numbers(df, "n", "id", ascending=asc, handle=handle).collect()
    assert all(r["n"] == (r["id"] if asc else 2001 - r["id"]) for r in got) and len(got) == 2000


def test_row_numbers_over_empty_partitions(spark):
    df = spark.range(0, 100, 1, 10).where("id < 20 or id >= 70").withColumn("row_number", F.lit("old"))
    assert sorted((r["row_number"], r["id"]) for r in fk.with_row_numbers(df).collect()) == [(i + 1, x) for i, x in enumerate([*range(20), *range(70, 100)])]
    assert fk.with_row_numbers(spark.range(0)).count() == 0
    with pytest.raises(ValueError):
        fk.with_row_numbers(df, storage_level=StorageLevel.NONE)


def test_unpersist_handle(spark):
    with pytest.raises(RuntimeError):
        fk.UnpersistHandle()()
    fk.UnpersistHandle(silent=True)()
    h = fk.UnpersistHandle()
    h.set_data_frame(spark.range(1))
    with pytest.raises(RuntimeError):
        h.set_data_frame(spark.range(1))
    h()
    fk.NoopUnpersistHandle()()


def test_sorted_groups_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(500).select((F.col("id") % 6).alias("k"), (500 - F.col("id")).alias("v")).repartition(3)
        got = fk.group_by_sorted(df, "k", order=["v"], partitions=2).flat_map(lambda key, rows: [(key[0], [r.v for r in rows])], "k long, vs array<long>").collect()
        assert {r.k: r.vs for r in got} == {k: sorted(500 - i for i in range(500) if i % 6 == k) for k in range(6)}
        first = fk.group_by_key_sorted(df, "k", "v", reverse=True).flat_map(lambda key, rows: [(key[0], next(rows).v)], "k long, v long").collect()
        assert {r.k: r.v for r in first} == {k: 500 - k for k in range(6)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_sorted_groups_null_and_nan_keys(spark):
    nan = float("nan")
    df = spark.createDataFrame([(None, 1), (nan, 2), (nan, 3), (None, 4), (0.5, None)], "k double, v int")
    got = fk.group_by_sorted(df, "k", order=["v"]).flat_map(lambda key, rows: [(len(list(rows)),)], "n int").collect()
    assert sorted(r.n for r in got) == [1, 2, 2]
    state = fk.group_by_sorted(df.limit(0), "k").flat_map_with_state(lambda k: 0, lambda s, r: (s, []), "n int")
    assert state.count() == 0


def test_ticks(spark):
    # Fixed values of the format: 1970 in ticks, the last tick whose nanoseconds fit a long, and the last tick of all.
    epoch, last_nanos, last = 621355968000000000, 713589688368547758, 3155378975999999999
    some = [epoch - 123_456_789_012_345, epoch, epoch + 17_000_000_012_345_671]
    df = spark.createDataFrame([(t,) for t in (*some, last_nanos, last, 0)], "t long")
    got = df.select(fk.dotnet_ticks_to_unix_epoch_nanos("t").alias("n"), fk.dotnet_ticks_to_unix_epoch("t").alias("e"))
    assert got.schema["e"].dataType.simpleString() == "decimal(29,9)"
    assert [r.n for r in got.collect()] == [*(100 * (t - epoch) for t in some), 100 * (last_nanos - epoch), None, None]
    ts = dt.datetime(1987, 6, 5, 4, 3, 2, 10_203)
    one = spark.createDataFrame([(ts,)], "t timestamp")
    micros = (ts - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
    assert one.select(fk.timestamp_to_dotnet_ticks("t")).first()[0] == epoch + 10 * micros
    with pytest.raises(Exception, match="DATATYPE_MISMATCH"):
        spark.range(1).select(fk.timestamp_to_dotnet_ticks("id")).collect()
    for kind in ("string", "decimal(19,7)", "double", "long", "int"):
        assert spark.range(1).select(fk.unix_epoch_to_dotnet_ticks(F.lit("1234567890").cast(kind))).first()[0] == epoch + 12345678900000000
        assert spark.range(1).select(fk.unix_epoch_nanos_to_dotnet_ticks(F.lit("4700").cast(kind if kind != "decimal(19,7)" else "decimal(21,0)"))).first()[0] == epoch + 47


def test_write_partitioned(spark, tmp_path):
    df = spark.range(2000).select("id", (F.col("id") % 4).alias("k"), F.rand(3).alias("r")).repartition(8)
    out = str(tmp_path / "t")
    fk.write_partitioned_by(df, ["k"], more_file_order=["id"], written_projection=["k", "id"]).parquet(out)
    for k in range(4):
        files = [f for f in os.listdir(f"{out}/k={k}") if f.endswith(".parquet")]
        assert len(files) == 1
        ids = [r.id for r in spark.read.parquet(f"{out}/k={k}/{files[0]}").collect()]
        assert ids == sorted(ids) and len(ids) == 500
    fk.write_partitioned_by(df, [("b", F.col("id") < 5)], [("c", F.col("id") % 2)], partitions=3).parquet(str(tmp_path / "u"))
    assert sorted(x for x in os.listdir(tmp_path / "u") if "=" in x) == ["b=false", "b=true"]
    for bad in ([], [F.col("id")]):
        with pytest.raises(ValueError):
            fk.write_partitioned_by(df, bad)


def test_parquet_tables(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(0, 300, 1, 2).select("id", F.when(F.col("id") % 3 > 0, F.col("id") * 1.0).alias("val")).write.option("parquet.block.size", 1024).parquet(path)
    meta = fk.parquet_metadata(spark, path).collect()
    assert len(meta) == 2 and sum(r.rows for r in meta) == 300 and sum(r.nulls for r in meta) == 100 and all(r.encryption == "UNENCRYPTED" for r in meta)
    blocks = fk.parquet_blocks(spark, path, parallelism=1).collect()
    assert sum(r.rows for r in blocks) == 300 and sum(r.compressedBytes for r in blocks) == sum(r.compressedBytes for r in meta)
    chunks = fk.parquet_block_columns(spark, path).collect()
    assert len(chunks) == 2 * len(blocks) and min(int(r.minValue) for r in chunks if r.column == ["id"]) == 0
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        parts = fk.parquet_partitions(spark, path).collect()
        read = {r.p: r["count"] for r in spark.read.parquet(path).groupBy(F.spark_partition_id().alias("p")).count().collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    by = {}
    for r in parts:
        by[r.partition] = by.get(r.partition, 0) + r.rows
    assert {k: v for k, v in by.items() if v} == read and len(parts) > 2
    nested = str(tmp_path / "n")
    spark.sql("select 1L a, struct(1 as x, 2.0D as y, timestamp'2020-01-01 00:00:00' as z) b, array('q') c").coalesce(1).write.parquet(nested)
    assert [".".join(r.columnPath) for r in fk.parquet_schema(spark, nested).collect()] == ["a", "b.x", "b.y", "b.z", "c.list.element"]


def test_parquet_schema_and_values_of_nested_columns(spark, tmp_path):
    """Own repetition, logical types, text of the schema and of statistics."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    deep = pa.struct([pa.field("need", pa.int64(), nullable=False), pa.field("may", pa.timestamp("us", tz="UTC"))])
    schema = pa.schema(
        [
            pa.field("key", pa.int64(), nullable=False), pa.field("deep", deep), pa.field("words", pa.list_(pa.string())), pa.field("tiny", pa.int8()), pa.field("price", pa.decimal128(30, 3)),
            pa.field("day", pa.date32()), pa.field("at", pa.timestamp("ms")), pa.field("ratio", pa.float64()), pa.field("raw", pa.binary()), pa.field("u", pa.uint32()),
        ]
    )
    rows = [
        {"key": 1, "deep": {"need": 5, "may": dt.datetime(2001, 2, 3, 4, 5, 6, 7)}, "words": ["x", None], "tiny": -3, "price": Decimal("12.345"), "day": dt.date(1969, 12, 30), "at": dt.datetime(2020, 1, 1), "ratio": 1.5e-7, "raw": b"\x01\xff", "u": 2**31 + 5},
        {"key": 2, "deep": None, "words": None, "tiny": 4, "price": Decimal("-1.000"), "day": None, "at": None, "ratio": 123456789.0, "raw": None, "u": 7},
    ]
    path = str(tmp_path / "one.parquet")
    pq.write_table(pa.Table.from_pylist(rows, schema=schema), path, coerce_timestamps=None, version="2.6")
    got = {r.columnName: r for r in fk.parquet_schema(spark, path).collect()}
    told = {n: (r.repetition, r.type, r.originalType, r.logicalType, r.maxDefinitionLevel, r.maxRepetitionLevel) for n, r in got.items()}
    assert told["key"] == ("REQUIRED", "INT64", None, None, 0, 0)
    assert told["need"] == ("REQUIRED", "INT64", None, None, 1, 0)
    assert told["may"] == ("OPTIONAL", "INT64", "TIMESTAMP_MICROS", "TIMESTAMP(MICROS,true)", 2, 0)
    assert told["element"] == ("OPTIONAL", "BINARY", "UTF8", "STRING", 3, 1)
    assert told["tiny"][2:4] == ("INT_8", "INTEGER(8,true)") and told["price"][2:4] == ("DECIMAL", "DECIMAL(30,3)") and told["at"][3] == "TIMESTAMP(MILLIS,false)"
    assert got["price"].length == 13 and got["key"].length == 0 and {r.primitiveOrder for r in got.values()} == {"TYPE_DEFINED_ORDER"}
    chunk = {r.column[-1]: r for r in fk.parquet_block_columns(spark, path).collect()}
    ends = {n: (r.minValue, r.maxValue, r.nulls) for n, r in chunk.items()}
    assert ends["tiny"] == ("-3", "4", 0) and ends["price"] == ("-1.000", "12.345", 0) and ends["day"] == ("1969-12-30", "1969-12-30", 1)
    assert ends["ratio"] == ("1.5E-7", "1.23456789E8", 0) and ends["raw"][0] == "0x01FF" and ends["u"] == ("7", str(2**31 + 5), 0)
    assert ends["may"][0] == "2001-02-03T04:05:06.000007+0000" and ends["at"][0] == "2020-01-01T00:00:00.000"
    assert chunk["element"].type == "optional binary element (STRING)" and chunk["key"].type == "required int64 key"
    text = fk.parquet_metadata(spark, path).first().schema
    assert text.startswith("message schema {\n  required int64 key;\n  optional group deep {\n    required int64 need;\n") and "  optional group words (LIST) {\n    repeated group list {\n" in text
    assert text.count("{") == text.count("}") == 4


def test_parquet_of_a_store_that_arrow_does_not_know(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "p")
    spark.range(0, 300, 1, 3).write.parquet(path)
    want = [tuple(r) for r in fk.parquet_blocks(spark, path).orderBy("filename").collect()]
    monkeypatch.setattr(parquet_meta, "_known_to_arrow", lambda p: False)
    monkeypatch.setattr(parquet_meta, "_tail", None)
    assert [tuple(r) for r in fk.parquet_blocks(spark, path).orderBy("filename").collect()] == want and len(want) == 3


def test_parquet_opens_a_file_of_many_splits_once(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(0, 50_000, 1, 1).write.option("parquet.block.size", 1024).parquet(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        parts = fk.parquet_partitions(spark, path)
        assert parts.count() > 50 and parts._jdf.queryExecution().toRdd().getNumPartitions() == 1
        assert parts.agg(F.sum("rows")).first()[0] == 50_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_parquet_encryption(spark, tmp_path):
    """Encrypted columns under a plain footer are told by nulls; an encrypted footer is an error."""
    import base64

    import pyarrow as pa
    import pyarrow.parquet as pq
    import pyarrow.parquet.encryption as pe

    class Kms(pe.KmsClient):
        def __init__(self, config):
            super().__init__()

        def wrap_key(self, key, master):
            return base64.b64encode(key)

        def unwrap_key(self, wrapped, master):
            return base64.b64decode(wrapped)

    factory, connection = pe.CryptoFactory(lambda c: Kms(c)), pe.KmsConnectionConfig()
    for name, plain in (("plain", True), ("closed", False)):
        config = pe.EncryptionConfiguration(footer_key="f", column_keys={"k": ["b"]}, plaintext_footer=plain)
        with pq.ParquetWriter(str(tmp_path / f"{name}.parquet"), pa.schema([("a", pa.int64()), ("b", pa.int64())]), encryption_properties=factory.file_encryption_properties(connection, config)) as w:
            w.write_table(pa.table({"a": [1, 2], "b": [3, 4]}))
    one = str(tmp_path / "plain.parquet")
    footer = parquet_footer.Footer(parquet_meta._tail(one))
    assert footer.encryption == "PLAINTEXT_FOOTER"
    row = next(parquet_meta._file_row(footer))
    assert (row["rows"], row["columns"], row["values"], row["compressedBytes"], row["nulls"]) == (2, 2, None, None, None)
    chunks = list(parquet_meta._chunk_rows(footer))
    assert [c["encrypted"] for c in chunks] == [False, True] and all(c["minValue"] is None and c["values"] is None for c in chunks)
    with pytest.raises(ValueError, match="encrypted columns"):
        list(parquet_meta._split_rows(footer, [(0, 0, 10)], 10))
    with pytest.raises(ValueError, match="footer is encrypted"):
        parquet_meta._tail(str(tmp_path / "closed.parquet"))


def test_connect_sessions_are_rejected(spark):
    fake = type("SparkSession", (), {"__module__": "pyspark.sql.connect.session"})()
    for call in (lambda: fk.set_job_description(fake, "x"), lambda: fk.create_temporary_dir(fake, "x"), lambda: fk.parquet_metadata(fake, "x")):
        with pytest.raises(RuntimeError, match="Spark Connect"):
            call()


def test_names_with_dots_in_groups_and_row_numbers(spark):
    df = spark.createDataFrame([(1, 5), (1, 3), (2, 9)], ["k.k", "o`o"])
    got = fk.group_by_sorted(df, "k.k", order=["o`o"]).flat_map(lambda key, rows: [(key[0], [r[1] for r in rows])], "k long, os array<long>").collect()
    assert {r.k: r.os for r in got} == {1: [3, 5], 2: [9]}
    assert {r["k.k"]: r["count"] for r in fk.group_by_key(df, "k.k").count().collect()} == {1: 2, 2: 1}
    numbered = fk.with_row_numbers(df, "n.n", order="o`o")
    assert numbered.columns == ["k.k", "o`o", "n.n"] and [tuple(r) for r in numbered.orderBy("`n.n`").collect()] == [(1, 3, 1), (1, 5, 2), (2, 9, 3)]
    again = fk.with_row_numbers(numbered, "n.n", order="`n.n`", ascending=False)
    assert again.columns == ["k.k", "o`o", "n.n"] and {r["n.n"] for r in again.collect()} == {1, 2, 3}
    with pytest.raises(ValueError, match="NONE"):
        fk.with_row_numbers(df, storage_level=StorageLevel.NONE)


def test_poetry_project(spark, tmp_path):
    """A stand-in for Poetry writes the wheel; the command gets the project and the folder, and pip the wheel."""
    project = tmp_path / "project"
    project.mkdir()
    script = tmp_path / "poetry.py"
    script.write_text(
        "import shutil, sys\n"
        "assert sys.argv[1:4] == ['build', '--format', 'wheel'] and sys.argv[-1].endswith('project')\n"
        f"shutil.copy({write_wheel(str(tmp_path), 'fkpoem', 11)!r}, sys.argv[sys.argv.index('--output') + 1])\n"
    )
    fk.install_poetry_project(spark, str(project), poetry=[sys.executable, str(script)], pip_arguments=("--no-index", "--no-deps"))

    def value(_):
        import fkpoem

        return fkpoem.VALUE

    assert spark.sparkContext.parallelize([0]).map(value).collect() == [11]
    with pytest.raises(subprocess.CalledProcessError):
        fk.install_poetry_project(spark, str(project), poetry=[sys.executable, "-c", "raise SystemExit(3)"])


def test_fluent_names_session(spark):
    assert fk.On(1, True).call(str) == "1" and fk.On(1, False).call(str) == 1
    assert fk.On(1, False).either(str).otherwise(float) == 1.0 and fk.call(2, str) == "2"
    assert spark.range(3).transform(fk.transform_if(True, lambda d: d.where("id = 1"))).count() == 1
    assert spark.range(3).transform(fk.transform_if(False, lambda d: d.where("id = 1"))).count() == 3
    assert fk.backticks("a", "b.c", "d`e", "1x") == "a.`b.c`.`d``e`.`1x`"
    assert fk.free_prefix(["a", "__b", "_c"]) == "___" and fk.free_prefix([]) == "_"
    get = lambda: spark.sparkContext.getLocalProperty("spark.job.description")
    with fk.job_description(spark, "outer"):
        with fk.append_job_description(spark, "inner"):
            assert get() == "outer - inner"
        with fk.job_description(spark, "no", if_not_set=True):
            assert get() == "outer"
    assert get() is None
    assert os.path.isdir(fk.create_temporary_dir(spark, "x"))
    assert fk.version_info(spark)["spark"] == spark.version


def write_wheel(folder, name, value):
    """A package of one module, as a wheel, without any build tool."""
    path = os.path.join(folder, f"{name}-1.0-py3-none-any.whl")
    info = f"{name}-1.0.dist-info"
    files = {
        f"{name}/__init__.py": f"VALUE = {value}\n",
        f"{info}/METADATA": f"Metadata-Version: 2.1\nName: {name}\nVersion: 1.0\n",
        f"{info}/WHEEL": "Wheel-Version: 1.0\nGenerator: test\nRoot-Is-Purelib: true\nTag: py3-none-any\n",
    }
    with zipfile.ZipFile(path, "w") as z:
        for n, text in files.items():
            z.writestr(n, text)
        z.writestr(f"{info}/RECORD", "".join(f"{n},,\n" for n in (*files, f"{info}/RECORD")))
    return path


def test_pip_package(spark, tmp_path):
    fk.install_pip_package(spark, "--no-index", "--no-deps", write_wheel(str(tmp_path), "fkprobe", 7))

    def value(_):
        import fkprobe

        return fkprobe.VALUE

    assert spark.sparkContext.parallelize([0]).map(value).collect() == [7]


def test_cli(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string").write.csv(str(tmp_path / "l"))
    spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string").write.parquet(str(tmp_path / "r"))
    common = ["--left-format", "csv", "--left-schema", "id int, v string", "-f", "parquet", "--id", "id", str(tmp_path / "l"), str(tmp_path / "r")]
    cli.run([*common, str(tmp_path / "o"), "--filter", "C", "--filter", "I", "--output-format", "json"], spark)
    assert sorted(r["diff"] for r in spark.read.json(str(tmp_path / "o")).collect()) == ["C", "I"]
    cli.run([*common, str(tmp_path / "s"), "--statistics", "--save-mode", "overwrite"], spark)
    assert {(r["diff"], r["count"]) for r in spark.read.parquet(str(tmp_path / "s")).collect()} == {("C", 1), ("D", 1), ("I", 1)}
    with pytest.raises(SystemExit):
        cli.run([*common, "x", "--filter", "Z"], spark)
