"""The structure of Parquet files as tables: files, columns, row groups, column chunks, splits.

The driver only lists files. Executors read the footers, and nothing but these, a task for each group of files, through Arrow's
file systems. Of files in stores that Arrow does not know, and which only Spark's own file systems read, the driver
fetches the footers, some kilobytes each.

Columns may be encrypted: then sizes, values, nulls and statistics of the file are null, and its splits cannot be told. An
encrypted footer is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from framekit.session import require_classic
from framekit.sources.parquet_footer import CODECS, ENCODINGS, Footer, read_tail, value_text

_METADATA = (
    "filename string, blocks int, compressedBytes long, uncompressedBytes long, rows long, columns int, values long, nulls long, "
    "createdBy string, schema string, encryption string, keyValues map<string,string>"
)
_SCHEMA = (
    "filename string, columnName string, columnPath array<string>, repetition string, type string, length int, originalType string, "
    "logicalType string, isPrimitive boolean, primitiveType string, primitiveOrder string, maxDefinitionLevel int, maxRepetitionLevel int"
)
_BLOCKS = "filename string, block int, blockStart long, compressedBytes long, uncompressedBytes long, rows long, columns int, values long, nulls long"
_COLUMNS = (
    "filename string, block int, column array<string>, codec string, type string, encodings array<string>, encrypted boolean, minValue string, "
    "maxValue string, columnStart long, compressedBytes long, uncompressedBytes long, values long, nulls long"
)
_PARTITIONS = (
    "partition int, start long, end long, length long, blocks int, compressedBytes long, uncompressedBytes long, rows long, columns int, "
    "values long, nulls long, filename string, fileLength long"
)


#: Footers that the driver fetches at once.
_THREADS = 16


def _splits(spark: SparkSession, paths: tuple[str, ...]) -> list[tuple[int, int, int, str, int]]:
    """(partition, start, length, file, file size) as Spark plans an ordinary read of the paths."""
    parts = require_classic(spark, "the structure of Parquet files").read.parquet(*paths)._jdf.queryExecution().toRdd().partitions()
    out = []
    for p in parts:
        for f in p.files():
            out.append((p.index(), f.start(), f.length(), f.filePath().toString(), f.fileSize()))
    return out


def _arrow_file(path: str):
    """The file's system and its name there; an error if Arrow does not know the store."""
    from pyarrow import fs

    scheme = urlsplit(path).scheme
    if scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(urlsplit(path).path) if scheme else path
    return fs.FileSystem.from_uri(path)


def _tail(path: str) -> bytes:
    system, name = _arrow_file(path)
    with system.open_input_file(name) as f:
        return read_tail(lambda at, n: f.read_at(n, at), f.size())


def _tail_by_spark(spark: SparkSession, path: str) -> bytes:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def read_at(position: int, length: int) -> bytes:
        stream = system.open(at)
        try:
            stream.seek(position)
            return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, length))
        finally:
            stream.close()

    return read_tail(read_at, system.getFileStatus(at).getLen())


def _known_to_arrow(path: str) -> bool:
    try:
        _arrow_file(path)
    except Exception:  # an unknown scheme, or a store whose library is missing here
        return False
    return True


def _starting(chunk: dict) -> int:
    places = chunk[3]
    return min(places[9], places[11]) if places.get(11) else places[9]


def _nulls(chunks: list[dict]) -> int | None:
    """Only known where every chunk has a count."""
    counts = [c[3].get(12, {}).get(3) for c in chunks]
    return None if None in counts else sum(counts)


def _guarded(footer: Footer, value: Callable):
    """What cannot be told of a file with encrypted columns is null."""
    return value() if footer.encryption == "UNENCRYPTED" else None


def _block(footer: Footer, group: dict) -> dict:
    chunks = group[1]
    return {
        "blockStart": min(map(_starting, chunks), default=0) if footer.encryption == "UNENCRYPTED" else group.get(5, 0),
        "compressedBytes": _guarded(footer, lambda: sum(c[3][7] for c in chunks)),
        "uncompressedBytes": group[2],
        "rows": group[3],
        "columns": len(chunks),
        "values": _guarded(footer, lambda: sum(c[3][5] for c in chunks)),
        "nulls": _guarded(footer, lambda: _nulls(chunks)),
    }


def _totals(blocks: list[dict]) -> dict:
    sums = {k: [b[k] for b in blocks] for k in ("compressedBytes", "uncompressedBytes", "rows", "values", "nulls")}
    return {k: None if None in v else sum(v) for k, v in sums.items()}


def _file_row(footer: Footer) -> Iterator[dict]:
    totals = _totals([_block(footer, g) for g in footer.groups])
    if footer.encryption != "UNENCRYPTED":
        totals["uncompressedBytes"] = None
    yield {
        "blocks": len(footer.groups), **totals, "columns": len(footer.leaves), "createdBy": footer.created_by, "schema": footer.root.text(),
        "encryption": footer.encryption, "keyValues": footer.key_values,
    }


def _column_rows(footer: Footer) -> Iterator[dict]:
    for leaf in footer.leaves:
        c = leaf.node
        yield {
            "columnName": c.name,
            "columnPath": leaf.path,
            "repetition": c.repetition,
            "type": c.type,
            "length": c.length,
            "originalType": c.original,
            "logicalType": c.logical,
            "isPrimitive": True,
            "primitiveType": c.type,
            "primitiveOrder": c.order,
            "maxDefinitionLevel": leaf.max_definition,
            "maxRepetitionLevel": leaf.max_repetition,
        }


def _block_rows(footer: Footer) -> Iterator[dict]:
    for i, group in enumerate(footer.groups):
        yield {"block": group.get(7, i) + 1, **_block(footer, group)}


def _chunk_rows(footer: Footer) -> Iterator[dict]:
    for i, group in enumerate(footer.groups):
        for leaf, c in zip(footer.leaves, group[1], strict=True):
            m = c.get(3, {})
            # The newer two fields where a writer has them.
            stats = m.get(12, {})
            low, high = (stats.get(6, stats.get(2)), stats.get(5, stats.get(1)))
            told = {
                "codec": lambda m=m: CODECS[m[4]],
                "type": lambda leaf=leaf: leaf.node.line(),
                "encodings": lambda m=m: sorted({ENCODINGS.get(e, str(e)) for e in m[2]}),
                "minValue": lambda low=low, leaf=leaf: None if low is None else value_text(low, leaf.node),
                "maxValue": lambda high=high, leaf=leaf: None if high is None else value_text(high, leaf.node),
                "columnStart": lambda c=c: _starting(c),
                "compressedBytes": lambda m=m: m[7],
                "uncompressedBytes": lambda m=m: m[6],
                "values": lambda m=m: m[5],
                "nulls": lambda c=c: _nulls([c]),
            }
            yield {"block": group.get(7, i) + 1, "column": leaf.path, "encrypted": 8 in c, **{k: _guarded(footer, f) for k, f in told.items()}}


def _split_rows(footer: Footer, splits: list[tuple[int, int, int]], size: int) -> Iterator[dict]:
    """Each split with the row groups whose midpoint lies in it."""
    if footer.encryption != "UNENCRYPTED":
        raise ValueError("the file has encrypted columns, so the places of its row groups are not known")
    blocks = [_block(footer, g) for g in footer.groups]
    for partition, start, length in splits:
        own = [b for b in blocks if start <= b["blockStart"] + b["compressedBytes"] // 2 < start + length]
        yield {"partition": partition, "start": start, "end": start + length, "length": length, "fileLength": size, "blocks": len(own), "columns": len(footer.leaves) if own else 0, **_totals(own)}


def _footers(spark: SparkSession, files: list[tuple[str, list, int]], parallelism: int | None, schema: str, rows: Callable) -> DataFrame:
    """``rows(footer, splits, size)`` of each (path, splits, size); every footer is read once."""
    struct = T.StructType.fromDDL(schema)
    foreign = [f[0] for f in files if not _known_to_arrow(f[0])]
    with ThreadPoolExecutor(_THREADS) as pool:
        tails = dict(zip(foreign, pool.map(lambda p: _tail_by_spark(spark, p), foreign), strict=True))

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for path, splits, size, tail in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                footer = Footer(_tail(path) if tail is None else tail)
                found = [{"filename": path, **r} for r in rows(footer, [(s["partition"], s["start"], s["length"]) for s in splits], size)]
                yield pa.RecordBatch.from_pylist(found, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(struct)
    listed = [(path, splits, size, tails.get(path)) for path, splits, size in files]
    n = parallelism or min(max(len(listed), 1), spark.sparkContext.defaultParallelism)
    inputs = spark.createDataFrame(listed, "path string, splits array<struct<partition:int,start:long,length:long>>, size long, tail binary")
    return inputs.repartition(n).mapInArrow(read, struct)


def _table(spark: SparkSession, paths: tuple[str, ...], parallelism: int | None, schema: str, rows: Callable) -> DataFrame:
    files = sorted({(s[3], s[4]) for s in _splits(spark, paths)})
    return _footers(spark, [(path, [], size) for path, size in files], parallelism, schema, lambda footer, *_: rows(footer))


def parquet_metadata(spark: SparkSession, *paths: str, parallelism: int | None = None) -> DataFrame:
    """One row per file."""
    return _table(spark, paths, parallelism, _METADATA, _file_row)


def parquet_schema(spark: SparkSession, *paths: str, parallelism: int | None = None) -> DataFrame:
    """One row per file and leaf column."""
    return _table(spark, paths, parallelism, _SCHEMA, _column_rows)


def parquet_blocks(spark: SparkSession, *paths: str, parallelism: int | None = None) -> DataFrame:
    """One row per file and row group."""
    return _table(spark, paths, parallelism, _BLOCKS, _block_rows)


def parquet_block_columns(spark: SparkSession, *paths: str, parallelism: int | None = None) -> DataFrame:
    """One row per file, row group and column chunk."""
    return _table(spark, paths, parallelism, _COLUMNS, _chunk_rows)


def parquet_partitions(spark: SparkSession, *paths: str, parallelism: int | None = None) -> DataFrame:
    """One row per split that Spark plans, with the row groups whose midpoint lies in it."""
    files: dict[tuple[str, int], list] = {}
    for partition, start, length, path, size in _splits(spark, paths):
        files.setdefault((path, size), []).append((partition, start, length))
    return _footers(spark, [(path, splits, size) for (path, size), splits in sorted(files.items())], parallelism, _PARTITIONS, _split_rows)
