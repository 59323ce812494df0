"""Exact top-k inner products with a pivot-distance index.

Every vector x is completed to x' = (x, sqrt(M^2 - |x|^2)), M the largest norm, and a query to q' = (q, 0);
then |q' - x'|^2 = |q|^2 + M^2 - 2 q.x, so the best products are the nearest points. The index keys each vector by its nearest
pivot and the distance to it, sorted, in chunks: thin annuli around the pivots. Each query expands them in the order of
their distance from it, by the triangle inequality |d(q, pivot) - d(x, pivot)|, first one, then in steps that grow by ``GROWTH``. After each
step its k-th best product bounds the radius anew, and it stops where no annulus left can hold a product as good.

Queries that lie together travel as a block, so products are matrix products; a step ships to each chunk only the queries
of a block that need it, and the chunk's vectors once; queries of more than ``BROADCAST`` bytes never pass the driver. A cell of any size is cut
into chunks: the range partitioning ends with the vector id, so equal vectors spread over tasks. Pivots come from a bounded sample (``SAMPLE``); every vector is indexed. What
the driver and the tasks know of all chunks is cell and radii, of ``MAX_CHUNKS`` at most: chunks grow beyond.

Rows with norms far beyond those of the sample (``FAR`` times the largest) would make all bounds useless, or not finite. They are kept in
chunks of their own, which every query meets; as queries, they meet all chunks.

Defined results: vectors that are null or hold null or non-finite components, and rows without an id, take
no part. Shorter vectors count as ended by zeros. A query never meets rows with its own id. Queries with equal
ids count once, with the smallest vector; repeated rows are candidates each. Products are exact whatever the components, and clipped to
a long. Without enough candidates, all are returned; an empty table gives none. Other columns of the input play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framekit.llm.common import Scratch, hashed_sample, small, written
from framekit.names import backticks

#: Vectors that pivots are chosen from, most pivots, vectors of a chunk and of a query block, most chunks.
SAMPLE, MAX_PIVOTS, CHUNK, BLOCK, MAX_CHUNKS = 2048, 256, 1024, 256, 1 << 20
#: Chunks of the second step, and how much more each further one has.
GROWTH = 8
#: Norms beyond the largest of the sample that the bounds allow for.
FAR = 16.0
#: Bytes of a step's queries, as rows, that are broadcast at most; they meet the chunks by shuffle beyond.
BROADCAST = 8 << 20
#: Chunks whose distances from a block are looked at in one go.
_SLAB = 1 << 14
_EXACT = float(2**53)
_NONE = np.iinfo(np.int64).min


def quantised(values, scale: float = 256.0) -> np.ndarray | None:
    """floor(scale * x) of each component as doubles; None if a component is null or not finite."""
    if values is None or any(v is None for v in values):
        return None
    x = np.array(values, np.float64)
    if not np.isfinite(x).all():
        return None
    with np.errstate(over="ignore"):
        out = np.floor(scale * x)
    # Doubles beyond 2**1000 have no room for the factor, nor digits after the point.
    return np.where(np.isfinite(out), out, np.copysign(np.finfo(np.float64).max, x))


def _packed(rows: list[np.ndarray]) -> bytes:
    """Vectors of one width as bytes: the smallest of three number types that holds them."""
    x = np.stack(rows)
    top = np.abs(x).max(initial=0)
    kind = "<i2" if top < 2**15 else "<i4" if top < 2**31 else "<f8"
    return kind.encode() + x.astype(kind).tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data[3:], data[:3].decode()).reshape(n, -1).astype(np.float64)


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer products, clipped to a long but for its smallest value, which means none."""
    with np.errstate(over="ignore"):
        most = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(q.shape[1], 1)
    if most < _EXACT:
        return (q @ x.T).astype(np.int64)
    if most < 2.0**62:
        return q.astype(np.int64) @ x.astype(np.int64).T
    whole = lambda a: np.array([[int(v) for v in row] for row in a], object).reshape(a.shape)
    return np.clip(whole(q) @ whole(x).T, _NONE + 1, 2**63 - 1).astype(np.int64)


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first: each next pivot is farthest from those chosen."""
    if not len(sample):
        return sample
    chosen, gap = [0], ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < n and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


class Space:
    """Distances to the pivots among the completed vectors."""

    def __init__(self, pivots: np.ndarray, largest: float) -> None:
        self.pivots, self.m2 = pivots, largest
        self.rest = np.sqrt(np.maximum(largest - (pivots**2).sum(axis=1), 0))

    def of_vectors(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.m2 - (x**2).sum(axis=1), 0))
        return np.sqrt(np.maximum(2 * (self.m2 - x @ self.pivots.T - rest[:, None] * self.rest), 0))

    def of_queries(self, q: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((q**2).sum(axis=1)[:, None] + self.m2 - 2 * q @ self.pivots.T, 0))


def _prepared(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """Id, quantised vector, squared norm and width of the rows that take part."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, vectors, norms = [], [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if i is not None and (x := quantised(v)) is not None:
                    ids.append(i)
                    vectors.append(x)
                    with np.errstate(over="ignore"):
                        norms.append(float((x**2).sum()))
            widths = [len(x) for x in vectors]
            arrays = [pa.array(ids, pa.int64()), pa.array(vectors, pa.list_(pa.float64())), pa.array(norms, pa.float64()), pa.array(widths, pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "v", "norm", "width"])

    return df.select(F.col(backticks(vec_id)).cast("long").alias("i"), F.col(backticks(embedding)).alias("v")).mapInArrow(run, "vec_id long, v array<double>, norm double, width int")


_PACKED = "cell int, lo double, hi double, n int, ids binary, vectors binary"


def _pack(df: DataFrame, size: int, width: int) -> DataFrame:
    """Runs of at most ``size`` rows of one cell, of a table sorted by cell and distance within partitions."""

    def run(batches):
        import pyarrow as pa

        def flush(rows):
            cell, dist, ids, vectors = zip(*rows, strict=True)
            padded = [np.pad(np.asarray(v), (0, width - len(v))) for v in vectors]
            return {"cell": cell[0], "lo": min(dist), "hi": max(dist), "n": len(rows), "ids": np.array(ids, "<i8").tobytes(), "vectors": _packed(padded)}

        schema = pa.schema([("cell", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64()), ("n", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary())])
        held: list = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("cell", "dist", "vec_id", "v")), strict=True):
                if held and (held[0][0] != row[0] or len(held) == size):
                    yield pa.RecordBatch.from_pylist([flush(held)], schema=schema)
                    held = []
                held.append(row)
        if held:
            yield pa.RecordBatch.from_pylist([flush(held)], schema=schema)

    return df.mapInArrow(run, _PACKED)


def _keyed(df: DataFrame, space: tuple, width: int, queries: bool) -> DataFrame:
    """With the nearest pivot as cell, and the distance to it; in cell -1 beyond the space's largest norm."""
    shared = df.sparkSession.sparkContext.broadcast(space)

    def run(batches):
        import pyarrow as pa

        s = Space(*shared.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, dist = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
            near = np.flatnonzero(batch.column("norm").to_numpy() <= s.m2)
            if len(near):
                vectors = batch.column("v").to_pylist()
                x = np.stack([np.pad(np.asarray(vectors[i]), (0, width - len(vectors[i]))) for i in near])
                d = s.of_queries(x) if queries else s.of_vectors(x)
                cell[near] = d.argmin(axis=1)
                dist[near] = d.min(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(dist), batch.column("vec_id"), batch.column("v")], names=["cell", "dist", "vec_id", "v"])

    keyed = df.select("vec_id", "v", "norm").mapInArrow(run, "cell int, dist double, vec_id long, v array<double>")
    return keyed.repartitionByRange("cell", "dist", "vec_id").sortWithinPartitions("cell", "dist", "vec_id")


class _Rings:
    """Cell and radii of every chunk."""

    def __init__(self, space: tuple, chunk: np.ndarray, cell: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        self.space, self.chunk, self.cell, self.lo, self.hi = Space(*space), chunk, cell, lo, hi

    def expansion(self, cell: int, q: np.ndarray, kth: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """Place, chunk and the queries of a block that may need it, of every such chunk, in the order of their distance from the block."""
        n = len(self.chunk)
        if cell < 0:
            yield from ((place, int(self.chunk[place]), np.arange(len(q))) for place in range(n))
            return
        s = self.space
        d = s.of_queries(q)
        known = kth > _NONE
        # A little wider than the bound, for rounding.
        radius = np.sqrt(np.maximum((q**2).sum(axis=1) + s.m2 - 2.0 * np.where(known, kth, 0), 0)) * (1 + 1e-9) + 1e-6 * np.sqrt(s.m2 + 1)
        radius[~known] = np.inf

        def gaps(at) -> np.ndarray:
            to = np.maximum(self.cell[at], 0)
            return np.maximum(np.maximum(self.lo[at] - d[:, to], d[:, to] - self.hi[at]), 0) * (self.cell[at] >= 0)

        least, needed = np.empty(n), np.empty(n, bool)
        for i in range(0, n, _SLAB):
            part = gaps(slice(i, i + _SLAB))
            least[i : i + _SLAB], needed[i : i + _SLAB] = part.min(axis=0), (part <= radius[:, None]).any(axis=0)
        order = np.argsort(least, kind="stable")
        places = np.flatnonzero(needed[order])
        for i in range(0, len(places), _SLAB):
            at = order[places[i : i + _SLAB]]
            need = gaps(at) <= radius[:, None]
            yield from ((int(places[i + j]), int(self.chunk[c]), np.flatnonzero(need[:, j])) for j, c in enumerate(at))


_STATE = "block long, cell int, n int, ids binary, vectors binary, done int, scores binary, found binary"


def _asked(state: DataFrame, rings, step: int, k: int) -> DataFrame:
    """For every block, the next ``step`` chunks of its expansion that a query may need, each with these queries.

    What is needed only shrinks as the bounds tighten, so a block without a row here is done.
    """

    def run(batches):
        import pyarrow as pa

        r = _Rings(*rings.value)
        for batch in batches:
            for b in batch.to_pylist():
                ids, kth = np.frombuffer(b["ids"], "<i8"), np.frombuffer(b["scores"], "<i8").reshape(-1, k)[:, -1]
                # Vectors stay packed as they are: all of a block have one type.
                kind, raw = b["vectors"][:3], np.frombuffer(b["vectors"][3:], b["vectors"][:3].decode()).reshape(b["n"], -1)
                left = (x for x in r.expansion(b["cell"], raw.astype(np.float64), kth) if x[0] >= b["done"])
                rows = ((b["block"], chunk, place, at.astype("<i4").tobytes(), ids[at].tobytes(), kind + raw[at].tobytes(), kth[at].tobytes()) for place, chunk, at in islice(left, step))
                while out := list(islice(rows, 64)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    import pyarrow as pa

    names, kinds = ["block", "chunk", "place", "at", "q_ids", "q_vectors", "kth"], (pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 4)
    return state.mapInArrow(run, "block long, chunk long, place int, at binary, q_ids binary, q_vectors binary, kth binary")


def _best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row of scores with their ids; ties to the smaller id; ended by none."""
    if scores.shape[1] < k:
        lack = ((0, 0), (0, k - scores.shape[1]))
        scores, ids = np.pad(scores, lack, constant_values=_NONE), np.pad(ids, lack)
    if scores.shape[1] > 4 * k:
        # Only what reaches the k-th best score is put in order.
        kth = np.partition(scores, -k, axis=1)[:, -k]
        most = int((scores >= kth[:, None]).sum(axis=1).max())
        if most < scores.shape[1]:
            at = np.argsort(scores < kth[:, None], axis=1, kind="stable")[:, :most]
            scores, ids = np.take_along_axis(scores, at, 1), np.take_along_axis(ids, at, 1)
    # Smaller ids first, then by score: a negated long is exact, as the smallest of all stands for none only.
    by_id = np.argsort(ids, axis=1, kind="stable")
    scores, ids = np.take_along_axis(scores, by_id, 1), np.take_along_axis(ids, by_id, 1)
    at = np.argsort(np.where(scores == _NONE, 2**63 - 1, -np.maximum(scores, _NONE + 1)), axis=1, kind="stable")[:, :k]
    return np.take_along_axis(scores, at, 1), np.take_along_axis(ids, at, 1)


def _with_chunks(pairs: DataFrame, data: DataFrame, scratch: Scratch) -> DataFrame:
    """What a step asks, beside the vectors of its chunks.

    A block's queries stand in the files once for many chunks, so files may be a hundredth of their rows, and Spark, which goes by the
    files, would have the driver gather them. The rows' own size decides here.
    """
    size = pairs.agg(F.sum(sum(F.octet_length(c) for c in ("at", "q_ids", "q_vectors", "kth")))).first()[0] or 0
    if size <= BROADCAST:
        return data.join(F.broadcast(pairs), "chunk")
    # Only chunks that are asked for are shuffled.
    wanted = data.join(small(pairs.select("chunk").distinct(), scratch), "chunk", "left_semi")
    return wanted.hint("merge").join(pairs.hint("merge"), "chunk")


def _scored(pairs: DataFrame, k: int) -> DataFrame:
    """The best of each chunk for the queries that meet it."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                q_ids, ids, kth = (np.frombuffer(r[c], "<i8") for c in ("q_ids", "ids", "kth"))
                got = _scores(_unpacked(r["q_vectors"], len(q_ids)), _unpacked(r["vectors"], r["n"]))
                got[(got < kth[:, None]) | (q_ids[:, None] == ids[None, :])] = _NONE
                scores, found = _best_of(got, np.broadcast_to(ids, got.shape), k)
                out.append((r["block"], r["place"], r["at"], scores.astype("<i8").tobytes(), found.astype("<i8").tobytes()))
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), *[pa.binary()] * 3), strict=True)], names=["block", "place", "at", "scores", "found"])

    return pairs.mapInArrow(run, "block long, place int, at binary, scores binary, found binary")


def _merged(state: DataFrame, scored: DataFrame, k: int) -> DataFrame:
    """The blocks' best so far, with what a step has found."""
    both = state.unionByName(scored, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", F.col("at").isNotNull())

    def run(batches):
        import pyarrow as pa

        def finished():
            values = {**row, "done": done, "scores": scores.astype("<i8").tobytes(), "found": found.astype("<i8").tobytes()}
            return pa.RecordBatch.from_arrays([pa.array([values[n]], t) for n, t in zip(names, kinds, strict=True)], names=names)

        row = None
        for batch in batches:
            for r in batch.to_pylist():
                if r["at"] is None:
                    if row is not None:
                        yield finished()
                    row, done = r, r["done"]
                    scores, found = (np.frombuffer(r[c], "<i8").reshape(-1, k).copy() for c in ("scores", "found"))
                else:
                    at, done = np.frombuffer(r["at"], "<i4"), max(done, r["place"] + 1)
                    more, ids = (np.frombuffer(r[c], "<i8").reshape(-1, k) for c in ("scores", "found"))
                    scores[at], found[at] = _best_of(np.hstack([scores[at], more]), np.hstack([found[at], ids]), k)
        if row is not None:
            yield finished()

    import pyarrow as pa

    names, kinds = [f.split()[0] for f in _STATE.split(", ")], (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary())
    return both.select(*names, "place", "at").mapInArrow(run, _STATE)


def _listed(state: DataFrame, k: int) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for b in batch.to_pylist():
                ids = np.frombuffer(b["ids"], "<i8")
                scores, found = (np.frombuffer(b[c], "<i8").reshape(-1, k) for c in ("scores", "found"))
                q, rank = np.nonzero(scores > _NONE)
                arrays = [pa.array(ids[q]), pa.array((rank + 1).astype(np.int32)), pa.array(found[q, rank]), pa.array(scores[q, rank])]
                yield pa.RecordBatch.from_arrays(arrays, names=["query_id", "rank", "vec_id", "score"])

    return state.mapInArrow(run, "query_id long, rank int, vec_id long, score long")


def top_k(df: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of each query's ``k`` best rows; ties go to the smaller id. ``is_query`` is about ``vec_id``."""
    spark = df.sparkSession
    with Scratch(spark) as scratch:
        base = scratch.write(_prepared(df, vec_id, embedding), "vectors")
        stats = base.agg(F.count("*").alias("n"), F.max("width").alias("width")).first()
        if not stats["n"]:
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
        width = max(stats["width"], 1)
        tame = base.where(F.col("norm") < float("inf"))
        sample = hashed_sample(tame.select("vec_id", "v", "norm"), ["vec_id", "v"], SAMPLE).collect()
        points = np.array([list(r["v"]) + [0.0] * (width - len(r["v"])) for r in sorted(sample, key=lambda r: (r["vec_id"], r["v"]))]).reshape(-1, width)
        limit = min(FAR**2 * max((r["norm"] for r in sample), default=-1.0), 1e300)
        largest = tame.where(F.col("norm") <= limit).agg(F.max("norm")).first()[0]
        pivots = choose_pivots(points, int(min(MAX_PIVOTS, max(4, np.sqrt(stats["n"]) / 8))))
        space = (pivots, -1.0 if largest is None else largest)

        size = max(CHUNK, -(-stats["n"] // MAX_CHUNKS))
        chunks = scratch.write(_pack(_keyed(base, space, width, False), size, width).withColumn("chunk", F.monotonically_increasing_id()), "chunks")
        first = F.min_by(F.struct("v", "norm"), "v")
        asked = base.where(is_query).groupBy("vec_id").agg(first.alias("x")).select("vec_id", "x.v", "x.norm")
        blocks = _pack(_keyed(asked, space, width, True), BLOCK, width)
        nothing = F.expr(f"unhex(repeat('{'00' * 7}80', n * {k}))")
        named = blocks.select(F.monotonically_increasing_id().alias("block"), "cell", "n", "ids", "vectors", F.lit(0).alias("done"), nothing.alias("scores"), nothing.alias("found"))
        state = scratch.write(named, "queries")

        # At most MAX_CHUNKS and one for each partition and cell.
        known = chunks.select("chunk", "cell", "lo", "hi").orderBy("chunk").toPandas()
        rings = spark.sparkContext.broadcast((space, *(known[c].to_numpy() for c in ("chunk", "cell", "lo", "hi"))))
        data, step = chunks.select("chunk", "n", "ids", "vectors"), 1
        while not (pairs := scratch.write(_asked(state, rings, step, k), "asked")).isEmpty():
            after = scratch.write(_merged(state, _scored(_with_chunks(pairs, data, scratch), k), k), "queries")
            scratch.drop(pairs)
            scratch.drop(state)
            state, step = after, step * GROWTH
        return written(_listed(state, k), "top")
