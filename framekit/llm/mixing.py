"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks of rows. With share w of the slots, its block i may not run before slot
floor(i / w) and must run before slot ceil((i + 1) / w); taking the earliest deadline among the
released blocks meets them all, so after every slot each source is less than one block from its
share. When a source ends, the others go on with their weights in proportion. No row is dropped or repeated:
the result is an order of all rows.

Weights are taken as the exact decimal numbers that they are written as. Where they repeat after few slots (``MAX_SLOTS`` for all
phases together), the driver lays out one period for each set of sources still running and every row finds its slot by arithmetic.
All other weights, and any number of sources, have their schedule laid out block by block, in one pass that holds a
heap of the sources; the blocks, a hundredth of the rows, are written to the shared folder and joined. Both give the same schedule.
Rows of a source are ordered by hash and numbered by many tasks; only a row count for each source reaches the driver.

Defined results: sources without a target, and null ones, form one pool of their own; sources with a target
but no rows are left out. Equal rows take neighbouring places of their source in some order. An empty table gives an empty table.
Texts of any length go along as they are. Columns of the input are kept whatever their names, but for ``block``, ``slot`` and ``position``.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framekit.llm.common import columns, number_within, written
from framekit.names import backticks, free_prefix

#: Rows of a block; the most slots that the driver lays out.
BLOCK_ROWS, MAX_SLOTS = 100, 20_000
#: Bytes of texts in one file of an ordered table.
FILE_BYTES = 64 << 20


def period(weights: Sequence[int]) -> list[list[int]]:
    """The slots of each source in one period of ``sum(weights)`` slots, by earliest deadline first."""
    total = sum(weights)
    slots: list[list[int]] = [[] for _ in weights]
    waiting = [(0, s) for s in range(len(weights))]
    heapq.heapify(waiting)
    ready: list[tuple[int, int]] = []
    for t in range(total):
        while waiting and waiting[0][0] <= t:
            _, s = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(len(slots[s]) + 1) * total // weights[s]), s))
        _, s = heapq.heappop(ready)
        slots[s].append(t)
        if len(slots[s]) < weights[s]:
            heapq.heappush(waiting, (len(slots[s]) * total // weights[s], s))
    return slots


@dataclass(frozen=True)
class Phase:
    """Slots from ``first`` on, while the same sources run: each one's first block here, weight, and slots in a period."""

    first: int
    period: int
    start: dict[int, int]
    slots: dict[int, list[int]]

    def slot(self, source: int, block: int) -> int:
        turn, place = divmod(block - self.start[source], len(self.slots[source]))
        return self.first + turn * self.period + self.slots[source][place]


def phases(weights: Sequence[int], blocks: Sequence[int]) -> list[Phase]:
    """Phases that schedule all blocks; a phase ends when a source has run its last one."""
    done = [0] * len(weights)
    first, out = 0, []
    while running := [s for s in range(len(weights)) if done[s] < blocks[s]]:
        g = math.gcd(*(weights[s] for s in running))
        w = [weights[s] // g for s in running]
        laid = dict(zip(running, period(w), strict=True))
        phase = Phase(first, sum(w), {s: done[s] for s in running}, laid)
        end = min(phase.slot(s, blocks[s] - 1) for s in running) + 1
        out.append(phase)
        for s in running:
            turns, part = divmod(end - first, phase.period)
            done[s] += turns * len(laid[s]) + sum(t < part for t in laid[s])
        first = end
    return out


def blocks_in_order(weights: Sequence[int], blocks: Sequence[int]) -> Iterator[tuple[int, int]]:
    """(source, block) of every slot, for any weights: the schedule of ``phases`` without a table of periods."""
    done = [0] * len(weights)
    while running := [s for s in range(len(weights)) if done[s] < blocks[s]]:
        total = sum(weights[s] for s in running)
        ran = dict.fromkeys(running, 0)
        waiting = [(0, s) for s in running]
        ready: list[tuple[int, int]] = []
        t, ended = 0, False
        while not ended:
            while waiting and waiting[0][0] <= t:
                _, s = heapq.heappop(waiting)
                heapq.heappush(ready, (-(-(ran[s] + 1) * total // weights[s]), s))
            _, s = heapq.heappop(ready)
            yield s, done[s]
            ran[s], done[s], t = ran[s] + 1, done[s] + 1, t + 1
            heapq.heappush(waiting, (ran[s] * total // weights[s], s))
            ended = done[s] == blocks[s]


def _integer(weights: Sequence[float]) -> list[int]:
    """Whole numbers in exactly the weights' proportions."""
    exact = [Fraction(repr(float(w))) for w in weights]
    by = math.lcm(*(w.denominator for w in exact))
    whole = [int(w * by) for w in exact]
    return [w // math.gcd(*whole) for w in whole]


def _laid(df: DataFrame, weights: list[int], rows: list[int], block_rows: int) -> DataFrame:
    """(pool, block, slot, start) of every block, laid out by one task and written."""
    blocks = [-(-n // block_rows) for n in rows]

    def run(batches):
        import pyarrow as pa

        for _ in batches:
            slot, start, held = 0, 0, []
            for s, b in blocks_in_order(weights, blocks):
                held.append((s, b, slot, start))
                slot, start = slot + 1, start + min(block_rows, rows[s] - b * block_rows)
                if len(held) == 50_000 or start == sum(rows):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=["pool", "block", "slot", "start"])
                    held = []

    import pyarrow as pa

    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
    one = df.sparkSession.range(0, 1 if any(rows) else 0, 1, 1)
    return written(one.mapInArrow(run, "pool int, block long, slot long, start long"), "schedule")


def mix(
    df: DataFrame, source: str, targets: Mapping[str, float], other: float, identity: Sequence[str], block_rows: int = BLOCK_ROWS, hashed: Column | None = None, prefix: str = ""
) -> DataFrame:
    """Append block (of its source), slot and position (gapless from 0), their names after the prefix, to every row.

    ``targets``: weights of named sources; ``other``: of the pool of all others. ``identity``:
    columns whose hash (``hashed``, a long, if given) orders the rows of a source and spreads their numbering.
    """
    if other <= 0 or any(w <= 0 for w in targets.values()):
        raise ValueError("give weights over 0")
    names = sorted(targets)
    weights = _integer([targets[k] for k in names] + [other])
    mark = free_prefix([*df.columns, f"{prefix}position"])
    pool, rank, block = f"{mark}pool", f"{mark}rank", f"{mark}block"
    made = [prefix + n for n in ("block", "slot", "position")]
    kept = [c for c in df.columns if c.lower() not in made]

    def result(out: DataFrame, slot: str, position: Column) -> DataFrame:
        return out.select(*columns(df, kept), *(c.alias(n) for c, n in zip((F.col(block), F.col(slot), position.cast("long")), made, strict=True)))

    spark = df.sparkSession
    if len(names) <= 100:
        listed = F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")
        # 1-based place among the targets; 0 for all others.
        place = F.coalesce(F.array_position(listed, F.col(backticks(source)).cast("string")), F.lit(0))
        pooled = df.withColumn(pool, F.when(place > 0, place - 1).otherwise(len(names)).cast("int"))
    else:
        # As many rows as the caller has given targets.
        known = F.broadcast(spark.createDataFrame(list(enumerate(names)), f"`{pool}` int, `{block}` string"))
        pooled = df.join(known, F.col(backticks(source)).cast("string") == F.col(block), "left").drop(block).withColumn(pool, F.coalesce(pool, F.lit(len(names))))
    counts = {r[pool]: r["count"] for r in pooled.groupBy(pool).count().collect()}
    rows = [counts.get(i, 0) for i in range(len(weights))]
    present = [s for s in range(len(weights)) if rows[s]]
    own = columns(df, identity)
    numbered = number_within(pooled, rank, [pool], F.xxhash64(*own) if hashed is None else hashed, own)
    numbered = numbered.withColumn(block, F.floor(F.col(rank) / block_rows).cast("long"))
    within = F.col(rank) % block_rows
    if sum(weights[s] for s in present) * len(present) > MAX_SLOTS:
        laid = _laid(df, weights, rows, block_rows).select(F.col("pool").alias(pool), F.col("block").alias(block), F.col("slot").alias(f"{mark}slot"), F.col("start").alias(f"{mark}start"))
        out = numbered.join(laid, [pool, block])
        return result(out, f"{mark}slot", F.col(f"{mark}start") + within)
    blocks = [-(-n // block_rows) for n in rows]
    plan = phases(weights, blocks)
    # Tables of at most MAX_SLOTS rows: one for each pool, and one for each phase, pool and place in the period.
    laid = [(s, i, j, p.start[s], p.first + t, len(p.slots[s]), p.period) for s in present for i, p in enumerate(p for p in plan if s in p.start) for j, t in enumerate(p.slots[s])]
    a, b = f"{mark}phases", f"{mark}phase"
    j, s0, t0, w, p, slot = (f"{mark}{x}" for x in ("j", "start", "first", "weight", "period", "slot"))
    slot_table = spark.createDataFrame(laid, f"`{pool}` int, `{b}` int, `{j}` int, `{s0}` long, `{t0}` long, `{w}` int, `{p}` long")
    # Start and weight of each phase of a pool.
    phase_table = spark.createDataFrame([(s, [[p.start[s], len(p.slots[s])] for p in plan if s in p.start]) for s in present], f"`{pool}` int, `{a}` array<array<long>>")
    out = numbered.join(F.broadcast(phase_table), pool)
    out = out.withColumn(b, (F.size(F.filter(a, lambda x: F.get(x, F.lit(0)) <= F.col(block))) - 1).cast("int"))
    running = F.get(F.col(a), F.col(b))
    out = out.withColumn(j, ((F.col(block) - F.get(running, F.lit(0))) % F.get(running, F.lit(1))).cast("int"))
    out = out.join(F.broadcast(slot_table), [pool, b, j])
    out = out.withColumn(slot, F.col(t0) + F.floor((F.col(block) - F.col(s0)) / F.col(w)).cast("long") * F.col(p))
    # The last block of a source may be short; later positions move up by what it lacks.
    short = [(next(p for p in reversed(plan) if s in p.start).slot(s, blocks[s] - 1), blocks[s] * block_rows - rows[s]) for s in present]
    lacking = sum((F.when(F.col(slot) > at, n).otherwise(0) for at, n in short if n), F.lit(0))
    return result(out, slot, F.col(slot) * block_rows + within - lacking)


def ordered(df: DataFrame, position: str = "position", file_bytes: int = FILE_BYTES, unmixed: DataFrame | None = None) -> DataFrame:
    """The rows dealt to partitions and sorted by their gapless position, so that files hold the mixture in order.

    The number of files follows the bytes of strings and binaries (and eight for each row), whatever the number of rows. They are
    counted in ``unmixed`` if given: the same rows, before they were numbered.
    """
    rows = df if unmixed is None else unmixed
    wide = [F.coalesce(F.octet_length(F.col(backticks(f.name))), F.lit(0)) for f in rows.schema if f.dataType.simpleString() in ("string", "binary")]
    n, size = rows.agg(F.count("*"), F.sum(sum(wide, F.lit(8)).cast("long"))).first()
    parts = max(1, -(-(size or 0) // file_bytes))
    at = F.col(backticks(position))
    return df.repartitionById(parts, F.least(F.floor(at * parts / max(n, 1)), F.lit(parts - 1)).cast("int")).sortWithinPartitions(at)
