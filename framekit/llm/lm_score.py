"""Language-model scores from a Brown class-based bigram model learned from the corpus itself.

Tokens are the text's words, lower-cased in A-Z, and one end. Every word of the training texts has a class of its own choice:

1. The most frequent words (``UNITS``), all others together by shape (how they end, or whether they are long), and the end are
   clustered by exchange on the driver, so that the class bigrams gain likelihood.
2. Every other word, however rare, starts in the class of its shape. The classes before and after each of its occurrences are
   gathered over all training texts, and it moves to the class that gains most while the others stand still; the frequent
   words first, ``ROUNDS`` times, then the rest.
3. Class bigrams are counted once more over all training texts, under the final classes.

A token's probability is P(class | class before) * P(word | class), with Witten-Bell smoothed transitions. Only words without
any occurrence in training go by shape; there is one unknown word in each shape's class, so all sums to one.

The word table stays distributed. Only its head, at most ``HEAD`` words, and bounded matrices reach the driver; all other words meet
their counts and classes in a shuffle join, where none is frequent enough to be a hot key: each of the head's is at least as frequent, or, if
the head is empty, over ``HEAD`` words are. Words of over ``WORD_BYTES`` bytes go by a digest of the whole word, so the head is bounded in bytes too.
Texts are coded once for training; what is gathered about head words is merged in blocks of ``BLOCK`` words.

Defined results: a null text is empty, and an empty text has the end token only. Texts of any length are read from end to end.
Equal texts score alike, and repeated rows count each time. Without training texts every token is unknown and the model is the base
model's uniform limit. Kept columns keep their names, but for those that are added, which replace them.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framekit.llm.common import Scratch, columns, written
from framekit.names import backticks, free_prefix

#: Words that are clustered on the driver, classes, sweeps of that exchange, and rounds of the head's other words.
UNITS, CLASSES, SWEEPS, ROUNDS = 1000, 40, 8, 1
#: Words whose counts every task gets; bytes from which on a word goes by its digest.
HEAD, WORD_BYTES = 300_000, 64
#: Entries that a task combines in memory before it passes them on.
COMBINE = 400_000
#: Head words whose neighbours are merged in one place; neighbours that are looked at in one go.
BLOCK, STEP = 1024, 40_000
_SHAPES = 4
#: The class byte of a word that isn't in the head.
_OPEN = 255


def words_of(text: bytes | None) -> list[bytes]:
    """Exactly the runs without blank, tab, line feed, vertical tab, form feed and carriage return; A-Z lower-cased.

    A long one is told by a digest of all of it, after a blank, which no other word holds, and by its last byte.
    """
    words = (text or b"").lower().split()
    if max(map(len, words), default=0) > WORD_BYTES:
        words = [w if len(w) <= WORD_BYTES else b" " + hashlib.blake2b(w, digest_size=16).digest() + w[-1:] for w in words]
    return words


def shape_of(word: bytes) -> int:
    """The shape of a word that is no unit: how it ends, or else whether it is long."""
    last = word[-1]
    return 0 if last == 46 else 1 if last == 44 else 2 if len(word) <= 8 else 3


def _shape(word: str) -> Column:
    w = F.col(word)
    return F.when(w.endswith(F.lit(b".")), 0).when(w.endswith(F.lit(b",")), 1).when(F.octet_length(w) <= 8, 2).otherwise(3)


def count_words(texts: DataFrame) -> DataFrame:
    """(word binary, c long) of a table with the one column ``text``."""

    def run(batches):
        import pyarrow as pa

        counts: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])
            counts.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = words_of(text)
                for i in range(0, len(words), COMBINE):
                    counts.update(words[i : i + COMBINE])
                    if len(counts) > COMBINE:
                        yield flush()
        if counts:
            yield flush()

    parts = texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "word binary, c long")
    return parts.groupBy("word").agg(F.sum("c").alias("c"))


def head_of(counts: DataFrame) -> list[tuple[bytes, int]]:
    """The most frequent words, at most ``HEAD``, most frequent first.

    A histogram of rounded logarithms finds the count to cut at, so no task sorts the table.
    """
    level = F.floor(F.log2("c") * 16).cast("int")
    cut, total = None, 0
    for row in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):
        total += row["count"]
        if total > HEAD:
            break
        cut = row["level"]
    if cut is None:
        return []
    rows = counts.where(level >= cut).collect()
    return sorted(((bytes(r["word"]), r["c"]) for r in rows), key=lambda x: (-x[1], x[0]))


def coded(texts: DataFrame, words: list[bytes], scratch: Scratch) -> DataFrame:
    """row, ids and rest of every text: each word's place in the head as int32, or -1 - shape and the word itself in ``rest``."""
    shared = texts.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        import pyarrow as pa

        index = {w: i for i, w in enumerate(shared.value)}
        for batch in batches:
            codes, rests = [], []
            for text in batch.column(0).to_pylist():
                ids, rest = _ids(words_of(text), index)
                codes.append(ids.tobytes())
                rests.append(rest)
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.binary()), pa.array(rests, pa.list_(pa.binary()))], names=["ids", "rest"])

    rows = texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "ids binary, rest array<binary>")
    return scratch.write(rows.withColumn("row", F.monotonically_increasing_id()), "coded")


def _ids(words: list[bytes], index: dict[bytes, int]) -> tuple[np.ndarray, list[bytes]]:
    ids = np.array([index.get(w, -1) for w in words], np.int32)
    out = np.flatnonzero(ids < 0)
    rest = [words[i] for i in out]
    ids[out] = [-1 - shape_of(w) for w in rest]
    return ids, rest


def _joined(batch, end: int) -> np.ndarray:
    """All ids of a batch of coded texts, an end before, between and behind."""
    one = np.array([end], np.int32)
    return np.concatenate([one, *(x for t in batch.column("ids").to_pylist() for x in (np.frombuffer(t, np.int32), one))])


def _matrix(table: DataFrame, size: int, ids_of) -> np.ndarray:
    """Sum over batches of the pairs of neighbours in ``ids_of(batch)``, numbers under ``size``."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros(size * size, np.int64)
        for batch in batches:
            a = ids_of(batch).astype(np.int64)
            total += np.bincount(a[:-1] * size + a[1:], minlength=size * size)
        found = np.flatnonzero(total)
        for i in range(0, len(found), 100_000):
            part = found[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], names=["pair", "n"])

    pairs = table.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size * size)
    out[pairs["pair"].to_numpy(np.int64)] = pairs["n"].to_numpy(np.float64)
    return out.reshape(size, size)


def best_classes(word: np.ndarray, ctx: np.ndarray, n: np.ndarray, old: np.ndarray, joint: np.ndarray) -> np.ndarray:
    """The class of each word that gains most likelihood while all others stand still.

    ``word`` (ascending numbers, all of them) has ``n`` times the neighbour ``ctx``: the class before, or K + the class
    behind. ``old`` are the words' classes in ``joint``, the K x K class bigrams; the last class is the end's, which no word joins.
    """
    k = len(joint) - 1
    table = np.concatenate([joint[:, :k], joint[:k].T])
    sides = np.stack([joint.sum(axis=0)[:k], joint.sum(axis=1)[:k]])
    # In an empty class any word would gain, and all that came at once would share it.
    closed = np.flatnonzero(sides.sum(axis=0) == 0)
    out = old.copy()
    starts = np.searchsorted(word, np.arange(len(old) + 1))
    at = 0
    while at < len(old):
        # As many words as have STEP neighbours, one at least.
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + STEP, "right")) - 1)
        part = slice(starts[at], starts[to])
        own, w, m = old[at:to], word[part] - at, n[part].astype(float)[:, None]
        # A word's own occurrences count in no class while it looks for one.
        there = table[ctx[part]]
        there[np.arange(len(w)), own[w]] -= m[:, 0]
        there = np.maximum(there, 0)
        gain = np.add.reduceat(_xlogx(there + m) - _xlogx(there), starts[at:to] - starts[at], axis=0)
        before = ctx[part] <= k
        for side, here in zip(sides, (before, ~before), strict=True):
            times = np.bincount(w[here], m[here, 0], to - at)[:, None]
            rest = np.repeat(side[None], to - at, axis=0)
            rest[np.arange(to - at), own] -= times[:, 0]
            rest = np.maximum(rest, 0)
            gain -= _xlogx(rest + times) - _xlogx(rest)
        i = np.arange(to - at)
        stay = gain[i, own]
        gain[:, closed] = -np.inf
        new = gain.argmax(axis=1)
        out[at:to] = np.where(gain[i, new] > stay + 1e-9, new, own)
        at = to
    return out


def _head_round(codes: DataFrame, classes: np.ndarray, head: int, first: int) -> np.ndarray:
    """New classes of the head's words from number ``first`` on. ``classes``: of the head, the end, the shapes from last to first."""
    k = int(classes[head]) + 1
    joint = _matrix(codes, k, lambda batch: classes[_joined(batch, head)])

    def gather(batches):
        import pyarrow as pa

        def flush(held):
            found, n = np.unique(np.concatenate(held), return_counts=True)
            cuts = np.flatnonzero(np.diff(found // (2 * k * BLOCK), prepend=-1, append=-1))
            parts = [(found[i] // (2 * k * BLOCK), (found[i:j] % (2 * k * BLOCK)).astype(np.int32).tobytes(), n[i:j].astype(np.int64).tobytes()) for i, j in zip(cuts, cuts[1:], strict=False)]
            cols = list(zip(*parts, strict=True)) or [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["block", "codes", "n"])

        held, size = [], 0
        for batch in batches:
            ids = _joined(batch, head)
            cls = classes[ids].astype(np.int64)
            at = np.flatnonzero((ids >= first) & (ids < head))
            own = (ids[at].astype(np.int64) - first) * (2 * k)
            held += [own + cls[at - 1], own + k + cls[at + 1]]
            size += 2 * len(at)
            if size > 10 * COMBINE:
                yield flush(held)
                held, size = [], 0
        if size:
            yield flush(held)

    def choose(batches):
        import pyarrow as pa

        def chosen(block, total):
            code = np.flatnonzero(total)
            where = first + block * BLOCK
            named, word = np.unique(code // (2 * k), return_inverse=True)
            new = best_classes(word, code % (2 * k), total[code], classes[where + named], joint)
            return pa.RecordBatch.from_arrays([pa.array(where + named), pa.array(new.astype(np.int64))], names=["id", "class"])

        block, total = None, None
        for batch in batches:
            for b, codes_, n in zip(*(batch.column(c).to_pylist() for c in ("block", "codes", "n")), strict=True):
                if b != block:
                    if block is not None:
                        yield chosen(block, total)
                    block, total = b, np.zeros(BLOCK * 2 * k, np.int64)
                total[np.frombuffer(codes_, np.int32)] += np.frombuffer(n, np.int64)
        if block is not None:
            yield chosen(block, total)

    spread = codes.select("ids").mapInArrow(gather, "block long, codes binary, n binary").repartition("block").sortWithinPartitions("block")
    found = spread.mapInArrow(choose, "id long, class long").toPandas()
    out = classes.copy()
    out[found["id"].to_numpy(np.int64)] = found["class"].to_numpy(np.int64)
    return out


def _rare_words(codes: DataFrame, classes: np.ndarray, head: int) -> DataFrame:
    """(word, c, class) of all words outside the head."""
    k = int(classes[head]) + 1
    joint = _matrix(codes, k, lambda batch: classes[_joined(batch, head)])

    def gather(batches):
        import pyarrow as pa

        counts: Counter = Counter()

        def flush():
            words, pairs = zip(*counts.keys(), strict=True)
            out = [pa.array(words, pa.binary()), pa.array([(p << 40) + n for p, n in zip(pairs, counts.values(), strict=True)], pa.int64())]
            counts.clear()
            return pa.RecordBatch.from_arrays(out, names=["word", "near"])

        for batch in batches:
            ids = _joined(batch, head)
            cls = classes[ids].astype(np.int64)
            at = np.flatnonzero(ids < 0)
            words = batch.column("rest").flatten().to_pylist()
            pairs = (cls[at - 1] * k + cls[at + 1]).tolist()
            for i in range(0, len(words), COMBINE):
                counts.update(zip(words[i : i + COMBINE], pairs[i : i + COMBINE], strict=True))
                if len(counts) > COMBINE:
                    yield flush()
        if counts:
            yield flush()

    def choose(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                near = batch.column("near")
                packed, lengths = near.flatten().to_numpy(), near.value_lengths().to_numpy().astype(np.int64)
                pair, n = packed >> 40, packed & ((1 << 40) - 1)
                word = np.repeat(np.arange(len(lengths)), lengths)
                count = np.bincount(word, n, len(lengths)).astype(np.int64)
                # Both neighbours of an occurrence; those of a word that agree are added up.
                code, where = np.unique(np.concatenate([word * (2 * k) + pair // k, word * (2 * k) + k + pair % k]), return_inverse=True)
                total = np.bincount(where, np.concatenate([n, n]))
                old = classes[-1 - batch.column("shape").to_numpy().astype(np.int64)]
                new = best_classes(code // (2 * k), code % (2 * k), total, old, joint)
                yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(count), pa.array(new.astype(np.int32))], names=["word", "c", "class"])

    near = codes.select("ids", "rest").mapInArrow(gather, "word binary, near long").groupBy("word").agg(F.collect_list("near").alias("near"))
    return written(near.select("word", _shape("word").alias("shape"), "near").mapInArrow(choose, "word binary, c long, class int"), "rare")


def _open_words(rows: DataFrame, row: str, rest: str, rare: DataFrame, shape_class: Sequence[int], p: str) -> DataFrame:
    """A row for each word in ``rest``: its row and place there, c (null if unknown), its class and shape, as p + at, c, class, shape."""
    word = f"{p}word"
    known = rare.select(F.col("word").alias(word), F.col("c").alias(f"{p}c"), F.col("class").alias(f"{p}class"))
    out = rows.select(row, F.posexplode(rest).alias(f"{p}at", word)).join(known, word, "left").withColumn(f"{p}shape", _shape(word))
    return out.withColumn(f"{p}class", F.coalesce(f"{p}class", F.get(F.array(*[F.lit(int(c)) for c in shape_class]), F.col(f"{p}shape"))))


def _placed(p: str) -> Column:
    """Place and class of a row's words outside the head, for ``_filled``."""
    return F.collect_list(F.col(f"{p}at").cast("long") * 256 + F.col(f"{p}class"))


def _filled(classes: bytes, places: np.ndarray) -> np.ndarray:
    """A text's classes with the open ones set."""
    out = np.frombuffer(classes, np.uint8)
    if len(places):
        out = out.copy()
        out[np.flatnonzero(out == _OPEN)[places >> 8]] = places & 255
    return out


def _places(batch, name: str) -> list[np.ndarray]:
    import pyarrow as pa

    column = batch.column(name).fill_null(pa.scalar([], batch.column(name).type))
    values, ends = column.flatten().to_numpy(), np.cumsum(column.value_lengths().to_numpy())
    return np.split(values, ends[:-1]) if len(ends) else []


def count_class_bigrams(codes: DataFrame, classes: np.ndarray, head: int, rare: DataFrame) -> np.ndarray:
    """Class bigrams of all training texts under the words' final classes."""
    end = int(classes[head])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            seqs = []
            for t in batch.column("ids").to_pylist():
                ids = np.frombuffer(t, np.int32)
                seqs.append(np.where(ids < 0, _OPEN, classes[ids]).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(seqs, pa.binary())], names=["row", "seq"])

    def joined(batch):
        one = np.array([end], np.uint8)
        return np.concatenate([one, *(x for t, at in zip(batch.column("seq").to_pylist(), _places(batch, "places"), strict=True) for x in (_filled(t, at), one))])

    seqs = codes.select("row", "ids").mapInArrow(run, "row long, seq binary")
    shape_class = [classes[-1 - s] for s in range(_SHAPES)]
    places = _open_words(codes, "row", "rest", rare, shape_class, "_").groupBy("row").agg(_placed("_").alias("places"))
    return _matrix(seqs.join(places, "row", "left").select("seq", "places"), end + 1, joined)


def _xlogx(a: np.ndarray) -> np.ndarray:
    return a * np.log(np.maximum(a, 1e-300))


def exchange(bigrams: np.ndarray, fixed: int, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Classes of the units by exchange: each unit in turn moves to the class that gains most.

    The unit ``fixed`` stays alone in the last class. Maximises the likelihood of the class bigrams,
    sum N(c, d) log N(c, d) - sum N(c.) log N(c.) - sum N(.c) log N(.c).
    """
    size = len(bigrams)
    k = max(1, min(classes - 1, size - 1))
    order = [u for u in np.argsort(-bigrams.sum(axis=0), kind="stable") if u != fixed]
    of = np.empty(size, np.int64)
    of[fixed] = k
    of[order] = np.arange(len(order)) % k
    joint = np.zeros((k + 1, k + 1))
    np.add.at(joint, (of[:, None].repeat(size, 1), of[None, :].repeat(size, 0)), bigrams)
    for _ in range(sweeps):
        moved = 0
        for u in order:
            old = of[u]
            after = np.bincount(of, bigrams[u], k + 1)
            before = np.bincount(of, bigrams[:, u], k + 1)
            loop = bigrams[u, u]
            if not after.any() and not before.any():
                continue
            # Take the unit out of its class; its own loop counts in both rows and columns.
            after[old] -= loop
            before[old] -= loop
            joint[old, :] -= after
            joint[:, old] -= before
            joint[old, old] -= loop
            # Gain of each class c: row c gets ``after``, column c gets ``before``, (c, c) all three.
            rows = _xlogx(joint + after).sum(axis=1) - _xlogx(joint).sum(axis=1)
            cols = _xlogx(joint + before[:, None]).sum(axis=0) - _xlogx(joint).sum(axis=0)
            d = np.diag(joint)
            corner = _xlogx(d + after + before + loop) + _xlogx(d) - _xlogx(d + after) - _xlogx(d + before)
            left, right = joint.sum(axis=1), joint.sum(axis=0)
            # Marginals as they will be: every class but c loses nothing, so only c's own terms count,
            # and the other classes' columns gain from row c alike for every c.
            n_left, n_right = after.sum() + loop, before.sum() + loop
            shift_l, shift_r = left + before, right + after
            margin = _xlogx(shift_l + n_left) - _xlogx(shift_l) + _xlogx(shift_r + n_right) - _xlogx(shift_r)
            gain = (rows + cols + corner - margin)[:k]
            new = int(gain.argmax()) if gain.max() > gain[old] + 1e-9 else old
            of[u] = new
            joint[new, :] += after
            joint[:, new] += before
            joint[new, new] += loop
            moved += new != old
        if not moved:
            break
    return of


@dataclass
class ClassModel:
    """Log10 tables: ``step`` of (class, class), ``emit`` of a unit in its class.

    Units are the words clustered on the driver, the other known words of each class together, the unknown word of each shape, and
    the end. ``others``: occurrences of a class's other words; ``head_class``: of every head word.
    """

    words: list[bytes]
    unit_class: np.ndarray
    step: np.ndarray
    emit: np.ndarray
    others: np.ndarray
    head_class: np.ndarray
    tokens: int
    types: int
    ends: int

    @property
    def shape_class(self) -> np.ndarray:
        return self.unit_class[-1 - _SHAPES : -1]

    def of_others(self) -> np.ndarray:
        """By class: what is added to log10 of the count of a word that is no unit."""
        n = len(self.words)
        return self.emit[n : n + len(self.others)] - np.log10(np.maximum(self.others, 1))


def build(head: list[tuple[bytes, int]], units: int, classes: np.ndarray, joint: np.ndarray, rare: dict[int, tuple[int, int]], ends: int) -> ClassModel:
    """``classes``: of the head, the end, the shapes from last to first; ``rare``: (tokens, types) of the words outside the head, by class."""
    k, h = len(joint), len(head)
    n, followers = joint.sum(axis=1), np.maximum((joint > 0).sum(axis=1), 1)
    plain = (joint.sum(axis=0) + 1) / (joint.sum() + k)
    step = np.log10((joint + followers[:, None] * plain) / (n + followers)[:, None])
    c = np.array([x for _, x in head], float)
    others = np.bincount(classes[units:h], c[units:], k) + [rare.get(i, (0, 0))[0] for i in range(k)]
    unit_class = np.concatenate([classes[:units], np.arange(k), classes[: -1 - _SHAPES : -1], classes[h : h + 1]])
    seen = np.concatenate([c[:units] + 0.5, others, np.full(_SHAPES, 0.5), [ends + 0.5]])
    # A class without words, not even unknown ones, is never entered: its transitions' share goes to its empty unit.
    empty = np.bincount(unit_class, seen, k) == 0
    seen[units : units + k][empty] = 0.5
    emit = np.log10(np.maximum(seen, 1e-300) / np.bincount(unit_class, seen, k)[unit_class])
    tokens, types = int(c.sum()) + sum(t for t, _ in rare.values()) + ends, h + sum(v for _, v in rare.values()) + (ends > 0)
    return ClassModel([w for w, _ in head[:units]], unit_class, step, emit, others, classes[:h], tokens, types, ends)


def fit(texts: DataFrame) -> tuple[ClassModel, list[tuple[bytes, int]], DataFrame]:
    """The model, the head of the word table, and (word, c, class) of all other words, from the column ``text``.

    The last is read from the shared folder by whatever is scored with it, so its files stay.
    """
    with Scratch(texts.sparkSession) as scratch:
        counts = scratch.write(count_words(texts), "words")
        head = head_of(counts)
        scratch.drop(counts)
        ends = texts.count()
        words = [w for w, _ in head]
        units, h = min(UNITS, len(head)), len(head)
        codes = coded(texts, words, scratch)
        # Places in a table of the head, the end, and the shapes from last to first, which negative ids reach.
        shape_unit = np.arange(units, units + _SHAPES)
        table = np.concatenate([np.arange(units), units + np.array([shape_of(w) for w in words[units:]], np.int64), [units + _SHAPES], shape_unit[::-1]]).astype(np.int64)
        size = units + _SHAPES + 1
        bigrams = _matrix(codes.select("ids"), size, lambda batch: table[_joined(batch, h)])
        classes = exchange(bigrams, size - 1)[table]
        for _ in range(ROUNDS if h > units else 0):
            classes = _head_round(codes.select("ids"), classes, h, units)
        rare = _rare_words(codes, classes, h)
        joint = count_class_bigrams(codes, classes, h, rare)
    by_class = {r["class"]: (r["t"], r["v"]) for r in rare.groupBy("class").agg(F.sum("c").alias("t"), F.count("*").alias("v")).collect()}
    return build(head, units, classes, joint, by_class, ends), head, rare


def score(docs: DataFrame, model: ClassModel, head: list[tuple[bytes, int]], rare: DataFrame, text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """The kept columns with n_tokens, n_known, train_tokens, base_score and score of every whole text."""
    added = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    from pyspark.sql import types as T

    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(([w for w, _ in head], np.array([c for _, c in head], np.int64), model.__dict__))
    base_log = math.log10(model.tokens + model.types + 1)
    p = free_prefix(docs.columns)
    mark, row = f"{p}text", f"{p}row"
    names = n_, known_, base_, part_, seq_, rest_ = [p + n for n in ("n", "known", "base", "part", "seq", "rest")]
    kept = [c for c in keep if c.lower() not in added]
    # Functions over Arrow batches look columns up by name, so these are plain on the way.
    own = [f"{p}{i}" for i in range(len(kept))]
    df = docs.select(*(c.alias(n) for c, n in zip(columns(docs, kept), own, strict=True)), F.col(backticks(text)).cast("binary").alias(mark))

    def run(batches):
        import pyarrow as pa

        words, c, plain = shared.value
        m = ClassModel(**plain)
        index = {w: i for i, w in enumerate(words)}
        n_units = len(m.words)
        # For each head word, and last for one outside it: its class, its part of the base score, and of the model's in its class.
        cls = np.append(m.head_class, _OPEN).astype(np.uint8)
        base = np.append(np.log10(c + 1.0) - base_log, 0.0)
        part = np.append(m.emit[:n_units], np.append(np.log10(c[n_units:]) + m.of_others()[m.head_class[n_units:]], 0.0))
        end_base, end_part = math.log10(m.ends + 1) - base_log, m.emit[-1]
        get = index.get

        def one(data):
            tokens = words_of(data)
            total_base, total, known, rest, seq = end_base, end_part, int(m.ends > 0), [], []
            for i in range(0, len(tokens), 200_000):
                some = tokens[i : i + 200_000]
                ids = np.array([get(w, -1) for w in some], np.int64)
                unseen = np.flatnonzero(ids < 0)
                rest += [some[j] for j in unseen]
                total += part[ids].sum()
                total_base += base[ids].sum()
                known += len(some) - len(unseen)
                seq.append(cls[ids].tobytes())
            return len(tokens) + 1, known, total_base, total, b"".join(seq), rest

        for batch in batches:
            found = [one(t) for t in batch.column(mark).to_pylist()]
            cols = list(zip(*found, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.binary()))
            new = [pa.array(x, t) for x, t in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in own), *new], names=[*own, *names])

    kinds = (T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType(), T.BinaryType(), T.ArrayType(T.BinaryType()))
    schema = T.StructType([*(df.schema[x] for x in own), *(T.StructField(n, t) for n, t in zip(names, kinds, strict=True))])
    # Written once: the row numbers must be the same in both uses.
    parts = written(df.mapInArrow(run, schema).withColumn(row, F.monotonically_increasing_id()), "scores")
    rest = _open_words(parts, row, rest_, rare, model.shape_class, p)
    c, cls = F.col(f"{p}c"), F.col(f"{p}class")
    listed = lambda values: F.array(*[F.lit(float(x)) for x in values])
    emitted = F.when(c.isNotNull(), F.log10(c) + F.get(listed(model.of_others()), cls)).otherwise(F.get(listed(model.emit[-1 - _SHAPES : -1]), F.col(f"{p}shape")))
    sums = rest.groupBy(row).agg(
        F.count(c).alias(f"{p}k"), F.sum(F.log10(F.coalesce(c, F.lit(0)) + 1)).alias(f"{p}s"), F.count("*").alias(f"{p}m"), F.sum(emitted).alias(f"{p}e"), _placed(p).alias(f"{p}places")
    )
    step, end = model.step, int(model.unit_class[-1])

    def walk(batches):
        import pyarrow as pa

        for batch in batches:
            steps = []
            for t, at in zip(batch.column(seq_).to_pylist(), _places(batch, f"{p}places"), strict=True):
                seq = _filled(t, at)
                steps.append(step[np.append(end, seq), np.append(seq, end)].sum())
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in left), pa.array(steps, pa.float64())], names=[*left, f"{p}steps"])

    left = [*own, n_, known_, base_, part_, f"{p}k", f"{p}s", f"{p}m", f"{p}e"]
    both = parts.select(row, seq_, *left[:-4]).join(sums, row, "left").select(*left, seq_, f"{p}places")
    walked = both.mapInArrow(walk, T.StructType([*(both.schema[x] for x in left), T.StructField(f"{p}steps", T.DoubleType())]))
    zero = lambda x: F.coalesce(F.col(p + x), F.lit(0))
    return walked.select(
        *(F.col(n).alias(c) for c, n in zip(kept, own, strict=True)),
        F.col(n_).alias("n_tokens"),
        (F.col(known_) + zero("k")).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col(base_) + zero("s") - zero("m") * base_log).alias("base_score"),
        (F.col(part_) + zero("e") + F.col(f"{p}steps")).alias("score"),
    )
