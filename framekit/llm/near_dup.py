"""Near-duplicate texts by weighted MinHash, banded joining and exact verification.

A text is the weighted set of its runs of five words (letters and digits, lower-cased), the weight
being how often a run occurs; texts are linked if their weighted Jaccard similarity, sum of minima
over sum of maxima, is at least 0.8. A class is a connected component of links.

1. Equal texts are one from the start: everything below is per distinct text, keyed by a 64-bit hash. A task signs each text once.
2. Every distinct text gets a DartMinHash signature and 96 bands of 8 coordinates. Texts that agree in all of a band's meet in
   a bucket; buckets with the same members count once (a count and sums tell, so no list is built).
3. First, likely links: the texts of a bucket (or of a block of it, if it is large) that the signatures hold for linked are
   joined by a forest, fewer pairs than members and few for each text. Their texts are fetched and compared exactly, and the links joined to components.
4. Then all the rest: every pair of a bucket that lies in different components and whose signatures' agreement is within 4
   standard deviations of 0.8, once in the first band that it shares, is compared exactly too. A large bucket is cut into blocks that meet
   pairwise in different tasks, signatures only, and the pairs found leave the task, their texts to be fetched. Where they are many more than the
   texts, the two blocks meet again with their texts instead: pairs are compared in place, and one link for each pair of components leaves the task.
5. Links are joined to classes by rounds of contraction, each written to the shared folder.

A pair at similarity 0.8 is missed with a probability of about 2 in 10,000, at 0.82 of 3 in 100,000, at 0.85 of 1 in a million
(simulated with these bands and independent coordinates).

Defined results: null texts have no links and no copies: each row is its own class. Texts without a letter or digit are
linked only to equal ones. Texts of one to four words have a single run, the whole text; texts of any length are compared as a whole.
Ids may be of any type with an order. An empty table has no classes. Columns of the input are kept whatever their names, but for ``class_id``. The class id is the smallest document
id in it; null ids count only where a class has no other, and then its id is null. Of each class one text stays, the one with the
smallest id and, where texts share it, the smallest hash; of its rows, one. Rows with equal ids and texts fall together like other copies.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framekit.llm.common import Scratch, columns, sized, small, written
from framekit.llm.dart_minhash import COORDINATES, mix, signature
from framekit.names import backticks, free_prefix

WORDS, SIMILARITY = 5, 0.8
BANDS, BAND_SIZE = 96, 8
#: Least agreement of the signatures of a candidate, and of a likely link.
_DEVIATION = (SIMILARITY * (1 - SIMILARITY) / COORDINATES) ** 0.5
CANDIDATE, LIKELY = SIMILARITY - 4 * _DEVIATION, SIMILARITY - 0.5 * _DEVIATION
#: Members of a block of a large bucket and runs of words in it, on average.
BLOCK, BLOCK_RUNS = 1024, 1 << 20
#: Likely links of one text in a block at most; pairs for each text of two blocks, from which on their texts meet instead.
DEGREE, MANY = 64, 1
#: Hashes of words, and keys of texts, that a task keeps.
_CACHE, _SEEN = 100_000, 200_000
_NOT_WORD = re.compile(r"[\W_]+")
_U = np.uint64


class WordHashes(dict):
    """64-bit hashes of words, kept for reuse up to a bound."""

    def __missing__(self, word: str | bytes) -> int:
        import xxhash

        if len(self) > _CACHE:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word if isinstance(word, bytes) else word.encode("utf8", "surrogatepass"))
        return out


_POWERS = mix(np.arange(1, WORDS + 1, dtype=_U)) | _U(1)


_ASCII = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> list:
    """Lower-cased runs of letters and digits, as bytes where the text is ASCII."""
    return text.encode().translate(_ASCII).split() if text.isascii() else _NOT_WORD.sub(" ", text.lower()).split()


def shingles(text: str | None, known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed runs of words, ascending, and how often each occurs."""
    words = words_of(text) if text else []
    if not words:
        return np.empty(0, _U), np.empty(0, np.int64)
    h = np.fromiter(map(known.__getitem__, words), _U, len(words))
    size = min(WORDS, len(words))
    runs = np.zeros(len(words) - size + 1, _U)
    for j in range(size):
        runs += h[j : len(h) - size + 1 + j] * _POWERS[j]
    return np.unique(mix(runs), return_counts=True)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    total = int(a[1].sum() + b[1].sum())
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = int(np.minimum(a[1][i], b[1][j]).sum())
    return common / (total - common) if total else 0.0


#: Coordinates of each band: eight of all, drawn by a fixed generator.
_BAND_AT = np.stack([np.random.default_rng(1000 + b).choice(COORDINATES, BAND_SIZE, replace=False) for b in range(BANDS)])
_BAND_BY = mix(np.arange(1, BANDS * BAND_SIZE + 1, dtype=_U)).reshape(BANDS, BAND_SIZE) | _U(1)


def band_hashes(signatures: np.ndarray) -> np.ndarray:
    """n x BANDS hashes, under 2^63, of n x COORDINATES signatures; modulo BANDS they are the band's number."""
    number = np.arange(BANDS, dtype=_U)
    return mix((signatures.astype(_U)[:, _BAND_AT] * _BAND_BY).sum(axis=2, dtype=_U) + number) // _U(4 * BANDS) * _U(BANDS) + number


def key_of(text: str) -> Column:
    return F.xxhash64(F.col(backticks(text)))


def _distinct(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """key, first (the smallest id), n rows, weight and signature of every distinct text; the last is null for one without words."""

    def run(batches):
        import pyarrow as pa

        known, seen = WordHashes(), set()
        for batch in batches:
            weights, signs = [], []
            for k, t in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if k in seen:
                    # Signed before; the row only counts.
                    weights.append(None)
                    signs.append(None)
                    continue
                if len(seen) > _SEEN:
                    seen.clear()
                seen.add(k)
                elements, counts = shingles(t, known)
                weights.append(int(counts.sum()))
                signs.append(signature(elements, counts.astype(np.float64)).tobytes() if len(elements) else None)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("doc_id"), pa.array(weights, pa.int64()), pa.array(signs, pa.binary())], names=["key", "doc_id", "weight", "signature"])

    own = F.col(backticks(text))
    rows = docs.where(own.isNotNull()).select(F.col(backticks(doc_id)).alias("doc_id"), key_of(text).alias("key"), own.alias("text"))
    kinds = T.StructType([T.StructField("key", T.LongType()), rows.schema["doc_id"], T.StructField("weight", T.LongType()), T.StructField("signature", T.BinaryType())])
    # The largest: null where a row was not signed.
    grouped = rows.mapInArrow(run, kinds).groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"), F.max(F.struct("weight", "signature")).alias("s"))
    return grouped.select("key", "first", "n", F.col("s.weight").alias("weight"), F.col("s.signature").alias("signature"))


def _bands(signed: DataFrame) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                s = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint16).reshape(-1, COORDINATES)
                h = band_hashes(s).astype(np.int64).ravel()
                key, weight = (pa.array(np.repeat(batch.column(c).to_numpy(), BANDS)) for c in ("key", "weight"))
                yield pa.RecordBatch.from_arrays([pa.array(h), key, weight], names=["bucket", "key", "weight"])

    return signed.select("key", "weight", "signature").mapInArrow(run, "bucket long, key long, weight long")


def _of_several(banded: DataFrame) -> DataFrame:
    """The rows whose buckets have others. All bands are made and shuffled once: what meets is told from its neighbours in the order of buckets."""

    def run(batches):
        import pyarrow as pa

        # The last row so far, and whether its bucket had another before it.
        last, met = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch] if last is None else [last, batch])
            same = np.diff(rows.column("bucket").to_numpy()) == 0
            several = np.append(same, False) | np.insert(same, 0, met)
            last, met = pa.RecordBatch.from_pylist(rows.slice(len(rows) - 1).to_pylist(), schema=batch.schema), bool(several[-1])
            yield from rows.slice(0, len(rows) - 1).filter(pa.array(several[:-1])).to_batches()
        if met:
            yield last

    return banded.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, banded.schema)


def _members(signed: DataFrame, scratch: Scratch) -> DataFrame:
    """(bucket, blocks, key) of the buckets of two texts and more, each set of members once: in the first band that gathers it."""
    met = scratch.write(_of_several(_bands(signed)), "met")
    mixed = F.xxhash64("key")
    sets = met.groupBy("bucket").agg(
        F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"), F.bit_xor(mixed).alias("x"), F.bit_xor(F.xxhash64(mixed)).alias("y"), F.sum("weight").alias("w")
    )
    first = F.struct(F.pmod("bucket", F.lit(BANDS)).alias("band"), "bucket")
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("w") / BLOCK_RUNS)).cast("int")
    once = sets.groupBy("n", "low", "high", "x", "y", "w").agg(F.min(first).alias("b")).select("b.bucket", blocks.alias("blocks"))
    return scratch.write(met.join(small(once, scratch), "bucket").select("bucket", "blocks", "key"), "members")


def _agreeing(i: int, other: np.ndarray, weights: np.ndarray, s: np.ndarray, least: float) -> np.ndarray:
    near = other[np.minimum(weights[other], weights[i]) >= SIMILARITY * np.maximum(weights[other], weights[i])]
    return near[(s[near] == s[i]).mean(axis=1) >= least]


def _forest(keys: np.ndarray, weights: np.ndarray, s: np.ndarray) -> list[tuple[int, int]]:
    """Pairs that are likely links and connect what likely links connect, but for ``DEGREE``; the same ones first in every bucket."""
    out, free = [], np.ones(len(keys), bool)
    for first in np.argsort(keys):
        waiting = [first] if free[first] else []
        free[first] = False
        for i in waiting:
            mine = _agreeing(i, np.flatnonzero(free), weights, s, LIKELY)[:DEGREE]
            out += [(i, j) for j in mine]
            free[mine] = False
            waiting += list(mine)
    return out


def _across(mine: np.ndarray, g: int, h: int, band: int, keys: np.ndarray, weights: np.ndarray, s: np.ndarray, roots: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """A text and others in different components that may be links of it and meet it in this band first, every pair once."""
    left, right = np.flatnonzero(mine == g), np.flatnonzero(mine == h)
    for i in left:
        other = right[roots[right] != roots[i]]
        found = _agreeing(i, other[keys[other] > keys[i]] if g == h else other, weights, s, CANDIDATE)
        if len(found):
            shared = (s[found] == s[i])[:, _BAND_AT].all(axis=2)
            found = found[shared.argmax(axis=1) == band]
        if len(found):
            yield i, found


def _links_between(pairs: Iterator[tuple[int, np.ndarray]], roots: np.ndarray, texts: Sequence[str]) -> list[tuple[int, int]]:
    """Of the pairs that are links, one for each two components that they join."""
    known, sets, parent = WordHashes(), {}, {}

    def find(r: int) -> int:
        while (up := parent.get(r, r)) != r:
            parent[r] = r = parent.get(up, up)
        return r

    def of(i: int):
        if i not in sets:
            sets[i] = shingles(texts[i], known)
        return sets[i]

    out = []
    for i, found in pairs:
        for j in found:
            a, b = find(int(roots[i])), find(int(roots[j]))
            if a != b and weighted_jaccard(of(i), of(j)) >= SIMILARITY:
                parent[a] = b
                out.append((i, j))
    return out


def _open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(bucket, blocks, key, root) of the buckets whose texts are of several components."""
    rooted = members.join(sized(roots), "key", "left").withColumn("root", F.coalesce("root", "key"))
    several = rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("bucket")
    return rooted.join(several, "bucket", "left_semi").select("bucket", "blocks", "key", "root")


def _met(rooted: DataFrame, signed: DataFrame, every_two: bool, more: Sequence[str] = ()) -> DataFrame:
    """The members with their signatures (and ``more`` columns), in (bucket, g, h): each in its own block's, or in every two blocks' of its bucket.

    A text is looked up once, with the list of its buckets, of which there are ``BANDS`` at most.
    """
    mine = F.pmod(F.xxhash64("key", "bucket"), F.col("blocks")).cast("int")
    if every_two:
        at = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(mine, o).alias("g"), F.greatest(mine, o).alias("h")))
    else:
        at = F.array(F.struct(mine.alias("g"), mine.alias("h")))
    data = ["key", "weight", "signature", "root", *more]
    listed = rooted.groupBy("key").agg(F.min("root").alias("root"), F.collect_list(F.struct("bucket", "blocks")).alias("buckets"))
    each = listed.join(signed.select("key", "weight", "signature", *more), "key").select(F.inline("buckets"), *data)
    return each.select("bucket", mine.alias("mine"), F.explode(at).alias("at"), *data).select("bucket", "at.g", "at.h", "mine", *data)


_PAIRS = "a long, b long, bucket long, g int, h int"


def _compared(met: DataFrame, what: str) -> DataFrame:
    """Pairs (a, b), a < b, of the texts that meet.

    ``what``: "forest", likely links; "pairs", all that may be links, or none but (bucket, g, h) where they are too many;
    "links", links, which needs the column ``text``.
    """

    def run(batches):
        import pyarrow as pa

        def compare(rows):
            where, mine, keys, weights, s, roots, *text = zip(*rows, strict=True)
            keys, weights, roots = np.array(keys, np.int64), np.array(weights, np.float64), np.array(roots, np.int64)
            s = np.frombuffer(b"".join(s), np.uint16).reshape(-1, COORDINATES)
            bucket, g, h = where[0]
            if what == "forest":
                pairs = _forest(keys, weights, s)
            else:
                found = _across(np.array(mine), g, h, bucket % BANDS, keys, weights, s, roots)
                if what == "links":
                    pairs = _links_between(found, roots, text[0])
                else:
                    pairs = []
                    for i, others in found:
                        pairs += [(i, j) for j in others]
                        if len(pairs) > MANY * len(keys):
                            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((None, None, bucket, g, h), kinds, strict=True)], names=names)
            ends = keys[np.array(pairs, np.int64).reshape(-1, 2)]
            none = [pa.nulls(len(ends), t) for t in kinds[2:]]
            return pa.RecordBatch.from_arrays([pa.array(ends.min(axis=1)), pa.array(ends.max(axis=1)), *none], names=names)

        kinds, names = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()), ["a", "b", "bucket", "g", "h"]
        held: list = []
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for b, g, h, *rest in zip(*cols, strict=True):
                if held and held[0][0] != (b, g, h):
                    yield compare(held)
                    held = []
                held.append(((b, g, h), *rest))
        if held:
            yield compare(held)

    return met.repartition("bucket", "g", "h").sortWithinPartitions("bucket", "g", "h").mapInArrow(run, _PAIRS)


def _texts(docs: DataFrame, text: str, keys: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, text) of the distinct keys of a table with the column ``key``."""
    found = docs.select(key_of(text).alias("key"), F.col(backticks(text)).alias("text")).join(small(keys.select("key").distinct(), scratch), "key", "left_semi")
    # Written, so that a join with a key that has many pairs can be split at run time.
    return scratch.write(found.groupBy("key").agg(F.min("text").alias("text")), "texts")


def _verified(pairs: DataFrame, docs: DataFrame, text: str, scratch: Scratch) -> DataFrame:
    """The pairs whose texts are similar enough."""
    texts = _texts(docs, text, pairs.select(F.explode(F.array("a", "b")).alias("key")), scratch)
    both = sized(pairs).join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches):
        import pyarrow as pa

        known = WordHashes()
        for batch in batches:
            sims = [weighted_jaccard(shingles(x, known), shingles(y, known)) for x, y in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True)]
            found = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"])
            yield found.filter(pa.array([s >= SIMILARITY for s in sims], pa.bool_()))

    out = scratch.write(both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long"), "verified")
    scratch.drop(texts)
    return out


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, root): one key of each key's connected component as its root, for all keys in links (a, b).

    In each round every key takes its smallest neighbour as label, and that one's label in turn; links
    then join labels, those within a label vanish, and the next round works on what is left, far less each time.
    """
    links = scratch.write(links.select("a", "b").distinct(), "links")
    roots = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = scratch.write(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")), "lowest")
        via = sized(lowest).select(F.col("a").alias("low"), F.col("low").alias("lower"))
        step = scratch.write(lowest.join(via, "low").select(F.col("a").alias("key"), F.col("lower").alias("root")), "step")
        near = sized(step)
        named = lambda c: near.select(F.col("key").alias(c), F.col("root").alias(f"root_{c}"))
        x, y = F.col("root_a"), F.col("root_b")
        left = links.join(named("a"), "a").join(named("b"), "b").where(x != y).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()
        following = scratch.write(left, "links")
        if roots is None:
            roots = step
        else:
            on = near.select(F.col("key").alias("root"), F.col("root").alias("next"))
            done, roots = roots, scratch.write(roots.join(on, "root", "left").select("key", F.coalesce("next", "root").alias("root")), "roots")
            scratch.drop(done)
            scratch.drop(step)
        scratch.drop(lowest)
        scratch.drop(links)
        links = following
        if links.isEmpty():
            return roots


def classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """key, first (smallest id with the text), n (rows with it), class_id and stays (true for one text of each class) of each distinct text.

    Written to the shared folder, where whatever is made of it reads it.
    """
    with Scratch(docs.sparkSession) as scratch:
        every = scratch.write(_distinct(docs, text, doc_id), "signatures")
        signed = every.where(F.col("signature").isNotNull())
        members = _members(signed, scratch)
        likely = scratch.write(_compared(_met(members.withColumn("root", F.col("key")), signed, False), "forest").select("a", "b").distinct(), "likely")
        links = _verified(likely, docs, text, scratch)
        roots = components(links, scratch)
        rooted = scratch.write(_open(members, roots), "open")
        found = scratch.write(_compared(_met(rooted, signed, True), "pairs"), "pairs")
        pairs = scratch.write(found.where(F.col("a").isNotNull()).select("a", "b").distinct().join(likely, ["a", "b"], "left_anti"), "candidates")
        links = links.unionByName(_verified(pairs, docs, text, scratch))
        many = found.where(F.col("a").isNull()).select("bucket", "g", "h")
        if not many.isEmpty():
            again = scratch.write(rooted.join(small(many.select("bucket").distinct(), scratch), "bucket", "left_semi"), "again")
            full = _met(again, signed.join(_texts(docs, text, again, scratch), "key"), True, ["text"]).join(small(many, scratch), ["bucket", "g", "h"], "left_semi")
            links = links.unionByName(scratch.write(_compared(full, "links").select("a", "b"), "between"))
        linked = scratch.write(signed.select("key", "first").join(sized(components(links, scratch)), "key"), "linked")
        best = F.min(F.struct(F.col("first").isNull().alias("none"), "first", "key"))
        lowest = linked.groupBy("root").agg(best.alias("best")).select("root", F.col("best.first").alias("class_id"), F.col("best.key").alias("survivor"))
        named = linked.join(small(lowest, scratch), "root").select("key", "class_id", (F.col("key") == F.col("survivor")).alias("stays"))
        of = every.select("key", "first", "n").join(small(named, scratch), "key", "left")
        alone = F.col("stays").isNull()
        return written(of.select("key", "first", "n", F.when(alone, F.col("first")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("stays", F.lit(True)).alias("stays")), "classes")


def with_classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] | None = None) -> DataFrame:
    """The kept columns (all by default) with the class_id of every row."""
    p = free_prefix([*docs.columns, "class_id"])
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() != "class_id"]
    # All others are their own classes. A null text's key is null, and meets no class.
    more = classes(docs, text, doc_id).where((F.col("n") > 1) | ~F.col("class_id").eqNullSafe(F.col("first")))
    of = small(more.select(F.col("key").alias(f"{p}key"), "class_id"))
    rows = docs.select(*columns(docs, kept), F.col(backticks(doc_id)).alias(f"{p}id"), _own_key(text).alias(f"{p}key"))
    return rows.join(of, f"{p}key", "left").select(*columns(docs, kept), F.coalesce("class_id", F.col(f"{p}id")).alias("class_id"))


def _own_key(text: str) -> Column:
    return F.when(F.col(backticks(text)).isNotNull(), key_of(text))


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of each class, the one with the smallest id; all rows without a text stay.

    Only what is decided about texts of classes and texts with copies is looked up. Rows that agree in id and
    text as well are told apart by their partition and place, and one of them stays.
    """
    p = free_prefix(docs.columns)
    key, first, n, stays = f"{p}key", f"{p}first", f"{p}n", f"{p}stays"
    of = classes(docs, text, doc_id).where(~F.col("stays") | (F.col("n") > 1))
    decided = small(of.select(F.col("key").alias(key), F.col("first").alias(first), F.col("n").alias(n), F.col("stays").alias(stays)))
    own = F.col(backticks(doc_id))
    marked = docs.withColumn(key, _own_key(text)).join(decided, key, "left")
    # A text goes if it isn't the one of its class that stays; if it has copies, only its first row stays.
    kept = marked.where(F.col(stays).isNull() | (F.col(stays) & own.eqNullSafe(F.col(first))))
    again = Window.partitionBy(key, own).orderBy(F.monotonically_increasing_id())
    single = kept.where(F.coalesce(F.col(n), F.lit(1)) == 1)
    firsts = kept.where(F.col(n) > 1).withColumn(n, F.row_number().over(again)).where(F.col(n) == 1)
    return single.select(*columns(docs)).unionByName(firsts.select(*columns(docs)))
