"""Benchmark decontamination by spaced-seed hashing, in built-in functions only.

Two fixed masks look at six of the tokens under them and ignore the rest. Hashes of the masked tokens at
every place of every training text meet those of the benchmark in a join; around each hit the texts are
aligned and compared token by token. An overlap is a run of ``WINDOW`` aligned tokens of which
at most ``SUBSTITUTIONS`` differ (all of a shorter item: of 12 tokens 2, of 11 one may differ, of fewer none). For each way to place two
substitutions in thirteen tokens one of the masks has a place that avoids them, so no such overlap is missed. In twelve tokens
eight ways are left over; a third mask over the whole item avoids these. Items of fewer than ``SHORTEST`` tokens must occur as they
are: a mask looks at all their tokens. These masks are used only for lengths that the benchmark has.

A bitmap of the benchmark's hashes, 64 bits for each up to ``MAX_WORDS`` longs (16 MB), lets
a text's places be tested where they are hashed: only hits leave the text, each with the hashes of
the few tokens around it. If the bitmap of a benchmark of tens of millions of tokens fills up, more places go to the join; the result is
the same. Places of the benchmark that agree in all the tokens around them, as passages that many items share do, are one
in that join, and only the pairs to return are spread over the items. The benchmark's side is broadcast up to ``BROADCAST_PLACES``
rows of fixed width, else shuffled.

Tokens are runs of letters and digits, lower-cased; texts of any length are read from end to end. Defined results: null and empty
texts overlap nothing, nor do items without a token; nothing overlaps an empty benchmark. Equal texts get equal verdicts, and repeated
rows stay or go together. Null ids are ids like others. Columns of the documents are kept whatever their names; in ``overlaps``
the added columns replace kept ones of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framekit.llm.common import columns, small, written
from framekit.names import backticks, free_prefix

#: Places that the masks look at.
MASKS = ((0, 3, 5, 6, 8, 9), (0, 1, 3, 4, 7, 10))
WINDOW, SUBSTITUTIONS = 13, 2
SHORTEST = max(m[-1] for m in MASKS) + 1
#: By the length of an item: places of a mask over the whole of it, for what the others have no place for.
WHOLE = {**{n: tuple(range(n)) for n in range(1, SHORTEST)}, 12: (0, 2, 3, 6, 9, 11)}
BROADCAST_PLACES, MAX_WORDS = 100_000, 1 << 21
#: Tokens before a hit's first one and in all that are compared.
_BEFORE = WINDOW - 1
_SPAN = _BEFORE + SHORTEST + WINDOW - 1
#: The number of a whole item's mask is this and its length.
_FIRST_WHOLE = 100


def token_hashes(text: Column) -> Column:
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def _seeds(tokens: Column, mask: tuple[int, ...], number: int) -> Column:
    """The hash of the masked tokens at each place; an empty array for a shorter text."""
    places = F.size(tokens) - (mask[-1] + 1)
    at = F.when(places >= 0, F.sequence(F.lit(0), places)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.lit(number), *[F.get(tokens, i + o) for o in mask]))


def _around(tokens: Column, at: Column) -> Column:
    """The tokens around a place, null beyond the ends."""
    return F.transform(F.sequence(F.lit(-_BEFORE), F.lit(_SPAN - _BEFORE - 1)), lambda o: F.get(tokens, at + o))


def _hits(tokens: Column, masks: dict[int, tuple[int, ...]], keep) -> Column:
    """Structs of the kept seeds of the masks, by number: hash, tokens around. ``keep``: a test of the hash, or None for all."""
    # The masks' seeds follow each other; a seed's number in the list gives back its place.
    firsts, before = [], F.lit(0)
    for m in masks.values():
        firsts.append(before)
        before = before + F.greatest(F.size(tokens) - m[-1], F.lit(0))

    def hit(h: Column, k: Column) -> Column:
        place = k - firsts[0]
        for first in firsts[1:]:
            place = F.when(k >= first, k - first).otherwise(place)
        found = F.struct(h.alias("seed"), _around(tokens, place).alias("around"))
        return found if keep is None else F.when(keep(h), found)

    return F.array_compact(F.transform(F.concat(*[_seeds(tokens, m, n) for n, m in masks.items()]), hit))


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed a single time: bound to a lambda's variable, it is not copied into the places of use."""
    return F.flatten(F.transform(F.array(value), use))


def _bitmap(seeds: DataFrame, words: int) -> Column:
    """Longs in one scalar: the bit of each seed."""
    bit = F.pmod("seed", F.lit(64 * words))
    marked = seeds.groupBy(F.floor(bit / 64).cast("long").alias("id")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(seed, {64 * words}) % 64 as int))")).alias("bits"))
    every = seeds.sparkSession.range(words).join(marked, "id", "left").select("id", F.coalesce("bits", F.lit(0)).alias("bits"))
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "bits"))), lambda s: s["bits"]).alias("bits")).scalar()


def _places(benchmark: DataFrame, item_id: str, item_text: str) -> tuple[DataFrame, dict[int, tuple[int, ...]]]:
    """item_id, length, seed and item_around of every masked place of the items, and the masks that they need, by number."""
    items = benchmark.select(F.col(backticks(item_id)).alias("item_id"), token_hashes(F.col(backticks(item_text))).alias("tokens"))
    items = items.withColumn("length", F.size("tokens"))
    # Masks over whole items are looked for only in the lengths that the benchmark has.
    lengths = [r["length"] for r in items.where(F.col("length").isin(list(WHOLE))).select("length").distinct().orderBy("length").collect()]
    found = _hits(F.col("tokens"), dict(enumerate(MASKS)), None)
    for n in lengths:
        found = F.when(F.col("length") == n, F.concat(found, _hits(F.col("tokens"), {_FIRST_WHOLE + n: WHOLE[n]}, None))).otherwise(found)
    window = F.least(F.col("length"), F.lit(WINDOW)).alias("window")
    places = items.select("item_id", window, F.explode(found).alias("hit")).select("item_id", "window", F.col("hit.seed").alias("seed"), F.col("hit.around").alias("item_around"))
    return places, dict(enumerate(MASKS)) | {_FIRST_WHOLE + n: WHOLE[n] for n in lengths}


def _overlapping(docs: DataFrame, places: DataFrame, masks: dict[int, tuple[int, ...]], text: str, keep: tuple[str, ...]) -> DataFrame:
    """The kept columns, text_hash, place (of the benchmark, by hash) and matched of every place where a text overlaps the benchmark."""
    p = free_prefix([*docs.columns, "text_hash"])
    bitmap, hit, hashed, seed, around, window, place, matched = (f"{p}{x}" for x in ("bitmap", "hit", "text", "seed", "around", "window", "place", "matched"))
    n = places.count()
    words = min(MAX_WORDS, max(64, 1 << (max(n, 1)).bit_length()))

    def marked(h: Column) -> Column:
        bit = F.pmod(h, F.lit(64 * words))
        # Named once, so that the optimizer puts the scalar itself here instead of copying it into every row.
        return F.getbit(F.get(bitmap, F.shiftrightunsigned(bit, 6).cast("int")), (bit % 64).cast("int")) == 1

    own = columns(docs, keep)
    found = docs.withColumn(bitmap, _bitmap(places, words))
    found = found.select(*own, F.xxhash64(F.col(backticks(text))).alias(hashed), F.explode(_once(token_hashes(F.col(backticks(text))), lambda t: _hits(t, masks, marked))).alias(hit))
    found = found.select(*own, hashed, F.col(f"{hit}.seed").alias(seed), F.col(f"{hit}.around").alias(around))
    at = places.select(F.col("seed").alias(seed), F.col("item_around").alias(f"{p}item"), F.col("window").alias(window), F.col("place").alias(place))
    found = found.join(F.broadcast(at) if n <= BROADCAST_PLACES else at, seed)
    same = F.zip_with(around, f"{p}item", lambda a, b: F.coalesce((a == b).cast("int"), F.lit(0)))
    best = F.array_max(
        F.transform(F.sequence(F.lit(1), F.lit(_SPAN - WINDOW + 1)), lambda s: F.aggregate(F.slice(f"{p}same", s, WINDOW), F.lit(0), lambda a, b: a + b))
    )
    checked = found.select(*own, hashed, place, window, same.alias(f"{p}same")).select(*own, hashed, place, window, best.alias(matched))
    allowed = F.when(F.col(window) < SHORTEST, 0).otherwise(F.least(F.lit(SUBSTITUTIONS), F.floor(F.col(window) / 6))).cast("int")
    right = checked.where(F.col(matched) >= F.col(window) - allowed)
    return right.select(*own, F.col(hashed).alias("text_hash"), F.col(place).alias("place"), F.col(matched).alias("matched"))


def _distinct_places(found: DataFrame) -> DataFrame:
    """One row for each place that differs in its tokens, with a hash of them as ``place``; written, as it is read twice and joined."""
    named = found.withColumn("place", F.xxhash64("seed", "item_around", "window"))
    return written(named.groupBy("seed", "item_around", "window", "place").agg(F.lit(1).alias("one")).drop("one"), "places")


def overlaps(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each overlapping pair of a document (told apart by the kept columns and its text) and an item.

    Adds text_hash, item_id, matched (equal tokens in the best window) and hits (seeds in overlaps).
    """
    keep = tuple(c for c in keep if c.lower() not in ("text_hash", "item_id", "matched", "hits", "place"))
    found, masks = _places(benchmark, item_id, item_text)
    met = _overlapping(docs, _distinct_places(found), masks, text, keep)
    # Places in a text that overlap the same place of the benchmark are one here.
    own = columns(docs, keep)
    once = met.groupBy(*own, "text_hash", "place").agg(F.max("matched").alias("matched"), F.count("*").alias("hits"))
    named = found.select("item_id", F.xxhash64("seed", "item_around", "window").alias("place")).groupBy("item_id", "place").agg(F.count("*").alias("times"))
    spread = once.join(named, "place").groupBy(*own, "text_hash", "item_id")
    return spread.agg(F.max("matched").alias("matched"), F.sum(F.col("hits") * F.col("times")).alias("hits"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents that overlap no item. Copies of a text share its verdict, so the texts' hashes decide.

    The hashes are broadcast up to a checked number, so that documents are not shuffled.
    """
    found, masks = _places(benchmark, "item_id", "text")
    bad_hash = free_prefix(docs.columns) + "bad"
    bad = _overlapping(docs, _distinct_places(found), masks, text, ()).select(F.col("text_hash").alias(bad_hash)).distinct()
    return docs.join(small(bad), F.xxhash64(F.col(backticks(text))) == F.col(bad_hash), "left_anti")
