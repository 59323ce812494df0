"""Each operator against SQL or brute force, and on odd rows: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from oracle import DATA, compare
from pyspark.sql import functions as F

from framekit.llm import common, decontaminate, language_id, lm_score, mixing, pii, quality, queries, sharding, topk, url_rules

Q = queries.queries()
LONG = "word and more words " * 30_000
ODD = [
    (1, None, "en", "src0"), (2, "", None, None), (3, " \n\t", "en", ""), (4, LONG, "en", "src0"), (5, "Short text.", "de", "src1"), (5, "Short text.", "de", "src1"),
    (None, "No id here, 1.2.3.4", "fr", "src2"), (None, None, None, None), (6, "x" * 100_000, "en", "src0"), (7, "ÄÖ ß 日本語", "de", "src9"), (8, "12 34 ++ !!", "en", "src1"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """With columns named like results and temporary columns."""
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    names = ("shard", "position", "Score", "accepted", "spans", "_key", "__text", "row_number", "block", "class", "bad_hash", "text_hash", "a.b", "qu`ote", "class_id", "held out", "n_tokens", "key", "rule", "place")
    return df.withColumns({c: F.lit("old") for c in names}).withColumn("nested", F.struct(F.lit(1).alias("with blank"), F.lit(2).alias("with.dot")))


def kept_of(out, df, made):
    """The columns that a result keeps are those of the input but for new ones' names, with their values."""
    assert out.columns == [c for c in df.columns if c.lower() not in made] + list(made)
    old = [c for c in out.columns if c not in made and c not in ("doc_id", "text", "lang", "source", "nested")]
    assert all(set(r) == {"old"} for r in out.select(*common.columns(out, old)).collect())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    compare(spark, Q[name], queries.oracle_sql()[name], f"{DATA}/sf0.01")


# Sharding


def test_rendezvous_moves_few_and_follows_weights(spark):
    keys = spark.range(20_000)
    shards = [(s, float(1 + s % 2)) for s in range(8)]
    a = sharding.shard(keys, "id", shards)
    b = sharding.shard(keys, "id", [*shards, (8, 2.0)])
    both = a.join(b.withColumnRenamed("shard", "grown"), "id")
    assert both.where("shard <> grown and grown <> 8").count() == 0
    share = {r.shard: r["count"] / 20_000 for r in a.groupBy("shard").count().collect()}
    assert all(abs(share[s] - w / 12) < 0.01 for s, w in shards)
    assert abs(both.where("grown = 8").count() / 20_000 - 2 / 14) < 0.01
    for bad in ([], [(0, 0.0)], [(0, 1.0), (0, 1.0)]):
        with pytest.raises(ValueError):
            sharding.shard(keys, "id", bad)


def test_sharding_odd(odd):
    got = sharding.with_slots(sharding.shard(odd, "doc_id", [(0, 1.0), (1, 1.0)]), ["doc_id", "text"])
    out = got.collect()
    assert len(out) == len(ODD) and sorted(got.columns) == sorted([*odd.columns, "slot"])
    kept_of(got.select(*common.columns(got, [c for c in got.columns if c not in ("shard", "slot")])), odd.drop("shard"), ())
    for s in (0, 1):
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots)))
    assert sharding.with_slots(sharding.shard(odd.limit(0), "doc_id", [(0, 1.0)]), ["doc_id"]).count() == 0


# Mixing


def test_pfair_deviation():
    rng = random.Random(1)
    for _ in range(100):
        w, b = zip(*((rng.randint(1, 9), rng.randint(0, 40)) for _ in range(rng.randint(1, 6))), strict=True)
        plan = mixing.phases(w, b)
        for i, p in enumerate(plan):
            nxt = plan[i + 1] if i + 1 < len(plan) else None
            end = nxt.first if nxt else sum(b)
            taken = {p.slot(s, k): s for s in p.start for k in range(p.start[s], nxt.start.get(s, b[s]) if nxt else b[s])}
            assert sorted(taken) == list(range(p.first, end))
            total, run = sum(w[s] for s in p.start), Counter()
            for t in range(p.first, end):
                run[taken[t]] += 1
                assert all(abs(run[s] - w[s] * (t + 1 - p.first) / total) < 1 for s in p.start)


def brute_mix(rows, weights, block_rows):
    """Slot by slot, in fractions: of the sources with a released block, the one whose block must run first."""
    left = {s: list(r) for s, r in rows.items() if r}
    order = []
    while left:
        total, ran, t = sum(Fraction(weights[s]) for s in left), dict.fromkeys(left, 0), 0
        while all(left.values()):
            share = {s: Fraction(weights[s]) / total for s in left}
            s = min((s for s in left if math.floor(ran[s] / share[s]) <= t), key=lambda s: (math.ceil((ran[s] + 1) / share[s]), s))
            order.append((s, left[s][:block_rows]))
            left[s] = left[s][block_rows:]
            ran[s], t = ran[s] + 1, t + 1
        left = {s: r for s, r in left.items() if r}
    return order


@pytest.mark.parametrize("targets", [{"a": 3.0, "b": 1.0}, {"a": math.pi, "b": 1000.3, "c": 0.01}, {"a": 0.7, "b": 0.1, "c": 1 / 3, "d": 2.0}, {}])
def test_mixing_against_brute_force(spark, targets):
    """Small periods by arithmetic, others laid out in order."""
    rng = random.Random(3)
    rows = [(i, rng.choice("aaaabbcde")) for i in range(700)]
    df = spark.createDataFrame(rows, "id long, source string").repartition(5)
    got = mixing.mix(df, "source", targets, 0.5, ["id"], block_rows=7).collect()
    names = sorted(targets)
    pool = lambda s: names.index(s) if s in names else len(names)
    own = {p: [] for p in range(len(names) + 1)}
    for r in df.orderBy(F.xxhash64("id")).collect():
        own[pool(r.source)].append(r.id)
    weights = [Fraction(repr(targets[k])) for k in names] + [Fraction(1, 2)]
    want, seen, at = set(), Counter(), 0
    for slot, (p, ids) in enumerate(brute_mix(own, weights, 7)):
        want |= {(i, seen[p], slot, at + k) for k, i in enumerate(ids)}
        seen[p], at = seen[p] + 1, at + len(ids)
    assert {(r.id, r.block, r.slot, r.position) for r in got} == want


def test_mixing_many_sources_and_both_ways_agree(spark, monkeypatch):
    rng = random.Random(4)
    for _ in range(30):
        w, b = zip(*((rng.randint(1, 9), rng.randint(0, 30)) for _ in range(rng.randint(1, 6))), strict=True)
        plan = mixing.phases(w, b)
        slots = {}
        for i, p in enumerate(plan):
            nxt = plan[i + 1] if i + 1 < len(plan) else None
            slots |= {p.slot(s, k): (s, k) for s in p.start for k in range(p.start[s], nxt.start.get(s, b[s]) if nxt else b[s])}
        assert [slots[t] for t in sorted(slots)] == list(mixing.blocks_in_order(w, b))
    df = spark.range(3000).withColumn("source", F.concat(F.lit("s"), F.col("id") % 700))
    got = mixing.mix(df, "source", {f"s{i}": 1.0 + i for i in range(600)}, 1.0, ["id"], block_rows=2).collect()
    assert sorted(r.position for r in got) == list(range(3000)) and {r.source for r in got} == {f"s{i}" for i in range(700)}


def test_numbers_do_not_depend_on_buckets_and_split_equal_rows(spark, monkeypatch):
    df = spark.range(4000).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("v"))
    number = lambda: sorted(map(tuple, common.number_within(df, "n", ["g"], F.xxhash64("v"), ["v"]).collect()))
    want = number()
    for g in range(3):
        assert sorted(n for a, _, n in want if a == g) == list(range(sum(a == g for a, _, _ in want)))
    monkeypatch.setattr(common, "BUCKET_ROWS", 10)
    assert number() == want
    monkeypatch.setattr(common, "CROWDED", 40)
    assert number() == want
    monkeypatch.setattr(common, "LEAST_BUCKETS", 2)
    monkeypatch.setattr(common, "BUCKET_ROWS", 1 << 20)
    assert number() == want


def test_mixing_odd(odd):
    got = mixing.mix(odd, "source", {"src0": 2.0, "gone": 1.0}, 0.5, ["doc_id", "text"], block_rows=2)
    kept_of(got, odd, ("block", "slot", "position"))
    assert set(odd.columns) < set(mixing.mix(odd, "source", {}, 0.5, ["doc_id", "a.b"], prefix="_").columns)
    assert sorted(r.position for r in got.collect()) == list(range(len(ODD)))
    assert mixing.mix(odd.limit(0), "source", {}, 1.0, ["doc_id"]).count() == 0
    kept = mixing.ordered(got)
    assert kept.count() == len(ODD)
    with pytest.raises(ValueError):
        mixing.mix(odd, "source", {"a": 0.0}, 1.0, ["doc_id"])


# URL rules


def test_url_rules_against_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    labels = ["a", "b", "ab", "a-b", "com", "x"]
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randint(1, 4)))
    path = lambda: "/" + "/".join(rng.choice(["p", "pq", "q"]) for _ in range(rng.randint(0, 3)))
    rules = [url_rules.Rule(rng.choice(["allow", "block"]), host(), path()) for _ in range(60)]
    rules = list({r.name: r for r in rules}.values())
    urls = [f"http://{host().upper()}{path()}?q=http://no" for _ in range(400)] + [None, "", "nohost", "://", "http://a", "http://.com/", "x://a.b#f", "http://" + "b." * 500 + "com/p"]
    monkeypatch.setattr(url_rules, "RULES_AT_ONCE", 17)
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, rule string").repartition(3)
    for r in url_rules.judge(df, "url", rules, default="block").collect():
        fits = [x for x in rules if (r.host == x.host or r.host.endswith("." + x.host)) and r.path.startswith(x.path)]
        best = max(fits, key=lambda x: (len(x.name), len(x.host)), default=None)
        if best is None:
            assert (r.rule, r.verdict) == (None, "block")
        else:
            assert (len(r.rule), r.rule) == (len(best.name), r.rule) and r.rule in {x.name for x in fits if len(x.name) == len(best.name)}
    long = url_rules.Rule("block", "com", "/" + "p" * 5000)
    monkeypatch.setattr(url_rules, "CHARS_AT_ONCE", 100)
    far = spark.createDataFrame([(1, "x://a.com/" + "p" * 6000), (2, "x://a.com/p")], "id int, url string")
    assert [r.verdict for r in url_rules.judge(far, "url", [long, *rules[:3]]).orderBy("id").collect()][0] == "block"
    named = df.withColumnsRenamed({"url": "the.url"}).withColumn("key", F.lit("old")).withColumn("qu`ote", F.lit("old"))
    out = url_rules.judge(named, "the.url", rules)
    assert out.columns == ["page_id", "the.url", "key", "qu`ote", "host", "path", "rule", "verdict"] and {r.key for r in out.collect()} == {"old"}
    assert url_rules.judge(df.limit(0), "url", rules).count() == 0
    assert url_rules.judge(df, "url", []).where("verdict <> 'allow'").count() == 0


# Decontamination


def test_decontamination_against_brute_force(spark, rows):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{DATA}/sf0.01/benchmark.parquet").collect()}
    cut = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    tokens = {i: cut(t) for i, t in items.items()}
    at = {}
    for i, w in tokens.items():
        for k in range(len(w) - 2):
            at.setdefault(tuple(w[k : k + 3]), []).append((i, k))
    want = set()
    for d, t in rows:
        w = cut(t)
        for i, shift in {(i, k - j) for k in range(len(w) - 2) for i, j in at.get(tuple(w[k : k + 3]), ())}:
            same = [int(0 <= shift + j < len(w) and w[shift + j] == x) for j, x in enumerate(tokens[i])]
            if len(same) >= 11 and max(sum(same[s : s + 13]) for s in range(max(1, len(same) - 12))) >= min(13, len(same)) - min(2, len(same) // 6):
                want.add((d, i))
    assert {(r.doc_id, r.item_id) for r in Q["op6_decontamination"](spark, f"{DATA}/sf0.01").collect()} == want


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_decontamination_tolerates_two_substitutions(spark, odd, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_PLACES", broadcast)
    rng = random.Random(4)
    item = [f"b{i}" for i in range(13)]
    texts = []
    for a in range(13):
        for b in range(a, 13):
            t = [f"t{rng.randrange(9**9)}" for _ in range(40)]
            t[10:23] = [x if i not in (a, b) else "zzz" for i, x in enumerate(item)]
            texts.append(" ".join(t))
    clean = [" ".join(f"t{rng.randrange(9**9)}" for _ in range(40)), " ".join(item[:9]), " ".join(x if i % 4 else "y" for i, x in enumerate(item))]
    df = spark.createDataFrame(list(enumerate(texts + clean)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "too short")], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.overlaps(df, bench).collect()} == set(range(len(texts)))
    assert {r.doc_id for r in decontaminate.decontaminated(df, bench).collect()} == set(range(len(texts), len(texts) + 3))
    kept_of(decontaminate.decontaminated(odd, bench), odd, ())
    assert decontaminate.decontaminated(odd, bench).count() == len(ODD)
    assert decontaminate.overlaps(odd, bench, keep=("a.b", "text_hash", "bad_hash")).columns == ["a.b", "bad_hash", "text_hash", "item_id", "matched", "hits"]
    assert decontaminate.decontaminated(odd, bench.limit(0)).columns == odd.columns
    assert decontaminate.overlaps(df.limit(0), bench).count() == 0


@pytest.mark.parametrize(("length", "places"), [(11, 1), (12, 2)])
def test_decontamination_covers_short_windows(spark, length, places):
    item = [f"b{i}" for i in range(length)]
    ways = list(itertools.combinations(range(length), places))
    texts = [" ".join(["one", "two", *("zzz" if i in way else w for i, w in enumerate(item)), "three"]) for way in ways]
    over = " ".join("zzz" if i in range(0, 2 * places + 2, 2) else w for i, w in enumerate(item))
    df = spark.createDataFrame(list(enumerate([*texts, over, " ".join(item)])), "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(f"c{i}" for i in range(20)))], "item_id long, text string")
    assert {r.doc_id: r.matched for r in decontaminate.overlaps(df, bench).collect()} == {**{i: length - places for i in range(len(ways))}, len(ways) + 1: length}


def test_decontamination_of_passages_that_many_items_share(spark):
    """Equal places meet once; all pairs come out, and documents' verdicts without them."""
    shared = " ".join(f"s{i}" for i in range(150))
    bench = spark.createDataFrame([(i, f"q{i} {shared} a{i}") for i in range(12)], "item_id long, text string")
    df = spark.createDataFrame([(d, f"x{d} {shared} y{d}") for d in range(15)] + [(99, "nothing of it")], "doc_id long, text string")
    got = decontaminate.overlaps(df, bench).collect()
    assert {(r.doc_id, r.item_id, r.matched) for r in got} == {(d, i, 13) for d in range(15) for i in range(12)}
    places, _ = decontaminate._places(bench, "item_id", "text")
    assert decontaminate._distinct_places(places).count() < places.count() / 3
    plan = decontaminate.decontaminated(df, bench)
    assert [r.doc_id for r in plan.collect()] == [99]
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_decontamination_finds_short_items_whole(spark):
    items = [" ".join(f"i{n}x{k}" for k in range(n)) for n in range(1, 11)]
    odd = lambda t: " ".join([*t.split()[:-1], "zzz"])
    docs = [f"before it {t.upper()}, behind" for t in items] + list(items) + [f"before {odd(t)} {t.split()[-1]}" for t in items[1:]]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame([*enumerate(items), (50, "..."), (51, None)], "item_id long, text string")
    want = {(d, d % 10, d % 10 + 1) for d in range(20)}
    assert {(r.doc_id, r.item_id, r.matched) for r in decontaminate.overlaps(df, bench).collect()} == want
    assert {r.doc_id for r in decontaminate.decontaminated(df, bench).collect()} == set(range(20, 29))


# Language model


def check_scores(got, rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = [(i, [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)), None]) for i, t in rows]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted(((i, held(i), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in tokens), key=repr)
    have = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=repr)
    for a, b in zip(sorted(have, key=lambda r: (repr(r[:5]), r[5])), sorted(want, key=lambda r: (repr(r[:5]), r[5])), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9)


def test_lm_query(spark, rows):
    got = Q["op7_lm_score"](spark, f"{DATA}/sf0.01").collect()
    check_scores(got, rows)
    own = [r for r in got if r.held_out]
    assert sum(r.score for r in own) > sum(r.base_score for r in own)


def test_lm_small_head_and_odd_rows(spark, odd, docs, rows, monkeypatch):
    monkeypatch.setattr(lm_score, "HEAD", 50)
    monkeypatch.setattr(lm_score, "UNITS", 20)
    monkeypatch.setattr(lm_score, "COMBINE", 100)
    some = docs.limit(60).select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    listed = [(r.doc_id, r.text) for r in some.collect()]
    some = spark.createDataFrame(listed, "doc_id long, text string").withColumn("held_out", queries._fold(7) == 2)
    model, head, counts = lm_score.fit(some.where(~F.col("held_out")).select("text"))
    assert len(head) <= 50
    check_scores(lm_score.score(some, model, head, counts, keep=["doc_id", "held_out"]).collect(), listed)
    # All continuations of a unit together, one unknown word in each shape included, have probability one.
    for before in range(len(model.unit_class)):
        p = 10 ** (model.step[model.unit_class[before], model.unit_class] + model.emit)
        assert p.sum() == pytest.approx(1)
    nothing = lm_score.fit(some.limit(0).select("text"))
    out = lm_score.score(some, *nothing, keep=["doc_id"]).collect()
    assert len(out) == len(listed) and all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in out)
    assert lm_score.score(some.limit(0), model, head, counts, keep=["doc_id"]).count() == 0


def test_lm_gives_every_training_word_a_class(spark, monkeypatch):
    # Nouns and verbs in turn, all of one shape, no two rare ones together; four words are clustered on the driver, ten are in the head.
    monkeypatch.setattr(lm_score, "UNITS", 4)
    monkeypatch.setattr(lm_score, "HEAD", 10)
    rng = random.Random(9)
    word = lambda i: "nv"[i % 2] + (str(rng.randrange(30)) if i % 6 in (2, 5) else rng.choice("ab"))
    texts = [" ".join(word(i) for i in range(24)) for _ in range(150)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    model, head, rare = lm_score.fit(df)
    classes = {w: int(c) for (w, _), c in zip(head, model.head_class, strict=True)} | {bytes(r.word): r["class"] for r in rare.collect()}
    count = Counter(w for t in texts for w in t.encode().split())
    assert set(classes) == set(count) and len(head) <= 10
    nouns, verbs = ({c for w, c in classes.items() if w[:1] == x} for x in (b"n", b"v"))
    assert not nouns & verbs
    # The score, from the classes alone: joint class counts smoothed, and each word's share of its class.
    end, k = int(model.unit_class[-1]), len(model.step)
    joint = np.zeros((k, k))
    for t in texts:
        seq = [end, *(classes[w] for w in t.encode().split()), end]
        np.add.at(joint, (seq[:-1], seq[1:]), 1)
    some = ["na v1 n2 new", "nothing", "", texts[0]]
    follow = np.maximum((joint > 0).sum(axis=1), 1)
    step = np.log10((joint + follow[:, None] * ((joint.sum(axis=0) + 1) / (joint.sum() + k))) / (joint.sum(axis=1) + follow)[:, None])
    units = {w for w, _ in head[:4]}
    inside = Counter()
    for w, c in count.items():
        inside[classes[w]] += c + 0.5 * (w in units)
    for s in model.shape_class:
        inside[int(s)] += 0.5
    for r in lm_score.score(spark.createDataFrame([(t,) for t in some], "text string"), model, head, rare, keep=["text"]).collect():
        seq, want = [end], 0.0
        for w in r.text.encode().split():
            cls = classes.get(w, int(model.shape_class[lm_score.shape_of(w)]))
            want += math.log10((count[w] + 0.5 * (w in units or w not in count)) / inside[cls])
            seq.append(cls)
        seq.append(end)
        assert r.score == pytest.approx(want + step[seq[:-1], seq[1:]].sum(), rel=1e-9)


def test_lm_counts_long_words_by_their_whole(spark):
    """A frequent word of over 64 bytes is in the head, and two that end differently are two words."""
    a, b = "-" * 5000, "-" * 4999 + "+"
    texts = [f"{a} one two"] * 30 + [f"{b} three"] * 3
    model, head, rare = lm_score.fit(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert sorted(c for _, c in head) == [3, 3, 30, 30, 30] and max(len(w) for w, _ in head) <= lm_score.WORD_BYTES
    out = lm_score.score(spark.createDataFrame([(1, f"{a} {b} {a}x"), (2, a)], "`i.d` int, text string").withColumn("score", F.lit("old")), model, head, rare, keep=["i.d", "score"])
    assert out.columns == ["i.d", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert [(r["i.d"], r.n_tokens, r.n_known) for r in out.orderBy("`i.d`").collect()] == [(1, 4, 3), (2, 2, 2)]


def test_exchange_separates_alternating_units():
    n = np.zeros((9, 9))
    for a in range(4):
        for b in range(4, 8):
            n[a, b] = n[b, a] = 50
    n[8, 0] = n[4, 8] = 1
    of = lm_score.exchange(n, 8, classes=3)
    assert len(set(of[:4])) == 1 and len(set(of[4:8])) == 1 and len(set(of)) == 3


# Language


def test_language_query(spark, docs):
    got = {r.doc_id: r for r in Q["op8_language"](spark, f"{DATA}/sf0.01").collect()}
    langs = {r.doc_id: r.lang for r in docs.collect()}
    held = [i for i in got if got[i].held_out]
    assert {i for i in langs if zlib.crc32(str(i).encode()) % 4 == 2} == set(held)
    assert np.mean([got[i].lang_pred == langs[i] for i in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_odd(odd, docs):
    model = language_id.train(docs)
    out = {(r.doc_id, r.text[:20] if r.text else r.text): r for r in language_id.predict(odd, model).collect()}
    assert len(out) == len(ODD) - 1
    kept_of(language_id.predict(odd, model), odd, ("lang_pred", "score", "rejected"))
    for r in out.values():
        assert (r.lang_pred == "und") == (not r.text or not any(map(str.isalpha, r.text)))
    assert language_id.predict(odd.limit(0), model).count() == 0
    none = language_id.train(odd.limit(0))
    assert {r.lang_pred for r in language_id.predict(odd, none, keep=["doc_id"]).collect()} == {"und"}


def test_language_learns_from_whole_texts_and_every_language(spark):
    """What tells languages apart stands after 2,000 words, and there are more than 200 of them."""
    filler = " ".join(f"same{i % 50}" for i in range(2000))
    two = [(f"{filler} " + " ".join([w] * 400), lang) for w, lang in (("zulu", "z"), ("yankee", "y")) for _ in range(30)]
    model = language_id.train(spark.createDataFrame(two, "text string, lang string"))
    scorer = language_id.Scorer(model)
    assert [scorer.predict(f"{filler} " + " ".join([w] * 390))[0] for w in ("zulu", "yankee")] == ["z", "y"]
    many = [(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}q " * 5, f"l{i}") for i in range(230) for _ in range(2)]
    assert len(language_id.train(spark.createDataFrame(many, "text string, lang string")).languages) == 230
    cache, known = {}, language_id.Grams()
    at, n = language_id.bag_of("ab " * 3 + "x" * 100_000, cache, known)
    assert n.sum() == 3 * len(language_id.grams_of("ab", known)) + len(language_id.grams_of("x" * 100_000, known))


# Top-k


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(5)
    vectors = [(i, [float(x) for x in rng.normal(size=rng.integers(0, 6))]) for i in range(300)]
    vectors += [(i, [0.5, 0.25, 0.0]) for i in range(300, 420)]
    vectors += [(500, None), (550, [1.0, None]), (600, [float("nan")]), (650, [float("inf")]), (None, [1.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    good = {i: [math.floor(256 * x) for x in v] for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = set()
    for q in (i for i in good if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(good[q], v, strict=False)), i) for i, v in good.items() if i != q)[:5]
        want |= {(q, n, i, -s) for n, (s, i) in enumerate(best, 1)}
    assert {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect()} == want
    few = df.where("vec_id in (0, 1, 2)")
    assert topk.top_k(few, F.col("vec_id") == 0).count() == 2
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0
    named = df.withColumnsRenamed({"embedding": "em.bed"}).withColumns({c: F.lit("old") for c in ("score", "rank", "query_id", "v", "norm", "cell")})
    assert {tuple(r) for r in topk.top_k(named, F.col("vec_id") % 50 == 0, embedding="em.bed").collect()} == want
    large = spark.createDataFrame([(1, [1e6, 3.0]), (2, [2e6, 1.0]), (3, [-1e6, 0.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in topk.top_k(large, F.col("vec_id") == 1).orderBy("rank").collect()] == [(2, 2**16 * (2 * 10**12 + 3)), (3, -(2**16) * 10**12)]


@pytest.mark.parametrize("scale", [1.0, 1e6, 1e15])
def test_top_k_expands_in_steps_and_takes_huge_components(spark, monkeypatch, scale):
    monkeypatch.setattr(topk, "CHUNK", 16)
    monkeypatch.setattr(topk, "BLOCK", 8)
    monkeypatch.setattr(topk, "GROWTH", 2)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 4)) * 10
    vectors = [(i, [float(x) * scale for x in centres[i % 12] + rng.normal(size=4) * 0.2]) for i in range(600)]
    vectors[50] = (50, [1e200, 0.0, 1.0, -3.0])
    vectors[51] = (51, [-1e200, 1e250, 0.0, 0.0])
    vectors[52] = (52, [1.7e308] * 4)
    vectors += [(1000 + i, vectors[3][1]) for i in range(40)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    whole = {i: [int(x) for x in topk.quantised(v)] for i, v in vectors}
    clip = lambda x: max(min(x, 2**63 - 1), -(2**63) + 1)
    want = set()
    for q in (i for i in whole if i % 50 == 0):
        best = sorted((-clip(sum(a * b for a, b in zip(whole[q], v, strict=True))), i) for i, v in whole.items() if i != q)[:5]
        want |= {(q, n, i, -s) for n, (s, i) in enumerate(best, 1)}
    assert {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect()} == want


def test_top_k_looks_at_few_chunks_of_clustered_vectors(spark, monkeypatch):
    """Pruning: in clusters, a query meets a small part of the chunks."""
    monkeypatch.setattr(topk, "CHUNK", 64)
    monkeypatch.setattr(topk, "BLOCK", 8)
    pairs = []
    real = topk._asked
    monkeypatch.setattr(topk, "_asked", lambda *a: (out := real(*a), pairs.append(out.selectExpr("sum(length(at)) / 4 AS n").first()[0] or 0))[0])
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 6))
    centres *= 20 / np.linalg.norm(centres, axis=1, keepdims=True)
    vectors = [(i, [float(x) for x in centres[i % 40] + rng.normal(size=6) * 0.05]) for i in range(8000)]
    topk.top_k(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).count()
    assert sum(pairs) < 0.3 * 160 * 8000 / 64


def test_top_k_broadcasts_no_more_than_a_bound(spark, monkeypatch):
    """A block's queries for many chunks are small in files and large as rows; the driver must not gather them."""
    monkeypatch.setattr(topk, "CHUNK", 16)
    monkeypatch.setattr(topk, "GROWTH", 512)
    steps, real = [], topk._scored

    def spy(met, k):
        rows = met.selectExpr("sum(octet_length(q_vectors))").first()[0]
        steps.append((rows, "Inner, Build" in met._jdf.queryExecution().executedPlan().toString()))
        return real(met, k)

    monkeypatch.setattr(topk, "_scored", spy)
    x = np.random.default_rng(4).normal(size=(3200, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 5 == 0).collect()}
    whole = np.floor(256 * x).astype(np.int64)
    scores = whole[::5] @ whole.T
    scores[np.arange(640), np.arange(0, 3200, 5)] = -(2**62)
    best = np.argsort(-scores, axis=1, kind="stable")[:, :5]
    assert got == {(5 * q, n, int(i), int(scores[q, i])) for q in range(640) for n, i in enumerate(best[q], 1)}
    assert max(rows for rows, _ in steps) > 8 << 20
    assert not any(broadcast for rows, broadcast in steps if rows > 8 << 20)


# Samples


def test_sample_in_place_draws_the_smallest_hashes(spark):
    df = spark.range(5000).withColumn("_hash", F.lit("old")).repartition(7)
    for n in (0, 1, 40, 3000, 5000, 6000):
        want = [r.id for r in df.orderBy(F.xxhash64("id")).limit(n).collect()]
        got = common.sample_in_place(df, ["id"], n)
        assert got.columns == df.columns and sorted(r.id for r in got.collect()) == sorted(want)
    same = spark.range(100).select(F.lit(1).alias("id"))
    assert common.sample_in_place(same, ["id"], 10).count() == 10
    assert common.sample_in_place(df.limit(0), ["id"], 10).count() == 0


# Personal data

_PATTERNS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(d := re.sub(r"\D", "", s)) <= 19 and pii.luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(re.sub(r"\D", "", s)) <= 15),
}


def brute_spans(text):
    return [(k, *m.span()) for k, (pattern, test) in _PATTERNS.items() for m in re.finditer(pattern, text or "") if test(m[0])]


def test_base_spans_on_random_strings():
    rng = random.Random(6)
    for _ in range(4000):
        t = "".join(rng.choice("a1@.+ -()_4é,") for _ in range(rng.randrange(40)))
        assert pii.base_spans(t) == brute_spans(t), t
    assert pii.luhn("4316522678525456") and not pii.luhn("4316522678525457")
    assert pii.base_spans("1" * 200_000 + "." * 1000) == [] and len(pii.base_spans("a@" * 100_000 + "b.c")) == 1
    zeros = "0" * 5000
    assert pii.base_spans(f"{zeros}1.2.3.{zeros}") == [("ip", 0, 10_006)]


def test_taken_spans_against_brute_force():
    rng = random.Random(8)
    some = lambda n: [(s, s + rng.randrange(1, 6)) for s in (rng.randrange(40) for _ in range(n))]
    for _ in range(500):
        spans = some(rng.randrange(6))
        taken = pii._Taken(spans)
        for s, e in some(20):
            fits = all(e <= a or b <= s for a, b in spans)
            assert taken.free(s, e) == fits
            if fits and rng.random() < 0.3:
                taken.take(s, e)
                spans.append((s, e))
        apart = []
        for a, b in some(8):
            if all(b <= x or y <= a for x, y in apart):
                apart.append((a, b))
        taken = pii._Taken(apart)
        assert all(taken.nests(s, e) == any(a <= s and e <= b or s <= a and b <= e for a, b in apart) for s, e in some(20))


def test_pii_query(spark, rows):
    got = {r.doc_id: r for r in Q["op10_pii"](spark, f"{DATA}/sf0.01").collect()}
    for i, t in rows:
        base = brute_spans(t)
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        r = got[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x[0] for x in base) for k in pii.KINDS)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))


def test_pii_adds_disguised_spans_and_handles_odd_rows(spark, odd):
    model = pii.train(spark.read.parquet(f"{DATA}/sf0.1/documents.parquet"))
    text = "write to jo.doe (at) example (dot) org or call (310) 555-4510, not version 10.22.33.444 or 2024-01-02"
    kinds = [(k, text[s:e]) for k, s, e in model.spans(text)[1]]
    assert kinds == [("email", "jo.doe (at) example (dot) org"), ("phone", "(310) 555-4510")]
    assert pii.redact(text, model.spans(text)[1]).startswith("write to [email] or call [phone], not")
    out = pii.find(odd, model)
    kept_of(out, odd, ("spans",))
    assert out.count() == len(ODD) and {r.doc_id for r in out.where(F.size("spans") > 0).collect()} == {None}
    assert pii.find(odd.limit(0), pii.train(odd.limit(0))).count() == 0


def test_pii_recall_of_disguised_spans(spark, rows):
    """Base spans of texts that training has not read, as people hide them: at least nine in ten are found again."""
    model = pii.train(spark.read.parquet(f"{DATA}/sf0.1/documents.parquet").where("doc_id % 10 <> 3"))
    found, clean = Counter(), Counter()
    for r in spark.read.parquet(f"{DATA}/sf0.1/documents.parquet").where("doc_id % 10 = 3").select("text").collect():
        for kind, s, e in pii.base_spans(r.text or ""):
            if hidden := pii._disguised(kind, r.text[s:e]):
                text = r.text[max(0, s - 200) : s] + hidden + r.text[e : e + 200]
                at = len(r.text[max(0, s - 200) : s])
                clean[kind] += 1
                found[kind] += any(a <= at and at + len(hidden) <= b for _, a, b in model.spans(text)[1])
    assert sum(clean.values()) > 50 and all(found[k] >= 0.9 * clean[k] for k in clean), (found, clean)


def test_pii_proposes_parts_of_long_runs_and_names_of_any_length():
    text = "(310) 555-4510 (310) 555-4511"
    spans = {text[s:e] for k, s, e in pii.candidates(text) if k == "phone"}
    assert {"(310) 555-4510", "(310) 555-4511"} <= spans
    name = "n" * 500
    assert ("email", 0, len(f"{name} (at) {'d' * 90}.org")) in pii.candidates(f"{name} (at) {'d' * 90}.org")
    began = time.time()
    assert len(pii.candidates("12 345 6789 " * 20_000)) > 20_000
    pii.candidates("a (at) " * 30_000)
    assert time.time() - began < 20


# Quality


def test_quality_query(spark, docs):
    got = {r.doc_id: r for r in Q["op1_quality"](spark, f"{DATA}/sf0.01").collect()}
    labels = spark.read.parquet(f"{DATA}/sf0.01/labels.parquet").collect()
    assert len(got) == docs.count()
    right = [got[r.doc_id].accepted == bool(r.quality) for r in labels]
    assert np.mean(right) > 0.98


def test_expectation_maximisation_finds_accuracies():
    rng = np.random.default_rng(7)
    y = rng.random(20_000) < 0.8
    rate = np.linspace(0.7, 0.95, quality.LABELLERS)
    v = np.where(rng.random((20_000, quality.LABELLERS)) < rate, y[:, None], ~y[:, None]).astype(int)
    v[rng.random(v.shape) < 0.2] = quality.ABSTAIN
    patterns, counts = np.unique(v @ 3 ** np.arange(quality.LABELLERS)[::-1], return_counts=True)
    model = quality.expectation_maximisation(patterns, counts)
    assert abs(model.good - 0.8) < 0.03 and np.abs(model.accuracies() - rate).max() < 0.03


def test_quality_odd(odd):
    out = quality.classify(odd, quality.train(odd))
    kept_of(out, odd, ("posterior", "score", "accepted"))
    out = out.collect()
    assert len(out) == len(ODD)
    assert all(not r.accepted and r.score == 0 for r in out if not (r.text or "").split())
    empty = odd.limit(0)
    assert quality.classify(empty, quality.train(empty)).count() == 0


def test_quality_features_reach_the_end_of_long_words():
    ids = quality._Ids()
    start = b"a" * 20 + b"Some-Text_without.blanks" * 4
    a, b = (quality.featurise(start + end, ids) for end in (b"and-on" * 100, b"#@$%^&" * 100))
    assert not np.array_equal(a, b)
    assert np.array_equal(quality.featurise(b"x" * 64 + b"yz", ids), quality.featurise(b"x" * 64 + b" yz", ids))
    assert len(max(ids, key=len)) == 64
    shapes = [ids[w] >> 16 for w in (b"aB" * 20 + b"1", b"aB" * 20 + b"#")]
    assert shapes[0] != shapes[1]


def test_quality_scores_against_a_plain_recomputation(spark, docs, rows):
    """Votes, posteriors and scores of every document, without Spark."""
    model = quality.train(docs.select("doc_id", "text"))
    counts = Counter(p for _, t in rows if (p := quality.pattern_of(None if t is None else t.encode())) is not None)
    plain = quality.expectation_maximisation(*map(np.array, zip(*sorted(counts.items()), strict=True)))
    assert np.allclose(plain.rates, model.labels.rates) and plain.good == pytest.approx(model.labels.good)
    got = {r.doc_id: r for r in quality.classify(docs, model, keep=["doc_id"]).collect()}
    ids = quality._Ids()
    for i, t in rows[:300]:
        if (p := quality.pattern_of(t.encode())) is not None:
            z = float(quality.featurise(t.encode(), ids) @ model.weights[:-1] + model.weights[-1])
            assert got[i].posterior == pytest.approx(float(plain.posterior([p])[0])) and got[i].score == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-4)
