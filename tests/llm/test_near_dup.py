import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from oracle import DATA
from pyspark.sql import functions as F

from framekit.llm import near_dup, queries
from framekit.llm.common import Scratch
from framekit.llm.dart_minhash import COORDINATES, signature
from framekit.llm.near_dup import WordHashes, shingles, weighted_jaccard


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 140)] + [tuple(rng.sample(range(200, 260), 2)) for _ in range(40)]
    edges = [(min(e), max(e)) for e in edges]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    with Scratch(spark) as scratch:
        got = {r.key: r.root for r in near_dup.components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()}
    assert got.keys() == parent.keys()
    by = defaultdict(set)
    for k in parent:
        by[find(k)].add(got[k])
    assert all(len(v) == 1 for v in by.values()) and len({*got.values()}) == len(by)
    with Scratch(spark) as scratch:
        assert near_dup.components(spark.createDataFrame([], "a long, b long"), scratch).count() == 0


@pytest.mark.parametrize("weights", ["ones", "counts", "reals"])
def test_signature_agreement_is_weighted_jaccard(weights):
    rng = np.random.default_rng(1)
    got, want = [], []
    for _ in range(40):
        n = int(rng.integers(20, 600))
        ids = rng.integers(0, 2**63, n).astype(np.uint64)
        draw = {"ones": lambda k: np.ones(k), "counts": lambda k: rng.integers(1, 40, k).astype(float), "reals": lambda k: rng.uniform(0.1, 9, k)}[weights]
        a, b = np.zeros(n), np.zeros(n)
        common = rng.random(n) < rng.uniform(0.2, 1)
        a[:] = draw(n)
        b[common], b[~common] = a[common], np.where(rng.random((~common).sum()) < 0.5, draw((~common).sum()), 0)
        s = [signature(ids[x > 0], x[x > 0]) for x in (a, b)]
        got.append((s[0] == s[1]).mean())
        want.append(np.minimum(a, b).sum() / np.maximum(a, b).sum())
    error = np.array(got) - np.array(want)
    assert abs(error.mean()) < 0.02 and np.abs(error).max() < 4.5 * 0.5 / COORDINATES**0.5


def brute_classes(rows):
    known = WordHashes()
    sets = {}
    first = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        if t is not None and near_dup.words_of(t):
            first.setdefault(t, i)
            sets.setdefault(t, shingles(t, known))
    texts = list(sets)
    parent = {t: t for t in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(texts):
        for b in texts[:i]:
            if weighted_jaccard(sets[a], sets[b]) >= 0.8:
                parent[find(a)] = find(b)
    low = {}
    for t in texts:
        low[find(t)] = min(first[t], low.get(find(t), first[t]))
    return {i: low[find(t)] if t in parent else i for i, t in rows}


def test_query_against_brute_force(spark):
    got = {r.doc_id: r.class_id for r in queries.queries()["op5_near_dup"](spark, f"{DATA}/sf0.01").collect()}
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").collect()]
    assert got == brute_classes(rows)


def near_group(n, words=120, seed=5):
    """Copies of one text with a few words changed, far enough apart that not all are linked to each other."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(rng.randrange(4)):
            t[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize(("block", "many", "degree"), [(16, 8, 64), (16, 0, 2), (1024, 0, 64), (8, 1, 1)])
def test_large_group_in_blocks(spark, monkeypatch, block, many, degree):
    """Pairs that leave the blocks, and links found in them; both must find every class."""
    monkeypatch.setattr(near_dup, "BLOCK", block)
    monkeypatch.setattr(near_dup, "MANY", many)
    monkeypatch.setattr(near_dup, "DEGREE", degree)
    rows = list(enumerate(near_group(120) + near_group(30, seed=6)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_dup.with_classes(df).collect()} == brute_classes(rows)


def test_odd_rows(spark):
    long = " ".join(f"t{i % 9973}" for i in range(60_000))
    rows = [
        (1, None, "a"), (2, "", "a"), (3, " \n.", "b"), (4, "one two", None), (5, "One, two!", "c"), (6, "one", "c"), (None, "solo text here now then", "d"),
        (7, long, "e"), (8, long + " x", "e"), (9, "one two", "f"), (9, "one two", "g"), (10, None, "h"), (10, None, "h"), (11, "the cat sat on the mat", "i"),
        (12, "the cat sat on the mat", "i"), (4, "one two", None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, class_id string").withColumnRenamed("class_id", "_key")
    got = sorted(((r.doc_id, r.class_id) for r in near_dup.with_classes(df).collect()), key=repr)
    want = [(1, 1), (2, 2), (3, 3), (4, 4), (4, 4), (5, 4), (6, 6), (None, None), (7, 7), (8, 7), (9, 4), (9, 4), (10, 10), (10, 10), (11, 11), (12, 11)]
    assert got == sorted(want, key=repr)
    kept = near_dup.deduplicated(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([1, 2, 3, 4, 6, None, 7, 10, 10, 11], key=repr)
    assert near_dup.deduplicated(df.limit(0)).count() == 0
    assert Counter(near_dup.with_classes(df.limit(0)).columns) == Counter([*df.columns, "class_id"])


def test_any_names_and_ids(spark):
    """String ids, names with dots and quotes, columns named like results and temporary ones."""
    a, b = near_group(2, seed=12)
    rows = [("x9", a, "o"), ("x1", a + " more", "o"), ("y", b, "o"), (None, None, "o"), ("z", "", "o")]
    df = spark.createDataFrame(rows, "`the.id` string, `qu``ote` string, class_id string").withColumns({c: F.lit("o") for c in ("key", "_key", "n", "first", "stays", "root")})
    got = near_dup.with_classes(df, "qu`ote", "the.id")
    assert got.columns == [*[c for c in df.columns if c != "class_id"], "class_id"]
    by = {r["the.id"]: r.class_id for r in got.collect()}
    want = brute_classes([(r[0] or "", r[1]) for r in rows if r[1]])
    assert by == {"x9": want["x9"], "x1": want["x1"], "y": want["y"], None: None, "z": "z"}
    kept = near_dup.deduplicated(df, "qu`ote", "the.id")
    assert kept.columns == df.columns and {r["the.id"] for r in kept.collect()} == {want["x9"], want["x1"], want["y"], None, "z"}


def test_texts_are_signed_once_in_a_task(spark, monkeypatch):
    """Copies only count, whatever the bound on what a task remembers."""
    monkeypatch.setattr(near_dup, "_SEEN", 1)
    rows = [(i, f"text number {i % 3} of some words") for i in range(60)] + [(100, "..."), (101, "...")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["first"]: (r.n, r.signature is None, r.weight) for r in near_dup._distinct(df, "text", "doc_id").collect()}
    assert got == {0: (20, False, 2), 1: (20, False, 2), 2: (20, False, 2), 100: (2, True, 0)}


def test_bands_and_cut_miss_no_more_than_stated():
    rng = np.random.default_rng(11)
    chance = lambda s, m: math.comb(COORDINATES, m) * s**m * (1 - s) ** (COORDINATES - m)
    missed = {}
    for m in range(70, COORDINATES + 1):
        order = rng.random((3000, COORDINATES))
        agree = order <= np.sort(order, axis=1)[:, m - 1 : m]
        missed[m] = 1.0 if m / COORDINATES < near_dup.CANDIDATE else 1 - np.mean(np.any([agree[:, at].all(axis=1) for at in near_dup._BAND_AT], axis=0))
    # With room for the few draws in the second; long runs give about one in a million.
    for s, most in ((0.8, 3e-4), (0.85, 4e-6)):
        assert sum(chance(s, m) * x for m, x in missed.items()) < most


def test_one_row_of_each_class_stays(spark):
    near = near_group(4, seed=8)
    near = [near[0], near[0] + " more", near[0] + " less", near[0] + " last"]
    other = near_group(1, seed=9)[0]
    rows = [(5, near[0]), (5, near[1]), (9, near[2]), (None, near[3]), (None, other), (None, other + " x"), (None, other), (7, "!!! ++"), (6, "!!! ++"), (8, "\U0001f600"), (8, "\U0001f600"), (3, "..."), (2, None), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.text, r.class_id) for r in near_dup.with_classes(df).collect()), key=repr)
    class_of = lambda i, t: 5 if t in near else None if t and t.startswith(other) else 6 if t == "!!! ++" else i
    assert got == sorted(((i, t, class_of(i, t)) for i, t in rows), key=repr)
    kept = [(r.doc_id, r.text) for r in near_dup.deduplicated(df).collect()]
    assert sum(t in near for _, t in kept) == 1 and [i for i, t in kept if t in near] == [5]
    assert sum(bool(t) and t.startswith(other) for _, t in kept) == 1
    assert sorted((i, t) for i, t in kept if t and t not in near and not t.startswith(other)) == [(3, "..."), (6, "!!! ++"), (8, "\U0001f600")]
    assert sum(t is None for _, t in kept) == 2 and len(kept) == 7


def rows_of_joins(df):
    """The rows that each join of a plan made."""
    df.collect()

    def walk(node):
        if "Join" in node.nodeName():
            yield node.metrics().apply("numOutputRows").value()
        below = [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "AdaptiveSparkPlan":
            below = [node.executedPlan()]
        elif "QueryStage" in node.nodeName():
            below = [node.plan()]
        for x in below:
            yield from walk(x)

    return list(walk(df._jdf.queryExecution().executedPlan()))


@pytest.mark.parametrize("every_two", [False, True])
def test_a_text_of_many_buckets_is_looked_up_once(spark, every_two):
    signed = spark.range(40).selectExpr("id AS key", "id AS weight", "CAST(CAST(id AS string) AS binary) AS signature")
    rooted = signed.selectExpr("key", "explode(sequence(0, 95)) AS bucket").selectExpr("CAST(bucket AS long) AS bucket", "2 AS blocks", "key", "key % 7 AS root")
    met = near_dup._met(rooted, signed, every_two)
    made = rows_of_joins(met)
    assert made and max(made) == 40
    place = spark.range(40).selectExpr("id AS key", "explode(sequence(0L, 95L)) AS bucket").selectExpr("key", "bucket", "CAST(pmod(xxhash64(key, bucket), 2) AS int) AS m").collect()
    want = {(r.bucket, *sorted((r.m, o)), r.m, r.key, r.key % 7) for r in place for o in ((0, 1) if every_two else (r.m,))}
    got = [(r.bucket, r.g, r.h, r.mine, r.key, r.root) for r in met.collect()]
    assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("size", [1, 2, 3, 10_000])
def test_bands_are_shuffled_once(spark, monkeypatch, size):
    """However many buckets have several texts, and wherever the batches end."""
    from framekit.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    plans, write = {}, Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, df, what: plans.setdefault(what, df) and write(self, df, what))
    rng = random.Random(size)
    rows = [(rng.randrange(30), i, 1) for i in range(40)] + [(77, i, 1) for i in range(9)] + [(99, 5, 1)]
    monkeypatch.setattr(near_dup, "_bands", lambda signed: signed)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        with Scratch(spark) as scratch:
            got = {(r.bucket, r.key) for r in near_dup._members(spark.createDataFrame(rows, "bucket long, key long, weight long"), scratch).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    by = defaultdict(set)
    for b, k, _ in rows:
        by[b].add(k)
    first = {}
    for b in sorted(by, key=lambda b: (b % near_dup.BANDS, b)):
        if len(by[b]) > 1:
            first.setdefault(frozenset(by[b]), b)
    assert got == {(b, k) for b in first.values() for k in by[b]}
    assert list(plans)[0] == "met"
    assert plans["met"]._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(bucket") == 1
