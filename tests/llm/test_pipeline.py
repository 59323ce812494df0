import hashlib
import math

from oracle import DATA
from pyspark.sql import functions as F

import corpus_pipeline
from framekit.llm import mixing, queries
from test_near_dup import brute_classes
from test_operators import brute_mix


def test_stages_against_brute_force(spark):
    d = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    quality = {r.doc_id for r in queries.queries()["op1_quality"](spark, d).where("accepted").collect()}
    good = corpus_pipeline.keep_good(spark, docs, d)
    assert {r.doc_id for r in good.select("doc_id").collect()} == quality and good.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in good.collect()]
    once = {i for i, c in brute_classes(rows).items() if i == c}
    assert {r.doc_id for r in corpus_pipeline.keep_one_of_each(spark, good, d).select("doc_id").collect()} == once
    bad = {r.doc_id for r in queries.queries()["op6_decontamination"](spark, d).collect()}
    final = corpus_pipeline.run(spark, d)
    assert final.columns == [*docs.columns, "shard"]
    got = final.collect()
    assert sorted(r.doc_id for r in got) == sorted(once - bad)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.text == texts[r.doc_id] and 0 <= r.shard < queries.SHARDS for r in got)


def test_mix_and_shard_of_every_row(spark):
    """The stored order is the schedule's, and the shard is the least cost of the row's own id."""
    d = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").withColumn("position", F.lit("old"))
    mixed = corpus_pipeline.mix_sources(spark, docs, d)
    assert mixed.columns == docs.columns
    own = {}
    names = sorted(queries.MIX)
    for r in docs.withColumn("h", F.xxhash64("doc_id", F.xxhash64("text"))).orderBy("h").collect():
        own.setdefault(names.index(r.source) if r.source in names else len(names), []).append(r.doc_id)
    order = brute_mix(own, [int(queries.MIX[n]) for n in names] + [int(queries.MIX_OTHER)], mixing.BLOCK_ROWS)
    assert [r.doc_id for r in mixed.collect()] == [i for _, ids in order for i in ids]

    def cost(key, s):
        return -math.log((int(hashlib.md5(f"{key}|{s}".encode()).hexdigest()[:13], 16) + 0.5) / 16.0**13)

    for r in corpus_pipeline.shard(spark, docs, d).collect():
        assert r.shard == min(range(queries.SHARDS), key=lambda s: cost(r.doc_id, s))


def test_stages_on_odd_rows(spark):
    """Nulls, long texts, ties, repeats and columns of any name, through every stage."""
    d = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    some = [tuple(r) for r in docs.limit(40).collect()]
    t = some[0][docs.columns.index("text")]
    row = lambda **kw: tuple({**dict(zip(docs.columns, some[0], strict=True)), **kw}[c] for c in docs.columns)
    odd = [row(), row(), row(doc_id=None), row(text=None), row(text=None, doc_id=None, source=None), row(text=""), row(doc_id=10**9, text="It goes on and on. " * 20_000), row(doc_id=10**9, source=None, text=t + " and then some")]
    df = spark.createDataFrame(some + odd, docs.schema)
    extra = ("accepted", "score", "position", "_position", "bad_hash", "class_id", "key", "a.b", "qu`ote", "text_hash")
    df = df.withColumns({c: F.lit("old") for c in extra}).withColumn("nested", F.struct(F.lit(1).alias("with blank")))
    n = df.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, d)
        assert out.columns == [*df.columns, *(["shard"] if name == "shard" else [])]
        rows = out.collect()
        assert all(r[c] == "old" for r in rows for c in extra)
        keys = [(r.doc_id, r.text) for r in rows]
        if name == "quality":
            assert 0 < len(rows) < n and all(text for _, text in keys)
        elif name == "near_dup":
            assert sum(text is None for _, text in keys) == 2 and sum((text or "").startswith(t) for _, text in keys) == 1 and len(set(keys)) == len(keys)
        elif name == "decontaminate":
            assert sum(text is None for _, text in keys) == 2
        else:
            assert len(rows) == n


def test_stages_on_empty_table(spark):
    d = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, d)
        assert docs.count() == 0
