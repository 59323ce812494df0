"""A training-data pipeline over ``documents``: what is worth keeping, once, clean, mixed and sharded.

Defined results, for every stage: an empty table stays empty; null and empty texts are rejected by the first stage, and where one
reaches another stage it is kept, as nothing copies or overlaps it; texts of any length are read from end to end; columns beyond those of
``documents`` are carried along whatever their names, but for ``shard``, which the last stage replaces; repeated rows are one row after the second
stage, and ties are broken by id, then by text. A null id is an id like others, the last among copies; a null source belongs to the other sources.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framekit.llm import decontaminate, mixing, near_dup, quality, sharding
from framekit.llm.common import Scratch, columns, written
from framekit.llm.queries import MIX, MIX_OTHER, SHARDS, table
from framekit.names import free_prefix


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects."""
    # The verdict comes under names that no column of the documents has.
    mark = free_prefix(docs.columns)
    return quality.classify(docs, quality.train(docs), prefix=mark).where(f"{mark}accepted").select(*columns(docs))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return near_dup.deduplicated(docs)


def keep_off_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that overlap a benchmark item."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture within and between the files of the result."""
    mark = free_prefix(docs.columns)
    hashed = docs.withColumn(f"{mark}text", F.xxhash64("text"))
    mixed = mixing.mix(hashed, "source", MIX, MIX_OTHER, ["doc_id", f"{mark}text"], prefix=mark)
    return mixing.ordered(mixed, f"{mark}position", unmixed=docs).select(*columns(docs))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard."""
    return sharding.shard(docs, "doc_id", [(s, 1.0) for s in range(SHARDS)])


STAGES = [
    ("quality", keep_good),
    ("near_dup", keep_one_of_each),
    ("decontaminate", keep_off_benchmark),
    ("mix", mix_sources),
    ("shard", shard),
]

#: The classifier and the similarity join are beyond SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark) as scratch:
        for i, (name, stage) in enumerate(STAGES[:-2]):
            before, docs = docs, scratch.write(stage(spark, docs, sf_dir), f"stage-{name}")
            if i:
                scratch.drop(before)
        # The result reads the files of the last stage but one, so they stay.
        name, stage = STAGES[-2]
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
