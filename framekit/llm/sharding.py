"""Rendezvous hashing of stable record keys over weighted shards, in built-in functions only.

Every (key, shard) pair gets a hashed uniform number u; the shard with the least -ln(u) / weight
takes the key. A shard's share follows its weight, and a new shard takes keys only into itself.
The choice is a projection: no shuffle, no state, the same on every machine.

Defined results: a null key is the key ''; equal keys share a shard; texts play no part;
an empty table gives an empty table; columns of the input are kept whatever their names, but for one
that has the output's own name, which is replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framekit.llm.common import number_within, spread_hash
from framekit.names import backticks

#: Hexadecimal digits of an MD5 that make up a uniform number: 52 bits, exact in a double.
_DIGITS = 13


def _uniform(key: Column, shard: int) -> Column:
    """In (0, 1): the hash of the key and the shard."""
    digits = F.substring(F.md5(F.concat(key, F.lit(f"|{shard}"))), 1, _DIGITS)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16**_DIGITS)


def rendezvous(key: Column, shards: Sequence[tuple[int, float]]) -> Column:
    """The id of the shard that takes the key, of (id, weight) pairs; ties go to the smaller id."""
    if not shards or any(w <= 0 for _, w in shards) or len({s for s, _ in shards}) != len(shards):
        raise ValueError("give distinct shards with weights over 0")
    key = F.coalesce(key.cast("string"), F.lit(""))
    costs = [F.struct((-F.ln(_uniform(key, s)) / float(w)).alias("cost"), F.lit(s).alias("shard")) for s, w in shards]
    return F.array_min(F.array(*costs))["shard"]


def shard(df: DataFrame, key: str, shards: Sequence[tuple[int, float]], name: str = "shard") -> DataFrame:
    """Append the shard of each row."""
    return df.withColumn(name, rendezvous(F.col(backticks(key)), shards))


def with_slots(df: DataFrame, identity: Sequence[str], shard_column: str = "shard", name: str = "slot") -> DataFrame:
    """Append each row's place in its shard: gapless from 0, the same for the same rows whatever the table's size and partitions.

    ``identity``: columns that tell rows apart; rows equal in all of them are interchangeable.
    The places follow a hash of these columns, so that a shard of any size is numbered by many tasks.
    """
    own = [F.col(backticks(c)) for c in identity]
    return number_within(df, name, [shard_column], spread_hash(own), own)
