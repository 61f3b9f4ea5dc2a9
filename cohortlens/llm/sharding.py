"""Sharding by a permutation-filled lookup table of prime size.

Every shard has a preference order over the table's slots: the permutation
``(offset + j * skip) mod size``, offset and skip taken from the shard's name. The shards
take turns; in its turn a shard claims its most preferred slot that is still free, until no
slot is free. So each shard owns size/n slots, give or take one, and a change of the shard list
moves few slots besides those of the shards that came or went.

The table depends on the shard names only, never on data, and has ``size`` rows (a parameter
of at most MAX_SIZE), so it is broadcast; a row finds its shard by hashing its key to a slot.
Rows need no shuffle, and a hot value in another column does not matter: the key is dealt.

Defined results: a null key counts as the empty string; rows with equal keys share a shard;
an empty table gives an empty table; columns ``slot`` and ``shard`` of the input are replaced;
shard names must be distinct, non-null and at least one.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_SIZE = 1 << 20


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def _number(name: str) -> int:
    return int(hashlib.md5(name.encode()).hexdigest()[:15], 16)


def key_slot(key: Column, size: int) -> Column:
    """Slot of a key: the first 15 hex digits of its MD5 as a number, modulo ``size``."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(size)).cast("int")


def fill(shards: list[str], size: int) -> list[int]:
    """The table: for each slot, the place of its shard in ``shards``."""
    if not shards or len(set(shards)) != len(shards) or not all(isinstance(s, str) for s in shards):
        raise ValueError("shard names must be distinct strings, at least one")
    if not _is_prime(size) or not len(shards) <= size <= MAX_SIZE:
        raise ValueError(f"size must be a prime from the number of shards to {MAX_SIZE}")
    offset = [_number(f"{s}#offset") % size for s in shards]
    skip = [_number(f"{s}#skip") % max(size - 1, 1) + 1 for s in shards]
    owner, turn = [-1] * size, list(offset)
    claimed = 0
    while True:
        for i in range(len(shards)):
            while owner[turn[i]] >= 0:
                turn[i] = (turn[i] + skip[i]) % size
            owner[turn[i]] = i
            claimed += 1
            if claimed == size:
                return owner


def lookup(spark: SparkSession, shards: list[str], size: int) -> DataFrame:
    """(slot, shard): the filled table, as rows of one constant array."""
    owner = fill(shards, size)
    names = F.array(*[F.lit(s) for s in shards])
    cells = F.split(F.lit(",".join(map(str, owner))), ",")
    return (spark.range(1).select(F.posexplode(cells).alias("slot", "_o"))
            .select("slot", F.element_at(names, F.col("_o").cast("int") + 1).alias("shard")))


def assign(df: DataFrame, key: str, shards: list[str], size: int = 5003) -> DataFrame:
    """All columns of ``df`` plus ``slot`` and ``shard``."""
    table = F.broadcast(lookup(df.sparkSession, shards, size))
    return df.drop("slot", "shard").withColumn("slot", key_slot(F.col(key), size)).join(table, "slot")


def balance(assigned: DataFrame) -> DataFrame:
    """(shard, rows): rows per shard."""
    return assigned.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"))


def moved(old: list[str], new: list[str], size: int = 5003) -> int:
    """Slots whose shard differs between two shard lists."""
    a, b = fill(old, size), fill(new, size)
    return sum(old[x] != new[y] for x, y in zip(a, b))


def write(assigned: DataFrame, path: str) -> None:
    """One folder per shard. Tasks write the rows they read; nothing is shuffled."""
    assigned.write.partitionBy("shard").parquet(path)
