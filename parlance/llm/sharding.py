"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a prime-sized table, and
shards take turns claiming their next free slot (Maglev hashing).  A row's key
hashes to a slot, the slot names the shard: one look-up, shards of equal size,
and few rows that move when a shard comes or goes.
"""

from __future__ import annotations

from collections.abc import Sequence

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, names_of, quoted

#: A table has this many rows at most, so it can always be broadcast.
MOST_SLOTS = 1_000_003
#: A prime over a thousand times the usual number of shards: shares differ by under a hundredth.
SLOTS = 65_537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """For each slot the index of its shard.

    Raises ValueError for no shards, repeated names, a size that is no prime,
    fewer slots than shards, or more than MOST_SLOTS.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names")
    if not _is_prime(slots) or not len(shards) <= slots <= MOST_SLOTS:
        raise ValueError(f"slots must be a prime from the number of shards to {MOST_SLOTS}")
    at = [xxhash.xxh64_intdigest(s.encode(), 1) % slots for s in shards]
    step = [xxhash.xxh64_intdigest(s.encode(), 2) % max(1, slots - 1) + 1 for s in shards]
    table, free = [-1] * slots, slots
    while True:
        for k in range(len(shards)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % slots
            table[at[k]] = k
            free -= 1
            if not free:
                return table


def _key_hash(keys: Sequence[str], spare: Sequence[str]) -> Column:
    """A hash of the key; rows whose key is null all over are told apart by the spare columns."""
    own = F.xxhash64(*keys)
    if not spare:
        return own
    return F.when(F.coalesce(*[F.col(k).cast("string") for k in keys]).isNull(), F.xxhash64(*spare)).otherwise(own)


def assign_shards(df: DataFrame, keys: Sequence[str], shards: Sequence[str], slots: int = SLOTS, spare: Sequence[str] = (), hot_share: float | None = 0.25, out: tuple[str, str] = ("slot", "shard")) -> DataFrame:
    """``df`` with the slot and the shard's name of each row.

    Rows of one key share a shard, except for a hot key: one with more than
    ``hot_share`` of a shard's fair share of rows goes to several slots, by a
    hash of the whole row, so that one key never fills a shard.  There are at
    most ``len(shards) / hot_share`` hot keys, so their list is broadcast.
    ``hot_share`` None keeps every key together.  Null keys count as one key
    unless ``spare`` names columns that tell their rows apart.  Columns of
    ``df`` that bear the names in ``out`` are replaced.  An empty table gives
    an empty result; repeated rows go to one slot.
    """
    spark = df.sparkSession
    slot_col, shard_col = out
    base = df.drop(slot_col, shard_col)
    tmp = dict(zip(("hash", "hot", "rows"), free_names(df, "hash", "hot", "rows"), strict=True))
    table = spark.createDataFrame(list(enumerate(fill_table(shards, slots))), f"`{slot_col}` int, at int")
    names = F.array(*[F.lit(s) for s in shards])
    table = table.select(slot_col, names[F.col("at")].alias(shard_col))
    hashed = base.withColumn(tmp["hash"], _key_hash(keys, spare))
    if hot_share is not None:
        total = base.select(F.count("*").alias(tmp["rows"]))
        counts = hashed.groupBy(tmp["hash"]).agg(F.count("*").alias(tmp["hot"]))
        # The threshold is a fraction of a shard, so at most len(shards) / hot_share keys pass it.
        hot = counts.join(F.broadcast(total), F.col(tmp["hot"]) > F.greatest(F.lit(1), F.col(tmp["rows"]) * hot_share / len(shards))).select(tmp["hash"], tmp["hot"])
        spread = [F.col(quoted(c)) for c, kind in base.dtypes if not kind.startswith(("map", "variant"))]
        hashed = hashed.join(F.broadcast(hot), tmp["hash"], "left").withColumn(tmp["hash"], F.when(F.col(tmp["hot"]).isNull(), F.col(tmp["hash"])).otherwise(F.xxhash64(*spread, F.col(tmp["hash"])))).drop(tmp["hot"])
    placed = hashed.withColumn(slot_col, F.pmod(tmp["hash"], F.lit(slots)).cast("int"))
    return placed.join(F.broadcast(table), slot_col, "left").select(*names_of(base), slot_col, shard_col)


def write_shards(df: DataFrame, path: str, shard_col: str = "shard", rows_per_file: int = 1_000_000) -> None:
    """Writes a folder of Parquet files for each shard.

    Rows are rebalanced by shard first, so that a shard comes from few tasks
    while Spark can split a large one; ``rows_per_file`` bounds the files.
    """
    df.hint("rebalance", F.col(shard_col)).write.option("maxRecordsPerFile", rows_per_file).partitionBy(shard_col).mode("errorifexists").parquet(path)
