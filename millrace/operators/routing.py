"""Routing: a shard id for each row, and exchanges in which shard = partition."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import key_shard, pow2
from ..functions.ordinals import frame_of, fresh, with_position

#: Route tables up to this many keys are broadcast; larger ones are joined.
BROADCAST_ROUTES = 100_000


def by_key(df: DataFrame, key: str, shards: int, mode: str = "parity") -> DataFrame:
    """Same key, same shard; shard counts are rounded up to a power of two."""
    return df.withColumn("shard", key_shard(F.col(key), shards, mode))


def round_robin(df: DataFrame, ordinal: str, shards: int, start: int = 0) -> DataFrame:
    """The cursor starts at ``start`` and advances by one a row, in ordinal order."""
    (at,) = fresh(df, "at")
    made = with_position(df, ordinal, name=at)
    return made.withColumn("shard", (F.col(at) - 1 + start).bitwiseAND(F.lit(pow2(shards) - 1).cast("long")).cast("int")).drop(at)


def round_robin_producers(df: DataFrame, ordinal: str, producer: str, shards: int) -> DataFrame:
    """Each producer has a cursor of its own, which starts at its number: a
    clone takes the value of its parent's cursor as its start."""
    (at,) = fresh(df, "at")
    made = with_position(df, ordinal, [producer], at)
    return made.withColumn("shard", (F.col(at) - 1 + F.col(producer)).bitwiseAND(F.lit(pow2(shards) - 1).cast("long")).cast("int")).drop(at)


def round_robin_batches(df: DataFrame, ordinal: str, shards: int, batch: int) -> DataFrame:
    """A whole batch goes to one shard: one tick of the cursor a batch."""
    (at,) = fresh(df, "at")
    made = with_position(df, ordinal, name=at).withColumn("batch", frame_of(F.col(at), batch))
    return made.withColumn("shard", F.col("batch").bitwiseAND(F.lit(pow2(shards) - 1).cast("long")).cast("int")).drop(at)


def spread_evenly(df: DataFrame, shards: int) -> DataFrame:
    """Rows dealt over as many partitions, order not kept: for work, not for shards."""
    return df.repartition(pow2(shards))


@dataclass(frozen=True)
class Routes:
    """An explicit map from key to shard among ``shards`` (a power of two)."""

    shard_of: dict[str, int] = field(default_factory=dict)
    shards: int = 1

    @classmethod
    def from_groups(cls, groups: list[list[str]]) -> Routes:
        """Group i is shard i; of a key in two groups the last one counts."""
        return cls({k: i for i, own in enumerate(groups) for k in own}, pow2(max(len(groups), 1)))

    @classmethod
    def from_map(cls, group_of: dict[str, int], groups: int) -> Routes:
        n = pow2(max(groups, 1))
        return cls({k: g % n for k, g in group_of.items()}, n)

    def handle(self, key: str) -> int | None:
        """The shard of a key, or None where it isn't registered."""
        return self.shard_of.get(key)

    def __len__(self) -> int:
        return len(self.shard_of)

    def table(self, spark: SparkSession, key: str = "route_key", shard: str = "route_shard") -> DataFrame:
        rows = spark.createDataFrame(sorted(self.shard_of.items()), f"`{key}` string, `{shard}` int")
        return F.broadcast(rows) if len(self) <= BROADCAST_ROUTES else rows


def by_group(df: DataFrame, key: str, routes: Routes) -> DataFrame:
    """Adds ``shard``, null for keys that aren't registered."""
    name, shard = fresh(df, "route_key", "route_shard")
    table = routes.table(df.sparkSession, name, shard)
    return df.join(table, df[key] == table[name], "left").withColumn("shard", F.col(shard)).drop(name, shard)


def unused(df: DataFrame, key: str, routes: Routes) -> DataFrame:
    """The rows whose key isn't registered, null keys included."""
    (name,) = fresh(df, "route_key")
    table = routes.table(df.sparkSession, name, "route_shard")
    return df.join(table, df[key] == table[name], "left_anti")


def static(df: DataFrame, shard: Column, shards: int) -> DataFrame:
    """The caller's own shard numbers, any ``shards`` above 0; a number is taken
    modulo the count, never refused."""
    if shards < 1:
        raise ValueError("at least one shard")
    return df.withColumn("shard", F.pmod(shard.cast("long"), F.lit(shards)).cast("int"))


def partitioned(df: DataFrame, shards: int) -> DataFrame:
    """An exchange after which shard i is partition i, whole."""
    return df.repartitionById(shards, "shard")


def all_shards(spark: SparkSession, shards: int) -> DataFrame:
    """One row a shard: padding and idle shards exist too."""
    return spark.range(shards).select(F.col("id").cast("int").alias("shard"))


class Pairs:
    """Shards of a routed table handed out one by one, each at most once."""

    def __init__(self, df: DataFrame, shards: int):
        self.df, self.shards, self.left = df, shards, dict.fromkeys(range(shards))

    def take(self, shard: int) -> DataFrame | None:
        """The rows of a shard, or None if it is taken or out of range."""
        if shard not in self.left:
            return None
        del self.left[shard]
        return self.df.where(F.col("shard") == shard)

    def wrapped(self) -> list[tuple[int, DataFrame, DataFrame]]:
        """(shard, what was sent to it, what is received from it) of all shards not
        yet taken; both ends carry the shard's number in their column ``shard``."""
        return [(i, rows, rows) for i, rows in self.rest()]

    def rest(self) -> list[tuple[int, DataFrame]]:
        """All shards not yet taken."""
        return [(i, self.take(i)) for i in list(self.left)]

    def remaining(self) -> list[int]:
        return list(self.left)

    def is_empty(self) -> bool:
        """Whether all shards are taken; it says nothing about rows."""
        return not self.left


def skew(df: DataFrame, spark: SparkSession, shards: int) -> DataFrame:
    """(max_rows, avg_rows, empty_shards, shards) of a routed table."""
    counts = df.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    own = all_shards(spark, shards).join(counts, "shard", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return own.agg(F.max("n").alias("max_rows"), F.avg("n").alias("avg_rows"), F.sum((F.col("n") == 0).cast("long")).alias("empty_shards"), F.count(F.lit(1)).alias("shards"))
