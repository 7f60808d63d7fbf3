"""Channels as values: how rows are routed, over how many shards, with what room.

A channel holds no rows; it says how a DataFrame's rows are dealt and admitted.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import pow2
from . import admission, routing

ROTATION, KEY, GROUP, OWN = "rotation", "key", "group", "own"


@dataclass(frozen=True)
class Channel:
    """``kind`` routes: rotation, key, group (by ``routes``) or own shard numbers."""

    kind: str
    shards: int
    capacity: int
    routes: routing.Routes = field(default_factory=routing.Routes)

    def route(self, df: DataFrame, ordinal: str, key: str | Column | None = None, mode: str = "parity") -> DataFrame:
        if self.kind == ROTATION:
            return routing.round_robin(df, ordinal, self.shards)
        if self.kind == KEY:
            return routing.by_key(df, key, self.shards, mode)
        if self.kind == GROUP:
            return routing.by_group(df, key, self.routes)
        return routing.static(df, F.col(key) if isinstance(key, str) else key, self.shards)

    def try_send(self, df: DataFrame, ordinal: str, key: str | Column | None = None, **options) -> DataFrame:
        return admission.try_send(self.route(df, ordinal, key), ordinal, self.capacity, **options)

    def try_send_batch(self, df: DataFrame, ordinal: str, key: str | Column | None = None, **options) -> DataFrame:
        return admission.try_send_batch(self.route(df, ordinal, key), ordinal, self.capacity, **options)


def shared(spark: SparkSession, capacity: int, kind: str = ROTATION, shards: int | None = None, routes: routing.Routes | None = None) -> Channel:
    """Any number of producers: shards, by default as many as the cluster has
    cores, and capacity are rounded up to powers of two; a group has as many
    shards as its routes."""
    if kind == GROUP:
        return Channel(kind, routes.shards, pow2(capacity), routes)
    if kind not in (ROTATION, KEY):
        raise ValueError("kind is rotation, key or group")
    return Channel(kind, pow2(shards or spark.sparkContext.defaultParallelism), pow2(capacity))


def single(spark: SparkSession, capacity: int, shards: int | None = None) -> Channel:
    """One producer a shard: the number of shards stays as it is, capacity is rounded."""
    n = spark.sparkContext.defaultParallelism if shards is None else shards
    if n < 1:
        raise ValueError("at least one shard")
    return Channel(OWN, n, pow2(capacity))
