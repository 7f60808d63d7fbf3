"""Elastic pool decisions: how many workers are active, and who owns a shard."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written


@dataclass(frozen=True)
class PoolConfig:
    """Bounds and thresholds; fill levels are between 0 and 1."""

    min_consumers: int = 1
    max_consumers: int = 8
    scale_up: float = 0.80
    scale_down: float = 0.20
    sample_ms: int = 100
    batch_size: int = 64

    def __post_init__(self):
        if self.min_consumers < 1:
            object.__setattr__(self, "min_consumers", 1)
        if self.max_consumers < self.min_consumers:
            object.__setattr__(self, "max_consumers", self.min_consumers)

    def but(self, **changes) -> PoolConfig:
        return replace(self, **changes)

    def decide(self, current: int, fill: float) -> int:
        """Above the upper threshold the pool jumps to the share of its maximum
        that the fill asks for; below the lower one it gives up one worker."""
        if fill > self.scale_up:
            return min(max(math.ceil(fill * self.max_consumers), current), self.max_consumers)
        return max(current - 1, self.min_consumers) if fill < self.scale_down else current

    def decide_expr(self, current: Column, fill: Column) -> Column:
        up = F.least(F.greatest(F.ceil(fill * F.lit(self.max_consumers)).cast("int"), current), F.lit(self.max_consumers))
        down = F.greatest(current - 1, F.lit(self.min_consumers))
        return F.when(fill > F.lit(float(self.scale_up)), up).when(fill < F.lit(float(self.scale_down)), down).otherwise(current).cast("int")


def fill_ratio(queues: DataFrame, by: str, queued: str, capacity: int) -> DataFrame:
    """(by, fill): queued rows, at most ``capacity`` of a queue, over all room."""
    room = F.count(F.lit(1)) * F.lit(capacity)
    return queues.groupBy(by).agg((F.sum(F.least(F.col(queued), F.lit(capacity))).cast("double") / room.cast("double")).alias("fill"))


def trace(samples: DataFrame, step: str, fill: str, config: PoolConfig, start: int | None = None, stretch: int = 1 << 16, group: int = 1024) -> DataFrame:
    """(step, fill, active): the pool's size after each sample; ``step`` counts
    from 0 without gaps.

    A stretch of samples maps each possible size to another.  These maps are made
    side by side, composed by groups, the groups' maps by groups again, and so on
    until one group is left; sizes are then handed down the same way.  A task sees
    one stretch of samples, or ``group`` maps."""
    low, high = config.min_consumers, config.max_consumers
    start = low if start is None else start
    sizes = np.arange(low, high + 1)
    rows = samples.select(F.col(step).cast("long").alias("step"), F.col(fill).cast("double").alias("fill")).withColumn("b", F.floor(F.col("step") / stretch))

    def decide(now: np.ndarray, x: float) -> np.ndarray:
        if x > config.scale_up:
            return np.minimum(np.maximum(math.ceil(x * high), now), high)
        return np.maximum(now - 1, low) if x < config.scale_down else now

    def walk(now: np.ndarray, fills: np.ndarray):
        """Sizes after each sample; a stretch of samples that ask for nothing is one step."""
        out = np.empty((len(fills), len(now)), np.int64)
        asks = np.flatnonzero((fills > config.scale_up) | (fills < config.scale_down))
        at = 0
        for k in asks.tolist():
            out[at:k] = now
            now, at = decide(now, fills[k]), k + 1
            out[k] = now
        out[at:] = now
        return out

    def map_of(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        last = walk(sizes, table.sort_by("step").column("fill").to_numpy())[-1]
        return pa.table({"b": pa.array([key[0].as_py()], pa.int64()), "to": pa.array([last], pa.list_(pa.int64()))})

    def composed(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        now = sizes
        for to in table.sort_by("b").column("to").to_pylist():
            now = np.array(to)[now - low]
        return pa.table({"b": pa.array([key[0].as_py()], pa.int64()), "to": pa.array([now], pa.list_(pa.int64()))})

    def handed(table: pa.Table, first: int) -> pa.Table:
        """The size with which each map's stretch begins, from that of the first."""
        table, out = table.sort_by("b"), []
        for to in table.column("to").to_pylist():
            out.append(first)
            first = to[first - low]
        return pa.table({"b": table.column("b"), "cur": pa.array(out, pa.int64())})

    def top(table: pa.Table) -> pa.Table:
        return handed(table, start)

    def below(table: pa.Table) -> pa.Table:
        return handed(table, table.column("cur")[0].as_py())

    levels = [written(rows.groupBy("b").applyInArrow(map_of, "b long, to array<long>"), "maps")]
    while levels[-1].count() > group:
        levels.append(written(levels[-1].withColumn("g", F.floor(F.col("b") / group)).groupBy("g").applyInArrow(composed, "b long, to array<long>"), "maps"))
    starts = levels[-1].withColumn("g", F.lit(0)).groupBy("g").applyInArrow(top, "b long, cur long")
    for maps in reversed(levels[:-1]):
        mapped = maps.withColumn("g", F.floor(F.col("b") / group)).join(starts.select(F.col("b").alias("g"), "cur"), "g")
        starts = mapped.groupBy("g").applyInArrow(below, "b long, cur long")

    def sized(table: pa.Table) -> pa.Table:
        table = table.sort_by("step")
        fills, cur = table.column("fill").to_numpy(), table.column("cur")[0].as_py()
        return pa.table({"step": table.column("step"), "fill": table.column("fill"), "active": pa.array(walk(np.array([cur]), fills)[:, 0].astype(np.int32))})

    return rows.join(starts, "b").groupBy("b").applyInArrow(sized, "step long, fill double, active int")


def ownership(sizes: DataFrame, shards: int, active: str = "active") -> DataFrame:
    """Each row for each shard, with the worker that owns it."""
    ids = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    return sizes.withColumn("shard", ids).withColumn("owner", (F.col("shard") % F.greatest(F.col(active), F.lit(1))).cast("int"))
