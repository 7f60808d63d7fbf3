"""Folds over drained shards."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .receive import framed
from .routing import partitioned


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow types that Spark expects for a schema."""
    return to_arrow_schema(StructType.fromDDL(ddl))


def drain(df: DataFrame, *aggs: Column) -> DataFrame:
    """Aggregates by shard; order doesn't matter, so partial sums go first."""
    return df.groupBy("shard").agg(*aggs)


def drain_frames(df: DataFrame, ordinal: str, size: int, frame_aggs: list[Column], final_aggs: list[Column]) -> DataFrame:
    """A sink that sees whole frames: ``frame_aggs`` by frame, then
    ``final_aggs`` over the frames of a shard."""
    return framed(df, ordinal, size).groupBy("shard", "frame").agg(*frame_aggs).groupBy("shard").agg(*final_aggs)


def affine_fold(df: DataFrame, by: str, ordinal: str, value: Column, *, mul: int, mod: int, start: int, width: int = 1 << 14) -> DataFrame:
    """(by, h, n): h := (h * mul + value) mod ``mod`` over a group's rows in order.

    Such steps compose, so a group is folded by stretches of ``width`` ordinals,
    whose results are then composed: no task holds more than a stretch of a
    group, or one row a stretch."""
    rows = df.select(F.col(by), F.col(ordinal).alias("_o"), value.cast("long").alias("_v"), F.floor(F.col(ordinal) / width).alias("_b"))
    first = rows.groupBy(by, "_b").agg(F.array_sort(F.collect_list(F.struct("_o", "_v"))).alias("xs"))
    pair = lambda a, b: F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    step = lambda s, x: pair(s["a"] * mul % mod, (s["b"] * mul + x["_v"]) % mod)
    parts = first.select(by, "_b", F.size("xs").cast("long").alias("m"), F.aggregate("xs", pair(F.lit(1), F.lit(0)), step).alias("f"))
    whole = parts.groupBy(by).agg(F.sum("m").alias("n"), F.array_sort(F.collect_list(F.struct("_b", "f"))).alias("fs"))
    compose = lambda h, x: (h * x["f"]["a"] + x["f"]["b"]) % mod
    return whole.select(by, F.aggregate("fs", F.lit(start).cast("long"), compose).alias("h"), "n")


def drain_in_order(df: DataFrame, shards: int, ordinal: str, start: Callable[[], object], step: Callable, finish: Callable, schema: str) -> DataFrame:
    """Any sequential fold: ``step(state, row)`` over each shard's rows in order,
    then ``finish(shard, state)`` gives its output row.  Rows stream through one
    task a shard; only the state is held, however long the shard is."""
    kinds = arrow_schema(schema)
    ordered = partitioned(df.where(F.col("shard").isNotNull()), shards).sortWithinPartitions("shard", ordinal)

    def run(batches):
        shard, state = None, None
        for b in batches:
            for row in b.to_pylist():
                if shard is None or row["shard"] != shard:
                    if shard is not None:
                        yield pa.RecordBatch.from_pylist([dict(zip(kinds.names, finish(shard, state)))], kinds)
                    shard, state = row["shard"], start()
                state = step(state, row)
        if shard is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(kinds.names, finish(shard, state)))], kinds)

    return ordered.mapInArrow(run, schema)


def drain_batches(df: DataFrame, shards: int, ordinal: str, size: int, sink: Callable[[int, pa.Table], dict], schema: str) -> DataFrame:
    """``sink(shard, table)`` is called with each frame of a shard, in order, as
    an Arrow table of ``size`` rows (fewer in the last), and returns a row."""
    kinds = arrow_schema(schema)
    ordered = partitioned(df.where(F.col("shard").isNotNull()), shards).sortWithinPartitions("shard", ordinal)

    def run(batches):
        shard, held, n = None, [], 0

        def calls(last: bool):
            nonlocal held, n
            table = pa.Table.from_batches(held) if held else None
            at = 0
            while table is not None and (n - at >= size or last and n > at):
                yield pa.RecordBatch.from_pylist([sink(shard, table.slice(at, size))], kinds)
                at += size
            rest = table.slice(min(at, n)) if table is not None else None
            held, n = (rest.to_batches(), rest.num_rows) if rest is not None else ([], 0)

        for b in batches:
            ids = b.column("shard").to_pylist()
            at = 0
            while at < len(ids):
                end = at
                while end < len(ids) and ids[end] == ids[at]:
                    end += 1
                if shard is not None and ids[at] != shard:
                    yield from calls(True)
                shard = ids[at]
                held.append(b.slice(at, end - at))
                n += end - at
                yield from calls(False)
                at = end
        yield from calls(True)

    return ordered.mapInArrow(run, schema)
