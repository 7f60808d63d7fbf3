"""Per-item handlers with dead letters.

A handler gets a slot.  ``take()`` commits to the item; an exception before
that makes the item a dead letter with a reason, one after it is only counted.
Errors are caught row by row within an Arrow batch, so a bad row never fails
its task.  Tasks may be retried: handlers must not have effects of their own.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .routing import partitioned

PROCESSED, DEAD, FAILED = "processed", "dead_letter", "failed"


class Slot:
    """Who owns the item: present until it is taken."""

    def __init__(self, item: dict):
        self.item: dict | None = item

    def peek(self) -> dict | None:
        return self.item

    def take(self) -> dict | None:
        item, self.item = self.item, None
        return item


def per_item(fn: Callable[[dict], object]) -> Callable[[Slot], None]:
    """A handler that only looks, so that its items can always be recovered."""
    return lambda slot: fn(slot.peek())


def reason_of(error: BaseException) -> str | None:
    """The message of an error that has one."""
    return str(error.args[0]) if error.args and isinstance(error.args[0], str) else None


def handle(df: DataFrame, handler: Callable[[Slot], None], *, shards: int | None = None, ordinal: str | None = None) -> DataFrame:
    """The rows with status (processed, dead_letter, failed) and reason.  With
    ``shards`` and ``ordinal``, one task a shard sees its rows in order."""
    if shards is not None:
        df = partitioned(df.where(F.col("shard").isNotNull()), shards).sortWithinPartitions("shard", ordinal)
    schema = df.withColumns({"status": F.lit(""), "reason": F.lit(None).cast("string")}).schema

    def run(batches):
        for b in batches:
            status, reason = [], []
            for row in b.to_pylist():
                slot = Slot(row)
                try:
                    handler(slot)
                    status.append(PROCESSED)
                    reason.append(None)
                except Exception as e:  # noqa: BLE001 - the point of a dead letter
                    status.append(DEAD if slot.item is not None else FAILED)
                    reason.append(reason_of(e))
            cols = [*b.columns, pa.array(status, pa.string()), pa.array(reason, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, "status", "reason"])

    return df.mapInArrow(run, schema)


def classify(df: DataFrame, fails: Column, takes: Column | None = None, reason: Column | None = None) -> DataFrame:
    """The same outcome for handlers that are expressions, all native: rows
    that fail are dead letters unless they were taken before."""
    fails = F.coalesce(fails, F.lit(False))
    takes = F.coalesce(takes, F.lit(False)) if takes is not None else F.lit(False)
    return df.withColumns({"status": F.when(fails & takes, FAILED).when(fails, DEAD).otherwise(PROCESSED), "reason": F.when(fails, reason if reason is not None else F.lit(None).cast("string"))})


def dead_letters(handled: DataFrame) -> DataFrame:
    return handled.where(F.col("status") == DEAD)


def counted(handled: DataFrame, name: str = "pool") -> tuple[DataFrame, Observation]:
    """The rows, and counters (processed, handler_panics) that are filled in
    when an action has run over them."""
    seen = Observation(name)
    return handled.observe(seen, F.count(F.when(F.col("status") == PROCESSED, 1)).alias("processed"), F.count(F.when(F.col("status") != PROCESSED, 1)).alias("handler_panics")), seen


def tally(handled: DataFrame) -> dict[str, int]:
    return dict(Counter({r.status: r.n for r in handled.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}))
