"""An elastic pool over a stream: handler, dead letters, counters, scaling, stop.

Rows are handled micro-batch by micro-batch.  A batch that has begun is finished
before a stop takes effect; what was not begun stays in the source and is taken up
by the next pool on the same checkpoint.  Counters are those of finished batches.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import handlers
from ..operators.elastic import PoolConfig
from ..sources.shared import new_path
from .jobs import batch_sink, results


class Stop:
    """A handle that any thread may hold, copy and use, before or after the start."""

    def __init__(self):
        self.asked, self._query, self._lock = threading.Event(), None, threading.Lock()

    def bind(self, query: StreamingQuery) -> None:
        with self._lock:
            self._query = query
        if self.asked.is_set():
            query.stop()

    def stop(self) -> None:
        self.asked.set()
        with self._lock:
            query = self._query
        if query is not None:
            query.stop()


class Pool:
    """``fails``, ``takes`` and ``reason`` are expressions of a native handler;
    ``handler`` is one in Python, of a ``Slot``.  ``dead_letter(rows, batch)`` is
    called with the dead letters of each batch; if it fails itself, that is
    counted and the pool goes on."""

    def __init__(self, stream: DataFrame, config: PoolConfig | None = None, *, handler: Callable | None = None, fails: Column | None = None, takes: Column | None = None, reason: Column | None = None, dead_letter: Callable[[DataFrame, int], None] | None = None, capacity: int = 1024, path: str | None = None, checkpoint: str | None = None):
        self.stream, self.config, self.handler, self.dead_letter, self.capacity = stream, config or PoolConfig(), handler, dead_letter, capacity
        self.native = (fails if fails is not None else F.lit(False), takes, reason)
        self.spark = stream.sparkSession
        self.path, self.checkpoint = path or new_path(self.spark, "pool"), checkpoint or new_path(self.spark, "pool-check")
        self.processed = self.handler_panics = self.dead_letters = self.sink_failures = 0
        self.active, self.trace = self.config.min_consumers, []
        self._stop, self._query, self._seen = Stop(), None, set()

    def handled(self, df: DataFrame) -> DataFrame:
        return handlers.handle(df, self.handler) if self.handler else handlers.classify(df, *self.native)

    def _batch(self, df: DataFrame, batch: int) -> None:
        batch_sink(self.path, self.handled)(df, batch)
        made = self.spark.read.parquet(f"{self.path}/batch={batch}")
        n = handlers.tally(made)
        if self.dead_letter is not None and n.get(handlers.DEAD):
            try:
                self.dead_letter(handlers.dead_letters(made), batch)
            except Exception:  # noqa: BLE001 - a sink that fails must not end the pool
                self.sink_failures += 1
        if batch in self._seen:  # run again after a failure: counted before
            return
        self._seen.add(batch)
        self.processed += n.get(handlers.PROCESSED, 0)
        self.dead_letters += n.get(handlers.DEAD, 0)
        self.handler_panics += n.get(handlers.DEAD, 0) + n.get(handlers.FAILED, 0)
        fill = min(sum(n.values()), self.capacity) / self.capacity
        self.active = self.config.decide(self.active, fill)
        self.trace.append((batch, fill, self.active))

    def start(self, *, drain: bool = True, interval: str = "0 seconds") -> Pool:
        """``drain`` ends by itself once the source is empty; otherwise the pool
        goes on until it is stopped."""
        trigger = {"availableNow": True} if drain else {"processingTime": interval}
        self._query = self.stream.writeStream.foreachBatch(self._batch).option("checkpointLocation", self.checkpoint).trigger(**trigger).start()
        self._stop.bind(self._query)
        return self

    def stop_handle(self) -> Stop:
        return self._stop

    def is_stopped(self) -> bool:
        return self._query is not None and not self._query.isActive

    def wait_stopping(self, seconds: float | None = None) -> bool:
        """Wait until the pool has ended; whether it has, within ``seconds``."""
        ended = self._query.awaitTermination(seconds) if seconds is not None else self._query.awaitTermination()
        return True if ended is None else ended

    def stop_and_wait(self) -> None:
        self._stop.stop()
        self._query.awaitTermination()

    def rows(self) -> DataFrame:
        """All rows handled so far, with status and reason."""
        schema = handlers.classify(self.spark.createDataFrame([], self.stream.schema), F.lit(False)).schema
        return results(self.spark, self.path, schema)
