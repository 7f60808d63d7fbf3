"""Structured Streaming forms of the folds, handlers and lifecycle.

Sinks write a folder a batch and overwrite it on a retry, so that a batch that
is run again after a failure leaves its rows once.
"""

from __future__ import annotations

import heapq
import pickle
import tempfile
import time
from collections.abc import Callable, Iterable, Iterator
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import handlers
from ..operators.apps import HELD, Book
from ..sources.shared import new_path

Sink = Callable[[DataFrame, int], None]


def source(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """Files as a stream.  Files are taken by age, so only a sequence number in
    the rows gives their order."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def in_files(df: DataFrame, ordinal: str, files: int) -> str:
    """Write ``df`` as ``files`` files by ranges of the ordinal; returns the path."""
    path = new_path(df.sparkSession, "stream-in")
    df.repartitionByRange(files, ordinal).write.parquet(path)
    return path


def in_turns(parts: list[DataFrame]) -> str:
    """Write each part as one file, one after the other, so that a stream that
    takes a file at a time gets them in this order; returns the path."""
    path = new_path(parts[0].sparkSession, "stream-in")
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)  # files are taken by age
    return path


def batch_sink(path: str, make: Callable[[DataFrame], DataFrame] = lambda df: df) -> Sink:
    """Idempotent: the folder of a batch is replaced when the batch runs again."""

    def put(df: DataFrame, batch: int) -> None:
        make(df).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return put


def drain(stream: DataFrame, sink: Sink, checkpoint: str) -> None:
    """Process what there is, batch by batch, then end."""
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def results(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of all batches so far; none if no batch has ended yet."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(path)


def fold(stream: DataFrame, partial: Callable[[DataFrame], DataFrame], final: Callable[[DataFrame], DataFrame], schema: str) -> DataFrame:
    """Partial sums of each batch are stored, and folded when read: no state
    grows, and a lost batch is simply summed again."""
    spark = stream.sparkSession
    out, check = new_path(spark, "stream-fold"), new_path(spark, "stream-check")
    drain(stream, batch_sink(out, partial), check)
    return final(results(spark, out, schema))


def start_paced(stream: DataFrame, sink: Sink, checkpoint: str, interval: str = "0 seconds") -> StreamingQuery:
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


def run_until(query: StreamingQuery, batches: int, seconds: float = 300) -> None:
    """Stop a query once ``batches`` batches have ended; the batch that is under
    way may end too, whatever it leaves is taken up after a restart."""
    end = time.monotonic() + seconds
    while time.monotonic() < end and query.isActive:
        seen = query.lastProgress
        if seen is not None and seen["batchId"] + 1 >= batches:
            break
        time.sleep(0.05)
    query.stop()
    query.awaitTermination(30)


def with_dead_letters(stream: DataFrame, handler: Callable, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(processed, dead letters): two sinks of one handler run a batch."""
    spark = stream.sparkSession
    good, dead, check = (new_path(spark, f"stream-{x}") for x in ("good", "dead", "check"))

    def put(df: DataFrame, batch: int) -> None:
        whole = f"{dead}-all/batch={batch}"
        handlers.handle(df.select(*columns), handler).write.mode("overwrite").parquet(whole)
        made = spark.read.parquet(whole)
        batch_sink(good)(made.where(F.col("status") == handlers.PROCESSED), batch)
        batch_sink(dead)(made.where(F.col("status") == handlers.DEAD), batch)

    drain(stream.select(*columns), put, check)
    schema = spark.createDataFrame([], stream.select(*columns).schema).withColumns({"status": F.lit(""), "reason": F.lit(None).cast("string")}).schema
    return results(spark, good, schema), results(spark, dead, schema)


class InOrder(StatefulProcessor):
    """By key: rows so far, the largest ordinal so far, and how many rows came
    after a larger one in an earlier batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("seen", "n long, last long, late long")

    def handleInputRows(self, key, rows, timerValues):
        n, last, late = self.state.get() if self.state.exists() else (0, -(2**62), 0)
        most = last
        for pdf in rows:  # a shuffle keeps no order within a batch
            own = pdf["ordinal"]
            n, late, most = n + len(own), late + int((own < last).sum()), max(most, int(own.max()))
        self.state.update((n, most, late))
        yield pd.DataFrame({"key": [key[0]], "n": [n], "last": [most], "late": [late]})

    def close(self) -> None:
        pass


#: Rows that are sorted at once, of a block on disk, and of a frame of fills.
SORTED, BLOCK, OUTPUT = 200_000, 500, 10_000


def by_ordinal(frames: Iterable[pd.DataFrame], ordinal: str, columns: list[str]) -> Iterator[tuple]:
    """The rows of all frames as tuples, in order.  Beyond ``SORTED`` rows sorted
    runs go to a file of the task and are merged, a block of each at a time."""
    held, n, runs = [], 0, []

    def rows() -> list[tuple]:
        made = pd.concat(held)[columns].sort_values(ordinal, kind="stable")
        return list(zip(*(made[c].tolist() for c in columns)))

    with tempfile.TemporaryFile() as file:

        def read(blocks: list[tuple[int, int]]) -> Iterator[tuple]:
            for at, size in blocks:
                file.seek(at)
                yield from pickle.loads(file.read(size))

        for frame in frames:
            held.append(frame)
            n += len(frame)
            if n >= SORTED:
                made, blocks = rows(), []
                for i in range(0, len(made), BLOCK):
                    blocks.append((file.tell(), file.write(pickle.dumps(made[i : i + BLOCK]))))
                runs.append(blocks)
                held, n = [], 0
        last = rows() if held else []
        held = []
        yield from heapq.merge(*map(read, runs), last, key=itemgetter(columns.index(ordinal)))


class Stored:
    """The chunks of a book as entries of a state map, each read and written alone."""

    def __init__(self, state):
        self.state = state

    def __getitem__(self, key: tuple) -> bytes:
        return self.state.getValue(key)[0]

    def __setitem__(self, key: tuple, value: bytes) -> None:
        self.state.updateValue(key, (value,))

    def __delitem__(self, key: tuple) -> None:
        self.state.removeKey(key)


class Matching(StatefulProcessor):
    """The order book of a symbol; a batch's orders are matched by their ordinal.
    Neither the batch nor the book nor the fills are held whole."""

    def __init__(self, held: int = HELD):
        self.held = held

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("book", "buys binary, sells binary")
        self.stored = Stored(handle.getMapState("orders", "side string, run long, chunk long", "orders binary"))

    def handleInputRows(self, key, rows, timerValues):
        saved = dict(zip("BS", map(bytes, self.state.get()))) if self.state.exists() else None
        book, fills = Book(self.stored, saved, self.held), []
        frame = lambda: pd.DataFrame(fills, columns=["symbol", "taker", "maker", "price", "qty"])
        for ordinal, side, price, qty in by_ordinal(rows, "ordinal", ["ordinal", "side", "price", "qty"]):
            for fill in book.match(int(ordinal), side, float(price), int(qty)):
                fills.append((key[0], *fill))
                if len(fills) >= OUTPUT:
                    yield frame()
                    fills = []
        self.state.update((book.saved()["B"], book.saved()["S"]))
        yield frame()

    def close(self) -> None:
        pass


#: State by key needs this store; ``session`` sets it.
STATE_STORE = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _with_state(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str, label: str) -> DataFrame:
    """All output rows of a stateful processor.  The state store is set while the
    query starts only; the caller's settings stay as they are."""
    spark = rows.sparkSession
    before = spark.conf.get(STATE_STORE[0], None)
    made = rows.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Update", timeMode="None")
    out, check = new_path(spark, label), new_path(spark, "stream-check")
    writer = made.writeStream.outputMode("update").foreachBatch(batch_sink(out)).option("checkpointLocation", check).trigger(availableNow=True)
    spark.conf.set(*STATE_STORE)  # a query copies its settings when it starts
    try:
        query = writer.start()
    finally:
        spark.conf.set(STATE_STORE[0], before) if before else spark.conf.unset(STATE_STORE[0])
    query.awaitTermination()
    return results(spark, out, schema)


def fifo_state(stream: DataFrame, key: str, ordinal: str) -> DataFrame:
    """(key, n, last, late) after all batches, from state kept by key: late are
    rows that came in a later batch than one of their key with a larger ordinal."""
    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(ordinal).cast("long").alias("ordinal"))
    made = _with_state(rows, "key", InOrder(), "key string, n long, last long, late long", "stream-fifo")
    return made.groupBy("key").agg(F.max_by("last", "n").alias("last"), F.max_by("late", "n").alias("late"), F.max("n").alias("n")).select("key", "n", "last", "late")


def matching(orders: DataFrame, held: int = HELD) -> DataFrame:
    """The fills of a stream of orders (symbol, ordinal, side, price, qty); of each
    side of a book some ``held`` orders are in memory."""
    return _with_state(orders, "symbol", Matching(held), "symbol string, taker long, maker long, price double, qty long", "stream-fills")
