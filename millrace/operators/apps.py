"""What users compute with keyed streams: risk limits, matching, event routing."""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import key_shard
from ..functions.ordinals import fresh, running_sum, with_position
from .folds import arrow_schema
from .routing import partitioned


#: Output rows of a stateful step that are held.
OUTPUT = 10_000


def risk_filter(df: DataFrame, key: str, ordinal: str, amount: Column, limit: int) -> DataFrame:
    """Adds exposure, the key's running sum, and accepted (within the limit)."""
    return running_sum(df, ordinal, [key], amount, "exposure").withColumn("accepted", F.col("exposure") <= limit)


def keyed_state(df: DataFrame, key: str, ordinal: str, shards: int, start: Callable[[], dict], step: Callable[[dict, dict], Iterator[dict]], schema: str) -> DataFrame:
    """Mutable state by key: ``step(state, row)`` yields any number of output
    rows.  Rows are dealt by key and stream in order through their task, which
    holds one key's state and at most ``OUTPUT`` output rows at a time."""
    ordered = partitioned(df.withColumn("shard", key_shard(F.col(key), shards, "native")).where(F.col("shard").isNotNull()), shards).sortWithinPartitions(key, ordinal)
    kinds = arrow_schema(schema)

    def run(batches):
        now, state = None, None
        for b in batches:
            out = []
            for row in b.to_pylist():
                if state is None or row[key] != now:
                    now, state = row[key], start()
                for made in step(state, row):
                    out.append(made)
                    if len(out) >= OUTPUT:
                        yield pa.RecordBatch.from_pylist(out, kinds)
                        out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, kinds)

    return ordered.mapInArrow(run, schema)


#: Resting orders of a side that are held besides what is stored.
HELD = 1 << 14


class Side:
    """Resting orders, best price first, then oldest.  The best are in a heap; beyond
    ``held`` its worse half goes, as a sorted run of chunks, to ``store``, and the
    heap keeps the first of each run: (rank, ordinal, qty, run), run 0 being its own."""

    def __init__(self, store, name: str, saved: bytes | None = None, held: int = HELD):
        self.store, self.name, self.held, self.loaded = store, name, held, {}
        # runs: by number [chunk, place in it, chunks] of the order after that in the heap.
        self.heap, self.own, self.runs, self.last = pickle.loads(saved) if saved else ([], 0, {}, 0)

    def saved(self) -> bytes:
        return pickle.dumps((self.heap, self.own, self.runs, self.last))

    def push(self, rank, ordinal: int, qty: int) -> None:
        heapq.heappush(self.heap, (rank, ordinal, qty, 0))
        self.own += 1
        if self.own > self.held:
            self._store_half()

    def _store_half(self) -> None:
        own = sorted(o for o in self.heap if not o[3])
        keep, out = own[: self.held // 2], own[self.held // 2 :]
        self.last += 1
        rest = [o[:3] for o in out[1:]]
        size = -(-self.held // 16)
        chunks = [rest[i : i + size] for i in range(0, len(rest), size)]
        for i, chunk in enumerate(chunks):
            self.store[self.name, self.last, i] = pickle.dumps(chunk)
        self.heap = keep + [o for o in self.heap if o[3]] + [(*out[0][:3], self.last)]
        heapq.heapify(self.heap)
        self.own, self.runs[self.last] = len(keep), [0, 0, len(chunks)]

    def use(self, n: int) -> None:
        """Take ``n`` of the best order; what is left of it stays where it is."""
        rank, ordinal, qty, run = self.heap[0]
        if n != qty:
            heapq.heapreplace(self.heap, (rank, ordinal, qty - n, run))
        elif not run:
            heapq.heappop(self.heap)
            self.own -= 1
        elif (after := self._next(run)) is None:
            heapq.heappop(self.heap)
        else:
            heapq.heapreplace(self.heap, (*after, run))

    def _next(self, run: int) -> tuple | None:
        chunk, at, chunks = self.runs[run]
        if chunk == chunks:
            del self.runs[run]
            return None
        if run not in self.loaded:
            self.loaded[run] = pickle.loads(self.store[self.name, run, chunk])
        orders = self.loaded[run]
        self.runs[run] = [chunk, at + 1, chunks]
        if at + 1 == len(orders):
            del self.loaded[run], self.store[self.name, run, chunk]
            self.runs[run] = [chunk + 1, 0, chunks]
        return orders[at]


class Book:
    """The resting orders of a symbol.  ``store`` maps (side, run, chunk) to bytes;
    it has what doesn't fit the heaps, so a book of any size holds few orders itself."""

    def __init__(self, store=None, saved: dict[str, bytes] | None = None, held: int = HELD):
        store = {} if store is None else store
        self.sides = {s: Side(store, s, (saved or {}).get(s), held) for s in "BS"}

    def saved(self) -> dict[str, bytes]:
        return {s: side.saved() for s, side in self.sides.items()}

    def match(self, ordinal: int, side: str, price: float, qty: int) -> Iterator[tuple]:
        """Yield (taker, maker, price, qty) for each fill; what is left rests."""
        other, sign = self.sides["S" if side == "B" else "B"], 1 if side == "B" else -1
        while qty and other.heap and other.heap[0][0] <= sign * price:
            rank, maker, resting, _ = other.heap[0]
            n = min(qty, resting)
            qty -= n
            yield ordinal, maker, sign * rank, n
            other.use(n)
        if qty:
            self.sides[side].push(-sign * price, ordinal, qty)


def matching_engine(orders: DataFrame, *, key: str = "symbol", ordinal: str = "ordinal", shards: int = 8) -> DataFrame:
    """Orders (symbol, ordinal, side 'B' or 'S', price, qty) matched by price and
    time: (symbol, taker, maker, price, qty), one row a fill."""

    def step(book: Book, o: dict):
        for fill in book.match(o[ordinal], o["side"], o["price"], o["qty"]):
            yield dict(zip((key, "taker", "maker", "price", "qty"), (o[key], *fill)))

    return keyed_state(orders, key, ordinal, shards, Book, step, f"{key} string, taker long, maker long, price double, qty long")


def event_router(df: DataFrame, kind: str, ordinal: str, kinds: int, notifiers: int) -> DataFrame:
    """Adds shard, by the event's type (up to 16 bytes), and notifier, dealt in
    rotation within it."""
    typed = df.withColumn("shard", key_shard(F.col(kind), kinds, "short"))
    (at,) = fresh(typed, "at")
    made = with_position(typed, ordinal, ["shard"], at)
    return made.withColumn("notifier", ((F.col(at) - 1) % notifiers).cast("int")).drop(at)


#: The first trade's time and the ids between two producers.
TRADE_TIME, PRODUCER_STRIDE = 1672515782136, 1_000_000


def trades(ids: DataFrame, symbols: list[str], producers: int, per_producer: int) -> DataFrame:
    """Benchmark trades of (id): each producer deals the symbols in rotation."""
    names = F.array(*[F.lit(s) for s in symbols])
    p, i = F.floor(F.col("id") / per_producer), F.col("id") % per_producer
    at = ((p * PRODUCER_STRIDE + i) % len(symbols) + 1).cast("int")
    time = (F.lit(TRADE_TIME) + i).cast("long")
    return ids.select(p.cast("int").alias("producer"), F.lit("trade").alias("e"), time.alias("event_time"), F.element_at(names, at).alias("s"), i.cast("long").alias("t"), F.lit("0.001").alias("p"), F.lit("100").alias("q"), time.alias("trade_time"), (i % 2 == 0).alias("m"), F.lit(True).alias("_m"))
