"""Token ids in binary files: an adaptive context-mixing range coder.

A block codes its ids as many streams in step, so that each numpy operation
serves one id of every stream.  All streams of a block share one adaptive
model, updated after each step:

* order 2: the id that last followed a hash of the two ids before, with a
  confidence of 0 to 3;
* order 1: the id that last followed the id before, likewise;
* order 0: counts of all ids so far.

The pair of confidences (and whether both name one id) is the mixing context.
In each context adaptive counts weigh the three predictions: order 2 and order 1
give their weight to the id they name, order 0 spreads its own over all ids by
their counts, scaled to a power of two so that coding needs no division.  A
64-bit range coder with carries turns the intervals into 32-bit words, one
stretch a stream.  Nothing is carried from block to block, and each block holds a
CRC of its header, of its payload and of its ids, so blocks are decoded (and
damage is found) alone.

A task holds one block at a time.  A block is of whole documents, so a document
of more than ``block_ids`` ids is a block of its own, some 40 bytes an id.

Files are Parquet with a row per block: (part, block, first, doc_ids, lengths,
n_ids, ids_crc32, payload); parts and blocks ascend with doc_id.  Parquet is the
container because Spark's writers commit it safely and any store can hold it.

Defined results: null text counts as empty (the end id alone); null doc_ids
come first; repeated rows are written as often as they come; an empty table
writes no block; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import grouped, id_text, map_arrow
from .vocab import library_encoder

STREAMS, STEPS, BLOCK_IDS = 8192, 256, 1 << 21
_HEAD, _CRC = struct.Struct("<4sIIIIII"), struct.Struct("<I")  # magic, ids, vocabulary, streams, crc of ids, crc and size of payload; crc of these
_HASH_BITS, _GAIN, _ORDER0_BITS, _FIND_BITS = 18, 32, 22, 16
MOST_IDS = 1 << 21
#: What becomes of a confidence, by confidence * 2 + right.
_STEPS_OF = np.array([0, 1, -1, 1, -1, 1, -1, 0], np.int32)
_U = np.uint64
_LOW32 = _U(0xFFFFFFFF)


class BlockError(ValueError):
    """A block's bytes don't match their checksum."""


class _Model:
    """What the order-1 and order-2 tables predict is kept as id * 4 + confidence.

    ``start`` and ``size`` are the intervals, in 256ths, that a mixing context
    gives to each outcome: 0 for neither, 1 for order 1, 2 or 3 for order 2."""

    def __init__(self, vocab: int, streams: int):
        self.vocab = vocab
        self.table1, self.table2 = np.zeros(vocab, np.int32), np.zeros(1 << _HASH_BITS, np.int32)
        self.counts, self.new = np.ones(vocab, np.int64), []
        self.cum, self.size0 = np.zeros(vocab + 2, np.uint64), np.zeros(vocab + 1, np.uint64)
        # An outcome that is right needs no order 0: its place takes all of it.
        self.first0, self.size0[vocab] = np.zeros(vocab + 1, np.uint64), 1 << _ORDER0_BITS
        self.places = np.arange(vocab + 1)
        self.outcomes = np.tile(np.array([4, 2, 1, 1], np.int64), (32, 1))
        self.prev, self.mixed = np.zeros(streams, np.int64), np.zeros(streams, np.int64)
        self.outcomes_new = np.zeros(128, np.int64)
        self.step = 0

    def fresh(self) -> bool:
        """Whether the counts are taken in before this step: often at first."""
        return self.step < 8 or self.step % (8 if self.step < 64 else 16) == 0

    def predict(self):
        if self.fresh():
            self._settle()
        self.at2 = (self.mixed ^ self.prev * 0x85EBCA6B) >> 14 & (1 << _HASH_BITS) - 1
        self.v2, self.v1 = self.table2.take(self.at2), self.table1.take(self.prev)
        self.p2, self.p1 = self.v2 >> 2, self.v1 >> 2
        self.sure2, self.sure1 = self.v2 & 3, self.v1 & 3
        context = self.sure2 << 2
        context |= self.sure1
        context |= np.left_shift(self.p1 == self.p2, 4, dtype=np.int32)
        self.context = context.astype(np.int64)

    def _settle(self):
        if self.new:
            self.counts += _GAIN * np.bincount(np.concatenate(self.new), minlength=self.vocab)
            self.new = []
        # Multiplying and rounding down is the same on every machine that keeps IEEE 754.
        total = np.cumsum(self.counts)
        scaled = total * (((1 << _ORDER0_BITS) - self.vocab - 1) / float(total[-1]))
        self.cum[1 : self.vocab + 1] = scaled.astype(np.int64) + self.places[1:]
        self.first0[:-1] = self.cum[: self.vocab]
        np.subtract(self.cum[1 : self.vocab + 1], self.cum[: self.vocab], out=self.size0[: self.vocab])
        self.outcomes += self.outcomes_new.reshape(32, 4)
        self.outcomes_new[:] = 0
        n = self.outcomes.copy()
        n[:, 2] += n[:, 3]
        part = n[:, :3] * 253 // n[:, :3].sum(1, keepdims=True) + 1
        part[:, 0] += 256 - part.sum(1)
        two, one = part[:, 2], part[:, 1]
        self.two, self.one = two.astype(np.uint64), (two + one).astype(np.uint64)
        zero = np.zeros_like(two)
        self.start = np.stack([two + one, two, zero, zero], 1).astype(np.uint64).reshape(-1)
        self.size = np.stack([part[:, 0], one, two, two], 1).astype(np.uint64).reshape(-1)

    def update(self, ids, outcome, right2, right1):
        self.outcomes_new += np.bincount(outcome, minlength=128)
        fresh = np.left_shift(ids, 2, dtype=np.int32, casting="unsafe")
        for right, sure, old, table, at in ((right2, self.sure2, self.v2, self.table2, self.at2), (right1, self.sure1, self.v1, self.table1, self.prev)):
            sure <<= 1
            sure += right
            old += _STEPS_OF.take(sure)
            np.copyto(old, fresh, where=sure == 0)  # wrong, and was not sure before
            table[at] = old
        self.new.append(ids)
        self.mixed, self.prev = self.prev * 0x9E3779B1, ids
        self.step += 1


class _Writer:
    def __init__(self, streams: int, steps: int):
        self.low, self.range = np.zeros(streams, np.uint64), np.full(streams, 0xFFFFFFFFFFFFFFFF, np.uint64)
        self.words, self.n = np.zeros((streams, steps + 4), np.uint32), np.zeros(streams, np.int64)

    def code(self, start, size, start0, size0):
        """Narrow each stream to an outcome's 256ths, and in these to order 0's part."""
        unit = self.range >> _U(8)
        start *= unit
        unit *= size
        unit >>= _U(_ORDER0_BITS)
        start0 *= unit
        start += start0
        unit *= size0
        self.range = unit
        self.low += start
        carried = self.low < start
        if carried.any():
            rows = np.flatnonzero(carried)
            place = self.n[rows] - 1
            while len(rows):
                self.words[rows, place] += np.uint32(1)
                more = self.words[rows, place] == 0
                rows, place = rows[more], place[more] - 1
        short = np.flatnonzero(unit < _U(1 << 32))
        if len(short):
            low, n = self.low.take(short), self.n.take(short)
            self.words[short, n] = low >> _U(32)
            self.n[short] = n + 1
            self.low[short] = low << _U(32)
            unit[short] = unit.take(short) << _U(32)

    def end(self) -> bytes:
        rows = np.arange(len(self.n))
        self.words[rows, self.n] = (self.low >> _U(32)).astype(np.uint32)
        self.words[rows, self.n + 1] = (self.low & _LOW32).astype(np.uint32)
        self.n += 2
        keep = np.arange(self.words.shape[1])[None] < self.n[:, None]
        return self.n.astype("<u4").tobytes() + self.words[keep].astype("<u4").tobytes()


def encode_block(ids: np.ndarray) -> bytes:
    """Bytes of any number of ids below 2**21, by streams of consecutive ids."""
    n, vocab = len(ids), int(ids.max(initial=0)) + 1
    if vocab > MOST_IDS:
        raise ValueError(f"an id is {MOST_IDS} or more")
    streams = max(1, min(STREAMS, -(-n // STEPS)))
    steps = -(-n // streams)
    crc = zlib.crc32(ids.astype("<u4").tobytes())
    table = np.zeros((streams, steps), np.uint32)
    table.reshape(-1)[:n] = ids
    by_step = np.ascontiguousarray(table.T)
    model, out = _Model(vocab, streams), _Writer(streams, steps)
    for step in range(steps if n else 0):
        own = by_step[step].astype(np.int64)
        model.predict()
        right2, right1 = own == model.p2, own == model.p1
        outcome = model.context << 2
        outcome += right1
        outcome += np.left_shift(right2, 1, dtype=np.int64)
        place = np.where(right1 | right2, vocab, own)
        out.code(model.start.take(outcome), model.size.take(outcome), model.first0.take(place), model.size0.take(place))
        model.update(own, outcome, right2, right1)
    body = out.end() if n else b""
    head = _HEAD.pack(b"MRC2", n, vocab, streams, crc, zlib.crc32(body), len(body))
    return head + _CRC.pack(zlib.crc32(head)) + body


def decode_block(data: bytes) -> np.ndarray:
    """The ids of ``encode_block``; BlockError if a checksum doesn't hold."""
    if len(data) < _HEAD.size + _CRC.size or zlib.crc32(data[: _HEAD.size]) != _CRC.unpack_from(data, _HEAD.size)[0]:
        raise BlockError("the header is damaged")
    magic, n, vocab, streams, crc, body_crc, size = _HEAD.unpack_from(data)
    body = memoryview(data)[_HEAD.size + _CRC.size :]
    if magic != b"MRC2" or len(body) != size or zlib.crc32(body) != body_crc:
        raise BlockError("the payload is damaged")
    if not n:
        return np.zeros(0, np.uint32)
    steps = -(-n // streams)
    lengths = np.frombuffer(body, "<u4", streams).astype(np.int64)
    words = np.concatenate([np.frombuffer(body, "<u4", offset=4 * streams), np.zeros(2, np.uint32)]).astype(np.uint64)
    at = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    off = words[at] << _U(32) | words[at + 1]
    at = at + 2
    width = np.full(streams, 0xFFFFFFFFFFFFFFFF, np.uint64)
    by_step, model = np.zeros((steps, streams), np.uint32), _Model(vocab, streams)
    every = _ORDER0_BITS - _FIND_BITS
    for step in range(steps):
        fresh = model.fresh()
        model.predict()
        if fresh:  # the first place that each stretch of order 0's scale may mean
            find = np.cumsum(np.bincount((model.cum[1 : vocab + 1] >> _U(every)).astype(np.int64), minlength=1 << _FIND_BITS))
            find = np.concatenate([[0], find[:-1]])
        unit = width >> _U(8)
        past2 = off >= unit * model.one.take(model.context)
        past1 = off >= unit * model.two.take(model.context)
        outcome = model.context << 2
        outcome += 2
        outcome -= past1
        outcome -= past2
        off -= unit * model.start.take(outcome)
        unit *= model.size.take(outcome)
        unit >>= _U(_ORDER0_BITS)
        width = unit << _U(_ORDER0_BITS)
        own = np.where(past1, model.p1, model.p2).astype(np.int64)
        miss = np.flatnonzero(past2)
        if len(miss):
            unit, rest = unit.take(miss), off.take(miss)
            value = rest // unit
            x = find.take((value >> _U(every)).view(np.int64))
            after = np.flatnonzero(model.cum.take(x + 1) <= value)
            if len(after):
                x[after] = np.searchsorted(model.cum[: vocab + 1], value.take(after), "right") - 1
            off[miss] = rest - unit * model.cum.take(x)
            width[miss] = unit * model.size0.take(x)
            own[miss] = x
        by_step[step] = own
        short = np.flatnonzero(width < _U(1 << 32))
        if len(short):
            place = at.take(short)
            off[short] = off.take(short) << _U(32) | words.take(place)
            width[short] = width.take(short) << _U(32)
            at[short] = place + 1
        model.update(own, outcome, own == model.p2, own == model.p1)
    ids = np.ascontiguousarray(by_step.T).reshape(-1)[:n]
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise BlockError("the ids are damaged")
    return ids


def write(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *, end_id: int = 0, block_ids: int = BLOCK_IDS) -> None:
    """Write the ids of all texts, each followed by ``end_id``, in ascending id
    order.  The one shuffle deals the texts by ranges of the id; a task encodes
    its range block by block and holds one block of whole documents at a time."""
    rows = id_text(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id")

    def run(it):
        encode = library_encoder(tokenizer)
        part, block, first = TaskContext.get().partitionId(), 0, 0
        held: list[np.ndarray] = []
        names: list = []
        size, kind = 0, pa.int64()

        def emit():
            ids = np.concatenate(held)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([first], pa.int64()), pa.array([names], pa.list_(kind)), pa.array([[len(x) for x in held]], pa.list_(pa.int64())), pa.array([len(ids)], pa.int64()), pa.array([zlib.crc32(ids.tobytes())], pa.int64()), pa.array([encode_block(ids)], pa.binary())],
                names=["part", "block", "first", "doc_ids", "lengths", "n_ids", "ids_crc32", "payload"],
            )

        for b in grouped(it):
            kind = b.schema.field("doc_id").type
            ids, ends = encode(b.column("text"), end_id)
            for doc_id, own in zip(b.column("doc_id").to_pylist(), np.split(ids, ends[:-1])):
                held.append(own)
                names.append(doc_id)
                size += len(own)
                if size >= block_ids:
                    yield emit()
                    block, first, size = block + 1, first + size, 0
                    held, names = [], []
        if held:
            yield emit()

    kind = rows.schema["doc_id"].dataType.simpleString()
    map_arrow(rows, run, f"part int, block int, first long, doc_ids array<{kind}>, lengths array<long>, n_ids long, ids_crc32 long, payload binary").write.parquet(path)


def read(spark: SparkSession, path: str, *, with_ids: bool = False) -> DataFrame:
    """Decode the files: doc_id, start, n_tokens, ids_crc32 per document, and
    with ``with_ids`` the ids.  Blocks are decoded independently; the number of
    ids before each part is a running sum over one row a part."""
    blocks = spark.read.parquet(path)
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def run(it):
        for b in it:
            for i in range(b.num_rows):
                ids = decode_block(b.column("payload")[i].as_py())
                lengths = np.array(b.column("lengths")[i].as_py(), np.int64)
                if len(ids) != b.column("n_ids")[i].as_py() or lengths.sum() != len(ids) or (lengths < 0).any() or len(b.column("doc_ids")[i]) != len(lengths) or zlib.crc32(ids.tobytes()) != b.column("ids_crc32")[i].as_py():
                    raise BlockError("the row isn't that of its block")
                ends = np.cumsum(lengths)
                starts = ends - lengths
                raw = memoryview(ids.astype("<u4").tobytes())
                cols = [pa.array(np.full(len(lengths), b.column("part")[i].as_py(), np.int32)), b.column("doc_ids")[i].values, pa.array(starts + b.column("first")[i].as_py()), pa.array(lengths), pa.array([zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts, ends)], pa.int64())]
                names = ["part", "doc_id", "inside", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array([ids[s:e] for s, e in zip(starts, ends)], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    out = map_arrow(blocks, run, f"part int, doc_id {kind}, inside long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else ""))
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    named = out.join(parts, F.col("part") == F.col("p"))
    return named.select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
