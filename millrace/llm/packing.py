"""Hierarchical multi-length packing.

Documents are routed by length to tiers of window sizes (powers of two up to
``window``).  Whole windows are cut from long documents first; what is left goes
to the smallest tier that holds it.  Tiers are packed from the longest down:
an item opens a window of its tier, the gap is filled from the shorter items,
best fit first, and the last gap is closed by cutting an item to size.  The few
ids left at the end of a task become sequences of power-of-two lengths.  So each
sequence is exactly as long as a power of two, and none needs padding.

Packing is local to a task of the scan and holds at most ``hold`` ids at a
time: no shuffle, and memory doesn't grow with the input.  Sequences of a tier
are grouped into steps of ``step_tokens`` ids each, dealt in order of attention
cost (sum of squared piece lengths) forth and back so that steps cost alike.

Defined results: null text counts as empty and gives the end id alone; repeated
rows are packed as often as they come; null ids are kept; an empty table gives no
piece; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import grouped, id_text, map_arrow
from .vocab import word_encoder

WINDOW, SHORTEST = 4096, 256


class Pool:
    """Items (doc, start) by length, with a bit mask of the lengths there are."""

    def __init__(self, window: int):
        self.items: list[list] = [[] for _ in range(window + 1)]
        self.mask = 0

    def put(self, length: int, item: tuple) -> None:
        self.items[length].append(item)
        self.mask |= 1 << length

    def longest(self, most: int) -> int:
        """The greatest length there is up to ``most``, or 0."""
        return max(0, (self.mask & ((2 << most) - 1)).bit_length() - 1)

    def take(self, length: int) -> tuple:
        item = self.items[length].pop()
        if not self.items[length]:
            self.mask ^= 1 << length
        return item


def pack(lengths: list[int], window: int = WINDOW, shortest: int = SHORTEST) -> tuple[list, list]:
    """Sequences, each a list of pieces (doc, start, length), that are exactly
    full; and the pieces of the last, unfinished window."""
    tiers = [shortest << i for i in range((window // shortest).bit_length())]
    done, pool = [], Pool(window)
    for doc, n in enumerate(lengths):
        start = 0
        while n - start >= window:
            done.append([(doc, start, window)])
            start += window
        if n > start:
            pool.put(n - start, (doc, start))
    while pool.mask:
        first = pool.longest(window)
        size = next(t for t in tiers if t >= first)
        doc, start = pool.take(first)
        own, gap = [(doc, start, first)], size - first
        while gap:
            if fit := pool.longest(gap):
                doc, start = pool.take(fit)
                own.append((doc, start, fit))
                gap -= fit
            elif pool.mask:  # every item is longer than the gap: cut the longest
                long = pool.longest(window)
                doc, start = pool.take(long)
                own.append((doc, start, gap))
                pool.put(long - gap, (doc, start + gap))
                gap = 0
            else:
                return done, own
        done.append(own)
    return done, []


def powers(pieces: list) -> list:
    """Cut pieces into sequences whose lengths are the powers of two of their total."""
    total, out, pieces = sum(p[2] for p in pieces), [], list(reversed(pieces))
    for k in reversed(range(total.bit_length())):
        if total >> k & 1:
            own, gap = [], 1 << k
            while gap:
                doc, start, n = pieces.pop()
                cut = min(n, gap)
                own.append((doc, start, cut))
                if n > cut:
                    pieces.append((doc, start + cut, n - cut))
                gap -= cut
            out.append(own)
    return out


def step_groups(sequences: list, step_tokens: int) -> list[tuple[int, int]]:
    """(tier, group) of each sequence; groups are numbered over all tiers."""
    out, base = [(0, 0)] * len(sequences), 0
    tiers: dict[int, list[int]] = {}
    for i, s in enumerate(sequences):
        tiers.setdefault(sum(p[2] for p in s), []).append(i)
    for tier, own in sorted(tiers.items()):
        own.sort(key=lambda i: (-sum(p[2] ** 2 for p in sequences[i]), i))
        groups = max(1, -(-len(own) * tier // step_tokens))
        for at, i in enumerate(own):
            turn, col = divmod(at, groups)
            out[i] = (tier, base + (groups - 1 - col if turn % 2 else col))
        base += groups
    return out


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *, end_id: int = 2, window: int = WINDOW, shortest: int = SHORTEST, hold: int = 2_000_000, step_tokens: int = 32_768, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, tier (its sequence's length), step_group, and with
    ``with_ids`` the ids."""
    rows = id_text(docs, id_col, text_col)

    def run(it):
        encode = word_encoder(tokenizer)
        base = TaskContext.get().partitionId() << 40
        made = {"sequence": 0, "group": 0}
        held: list[tuple] = []  # (doc_id, first id's place, its ids as bytes, length from there)

        def emit(sequences: list) -> pa.RecordBatch:
            cols: list[list] = [[] for _ in range(10)]
            for own, (tier, group) in zip(sequences, step_groups(sequences, step_tokens)):
                offset = 0
                for doc, start, n in own:
                    doc_id, first, ids, _ = held[doc]
                    part = ids[4 * (first + start) : 4 * (first + start + n)]
                    row = (doc_id, first + start, n, zlib.crc32(part), len(ids) // 4, base + made["sequence"], offset, tier, base + made["group"] + group, np.frombuffer(part, "<u4") if with_ids else None)
                    for c, v in zip(cols, row):
                        c.append(v)
                    offset += n
                made["sequence"] += 1
            made["group"] += 1 + max((g for _, g in step_groups(sequences, step_tokens)), default=0)
            kinds = [id_type] + [pa.int64()] * 6 + [pa.int32(), pa.int64()]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]
            out = [pa.array(c, k) for c, k in zip(cols, kinds)]
            if with_ids:
                out.append(pa.array(cols[9], pa.list_(pa.int64())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(out, names=names)

        size, id_type = 0, pa.int64()
        for b in grouped(it):
            id_type = b.schema.field("doc_id").type
            ids, ends = encode(b.column("text"), end_id)
            raw, before = memoryview(ids.tobytes()), 0
            for doc_id, to in zip(b.column("doc_id").to_pylist(), ends.tolist()):
                held.append((doc_id, 0, raw[4 * before : 4 * to], to - before))
                size += to - before
                before = to
                if size >= hold:
                    full, rest = pack([x[3] for x in held], window, shortest)
                    yield emit(full)
                    # What is left of each document goes on into the next filling.
                    held = [(held[d][0], held[d][1] + s, memoryview(bytes(held[d][2])), n) for d, s, n in rest]
                    size = sum(x[3] for x in held)
        full, rest = pack([x[3] for x in held], window, shortest)
        if full or rest:
            yield emit(full + powers(rest))

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
    return map_arrow(rows, run, schema + (", ids array<bigint>" if with_ids else ""))
