"""SimHash near-dedup with bit-sliced comparison.

A fingerprint bit is 1 if it is set in over half of the XXH64 hashes of a
document's shingles.  Fingerprints that differ in at most ``radius`` bits are
linked; the classes are the connected components of the links.

Each different fingerprint is compared once, however many documents have it.
With ``radius + 1`` bands, two linked fingerprints agree in a whole band
(pigeonhole), so comparison runs within the buckets of each band.  A bucket is
compared bit-sliced: the 64 bit planes of its members are stored as words of 64
members each, a block of queries updates all its distances at once with
carry-save counters, and a query is abandoned once all members exceed the
radius.  A bucket that is large is cut into chunks and each pair of chunks is a
task of its own, so no task grows and no pair is left out; a task returns a
spanning forest of its links, never the pairs.

Defined results: null text counts as empty; a document without words has
fingerprint zero; an empty table gives an empty result; null ids are kept as
documents and are never the smallest id unless a class has no other; repeated
rows are returned as often as they come; other columns are ignored by
``classes`` and carried by ``keep_one``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, map_arrow, small, stage

#: Members of a chunk, and the members a bucket should have.
CHUNK, BUCKET = 8192, 512

#: Up to this many ids of documents that go are broadcast.
BROADCAST_IDS = 500_000


def shingles(text: str, size: int) -> list[bytes]:
    """Shingles of ``size`` words; A-Z lower-cased, words parted by ASCII white space."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    if size == 3:
        return [b"%b %b %b" % w for w in zip(words, words[1:], words[2:])]
    return [b" ".join(w) for w in zip(*(words[i:] for i in range(size)))]


def fingerprint(text: str, size: int = 3) -> int:
    made = shingles(text, size)
    if not made:
        return 0
    h = np.array([xxhash.xxh64_intdigest(s, 42) for s in made], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):  # bounds memory for very long texts
        part = h[i : i + (1 << 16)]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = 2 * ones > len(h)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""
    rows = id_text(docs, id_col, text_col)

    def run(it):
        for b in small(it):
            fp = np.array([fingerprint(t, shingle) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return map_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def planes(fp: np.ndarray) -> np.ndarray:
    """uint64[bits, words]: word w of plane k holds bit k of members 64w to 64w+63;
    a member is one number of 64 bits, or a row of several."""
    n = len(fp)
    wide = np.ascontiguousarray(fp.reshape(n, -1).astype("<u8")).view(np.uint8).reshape(n, -1)
    bits = np.zeros((8 * wide.shape[1], -(-n // 64) * 64), np.uint8)
    bits[:, :n] = np.unpackbits(wide, axis=1, bitorder="little").T
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")


def near(queries: np.ndarray, members: np.ndarray, radius: int):
    """Yield (query index, member index) arrays of all pairs within ``radius`` bits."""
    vertical, n = planes(members), len(members)
    queries = queries.reshape(len(queries), -1)
    words, wires = vertical.shape[1], (radius + 1).bit_length()
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    tail = np.zeros(words, np.uint64)  # places beyond the last member count as exceeded
    if n % 64:
        tail[-1] = full << np.uint64(n % 64)
    start = (1 << wires) - 1 - radius  # so that the count overflows just beyond the radius
    block = max(1, (1 << 17) // max(words, 1) // 8)
    for q0 in range(0, len(queries), block):
        q = queries[q0 : q0 + block]
        alive = np.arange(len(q))
        count = [np.full((len(q), words), full if start >> i & 1 else 0, np.uint64) for i in range(wires)]
        over = np.repeat(tail[None], len(q), 0)
        for k in range(len(vertical)):
            flip = np.where(q[alive, k // 64] >> np.uint64(k % 64) & np.uint64(1), full, np.uint64(0))[:, None]
            carry = vertical[k][None] ^ flip
            for wire in count:
                wire ^= carry  # sum
                carry = carry & ~wire  # carry: was 1 and became 0
            over |= carry
            if k % 8 == 7:
                left = (over != full).any(1)
                if not left.all():
                    alive, over, count = alive[left], over[left], [c[left] for c in count]
                    if not len(alive):
                        break
        if len(alive):
            hits = np.unpackbits((~over).view(np.uint8), axis=1, bitorder="little")
            i, j = np.nonzero(hits)
            yield alive[i] + q0, j


def forest(n: int, pairs) -> np.ndarray:
    """The smallest index of the component of each of n items; pairs: arrays (i, j)."""
    label = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = label[i], label[j]
            differ = a != b
            if not differ.any():
                break
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
    return label


def _bucket_links(radius: int):
    def run(table: pa.Table) -> pa.Table:
        fp, part = table.column("fp").to_numpy().view(np.uint64), table.column("part").to_numpy()
        order = np.argsort(fp, kind="stable")
        fp, part = fp[order], part[order]
        first, second = part == part.min(), part == part.max()
        a, b = np.flatnonzero(first), np.flatnonzero(second)
        label = forest(len(fp), ((a[i], b[j]) for i, j in near(fp[a], fp[b], radius)))
        moved = label != np.arange(len(fp))
        return pa.table({"a": fp[moved].view(np.int64), "b": fp[label[moved]].view(np.int64)})

    return run


def links(prints: DataFrame, n: int, radius: int, chunk: int = CHUNK) -> DataFrame:
    """(a, b) links that span the classes of the ``n`` different ``prints`` (fp)."""
    bands, width = radius + 1, 64 // (radius + 1)
    bits = min(width, max(1, math.ceil(math.log2(max(n, 2) / BUCKET)) if n > BUCKET else 1))
    keys = prints.select("fp", F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.expr(f"shiftrightunsigned(fp, {b * width}) & {(1 << bits) - 1}L").alias("key")) for b in range(bands)])).alias("at")).select("fp", "at.band", "at.key")
    sizes = stage(keys.groupBy("band", "key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").withColumn("parts", F.ceil(F.col("m") / chunk).cast("int")), "buckets")
    sized = keys.join(sizes, ["band", "key"]).withColumn("part", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("parts")).cast("int"))
    # A bucket of one chunk is one task group; a larger one is a group for each pair of chunks.
    dealt = sized.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("fp", "band", "key", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    return dealt.groupBy("band", "key", "i", "j").applyInArrow(_bucket_links(radius), "a long, b long")


def components(edges: DataFrame, most: int = 40) -> DataFrame:
    """(node, root): the smallest node of each node's component, by alternating
    large-star and small-star rounds, each written to the shared folder.  It
    stops when a round changes nothing; ``most`` rounds are far more than the
    logarithm of any number of nodes needs."""
    pair = lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    edges = stage(edges.where("a <> b").select(pair("a", "b").alias("e")).select("e.*").distinct(), "edges")

    def mark(df: DataFrame):
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    def star(df: DataFrame, large: bool) -> DataFrame:
        both = df.select(F.col("b").alias("u"), F.col("a").alias("v"))
        if large:
            both = both.unionByName(df.select(F.col("a").alias("u"), F.col("b").alias("v")))
        least = stage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        joined = both.join(least, "u")
        moved = joined.where("v > u").select("v", "m") if large else joined.where("v <> m").select("v", "m").unionByName(least.select(F.col("u").alias("v"), "m"))
        return moved.where("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()

    before = mark(edges)
    if not before[0]:
        return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    for _ in range(most):
        edges = stage(star(stage(star(edges, True), "large"), False), "small")
        now = mark(edges)
        if now == before:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        before = now
    raise RuntimeError("components did not settle")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 3, radius: int = 2, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest id of the class."""
    prints = stage(fingerprints(docs, id_col, text_col, shingle), "prints")
    stats = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "stats")
    roots = components(links(stats.select("fp"), stats.count(), radius, chunk))
    rooted = stats.join(roots, stats.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = stage(rooted, "rooted")
    ids = stage(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "ids")
    named = stage(rooted.join(ids, "root").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_least(docs: DataFrame, named: DataFrame, id_col: str, broadcast_ids: int) -> DataFrame:
    """The rows of ``docs`` whose id is the component_id that ``named`` gives it.

    Texts are filtered in place by the ids that go, which are broadcast if they
    are counted to be at most ``broadcast_ids``, and joined otherwise."""
    same = F.col("doc_id").eqNullSafe(F.col("component_id"))
    gone = stage(named.groupBy("doc_id").agg(F.bool_or(same).alias("keep")).where(~F.col("keep")).select(F.col("doc_id").alias("gone_id")), "gone")
    side = F.broadcast(gone) if gone.count() <= broadcast_ids else gone.hint("merge")
    return docs.join(side, docs[id_col].eqNullSafe(gone.gone_id), "left_anti")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, broadcast_ids: int = BROADCAST_IDS, **options) -> DataFrame:
    """The rows of ``docs`` with the smallest id of each class; all columns stay."""
    return keep_least(docs, classes(docs, id_col, text_col, **options), id_col, broadcast_ids)
