"""SimHash near-dedup of texts whose shingles are alike by 0.8 or more.

The operator of ``simhash`` for edited copies: two documents are linked if the
Jaccard similarity of their sets of shingles (five words) is at least 0.8; the
classes are the connected components of the links.  At that similarity some 15 %
of all SimHash bits differ, too many for bands of whole bits, so buckets come
from min-hashes in bands: documents that agree in all ``ROWS`` minima of one of
``BANDS`` bands.  Two documents of similarity s meet with a chance of
1 - (1 - s^ROWS)^BANDS, which is above 0.99997 from 0.8 on.  Each document is tied
to the first of its band only, so what a bucket gives grows with its members and
not with their pairs; what is tied together, directly or not, is a group.

A group is compared bit-sliced by SimHash fingerprints of ``WIDE`` times 64 bits
(``simhash.near``), and pairs within ``RADIUS`` bits are confirmed by their whole
sets.  The radius is 96 of 256: pairs of similarity 0.8 differ in 39 to 48 bits on
average with a deviation of 6, unlike ones in 128 with a deviation of 8.  A large
group is cut into chunks and each pair of chunks is a task of its own; a task
returns a spanning forest of its links, and leaves out only pairs whose documents
are in one tree already.

Documents with equal sets are compared once.  Shingles are held as XXH64.
Defined results: as for ``simhash``; documents without words are one class.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, id_text, map_arrow, small, stage
from .simhash import BROADCAST_IDS, components, keep_least, near, shingles

SHINGLE, BANDS, ROWS, WIDE, RADIUS = 5, 20, 4, 4, 96

#: Members and shingles of a chunk.
CHUNK, CHUNK_SHINGLES = 4096, 2_000_000

_MIX = np.random.default_rng(11).integers(0, 2**63, WIDE, np.uint64) * np.uint64(2) + np.uint64(1)
_TURNS = np.random.default_rng(7).integers(0, 2**63, (2, BANDS * ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def hashed(text: str, size: int = SHINGLE) -> np.ndarray:
    """The sorted set of a text's shingles."""
    return np.unique(np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles(text, size)], np.uint64))


def mark(made: np.ndarray) -> int:
    """The number, as a signed long, that stands for a set."""
    return xxhash.xxh64_intdigest(made.astype("<u8").tobytes(), 1) - 2**63


def bands(made: np.ndarray) -> np.ndarray:
    """A key for each band, as signed longs."""
    least = np.full(BANDS * ROWS, np.uint64(2**64 - 1))
    for i in range(0, len(made), 4096):  # bounds memory for very long texts
        least = np.minimum(least, (made[i : i + 4096, None] * _TURNS[0] + _TURNS[1]).min(0))
    whole = least.astype("<u8").tobytes()
    return np.array([xxhash.xxh64_intdigest(whole[8 * ROWS * b : 8 * ROWS * (b + 1)], b) for b in range(BANDS)], np.uint64).view(np.int64)


def signed(rows: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, mark, n, keys) of (doc_id, text)."""

    def run(it):
        for b in small(it):
            sets = [hashed(t, shingle) for t in b.column("text").to_pylist()]
            columns = [b.column("doc_id"), pa.array([mark(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([bands(s) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "mark", "n", "keys"])

    return map_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, mark long, n long, keys array<long>")


def _sets(rows: DataFrame, shingle: int) -> DataFrame:
    """(mark, made) of (doc_id, text)."""

    def run(it):
        for b in small(it):
            sets = [hashed(t, shingle) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([mark(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["mark", "made"])

    return map_arrow(rows, run, "mark long, made array<long>")


def wide(made: np.ndarray) -> np.ndarray:
    """The fingerprint of a set: a bit is 1 if it is set in over half of the
    numbers that its shingles give."""
    ones = np.zeros(64 * WIDE, np.int64)
    for i in range(0, len(made), 4096):
        h = made[i : i + 4096, None] * _MIX[None]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        ones += np.unpackbits(h.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(made), bitorder="little").view(np.uint64)


def close(sets: list[np.ndarray]):
    """(index, the later ones within ``RADIUS`` bits) of each set that has any."""
    prints = np.stack([wide(s.view(np.uint64)) for s in sets])
    for at in range(0, len(prints), 256):
        own = prints[at : at + 256]
        found = list(near(own, prints[at:], RADIUS))
        if found:
            i, j = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(i, kind="stable")
            i, j = i[order], j[order]
            for rows in np.split(np.arange(len(i)), np.flatnonzero(np.diff(i)) + 1):
                later = j[rows][j[rows] > i[rows[0]]]
                if len(later):
                    yield at + int(i[rows[0]]), at + later


def forest(sets: list[np.ndarray], tenths: int = 8) -> np.ndarray:
    """The smallest index of the component of each set; sets are linked from a
    Jaccard similarity of ``tenths`` / 10 on."""
    n, lens = len(sets), np.array([len(s) for s in sets], np.int64)
    label = np.arange(n)
    owner = np.repeat(np.arange(n), lens)
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    held = np.argsort(token, kind="stable")
    members, starts = owner[held], np.concatenate([[0], np.cumsum(np.bincount(token))])
    first = np.concatenate([[0], np.cumsum(lens)])
    for r, others in close(sets):
        apart = np.zeros(n, bool)
        apart[others] = label[others] != label[r]
        if not apart.any():
            continue
        own = token[first[r] : first[r + 1]]
        own = own[starts[own + 1] - starts[own] > 1]
        size = starts[own + 1] - starts[own]
        at = np.repeat(starts[own] - np.cumsum(size) + size, size) + np.arange(size.sum())
        common = np.bincount(members[at], minlength=n)
        # common / (a + b - common) >= tenths / 10
        hits = apart & (common > 0) & ((10 + tenths) * common >= tenths * (lens + lens[r]))
        if hits.any():
            joined = np.unique(np.append(label[hits], label[r]))
            label[np.isin(label, joined)] = joined[0]
    return label


def _links(tenths: int):
    def run(table: pa.Table) -> pa.Table:
        marks, at = np.unique(table.column("mark").to_numpy(), return_index=True)
        made = table.column("made").combine_chunks()
        label = forest([made[i].values.to_numpy() for i in at.tolist()], tenths)
        moved = label != np.arange(len(marks))
        out = pa.table({"a": marks[moved], "b": marks[label[moved]]})
        give_back()
        return out

    return run


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = SHINGLE, tenths: int = 8, chunk: int = CHUNK, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """(doc_id, mark, component_id): component_id is the smallest id of the class."""
    rows = id_text(docs, id_col, text_col)
    prints = stage(signed(rows, shingle), "signed")
    stats = stage(prints.groupBy("mark").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("keys").alias("keys")), "marks")
    keys = stats.select("mark", F.explode("keys").alias("key"))
    buckets = stage(keys.groupBy("key").agg(F.min("mark").alias("a"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m"), "buckets")
    side = F.broadcast(buckets) if buckets.count() <= broadcast_ids else buckets
    tied = stage(components(keys.join(side, "key").select("a", F.col("mark").alias("b"))), "tied")
    # The first of a group isn't a node of its own.
    tied = tied.unionByName(tied.select(F.col("root").alias("node"), "root").distinct())
    group = stage(stats.drop("keys").join(tied, stats.mark == tied.node).drop("node"), "group")
    cut = group.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / chunk), F.ceil(F.sum("n") / CHUNK_SHINGLES)).cast("int").alias("parts"))
    n, total = group.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    several = max(1, -(-n // min(chunk, 1000)), -(-total // (CHUNK_SHINGLES // 4)))  # small groups share a task
    some = stage(group.join(stage(cut, "cut"), "root"), "some")
    wanted = some.select(F.col("least").alias("wanted_id")).distinct()
    wanted = F.broadcast(wanted) if n <= broadcast_ids else wanted.hint("merge")
    sets = _sets(rows.join(wanted, rows.doc_id.eqNullSafe(F.col("wanted_id")), "left_semi"), shingle)
    dealt = (
        sets.join(some.select("mark", "root", "parts"), "mark")
        .withColumn("large", F.col("parts") > 1)
        .withColumn("g", F.when(F.col("large"), F.col("root")).otherwise(F.pmod(F.xxhash64("root"), F.lit(several))))
        .withColumn("part", F.pmod(F.xxhash64("mark", F.lit(1)), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("mark", "made", "large", "g", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    )
    roots = components(dealt.groupBy("large", "g", "i", "j").applyInArrow(_links(tenths), "a long, b long"))
    rooted = stage(stats.select("mark", "least").join(roots, stats.mark == roots.node, "left").select("mark", "least", F.coalesce("root", "mark").alias("root")), "rooted")
    ids = stage(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "ids")
    named = stage(rooted.join(ids, "root").select("mark", "component_id"), "named")
    return prints.select("doc_id", "mark").join(named, "mark").select("doc_id", "mark", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, broadcast_ids: int = BROADCAST_IDS, **options) -> DataFrame:
    """The rows of ``docs`` with the smallest id of each class; all columns stay."""
    return keep_least(docs, classes(docs, id_col, text_col, broadcast_ids=broadcast_ids, **options), id_col, broadcast_ids)
