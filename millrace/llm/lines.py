"""Line dedup with levelled sorted runs of line digests.

A run is a table (hi, lo, docs) of 128-bit digests of lines' keys, ``docs`` counting
the documents that hold them.  All runs are laid out alike: bucketed by the digest
and sorted in each bucket, so runs are merged, and batches anti-joined with them,
bucket by bucket, and no run is ever shuffled.  Each batch of documents makes a run
of level 0; two runs of a level are merged into one of the next, so a digest is
rewritten a logarithmic number of times.  Two uses:

* ``drop_common`` drops, everywhere, the lines found in at least ``min_docs``
  documents of the whole table.  Digests that the runs so far have counted often
  enough are decided and stand in runs of their own; each new batch is anti-joined
  with these and adds what is left.  What the last runs sum up to decides the rest.
* ``LineRuns.add`` drops from each new batch the lines that an earlier batch had
  and adds the batch's own run.

Defined results: a null or empty text is one empty line, which is never
dropped (its key is shorter than ``min_chars``); an empty table gives an empty
result; a line repeated within a document counts once for that document; rows
repeated in the table count as documents of their own, whatever their ids; columns
other than id and text are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket_count, id_text, map_arrow, small, stage, stage_path

_SPACE = " \t\n\x0b\x0c\r"

#: Up to this many common keys are broadcast (16 bytes each); beyond it they
#: are joined.
BROADCAST_KEYS = 1_000_000

#: Documents a bucket of the runs is meant for, and the buckets there are at least.
BUCKET_DOCS, BUCKETS = 50_000, 8


def keys_of(lines: list[str], min_chars: int) -> list[bytes | None]:
    """The keys of lines: stripped, A-Z lower-cased; None where they are too short."""
    return [k.encode("utf-8", "surrogatepass").lower() if len(k := x.strip(_SPACE)) >= min_chars else None for x in lines]


def digests(keys: list[bytes]) -> np.ndarray:
    """int64[n, 2]: 128 bits of each key."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), ">i8").reshape(-1, 2).astype(np.int64)


def _flat(batch: pa.RecordBatch, min_chars: int):
    """The lines of each text; of all lines with a key, one after the other, the
    text's place, the line's place among all, and the digest."""
    texts = [(t or "").split("\n") for t in batch.column("text").to_pylist()]
    sizes = np.array([len(x) for x in texts], np.int64)
    keys = [k for x in texts for k in keys_of(x, min_chars)]
    at = np.flatnonzero(np.array([k is not None for k in keys], bool))
    owner = np.repeat(np.arange(len(texts)), sizes)
    return texts, sizes, owner[at], at, digests([keys[i] for i in at.tolist()])


def _distinct(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One row of each different one, in order of the columns, and how often it is there."""
    order = np.lexsort(columns[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.any([np.diff(c[order]) != 0 for c in columns], axis=0)
    return order[new], np.diff(np.append(np.flatnonzero(new), len(order)))


def line_digests(docs: DataFrame, min_chars: int, batches: int) -> DataFrame:
    """(batch, hi, lo, docs) of (doc_id, text), partly summed: each task adds up
    what it has seen of an Arrow batch, so a line in a third of all documents is
    one row of it."""

    def run(it):
        for b in small(it):
            _, _, owner, _, d = _flat(b, min_chars)
            if not len(owner):
                continue
            mine = b.column("batch").to_numpy()
            at, _ = _distinct(d[:, 0], d[:, 1], owner)
            part, hi, lo = mine[owner[at]], d[at, 0], d[at, 1]
            first, n = _distinct(part, hi, lo)
            yield pa.RecordBatch.from_arrays([pa.array(part[first], pa.int32()), pa.array(hi[first]), pa.array(lo[first]), pa.array(n)], names=["batch", "hi", "lo", "docs"])

    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch")
    return map_arrow(docs.select(batch, "text"), run, "batch int, hi long, lo long, docs long")


def bucketed(df: DataFrame, label: str, buckets: int, *by: str) -> DataFrame:
    """Write (hi, lo, ...) by buckets of the digest, sorted, and read it back; with
    ``by``, in a folder for each of its values."""
    name = f"millrace_{label}_{uuid.uuid4().hex}"
    writer = df.sortWithinPartitions(*by, "hi", "lo").write.bucketBy(buckets, "hi", "lo").sortBy("hi", "lo").option("path", stage_path(df.sparkSession, label))
    (writer.partitionBy(*by) if by else writer).saveAsTable(name)
    return df.sparkSession.table(name)


def together(df: DataFrame, buckets: int) -> DataFrame:
    """One task a bucket: the only shuffle that a digest goes through."""
    return df.repartition(buckets, "hi", "lo")


class LineRuns:
    """Runs as (level, table), all of ``buckets`` buckets."""

    def __init__(self, spark: SparkSession, buckets: int = BUCKETS, min_chars: int = 1):
        self.spark, self.buckets, self.min_chars, self.runs = spark, buckets, min_chars, []

    def push(self, run: DataFrame) -> None:
        """Add (hi, lo, docs), unique by digest and with a task for each bucket;
        merge while a level has two runs."""
        level, made = 0, bucketed(run, "run", self.buckets)
        while twin := next((t for x, t in self.runs if x == level), None):
            self.runs = [(x, t) for x, t in self.runs if x != level]
            level, made = level + 1, bucketed(self.merge(twin, made), "run", self.buckets)
        self.runs.append((level, made))

    @staticmethod
    def merge(a: DataFrame, b: DataFrame) -> DataFrame:
        """Two runs as one: a merge join within the buckets."""
        b = b.select(F.col("hi").alias("hi_b"), F.col("lo").alias("lo_b"), F.col("docs").alias("docs_b")).hint("merge")
        both = a.join(b, (F.col("hi") == F.col("hi_b")) & (F.col("lo") == F.col("lo_b")), "full_outer")
        return both.select(F.coalesce("hi", "hi_b").alias("hi"), F.coalesce("lo", "lo_b").alias("lo"), (F.coalesce("docs", F.lit(0)) + F.coalesce("docs_b", F.lit(0))).alias("docs"))

    def without(self, run: DataFrame) -> DataFrame:
        """The rows of ``run`` whose digest no run has: a merge anti-join with each."""
        for _, t in self.runs:
            run = run.join(t.select("hi", "lo").hint("merge"), ["hi", "lo"], "left_anti")
        return run

    def merged(self) -> DataFrame:
        """All runs as one (hi, lo, docs)."""
        if not self.runs:
            return self.spark.createDataFrame([], "hi long, lo long, docs long")
        while len(self.runs) > 1:
            (_, a), (level, b) = sorted(self.runs, key=lambda r: r[0])[:2]
            rest = [r for r in self.runs if r[1] is not a and r[1] is not b]
            self.runs = [*rest, (level + 1, bucketed(self.merge(a, b), "run", self.buckets))]
        return self.runs[0][1]

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Drop the lines of ``docs`` that earlier batches had, then take in
        this batch's lines.  Returns (doc_id, n_lines, n_dropped, kept_text)."""
        rows = id_text(docs, id_col, text_col)
        own = bucketed(together(line_digests(rows, self.min_chars, 1), self.buckets).groupBy("hi", "lo").agg(F.sum("docs").alias("docs")), "batch", self.buckets)
        new = bucketed(self.without(own), "new", self.buckets)
        old = stage(own.select("hi", "lo").join(new.select("hi", "lo").hint("merge"), ["hi", "lo"], "left_anti"), "seen")
        out = stage(drop_lines(rows, old, self.min_chars), "kept")
        self.push(new)
        return out


def count_common(parts: DataFrame, batches: int, buckets: int, min_docs: int) -> DataFrame:
    """(hi, lo) of the digests with ``min_docs`` documents in all batches of
    ``parts`` (batch, hi, lo, docs), a bucketed table."""
    spark = parts.sparkSession
    counts, decided = LineRuns(spark, buckets), LineRuns(spark, buckets)
    for i in range(batches):
        counts.push(decided.without(parts.where(F.col("batch") == i).select("hi", "lo", "docs")))
        # What a merge of runs has found to be common needs no more counting.
        level, top = counts.runs[-1]
        if level and i < batches - 1:
            decided.push(decided.without(top.where(F.col("docs") >= min_docs)))
    rest = counts.merged().where(F.col("docs") >= min_docs).select("hi", "lo")
    return decided.without(rest).unionByName(decided.merged().select("hi", "lo"))


def _apply(min_chars: int, found):
    """Arrow mapper that drops the lines for which found(batch, text places,
    digests) is true."""

    def run(it):
        for b in small(it):
            texts, sizes, owner, at, d = _flat(b, min_chars)
            drop = np.zeros(int(sizes.sum()), bool)
            drop[at] = found(b, owner, d)
            dropped = np.bincount(np.repeat(np.arange(len(texts)), sizes), drop, len(texts)).astype(np.int64)
            keep = (~drop).tolist()
            kept, start = [], 0
            for lines, gone in zip(texts, dropped.tolist()):
                kept.append("\n".join([x for x, k in zip(lines, keep[start : start + len(lines)]) if k] if gone else lines))
                start += len(lines)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes), pa.array(dropped), pa.array(kept, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_text"])

    return run


def among(d: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    """Whether each digest is one of ``sorted_keys``, int64[n, 2] in order."""
    out = np.zeros(len(d), bool)
    at, left = np.searchsorted(sorted_keys[:, 0], d[:, 0]), np.arange(len(d))
    while len(left):  # more than one turn only where 64 bits agree
        left = left[at[left] < len(sorted_keys)]
        left = left[sorted_keys[at[left], 0] == d[left, 0]]
        out[left] = sorted_keys[at[left], 1] == d[left, 1]
        left = left[~out[left]]
        at[left] += 1
    return out


def drop_lines(rows: DataFrame, keys: DataFrame, min_chars: int, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text) of (doc_id, text) without the
    lines whose digest is in ``keys`` (hi, lo).

    Up to ``broadcast_keys`` keys go to the executors as a sorted array (their
    number is counted first); more are joined with the lines' digests, and the
    digests found come back to the texts by id."""
    spark = rows.sparkSession
    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_lines long, n_dropped long, kept_text string"
    if keys.count() <= broadcast_keys:
        table = np.stack([c.to_numpy() for c in keys.select("hi", "lo").toArrow().columns], 1).reshape(-1, 2)
        sent = spark.sparkContext.broadcast(table[np.lexsort((table[:, 1], table[:, 0]))])
        return map_arrow(rows, _apply(min_chars, lambda b, owner, d: among(d, sent.value)), schema)

    # Rows that share an id share their lists: each entry is a common line for either.
    def run(it):
        for b in small(it):
            _, _, owner, _, d = _flat(b, min_chars)
            at, _ = _distinct(d[:, 0], d[:, 1], owner)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(owner[at])), pa.array(d[at, 0]), pa.array(d[at, 1])], names=["d_id", "hi", "lo"])

    # A staged key table on one side and a bare exchange on the other let Spark split hot keys.
    hits = map_arrow(rows, run, f"d_id {id_type}, hi long, lo long").join(stage(keys, "keys"), ["hi", "lo"])
    drops = hits.groupBy("d_id").agg(F.collect_set(F.struct("hi", "lo")).alias("drops"))
    joined = rows.join(drops, F.col("doc_id").eqNullSafe(F.col("d_id")), "left").select("doc_id", "text", "drops")

    def found(b, owner, d):
        own = [{(x["hi"], x["lo"]) for x in b.column("drops")[row].as_py() or []} for row in range(b.num_rows)]
        return [tuple(k) in own[o] for o, k in zip(owner.tolist(), d.tolist())]

    return map_arrow(joined, _apply(min_chars, found), schema)


def drop_common(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_chars: int = 1, min_docs: int = 10, batches: int = 8, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text): every line whose key is found
    in at least ``min_docs`` documents is dropped from all of them."""
    rows = id_text(docs, id_col, text_col)
    buckets = bucket_count(docs.count(), BUCKET_DOCS, BUCKETS)
    parts = together(line_digests(rows, min_chars, batches), buckets).groupBy("batch", "hi", "lo").agg(F.sum("docs").alias("docs"))
    parts = bucketed(parts, "digests", buckets, "batch")
    common = stage(count_common(parts, batches, buckets, min_docs), "common")
    return drop_lines(rows, common, min_chars, broadcast_keys)
