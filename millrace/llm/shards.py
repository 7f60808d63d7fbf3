"""Sharding by sampled splitters.

Records are ordered by (64-bit hash of the text, id), so equal texts stand
together yet a text with a third of all rows can still be split.  Keys are
sampled with a chance proportional to their weight, quantiles of the sample cut
the order into ranges, ranges that turn out overfull are sampled again and cut
further, and exact sums per range then give every record its place in the whole
order.  Shards are equal stretches of that order.  Only (id, size, crc, hash) is
shuffled, never a text; what reaches the driver is the sample (at most 32 keys
a range) and one row a range.

Laws: ``bytes`` (a record is in the shard in which its middle lies, so shard sizes
differ by less than two of the largest records) and ``rows`` (counts differ by one
at most).  Equal texts stand together, so at most one group of them is cut at each
place where two shards meet; ``group_cut`` marks the rows of such groups.

Defined results: a null text has no bytes and hashes as the empty text; null
ids sort first; ids that aren't whole numbers are ordered by a hash; repeated rows
get places of their own; an empty table gives an empty result; other columns are
ignored by ``plan`` and carried by ``write``.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_count, id_text, stage

#: Rows a range is meant to hold, sampled keys a range, and the most ranges.
ROWS_A_RANGE, KEYS_A_RANGE, MOST_RANGES = 50_000, 32, 20_000


def range_of(h: np.ndarray, i: np.ndarray, bh: np.ndarray, bi: np.ndarray) -> np.ndarray:
    """The number of boundaries (bh, bi), sorted, that are <= each key (h, i)."""
    low, high = np.searchsorted(bh, h, "left"), np.searchsorted(bh, h, "right")
    out = low.copy()
    tied = high > low  # the hash is that of a boundary: ids decide
    for v in np.unique(h[tied]):
        at = h == v
        a, b = np.searchsorted(bh, v, "left"), np.searchsorted(bh, v, "right")
        out[at] = a + np.searchsorted(bi[a:b], i[at], "right")
    return out


def _with_range(slim: DataFrame, bh: np.ndarray, bi: np.ndarray) -> DataFrame:
    @F.pandas_udf("int")
    def which(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for h, i in batches:
            yield pd.Series(range_of(h.to_numpy(), i.to_numpy(), bh, bi).astype(np.int32))

    return slim.withColumn("range", which("h", "key_id"))


def _sample(rows: DataFrame, chance, salt: int):
    """Keys with chance min(1, chance), chosen by a hash of the key so that a
    rerun chooses the same, and their weights max(1, chance)."""
    u = F.xxhash64("h", "key_id", F.lit(salt)).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    got = rows.where(u < chance).select("h", "key_id", F.greatest(F.lit(1.0), chance).alias("by")).toPandas()
    return got.h.to_numpy(np.int64), got.key_id.to_numpy(np.int64), got.by.to_numpy(float)


def _quantiles(h: np.ndarray, i: np.ndarray, by: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((i, h))
    total = np.cumsum(by[order])
    if not len(total) or parts < 2:
        return h[:0], i[:0]
    at = np.unique(np.searchsorted(total, total[-1] * np.arange(1, parts) / parts, "left").clip(0, len(total) - 1))
    return h[order][at], i[order][at]


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shards: int = 40, law: str = "bytes", overhead: int = 16, rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, group_cut), one row per record."""
    if law not in ("bytes", "rows"):
        raise ValueError("law is 'bytes' or 'rows'")
    whole = docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long")
    slim = stage(
        id_text(docs, id_col, text_col).select(
            "doc_id",
            (F.octet_length("text") + overhead).cast("long").alias("size"),
            F.crc32(F.encode("text", "utf-8")).alias("text_crc32"),
            F.xxhash64("text").alias("h"),
            F.coalesce(F.col("doc_id").cast("long") if whole else F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")), F.lit(-(1 << 63))).alias("key_id"),
        ),
        "slim",
    ).withColumn("w", F.col("size") if law == "bytes" else F.lit(1).cast("long"))
    n, total = slim.agg(F.count(F.lit(1)), F.coalesce(F.sum("w"), F.lit(0))).first()
    parts = bucket_count(n, rows_a_range, 4 * shards, MOST_RANGES)
    bh, bi = _quantiles(*_sample(slim, F.col("w") * F.lit(KEYS_A_RANGE * parts / max(total, 1)), 0), parts)
    most = max(1000, 4 * n // parts)
    for turn in range(1, 5):
        counts = {r["range"]: r.n for r in _with_range(slim, bh, bi).groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect()}
        over = {k: v for k, v in counts.items() if v > most}
        if not over or len(bh) >= 2 * MOST_RANGES:
            break
        pick = _with_range(slim, bh, bi).where(F.col("range").isin(list(over)))
        sh, si, _ = _sample(pick, F.lit(KEYS_A_RANGE * sum(-(-v // most) for v in over.values()) / sum(over.values())), turn)
        where, add = range_of(sh, si, bh, bi), [(bh, bi)]
        for k, v in over.items():
            add.append(_quantiles(sh[where == k], si[where == k], np.ones((where == k).sum()), 2 * -(-v // most)))
        keys = np.unique(np.array([(a, b) for x, y in add for a, b in zip(x, y)], np.int64).reshape(-1, 2), axis=0)
        if len(keys) == len(bh):  # one key alone is overfull: rows that repeat id and text
            break
        bh, bi = keys[:, 0].copy(), keys[:, 1].copy()
    return _places(_with_range(slim, bh, bi), n, total, shards, law)


def _places(slim: DataFrame, n: int, total: int, shards: int, law: str) -> DataFrame:
    spark = slim.sparkSession
    inside = Window.partitionBy("range").orderBy("h", "key_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = slim.withColumns({"rn": F.row_number().over(Window.partitionBy("range").orderBy("h", "key_id")).cast("long"), "run": F.sum("w").over(inside)})
    placed = stage(placed, "placed")
    per = sorted(placed.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w")).collect())
    base, rows, weight = [], 0, 0
    for r in per:
        base.append((r["range"], rows, weight))
        rows, weight = rows + r.n, weight + r.w
    bases = spark.createDataFrame(base, "range int, row_base long, w_base long")
    mid = "(2 * (w_base + run) - w)"
    placed = placed.join(F.broadcast(bases), "range").withColumn("shard", F.expr(f"cast(least({shards - 1}, {mid} * {shards} div {2 * max(total, 1)}) as int)"))
    starts, ends, cut, last = [], {}, [], None
    for r in sorted(placed.groupBy("shard", "range").agg(F.min("rn").alias("first"), F.count(F.lit(1)).alias("n"), F.min("h").alias("low"), F.max("h").alias("high")).collect()):
        if last is not None and last.shard != r.shard and last.high == r.low:
            cut.append(r.low)
        last = r
        starts.append((r.shard, r["range"], ends.get(r.shard, 0) - r["first"]))
        ends[r.shard] = ends.get(r.shard, 0) + r.n
    shift = spark.createDataFrame(starts, "shard int, range int, shift long")
    return placed.join(F.broadcast(shift), ["shard", "range"]).select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", (F.col("rn") + F.col("shift")).alias("slot"), F.col("h").isin(cut).alias("group_cut"))


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Write ``docs`` as Parquet files in folders ``shard=0`` and so on, rows in
    slot order, all columns kept in a struct ``row``; ids must be unique.
    Returns the plan."""
    made = stage(plan(docs, id_col, text_col, **options), "plan")
    whole = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = whole.join(made.select(F.col("doc_id").alias("p_id"), "shard", "slot"), F.col("doc_id").eqNullSafe(F.col("p_id"))).select("shard", "slot", "row")
    joined.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return made
