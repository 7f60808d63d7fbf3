"""Exact dedup by two-pass Bloom filtering, in DataFrame operations only.

Pass 1 hashes each text to one bit of a table with ``bits_per_row`` bits a row and
finds the bits that are set more than once.  Each task packs the bits it sets into
one row for each stretch of the table, so what is shuffled is a few bytes a text
in some hundred rows a task; the rows of a stretch are then sorted and compared.
Pass 2 tests every row against the bits found: a row whose bit nothing else set
has a text of its own and passes straight through; only the rest (id and digest,
never the text) is shuffled and grouped exactly.

The table grows with the rows, so the chance that a text of its own is grouped
stays at 1 / bits_per_row.  Up to ``broadcast_bits`` repeated bits (counted first)
are broadcast; with more of them, pass 2 joins by the bit instead, the result
being the same.

Defined results: a null text counts as empty; equal means identical; of equal
texts the row with the largest id stays (null ids come last), and of repeated
rows with that id one stays; an empty table gives an empty result; columns
other than id and text are ignored by ``decisions`` and carried by ``keep``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, stage

BITS_PER_ROW, BROADCAST_BITS = 64, 2_000_000

#: Stretches of the table at least, and bits set that a stretch should have at most.
STRETCHES, STRETCH_BITS = 128, 1 << 20


def power_above(n: int) -> int:
    return 1 << max(n - 1, 0).bit_length()


def _slot(bits: int):
    """The bit of a row, from a 64-bit hash of its text."""
    return F.xxhash64("text").bitwiseAND(F.lit(bits - 1))


def repeated_bits(rows: DataFrame, bits: int, stretches: int) -> DataFrame:
    """(bit): the bits that two or more rows set."""
    width = bits // stretches
    again = lambda xs: F.filter(xs, lambda x, i: (i > 0) & (x == F.get(xs, i - 1)))
    once = lambda xs: F.filter(xs, lambda x, i: (i == 0) | (x != F.get(xs, i - 1)))
    slot = rows.select(_slot(bits).alias("slot"), F.spark_partition_id().alias("task"))
    placed = slot.select(F.shiftright("slot", width.bit_length() - 1).cast("int").alias("stretch"), "task", F.col("slot").bitwiseAND(F.lit(width - 1)).alias("at"))
    # A text with a third of all rows is one bit of each task from here on.
    packed = placed.groupBy("stretch", "task").agg(F.sort_array(F.collect_list("at")).alias("xs"))
    # A new name for each new array: a lambda would take an alias of its own select for the column.
    packed = packed.select("stretch", once(F.col("xs")).alias("one"), F.array_distinct(again(F.col("xs"))).alias("twice"))
    whole = packed.groupBy("stretch").agg(F.sort_array(F.flatten(F.collect_list("one"))).alias("all"), F.flatten(F.collect_list("twice")).alias("twice"))
    return whole.select("stretch", F.explode(F.array_union(again(F.col("all")), F.col("twice"))).alias("at")).select((F.col("stretch").cast("long") * width + F.col("at")).alias("bit"))


def flagged(docs: DataFrame, id_col: str, text_col: str, bits_per_row: int, broadcast_bits: int, carry: bool = False) -> DataFrame:
    """(doc_id, text, tag, maybe[, row]): maybe is false where the text is surely unique;
    ``tag`` tells rows apart and may be used once only, since a rerun can deal it anew.

    ``row`` holds the input row whole, so that no column name can clash."""
    n = docs.count()
    stretches = power_above(max(STRETCHES, -(-n // STRETCH_BITS)))
    bits = max(stretches, power_above(bits_per_row * n))
    found = stage(repeated_bits(id_text(docs, id_col, text_col), bits, stretches), "bits")
    cols = [F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")]
    if carry:
        cols.append(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = docs.select(*cols).withColumns({"tag": F.monotonically_increasing_id(), "slot": _slot(bits)})
    side = F.broadcast(found) if found.count() <= broadcast_bits else found.hint("shuffle_hash")
    return rows.join(side, F.col("slot") == F.col("bit"), "left").withColumn("maybe", F.col("bit").isNotNull()).drop("slot", "bit")


def _groups(candidates: DataFrame) -> DataFrame:
    """One row per text among the candidates; partial sums leave one row per
    text and task, so a text with a third of all rows is no burden."""
    return candidates.groupBy("sha").agg(
        F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "tag")).alias("top"),
        F.count(F.lit(1)).alias("group_size"),
    )


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, bits_per_row: int = BITS_PER_ROW, broadcast_bits: int = BROADCAST_BITS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per input row."""
    rows = flagged(docs, id_col, text_col, bits_per_row, broadcast_bits).select("doc_id", "tag", "maybe", F.sha2("text", 256).alias("sha"))
    alone = rows.where(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    cand = stage(rows.where("maybe").select("doc_id", "tag", "sha"), "candidates")
    groups = stage(_groups(cand), "groups")
    both = cand.join(groups, "sha").select("doc_id", F.col("top.doc_id").alias("keep_id"), "group_size", (F.col("tag") == F.col("top.tag")).alias("kept"), F.col("sha").alias("text_sha256"))
    return alone.unionByName(both)


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, bits_per_row: int = BITS_PER_ROW, broadcast_bits: int = BROADCAST_BITS) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they were.  Rows that the
    filter proves unique are never shuffled; of the others each task hands on
    one row per text at most, the one with its largest id."""
    rows = flagged(docs, id_col, text_col, bits_per_row, broadcast_bits, carry=True)
    alone = rows.where(~F.col("maybe")).select("row.*")
    order = F.struct(F.col("doc_id").isNotNull(), F.col("doc_id"))
    best = rows.where("maybe").groupBy(F.sha2("text", 256).alias("sha")).agg(F.max_by("row", order).alias("row"))
    return alone.unionByName(best.select("row.*"))
