"""Bounded admission: which rows fit, and what becomes of the others.

``status`` is accepted, full, timeout, disconnected or unsent; no row is ever
lost, so accepted and remainder together are the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import pow2
from ..functions.ordinals import fresh, with_position
from .receive import sizes_of
from .routing import Routes, by_group, round_robin, static

#: Stands for the rows without a shard, after all shards.
_LAST = 2**31 - 1


def try_send(df: DataFrame, ordinal: str, capacity: int, *, queued: int = 0, closed: list[int] | None = None) -> DataFrame:
    """Each row by itself: accepted while its shard has room, else full; rows
    for ``closed`` shards are disconnected.  Adds rn and status."""
    made = with_position(df, ordinal, ["shard"])
    status = F.when(F.col("shard").isin(closed or []), "disconnected").when(F.col("rn") <= max(capacity - queued, 0), "accepted").otherwise("full")
    return made.withColumn("status", status)


def try_send_rotating(df: DataFrame, ordinal: str, shards: int, capacity: int, *, start: int = 0, **options) -> DataFrame:
    """Rows dealt in rotation, each then tried: a row that finds its shard full
    has used its turn, and the next row goes to the next shard."""
    return try_send(round_robin(df, ordinal, shards, start), ordinal, capacity, **options)


def try_send_grouped(df: DataFrame, ordinal: str, key: str, routes: Routes, capacity: int, **options) -> DataFrame:
    """Rows sent by their key's handle; keys without one are unregistered."""
    made = try_send(by_group(df, key, routes), ordinal, capacity, **options)
    return made.withColumn("status", F.when(F.col("shard").isNull(), "unregistered").otherwise(F.col("status")))


def try_send_static(df: DataFrame, ordinal: str, shard: Column, shards: int, capacity: int, **options) -> DataFrame:
    """Rows sent to the caller's own shards."""
    return try_send(static(df, shard, shards), ordinal, capacity, **options)


def send(df: DataFrame, *, sent_at: str | None = None, room_at: str | None = None, timeout: float | None = None) -> DataFrame:
    """Blocking send: every row is accepted; with clock columns, rows that would
    have waited longer than ``timeout`` are handed back as timeout."""
    if timeout is None:
        return df.withColumn("status", F.lit("accepted"))
    return df.withColumn("status", F.when(F.col(room_at) - F.col(sent_at) <= timeout, "accepted").otherwise("timeout"))


def send_ref(df: DataFrame, cancelled: Column) -> DataFrame:
    """A send whose wait may be cancelled: adds status (accepted or cancelled) and
    in_slot, whether the caller still has the item: true for whatever was not
    accepted.  ``send_async`` gives its item away first, so there a cancelled row
    is lost: take ``status`` alone."""
    gone = F.coalesce(cancelled, F.lit(False))
    return df.withColumns({"status": F.when(gone, "cancelled").otherwise("accepted"), "in_slot": gone})


def _visited(df: DataFrame, ordinal: str, sent: Column, stops: Column, why: Column | str) -> DataFrame:
    """Shards are visited in order and the batch stops at the first for which
    ``stops`` holds, ``sent`` rows of it being sent; both are expressions of a
    shard's entry ``x`` (shard, n).  Adds rn, status and position."""
    ranked = with_position(df, ordinal, ["shard"])
    s, sizes, stop = fresh(ranked, "s", "sizes", "stop")
    made = ranked.withColumn(s, F.coalesce("shard", F.lit(_LAST))).crossJoin(F.broadcast(sizes_of(df.withColumn("shard", F.coalesce("shard", F.lit(_LAST))), sizes)))
    made = made.withColumn(stop, F.array_min(F.transform(F.filter(sizes, lambda x: (x["shard"] < _LAST) & stops(x)), lambda x: x["shard"])))
    taken = lambda x: F.when((x["shard"] < _LAST) & (F.col(stop).isNull() | (x["shard"] <= F.col(stop))), sent(x)).otherwise(0)
    own = F.aggregate(F.filter(sizes, lambda x: x["shard"] == F.col(s)), F.lit(0).cast("long"), lambda n, x: n + taken(x).cast("long"))
    before = F.aggregate(F.filter(sizes, lambda x: x["shard"] < F.col(s)), F.lit(0).cast("long"), lambda n, x: n + x["n"] - taken(x).cast("long"))
    fits = F.col("rn") <= own
    made = made.withColumn("status", F.when(fits, "accepted").when(F.col(s) == F.col(stop), why).otherwise("unsent"))
    return made.withColumn("position", F.when(~fits, before + F.col("rn") - own)).drop(s, sizes, stop)


def try_send_batch(df: DataFrame, ordinal: str, capacity: int, *, queued: int = 0) -> DataFrame:
    """One batch split by shard: shards are visited in order and the batch stops
    at the first one without room, whose fitting rows are still sent.  Rows with
    null shard (keys that aren't registered) are never sent.

    Adds rn, status (accepted, full, unsent) and position, the place from 1 in
    the remainder: the failed shard's rows, later shards, then the unregistered.
    All but rn follows from the rows of each shard."""
    room = max(capacity - queued, 0)
    return _visited(df, ordinal, lambda x: F.least(x["n"], F.lit(room).cast("long")), lambda x: x["n"] > room, "full")


def send_batch(df: DataFrame, ordinal: str, *, closed: list[int] | None = None) -> DataFrame:
    """A blocking batch, waiting where there is no room: all is sent, up to the
    first ``closed`` shard, whose rows come back as disconnected."""
    shut = lambda x: x["shard"].isin(closed or [])
    return _visited(df, ordinal, lambda x: F.when(shut(x), 0).otherwise(x["n"]), shut, "disconnected")


def spread_places(rows: int, rooms: list[int], start: int = 0) -> list[tuple[int, int, int]]:
    """(from, to, shard), places from 1, of what a spreading batch gets in: the
    next shard takes as much of the front as it has room for, and if something is
    left, the shard after it takes the last item; and so on.  It ends where that
    shard has no room: the sender waits there."""
    rooms, at, lo, hi, out = list(rooms), start, 1, rows, []
    while lo <= hi:
        shard = at % len(rooms)
        n = min(rooms[shard], hi - lo + 1)
        if n:
            out.append((lo, lo + n - 1, shard))
        rooms[shard], lo = rooms[shard] - n, lo + n
        shard = (at + 1) % len(rooms)
        if lo > hi or not rooms[shard]:
            break
        out.append((hi, hi, shard))
        rooms[shard], hi, at = rooms[shard] - 1, hi - 1, at + 2
    return out


def spread_batch(df: DataFrame, ordinal: str, shards: int, capacity: int, *, queued: dict[int, int] | None = None, start: int = 0) -> DataFrame:
    """One batch spread over the shards in rotation, order not kept.  Adds shard and
    status (accepted, or waiting for what has no room yet).  What is looked up is at
    most one place for each row there is room for."""
    rooms = [max(capacity - (queued or {}).get(i, 0), 0) for i in range(pow2(shards))]
    (at,) = fresh(df, "at")
    ranked = with_position(df, ordinal, name=at)
    places = [(p, s) for lo, hi, s in spread_places(df.count(), rooms, start) for p in range(lo, hi + 1)]
    table = df.sparkSession.createDataFrame(places, "place long, shard int")
    made = ranked.join(F.broadcast(table), ranked[at] == table["place"], "left").drop("place", at)
    return made.withColumn("status", F.when(F.col("shard").isNull(), "waiting").otherwise("accepted"))


def sent_count(admitted: DataFrame) -> DataFrame:
    """(sent): what an asynchronous batch comes to; a closed shard isn't an error
    but a lower count."""
    return admitted.agg(F.count(F.when(F.col("status") == "accepted", 1)).alias("sent"))


def send_batch_timeout(df: DataFrame, ordinal: str, room_at: Column, timeout: float, *, per: str = "call") -> DataFrame:
    """A blocking batch with a deadline.  ``room_at`` is when, after the call's
    start, there is room for a row; rows are sent one after the other, shard by
    shard, each as soon as there is room for it and the one before is sent.

    ``per`` "call": one deadline for the whole batch; "shard": each shard has
    ``timeout`` from when the one before it was done.  The batch stops at the
    first row that would be late; the rest comes back as timeout (of that shard)
    or unsent.  Adds rn, status and position."""
    if per not in ("call", "shard"):
        raise ValueError("per is 'call' or 'shard'")
    ranked = with_position(df, ordinal, ["shard"])
    at, s, waits, stop = fresh(ranked, "at", "s", "waits", "stop")
    timed = ranked.withColumns({at: F.coalesce(room_at.cast("double"), F.lit(0.0)), s: F.coalesce("shard", F.lit(_LAST))})
    # One entry a shard: its rows, its longest wait, and then when it begins.
    shard = timed.groupBy(F.col(s).alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.max(at).alias("most"))
    listed = shard.agg(F.array_sort(F.collect_list(F.struct("shard", "n", "most"))).alias("xs"))
    begins = lambda x: F.aggregate(F.filter("xs", lambda y: y["shard"] < x["shard"]), F.lit(0.0), lambda m, y: F.greatest(m, y["most"]))
    listed = listed.select(F.transform("xs", lambda x: F.struct(x["shard"].alias("shard"), x["n"].alias("n"), x["most"].alias("most"), ((begins(x) if per == "shard" else F.lit(0.0)) + timeout).alias("deadline"))).alias(waits))
    late = F.filter(waits, lambda x: (x["shard"] < _LAST) & (x["most"] > x["deadline"]))
    listed = listed.withColumn(stop, F.get(F.array_sort(late), 0))
    made = timed.crossJoin(F.broadcast(listed))
    # In the shard that stops, the first late row and what follows it come back.
    first = made.where((F.col(s) == F.col(f"{stop}.shard")) & (F.col(at) > F.col(f"{stop}.deadline"))).agg(F.min("rn").alias("from"))
    (start,) = fresh(made, "from")
    made = made.crossJoin(F.broadcast(first.withColumnRenamed("from", start)))
    halted = F.col(f"{stop}.shard")
    fits = (F.col(s) < _LAST) & (halted.isNull() | (F.col(s) < halted) | ((F.col(s) == halted) & (F.col("rn") < F.col(start))))
    made = made.withColumn("status", F.when(fits, "accepted").when(F.col(s) == halted, "timeout").otherwise("unsent"))
    rest = lambda x: F.when(x["shard"] == halted, x["n"] - F.col(start) + 1).when((x["shard"] == _LAST) | (x["shard"] > halted), x["n"]).otherwise(0)
    before = F.aggregate(F.filter(waits, lambda x: x["shard"] < F.col(s)), F.lit(0).cast("long"), lambda m, x: m + F.coalesce(rest(x), F.lit(0)).cast("long"))
    own = F.col("rn") - F.when(F.col(s) == halted, F.col(start) - 1).otherwise(0)
    return made.withColumn("position", F.when(~fits, before + own)).drop(at, s, waits, stop, start)


def batch_outcome(admitted: DataFrame, key: str) -> DataFrame:
    """One row: sent, left, status, and the shard and key of the first unsent row
    of the failed shard (empty key if none)."""
    failed = F.col("status").isin("full", "timeout", "disconnected")
    head = F.min(F.when(failed, F.struct("position", "shard", "status", F.col(key).alias("key"))))
    made = admitted.agg(F.sum((F.col("status") == "accepted").cast("long")).alias("sent"), F.sum((F.col("status") != "accepted").cast("long")).alias("left"), head.alias("head"))
    return made.select(F.coalesce("sent", F.lit(0)).alias("sent"), F.coalesce("left", F.lit(0)).alias("left"), F.coalesce("head.status", F.lit("ok")).alias("status"), F.col("head.shard").alias("shard"), F.coalesce("head.key", F.lit("")).alias("key"))
