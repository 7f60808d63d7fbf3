"""Receiving: frames, end-of-input flags, fair merges over shards, timed polls."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordinals import frame_of, fresh, most_before, with_position

#: Shards that a merge can order.
MOST_SHARDS = 1 << 16


def framed(df: DataFrame, ordinal: str, size: int) -> DataFrame:
    """Adds rn and frame: a shard's rows, in order, in frames of ``size``."""
    return with_position(df, ordinal, ["shard"]).withColumn("frame", frame_of(F.col("rn"), size))


def frames(df: DataFrame, ordinal: str, size: int) -> DataFrame:
    """(shard, frame, n, dc): the calls that drain closed shards.  The flag comes
    with the last rows only if the last frame holds a single row; otherwise one
    more call returns no row and the flag.  They follow from the rows of each
    shard; ``ordinal`` tells which rows are in which frame and isn't needed here."""
    rows = df.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"))
    last = F.floor((F.col("rows") - 1) / size)
    rest = F.col("rows") - last * size
    every = F.sequence(F.lit(0).cast("long"), last + F.when(rest == 1, 0).otherwise(1))
    calls = rows.select("shard", "rows", F.explode(every).alias("frame"))
    n = F.greatest(F.least(F.lit(size).cast("long"), F.col("rows") - F.col("frame") * size), F.lit(0).cast("long"))
    return calls.select("shard", "frame", n.alias("n"), ((n == 0) | ((n == 1) & (F.col("frame") * size + 1 == F.col("rows")))).alias("dc"))


def sizes_of(df: DataFrame, name: str) -> DataFrame:
    """One row: an array of (shard, n), the rows of all shards that have any, in order."""
    counts = df.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    listed = counts.agg(F.array_sort(F.collect_list(F.struct("shard", "n"))).alias(name))
    too_many = F.raise_error(F.lit(f"more than {MOST_SHARDS} shards")).cast(listed.schema[name].dataType)
    return listed.select(F.when(F.size(name) > MOST_SHARDS, too_many).otherwise(F.col(name)).alias(name))


def _sum(shards: Column, value) -> Column:
    return F.aggregate(shards, F.lit(0).cast("long"), lambda s, x: s + value(x).cast("long"))


def merge_any(df: DataFrame, ordinal: str) -> DataFrame:
    """Adds position: one row of each shard in turn, the order in which a fair
    poller takes rows from filled, closed shards.  A row's place follows from its
    place in its shard and from how many rows the shards have."""
    ranked = with_position(df, ordinal, ["shard"])
    (sizes,) = fresh(ranked, "sizes")
    made = ranked.crossJoin(F.broadcast(sizes_of(df, sizes)))
    rn, shard = F.col("rn"), F.col("shard")
    earlier = _sum(F.col(sizes), lambda x: F.least(x["n"], rn - 1))
    return made.withColumn("position", earlier + _sum(F.col(sizes), lambda x: F.when((x["n"] >= rn) & (x["shard"] <= shard), 1).otherwise(0))).drop(sizes)


def merge_frames(df: DataFrame, ordinal: str, size: int, shards: int) -> DataFrame:
    """Adds frame and position: call c takes a frame of each shard, starting with
    shard c, and the cursor advances by one a call."""
    made = framed(df, ordinal, size)
    (sizes,) = fresh(made, "sizes")
    made = made.crossJoin(F.broadcast(sizes_of(df, sizes)))
    rn, shard, frame = F.col("rn"), F.col("shard"), F.col("frame")
    turn = lambda s: F.pmod(s - frame, F.lit(shards))
    done = frame * size
    earlier = _sum(F.col(sizes), lambda x: F.least(x["n"], done))
    call = _sum(F.col(sizes), lambda x: F.when(turn(x["shard"]) < turn(shard), F.greatest(F.least(x["n"] - done, F.lit(size).cast("long")), F.lit(0).cast("long"))).otherwise(0))
    return made.withColumn("position", earlier + call + rn - done).drop(sizes)


def ticks(df: DataFrame, ordinal: str, at: Column, timeout: Column | float, by: list[str] | None = None) -> DataFrame:
    """Adds timeouts: the polls of ``timeout`` that came back empty before the row
    arrived, as a loop that polls again at once has them.  Rows arrive at ``at``,
    which grows with ``ordinal``; a row that arrives just as a poll ends is taken.
    The first row of a shard has none."""
    before, when = fresh(df, "before", "at")
    timed = df.withColumn(when, at)
    made = most_before(timed, ordinal, by or ["shard"], F.col(when), before)
    waits = F.ceil((F.col(when) - F.col(before)) / timeout) - 1
    return made.withColumn("timeouts", F.greatest(F.coalesce(waits, F.lit(0)), F.lit(0)).cast("long")).drop(before, when)


def any_outcome(df: DataFrame, shards: int, closed: list[int] | None = None) -> DataFrame:
    """(rows, disconnected_shards, status): what a poll of any shard comes to once
    the rows are taken: ``disconnected`` when all shards are closed, else ``empty``."""
    gone = len(set(range(shards)) & set(range(shards) if closed is None else closed))
    return df.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.lit(gone).alias("disconnected_shards"), F.lit("disconnected" if gone == shards else "empty").alias("status"))


def receive(df: DataFrame, shard: int, shards: int) -> DataFrame:
    """A shard's rows; the number is taken modulo the count."""
    return df.where(F.col("shard") == shard % shards)


def polled(df: DataFrame, ordinal: str, shards: int, taken: int, closed: list[int] | None = None) -> DataFrame:
    """(shard, status, value): a poll of each shard after ``taken`` rows were taken
    from it: the next ordinal, or empty; a closed shard is disconnected only once
    it is drained."""
    next_row = with_position(df, ordinal, ["shard"]).where(F.col("rn") == taken + 1).select(F.col("shard").alias("own"), F.col(ordinal).alias("value"))
    every = df.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    made = every.join(next_row, F.col("shard") == F.col("own"), "left")
    done = F.when(F.col("shard").isin(closed if closed is not None else list(range(shards))), "disconnected").otherwise("empty")
    return made.select("shard", F.when(F.col("own").isNotNull(), "item").otherwise(done).alias("status"), "value")


def timed_frames(df: DataFrame, ordinal: str, size: int, at: Column, timeout: float) -> DataFrame:
    """(shard, calls, empty_calls, rows): batched polls with a timeout.  A call waits
    up to ``timeout`` for its first row and takes what else is there, so calls that
    come back empty are the empty polls before a frame's first row."""
    waited = ticks(df, ordinal, at, timeout)
    made = framed(waited, ordinal, size).groupBy("shard", "frame").agg(F.min(F.struct("rn", "timeouts"))["timeouts"].alias("empty"), F.count(F.lit(1)).alias("n"))
    return made.groupBy("shard").agg((F.count(F.lit(1)) + F.sum("empty")).alias("calls"), F.sum("empty").alias("empty_calls"), F.sum("n").alias("rows"))


def iterate(df: DataFrame, ordinal: str):
    """The rows one by one, in order, a partition at a time: the driver holds no more."""
    return df.orderBy(ordinal).toLocalIterator(prefetchPartitions=True)


def compete(df: DataFrame, receivers: int, *keys: str) -> DataFrame:
    """Adds receiver: clones of a receiver compete for its rows, and each row goes
    to exactly one of them, here by a hash of ``keys``; order among them is lost."""
    return df.withColumn("receiver", F.pmod(F.xxhash64(*keys), F.lit(receivers)).cast("int"))


def queued(sent: DataFrame, received: DataFrame, shards: int) -> DataFrame:
    """(shard, queued): rows sent and not yet received."""
    one = lambda df, sign: df.groupBy("shard").agg((F.lit(sign) * F.count(F.lit(1))).alias("n"))
    sums = one(sent, 1).unionByName(one(received, -1)).groupBy("shard").agg(F.sum("n").alias("queued"))
    ids = sent.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    return ids.join(sums, "shard", "left").select("shard", F.coalesce("queued", F.lit(0)).alias("queued"))
