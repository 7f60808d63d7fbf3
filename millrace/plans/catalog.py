"""The registered queries of the engine and their SQL.

Shards: 4 unless said; frames of 64; capacity 512.  Money values are summed in
whole cents, so that results don't depend on the order of summation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import FNV_OFFSET, FNV_PRIME, key_shard, wrapping_affine
from ..functions.ordinals import with_position
from ..operators import admission, apps, audit, channels, elastic, folds, handlers, receive, routing
from ..sources.tables import table
from ..streaming import jobs, pool

SHARDS, FRAME, CAPACITY, HOURLY = 4, 64, 512, 24
ROUTES = routing.Routes.from_groups([["click", "view"], ["purchase"], ["signup"]])


def cents(column: str = "value"):
    return F.round(F.col(column) * 100).cast("long")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def sharded(spark, sf_dir, *columns: str) -> DataFrame:
    return routing.by_key(events(spark, sf_dir).select("event_id", "event_type", *columns), "event_type", SHARDS, "short")


def route_key(spark, sf_dir):
    return sharded(spark, sf_dir).groupBy("shard").agg(F.count(F.lit(1)).alias("n"))


def route_key_assignment(spark, sf_dir):
    keys = table(spark, sf_dir, "nation").select(F.col("n_name").alias("key"))
    keys = keys.union(table(spark, sf_dir, "orders").select("o_orderpriority")).union(events(spark, sf_dir).select("event_type")).distinct()
    return keys.select("key", key_shard(F.col("key"), 8, "short").alias("shard"))


def route_key_long(spark, sf_dir):
    """Keys beyond 16 bytes take the other hash: the same key, the same shard."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url").union(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"))
    return routing.by_key(pages, "url", 8).select("page_id", "url", "shard")


def route_round_robin(spark, sf_dir):
    return routing.round_robin(events(spark, sf_dir).select("event_id"), "event_id", SHARDS).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("id_sum"))


def route_round_robin_producers(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", (F.col("user_id") % 2).alias("producer"))
    return routing.round_robin_producers(rows, "event_id", "producer", SHARDS).groupBy("producer", "shard").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("id_sum"))


def route_round_robin_batch(spark, sf_dir):
    return routing.round_robin_batches(events(spark, sf_dir).select("event_id"), "event_id", SHARDS, FRAME).groupBy("shard", "batch").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


def route_group(spark, sf_dir):
    routed = routing.by_group(events(spark, sf_dir).select("event_id", "event_type"), "event_type", ROUTES)
    counts = routed.where("shard is not null").groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    return routing.all_shards(spark, ROUTES.shards).join(counts, "shard", "left").select("shard", F.coalesce("n", F.lit(0)).alias("n"))


def route_group_unused(spark, sf_dir):
    return routing.unused(events(spark, sf_dir).select("event_id", "event_type"), "event_type", ROUTES)


def route_static(spark, sf_dir):
    return routing.static(events(spark, sf_dir).select("event_id", "user_id"), F.col("user_id"), 3).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("id_sum"))


def shard_skew(spark, sf_dir):
    return routing.skew(sharded(spark, sf_dir), spark, 8)


def admit_try_send(spark, sf_dir):
    return admission.try_send(sharded(spark, sf_dir), "event_id", CAPACITY).groupBy("shard", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("id_sum"))


def admit_try_send_batch(spark, sf_dir):
    return admission.try_send_batch(sharded(spark, sf_dir), "event_id", CAPACITY).groupBy("shard", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("id_sum"))


def batch_remainder_order(spark, sf_dir):
    batch = routing.by_group(events(spark, sf_dir).select("event_id", "event_type"), "event_type", ROUTES)
    return admission.try_send_batch(batch, "event_id", 1500).where("status <> 'accepted'").select("event_id", "shard", "status", "position")


def batch_error(spark, sf_dir):
    return admission.batch_outcome(admission.try_send_batch(sharded(spark, sf_dir), "event_id", CAPACITY), "event_type")


def _counted(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("id_sum"))


def rotate_try_send(spark, sf_dir):
    """A row that finds its shard full has used its turn all the same."""
    channel = channels.shared(spark, 700, channels.ROTATION, 3)
    return _counted(channel.try_send(events(spark, sf_dir).select("event_id"), "event_id"), "shard", "status")


def group_try_send(spark, sf_dir):
    return _counted(admission.try_send_grouped(events(spark, sf_dir).select("event_id", "event_type"), "event_id", "event_type", ROUTES, CAPACITY), "shard", "status")


def static_try_send(spark, sf_dir):
    channel = channels.single(spark, CAPACITY, 3)
    return _counted(channel.try_send(events(spark, sf_dir).select("event_id", "user_id"), "event_id", "user_id", closed=[2]), "shard", "status")


def send_timeout(spark, sf_dir):
    """Room comes up to 12 seconds after a row; a wait of over 9 is too long."""
    rows = events(spark, sf_dir).select("event_id", F.col("event_id").cast("double").alias("sent_at"), (F.col("event_id") + F.col("event_id") % 13).cast("double").alias("room_at"))
    return _counted(admission.send(rows, sent_at="sent_at", room_at="room_at", timeout=9.0), "status")


def send_cancelled(spark, sf_dir):
    """Each eleventh send is cancelled: its item is still in the caller's slot."""
    return _counted(admission.send_ref(events(spark, sf_dir).select("event_id"), F.col("event_id") % 11 == 0), "status", "in_slot")


def batch_send_closed(spark, sf_dir):
    """A blocking batch by key; the shard after the first is closed."""
    return admission.send_batch(sharded(spark, sf_dir), "event_id", closed=[1]).select("event_id", "shard", "status", "position")


def batch_send_group(spark, sf_dir):
    """A blocking batch by route: unregistered keys come back, last."""
    batch = routing.by_group(events(spark, sf_dir).select("event_id", "event_type"), "event_type", ROUTES)
    return admission.send_batch(batch, "event_id").where("status <> 'accepted'").select("event_id", "status", "position")


def batch_spread(spark, sf_dir):
    """A batch larger than all room, with shard 2 nearly full."""
    return _counted(admission.spread_batch(events(spark, sf_dir).select("event_id"), "event_id", SHARDS, CAPACITY, queued={2: 500}), "shard", "status")


def batch_send_async(spark, sf_dir):
    """How many rows got in before the closed shard."""
    return admission.sent_count(admission.send_batch(sharded(spark, sf_dir), "event_id", closed=[1]))


def batch_send_static(spark, sf_dir):
    """One producer a shard, each with its own batch."""
    channel = channels.single(spark, CAPACITY, 3)
    sent = admission.try_send(channel.route(events(spark, sf_dir).select("event_id", "user_id"), "event_id", "user_id"), "event_id", channel.capacity)
    return _counted(sent, "shard", "status")


def _room():
    """Seconds until there is room: longer for later shards."""
    return F.col("shard") * F.col("shard") * 10 + F.col("event_id") % 7


def batch_deadline_call(spark, sf_dir):
    """One deadline for the whole batch."""
    return admission.send_batch_timeout(sharded(spark, sf_dir), "event_id", _room(), 15.0).select("event_id", "shard", "status", "position")


def batch_deadline_shard(spark, sf_dir):
    """A deadline for each shard, from when the one before it was done."""
    return admission.send_batch_timeout(sharded(spark, sf_dir), "event_id", _room(), 25.0, per="shard").select("event_id", "shard", "status", "position")


def recv_ticks(spark, sf_dir):
    """A loop that polls each shard for two hours at a time: polls that came back empty."""
    rows = receive.ticks(sharded(spark, sf_dir, "ts"), "event_id", F.unix_seconds(F.col("ts").cast("timestamp")), 7200)
    return rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum("timeouts").alias("timeouts"), F.max("timeouts").alias("longest"))


def recv_polled(spark, sf_dir):
    """Polls after 2000 rows of each shard; shard 3 is still open."""
    return receive.polled(sharded(spark, sf_dir), "event_id", SHARDS, 2000, closed=[0, 1, 2])


def recv_batch_timed(spark, sf_dir):
    return receive.timed_frames(sharded(spark, sf_dir, "ts"), "event_id", FRAME, F.unix_seconds(F.col("ts").cast("timestamp")), 600)


def game_loop(spark, sf_dir):
    """Inputs of an hour beyond its room are dropped, and the loop ticks every
    quarter of an hour in which nothing comes."""
    hour = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600)
    rows = events(spark, sf_dir).select("event_id", hour.cast("int").alias("shard"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))
    tried = admission.try_send(rows, "event_id", HOURLY // 2)
    ticked = receive.ticks(tried.withColumn("loop", F.lit(0)), "event_id", F.col("at"), 900, ["loop"])
    return ticked.groupBy(F.when(F.col("status") == "accepted", "played").otherwise("dropped").alias("input")).agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("id_sum"), F.sum("timeouts").alias("ticks"))


def recv_shard(spark, sf_dir):
    """Shard numbers of a receiver wrap around: 9 of 4 is 1."""
    return receive.receive(sharded(spark, sf_dir), 9, SHARDS).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("id_sum"))


def take_pairs(spark, sf_dir):
    """Shards handed out one by one: 2, then all that are left."""
    pairs = routing.Pairs(sharded(spark, sf_dir), SHARDS)
    taken = [(0, 2, pairs.take(2)), *[(1, i, rows) for i, rows in pairs.rest()]]
    made = None
    for turn, shard, rows in taken:
        own = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(turn).alias("turn"), F.lit(shard).alias("shard"), "n")
        made = own if made is None else made.unionByName(own)
    return made


def competing(spark, sf_dir):
    """Three clones of a receiver: each row goes to exactly one."""
    own = receive.compete(events(spark, sf_dir).select("event_id"), 3, "event_id")
    per = own.groupBy("receiver").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("id_sum"))
    return per.agg(F.count(F.lit(1)).alias("receivers"), F.sum("n").alias("n"), F.sum("id_sum").alias("id_sum"))


def queue_depth(spark, sf_dir):
    sent = sharded(spark, sf_dir)
    return receive.queued(sent, sent.where("event_id % 5 <> 0"), SHARDS)


def recv_any_closed(spark, sf_dir):
    return receive.any_outcome(sharded(spark, sf_dir), SHARDS)


def drain_total(spark, sf_dir):
    """What the caller makes of the shards' results."""
    return drain_fold(spark, sf_dir).agg(F.count(F.lit(1)).alias("shards"), F.sum("n").alias("n"), F.sum("cents").alias("cents"), F.max("max_event_id").alias("max_event_id"))


#: Multiplier and increment of the benchmark's generator.
LCG_MUL, LCG_ADD = 6364136223846793005, 1442695040888963407


def lcg_work(spark, sf_dir):
    """5000 steps of the generator from each id, modulo 2**31."""
    low = F.pmod(wrapping_affine(F.col("event_id"), 5000, LCG_MUL, LCG_ADD), F.lit(1 << 31).cast("decimal(20,0)")).cast("long")
    return events(spark, sf_dir).select("event_id", low.alias("v"))


def frames(spark, sf_dir):
    return receive.frames(sharded(spark, sf_dir), "event_id", FRAME)


def merge_any(spark, sf_dir):
    return receive.merge_any(sharded(spark, sf_dir), "event_id").select("event_id", "shard", "position")


def merge_batch_any(spark, sf_dir):
    return receive.merge_frames(sharded(spark, sf_dir), "event_id", FRAME, SHARDS).select("event_id", "shard", "frame", "position")


def drain_fold(spark, sf_dir):
    return folds.drain(sharded(spark, sf_dir, "value"), F.count(F.lit(1)).alias("n"), F.sum(cents()).alias("cents"), F.max("event_id").alias("max_event_id"))


def drain_sink(spark, sf_dir):
    made = folds.drain_frames(
        sharded(spark, sf_dir, "value"), "event_id", FRAME,
        [F.count(F.lit(1)).alias("n"), F.sum(cents()).alias("cents"), F.max("event_id").alias("top")],
        [F.sum("n").alias("n"), F.count(F.lit(1)).alias("frames"), F.sum("cents").alias("cents"), F.max("top").alias("max_event_id")],
    )
    return made.withColumn("items_per_write", F.round(F.col("n") / F.col("frames"), 6))


def ordered_fold(spark, sf_dir):
    return folds.affine_fold(events(spark, sf_dir), "user_id", "event_id", F.col("event_id"), mul=31, mod=1_000_003, start=7).select("user_id", "h", "n")


def fifo_violations(spark, sf_dir):
    merged = receive.merge_any(sharded(spark, sf_dir), "event_id")
    return audit.fifo_violations(merged, "event_type", "position", "event_id").select("event_id", "event_type")


def fifo_violations_found(spark, sf_dir):
    """Each tenth event comes some places late; those of its type that it then
    follows make it a violation."""
    late = F.col("event_id") * 2 + F.when(F.col("event_id") % 10 == 3, 31).otherwise(0)
    return audit.fifo_violations(events(spark, sf_dir).select("event_id", "event_type", late.alias("place")), "event_type", "place", "event_id").select("event_id", "event_type", "place")


def poisoned(slot):
    if slot.peek()["event_id"] % 7 == 0:
        raise ValueError("multiple of seven")


def dead_letter(spark, sf_dir):
    made = handlers.handle(sharded(spark, sf_dir), poisoned)
    return made.groupBy("shard", "status", "reason").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("id_sum"))


def dead_letter_native(spark, sf_dir):
    """The same handler as an expression; multiples of 14 fail after the item is taken."""
    made = handlers.classify(sharded(spark, sf_dir), F.col("event_id") % 7 == 0, F.col("event_id") % 14 == 0, F.lit("multiple of seven"))
    return made.groupBy("shard", "status", "reason").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("id_sum"))


def inserting(slot):
    """Odd ids are inserted; even ones are rejected, multiples of 10 after the
    item was taken."""
    i = slot.peek()["event_id"]
    if i % 10 == 0:
        slot.take()
        raise RuntimeError("rejected after take")
    if i % 2 == 0:
        raise RuntimeError("rejected")
    slot.take()


def slot_outcomes(spark, sf_dir):
    made = handlers.handle(events(spark, sf_dir).select("event_id"), inserting)
    return made.groupBy("status", "reason").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("id_sum"))


def zero_loss_audit(spark, sf_dir):
    """Rows that were taken before they failed are lost, and some are done twice."""
    sent = sharded(spark, sf_dir)
    done = handlers.classify(sent, F.col("event_id") % 7 == 0, F.col("event_id") % 14 == 0).where("status in ('processed', 'dead_letter')")
    return audit.conservation(sent, done.unionByName(done.where("event_id % 101 = 7")), ["shard"], "event_id")


def hourly(spark, sf_dir) -> DataFrame:
    """(hour, queued): rows of each hour; hours count from the first."""
    hour = F.unix_seconds(F.date_trunc("hour", F.col("ts")).cast("timestamp")) / 3600
    return events(spark, sf_dir).groupBy(hour.cast("long").alias("hour")).agg(F.count(F.lit(1)).alias("queued"))


def fill_ratio(spark, sf_dir):
    return elastic.fill_ratio(hourly(spark, sf_dir), "hour", "queued", HOURLY)


def _trace(spark, sf_dir):
    fills = with_position(fill_ratio(spark, sf_dir), "hour", name="step").withColumn("step", F.col("step") - 1)
    return elastic.trace(fills, "step", "fill", elastic.PoolConfig(1, 8))


def elastic_trace(spark, sf_dir):
    return _trace(spark, sf_dir).select("step", "active")


def shard_ownership(spark, sf_dir):
    return elastic.ownership(_trace(spark, sf_dir), SHARDS).groupBy("owner", "shard").agg(F.count(F.lit(1)).alias("samples"))


def risk_filter(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    made = apps.risk_filter(orders, "o_custkey", "o_orderkey", cents("o_totalprice"), 100_000_000)
    return made.select("o_orderkey", "o_custkey", "exposure", "accepted")


def event_router(spark, sf_dir):
    made = apps.event_router(events(spark, sf_dir).select("event_id", "event_type"), "event_type", "event_id", SHARDS, 3)
    return made.groupBy("shard", "notifier").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("id_sum"))


def heavy_transform(spark, sf_dir):
    low = F.pmod(wrapping_affine(F.col("event_id"), 2000), F.lit(1 << 31).cast("decimal(20,0)")).cast("long")
    return events(spark, sf_dir).select("event_id", low.alias("v"))


SYMBOLS = ["AAPL", "MSFT", "GOOG", "AMZN", "NVDA", "META", "TSLA", "AMD", "INTC", "NFLX", "BTC", "ETH"]


def trade_checksum(spark, sf_dir):
    ids = events(spark, sf_dir).select(F.col("event_id").alias("id"))
    return audit.checksum(apps.trades(ids, SYMBOLS, 4, 2500), ["s"], "t")


def _orders(spark, sf_dir) -> DataFrame:
    """Events as orders: type picks the symbol, parity the side."""
    return events(spark, sf_dir).select(
        F.col("event_type").alias("symbol"), F.col("event_id").alias("ordinal"), F.when(F.col("user_id") % 2 == 0, "B").otherwise("S").alias("side"),
        (F.col("event_id") * 7919 % 101).cast("double").alias("price"), (F.col("event_id") % 5 + 1).alias("qty"),
    )


def matching(spark, sf_dir):
    return apps.matching_engine(_orders(spark, sf_dir))


def shard_average(spark, sf_dir):
    rows = routing.static(events(spark, sf_dir).select("user_id", "value"), F.col("user_id"), 3)
    return folds.drain(rows, F.count(F.lit(1)).alias("n"), F.round(F.sum(cents()) / F.count(F.lit(1)), 6).alias("avg_cents"))


def sector(spark, sf_dir):
    """Regions as sectors: nations are routed by an explicit map."""
    groups = {f"NATION_{i}": g for i, g in enumerate((0, 0, 1, 1, 2, 2, 3, 5))}
    routes = routing.Routes.from_map(groups, 3)
    return routing.by_group(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_name", routes).where("shard is not null")


def _streamed(spark, sf_dir, files: int = 4) -> DataFrame:
    rows = sharded(spark, sf_dir, "user_id", "value")
    return jobs.source(spark, jobs.in_files(rows, "event_id", files), rows.schema, 1)


def _shard_sums(df: DataFrame) -> DataFrame:
    return df.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum(cents()).alias("cents"))


def _total(df: DataFrame) -> DataFrame:
    return df.groupBy("shard").agg(F.sum("n").alias("n"), F.sum("cents").alias("cents"))


SUMS = "shard int, n long, cents long"


def stream_fold(spark, sf_dir):
    return jobs.fold(_streamed(spark, sf_dir), _shard_sums, _total, SUMS)


def _in_turns(spark, sf_dir, late_first: bool) -> DataFrame:
    """Even hours and odd hours as two batches, or halves of the ids in order."""
    rows = sharded(spark, sf_dir, "user_id", "value")
    first = F.col("event_id") % 5 == 4 if late_first else F.col("event_id") < 3000
    return jobs.source(spark, jobs.in_turns([rows.where(first), rows.where(~first)]), rows.schema, 1)


def stream_fifo_state(spark, sf_dir):
    """Batches in order: nothing is late."""
    return jobs.fifo_state(_in_turns(spark, sf_dir, False), "event_type", "event_id")


def stream_fifo_late(spark, sf_dir):
    """Each fifth event comes in the first batch: of the others those are late that
    a larger one of their type came before."""
    return jobs.fifo_state(_in_turns(spark, sf_dir, True), "event_type", "event_id")


def stream_matching(spark, sf_dir):
    """The orders of ``matching`` as a stream, with the books kept as state."""
    rows = _orders(spark, sf_dir)
    cut = rows.where("ordinal < 1500"), rows.where("ordinal >= 1500 and ordinal < 4000"), rows.where("ordinal >= 4000")
    return jobs.matching(jobs.source(spark, jobs.in_turns(list(cut)), rows.schema, 1))


def stream_stop_resume(spark, sf_dir):
    """Stopped after two batches and started again on the same checkpoint."""
    stream = _streamed(spark, sf_dir, 8)
    out, check = jobs.new_path(spark, "stream-fold"), jobs.new_path(spark, "stream-check")
    jobs.run_until(jobs.start_paced(stream, jobs.batch_sink(out, _shard_sums), check), 2)
    done = jobs.results(spark, out, SUMS).agg(F.sum("n")).first()[0]
    jobs.drain(stream, jobs.batch_sink(out, _shard_sums), check)
    made = _total(jobs.results(spark, out, SUMS))
    return made.crossJoin(F.broadcast(made.agg(F.sum("n").alias("all")))).select("shard", "n", "cents", (F.lit(done) < F.col("all")).alias("left_at_stop"))


def stream_dead_letter(spark, sf_dir):
    good, dead = jobs.with_dead_letters(_streamed(spark, sf_dir), poisoned, ["event_id", "shard"])
    return good.unionByName(dead).groupBy("shard", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("id_sum"))


def pool_stream(spark, sf_dir):
    """A pool drains the stream; its dead letters go to a sink of the caller's, and
    its counters agree with its rows."""
    dead = jobs.new_path(spark, "letters")
    own = pool.Pool(
        _streamed(spark, sf_dir), fails=F.col("event_id") % 7 == 0, takes=F.col("event_id") % 14 == 0, reason=F.lit("seven"), capacity=4096,
        dead_letter=lambda df, batch: jobs.batch_sink(dead)(df, batch),
    )
    own.start().wait_stopping()
    rows = own.rows()
    letters = jobs.results(spark, dead, rows.schema)
    counts = rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("id_sum"))
    kept = letters.agg(F.lit("in the sink").alias("status"), F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("id_sum"))
    seen = spark.createDataFrame([("counted processed", own.processed, None), ("counted panics", own.handler_panics, None), ("failures of the sink", own.sink_failures, None)], "status string, n long, id_sum long")
    return counts.unionByName(kept).unionByName(seen)


def pool_failing_sink(spark, sf_dir):
    """A sink that fails itself is counted once a batch, and nothing stops."""

    def broken(df, batch):
        raise RuntimeError("no letters today")

    own = pool.Pool(_streamed(spark, sf_dir), fails=F.col("event_id") % 7 == 0, dead_letter=broken)
    own.start().wait_stopping()
    return own.rows().agg(F.count(F.lit(1)).alias("rows")).select("rows", F.lit(own.dead_letters).alias("dead"), F.lit(own.sink_failures).alias("sink_failures"))


def pool_stop(spark, sf_dir):
    """Stopped by a handle while it runs: the batch under way is finished, what was
    not begun stays behind, and a pool on the same checkpoint takes it up."""
    stream = _streamed(spark, sf_dir, 10)
    first = pool.Pool(stream, fails=F.lit(False))
    stop = first.stop_handle()
    first.dead_letter = None
    first.start(drain=False)
    while not first.trace and not first.is_stopped():
        first.wait_stopping(0.05)
    stop.stop()
    first.wait_stopping()
    before = first.rows().count()
    again = pool.Pool(stream, fails=F.lit(False), path=first.path, checkpoint=first.checkpoint)
    again.start().wait_stopping()
    made = again.rows().agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("event_id").alias("ids"))
    return made.select("rows", "ids", (F.lit(before) > 0).alias("begun"), (F.lit(before) < F.col("rows")).alias("left_at_stop"), F.lit(first.is_stopped()).alias("stopped"))


_ALL = (
    route_key, route_key_assignment, route_key_long, route_round_robin, route_round_robin_producers, route_round_robin_batch, route_group, route_group_unused, route_static, shard_skew,
    admit_try_send, admit_try_send_batch, batch_remainder_order, batch_error, frames, merge_any, merge_batch_any, drain_fold, drain_sink, ordered_fold, fifo_violations,
    dead_letter, slot_outcomes, zero_loss_audit, fill_ratio, elastic_trace, shard_ownership, risk_filter, event_router, heavy_transform, trade_checksum, matching, shard_average, sector,
    stream_fold, stream_fifo_state, stream_stop_resume, stream_dead_letter,
    batch_spread, batch_send_async, batch_send_static, recv_polled, recv_batch_timed,
    rotate_try_send, group_try_send, static_try_send, send_timeout, send_cancelled, batch_send_closed, batch_send_group, batch_deadline_call, batch_deadline_shard,
    recv_ticks, game_loop, recv_shard, take_pairs, competing, queue_depth, recv_any_closed, drain_total, lcg_work, fifo_violations_found, dead_letter_native,
    stream_fifo_late, stream_matching, pool_stream, pool_failing_sink, pool_stop,
)
QUERIES = {f.__name__: f for f in _ALL}


def fnv_sql(key: str) -> str:
    """FNV-1a modulo 2**20 of an ASCII key."""
    return f"list_reduce(list_prepend({FNV_OFFSET & 0xFFFFF}::BIGINT, list_transform(range(1, length({key}) + 1), lambda i: ascii(substr({key}, i::INT, 1))::BIGINT)), lambda h, b: (xor(h, b) * {FNV_PRIME & 0xFFFFF}) & 1048575)"


def _sharded_sql(n: int = SHARDS) -> str:
    return f"sharded AS (SELECT *, ({fnv_sql('event_type')} & {n - 1})::INT AS shard FROM events), ranked AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY event_id) AS rn FROM sharded)"


_GROUP = "CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 0 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 END::INT"
_CENTS = "sum(cast(round(value * 100) AS BIGINT))::BIGINT"
_BATCH = f"""b AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY event_id) AS rn FROM s),
stop AS (SELECT min(shard) AS stop FROM b WHERE rn > {{cap}} AND shard IS NOT NULL),
m AS (SELECT b.*, CASE WHEN shard IS NOT NULL AND rn <= {{cap}} AND (stop IS NULL OR shard <= stop) THEN 'accepted' WHEN shard = stop THEN 'full' ELSE 'unsent' END AS status FROM b, stop)"""
_WHOLE_BATCH = f"WITH s AS (SELECT event_id, event_type, ({fnv_sql('event_type')} & 3)::INT AS shard FROM events), " + _BATCH.format(cap=CAPACITY)
_TRACE = f"""RECURSIVE h AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1),
f AS (SELECT row_number() OVER (ORDER BY hour) - 1 AS step, least(n, {HOURLY})::DOUBLE / {HOURLY}::DOUBLE AS fill FROM h),
t(step, active) AS (
  SELECT -1::BIGINT, 1
  UNION ALL
  SELECT f.step, (CASE WHEN fill > 0.8::DOUBLE THEN least(greatest(ceil(fill * 8)::INT, active), 8) WHEN fill < 0.2::DOUBLE THEN greatest(active - 1, 1) ELSE active END)::INT
  FROM t JOIN f ON f.step = t.step + 1)"""


def _heavy(steps: int = 2000, mul: int = 31, add: int = 1) -> tuple[int, int]:
    a, b = 1, 0
    for _ in range(steps):
        a, b = a * mul % 2**31, (b * mul + add) % 2**31
    return a, b


_TALLY = "count(*) AS n, sum(event_id)::BIGINT AS id_sum"
_SHARDED_EVENTS = f"s AS (SELECT event_id, event_type, ({fnv_sql('event_type')} & 3)::INT AS shard FROM events)"
_ROOM = "(shard * shard * 10 + event_id % 7)"


def _deadline(per_shard: bool, timeout: float) -> str:
    """Rows by shard; the first shard with a row that is late stops the batch."""
    begins = "coalesce(max(most) OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)" if per_shard else "0"
    return f"""WITH {_SHARDED_EVENTS}, r AS (SELECT *, {_ROOM} AS room, row_number() OVER (PARTITION BY shard ORDER BY event_id) AS rn FROM s),
w AS (SELECT shard, max(room) AS most FROM r GROUP BY 1), d AS (SELECT shard, most, {begins} + {timeout} AS deadline FROM w),
stop AS (SELECT shard, deadline FROM d WHERE most > deadline ORDER BY shard LIMIT 1),
f AS (SELECT min(rn) AS first FROM r, stop WHERE r.shard = stop.shard AND room > deadline),
m AS (SELECT r.*, CASE WHEN h.shard IS NULL OR r.shard < h.shard OR r.shard = h.shard AND rn < f.first THEN 'accepted' WHEN r.shard = h.shard THEN 'timeout' ELSE 'unsent' END AS status
      FROM r LEFT JOIN stop h ON true LEFT JOIN f ON true)
SELECT event_id, shard, status, CASE WHEN status <> 'accepted' THEN row_number() OVER (PARTITION BY status = 'accepted' ORDER BY shard, rn) END AS position FROM m"""


def _ticks(by: str, seconds: int) -> str:
    gap = f"epoch(ts)::BIGINT - lag(epoch(ts)::BIGINT) OVER ({by} ORDER BY event_id)"
    return f"greatest(coalesce(ceil(({gap})::DOUBLE / {seconds}) - 1, 0), 0)::BIGINT"


_DRAIN = f"WITH {_sharded_sql()} SELECT shard, count(*)::BIGINT AS n, {_CENTS} AS cents"
ORACLES = {
    "route_key": f"WITH {_sharded_sql()} SELECT shard, count(*) AS n FROM sharded GROUP BY shard",
    "route_key_assignment": f"WITH k AS (SELECT n_name AS key FROM nation UNION SELECT o_orderpriority FROM orders UNION SELECT event_type FROM events) SELECT key, ({fnv_sql('key')} & 7)::INT AS shard FROM k",
    "route_round_robin": "SELECT ((rn - 1) & 3)::INT AS shard, count(*) AS n, sum(event_id)::BIGINT AS id_sum FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS rn FROM events) GROUP BY 1",
    "route_round_robin_producers": "SELECT producer, ((rn - 1 + producer) & 3)::INT AS shard, count(*) AS n, sum(event_id)::BIGINT AS id_sum FROM (SELECT event_id, user_id % 2 AS producer, row_number() OVER (PARTITION BY user_id % 2 ORDER BY event_id) AS rn FROM events) GROUP BY 1, 2",
    "route_round_robin_batch": f"SELECT (batch & 3)::INT AS shard, batch, count(*) AS n, min(event_id) AS first_id FROM (SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // {FRAME} AS batch FROM events) GROUP BY 1, 2",
    "route_group": f"SELECT r.range::INT AS shard, count(e.event_id) AS n FROM range(4) r LEFT JOIN events e ON {_GROUP} = r.range GROUP BY 1",
    "route_group_unused": "SELECT event_id, event_type FROM events WHERE event_type IS NULL OR event_type NOT IN ('click', 'view', 'purchase', 'signup')",
    "route_static": "SELECT (user_id % 3)::INT AS shard, count(*) AS n, sum(event_id)::BIGINT AS id_sum FROM events GROUP BY 1",
    "shard_skew": f"WITH {_sharded_sql()}, c AS (SELECT r.range AS shard, count(s.event_id) AS n FROM range(8) r LEFT JOIN sharded s ON s.shard = r.range GROUP BY 1) SELECT max(n) AS max_rows, avg(n) AS avg_rows, count(*) FILTER (WHERE n = 0) AS empty_shards, count(*) AS shards FROM c",
    "admit_try_send": f"WITH {_sharded_sql()} SELECT shard, CASE WHEN rn <= {CAPACITY} THEN 'accepted' ELSE 'full' END AS status, count(*) AS n, sum(event_id)::BIGINT AS id_sum FROM ranked GROUP BY 1, 2",
    "admit_try_send_batch": _WHOLE_BATCH + " SELECT shard, status, count(*) AS n, sum(event_id)::BIGINT AS id_sum FROM m GROUP BY 1, 2",
    "batch_remainder_order": f"WITH s AS (SELECT event_id, event_type, {_GROUP} AS shard FROM events), " + _BATCH.format(cap=1500) + " SELECT event_id, shard, status, row_number() OVER (ORDER BY shard NULLS LAST, rn) AS position FROM m WHERE status <> 'accepted'",
    "batch_error": _WHOLE_BATCH + ", head AS (SELECT shard, event_type AS key FROM m WHERE status = 'full' ORDER BY rn LIMIT 1) SELECT count(*) FILTER (WHERE status = 'accepted') AS sent, count(*) FILTER (WHERE status <> 'accepted') AS left, CASE WHEN (SELECT count(*) FROM head) > 0 THEN 'full' ELSE 'ok' END AS status, (SELECT shard FROM head) AS shard, coalesce((SELECT key FROM head), '') AS key FROM m".replace("AS left", 'AS "left"'),
    "frames": f"WITH {_sharded_sql()}, c AS (SELECT shard, (rn - 1) // {FRAME} AS frame, count(*) AS n FROM ranked GROUP BY 1, 2), l AS (SELECT *, frame = max(frame) OVER (PARTITION BY shard) AND n = 1 AS dc FROM c) SELECT * FROM l UNION ALL SELECT shard, max(frame) + 1, 0, true FROM l GROUP BY shard HAVING NOT bool_or(dc)",
    "merge_any": f"WITH {_sharded_sql()} SELECT event_id, shard, row_number() OVER (ORDER BY rn, shard) AS position FROM ranked",
    "merge_batch_any": f"WITH {_sharded_sql()} SELECT event_id, shard, (rn - 1) // {FRAME} AS frame, row_number() OVER (ORDER BY (rn - 1) // {FRAME}, ((shard - (rn - 1) // {FRAME}) % 4 + 4) % 4, rn) AS position FROM ranked",
    "drain_fold": _DRAIN + ", max(event_id) AS max_event_id FROM sharded GROUP BY shard",
    "drain_sink": _DRAIN + f", max(event_id) AS max_event_id, count(DISTINCT (rn - 1) // {FRAME}) AS frames, round(count(*)::DOUBLE / count(DISTINCT (rn - 1) // {FRAME}), 6) AS items_per_write FROM ranked GROUP BY shard",
    "ordered_fold": "SELECT user_id, list_reduce(list_prepend(7::BIGINT, list(event_id ORDER BY event_id)), lambda h, x: (h * 31 + x) % 1000003) AS h, count(*) AS n FROM events GROUP BY user_id",
    "fifo_violations": "SELECT event_id, event_type FROM events WHERE false",
    "fifo_violations_found": "WITH p AS (SELECT event_id, event_type, event_id * 2 + CASE WHEN event_id % 10 = 3 THEN 31 ELSE 0 END AS place FROM events), m AS (SELECT *, max(event_id) OVER (PARTITION BY event_type ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most FROM p) SELECT event_id, event_type, place FROM m WHERE most > event_id",
    "rotate_try_send": f"WITH p AS (SELECT event_id, ((row_number() OVER (ORDER BY event_id) - 1) & 3)::INT AS shard FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY event_id) AS rn FROM p) SELECT shard, CASE WHEN rn <= 1024 THEN 'accepted' ELSE 'full' END AS status, {_TALLY} FROM r GROUP BY 1, 2",
    "group_try_send": f"WITH p AS (SELECT event_id, {_GROUP} AS shard FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY event_id) AS rn FROM p) SELECT shard, CASE WHEN shard IS NULL THEN 'unregistered' WHEN rn <= {CAPACITY} THEN 'accepted' ELSE 'full' END AS status, {_TALLY} FROM r GROUP BY 1, 2",
    "static_try_send": f"WITH p AS (SELECT event_id, (user_id % 3)::INT AS shard FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY event_id) AS rn FROM p) SELECT shard, CASE WHEN shard = 2 THEN 'disconnected' WHEN rn <= {CAPACITY} THEN 'accepted' ELSE 'full' END AS status, {_TALLY} FROM r GROUP BY 1, 2",
    "send_timeout": f"SELECT CASE WHEN event_id % 13 <= 9 THEN 'accepted' ELSE 'timeout' END AS status, {_TALLY} FROM events GROUP BY 1",
    "send_cancelled": f"SELECT CASE WHEN event_id % 11 = 0 THEN 'cancelled' ELSE 'accepted' END AS status, event_id % 11 = 0 AS in_slot, {_TALLY} FROM events GROUP BY 1, 2",
    "batch_spread": f"""WITH RECURSIVE e AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS place FROM events),
t(step, lo, hi, rooms, first, last) AS (
  SELECT -1, 1::BIGINT, count(*)::BIGINT, [{CAPACITY}, {CAPACITY}, {CAPACITY - 500}, {CAPACITY}], 0::BIGINT, 0::BIGINT FROM e
  UNION ALL
  SELECT step + 1, CASE WHEN n IS NULL THEN hi + 1 WHEN step % 2 <> 0 THEN lo + n ELSE lo END, CASE WHEN n IS NOT NULL AND step % 2 = 0 THEN hi - 1 ELSE hi END,
         list_transform(range(0, 4), lambda i: rooms[i::INT + 1] - CASE WHEN i = (step + 1) % 4 THEN coalesce(n, 0) ELSE 0 END::INT),
         CASE WHEN step % 2 <> 0 THEN lo ELSE hi END, CASE WHEN step % 2 <> 0 THEN lo + coalesce(n, 0) - 1 WHEN n IS NULL THEN hi - 1 ELSE hi END
  FROM (SELECT *, CASE WHEN step % 2 <> 0 THEN least(rooms[(step + 1) % 4 + 1], hi - lo + 1) WHEN rooms[(step + 1) % 4 + 1] > 0 THEN 1 END::BIGINT AS n FROM t WHERE lo <= hi)),
p AS (SELECT e.event_id, (t.step % 4)::INT AS shard FROM e LEFT JOIN t ON t.step >= 0 AND e.place BETWEEN t.first AND t.last)
SELECT shard, CASE WHEN shard IS NULL THEN 'waiting' ELSE 'accepted' END AS status, {_TALLY} FROM p GROUP BY 1, 2""",
    "batch_send_async": f"WITH {_SHARDED_EVENTS} SELECT count(*) FILTER (WHERE shard < 1) AS sent FROM s",
    "batch_send_static": f"WITH p AS (SELECT event_id, (user_id % 3)::INT AS shard FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY event_id) AS rn FROM p) SELECT shard, CASE WHEN rn <= {CAPACITY} THEN 'accepted' ELSE 'full' END AS status, {_TALLY} FROM r GROUP BY 1, 2",
    "recv_polled": f"WITH {_sharded_sql()}, x AS (SELECT * FROM ranked WHERE rn = 2001) SELECT r.range::INT AS shard, CASE WHEN x.event_id IS NOT NULL THEN 'item' WHEN r.range = 3 THEN 'empty' ELSE 'disconnected' END AS status, x.event_id AS value FROM range(4) r LEFT JOIN x ON x.shard = r.range",
    "recv_batch_timed": f"WITH {_sharded_sql()}, t AS (SELECT shard, rn, {_ticks('PARTITION BY shard', 600)} AS ticks FROM ranked), f AS (SELECT shard, (rn - 1) // {FRAME} AS frame, arg_min(ticks, rn) AS empty, count(*) AS n FROM t GROUP BY 1, 2) SELECT shard, (count(*) + sum(empty))::BIGINT AS calls, sum(empty)::BIGINT AS empty_calls, sum(n)::BIGINT AS rows FROM f GROUP BY 1".replace("AS rows", 'AS "rows"'),
    "batch_send_closed": f"WITH {_SHARDED_EVENTS} SELECT event_id, shard, CASE WHEN shard < 1 THEN 'accepted' WHEN shard = 1 THEN 'disconnected' ELSE 'unsent' END AS status, CASE WHEN shard >= 1 THEN row_number() OVER (PARTITION BY shard >= 1 ORDER BY shard, event_id) END AS position FROM s",
    "batch_send_group": f"SELECT event_id, 'unsent' AS status, row_number() OVER (ORDER BY event_id) AS position FROM events WHERE {_GROUP} IS NULL",
    "batch_deadline_call": _deadline(False, 15),
    "batch_deadline_shard": _deadline(True, 25),
    "recv_ticks": f"WITH {_sharded_sql()}, t AS (SELECT shard, {_ticks('PARTITION BY shard', 7200)} AS timeouts FROM sharded) SELECT shard, count(*) AS n, sum(timeouts)::BIGINT AS timeouts, max(timeouts) AS longest FROM t GROUP BY 1",
    "game_loop": f"WITH t AS (SELECT event_id, {_ticks('', 900)} AS ticks, row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY event_id) AS rn FROM events) SELECT CASE WHEN rn <= {HOURLY // 2} THEN 'played' ELSE 'dropped' END AS input, {_TALLY}, sum(ticks)::BIGINT AS ticks FROM t GROUP BY 1",
    "recv_shard": f"WITH {_sharded_sql()} SELECT shard, {_TALLY} FROM sharded WHERE shard = 1 GROUP BY 1",
    "take_pairs": f"WITH {_sharded_sql()} SELECT (r.range <> 2)::INT AS turn, r.range::INT AS shard, count(s.event_id) AS n FROM range(4) r LEFT JOIN sharded s ON s.shard = r.range GROUP BY 1, 2",
    "competing": f"SELECT 3::BIGINT AS receivers, {_TALLY} FROM events",
    "queue_depth": f"WITH {_sharded_sql()} SELECT r.range::INT AS shard, (count(s.event_id) FILTER (WHERE s.event_id % 5 = 0))::BIGINT AS queued FROM range(4) r LEFT JOIN sharded s ON s.shard = r.range GROUP BY 1",
    "recv_any_closed": "SELECT count(*) AS rows, 4 AS disconnected_shards, 'disconnected' AS status FROM events".replace("AS rows", 'AS "rows"'),
    "drain_total": f"WITH {_sharded_sql()} SELECT count(DISTINCT shard) AS shards, count(*) AS n, {_CENTS} AS cents, max(event_id) AS max_event_id FROM sharded",
    "lcg_work": f"SELECT event_id, ((event_id::HUGEINT * {_heavy(5000, LCG_MUL, LCG_ADD)[0]} + {_heavy(5000, LCG_MUL, LCG_ADD)[1]}) % 2147483648)::BIGINT AS v FROM events",
    "dead_letter_native": f"WITH {_sharded_sql()} SELECT shard, CASE WHEN event_id % 14 = 0 THEN 'failed' WHEN event_id % 7 = 0 THEN 'dead_letter' ELSE 'processed' END AS status, CASE WHEN event_id % 7 = 0 THEN 'multiple of seven' END AS reason, {_TALLY} FROM sharded GROUP BY 1, 2, 3",
    "stream_fifo_late": "WITH first AS (SELECT event_type, max(event_id) AS most FROM events WHERE event_id % 5 = 4 GROUP BY 1) SELECT e.event_type AS key, count(*) AS n, max(event_id) AS last, (count(*) FILTER (WHERE event_id % 5 <> 4 AND event_id < most))::BIGINT AS late FROM events e LEFT JOIN first f ON e.event_type = f.event_type GROUP BY 1",
    "pool_stream": f"SELECT CASE WHEN event_id % 14 = 0 THEN 'failed' WHEN event_id % 7 = 0 THEN 'dead_letter' ELSE 'processed' END AS status, {_TALLY} FROM events GROUP BY 1 UNION ALL SELECT 'in the sink', {_TALLY} FROM events WHERE event_id % 14 = 7 UNION ALL SELECT 'counted processed', count(*), NULL FROM events WHERE event_id % 7 <> 0 UNION ALL SELECT 'counted panics', count(*), NULL FROM events WHERE event_id % 7 = 0 UNION ALL SELECT 'failures of the sink', 0, NULL",
    "pool_failing_sink": 'SELECT count(*) AS "rows", (count(*) FILTER (WHERE event_id % 7 = 0))::INT AS dead, 4 AS sink_failures FROM events',
    "pool_stop": 'SELECT count(*) AS "rows", count(DISTINCT event_id) AS ids, true AS begun, true AS left_at_stop, true AS stopped FROM events',
    "dead_letter": f"WITH {_sharded_sql()} SELECT shard, CASE WHEN event_id % 7 = 0 THEN 'dead_letter' ELSE 'processed' END AS status, CASE WHEN event_id % 7 = 0 THEN 'multiple of seven' END AS reason, count(*) AS n, sum(event_id)::BIGINT AS id_sum FROM sharded GROUP BY 1, 2, 3",
    "slot_outcomes": "SELECT CASE WHEN event_id % 10 = 0 THEN 'failed' WHEN event_id % 2 = 0 THEN 'dead_letter' ELSE 'processed' END AS status, CASE WHEN event_id % 10 = 0 THEN 'rejected after take' WHEN event_id % 2 = 0 THEN 'rejected' END AS reason, count(*) AS n, sum(event_id)::BIGINT AS id_sum FROM events GROUP BY 1, 2",
    "zero_loss_audit": f"WITH {_sharded_sql()}, d AS (SELECT shard, event_id FROM sharded WHERE event_id % 14 <> 0 UNION ALL SELECT shard, event_id FROM sharded WHERE event_id % 14 <> 0 AND event_id % 101 = 7), x AS (SELECT shard, count(*) AS sent, sum(event_id)::BIGINT AS sent_sum FROM sharded GROUP BY 1), y AS (SELECT shard, count(*) AS done, sum(event_id)::BIGINT AS done_sum FROM d GROUP BY 1) SELECT x.shard, sent, done, sent_sum, done_sum, sent - done AS lost FROM x JOIN y ON x.shard = y.shard",
    "fill_ratio": f"SELECT epoch(date_trunc('hour', ts))::BIGINT // 3600 AS hour, least(count(*), {HOURLY})::DOUBLE / {HOURLY}::DOUBLE AS fill FROM events GROUP BY 1",
    "elastic_trace": f"WITH {_TRACE} SELECT step, active FROM t WHERE step >= 0",
    "shard_ownership": f"WITH {_TRACE} SELECT (s.range % greatest(active, 1))::INT AS owner, s.range::INT AS shard, count(*) AS samples FROM t, range(4) s WHERE step >= 0 GROUP BY 1, 2",
    "risk_filter": "SELECT o_orderkey, o_custkey, sum(cast(round(o_totalprice * 100) AS BIGINT)) OVER w::BIGINT AS exposure, sum(cast(round(o_totalprice * 100) AS BIGINT)) OVER w <= 100000000 AS accepted FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)",
    "event_router": f"WITH {_sharded_sql()} SELECT shard, ((rn - 1) % 3)::INT AS notifier, count(*) AS n, sum(event_id)::BIGINT AS id_sum FROM ranked GROUP BY 1, 2",
    "heavy_transform": f"SELECT event_id, ((event_id::HUGEINT * {_heavy()[0]} + {_heavy()[1]}) % 2147483648)::BIGINT AS v FROM events",
    "trade_checksum": f"WITH t AS (SELECT ({SYMBOLS!r})[((event_id // 2500 * 1000000 + event_id % 2500) % {len(SYMBOLS)} + 1)::INT] AS s, event_id % 2500 AS t FROM events) SELECT s, count(*) AS n, sum(t)::BIGINT AS checksum FROM t GROUP BY s",
    "shard_average": "SELECT (user_id % 3)::INT AS shard, count(*) AS n, round(sum(cast(round(value * 100) AS BIGINT))::DOUBLE / count(*), 6) AS avg_cents FROM events GROUP BY 1",
    "sector": "WITH n AS (SELECT n_nationkey, n_name, CASE WHEN n_name IN ('NATION_0', 'NATION_1') THEN 0 WHEN n_name IN ('NATION_2', 'NATION_3', 'NATION_7') THEN 1 WHEN n_name IN ('NATION_4', 'NATION_5') THEN 2 WHEN n_name = 'NATION_6' THEN 3 END::INT AS shard FROM nation) SELECT * FROM n WHERE shard IS NOT NULL",
    "stream_fold": _DRAIN + " FROM sharded GROUP BY shard",
    "stream_fifo_state": "SELECT event_type AS key, count(*) AS n, max(event_id) AS last, 0::BIGINT AS late FROM events GROUP BY 1",
    "stream_stop_resume": _DRAIN + ", true AS left_at_stop FROM sharded GROUP BY shard",
    "stream_dead_letter": f"WITH {_sharded_sql()} SELECT shard, CASE WHEN event_id % 7 = 0 THEN 'dead_letter' ELSE 'processed' END AS status, count(*) AS n, sum(event_id)::BIGINT AS id_sum FROM sharded GROUP BY 1, 2",
}
