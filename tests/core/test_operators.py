"""Operators against simulators, closed forms and edge cases."""

import random
import re
from collections import defaultdict

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.functions.hashing import key_shard, pow2, wrapping_affine
from millrace.functions.ordinals import bounds, most_before, running_sum, with_position
from millrace.operators import admission, apps, audit, channels, elastic, folds, handlers, receive, routing
from millrace.streaming import jobs


def fnv(key: str) -> int:
    h = 0xCBF29CE484222325
    for b in key.encode():
        h = (h ^ b) * 0x100000001B3 % 2**64
    return h


def test_key_hash(spark):
    import xxhash

    keys = ["", "a", "AAPL", "é", "日本", "x" * 16, "x" * 17, "🎉" * 5, None]
    got = {r.k: r.s for r in spark.createDataFrame([(k,) for k in keys], "k string").select("k", key_shard(F.col("k"), 64).alias("s")).collect()}
    want = {k: None if k is None else (fnv(k) if len(k.encode()) <= 16 else xxhash.xxh3_64_intdigest(k.encode())) & 63 for k in keys}
    assert got == want
    symbols = dict(AAPL=3, MSFT=3, GOOG=1, AMZN=3, NVDA=2, META=0, TSLA=3, AMD=1, INTC=3, NFLX=1, BTC=0, ETH=0, ORCL=3, UBER=1, LYFT=0, SNAP=1)
    rows = spark.createDataFrame([(k,) for k in symbols], "k string").select("k", key_shard(F.col("k"), 4, "short").alias("s")).collect()
    assert {r.k: r.s for r in rows} == symbols


def test_pow2():
    assert [pow2(n) for n in (0, 1, 2, 3, 4, 5, 8, 9)] == [1, 1, 2, 4, 4, 8, 8, 16]


def test_wrapping(spark):
    values = [0, 1, 10**5, 2**62 + 12345, 2**32 - 1]

    def slow(v):
        for _ in range(2000):
            v = (v * 31 + 1) % 2**64
        return v

    got = spark.createDataFrame([(v,) for v in values], "v long").select(wrapping_affine(F.col("v"), 2000).alias("w")).collect()
    assert [int(r.w) for r in got] == [slow(v) for v in values]


def test_position_over_many_buckets(spark):
    ids = random.Random(1).sample(range(10**6), 500)
    df = spark.createDataFrame([(i, i % 3) for i in ids], "o long, k long").repartition(5)
    want = {i: n + 1 for n, i in enumerate(sorted(ids))}
    assert {r.o: r.rn for r in with_position(df, "o", stretches=7).collect()} == want
    own = defaultdict(list)
    for i in sorted(ids):
        own[i % 3].append(i)
    assert {r.o: r.rn for r in with_position(df, "o", ["k"], stretches=7).collect()} == {i: n + 1 for x in own.values() for n, i in enumerate(x)}


@pytest.fixture(scope="module")
def long_table(spark, tmp_path_factory):
    """2.5 million rows in files of some 30 MB."""
    path = str(tmp_path_factory.mktemp("long") / "t")
    spark.range(2_500_000).select("id", F.xxhash64("id").alias("v")).write.parquet(path)
    return spark.read.parquet(path)


def test_tables_are_cut_by_rows(long_table):
    """No stretch holds many more rows than it is for, however small their files."""
    assert len(bounds(long_table, "id")) == 4
    dealt = with_position(long_table.select("id"), "id", name="a").withColumn("part", F.spark_partition_id())
    assert dealt.groupBy("part").count().agg(F.max("count")).first()[0] < 700_000


@pytest.mark.parametrize("stretches", [None, 23, 200])
def test_positions_of_positions(long_table, stretches):
    """Over several stretches, one found by the other, and counted."""
    first = with_position(long_table.select("id"), "id", name="a", stretches=stretches)
    assert first.count() == 2_500_000
    made = with_position(first.withColumn("shard", F.col("a") % 4), "id", ["shard"], "b", stretches=stretches)
    assert made.where("a = id + 1 and b = id div 4 + 1").count() == 2_500_000


def test_ticks_of_one_loop_are_dealt_out(long_table):
    """A loop over all rows isn't one task: each thousandth row comes late by 95."""
    rows = long_table.select("id", (F.col("id") * 10 + F.expr("id div 1000") * 95).alias("at"), F.lit(0).alias("loop"))
    made = receive.ticks(rows, "id", F.col("at"), 15, ["loop"])
    late = (F.col("id") % 1000 == 0) & (F.col("id") > 0)
    assert made.where(F.col("timeouts") == F.when(late, 6).otherwise(0)).count() == 2_500_000
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Window.*_stretch.*\n.*Sort.*\n.*Project.*\n.*Exchange shufflepartitionidpassthrough\(.*_stretch.*, 5\)", plan)


def test_running_values_do_not_depend_on_stretches(spark):
    """A key with a third of all rows, nulls, and columns that helpers might be called."""
    rng = random.Random(6)
    rows = [(i, "hot" if i % 3 == 0 else f"k{i % 11}", None if i % 17 == 0 else rng.randint(-5, 9), i) for i in rng.sample(range(100_000), 900)]
    df = spark.createDataFrame(rows, "o long, k string, v long, _stretch long").repartition(6)
    sums, most, want = defaultdict(lambda: None), {}, {}
    for o, k, v, _ in sorted(rows):
        before = most.get(k)
        if v is not None:
            sums[k] = v + (sums[k] or 0)
        want[o] = (sums[k], before)
        most[k] = o if before is None else max(before, o)
    for n in (1, 2, 9, 300):
        made = most_before(running_sum(df, "o", ["k"], F.col("v"), "s", n), "o", ["k"], F.col("o"), "m", n)
        assert {r.o: (r.s, r.m) for r in made.collect()} == want
        assert made.columns == [*df.columns, "s", "m"]


def test_columns_of_any_name_stay(spark):
    names = ["_at", "_key0", "_base", "_own", "_other", "_sizes", "_route_key", "_most"]
    df = spark.createDataFrame([(i, i % 2, *[7] * len(names)) for i in range(40)], f"v long, shard int, {', '.join(f'`{n}` int' for n in names)}")
    for made in (receive.merge_any(df, "v"), routing.round_robin(df, "v", 4), routing.unused(df.withColumn("k", F.lit("a")), "k", routing.Routes()), admission.try_send_batch(df, "v", 3), with_position(df, "v", ["shard"], stretches=4)):
        assert set(names) <= set(made.columns) and {tuple(r) for r in made.select(*names).distinct().collect()} == {(7,) * len(names)}


def test_channels(spark):
    assert channels.shared(spark, 700).capacity == 1024 and channels.shared(spark, 1).shards == pow2(spark.sparkContext.defaultParallelism)
    assert (channels.single(spark, 5, 3).shards, channels.single(spark, 5, 3).capacity) == (3, 8)
    assert channels.shared(spark, 8, channels.GROUP, routes=routing.Routes.from_groups([["a"], ["b"], ["c"]])).shards == 4
    for bad in (lambda: channels.single(spark, 1, 0), lambda: channels.shared(spark, 1, "other")):
        with pytest.raises(ValueError):
            bad()
    rows = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(12)], "v long, k string")
    for channel, key in ((channels.shared(spark, 2, shards=2), None), (channels.shared(spark, 2, channels.KEY, 4), "k"), (channels.single(spark, 2, 3), "v")):
        sent = channel.try_send_batch(rows, "v", key)
        assert sent.count() == 12 and {r.status for r in sent.collect()} >= {"accepted", "full"}


def waited(rows, timeout, per_shard):
    """A sender that waits for each row in turn: v -> (status, position)."""
    out, left, now, halted = {}, [], 0.0, None
    shards = sorted({s for _, s, _ in rows if s is not None})
    for s in shards:
        deadline = (now if per_shard else 0.0) + timeout
        for v, _, room in sorted(r for r in rows if r[1] == s):
            if halted is None and max(now, room) <= deadline:
                now = max(now, room)
                out[v] = ("accepted", None)
            else:
                halted = s if halted is None else halted
                left.append((v, "timeout" if s == halted else "unsent"))
    left += [(v, "unsent") for v, s, _ in sorted(r for r in rows if r[1] is None)]
    return out | {v: (status, i + 1) for i, (v, status) in enumerate(left)}


def test_deadlines_follow_the_waiting_sender(spark):
    rng = random.Random(9)
    for trial in range(12):
        rows = [(v, rng.choice([0, 1, 1, 2, None]), float(rng.randint(0, 20 + 5 * trial))) for v in range(40)]
        df = spark.createDataFrame(rows, "v long, shard int, room double").repartition(3)
        for per in ("call", "shard"):
            timeout = rng.choice([0.0, 8.0, 20.0, 45.0, 500.0])
            got = {r.v: (r.status, r.position) for r in admission.send_batch_timeout(df, "v", F.col("room"), timeout, per=per).collect()}
            assert got == waited(rows, timeout, per == "shard")


def spread_slowly(rows, rooms, start):
    """Item by item, with lists for queues."""
    left, queues, at = list(range(1, rows + 1)), [[] for _ in rooms], start
    while left:
        own, room = queues[at % len(rooms)], rooms[at % len(rooms)]
        while left and len(own) < room:
            own.append(left.pop(0))
        at += 1
        if not left or len(queues[at % len(rooms)]) == rooms[at % len(rooms)]:
            break
        queues[at % len(rooms)].append(left.pop())
        at += 1
    return {v: s for s, own in enumerate(queues) for v in own}


def test_spreading_batches():
    rng = random.Random(3)
    for _ in range(300):
        rooms, rows, start = [rng.randint(0, 6) for _ in range(4)], rng.randint(0, 20), rng.randint(0, 3)
        got = {p: s for lo, hi, s in admission.spread_places(rows, rooms, start) for p in range(lo, hi + 1)}
        assert got == spread_slowly(rows, rooms, start)


def test_empty_polls(spark):
    df = spark.createDataFrame([(0, 0, 0), (1, 0, 10), (2, 0, 11), (3, 0, 31), (4, 1, 5)], "v long, shard int, at long")
    got = {r.v: r.timeouts for r in receive.ticks(df, "v", F.col("at"), 10).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 1, 4: 0}
    assert [r.v for r in receive.iterate(df, "v")] == [0, 1, 2, 3, 4]
    assert receive.any_outcome(df, 3, closed=[0, 2]).first() == (5, 2, "empty")


def test_even_rotation(spark):
    got = routing.round_robin(spark.range(8).select(F.col("id").alias("v")), "v", 4).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in got) == [2, 2, 2, 2]


def test_shard_is_partition(spark):
    df = routing.partitioned(routing.static(spark.range(1000).select(F.col("id").alias("v")), F.col("v"), 3), 3)
    got = df.withColumn("p", F.spark_partition_id()).select("shard", "p").distinct().collect()
    assert sorted((r.shard, r.p) for r in got) == [(0, 0), (1, 1), (2, 2)]


def test_routes(spark):
    routes = routing.Routes.from_groups([["A", "B"], ["C"], ["A"]])
    assert (routes.shards, len(routes), routes.handle("A"), routes.handle("Z")) == (4, 3, 2, None)
    assert routing.Routes.from_map({"x": 5}, 3).handle("x") == 1
    df = spark.createDataFrame([("A", 1), ("Z", 2), (None, 3)], "k string, v long")
    assert {r.v: r.shard for r in routing.by_group(df, "k", routes).collect()} == {1: 2, 2: None, 3: None}
    assert {r.v for r in routing.unused(df, "k", routes).collect()} == {2, 3}
    pairs = routing.Pairs(routing.by_group(df, "k", routes), 4)
    assert pairs.take(2).count() == 1 and pairs.take(2) is None and pairs.take(9) is None and pairs.remaining() == [0, 1, 3]
    assert [i for i, _ in pairs.rest()] == [0, 1, 3] and pairs.is_empty()


def batch(spark, rows):
    return spark.createDataFrame(rows, "v long, shard int")


def test_overflowing_batch_keeps_all_rows(spark):
    rows = [(1, 0), (2, 0), (3, 0), (10, 1), (20, 1), (30, 1), (99, None)]
    got = {r.v: (r.status, r.position) for r in admission.try_send_batch(batch(spark, rows), "v", 2).collect()}
    assert got == {1: ("accepted", None), 2: ("accepted", None), 3: ("full", 1), 10: ("unsent", 2), 20: ("unsent", 3), 30: ("unsent", 4), 99: ("unsent", 5)}
    assert {r.status for r in admission.try_send_batch(batch(spark, rows[:2]), "v", 2).collect()} == {"accepted"}
    assert admission.try_send_batch(batch(spark, []), "v", 2).count() == 0
    out = admission.batch_outcome(admission.try_send_batch(batch(spark, rows).withColumn("k", F.lit("a")), "v", 2), "k").first()
    assert (out.sent, out.left, out.status, out.shard, out.key) == (2, 5, "full", 0, "a")
    assert {r.status for r in admission.try_send(batch(spark, rows), "v", 2, closed=[1]).where("shard = 1").collect()} == {"disconnected"}


def test_timeouts(spark):
    df = spark.createDataFrame([(1, 0.0, 0.5), (2, 0.0, 3.0)], "v long, s double, r double")
    assert [r.status for r in admission.send(df, sent_at="s", room_at="r", timeout=1.0).orderBy("v").collect()] == ["accepted", "timeout"]


@pytest.mark.parametrize("n", [1, 2, 5, 255, 256])
def test_last_batch_is_not_lost(spark, n):
    got = receive.frames(batch(spark, [(i, 0) for i in range(n)]), "v", 64).collect()
    assert sum(r.n for r in got) == n and sum(r.dc for r in got) == 1
    assert any(r.dc and r.n for r in got) == (n % 64 == 1)


def poll(queues, size):
    """A fair poller over filled, closed shards: (shard, frame, place)."""
    n, cursor, out = len(queues), 0, []
    while any(queues):
        for k in range(n):
            s = (cursor + k) % n
            own, queues[s] = queues[s][:size], queues[s][size:]
            out += own
        cursor = (cursor + 1) % n
    return out


def test_merges_follow_the_poller(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([0, 0, 1, 3])) for i in range(300)]
    queues = lambda: [[v for v, s in rows if s == k] for k in range(4)]
    got = receive.merge_frames(batch(spark, rows), "v", 16, 4).orderBy("position").collect()
    assert [r.v for r in got] == poll(queues(), 16)
    turn, left = [], queues()
    while any(left):
        for q in left:
            if q:
                turn.append(q.pop(0))
    got = receive.merge_any(batch(spark, rows), "v").orderBy("position").collect()
    assert [r.v for r in got] == turn and [r.position for r in got] == list(range(1, 301))


def test_ordered_folds(spark):
    df = batch(spark, [(i, i % 3) for i in range(2000)])
    want = {}
    for k in range(3):
        h = 7
        for i in range(k, 2000, 3):
            h = (h * 31 + i) % 1_000_003
        want[k] = h
    assert {r.shard: r.h for r in folds.affine_fold(df, "shard", "v", F.col("v"), mul=31, mod=1_000_003, start=7, width=100).collect()} == want
    got = folds.drain_in_order(df, 3, "v", lambda: 7, lambda h, r: (h * 31 + r["v"]) % 1_000_003, lambda s, h: (s, h), "shard int, h long").collect()
    assert {r.shard: r.h for r in got} == want


def test_batches_reach_the_sink_whole(spark):
    df = batch(spark, [(i, 0 if i < 201 else 1) for i in range(330)])

    def sink(shard: int, t: pa.Table) -> dict:
        v = t.column("v").to_pylist()
        return {"shard": shard, "n": len(v), "first": v[0], "sorted": v == sorted(v)}

    got = sorted((r.shard, r["first"], r.n, r.sorted) for r in folds.drain_batches(df, 2, "v", 64, sink, "shard int, n long, first long, sorted boolean").collect())
    assert got == [(0, 0, 64, True), (0, 64, 64, True), (0, 128, 64, True), (0, 192, 9, True), (1, 201, 64, True), (1, 265, 64, True), (1, 329, 1, True)]


def test_poison_is_accounted_for(spark):
    df = batch(spark, [(i, i % 4) for i in range(1, 10_001)])

    def seven(row):
        if row["v"] % 7 == 0:
            raise ValueError(f"bad {row['v']}")

    made = handlers.handle(df, handlers.per_item(seven), shards=4, ordinal="v")
    rows, seen = handlers.counted(made)
    assert rows.count() == 10_000
    assert seen.get == {"processed": 10_000 - 10_000 // 7, "handler_panics": 10_000 // 7}
    dead = handlers.dead_letters(made).agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.min("reason").alias("r")).first()
    assert (dead.n, dead.s, dead.r[:4]) == (1428, sum(range(7, 10_001, 7)), "bad ")
    assert audit.fifo_violations(made.withColumn("place", F.col("v")), "shard", "place", "v").count() == 0
    assert handlers.tally(handlers.classify(df, F.col("v") % 7 == 0, F.col("v") % 2 == 0)) == {"processed": 8572, "dead_letter": 714, "failed": 714}


def test_scaling(spark):
    config = elastic.PoolConfig(1, 8)
    fills = [0.9, 0.95, 0.5, 0.1, 0.1, 0.0, 0.81]
    assert (elastic.PoolConfig(0, 0).min_consumers, elastic.PoolConfig(3, 1).max_consumers) == (1, 3)
    df = spark.createDataFrame(list(enumerate(fills)), "step long, fill double")
    for stretch in (512, 2):
        got = elastic.trace(df, "step", "fill", config, stretch=stretch).orderBy("step").collect()
        assert [r.active for r in got] == [8, 8, 8, 7, 6, 5, 7]
    rng, now, want = random.Random(2), 1, []
    many = [rng.random() for _ in range(700)]
    for f in many:
        want.append(now := config.decide(now, f))
    got = elastic.trace(spark.createDataFrame(list(enumerate(many)), "step long, fill double"), "step", "fill", config, stretch=16, group=3).orderBy("step").collect()
    assert [r.active for r in got] == want
    assert elastic.trace(df.limit(0), "step", "fill", config).count() == 0


def test_lost_rows_show(spark):
    df = batch(spark, [(i, i % 2) for i in range(10)])
    got = {r.shard: r.lost for r in audit.conservation(df, df.where("v <> 3"), ["shard"], "v").collect()}
    assert got == {0: 0, 1: 1}


def test_matching(spark):
    orders = [("X", 1, "S", 10.0, 5), ("X", 2, "S", 9.0, 3), ("X", 3, "B", 10.0, 6), ("Y", 4, "B", 10.0, 1), ("X", 5, "B", 8.0, 1), ("X", 6, "S", 8.0, 4)]
    got = apps.matching_engine(spark.createDataFrame(orders, "symbol string, ordinal long, side string, price double, qty long")).collect()
    assert sorted((r.taker, r.maker, r.price, r.qty) for r in got) == [(3, 1, 10.0, 3), (3, 2, 9.0, 3), (6, 5, 8.0, 1)]


def test_results_do_not_depend_on_partitions(spark):
    df = batch(spark, [(i, i % 5) for i in range(500)])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append(sorted(map(tuple, receive.merge_frames(df, "v", 8, 5).select("v", "position").collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1]


def test_entry_module(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 4
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


class Chunks(dict):
    """A store that knows how many chunks it had at most and were taken out."""

    most = gone = 0

    def __setitem__(self, key, value):
        super().__setitem__(key, value)
        self.most = max(self.most, len(self))

    def __delitem__(self, key):
        super().__delitem__(key)
        self.gone += 1


@pytest.mark.parametrize("wide", [False, True])
def test_books_hold_few_orders(wide):
    """Fills of a book that stores what rests, saved and taken up again at times,
    are those of one that holds all; so they are with late orders."""
    rng, store = random.Random(5), Chunks()
    book, whole = apps.Book(store, held=16), apps.Book(held=10**9)
    for i in range(6000):
        price = (rng.randrange(100_000) if wide else rng.randrange(30)) + (-40 if i % 2000 > 1900 else 0) * rng.choice((1, -1))
        order = (i - rng.choice((0, 0, 50)) * 2 + i % 2 * 10_000, rng.choice("BS"), float(price), rng.randrange(1, 9))
        assert list(book.match(*order)) == list(whole.match(*order))
        assert all(side.own <= 16 for side in book.sides.values())
        if i % 700 == 0:
            book = apps.Book(store, book.saved(), held=16)
    assert store.most > 20 and store.gone > 20
    book = apps.Book(store, book.saved(), held=16)
    for name in "BS":  # all that rests, to the last
        order = (10**6, name, 1e9 if name == "B" else -1e9, 10**9)
        assert list(book.match(*order)) == list(whole.match(*order))


def test_rows_are_sorted_in_runs(monkeypatch):
    monkeypatch.setattr(jobs, "SORTED", 700)
    rng = random.Random(2)
    rows = [(rng.randrange(3000), rng.choice("BS"), float(i), i) for i in range(5000)]
    frames = (pd.DataFrame(rows[i : i + 90], columns=["o", "side", "price", "qty"]) for i in range(0, 5000, 90))
    assert list(jobs.by_ordinal(frames, "o", ["o", "side", "price", "qty"])) == sorted(rows, key=lambda r: r[0])
    assert list(jobs.by_ordinal(iter([]), "o", ["o"])) == []


def test_streamed_books_are_stored(spark):
    """Books of more orders than are held, over several batches."""
    rng = random.Random(3)
    orders = [(rng.choice("xyz"), i, rng.choice("BS"), float(rng.randrange(400)), rng.randrange(1, 6)) for i in range(3000)]
    df = spark.createDataFrame(orders, "symbol string, ordinal long, side string, price double, qty long")
    parts = [df.where(f"ordinal >= {a} and ordinal < {a + 1000}") for a in (0, 1000, 2000)]
    got = jobs.matching(jobs.source(spark, jobs.in_turns(parts), df.schema, 1), held=16).drop("batch").collect()
    want = apps.matching_engine(df).collect()
    key = lambda r: (r.symbol, r.taker, r.maker)
    assert len(want) > 1000 and sorted(got, key=key) == sorted(want, key=key)
