"""Every query against its SQL on the same tables, in DuckDB."""

import os

import duckdb
import pytest

from millrace.plans import catalog

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA)
    have = rows_of(got.columns, [tuple(r) for r in got.collect()])
    assert have or name == "fifo_violations"  # of which there are none in a fair merge
    if name not in catalog.ORACLES:
        return
    rel = duck.sql(catalog.ORACLES[name])
    assert sorted(rel.columns) == sorted(got.columns)
    assert have == rows_of(rel.columns, rel.fetchall())


def book_fills(orders):
    """Price, then time: a plain order book."""
    books, fills = {}, []
    for symbol, ordinal, side, price, qty in sorted(orders, key=lambda o: o[1]):
        book = books.setdefault(symbol, {"B": [], "S": []})
        sign = 1 if side == "B" else -1
        while qty:
            fits = [o for o in book["S" if side == "B" else "B"] if sign * o["price"] <= sign * price]
            if not fits:
                break
            best = min(fits, key=lambda o: (sign * o["price"], o["ordinal"]))
            n = min(qty, best["qty"])
            fills.append((symbol, ordinal, best["ordinal"], best["price"], n))
            qty, best["qty"] = qty - n, best["qty"] - n
            if not best["qty"]:
                book["S" if side == "B" else "B"].remove(best)
        if qty:
            book[side].append({"ordinal": ordinal, "price": price, "qty": qty})
    return sorted(fills)


def test_matching_is_the_order_book(spark):
    """As a batch and as a stream with state, over the whole table."""
    want = book_fills([tuple(r) for r in catalog._orders(spark, DATA).collect()])
    assert len(want) > 5000
    for name in ("matching", "stream_matching"):
        assert sorted((r.symbol, r.taker, r.maker, r.price, r.qty) for r in catalog.QUERIES[name](spark, DATA).collect()) == want


def test_long_keys_are_hashed_as_stated(spark):
    import xxhash

    for r in catalog.route_key_long(spark, DATA).collect():
        data = r.url.encode()
        if len(data) > 16:
            assert r.shard == xxhash.xxh3_64_intdigest(data) & 7


def test_no_python_where_keys_are_short(spark):
    for name in ("event_router", "route_key_assignment", "dead_letter_native", "batch_deadline_shard", "risk_filter", "merge_any", "merge_batch_any", "frames"):
        plan = catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "ArrowEval" not in plan, name
