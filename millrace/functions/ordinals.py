"""Positions and running values over whole tables without one task for all rows.

Rows are dealt to stretches of the ordinal whose bounds are quantiles of a sample,
so a stretch holds about as many rows as any other however the ordinals lie.  A
value is found within its stretch and shifted by what earlier stretches hold.  What
a single task sees is a stretch of rows, or one row for each of at most ``MOST``
stretches, so a key with a third of all rows is spread as well.

A table that Spark's own estimate takes to be small is one stretch, others have one
for each ``STRETCH_ROWS`` rows, and a task each; results don't depend on the stretches.  Ordinals should be unique within a key: rows with equal
ones stand in one stretch, in the order of a hash of the row.  Names of helper
columns are chosen so that they don't clash with those of the table.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tables below so many bytes, by Spark's estimate, are one stretch; rows that a
#: stretch of others is for, and the most stretches.
SMALL_BYTES, STRETCH_ROWS, MOST = 8 << 20, 1 << 19, 4096

#: Cuts that are compared in generated code.
MOST_COMPARED = 128


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``df`` has."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        made = f"_{name}"
        while made in have:
            made = f"_{made}"
        have.add(made)
        out.append(made)
    return out


def estimated_bytes(df: DataFrame) -> int:
    """What Spark takes the inputs of ``df`` to hold; rows are counted where it
    doesn't know."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    total = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return total if total < 1 << 62 else 100 * df.count()


def bounds(df: DataFrame, ordinal: str, stretches: int | None = None) -> list[float]:
    """Ordinals that cut ``df`` into stretches, by quantiles of all its rows.  Files
    of one size may hold any number of rows, so unless they are small rows are counted."""
    n = stretches or (1 if estimated_bytes(df) < SMALL_BYTES else min(MOST, -(-df.count() // STRETCH_ROWS)))
    if n < 2:
        return []
    return sorted(set(df.approxQuantile(ordinal, [i / n for i in range(1, n)], 1 / (4 * n))))


def _by_halves(ordinal: Column, cuts: list[float], low: int, high: int) -> Column:
    if low == high:
        return F.lit(low)
    at = (low + high) // 2
    return F.when(ordinal > cuts[at], _by_halves(ordinal, cuts, at + 1, high)).otherwise(_by_halves(ordinal, cuts, low, at))


def stretch_of(ordinal: Column, cuts: list[float]) -> Column:
    """How many cuts lie below the ordinal, found by halves, or where that makes too
    much code in two steps of the root of their number each."""
    if len(cuts) <= MOST_COMPARED:
        return _by_halves(ordinal, cuts, 0, len(cuts))
    below = lambda xs: F.size(F.filter(xs, lambda c: c < ordinal))
    size = math.isqrt(len(cuts) - 1) + 1
    parts = [cuts[i : i + size] for i in range(0, len(cuts), size)]
    ends = F.array(*[F.lit(p[-1]) for p in parts])  # a part is passed if its last cut lies below
    fine = F.array(*[F.array(*map(F.lit, p)) for p in parts])
    passed = below(ends)
    return F.when(passed == len(parts), F.lit(len(cuts))).otherwise(passed * size + F.coalesce(below(F.get(fine, passed)), F.lit(0)))


def _order(df: DataFrame, ordinal: str) -> list[Column]:
    return [F.col(f"`{ordinal}`"), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if not df.schema[c].dataType.typeName().startswith("map")])]


def shifted(df: DataFrame, ordinal: str, by: list[str], name: str, inside: Callable, total: Column, fold: Callable, combine: Callable, stretches: int | None = None) -> DataFrame:
    """Adds ``name``, a running value of ``by`` in the order of ``ordinal``.

    ``inside(window)`` is the value within a stretch, ``total`` the aggregate of a
    stretch, ``fold`` the window function that adds up totals of earlier ones, and
    ``combine(earlier, inside)`` the value."""
    cuts = bounds(df, ordinal, stretches)
    if not cuts:
        whole = Window.partitionBy(*by).orderBy(*_order(df, ordinal)) if by else Window.orderBy(*_order(df, ordinal))
        return df.withColumn(name, combine(F.lit(None), inside(whole)))
    at, own, base, other = fresh(df, "stretch", "own", "base", "other")
    keys = fresh(df, *[f"key{i}" for i in range(len(by))])
    cut = df.withColumn(at, stretch_of(F.col(f"`{ordinal}`"), cuts))
    # Partition i is stretch i: joined ones would be sorted in one task.
    local = cut.repartitionById(len(cuts) + 1, at).withColumn(own, inside(Window.partitionBy(*by, at).orderBy(*_order(df, ordinal))))
    totals = cut.groupBy(*by, at).agg(total.alias(own))
    order = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(by, keys)], (F.col(at) + 1).alias(other), fold(F.col(own)).over(order).alias(base))
    # Were both plain columns, Spark would put what it infers of the one as a filter
    # on the other's side, where the ordinal isn't found.
    same = F.col(at) + 1 == F.col(other)
    for c, k in zip(by, keys):
        same = same & F.col(f"`{c}`").eqNullSafe(F.col(k))
    made = local.join(bases if by else F.broadcast(bases), same)  # without keys a row a stretch
    return made.withColumn(name, combine(F.col(base), F.col(own))).drop(at, own, base, other, *keys)


def with_position(df: DataFrame, ordinal: str, by: list[str] | None = None, name: str = "rn", stretches: int | None = None) -> DataFrame:
    """``name``: the row's place, from 1, by ``ordinal`` (a number) within ``by``."""
    return shifted(df, ordinal, by or [], name, lambda w: F.row_number().over(w).cast("long"), F.count(F.lit(1)), F.sum, lambda base, own: own + F.coalesce(base.cast("long"), F.lit(0)).cast("long"), stretches)


def running_sum(df: DataFrame, ordinal: str, by: list[str], value: Column, name: str, stretches: int | None = None) -> DataFrame:
    """``name``: the sum of ``value`` up to and with the row; nulls count as nothing."""
    up_to = lambda w: F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return shifted(df, ordinal, by, name, up_to, F.sum(value), F.sum, lambda base, own: F.when(base.isNull(), own).when(own.isNull(), base).otherwise(base + own), stretches)


def most_before(df: DataFrame, ordinal: str, by: list[str], value: Column, name: str, stretches: int | None = None) -> DataFrame:
    """``name``: the largest ``value`` of the rows before, null where there is none."""
    earlier = lambda w: F.max(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return shifted(df, ordinal, by, name, earlier, F.max(value), F.max, lambda base, own: F.greatest(base, own), stretches)


def frame_of(position: Column, size: int) -> Column:
    """The number, from 0, of the frame of ``size`` rows a position falls in."""
    return F.floor((position - 1) / F.lit(size)).cast("long")
