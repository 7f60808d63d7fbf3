"""What the operators share: the shared folder, staged tables, Arrow mapping."""

from __future__ import annotations

import contextlib
import ctypes
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import new_path as stage_path
from ..sources.shared import written as stage

__all__ = ["bucket_count", "give_back", "grouped", "id_text", "map_arrow", "parts", "small", "stage", "stage_path"]

#: Text bytes that become Python objects together, and that are encoded together.
PART_BYTES, GROUP_BYTES = 4 << 20, 1 << 20

def id_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text) with null texts as empty; other columns, whatever their
    names, are left behind at the scan."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    def run(it):
        yield from fn(it)
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Hand freed memory back to the system: a worker process outlives its task,
    and what it keeps would count against the stages that follow."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL("libc.so.6").malloc_trim(0)


def parts(b: pa.RecordBatch, column: str = "text", size: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """Stretches of a batch of about ``size`` bytes of ``column`` each."""
    whole = b.column(column)
    if b.num_rows < 2 or whole.nbytes <= size:
        yield b
        return
    binary = pa.types.is_string(whole.type) or pa.types.is_binary(whole.type)
    offsets = np.asarray(pc.fill_null(pc.binary_length(whole), 0)).cumsum(dtype=np.int64) if binary else np.arange(b.num_rows) * whole.nbytes // b.num_rows
    cuts = np.flatnonzero(np.diff(offsets // size)) + 1
    for at, to in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
        if to > at:
            yield b.slice(at, to - at)


def small(it: Iterator[pa.RecordBatch], column: str = "text", size: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """An Arrow stream in batches of about ``size`` bytes at most: what a mapper
    turns into Python objects at a time is bounded by bytes, whatever the rows of
    a batch are in the session."""
    for b in it:
        yield from parts(b, column, size)


def grouped(it: Iterator[pa.RecordBatch], column: str = "text", size: int = GROUP_BYTES) -> Iterator[pa.RecordBatch]:
    """The stream in batches of about ``size`` bytes: small ones are joined, large
    ones cut; a single row is never cut."""
    held, total = [], 0
    for b in small(it, column, size):
        held.append(b)
        total += b.column(column).nbytes
        if total >= size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, total = [], 0
    if total or any(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def bucket_count(rows: int, per: int, least: int = 1, most: int = 20_000) -> int:
    return max(least, min(most, -(-rows // per)))
