"""Helpers that several operators share: Arrow batches of bounded size, joins with frequent keys, hashing."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.scratch import materialise, remove
from tidemark.scratch import path as scratch_path

__all__ = ["bounded_batches", "frees", "join_frequent", "map_arrow", "materialise", "mix64", "remove", "scratch_path", "slices", "unused"]
BATCH_BYTES = 4 << 20
#: A key is frequent if it has more than so many rows, and more than the MOST_FREQUENT-th part of all: there can't be more than MOST_FREQUENT.
LEAST_FREQUENT, MOST_FREQUENT = 1000, 10_000


def bounded_batches(spark: SparkSession) -> None:
    """Let Arrow batches end by bytes, so that long texts can't make a batch of any size.

    A setting of the session, which the operators need whenever their results are read; it stays.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def slices(batches: Iterator[pa.RecordBatch], column: int, max_bytes: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the values of one column add up to ``max_bytes`` at most (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
            yield batch.slice(at, upto - at)
            at = upto


_held: set[Callable[[], None]] = set()


def _begin(caches: tuple[Callable[[], None], ...]) -> None:
    others = [empty for empty in _held if empty not in caches]
    for empty in others:
        empty()
    if others:
        gc.collect()
    _held.clear()
    _held.update(caches)


def _give_back() -> None:
    """Return freed memory to the machine: Arrow's pool and glibc keep it otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def frees(*caches: Callable[[], None]) -> Callable:
    """Decorates what a task does with its batches; ``caches`` are the functions that empty what it keeps in its worker.

    Spark keeps Python workers from task to task and from operator to operator. An operator's caches stay for its next
    task; a task of another operator empties them first, so that they don't add up. ``caches`` have to be functions of
    a module: anything else, a dict's own method say, would be sent to the worker with a copy of the dict.
    """

    def wrap(function: Callable) -> Callable:
        @wraps(function)
        def run(batches: Iterator, *given, **options) -> Iterator:
            _begin(caches)
            try:
                yield from function(batches, *given, **options)
            finally:
                _give_back()

        return run

    return wrap


def join_frequent(rows: DataFrame, facts: DataFrame, key: str, total: int) -> DataFrame:
    """The inner join of ``rows`` with ``facts``, which has a row for each key with the number ``n`` of its rows.

    Frequent keys, MOST_FREQUENT at most, are broadcast and meet their rows where these are; only the rows of others are shuffled.
    """
    many = max(LEAST_FREQUENT, total // MOST_FREQUENT)
    frequent = facts.where(F.col("n") > many)
    others = rows.join(F.broadcast(frequent.select(key)), key, "left_anti").join(facts.where(F.col("n") <= many), key)
    return rows.join(F.broadcast(frequent), key).unionByName(others)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that ``df`` doesn't have, whatever its own are."""
    there = {c.lower() for c in df.columns}
    mark = "_tidemark"
    while any(f"{mark}_{n}".lower() in there for n in names):
        mark += "_"
    return [f"{mark}_{n}" for n in names]


def map_arrow(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    bounded_batches(df.sparkSession)
    return df.mapInArrow(function, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64: a bijection on 64-bit words with good avalanche."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
