"""Bloom filters that tasks build for themselves, merged segment by segment, of bounded size."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import map_arrow, mix64

SEGMENT_BITS = 1 << 18
#: 32 MB, what a driver and every executor can hold.
MOST_FILTER_BITS = 1 << 28
HASHES = 3


class Bloom:
    """A Bloom filter in segments: a key's bits all lie in one segment."""

    def __init__(self, bits: int, data: np.ndarray | None = None):
        self.segments = max(1, bits // SEGMENT_BITS)
        self.data = np.zeros(self.segments * SEGMENT_BITS // 8, np.uint8) if data is None else data

    def places(self, hashes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            segment = (hashes >> np.uint64(32)) % np.uint64(self.segments)
            step = mix64(hashes) | np.uint64(1)
            inside = (hashes + np.arange(HASHES, dtype=np.uint64)[:, None] * step) % np.uint64(SEGMENT_BITS)
            return (segment * np.uint64(SEGMENT_BITS) + inside).astype(np.int64)

    def add(self, places: np.ndarray) -> None:
        np.bitwise_or.at(self.data, (places >> 3).ravel(), (1 << (places & 7)).astype(np.uint8).ravel())

    def has(self, places: np.ndarray) -> np.ndarray:
        return ((self.data[places >> 3] >> (places & 7).astype(np.uint8)) & 1).all(0)


def _segments(bits: int):
    """Each task's filter of the hashes that it sees, as rows (segment, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = Bloom(bits)
        for batch in batches:
            bloom.add(bloom.places(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)))
        whole = bloom.data.reshape(bloom.segments, -1)
        for s in np.flatnonzero(whole.any(1)).tolist():
            yield pa.RecordBatch.from_pydict({"segment": pa.array([s], pa.int32()), "data": [zlib.compress(whole[s].tobytes(), 1)]})

    return run


def _union_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, np.ndarray] = {}
    for batch in batches:
        for segment, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data = np.frombuffer(zlib.decompress(data), np.uint8)
            found[segment] = found[segment] | data if segment in found else data
    for segment, data in found.items():
        yield pa.RecordBatch.from_pydict({"segment": pa.array([segment], pa.int32()), "data": [zlib.compress(data.tobytes(), 1)]})


def perhaps_in(keys: DataFrame, column: str) -> Column:
    """False only for rows whose ``column`` is not among those of ``keys``: a Bloom filter of bounded size, broadcast.

    With more keys than its bits can tell apart more rows pass, so an exact join has to follow.
    """
    spark = keys.sparkSession
    bits = min(MOST_FILTER_BITS, max(SEGMENT_BITS, 1 << (16 * keys.count()).bit_length()))
    parts = map_arrow(keys.select(F.xxhash64(column).alias("h")), _segments(bits), "segment int, data binary")
    whole = Bloom(bits)
    rows = whole.data.reshape(whole.segments, -1)
    for row in map_arrow(parts.repartition("segment"), _union_segments, "segment int, data binary").collect():
        rows[row["segment"]] = np.frombuffer(zlib.decompress(row["data"]), np.uint8)
    shared = spark.sparkContext.broadcast(whole.data)

    def test(hashes: pd.Series) -> pd.Series:
        data = shared.value
        bloom = Bloom(len(data) * 8, data)
        return pd.Series(bloom.has(bloom.places(hashes.to_numpy(np.int64).view(np.uint64))))

    return F.pandas_udf(test, "boolean")(F.xxhash64(column))
