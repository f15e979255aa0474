"""Approximate nearest neighbours with a hash-prefix forest.

Method: every tree gives each vector a long string of letters and keeps the strings as a sorted array. A
letter says along which of 16 random directions, forward or backward, the vector goes farthest; it tells near
vectors from far ones better than five bits of random hyperplanes. A query descends each tree to the rows
that share the longest prefix with its own string. Then all trees ascend together, letter by letter, until
enough candidates are met; the last step is taken tree by tree so as not to gather far more. Candidates are
ranked by their exact inner product.

How many are gathered grows with the number of rows to the power 0.6, so the share of a block that is scored falls with
its size. Nearness by inner product becomes nearness by angle through one more component, which lifts every
row to the largest norm and is 0 in queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import map_arrow
from tidemark.llm._vectors import hits_table, matrix, search_blocks, valid_rows

TREES = 128
#: Directions of a letter, its bits, letters of a string.
DIRECTIONS, LETTER_BITS, LETTERS = 16, 5, 4
BITS = LETTER_BITS * LETTERS
#: Entries that the trees gather for a query: GATHER times the block's rows to the power of GROWTH. Entries of several trees can be one row.
GATHER, GROWTH = 16.0, 0.6
BLOCK_ROWS = 65536
QUERY_ROWS = 16384
_SEED = 20


def strings(vectors: np.ndarray, lift: np.ndarray, trees: int) -> np.ndarray:
    """The strings of vectors (rows, trees), the first letter's bits on top; ``lift`` is the additional component."""
    rng = np.random.default_rng(_SEED)
    scale = np.maximum(np.abs(vectors).max(1, initial=0), np.abs(lift))
    single = np.concatenate([vectors, lift[:, None]], 1)
    single = (single / np.where(scale > 0, scale, 1)[:, None]).astype(np.float32)
    out = np.zeros((len(vectors), trees), np.uint32)
    for _ in range(LETTERS):
        planes = rng.standard_normal((single.shape[1], trees * DIRECTIONS)).astype(np.float32)
        for at in range(0, len(single), 1024):
            along = (single[at : at + 1024] @ planes).reshape(-1, trees, DIRECTIONS)
            best = np.abs(along).argmax(2)
            forward = np.take_along_axis(along, best[:, :, None], 2)[:, :, 0] > 0
            out[at : at + 1024] = out[at : at + 1024] << np.uint32(LETTER_BITS) | (2 * best + forward).astype(np.uint32)
    return out


def _hash(batches: Iterator[pa.RecordBatch], vector: str, query: bool, trees: int) -> Iterator[pa.RecordBatch]:
    """Add ``strings`` to batches, whose vectors may differ in length."""
    for batch in batches:
        column, largest = batch.column(vector), batch.column("largest").to_numpy(zero_copy_only=False)
        lengths = np.diff(column.offsets.to_numpy())
        coded: list = [b""] * batch.num_rows
        for d in np.unique(lengths):
            rows = np.flatnonzero(lengths == d)
            for part in np.array_split(rows, -(-len(rows) // 4096)):
                values = matrix(pa.chunked_array([column.take(pa.array(part))]))
                with np.errstate(over="ignore", invalid="ignore"):
                    lift = np.zeros(len(part)) if query else np.sqrt(np.maximum(largest[part] ** 2 - (values**2).sum(1), 0))
                for row, string in zip(part, strings(values, np.where(np.isfinite(lift), lift, 0), trees), strict=True):
                    coded[row] = string.tobytes()
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(coded, pa.binary())], names=[*batch.schema.names, "strings"])


def hashed(df: DataFrame, query: bool, trees: int) -> DataFrame:
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return map_arrow(df, partial(_hash, vector="direction" if query else "vector", query=query, trees=trees), f"{schema}, strings binary")


def _coded(column: pa.ChunkedArray) -> np.ndarray:
    """The strings of a group, as (trees, rows)."""
    return np.ascontiguousarray(np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), -1).T)


class Forest:
    """The trees over one block of rows; ``coded`` has their strings, as (trees, rows)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, coded: np.ndarray, gather: float = GATHER):
        self.ids, self.vectors, self.single = ids, vectors, vectors.astype(np.float32)
        self.trees = len(coded)
        self.order = np.stack([np.argsort(s, kind="stable").astype(np.int32) for s in coded])
        self.sorted = np.take_along_axis(coded, self.order, 1)
        self.target = int(np.ceil(gather * len(ids) ** GROWTH))
        with np.errstate(over="ignore"):
            self.largest = float(np.linalg.norm(vectors, axis=1).max(initial=0))

    def ranges(self, coded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, end) in each tree's sorted array for each prefix of 0..LETTERS letters, as (trees, lengths, queries)."""
        free = np.arange(BITS, -1, -LETTER_BITS, dtype=np.uint64)[:, None]
        first = np.empty((self.trees, LETTERS + 1, coded.shape[1]), np.int64)
        end = np.empty_like(first)
        for t in range(self.trees):
            low = coded[t].astype(np.uint64)[None, :] >> free << free
            first[t] = np.searchsorted(self.sorted[t], low.ravel().astype(np.uint32)).reshape(low.shape)
            end[t] = np.searchsorted(self.sorted[t], (low + (np.uint64(1) << free) - np.uint64(1)).ravel().astype(np.uint32), side="right").reshape(low.shape)
        return first, end

    def candidates(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Rows met by one query on the way up; ``first`` and ``end`` as (trees, lengths)."""
        sizes = end - first
        enough = np.flatnonzero(sizes.sum(0) >= self.target)
        length = int(enough[-1]) if len(enough) else 0  # the longest prefix at which the trees have met enough
        at = np.full(self.trees, length)
        if length < LETTERS:  # as many trees ascend the last step as are needed
            step = sizes[:, length] - sizes[:, length + 1]
            before = sizes[:, length + 1].sum() + np.cumsum(step) - step
            at[before >= self.target] += 1
        met = np.zeros(len(self.ids), bool)
        for t, a in enumerate(at.tolist()):
            met[self.order[t, first[t, a] : end[t, a]]] = True
        return met

    def search(self, query_id: int, query: np.ndarray, met: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        rows = np.flatnonzero(met & (self.ids != query_id))
        if len(rows) > 4 * k:
            with np.errstate(over="ignore", invalid="ignore"):
                rough = self.single[rows] @ query.astype(np.float32)
                margin = 1e-6 * len(query) * self.largest * float(np.linalg.norm(query)) + 1e-30
            if np.isfinite(rough).all() and np.isfinite(margin):  # keep all whose exact product may be among the best
                rows = rows[rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - margin]
        with np.errstate(over="ignore", invalid="ignore"):
            scores = (self.vectors[rows] * query).sum(1)
        best = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows][best], scores[best]


def _search(block: pa.Table, queries: pa.Table, k: int, gather: float) -> pa.Table:
    q, query_id, vec_id, score = [], [], [], []
    if block.num_rows and queries.num_rows:
        forest = Forest(block.column("id").to_numpy(), matrix(block.column("vector")), _coded(block.column("strings")), gather)
        numbers, owns, vectors, coded = queries.column("q").to_numpy(), queries.column("own").to_numpy(), matrix(queries.column("direction")), _coded(queries.column("own_strings"))
        for at in range(0, len(owns), 256):
            first, end = forest.ranges(coded[:, at : at + 256])
            for i in range(at, min(at + 256, len(owns))):
                met = forest.candidates(first[:, :, i - at], end[:, :, i - at])
                if met.sum() <= k:  # a block so small that fewer than k others are met: all of it
                    met[:] = True
                ids, scores = forest.search(owns[i], vectors[i], met, k)
                q.append(np.full(len(ids), numbers[i]))
                query_id.append(np.full(len(ids), owns[i]))
                vec_id.append(ids)
                score.append(scores)
    return hits_table(q, query_id, vec_id, score, pa.float64())


def nearest(
    df: DataFrame, query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, trees: int = TREES, gather: float = GATHER, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS
) -> DataFrame:
    """query_id, rank, vec_id, score of the nearest k rows found for each query.

    Nearness is the inner product in double precision. ``query`` says, over (``id``), which rows are
    queries. Candidates are all rows but those with the query's own id; if there are fewer than k, all
    are returned. Ties go to the smaller id. Rows with a null id, or a vector that is null, empty, zero,
    or holds a null or non-finite component take no part. A query's candidates are the rows whose vectors
    have its own vector's length. Every query row is a query of its own, and repeated rows are candidates each.
    Each block of rows has a forest, and a query visits all of them. An empty table gives no rows.
    """
    rows = valid_rows(df, id_col, vector_col).where(F.exists("vector", lambda x: x != 0))
    return search_blocks(rows, query, partial(_search, k=k, gather=gather), k, "double", block_rows, query_rows, partial(hashed, trees=trees))
