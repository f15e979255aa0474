"""Exact top-k search by inner product over a bit-sliced index.

Method: the components of a block's vectors are whole numbers; each binary digit of each component is
a bitmap over the block's rows. The lowest digits are left out of the index (quantised attribute
slices). A query's score over all rows is a sum of slices, each at the weight that the query's own
digits give it; carry-save adders over whole bitmaps add them. The sum's slices are then walked from
the most significant one down to find the rows on top. What the left-out digits could still change is
bounded; rows within that bound of the k-th are the boundary, and their scores are worked out exactly.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._vectors import hits_table, matrix, search_blocks, valid_rows

#: Digits of a component that the index has, the sign among them.
KEPT_DIGITS = 7
BLOCK_ROWS = 32768
QUERY_ROWS = 16384
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def signed_digits(value: int) -> list[tuple[int, int]]:
    """(power, +1 or -1) of a whole number's non-adjacent form: few digits that aren't zero."""
    found, power = [], 0
    while value:
        if value & 1:
            digit = 2 - (value & 3)
            found.append((power, digit))
            value -= digit
        value >>= 1
        power += 1
    return found


def _bitmap(flags: np.ndarray, words: int) -> np.ndarray:
    raw = np.packbits(flags, bitorder="little")
    return np.pad(raw, (0, words * 8 - len(raw))).view(np.uint64)


class SliceIndex:
    """The bitmaps of one block of rows."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, kept_digits: int = KEPT_DIGITS):
        self.ids, self.values = ids, values
        self.largest = int(np.abs(values).max(initial=0))
        self.n, self.words = len(values), max(1, -(-len(values) // 64))
        self.digits = max(self.largest.bit_length() + 1, 2)
        self.dropped = max(0, self.digits - kept_digits)
        self.digits -= self.dropped
        slices = [_bitmap((values[:, d] >> (self.dropped + b)) & 1 == 1, self.words) for d in range(values.shape[1]) for b in range(self.digits)]
        self.slices = np.stack(slices)
        self.slices = np.concatenate([self.slices, ~self.slices])
        self.valid = _bitmap(np.ones(self.n, bool), self.words)
        self.by_id = np.argsort(ids, kind="stable")
        self.sorted_ids = ids[self.by_id]

    def total(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of (score of the kept digits + constant) for all rows, lowest first, and the constant."""
        width, half = self.digits, len(self.slices) // 2
        places: dict[int, list[int]] = {}
        constant = 0
        for d, value in enumerate(query.tolist()):
            for power, sign in signed_digits(value):
                for b in range(width):
                    negative = (sign < 0) != (b == width - 1)  # the top digit of two's complement counts negative
                    places.setdefault(power + b, []).append(d * width + b + half * negative)
                    constant += negative << (power + b)
        out: list[np.ndarray] = []
        weight, carried = 0, []
        top = max(places, default=-1)
        while weight <= top or carried:
            parts = [self.slices[places[weight]]] if weight in places else []
            bits = np.concatenate(parts + carried) if parts or carried else np.zeros((0, self.words), np.uint64)
            carried = []
            while len(bits) > 1:
                if len(bits) == 2:
                    carried.append(bits[:1] & bits[1:])
                    bits = bits[:1] ^ bits[1:]
                else:
                    third = len(bits) // 3
                    a, b, c = bits[:third], bits[third : 2 * third], bits[2 * third : 3 * third]
                    x = a ^ b
                    carried.append((a & b) | (x & c))
                    bits = np.concatenate([x ^ c, bits[3 * third :]])
            out.append(bits[0] if len(bits) else np.zeros(self.words, np.uint64))
            weight += 1
        return out, constant

    def boundary(self, query_id: int, query: np.ndarray, k: int) -> np.ndarray:
        """Rows that can be among the query's best k, all of those that are among them."""
        rest = self.valid.copy()
        a, b = np.searchsorted(self.sorted_ids, [query_id, query_id + 1])
        own = self.by_id[a:b]
        np.bitwise_and.at(rest, own >> 6, ~(np.uint64(1) << (own & 63).astype(np.uint64)))
        if int(np.bitwise_count(rest).sum()) > k:
            slices, _ = self.total(query)
            # the k-th largest sum, from the most significant slice downward
            sure, tied, kth = np.zeros_like(rest), rest, 0
            for s in reversed(slices):
                ones = tied & s
                if int(np.bitwise_count(sure | ones).sum()) >= k:
                    tied, kth = ones, kth << 1 | 1
                else:
                    sure, tied, kth = sure | ones, tied & ~s, kth << 1
            # lowest sum that the dropped digits can still lift to the k-th
            slack = sum(map(abs, query.tolist())) * ((1 << self.dropped) - 1)
            least = kth - -(-slack >> self.dropped)
            if least > 0:
                above, equal = np.zeros_like(rest), rest
                for place in range(len(slices) - 1, -1, -1):
                    if least >> place & 1:
                        equal = equal & slices[place]
                    else:
                        above, equal = above | (equal & slices[place]), equal & ~slices[place]
                rest = above | equal
        return np.flatnonzero(np.unpackbits(rest.view(np.uint8), bitorder="little", count=self.n))

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the best k rows whose id isn't the query's, ties to the smaller id."""
        rows = self.boundary(query_id, query, k)
        if self.largest * sum(map(abs, query.tolist())) >= 1 << 63:  # beyond 64 bits: Python's whole numbers
            exact = self.values[rows].astype(object) @ query.astype(object)
            order = sorted(range(len(rows)), key=lambda i: (-exact[i], self.ids[rows[i]]))[:k]
            if any(not -(1 << 63) <= exact[i] < 1 << 63 for i in order):
                raise OverflowError(f"a score of query {query_id} is beyond 64 bits")
            return self.ids[rows][order], exact[order].astype(np.int64)
        scores = self.values[rows] @ query
        best = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows][best], scores[best]


def _quantised(column: pa.ChunkedArray, scale: float) -> np.ndarray:
    with np.errstate(over="ignore"):
        whole = np.floor(scale * matrix(column))
    if (np.abs(whole) >= 2.0**63).any():
        raise OverflowError("a component is beyond 64 bits after scaling")
    return whole.astype(np.int64)


def _search(block: pa.Table, queries: pa.Table, k: int, scale: float) -> pa.Table:
    q, query_id, vec_id, score = [], [], [], []
    if block.num_rows and queries.num_rows:
        index = SliceIndex(block.column("id").to_numpy(), _quantised(block.column("vector"), scale))
        for number, own, vector in zip(queries.column("q").to_pylist(), queries.column("own").to_pylist(), _quantised(queries.column("direction"), scale), strict=True):
            ids, scores = index.search(own, vector, k)
            q.append(np.full(len(ids), number))
            query_id.append(np.full(len(ids), own))
            vec_id.append(ids)
            score.append(scores)
    return hits_table(q, query_id, vec_id, score, pa.int64())


def top_k(df: DataFrame, query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: float = 256.0, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score of the k rows with the highest score for each query, exactly.

    Components become floor(scale * x); the score is the whole-number inner product. ``query`` says, over
    (``id``), which rows are queries. Candidates are all rows but those with the query's own id; fewer
    than k are returned only if there are fewer. Ties go to the smaller id. Rows with a null id, or a
    vector that is null, empty, or holds a null or non-finite component take no part. A query's candidates
    are the rows whose vectors have its own vector's length; other lengths have no inner product with it.
    Every query row is a query of its own, repeated rows too, and repeated rows are candidates each.
    Components or scores beyond 64 bits, which SQL's BIGINT doesn't hold either, end the job with an error. An empty table gives no rows.
    """
    rows = valid_rows(df, id_col, vector_col)
    return search_blocks(rows, query, partial(_search, k=k, scale=scale), k, "long", block_rows, query_rows)
