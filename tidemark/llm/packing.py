"""Packing of token ids into sequences by power-of-two decomposition.

Method: a document of n ids is cut into as many full sequences as fit, and the rest into the powers of
two of its binary representation, longest first. Every piece is a sequence of its own: no sequence
crosses documents and none is padded. Sequences of one length share a bucket, so that a loader takes
batches of one shape from one bucket. Nothing is shuffled: cutting needs the document alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import word_tokens
from tidemark.llm._common import frees, map_arrow, slices

#: Room for the numbers within a bucket below the bucket's own bits.
BUCKET_SHIFT = 57


def piece_lengths(n: int, max_length: int) -> list[int]:
    """Lengths of the pieces of n ids, longest first."""
    full, rest = divmod(n, max_length)
    return [max_length] * full + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


@frees(word_tokens.unload)
def _pieces(batches: Iterator[pa.RecordBatch], path: str, end_id: int, max_length: int) -> Iterator[pa.RecordBatch]:
    tokens = word_tokens.load(path)
    end = np.array([end_id], "<u4").tobytes()
    for batch in slices(batches, 1, 2 << 20):
        rows, starts, lengths, ids, totals = [], [], [], [], []
        for row, text in enumerate(batch.column(1).to_pylist()):
            packed = tokens.encode(text or "") + end
            total, at = len(packed) // 4, 0
            for n in piece_lengths(total, max_length):
                rows.append(row)
                starts.append(at)
                lengths.append(n)
                ids.append(packed[4 * at : 4 * (at + n)])
                totals.append(total)
                at += n
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(ids, pa.binary()), pa.array(totals, pa.int64())],
            names=["doc_id", "start", "length", "ids", "doc_tokens"],
        )


def pack(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, max_length: int = 2048) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, doc_tokens, bucket, sequence_id, offset.

    ``ids`` holds little-endian unsigned 32-bit ids, ``bucket`` the binary logarithm of the sequence's
    length. A null or empty text is the end id alone, one piece of length 1. A text of any length is
    packed whole. Rows that share a doc_id are documents of their own with sequences of their own;
    a null doc_id stays null. An empty table gives no rows. ``max_length`` has to be a power of two.
    Sequence ids are unique; those of longer buckets come first; within a bucket they follow the scan.
    """
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")
    kind = df.schema[id_col].dataType.simpleString()
    top = max_length.bit_length() - 1
    source = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    pieces = map_arrow(source, partial(_pieces, path=tokenizer_path, end_id=end_id, max_length=max_length), f"doc_id {kind}, start long, length long, ids binary, doc_tokens long")
    bucket = F.log2("length").cast("int")
    return pieces.select(
        "*",
        bucket.alias("bucket"),
        (F.shiftleft((F.lit(top) - bucket).cast("long"), BUCKET_SHIFT) + F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )


def write_buckets(packed: DataFrame, path: str) -> None:
    """Write sequences to one folder per length, ready to be read in batches of one shape."""
    packed.write.partitionBy("bucket").parquet(path)
