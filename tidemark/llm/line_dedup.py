"""Line dedup with two Bloom filters and an exact confirmation of the suspects.

Method: a first pass puts every document's distinct line keys into a filter of keys seen once; keys met
again go into a second filter of keys seen twice. A second pass tests every key against the second
filter. Only suspected repeats are shuffled, as 16-byte digests; counting them exactly tells which
keys really repeat and which document keeps its lines.

Filters are built by every task for itself and merged segment by segment: a bit is seen twice if some
task saw it twice or two tasks saw it. That keeps every key that really repeats; keys that only look
so are dropped by the exact count. Tasks send their segments compressed, so what is shuffled for the
filters follows the number of keys, not tasks times filter size. The merged filter is broadcast;
``filter_bits`` bounds it at any input size. If far more keys than bits come, more keys are
suspected and shuffled, and the result is the same.

Keys that many documents hold meet their documents by broadcast (there can't be many such keys), the
others by a join, so no task gets a frequent line's documents. Texts of
documents that lose no line stay where they are; only the others' are joined with the keys they lose.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._bloom import MOST_FILTER_BITS, SEGMENT_BITS, Bloom, perhaps_in
from tidemark.llm._common import frees, join_frequent, map_arrow, materialise, slices, unused

BLANK = " \t\n\x0b\x0c\r"
MIN_CHARS = 20
MIN_DOCUMENTS = 3


def line_key(line: str) -> str:
    """A line without white space at its ends and with A-Z in lower case."""
    return line.strip(BLANK).encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def digest(line: str, min_chars: int) -> bytes | None:
    """16 bytes that stand for the line's key; None for keys that are too short."""
    line = line.strip(BLANK)
    return hashlib.blake2b(line.encode("utf-8", "surrogatepass").lower(), digest_size=16).digest() if len(line) >= min_chars else None


def keys_of(text: str | None, min_chars: int) -> set[bytes]:
    found = {digest(line, min_chars) for line in (text or "").split("\n")}
    found.discard(None)
    return found


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)[:, 0]


def _build(bits: int, min_chars: int):
    """Each task's two filters, as rows (segment, once, twice)."""

    @frees()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = Bloom(bits), Bloom(bits)
        for batch in slices(batches, 0):
            keys = [k for t in batch.column(0).to_pylist() for k in keys_of(t, min_chars)]
            if not keys:
                continue
            hashes, counts = np.unique(_hashes(keys), return_counts=True)
            places = once.places(hashes)
            twice.add(places[:, (counts > 1) | once.has(places)])
            once.add(places)
        size = SEGMENT_BITS // 8
        for s in np.flatnonzero(once.data.reshape(-1, size).any(1)).tolist():
            part = slice(s * size, (s + 1) * size)
            yield pa.RecordBatch.from_pydict({"segment": pa.array([s], pa.int32()), "once": [zlib.compress(once.data[part].tobytes(), 1)], "twice": [zlib.compress(twice.data[part].tobytes(), 1)]})

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fold the tasks' segments; a partition holds whole segments and a bounded number of them."""
    found: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for segment, once, twice in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (once, twice))
            if segment not in found:
                found[segment] = [a.copy(), b.copy()]
            else:
                seen, again = found[segment]
                again |= b | (seen & a)
                seen |= a
    for segment, (_, again) in found.items():
        if again.any():
            yield pa.RecordBatch.from_pydict({"segment": pa.array([segment], pa.int32()), "twice": [zlib.compress(again.tobytes(), 1)]})


def twice_seen(df: DataFrame, text_col: str, min_chars: int, filter_bits: int | None) -> Bloom:
    """The merged filter of keys that seem to be in two documents or more."""
    text = F.col(text_col)
    if filter_bits is None:
        lines = df.agg(F.sum(F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1)).head()[0] or 1
        filter_bits = min(MOST_FILTER_BITS, 1 << (16 * int(lines)).bit_length())
    bits = max(SEGMENT_BITS, filter_bits)
    parts = map_arrow(df.select(text), _build(bits, min_chars), "segment int, once binary, twice binary")
    whole = Bloom(bits)
    size = SEGMENT_BITS // 8
    for row in map_arrow(parts.repartition("segment"), _merge, "segment int, twice binary").collect():
        whole.data[row["segment"] * size : (row["segment"] + 1) * size] = np.frombuffer(zlib.decompress(row["twice"]), np.uint8)
    return whole


def dedup_lines(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS, filter_bits: int | None = None, result_col: str = "line_dedup"
) -> DataFrame:
    """``df`` with a struct (n_lines, n_dropped, kept) in ``result_col``.

    Keys of ``min_chars`` code points or more that are found in ``min_documents`` rows or more lose
    all their lines except in the rows with the largest id that holds them. ``kept`` has the other
    lines, joined by newlines. A null or empty text is one empty line, kept as an empty text. Rows
    that share an id count as documents of their own; if theirs is the largest id, all of them keep
    the line. Rows with a null id count, but keep a line only if no row with an id holds it. Texts are
    split whole, whatever their length. All columns of ``df`` stay, whatever their names, but for one
    named ``result_col``, whose place the result takes. An empty table gives an empty table.
    """
    df = df.drop(result_col)
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = df.schema[id_col].dataType.simpleString()
    suspected = df.sparkSession.sparkContext.broadcast(twice_seen(source, "text", min_chars, filter_bits).data)

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = suspected.value
        bloom = Bloom(len(data) * 8, data)
        for batch in slices(batches, 1):
            keys, rows = [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                own = keys_of(text, min_chars)
                keys += own
                rows += [row] * len(own)
            if not keys:
                continue
            hit = np.flatnonzero(bloom.has(bloom.places(_hashes(keys))))
            yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in hit], pa.binary()), batch.column(0).take(pa.array([rows[i] for i in hit], pa.int64()))], names=["key", "id"])

    suspect = materialise(map_arrow(source, suspects, f"key binary, id {kind}"), "suspects")
    repeated = materialise(suspect.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= min_documents), "repeated")
    losing = join_frequent(suspect, repeated, "key", suspect.count()).where(~F.col("id").eqNullSafe(F.col("keeper")))
    own_id, drop, perhaps = unused(df, "id", "drop", "perhaps")
    drops = materialise(losing.groupBy(F.col("id").alias(own_id)).agg(F.collect_set("key").alias(drop)), "drops")

    def apply(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, dropped in parts:
            rows = []
            for text, gone in zip(texts, dropped, strict=True):
                lines = (text or "").split("\n")
                kept = lines
                if gone is not None and len(gone):
                    gone = {bytes(d) for d in gone}
                    kept = [x for x in lines if digest(x, min_chars) not in gone]
                rows.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
            yield pd.DataFrame(rows, columns=["n_lines", "n_dropped", "kept"])

    result = F.pandas_udf(apply, "n_lines long, n_dropped long, kept string")
    marked = df.withColumn(perhaps, perhaps_in(drops.select(F.col(own_id).alias(id_col)), id_col))
    whole = F.coalesce(text_col, F.lit(""))
    n_lines = (F.length(whole) - F.length(F.replace(whole, F.lit("\n"))) + 1).cast("long")
    as_they_are = marked.where(~F.col(perhaps)).withColumn(result_col, F.struct(n_lines.alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), whole.alias("kept")))
    joined = marked.where(perhaps).join(drops, F.col(id_col).eqNullSafe(F.col(own_id)), "left").withColumn(result_col, result(F.col(text_col), F.col(drop)))
    columns = [*df.columns, result_col]
    return as_they_are.select(columns).union(joined.select(columns))
