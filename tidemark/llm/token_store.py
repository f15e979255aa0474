"""Token-id shards: concatenated ids with Elias-Fano coded document boundaries.

A shard holds the ids of consecutive documents in one array of 16 or 32 bits and the documents' ends as
an Elias-Fano sequence: the low bits of every end side by side, the high bits in unary. A select
structure (the place of every 64th one-bit) gives any boundary in constant time, so there is no table
of 64-bit offsets; readers take every offset from it. Whole-number document ids, which ascend, are
Elias-Fano coded likewise. Shards are rows of a Parquet table, so Spark's commit protocol makes writing safe
against lost or doubled tasks, and any store that Spark reaches will do; :func:`export_files` lays
each shard down as a file of its own for loaders that map files.

File image of a shard, little-endian: magic ``TMSHARD1``, then unsigned 64-bit: documents, ids, bytes
per id, low bits, words of high bits; then the ids, the low bits, the high bits and the select samples (32-bit), each
padded to 8 bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from tidemark.llm import word_tokens
from tidemark.llm._common import frees, map_arrow, slices

MAGIC = b"TMSHARD1"
SAMPLE = 64
SHARD_IDS = 1 << 21
#: Types of ids that are Elias-Fano coded; others stay as they are.
WHOLE = ("tinyint", "smallint", "int", "bigint")


class EliasFano:
    """A non-decreasing sequence of unsigned integers in about 2 + log2(largest / count) bits each."""

    def __init__(self, count: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.count, self.low_bits, self.low, self.high, self.samples = count, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = np.zeros(0, np.uint8)
        if low_bits:
            bits = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
            low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(ones[-1]) if n else 0) // 64 + 1, np.uint64)
        np.bitwise_or.at(high, ones >> 6, np.uint64(1) << (ones & 63).astype(np.uint64))
        return cls(n, low_bits, low, high, ones[::SAMPLE].astype("<u4"))

    def _low(self, i: int) -> int:
        at = i * self.low_bits
        first, last = at >> 3, (at + self.low_bits + 7) >> 3
        return (int.from_bytes(self.low[first:last].tobytes(), "little") >> (at & 7)) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """Value i, from the sample before it and popcounts of the words between."""
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        word_at = at >> 6
        word = int(self.high[word_at]) >> (at & 63) << (at & 63)
        while (ones := word.bit_count()) <= left:
            left -= ones
            word_at += 1
            word = int(self.high[word_at])
        for _ in range(left):
            word &= word - 1
        place = (word_at << 6) + (word & -word).bit_length() - 1
        return (place - i) << self.low_bits | self._low(i)

    def image(self) -> bytes:
        """Low bits, high bits and select samples, each padded to 8 bytes."""
        return b"".join(map(_padded, (self.low.tobytes(), self.high.astype("<u8").tobytes(), self.samples.tobytes())))

    @classmethod
    def of_image(cls, count: int, low_bits: int, words: int, image: bytes, at: int = 0) -> EliasFano:
        """Read back from its image, without copying."""
        parts = []
        for kind, n in (("u1", (count * low_bits + 7) // 8), ("<u8", words), ("<u4", -(-count // SAMPLE))):
            parts.append(np.frombuffer(image, kind, n, at))
            at += -(-parts[-1].nbytes // 8) * 8
        return cls(count, low_bits, *parts)


def _padded(raw: bytes) -> bytes:
    return raw + b"\0" * (-len(raw) % 8)


def encode_ids(ids: pa.Array) -> bytes:
    """Ascending whole numbers, nulls first, as an Elias-Fano sequence of the distances from the first."""
    nulls = ids.null_count
    values = ids.slice(nulls).cast(pa.int64()).to_numpy(zero_copy_only=False).astype(np.int64)
    first = int(values[0]) if len(values) else 0
    coded = EliasFano.encode(values.astype(np.uint64) - np.uint64(first % (1 << 64)))
    return np.array([nulls, first, coded.count, coded.low_bits, len(coded.high)], "<i8").tobytes() + coded.image()


def decode_ids(image: bytes) -> Callable[[int], int | None]:
    """The function that gives the id of a document by its place in the shard."""
    nulls, first, *of = np.frombuffer(image, "<i8", 5).tolist()
    coded = EliasFano.of_image(*of, image, 40)
    return lambda i: None if i < nulls else first + coded.select(i - nulls)


def shard_image(ids: np.ndarray, ends: np.ndarray) -> bytes:
    """The file image of ids whose documents end at ``ends``."""
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    bounds = EliasFano.encode(ends)
    head = np.array([len(ends), len(ids), width, bounds.low_bits, len(bounds.high)], "<u8").tobytes()
    return MAGIC + head + _padded(ids.astype(f"<u{width}").tobytes()) + bounds.image()


class Shard:
    """A shard read back from its image, without copying."""

    def __init__(self, image: bytes):
        if image[:8] != MAGIC:
            raise ValueError("not a token shard")
        n, total, width, low_bits, words = np.frombuffer(image, "<u8", 5, 8).tolist()
        self.ids = np.frombuffer(image, f"<u{width}", total, 48)
        self.bounds = EliasFano.of_image(n, low_bits, words, image, 48 + -(-self.ids.nbytes // 8) * 8)

    def __len__(self) -> int:
        return self.bounds.count

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.bounds.select(i - 1) if i else 0 : self.bounds.select(i)]


@frees(word_tokens.unload)
def _shards(batches: Iterator[pa.RecordBatch], path: str, end_id: int, shard_ids: int, coded: bool) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, number = TaskContext.get().partitionId(), 0
    tokens, end = word_tokens.load(path), np.array([end_id], "<u4").tobytes()
    packed, docs, size, before = [], [], 0, 0

    def flush() -> pa.RecordBatch:
        ids = np.frombuffer(b"".join(packed), "<u4")
        ends = np.cumsum([len(p) // 4 for p in packed], dtype=np.int64)
        every = pa.concat_arrays(docs)
        column = pa.array([encode_ids(every)], pa.binary()) if coded else pa.ListArray.from_arrays(pa.array([0, len(packed)], pa.int32()), every)
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int64()), pa.array([number], pa.int64()), column, pa.array([before], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([shard_image(ids, ends)], pa.binary())],
            names=["part", "number", "doc_ids", "before", "n_ids", "image"],
        )

    for batch in slices(batches, 1, 1 << 20):
        packed += [tokens.encode(t or "") + end for t in batch.column(1).to_pylist()]
        docs.append(batch.column(0))
        size = size + sum(len(p) for p in packed[-batch.num_rows :]) // 4
        if size >= shard_ids:
            yield flush()
            packed, docs, size, number, before = [], [], 0, number + 1, before + size
    if packed:
        yield flush()


def write(df: DataFrame, tokenizer_path: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, shard_ids: int = SHARD_IDS) -> None:
    """Encode every document, append ``end_id`` and write shards in ascending order of ``id_col`` to ``path``.

    Null and empty texts are the end id alone; null ids come first. Rows that share an id are
    documents of their own, in the order of the scan. Texts are encoded whole; a shard ends after the
    document with which it reaches ``shard_ids``. An empty table gives an empty table of shards.
    """
    kind = df.schema[id_col].dataType.simpleString()
    coded = kind in WHOLE
    source = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("_row"))
    ordered = source.repartitionByRange("doc_id", "_row").sortWithinPartitions("doc_id", "_row").select("doc_id", "text")
    shards = map_arrow(ordered, partial(_shards, path=tokenizer_path, end_id=end_id, shard_ids=shard_ids, coded=coded), f"part long, number long, doc_ids {'binary' if coded else f'array<{kind}>'}, before long, n_ids long, image binary")
    shards.write.option("compression", "zstd").parquet(path)


@frees()
def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            shard, base = Shard(batch.column(2)[row].as_py()), batch.column(1)[row].as_py()
            docs = batch.column(0)[row]
            doc = decode_ids(docs.as_py()) if pa.types.is_binary(docs.type) else None
            start = 0
            for at in range(0, len(shard), 1024):
                places = range(at, min(at + 1024, len(shard)))
                bounds = [start, *map(shard.bounds.select, places)]
                start = bounds[-1]
                own = pa.array([doc(i) for i in places], pa.int64()) if doc else docs.values.slice(at, len(places))
                ids = [shard.ids[a:b].astype("<u4").tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([own, pa.array([base + b for b in bounds[:-1]], pa.int64()), pa.array(np.diff(bounds), pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian unsigned 32-bit) of every document of written shards; whole-number ids are long.

    ``start`` counts the ids of all documents before. A shard knows the ids before it in its partition;
    the partitions' sums, one number for each written partition, are broadcast. Shards aren't shuffled.
    """
    shards = spark.read.parquet(path)
    held = shards.schema["doc_ids"].dataType
    kind = held.elementType.simpleString() if isinstance(held, ArrayType) else "long"
    sums = sorted((r["part"], r["n"]) for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    bases = np.cumsum([0, *(n for _, n in sums)]).tolist()
    per_part = spark.createDataFrame([(p, b) for (p, _), b in zip(sums, bases, strict=False)], "part long, part_base long")
    placed = shards.join(F.broadcast(per_part), "part").select("doc_ids", (F.col("part_base") + F.col("before")).alias("base"), "image")
    return map_arrow(placed, _read, f"doc_id {kind}, start long, n_tokens long, ids binary")


def export_files(spark: SparkSession, path: str, folder: str) -> int:
    """Write each shard as ``part-number.tms`` to a folder that all executors mount; returns how many."""
    import os

    def put(row) -> None:
        name = os.path.join(folder, f"{row['part']:06d}-{row['number']:06d}.tms")
        with open(f"{name}.{os.getpid()}", "wb") as f:
            f.write(row["image"])
        os.replace(f.name, name)

    shards = spark.read.parquet(path).select("part", "number", "image")
    shards.foreach(put)
    return shards.count()
