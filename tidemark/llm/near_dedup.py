"""Near-duplicate classes by DartMinHash signatures and banding, every link confirmed exactly.

Method: a document is a weighted set of five-word shingles. Darts fall on the plane of weight and rank
of every shingle, at places that a hash fixes for all documents alike. A document takes the darts that
lie within its weights and below a rank chosen so that about k ln k + 2k of them are met, however many
shingles it has; the earliest dart of each of k coordinates is its signature. Two documents agree in a
coordinate with the probability of their weighted Jaccard similarity. Bands of coordinates are joined.

Texts of the same words are one node from the start, so groups of copies cost one row. In a band's
bucket, small groups are compared pair by pair. In large ones every member is compared with the
member that shares most of its buckets with most others, the likely origin of edited copies. Members
that don't match it go on among themselves,
round by round, and what is left in the end is compared in blocks that put out links only. So no bucket emits its square, and no bucket is cut. Links are confirmed on the shingle sets
themselves and joined to classes by spreading the smallest label.

A member that missed the hub may still be linked to one that matched it. Jaccard distance is a metric, so with
links up to the distance d the two are compared only if the miss lies within 2d of the hub and the match at
least the miss's distance less d away; and only if the hub's class doesn't hold the miss already.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._bloom import perhaps_in
from tidemark.llm._common import frees, join_frequent, map_arrow, materialise, mix64, remove, slices, unused

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 6
#: Buckets up to this size are compared pair by pair.
SMALL = 4
#: After so many rounds the rest of a bucket is compared in blocks.
ROUNDS = 3
#: Members of a bucket that a block holds.
BLOCK = 128

_WORD = re.compile(r"\w+")


class _Known(dict):
    """word -> 8 bytes that stand for it, worked out when it is first asked for."""

    def __missing__(self, word: str) -> bytes:
        found = self[word] = hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest()
        return found


_known = _Known()


def _word_hashes(words: list[str]) -> np.ndarray:
    if len(_known) > 120_000:
        _known.clear()
    return np.frombuffer(b"".join(map(_known.__getitem__, words)), np.uint64)


def _forget() -> None:
    _known.clear()


_FACTORS = mix64(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)


def shingles(words: list[str], n: int = WORDS) -> np.ndarray:
    """64-bit hashes of all runs of n words, repeats included; all words as one run if there are fewer."""
    if not words:
        return np.zeros(0, np.uint64)
    h = _word_hashes(words)
    n = min(n, len(h))
    with np.errstate(over="ignore"):
        total = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            total += h[i : len(h) - n + 1 + i] * _FACTORS[i]
        return mix64(total)


def dart_signatures(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, count: int, k: int) -> np.ndarray:
    """The signatures of ``count`` weighted sets, as (count, k) dart ids.

    Set ``owner[i]`` holds ``elements[i]`` with ``weights[i]`` > 0, each element once. Every set needs an element.

    The weight axis is cut into strips [2^v - 1, 2^(v+1) - 1). Along the rank axis of an element's strip
    the darts are a Poisson process with the strip's width as rate, so the gaps between them are
    exponential; a dart's height in the strip is uniform. All of it comes from hashes of (element, strip, number of the dart).
    """
    out = np.zeros((count, k), np.uint64)
    todo = np.arange(count)
    tau = (k * np.log(k) + 2 * k) / np.maximum(np.bincount(owner, weights, count), 1e-12)
    strips = np.floor(np.log2(weights + 1 - 1e-12)).astype(np.int64) + 1
    item = np.repeat(np.arange(len(elements)), strips)
    strip = np.arange(len(item)) - np.repeat(np.cumsum(strips) - strips, strips)
    width = np.exp2(strip)
    height = (weights[item] - (width - 1)) / width  # of the strip's height, what the weight covers
    seed = mix64(elements[item] ^ mix64(strip.astype(np.uint64) + np.uint64(0xDA27)))
    set_of = owner[item]
    while len(todo):
        best = np.full(count * k, np.inf)
        at = np.flatnonzero(np.isin(set_of, todo)) if len(todo) < count else np.arange(len(item))
        rank = np.zeros(len(at))
        number = 0
        ranks, places, ids = [], [], []
        while len(at):
            with np.errstate(over="ignore"):
                h = mix64(seed[at] + np.uint64(number + 1) * np.uint64(0x9E3779B97F4A7C15))
                g = mix64(h ^ np.uint64(0x5851F42D4C957F2D))
            rank = rank - np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / width[at]
            stay = rank <= tau[set_of[at]]
            at, rank, h, g = at[stay], rank[stay], h[stay], g[stay]
            inside = ((g & np.uint64(0xFFFFFFFF)).astype(np.float64) + 0.5) * 2.0**-32 < height[at]
            ranks.append(rank[inside])
            places.append(set_of[at[inside]] * k + ((g[inside] >> np.uint64(32)) % np.uint64(k)).astype(np.int64))
            ids.append(h[inside])
            number += 1
        rank, place, dart = np.concatenate(ranks), np.concatenate(places), np.concatenate(ids)
        np.minimum.at(best, place, rank)
        first = rank == best[place]
        flat = np.zeros(count * k, np.uint64)
        flat[place[first]] = dart[first]
        out[todo] = flat.reshape(count, k)[todo]
        # a coordinate without a dart: throw on up to twice the rank
        todo = todo[np.isinf(best.reshape(count, k)[todo]).any(1)]
        tau[todo] *= 2
    return out


def band_values(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit value for each band of a signature, different from band to band."""
    with np.errstate(over="ignore"):
        parts = signatures.reshape(len(signatures), bands, rows)
        total = np.arange(bands, dtype=np.uint64)[None, :] * np.uint64(0x632BE59BD9B4E019)
        total = np.repeat(total, len(signatures), 0)
        for i in range(rows):
            total = mix64(total + parts[:, :, i] * _FACTORS[i])
    return total.view(np.int64)


def _node(words: list[str], text: str) -> bytes:
    """What texts of the same words share; texts without a word share it if they are equal."""
    same = " ".join(words) if words else "\0" + text
    return hashlib.blake2b(same.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _nodes(texts: pd.Series) -> pd.Series:
    """The nodes of texts, as of :func:`_node`; null for a null."""
    return pd.Series([None if t is None else _node(_WORD.findall(t.lower()), t) for t in texts], dtype=object)


def _repeats(elements: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Elements of which the j-th repeat is one of its own, sorted."""
    number = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    with np.errstate(over="ignore"):
        return np.sort(mix64(np.repeat(elements, counts) + number.astype(np.uint64)))


def _profile(bands: int, rows: int, n: int, weighted: bool):
    """(id, node, bands, shingles) of documents; node stands for the words of the text."""

    @frees(_forget)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 1 << 20):
            nodes, sets, weights = [], [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                words = _WORD.findall(text.lower())
                nodes.append(_node(words, text))
                found, counts = np.unique(shingles(words, n), return_counts=True)
                sets.append(found)
                weights.append(counts if weighted else np.ones(len(found)))
            full = [i for i, s in enumerate(sets) if len(s)]
            values: list = [None] * len(sets)
            if full:
                owner = np.repeat(np.arange(len(full)), [len(sets[i]) for i in full])
                signatures = dart_signatures(np.concatenate([sets[i] for i in full]), np.concatenate([weights[i] for i in full]).astype(np.float64), owner, len(full), bands * rows)
                for i, v in zip(full, band_values(signatures, bands, rows), strict=True):
                    values[i] = v
            if weighted:  # the j-th repeat of a shingle as an element of its own: then sets have the weighted similarity
                sets = [_repeats(s, c) for s, c in zip(sets, weights, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(nodes, pa.binary()), pa.array(values, pa.list_(pa.int64())), pa.array([(s >> np.uint64(32)).astype("<u4").tobytes() for s in sets], pa.binary())],
                names=["id", "node", "bands", "shingles"],
            )

    return run


def jaccard(a: bytes, b: bytes) -> float:
    """Similarity of two sorted sets of 32-bit hashes."""
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    both = np.concatenate([x, y])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared / max(1, len(both) - shared)


def _score(similarity: float):
    """(a, b, near) of the pairs with that similarity, ``near``, at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (batch.column(i) for i in range(4))
            near = np.array([jaccard(x[i].as_buffer(), y[i].as_buffer()) for i in range(batch.num_rows)], np.float64)
            keep = pa.array(np.flatnonzero(near >= similarity))
            yield pa.RecordBatch.from_arrays([a.take(keep), b.take(keep), pa.array(near).take(keep)], names=["a", "b", "near"])

    return run


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _all_pairs(rows: DataFrame) -> DataFrame:
    """All pairs of nodes within buckets; for buckets of bounded size."""
    members = rows.groupBy("bucket").agg(F.sort_array(F.collect_set("node")).alias("m"))
    nested = F.transform("m", lambda x, i: F.transform(F.slice(F.col("m"), i + 2, F.size("m")), lambda y: F.struct(x.alias("a"), y.alias("b"))))
    return members.select(F.explode(F.flatten(nested)).alias("p")).select("p.a", "p.b")


def _links_in_blocks(sized: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links among the members of buckets (bucket, node, n): each pair of blocks of a bucket is a group of bounded size."""
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    dealt = sized.select("bucket", "node", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    dealt = dealt.join(sets, "node").select("bucket", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "node", "shingles")

    def run(group: pa.Table) -> pa.Table:
        owns = np.array(group.column("own"))
        nodes, sets_ = group.column("node").to_pylist(), [np.frombuffer(x, "<u4") for x in group.column("shingles").to_pylist()]
        a, b = [], []
        first, second = np.flatnonzero(owns == owns.min()), np.flatnonzero(owns == owns.max())
        if group.column("p")[0].as_py() != group.column("q")[0].as_py() and len(first) == len(owns):
            second = second[:0]  # the other block of this pair is empty
        if len(second):
            flat = np.concatenate([sets_[j] for j in second])
            lengths = np.array([len(sets_[j]) for j in second])
            starts = np.cumsum(lengths) - lengths
            values, place = np.unique(flat, return_inverse=True)
            for i in first:
                mark = np.isin(values, sets_[i], assume_unique=False)
                shared = np.add.reduceat(mark[place].astype(np.int64), starts)
                close = shared >= similarity * (lengths + len(sets_[i]) - shared)
                for j in second[close]:
                    if nodes[i] != nodes[j]:
                        a.append(min(nodes[i], nodes[j]))
                        b.append(max(nodes[i], nodes[j]))
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return dealt.groupBy("bucket", "p", "q").applyInArrow(run, "a binary, b binary").distinct()


def _links_across(rings: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links between the members of a ring (ring, node, near, missed, n_hit, n_missed) that matched its hub and those that missed it.

    Each pair of a block of the first and a block of the second is a group of bounded size.
    """
    reach = 1 - similarity + 1e-9
    wide = {side: F.ceil(F.col(n) / F.lit(BLOCK)).cast("int") for side, n in ((False, "n_hit"), (True, "n_missed"))}
    own = F.pmod(F.xxhash64("node"), F.when(F.col("missed"), wide[True]).otherwise(wide[False])).cast("int")
    others = F.when(F.col("missed"), wide[False]).otherwise(wide[True])
    dealt = rings.select("ring", "node", "near", "missed", own.alias("own"), F.explode(F.sequence(F.lit(0), others - 1)).alias("other"))
    p, q = F.when(F.col("missed"), F.col("other")).otherwise(F.col("own")), F.when(F.col("missed"), F.col("own")).otherwise(F.col("other"))
    dealt = dealt.join(sets, "node").select("ring", p.alias("p"), q.alias("q"), "node", "near", "missed", "shingles")

    def run(group: pa.Table) -> pa.Table:
        missed, near = np.array(group.column("missed")), np.array(group.column("near"))
        nodes, sets_ = group.column("node").to_pylist(), [np.frombuffer(x, "<u4") for x in group.column("shingles").to_pylist()]
        hits, a, b = np.flatnonzero(~missed), [], []
        if len(hits) and missed.any():
            flat = np.concatenate([sets_[j] for j in hits])
            lengths = np.array([len(sets_[j]) for j in hits])
            starts = np.cumsum(lengths) - lengths
            values, place = np.unique(flat, return_inverse=True)
            for i in np.flatnonzero(missed):
                size = len(sets_[i])
                able = (near[hits] <= near[i] + reach) & (lengths >= similarity * size) & (size >= similarity * lengths)
                if not able.any():
                    continue
                shared = np.add.reduceat(np.isin(values, sets_[i])[place].astype(np.int64), starts)
                for j in hits[able & (shared >= similarity * (lengths + size - shared))]:
                    a.append(min(nodes[i], nodes[j]))
                    b.append(max(nodes[i], nodes[j]))
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return dealt.groupBy("ring", "p", "q").applyInArrow(run, "a binary, b binary").distinct()


def _links(rows: DataFrame, sets: DataFrame, similarity: float) -> tuple[DataFrame, list[DataFrame]]:
    """Confirmed pairs (a, b) of nodes that share a bucket of ``rows`` (bucket, node), and what :func:`_rejoin` needs.

    That is, for each round, (ring, hub, node, near) of the members near the hub of a bucket with misses within reach.
    """
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    crowd = materialise(rows.join(sizes, "bucket").groupBy("node").agg(F.sum("n").alias("crowd")), "crowd")
    rows = materialise(rows.join(crowd, "node"), "buckets")
    confirmed, rings = None, []
    for number in range(ROUNDS + 1):
        size = materialise(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("crowd", "node"))["node"].alias("hub")).where(F.col("n") > 1), "sizes")
        sized = materialise(join_frequent(rows, size, "bucket", rows.count()), "sized")
        if number == ROUNDS:
            confirmed = confirmed.union(materialise(_links_in_blocks(sized, sets, similarity), "links"))
            break
        pairs = _all_pairs(sized.where(F.col("n") <= SMALL))
        spokes = sized.where((F.col("n") > SMALL) & (F.col("node") != F.col("hub"))).select("bucket", "node", "hub", "crowd", *_ordered("node", "hub"))
        pairs = pairs.union(spokes.select("a", "b"))
        left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
        right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
        both = pairs.distinct().join(left, "a").join(right, "b").select("a", "b", "x", "y")
        scored = materialise(map_arrow(both, _score(2 * similarity - 1 - 1e-9), "a binary, b binary, near double"), "links")
        found = scored.where(F.col("near") >= similarity).select("a", "b")
        confirmed = found if confirmed is None else confirmed.union(found)
        placed = spokes.join(scored, ["a", "b"]).select(F.struct(F.lit(number).alias("round"), "bucket").alias("ring"), "hub", "node", "near")
        rings.append(placed)
        rows = materialise(spokes.join(found, ["a", "b"], "left_anti").select("bucket", "node", "crowd"), "rest")
        if rows.isEmpty():
            break
    return confirmed, rings


def _rejoin(labels: DataFrame, rings: list[DataFrame], sets: DataFrame, similarity: float) -> DataFrame:
    """``labels`` after the links between members that matched a hub and those that missed it.

    Matches have their hub's label, so only misses with another one can change anything.
    """
    placed = rings[0]
    for more in rings[1:]:
        placed = placed.union(more)
    placed = materialise(placed, "placed")
    own = labels.select("node", "label")
    of_hub = labels.select(F.col("node").alias("hub"), F.col("label").alias("hub_label"))
    missed = placed.where(F.col("near") < similarity).join(own, "node", "left").join(of_hub, "hub", "left")
    missed = materialise(missed.where(~F.coalesce("label", "node").eqNullSafe(F.coalesce("hub_label", "hub"))).select("ring", "node", "near"), "missed")
    if missed.isEmpty():
        return labels
    # of the matches, those that the nearest miss of their ring allows
    matched = placed.where(F.col("near") >= similarity)
    nearest = missed.groupBy("ring").agg(F.max("near").alias("most"), F.count(F.lit(1)).alias("n_missed"))
    nearest = materialise(nearest.join(matched.groupBy("ring").agg(F.count(F.lit(1)).alias("n")), "ring"), "nearest")
    hits = join_frequent(matched, nearest, "ring", matched.count()).where(F.col("near") <= F.col("most") + (1 - similarity + 1e-9))
    hits = materialise(hits.select("ring", "node", "near", "n_missed"), "hits")
    counted = hits.groupBy("ring").agg(F.count(F.lit(1)).alias("n_hit"), F.first("n_missed").alias("n_missed"))
    counted = materialise(counted.withColumn("n", F.col("n_hit") + F.col("n_missed")), "counted")
    both = hits.select("ring", "node", "near", F.lit(False).alias("missed")).union(missed.select("ring", "node", "near", F.lit(True)))
    across = materialise(_links_across(join_frequent(both, counted, "ring", both.count()), sets, similarity), "links")
    if across.isEmpty():
        return labels
    # classes as nodes: only those that a new link touches take part
    for side in ("a", "b"):
        across = across.join(labels.select(F.col("node").alias(side), "label"), side, "left").withColumn(side, F.coalesce("label", side)).drop("label")
    joined = components(across.where(F.col("a") != F.col("b")).select(*_ordered("a", "b")).distinct())
    merged = labels.join(joined.select(F.col("node").alias("label"), F.col("label").alias("wider")), "label", "left").select("node", F.coalesce("wider", "label").alias("label"))
    return merged.union(joined.join(labels.select("node"), "node", "left_anti").select("node", "label"))


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node with a link; the label is the smallest node that it reaches.

    Labels spread along links and each node then takes its label's label, so the rounds grow with the
    logarithm of the longest path. Every round is written out, and ends in one count.
    """
    spark = links.sparkSession
    edges = materialise(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    now = labels = materialise(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        seen = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        spread = labels.join(seen, labels["node"] == seen["a"]).select("node", F.least("label", "near").alias("low"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("further"))
        last, now = now, materialise(spread.join(jump, "low", "left").select("node", F.least("low", F.coalesce("further", "low")).alias("label"), "old"), "labels")
        labels = now.select("node", "label")
        remove(spark, *(p.rsplit("/", 1)[0] for p in last.inputFiles()[:1]))
        if now.where(F.col("label") != F.col("old")).isEmpty():
            return labels


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, weighted: bool = True) -> DataFrame:
    """doc_id, class_id and copies of every row: class_id is the smallest id of the row's class.

    Classes join documents whose ``words``-word shingles (words: runs of letters, digits and underscores,
    in lower case) have a Jaccard similarity of ``similarity`` or more, and whatever such links connect.
    ``weighted`` counts how often a shingle occurs (the sum of minima by that of maxima), else it is the
    similarity of sets. Shingles are compared by 32 bits of their hashes. ``copies`` is how many rows have the
    same words in the same order. Texts of fewer words are one shingle; texts without any word, null ones among
    them as empty texts, are in a class only with rows of the very same text. Texts count whole. Repeated rows and ids get
    a row each; null ids are in classes but name one only if the class has no other. An empty table gives no rows.
    """
    return _judged(df, id_col, text_col, words, similarity, bands, rows, weighted).select(F.col("id").alias("doc_id"), "class_id", "copies")


def _judged(df: DataFrame, id_col: str, text_col: str, words: int = WORDS, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, weighted: bool = True) -> DataFrame:
    """(id, node, class_id, copies, first) of every row, as of :func:`classes`; ``first`` holds on one id and node of each class."""
    kind = df.schema[id_col].dataType.simpleString()
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    profiles = materialise(map_arrow(source, _profile(bands, rows, words, weighted), f"id {kind}, node binary, bands array<long>, shingles binary"), "profiles")
    nodes = materialise(profiles.groupBy("node").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands")), "nodes")
    bucketed = nodes.select(F.explode("bands").alias("bucket"), "node")
    shared = bucketed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("bucket")
    rows_ = materialise(bucketed.join(shared, "bucket"), "candidates")
    wanted = materialise(rows_.select("node").distinct(), "wanted")
    # copies fold before the shuffle, and what no bucket wants stays out of it
    folded = profiles.select("node", "shingles").where(perhaps_in(wanted, "node")).groupBy("node").agg(F.first("shingles").alias("shingles"))
    sets = materialise(folded.join(wanted, "node", "left_semi"), "sets")
    links, rings = _links(rows_, sets, similarity)
    labels = _rejoin(components(links), rings, sets, similarity)
    labelled = nodes.select("node", "rep", "copies").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    names = labelled.groupBy("label").agg(F.min("rep").alias("class_id"), F.min(F.struct(F.col("rep").isNull(), "rep", "node"))["node"].alias("keeper"))
    named = labelled.join(names, "label").select("node", "class_id", "copies", (F.col("node") == F.col("keeper")).alias("keeps"))
    first = F.col("keeps") & F.col("id").eqNullSafe(F.col("class_id"))
    return profiles.select("id", "node").join(named, "node").select("id", "node", "class_id", "copies", first.alias("first"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", one_row: bool = False, **options) -> DataFrame:
    """The rows of ``df`` that stay when one document of each class stays: the one with the smallest id.

    With ``one_row`` one row of each class stays, also where ids are null or repeat: of the rows with the class's smallest
    id (without any, of those that have none) one of the smallest node. Else rows of one id stay or go together: a class
    without any id keeps the copies of its text that have none, and with them stay all rows without an id; rows that repeat
    both id and text stay once.
    """
    if one_row:
        return _keep_one_row(df, id_col, text_col, **options)
    id_, stays_, rows_, perhaps_ = unused(df, "id", "stays", "rows", "perhaps")
    found = classes(df, id_col, text_col, **options).groupBy(F.col("doc_id").alias(id_))
    verdicts = found.agg(F.max(F.col("doc_id").eqNullSafe(F.col("class_id"))).alias(stays_), F.count(F.lit(1)).alias(rows_))
    # ids that go or repeat; rows of others stay where they are, and only these are shuffled with their texts
    doubtful = materialise(verdicts.where(~F.col(stays_) | (F.col(rows_) > 1)).select(id_, stays_), "doubtful")
    perhaps = perhaps_in(doubtful.withColumnRenamed(id_, id_col), id_col)
    marked = df.withColumn(perhaps_, perhaps)
    judged = marked.where(perhaps_).join(doubtful, F.col(id_col).eqNullSafe(F.col(id_)), "left")
    stay = judged.where(F.coalesce(stays_, F.lit(True))).dropDuplicates([id_col, text_col])
    return marked.where(~F.col(perhaps_)).select(df.columns).union(stay.select(df.columns))


def _keep_one_row(df: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    id_, rows_, perhaps_, key_, node_ = unused(df, "id", "rows", "perhaps", "key", "node")
    found = materialise(_judged(df, id_col, text_col, **options).select(F.col("id").alias(id_), F.col("node").alias(key_), "first"), "judged")
    verdicts = found.groupBy(id_).agg(F.max("first").alias("stays"), F.count(F.lit(1)).alias(rows_))
    # ids that go or repeat; rows of others stay where they are, and only these are shuffled with their texts
    doubtful = materialise(verdicts.where(~F.col("stays") | (F.col(rows_) > 1)).select(id_, "stays", rows_), "doubtful")
    marked = df.withColumn(perhaps_, perhaps_in(doubtful.select(F.col(id_).alias(id_col)), id_col))
    judged = marked.where(perhaps_).join(doubtful.select(id_, rows_), F.col(id_col).eqNullSafe(F.col(id_)), "left").drop(id_)
    sure = marked.where(~F.col(perhaps_)).select(df.columns).union(judged.where(F.col(rows_).isNull()).select(df.columns))
    repeated = doubtful.where(F.col("stays") & (F.col(rows_) > 1))
    if repeated.isEmpty():
        return sure
    # rows of ids that repeat are told apart by their words
    chosen = found.where("first").select(id_, key_).distinct()
    several = judged.where(F.col(rows_) > 1).withColumn(node_, F.pandas_udf(_nodes, "binary")(F.coalesce(text_col, F.lit(""))))
    stay = several.join(chosen, F.col(id_col).eqNullSafe(F.col(id_)) & (F.col(node_) == F.col(key_)), "left_semi")
    return sure.union(stay.dropDuplicates([id_col, node_]).select(df.columns))
