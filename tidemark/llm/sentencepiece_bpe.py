"""SentencePiece BPE encoding by vectorised merge rounds, and decoding by gathers.

Method: words are laid out as flat numpy arrays of symbols. In a round every word finds the best rank
among its adjacent pairs (a segmented minimum), all words merge their leftmost pairs of that rank at
once, and the arrays are compacted; words without a pair left go out. It ends when no word is left.

The library always merges the best pair of the whole text, leftmost first. Words don't influence one
another because no piece holds a space after another character, so words can take their rounds
side by side. Within a word, several pairs of the best rank merge in one round only if no piece that
contains the merged one is better or as good; otherwise one pair is merged in that round. The result
is the library's, symbol for symbol.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import frees, map_arrow, slices

NONE = np.int64(1) << np.int64(40)
SPACE = "▁"
_WORDS = re.compile(f"{SPACE}*[^{SPACE}\n]+|\n|{SPACE}+")
#: Also cuts between a letter and a full stop or comma, for vocabularies without a piece that holds such a pair.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_FINER = re.compile(f"{SPACE}*[{_LETTERS}]++(?=[{SPACE}.,\n]|\\Z)|{SPACE}*[^{SPACE}\n]+|\n|{SPACE}+")
_JOINED = re.compile(f"[{_LETTERS}][.,]")


class PairTable:
    """(left, right) symbols -> position in a sorted table, by open addressing over numpy arrays."""

    def __init__(self, keys: np.ndarray):
        self.shift = np.uint64(64 - max(4, int(len(keys) * 4).bit_length()))
        size = 1 << int(np.uint64(64) - self.shift)
        self.keys = np.full(size, -1, np.int64)
        self.values = np.full(size, -1, np.int64)
        self.mask = size - 1
        left = np.arange(len(keys))
        slot = self._slot(keys)
        self.probes = 0
        while len(left):
            self.probes += 1
            free = self.keys[slot] == -1
            first = np.unique(slot[free], return_index=True)[1]
            take = np.flatnonzero(free)[first]
            self.keys[slot[take]] = keys[left[take]]
            self.values[slot[take]] = left[take]
            stay = np.ones(len(left), bool)
            stay[take] = False
            left, slot = left[stay], (slot[stay] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Positions of the keys, -1 for absent ones."""
        slot = self._slot(keys)
        there = self.keys[slot]
        found = np.where(there == keys, self.values[slot], -1)
        open_ = np.flatnonzero((there != keys) & (there != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            there = self.keys[slot[open_]]
            hit = there == keys[open_]
            found[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (there != -1)]
        return found


class Encoder:
    """The vocabulary of one model file as arrays, with a cache of words met."""

    def __init__(self, path: str, cache_words: int = 300_000):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as messages

        model = messages.ModelProto()
        self.library = SentencePieceProcessor(model_file=path)
        model.ParseFromString(self.library.serialized_model_proto())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not (spec.add_dummy_prefix and spec.escape_whitespaces and model.trainer_spec.byte_fallback):
            raise ValueError("only BPE models with byte fallback, a dummy prefix and no normalisation are supported")
        pieces = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
        if any(p.type in (4, 5) for p in model.pieces) or any(SPACE in p.lstrip(SPACE) or "\n" in p and len(p) > 1 for p in pieces):
            raise ValueError("pieces that are user-defined or span words are not supported")
        self.cut = _WORDS if any(map(_JOINED.search, pieces)) else _FINER
        score = {p: model.pieces[i].score for p, i in pieces.items()}
        order = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.size = len(model.pieces)
        self.single = {p: i for p, i in pieces.items() if len(p) == 1}
        #: A symbol of a merge is a piece; characters without a piece can't merge, so a pair's halves are pieces.
        halves = [(pieces[p[:k]], pieces[p[k:]], i, order[score[p]]) for p, i in pieces.items() for k in range(1, len(p)) if p[:k] in pieces and p[k:] in pieces]
        table = np.array(halves, np.int64).reshape(-1, 4)
        self.pairs = PairTable(table[:, 0] << 32 | table[:, 1])
        self.merged, self.rank = np.append(table[:, 2], -1), np.append(table[:, 3], NONE)
        best = np.full(self.size, NONE)
        for column in (0, 1):  # the best rank of a pair that a piece takes part in
            np.minimum.at(best, table[:, column], table[:, 3])
        own = np.full(len(order) + 1, NONE)
        for p, i in pieces.items():
            own[order[score[p]]] = min(own[order[score[p]]], best[i])
        self.one_by_one = own <= np.arange(len(own))
        self.byte = np.array([self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        self.end = self.library.eos_id()
        self.known: dict[str, bytes] = {}
        self.cache_words = cache_words
        self._letters: dict[str, int] = dict(self.single)
        raw = [b""] * self.size
        for i, p in enumerate(model.pieces):
            raw[i] = {1: lambda p=p: p.piece.replace(SPACE, " ").encode(), 6: lambda p=p: bytes([int(p.piece[3:5], 16)]), 2: lambda: " ⁇ ".encode()}.get(p.type, lambda: b"")()
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_length = np.array([len(r) for r in raw], np.int64)
        self.raw_start = np.cumsum(self.raw_length) - self.raw_length

    def merge_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word (not empty), packed as little-endian 32-bit integers."""
        letters = self._letters
        text = "".join(words)
        for c in set(text) - letters.keys():
            letters[c] = -1 - ord(c)
        symbol = np.fromiter(map(letters.__getitem__, text), np.int64, len(text))
        word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        found = self._look_up(symbol, word, np.arange(len(symbol)))
        out_symbol, out_word = [], []
        while len(symbol):
            first = np.flatnonzero(np.diff(word, prepend=-1))
            rank = self.rank[found]
            best = np.minimum.reduceat(rank, first)
            count = np.diff(first, append=len(word))
            if (done := best == NONE).any():
                gone = np.repeat(done, count)
                out_symbol.append(symbol[gone])
                out_word.append(word[gone])
                symbol, word, found, rank, best, count = symbol[~gone], word[~gone], found[~gone], rank[~gone], best[~done], count[~done]
                if not len(symbol):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, count))
            if len(hit) > len(best):  # several in some word
                w = word[hit]
                start = np.diff(w, prepend=-1) != 0
                # in a run of overlapping pairs every second one merges, from the left
                new_run = start | (np.diff(hit, prepend=-9) != 1)
                run_at = np.maximum.accumulate(np.where(new_run, np.arange(len(hit)), 0))
                keep = (np.arange(len(hit)) - run_at) % 2 == 0
                keep &= start | ~self.one_by_one[rank[hit]]
                hit = hit[keep]
            symbol[hit] = self.merged[found[hit]]
            stay = np.ones(len(symbol), bool)
            stay[hit + 1] = False
            at = hit - np.arange(len(hit))  # where the merged symbols are after compaction
            symbol, word, found = symbol[stay], word[stay], found[stay]
            touched = np.zeros(len(symbol), bool)
            touched[at] = touched[np.maximum(at - 1, 0)] = True
            again = np.flatnonzero(touched)
            found[again] = self._look_up(symbol, word, again)
        symbol, word = np.concatenate([*out_symbol, symbol]), np.concatenate([*out_word, word])
        order = np.argsort(word, kind="stable")
        symbol, word = symbol[order], word[order]
        if (symbol < 0).any():
            parts = [[s] if s >= 0 else self.byte[list(chr(-1 - s).encode("utf-8", "surrogatepass"))].tolist() for s in symbol.tolist()]
            word = np.repeat(word, [len(p) for p in parts])
            symbol = np.array([i for p in parts for i in p])
        packed = symbol.astype("<i4").tobytes()
        ends = (4 * np.cumsum(np.bincount(word, minlength=len(words)))).tolist()
        return [packed[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _look_up(self, symbol: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """For positions: the pair that begins there, as a place in the merge table (-1: none)."""
        found = np.full(len(at), -1)
        inner = at < len(symbol) - 1
        a = at[inner]
        left, right = symbol[a], symbol[a + 1]
        ok = (word[a] == word[a + 1]) & (left >= 0) & (right >= 0)
        key = left << 32 | right
        found[inner] = np.where(ok, self.pairs.find(np.where(ok, key, 0)), -1)
        return found

    def encode_batch(self, texts: list[str], end: bool = True) -> list[bytes]:
        """The ids of each text, packed as little-endian 32-bit integers."""
        last = np.array([self.end], "<i4").tobytes() if end else b""
        cut = [self.cut.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        fresh = list(set().union(*cut) - self.known.keys())
        if len(self.known) + len(fresh) > self.cache_words:
            self.known.clear()
            fresh = list(set().union(*cut))
        if fresh:
            self.known.update(zip(fresh, self.merge_words(fresh), strict=True))
        return [b"".join(map(self.known.__getitem__, words)) + last for words in cut]

    def decode(self, ids: np.ndarray) -> str:
        """What the library's decode returns: pieces joined, the dummy space at the start gone."""
        length = self.raw_length[ids]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        raw = self.raw[np.repeat(self.raw_start[ids] - ends + length, length) + np.arange(total)].tobytes()
        text = raw.decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


_loaded: dict[str, Encoder] = {}


def load(path: str) -> Encoder:
    """One per worker process and file."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def unload() -> None:
    _loaded.clear()


@frees(unload)
def _encode(batches: Iterator[pa.RecordBatch], path: str, end: bool) -> Iterator[pa.RecordBatch]:
    encoder = load(path)
    for batch in slices(batches, 1, 2 << 20):
        packed = encoder.encode_batch([t or "" for t in batch.column(1).to_pylist()], end)
        offsets = np.cumsum([0, *(len(p) // 4 for p in packed)]).astype("<i4")
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), "<i4")))
        yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])


def encode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", end: bool = True) -> DataFrame:
    """One row per row: doc_id, ids (array of int, with the end id if ``end``).

    A null text is encoded as an empty one: the end id alone. Texts are encoded whole whatever their
    length. Rows don't depend on one another: repeated rows and ids (null ones too) give repeated
    results, an empty table gives none.
    """
    kind = df.schema[id_col].dataType.simpleString()
    source = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(source, partial(_encode, path=model_path, end=end), f"doc_id {kind}, ids array<int>")


@frees(unload)
def _round_trip(batches: Iterator[pa.RecordBatch], path: str, end: bool) -> Iterator[pa.RecordBatch]:
    encoder = load(path)
    for batch in _encode(batches, path, end):
        flat, offsets = batch.column(1).values.to_numpy(), batch.column(1).offsets.to_pylist()
        texts = [encoder.decode(flat[a:b]) for a, b in zip(offsets, offsets[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])


def round_trip(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", end: bool = True) -> DataFrame:
    """:func:`encode` with the text decoded from the ids beside them, in one pass: doc_id, ids, decoded."""
    kind = df.schema[id_col].dataType.simpleString()
    source = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(source, partial(_round_trip, path=model_path, end=end), f"doc_id {kind}, ids array<int>, decoded string")


@frees(unload)
def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encoder = load(path)
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            texts = [encoder.decode(x.values.to_numpy()) if x.is_valid else None for x in part.column(1)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids and the decoded text for rows (doc_id, ids). Control ids have no text; null ids give a null text."""
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return map_arrow(encoded.select("doc_id", "ids"), partial(_decode, path=model_path), f"doc_id {kind}, ids array<int>, decoded string")
