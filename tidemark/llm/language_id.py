"""Language identification with hyperdimensional profiles.

Method: every letter has a fixed random vector of +1 and -1. An n-gram's vector binds (multiplies) the
vectors of its letters, each permuted (rotated) by its place; a text's vector bundles (adds) those of
all its n-grams; a language's prototype bundles the unit vectors of its sample texts. A text gets the
language whose prototype has the largest cosine with it.

The prototypes are fitted on a sample of labelled rows whose size is bounded by ``sample_rows``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import bounded_batches, frees

DIMENSIONS = 1024
NGRAM = 3
GRAMS = 4096
UNDETERMINED = "und"
_SEED = 0x7469646D
_vectors: dict[int, np.ndarray] = {}


def letter_vector(code: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The random vector of a code point (0: a word boundary); the same on every machine."""
    if code not in _vectors or len(_vectors[code]) != dimensions:
        if len(_vectors) > 20_000:
            _vectors.clear()
        bits = np.random.Philox(key=[_SEED, code]).random_raw(-(-dimensions // 64))
        _vectors[code] = np.unpackbits(bits.view(np.uint8))[:dimensions].astype(np.int8) * 2 - 1
    return _vectors[code]


def _forget() -> None:
    _vectors.clear()


_letter_of = np.zeros(0, np.uint32)


def _letter_table() -> np.ndarray:
    """Code point -> itself if it is a letter, else 0."""
    global _letter_of
    if not len(_letter_of):
        table = np.arange(0x110000, dtype=np.uint32)
        table[[i for i in range(0x110000) if not chr(i).isalpha()]] = 0
        _letter_of = table
    return _letter_of


def letters(text: str) -> np.ndarray:
    """Code points of the lower-case letters, other runs as one 0, with a 0 at both ends; empty without letters."""
    codes = _letter_table()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    codes = np.concatenate([[0], codes, [0]]).astype(np.uint32)
    keep = np.append(True, (codes[1:] != 0) | (codes[:-1] != 0))
    codes = codes[keep]
    return codes if len(codes) >= NGRAM else codes[:0]


def bundle(texts: list[np.ndarray], dimensions: int = DIMENSIONS) -> np.ndarray:
    """The bundled vector of each text's n-grams, one row each; texts as of :func:`letters`, none empty."""
    codes = np.concatenate(texts).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    whole = owner[2:] == owner[:-2]
    code = (codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:])[whole]
    order = np.argsort(code)
    code, whose = code[order], owner[2:][whole][order]
    new = np.diff(code, prepend=-1) != 0
    grams, at = code[new], np.cumsum(new) - 1
    known, place = np.unique(np.stack([grams >> 42, grams >> 21 & 0x1FFFFF, grams & 0x1FFFFF]), return_inverse=True)
    table = np.stack([letter_vector(int(c), dimensions) for c in known])
    out = np.zeros((len(texts), dimensions), np.float32)
    place = place.reshape(3, -1)
    rolled = [np.roll(table, NGRAM - 1 - k, axis=1) for k in range(NGRAM)]
    for a in range(0, len(grams), GRAMS):  # so many at a time: what is held doesn't depend on how many there are
        part = slice(a, a + GRAMS)
        here = slice(*np.searchsorted(at, [a, a + GRAMS]))
        counts = np.bincount(whose[here] * GRAMS + at[here] - a, minlength=len(texts) * GRAMS).reshape(len(texts), GRAMS)[:, : len(grams) - a].astype(np.float32)
        bound = rolled[0][place[0][part]] * rolled[1][place[1][part]] * rolled[2][place[2][part]]
        out += counts @ bound.astype(np.float32)
    return out


def groups(texts: list[str | None], most: int = 1 << 19) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Positions and letters of the texts that have any, in runs of bounded size."""
    at, run, size = [], [], 0
    for i, text in enumerate(texts):
        codes = letters(text) if isinstance(text, str) else ()
        if len(codes):
            at.append(i)
            run.append(codes)
            size += len(codes)
            if size >= most or len(run) >= 256:
                yield at, run
                at, run, size = [], [], 0
    if run:
        yield at, run


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)


def fit(df: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", sample_rows: int = 8192, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Prototypes of the languages in ``label_col``, as unit vectors.

    Rows with a null label, a null text or no letter teach nothing. ``sample_rows`` rows on average are
    drawn by a hash of id, text and label, so a run can be repeated; rows that are equal in these are drawn
    as one. Only one sum for each language and dimension comes to the driver. No labelled row: no prototype.
    """
    labelled = df.where(F.col(text_col).isNotNull() & F.col(label_col).isNotNull())
    total = labelled.count()
    sample = labelled.select(F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("lang"), F.xxhash64(id_col, text_col, label_col).alias("drawn"))
    if total > sample_rows:
        sample = sample.where(F.col("drawn") < int((sample_rows / total - 0.5) * 2**64)).dropDuplicates(["drawn"])

    @frees(_forget)
    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for pdf in batches:
            langs = pdf["lang"].tolist()
            for at, run in groups(pdf["text"].tolist()):
                for i, v in zip(at, unit(bundle(run, dimensions)), strict=True):
                    total[langs[i]] = total.get(langs[i], 0) + np.rint(v * (1 << 20)).astype(np.int64)
        for lang, v in total.items():
            yield pd.DataFrame({"lang": lang, "k": np.arange(dimensions), "v": v})

    bounded_batches(df.sparkSession)
    rows = sample.select("text", "lang").mapInPandas(sums, "lang string, k int, v long").groupBy("lang", "k").agg(F.sum("v").alias("v")).collect()
    found: dict[str, np.ndarray] = {}
    for r in rows:
        found.setdefault(r["lang"], np.zeros(dimensions))[r["k"]] = r["v"]
    return {lang: found[lang] / max(np.linalg.norm(found[lang]), 1e-9) for lang in sorted(found)}


def predict(text: Column, prototypes: dict[str, np.ndarray], spark=None) -> Column:
    """A struct (lang_pred, score) for each text.

    ``score`` is the cosine with the winning prototype, 0 to 1; ties go to the first language by name.
    A null text and one without a letter are ``und`` with score 0, and so is any text if there is no
    prototype. Texts count whole, whatever their length; rows don't depend on one another.
    """
    names = list(prototypes)
    table = np.stack([prototypes[n] for n in names]).astype(np.float32) if names else None
    if spark is not None:
        bounded_batches(spark)

    @frees(_forget)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in parts:
            lang, score = np.full(len(series), UNDETERMINED, object), np.zeros(len(series))
            for at, group in groups(series.tolist()) if names else ():
                cosine = (unit(bundle(group, table.shape[1])) @ table.T).round(6)
                best = cosine.argmax(1)
                lang[at] = [names[b] for b in best]
                score[at] = np.clip(cosine.max(1), 0, 1)
            yield pd.DataFrame({"lang_pred": lang, "score": score})

    return F.pandas_udf(run, "lang_pred string, score double").asNondeterministic()(text)  # else a filter on it would run it twice
