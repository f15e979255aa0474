"""Secret scan: fixed patterns, and strings that a tiktoken vocabulary can't compress.

Method: text that people write takes few tokens for its length, random strings take many. A run of key
characters is a secret when it has few characters per token. Known digests (hexadecimal strings of a
usual digest's length) and UUIDs are cut out before, and what is left on either side is tested by itself.
Identifiers whose parts are all plain, that is words with many characters per token or numbers, are
excluded. Where a run as a whole is readable, the parts that aren't plain are tested without the others.
The fixed patterns' spans always stay.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.llm._common import bounded_batches, frees

# The patterns of the contract.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")

LEAST_CHARS = 20
SEPARATORS = "+/_=-"
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
PART = re.compile("[A-Za-z0-9]+")
#: A short number at a word's end.
NUMBERED = re.compile(r"(?<=[a-z])\d{1,4}\Z")
UUID = re.compile(r"(?i)[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}")
HEXADECIMAL = re.compile("[0-9a-fA-F]+")
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
WORDS = ("passw", "secret", "token", "api")
MAX_CHARS_PER_TOKEN = 2.2


def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("secret_scan", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and non-overlapping within a kind."""
    spans = []
    lower = text.lower()
    if any(w in lower for w in WORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def is_plain(part: str, encoding, ratio: float) -> bool:
    """Words, as far as the vocabulary knows them, with a short number behind them or none; and plain numbers."""
    if part.isdigit():
        return True
    word = NUMBERED.sub("", part)
    tokens = len(encoding.encode_ordinary(word))
    return word.isalpha() and (tokens == 1 or len(word) >= ratio * tokens)


def stretches(text: str, start: int, end: int, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """What fixed patterns, UUIDs and known digests leave of a run, without the separator beside them."""
    cuts = [(s, e) for s, _, e in taken if s < end and start < e]
    cuts += [m.span() for m in UUID.finditer(text, start, end)]
    cuts += [m.span() for m in PART.finditer(text, start, end) if len(m[0]) in DIGEST_LENGTHS and HEXADECIMAL.fullmatch(m[0])]
    found, at = [], start
    for s, e in [*sorted(cuts), (end, end)]:
        a = at + (at > start and at < end and text[at] in SEPARATORS)
        b = s - (s < end and s > a and text[s - 1] in SEPARATORS)
        if b - a >= LEAST_CHARS:
            found.append((a, b))
        at = max(at, e)
    return found


def unreadable(run: str, encoding, ratio: float) -> list[tuple[int, int]]:
    """(start, end) of what has few characters per token: the whole run, or else its parts that aren't plain.

    Neighbours among these parts are taken together, with what lies between them, as long as they stay under the ratio.
    """
    parts = [m.span() for m in PART.finditer(run)]
    odd = [i for i, (s, e) in enumerate(parts) if not is_plain(run[s:e], encoding, ratio)]
    if not odd:
        return []
    tokens = encoding.encode_ordinary(run)
    if len(run) < ratio * len(tokens):
        return [(0, len(run))]
    starts = np.cumsum([0] + [len(encoding.decode_single_token_bytes(t)) for t in tokens])  # no token crosses a part's edge

    def low(first: int, last: int) -> bool:
        s, e = parts[first][0], parts[last][1]
        return e - s < ratio * (np.searchsorted(starts, e) - np.searchsorted(starts, s))

    groups: list[tuple[int, int]] = []
    for i in odd:
        groups.append((i, i))
        while len(groups) > 1 and low(groups[-2][0], groups[-1][1]):
            groups[-2:] = [(groups[-2][0], groups[-1][1])]
    found = []
    for first, last in groups:
        # separators at the ends may belong to a key, but for the one beside a readable part
        s = parts[first - 1][1] + 1 if first else 0
        e = parts[last + 1][0] - 1 if last + 1 < len(parts) else len(run)
        if e - s >= LEAST_CHARS and low(first, last):
            found.append((s, e))
    return found


def random_spans(text: str, encoding, taken: list[tuple[int, int, int]], ratio: float = MAX_CHARS_PER_TOKEN) -> list[tuple[int, int, int]]:
    """Runs, and parts of runs, with few characters per token that no fixed pattern covers."""
    spans = []
    for m in RUN.finditer(text):
        for a, b in stretches(text, m.start(), m.end(), taken):
            spans += [(a + s, 3, a + e) for s, e in unreadable(text[a:b], encoding, ratio)]
    return spans


def render(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """The text with every span replaced; overlapping spans are replaced as one."""
    out, at, upto = [], 0, -1
    for s, _, e in sorted(spans):
        if s > upto:
            if upto >= 0:
                at = upto
            out += [text[at:s], mark]
            upto = e
        upto = max(upto, e)
    return "".join(out) + text[max(upto, 0) :] if spans else text


def scan(text: Column, vocabulary: str, pattern: str, ratio: float = MAX_CHARS_PER_TOKEN, mark: str = "[SECRET]", spark=None) -> Column:
    """A struct for each text: n_assign, n_access, n_hex, n_random, base_sha256, spans, redacted.

    ``vocabulary`` is the path of a tiktoken file and ``pattern`` its split pattern. Spans count code
    points, the end excluded. A null text is scanned as an empty one (no spans) and its ``redacted``
    stays null. Texts are scanned whole, whatever their length; rows don't depend on one another, so
    repeated rows get the same result. ``redacted`` is null where nothing was found: the text stands.
    """
    if spark is not None:
        bounded_batches(spark)

    @frees()
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoding = _encoding(vocabulary, pattern)
        for texts in parts:
            rows = []
            for value in texts:
                t = value or ""
                base = base_spans(t)
                every = sorted(base + random_spans(t, encoding, base, ratio))
                counts = [0, 0, 0, 0]
                for _, k, _ in every:
                    counts[k] += 1
                rows.append((*counts, hashlib.sha256(render(base).encode()).hexdigest(), render(every), redact(t, every, mark) if every else None))
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans", "redacted"])

    kind = "n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string, redacted string"
    return F.pandas_udf(run, kind)(text)
