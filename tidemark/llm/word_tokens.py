"""Exact token ids of a word-level BPE file of the ``tokenizers`` library, with a cache of words.

The library normalises a text, cuts it into words and encodes each word by itself, so a word has the
same ids wherever it stands. Texts in plain Latin script are cut here by the same rules and looked up
word by word; only words not met before go through the library's model. Any other text goes through
the library as a whole, so the ids are always the library's.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from struct import pack

import numpy as np

#: What the fast path may hold: ASCII without controls, and Latin letters and signs whose normal form and category are settled.
_ODD = re.compile("[^\\t\\n\\r\\x20-\\x7e¡-įı-ſ]|<\\|")
_RANGE = [chr(c) for c in [*range(0x21, 0x7F), *range(0xA1, 0x180)] if c != 0x130]
_LETTERS = re.escape("".join(c for c in _RANGE if unicodedata.category(c)[0] == "L"))
_NUMBERS = re.escape("".join(c for c in _RANGE if unicodedata.category(c)[0] == "N"))
#: The pre-tokenizer's pattern that the fast path stands for; other files take the slow path only.
_KNOWN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+")


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


class _Known(dict):
    """word -> its ids, as little-endian unsigned 32-bit integers; a word that isn't there is encoded when it is asked for."""

    def __init__(self, model):
        super().__init__()
        self.tokenize, self.letters = model.tokenize, _byte_letters()

    def __missing__(self, word: str) -> bytes:
        letters = self.letters
        ids = [t.id for t in self.tokenize(word if word.isascii() else "".join([letters[b] for b in word.encode()]))]  # visible ASCII stands for itself
        found = self[word] = pack(f"<{len(ids)}I", *ids)
        return found


class WordTokens:
    """Encodes texts, with a cache of the words met."""

    def __init__(self, path: str, cache_words: int = 120_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = _Known(self.tokenizer.model)
        self.cache_words = cache_words
        splits, forms = (json.loads(part.__getstate__()) if part else {} for part in (self.tokenizer.pre_tokenizer, self.tokenizer.normalizer))
        steps = splits.get("pretokenizers") or [{}]
        forms = [n.get("type") for n in forms.get("normalizers", [])]
        self.fast = forms == ["NFC", "Replace", "Lowercase"] and steps[0].get("pattern", {}).get("Regex") == _KNOWN_SPLIT and [s.get("type") for s in steps] == ["Split", "ByteLevel"]

    def encode(self, text: str) -> bytes:
        """All ids of a text, packed."""
        if not self.fast or _ODD.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self.known) > self.cache_words:
            self.known.clear()
        return b"".join(map(self.known.__getitem__, _SPLIT.findall(text.lower())))


_loaded: dict[str, WordTokens] = {}


def load(path: str) -> WordTokens:
    """One per worker process and file."""
    if path not in _loaded:
        _loaded[path] = WordTokens(path)
    return _loaded[path]


def unload() -> None:
    _loaded.clear()
