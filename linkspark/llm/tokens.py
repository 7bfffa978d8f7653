"""Exact ids of the word-BPE tokenizer, with each pre-token encoded once per worker."""

from __future__ import annotations

import re
import unicodedata
from struct import pack

from linkspark.llm.caches import WordCache

#: Letters of the range U+0000 to U+017F after lower-casing; its other
#: characters are digits, white space or symbols (fixed values).
_L = "a-zªµºß-öø-ÿĀ-ſ"
_N = "0-9²³¹¼½¾"
_PRE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\s{_L}{_N}]+")
#: Anything whose case mapping, white-space class or letter class could differ
#: between regex engines goes to the tokenizer itself.
_PLAIN = re.compile("[\t\n\r\x20-~\xa1-įı-ž–—‘’“”…€]*")


class WordBpe:
    """Ids of a lower-casing word-BPE tokenizer file, as little-endian uint32 bytes."""

    _open: dict[str, WordBpe] = {}

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache = WordCache(self._encode, most=600_000)

    @classmethod
    def of(cls, path: str) -> WordBpe:
        """One instance per file and worker process."""
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def _encode(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return pack(f"<{len(ids)}I", *ids)

    def ids(self, text: str) -> bytes:
        """Ids of the whole text; equal to the tokenizer's own for every input."""
        if not text:
            return b""
        if not _PLAIN.fullmatch(text) or any(s in text for s in self.special) or not unicodedata.is_normalized("NFC", text):
            return self._encode(text)
        return b"".join(map(self.cache.__getitem__, _PRE.findall(text.lower())))
