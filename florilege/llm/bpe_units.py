"""Byte-level BPE ids of whole texts through a cache of blank-separated units.

The vocabulary's pattern never lets a token span the border between a word and
a following single blank, so the ids of a text are those of its units, each with
its leading blank. Where blanks are next to other white space, or a special
token's string occurs, the whole text goes through the library at once.
"""

from __future__ import annotations

import array
import json

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_chars() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: char -> byte."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class UnitEncoder:
    """encode(text) -> little-endian uint32 ids as bytes, equal to the tokenizers library's ids."""

    LIMIT = 500_000  # units kept by a worker

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = _byte_chars()
        ranks = {bytes(chars[c] for c in token): i for token, i in spec["model"]["vocab"].items() }
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        for t in self.special:
            ranks.pop(t.encode(), None)
        self.latin = tiktoken.Encoding("units", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.first: dict[str, bytes | None] = {}
        self.later: dict[str, bytes | None] = {}
        self.library = None

    def whole(self, text: str) -> bytes:
        """Ids of any text: special tokens' strings, and what lies beyond Latin letters, where versions of Unicode differ, go through the tokenizers library."""
        if (text.isascii() or max(text) <= "\u024f") and not any(t in text for t in self.special):
            return array.array("I", self.latin(text)).tobytes()
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        return array.array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _unit(self, unit: str, cache: dict, blank: str) -> bytes | None:
        if len(cache) >= self.LIMIT:
            cache.clear()
        safe = unit and not unit[0].isspace() and not unit[-1].isspace() and not any(t in unit for t in self.special)
        out = cache[unit] = self.whole(blank + unit) if safe else None
        return out

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        head, *units = text.split(" ")
        later, missing = self.later, object()
        got = self.first.get(head, missing)
        if got is missing:
            got = self._unit(head, self.first, "")
        out = [got]
        for u in units:
            got = later.get(u, missing)
            if got is missing:
                got = self._unit(u, later, " ")
            out.append(got)
        return self.whole(text) if None in out else b"".join(out)
