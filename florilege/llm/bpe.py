"""BPE encoding and decoding with forced-boundary splitting.

Every token is a string of byte symbols. A pair of neighbouring symbols that
occurs inside no token of the vocabulary can never be merged across, so a cut
there is certain: the fragments on both sides are encoded alone and their ids
concatenated. Fragments repeat far more than words do, so their ids are cached.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_units import _byte_chars


class ForcedBoundaryBPE:
    """Encoder and decoder of a word-end BPE vocabulary file; ids equal the tokenizers library's."""

    UNITS, PIECES, FRAGMENTS = 400_000, 300_000, 50_000  # kept by a worker

    def __init__(self, path: str):
        import re

        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocab = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.byte_char = {b: c for c, b in _byte_chars().items()}
        self.inside, self.last = set(), set()
        for token in self.vocab:
            ended = bool(self.end) and token.endswith(self.end)
            body = token[: -len(self.end)] if ended else token
            neighbours = list(zip(body, body[1:], strict=False))
            self.last.update(neighbours[-1:] if ended else ())
            self.inside.update(neighbours[:-1] if ended else neighbours)
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.added = added
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in added.items()}
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        library = Tokenizer.from_file(path)
        self.normalise, self.split_any = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.odd = re.compile("[\x1c-\x1f]")
        self.units: dict[str, tuple[int, str, str]] = {}
        self.pieces: dict[str, tuple[int, str, str]] = {}
        self.fragments: dict[tuple[str, bool], list[int]] = {}

    def fragments_of(self, word: str) -> list[tuple[str, bool]]:
        """Cut a word of byte symbols at every certain boundary: (fragment, whether it ends the word)."""
        out, start, n = [], 0, len(word)
        for i in range(1, n):
            if (word[i - 1], word[i]) not in (self.last if i == n - 1 else self.inside):
                out.append((word[start:i], False))
                start = i
        return [*out, (word[start:], True)]

    def encode_fragment(self, fragment: str, ends: bool) -> list[int]:
        got = self.fragments.get((fragment, ends))
        if got is not None:
            return got
        parts = list(fragment)
        if ends:
            parts[-1] += self.end
        parts = self._merged(parts)
        ids = [self.vocab[p] for p in parts if p in self.vocab]
        if len(self.fragments) >= self.FRAGMENTS:
            self.fragments.clear()
        if len(fragment) <= 64:
            self.fragments[fragment, ends] = ids
        return ids

    def _merged(self, parts: list[str]) -> list[str]:
        """Apply the merges in order of rank, the leftmost first: a heap over a linked list, so long fragments stay cheap."""
        ranks, n = self.ranks, len(parts)
        if n <= 24:
            # Words are short: look for the best pair again after each merge.
            get, none = ranks.get, len(ranks)
            while len(parts) > 1:
                best, at, a = none, 0, parts[0]
                for i, b in enumerate(parts[1:]):
                    if (r := get((a, b), none)) < best:
                        best, at = r, i
                    a = b
                if best == none:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            return parts
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, ""
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y >= 0 and (r := ranks.get((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [p for p in parts if p]

    def encode_segment(self, text: str) -> list[int]:
        """Ids of a text without special tokens' strings."""
        ids: list[int] = []
        text = self.normalise(text)
        # Beyond Latin letters, libraries differ in the version of Unicode that they know.
        simple = text.isascii() or max(text) <= "\u024f"
        for piece in ["".join([self.byte_char[b] for b in p.encode()]) for p in self.split(text)] if simple else [p for p, _ in self.split_any(text)]:
            for fragment, ends in self.fragments_of(piece):
                ids += self.encode_fragment(fragment, ends)
        return ids

    def _piece(self, piece: str) -> tuple[int, str, str]:
        """A normalised piece's ids: how many, joined, and their tokens joined. Case and punctuation around a word share its entry."""
        got = self.pieces.get(piece)
        if got is None:
            word = piece if piece.isascii() else "".join([self.byte_char[x] for x in piece.encode()])
            ids = [i for fragment, ends in self.fragments_of(word) for i in self.encode_fragment(fragment, ends)]
            got = len(ids), " ".join(map(str, ids)), " ".join([self.token[i] for i in ids])
            if len(self.pieces) >= self.PIECES:
                self.pieces.clear()
            if len(piece) <= 256:
                self.pieces[piece] = got
        return got

    def _unit(self, unit: str) -> tuple[int, str, str]:
        if not (unit.isascii() or max(unit) <= "\u024f"):
            ids = self.encode_segment(unit)
            found = [(len(ids), " ".join(map(str, ids)), " ".join([self.token[i] for i in ids]))]
        else:
            low = unit.lower() if unit.isascii() else self.normalise(unit)
            if low.isalpha():
                found = [self._piece(low)]
            elif low[:-1].isalpha() and low[-1] in ",.;:!?":
                found = [self._piece(low[:-1]), self._piece(low[-1])]
            else:
                found = [self._piece(p) for p in self.split(low)]
        got = found[0] if len(found) == 1 else (sum(x[0] for x in found), " ".join([x[1] for x in found if x[0]]), " ".join([x[2] for x in found if x[0]]))
        if len(self.units) >= self.UNITS:
            self.units.clear()
        if len(unit) <= 256:
            self.units[unit] = got
        return got

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for part in self.special.split(text) if self.special else [text]:
            ids += [self.added[part]] if part in self.added else self.encode_segment(part)
        return ids

    def decode(self, ids: list[int]) -> str:
        """As a tokenizer without a decoder does: the tokens, joined by blanks."""
        return " ".join([self.token[i] for i in ids if i in self.token])

    def summary(self, text: str) -> tuple[int, str, str]:
        """(number of ids, decimal ids joined by blanks, decoded text), through the cache of white-space separated units."""
        if "<|" in text and self.special and self.special.search(text) or self.odd.search(text):
            ids = self.encode(text)
            return len(ids), " ".join(map(str, ids)), self.decode(ids)
        units, n, a, b = self.units, 0, [], []
        for u in text.split():
            got = units.get(u)
            if got is None:
                got = self._unit(u)
            if got[0]:
                n += got[0]
                a.append(got[1])
                b.append(got[2])
        return n, " ".join(a), " ".join(b)


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", outputs: str = "texts") -> DataFrame:
    """Encode every text and decode its ids again.

    outputs "texts": doc_id, n_tokens, ids array<int>, decoded string; "digests": the
    sha256 of the decimal ids and of the decoded text. A null text counts as empty
    and gives no ids; repeated rows give repeated rows.
    """

    def run(batches):
        bpe = ForcedBoundaryBPE(vocabulary)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            found = [bpe.summary(t or "") if outputs == "digests" else bpe.encode(t or "") for t in batch.column(1).to_pylist()]
            if outputs == "digests":
                cols = {"n_tokens": pa.array([x[0] for x in found], pa.int64()), "ids_sha256": [sha(x[1]) for x in found], "decoded_sha256": [sha(x[2]) for x in found]}
            else:
                cols = {"n_tokens": pa.array([len(x) for x in found], pa.int64()), "ids": pa.array(found, pa.list_(pa.int32())), "decoded": [bpe.decode(x) for x in found]}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).cast(pa.int64()), **{k: v if isinstance(v, pa.Array) else pa.array(v, pa.string()) for k, v in cols.items()}})

    schema = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if outputs == "digests" else "ids array<int>, decoded string")
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, schema)
