"""Removal of repeated byte strings by a hash-compared suffix sort.

Every byte that lies in a string of LENGTH bytes which also starts in a document
with a smaller id is removed. Two exchanges between shards of documents and
ranges of hashed keys bring together what has to be sorted:

1. Minimisers. Each window (string of LENGTH bytes) has the smallest scrambled hash
   of its GRAM-byte strings as its key; equal windows have equal keys. Only keys that
   several documents have can hold repeats.
2. Segments. Runs of windows with one such key go, once for each distinct text, to
   the key's range with the smallest id that has them. There all suffixes of the
   key's segments are sorted: within equal first eight bytes by mergesort, whose
   comparisons find the common extension of two suffixes by binary search over
   prefix polynomial hashes. Runs of suffixes that share LENGTH bytes, verified byte
   by byte, are equal windows; all but those of the smallest id are repeats.

Hashes only choose what is compared: no byte goes without its string having been
found, byte for byte, in a document with a smaller id. Nothing is compared pair by
pair within a group, and a key's frequency does not matter: a shard sends each
distinct key or segment once. Where a key has very many different runs (at the edges
of a passage that many documents share), its windows go one by one to the ranges of
their own hashes, so that no task has to sort them all.
"""

from __future__ import annotations

import hashlib
from array import array
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import materialise
from .exchange import NO_ID, SHARD_BYTES, answer, ask, blobs, cut_points, finish, packed, ranges_for, shard_table, unpacked, unpacked_keys

LENGTH, GRAM, MOST = 50, 32, 64
SORTED = 50_000  # windows sorted at once, or one key's
HOT = 2_000  # different runs of a key, from which on its windows go alone
SUB = 4  # sub-ranges of a key range's segments, unpacked one at a time
KEY, SEGMENT, STATE = range(3)
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(50).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)


def gram_hashes(buf: np.ndarray) -> np.ndarray:
    """Scrambled hashes of the GRAM-byte strings that start at each place, by doubling."""
    h, b, n = _BYTES[buf], _BASE, 1
    while n < GRAM:
        h = h[:-n] * b + h[n:]
        b, n = _U(int(b) ** 2 & 0xFFFFFFFFFFFFFFFF), 2 * n
    h ^= h >> _U(31)
    h *= _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(29))


def scrambled(keys: np.ndarray) -> np.ndarray:
    """Minima spread evenly over all 64 bits, one to one: key ranges are of one width, and minima lie low."""
    keys = keys * _U(0x9FB21C651E98DF25)
    return keys ^ (keys >> _U(32))


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each `width` neighbours, by doubling."""
    n = 1
    while 2 * n <= width:
        h = np.minimum(h[:-n], h[n:])
        n *= 2
    return h if n == width else np.minimum(h[: len(h) - (width - n)], h[width - n :])


class _Runs:
    """A shard's windows, as runs of neighbours with one minimiser: first window, key, document, length, and a hash of the run's two ends."""

    def __init__(self, ids: np.ndarray, texts: list[bytes]):
        self.ids, self.texts = ids, texts
        at, keys, of, n, ends = [], [], [], [], []
        for i, text in enumerate(texts):
            if len(text) < LENGTH:
                continue
            h = gram_hashes(np.frombuffer(text, np.uint8))
            k = window_minima(h, LENGTH - GRAM + 1)
            first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            keys.append(scrambled(k[first]))
            at.append(first)
            n.append(np.diff(first, append=len(k)))
            of.append(np.full(len(first), i, np.int64))
            ends.append(h[first] * _BASE ^ h[first + n[-1] - 1 + LENGTH - GRAM])
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.at, self.keys, self.of, self.n, self.ends = join(at, np.int64), join(keys, _U), join(of, np.int64), join(n, np.int64), join(ends, _U)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct keys, whether several ids have them here, and how many different runs (told apart by their ends)."""
        if not len(self.keys):
            return self.keys, np.zeros(0, np.uint8), np.zeros(0, np.uint32)
        order = np.lexsort((self.ends, self.keys))
        k, e, i = self.keys[order], self.ends[order], self.ids[self.of[order]]
        new = np.concatenate([[True], k[1:] != k[:-1]])
        first = np.flatnonzero(new)
        runs = np.add.reduceat(new | np.concatenate([[True], e[1:] != e[:-1]]), first, dtype=np.uint32)
        return k[first], (np.maximum.reduceat(i, first) != np.minimum.reduceat(i, first)).astype(np.uint8), runs

    def shared(self, answers: dict) -> tuple[np.ndarray, np.ndarray]:
        """Runs whose key several documents have, and whether that key is hot."""
        parts = [unpacked(b)[0] for _, b in sorted(answers.get(KEY, {}).items())]
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, bool)
        level = np.concatenate(parts)
        some = level & 1 > 0
        keys, hot = np.unique(self.keys)[some], level[some] & 2 > 0
        if not len(keys):
            return np.zeros(0, np.int64), np.zeros(0, bool)
        place = np.minimum(np.searchsorted(keys, self.keys), len(keys) - 1)
        hit = np.flatnonzero(keys[place] == self.keys)
        return hit, hot[place[hit]]


class _Segments:
    """A shard's segments of shared keys: each distinct one once, by key, and where each stands (row, document, place, windows). Windows of hot keys stand alone, keyed by their own hash."""

    def __init__(self, runs: _Runs, answers: dict):
        import xxhash

        hit, hot = runs.shared(answers)
        rows: dict[tuple[int, bytes], int] = {}
        which, of, place, windows = array("I"), array("I"), array("Q"), array("B")
        for r in range(0, len(hit), 100_000):
            own = hit[r : r + 100_000]
            for k, i, a, n, alone in zip(*(x[own].tolist() for x in (runs.keys, runs.of, runs.at, runs.n)), hot[r : r + 100_000].tolist(), strict=True):
                text = runs.texts[i]
                for p in range(a, a + n, 1 if alone else MOST):
                    w = 1 if alone else min(MOST, a + n - p)
                    t = text[p : p + w + LENGTH - 1]
                    key = (xxhash.xxh3_64_intdigest(t), t) if alone else (k, t)
                    which.append(rows.setdefault(key, len(rows)))
                    of.append(i)
                    place.append(p)
                    windows.append(w)
        self.of, self.place, self.n = np.frombuffer(of, np.uint32), np.frombuffer(place, np.uint64), np.frombuffer(windows, np.uint8)
        keys = np.fromiter((k for k, _ in rows), _U, len(rows))
        order = np.argsort(keys, kind="stable")
        rank = np.empty(len(rows), np.uint32)
        rank[order] = np.arange(len(rows), dtype=np.uint32)
        self.which = rank[np.frombuffer(which, np.uint32)]
        self.lowest = np.full(len(rows), NO_ID, np.int64)
        np.minimum.at(self.lowest, self.which, runs.ids[self.of])
        self.keys, texts = keys[order], [t for _, t in rows]
        self.texts = [texts[i] for i in order.tolist()]

    def state(self) -> bytes:
        return packed(self.which, self.of, self.place, self.n, self.lowest)


def _answer_keys(kind: int, part: int, pairs: list, hot: int):
    """For each key that a shard sent: 1 if several documents have it, 2 if it has `hot` different runs or more."""
    got = [unpacked_keys(b) for _, b in pairs]
    keys, back, n = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True, return_counts=True)
    several = np.bincount(back, np.concatenate([g[1] for g in got]))
    runs = np.bincount(back, np.concatenate([g[2] for g in got]))
    level = ((n > 1) | (several > 0)) + (runs >= hot) * np.uint8(2)
    for (shard, _), (own, *_) in zip(pairs, got, strict=True):
        yield KEY, shard, part, packed(level[np.searchsorted(keys, own)].astype(np.uint8))


# ---- the suffix sort ----


class Suffixes:
    """Suffixes of a buffer, compared by their common extension over prefix polynomial hashes."""

    def __init__(self, text: bytes):
        self.buf = np.frombuffer(text + bytes(LENGTH + 8), np.uint8)
        n = len(self.buf)
        powers = np.full(n + 1, _BASE)
        powers[0] = 1
        self.powers = np.multiply.accumulate(powers)
        inverse = np.full(n + 1, _U(pow(int(_BASE), -1, 1 << 64)))
        inverse[0] = 1
        self.inverse = np.multiply.accumulate(inverse)
        self.prefix = np.concatenate([np.zeros(1, _U), np.cumsum(_BYTES[self.buf] * self.powers[:n], dtype=_U)])

    def hashed(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (self.prefix[at + n] - self.prefix[at]) * self.inverse[at]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension, LENGTH at most, by binary search."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), LENGTH)
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.hashed(a, mid) == self.hashed(b, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def before(self, a: np.ndarray, b: np.ndarray, ties: bool) -> np.ndarray:
        """Whether suffix a sorts before b; `ties`: what equal ones give."""
        n = self.common(a, b)
        return np.where(n == LENGTH, ties, self.buf[a + np.minimum(n, LENGTH - 1)] < self.buf[b + np.minimum(n, LENGTH - 1)])

    def sort(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Sort suffixes within groups (equal numbers next to each other): bottom-up mergesort, all groups' merges of one width at once."""
        at = at.copy()
        n = len(at)
        new = np.concatenate([[True], group[1:] != group[:-1]]) if n else np.zeros(0, bool)
        first = np.flatnonzero(new)
        begin = first[np.cumsum(new) - 1]
        stop = np.append(first[1:], n)[np.cumsum(new) - 1]
        width, longest = 1, int((stop - begin).max()) if n else 0
        while width < longest:
            i = np.flatnonzero(stop - begin > width)
            rank = i - begin[i]
            left = rank // width % 2 == 0
            mine = begin[i] + rank // width * width
            other = np.where(left, mine + width, mine - width)
            other_stop = np.minimum(other + width, stop[i])
            some = other < stop[i]
            i, left, mine, other, other_stop = i[some], left[some], mine[some], other[some], other_stop[some]
            low, high = other.copy(), other_stop.copy()
            while True:
                live = np.flatnonzero(low < high)
                if not len(live):
                    break
                mid = (low[live] + high[live]) // 2
                # An element of the left run goes before equal ones of the right run.
                less = np.where(left[live], self.before(at[mid], at[i[live]], False), self.before(at[mid], at[i[live]], True))
                low[live], high[live] = np.where(less, mid + 1, low[live]), np.where(less, high[live], mid)
            to = np.where(left, mine, other) + (i - mine) + (low - other)
            moved = at[i]
            at[to] = moved
            width *= 2
        return at


def repeated_windows(keys: np.ndarray, ids: np.ndarray, n: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """For each segment a mask of the windows that a segment with a smaller id has too; bit i: the window at i."""
    distinct: dict[tuple[int, bytes], int] = {}
    which = np.array([distinct.setdefault(k, len(distinct)) for k in zip(keys.tolist(), texts, strict=True)], np.int64)
    lowest = np.full(len(distinct), NO_ID, np.int64)
    np.minimum.at(lowest, which, ids)
    full = lambda w: (_U(1) << w.astype(_U)) - _U(1) if len(w) else w.astype(_U)
    whole = np.where(n >= 64, ~_U(0), full(np.minimum(n, 63)))
    mask = np.where(lowest[which] < ids, whole, _U(0))
    # Keys with several texts: sort their suffixes.
    names = list(distinct)
    key = np.array([k for k, _ in names], _U)
    order = np.argsort(key, kind="stable")
    _, back, many = np.unique(key, return_inverse=True, return_counts=True)
    rows = np.array([i for i in order.tolist() if many[back[i]] > 1], np.int64)
    hidden = np.zeros(len(names), _U)
    if len(rows):
        # Some keys at a time: what the sort holds is bounded, but for a single key.
        windows = np.array([len(names[i][1]) for i in rows]) - LENGTH + 1
        ends = np.flatnonzero(np.append(key[rows[1:]] != key[rows[:-1]], True)) + 1
        done, total = 0, np.cumsum(windows)
        for end in ends.tolist():
            if end == len(rows) or total[end - 1] - (total[done - 1] if done else 0) >= SORTED:
                own = rows[done:end]
                _sorted_repeats(key[own], lowest[own], [names[i][1] for i in own], own, hidden)
                done = end
    return mask | hidden[which]


def _sorted_repeats(keys: np.ndarray, lowest: np.ndarray, texts: list[bytes], rows: np.ndarray, hidden: np.ndarray) -> None:
    """Sort the suffixes of some keys' distinct segments; note in `hidden`, at the segments' rows, the windows that a smaller id has."""
    size = np.array([len(t) for t in texts])
    base, windows = np.cumsum(size) - size, size - LENGTH + 1
    row = np.repeat(np.arange(len(texts)), windows)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    s = Suffixes(b"".join(texts))
    at = base[row] + offset
    lead = np.zeros(len(at), _U)
    for i in range(8):
        lead = lead << _U(8) | s.buf[at + i].astype(_U)
    k = keys[row]
    pre = np.lexsort((lead, k))
    at, row, k, lead = at[pre], row[pre], k[pre], lead[pre]
    group = np.cumsum(np.concatenate([[False], (k[1:] != k[:-1]) | (lead[1:] != lead[:-1])]))
    # The sort moves places alone; what a place belongs to is looked up by it.
    owner = np.zeros(len(s.buf), np.int64)
    owner[at] = row
    at = s.sort(at, group)
    row = owner[at]
    same = np.zeros(len(at), bool)
    near = np.flatnonzero(group[1:] == group[:-1]) + 1
    near = near[s.common(at[near - 1], at[near]) == LENGTH]
    # Equal hashes are verified byte by byte.
    for i in range(0, len(near), 65_536):
        j, span = near[i : i + 65_536], np.arange(LENGTH)
        same[j] = (s.buf[at[j - 1][:, None] + span] == s.buf[at[j][:, None] + span]).all(1)
    least = np.minimum.reduceat(lowest[row], np.flatnonzero(~same))[np.cumsum(~same) - 1]
    gone = least < lowest[row]
    np.bitwise_or.at(hidden, rows[row[gone]], _U(1) << (at[gone] - base[row[gone]]).astype(_U))


def _segment_rows(shard: int, segments: _Segments, parts: int):
    """Each distinct segment of a shard once, with its smallest id."""
    keys, lowest, texts = segments.keys, segments.lowest, segments.texts
    cuts = cut_points(keys, parts * SUB)
    for p in np.flatnonzero(np.diff(cuts[::SUB])).tolist():
        subs = []
        for q in range(p * SUB, (p + 1) * SUB):
            own = texts[cuts[q] : cuts[q + 1]]
            if not own:
                subs += [b"", b""]
                continue
            subs.append(packed(keys[cuts[q] : cuts[q + 1]], lowest[cuts[q] : cuts[q + 1]], np.array([len(t) for t in own], np.uint16)))
            subs.append(zstandard.ZstdCompressor(level=3).compress(b"".join(own)))
        yield SEGMENT, shard, p, np.array([len(x) for x in subs], np.int64).tobytes() + b"".join(subs)


def _sub_segments(blob: bytes, q: int):
    """(keys, ids, sizes, texts) of a blob's sub-range."""
    ends = np.cumsum(np.frombuffer(blob, np.int64, 2 * SUB)) + 16 * SUB
    start, middle, end = int(ends[2 * q - 1]) if q else 16 * SUB, int(ends[2 * q]), int(ends[2 * q + 1])
    if start == end:
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64), []
    k, i, s = unpacked(blob[start:middle])
    raw, size = zstandard.ZstdDecompressor().decompress(blob[middle:end]), s.astype(np.int64)
    return k, i, size, [raw[e - w : e] for e, w in zip(np.cumsum(size).tolist(), size.tolist(), strict=True)]


def _answer_segments(kind: int, part: int, pairs: list):
    """For each segment that a shard sent, the mask of its repeated windows; one sub-range is unpacked and sorted at a time. What a shard notes for itself goes back as it is."""
    if kind == STATE:
        yield from ((STATE, shard, part, blob) for shard, blob in pairs)
        return
    masks: list[list[np.ndarray]] = [[] for _ in pairs]
    for q in range(SUB):
        got = [_sub_segments(blob, q) for _, blob in pairs]
        keys, ids, sizes = (np.concatenate([g[c] for g in got]) for c in range(3))
        mask = repeated_windows(keys, ids, sizes - LENGTH + 1, [t for g in got for t in g[3]])
        for own, m in zip(masks, np.split(mask, np.cumsum([len(g[0]) for g in got])[:-1]), strict=True):
            own.append(m)
    for (shard, _), own in zip(pairs, masks, strict=True):
        yield SEGMENT, shard, part, packed(np.concatenate(own))


def _repeats(ids: np.ndarray, texts: list[bytes], answers: dict) -> list[np.ndarray]:
    """For each document, a flag for each place: whether a repeated window starts there."""
    sizes = np.array([len(t) for t in texts], np.int64)
    base = np.cumsum(sizes) - sizes
    gone = np.zeros(int(sizes.sum()), bool)
    for blob in answers.get(STATE, {}).values():
        which, of, place, n, lowest = unpacked(blob)
        parts = [unpacked(b)[0] for _, b in sorted(answers.get(SEGMENT, {}).items())]
        masks = np.concatenate(parts) if parts else np.zeros(0, _U)
        mask = np.where(lowest[which] < ids[of], ~_U(0), masks[which])
        hit, bit = np.flatnonzero(mask), np.arange(MOST)
        for i in range(0, len(hit), 16_384):
            j = hit[i : i + 16_384]
            on = (mask[j][:, None] >> bit.astype(_U) & _U(1) > 0) & (bit < n[j][:, None])
            gone[((base[of[j]] + place[j].astype(np.int64))[:, None] + bit)[on]] = True
    return np.split(gone, base[1:])


def _cover(gone: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the windows at the flagged starts cover."""
    at = np.flatnonzero(gone)
    if not len(at):
        return []
    first = np.concatenate([[True], at[1:] > at[:-1] + LENGTH])
    last = np.concatenate([first[1:], [True]])
    return list(zip(at[first].tolist(), np.minimum(at[last] + LENGTH, size).tolist(), strict=True))


def suffix_dedup(docs: DataFrame, outputs: str = "texts") -> DataFrame:
    """Remove repeated strings of 50 bytes from docs (doc_id, text).

    outputs "texts": doc_id, kept (the remaining text; bytes that are no UTF-8 any more are
    replaced), spans array<struct<start,end>> of removed bytes; "digests": counts and the
    remaining bytes' sha256. A null text counts as empty and keeps nothing. Rows that share
    a doc_id never remove each other's bytes; a null id sorts after all others.
    """
    shards = shard_table(docs.select("doc_id", "text"), "dedup", SHARD_BYTES // 2)
    parts = ranges_for(shards)

    def ask_keys(shard, ids, texts, _):
        keys, several, runs = _Runs(ids, texts).distinct()
        yield from blobs(KEY, shard, keys, [several, runs], parts)

    keyed = materialise(answer(ask(shards, None, ask_keys), partial(_answer_keys, hot=HOT)), "keys")

    def ask_segments(shard, ids, texts, answers):
        segments = _Segments(_Runs(ids, texts), answers)
        yield STATE, shard, shard, segments.state()
        yield from _segment_rows(shard, segments, parts)

    answered = answer(ask(shards, keyed, ask_segments), _answer_segments)
    digests = outputs == "digests"

    def result(shard, ids, texts, answers):
        gone = iter(_repeats(ids, texts, answers))
        rows = []
        for i, t in zip(ids.tolist(), texts, strict=True):
            spans = _cover(next(gone), len(t))
            edges = [0, *(x for s in spans for x in s), len(t)]
            kept = b"".join([t[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)])
            rows.append((None if i == NO_ID else i, len(t), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest() if digests else kept.decode("utf-8", "replace"), spans))
        c = [list(x) for x in zip(*rows, strict=True)]
        if digests:
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(c[0], pa.int64()), **{k: pa.array(v, pa.int64()) for k, v in zip(("n_bytes", "n_removed", "n_spans"), c[1:4], strict=True)}, "kept_sha256": c[4]})
        else:
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(c[0], pa.int64()), "kept": c[4], "spans": pa.array([[{"start": a, "end": b} for a, b in s] for s in c[5]], kind)})

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" if digests else "doc_id long, kept string, spans array<struct<start:long,end:long>>"
    return finish(shards, answered, result, schema)
