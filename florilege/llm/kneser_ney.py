"""Language-model scoring: an interpolated modified Kneser-Ney model of any order from 2.

Counting and scoring share exchanges between shards of documents and ranges of
hashed keys, one for each order. First, shards send their distinct n-grams of the
highest order and words with training counts; a range sums them into sorted hash
arrays, which its task memory-maps to answer each shard's keys: the total count,
and whether the shard owns the n-gram (exactly one shard does). Then, order by
order, shards send for each n-gram that is one word shorter what the n-grams they
own add to it: as a context (sum of counts, how many followers occur once, twice,
more often) and as an ending (number of distinct words before it; n-grams at a
text's beginning, which no word precedes, keep their counts). With all answers a
shard has all it needs to score its texts.

Discounts come from the global counts of counts, a few numbers that are summed in
Spark. Nothing else reaches the driver; what is gathered grows with the corpus.
"""

from __future__ import annotations

import os
import tempfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .exchange import NO_ID, answer, ask, blobs, finish, narrow, packed, ranges_for, shard_table, unpacked, unpacked_keys

TOP, WORD, STATS, LEVEL = range(4)  # n-grams of k words, as contexts and endings, are kind LEVEL + k
#: Hash keys of the text's end and of its beginning; words have the hash of their bytes.
END, BEGIN = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


class _Words(dict):
    def __missing__(self, word):
        n = self[word] = len(self) + 2
        return n


def tokenised(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, the token before each, document of each, word keys); token 0 is a text's end, 1 its beginning."""
    import xxhash

    words, parts = _Words(), []
    for t in texts:
        w = t.translate(_LOWER).split()
        parts.append(np.fromiter(map(words.__getitem__, w), np.int64, len(w)))
        parts.append(np.zeros(1, np.int64))
    tokens = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    before = np.concatenate([[1], np.where(tokens[:-1] == 0, 1, tokens[:-1])]) if len(tokens) else tokens
    doc = np.repeat(np.arange(len(texts)), [len(p) + 1 for p in parts[::2]])
    keys = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    return tokens, before, doc, np.concatenate([np.array([END, BEGIN], np.uint64), keys])


def bigram_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a ^ (a >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + b * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def is_training(ids: np.ndarray, modulus: int, held: int) -> np.ndarray:
    return np.array([i != NO_ID and zlib.crc32(str(i).encode()) % modulus != held for i in ids.tolist()], bool)


class _Level:
    """A shard's distinct n-grams of one length: keys and their order in blobs; first word, ending and context (levels below), and the n-gram at each token."""

    def __init__(self, keys, at, begin, first=None, ending=None, context=None):
        self.keys, self.at, self.begin, self.first, self.ending, self.context = keys, at, begin, first, ending, context
        self.order = np.argsort(keys, kind="stable")


class _Shard:
    """A shard's distinct n-grams of each length up to the model's order."""

    def __init__(self, ids: np.ndarray, texts: list[bytes], modulus: int, held: int, order: int):
        self.ids = ids
        self.train = is_training(ids, modulus, held)
        self.tokens, before, self.doc, self.word_keys = tokenised(texts)
        self.levels = [None, _Level(self.word_keys, self.tokens, 1)]
        starts = np.concatenate([[True], self.tokens[:-1] == 0]) if len(self.tokens) else np.zeros(0, bool)
        for k in range(2, order + 1):
            under = self.levels[-1]
            if k > 2:
                before = np.concatenate([[1], before[:-1]])
                before[starts] = 1
            # Last comes the n-gram of beginnings alone, which is a context but stands nowhere.
            codes = before * len(under.keys) + under.at
            if k < order:
                codes = np.append(codes, len(under.keys) + under.begin)
            distinct, at = np.unique(codes, return_inverse=True)
            first, ending = np.divmod(distinct, len(under.keys))
            context = first
            if k > 2:
                context = np.full(len(distinct), under.begin)
                context[at[: len(self.tokens)]] = np.where(starts, under.begin, np.roll(under.at, 1))
            keys = bigram_keys(self.word_keys[first], under.keys[ending])
            self.levels.append(_Level(keys, at[: len(self.tokens)], int(at[-1]) if k < order else -1, first, ending, context))
        self.top = self.levels[order]

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        w = self.train[self.doc].astype(np.float64)
        return np.bincount(self.top.at, w, len(self.top.keys)).astype(np.int64), np.bincount(self.tokens, w, len(self.word_keys)).astype(np.int64)

    def restored(self, answers: dict, kind: int, columns: int) -> list[np.ndarray]:
        """The answers of all ranges, in the order of the shard's own arrays."""
        parts = [unpacked(b) for _, b in sorted(answers.get(kind, {}).items())]
        order = (self.top if kind == TOP else self.levels[max(kind - LEVEL, 1)]).order
        out = []
        for c in range(columns):
            a = np.zeros(len(order), np.int64)
            if parts:
                a[order] = np.concatenate([p[c].astype(np.int64) for p in parts])
            out.append(a)
        return out

    def counted(self, answers: dict, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(count, whether the shard owns it) of each n-gram of k words: how often it occurs, below the model's order how many words precede it."""
        c, mine = self.restored(answers, TOP, 2) if self.levels[k] is self.top else self.restored(answers, LEVEL + k, 6)[4:]
        return c, mine > 0


def _summed(pairs: list[tuple[int, bytes]], columns: int) -> tuple[np.ndarray, list[np.ndarray], str]:
    """Sorted hash arrays of a range in a file, memory-mapped: distinct keys, and sums of each column."""
    got = [unpacked_keys(b) for _, b in pairs]
    keys = np.concatenate([g[0] for g in got])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sums = [np.add.reduceat(np.concatenate([g[1 + c] for g in got]).astype(np.int64)[order], first) for c in range(columns)]
    handle, path = tempfile.mkstemp(prefix="ngrams-")
    with os.fdopen(handle, "wb") as f:
        for a in (keys[first], *sums):
            f.write(a.tobytes())
    n = len(first)
    maps = [np.memmap(path, k, "r", 8 * n * i, (n,)) for i, k in enumerate([np.uint64] + [np.int64] * columns)]
    return maps[0], maps[1:], path


def _count_of_counts(c: np.ndarray) -> list[int]:
    return [int((c == i).sum()) for i in (1, 2, 3, 4)]


def _answer_counts(kind: int, part: int, pairs: list):
    keys, (counts,), path = _summed(pairs, 1)
    try:
        owned = np.zeros(len(keys), bool)
        for shard, blob in pairs:
            own, sent = unpacked_keys(blob)
            at = np.searchsorted(keys, own)
            c = counts[at]
            if kind == TOP:
                mine = (sent > 0) & ~owned[at]
                owned[at[mine]] = True
                yield kind, shard, part, packed(narrow(c), mine)
            else:
                yield kind, shard, part, packed(narrow(c))
        stats = [*_count_of_counts(counts), int(counts.sum()), int((counts > 0).sum())]
        yield STATS, kind, part, packed(np.array(stats, np.int64))
    finally:
        os.unlink(path)


def _answer_words(kind: int, part: int, pairs: list):
    keys, sums, path = _summed(pairs, 5)
    try:
        n, owned = sums[4], np.zeros(len(keys), bool)
        for shard, blob in pairs:
            at = np.searchsorted(keys, unpacked_keys(blob)[0])
            answers = [narrow(s[at]) for s in sums]
            if kind > LEVEL + 1:
                answers.append((n[at] > 0) & ~owned[at])
                owned[at] = True
            yield kind, shard, part, packed(*answers)
        stats = [*_count_of_counts(n), int(n.sum()), int((n > 2).sum())]
        yield STATS, kind, part, packed(np.array(stats, np.int64))
    finally:
        os.unlink(path)


def _totals(answers: DataFrame) -> dict[int, np.ndarray]:
    """Sums of the ranges' statistics, by what they are of: six numbers each."""

    def run(batches):
        for batch in batches:
            rows = [unpacked(b.as_py())[0] for b in batch.column(1)]
            yield pa.RecordBatch.from_pydict({"of": batch.column(0), **{f"s{i}": pa.array([int(r[i]) for r in rows], pa.int64()) for i in range(6)}})

    rows = answers.filter(F.col("kind") == STATS).select("shard", "blob").mapInArrow(run, "of long, " + ", ".join(f"s{i} long" for i in range(6)))
    return {r[0]: np.array(r[1:], np.int64) for r in rows.groupBy("of").agg(*(F.sum(f"s{i}") for i in range(6))).collect()}


def discounts(n: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts of 0, 1, 2 and more, from the counts of counts; 0.5, 1 and 1.5 where a count is missing."""
    n1, n2, n3, n4 = (float(x) for x in n[:4])
    if min(n1, n2, n3) <= 0:
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    d = np.array([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.clip(d, [0, 0.01, 0.01, 0.01], [0, 1, 2, 3])


def score(docs: DataFrame, modulus: int = 7, held: int = 2, order: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs (doc_id, text).

    Rows whose crc32(doc_id as text) mod `modulus` is `held`, or whose id is null, are
    held out; the rest train. A null text counts as empty: its one token is the end.
    Without training rows the model is uniform over one unknown word. order is the
    length of the model's n-grams, 2 at least.
    """
    if order < 2:
        raise ValueError("order must be 2 or more")
    shards = shard_table(docs.select("doc_id", "text"), "lm")
    parts = ranges_for(shards)

    def count(shard, ids, texts, _):
        s = _Shard(ids, texts, modulus, held, order)
        grams, words = s.counts()
        yield from blobs(TOP, shard, s.top.keys[s.top.order], [narrow(grams[s.top.order])], parts)
        by_key = s.levels[1].order
        yield from blobs(WORD, shard, s.word_keys[by_key], [narrow(words[by_key])], parts)

    def adder(k):
        def add(shard, ids, texts, answers):
            s = _Shard(ids, texts, modulus, held, order)
            level, under = s.levels[k], s.levels[k - 1]
            c, mine = s.counted(answers, k)
            n, a, b, c = len(under.keys), level.context[mine], level.ending[mine], c[mine]
            # Where nothing precedes the ending, it keeps its count.
            alone = (level.first[mine] == 1) & (under.first[b] == 1) if k > 2 else np.zeros(len(b), bool)
            columns = [np.bincount(a, c, n), np.bincount(a[c == 1], minlength=n), np.bincount(a[c == 2], minlength=n), np.bincount(a[c > 2], minlength=n), np.bincount(b, np.where(alone, c, 1), n)]
            yield from blobs(LEVEL + k - 1, shard, under.keys[under.order], [narrow(x.astype(np.int64)[under.order]) for x in columns], parts)

        return add

    counted = materialise(answer(ask(shards, None, count), _answer_counts), "counts")
    totals, back = _totals(counted), counted.filter(F.col("kind") != STATS)
    both = newest = back
    for k in range(order, 1, -1):
        under = materialise(answer(ask(shards, newest, adder(k)), _answer_words), "words")
        totals |= _totals(under)
        newest = under.filter(F.col("kind") != STATS)
        both = both.unionByName(newest)
    none = np.zeros(6, np.int64)
    of_words, of_follow = totals.get(WORD, none), totals.get(LEVEL + 1, none)
    d = {k: discounts(totals.get(TOP if k == order else LEVEL + k, none)) for k in range(1, order + 1)}
    n_train, n_words, n_follow = int(of_words[4]), int(of_words[5]), int(of_follow[4])
    left1 = (d[1][1] * of_follow[0] + d[1][2] * of_follow[1] + d[1][3] * of_follow[5]) / n_follow if n_follow else 1.0

    def scored(shard, ids, texts, answers):
        s = _Shard(ids, texts, modulus, held, order)
        (raw,) = s.restored(answers, WORD, 1)
        follow = s.restored(answers, LEVEL + 1, 5)[4]
        p = (np.maximum(follow - d[1][np.minimum(follow, 3)], 0) / n_follow if n_follow else 0.0 * follow) + left1 / (n_words + 1)
        for k in range(2, order + 1):
            level, (c, _) = s.levels[k], s.counted(answers, k)
            total, once, twice, more = s.restored(answers, LEVEL + k - 1, 4)
            whole = np.maximum(total, 1)[level.context]
            left = (d[k][1] * once + d[k][2] * twice + d[k][3] * more)[level.context] / whole
            p = np.maximum(c - d[k][np.minimum(c, 3)], 0) / whole + np.where(total[level.context] > 0, left, 1.0) * p[level.ending]
        n = len(ids)
        base = np.log10((raw + 1) / (n_train + n_words + 1))
        cols = {
            "doc_id": pa.array([None if i == NO_ID else i for i in ids.tolist()], pa.int64()), "held_out": ~s.train,
            "n_tokens": np.bincount(s.doc, minlength=n).astype(np.int64), "n_known": np.bincount(s.doc[raw[s.tokens] > 0], minlength=n).astype(np.int64),
            "train_tokens": np.full(n, n_train, np.int64), "base_score": np.bincount(s.doc, base[s.tokens], n), "score": np.bincount(s.doc, np.log10(p)[s.top.at], n),
        }
        yield pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in cols.items()})

    return finish(shards, both, scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
