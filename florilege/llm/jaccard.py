"""N-gram Jaccard join: documents whose shingle sets have a similarity of at least a threshold, as components.

Count vectors and an R-tree, behind exact blocks. Each shingle is hashed into one
of DIMS groups; a document is the point of its group counts. For two points the
sum over groups of the smaller count bounds the overlap from above, and for a
rectangle of points the sum of minima with its upper corner bounds all of them.
Alone, an R-tree over these points can't prune long sets at high thresholds (the
bound's slack grows as the root of the length, but in every group), so equal
signatures come first: two sets in the threshold differ in at most d shingles, d
known from their sizes; of more than d hash groups at least one is then equal in
both. The documents that share a signature are a block.

Of each block the first member is compared with all others: by the bound, then
exactly. That keeps a block of copies linear: where all its members fall into one
component, nothing more can be learnt. Signatures whose members are still in several
components, joined by their first member, make larger blocks, whose points are indexed
in an R-tree. It is searched for the members outside the block's main component;
pairs that survive the bound, and lie across components, are verified exactly. Large
blocks are searched tile by tile. Where many pairs of a tile survive, their texts
go there and are verified in place, and one link for two components leaves it. So no
link between components is lost, and no group's pairs are emitted.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .components import components
from .exchange import BLOB, answer, blob_batches, blobs, packed, unpacked, unpacked_keys

DIMS = 128
TILE = 2048  # members of a block that are searched at once
DENSE = 4  # pairs left of a tile for each of its members, from which on they are verified in place
CHUNK = 20_000  # rows of small blocks for one task
LEAF = 32
RANGE_SHINGLES = 2_000_000  # for each key range of signatures
SLOTS = 1 << 25  # bits of the filter of ids: 4 MB
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingles(text: bytes, words: int = 3) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; of the whole sequence if it is shorter; none without words."""
    import xxhash

    w = text.translate(_LOWER).split()
    if not w:
        return np.zeros(0, np.uint64)
    if len(w) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(w), seed=len(w))], np.uint64)
    keys = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    n = len(w) - words + 1
    h = np.zeros(n, np.uint64)
    for i in range(words):
        h = (h ^ keys[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique(h)


class Blocks:
    """Signatures such that two sets in the threshold (percent) share one."""

    def __init__(self, percent: int):
        self.percent = percent
        self.lows, self.highs, self._groups = [1], [], {}

    def _level(self, n: int) -> int:
        while not self.highs or self.highs[-1] < n:
            high = max(self.lows[-1], self.lows[-1] * 100 // self.percent)
            self.highs.append(high)
            self.lows.append(high + 1)
        return int(np.searchsorted(np.array(self.highs), n))

    def differ(self, n: int) -> int:
        """The most by which a set of n and one that is not smaller differ within the threshold."""
        p = self.percent
        return n * (100 - p) // p

    def groups(self, level: int) -> int:
        """Groups of a level: more than d, and so many that its smallest sets have more than d in use, with three deviations to spare.

        Signatures of empty groups are alike for unrelated sets, and needed only where d groups or fewer are in use.
        """
        if level not in self._groups:
            low, d = self.lows[level], self.differ(self.highs[level])
            for n in range(d + 1, 2 * d + 6):
                share = math.exp(-low / n)
                used, deviation = n * (1 - share), math.sqrt(n * share * max(0.0, 1 - (1 + low / n) * share))
                if not d or used - 3 * deviation > d:
                    break
            self._groups[level] = n
        return self._groups[level]

    def signatures(self, s: np.ndarray) -> np.ndarray:
        """64-bit signatures of a set of sorted hashes; a set's own level and the one below, where smaller partners meet it."""
        if not len(s):
            return s
        level = self._level(len(s))
        return np.concatenate([self._tagged(s, t) for t in ((level, level - 1) if level else (level,))])

    def _tagged(self, s: np.ndarray, tag: int) -> np.ndarray:
        d, groups = self.differ(self.highs[tag]), self.groups(tag)
        with np.errstate(over="ignore"):
            mixed = (s ^ (s >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
            mixed ^= mixed >> np.uint64(27)
            g = (s % np.uint64(groups)).astype(np.int64)
            sums = np.zeros(groups, np.uint64)
            np.add.at(sums, g, mixed)
            n = np.bincount(g, minlength=groups)
            own = np.arange(groups, dtype=np.uint64)
            out = (sums ^ np.uint64(tag * 0x1000003)) * np.uint64(0xD6E8FEB86659FD93) + own * np.uint64(0xA0761D6478BD642F) + n.astype(np.uint64)
            out = (out ^ (out >> np.uint64(32))) * np.uint64(0xE7037ED1A0B428DB)
            out ^= out >> np.uint64(28)
        # At most d groups differ: a set with more groups than that in use has an equal one among them.
        return out[n > 0] if (n > 0).sum() > d else out


def needed(a, b, percent: int):
    """The least overlap of linked sets of sizes a and b."""
    return -(-percent * (a + b) // (100 + percent))


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def counts_of(s: np.ndarray) -> np.ndarray:
    return np.bincount((s >> np.uint64(65 - DIMS.bit_length())).astype(np.int64), minlength=DIMS).astype(np.int32)


class RTree:
    """A packed R-tree over count vectors: sorted by tiles, LEAF points to a leaf, LEAF nodes to a node; only upper corners are needed."""

    def __init__(self, points: np.ndarray):
        self.points = points
        order = np.arange(len(points))

        def tiles(rows: np.ndarray, dim: int) -> list[np.ndarray]:
            if len(rows) <= LEAF or dim >= points.shape[1]:
                rows = rows[np.argsort(points[rows].sum(1), kind="stable")]
                return [rows[i : i + LEAF] for i in range(0, len(rows), LEAF)]
            slabs = max(2, math.ceil((len(rows) / LEAF) ** (1 / (points.shape[1] - dim))))
            rows = rows[np.argsort(points[rows, dim], kind="stable")]
            return [t for part in np.array_split(rows, slabs) for t in tiles(part, dim + 1)]

        spread = np.argsort(-points.var(0), kind="stable") if len(points) else np.arange(points.shape[1])
        points, self.points = points[:, spread], points[:, spread]
        self.spread = spread
        self.leaves = tiles(order, 0)
        uppers = np.array([points[t].max(0) for t in self.leaves]).reshape(-1, points.shape[1])
        self.levels = [uppers]
        while len(uppers) > LEAF:
            uppers = np.array([uppers[i : i + LEAF].max(0) for i in range(0, len(uppers), LEAF)])
            self.levels.append(uppers)

    def search(self, q: np.ndarray, percent: int) -> np.ndarray:
        """Points whose summed coordinate minima with q reach the overlap that a link needs."""
        q = q[self.spread]
        n = q.sum()
        nodes = np.arange(len(self.levels[-1]))
        for depth in range(len(self.levels) - 1, -1, -1):
            # A partner of size m needs percent (n + m) / (100 + percent), and m >= percent n / 100.
            nodes = nodes[np.minimum(self.levels[depth][nodes], q).sum(1) >= needed(n, -(-percent * n // 100), percent)]
            if depth:
                nodes = (nodes[:, None] * LEAF + np.arange(LEAF)).reshape(-1)
                nodes = nodes[nodes < len(self.levels[depth - 1])]
        rows = np.concatenate([self.leaves[i] for i in nodes]) if len(nodes) else np.zeros(0, np.int64)
        p = self.points[rows]
        return rows[np.minimum(p, q).sum(1) >= needed(n, p.sum(1), percent)]


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n, h1, h2 (of the set), counts (its point)."""

    def run(batches):
        import xxhash

        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("n", "h1", "h2", "counts")}
            for text in batch.column(1):
                s = shingles(text.as_buffer().to_pybytes() if text.is_valid else b"", words)
                h = xxhash.xxh3_128_digest(s.tobytes())
                for k, v in zip(out, (len(s), int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True), counts_of(s)), strict=True):
                    out[k].append(v)
            kinds = {"n": pa.int64(), "h1": pa.int64(), "h2": pa.int64(), "counts": pa.list_(pa.int32())}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), **{k: pa.array(v, kinds[k]) for k, v in out.items()}})

    return docs.mapInArrow(run, "doc_id long, n long, h1 long, h2 long, counts array<int>")


def _asked(docs: DataFrame, words: int, percent: int, parts: int) -> DataFrame:
    """Signatures by key range (kind 0), each once for a run of rows, with the smallest id that has it there; the run's other ids are paired with that one at once (kind 1)."""

    def run(batches):
        import xxhash

        shard, blocks, keys, ids, seen, size = TaskContext.get().partitionId(), Blocks(percent), [], [], set(), 0

        def rows():
            k, i = np.concatenate(keys), np.concatenate(ids)
            order = np.lexsort((i, k))
            k, i = k[order], i[order]
            new = np.concatenate([[True], k[1:] != k[:-1]])
            yield from blobs(0, shard, k[new], [i[new]], parts)
            star = _star(k, i, new)
            if len(star[0]):
                yield 1, shard, shard, packed(*star)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if doc_id is None or not text.is_valid:
                    continue
                s = shingles(text.as_buffer().to_pybytes(), words)
                h = xxhash.xxh3_128_digest(s.tobytes())
                if h in seen or not len(s):
                    continue  # an equal set is linked by its hash
                seen.add(h)
                k = blocks.signatures(s)
                keys.append(k)
                ids.append(np.full(len(k), doc_id, np.int64))
                size += len(k)
                if size > 2_000_000:
                    yield from blob_batches(rows())
                    keys, ids, seen, size = [], [], set(), 0
        if size:
            yield from blob_batches(rows())

    return docs.mapInArrow(run, BLOB)


def _star(k: np.ndarray, i: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, smallest id, other id) of sorted signatures; new: where each begins."""
    hub = i[np.flatnonzero(new)][np.cumsum(new) - 1]
    keep = hub != i
    rows = np.unique(np.stack([k[keep].view(np.int64), hub[keep], i[keep]], 1), axis=0)
    return rows[:, 0].copy(), rows[:, 1].copy(), rows[:, 2].copy()


def _stars(kind: int, part: int, pairs: list):
    """Of each signature that several ids have: (signature, smallest id, other id)."""
    if kind == 1:
        yield from ((1, shard, part, blob) for shard, blob in pairs)
        return
    got = [unpacked_keys(b) for _, b in pairs]
    k, i = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
    order = np.lexsort((i, k))
    k, i = k[order], i[order]
    star = _star(k, i, np.concatenate([[True], k[1:] != k[:-1]]))
    if len(star[0]):
        yield kind, 0, part, packed(*star)


def _star_rows(stars: DataFrame, columns: str) -> DataFrame:
    """sig, a, b of the blobs, or the distinct a, b of each blob."""

    def run(batches):
        for batch in batches:
            for blob in batch.column(0):
                sig, a, b = unpacked(blob.as_py())
                if columns == "pairs":
                    ab = np.unique(np.stack([a, b], 1), axis=0)
                    yield pa.RecordBatch.from_pydict({"a": ab[:, 0], "b": ab[:, 1]})
                else:
                    yield pa.RecordBatch.from_pydict({"sig": sig, "a": a, "b": b})

    return stars.select("blob").mapInArrow(run, "a long, b long" if columns == "pairs" else "sig long, a long, b long")


def _only(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of docs whose key may be among ids (one column): what a join on the key would drop, mostly before it is shuffled.

    A Bloom filter of SLOTS bits with one hash, as rows of a bitmap each, is broadcast:
    at most SLOTS / 8 bytes, whatever the number of ids. With very many ids it lets
    more through, so a join has to follow.
    """
    slot = F.pmod(F.xxhash64(key), F.lit(SLOTS))
    bits = ids.select(slot.alias("slot")).groupBy(F.expr("bitmap_bucket_number(slot)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("bits"))
    byte = F.conv(F.hex(F.expr("substring(bits, cast(bitmap_bit_position(slot) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    at = docs.withColumn("slot", slot).withColumn("bucket", F.expr("bitmap_bucket_number(slot)"))
    hit = F.expr("cast(bitmap_bit_position(slot) % 8 as int)")
    return at.join(F.broadcast(bits), "bucket").filter(F.call_function("shiftright", byte, hit).bitwiseAND(F.lit(1)) == 1).select(*docs.columns)


def _verified(pairs: DataFrame, docs: DataFrame, points: DataFrame, words: int, percent: int) -> DataFrame:
    """a, b, ok of distinct pairs: the bound first, then the sets of the whole texts."""
    x = points.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("counts").alias("ca"))
    y = points.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("counts").alias("cb"))
    near = pairs.join(x, "a").join(y, "b")
    most = F.aggregate(F.zip_with("ca", "cb", lambda p, q: F.least(p, q)), F.lit(0).cast("long"), lambda s, v: s + v)
    near = near.filter(most * (100 + percent) >= (F.col("na") + F.col("nb")) * percent).select("a", "b")
    near = materialise(near, "near")
    ids = near.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = _only(docs.filter("text IS NOT NULL"), ids, "doc_id").dropDuplicates(["doc_id"])
    with_texts = near.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")

    def run(batches):
        hub, held = None, None
        for batch in batches:
            ok = []
            for a, ta, tb in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if hub != a:
                    hub, held = a, shingles(ta.as_buffer().to_pybytes(), words)
                ok.append(linked(held, shingles(tb.as_buffer().to_pybytes(), words), percent))
            yield pa.RecordBatch.from_pydict({"a": batch.column(0), "b": batch.column(1), "ok": pa.array(ok, pa.bool_())})

    return with_texts.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, ok boolean").filter("ok").select("a", "b")


def _tile_links(words: int, percent: int):
    """Links between components in a tile, or between two tiles, of a block's members: one for each two components that meet.

    The R-tree of the one tile is searched for each member of the other. What survives the
    bound is verified here: sets are held as their differences from the member nearest to
    the mean point, which are short where all are copies of one text, and an index of these
    differences gives the size of any two members' difference.
    """

    def run(t: pa.Table) -> pa.Table:
        ids, label, tile = (t[c].to_numpy() for c in ("id", "label", "tile"))
        sets = [shingles(x.as_buffer().to_pybytes(), words) for x in t["text"]]
        size = np.array([len(s) for s in sets], np.int64)
        points = np.array([counts_of(s) for s in sets]).reshape(-1, DIMS)
        hub = sets[int(np.abs(points - points.mean(0)).sum(1).argmin())]
        parts = [np.setxor1d(s, hub, assume_unique=True) for s in sets]
        part = np.array([len(x) for x in parts], np.int64)
        low, high = t["t1"][0].as_py(), t["t2"][0].as_py()
        left, right = np.flatnonzero(tile == low), np.flatnonzero(tile == high)
        if not len(left) or not len(right):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        tree = RTree(points[left])
        held = np.concatenate([parts[i] for i in left])
        owner = np.repeat(np.arange(len(left)), part[left])
        order = np.argsort(held, kind="stable")
        owner, (values, first) = owner[order], np.unique(held[order], return_index=True)
        last = np.append(first[1:], len(held))
        above: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := above.get(x, x)) != x:
                x = y
            return x

        out = []
        for j in right.tolist():
            if not (label[left] != label[j]).any():
                continue
            i = tree.search(points[j], percent)
            i = i[label[left[i]] != label[j]]
            if not len(i):
                continue
            at = np.searchsorted(values, parts[j])
            at = at[at < len(values)][values[at[at < len(values)]] == parts[j][at < len(values)]]
            both = np.bincount(np.concatenate([owner[first[k] : last[k]] for k in at.tolist()]), minlength=len(left))[i] if len(at) else np.zeros(len(i), np.int64)
            differ, total = part[j] + part[left[i]] - 2 * both, size[j] + size[left[i]]
            for k in left[i[(100 * (total - differ) >= percent * (total + differ)) & (total > differ)]].tolist():
                x, y = root(int(label[j])), root(int(label[k]))
                if x != y:
                    above[max(x, y)] = min(x, y)
                    out.append((min(ids[j], ids[k]), max(ids[j], ids[k])))
        return pa.table({"a": pa.array([r[0] for r in out], pa.int64()), "b": pa.array([r[1] for r in out], pa.int64())})

    return run


def _near_points(percent: int, dense: int):
    """Pairs of a block's members, or of two tiles of them, that the bound doesn't rule out and that lie in different components; no pair but a mark for tiles with very many.

    A chunk has several blocks. A block of few points is one leaf; of others, the R-tree of the one tile
    is searched for each member of the other.
    """

    def run(t: pa.Table) -> pa.Table:
        block, ids, label, tile = (t[c].to_numpy() for c in ("block", "id", "label", "tile"))
        low, high = t["t1"][0].as_py(), t["t2"][0].as_py()
        points = t["counts"].combine_chunks().flatten().to_numpy().reshape(-1, DIMS)
        order = np.lexsort((tile, block))
        cuts = np.flatnonzero(np.concatenate([[True], block[order][1:] != block[order][:-1], [True]]))
        found: list[tuple] = []

        def near(x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray | None:
            """Pairs (smaller id, larger id) of rows of x and of y across components whose bound reaches what a link needs; None if there are more than `most`."""
            pairs, n = [np.zeros((0, 2), np.int64)], 0
            p, size = points[x], points[x].sum(1)
            tree = RTree(p) if len(x) > LEAF else None
            for j in y.tolist():
                q = points[j]
                i = x[tree.search(q, percent) if tree else np.minimum(p, q).sum(1) >= needed(size, q.sum(), percent)]
                i = i[label[i] != label[j]]
                n += len(i)
                if n > most:
                    return None
                if len(i):
                    pairs.append(np.stack([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])], 1))
            return np.concatenate(pairs)

        for start, stop in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            rows = order[start:stop]
            left, right = rows[tile[rows] == low], rows[tile[rows] == high]
            if not len(left) or not len(right):
                continue
            # Pairs across components have an end outside the largest one.
            names, n = np.unique(label[rows], return_counts=True)
            main, most = names[n.argmax()], dense * (len(left) + len(right))
            sides = [near(left, right[label[right] != main], most)]
            if low != high and sides[0] is not None:
                sides.append(near(right[label[right] == main], left[label[left] != main], most))
            if any(x is None for x in sides):
                found.append((block[rows[:1]], None, None))
            elif sum(map(len, sides)):
                both = np.unique(np.concatenate(sides), axis=0)
                found.append((np.full(len(both), block[rows[0]]), both[:, 0], both[:, 1]))
        column = lambda k: pa.concat_arrays([pa.array([None] if f[k] is None else f[k], pa.int64()) for f in found]) if found else pa.array([], pa.int64())
        n = sum(len(f[0]) for f in found)
        return pa.table({"block": column(0), "t1": pa.array([low] * n, pa.int32()), "t2": pa.array([high] * n, pa.int32()), "a": column(1), "b": column(2)})

    return run


def _merged(label: DataFrame, links: DataFrame) -> DataFrame:
    """label (node, label) after more links (a, b): the components of the labels that they join."""
    of = lambda name: label.select(F.col("node").alias(name), F.col("label").alias(f"l{name}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    top = materialise(components(ends), "labels")
    up = label.join(top.select(F.col("node").alias("label"), F.col("label").alias("top")), "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    return materialise(up.unionByName(top.join(label, "node", "left_anti")), "labels")


def jaccard_join(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text).

    Texts are lower-cased in A-Z; words are runs without white space (blank, tab to
    carriage return). A set with fewer words than a shingle has the whole sequence as
    its one shingle; null texts and texts without words have an empty set and link
    with nothing. component_id is the smallest doc_id reachable over links, itself
    included. Rows that share a doc_id are one node; where their texts differ, the links of
    one of them are sure to be found. A null doc_id has no component.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = materialise(_sets(docs, words), "sets")
    points = sets.select("doc_id", "n", "counts").filter("n > 0 AND doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    # Equal sets are linked with the first that has them.
    first = sets.filter("n > 0 AND doc_id IS NOT NULL").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("a"), F.count("*").alias("m")).filter("m > 1").drop("m")
    equal = sets.select("doc_id", "h1", "h2", "n").join(first, ["h1", "h2", "n"]).select("a", F.col("doc_id").alias("b")).filter("a <> b")
    parts = max(1, math.ceil((sets.agg(F.sum("n")).first()[0] or 0) / RANGE_SHINGLES))
    stars = materialise(answer(_asked(docs, words, percent, parts), _stars), "stars")
    pairs = materialise(_star_rows(stars, "pairs").distinct(), "pairs")
    # Each member is verified with the smallest of its firsts; its other pairs only where they might still join two components.
    nearest = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = materialise(_verified(nearest, docs, points, words, percent).unionByName(equal).distinct(), "links")
    label = materialise(components(links), "labels")

    def across(rows: DataFrame) -> DataFrame:
        """Pairs whose ends are in different components so far."""
        of = lambda name: label.select(F.col("node").alias(name), F.col("label").alias(f"l{name}"))
        return rows.join(of("a"), "a", "left").join(of("b"), "b", "left").filter(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")

    rest = materialise(across(pairs.join(nearest, ["a", "b"], "left_anti")), "rest")
    if not rest.isEmpty():
        label = _merged(label, materialise(_verified(rest, docs, points, words, percent), "links"))
    # Signatures whose members are in several components make blocks, by the first member. Pairs with it are known by now.
    split = materialise(across(pairs), "split")
    if not split.isEmpty():
        rows = _star_rows(stars, "rows")
        rows = rows.join(rows.join(split, ["a", "b"], "left_semi").select("sig").distinct(), "sig", "left_semi")
        members = rows.join(rows.groupBy("sig").agg(F.min("a").alias("block")), "sig").select("block", F.explode(F.array("a", "b")).alias("id")).distinct()
        members = materialise(members.join(label.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id")), "members")
        blocks = members.groupBy("block").agg(F.count("*").alias("m"), F.min("label").alias("l0"), F.max("label").alias("l1")).filter("m > 2 AND l0 <> l1")
        blocks = materialise(blocks.select("block", F.ceil(F.col("m") / TILE).cast("int").alias("tiles"), "m"), "blocks")
        chunks = max(1, math.ceil((blocks.filter("tiles = 1").agg(F.sum("m")).first()[0] or 0) / CHUNK))
        held = members.join(blocks, "block").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
        # A large block has its own chunks; a member of it meets each tile once.
        held = held.withColumn("chunk", F.when(F.col("tiles") == 1, F.pmod(F.xxhash64("block"), F.lit(chunks))).otherwise(F.col("block")))
        placed = held.join(points.select(F.col("doc_id").alias("id"), "counts"), "id").withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
        placed = placed.withColumn("t1", F.least("tile", "other")).withColumn("t2", F.greatest("tile", "other"))
        found = placed.select("block", "id", "label", "tile", "counts", "chunk", "tiles", "t1", "t2").groupBy("chunk", "tiles", "t1", "t2").applyInArrow(_near_points(percent, DENSE), "block long, t1 int, t2 int, a long, b long")
        found = materialise(found, "found")
        more = _verified(found.filter("a IS NOT NULL").select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti"), docs, points, words, percent)
        dense = found.filter("a IS NULL").select("block", "t1", "t2")
        if not dense.isEmpty():
            own = held.join(dense, "block").filter("tile = t1 OR tile = t2").select("block", "t1", "t2", "id", "label", "tile")
            texts = _only(docs.filter("text IS NOT NULL").withColumnRenamed("doc_id", "id"), own.select("id"), "id").dropDuplicates(["id"])
            more = more.unionByName(texts.join(own, "id").groupBy("block", "t1", "t2").applyInArrow(_tile_links(words, percent), "a long, b long"))
        more = materialise(more, "links")
        if not more.isEmpty():
            label = _merged(label, more)
    out = sets.select("doc_id", F.col("n").alias("n_shingles")).join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"))
