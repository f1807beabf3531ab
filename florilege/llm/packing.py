"""Best-fit packing of tokenised documents into sequences of a fixed length.

Hierarchical residual packing. Pieces are dealt at random into parts of bounded
size. Each part packs its pieces best-fit, longest first; bins that are nearly
full are sealed, and the underfull bins become items themselves, of their fill's
size. Parts are then merged in a tree, a few at a time, and each node packs its
children's underfull bins best-fit again, until the root seals the rest.

Bins of one part and one fill are interchangeable, so a node of the tree only
sees how many there are of each fill: its input and work are bounded by the
capacity and the fan-in, whatever the corpus. Which bin goes where is worked out
afterwards by joins with the nodes' moves, over ranges of ranks.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

CAPACITY = 1024
END_ID = 2
PART_ITEMS = 32_768
FAN_IN = 8


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, tuple]]:
    """Best-fit decreasing over classes of equal items: [(bins, fill, ((size, repeat), ...)), ...]."""
    runs: dict[int, list] = {}
    rooms: list[int] = []

    def put(room: int, n: int, held: tuple) -> None:
        if room not in runs:
            insort(rooms, room)
            runs[room] = []
        runs[room].append((n, held))

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                break
            room = rooms[at]
            n, held = runs[room].pop()
            if not runs[room]:
                del runs[room], rooms[at]
            each = room // size
            whole = min(n, left // each)
            if whole:
                put(room - each * size, whole, (*held, (size, each)))
                left -= whole * each
                n -= whole
            else:
                put(room - left * size, 1, (*held, (size, left)))
                n, left = n - 1, 0
            if n:
                put(room, n, held)
        if left:
            each = capacity // size
            whole, rest = divmod(left, each)
            if whole:
                put(capacity - each * size, whole, ((size, each),))
            if rest:
                put(capacity - rest * size, 1, ((size, rest),))
    return [(n, capacity - room, held) for room in rooms for n, held in runs[room]]


def _cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: only the first may be shorter than the capacity."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    return ([(0, head)] if head else []) + [(s, capacity) for s in range(head, n, capacity)]


def tokenised_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Cut each document's ids (the end id last) into pieces: doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""

    def run(batches):
        import zlib

        from .bpe_units import UnitEncoder

        encoder, end = UnitEncoder(tokenizer), int(end_id).to_bytes(4, "little")
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encoder.encode(text or "") + end
                for piece, (start, length) in enumerate(_cut(len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + length)]
                    for k, v in zip(out, (doc_id, piece, start, length, zlib.crc32(part), np.frombuffer(part, np.uint32).astype(np.int32) if with_ids else None), strict=True):
                        out[k].append(v)
            kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "ids": pa.list_(pa.int32())}
            yield pa.RecordBatch.from_pydict({k: pa.array(v, kinds[k]) for k, v in out.items() if with_ids or k != "ids"})

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, schema)


def _deal(runs: list, capacity: int, nearly: int, final: bool):
    """Number the runs' bins: yields (bins, fill, contents, sealed, first) — sealed bins count on over all, open ones for each fill."""
    sealed, ranks = 0, {}
    for n, fill, held in runs:
        if final or fill >= nearly:
            yield n, fill, held, True, sealed
            sealed += n
        else:
            yield n, fill, held, False, ranks.get(fill, 0)
            ranks[fill] = ranks.get(fill, 0) + n


def _pack_part(capacity: int, nearly: int):
    """Level 0: each piece gets its bin in the part (sealed number or rank among the open ones of its fill) and its offset there."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        length = t["length"].to_numpy()
        sizes, first, counts = np.unique(-length, return_index=True, return_counts=True)
        at = dict(zip((-sizes).tolist(), first.tolist(), strict=True))
        n_rows = len(length)
        fill_of, rank, offset, is_sealed = (np.zeros(n_rows, np.int64) for _ in range(4))
        for n, fill, held, sealed, base in _deal(best_fit(dict(zip((-sizes).tolist(), counts.tolist(), strict=True)), capacity), capacity, nearly, False):
            before = 0
            for size, each in held:
                own = slice(at[size], at[size] + n * each)
                j = np.arange(n * each)
                fill_of[own], rank[own], offset[own], is_sealed[own] = fill, base + j // each, before + j % each * size, sealed
                at[size] += n * each
                before += size * each
        for name, v in (("fill", fill_of), ("rank", rank), ("offset", offset), ("sealed", is_sealed)):
            t = t.append_column(name, pa.array(v))
        return t

    return run


def _merge_node(capacity: int, nearly: int, final: bool):
    """A node of the tree: counts of open bins by child and fill -> moves (kind 0) and its own open classes (kind 1)."""

    def run(t: pa.Table) -> pa.Table:
        rows = sorted(zip(t["part"].to_pylist(), t["fill"].to_pylist(), t["n"].to_pylist(), strict=True))
        node = t["node"][0].as_py()
        queues: dict[int, list] = {}
        for child, fill, n in rows:
            queues.setdefault(fill, []).append([child, 0, n])
        out = []
        for n, fill, held, sealed, base in _deal(best_fit({s: sum(x[2] for x in q) for s, q in queues.items()}, capacity), capacity, nearly, final):
            before = 0
            for size, each in held:
                j = 0
                while j < n * each:
                    head = queues[size][0]
                    take = min(head[2], n * each - j)
                    out.append((0, head[0], size, head[1], take, j, each, before, int(sealed), fill, base, node))
                    head[1], head[2], j = head[1] + take, head[2] - take, j + take
                    if not head[2]:
                        queues[size].pop(0)
                before += size * each
            if not sealed:
                out.append((1, 0, 0, 0, n, 0, 1, 0, 0, fill, base, node))
        names = ["kind", "child", "size", "from_rank", "n", "j", "each", "before", "to_sealed", "to_fill", "base", "node"]
        return pa.table({k: pa.array([r[i] for r in out], pa.int64()) for i, k in enumerate(names)})

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, part_items: int = PART_ITEMS, fan_in: int = FAN_IN) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32): few sequences of at most `capacity` tokens.

    A piece's length must be 1 to capacity. Repeated rows are separate pieces. An
    empty table gives an empty result.
    """
    nearly = capacity - capacity // 64
    pieces = materialise(pieces, "pieces")
    parts = max(1, math.ceil(pieces.count() / part_items))
    keyed = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(parts)))
    packed = materialise(keyed.groupBy("part").applyInArrow(_pack_part(capacity, nearly), keyed.schema.simpleString()[7:-1] + ", fill: bigint, rank: bigint, offset: bigint, sealed: bigint"), "packed")
    number = lambda level, node, i: F.lit(level << 58) + F.shiftleft(node, 32) + i
    own = pieces.columns
    done = [packed.filter("sealed = 1").select(*own, number(0, F.col("part"), F.col("rank")).alias("sequence_id"), "offset")]
    items = packed.filter("sealed = 0").select(*own, "part", "fill", "rank", "offset")
    # Underfull bins: each counts once, through the piece at its start.
    classes = items.filter("offset = 0").groupBy("part", "fill").agg(F.count("*").alias("n"))
    level, nodes = 0, parts
    move = "kind long, child long, size long, from_rank long, n long, j long, each long, before long, to_sealed long, to_fill long, base long, node long"
    while True:
        level, nodes = level + 1, math.ceil(nodes / fan_in)
        asked = classes.withColumn("node", F.floor(F.col("part") / fan_in))
        moves = materialise(asked.groupBy("node").applyInArrow(_merge_node(capacity, nearly, nodes == 1), move), "moves")
        k = F.col("j") + F.col("rank") - F.col("from_rank")
        m = moves.filter("kind = 0").drop("kind")
        placed = items.join(m, (F.col("part") == F.col("child")) & (F.col("fill") == F.col("size")) & (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("from_rank") + F.col("n")))
        placed = placed.select(*own, F.col("node").alias("to_part"), "to_fill", (F.col("base") + F.floor(k / F.col("each"))).alias("to_rank"), (F.col("offset") + F.col("before") + k % F.col("each") * F.col("size")).alias("to_offset"), "to_sealed")
        done.append(placed.filter("to_sealed = 1").select(*own, number(level, F.col("to_part"), F.col("to_rank")).alias("sequence_id"), F.col("to_offset").alias("offset")))
        if nodes == 1:
            break
        items = placed.filter("to_sealed = 0").select(*own, F.col("to_part").alias("part"), F.col("to_fill").alias("fill"), F.col("to_rank").alias("rank"), F.col("to_offset").alias("offset"))
        classes = moves.filter("kind = 1").groupBy(F.col("node").alias("part"), F.col("to_fill").alias("fill")).agg(F.sum("n").alias("n"))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Tokenise and pack documents; one row per piece with its place. A null text counts as empty: it holds the end id alone."""
    return pack(tokenised_pieces(docs, tokenizer, id_col, text_col, capacity, end_id, with_ids), capacity)
