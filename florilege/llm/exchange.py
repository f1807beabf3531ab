"""Shards of documents, and questions about keys that shards ask of key ranges.

A shard is one row with the compressed texts of some documents, cut from the
scan as it comes. Shards are stored once, bucketed by their number, so that
answers can be brought to them without moving the texts again.

Keys (64-bit hashes) travel as blobs: each shard sorts its distinct keys and
sends one compressed blob to every key range; a range's task sees each key at
most once for each shard, whatever the key's frequency, and its answers go back
in the blob's order, without the keys.
"""

from __future__ import annotations

import ctypes
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_table

SHARD_BYTES = 16 << 20
RANGE_BYTES = 16 << 20  # of text for each key range
NO_ID = np.iinfo(np.int64).max  # stands for a null id
BLOB = "kind int, shard long, part long, blob binary"

def packed(*arrays: np.ndarray) -> bytes:
    """Arrays, bytes of equal weight together, compressed; what unpacked() gives back."""
    head, body = [], []
    for a in arrays:
        a = np.ascontiguousarray(a)
        head.append(f"{a.dtype.str}:{len(a)}")
        body.append(a.view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b"")
    return zstandard.ZstdCompressor(level=1).compress(",".join(head).encode() + b"\n" + b"".join(body))


def unpacked(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    head, _, body = raw.partition(b"\n")
    out, at = [], 0
    for part in head.decode().split(","):
        kind, n = part.split(":")
        kind, n = np.dtype(kind), int(n)
        planes = np.frombuffer(body, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += n * kind.itemsize
    return out


def packed_keys(keys: np.ndarray, *values: np.ndarray) -> bytes:
    """Sorted uint64 keys, as differences, and values beside them."""
    return packed(np.diff(keys, prepend=np.uint64(0)), *values)


def unpacked_keys(blob: bytes) -> list[np.ndarray]:
    keys, *values = unpacked(blob)
    return [np.cumsum(keys, dtype=np.uint64), *values]


def narrow(a: np.ndarray) -> np.ndarray:
    """Non-negative integers in the least width that holds them."""
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def ranges_for(shards: DataFrame) -> int:
    """How many key ranges the texts of stored shards ask for, by their real size."""
    return max(1, math.ceil((shards.agg(F.sum("size")).first()[0] or 0) / RANGE_BYTES))


def trim() -> None:
    """Give memory that a group has freed back to the system: a worker handles one group after another, and its peak would be the sum of what allocators keep."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def cut_points(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where the sorted keys' ranges begin: parts + 1 places."""
    edges = np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]]).astype(np.int64)


def blobs(kind: int, shard: int, keys: np.ndarray, values: list[np.ndarray], parts: int):
    """Rows of BLOB for sorted keys, one for each range that has any."""
    cuts = cut_points(keys, parts)
    for p in np.flatnonzero(np.diff(cuts)).tolist():
        own = slice(cuts[p], cuts[p + 1])
        yield kind, shard, p, packed_keys(keys[own], *(v[own] for v in values))


def blob_batches(rows):
    """Record batches of BLOB from rows, some MB each."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[3])
        if size > 8 << 20:
            yield _blob_batch(held)
            held, size = [], 0
    if held:
        yield _blob_batch(held)


def _blob_batch(rows) -> pa.RecordBatch:
    kinds = (("kind", pa.int32()), ("shard", pa.int64()), ("part", pa.int64()), ("blob", pa.binary()))
    return pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(kinds)})


def shard_table(docs: DataFrame, label: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Store docs (doc_id, text) as shards: shard, size (bytes of text), docs binary. A null text counts as empty."""

    def run(batches):
        part, seq, ids, texts, size = TaskContext.get().partitionId(), 0, [], [], 0

        def row():
            nonlocal seq, ids, texts, size
            sizes = np.array([len(t) for t in texts], np.int64)
            blob = zstandard.ZstdCompressor(level=3).compress(np.int64(len(ids)).tobytes() + np.array(ids, np.int64).tobytes() + sizes.tobytes() + b"".join(texts))
            out = pa.RecordBatch.from_pydict({"shard": pa.array([part << 24 | seq], pa.int64()), "size": pa.array([size], pa.int64()), "docs": pa.array([blob], pa.binary())})
            seq, ids, texts, size = seq + 1, [], [], 0
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                raw = text.as_buffer() if text.is_valid else None
                ids.append(doc_id.as_py() if doc_id.is_valid else NO_ID)
                texts.append(raw.to_pybytes() if raw is not None else b"")
                size += len(texts[-1])
                if size >= shard_bytes:
                    yield row()
        if ids:
            yield row()

    spark = docs.sparkSession
    name = f"florilege_{label}_{uuid.uuid4().hex}"
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)
    docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, "shard long, size long, docs binary").write.format("parquet").option("compression", "none").bucketBy(buckets, "shard").saveAsTable(name)
    return keep_table(spark, name)


def shard_docs(blob: bytes) -> tuple[np.ndarray, list[bytes]]:
    """(ids, UTF-8 texts) of a shard."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    ids, sizes = np.frombuffer(raw, np.int64, n, 8), np.frombuffer(raw, np.int64, n, 8 + 8 * n)
    ends = np.cumsum(sizes) + 8 + 16 * n
    return ids, [raw[e - s : e] for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)]


def ask(shards: DataFrame, answers: DataFrame | None, question) -> DataFrame:
    """Rows of BLOB from each shard; question(shard, ids, texts, answers) yields them. answers: {kind: {part: blob}}."""
    if answers is None:

        def first(batches):
            for batch in batches:
                for shard, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    yield from blob_batches(question(shard, *shard_docs(blob.as_py()), {}))
                    trim()

        return shards.select("shard", "docs").mapInArrow(first, BLOB)
    return _with_answers(shards, answers, lambda *a: blob_batches(question(*a)), BLOB)


def finish(shards: DataFrame, answers: DataFrame, fn, schema: str) -> DataFrame:
    """What fn(shard, ids, texts, answers) yields as record batches for each shard."""
    return _with_answers(shards, answers, fn, schema)


def _with_answers(shards: DataFrame, answers: DataFrame, fn, schema: str) -> DataFrame:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        got: dict[int, dict[int, bytes]] = {}
        for k, p, b in zip(right["kind"].to_pylist(), right["part"].to_pylist(), right["blob"], strict=True):
            got.setdefault(k, {})[p] = b.as_py()
        out = [pa.Table.from_batches([b]) for s, d in zip(left["shard"].to_pylist(), left["docs"], strict=True) for b in fn(s, *shard_docs(d.as_py()), got)]
        trim()
        return pa.concat_tables(out) if out else empty

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    empty = to_arrow_schema(_parse_datatype_string(schema)).empty_table()
    return shards.select("shard", "docs").groupBy("shard").cogroup(answers.select("shard", "kind", "part", "blob").groupBy("shard")).applyInArrow(run, schema)


def answer(asked: DataFrame, fn) -> DataFrame:
    """Rows of BLOB from each key range of each kind; fn(kind, part, [(shard, blob)]) yields them, and they leave as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, kind, part = [], None, None
        for b in batches:
            kind, part = b.column("kind")[0].as_py(), b.column("part")[0].as_py()
            pairs += zip(b.column("shard").to_pylist(), (x.as_py() for x in b.column("blob")), strict=True)
        pairs.sort(key=lambda x: x[0])
        yield from blob_batches(fn(kind, part, pairs))
        trim()

    return asked.groupBy("kind", "part").applyInArrow(run, BLOB)
