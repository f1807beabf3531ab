"""Chunking and map-reduce over pluggable models: summarisers and embedders.

A model is a Python function over a list of texts; Spark calls it in Arrow
batches. Stand-ins that need no network are here: a summariser that takes a
text's first sentences, and an embedder of hashed words.
"""

from __future__ import annotations

import math
import re
import time
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import plain
from ..functions import text as T

Summariser = Callable[[list[str], int], list[str]]
Embedder = Callable[[list[str]], list[list[float]]]
_SEGMENT, _UNIT = re.compile(T.SEGMENT), re.compile(r"[^\W_]+|[^\s]", re.U)


def lead_summary(texts: list[str], n: int) -> list[str]:
    """Each text's first n sentences."""
    return [" ".join(t[a:b] for a, b in plain.sentence_ranges(t)[:n]) for t in texts]


def hashed_embedding(texts: list[str], dims: int = 64) -> list[list[float]]:
    """Counts of hashed words that are no stop words."""
    out = []
    for t in texts:
        v = [0.0] * dims
        for w in re.findall(T.TOKEN, plain.normalize_text(t).lower()):
            if w not in P.STOP_WORDS:
                v[zlib.crc32(w.encode()) % dims] += 1.0
        out.append(v)
    return out


def retried(call: Callable, attempts: int = 3, wait: float = 2.0, sleep: Callable = time.sleep) -> Callable:
    """call, again after 2 and 4 seconds if it fails; the last failure is raised."""

    def run(*args):
        for i in range(attempts):
            try:
                return call(*args)
            except Exception:
                if i == attempts - 1:
                    raise
                sleep(wait * 2**i)

    return run


def with_fallback(first: Callable, second: Callable) -> Callable:
    """first, and where it fails, second: another source of the same summaries or embeddings."""

    def run(*args):
        try:
            return first(*args)
        except Exception:
            return second(*args)

    return run


def by_index(items: list[dict], n: int) -> list[list[float]]:
    """The vectors of a service's answer, items of index and embedding in any order, in the order of the n texts sent."""
    if sorted(x["index"] for x in items) != list(range(n)):
        raise ValueError(f"{len(items)} vectors for {n} texts")
    return [x["embedding"] for x in sorted(items, key=lambda x: x["index"])]


def estimate_tokens(text: str) -> int:
    return sum(math.ceil(len(u) / 3) if u[0].isalnum() else 1 for u in _UNIT.findall(text or ""))


def map_budget(window: int) -> dict[str, int]:
    """Tokens of a window for the prompt's reserve, the input and the output."""
    reserve = max(128, min(512, window // 2))
    return {"reserve": reserve, "input": max(1, window - reserve), "output": max(32, min(400, reserve - 80))}


def _packed(parts: list[str], limit: int, oversize: Callable[[str], list[str]]) -> list[str]:
    """Join neighbours while they stay within the limit; a part beyond it goes through oversize."""
    out, held, n = [], "", 0
    for p in parts:
        t = estimate_tokens(p)
        if t > limit or held and n + t > limit:
            out.append(held.strip())
            held, n = "", 0
        if t > limit:
            out += oversize(p)
        else:
            held, n = held + p, n + t
    return [c for c in [*out, held.strip()] if c]


def split_by_tokens(text: str, limit: int) -> list[str]:
    """Chunks of segments within `limit` tokens; longer segments are cut between words, and longer words every 2 x limit characters."""
    cut = lambda u: [u[i : i + 2 * limit] for i in range(0, len(u), 2 * limit)]
    return _packed(_SEGMENT.findall(text or ""), limit, lambda s: _packed(re.findall(r"\S+\s*", s), limit, cut))


def split_by_sentences(text: str, n: int) -> list[str]:
    s = _SEGMENT.findall(text or "")
    return [c for i in range(0, len(s), n) if (c := " ".join(s[i : i + n]).strip())]


def chunks_by_tokens(docs: DataFrame, limit: int, text_col: str = "text") -> DataFrame:
    """doc_id, chunk_no, chunk, tokens."""

    def run(batches):
        for batch in batches:
            rows = [(d, i, c, estimate_tokens(c)) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, c in enumerate(split_by_tokens(t or "", limit))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int32(), pa.string(), pa.int64()))], ["doc_id", "chunk_no", "chunk", "tokens"])

    return docs.select(F.col("doc_id").cast("long"), text_col).mapInArrow(run, "doc_id long, chunk_no int, chunk string, tokens long")


def embeddings(texts: DataFrame, embed: Embedder = hashed_embedding, text_col: str = "text") -> DataFrame:
    """Add embedding; the model must give one vector for each text of a batch."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema)

    def run(batches):
        for batch in batches:
            given = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            got = embed([t or "" for t in given])
            if len(got) != len(given):
                raise ValueError(f"{len(got)} vectors for {len(given)} texts")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.list_(pa.float64()))], [*batch.schema.names, "embedding"])

    return texts.mapInArrow(run, f"{fields}, embedding array<double>")


def _summarised(parts: DataFrame, model: Summariser) -> DataFrame:
    """doc_id, part_no, n and chunk -> the chunk's summary of n sentences."""

    def run(batches):
        for batch in batches:
            n, texts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            out = [""] * len(n)
            for size in set(n):
                rows = [i for i, x in enumerate(n) if x == size]
                for i, s in zip(rows, model([texts[i] for i in rows], size), strict=True):
                    out[i] = s
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.string())], ["doc_id", "part_no", "n", "chunk"])

    return parts.select(F.col("doc_id").cast("long"), F.col("part_no").cast("int"), F.col("n").cast("int"), "chunk").mapInArrow(run, "doc_id long, part_no int, n int, chunk string")


def _joined(parts: DataFrame, by: str) -> DataFrame:
    p = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("part_no", "chunk"))).alias("p"))
    return p.select("doc_id", F.array_join("p.chunk", by).alias("text"))


def summarise(docs: DataFrame, n: int = 10, model: Summariser = lead_summary, map_reduce: bool = False, chunk_sentences: int = 10, rounds: int = 8, strict: bool = False, most: int | None = None, keep: Callable[[DataFrame], DataFrame] = DataFrame.persist) -> DataFrame:
    """doc_id, text: a summary of n sentences of each document.

    With map_reduce, chunks of chunk_sentences are summarised side by side, and
    their summaries again in chunks of 2n while there are several, `rounds` times at most;
    what is in several parts then is returned as it is, or if strict is an error (as for a
    remote model, which has 16 rounds). most: characters of a text that the model gets (a
    remote one gets 128,000). keep: caches a round's summaries, which the next rounds read;
    whoever passes it can release them.
    """
    whole = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if most is not None:
        whole = whole.select("doc_id", F.substring("text", 1, most).alias("text"))
    if not map_reduce:
        return _summarised(whole.select("doc_id", F.lit(0).alias("part_no"), F.lit(n).alias("n"), F.col("text").alias("chunk")), model).select("doc_id", F.col("chunk").alias("text"))
    chunks = whole.select("doc_id", T.chunks_by_sentences(F.col("text"), max(2, chunk_sentences)).alias("c"))
    each = F.greatest(F.lit(1), F.ceil(F.lit(2 * n) / F.size("c")))
    mapped = _summarised(chunks.select("doc_id", each.alias("n"), F.posexplode("c").alias("part_no", "chunk")), model)
    state, done = keep(_joined(mapped, "\n")), None
    for _ in range(rounds):
        parts = state.select("doc_id", "text", T.chunks_by_sentences(F.col("text"), max(1, 2 * n)).alias("c"))
        ready = parts.filter(F.size("c") < 2).select("doc_id", "text")
        done = ready if done is None else done.unionByName(ready)
        rest = parts.filter(F.size("c") >= 2)
        if rest.isEmpty():
            return done
        state = keep(_joined(_summarised(rest.select("doc_id", F.lit(n).alias("n"), F.posexplode("c").alias("part_no", "chunk")), model), "\n\n"))
    if strict and not state.filter(F.size(T.chunks_by_sentences(F.col("text"), max(1, 2 * n))) >= 2).isEmpty():
        raise RuntimeError(f"summaries are not reduced after {rounds} rounds")
    return done.unionByName(state)
