"""Exact top-k search by inner product, block at a time.

Vectors become integers, floor(scale * x). They are dealt into blocks of similar
sign patterns; a block has a forward index (its vectors as one matrix) and, for
each component, its largest and smallest value. For a query, a block's bound is
the sum over components of the better of the two products. Blocks are taken by
falling bound, and scored through their forward index until the bound is below
the query's k-th score: what is left can't change the result, ties included.

Queries are a stated subset. Candidates are stored once, as stripes of blocks; the
queries travel to them, some at a time, as they are fewer. Queries first meet the
blocks of one stripe, which gives each a k-th score to begin with: blocks of other
stripes whose bound is below it are not scored. Each stripe gives k candidates for
each query at most, of which the k best are kept.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

BLOCK, STRIPE_BLOCKS, LEAST_BLOCKS, WAVE = 512, 128, 16, 2048  # vectors of a block, blocks of a stripe (of a small table's), queries that meet a stripe at once
NONE = -(1 << 62)  # the score of no row


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """vec_id, v array<long>, code: floor(scale * x); rows whose id is null, or whose vector is null or holds null or non-finite components, are left out. A component beyond 62 bits is an error."""
    v = F.col(vector_col)
    fine = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    whole = lambda y: F.when(F.abs(y) < 2.0**62, F.floor(y).cast("long")).otherwise(F.raise_error(F.lit("a component is too large for 64-bit scores")).cast("long"))
    ints = F.transform(v, lambda x: whole(x.cast("double") * F.lit(float(scale))))
    signs = F.aggregate(F.slice(F.col("v"), 1, 12), F.lit(0).cast("int"), lambda a, x: a * 2 + (x >= 0).cast("int"))
    return vectors.filter(F.col(id_col).cast("long").isNotNull() & fine).select(F.col(id_col).cast("long").alias("vec_id"), ints.alias("v")).withColumn("code", signs)


def _matrix(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of integers, in the least width that holds them; shorter vectors are filled with zeros, which add nothing to a product."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    sizes = col.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = col.flatten().to_numpy(zero_copy_only=False)
    top = int(max(-int(flat.min()), int(flat.max()))) if len(flat) else 0
    out = np.zeros((len(sizes), int(sizes.max()) if len(sizes) else 0), np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.int64)
    if len(flat):
        out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _products(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Exact integer products: by floating point where every sum stays below 2^53, by Python's integers where 64 bits might not do."""
    d = min(q.shape[1], m.shape[1])
    q, m = q[:, :d], m[:, :d]
    if not q.size or not m.size:
        return np.zeros((len(q), len(m)), np.int64)
    most = float(max(-int(q.min()), int(q.max()), 0)) * float(max(-int(m.min()), int(m.max()), 0)) * d
    if most < 2.0**53:
        return (q.astype(np.float64) @ m.T.astype(np.float64)).astype(np.int64)
    if most < 2.0**62:
        return q.astype(np.int64) @ m.T.astype(np.int64)
    out = q.astype(object) @ m.T.astype(object)
    if max(map(abs, out.reshape(-1))) >= 1 << 62:
        raise OverflowError("a score is too large for 64 bits")
    return out.astype(np.int64)


def search_stripe(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, m: np.ndarray, k: int, block: int = BLOCK, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, vector ids, scores): for each query the k best of a stripe, ties to smaller ids, its own row left out. floor: scores that k other rows reach; blocks that can't are left out."""
    d = min(q.shape[1], m.shape[1])
    q, m = q[:, :d], m[:, :d]
    cuts = range(0, len(m), block)
    top, low = (np.array([f(m[c : c + block], axis=0) for c in cuts]).reshape(-1, d) for f in (np.max, np.min))
    bound = _products(np.maximum(q, 0), top) + _products(np.minimum(q, 0), low)
    order = np.argsort(-bound, axis=1, kind="stable")
    best_s = np.full((len(q), k), NONE)
    best_i = np.full((len(q), k), np.iinfo(np.int64).max)
    for step in range(len(cuts)):
        at = order[:, step]
        alive = bound[np.arange(len(q)), at] >= (best_s[:, -1] if floor is None else np.maximum(best_s[:, -1], floor))
        if not alive.any():
            break
        for b in np.unique(at[alive]):
            rows = np.flatnonzero(alive & (at == b))
            own = slice(b * block, (b + 1) * block)
            s = _products(q[rows], m[own])
            i = np.broadcast_to(ids[own], s.shape)
            s = np.where(i == q_ids[rows, None], NONE, s)
            i = np.where(s == NONE, np.iinfo(np.int64).max, i)
            if s.shape[1] > 4 * k:
                # Only what reaches the block's own k-th score can be among the best; ties with it stay.
                kth = np.partition(s, -k, axis=1)[:, -k]
                width = int((s >= kth[:, None]).sum(1).max())
                top = np.argpartition(-s, width - 1, axis=1)[:, :width]
                s, i = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)
            s, i = np.hstack([best_s[rows], s]), np.hstack([best_i[rows], i])
            pick = np.lexsort((i, -s), axis=1)[:, :k]
            best_s[rows], best_i[rows] = np.take_along_axis(s, pick, 1), np.take_along_axis(i, pick, 1)
    r, c = np.nonzero(best_i != np.iinfo(np.int64).max)
    return q_ids[r], best_i[r, c], best_s[r, c]


def top_k(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each row that is_query (a condition on vec_id) holds for.

    Rows with a null id, and vectors that are null or hold null or non-finite components, take no part.
    Equal scores rank by vec_id. Vectors of different lengths are compared over the shorter one. Equal
    rows count once; different rows that share an id are candidates of their own, none of them for a
    query with that id, and as queries they share its ranks. A score beyond 62 bits is an error.
    """
    spark = vectors.sparkSession
    rows = quantised(vectors, id_col, vector_col, scale)
    n = rows.count()
    stripes = max(1, math.ceil(n / (BLOCK * STRIPE_BLOCKS)), min(spark.sparkContext.defaultParallelism, math.ceil(n / (BLOCK * LEAST_BLOCKS))))
    waves = max(1, math.ceil(rows.filter(is_query).count() / WAVE))
    # Stripes are dealt by a hash of the id, so that vectors that are alike are spread; a stripe's blocks are ranges of the sign code.
    packed = rows.withColumn("stripe", F.pmod(F.xxhash64("vec_id"), F.lit(stripes))).groupBy("stripe").applyInArrow(_packed("stripe"), PACKED)
    packed = materialise(packed, "stripes")
    asked = rows.filter(is_query).withColumn("wave", F.pmod(F.xxhash64("vec_id"), F.lit(waves))).groupBy("wave").applyInArrow(_packed("wave"), PACKED)
    asked = materialise(asked.withColumnRenamed("part", "wave"), "queries")

    def meet(queries: DataFrame, candidates: DataFrame, low: int, high: int) -> DataFrame:
        """What the queries find in the stripes from low to high: a stated query set against all rows."""
        sent = queries.withColumn("part", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn("part", F.col("part").cast("long"))

        def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            out = []
            for c in left.to_pylist() if len(right) else ():
                ids, m = np.frombuffer(c["ids"], np.int64), np.frombuffer(c["m"], c["kind"]).reshape(-1, c["width"])
                for r in right.to_pylist():
                    q_ids, q = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["m"], r["kind"]).reshape(-1, r["width"])
                    floor = np.frombuffer(r["floor"], np.int64) if r["floor"] is not None else None
                    out.append(search_stripe(q_ids, q, ids, m, k, floor=floor))
            a, b, s = (np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64) for i in range(3))
            return pa.table({"query_id": a, "vec_id": b, "score": s, "wave": np.full(len(a), key[1].as_py(), np.int64)})

        # A stripe goes to each wave's task; a wave is bounded, and stripes are.
        several = candidates.withColumn("wave", F.explode(F.sequence(F.lit(0), F.lit(waves - 1)))).withColumn("wave", F.col("wave").cast("long"))
        columns = ("part", "wave", "ids", "m", "width", "kind")
        return several.select(*columns).groupBy("part", "wave").cogroup(sent.select(*columns, "floor").groupBy("part", "wave")).applyInArrow(run, "query_id long, vec_id long, score long, wave long")

    first = materialise(meet(asked.withColumn("floor", F.lit(None).cast("binary")), packed.filter("part = 0"), 0, 0).dropDuplicates(["query_id", "vec_id", "score"]), "first")
    found = first
    if stripes > 1:
        reached = first.groupBy("wave", "query_id").agg(F.count("*").alias("n"), F.min("score").alias("kth")).withColumn("kth", F.when(F.col("n") >= k, F.col("kth")))
        floors = reached.groupBy("wave").agg(F.collect_list(F.struct("query_id", F.coalesce("kth", F.lit(NONE)).alias("kth"))).alias("f"))

        def floored(batches):
            for batch in batches:
                out = []
                for ids, f in zip(batch.column("ids"), batch.column("f").to_pylist(), strict=True):
                    kth = {x["query_id"]: x["kth"] for x in f or ()}
                    out.append(np.array([kth.get(i, NONE) for i in np.frombuffer(ids.as_py(), np.int64).tolist()], np.int64).tobytes())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("wave", "ids", "m", "width", "kind")), pa.array(out, pa.binary())], ["wave", "ids", "m", "width", "kind", "floor"])

        informed = asked.join(floors, "wave", "left").select("wave", "ids", "m", "width", "kind", "f").mapInArrow(floored, "wave long, ids binary, m binary, width long, kind string, floor binary")
        found = first.unionByName(meet(informed, packed.filter("part > 0"), 1, stripes - 1))
    # Queries that share an id may find the same; each pair counts once.
    pairs = found.groupBy("query_id", "vec_id", "score").agg(F.max("wave").alias("wave"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


PACKED = "part long, ids binary, m binary, width long, kind string"


def _packed(key: str):
    """A group's vectors as one row: ids and a matrix, by sign code."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("code", "ascending"), ("vec_id", "ascending")])
        ids, m = t["vec_id"].to_numpy(), _matrix(t["v"])
        if len(np.unique(ids)) < len(ids):
            # Equal rows count once; they come to the same group.
            first = {(i, m[r].tobytes()): r for r, i in reversed(list(enumerate(ids.tolist())))}
            keep = sorted(first.values())
            ids, m = ids[keep], m[keep]
        return pa.table({"part": pa.array([t[key][0].as_py()], pa.int64()), "ids": pa.array([ids.tobytes()]), "m": pa.array([m.tobytes()]), "width": pa.array([m.shape[1]], pa.int64()), "kind": pa.array([m.dtype.str])})

    return run
