"""Exact top-k inner products by block-at-a-time pruning.

Vectors are put into ranges of like vectors (centroids fitted on a bounded
sample; they steer speed only) and packed into blocks of ``BLOCK`` rows. A
block keeps the largest and smallest value of each dimension, its term
maxima, and its rows as a forward index. For one query the maxima sum to a
bound; blocks are scored in falling order of bounds until the next bound is
below the query's kth score, so no block that could matter is left out.

First each query meets the few ranges with its best bounds, which give its
kth score so far; then it meets only ranges whose bound still reaches that.

Defined cases: vectors that are null, of another length than the most common
kind, or hold null or non-finite components take no part; ties go to the
smaller id; repeated ids are candidates of their own, but never of a query
with the same id; fewer than k candidates are all returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import cut, sized
from .batches import ship

BLOCK = 64
RANGE_BLOCKS = 256
CHUNK = 512
# Ranges that give a query its first kth score.
FIRST_RANGES = 4
SAMPLE = 4096
CENTROIDS = 64
# Products and sums of doubles are exact below this.
EXACT = float(2**53)


def quantise(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 64) -> DataFrame:
    """vec_id, q: floor(scale * x) of every component, for usable vectors."""
    x = F.col(f"`{embedding}`").cast("array<double>")
    good = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), x.alias("x")).where(good & F.col("vec_id").isNotNull()).select(
        "vec_id", F.transform("x", lambda v: F.floor(v * scale).cast("long")).alias("q"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _centroids(q: DataFrame, seed: int = 3) -> np.ndarray:
    rows = q.orderBy(F.xxhash64("vec_id"), "vec_id", "q").limit(SAMPLE).toArrow()
    if not rows.num_rows:
        return np.zeros((1, 0))
    x = _matrix(rows.column("q").combine_chunks()).astype(float)
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(CENTROIDS, len(x)), replace=False)]
    for _ in range(6):
        near = np.argmax(x @ c.T - (c * c).sum(1) / 2, axis=1)
        c = np.stack([x[near == k].mean(0) if (near == k).any() else c[k] for k in range(len(c))])
    return c


RANGES = T.StructType([
    T.StructField("range_id", T.LongType()), T.StructField("high", T.ArrayType(T.LongType())), T.StructField("low", T.ArrayType(T.LongType())),
    T.StructField("ids", T.BinaryType()), T.StructField("rows", T.BinaryType()),
])


def build_ranges(q: DataFrame) -> DataFrame:
    """Ranges of at most ``RANGE_BLOCKS`` blocks, written once."""
    ship(q.sparkSession)
    c = _centroids(q)
    half = (c * c).sum(1) / 2

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near = np.argmax(_matrix(b.column("q")).astype(float) @ c.T - half, axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32))], [*b.schema.names, "near"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, limit = [], [], BLOCK * RANGE_BLOCKS

        def flush(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal ids, rows
            if not ids:
                return
            i, x = np.concatenate(ids), np.concatenate(rows)
            at = 0
            while len(i) - at >= limit or (final and at < len(i)):
                j = min(at + limit, len(i))
                part = np.ascontiguousarray(x[at:j])
                yield pa.RecordBatch.from_arrays([
                    pa.array([0], pa.int64()), pa.array([part.max(0).tolist()], pa.list_(pa.int64())),
                    pa.array([part.min(0).tolist()], pa.list_(pa.int64())), pa.array([i[at:j].tobytes()], pa.binary()), pa.array([part.tobytes()], pa.binary())],
                    [f.name for f in RANGES.fields])
                at = j
            ids, rows = ([i[at:]], [x[at:]]) if at < len(i) else ([], [])

        held = 0
        for b in batches:
            if b.num_rows:
                ids.append(b.column("vec_id").to_numpy())
                rows.append(_matrix(b.column("q")))
                held += b.num_rows
            if held >= limit:
                yield from flush(False)
                held = sum(map(len, ids))
        yield from flush(True)

    kinds = T.StructType([*q.schema.fields, T.StructField("near", T.IntegerType())])
    parts = max(1, int(q.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sorted_rows = q.mapInArrow(nearest, kinds).repartitionByRange(parts, "near", "vec_id").sortWithinPartitions("near", "vec_id")
    made = sorted_rows.mapInArrow(pack, RANGES)
    return cut(made.withColumn("range_id", F.monotonically_increasing_id()))


FOUND = "query_id long, vec_id long, score long"


def _score_range(query_ids, queries, floor, ids, rows, k: int):
    """Hits (query row, id, score) of a range for each query: every candidate
    at or over both the query's floor and its kth score in the range."""
    n, dim = rows.shape
    edges = np.arange(0, n, BLOCK)
    high, low = np.maximum.reduceat(rows, edges, axis=0), np.minimum.reduceat(rows, edges, axis=0)
    most = float(np.abs(rows).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(dim, 1)
    kind = np.float64 if most < EXACT else object
    rows, high, low, queries = (x.astype(kind) for x in (rows, high, low, queries))
    bounds = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
    order = np.argsort(-bounds, axis=1, kind="stable")
    out = []
    for r in range(len(queries)):
        at, kth = 0, floor[r]
        best_id, best = np.zeros(0, np.int64), np.zeros(0, kind)
        step = 2
        while at < len(order[r]) and bounds[r, order[r, at]] >= kth:
            blocks = order[r, at : at + step]
            blocks = blocks[bounds[r, blocks].astype(float) >= kth]
            place = (edges[blocks][:, None] + np.arange(BLOCK)).ravel()
            place = place[place < n]
            s = rows[place] @ queries[r]
            keep = (s >= kth) & (ids[place] != query_ids[r])
            best_id, best = np.concatenate([best_id, ids[place][keep]]), np.concatenate([best, s[keep]])
            if len(best) > k:
                top = np.lexsort((best_id, -best))[:k]
                best_id, best = best_id[top], best[top]
                kth = max(kth, best[-1])
            elif len(best) == k:
                kth = max(kth, best.min())
            at, step = at + step, step * 2
        out.append((best_id, best))
    return out


def _meet(pairs: DataFrame, k: int) -> DataFrame:
    """Rows (ids, rows of a range; q_ids, q_rows, floor of queries) to hits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, q_ids = (np.frombuffer(b.column(c)[i].as_py(), np.int64) for c in ("ids", "q_ids"))
                rows, q_rows = (np.frombuffer(b.column(c)[i].as_py(), np.int64).reshape(len(n), -1) for c, n in (("rows", ids), ("q_rows", q_ids)))
                floor = np.frombuffer(b.column("floor")[i].as_py(), np.float64)
                found = _score_range(q_ids, q_rows, floor, ids, rows, k)
                sizes = [len(x) for x, _ in found]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(q_ids, sizes), pa.int64()), pa.array(np.concatenate([x for x, _ in found]), pa.int64()),
                    pa.array([max(-(2**63), min(2**63 - 1, int(s))) for _, x in found for s in x], pa.int64())], ["query_id", "vec_id", "score"])

    return pairs.select("ids", "rows", "q_ids", "q_rows", "floor").mapInArrow(run, FOUND)


def _chunks(queries: DataFrame) -> DataFrame:
    """Queries (vec_id, q, floor, range_id) packed by range."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(ids, q, floor, where):
            return pa.RecordBatch.from_arrays([
                pa.array([where], pa.int64()), pa.array([np.asarray(ids, np.int64).tobytes()], pa.binary()),
                pa.array([np.asarray(q, np.int64).tobytes()], pa.binary()), pa.array([np.asarray(floor, np.float64).tobytes()], pa.binary())],
                ["range_id", "q_ids", "q_rows", "floor"])

        held: list = []
        for b in batches:
            for row in zip(*[b.column(c).to_pylist() for c in ("vec_id", "q", "floor", "range_id")], strict=True):
                if held and (held[0][3] != row[3] or len(held) >= CHUNK):
                    yield one(*list(zip(*held, strict=True))[:3], held[0][3])
                    held = []
                held.append(row)
        if held:
            yield one(*list(zip(*held, strict=True))[:3], held[0][3])

    parts = max(1, int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(parts))
    return queries.select("vec_id", "q", "floor", "range_id").repartition(parts, "range_id", salt).sortWithinPartitions("range_id").mapInArrow(
        pack, "range_id long, q_ids binary, q_rows binary, floor binary")


def top_k(vectors: DataFrame, every: int = 20, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all rows but the query's.

    Queries are the rows whose id is divisible by ``every``; of several rows
    with one such id the smallest vector asks.
    """
    q = cut(quantise(vectors, vec_id, embedding, scale))
    dims = q.groupBy(F.size("q").alias("d")).count().orderBy(F.desc("count"), "d").first()
    q = q.where(F.size("q") == (dims["d"] if dims else 0))
    ranges = build_ranges(q)
    queries = q.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("q").alias("q"))
    # A little over the exact bound, so that rounding never prunes.
    term = F.transform(F.arrays_zip("q", "high", "low"), lambda x: F.greatest(
        x["q"].cast("double") * x["high"], x["q"].cast("double") * x["low"]))
    bound = F.aggregate(term, F.lit(0.0), lambda a, x: a + x + F.abs(x) * 1e-12)
    summary = ranges.select("range_id", "high", "low")
    best_first = W.partitionBy("vec_id").orderBy(F.desc("bound"), "range_id")
    met = queries.crossJoin(sized(summary, summary.count())).select("vec_id", "range_id", bound.alias("bound"))
    met = cut(met.withColumn("nth", F.row_number().over(best_first)))
    none = F.lit(float("-inf"))
    first = met.where(F.col("nth") <= FIRST_RANGES).join(queries, "vec_id").withColumn("floor", none)
    hits = cut(_meet(_chunks(first).join(ranges, "range_id"), k))
    # Few hits for each query: at most k of each of its first ranges.
    ranked = hits.withColumn("nth", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    kth = ranked.where(F.col("nth") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("floor"))
    rest = met.where(F.col("nth") > FIRST_RANGES).join(kth, "vec_id", "left").withColumn("floor", F.coalesce("floor", none))
    rest = rest.where("bound >= floor").join(queries, "vec_id")
    more = _meet(_chunks(rest).join(ranges, "range_id"), k)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.unionByName(more).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
