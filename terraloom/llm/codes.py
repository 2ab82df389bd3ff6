"""Vectors as short codes: integer k-means per part, with norm-of-sum bounds.

Every vector is cut into equal parts, and each part position has a codebook.
A round assigns every part to its nearest entry and moves each entry to the
floor of the mean of its parts. All codebooks of earlier rounds are kept.

A part keeps an upper bound (distance to its entry) and a lower bound
(distance to the second nearest), each with the stamp of the round in which it
was exact. Between that round and now an entry moved by the norm of the sum of
its steps, which is its true net displacement and at most the sum of the norms
of the steps. Only when the bounds, widened by that, overlap, the upper one is
made exact, and only when they still overlap all entries are scanned. Bounds
are rounded outwards, all distances that decide are exact integers.

Vectors are packed once into blocks, without a shuffle. A round rewrites the
blocks with their bounds and the sums of their parts; the driver holds the
codebooks only (parts x entries vectors a round).

Defined cases: null vectors and vectors with null or non-finite components go;
vectors of another length than the most common one (the shorter of equals),
or all where it can't be cut into equal parts, stay with null code and error;
null ids come last among the first entries; repeated rows are vectors of their
own; components stop at +-LIMIT; fewer vectors than entries make fewer
entries; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import Successive, cut, cut_with, sized
from .batches import ship

BLOCK = 2048
# Components beyond this are cut to it, so that errors fit 64 bits.
LIMIT = 1 << 26
# Integers in doubles are exact below this.
EXACT = float(2**53)
_BOUND = np.float32


@dataclass
class Coded:
    """``rows``: vec_id, label, codes, error; ``history``: codebooks by round,
    each (part, entry, position); ``scans``: parts scanned over all entries
    and all parts, by round."""

    rows: DataFrame
    history: list[np.ndarray]
    scans: list[tuple[int, int]]


def quantise(vectors: DataFrame, scale: int, vec_id: str, embedding: str, label: str) -> DataFrame:
    """vec_id, label, q: floor(scale * x) of every component of usable vectors."""
    x = F.col(f"`{embedding}`").cast("array<double>")
    good = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    held = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{label}`").alias("label"), x.alias("x")).where(good)
    most = float(LIMIT)
    return held.select("vec_id", "label", F.transform(
        "x", lambda v: F.floor(F.greatest(F.least(v * scale, F.lit(most)), F.lit(-most))).cast("int")).alias("q"))


def _blocks(q: DataFrame, entries: int) -> DataFrame:
    """Rows of one length packed as they come, with their smallest ids."""
    kinds = {c: q.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    schema = (f"width int, n int, ids array<{kinds['vec_id']}>, labels array<{kinds['label']}>, x binary, "
              f"heads array<struct<vec_id: {kinds['vec_id']}, q: array<int>>>")

    def one(ids: pa.Array, labels: pa.Array, x: np.ndarray) -> pa.RecordBatch:
        n, width = x.shape
        offsets = pa.array([0, n], pa.int32())
        order = sorted(range(n), key=lambda i: (not ids[i].is_valid, ids[i].as_py() if ids[i].is_valid else 0, x[i].tolist()))[:entries]
        heads = [{"vec_id": ids[i].as_py(), "q": x[i].tolist()} for i in order]
        small = x.astype(np.int16) if n and width and np.abs(x).max() < 1 << 15 else x.astype(np.int32)
        return pa.RecordBatch.from_arrays([
            pa.array([width], pa.int32()), pa.array([n], pa.int32()), pa.ListArray.from_arrays(offsets, ids),
            pa.ListArray.from_arrays(offsets, labels), pa.array([np.ascontiguousarray(small).tobytes()], pa.binary()),
            pa.array([heads], pa.list_(pa.struct([("vec_id", ids.type), ("q", pa.list_(pa.int32()))]))),
        ], ["width", "n", "ids", "labels", "x", "heads"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def flush(width: int) -> pa.RecordBatch:
            ids, labels, x = zip(*held.pop(width), strict=True)
            return one(pa.concat_arrays(ids), pa.concat_arrays(labels), np.concatenate(x))

        for b in batches:
            sizes = b.column("q").value_lengths().to_numpy(zero_copy_only=False)
            for width in np.unique(sizes).tolist():
                some = b.filter(pa.array(sizes == width))
                x = some.column("q").flatten().to_numpy(zero_copy_only=False).reshape(-1, width) if width else np.zeros((some.num_rows, 0), np.int32)
                for at in range(0, len(x), BLOCK):
                    part = held.setdefault(width, [])
                    part.append((some.column("vec_id").slice(at, BLOCK), some.column("label").slice(at, BLOCK), x[at : at + BLOCK]))
                    if sum(len(p[2]) for p in part) >= BLOCK:
                        yield flush(width)
        for width in list(held):
            yield flush(width)

    return q.mapInArrow(run, schema)


def net_moves(history: list[np.ndarray], part: int) -> tuple[np.ndarray, np.ndarray]:
    """By stamp and entry: how far the entry has moved since, and how far the
    entry that moved most among all others."""
    now = history[-1][part].astype(float)
    moved = np.stack([np.sqrt(((c[part].astype(float) - now) ** 2).sum(-1)) for c in history])
    if moved.shape[1] == 1:
        return moved, np.zeros_like(moved)
    order = np.argsort(-moved, axis=1)[:, :2]
    first, second = (np.take_along_axis(moved, order[:, k : k + 1], 1) for k in (0, 1))
    return moved, np.where(np.arange(moved.shape[1]) == order[:, :1], second, first)


class Bounds:
    """Assignment and bounds of the parts of one block: all (row, part)."""

    FIELDS = (("near", np.uint8), ("upper", _BOUND), ("upper_at", np.uint8), ("lower", _BOUND), ("lower_at", np.uint8))

    def __init__(self, n: int, parts: int, raw: dict[str, bytes] | None = None):
        self.fresh = raw is None
        for name, kind in self.FIELDS:
            have = np.zeros((n, parts), kind) if raw is None else np.frombuffer(raw[name], kind).reshape(n, parts).copy()
            setattr(self, name, have)

    def raw(self) -> dict[str, bytes]:
        return {name: getattr(self, name).tobytes() for name, _ in self.FIELDS}


def _distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to all entries."""
    return (x * x).sum(1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(1)[None, :]


def assign(x: np.ndarray, history: list[np.ndarray], b: Bounds, net: bool = True) -> int:
    """Bring ``b`` to the newest codebooks; how many parts were scanned.

    ``x`` is (row, part, position). ``net=False`` widens bounds by the sum of
    all steps instead, for comparison.
    """
    t, now = len(history) - 1, history[-1]
    n, parts, width = x.shape
    most = max(float(np.abs(x).max(initial=0)), float(np.abs(now).max(initial=0)))
    kind = np.float64 if 4 * most * most * max(width, 1) < EXACT else object
    scanned = 0
    for p in range(parts):
        part, entries = x[:, p].astype(kind), now[p].astype(kind)
        todo = np.arange(n)
        if not b.fresh:
            near = b.near[:, p]
            if net:
                moved, others = net_moves(history, p)
            else:
                steps = [net_moves(history[k : k + 2], p) for k in range(t)]
                moved, others = (np.stack([sum((s[i][0] for s in steps[k:]), np.zeros(len(entries))) for k in range(t + 1)]) for i in (0, 1))
            high = (b.upper[:, p] + moved[b.upper_at[:, p], near]) * (1 + 1e-6)
            low = (b.lower[:, p] - others[b.lower_at[:, p], near]) * (1 - 1e-6)
            todo = np.flatnonzero(~(high < low))
            mine = part[todo] - entries[near[todo]]
            exact = np.sqrt((mine * mine).sum(1).astype(float))
            b.upper[todo, p] = np.nextafter(exact.astype(_BOUND), _BOUND(np.inf))
            b.upper_at[todo, p] = t
            todo = todo[~(exact * (1 + 1e-6) < low[todo])]
        if not len(todo):
            continue
        scanned += len(todo)
        d = _distances(part[todo], entries)
        best = d.argmin(1)
        mine = np.take_along_axis(d, best[:, None], 1)[:, 0]
        b.near[todo, p] = best
        b.upper[todo, p] = np.nextafter(np.sqrt(mine.astype(float)).astype(_BOUND), _BOUND(np.inf))
        if len(entries) > 1:
            np.put_along_axis(d, best[:, None], np.inf if kind is np.float64 else 1 << 80, 1)
            second = np.sqrt(d.min(1).astype(float)).astype(_BOUND)
            b.lower[todo, p] = np.maximum(np.nextafter(second, _BOUND(0)), 0)
        else:
            b.lower[todo, p] = np.inf
        b.upper_at[todo, p] = b.lower_at[todo, p] = t
    b.fresh = False
    return scanned


def _sums(x: np.ndarray, near: np.ndarray, entries: int) -> np.ndarray:
    """By part: sums of every entry's parts, then how many there are."""
    parts = []
    for p in range(x.shape[1]):
        order = np.argsort(near[:, p], kind="stable")
        sizes = np.bincount(near[:, p], minlength=entries)
        total = np.concatenate([np.zeros((1, x.shape[2]), np.int64), np.cumsum(x[order, p].astype(np.int64), axis=0)])
        ends = np.cumsum(sizes)
        parts.append(np.concatenate([total[ends] - total[ends - sizes], sizes[:, None]], axis=1))
    return np.stack(parts)


def _unpack(row: dict, parts: int) -> np.ndarray:
    kind = np.int16 if len(row["x"]) == 2 * row["n"] * row["width"] else np.int32
    return np.frombuffer(row["x"], kind).reshape(row["n"], parts, -1)


def _round(blocks: DataFrame, history: list[np.ndarray], parts: int) -> DataFrame:
    """Blocks with bounds brought up to ``history``, and the sums they give."""
    names = [name for name, _ in Bounds.FIELDS]
    base = ["width", "n", "ids", "labels", "x"]
    first = "near" not in blocks.columns
    schema = T.StructType([*[blocks.schema[c] for c in base], *[T.StructField(c, T.BinaryType()) for c in names],
                           T.StructField("sums", T.ArrayType(T.LongType())), T.StructField("scanned", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in ["width", "n", "x", *([] if first else names)]}
                x = _unpack(row, parts)
                b = Bounds(row["n"], parts, None if first else row)
                scanned = assign(x, history, b)
                raw, sums = b.raw(), _sums(x, b.near, history[-1].shape[1])
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(k, 1) for c in base], *[pa.array([raw[c]], pa.binary()) for c in names],
                     pa.array([sums.ravel().tolist()], pa.list_(pa.int64())), pa.array([scanned], pa.int64())],
                    [f.name for f in schema.fields])

    return blocks.select(*base, *([] if first else names)).mapInArrow(run, schema)


def _totals(blocks: DataFrame, shape: tuple) -> tuple[np.ndarray, int]:
    """Sums of all blocks: added within each task, then by position."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, scanned = None, 0
        for b in batches:
            if b.num_rows:
                rows = b.column("sums").flatten().to_numpy().reshape(b.num_rows, -1).sum(0)
                total = rows if total is None else total + rows
                scanned += int(b.column("scanned").to_numpy().sum())
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([[*total.tolist(), scanned]], pa.list_(pa.int64()))], ["sums"])

    added = blocks.select("sums", "scanned").mapInArrow(run, "sums array<long>")
    rows = added.select(F.posexplode("sums").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect()
    flat = np.array([r["v"] for r in rows], np.int64)
    return flat[:-1].reshape(shape), int(flat[-1])


def _coded(blocks: DataFrame, history: list[np.ndarray], parts: int) -> DataFrame:
    """vec_id, label, codes and error of every row by the newest codebooks."""
    names = [name for name, _ in Bounds.FIELDS]
    kinds = {c: blocks.schema[c].dataType.elementType.simpleString() for c in ("ids", "labels")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in ["width", "n", "x", *names]}
                x, b = _unpack(row, parts), Bounds(row["n"], parts, row)
                scanned = assign(x, history, b)
                error = np.zeros(row["n"], np.int64)
                for p in range(parts):
                    d = x[:, p].astype(np.int64) - history[-1][p][b.near[:, p]]
                    error += (d * d).sum(1)
                where = np.zeros(row["n"], np.int64)
                where[:1] = scanned
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ids").slice(k, 1).flatten(), batch.column("labels").slice(k, 1).flatten(),
                     pa.array([c.tobytes() for c in b.near], pa.binary()), pa.array(error), pa.array(where)],
                    ["vec_id", "label", "codes", "error", "scanned"])

    return blocks.select("width", "n", "ids", "labels", "x", *names).mapInArrow(
        run, f"vec_id {kinds['ids']}, label {kinds['labels']}, codes binary, error long, scanned long")


def fit(
    vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096,
    vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
) -> Coded:
    """Codebooks after ``rounds`` rounds and every vector's codes by them.

    The first entries are the parts of the vectors with the smallest ids.
    ``entries`` and the rounds fit one byte each.
    """
    if not (0 < entries <= 256 and 0 <= rounds < 255):
        raise ValueError("codes and stamps are bytes")
    spark = vectors.sparkSession
    ship(spark)
    packed = cut(_blocks(quantise(vectors, scale, vec_id, embedding, label), entries))
    size = packed.groupBy("width").agg(F.sum("n").alias("rows")).orderBy(F.desc("rows"), "width").first()
    width = size["width"] if size else 0
    can = bool(size) and width % parts == 0
    used = packed.where((F.col("width") == width) & F.lit(can))
    none = F.lit(None)
    left = packed.where((F.col("width") != width) | ~F.lit(can)).select(F.explode(F.arrays_zip("ids", "labels")).alias("r")).select(
        F.col("r.ids").alias("vec_id"), F.col("r.labels").alias("label"), none.cast("binary").alias("codes"), none.cast("long").alias("error"))
    if not can:
        return Coded(left, [], [])
    heads = used.select(F.inline("heads")).orderBy(F.isnull("vec_id"), "vec_id", "q").limit(entries).collect()
    first = np.array([r["q"] for r in heads], np.int64).reshape(len(heads), parts, -1).transpose(1, 0, 2)
    history, scans, loop = [np.ascontiguousarray(first)], [], Successive(spark)
    shape = (parts, len(heads), first.shape[2] + 1)
    blocks = used
    for _ in range(rounds):
        blocks = loop.put(_round(blocks, history, parts))
        sums, scanned = _totals(blocks, shape)
        n = sums[:, :, -1:]
        history.append(np.where(n > 0, sums[:, :, :-1] // np.maximum(n, 1), history[-1]))
        scans.append((scanned, int(n.sum())))
    if not rounds:
        blocks = loop.put(_round(blocks, history, parts))
    rows, seen = cut_with(_coded(blocks, history, parts), scanned=F.sum("scanned"))
    scans.append((seen["scanned"] or 0, seen["rows"] * parts))
    return Coded(rows.drop("scanned").unionByName(left), history, scans)


def codebooks_digest(codebooks: np.ndarray | None) -> str:
    """Digest of all components by part, entry and position."""
    flat = [] if codebooks is None else codebooks.ravel().tolist()
    return hashlib.sha256(",".join(map(str, flat)).encode()).hexdigest()


def with_label_error(rows: DataFrame) -> DataFrame:
    """``rows`` with the sum of errors over equal labels, nulls together."""
    sums, seen = cut_with(rows.groupBy("label").agg(F.sum("error").alias("label_error")))
    sums = sums.withColumnRenamed("label", "_label")
    return rows.join(sized(sums, seen["rows"]), F.col("label").eqNullSafe(F.col("_label")), "left").drop("_label")
