"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of equal texts are folded first. The 64 bits are split into
partitions of correlated bits; a dynamic programme gives each partition its
own threshold so that thresholds sum to ``distance - partitions + 1`` (-1
leaves a partition out) at the least estimated candidate work. Any pair
within the distance agrees, in some partition, to within its threshold.

Buckets of more than ``BUCKET`` fingerprints are not paired. Their members go
by an exact second way instead: two fingerprints differ in at most
``2 * r`` bits exactly when a bit string lies within ``r`` bits of both, so
each member is joined to its neighbourhood and linked to the smallest member
that shares a point. That is linear in the members, and drops no link.

Defined cases: null, empty and blank texts have no words and fingerprint 0,
linked like any other; equal rows share a component; an empty table gives an
empty result.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_digest

from ..operators.network import connected_components
from ..scratch import cut, cut_with
from .batches import NON_SPACE, Words, map_texts, slices, text_bytes

SHARD_BYTES = 1 << 20
BUCKET = 32
PARTITIONS = (2, 3, 4)
# Work of making one probe row, against checking one pair in a bucket.
PROBE_WORK = 4.0


def _fingerprints(texts: pa.Array, shingle: int, seed: int) -> list:
    data, offsets = text_bytes(texts)
    out = np.zeros(len(texts), np.uint64)
    for i, j in slices(offsets, SHARD_BYTES):
        words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], NON_SPACE)
        if not len(words):
            continue
        joined, begins, ends = words.joined()
        # Last word of each shingle; a text of fewer words is one shingle.
        last = words.first[1:] - 1
        n = np.where(words.counts > 0, np.maximum(words.counts - shingle + 1, 1), 0)
        start = np.repeat(words.first[:-1] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        stop = np.minimum(start + shingle - 1, np.repeat(last, n))
        raw = b"".join([xxh64_digest(joined[a:b], seed) for a, b in zip(begins[start].tolist(), ends[stop].tolist(), strict=True)])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
        has = np.flatnonzero(n)
        ones = np.add.reduceat(bits, (np.cumsum(n) - n)[has], axis=0, dtype=np.int32)
        packed = np.packbits(2 * ones > n[has][:, None], axis=1)
        out[i + has] = np.ascontiguousarray(packed).view(">u8").ravel()
    return [pa.array(out.view(np.int64))]


def fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None, shingle: int = 3, seed: int = 42) -> DataFrame:
    """``_row`` with the kept columns and ``fp``, the fingerprint as a long."""
    keep = docs.columns if keep is None else keep
    added = T.StructType([T.StructField("fp", T.LongType())])
    out = map_texts(docs, [text], keep, lambda t: _fingerprints(t, shingle, seed), added)
    return out.select("_row", F.col("_new.fp").alias("fp"))


def bit_statistics(fps: DataFrame, column: str = "fp") -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, ones of each bit and pairwise joint ones, over all rows."""
    def count(batches):
        n, joint = 0, np.zeros((64, 64))
        for b in batches:
            raw = np.ascontiguousarray(b.column(0).to_numpy(zero_copy_only=False).astype(">i8")).view(np.uint8)
            bits = np.unpackbits(raw.reshape(-1, 8), axis=1).astype(np.float32)[:, ::-1]
            n, joint = n + len(bits), joint + bits.T @ bits
        if n:
            yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "joint": pa.array([joint.ravel().tolist()], pa.list_(pa.float64()))})

    parts = fps.select(column).mapInArrow(count, "n long, joint array<double>")
    at = F.posexplode("joint")
    sums = parts.select("n", at).groupBy("pos").agg(F.sum("n").alias("n"), F.sum("col").alias("s")).orderBy("pos").collect()
    if not sums:
        return 0, np.zeros(64), np.zeros((64, 64))
    joint = np.array([r["s"] for r in sums]).reshape(64, 64)
    return int(sums[0]["n"]), np.diag(joint).copy(), joint


def correlated_groups(n: int, ones: np.ndarray, joint: np.ndarray, groups: int) -> list[list[int]]:
    """The 64 bits in ``groups`` parts of like size, correlated bits together."""
    p = ones / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(joint / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(corr, 0)
    free, out = set(range(64)), []
    for g in range(groups):
        size = len(free) // (groups - g)
        mine = [max(sorted(free), key=lambda b: corr[b, sorted(free)].sum())]
        free.discard(mine[0])
        while len(mine) < size:
            b = max(sorted(free), key=lambda x: corr[x, mine].mean())
            mine.append(b)
            free.discard(b)
        out.append(sorted(mine))
    return out


def allocate(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """Thresholds of the least summed cost that add up to ``total``."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for used, (spent, chosen) in best.items():
            for t, c in cost.items():
                x = (spent + c, [*chosen, t])
                if used + t not in after or x < after[used + t]:
                    after[used + t] = x
        best = after
    return best[total]


def _mask(bits: list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >= 1 << 63 else m


def plan(fps: DataFrame, distance: int, column: str = "fp") -> list[tuple[list[int], int]]:
    """(bits, threshold) of the partitions to probe.

    Pairs that agree on a whole partition are counted over all rows; pairs a
    few bits apart are estimated from those and each bit's rate of agreement.
    """
    n, ones, joint = bit_statistics(fps, column)
    if n < 2:
        return [(list(range(64)), distance)]
    p = ones / n
    agree = np.maximum(p * p + (1 - p) * (1 - p), 0.5)
    choices = [(m, correlated_groups(n, ones, joint, m)) for m in PARTITIONS if m <= distance + 2]
    keys = [F.struct(F.lit(m * 10 + k).alias("p"), F.col(column).bitwiseAND(F.lit(_mask(bits))).alias("v"))
            for m, groups in choices for k, bits in enumerate(groups)]
    counts = fps.select(F.explode(F.array(*keys)).alias("x")).select("x.*").groupBy("p", "v").agg(F.count(F.lit(1)).alias("c"))
    c = F.col("c").cast("double")
    # A bucket over the limit costs its members' neighbourhoods, not its pairs.
    work = F.when(c > BUCKET, F.lit(64.0) * c).otherwise(c * (c - 1) / 2)
    same = {r["p"]: r["w"] for r in counts.groupBy("p").agg(F.sum(work).alias("w")).collect()}
    best = None
    for m, groups in choices:
        costs = []
        for k, bits in enumerate(groups):
            odds = (1 - agree[bits]) / agree[bits]
            cost = {-1: 0.0, 0: PROBE_WORK * n + same.get(m * 10 + k, 0.0)}
            near = 1.0
            for t in range(1, distance + 1):
                near += comb(len(bits), t) * float(np.mean(odds)) ** t
                cost[t] = PROBE_WORK * n * sum(comb(len(bits), x) for x in range(t + 1)) + same.get(m * 10 + k, 0.0) * near
            costs.append(cost)
        found = allocate(costs, distance - m + 1)
        if best is None or found[0] < best[0]:
            best = (found[0], [(b, t) for b, t in zip(groups, found[1], strict=True) if t >= 0])
    return best[1]


def _flips(bits: list[int], upto: int, least: int = 0) -> list[int]:
    return [_mask(list(c)) for r in range(least, upto + 1) for c in combinations(bits, r)]


def links(fps: DataFrame, distance: int = 2, column: str = "fp", bucket: int = BUCKET) -> DataFrame:
    """(src, dst), src < dst: enough true links to keep the components whole.

    ``fps`` has distinct fingerprints. Every pair within ``distance`` is
    linked directly or, in crowded buckets, by way of a common third.
    """
    if distance % 2:
        raise ValueError("the neighbourhoods of crowded buckets need an even distance")
    parts = plan(fps, distance, column)
    fp = F.col(column)
    rows = []
    for k, (bits, t) in enumerate(parts):
        mask = F.lit(_mask(bits))
        rows.append(F.struct(F.lit(k).alias("p"), fp.bitwiseAND(mask).alias("v"), F.lit(True).alias("home")))
        rows += [F.struct(F.lit(k).alias("p"), fp.bitwiseXOR(F.lit(x)).bitwiseAND(mask).alias("v"), F.lit(False).alias("home"))
                 for x in _flips(bits, t, 1)]
    members = cut(fps.select(fp.alias("fp"), F.explode(F.array(*rows)).alias("x")).select("fp", "x.*"))
    full = members.groupBy("p", "v").agg(F.count(F.lit(1)).alias("n"), F.max("home").alias("any_home"), F.bit_or("fp").bitwiseXOR(F.bit_and("fp")).alias("mask")).where("n > 1 and any_home")
    crowded, seen = cut_with(full.where(F.col("n") > bucket).select("p", "v", "mask"))
    few = members.join(full.where(F.col("n") <= bucket).select("p", "v"), ["p", "v"], "left_semi")
    few = few.groupBy("p", "v").agg(F.collect_list(F.struct("fp", "home")).alias("m"))

    def near(x, y):
        return (y["fp"] > x["fp"]) & (x["home"] | y["home"]) & (F.bit_count(x["fp"].bitwiseXOR(y["fp"])) <= distance)

    pairs = F.flatten(F.transform("m", lambda x: F.transform(
        F.filter("m", lambda y: near(x, y)), lambda y: F.struct(x["fp"].alias("src"), y["fp"].alias("dst")))))
    found = few.select(F.explode(pairs).alias("e")).select("e.src", "e.dst")
    if not seen["rows"]:
        return found.distinct()
    # Only bits in which some member of a bucket differs can tell two apart.
    hot = members.join(crowded, ["p", "v"]).groupBy("fp").agg(F.bit_or("mask").alias("mask"))
    steps = F.array(*[F.lit(x) for x in _flips(list(range(64)), distance // 2)])
    own = F.filter(steps, lambda x: x.bitwiseAND(F.col("mask")) == x)
    around = hot.select("fp", F.explode(own).alias("step")).select("fp", F.col("fp").bitwiseXOR(F.col("step")).alias("at"))
    low = around.groupBy("at").agg(F.min("fp").alias("src"), F.count(F.lit(1)).alias("n")).where("n > 1").select("at", "src")
    stars = around.join(low, "at").where("src < fp").select("src", F.col("fp").alias("dst"))
    return found.unionByName(stars).distinct()


def _placed(rows: DataFrame, distance: int) -> DataFrame:
    """(fp, root) for the fingerprints of ``rows``."""
    distinct = cut(rows.select("fp").distinct())
    roots = connected_components(links(distinct, distance)).select(F.col("node_id").alias("fp"), F.col("component").alias("root"))
    return distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = 2, shingle: int = 3) -> DataFrame:
    """One row per document: doc_id, fp and component_id (smallest doc_id)."""
    rows = cut(fingerprints(docs, text, [doc_id], shingle).select(F.col("_row")[doc_id].alias("doc_id"), "fp"))
    low = rows.groupBy("fp").agg(F.min("doc_id").alias("low"))
    placed = cut(_placed(rows, distance).join(low, "fp"))
    least = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    named = placed.join(least, "root").select("fp", "component_id")
    return rows.join(cut(named), "fp")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = 2, shingle: int = 3) -> DataFrame:
    """The row with the smallest id of each component; columns unchanged.

    Null ids come last; of rows equal in id and fingerprint one stays.
    """
    kept = fingerprints(docs, text, None, shingle)
    key = F.coalesce(F.col("_row")[doc_id].cast("string"), F.lit(""))
    rows = cut(fingerprints(docs, text, [doc_id], shingle).select(F.col("_row")[doc_id].alias("id"), key.alias("_key"), "fp"))
    first = F.min(F.struct(F.isnull("id").alias("none"), "id", "_key", "fp"))
    low = rows.groupBy("fp").agg(first.alias("low"))
    heads = _placed(rows, distance).join(low, "fp").groupBy("root").agg(F.min("low").alias("low")).select("low._key", "low.fp")
    return kept.withColumn("_key", key).join(cut(heads), ["_key", "fp"]).dropDuplicates(["_key", "fp"]).select("_row.*")
