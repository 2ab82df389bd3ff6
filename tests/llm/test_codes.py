"""Codes of vectors against plain integer k-means."""

import hashlib
import math
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from terraloom.llm import codes, queries


def plain(rows, parts=8, entries=16, rounds=6, scale=4096):
    """{vec_id: (code, error)} and the final codebooks, entry by entry."""
    kept = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return {}, []
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    order = sorted(kept, key=lambda r: (r[0], r[1]))
    books = [[cut(r[1], p) for r in order[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    pick = lambda v, p: min((far(cut(v, p), c), k) for k, c in enumerate(books[p]))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v, _ in kept:
            for p in range(parts):
                groups[p, pick(v, p)[1]].append(cut(v, p))
        for (p, k), members in groups.items():
            books[p][k] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    out = {}
    for i, v, _ in kept:
        best = [pick(v, p) for p in range(parts)]
        out[i] = ("".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best))
    return out, books


def coded(made):
    return {r.vec_id: (None if r.codes is None else r.codes.hex(), r.error) for r in made.rows.collect()}


def test_codes_match_plain_clustering(spark, sf):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = {r.vec_id: r for r in queries.op11_vector_code_compression(spark, sf).collect()}
    want, books = plain(rows)
    assert {i: (r.code, r.error) for i, r in got.items()} == want
    digest = hashlib.sha256(",".join(str(x) for p in books for c in p for x in c).encode()).hexdigest()
    assert {r.codebooks_sha256 for r in got.values()} == {digest}
    sums = defaultdict(int)
    for i, _, label in rows:
        sums[label] += want[i][1]
    assert all(got[i].label_error == sums[label] for i, _, label in rows)


def test_odd_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [float(x) for x in rng.normal(size=4)], "a" if k % 3 else None) for k in range(40)]
    rows += [(3, rows[3][1], "a"), (100, None, "b"), (101, [1.0, None, 0.0, 2.0], "b"), (102, [1.0, float("nan"), 0.0, 2.0], "b"),
             (103, [float("-inf")] * 4, "b"), (104, [1e30, -1e30, 0.0, 5.0], "b"), (105, [1.0, 2.0], "c"), (None, [0.5, -0.5, 0.25, 0.0], None)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label string, error long, codes string")
    made = codes.fit(df, parts=2, entries=5, rounds=3, scale=8)
    got = coded(made)
    assert got[105] == (None, None) and not {100, 101, 102, 103} & set(got) and len(made.rows.collect()) == 44
    clipped = [(i, v, label) for i, v, label in rows if i not in (None, 104, 105)]
    # The wide vectors take part, so plain clustering gets them cut the same way.
    most = codes.LIMIT / 8
    want, _ = plain([*clipped, (104, [most, -most, 0.0, 5.0], "b"), (1 << 40, [0.5, -0.5, 0.25, 0.0], None)], 2, 5, 3, 8)
    want[None] = want.pop(1 << 40)
    assert {k: v for k, v in got.items() if k != 105} == want
    sums = {r.vec_id: r.label_error for r in codes.with_label_error(made.rows).collect()}
    assert sums[0] == sums[None] == sum(want[i][1] for i, _, label in rows if label is None)
    assert codes.fit(df, parts=3).rows.where("codes is not null or error is not null").count() == 0
    assert codes.fit(df.limit(0)).rows.count() == 0
    assert codes.fit(df.where("vec_id = 1"), parts=2).rows.select(F.hex("codes")).first()[0] == "0000"


def test_net_displacement_scans_less_and_stays_exact():
    rng = np.random.default_rng(2)
    x = rng.integers(-4000, 4000, (3000, 2, 4))
    x[::7] = x[0]
    history, tight, loose = [x[:16].transpose(1, 0, 2).copy()], codes.Bounds(3000, 2), codes.Bounds(3000, 2)
    scans = [0, 0]
    for _ in range(12):
        for k, (b, net) in enumerate(((tight, True), (loose, False))):
            scans[k] += codes.assign(x, history, b, net)
        exact = np.stack([((x[:, p, None] - history[-1][p][None]) ** 2).sum(-1).argmin(1) for p in range(2)], 1)
        assert (tight.near == exact).all() and (loose.near == exact).all()
        sums = codes._sums(x, tight.near, 16)
        history.append(np.where(sums[:, :, -1:] > 0, sums[:, :, :-1] // np.maximum(sums[:, :, -1:], 1), history[-1]))
    assert scans[0] < scans[1] < 12 * 6000


def test_rows_stay_whole_when_blocks_are_small(spark, monkeypatch):
    rows = [(k, [float(k % 11), float(k % 7)], k % 4) for k in range(500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(7)
    want, _ = plain(rows, 2, 4, 5, 3)
    assert coded(codes.fit(df, 2, 4, 5, 3)) == want
