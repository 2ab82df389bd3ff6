"""Toxicity by bags of subwords in a linear softmax.

Each word is the set of its character n-grams (with its ends marked) and the
word itself, hashed into buckets. A text is the average of its subword
vectors; vectors and softmax are trained jointly in numpy, so an unseen
misspelling shares the vectors of the n-grams it keeps. Once trained, a
subword adds ``vector . weights`` to the text's logit, so scoring needs one
number per bucket and reads every text whole.

Defined cases: null, empty and wordless texts get the score of the bias
alone; without both classes among the training rows every text scores the
share of label 1 (0 when there are none). Training rows are a bounded sample:
at most ``TRAIN_ROWS`` texts of label 1 and twice as many of label 0, drawn by
a hash whatever their length, and whole texts up to ``TRAIN_BYTES`` together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import cut
from .batches import ALNUM, Words, map_texts, slices, text_bytes

TRAIN_ROWS = 2500
TRAIN_BYTES = 32 << 20
BITS = 17
BUCKETS = 1 << BITS
GRAMS = (3, 4, 5)
DIM = 8
#: Score from which a text counts as toxic.
CUT = 0.3
SHARD_BYTES = 1 << 20


def subwords(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(word index, bucket) of every subword."""
    n = len(words)
    h = words.hashes()
    owners, buckets = [np.arange(n)], [(h >> np.uint64(64 - BITS)).astype(np.int64)]
    size = words.ends - words.starts
    # Ends are marked: byte 32 stands before and after each word.
    joined, begins, ends = words.joined()
    raw = np.frombuffer(b" " + joined, np.uint8)
    for g in GRAMS:
        many = np.maximum(size + 2 - g + 1, 0)
        at = np.repeat(begins - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        code = np.zeros(len(at), np.uint64)
        for k in range(g):
            code = (code << np.uint64(8)) | raw[at + k]
        code = (code + np.uint64(g)) * np.uint64(0x9E3779B97F4A7C15)
        owners.append(np.repeat(np.arange(n), many))
        buckets.append((code >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(owners), np.concatenate(buckets)


@dataclass
class Model:
    """Logit of each bucket, and the bias."""

    gain: np.ndarray
    bias: float


def _bags(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bags as (offsets, bucket, share), with each bucket once in a text."""
    data, offsets = text_bytes(texts)
    at, ids, shares = [0], [], []
    for i, j in slices(offsets, SHARD_BYTES):
        words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], ALNUM)
        owner, bucket = subwords(words) if len(words) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        doc = words.text_of()[owner] if len(owner) else owner
        key, count = np.unique(doc * BUCKETS + bucket, return_counts=True)
        total = np.bincount(doc, minlength=j - i)
        ids.append((key % BUCKETS).astype(np.int32))
        shares.append((count / np.maximum(total[key // BUCKETS], 1)).astype(np.float32))
        at += (at[-1] + np.cumsum(np.bincount(key // BUCKETS, minlength=j - i))).tolist()
    return np.array(at), np.concatenate([*ids, np.zeros(0, np.int32)]), np.concatenate([*shares, np.zeros(0, np.float32)])


def train(texts: pa.Array, labels: np.ndarray, prior: float, steps: int = 500, batch: int = 64, rate: float = 0.02, decay: float = 0.05, seed: int = 7) -> Model:
    """Subword vectors and softmax weights, fitted together by Adam with decay.

    ``prior`` is the share of label 1 among all labelled rows: the sample
    holds more of the rarer class and is weighed back.
    """
    if len(labels) == 0 or labels.min() == labels.max():
        p = float(np.clip(labels.mean() if len(labels) else 0.0, 1e-6, 1 - 1e-6))
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(p / (1 - p))))
    rng = np.random.default_rng(seed)
    at, ids, shares = _bags(texts)
    # Shares are scaled by the mean bag size, so that steps have a like effect.
    scale = np.float32(np.mean(np.diff(at)) ** 0.5)
    vector = (rng.standard_normal((BUCKETS, DIM)) * 0.1).astype(np.float32)
    soft = (rng.standard_normal((DIM, 2)) * 0.3).astype(np.float32)
    bias = np.zeros(2, np.float32)
    share = labels.mean()
    weight = np.where(labels == 1, prior / share, (1 - prior) / (1 - share)).astype(np.float32)
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (vector, soft, bias)]
    step = 0
    while step < steps:
        order = rng.permutation(len(labels))
        for lo in range(0, len(order), batch):
            rows = order[lo : lo + batch]
            size = at[rows + 1] - at[rows]
            place = np.repeat(at[rows] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            row, bucket, part = np.repeat(np.arange(len(rows)), size), ids[place], shares[place] * scale
            # Average of each text's subword vectors, through to the softmax.
            filled = np.flatnonzero(size)
            hidden = np.zeros((len(rows), DIM), np.float32)
            if len(filled):
                hidden[filled] = np.add.reduceat(vector[bucket] * part[:, None], (np.cumsum(size) - size)[filled], axis=0)
            out = hidden @ soft + bias
            out = np.exp(out - out.max(1, keepdims=True))
            out /= out.sum(1, keepdims=True)
            out[np.arange(len(rows)), labels[rows]] -= 1
            out *= (weight[rows] / len(rows))[:, None]
            back = (out @ soft.T)[row] * part[:, None]
            place = (bucket[:, None] * DIM + np.arange(DIM)).ravel()
            to_vector = np.bincount(place, back.ravel(), minlength=BUCKETS * DIM).astype(np.float32).reshape(BUCKETS, DIM)
            step += 1
            fix = np.float32(rate * (1 - 0.99**step) ** 0.5 / (1 - 0.9**step))
            for x, (m, v), grad in zip((vector, soft, bias), state, (to_vector, hidden.T @ out, out.sum(0)), strict=True):
                m += np.float32(0.1) * (grad - m)
                grad *= grad
                v += np.float32(0.01) * (grad - v)
                x -= fix * m / (np.sqrt(v) + np.float32(1e-8))
                if x is not bias:
                    x *= np.float32(1 - rate * decay)
    gain = vector @ (soft[:, 1] - soft[:, 0]) * scale
    return Model(gain.astype(np.float32), float(bias[1] - bias[0]))


def _scores(texts: pa.Array, model: Model) -> list:
    data, offsets = text_bytes(texts)
    out = np.full(len(texts), model.bias)
    for i, j in slices(offsets, SHARD_BYTES):
        words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], ALNUM)
        if not len(words):
            continue
        # Each distinct word of the slice is cut into subwords once.
        _, first, inverse = np.unique(words.hashes(), return_index=True, return_inverse=True)
        some = words.pick(first)
        owner, bucket = subwords(some)
        gain = np.bincount(owner, model.gain[bucket], minlength=len(first))
        count = np.bincount(owner, minlength=len(first))
        doc = words.text_of()
        total = np.bincount(doc, gain[inverse], minlength=j - i)
        out[i:j] += total / np.maximum(np.bincount(doc, count[inverse], minlength=j - i), 1)
    return [pa.array(1 / (1 + np.exp(-np.clip(out, -500, 500))))]


def training_rows(docs: DataFrame, labels: DataFrame, allowed: Column, rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> tuple[DataFrame, float]:
    """A bounded labelled sample, and the share of label 1 among all labels.

    At most ``rows`` ids of label 1 and twice as many of label 0 are drawn by
    a hash, texts of any length; of each label whole texts are taken in hash
    order until half of ``most_bytes`` is used. Texts join labels by doc_id.
    Ids whose labels disagree are left out; of repeated ids the smallest text
    counts.
    """
    known = labels.where(allowed & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(
        F.min("toxic").alias("toxic"), F.max("toxic").alias("_high")).where("toxic = _high").drop("_high")
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    mark = F.xxhash64("doc_id")
    some = [known.where(F.col("toxic") == k).orderBy(mark, "doc_id").limit(n) for k, n in ((0, 2 * rows), (1, rows))]
    # At most 3 * rows ids, so the broadcast and the sample are bounded.
    picked = F.broadcast(some[0].unionByName(some[1]))
    met = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(picked, "doc_id")
    drawn = cut(met.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("toxic").alias("toxic")))
    upto = W.partitionBy("toxic").orderBy(mark, "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    fits = drawn.select("doc_id", "toxic", F.octet_length("text").cast("long").alias("size")).withColumn(
        "upto", F.sum("size").over(upto)).where(F.col("upto") <= most_bytes // 2).select("doc_id")
    total = sum(counts.values())
    return drawn.join(F.broadcast(fits), "doc_id", "left_semi"), counts.get(1, 0) / total if total else 0.0


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, **options) -> Model:
    """A model from the sample; the same rows give the same model."""
    sample, prior = training_rows(docs, labels, allowed, **options)
    rows = sample.select("doc_id", "text", F.col("toxic").cast("int")).toArrow().sort_by("doc_id").combine_chunks()
    texts = rows.column(1).combine_chunks() if rows.num_rows else pa.array([], pa.string())
    return train(texts, np.array(rows.column(2).to_pylist(), np.int64), prior)


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``_row`` with the kept columns and ``score`` between 0 and 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = T.StructType([T.StructField("score", T.DoubleType())])
    out = map_texts(docs, [text], docs.columns if keep is None else keep, lambda t: _scores(t, shared.value), added)
    return out.select("_row", F.col("_new.score").alias("score"))


def not_held_out(doc_id: str = "doc_id", fold: int = 2) -> Column:
    """Rows that may be learned from: crc32 of the id as text, modulo 4."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 != fold
