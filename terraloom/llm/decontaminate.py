"""Benchmark decontamination by sparse suffix arrays over the training texts.

Each Arrow slice of documents is a shard. Its suffix array holds the word
positions whose next words open some benchmark window (any other suffix
cannot match), ordered by their first ``window`` words. Every benchmark
suffix that can occur in the shard is located by binary search, which gives
all its places; matches are then extended to their longest verbatim length.
Documents never shuffle; the benchmark is broadcast in blocks of bounded
bytes, one pass for each block.

Defined cases: null and empty texts have no words and are never
contaminated; items without words are skipped; equal item texts all count;
repeated rows each get their own result; an empty benchmark leaves all clean.
Words are compared by 64-bit hashes of their bytes.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import ALNUM, Words, map_texts, slices, text_bytes

SHARD_BYTES = 4 << 20
BLOCK_BYTES = 16 << 20
SEED_WORDS = 4
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)

ADDED = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(T.LongType())),
    T.StructField("items", T.ArrayType(T.StringType())), T.StructField("longest", T.LongType()),
    T.StructField("longest_item", T.StringType()), T.StructField("longest_at", T.LongType()),
])


@dataclass
class Block:
    """One block of the benchmark, ready for search."""

    vocab: np.ndarray  # sorted word hashes; rank = index + 1
    text: np.ndarray  # ranks of all item words, a 0 after each item
    keys: np.ndarray  # distinct windows as big-endian ranks
    highs: np.ndarray  # the last key that has the window as prefix
    sizes: np.ndarray  # words of each window
    seeds: list  # (words, sorted seeds, seed of each window or None)
    owner_at: np.ndarray  # first entry of each window in owners
    owners: np.ndarray  # item index
    places: np.ndarray  # position in text
    items: list  # item ids as strings


def _seed(ranks: np.ndarray, n: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of ``n`` ranks from each position, and where none of them is 0."""
    h, ok = np.zeros(length, np.uint64), np.ones(length, bool)
    for k in range(n):
        part = ranks[k : k + length]
        h += part.astype(np.uint64) * _MIX[k]
        ok &= part > 0
    return h ^ (h >> np.uint64(31)), ok


def _keys(ranks: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    rows = ranks[at[:, None] + np.arange(window)].astype(">u4")
    return np.ascontiguousarray(rows).view(f"S{4 * window}").ravel()


def build_block(ids: list, texts: pa.Array, window: int) -> Block | None:
    data, offsets = text_bytes(texts)
    words = Words(data, offsets, ALNUM)
    if not len(words):
        return None
    vocab, ranks = np.unique(words.hashes(), return_inverse=True)
    owner = words.text_of()
    text = np.zeros(len(words) + len(ids) + window, np.uint32)
    place = np.arange(len(words)) + owner
    text[place] = ranks + 1
    size = np.minimum(words.counts, window)
    opens = np.arange(len(words)) - words.first[:-1][owner] + size[owner] <= words.counts[owner]
    owner, place = owner[opens], place[opens]
    size = size[owner]
    rows = text[place[:, None] + np.arange(window)]
    rows = np.where(np.arange(window) < size[:, None], rows, 0).astype(">u4")
    high = np.where(np.arange(window) < size[:, None], rows, 0xFFFFFFFF).astype(">u4")
    keys = np.ascontiguousarray(rows).view(f"S{4 * window}").ravel()
    highs = np.ascontiguousarray(high).view(f"S{4 * window}").ravel()
    kinds, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    order = np.argsort(inverse, kind="stable")
    sizes, seeds = size[first], []
    for n in np.unique(np.minimum(sizes, SEED_WORDS)):
        mine = np.minimum(sizes, SEED_WORDS) == n
        h = _seed(np.concatenate([text, np.zeros(SEED_WORDS, np.uint32)]), int(n), len(text))[0][place[first]]
        seeds.append((int(n), np.unique(h[mine]), np.where(mine, h, np.uint64(0)), mine))
    at = np.concatenate([[0], np.cumsum(np.bincount(inverse, minlength=len(kinds)))])
    return Block(vocab, text, kinds, highs[first], sizes, seeds, at, owner[order], place[order], [str(i) for i in ids])


def _member(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    at = np.searchsorted(sorted_values, x)
    at[at == len(sorted_values)] = 0
    return sorted_values[at] == x


def search_shard(words: Words, block: Block, window: int):
    """For one shard: (text, first word, words) hits, (text, item) pairs and
    (text, length, item, first word) of the longest match of each text."""
    n, docs = len(words), len(words.counts)
    h = words.hashes()
    at = np.searchsorted(block.vocab, h)
    at[at == len(block.vocab)] = 0
    rank = np.where(block.vocab[at] == h, at + 1, 0).astype(np.uint32)
    owner = words.text_of()
    length = n + docs
    ranks = np.zeros(length + window + SEED_WORDS, np.uint32)
    ranks[np.arange(n) + owner] = rank
    opens, near = np.zeros(length, bool), np.zeros(len(block.keys), bool)
    for size, seeds, of_window, mine in block.seeds:
        seed, ok = _seed(ranks, size, length)
        place = np.flatnonzero(ok)
        place = place[_member(seeds, seed[place])]
        opens[place] = True
        near |= mine & _member(np.unique(seed[place]), of_window)
    place, probe = np.flatnonzero(opens), np.flatnonzero(near)
    none = np.zeros(0, np.int64)
    if not len(place) or not len(probe):
        return none, none, none, none, none, none, none, none, none
    keys = _keys(ranks, place, window)
    order = np.argsort(keys, kind="stable")  # the shard's suffix array
    keys, place = keys[order], place[order]
    low = np.searchsorted(keys, block.keys[probe], "left")
    high = np.searchsorted(keys, block.highs[probe], "right")
    found = np.maximum(high - low, 0)
    hit = np.repeat(probe, found)
    where = place[np.repeat(low - (np.cumsum(found) - found), found) + np.arange(int(found.sum()))]
    doc_start = words.first[:-1] + np.arange(docs)
    doc = np.searchsorted(doc_start, where, "right") - 1
    # Texts without words share a start with none: their slot is their own.
    begin = where - doc_start[doc]
    # Which items, each once for each text.
    pairs = np.unique(np.stack([doc, hit]), axis=1) if len(doc) else np.zeros((2, 0), np.int64)
    many = block.owner_at[pairs[1] + 1] - block.owner_at[pairs[1]]
    entry = np.repeat(block.owner_at[pairs[1]] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    items = np.unique(np.stack([np.repeat(pairs[0], many), block.owners[entry]]), axis=1)
    # Longest: extend each match, at every place of its window, word by word.
    many = block.owner_at[hit + 1] - block.owner_at[hit]
    entry = np.repeat(block.owner_at[hit] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    mine, theirs = np.repeat(where, many), block.places[entry]
    grown = np.repeat(block.sizes[hit], many).astype(np.int64)
    todo = np.arange(len(mine))
    while len(todo):
        a, b = ranks[mine[todo] + grown[todo]], block.text[theirs[todo] + grown[todo]]
        todo = todo[(a == b) & (a > 0)]
        grown[todo] += 1
    best = np.lexsort((np.repeat(begin, many), block.owners[entry], -grown, np.repeat(doc, many)))
    by = np.repeat(doc, many)[best]
    top = best[np.concatenate([[True], by[1:] != by[:-1]])] if len(best) else best
    return (doc, begin, block.sizes[hit], items[0], items[1], np.repeat(doc, many)[top], grown[top],
            block.owners[entry][top], np.repeat(begin, many)[top])


def _covered(doc: np.ndarray, begin: np.ndarray, size: np.ndarray) -> dict[int, np.ndarray]:
    """Words inside the intervals, as merged [start, end) bounds for each text."""
    out = {}
    order = np.lexsort((begin, doc))
    doc, begin, end = doc[order], begin[order], (begin + size)[order]
    edges = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1], [True]])) if len(doc) else []
    for i, j in zip(edges[:-1], edges[1:], strict=True):
        s, reach = begin[i:j], np.maximum.accumulate(end[i:j])
        fresh = np.concatenate([[True], s[1:] > reach[:-1]])
        last = np.concatenate([fresh[1:], [True]])
        out[int(doc[i])] = np.stack([s[fresh], reach[last]], axis=1).ravel()
    return out


def scan(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = 13, keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``_row`` with the kept columns (all by default), ``_new`` with ADDED.

    ``hits`` are word bounds start, end, start, end, ... in the text; ``items``
    the ids of items with windows in it; ``longest`` words of the longest
    verbatim match, with its item and first word (0 and null if none).
    """
    spark = docs.sparkSession
    keep = docs.columns if keep is None else keep
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length(item_text)), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(size / block_bytes))
    part = F.pmod(F.xxhash64(F.col(item_id).cast("string"), item_text), F.lit(blocks))
    kept = F.struct(*[F.col(f"`{c}`") for c in keep])
    state = F.lit(None).cast(ADDED)
    df = docs.select(F.col(f"`{text}`").alias("text"), kept.alias("row"), state.alias("state"))
    for b in range(blocks):
        rows = benchmark.where(part == b).select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).toArrow()
        ids = rows.column("i").combine_chunks() if rows.num_rows else pa.array([], pa.string())
        texts = rows.column("t").combine_chunks() if rows.num_rows else pa.array([], pa.string())
        shared = spark.sparkContext.broadcast(build_block([str(x) for x in ids.to_pylist()], texts, window))

        def match(texts: pa.Array, before: pa.Array, shared=shared) -> list:
            return _match(texts, before, shared.value, window)

        out = map_texts(df, ["text", "state"], ["row", "text"] if b < blocks - 1 else ["row"], match, ADDED)
        df = out.select(*(["_row.text"] if b < blocks - 1 else []), F.col("_row.row").alias("row"), F.col("_new").alias("state"))
    return df.select(F.col("row").alias("_row"), F.col("state").alias("_new"))


def _match(texts: pa.Array, before: pa.Array, block: Block | None, window: int) -> list:
    data, offsets = text_bytes(texts)
    old = before.to_pylist() if before.null_count < len(before) else [None] * len(texts)
    counts = np.zeros(len(texts), np.int64)
    hits: list = [o["hits"] if o else [] for o in old]
    items: list = [o["items"] if o else [] for o in old]
    best: list = [(o["longest"], o["longest_item"], o["longest_at"]) if o else (0, None, None) for o in old]
    for i, j in slices(offsets, SHARD_BYTES):
        words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], ALNUM)
        counts[i:j] = words.counts
        if block is None or not len(words):
            continue
        doc, begin, size, in_doc, item, top, grown, whose, where = search_shard(words, block, window)
        if not len(doc):
            continue
        for d, bounds in _covered(doc, begin, size).items():
            bounds = bounds.reshape(-1, 2)
            if hits[i + d]:
                both = np.concatenate([np.array(hits[i + d]).reshape(-1, 2), bounds])
                bounds = _covered(np.zeros(len(both), int), both[:, 0], both[:, 1] - both[:, 0])[0]
            hits[i + d] = np.ravel(bounds).tolist()
        for d, k in zip(in_doc.tolist(), item.tolist(), strict=True):
            items[i + d] = [*items[i + d], block.items[k]]
        for d, g, k, w in zip(top.tolist(), grown.tolist(), whose.tolist(), where.tolist(), strict=True):
            if g > best[i + d][0]:
                best[i + d] = (g, block.items[k], w)
    return [
        pa.array(counts), pa.array(hits, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string())),
        pa.array([x[0] for x in best], pa.int64()), pa.array([x[1] for x in best], pa.string()),
        pa.array([x[2] for x in best], pa.int64()),
    ]


def n_hit(hits: str = "_new.hits"):
    """Words inside the bounds, as a column."""
    return F.aggregate(F.zip_with(hits, F.sequence(F.lit(0), F.size(hits) - 1), lambda x, k: F.when(k % 2 == 0, -x).otherwise(x)),
                       F.lit(0).cast("long"), lambda a, x: a + x)


def verdict(scanned: DataFrame, one_in: int = 20) -> DataFrame:
    """``scan`` with n_hit, the items' digest and whether the text goes.

    Contaminated: some word is hit and hits are at least 1 in ``one_in``.
    """
    hits = F.when(F.size("_new.hits") == 0, F.lit(0).cast("long")).otherwise(n_hit())
    named = F.array_distinct("_new.items")
    return scanned.select(
        "_row", F.col("_new.n_words").alias("n_words"), hits.alias("n_hit"), F.size(named).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(named), ",").cast("binary"), 256).alias("items_sha256"), F.col("_new.longest").alias("longest"),
        F.col("_new.longest_item").alias("longest_item"), F.col("_new.longest_at").alias("longest_at"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(one_in) * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, columns unchanged."""
    return verdict(scan(docs, benchmark, **options)).where(~F.col("contaminated")).select("_row.*")
