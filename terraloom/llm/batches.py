"""Arrow batches of whole texts as numpy arrays, and word splitting on bytes."""

from __future__ import annotations

import atexit
import hashlib
import os
import shutil
import tempfile
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

# Bytes of words, after A-Z were lower-cased. Every byte of a character beyond
# ASCII belongs to a word in both rules.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
NON_SPACE = np.ones(256, bool)
NON_SPACE[[9, 10, 11, 12, 13, 32]] = False

_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LONG_WORD = 64
#: Rows are handed over by number else, whatever the length of their texts.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors unless their search path has it, and
    bound the bytes of an Arrow batch where the session leaves them open."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    app = spark.sparkContext.applicationId
    seen = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if app in _shipped or root in map(os.path.realpath, filter(None, seen)) or any(
        p and os.path.isdir(os.path.join(p, "terraloom")) for p in seen
    ):
        return
    folder = tempfile.mkdtemp(prefix="spark-terraloom-code-", dir="/tmp")
    archive = shutil.make_archive(os.path.join(folder, "terraloom"), "zip", root, "terraloom")
    spark.sparkContext.addPyFile(archive)
    atexit.register(shutil.rmtree, folder, True)
    _shipped.add(app)


def map_texts(
    df: DataFrame, inputs: Sequence, keep: Sequence[str], fn: Callable[..., list], added: T.StructType
) -> DataFrame:
    """Add the columns that ``fn`` computes from whole Arrow batches.

    ``fn`` gets one Arrow array per column of ``inputs`` and returns one per
    field of ``added``. Rows stay where they are: no shuffle. The result has
    ``_row`` (struct of the ``keep`` columns) and ``_new`` (struct of the
    added ones), so names of extra columns cannot clash.
    """
    ship(df.sparkSession)
    row = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(0).alias("none"))
    given = df.select(row.alias("_row"), *[F.col(f"`{c}`").alias(f"_in{k}") if isinstance(c, str) else c.alias(f"_in{k}")
                                           for k, c in enumerate(inputs)])
    n = len(inputs)
    schema = T.StructType([given.schema["_row"], T.StructField("_new", added)])
    names = [f.name for f in added.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = fn(*[b.column(1 + k) for k in range(n)])
            new = pa.StructArray.from_arrays([pa.array(x) if not isinstance(x, pa.Array) else x for x in made], names)
            yield pa.RecordBatch.from_arrays([b.column(0), new], ["_row", "_new"])

    return given.mapInArrow(run, schema)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes and the n + 1 offsets of an Arrow string array; null is empty."""
    if pa.types.is_binary(texts.type):
        texts = texts.cast(pa.large_binary())
    elif not pa.types.is_large_binary(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = pc.fill_null(texts, b"" if pa.types.is_large_binary(texts.type) else "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    if data is None:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of about ``limit`` bytes; a longer text stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """Lower-cased words of several texts.

    ``first`` has the index of each text's first word, and the number of all
    words at its end. ``low`` is padded by 8 bytes.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray):
        size = len(data)
        self.low = np.zeros(size + 8, np.uint8)
        np.take(LOWER, data, out=self.low[:size])
        inside = kind[self.low[:size]]
        fresh = np.zeros(size + 1, bool)
        fresh[offsets] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | fresh[1:size]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | fresh[1:size]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.starts)

    def text_of(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def pick(self, index: np.ndarray) -> Words:
        """The same texts' bytes with only some of the words, as one text."""
        out = object.__new__(Words)
        out.low, out.starts, out.ends = self.low, self.starts[index], self.ends[index]
        out.first, out.counts = np.array([0, len(index)]), np.array([len(index)])
        return out

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word, eight bytes at a time."""
        size = self.ends - self.starts
        view = np.ndarray((len(self.low) - 7,), "<u8", self.low, strides=(1,))
        out = size.astype(np.uint64) * _C2
        at, todo = self.starts, np.flatnonzero(size <= _LONG_WORD)
        step = 0
        while len(todo):
            left = np.minimum(size[todo] - step, 8).astype(np.uint64)
            lane = view[at[todo] + step] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * left))
            h = (out[todo] ^ lane) * _C1
            out[todo] = h ^ (h >> np.uint64(29))
            step += 8
            todo = todo[size[todo] > step]
        for k in np.flatnonzero(size > _LONG_WORD):
            word = self.low[self.starts[k] : self.ends[k]].tobytes()
            out[k] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return out

    def joined(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The words with one space after each; their starts and ends there."""
        size = self.ends - self.starts
        ends = np.cumsum(size + 1) - 1
        begins = ends - size
        out = np.full(int(ends[-1]) + 1 if len(size) else 0, 32, np.uint8)
        out[np.repeat(begins - self.starts, size) + _ranges(self.starts, size)] = self.low[_ranges(self.starts, size)]
        return out.tobytes(), begins, ends


def _ranges(starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers start, start + 1, ... of each range, one after another."""
    total = int(size.sum())
    return np.arange(total) + np.repeat(starts - (np.cumsum(size) - size), size)
