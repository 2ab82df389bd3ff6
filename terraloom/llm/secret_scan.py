"""Secrets in texts and in what is encoded inside them.

A worklist holds layers: the whole text first, then whatever can be unwrapped
from a layer. Percent escapes and Unicode escapes (``\\u0041``, ``\\x41``,
``&#65;``) are undone over the whole layer, so a secret that is encoded only in
part is seen in its surroundings. Runs of base64 letters are decoded at each of
the four offsets a value may begin at, so a value that follows a path or
another word is decoded too. Decoded bytes are searched for runs of two-byte
characters and compressed streams (gzip, zlib, bzip2, xz, zstd), which are
layers again. Every layer is scanned
with the same patterns and unwrapped further, until no new layer comes up; a
layer that was there before (equal content from the same place) is dropped, so
a stream that unpacks to itself ends.

Each layer knows for every character the range of the given text that it came
from, so a finding reports code points of the given text: the escapes it is
made of, the base64 letters that hold its bytes, or the whole run around a
compressed stream. A long compressed stream is unpacked piece by piece, cut at
line ends, so a task holds a piece and not the stream; no pattern crosses a
line end.

Kinds: assign (a name, ``:`` or ``=``, a value of 8 characters or more),
access (AKIA and capitals or digits, 16 or more), hex (32 or more). A finding
of the text itself has no layers; one that a layer gives too is not repeated.

Defined cases: null texts are empty; a malformed escape, base64 that decodes
to nothing of interest and a broken stream give no layer beyond what could be
read; repeated rows are treated alike; rows and extra columns stay; texts are
searched whole, however long.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import itertools
import lzma
import re
import zlib
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import map_texts

KINDS = ("assign", "access", "hex")
PIECE = 4 << 20
BLOCK = 1 << 16

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(
    r"(?:\\u[0-9A-Fa-f]{4})+|\\u\{0*[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#0*[0-9]{1,7};|&#[xX]0*[0-9A-Fa-f]{1,6};")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:\r?\n[A-Za-z0-9+/_-]{16,})*")
_STREAM = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]1AY&SY|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
_WIDE = re.compile(rb"(?:[\x09\x0a\x0d\x20-\x7e]\x00){8,}|(?:\x00[\x09\x0a\x0d\x20-\x7e]){8,}")
_URLSAFE = str.maketrans("-_", "+/", "\r\n")


@dataclass(frozen=True)
class Layer:
    """A text and where its characters come from.

    ``begin`` and ``end`` have a bound for each character; where they are
    None, the characters are those of the given text from ``whole[0]`` on
    (``path`` empty) or all come from the range ``whole``.
    """

    text: str
    path: tuple[str, ...]
    whole: tuple[int, int]
    begin: np.ndarray | None = None
    end: np.ndarray | None = None

    def span(self, i: int, j: int) -> tuple[int, int]:
        if self.begin is not None:
            return int(self.begin[i]), int(self.end[j - 1])
        return self.whole if self.path else (i, j)

    def ranges(self) -> tuple[np.ndarray, np.ndarray]:
        if self.begin is not None:
            return self.begin, self.end
        n = len(self.text)
        if self.path:
            return np.full(n, self.whole[0]), np.full(n, self.whole[1])
        return np.arange(n), np.arange(1, n + 1)

    def mark(self) -> bytes:
        """Equal for layers of equal content from the same places."""
        h = hashlib.blake2b(self.text.encode("utf-8", "surrogatepass"), digest_size=16)
        for part in (self.begin, self.end) if self.begin is not None else (np.array(self.whole),):
            h.update(np.ascontiguousarray(part, np.int64).tobytes())
        return h.digest()


def matches(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of the patterns in one text."""
    for m in _ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= 8:
            yield "assign", m.start(), m.end()
    for kind, pattern in (("access", _ACCESS), ("hex", _HEX)):
        for m in pattern.finditer(text):
            yield kind, m.start(), m.end()


def _percent(found: str) -> list[tuple[str, int, int]]:
    """Characters of a run of percent escapes with their place in the run."""
    raw, out, at = bytes.fromhex(found.replace("%", "")), [], 0
    while at < len(raw):
        lead = raw[at]
        size = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        try:
            char = raw[at : at + size].decode()
        except UnicodeDecodeError:
            char, size = chr(lead), 1
        if len(char) != 1:
            char, size = chr(lead), 1
        out.append((char, 3 * at, 3 * (at + size)))
        at += size
    return out


def _escaped(found: str) -> list[tuple[str, int, int]]:
    """The characters of one escape, or of a run of ``\\u`` units."""
    if re.match(r"\\u[0-9A-Fa-f]", found):
        units = [int(found[k + 2 : k + 6], 16) for k in range(0, len(found), 6)]
        out, k = [], 0
        while k < len(units):
            pair = 0xD800 <= units[k] < 0xDC00 and k + 1 < len(units) and 0xDC00 <= units[k + 1] < 0xE000
            code = 0x10000 + (units[k] - 0xD800 << 10) + (units[k + 1] - 0xDC00) if pair else units[k]
            out.append((chr(code), 6 * k, 6 * (k + 1 + pair)))
            k += 1 + pair
        return out
    digits = re.search(r"[xX{U]?([0-9A-Fa-f]+)\W?$", found).group(1)
    code = int(digits, 10 if re.match(r"&#[0-9]", found) else 16)
    return [(chr(code), 0, len(found))] if code <= 0x10FFFF else [(c, k, k + 1) for k, c in enumerate(found)]


def _undone(layer: Layer, pattern: re.Pattern, chars: Callable, name: str) -> Layer | None:
    """The whole layer with all escapes of one sort undone, or None without any."""
    texts, begins, ends, at = [], [], [], 0
    begin = end = None
    for m in pattern.finditer(layer.text):
        if begin is None:
            begin, end = layer.ranges()
        texts.append(layer.text[at : m.start()])
        begins.append(begin[at : m.start()])
        ends.append(end[at : m.start()])
        found = chars(m.group())
        texts.append("".join(c for c, _, _ in found))
        begins.append(begin[[m.start() + i for _, i, _ in found]])
        ends.append(end[[m.start() + j - 1 for _, _, j in found]])
        at = m.end()
    if begin is None:
        return None
    begins.append(begin[at:])
    ends.append(end[at:])
    texts.append(layer.text[at:])
    return Layer("".join(texts), (*layer.path, name), layer.whole, np.concatenate(begins), np.concatenate(ends))


def _reader(magic: bytes) -> tuple[str, Callable]:
    if magic.startswith(b"\x1f\x8b"):
        return "gzip", lambda: zlib.decompressobj(31)
    if magic.startswith(b"\x78"):
        return "zlib", zlib.decompressobj
    if magic.startswith(b"BZ"):
        return "bzip2", bz2.BZ2Decompressor
    if magic.startswith(b"\xfd"):
        return "xz", lzma.LZMADecompressor
    return "zstd", zstandard.ZstdDecompressor


class _Source:
    """Reads from an iterator of bytes."""

    def __init__(self, blocks: Iterator[bytes]):
        self.blocks, self.held = blocks, b""

    def read(self, size: int) -> bytes:
        while len(self.held) < size:
            block = next(self.blocks, b"")
            if not block:
                break
            self.held += block
        out, self.held = self.held[:size], self.held[size:]
        return out


def _chunks(kind: str, new: Callable, blocks: Iterator[bytes]) -> Iterator[bytes]:
    """Unpacked bytes, at most a piece at a time; ends quietly where broken."""
    try:
        if kind == "zstd":
            yield from new().read_to_iter(_Source(blocks), write_size=PIECE)
            return
        d = new()
        for block in blocks:
            out = d.decompress(block, PIECE)
            while out:
                yield out
                if kind in ("gzip", "zlib"):
                    out = d.decompress(d.unconsumed_tail, PIECE) if d.unconsumed_tail else b""
                else:
                    out = b"" if d.eof or d.needs_input else d.decompress(b"", PIECE)
            if d.eof:
                return
        if kind in ("gzip", "zlib"):
            yield d.flush()
    except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError, zstandard.ZstdError):
        return


def unpacked(chunks: Iterator[bytes], path: tuple[str, ...], heads: frozenset = frozenset()) -> Iterator[tuple[tuple, bytes]]:
    """(path, bytes) of a stream: whole where it is short, or else in pieces
    cut at line ends, and of the stream it begins with itself."""
    first = b""
    for chunk in chunks:
        first += chunk
        if len(first) > PIECE:
            break
    else:
        if first:
            yield path, first
        return
    head = hashlib.blake2b(first[:PIECE], digest_size=16).digest()
    inner = _STREAM.match(first)
    if inner:
        # Too long to be a layer at once: the inner stream is read through it.
        if head not in heads:
            kind, new = _reader(inner.group())
            yield from unpacked(_chunks(kind, new, itertools.chain([first], chunks)), (*path, kind), heads | {head})
        return
    rest = first
    for chunk in itertools.chain([b""], chunks):
        rest += chunk
        cut = rest.rfind(b"\n") + 1
        if len(rest) >= PIECE and cut:
            yield path, rest[:cut]
            rest = rest[cut:]
    if rest:
        yield path, rest


def _text(raw: bytes) -> str:
    """One character for each byte; the patterns are all ASCII."""
    return raw.decode("latin-1")


def _decoded(layer: Layer) -> Iterator[Layer]:
    """Layers of the base64 runs of a layer."""
    begins = ends = None
    for m in _RUN.finditer(layer.text):
        run = m.group()
        where = np.arange(m.start(), m.end())
        if "\n" in run:
            codes = np.frombuffer(run.encode("utf-32-le"), np.uint32)
            where = where[(codes != 10) & (codes != 13)]
        letters = run.translate(_URLSAFE)
        if layer.path and begins is None:
            begins, ends = layer.ranges()
        for offset in range(4):
            part = letters[offset:]
            left = len(part) % 4
            if left == 1:
                part, left = part[:-1], 0
            raw = base64.b64decode(part + "=" * (-left % 4))
            if not raw:
                continue
            k = np.arange(len(raw))
            # Byte k has bits of the letters k * 4 // 3 and the one after it.
            first = where[offset + k * 4 // 3]
            last = where[offset + (k * 8 + 7) // 6]
            begin, end = (begins[first], ends[last]) if layer.path else (first, last + 1)
            whole = (int(begin[0]), int(end[-1]))
            path = (*layer.path, "base64")
            yield Layer(_text(raw), path, whole, begin, end)
            for w in _WIDE.finditer(raw):
                # The character's byte comes first or second in each pair.
                low = w.start() + (raw[w.start()] == 0)
                yield Layer(_text(raw[low : w.end() : 2]), (*path, "utf16"), whole, begin[w.start() : w.end() : 2], end[w.start() + 1 : w.end() : 2])
            yield from _streams(raw, path, begin, end)


def _streams(raw: bytes, path: tuple, begin: np.ndarray, end: np.ndarray) -> Iterator[Layer]:
    """Layers of compressed streams in decoded bytes; a stream in a stream is
    a layer of the same run."""
    for m in _STREAM.finditer(raw):
        kind, new = _reader(m.group())
        whole = (int(begin[m.start()]), int(end[-1]))
        blocks = (raw[k : k + BLOCK] for k in range(m.start(), len(raw), BLOCK))
        for inner, piece in unpacked(_chunks(kind, new, blocks), (*path, kind)):
            yield Layer(_text(piece), inner, whole)


def _inner_streams(layer: Layer) -> Iterator[Layer]:
    """Streams right inside the bytes of a decoded layer."""
    if layer.path and layer.path[-1] in ("gzip", "zlib", "bzip2", "xz", "zstd"):
        raw = layer.text.encode("latin-1")
        if _STREAM.search(raw):
            begin, end = layer.ranges()
            yield from _streams(raw, layer.path, begin, end)


# Whole-layer decodings with the signs without which there is nothing to do.
UNDO = ((_PERCENT, _percent, "url", "%"), (_ESCAPE, _escaped, "unicode", ("\\", "&#")))


def scan_text(text: str | None) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, layers) of all findings by start, kind and end."""
    text = text or ""
    found: dict[tuple[str, int, int], str] = {}
    work, seen = deque([Layer(text, (), (0, len(text)))]), set()
    while work:
        layer = work.popleft()
        for kind, i, j in matches(layer.text):
            found.setdefault((kind, *layer.span(i, j)), ">".join(layer.path))
        made = [_undone(layer, p, f, name) for p, f, name, signs in UNDO if any(c in layer.text for c in signs)]
        for new in (*[m for m in made if m is not None], *_decoded(layer), *_inner_streams(layer)):
            key = new.mark()
            if key not in seen:
                seen.add(key)
                work.append(new)
    order = {k: n for n, k in enumerate(KINDS)}
    return [(k, i, j, p) for (k, i, j), p in sorted(found.items(), key=lambda x: (x[0][1], order[x[0][0]], x[0][2]))]


SPANS = T.StructType([T.StructField("spans", T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
    T.StructField("layers", T.StringType())])))])


def scan(docs: DataFrame, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """``_row`` (the kept columns, all by default) and ``_new.spans``."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("layers", pa.string())]))

    def run(texts: pa.Array) -> list:
        rows = [scan_text(t.as_py()) for t in texts]
        return [pa.array([[dict(zip(("kind", "start", "end", "layers"), s, strict=True)) for s in r] for r in rows], kind)]

    return map_texts(docs, [text], docs.columns if keep is None else keep, run, SPANS)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digests(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and digest of what the text itself shows, and all spans."""
    base = F.filter("_new.spans", lambda s: s["layers"] == "")

    def count(kind: str) -> Column:
        return F.size(F.filter(F.col("_base"), lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scanned.withColumn("_base", base).select(
        f"_row.{key}", *[count(k) for k in KINDS], F.sha2(_joined(F.col("_base")), 256).alias("base_sha256"),
        _joined(F.col("_new.spans")).alias("spans"))
