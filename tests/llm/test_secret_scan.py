"""Findings of the worklist against planted layers and a plain base scan."""

import base64
import bz2
import gzip
import hashlib
import lzma
import re
import urllib.parse
import zlib

import pytest
import zstandard

from terraloom.llm import queries, secret_scan

SECRET = "password=hunter2hunter2"
KINDS = ("assign", "access", "hex")


def base(text):
    """Kind, start and end of the contract's base patterns."""
    text, out = text or "", []
    sign = re.compile("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "(password|passwd|secret|token|api_?key)")
                      + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for kind, pattern, ok in ((0, sign, lambda m: len(m.group(2)) >= 8), (1, re.compile("AKIA[A-Z0-9]+"), lambda m: len(m.group()) >= 16),
                              (2, re.compile("[0-9a-f]+"), lambda m: len(m.group()) >= 32)):
        out += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if ok(m)]
    return sorted(out)


def test_base_matches_the_plain_scan(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = 0
    for r in queries.op12_secret_scans(spark, sf).collect():
        want = base(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == n for _, k, _ in want) for n in range(3))
        joined = ",".join(f"{KINDS[k]}:{i}:{j}" for i, k, j in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) <= set(r.spans.split(","))
        found += len(want)
    assert found > 5


def b64(raw):
    return base64.b64encode(raw).decode()


UNICODE = "".join(f"\\u{ord(c):04x}" for c in SECRET)
LAYERS = {
    "url": urllib.parse.quote(SECRET, safe=""), "url>url": urllib.parse.quote(urllib.parse.quote(SECRET, safe=""), safe=""),
    "unicode": UNICODE, "base64": b64(SECRET.encode()), "base64>base64": b64(b64(SECRET.encode()).encode()),
    "base64>gzip": b64(gzip.compress(SECRET.encode())), "base64>zlib": b64(zlib.compress(SECRET.encode())), "base64>bzip2": b64(bz2.compress(SECRET.encode())),
    "base64>xz": b64(lzma.compress(SECRET.encode())), "base64>zstd": b64(zstandard.ZstdCompressor().compress(SECRET.encode() * 2)),
    "base64>utf16": b64(SECRET.encode("utf-16-le")), "url>base64": "".join(f"%{c:02X}" for c in b64(SECRET.encode()).encode()),
    "base64>gzip>gzip": b64(gzip.compress(gzip.compress(SECRET.encode()))), "base64>unicode": b64(UNICODE.encode()),
    "base64>zlib>base64>gzip": b64(zlib.compress(b64(gzip.compress(b"a line\n" + SECRET.encode())).encode())),
}


@pytest.mark.parametrize("path", LAYERS)
@pytest.mark.parametrize("before,after", [("", ""), ("Größe € ", " end"), ("see http://host/a/", '"')])
def test_layers_are_unwrapped(path, before, after):
    hidden = LAYERS[path]
    text = before + hidden + after
    new = [s for s in secret_scan.scan_text(text) if s[3]]
    assert any(k == "assign" and len(before) <= i < j <= len(before) + len(hidden) for k, i, j, _ in new)
    assert path == "base64>utf16" or path in {p for *_, p in new}


def test_spans_cover_the_bytes_that_matter():
    wrapped = "n " + b64(b"....." + SECRET.encode() + b"!" * 40) + " n"
    (_, i, j, path), = secret_scan.scan_text(wrapped)
    assert path == "base64" and SECRET.encode() in base64.b64decode(wrapped[i - (i - 2) % 4 : j + (2 - j) % 4] + "===") and j - i <= 34
    text = "pass%77ord = ünsafe, tok\\u0065n=abcdefgh%41b%zz"
    assert [(text[i:j], k) for k, i, j, _ in secret_scan.scan_text(text)] == [("tok\\u0065n=abcdefgh", "assign"), ("tok\\u0065n=abcdefgh%41b", "assign")]


def test_base_spans_stay_when_a_layer_reaches_further():
    text = "token=abcdefgh%41%42"
    assert [s[:3] for s in secret_scan.scan_text(text)] == [("assign", 0, 14), ("assign", 0, 20)]


def test_equal_layers_are_worked_once(monkeypatch):
    seen = []
    monkeypatch.setattr(secret_scan, "matches", lambda text, old=secret_scan.matches: seen.append(text) or old(text))
    secret_scan.scan_text("a%41b\\u0041c")
    # The text, each escape undone alone, and both undone, whichever came first.
    assert sorted(seen) == ["a%41bAc", "a%41b\\u0041c", "aAbAc", "aAb\\u0041c"]


def test_long_streams_are_read_in_pieces():
    deep = gzip.compress(gzip.compress(b"some words here\n" * 600_000 + SECRET.encode() + b"\n" + b"more words\n" * 300_000))
    once = gzip.compress(b"some words here\n" * 900_000)
    sizes = [len(p) for _, p in secret_scan.unpacked(secret_scan._chunks(*secret_scan._reader(b"\x1f\x8b"), iter([once])), ("gzip",))]
    assert len(sizes) > 2 and max(sizes) <= 2 * secret_scan.PIECE
    (_, i, j, path), = secret_scan.scan_text("x " + b64(deep))
    assert path == "base64>gzip>gzip" and i == 2
    assert secret_scan.scan_text("x " + b64(deep[:2000]) + " %E2%28%A1 %zz \\ud800 \\u{110000} &#9999999; " + b64(deep)[::-1]) is not None


def test_odd_rows(spark, odd_docs):
    rows = secret_scan.scan(odd_docs, keep=None).collect()
    assert len(rows) == odd_docs.count() and {tuple(r._row) for r in rows} == {tuple(r) for r in odd_docs.collect()}
    out = secret_scan.digests(secret_scan.scan(odd_docs))
    assert out.where("doc_id = 1 and spans = '' and n_hex = 0").count() == 1
    long = spark.createDataFrame([(1, "word " * 400_000 + SECRET), (1, None)], "doc_id long, text string")
    got = {r.spans for r in secret_scan.digests(secret_scan.scan(long)).collect()}
    assert got == {f"assign:{5 * 400_000}:{5 * 400_000 + len(SECRET)}", ""}
    assert secret_scan.digests(secret_scan.scan(odd_docs.limit(0))).count() == 0
