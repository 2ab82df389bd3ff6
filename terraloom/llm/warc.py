"""WARC records in ZIP packages, read back by ranges.

Each task writes packages of its own into the shared folder: a ZIP whose
members are stored, not packed, so that a record inside the archive member
can be read by its offset. The archive has one gzip member for each record;
the index member gives every record's offset and length. Reading parses the
end record and central directory (ZIP64 fields included), finds the members,
and range-reads the index and then single records; nothing is extracted.

Of equal payloads the row with the smallest page_id holds the payload and
others refer to it. Package names are drawn for each attempt and passed on by
a written list, so files of failed attempts are never read.

Defined cases: a null html is an empty payload; null page ids and rows that
repeat the smallest id hold their own payload; an empty table gives no
packages and an empty result; a null url is left out of the record.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import cut, scratch_root
from .batches import ship

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PACKAGE_RECORDS = 50_000
PACKAGE_BYTES = 512 << 20
LIST = "package string, records long"
ENTRY = "package string, base long, offset long, length long"
RECORD = "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, url string, payload binary"


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (pafs.LocalFileSystem(), path)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url, payload: bytes, refers_to, date: str) -> bytes:
    """One WARC record; a revisit has headers only."""
    def name(x) -> str:
        return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{x}')}>"

    revisit = refers_to is not None
    body = b"" if revisit else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": name(page_id), "WARC-Date": date,
        "WARC-Target-URI": None if url is None else quote(url, safe=":/?#[]@!$&'()*+,;=%~-._"), "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None,
        "WARC-Refers-To": name(refers_to) if revisit else None, "X-Refers-To-Page": refers_to, "X-Page": page_id, "X-Payload-Length": len(payload),
        "Content-Type": "application/http; msgtype=response", "Content-Length": len(body)}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple:
    """The fields of RECORD from one record's bytes."""
    head, _, body = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = body[: int(fields["Content-Length"])]
    number = {k: int(fields[k]) if k in fields else None for k in ("X-Page", "X-Refers-To-Page", "X-Payload-Length")}
    url = fields.get("WARC-Target-URI")
    if fields["WARC-Type"] == "revisit":
        return number["X-Page"], "revisit", number["X-Payload-Length"], fields["WARC-Payload-Digest"].removeprefix("sha1:"), number["X-Refers-To-Page"], url, None
    payload = body.partition(b"\r\n\r\n")[2]
    made = digest(payload)
    if f"sha1:{made}" != fields["WARC-Payload-Digest"]:
        raise ValueError(f"payload of page {number['X-Page']} does not match its digest")
    return number["X-Page"], "response", len(payload), made, None, url, payload


class PackageWriter:
    """A ZIP package that is written as its records come."""

    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.wacz"
        fs, inner = _store(self.path)
        self.out = fs.open_output_stream(inner)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(ARCHIVE, "w", force_zip64=True)
        self.at, self.lines = 0, []

    def add(self, raw: bytes, url, page_id) -> None:
        press = zlib.compressobj(1, zlib.DEFLATED, 31)
        packed = press.compress(raw) + press.flush()
        self.member.write(packed)
        self.lines.append(json.dumps({"url": url, "page": page_id, "offset": self.at, "length": len(packed)}))
        self.at += len(packed)

    def close(self) -> tuple[str, int]:
        self.member.close()
        self.zip.writestr(INDEX, "\n".join(self.lines))
        self.zip.close()
        self.out.close()
        return self.path, len(self.lines)


def members(read, size: int) -> dict[str, tuple[int, int]]:
    """{member: (offset of its data, length)} of a ZIP with stored members.

    ``read(offset, length)`` reads a range.
    """
    tail_at = max(0, size - 65_557)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack("<HII", tail[end + 10 : end + 20])
    locator = tail[end - 20 : end] if end >= 20 else b""
    if locator[:4] == b"PK\x06\x07":
        at = struct.unpack("<Q", locator[8:16])[0]
        count, length, start = struct.unpack("<QQQ", read(at + 32, 24))
    found, directory, at = {}, read(start, length), 0
    for _ in range(count):
        sign, method, packed, plain, n_name, n_extra, n_note, where = struct.unpack("<4s6xH8xIIHHH8xI", directory[at : at + 46])
        if sign != b"PK\x01\x02":
            raise ValueError("broken central directory")
        name = directory[at + 46 : at + 46 + n_name].decode()
        extra, k = directory[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while k + 4 <= len(extra):
            kind, n = struct.unpack("<HH", extra[k : k + 4])
            if kind == 1:  # ZIP64: only the fields that did not fit, in this order
                wide = list(struct.unpack(f"<{n // 8}Q", extra[k + 4 : k + 4 + n // 8 * 8]))
                plain, packed, where = (wide.pop(0) if x == 0xFFFFFFFF else x for x in (plain, packed, where))
            k += 4 + n
        if method == 0:
            n_name, n_extra = struct.unpack("<HH", read(where + 26, 4))
            found[name] = (where + 30 + n_name + n_extra, plain)
        at += 46 + len(name.encode()) + len(extra) + n_note
    return found


def typed(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, payload, refers_to (null for the rows that hold it)."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumn("key", F.sha1("payload"))
    big = F.length("payload") >= least
    low = rows.where(big).groupBy("key").agg(F.min("page_id").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "low")
    refers = F.when(big & (F.col("page_id") > F.col("low")), F.col("low"))
    return rows.join(low, "key", "left").select("page_id", "url", "payload", refers.alias("refers_to"))


def write(rows: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", records: int = PACKAGE_RECORDS, size: int = PACKAGE_BYTES) -> DataFrame:
    """Write packages under ``folder`` and return the written list of them."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for b in batches:
            for i in range(b.num_rows):
                if out is None:
                    fs, inner = _store(folder)
                    fs.create_dir(inner)
                    out = PackageWriter(folder)
                page_id, url, payload, refers_to = (b.column(c)[i].as_py() for c in ("page_id", "url", "payload", "refers_to"))
                out.add(record(page_id, url, payload, refers_to, date), url, page_id)
                if len(out.lines) >= records or out.at >= size:
                    yield _listed(*out.close())
                    out = None
        if out is not None:
            yield _listed(*out.close())

    return cut(rows.select("page_id", "url", "payload", "refers_to").mapInArrow(run, LIST))


def _listed(path: str, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["package", "records"])


def index(packages: DataFrame) -> DataFrame:
    """One row per record: its package, member start, offset and length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("package").to_pylist():
                fs, inner = _store(path)
                with fs.open_input_file(inner) as f:
                    found = members(lambda at, n, f=f: bytes(f.read_at(n, at)), f.size())
                    at, n = found[INDEX]
                    lines = [json.loads(x) for x in bytes(f.read_at(n, at)).decode().split("\n") if x]
                base = found[ARCHIVE][0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(lines)), pa.array([base] * len(lines), pa.int64()), *[pa.array([x[k] for x in lines], pa.int64()) for k in ("offset", "length")]],
                    ["package", "base", "offset", "length"])

    return packages.select("package").mapInArrow(run, ENTRY)


def read(entries: DataFrame, with_payload: bool = True) -> DataFrame:
    """Range-read the records of index rows."""
    ship(entries.sparkSession)
    names = ["page_id", "record_type", "payload_bytes", "payload_digest", "refers_to", "url", "payload"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, f, done, held = None, None, [], 0

        def batch() -> pa.RecordBatch:
            cols = list(zip(*done, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        for b in batches:
            for package, base, offset, length in zip(*[b.column(c).to_pylist() for c in ("package", "base", "offset", "length")], strict=True):
                if package != path:
                    if f is not None:
                        f.close()
                    fs, inner = _store(package)
                    path, f = package, fs.open_input_file(inner)
                row = parse(zlib.decompress(f.read_at(length, base + offset), 31))
                done.append(row if with_payload else (*row[:-1], None))
                held += row[2] if with_payload else 100
                if held >= 8 << 20:
                    yield batch()
                    done, held = [], 0
        if done:
            yield batch()
        if f is not None:
            f.close()

    n = max(1, int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spread = entries.repartition(n, "package", F.floor(F.col("offset") / (4 << 20))).sortWithinPartitions("package", "offset")
    return spread.mapInArrow(run, RECORD)


def new_folder(spark: SparkSession) -> str:
    """A folder for packages that every executor can reach."""
    return f"{scratch_root(spark)}/packages/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
