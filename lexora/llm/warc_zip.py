"""WARC records in ZIP archives: written in place, read by ranges.

An archive is a ZIP file of stored (method 0) members: WARC files, each record a
gzip member of its own, below archive/, and indexes below indexes/, with a line
for each record that ends in a JSON object of file name, offset and length.  A
reader parses the end-of-directory records (ZIP64 ones included), the central
directory and the members' local headers, reads the indexes, and then fetches
each record by a range of bytes; no member is extracted.  Archives of others are
read alike: indexes may be compressed, or absent, in which case a WARC file's
records are found one after the other.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import urllib.parse
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexora.llm.common import attach, cut
from lexora.shared import fresh

RECORDS, INDEX = "archive/records.warc.gz", "indexes/index.cdxj"
#: A field of ours: the target is percent-encoded as a whole, as it can't stand in a header.
ESCAPED = "X-Target-URI-Escaped"
#: Bytes read at once where no index tells a record's length.
STEP = 1 << 16
#: Bytes of records after which a task starts another archive.
ROLL = 256 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
U16, U32 = 0xFFFF, 0xFFFFFFFF


# ---- ZIP


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    stored: int
    header: int  # place of the local header


class BadArchive(ValueError):
    pass


def _exactly(file: pa.NativeFile, at: int, n: int) -> bytes:
    file.seek(at)
    out = file.read(n)
    if len(out) != n:
        raise BadArchive(f"{n} bytes at {at} end early")
    return out


def members(file: pa.NativeFile) -> dict[str, Member]:
    """The central directory, by way of the end records; members are located, not read."""
    size = file.size()
    tail_at = max(0, size - 22 - U16)
    tail = _exactly(file, tail_at, size - tail_at)
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0 and (len(tail) - at < 22 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(b"PK\x05\x06", 0, at)  # the mark inside a comment
    if at < 0:
        raise BadArchive("no end of central directory")
    _, _, _, count, length, start, _ = struct.unpack_from("<4H2LH", tail, at + 4)
    if U16 in (count,) or U32 in (length, start):
        locator_at = tail_at + at - 20
        if locator_at < 0 or (locator := _exactly(file, locator_at, 20))[:4] != b"PK\x06\x07":
            raise BadArchive("no ZIP64 locator")
        end64 = _exactly(file, struct.unpack_from("<Q", locator, 8)[0], 56)
        if end64[:4] != b"PK\x06\x06":
            raise BadArchive("no ZIP64 end of central directory")
        count, length, start = struct.unpack_from("<3Q", end64, 32)
    directory, out, p = _exactly(file, start, length), {}, 0
    for _ in range(count):
        if directory[p : p + 4] != b"PK\x01\x02":
            raise BadArchive("bad central directory")
        method, = struct.unpack_from("<H", directory, p + 10)
        stored, full, n_name, n_extra, n_comment = struct.unpack_from("<2L3H", directory, p + 20)
        header, = struct.unpack_from("<L", directory, p + 42)
        name = directory[p + 46 : p + 46 + n_name].decode("utf-8")
        extra, q = directory[p + 46 + n_name : p + 46 + n_name + n_extra], 0
        while q + 4 <= len(extra):
            tag, n = struct.unpack_from("<2H", extra, q)
            if tag == 1:  # the fields that don't fit above, in this order
                values = iter(struct.unpack_from(f"<{n // 8}Q", extra, q + 4))
                full = next(values) if full == U32 else full
                stored = next(values) if stored == U32 else stored
                header = next(values) if header == U32 else header
            q += 4 + n
        out[name] = Member(name, method, full, stored, header)
        p += 46 + n_name + n_extra + n_comment
    return out


def data_at(file: pa.NativeFile, m: Member) -> int:
    """Where a stored member's bytes begin: its local header has lengths of its own."""
    if m.method != 0 or m.size != m.stored:
        raise BadArchive(f"{m.name} isn't stored")
    head = _exactly(file, m.header, 30)
    if head[:4] != b"PK\x03\x04":
        raise BadArchive(f"no local header of {m.name}")
    return m.header + 30 + sum(struct.unpack_from("<2H", head, 26))


class ZipWriter:
    """Stored members written front to back; each has ZIP64 sizes in a data descriptor, so nothing is held or sought.

    `zip64` set, the end records are ZIP64 ones even where the archive is small.
    """

    def __init__(self, out: pa.NativeFile, zip64: bool = True):
        self.out, self.at, self.zip64, self.done = out, 0, zip64, []
        self.name = ""

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        self.name, self.header = name, self.at
        raw = name.encode()
        extra = struct.pack("<2H2Q", 1, 16, 0, 0)
        self._put(struct.pack("<L5H3L2H", 0x04034B50, 45, 0x0808, 0, 0, 0x21, 0, U32, U32, len(raw), len(extra)) + raw + extra)
        self.start, self.crc = self.at, 0

    def write(self, data: bytes) -> tuple[int, int]:
        """Where in the member data lies, and its length."""
        at = self.at - self.start
        self.crc = zlib.crc32(data, self.crc)
        self._put(data)
        return at, len(data)

    def end(self) -> None:
        size = self.at - self.start
        self._put(struct.pack("<2L2Q", 0x08074B50, self.crc, size, size))
        self.done.append((self.name.encode(), self.crc, size, self.header))

    def close(self) -> None:
        start = self.at
        for raw, crc, size, header in self.done:
            extra = struct.pack("<2H3Q", 1, 24, size, size, header)
            self._put(struct.pack("<L6H3L5H2L", 0x02014B50, 45, 45, 0x0808, 0, 0, 0x21, crc, U32, U32, len(raw), len(extra), 0, 0, 0, 0, U32) + raw + extra)
        length, count = self.at - start, len(self.done)
        if self.zip64:
            end64 = self.at
            self._put(struct.pack("<LQ2H2L4Q", 0x06064B50, 44, 45, 45, 0, 0, count, count, length, start) + struct.pack("<2LQL", 0x07064B50, 0, end64, 1))
        small = (U16, U16, U32, U32) if self.zip64 else (count, count, length, start)
        self._put(struct.pack("<L2H2H2LH", 0x06054B50, 0, 0, *small, 0))
        self.out.close()


# ---- WARC


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(row: dict) -> bytes:
    """One gzip member.  row: page_id, url, payload (absent in a revisit), payload_bytes, payload_digest, refers_to, type."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row["payload_bytes"]
    block = http + row["payload"] if row["type"] == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {row['type']}", f"WARC-Record-ID: <urn:page:{_named(row['page_id'])}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    url = row["url"]
    if url is not None:
        plain = not _UNSAFE.search(url) and url == url.strip()
        head += [f"WARC-Target-URI: {url}"] if plain else [f"WARC-Target-URI: {urllib.parse.quote(url, safe='')}", f"{ESCAPED}: 1"]
    head += [f"WARC-Payload-Digest: sha1:{row['payload_digest']}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if row["type"] == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{_named(row['refers_to'])}>"]
    z = zlib.compressobj(1, wbits=31)
    return z.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


_UNSAFE = re.compile(r"[\x00-\x1f\x7f-\x9f\u2028\u2029]")


def _named(page_id: int | None) -> str:
    return "null" if page_id is None else str(page_id)


def _number(urn: str | None) -> int | None:
    """The page_id of a record's name; null for the names that others give."""
    name = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(name) if re.fullmatch(r"-?\d{1,19}", name) else None


def parse(data: bytes) -> dict | None:
    """A response's or revisit's fields, None for records of other types; a payload is held against its digest and length where these are given."""
    raw = zlib.decompress(data, wbits=31) if data[:2] == b"\x1f\x8b" else data
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    if not lines[0].startswith("WARC/") or len(rest) < (n := int(fields.get("content-length", -1))) or n < 0:
        raise BadArchive("bad record")
    kind = fields.get("warc-type")
    if kind not in ("response", "revisit"):
        return None
    http, _, payload = rest[:n].partition(b"\r\n\r\n")
    named = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    size = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
    if kind == "response" and (len(payload) != size or named and len(named) == 32 and digest(payload) != named):
        raise BadArchive("payload and its length or digest differ")
    url = fields.get("warc-target-uri")
    return {
        "page_id": _number(fields.get("warc-record-id")), "url": urllib.parse.unquote(url) if url is not None and ESCAPED.lower() in fields else url,
        "payload": payload if kind == "response" else None, "payload_bytes": size, "payload_digest": named or (digest(payload) if kind == "response" else None), "record_type": kind,
        "refers_to": _number(fields.get("warc-refers-to")) if kind == "revisit" else None,
    }


# ---- over tables


def _opened(where: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system for a path as Spark names it."""
    for spark_name, arrow_name in (("s3a://", "s3://"), ("s3n://", "s3://")):
        where = where.replace(spark_name, arrow_name, 1) if where.startswith(spark_name) else where
    return pafs.FileSystem.from_uri(where)


def write(pages: DataFrame, where: str | None = None, least: int = 0, salts: int = 32, roll: int = ROLL) -> DataFrame:
    """Write a record for every row of pages; the manifest (path, records) of the archives.

    Of the records with equal payloads of at least `least` bytes, those with the
    group's largest page_id are responses and the others revisit it; smaller
    payloads are all responses.  Archives that a failed or repeated task leaves
    aren't in the manifest, which is written with Spark's commit.
    """
    spark = pages.sparkSession
    where = where or fresh(spark, "warc")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("payload")))
    typed = attach(rows, ["sha"], F.struct("page_id", "url"), [F.max("page_id").alias("_k")], [F.max("_k").alias("keep")], salts)
    revisit = (F.octet_length("payload") >= least) & ~F.col("page_id").eqNullSafe(F.col("keep"))
    typed = typed.select("page_id", "url", F.octet_length("payload").cast("long").alias("payload_bytes"), "sha", F.when(~revisit, F.col("payload")).alias("payload"), F.when(revisit, F.col("keep")).alias("refers_to"), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("type"))
    folder = where

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _opened(folder)
        fs.create_dir(base, recursive=True)
        done: list[tuple[str, int]] = []
        zf, index, name = None, [], ""

        def finish() -> None:
            zf.end()
            zf.begin(INDEX)
            zf.write("".join(f"page:{k} 19700101000000 {json.dumps({'filename': RECORDS.split('/')[-1], 'offset': str(o), 'length': str(n)})}\n" for k, o, n in index).encode())
            zf.end()
            zf.close()
            done.append((f"{folder}/{name}", len(index)))

        for b in batches:
            for row in (r for k in range(0, b.num_rows, 256) for r in b.slice(k, 256).to_pylist()):
                if zf is None:
                    name, index = f"{uuid.uuid4().hex}.zip", []
                    zf = ZipWriter(fs.open_output_stream(f"{base}/{name}"))
                    zf.begin(RECORDS)
                row["payload_digest"] = base64.b32encode(row["sha"]).decode()
                index.append((_named(row["page_id"]), *zf.write(record(row))))
                if zf.at >= roll:
                    finish()
                    zf = None
        if zf is not None:
            finish()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["path", "records"])

    return cut(typed.mapInArrow(run, "path string, records long"), "warc-manifest")


def _entries(f: pa.NativeFile, of: dict[str, Member]) -> Iterator[tuple[str, int, int]]:
    """Member, offset and length of each record that the indexes name."""
    files = {m.split("/")[-1]: m for m in of if _is_warc(m)}
    for name, m in sorted(of.items()):
        if not re.fullmatch(r"indexes/.*\.(cdxj?|jsonl)(\.gz)?", name):
            continue
        data = _exactly(f, data_at(f, m), m.size)
        if name.endswith(".gz"):
            data = gzip.decompress(data)
        for line in data.splitlines():
            entry = json.loads(line[line.find(b"{") :]) if b"{" in line else {}
            if "offset" in entry and "length" in entry:
                member = files.get(str(entry.get("filename", "")).split("/")[-1]) or (next(iter(files.values())) if len(files) == 1 else None)
                if member is None:
                    raise BadArchive(f"no WARC file {entry.get('filename')}")
                yield member, int(entry["offset"]), int(entry["length"])


def _is_warc(name: str) -> bool:
    return bool(re.search(r"\.warc(\.gz)?$", name))


def _walked(f: pa.NativeFile, m: Member) -> Iterator[bytes]:
    """The records of a WARC file of gzip members, one after the other, without an index."""
    at, end = data_at(f, m), data_at(f, m) + m.size
    while at < end:
        z, parts, read = zlib.decompressobj(wbits=31), [], at
        while not z.eof:
            if read >= end:
                raise BadArchive("a record ends early")
            step = _exactly(f, read, min(STEP, end - read))
            parts.append(z.decompress(step))
            read += len(step)
        at = read - len(z.unused_data)
        yield b"".join(parts)


def ranged(path: str) -> Iterable[dict]:
    """The responses and revisits of an archive, each by one range of bytes."""
    fs, name = _opened(path)
    with fs.open_input_file(name) as f:
        of = members(f)
        places: dict[str, int] = {}
        for member, offset, length in _entries(f, of):
            if member not in places:
                places[member] = data_at(f, of[member])
            if (r := parse(_exactly(f, places[member] + offset, length))) is not None:
                yield r
        if not places:
            for member in filter(_is_warc, sorted(of)):
                yield from filter(None, map(parse, _walked(f, of[member])))


FIELDS = {"page_id": pa.int64(), "url": pa.string(), "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}


def read(spark: SparkSession, manifest: DataFrame, payload: bool = True) -> DataFrame:
    """The records of the archives in a manifest; `payload` unset, without the payloads, which are still checked."""
    kept = {k: t for k, t in FIELDS.items() if payload or k != "payload"}
    schema = "page_id long, url string, " + "payload binary, " * payload + "payload_bytes long, payload_digest string, record_type string, refers_to long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kept.items()], names=list(kept))

        for b in batches:
            for path in b.column(0).to_pylist():
                rows, size = [], 0
                for r in ranged(path):
                    size += len(r["payload"] or b"") if payload else 64
                    rows.append({k: r[k] for k in kept})
                    if size >= 1 << 22:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    archives = manifest.select("path").repartition(max(1, min(manifest.count(), 10_000)))
    return archives.mapInArrow(run, schema)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write pages to archives and read them back: one row for each row of pages, without payloads.

    A null html is an empty payload; a null url has no target field; null and
    repeated page_ids stay: all rows with a payload's largest page_id are
    responses (a null is below any id; in a group of nulls all are responses).
    An empty table gives an empty result; other columns aren't read.
    """
    return read(pages.sparkSession, write(pages, least=least), payload=False)
