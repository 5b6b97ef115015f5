from __future__ import annotations

import base64
import gzip
import hashlib
import io
import random
import zipfile

import pyarrow as pa
import pytest

from lexora.llm import queries, url_models, warc_zip

PAGES = "page_id long, url string, html string, sha string, keep int, payload string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, None, 1, "p") for r in rows], PAGES).repartition(2)


def sha(x: bytes) -> str:
    return base64.b32encode(hashlib.sha1(x).digest()).decode()


def test_round_trip(spark):
    long = "x" * 300_000 + "\u00e9"
    rows = [(1, "http://a", "same"), (2, None, "same"), (3, "http://b\r\nX: y", "other"), (4, "u", None), (5, "u", ""), (None, "v", "same"), (6, "w", long), (2, None, "same"), (None, None, "alone"), (None, "z", "alone"), (-7, "q", "a\r\n\r\nb\0"), (8, "http://a.com/%20b?x=%25", "eight"), (9, " http://x ", "nine"), (10, "", "ten"), (11, "http://\u4e2d/\u2028 %0A", "eleven")]
    m = warc_zip.write(pages(spark, rows))
    got = warc_zip.read(spark, m).collect()
    payload = {}
    for _, _, h in rows:
        payload[sha((h or "").encode())] = (h or "").encode()
    most = {"same": 2, "other": 3, "": 5, long: 6, "alone": None, "a\r\n\r\nb\0": -7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11}
    want = sorted(((i, u, sha((h or "").encode()), len((h or "").encode()), "response" if i == most[h or ""] else "revisit", None if i == most[h or ""] else most[h or ""]) for i, u, h in rows), key=str)
    assert sorted(((r.page_id, r.url, r.payload_digest, r.payload_bytes, r.record_type, r.refers_to) for r in got), key=str) == want
    assert all(bytes(r.payload) == payload[r.payload_digest] for r in got if r.record_type == "response")
    assert m.agg({"records": "sum"}).first()[0] == len(rows)


def test_least_bytes_and_many_archives(spark):
    rows = [(i, "u", "tiny" if i % 2 else "long enough payload") for i in range(40)]
    m = warc_zip.write(pages(spark, rows), least=10, roll=500)
    assert m.count() > 4
    got = warc_zip.read(spark, m, payload=False).collect()
    assert sum(r.record_type == "revisit" for r in got) == 19 and all(r.refers_to == 38 for r in got if r.record_type == "revisit")


def test_no_pages(spark):
    assert warc_zip.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_archives_are_zip_files():
    for zip64 in (True, False):
        sink = pa.BufferOutputStream()
        keep = pa.PythonFile(out := io.BytesIO(), "w")
        del sink
        w = warc_zip.ZipWriter(keep, zip64)
        w.begin("a.txt"), w.write(b"hello "), w.write(b"there"), w.end()
        w.begin("b/c.txt"), w.end()
        close, keep_bytes = keep.close, out.getvalue
        w.out = type("F", (), {"write": keep.write, "close": staticmethod(lambda: None)})()
        w.close()
        data = keep_bytes()
        z = zipfile.ZipFile(io.BytesIO(data))
        assert z.testzip() is None and z.read("a.txt") == b"hello there" and z.namelist() == ["a.txt", "b/c.txt"]
        f = pa.BufferReader(data)
        found = warc_zip.members(f)
        assert data[warc_zip.data_at(f, found["a.txt"]) :][:11] == b"hello there" and found["b/c.txt"].size == 0
        close()


def test_reads_archives_of_others():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.comment = b"a comment with PK\x05\x06 in it"
        z.writestr("x", b"123")
        z.writestr("y", b"456" * 99, compress_type=zipfile.ZIP_DEFLATED)
    f = pa.BufferReader(out.getvalue())
    m = warc_zip.members(f)
    assert out.getvalue()[warc_zip.data_at(f, m["x"]) :][:3] == b"123"
    with pytest.raises(warc_zip.BadArchive):
        warc_zip.data_at(f, m["y"])
    with pytest.raises(warc_zip.BadArchive):
        warc_zip.members(pa.BufferReader(b"no archive at all, not even nearly"))


def foreign(kind, payload, name="<urn:uuid:1>", **more):
    block = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n" + payload
    head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", "WARC-Target-URI: http://x/%41", *[f"{k}:{v}" for k, v in more.items()], f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


def test_archives_of_others_are_read(tmp_path):
    """Other names of members, compressed indexes with other fields, records of other types and without digests; no index at all."""
    records = [foreign("warcinfo", b"about"), foreign("response", b"one", **{"warc-payload-digest": "sha1:" + sha(b"one")}), foreign("request", b""), foreign("response", b"two" * 50_000), foreign("revisit", b"")]
    at = [sum(map(len, records[:k])) for k in range(len(records))]
    lines = "".join(f'x,y)/ 2020 {{"url": "http://x/", "digest": "d", "filename": "data.warc.gz", "offset": "{o}", "length": {len(r)}}}\n' for o, r in zip(at, records, strict=True))
    for k, index in enumerate([("indexes/a.cdx.gz", gzip.compress(b"!meta 0 {}\n" + lines.encode())), ("indexes/b.cdxj", lines.encode()), None]):
        with zipfile.ZipFile(tmp_path / f"{k}.wacz", "w") as z:
            z.writestr("datapackage.json", b"{}")
            z.writestr("archive/data.warc.gz", b"".join(records))
            if index:
                z.writestr(*index)
        got = list(warc_zip.ranged(f"file://{tmp_path}/{k}.wacz"))
        assert [(r["page_id"], r["url"], r["record_type"], r["payload"], r["payload_digest"]) for r in got] == [(None, "http://x/%41", "response", b"one", sha(b"one")), (None, "http://x/%41", "response", b"two" * 50_000, sha(b"two" * 50_000)), (None, "http://x/%41", "revisit", None, None)]


def test_query_op1(spark, sf_dir):
    got = queries.op1_warc_zip(spark, sf_dir).collect()
    rows = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    last = {}
    for i, html in rows.items():
        last[html] = max(i, last.get(html, i))
    want = {i: (len(h), sha(h), "response" if last[h] == i else "revisit", None if last[h] == i else last[h]) for i, h in rows.items()}
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == want and len(got) == len(want)


# ---- URLs


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:end], rest[end:]
    cut = min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])
    return "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in host), tail[:cut]


RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


URLS = [None, "", "no scheme", "://", "http://", "http://Example.COM/en/7?x", "https://a.example.com/en/8", "http://notexample.com/en/7", "http://example.net/de/80", "x://é.net/de/?q#f", "http://com/en/", "http://org/es/a#b?c", "http://org?/es/", "a://b://c.org/es/", "http://h/" + "p" * 20_000, "http://casino-win.example.org/fr/1", "http://clean.example.org/fr/1", "http://\n.org/es/"]


def test_rules_and_parts(spark):
    rows = [(i, u, "s", "v") for i, u in enumerate(URLS)] + [(None, URLS[5], None, None)] * 2
    got = url_models.judge(spark.createDataFrame(rows, "page_id long, url string, score string, verdict string")).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id is None:
            assert r.host == "example.com"
            continue
        host, path = parts(URLS[r.page_id])
        name, verdict = rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, name)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
        assert (r.score is None) == (not URLS[r.page_id])
    assert url_models.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_query_op2(spark, sf_dir):
    got = queries.op2_url_models(spark, sf_dir).collect()
    want = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    assert len(got) == len(want)
    for r in got:
        host, path = parts(want[r.page_id])
        assert (r.host, r.path) == (host, path) and (r.rule, r.rule and r.verdict) == rule(host, path)
