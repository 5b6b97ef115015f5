"""EPUB files as rows: metadata, spine documents and contents.

Files come as (path, content), from Spark's binaryFile source or any other
table, so that every file system that Spark reads will do.
"""

from __future__ import annotations

import io
import posixpath
import urllib.parse
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NS = {"c": "urn:oasis:names:tc:opendocument:xmlns:container", "o": "http://www.idpf.org/2007/opf", "d": "http://purl.org/dc/elements/1.1/", "n": "http://www.daisy.org/z3986/2005/ncx/"}
_XHTML, _EPUB = "{http://www.w3.org/1999/xhtml}", "{http://www.idpf.org/2007/ops}"


def files(spark: SparkSession, folder: str) -> DataFrame:
    """The EPUB files below a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").option("recursiveFileLookup", True).load(folder).select("path", "content")


def picked(of: DataFrame) -> DataFrame:
    """The one file that an import takes: the first by path."""
    return of.orderBy("path").limit(1)


class _Book:
    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        if self.zip.read("mimetype").strip() != b"application/epub+zip":
            raise ValueError("no EPUB")
        root = ET.fromstring(self.zip.read("META-INF/container.xml")).find(".//c:rootfile", _NS).get("full-path")
        self.base, self.opf = posixpath.dirname(root), ET.fromstring(self.zip.read(root))
        self.items = {i.get("id"): i for i in self.opf.iterfind("o:manifest/o:item", _NS)}

    def read(self, href: str) -> bytes:
        return self.zip.read(posixpath.normpath(posixpath.join(self.base, urllib.parse.unquote(href))))

    def texts(self, name: str) -> list[str]:
        return [x.text.strip() for x in self.opf.iterfind(f"o:metadata/d:{name}", _NS) if x.text and x.text.strip()]

    def metadata(self) -> tuple:
        unique = self.opf.get("unique-identifier")
        ids = [x.text.strip() for x in self.opf.iterfind("o:metadata/d:identifier", _NS) if x.text and (x.get("id") == unique or not unique)]
        cover = next((i for i in self.items.values() if "cover-image" in (i.get("properties") or "").split()), None)
        if cover is None:
            named = next((m.get("content") for m in self.opf.iterfind("o:metadata/o:meta", _NS) if m.get("name") == "cover"), None)
            cover = self.items.get(named)
        return next(iter(self.texts("title")), None), self.texts("creator"), next(iter(ids), None), None if cover is None else self.read(cover.get("href"))

    def spine(self) -> Iterator[tuple]:
        for n, ref in enumerate(self.opf.iterfind("o:spine/o:itemref", _NS)):
            href = self.items[ref.get("idref")].get("href")
            yield n, href, self.read(href).decode("utf-8", "replace")

    def contents(self) -> Iterator[tuple]:
        """node, parent, position, href and title: from the navigation document, else from the older one."""
        nav = next((i for i in self.items.values() if "nav" in (i.get("properties") or "").split()), None)
        count = iter(range(1 << 31))

        def lists(ol: ET.Element, parent: int | None) -> Iterator[tuple]:
            for pos, li in enumerate(ol.findall(f"{_XHTML}li")):
                label = next((x for x in li if x.tag in (f"{_XHTML}a", f"{_XHTML}span")), None)
                node = next(count)
                yield node, parent, pos, None if label is None else label.get("href"), None if label is None else " ".join("".join(label.itertext()).split())
                for inner in li.findall(f"{_XHTML}ol"):
                    yield from lists(inner, node)

        def points(of: ET.Element, parent: int | None) -> Iterator[tuple]:
            for pos, p in enumerate(of.findall("n:navPoint", _NS)):
                node, title, at = next(count), p.find("n:navLabel/n:text", _NS), p.find("n:content", _NS)
                yield node, parent, pos, None if at is None else at.get("src"), None if title is None else title.text
                yield from points(p, node)

        if nav is not None:
            toc = next((x for x in ET.fromstring(self.read(nav.get("href"))).iter(f"{_XHTML}nav") if x.get(f"{_EPUB}type") == "toc"), None)
            if toc is not None and (ol := toc.find(f"{_XHTML}ol")) is not None:
                yield from lists(ol, None)
            return
        ncx = next((i for i in self.items.values() if i.get("media-type") == "application/x-dtbncx+xml"), None)
        if ncx is not None and (of := ET.fromstring(self.read(ncx.get("href"))).find("n:navMap", _NS)) is not None:
            yield from points(of, None)


_BROKEN = (zipfile.BadZipFile, zlib.error, ET.ParseError, KeyError, ValueError, AttributeError, RuntimeError, NotImplementedError, EOFError)


def _rows(of: DataFrame, schema: str, columns: list[str], read: Callable[[_Book], list[tuple]], broken: list[tuple]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    rows = read(_Book(bytes(content)))
                except _BROKEN:
                    rows = broken
                yield pd.DataFrame([(path, *r) for r in rows], columns=columns).astype(object)

    return of.select("path", "content").mapInPandas(run, schema)


def metadata(of: DataFrame) -> DataFrame:
    """path, title, authors, canonical_id and cover of each file; a file that can't be read has no title, no authors and so on."""
    return _rows(of, "path string, title string, authors array<string>, canonical_id string, cover binary", ["path", "title", "authors", "canonical_id", "cover"], lambda b: [b.metadata()], [(None, [], None, None)])


def documents(of: DataFrame) -> DataFrame:
    """path, spine_no, href and html of each document in reading order; none of a file that is no EPUB."""
    return _rows(of, "path string, spine_no long, href string, html string", ["path", "spine_no", "href", "html"], lambda b: list(b.spine()), [])


def contents(of: DataFrame) -> DataFrame:
    """book_id, node_id, parent_id, pos, href and title of each file's table of contents; empty where it can't be read."""
    out = _rows(of, "book_id string, node_id long, parent_id long, pos long, href string, title string", ["book_id", "node_id", "parent_id", "pos", "href", "title"], lambda b: list(b.contents()), [])
    return out.select("book_id", "node_id", "parent_id", "pos", "href", "title")


def packed(title: str | None, authors: list[str], identifier: str | None, chapters: list[tuple[str, str]], cover: bytes | None = None) -> bytes:
    """A small EPUB; chapters are (title, body)."""
    from xml.sax.saxutils import escape

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(zipfile.ZipInfo("mimetype"), "application/epub+zip")
        z.writestr(zipfile.ZipInfo("META-INF/container.xml"), f'<container xmlns="{_NS["c"]}" version="1.0"><rootfiles><rootfile full-path="OPS/book.opf" media-type="application/oebps-package+xml"/></rootfiles></container>')
        meta = "".join([f"<dc:title>{escape(title)}</dc:title>" if title is not None else "", *[f"<dc:creator>{escape(a)}</dc:creator>" for a in authors], f'<dc:identifier id="uid">{escape(identifier)}</dc:identifier>' if identifier is not None else ""])
        items = "".join(f'<item id="c{i}" href="c{i}.xhtml" media-type="application/xhtml+xml"/>' for i in range(len(chapters))) + '<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>' + ('<item id="cover" href="cover.jpg" media-type="image/jpeg" properties="cover-image"/>' if cover else "")
        z.writestr(zipfile.ZipInfo("OPS/book.opf"), f'<package xmlns="{_NS["o"]}" xmlns:dc="{_NS["d"]}" version="3.0" unique-identifier="uid"><metadata>{meta}</metadata><manifest>{items}</manifest><spine>{"".join(f"""<itemref idref="c{i}"/>""" for i in range(len(chapters)))}</spine></package>')
        links = "".join(f'<li><a href="c{i}.xhtml">{escape(t)}</a></li>' for i, (t, _) in enumerate(chapters))
        z.writestr(zipfile.ZipInfo("OPS/nav.xhtml"), f'<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><body><nav epub:type="toc"><ol>{links}</ol></nav></body></html>')
        for i, (t, body) in enumerate(chapters):
            z.writestr(zipfile.ZipInfo(f"OPS/c{i}.xhtml"), f'<html xmlns="http://www.w3.org/1999/xhtml"><body><h1>{escape(t)}</h1><p>{escape(body)}</p></body></html>')
        if cover:
            z.writestr(zipfile.ZipInfo("OPS/cover.jpg"), cover)
    return out.getvalue()
