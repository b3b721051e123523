"""Readers of document files as DataFrames: DOCX paragraphs, PDF text items, and server-sent events.

Files come through Spark's ``binaryFile`` reader, so they may be in any store
that Spark reads; parsing happens row by row inside the tasks.
"""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.operators import ingest
from clausemill.sources import tracked

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def docx_paragraphs_of(content: bytes) -> list[dict]:
    """Paragraph texts of a DOCX package; deleted text and field codes are left out; tracked changes are flagged.  A broken package has none."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            root = ET.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, zlib.error, KeyError, EOFError, ET.ParseError):
        return []
    out = []
    for n, p in enumerate(root.iter(f"{W}p")):
        parts, revised = [], False

        def walk(node):
            nonlocal revised
            for child in node:
                if child.tag in (f"{W}ins", f"{W}del"):
                    revised = True
                if child.tag in (f"{W}pPr", f"{W}del", f"{W}instrText", f"{W}p"):
                    continue
                if child.tag == f"{W}t":
                    parts.append(child.text or "")
                elif child.tag == f"{W}tab":
                    parts.append("\t")
                elif child.tag in (f"{W}br", f"{W}cr"):
                    parts.append("\n")
                elif child.tag == f"{W}noBreakHyphen":
                    parts.append("-")
                else:
                    walk(child)

        walk(p)
        out.append({"paragraph": n, "text": "".join(parts), "has_revisions": revised})
    return out


def docx_paragraphs(files: DataFrame) -> DataFrame:
    """``(path, paragraph, text, has_revisions)`` of DOCX ``files (path, content)``."""

    @F.pandas_udf("array<struct<paragraph:int,text:string,has_revisions:boolean>>")
    def read(content: pd.Series) -> pd.Series:
        return content.map(docx_paragraphs_of)

    return files.select("path", F.inline(read("content")))


def write_tracked(content: bytes, edits: dict[int, list[tuple[str, str]]], author: str, date: str) -> bytes:
    """The package with the given paragraphs as tracked changes: word operations ``(equal|delete|insert, text)`` by paragraph number."""
    root = tracked.parse(tracked.read_part(content))
    paragraphs, ids = list(root.iter("w:p")), tracked.next_ids(root)
    for n, ops in edits.items():
        for at, removed, added in reversed(tracked.changes(ops)):
            tracked.change(paragraphs[n], at, removed, added, ids, author, date)
    return tracked.with_body(content, root)


_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
_OPERATORS = re.compile(rb"(-?[\d.]+) (-?[\d.]+) Td|(?:-?[\d.]+ ){4}(-?[\d.]+) (-?[\d.]+) Tm|/\w+ ([\d.]+) Tf|\(((?:\\.|[^\\()])*)\)\s*Tj|(BT)")


def _inflated(data: bytes) -> bytes:
    """Inflated bytes, as far as a damaged stream goes, so that its page keeps its number and its beginning."""
    out, unpack = [], zlib.decompressobj()
    for at in range(0, len(data), 4096):
        try:
            out.append(unpack.decompress(data[at : at + 4096]))
        except zlib.error:
            break
    return b"".join(out)


def pdf_items_of(content: bytes) -> list[dict]:
    """Positioned text items of a PDF with plain or Flate streams and simple fonts; widths are half the font size a character.

    Each stream that shows text is a page.
    """
    out, page = [], 0
    for m in _STREAM.finditer(content):
        data = m[1]
        if b"FlateDecode" in content[max(0, content.rfind(b" obj", 0, m.start())) : m.start()]:
            data = _inflated(data)
        if b"BT" not in data:
            continue
        page += 1
        x = y = 0.0
        size, n = 12.0, 0
        for o in _OPERATORS.finditer(data):
            if o[7]:
                x = y = 0.0
            elif o[1]:
                x, y = x + float(o[1]), y + float(o[2])
            elif o[3]:
                x, y = float(o[3]), float(o[4])
            elif o[5]:
                size = float(o[5])
            else:
                s = re.sub(rb"\\(.)", rb"\1", o[6]).decode("latin-1")
                out.append({"page": page, "item": n, "str": s, "x": x, "y": y, "width": len(s) * size / 2, "height": size})
                n += 1
    return out


def pdf_items(files: DataFrame) -> DataFrame:
    """``(path, page, item, str, x, y, width, height)`` of PDF ``files (path, content)``."""

    @F.pandas_udf("array<struct<page:int,item:int,str:string,x:double,y:double,width:double,height:double>>")
    def read(content: pd.Series) -> pd.Series:
        return content.map(pdf_items_of)

    return files.select("path", F.inline(read("content")))


def pdf_texts(files: DataFrame) -> DataFrame:
    """``(path, page, text)`` of PDF ``files (path, content)``: items of a page with what separates them."""
    items = pdf_items(files).withColumn("page", F.struct("path", "page"))
    parts = F.array_sort(F.collect_list(F.struct("item", F.concat("separator", "str").alias("x"))))
    return ingest.separators(items).groupBy("page").agg(F.array_join(F.transform(parts, lambda p: p["x"]), "").alias("text")).select("page.path", "page.page", "text")


def docx_texts(files: DataFrame) -> DataFrame:
    """``(path, text)`` of DOCX ``files (path, content)``: paragraphs joined by line feeds."""
    parts = F.array_sort(F.collect_list(F.struct("paragraph", "text")))
    return docx_paragraphs(files).groupBy("path").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))


def server_events(body: Column) -> Column:
    """Data payloads of a server-sent event stream, in order; events are divided by blank lines."""
    parts = F.transform(F.split(body, "\r?\n\r?\n"), lambda e: F.array_join(F.transform(F.filter(F.split(e, "\r?\n"), lambda x: x.startswith("data:")), lambda x: F.regexp_replace(x, "^data: ?", "")), "\n"))
    return F.filter(parts, lambda p: p != "")
