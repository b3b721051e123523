"""Ingest: file-type verdicts, block text of HTML, upload checks, job de-duplication, deletes."""

from __future__ import annotations

import html.parser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIB, SCAN = 1 << 20, 64 << 10
# Leading bytes in hexadecimal.
PDF, ZIP, ZIP_EMPTY, OLE2 = "255044462D", "504B0304", "504B0506", "D0CF11E0A1B11AE1"


def sniff(content: Column) -> Column:
    """``struct(kind, reason)`` of file bytes: PDF, DOCX, or why the file is rejected."""
    lead = F.hex(F.substring(content, 1, 8))
    has = lambda part, needle: F.position(F.lit(needle.encode().hex().upper()), F.hex(part)) > 0
    wide = lambda part, needle: F.position(F.lit(needle.encode("utf-16-le").hex().upper()), F.hex(part)) > 0
    size = F.octet_length(content)
    head, tail = F.substring(content, 1, SCAN), F.substr(content, F.greatest(size - SCAN + 1, F.lit(1)))
    word = F.when(size <= 2 * SCAN, has(content, "word/document.xml")).otherwise(has(head, "word/document.xml") | has(tail, "word/document.xml"))
    verdict = lambda kind, reason: F.struct(F.lit(kind).alias("kind"), F.lit(reason).cast("string").alias("reason"))
    rejected = lambda reason: verdict("rejected", reason)
    return (
        F.when(content.isNull() | (size == 0), rejected("EMPTY_FILE"))
        .when(lead.startswith(PDF), verdict("PDF", None))
        .when(lead.startswith(ZIP), F.when(word, verdict("DOCX", None)).otherwise(rejected("UNSUPPORTED_TYPE")))
        .when(lead.startswith(ZIP_EMPTY), rejected("UNSUPPORTED_TYPE"))
        .when(lead == OLE2, F.when(wide(head, "EncryptedPackage"), rejected("ENCRYPTED_DOCX")).when(wide(head, "WordDocument"), rejected("LEGACY_DOC_FORMAT")).otherwise(rejected("UNSUPPORTED_TYPE")))
        .otherwise(rejected("UNSUPPORTED_TYPE"))
    )


def content_type(kind: Column) -> Column:
    return F.when(kind == "PDF", "application/pdf").when(kind == "DOCX", "application/vnd.openxmlformats-officedocument.wordprocessingml.document")


# The HTTP status of each rejection, and the code of each HTTP status.
REJECTED = {"EMPTY_FILE": 400, "LEGACY_DOC_FORMAT": 415, "ENCRYPTED_DOCX": 400, "UNSUPPORTED_TYPE": 415}
CODES = {404: "NOT_FOUND", 400: "BAD_REQUEST", 413: "FILE_TOO_LARGE", 415: "UNSUPPORTED_TYPE", 429: "RATE_LIMITED"}


def _looked_up(values: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


def rejection_status(reason: Column) -> Column:
    """HTTP status of a rejection reason; null for other reasons."""
    return _looked_up(REJECTED, reason)


def code_for_status(status: Column) -> Column:
    """Error code of an HTTP status; INTERNAL for any other, null included."""
    return F.coalesce(_looked_up(CODES, status), F.lit("INTERNAL"))


def model_code(status: Column, timed_out: Column) -> Column:
    """Error code of a failed model call: too many or too large requests, then refused ones, then timeouts."""
    return F.when(status.isin(429, 413), "LLM_RATE_LIMITED").when(status.isin(401, 403), "LLM_UNAVAILABLE").when(timed_out, "LLM_TIMEOUT").otherwise("LLM_UNAVAILABLE")


def valid_items(items: Column) -> Column:
    """The entries of an array of number arrays that hold seven numbers and no null; a null array gives an empty one."""
    seven = lambda x: x.isNotNull() & (F.size(x) == 7) & F.forall(x, lambda v: v.isNotNull())
    return F.filter(F.coalesce(items, F.array().cast("array<array<double>>")), seven)


def cents(x: Column) -> Column:
    """``x`` rounded to two decimals, halves upward."""
    return F.floor(x * 100 + 0.5) / 100


def known(ids: DataFrame, rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """``ids`` with ``found``: whether ``rows`` has the key; a null key is never found."""
    return ids.join(rows.select(key).distinct().withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def ingest_report(files: DataFrame, known: DataFrame, most: int = 25 * MIB) -> DataFrame:
    """Upload checks of ``files (file_id, content, created_at)``: verdict, hash, and the earlier upload of the same bytes, if any.

    ``known (sha256, doc_id)`` are earlier documents.
    """
    rows = files.select("file_id", "created_at", F.octet_length("content").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), sniff(F.col("content")).alias("v"))
    first = F.first_value("file_id").over(Window.partitionBy("sha256").orderBy("created_at", "file_id"))
    rows = rows.withColumn("first_file", first).join(known.groupBy("sha256").agg(F.min("doc_id").alias("known_doc")), "sha256", "left")
    reason = F.when(F.col("size_bytes") > most, "FILE_TOO_LARGE").otherwise(F.col("v.reason"))
    same = F.when(F.col("first_file") != F.col("file_id"), F.col("first_file"))
    return rows.select("file_id", "sha256", "size_bytes", F.when(reason.isNull(), F.col("v.kind")).alias("kind"), reason.alias("reason"), "known_doc", same.alias("same_as"))


def earliest_copy(docs: DataFrame, order: str = "doc_id") -> DataFrame:
    """``(doc_id, sha256, first_doc)`` of documents that repeat an earlier text."""
    hashed = docs.where("text is not null").select(F.col(order).alias("doc_id"), F.sha2("text", 256).alias("sha256"))
    firsts = hashed.groupBy("sha256").agg(F.min("doc_id").alias("first_doc"))
    return hashed.join(firsts, "sha256").where("doc_id <> first_doc").select("doc_id", "sha256", "first_doc")


def dedupe_jobs(jobs: DataFrame) -> DataFrame:
    """First job of each singleton key that is not null; jobs without a key all stay."""
    rank = F.row_number().over(Window.partitionBy("singleton_key").orderBy("created_at", "job_id"))
    keyed = jobs.where("singleton_key is not null").withColumn("rank", rank).where("rank = 1").drop("rank")
    return keyed.unionByName(jobs.where("singleton_key is null"))


def separators(items: DataFrame) -> DataFrame:
    """``items (page, item, str, x, y, width, height)`` with ``separator``, what stands before each on its page: line feed, space or nothing."""
    w = Window.partitionBy("page").orderBy("item")
    before = lambda c: F.lag(c).over(w)
    spaced = F.col("str").rlike(r"^\s") | before("str").rlike(r"\s$")
    gap = F.col("x") - (before("x") + before("width"))
    sep = (
        F.when(before("str").isNull(), "")
        .when(F.abs(F.col("y") - before("y")) >= F.greatest(F.lit(1.0), F.col("height") / 2), "\n")
        .when(spaced, "")
        .when(gap > 0.15 * F.col("height"), " ")
        .otherwise("")
    )
    return items.withColumn("separator", sep)


# Tags that stay, tags that are text blocks, and tags that go with their content.
KEPT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li table thead tbody tr td th strong b em i u br span sup sub".split())
BLOCK_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li td th".split())
DROPPED_TAGS = frozenset("script style textarea option noscript".split())


class _Cleaner(html.parser.HTMLParser):
    """Keeps allowed tags (with colspan and rowspan) and text; gathers the text of blocks that hold no other block.

    A list inside a list item counts as standing after it, so the item keeps its own text.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.blocks: list[list] = []
        self.open: list[list] = []
        self.lists: list[bool] = []  # of each open list: whether it stands right inside a list item
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        if tag in DROPPED_TAGS:
            self.hidden += 1
        elif not self.hidden and tag in KEPT_TAGS:
            kept = "".join(f' {k}="{html.escape(v or "")}"' for k, v in attrs if tag in ("td", "th") and k in ("colspan", "rowspan"))
            self.out.append(f"<{tag}{kept}{' /' if tag == 'br' else ''}>")
            if tag in ("ul", "ol"):
                self.lists.append(bool(self.open) and self.open[-1][0] == "li")
            if tag in BLOCK_TAGS:
                if self.open and not (tag == "li" and self.lists and self.lists[-1]):
                    self.open[-1][2] = False
                block = [tag, [], True, len(self.out) - 1]
                self.open.append(block)
                self.blocks.append(block)
            elif tag == "br" and self.open:
                self.open[-1][1].append(" ")

    def handle_endtag(self, tag):
        if tag in DROPPED_TAGS:
            self.hidden = max(0, self.hidden - 1)
        elif not self.hidden and tag in KEPT_TAGS and tag != "br":
            self.out.append(f"</{tag}>")
            if tag in ("ul", "ol") and self.lists:
                self.lists.pop()
            if tag in BLOCK_TAGS and any(b[0] == tag for b in self.open):
                while self.open.pop()[0] != tag:
                    pass

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(html.escape(data, quote=False))
            if self.open:
                self.open[-1][1].append(data)


def clean_html(source: str) -> tuple[str, list[tuple[str, str]]]:
    """Sanitised HTML, and ``(tag, text)`` of its leaf blocks with folded text."""
    p = _Cleaner()
    p.feed(source or "")
    p.close()
    return "".join(p.out), [(tag, " ".join("".join(parts).split())) for tag, parts, leaf, _ in p.blocks if leaf]


def annotated(source: str) -> tuple[str, str]:
    """Sanitised HTML whose leaf blocks carry ``data-start`` and ``data-end``, and the text that these count in: block texts joined by line feeds."""
    p = _Cleaner()
    p.feed(source or "")
    p.close()
    at, texts = 0, []
    for _, parts, leaf, place in p.blocks:
        if leaf:
            texts.append(" ".join("".join(parts).split()))
            p.out[place] = f'{p.out[place][:-1]} data-start="{at}" data-end="{at + len(texts[-1])}">'
            at += len(texts[-1]) + 1
    return "".join(p.out), "\n".join(texts)


def sanitized(source: Column) -> Column:
    """The allow-listed form of HTML.

    Row by row, so that a worker holds a hundred pages at once; an Arrow batch holds 10,000, whatever their length.
    """
    return F.udf(lambda h: clean_html(h)[0], "string", useArrow=False)(source)


def _blocks_of(source: str) -> list[dict]:
    out, at = [], 0
    for tag, text in clean_html(source)[1]:
        out.append({"tag": tag, "start": at, "end": at + len(text), "text": text})
        at += len(text) + 1
    return out


def block_list(source: Column) -> Column:
    return F.udf(_blocks_of, "array<struct<tag:string,start:int,end:int,text:string>>", useArrow=False)(source)


def html_blocks(pages: DataFrame, key: str = "page_id", html_col: str = "html") -> DataFrame:
    """``(key, n, tag, start, end, text)``: leaf blocks with offsets in the text that joins them with line feeds."""
    return pages.select(key, F.posexplode(block_list(F.col(html_col))).alias("n", "b")).select(key, "n", "b.*")


def cascade_delete(doomed: DataFrame, children: dict[str, DataFrame], loosened: dict[str, DataFrame], key: str = "doc_id") -> dict[str, DataFrame]:
    """Tables after ``doomed`` keys are deleted: rows of ``children`` go, rows of ``loosened`` keep a null key."""
    out = {n: t.join(doomed, key, "left_anti") for n, t in children.items()}
    gone = doomed.select(F.col(key).alias("__gone")).distinct()
    for n, t in loosened.items():
        joined = t.join(gone, t[key] == gone["__gone"], "left")
        out[n] = joined.select(*[F.when(F.col("__gone").isNull(), F.col(c)).alias(c) if c == key else F.col(c) for c in t.columns])
    return out


def next_status(kind: Column, text_chars: Column, fully_scanned: Column) -> tuple[Column, Column]:
    """Final status and error code of a processed document; unreadable outcomes never become READY."""
    code = F.when(fully_scanned, "SCANNED_DOCUMENT").when((kind == "DOCX") & (text_chars == 0), "EXTRACTION_FAILED")
    return F.when(code.isNull(), "READY").otherwise("FAILED"), code
