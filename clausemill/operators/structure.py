"""Lines, clauses, running headers, scanned pages and chunks of documents."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausemill.functions import text as T


def lines(docs: DataFrame, keys: list[str], text_col: str = "text", keep_empty: bool = True) -> DataFrame:
    """``(keys, line, line_start, line_end, line_text)``: lines by line feed with 0-based offsets, end exclusive.

    Offsets are running sums inside one row's array of lines, so nothing is shuffled.
    """
    rows = docs.select(*keys, F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1).alias("ls"))
    lengths = F.transform("ls", lambda x: F.length(x))
    rows = rows.select(*keys, "ls", T.offsets(lengths, 1).alias("starts"))
    rows = rows.select(*keys, F.posexplode(F.arrays_zip("ls", "starts")).alias("line", "x"))
    out = rows.select(*keys, "line", F.col("x.starts").alias("line_start"), (F.col("x.starts") + F.length("x.ls")).alias("line_end"), F.col("x.ls").alias("line_text"))
    return out if keep_empty else out.where("line_end > line_start")


_HEADING = "struct<ref:string,heading:string,depth:int>"
#: What a heading begins with, or that a line has no small letter; all heading rules imply it, and it fails early on prose.
_MAYBE = r"^(?:[0-9(]|ARTICLE|Article|SECTION|Section|[^a-z]+$)"


def with_clauses(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """``(keys, full, clauses)`` of every text that is not blank; clauses is an array of ``(ref, heading, depth, start, end, clause)``.

    All of it is computed inside the row from the array of its lines, so rows that share keys are told apart and nothing
    is shuffled.  A clause is the lines from its heading to the next one, without trailing white space.
    """
    rows = docs.select(*keys, F.coalesce(F.col(text_col), F.lit("")).alias("full")).where(T.trim(F.col("full")) != "")
    rows = rows.withColumn("ls", F.split("full", "\n", -1))
    lines_ = F.transform("ls", lambda x, i: F.struct(i.alias("i"), T.trim(x).alias("t")))
    rows = rows.withColumn("maybe", F.filter(lines_, lambda x: F.length(x["t"]).between(1, 120) & x["t"].rlike(_MAYBE)))
    rows = rows.withColumn("hs", F.filter(F.transform("maybe", lambda x: F.struct(x["i"].alias("i"), T.heading(x["t"]).alias("h"))), lambda x: x["h"].isNotNull()))
    first = F.coalesce(F.get(F.col("hs.i"), F.lit(0)), F.size("ls"))
    lead = F.exists(F.slice("ls", F.lit(1), first), lambda x: T.trim(x) != "")
    none = F.array().cast(f"array<struct<i:int,h:{_HEADING}>>")
    rows = rows.withColumn("hs", F.concat(F.when(lead, F.array(F.struct(F.lit(0).alias("i"), F.lit(None).cast(_HEADING).alias("h")))).otherwise(none), "hs"))
    stops = F.concat(F.slice(F.col("hs.i"), F.lit(2), F.size("hs")), F.array(F.size("ls")))
    piece = lambda x, z: F.struct(x["h"].alias("h"), F.array_join(F.slice("ls", x["i"] + 1, z - x["i"]), "\n").alias("t"))
    blank = F.length(F.array_join(F.slice("ls", F.lit(1), F.coalesce(F.get(F.col("hs.i"), F.lit(0)), F.lit(0))), "\n"))  # lines before the first clause
    skipped = F.when(F.get(F.col("hs.i"), F.lit(0)) > 0, blank).otherwise(-1)
    rows = rows.select(*keys, "full", skipped.alias("skipped"), F.zip_with("hs", stops, piece).alias("ps"))
    at = T.offsets(F.concat(F.array("skipped"), F.transform("ps", lambda p: F.length(p["t"]))), 1)
    cut = T.once(at, lambda at: F.transform("ps", lambda p, i: F.struct(p["h"].alias("h"), F.get(at, i + 1).alias("start"), T.rtrim(p["t"]).alias("clause"))))
    rows = rows.select(*keys, "full", cut.alias("cs"))
    whole = lambda c: F.struct(c["h"]["ref"].alias("ref"), c["h"]["heading"].alias("heading"), F.coalesce(c["h"]["depth"], F.lit(1)).alias("depth"), c["start"].alias("start"), (c["start"] + F.length(c["clause"])).alias("end"), c["clause"].alias("clause"))
    return rows.select(*keys, "full", F.transform("cs", whole).alias("clauses"))


def segment_clauses(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """``(keys, ordinal, ref, heading, depth, start, end, body)``: one row per clause.

    Text before the first heading is a clause of its own if it is not blank; a text without headings is one clause; a
    blank text has none.  Trailing white space does not count.
    """
    rows = with_clauses(docs, keys, text_col).select(*keys, F.posexplode(T.rows_of(F.col("clauses"))).alias("ordinal", "c"))
    return rows.select(*keys, "ordinal", "c.ref", "c.heading", "c.depth", "c.start", "c.end", T.clause_body(F.col("c.clause"), F.col("c.ref")).alias("body"))


EDGE, SHARE, FEWEST, LONGEST = 3, 0.5, 4, 120


def boilerplate(page_lines: DataFrame) -> DataFrame:
    """``(doc_id, page, line, kind)`` of repeated page edges in ``page_lines (doc_id, page, line, line_text)``.

    The first and last three non-empty lines of a page count.  A line is boilerplate if its folded text, or its page
    marker with digits masked, is on over half of at least four pages.
    """
    document, page, key = Window.partitionBy("doc_id"), Window.partitionBy("doc_id", "page"), Window.partitionBy("doc_id", "kind", "key")
    # Windows only, the document's first: lines are dealt by document once, or not at all if they lie so, and never joined with what is counted of them.
    first = lambda w: F.col("page").isNotNull() & F.coalesce(F.lag("page").over(w) != F.col("page"), F.lit(True))
    rows = page_lines.select("doc_id", "page", "line", "line_text").where("doc_id is not null").withColumn("new", first(document.orderBy("page", "line")))
    rows = rows.withColumn("pages", F.count_if("new").over(document)).where((F.col("pages") >= FEWEST) & (T.trim(F.col("line_text")) != ""))
    edges = rows.withColumn("a", F.row_number().over(page.orderBy("line"))).withColumn("z", F.count("*").over(page) - F.col("a") + 1).where((F.col("a") <= EDGE) | (F.col("z") <= EDGE))
    exact, marker = F.lower(T.fold(F.col("line_text"))), T.page_marker(F.col("line_text"))
    keyed = edges.where(F.length(T.trim(F.col("line_text"))) <= LONGEST).select("doc_id", "pages", "page", "line", F.explode(F.array(F.struct(F.lit("exact").alias("kind"), exact.alias("key")), F.struct(F.lit("marker").alias("kind"), marker.alias("key")))).alias("k"))
    keyed = keyed.select("doc_id", "pages", "page", "line", "k.kind", "k.key").where("key is not null").withColumn("new", first(key.orderBy("page", "line")))
    common = keyed.withColumn("on", F.count_if("new").over(key)).where(F.col("on") > SHARE * F.col("pages"))
    return common.groupBy("doc_id", "page", "line").agg(F.min("kind").alias("kind"))


def boilerplate_ranges(docs: DataFrame, page_chars: int, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(key, start, end)``: lines of a text that repeat at the edges of its pages of about ``page_chars`` characters; a line is on the page where it starts."""
    rows = lines(docs, [key], text_col).withColumn("page", F.floor(F.col("line_start") / page_chars).cast("int"))
    found = boilerplate(rows.select(F.col(key).alias("doc_id"), "page", "line", "line_text")).select(F.col("doc_id").alias(key), "line")
    return rows.join(found, [key, "line"]).select(key, F.col("line_start").alias("start"), F.col("line_end").alias("end"))


def scan_verdict(pages: DataFrame) -> DataFrame:
    """``(doc_id, n_pages, n_scanned, average_chars, fully_scanned)`` of ``pages (doc_id, page, text_chars)``.

    A page under 10 characters is scanned.  Under 25 on average, or four fifths scanned, the document is.
    """
    scanned = F.col("text_chars") < 10
    rows = pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.count_if(scanned).alias("n_scanned"), F.avg("text_chars").alias("average_chars"))
    return rows.withColumn("fully_scanned", (F.col("average_chars") < 25) | (F.col("n_scanned") / F.col("n_pages") >= 0.8))


def page_ranges(pages: DataFrame, out: str = "ranges", counted: str | None = None) -> DataFrame:
    """``(doc_id, ranges)`` of ``pages (doc_id, page)``: "3–5, 41"; with ``counted`` also the number of pages, under that name."""
    rows = pages.select("doc_id", "page").distinct()
    rows = rows.withColumn("island", F.col("page") - F.row_number().over(Window.partitionBy("doc_id").orderBy("page")))
    runs = rows.groupBy("doc_id", "island").agg(F.min("page").alias("a"), F.max("page").alias("z"))
    label = F.when(F.col("a") == F.col("z"), F.col("a").cast("string")).otherwise(F.concat_ws("–", F.col("a").cast("string"), F.col("z").cast("string")))
    parts = F.array_sort(F.collect_list(F.struct("a", label.alias("x"))))
    number = [] if counted is None else [F.sum(F.col("z") - F.col("a") + 1).alias(counted)]
    return runs.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["x"]), ", ").alias(out), *number)


def block_text(c: Column) -> Column:
    """Text of a block: every run of white space as one space, trimmed."""
    return T.fold(c)


def block_offsets(blocks: DataFrame, by: str = "doc_id", order: str = "n", text_col: str = "text") -> DataFrame:
    """``blocks`` with ``start`` and ``end`` of each folded block in the text that joins them with line feeds; empty blocks keep their place."""
    size = F.length(block_text(F.coalesce(F.col(text_col), F.lit(""))))
    before = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(size + 1).over(before), F.lit(0))
    return blocks.withColumn("start", start).withColumn("end", start + size)


# --- chunks

TARGET, MOST, LEAST, OVERLAP, BOILERPLATE = 1000, 1200, 150, 0.1, 0.6


def _cut_point(text: str, start: int, ideal: int) -> int:
    """Where to cut at or shortly before ``ideal``: after a paragraph, a line, a sentence or a word, whichever comes first in this list."""
    low = max(start + 1, ideal - int((ideal - start) * 0.3))
    for mark in ("\n\n", "\n"):
        if (at := text.rfind(mark, low, ideal + len(mark))) >= 0:
            return at + len(mark)
    ends = [text.rfind(mark, low + 1, ideal + 2) for mark in (". ", ".\n", "; ", ";\n")]
    if ideal == len(text) - 1 and text[ideal] in ".;":
        ends.append(ideal)
    if max(ends) >= 0:
        return max(ends) + 1
    at = text.rfind(" ", low, ideal + 1)
    return at + 1 if at >= 0 else ideal


def split_range(text: str, start: int, end: int, target: int = TARGET, overlap: float = OVERLAP) -> list[tuple[int, int]]:
    """Cut ``text[start:end]`` into ranges of about ``target`` tokens that overlap."""
    size = max(200, int(target * 3.5))
    out, at = [], start
    while at < end:
        stop = end if at + size >= end else _cut_point(text, at, at + size)
        out.append((at, stop))
        if stop >= end:
            break
        at = max(at + 1, stop - int(size * overlap))
    return out


def chunk_segments(text: str, segments: list[tuple], target: int = TARGET, most: int = MOST, least: int = LEAST) -> Iterator[tuple]:
    """``(start, end, ref, heading, tokens)`` chunks of ``segments (start, end, ref, heading)``: long ones split, short neighbours merged under the first one's name."""
    tokens = lambda n: -(-2 * n // 7)
    pieces = []
    for start, end, ref, heading in segments:
        ranges = [(start, end)] if tokens(end - start) <= most else split_range(text, start, end, target)
        pieces += [(a, b, ref, heading) for a, b in ranges]
    held = None
    for a, b, ref, heading in pieces:
        if held is not None:
            joined, short = tokens(b - held[0]), min(tokens(held[1] - held[0]), tokens(b - a)) < least
            if joined <= target and short:
                held = (held[0], b, *held[2:])
                continue
            yield (*held, tokens(held[1] - held[0]))
        held = (a, b, ref, heading)
    if held is not None:
        yield (*held, tokens(held[1] - held[0]))


def split_texts(docs: DataFrame, keys: list[str], text_col: str = "text", target: int = TARGET, overlap: float = OVERLAP) -> DataFrame:
    """``(keys, n, start, end)``: the ranges of about ``target`` tokens that each whole text is cut into; a null or empty text has none."""

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start": a, "end": b} for a, b in split_range(t, 0, len(t), target, overlap)])

    rows = docs.select(*keys, F.coalesce(F.col(text_col), F.lit("")).alias("full"))
    return rows.select(*keys, F.posexplode(cut("full")).alias("n", "c")).select(*keys, "n", "c.*")


def merge_segments(segments: DataFrame, keys: list[str], target: int = TARGET, most: int = MOST, least: int = LEAST) -> DataFrame:
    """``(keys, chunk, start, end, tokens)`` of ``segments (keys, ordinal, start, end)``: short neighbours joined up to ``target`` tokens, by a fold over the segments of a key.

    Segments over ``most`` tokens must be split before.
    """
    tokens = lambda n: F.ceil(n * 2 / 7)
    piece = "struct<start:bigint,end:bigint>"
    zero = F.struct(F.array().cast(f"array<{piece}>").alias("done"), F.lit(None).cast(piece).alias("held"))

    def step(acc: Column, x: Column) -> Column:
        new = F.struct(x["start"].cast("bigint").alias("start"), x["end"].cast("bigint").alias("end"))
        held = acc["held"]
        short = F.least(tokens(held["end"] - held["start"]), tokens(x["end"] - x["start"])) < least
        joins = held.isNotNull() & (tokens(x["end"] - held["start"]) <= target) & short
        grown = F.struct(held["start"].alias("start"), new["end"].alias("end"))
        return F.when(joins, F.struct(acc["done"].alias("done"), grown.alias("held"))).otherwise(F.struct(F.when(held.isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(held))).alias("done"), new.alias("held")))

    rows = segments.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ordinal", "start", "end"))).alias("ss"))
    rows = rows.select(*keys, F.aggregate("ss", zero, step, lambda acc: F.concat(acc["done"], F.array(acc["held"]))).alias("cs"))
    return rows.select(*keys, F.posexplode(T.rows_of(F.col("cs"))).alias("chunk", "c")).select(*keys, "chunk", "c.start", "c.end", tokens(F.col("c.end") - F.col("c.start")).alias("tokens"))


def covered(start: int, end: int, ranges: list[tuple[int, int]]) -> float:
    """The share of ``start..end`` that sorted ``ranges``, which may overlap, cover."""
    total, at = 0, start
    for a, b in ranges:
        a, b = max(a, at), min(b, end)
        if a < b:
            total, at = total + b - a, b
    return total / (end - start) if end > start else 0.0


def chunks(docs: DataFrame, keys: list[str], text_col: str = "text", target: int = TARGET, boilerplate_ranges: DataFrame | None = None) -> DataFrame:
    """``(keys, chunk, start, end, ref, heading, tokens, is_boilerplate)``: token-budgeted chunks along clause borders.

    A chunk is boilerplate if ``boilerplate_ranges (keys, start, end)`` cover the share BOILERPLATE of it.  Works on each
    row's own clauses, Arrow batch by Arrow batch, without a shuffle but for the ranges.
    """
    rows = with_clauses(docs, keys, text_col)
    none = F.array().cast("array<struct<s:int,e:int>>")
    if boilerplate_ranges is None:
        rows = rows.withColumn("ranges", none)
    else:
        ranges = boilerplate_ranges.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("int").alias("s"), F.col("end").cast("int").alias("e")))).alias("ranges"))
        rows = rows.join(ranges, keys, "left").withColumn("ranges", F.coalesce("ranges", none))

    @F.pandas_udf("array<struct<start:int,end:int,ref:string,heading:string,tokens:int,is_boilerplate:boolean>>")
    def cut(texts: pd.Series, clause_lists: pd.Series, range_lists: pd.Series) -> pd.Series:
        names, out = ("start", "end", "ref", "heading", "tokens"), []
        for text, clauses, ranges in zip(texts, clause_lists, range_lists):
            ranges = [(r["s"], r["e"]) for r in ranges]
            every = chunk_segments(text, [(x["start"], x["end"], x["ref"], x["heading"]) for x in clauses], target)
            out.append([dict(zip(names, c)) | {"is_boilerplate": covered(c[0], c[1], ranges) >= BOILERPLATE} for c in every])
        return pd.Series(out)

    return rows.select(*keys, F.posexplode(cut("full", "clauses", "ranges")).alias("chunk", "c")).select(*keys, "chunk", "c.*")
