"""Quotation verification: deterministic, never fuzzy.

Passes, first hit wins: EXACT_WS on normalised text, HYPHEN_BREAK with line-break
hyphens joined, WS_INSENSITIVE without spaces (quotes of 8 characters or more),
CASE_INSENSITIVE.  To find quotes anywhere, the first characters of each are
looked for in all documents at once, in one pass over a text whatever their
number; what is found is joined to the quotes by those characters and verified.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausemill.functions import text as T
from clausemill.functions.patterns import WS

SHORTEST, LONGEST = 8, 1500
#: Quotes, and bytes of quotes, that one broadcast holds; more go in blocks.  Characters of a quote that are looked for.
QUOTES, BYTES, KEY = 50_000, 32_000_000, 24

_PLAIN = dict.fromkeys(T.QUOTES[0], "'") | dict.fromkeys(T.QUOTES[1], '"') | dict.fromkeys(T.DASHES, "-")
_DROPPED = frozenset("­​‌‍﻿")


def prepare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, norm, hyphen_norm, stripped, lowered)``: the forms that the passes search, null text as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"), T.normalize(text).alias("norm"))
    broken = F.col("t").rlike(T.HYPHEN_BREAK)
    return rows.select("doc_id", "norm", F.when(broken, T.normalize(T.join_hyphens(F.col("t")))).alias("hyphen_norm"), T.strip_spaces(F.col("norm")).alias("stripped"), F.lower("norm").alias("lowered"))


def prepare_quotes(quotes: DataFrame, id_col: str = "quote_id", text_col: str = "text") -> DataFrame:
    """``(quote_id, q, q_stripped, q_lowered, reason)``: reason says why a quote is not searched, else null."""
    cleaned = T.clean_quote(F.coalesce(F.col(text_col), F.lit("")))
    rows = quotes.select(F.col(id_col).alias("quote_id"), cleaned.alias("cleaned"), T.normalize(cleaned).alias("q"))
    reason = (
        F.when(F.col("cleaned").rlike(r"\.\.\.|…"), "INNER_ELLIPSIS")
        .when(F.length("q") < SHORTEST, "TOO_SHORT")
        .when(F.length("q") > LONGEST, "TOO_LONG")
    )
    return rows.select("quote_id", "q", T.strip_spaces(F.col("q")).alias("q_stripped"), F.lower("q").alias("q_lowered"), reason.alias("reason"))


def _pass(name: str, hay: str, needle: str, more: Column | None = None) -> tuple[Column, str, Column, Column]:
    test = F.contains(F.col(hay), F.col(needle))
    return (test if more is None else test & more), name, F.col(hay), F.col(needle)


def match_kind() -> tuple[Column, Column]:
    """Of a row with prepared document and quote: the winning pass or null, and its number of matches."""
    passes = (
        _pass("EXACT_WS", "norm", "q"),
        _pass("HYPHEN_BREAK", "hyphen_norm", "q"),
        _pass("WS_INSENSITIVE", "stripped", "q_stripped", F.length("q_stripped") >= SHORTEST),
        _pass("CASE_INSENSITIVE", "lowered", "q_lowered"),
    )
    kind = count = None
    for test, name, hay, needle in passes:
        n = T.count_occurrences(hay, needle)
        kind = F.when(test, name) if kind is None else kind.when(test, name)
        count = F.when(test, n) if count is None else count.when(test, n)
    return kind, count


def _bare(c: Column) -> Column:
    """All four forms of a text agree once spaces and case are gone."""
    return F.lower(T.strip_spaces(c))


def _search(keys: Broadcast):
    """Which of the keys are in a text or in its other form."""

    @F.pandas_udf("array<string>")
    def seen(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        import ahocorasick

        found = ahocorasick.Automaton()
        for key in keys.value:
            found.add_word(key, key)
        found.make_automaton()
        for texts, others in batches:
            yield pd.Series([list({key for text in pair if text and len(found) for _, key in found.iter(text)}) for pair in zip(texts, others)], dtype=object)

    return seen


def find_quotes(docs: DataFrame, quotes: DataFrame, **names: str) -> DataFrame:
    """``(quote_id, doc_id, match_kind, n_matches)`` for every quote found in a document.

    Every document is read once for each block of at most QUOTES quotes and BYTES bytes of them.
    """
    spark = docs.sparkSession
    prepared = prepare(docs, **names)
    asked = prepare_quotes(quotes).where("reason is null").drop("reason").withColumn("key", F.substring(_bare(F.col("q")), 1, KEY))
    n, size = asked.agg(F.count("*"), F.sum(F.octet_length("q"))).first()
    blocks = max(1, -(-n // QUOTES), -(-(size or 0) // BYTES))
    out = None
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("quote_id"), F.lit(blocks)) == b) if blocks > 1 else asked
        keys = [r["key"] for r in block.select("key").distinct().collect()]
        kind, count = match_kind()
        near = prepared.withColumn("key", F.explode(_search(spark.sparkContext.broadcast(keys))(_bare(F.col("norm")), _bare(F.col("hyphen_norm")))))
        found = near.join(F.broadcast(block), "key").select("quote_id", "doc_id", kind.alias("match_kind"), count.alias("n_matches")).where("match_kind is not null")
        out = found if out is None else out.unionAll(found)
    return out


def verify(citations: DataFrame, docs: DataFrame) -> DataFrame:
    """Each citation ``(quote_id, doc_id, text)`` held against its own document only: status, match_kind, n_matches, reason."""
    asked = citations.select("quote_id", "doc_id").join(prepare_quotes(citations).withColumnRenamed("quote_id", "of"), F.col("quote_id") == F.col("of")).drop("of")
    rows = asked.join(prepare(docs).withColumn("known", F.lit(True)), "doc_id", "left")
    kind, count = match_kind()
    reason = (
        F.when(F.col("known").isNull(), "UNKNOWN_DOCUMENT")
        .when(F.col("norm") == "", "EMPTY_DOCUMENT")
        .when(F.col("reason").isNotNull(), F.col("reason"))
        .when(kind.isNull(), "NOT_FOUND")
    )
    rows = rows.withColumn("why", reason).withColumn("match_kind", F.when(F.col("why").isNull(), kind)).withColumn("n_matches", F.when(F.col("why").isNull(), count))
    status = F.when(F.col("why").isNull(), "VERIFIED").otherwise("UNVERIFIED")
    return rows.select("quote_id", "doc_id", status.alias("status"), "match_kind", "n_matches", F.col("why").alias("reason"))


def normalize_with_map(text: str) -> tuple[str, list[int]]:
    """Normalised text and, for each of its characters, the place in ``text`` that it comes from."""
    out, places, gap = [], [], None
    for i, c in enumerate(text):
        if c in _DROPPED:
            continue
        if c.isspace():
            gap = i if gap is None else gap
            continue
        if gap is not None and out:
            out.append(" ")
            places.append(gap)
        gap = None
        for d in _PLAIN.get(c) or unicodedata.normalize("NFKC", c):
            out.append(d)
            places.append(i)
    return "".join(out), places


_SPACES = re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), WS)
_BREAK = re.compile(rf"(?<=[^\W\d_])-{_SPACES}*[\r\n]{_SPACES}*(?=[^\W\d_])")


def _forms(text: str) -> Iterator[tuple[str, list[int], Callable[[str], str]]]:
    """The forms that the passes search, in their order: form, the place in ``text`` of each of its characters, and the form of a quote."""
    norm, places = normalize_with_map(text)
    yield norm, places, lambda q: q
    kept, at = [], 0
    for m in _BREAK.finditer(text):
        kept += range(at, m.start())
        at = m.end()
    if kept:
        kept += range(at, len(text))
        joined, inner = normalize_with_map("".join(map(text.__getitem__, kept)))
        yield joined, [kept[i] for i in inner], lambda q: q
    solid = [(c, p) for c, p in zip(norm, places) if c != " "]
    yield "".join(c for c, _ in solid), [p for _, p in solid], lambda q: q.replace(" ", "") if len(q.replace(" ", "")) >= SHORTEST else ""
    lowered = [(d, p) for c, p in zip(norm, places) for d in c.lower()]
    yield "".join(c for c, _ in lowered), [p for _, p in lowered], str.lower


def places_of(text: str, quote: str) -> list[tuple[int, int]]:
    """``(start, end)`` in ``text`` of every match of the first pass that has one; end exclusive, never inside a character."""
    needle = normalize_with_map(quote)[0]
    for form, places, of in _forms(text):
        key, found = of(needle), []
        at = form.find(key) if key else -1
        while at >= 0:
            found.append((places[at], places[at + len(key) - 1] + 1))
            at = form.find(key, at + 1)
        if found:
            return found
    return []


def quote_offsets(pairs: DataFrame) -> DataFrame:
    """``(quote_id, doc_id, start, end)`` in original text for every match of ``pairs (quote_id, doc_id, text, quote)``; end exclusive.

    The passes of :func:`find_quotes` are tried in their order; null text or quote has no match.
    """

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def locate(texts: pd.Series, quotes: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "end": b} for a, b in places_of(t or "", q or "")] for t, q in zip(texts, quotes)])

    return pairs.select("quote_id", "doc_id", F.inline(locate("text", "quote")))


def quote_dedupe(quotes: DataFrame) -> DataFrame:
    """First of the quotes that are alike in document and in text without regard to case and spacing."""
    w = Window.partitionBy("doc_id", "key").orderBy("n", "quote_id")
    rows = quotes.withColumn("key", F.lower(T.fold(F.col("text")))).withColumn("rank", F.row_number().over(w))
    return rows.where("rank = 1").drop("key", "rank")
