"""Matches of a pattern inside a text column as arrays of ``(s, e, v)``: code-point range, end exclusive, and matched string.

All of it is built-in SQL functions.  ``split`` gives the text between the
matches and ``regexp_extract_all`` the matches, so the places follow from a
running sum of their lengths.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<s:int,e:int,v:string>"
#: Spans are gathered in runs of this length, since adding to an array copies it.
_RUN = 128


def no_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def matches(text: str, pattern: str) -> Column:
    """All leftmost non-overlapping, non-empty matches of ``pattern`` in the column ``text``, in order."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    pairs = F.filter(F.zip_with(gaps, found, lambda g, v: F.struct(g.alias("g"), v.alias("v"))), lambda x: x["v"].isNotNull())
    start = F.struct(F.lit(0).alias("at"), no_spans().alias("run"), F.array().cast(f"array<array<{SPAN}>>").alias("done"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["g"]
        e = s + F.length(x["v"])
        span = F.array(F.struct(s.alias("s"), e.alias("e"), x["v"].alias("v")))
        full = F.size(acc["run"]) >= _RUN
        return F.struct(
            e.alias("at"),
            F.when(full, span).otherwise(F.concat(acc["run"], span)).alias("run"),
            F.when(full, F.concat(acc["done"], F.array(acc["run"]))).otherwise(acc["done"]).alias("done"),
        )

    spans = F.aggregate(pairs, start, step, lambda acc: F.concat(F.flatten(acc["done"]), acc["run"]))
    return F.when(F.col(text).rlike(pattern), spans).otherwise(no_spans())


def listed(spans: Column) -> Column:
    """``kind:start:end`` of spans ``(s, e, k, kind)`` by start, then by k, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def tagged(spans: Column, k: int, kind: str) -> Column:
    """Spans as ``(s, k, e, kind)``, an order that ``array_sort`` keeps by start, then kind."""
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), F.lit(kind).alias("kind")))


def overlaps(x: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (o["s"] < x["e"]) & (x["s"] < o["e"]))
