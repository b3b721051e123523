"""Half-open character ranges: predicates, interval joins and unions.

Joins always carry the document's equality, so Spark plans an equi-join with the
overlap as its residual condition and never a nested loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Touching ranges do not overlap."""
    return (s1 < e2) & (s2 < e1)


def clamp(s: Column, e: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """The part of a range inside ``[low, high)``; null if it is empty."""
    a, b = F.greatest(s, low), F.least(e, high)
    return F.when(a < b, a), F.when(a < b, b)


def range_join(left: DataFrame, right: DataFrame, key: str = "doc_id", how: str = "inner") -> DataFrame:
    """Rows of ``left (key, start, end)`` with the overlapping rows of ``right (key, r_start, r_end)``."""
    on = (left[key] == right[key]) & (left["start"] < right["r_end"]) & (right["r_start"] < left["end"])
    return left.join(right, on, how).drop(right[key])


def valid_window(first: Column, last: Column, most: int = 10) -> Column:
    """Whether pages ``first`` to ``last`` may be asked for: in order, from 1, and at most ``most`` of them."""
    return F.coalesce((first >= 1) & (first <= last) & (last - first + 1 <= most), F.lit(False))


def split_by(ranges: DataFrame, pages: DataFrame) -> DataFrame:
    """Each range cut at the borders of ``pages (doc_id, page, r_start, r_end)``."""
    out = range_join(ranges, pages)
    return out.withColumn("part_start", F.greatest("start", "r_start")).withColumn("part_end", F.least("end", "r_end"))


def merge_ranges(ranges: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, start, end)``: the union of overlapping or touching ranges; empty ranges are ignored."""
    w = Window.partitionBy(key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    rows = ranges.where("end > start").select(key, "start", "end")
    rows = rows.withColumn("new", F.coalesce(F.col("start") > F.max("end").over(w), F.lit(True)).cast("int"))
    rows = rows.withColumn("island", F.sum("new").over(Window.partitionBy(key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def covered_share(ranges: DataFrame, covers: DataFrame, id_col: str) -> DataFrame:
    """``ranges`` with ``share``: how much of each its overlapping ``covers (doc_id, r_start, r_end)`` cover; 0 without any."""
    joined = range_join(ranges, covers, how="left")
    length = F.coalesce(F.least("end", "r_end") - F.greatest("start", "r_start"), F.lit(0))
    return joined.groupBy("doc_id", id_col, "start", "end").agg((F.sum(length) / F.greatest(F.col("end") - F.col("start"), F.lit(1))).alias("share"))


def highlight_rects(quotes: DataFrame, items: DataFrame, page_height: float = 842.0, scale: float = 1.0) -> DataFrame:
    """Rectangles of quote ranges over positioned items ``(doc_id, r_start, r_end, x, y, width, height)``.

    A part of an item gets its proportional part of the width; y is flipped; sides are 2 at least.
    """
    rows = split_by(quotes, items)
    size = F.greatest(F.col("r_end") - F.col("r_start"), F.lit(1))
    left = F.col("x") + F.col("width") * (F.col("part_start") - F.col("r_start")) / size
    width = F.col("width") * (F.col("part_end") - F.col("part_start")) / size
    return rows.select(
        *quotes.columns, "r_start", (left * scale).alias("left"), ((page_height - F.col("y") - F.col("height")) * scale).alias("top"),
        F.greatest(width * scale, F.lit(2.0)).alias("rect_width"), F.greatest(F.col("height") * scale, F.lit(2.0)).alias("rect_height"),
    )
