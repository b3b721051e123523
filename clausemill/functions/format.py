"""Presentation of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_bytes(c: Column) -> Column:
    """"512 B", "3.2 KB", "45 MB": one decimal under ten units."""
    n = c.cast("double")
    out = F.when(n < 1024, F.concat(c.cast("bigint").cast("string"), F.lit(" B")))
    for i, unit in enumerate(("KB", "MB", "GB"), 1):
        v = n / float(1024**i)
        text = F.when(v < 10, F.format_string("%.1f", v)).otherwise(F.floor(v + 0.5).cast("string"))
        shown = F.concat(text, F.lit(f" {unit}"))
        out = out.otherwise(shown) if unit == "GB" else out.when(n < 1024 ** (i + 1), shown)
    return out
