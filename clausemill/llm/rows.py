"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of text handled at once inside a task; a batch of long texts is cut by size as well.
ROWS, CHARS = 2_000, 1_000_000


def slices(texts: list[str] | list[bytes], most: int = CHARS) -> Iterator[tuple[int, int]]:
    """Cut a list of texts into runs of at most ROWS rows and about ``most`` characters."""
    return cuts(map(len, texts), most)


def cuts(lengths: Iterable[int], most: int = CHARS) -> Iterator[tuple[int, int]]:
    """Runs of at most ROWS neighbours whose lengths sum to about ``most``; a longer one is alone."""
    start, size, i = 0, 0, -1
    for i, n in enumerate(lengths):
        if i > start and (i - start >= ROWS or size + n > most):
            yield start, i
            start, size = i, 0
        size += n
    if start <= i:
        yield start, i + 1


def text_slices(column: pa.Array, most: int = CHARS) -> Iterator[tuple[int, int, list[str]]]:
    """``(start, end, texts)`` of a column of strings, null as empty; only one slice is held as Python strings."""
    for a, b in cuts(pc.fill_null(pc.binary_length(column), 0).to_pylist(), most):
        yield a, b, [t or "" for t in column.slice(a, b - a).to_pylist()]


def per_text(df: DataFrame, fn: Callable[[list[str]], dict[str, Iterable]], schema: str, id_col: str, text_col: str, most: int = CHARS) -> DataFrame:
    """One row ``(id, *columns of fn)`` per row of ``df``; ``fn`` gets the texts of a slice of about ``most`` characters, null as empty.

    ``schema`` names the columns of ``fn`` with their types.
    """
    source = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    out = F.lit(None).cast(f"struct<doc_id:{kind},{schema.replace(' ', ':')}>")
    arrow = source.sparkSession.range(0).select(out.alias("r")).select("r.*").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        types = to_arrow_schema(arrow)
        for batch in batches:
            ids = batch.column(0)
            for a, b, texts in text_slices(batch.column(1), most):
                columns = fn(texts)
                arrays = [ids.slice(a, b - a), *(x if isinstance(x, pa.Array) else pa.array(x, types.field(n).type) for n, x in columns.items())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *columns])

    return source.mapInArrow(run, arrow)


def any_row(condition: Column, df: DataFrame) -> bool:
    """Whether any row of ``df`` meets ``condition``; one row at most reaches the driver."""
    return bool(df.where(condition).select(F.lit(1)).head(1))
