"""Keeping or reading some rows of a stored table, decided row by row, without moving a text.

A row is known by its place: a hash of its file's path, and its number in the
file.  Only places, ids and hashes go through shuffles.  A list of places is cut
where files, or ranges of rows inside large files, end, so that a block lists at
most twice LISTED rows whatever the list's length; each block of files is read
by itself with its own part of the list broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausemill.llm.components import slice_of
from clausemill.storage import scratch, settle, settle_all

#: Rows of a list that a block of files holds at most twice; a broadcast of that many takes about 160 MB.
LISTED = 1_000_000


def placed(docs: DataFrame, stored: bool = False) -> DataFrame:
    """``docs`` as a plain read of Parquet files, whose rows have places.

    ``stored`` says that ``docs`` already is one, with filters and chosen columns at most.  Anything else, or a table
    that turns out to be none, is written to the shared folder first.
    """
    if stored:
        try:
            docs.select(place(docs))
            return docs
        except AnalysisException:  # no files, or rows made since they were read
            pass
    return settle(docs, "placed")


def place(docs: DataFrame) -> Column:
    """Where each row of a :func:`placed` table stands: ``struct(file, row)``."""
    about = docs.metadataColumn("_metadata")
    return F.struct(F.xxhash64(about["file_path"]).alias("file"), about["row_index"].alias("row"))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(key, text)`` of every row of a :func:`placed` table; key holds the id, which may be null, hashes of the text and of all columns, and the place.

    Columns that hold maps or variants can't be hashed and are left out of the second hash.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    others = [F.col(f"`{f.name}`") for f in docs.schema if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    key = F.struct(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text, F.length(text)).alias("h"), F.xxhash64(*others).alias("other"), place(docs)["file"].alias("file"), place(docs)["row"].alias("row"))
    return docs.select(key.alias("key"), F.col(f"`{text_col}`").alias("text"))


def first_row(key: str = "key"):
    """Aggregate: the key with the smallest id, nulls last; of equal ids that of the smallest hashes, then places."""
    return F.min(F.struct(F.col(f"{key}.id").isNull().alias("none"), *[F.col(f"{key}.{c}").alias(c) for c in ("id", "h", "other", "file", "row")]))


def _blocks(docs: DataFrame, places: DataFrame) -> tuple[DataFrame, list]:
    """The list with each place's block, and the first path and row of every block, in order.

    One row per file is counted in one task, as the driver holds the names of all files anyway.
    """
    files = docs.select(docs.metadataColumn("_metadata")["file_path"].alias("path"), docs.metadataColumn("_metadata")["row_index"].alias("row"))
    files = files.groupBy("path").agg(F.max("row").alias("last"))
    listed = places.groupBy("file").agg(F.count("*").alias("n"))
    cut = F.when(F.col("n") > LISTED, F.sequence(F.lit(0), F.col("last"), F.lit(LISTED))).otherwise(F.array(F.lit(0).cast("bigint")))
    runs = files.join(listed, F.xxhash64("path") == F.col("file"), "left").select("path", F.least(F.coalesce("n", F.lit(0)), F.lit(LISTED)).alias("n"), F.explode(cut).alias("low"))
    before = F.sum("n").over(Window.orderBy("path", "low")) - F.col("n")
    runs = settle(runs.withColumn("block", F.floor(before / LISTED)), "runs")
    starts = runs.groupBy("block").agg(F.min(F.struct("path", "low")).alias("first"), F.max("path").alias("last")).orderBy("block").collect()
    lows = runs.groupBy(F.xxhash64("path").alias("file")).agg(F.sort_array(F.collect_list(F.struct("low", "block"))).alias("lows"))
    block = F.filter("lows", lambda x: x["low"] <= F.col("row"))
    return places.join(lows, "file").select("file", "row", F.element_at(block, -1)["block"].alias("block")), starts


def sifted(docs: DataFrame, places: DataFrame, how: str) -> Iterator[DataFrame]:
    """``docs``, a :func:`placed` table, block by block: the rows in the list ``places (file, row)`` (``left_semi``) or the others (``left_anti``).

    Every file is read once, but for those cut between blocks.
    """
    dealt, starts = _blocks(docs, places)
    dealt = settle(dealt.repartition("block").sortWithinPartitions("block", "file", "row"), "listed")
    about = docs.metadataColumn("_metadata")
    path = about["file_path"]
    reached = lambda r: (path > r["first"]["path"]) | ((path == r["first"]["path"]) & (about["row_index"] >= r["first"]["low"]))
    nested = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), place(docs).alias("key")]
    for start, after in zip(starts, [*starts[1:], None]):
        part = docs.where((path >= start["first"]["path"]) & (path <= start["last"]) & reached(start))  # the bounds of paths choose the files
        if after is not None:
            part = part.where(~reached(after))
        own = F.broadcast(dealt.where(F.col("block") == start["block"]).select("file", "row"))
        yield part.select(*nested).join(own, (F.col("key.file") == own["file"]) & (F.col("key.row") == own["row"]), how).select("doc.*")


def sift(docs: DataFrame, places: DataFrame, how: str) -> DataFrame:
    """The rows that :func:`sifted` gives, written as one table; an empty table gives no rows."""
    with scratch() as kept:
        kept.append(settle_all((df for parts in (sifted(docs, places, how), [docs.limit(0)]) for df in parts), "sifted"))
    return kept[0]


def keep_one(docs: DataFrame, marks: DataFrame, classes: DataFrame) -> DataFrame:
    """The first row of ``docs``, a :func:`placed` table, of every class; all columns stay, whatever their names.

    ``marks (key, same)`` has a row per document, ``classes (of, root)`` the class of each ``same``.  Of rows equal in id
    and text one stays: that with the smallest hash of all columns.
    """
    with scratch() as kept:
        keys = settle(marks.join(classes, F.col("same") == F.col("of")).select("key", "root", slice_of("key.file", "key.row").alias("slice")), "keys")
        whole = Window.partitionBy("root")
        first = keys.groupBy("root", "slice").agg(first_row().alias("first"), F.count("*").alias("m"))
        first = first.select("root", "slice", F.min("first").over(whole).alias("first"), F.sum("m").over(whole).alias("m")).where("m > 1")
        gone = keys.join(first, ["root", "slice"]).where("key.file <> first.file or key.row <> first.row")
        kept.append(sift(docs, settle(gone.select("key.file", "key.row"), "gone"), "left_anti"))
    return kept[0]
