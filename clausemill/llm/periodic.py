"""Periodic runs of words: stretches that repeat a short sequence of words at least EXPONENT times.

All-lag scan: the array of a text's word ids is compared with itself at every
shift up to n / EXPONENT, and the stretches where both agree are run-length
coded.  Texts of a slice are scanned together, longest first, with ids of their
own, so that one comparison serves all texts that are long enough for a shift.
A text so long that its comparisons might exceed WORK is scanned in ranges of
shifts, dealt to tasks of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausemill.llm.rows import text_slices
from clausemill.storage import discard, settle

#: A run has at least LEAST words and EXPONENT periods.
LEAST, EXPONENT = 6, 4
#: Comparisons of words that one task makes for one text at most, if every other character were a word; texts of usual words take a ninth.
WORK = 36_000_000_000

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def word_ids(texts: list[str]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """``(words, ids, sizes)``: ids of all texts one after the other; texts share no id, so no shift finds words of two texts equal."""
    words = [t.encode().split() for t in texts]  # bytes split at ASCII white space alone
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    codes = pa.array([w for part in words for w in part], pa.binary()).dictionary_encode()
    ids = codes.indices.to_numpy().astype(np.int64) + np.repeat(np.arange(len(words)) * len(codes.dictionary), sizes)
    return words, ids.astype(np.int32) if len(words) * len(codes.dictionary) < 1 << 31 else ids, sizes


def stretches(ids: np.ndarray, sizes: np.ndarray, low: int = 1, high: int | None = None) -> np.ndarray:
    """Rows ``(start, end, period)`` of all runs with a period of ``low`` to ``high``, places counted through all texts.

    ``sizes`` must fall, so that the texts that are long enough for a shift come first.  Periods that are multiples of
    one within the same range are left out.
    """
    ends, found = np.cumsum(sizes), [np.zeros((0, 3), np.int64)]
    most = int(sizes.max(initial=0)) // EXPONENT
    for q in range(low, min(most, high or most) + 1):
        need = max(LEAST, EXPONENT * q)
        texts = int(np.searchsorted(-sizes, -need, side="right"))
        if not texts:
            break
        m = int(ends[texts - 1])
        same, true = ids[: m - q] == ids[q:m], need - q
        # A long enough stretch holds ``marks`` neighbours of any grid of this width; without them there is none to code.
        marks = min(4, true)
        grid = same[:: true // marks]
        hit = grid[: len(grid) - marks + 1].copy()
        for i in range(1, marks):
            hit &= grid[i : len(grid) - marks + 1 + i]
        if not hit.any():
            continue
        edge = np.flatnonzero(np.diff(same.view(np.int8), prepend=0, append=0))
        start, end = edge[::2], edge[1::2]
        long = end - start >= true
        found.append(np.stack([start[long], end[long] + q, np.full(long.sum(), q)], axis=1))
    return smallest_periods(np.concatenate(found))


def smallest_periods(found: np.ndarray) -> np.ndarray:
    """Of stretches with the same ends the one with the smallest period, by start, then period.

    A run whose smallest period divides q comes up at shift q with the same ends, and no other does.
    """
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    first = np.ones(len(found), bool)
    first[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    found = found[first]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def collapse(words: list[bytes], runs: np.ndarray) -> str:
    """The words joined by one space, without those that a run holds after its first period."""
    if len(runs):
        depth = np.zeros(len(words) + 1, np.int64)
        np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
        np.add.at(depth, runs[:, 1], -1)
        kept = np.cumsum(depth[:-1]) == 0
        words = [w for w, k in zip(words, kept) if k]
    return b" ".join(words).decode()


def _columns(words: list[list[bytes]], runs: list[np.ndarray]) -> dict:
    every = np.concatenate([np.zeros((0, 3), np.int64), *runs])
    struct = pa.StructArray.from_arrays([pa.array(every[:, 0]), pa.array(every[:, 1] - every[:, 0]), pa.array(every[:, 2])], names=["start", "length", "period"])
    offsets = np.r_[0, np.cumsum([len(r) for r in runs])].astype(np.int32)
    collapsed = pa.array([collapse(w, r) for w, r in zip(words, runs)], pa.string())
    return {"n_words": pa.array([len(w) for w in words], pa.int64()), "runs": pa.ListArray.from_arrays(pa.array(offsets), struct), "collapsed": collapsed}


def _scan(texts: list[str]) -> dict:
    """Runs and collapsed texts of a slice."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    words, ids, sizes = word_ids([texts[i] for i in order])
    fall = np.argsort(-sizes, kind="stable")
    starts = np.r_[0, np.cumsum(sizes)][:-1]
    ids = np.concatenate([np.zeros(0, ids.dtype), *(ids[starts[i] : starts[i] + sizes[i]] for i in fall)])
    found = stretches(ids, sizes[fall])
    starts = np.r_[0, np.cumsum(sizes[fall])]
    cut = np.searchsorted(found[:, 0], starts)
    words_of, runs_of = [None] * len(texts), [None] * len(texts)
    for at, i in enumerate(fall):
        runs_of[order[i]] = found[cut[at] : cut[at + 1]] - np.array([starts[at], starts[at], 0])
        words_of[order[i]] = words[i]
    return _columns(words_of, runs_of)


def _scan_short(chars: int):
    """Rows of all texts of at most ``chars`` characters."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_slices(batch.column(1)):
                mine = [i for i, t in enumerate(texts) if len(t) <= chars]
                columns = _scan([texts[i] for i in mine])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(mine, pa.int64())), *columns.values()], names=["doc_id", *columns])

    return scan


def _scan_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one range of shifts of each long text."""
    for batch in batches:
        for a, b, texts in text_slices(batch.column(3)):
            for i, text in zip(range(a, b), texts):
                row, part, parts = (batch.column(c)[i].as_py() for c in range(3))
                _, ids, sizes = word_ids([text])
                most = int(sizes[0]) // EXPONENT
                found = stretches(ids, sizes, 1 + most * part // parts, most * (part + 1) // parts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), row)), *(pa.array(found[:, c]) for c in range(3))], names=["row", "s", "e", "q"])


def _join_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs and collapsed texts of long texts whose ranges are all scanned."""
    for batch in batches:
        for a, b, texts in text_slices(batch.column(1)):
            for i, text in zip(range(a, b), texts):
                found = batch.column(2)[i].as_py() or []
                runs = np.array([(r["s"], r["e"], r["q"]) for r in found], np.int64).reshape(-1, 3)
                columns = _columns([text.encode().split()], [smallest_periods(runs)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *columns.values()], names=["doc_id", *columns])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", work: int = WORK) -> DataFrame:
    """``(doc_id, n_words, runs, collapsed)`` per row of ``docs``.

    ``runs`` holds every maximal stretch of words with smallest period q and at least max(LEAST, EXPONENT * q) words, by
    start, then period, as (start, length, period).  ``collapsed`` is the text's words joined by one space, without those
    that a run holds after its first q words.  Words are what ASCII white space separates, compared byte by byte.

    Null and empty texts have no words, no runs and an empty ``collapsed``.  Every row is judged by itself, so ids may be
    null or repeat, and other columns are not read.  An empty table gives no rows.  A text of any length is scanned whole.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words bigint, runs {RUNS}, collapsed string"
    # A text of n words takes 7/32 n^2 comparisons, and n is at most half its length.  Both branches tell by that length.
    chars = int(2 * (work * 32 / 7) ** 0.5)
    usual = source.mapInArrow(_scan_short(chars), schema)
    parts = F.ceil(F.pow(F.length("text") / 2.0, 2) * (7 / 32 / work)).cast("int")
    long = settle(source.where(F.length("text") > chars).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", parts.alias("parts")), "long")
    units = long.agg(F.sum("parts")).first()[0]
    if not units:
        discard(long)
        return usual
    ranges = long.select("row", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "parts", "text").repartition(min(units, 100_000), "row", "part")
    found = ranges.mapInArrow(_scan_range, "row bigint, s bigint, e bigint, q bigint").groupBy("row", "s", "e").agg(F.min("q").alias("q"))
    runs = found.groupBy("row").agg(F.collect_list(F.struct("s", "e", "q")).alias("found"))
    whole = long.join(runs, "row", "left").select("doc_id", "text", "found")
    return usual.unionByName(whole.mapInArrow(_join_ranges, schema))
