"""Best-fit packing of token sequences, with lower bounds that certify each partition.

Pieces are dealt by hash into partitions of about BINS bins.  Each partition
runs best-fit decreasing and compares its bin count with the largest of several
dual-feasible-function bounds.  Full bins are final.  A partition that meets its
bound keeps all but its emptiest bin; one with a gap gives up more of its
emptiest bins.  What was given up meets the documents of other partitions in the
next round, over fewer partitions, until one partition holds the rest.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausemill.llm.rows import per_text
from clausemill.llm.tokens import default_vocabulary, token_bytes
from clausemill.storage import settle

#: Bins of a partition, on average.
BINS = 512
#: Bins given up for each bin above the bound.
RELEASE = 8

PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, capacity: int = 2048, vocabulary: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The token pieces of every document: its ids, then ``end_id``, cut only where longer than ``capacity``."""
    path, end = vocabulary or default_vocabulary(), end_id.to_bytes(4, "little")

    def of(texts: list[str]) -> dict:
        out = []
        for text in texts:
            ids = token_bytes(text, path) + end
            cuts = range(0, len(ids), 4 * capacity)
            out.append([{"piece": i, "start": a // 4, "length": len(p) // 4, "ids_crc32": zlib.crc32(p)} for i, a in enumerate(cuts) if (p := ids[a : a + 4 * capacity])])
        return {"p": out}

    rows = per_text(docs, of, "p array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint>>", id_col, text_col)
    return rows.select(F.col("doc_id").cast("bigint"), F.inline("p"))


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The most bins that the dual-feasible functions used here prove necessary."""
    return bound_of_counts(np.bincount(lengths, minlength=capacity + 1), capacity) if len(lengths) else 0


def bound_of_counts(count: np.ndarray, capacity: int) -> int:
    """The same bound from the number of items of each length 0..capacity."""
    size = np.arange(capacity + 1)
    best = -(-int((count * size).sum()) // capacity)
    upto, tokens = np.cumsum(count), np.cumsum(count * size)
    half = capacity // 2
    for e in range(1, half + 1):  # items over C - e count as C, items under e as 0
        large = upto[capacity] - upto[capacity - e]
        rest = tokens[capacity - e] - tokens[e - 1]
        best = max(best, int(large) + -(-int(rest) // capacity))
    for k in range(2, 21):  # items rounded to multiples of C / k
        over = (k + 1) * size
        u = np.where(over % capacity == 0, size * k, over // capacity * capacity)
        best = max(best, -(-int((count * u).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, which come in decreasing order."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, n = 0, 0  # bit r of rooms: some bin has room for exactly r
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, length in enumerate(lengths.tolist()):
        fit = rooms >> length
        if fit:
            room = length + (fit & -fit).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, at, n = capacity, n, n + 1
        bins[i], offsets[i] = at, capacity - room
        if left := room - length:
            by_room[left].append(at)
            rooms |= 1 << left
    return bins, offsets


def _pack(capacity: int, last: bool):
    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], ignore_index=True)
        lengths = part["length"].to_numpy()
        bins, part["offset"] = best_fit_decreasing(lengths, capacity)
        part["bin"] = bins
        fill = np.bincount(bins, weights=lengths).astype(np.int64)
        gap = len(fill) - lower_bound(lengths, capacity)
        give = np.zeros(len(fill), bool)
        if not last:
            emptiest = np.argsort(fill, kind="stable")[: 1 + RELEASE * gap]
            give[emptiest] = fill[emptiest] < capacity
        part["released"] = give[bins]
        part["bound_gap"] = gap
        return part

    return pack


def pack(docs: DataFrame, capacity: int = 2048, vocabulary: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece with its place: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset, bound_gap, corpus_bound``.

    bound_gap is how many bins its partition has above the proven bound (0: certified optimal); corpus_bound is the
    number of sequences that no packing of all pieces can do without.

    Null text counts as empty: one piece that holds only ``end_id``.  Null and repeated ids are packed like any
    others.  An empty table gives no rows.  Other columns of ``docs`` are not read.
    """
    pool = settle(pieces(docs, capacity, vocabulary, end_id, id_col, text_col), "pieces")
    count = np.zeros(capacity + 1, np.int64)
    for r in pool.groupBy("length").count().collect():  # at most ``capacity`` rows
        count[r["length"]] = r["count"]
    bound = F.lit(bound_of_counts(count, capacity)).cast("bigint").alias("corpus_bound")
    done, turn, before = None, 0, None
    while True:
        tokens = pool.agg(F.sum("length")).first()[0] or 0
        parts = max(1, -(-tokens // (capacity * BINS)))
        if before is not None and parts >= before:
            parts = max(1, before // 2)
        before, last = parts, parts == 1
        dealt = pool.withColumn("part", F.pmod(F.xxhash64(F.lit(turn), F.monotonically_increasing_id()), F.lit(parts)).cast("bigint"))  # by place in the written table: repeated rows part
        packed = dealt.groupBy("part").applyInPandas(_pack(capacity, last), f"{PIECE}, part bigint, bin bigint, offset bigint, released boolean, bound_gap bigint")
        packed = settle(packed, f"packed{turn}")
        number = F.lit(turn * 2**56) + F.col("part") * 2**24 + F.col("bin")
        kept = packed.where("not released").select(*[c.split()[0] for c in PIECE.split(", ")], number.alias("sequence_id"), "offset", "bound_gap", bound)
        done = kept if done is None else done.unionByName(kept)
        if last:
            return done
        pool, turn = packed.where("released").select(*[c.split()[0] for c in PIECE.split(", ")]), turn + 1
