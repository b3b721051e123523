"""Approximate nearest neighbours by a permutation index.

1. PIVOTS vectors are chosen, each as far as can be from those before it, from a
   bounded sample of FIT rows.
2. Every vector is represented by its pivots in order of nearness.
3. Rows are dealt by hash into blocks.  A block's inverted file holds one list
   per pivot: the position that the pivot has in the order of each of its rows.
4. A query walks the lists of its pivots, nearest first, and sums up how far
   each row's position is from its own (the footrule distance).
5. The SHARE of each block with the least footrule distance, ties included, is
   measured exactly.

Files and groups of queries meet in tasks of bounded size; a query is never sent
to the driver and no table is broadcast, but for the pivots themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausemill.llm.vectors import _matrix
from clausemill.storage import discard, settle

#: Pivots, at most 256 so that a position is a byte; rows of the sample that they are chosen from.
PIVOTS, FIT = 256, 4096
#: Rows of a block, and queries that visit a block together.
BLOCK, TOGETHER = 8192, 1024
#: Part of each block that is measured exactly, and the least number of its rows.
SHARE, FLOOR = 0.10, 128


def usable_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(row, vec_id, v)`` with components in double precision, without rows that have no id or a null, empty, zero or non-finite vector."""
    v = F.col(f"`{vector_col}`")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    good = F.col(f"`{id_col}`").isNotNull() & F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))
    return rows.where(good).select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), v.cast("array<double>").alias("v"))


def spread_pivots(sample: np.ndarray, pivots: int) -> np.ndarray:
    """At most ``pivots`` different rows of ``sample``, each the farthest from all before it; the first row is the first one."""
    chosen, away = [], np.full(len(sample), np.inf)
    while len(sample) and len(chosen) < pivots:
        nxt = int(away.argmax())
        if away[nxt] <= 0.0:
            break
        chosen.append(nxt)
        away = np.minimum(away, ((sample - sample[nxt]) ** 2).sum(axis=1))
    return sample[chosen]


def _widen(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def positions(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """For every row of ``x`` the position of each pivot in the order of nearness; equally near ones in their own order."""
    width = max(x.shape[1], pivots.shape[1])
    x, pivots = _widen(x, width), _widen(pivots, width)
    square = (pivots**2).sum(axis=1)[None, :] - 2.0 * (x @ pivots.T)
    out = np.empty(square.shape, np.uint8)
    np.put_along_axis(out, np.argsort(square, axis=1, kind="stable"), np.arange(len(pivots), dtype=np.uint8)[None, :], axis=1)
    return out


def _place(pivots: np.ndarray):
    """Add the positions of its pivots to every vector."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for a in range(0, len(part), BLOCK):
                piece = part.iloc[a : a + BLOCK].copy()
                piece["order"] = [p.tobytes() for p in positions(_matrix(piece["v"]), pivots)]
                yield piece

    return place


def _post(part: pd.DataFrame) -> pd.DataFrame:
    """The inverted file of a block: a list of positions per pivot, and under pivot -1 the vectors themselves."""
    x = _matrix(part["v"])
    lists = np.frombuffer(b"".join(part["order"]), np.uint8).reshape(len(part), -1).T
    ids = part["vec_id"].to_numpy(np.int64).tobytes()
    files = [(-1, x.tobytes(), ids), *((p, np.ascontiguousarray(one).tobytes(), b"") for p, one in enumerate(lists))]
    return pd.DataFrame(files, columns=["pivot", "list", "ids"]).assign(block=part["block"].iat[0])[["block", "pivot", "list", "ids"]]


def footrule(lists: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Sum over the pivots, nearest to the query first, of the distance between a row's position and the query's."""
    total, gap = np.zeros(lists.shape[1], np.uint16), np.empty(lists.shape[1], np.int16)
    for pivot in np.argsort(order, kind="stable"):
        np.subtract(lists[pivot], np.int16(order[pivot]), out=gap, dtype=np.int16)
        np.abs(gap, out=gap)
        total += gap.view(np.uint16)
    return total


def _search(k: int, share: float, floor: int):
    """The ``k`` nearest found in a block for each query of a group."""

    def search(asked: pd.DataFrame, files: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(asked) and len(files):
            files = files.sort_values("pivot")
            ids = np.frombuffer(files["ids"].iat[0], np.int64)
            x = np.frombuffer(files["list"].iat[0], np.float64).reshape(len(ids), -1)
            lists = np.frombuffer(b"".join(files["list"].iloc[1:]), np.uint8).reshape(-1, len(ids))
            q = _matrix(asked["v"])
            width = max(q.shape[1], x.shape[1])
            q, x, n = _widen(q, width), _widen(x, width), min(len(ids), max(floor, int(np.ceil(share * len(ids)))))
            for qid, vector, order in zip(asked["vec_id"], q, asked["order"]):
                far = footrule(lists, np.frombuffer(order, np.uint8))
                near = np.flatnonzero((far <= np.partition(far, n - 1)[n - 1]) & (ids != qid))
                d = np.sqrt(((x[near] - vector) ** 2).sum(axis=1))
                best = np.lexsort((ids[near], d))[:k]
                found.append((np.full(len(best), qid), ids[near[best]], d[best]))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns)))

    return search


def nearest(rows: DataFrame, k: int = 10, every: int = 100, pivots: int = PIVOTS, share: float = SHARE, floor: int = FLOOR, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for every vector whose id is divisible by ``every``, the ``k`` nearest others found.

    score is the Euclidean distance in double precision; ties go to the smaller vec_id.  Fewer than ``k`` others: all of
    them.  ``share`` (at least ``floor`` rows) of every block of vectors is measured exactly, so a higher share finds more.

    Rows without id, and vectors that are null, empty, all zero or hold a null or non-finite component, take no part.
    Every other row counts, also one that repeats another; rows with the query's id are never its results, and rows that
    share a query's id ask together, so their results are ranked as one list.  A shorter vector counts as continued with
    zeros.  Other columns, whatever their names, are not read.  An empty table gives no rows.
    """
    if not 1 <= pivots <= 256:
        raise ValueError("pivots must be between 1 and 256")
    vectors = usable_vectors(rows, id_col, vector_col)
    fit = vectors.select("v", F.xxhash64("vec_id", "v").alias("h")).orderBy("h").limit(FIT).select("v").toPandas()["v"]
    chosen = spread_pivots(_matrix(fit), pivots)
    placed = settle(vectors.mapInPandas(_place(chosen), "row bigint, vec_id bigint, v array<double>, order binary"), "placed")
    blocks = max(1, -(-placed.count() // BLOCK))
    files = placed.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    files = settle(files.groupBy("block").applyInPandas(_post, "block bigint, pivot int, list binary, ids binary"), "files")
    asked = placed.where(F.pmod("vec_id", F.lit(every)) == 0).select("row", "vec_id", "v", "order")
    groups = max(1, -(-asked.count() // TOGETHER))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(groups))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
    met = files.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint"))))
    found = asked.groupBy("block", "part").cogroup(met.groupBy("block", "part")).applyInPandas(_search(k, share, floor), "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    out = settle(found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "nearest")
    discard(placed, files)
    return out
