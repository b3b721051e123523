"""Exact top-k inner-product search by pivot-table elimination.

1. Every vector's distances to a fixed number of pivots are computed once.
   Vectors are dealt by range of (nearest pivot, distance to it) into blocks of
   about BLOCK rows, so a block's distances to each pivot span a short range.
2. Each query is answered inside its own block first, which gives it a k-th
   best score that every later candidate has to reach.
3. For a query and a block, every pivot gives a lower bound on the distance
   (triangle inequality); the largest one bounds the inner product from above.
   Blocks that cannot reach the k-th best are not visited.
4. In a visited block each candidate has a bound of its own.  Candidates are
   scored in the order of their bounds until the next bound cannot reach the
   k-th best so far.

Only pairs of a block and a group of queries that still have business with each
other meet in a task, never all vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausemill.storage import discard, settle

#: Rows of a block of vectors, and blocks whose queries search together.
BLOCK, TOGETHER = 4096, 16
#: Pivots; candidates that a query scores at once.
PIVOTS, AT_ONCE = 32, 256
#: Rounding allowed for in a bound, whose distances are computed in floating point.
SLACK = 1e-6


def integer_vectors(rows: DataFrame, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, v)``: components as floor(scale * x).  Rows without id, or with a null or non-finite component, are left out."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    usable = rows.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.coalesce(finite, F.lit(False)))
    return usable.select(F.col(id_col).cast("bigint").alias("vec_id"), F.transform(vector_col, lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("v"))


def _matrix(vectors: pd.Series, width: int | None = None) -> np.ndarray:
    """Vectors as rows; a short one counts as continued with zeros."""
    width = width if width is not None else max(map(len, vectors), default=0)
    if all(len(v) == width for v in vectors):
        return np.array(vectors.tolist(), np.float64).reshape(len(vectors), width)
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : min(width, len(v))] = v[:width]
    return out


def pivot_table(vectors: DataFrame, pivots: int = PIVOTS) -> DataFrame:
    """``(row, vec_id, v, d, cell, near)``: d holds the distances to ``pivots`` vectors, picked by a hash of the id and value; near is the one to the nearest, cell."""
    picked = vectors.select("v", F.xxhash64("vec_id", "v").alias("h")).orderBy("h").limit(pivots).collect()
    marks = [r["v"] for r in picked]

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            width = max([*map(len, part["v"]), *map(len, marks)], default=0)
            x, p = _matrix(part["v"], width), _matrix(pd.Series(marks, dtype=object), width)
            d = np.stack([np.sqrt(((x - m) ** 2).sum(axis=1)) for m in p], axis=1) if len(p) else np.zeros((len(x), 0))
            part["d"], part["cell"], part["near"] = list(d), d.argmin(axis=1) if d.size else 0, d.min(axis=1) if d.size else 0.0
            yield part

    return vectors.withColumn("row", F.monotonically_increasing_id()).mapInPandas(measure, "vec_id bigint, v array<bigint>, row bigint, d array<double>, cell int, near double")


def _best(vector: np.ndarray, qid: int, bound: np.ndarray, c: np.ndarray, ids: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of the best ``k`` candidates with at least ``least``, scored in the order of ``bound``."""
    able = np.flatnonzero((bound >= least) & (ids != qid))
    able = able[np.argsort(-bound[able], kind="stable")]
    scores, found = np.zeros(0), np.zeros(0, np.int64)
    for a in range(0, len(able), AT_ONCE):
        if bound[able[a]] < least:
            break
        take = able[a : a + AT_ONCE]
        s = c[take] @ vector
        good = s >= least
        scores, found = np.r_[scores, s[good]], np.r_[found, ids[take[good]]]
        top = np.lexsort((found, -scores))[:k]
        scores, found = scores[top], found[top]
        if len(scores) == k:
            least = max(least, scores[-1])
    return scores, found


def _bounds(vector: np.ndarray, qd: np.ndarray, half: np.ndarray, cd: np.ndarray) -> np.ndarray:
    """The most that the inner product with each candidate can be."""
    near = np.maximum(np.abs(cd - qd[:, None]).max(axis=0, initial=0.0) - SLACK, 0.0)
    return half + (vector @ vector) / 2 + SLACK - near * near / 2


def _block(part: pd.DataFrame) -> tuple[np.ndarray, ...]:
    x, d = _matrix(part["v"]), np.ascontiguousarray(_matrix(part["d"]).T)
    return x, d, part["vec_id"].to_numpy(), (x**2).sum(axis=1) / 2


def _seed(k: int, every: int):
    """Of one block: its ranges, and the k-th best score that each of its queries finds in it."""

    def seed(part: pd.DataFrame) -> pd.DataFrame:
        x, d, ids, half = _block(part)
        out = [(int(part["block"].iat[0]), None, d.min(axis=1), d.max(axis=1), float(half.max()))]
        for i in np.flatnonzero(ids % every == 0):
            scores, _ = _best(x[i], ids[i], _bounds(x[i], d[:, i], half, d), x, ids, k, -np.inf)
            out.append((int(part["block"].iat[0]), part["row"].iat[i], None, None, float(scores[-1]) if len(scores) == k else -np.inf))
        return pd.DataFrame(out, columns=["block", "row", "low", "high", "value"]).astype({"row": "Int64"})

    return seed


def _visits(q: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
    """``(row, block)``: the blocks that may hold a candidate which reaches a query's k-th best."""
    rows, at = [], []
    if len(q) and len(blocks):
        low, high, half = _matrix(blocks["low"]), _matrix(blocks["high"]), blocks["value"].to_numpy()
        numbers = blocks["block"].to_numpy()
        for row, square, d, least in zip(q["row"], q["square"], _matrix(q["d"]), q["least"]):
            near = np.maximum(np.maximum(low - d, d - high).max(axis=1, initial=0.0) - SLACK, 0.0)
            able = numbers[half + square / 2 + SLACK - near * near / 2 >= least]
            rows.append(np.full(len(able), row))
            at.append(able)
    return pd.DataFrame({"row": np.concatenate(rows) if rows else np.zeros(0, np.int64), "block": np.concatenate(at) if at else np.zeros(0, np.int64)})


def _search(k: int):
    def search(q: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(q) and len(part):
            width = max(*map(len, q["v"]), *map(len, part["v"]), 0)
            x, d, ids, half = _matrix(part["v"], width), np.ascontiguousarray(_matrix(part["d"]).T), part["vec_id"].to_numpy(), None
            half = (x**2).sum(axis=1) / 2
            for qid, vector, qd, least in zip(q["vec_id"], _matrix(q["v"], width), _matrix(q["d"]), q["least"]):
                scores, found = _best(vector, qid, _bounds(vector, qd, half, d), x, ids, k, least)
                out["query_id"].append(np.full(len(found), qid))
                out["vec_id"].append(found)
                out["score"].append(scores.astype(np.int64))
        return pd.DataFrame({n: np.concatenate(v) if v else np.empty(0, np.int64) for n, v in out.items()})

    return search


def top_k(rows: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0, pivots: int = PIVOTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for every vector whose id is divisible by ``every``, its ``k`` best others.

    score is the inner product of the integer vectors; ties go to the smaller vec_id.  Fewer than ``k`` others: all of them.

    Rows without id, and vectors that are null or hold a null or non-finite component, take no part.  Every row counts,
    also one that repeats another; rows with the query's id are never its results, and rows that share a query's id ask
    together, so their results are ranked as one list.  A shorter vector counts as continued with zeros.  Sums are exact
    up to 2**53.  An empty table gives no rows.
    """
    table = settle(pivot_table(integer_vectors(rows, scale, id_col, vector_col), pivots), "pivots")
    blocks = max(1, -(-table.count() // BLOCK))
    dealt = table.repartitionByRange(blocks, "cell", "near", F.xxhash64("row")) if blocks > 1 else table.coalesce(1)
    dealt = settle(dealt.drop("cell", "near").withColumn("block", F.spark_partition_id().cast("bigint")), "blocks")
    discard(table)
    seeds = settle(dealt.groupBy("block").applyInPandas(_seed(k, every), "block bigint, row bigint, low array<double>, high array<double>, value double"), "seeds")
    ranges = seeds.where("row is null").select("block", "low", "high", "value")
    group = F.floor(F.col("block") / TOGETHER).alias("group")
    asked = dealt.where(F.pmod("vec_id", F.lit(every)) == 0).select("row", "vec_id", "v", "d", group).join(seeds.where("row is not null").select("row", F.col("value").alias("least")), "row")
    asked = settle(asked.withColumn("square", F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))), "asked")
    # Queries and block ranges meet in squares of 16 * TOGETHER blocks each; a range row is small.
    parts = (ranges.agg(F.max("block")).first()[0] or 0) // (16 * TOGETHER) + 1
    deal = lambda c: F.floor(c / (16 * TOGETHER)).cast("int")
    every_part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = asked.select("row", "d", "square", "least", deal(F.col("group") * TOGETHER).alias("a")).withColumn("b", every_part)
    right = ranges.withColumn("b", deal(F.col("block"))).withColumn("a", every_part)
    visits = settle(left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(_visits, "row bigint, block bigint"), "visits")
    going = asked.select("row", "vec_id", "v", "d", "least", "group").join(visits, "row")
    pairs = settle(going.select("block", "group").distinct(), "pairs")
    met = dealt.join(pairs, "block")
    found = going.groupBy("block", "group").cogroup(met.groupBy("block", "group")).applyInPandas(_search(k), "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
