"""Near-duplicates by SimHash and by shared word shingles.

:func:`keep_first` links texts by a Jaccard similarity of at least 0.8.  With ``radius``, candidates are first the
components of operator 1 (SimHash fingerprints, compared bit-sliced), each a block, and an exact check of shingles follows;
bands of minima add the candidates that the radius misses.

Plan
----
1. One pass gives each document a digest of its shingle set and BANDS keys of
   ROWS minima each.  Two texts at similarity 0.8 share a key with probability
   1 - (1 - 0.8 ** ROWS) ** BANDS = 0.99993, more similar ones oftener.
2. Equal sets collapse to one row; a set is known by its digest.
3. Documents that share a key form a block.  Blocks with the same members are
   one; a large block is dealt into chunks, and each pair of chunks is a unit.
4. Only documents in a block give their whole shingle sets, which are held
   against each other exactly inside a unit.  Units give spanning edges only;
   :func:`components` joins them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausemill.llm.components import components
from clausemill.llm.keep import first_row, keep_one, keyed, placed, sifted
from clausemill.llm.rows import per_text
from clausemill.llm.simhash import _hook, fingerprint, links
from clausemill.storage import scratch, settle, settle_all

SHINGLE, LEAST, SEED = 5, 0.8, 42
#: Bands of minima, and minima in each.
BANDS, ROWS = 24, 5
#: Rows, and shingles, of a block that are compared in one unit.
BLOCK, HELD = 2048, 1_000_000
#: Shingles whose minima are taken at once, and rows of shingles that a task takes at once.
AT_ONCE = 2048

_SETS = "same bigint, found array<bigint>"

_RANDOM = np.random.default_rng(SEED)
_XOR = _RANDOM.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64)
_ODD = _RANDOM.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)


def shingles(text: str) -> np.ndarray:
    """Sorted different hashes of a text's runs of SHINGLE words; a shorter text is one run, one without a word none."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()  # as in simhash: only A-Z and ASCII white space count
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    n = max(1, len(words) - SHINGLE + 1)
    pieces = map(joined.__getitem__, map(slice, [0, *ends[: n - 1]], (e - 1 for e in ends[-n:])))
    return np.unique(np.fromiter(map(xxh64_intdigest, pieces, repeat(SEED)), np.uint64, n))


def _keys(found: np.ndarray) -> np.ndarray:
    """The BANDS keys of a set of shingles."""
    from xxhash import xxh64_intdigest

    least = np.full(BANDS * ROWS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for a in range(0, len(found), AT_ONCE):
        np.minimum(least, ((found[a : a + AT_ONCE] ^ _XOR) * _ODD).min(axis=1), out=least)
    return np.array([xxh64_intdigest(band.tobytes(), i) for i, band in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def _digest(found: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(found.tobytes(), SEED)


def _marks(texts: list[str]) -> dict:
    every = [shingles(t) for t in texts]
    keys = [_keys(s) if len(s) else np.zeros(0, np.int64) for s in every]
    return {"same": np.array([_digest(s) for s in every], np.uint64).view(np.int64), "size": [len(s) for s in every], "keys": keys}


def _marks_with_fingerprints(texts: list[str]) -> dict:
    return _marks(texts) | {"fp": np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)}


def _sets(texts: list[str]) -> dict:
    every = [shingles(t) for t in texts]
    return {"same": np.array([_digest(s) for s in every], np.uint64).view(np.int64), "found": [s.view(np.int64) for s in every]}


def _sets_of(docs: DataFrame, text_col: str) -> DataFrame:
    return per_text(docs.select(F.lit(0).alias("none"), F.col(f"`{text_col}`").alias("text")), _sets, _SETS.replace(", ", ","), "none", "text").drop("doc_id")


def link_unit(values: np.ndarray, size: np.ndarray, side: np.ndarray, least: float = LEAST) -> np.ndarray:
    """Label of every row of a unit: the first row it is linked with, directly or through others.

    ``values`` holds the shingles of all rows one after the other.  If any row has side 1, rows of side 0 are only
    compared with those; otherwise all are compared.
    """
    n = len(size)
    label, start = np.arange(n), np.r_[0, np.cumsum(size)[:-1]]
    codes = np.unique(values, return_inverse=True)[1]
    mine = np.zeros(codes.max(initial=0) + 1, bool)
    for i in np.flatnonzero(side == 0):
        rest = np.flatnonzero(side == 1) if side.any() else np.arange(i + 1, n)
        rest = rest[(label[rest] != label[i]) & (np.minimum(size[rest], size[i]) >= least * np.maximum(size[rest], size[i]))]
        if not len(rest):
            continue
        own, w = codes[start[i] : start[i] + size[i]], size[rest]
        first = np.r_[0, np.cumsum(w)[:-1]]
        mine[own] = True
        both = np.add.reduceat(mine[codes[np.repeat(start[rest] - first, w) + np.arange(w.sum())]].astype(np.int64), first)
        mine[own] = False
        near = rest[both >= least * (size[i] + w - both) - 1e-9]
        _hook(label, np.full(len(near), i), near)
    return label


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None

    def edges(rep, unit, side, size, values) -> pa.RecordBatch:
        edge = np.r_[0, np.flatnonzero(unit[1:] != unit[:-1]) + 1, len(unit)]
        at, a, b = np.r_[0, np.cumsum(size)], [], []
        for x, y in zip(edge, edge[1:]):
            label = link_unit(values[at[x] : at[y]], size[x:y], side[x:y])
            linked = np.flatnonzero(label != np.arange(y - x))
            a.append(rep[x + linked])
            b.append(rep[x + label[linked]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    for batch in (b.slice(at, AT_ONCE) for b in batches for at in range(0, b.num_rows, AT_ONCE)):
        lists = batch.column(3)
        part = [*(batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)), pc.list_value_length(lists).to_numpy().astype(np.int64), lists.flatten().to_numpy()]
        part = part if held is None else [np.concatenate(p) for p in zip(held, part)]
        changes = np.flatnonzero(part[1][1:] != part[1][:-1])
        cut = changes[-1] + 1 if len(changes) else 0  # the last unit may go on in the next batch
        inside = part[3][:cut].sum()
        if cut:
            yield edges(*(p[:cut] for p in part[:4]), part[4][:inside])
        held = [*(p[cut:] for p in part[:4]), part[4][inside:]]
    if held is not None and len(held[0]):
        yield edges(*held)


def _blocks(distinct: DataFrame) -> DataFrame:
    """``(same, unit, side)``: what is compared with what.  Blocks with the same members count once."""
    rows = distinct.select("same", "size", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("held"), F.min("same").alias("least"), F.bit_xor(F.xxhash64("same")).alias("x"), F.bit_xor(F.xxhash64("same", F.lit(1))).alias("y")).where("n > 1")
    shared = shared.groupBy("n", "held", "least", "x", "y").agg(F.min("key").alias("key"))
    chunks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("held") / HELD)).cast("int")
    return (
        rows.join(shared.select("key", chunks.alias("chunks")), "key")
        .select("same", "key", F.pmod(F.xxhash64("same"), F.col("chunks")).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
        .select("same", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("unit"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    )


def _fingerprint_edges(marks: DataFrame, radius: int) -> DataFrame:
    """Edges ``(a, b)`` between sets of shingles whose texts have equal fingerprints, or ones within ``radius`` bits."""
    pairs = settle(marks.select("fp", "same").distinct(), "fingerprints")
    distinct = settle(pairs.groupBy("fp").agg(F.min("same").alias("rep")), "distinct")
    equal = pairs.join(distinct, "fp").where("same <> rep").select(F.col("same").alias("a"), F.col("rep").alias("b"))
    return equal.unionAll(links(distinct.select("rep", "fp"), radius))


def _with_components(distinct: DataFrame, marks: DataFrame, radius: int) -> DataFrame:
    """``distinct`` with one more key in ``keys`` where operator 1 links a set with others: its component."""
    roots = components(_fingerprint_edges(marks, radius))
    keys = F.when(F.col("root").isNull(), F.col("keys")).otherwise(F.concat("keys", F.array(F.xxhash64("root", F.lit("fp")))))
    return distinct.join(roots, F.col("same") == F.col("node"), "left").select("same", "first", "size", keys.alias("keys"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stored: bool = False, radius: int | None = None) -> DataFrame:
    """The first row of ``docs`` of every group, written to the shared folder; all columns stay, whatever their names.

    A group holds what is linked, directly or through others, by a Jaccard similarity of LEAST or more over SHINGLE-word
    shingles.  Its first row is the one with the smallest doc_id, nulls last.  Texts without a word, null ones among
    them, are one group.  Rows that share an id are judged each by its own text; of rows equal in id and text one stays.
    An empty table gives no rows.  ``stored`` says that ``docs`` is a plain read of Parquet files, see :func:`placed`.
    ``radius`` adds the components of fingerprints within that many bits to what is compared.  Texts are read up to three times and never shuffled.
    """
    with scratch() as kept:
        docs = placed(docs, stored)
        mark, more = (_marks, "") if radius is None else (_marks_with_fingerprints, ",fp bigint")
        marks = settle(per_text(keyed(docs, id_col, text_col), mark, "same bigint,size int,keys array<bigint>" + more, "key", "text").withColumnRenamed("doc_id", "key"), "marks")
        distinct = settle(marks.groupBy("same").agg(first_row().alias("first"), F.first("size").alias("size"), F.first("keys").alias("keys")), "distinct")
        if radius is not None:
            distinct = settle(_with_components(distinct, marks, radius), "distinct")
        blocks = settle(_blocks(distinct), "blocks")
        asked = settle(distinct.join(blocks.select("same").distinct(), "same", "left_semi").select("first.file", "first.row"), "asked")
        none = docs.sparkSession.range(0).select(F.lit(None).cast("bigint").alias("same"), F.lit(None).cast("array<bigint>").alias("found"))  # an empty list would start Python workers of another kind beside the others
        sets = settle_all((df for parts in ((_sets_of(part, text_col) for part in sifted(docs, asked, "left_semi")), [none]) for df in parts), "sets")
        linked = blocks.join(sets, "same").select("same", "unit", "side", "found")
        edges = linked.repartition("unit").sortWithinPartitions("unit", "side", "same").mapInArrow(_edges, "a bigint, b bigint")
        roots = components(edges)
        classes = distinct.select("same").join(roots, F.col("same") == F.col("node"), "left").select(F.col("same").alias("of"), F.coalesce("root", "same").alias("root"))
        kept.append(keep_one(docs, marks.select("key", "same"), classes))
    return kept[0]
