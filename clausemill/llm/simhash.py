"""SimHash near-duplicates: fingerprints of word shingles, linked by bit-sliced comparison.

Plan
----
1. One fingerprint per document (map only), written to the shared folder.
2. Equal fingerprints collapse to one row.  All later work is on different
   fingerprints, so a huge group of copies is one row.
3. Candidate blocks: the 64 bits are cut into ``radius + 2`` fields; two
   fingerprints within the radius agree on at least two whole fields, so
   every link lies in a block keyed by one pair of fields.  Blocks of one row
   need no comparison.  A block of more than BLOCK rows is dealt into chunks,
   and each pair of chunks becomes a task unit of its own.
4. Within a unit, bit planes are stored vertically, 64 fingerprints to a word.
   A row is compared with a word of 64 others at once: XOR per plane, distances
   kept in carry-save counters, and a word is abandoned as soon as all of its
   64 distances exceed the radius.
5. Units give spanning edges only; :func:`components` joins them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausemill.llm.components import components, slice_of
from clausemill.llm.keep import keep_one, keyed, placed
from clausemill.llm.rows import per_text
from clausemill.storage import discard, scratch, settle

#: Rows of a candidate block that are compared in one unit.
BLOCK = 2048
#: Shingles of a text hashed at once, and (row, word) comparisons held at once.
SHINGLES, COMPARISONS = 1 << 16, 1 << 15

_BITS = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(np.int64)
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str, shingle: int = 4, seed: int = 42) -> int:
    """SimHash of a text: bit set where over half the shingle hashes have it; no word gives zero."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space count
    if not words:
        return 0
    if len(words) <= shingle:
        return xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts, n = [0, *ends[:-shingle]], len(words) - shingle + 1
    counts = np.zeros((8, 8), np.int64)
    for a in range(0, n, SHINGLES):
        b = min(n, a + SHINGLES)
        pieces = map(joined.__getitem__, map(slice, starts[a:b], (e - 1 for e in ends[a + shingle - 1 : b + shingle - 1])))
        hashes = np.fromiter(map(xxh64_intdigest, pieces, repeat(seed)), np.uint64, b - a)
        places = hashes.view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256)
        counts += np.bincount(places.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    bits = counts.ravel() * 2 > n
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """``(doc_id, fp)`` per row of ``docs``: fp is the 64-bit fingerprint as a signed long; null text counts as empty."""

    def of(texts: list[str]) -> dict:
        return {"fp": np.array([fingerprint(t, shingle, seed) for t in texts], np.uint64).view(np.int64)}

    return per_text(docs, of, "fp bigint", id_col, text_col)


def _planes(fp: np.ndarray) -> np.ndarray:
    """[64, words]: plane b holds bit b of 64 consecutive fingerprints in each word."""
    lanes = np.zeros(-(-len(fp) // 64) * 64, np.uint64)
    lanes[: len(fp)] = fp
    return np.stack([np.packbits((lanes >> np.uint64(b)).astype(np.uint8) & 1, bitorder="little").view(np.uint64) for b in range(64)])


def _within(fp: np.ndarray, planes: np.ndarray, row: np.ndarray, word: np.ndarray, valid: np.ndarray, radius: int) -> tuple[np.ndarray, ...]:
    """Of the comparisons row x word, those with any distance within the radius, and the lanes that have it."""
    zero = np.zeros(len(row), np.uint64)
    ones, twos, fours, eights = zero, zero, zero, ~valid  # eights is sticky: over 7, or not a lane to compare
    for step, b in enumerate(range(0, 64, 3)):
        x = [planes[p][word] ^ (np.uint64(0) - (fp[row] >> np.uint64(p) & np.uint64(1))) for p in range(b, min(64, b + 3))]
        total, carry = x[0], None
        if len(x) == 3:  # carry-save: three planes become a sum and a carry
            half = x[0] ^ x[1]
            total, carry = half ^ x[2], (x[0] & x[1]) | (half & x[2])
        over = ones & total
        ones = ones ^ total
        if carry is not None:
            half = twos ^ carry
            twos, over = half ^ over, (twos & carry) | (half & over)
        else:
            twos, over = twos ^ over, twos & over
        eights = eights | (fours & over)
        fours = fours ^ over
        if step % 4 == 3 or b + 3 >= 64:
            gone, equal = eights.copy(), _ALL
            for bit, plane in ((4, fours), (2, twos), (1, ones)):
                if radius & bit:
                    equal = equal & plane
                else:
                    gone |= equal & plane
                    equal = equal & ~plane
            keep = np.flatnonzero(gone != _ALL)
            if len(keep) < 0.8 * len(row) or b + 3 >= 64:
                row, word, ones, twos, fours, eights, gone = (a[keep] for a in (row, word, ones, twos, fours, eights, gone))
            if not len(row):
                break
    return (row, word, ~gone) if len(row) else (row, word, zero[:0])


def _hook(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a[i] and b[i]; a label is the smallest index of its set."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(up := label[label], label):
            label[:] = up


def link_sorted(fp: np.ndarray, unit: np.ndarray, side: np.ndarray, radius: int) -> np.ndarray:
    """Label of every row: the first row it is linked with inside its unit, directly or through others.

    Rows come sorted by unit, then side.  A unit whose rows all have side 0 is compared with itself;
    otherwise rows of side 0 are compared with those of side 1.
    """
    n = len(fp)
    label = np.arange(n)
    edge = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
    size = np.diff(np.r_[edge, n])
    end = np.repeat(edge + size, size)
    apart = np.add.reduceat(side, edge) if n else side
    low = np.where(np.repeat(apart, size) > 0, end - np.repeat(apart, size), np.arange(n) + 1)
    rows = np.flatnonzero((side == 0) & (low < end))
    if not len(rows):
        return label
    planes = _planes(fp)
    low, end = low[rows], end[rows]
    first, words = low >> 6, ((end - 1) >> 6) - (low >> 6) + 1
    done = np.r_[0, np.cumsum(words)]
    a = 0
    while a < len(rows):
        b = max(a + 1, int(np.searchsorted(done, done[a] + COMPARISONS, "right")) - 1)
        w = words[a:b]
        word = np.repeat(first[a:b] - done[a:b], w) + np.arange(done[a], done[b])
        lo = np.clip(np.repeat(low[a:b], w) - word * 64, 0, 63).astype(np.uint64)
        hi = np.clip(word * 64 + 64 - np.repeat(end[a:b], w), 0, 63).astype(np.uint64)
        row, word, lanes = _within(fp, planes, np.repeat(rows[a:b], w), word, (_ALL << lo) & (_ALL >> hi), radius)
        if len(row):
            bits = np.unpackbits(lanes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            at, lane = np.nonzero(bits)
            _hook(label, row[at], word[at] * 64 + lane)
        a = b
    return label


def _edges(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def edges(part: np.ndarray) -> pa.RecordBatch:
            rep, fp, key, side = part
            label = link_sorted(fp.view(np.uint64), key, side, radius)
            linked = np.flatnonzero(label != np.arange(len(label)))
            return pa.RecordBatch.from_arrays([pa.array(rep[linked]), pa.array(rep[label[linked]])], names=["a", "b"])

        for batch in batches:
            part = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)])
            part = part if held is None else np.concatenate([held, part], axis=1)
            changes = np.flatnonzero(part[2, 1:] != part[2, :-1])
            cut = changes[-1] + 1 if len(changes) else 0  # the last unit may go on in the next batch
            if cut:
                yield edges(part[:, :cut])
            held = part[:, cut:]
        if held is not None and held.shape[1]:
            yield edges(held)

    return run


def _fields(radius: int) -> list[int]:
    """Masks of all pairs of ``radius + 2`` fields, as signed longs."""
    cuts = [round(64 * i / (radius + 2)) for i in range(radius + 3)]
    field = [((1 << b) - 1) & ~((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    return [m - (1 << 64) if (m := x | y) >> 63 else m for x, y in combinations(field, 2)]


def links(distinct: DataFrame, radius: int = 4) -> DataFrame:
    """Edges ``(a, b)`` of doc_ids that connect exactly the fingerprints within ``radius`` bits (0 to 7) of each other.

    ``distinct (rep, fp)`` has each fingerprint once.  The edges span the components; not every linked pair is one.
    """
    masks = _fields(radius)
    keys = F.array(*[F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)])
    rows = distinct.select("rep", "fp", F.explode(keys).alias("b")).select("rep", "fp", "b.c", "b.k")
    shared = rows.groupBy("c", "k").agg(F.count("*").alias("n")).where("n > 1")
    chunks = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("fp"), chunks).cast("int")
    dealt = (
        rows.join(shared, ["c", "k"])
        .select("rep", "fp", "c", "k", mine.alias("own"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("other"))
        .select("rep", "fp", F.xxhash64("c", "k", F.least("own", "other"), F.greatest("own", "other")).alias("unit"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    )
    return dealt.repartition("unit").sortWithinPartitions("unit", "side", "rep").mapInArrow(_edges(radius), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` per row of ``docs``.

    component_id is the smallest doc_id reachable over links of at most ``radius`` differing bits, itself included.

    * Null or blank text: fingerprint zero, linked like any other.
    * Null doc_id: the row gets its component's id, which is null only if no row of the component has one.
    * Repeated rows: each gives its row.  Rows that share an id but not a text are linked by their texts only.
    * Empty table: no rows.  Other columns of ``docs`` are not read.
    """
    marks = settle(fingerprints(docs, id_col, text_col, shingle, seed).select(F.col("doc_id").cast("bigint"), "fp"), "fingerprints")
    distinct = settle(marks.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct.select(F.col("fp").alias("rep"), "fp"), radius))
    named = settle(distinct.join(roots, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("of"), "root", "least"), "named")
    linked = named.where("root is not null").withColumn("slice", slice_of("of"))
    least = linked.groupBy("root", "slice").agg(F.min("least").alias("least")).select("root", "slice", F.min("least").over(Window.partitionBy("root")).alias("component_id"))
    alone = named.where("root is null").select("of", F.col("least").alias("component_id"))
    classes = settle(linked.join(least, ["root", "slice"]).select("of", "component_id").unionAll(alone), "classes")
    discard(distinct, named)
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return marks.join(classes, F.col("fp") == F.col("of"), "left").select("doc_id", hexed, "component_id")


def keep_first(docs: DataFrame, radius: int = 4, shingle: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", stored: bool = False) -> DataFrame:
    """The first row of ``docs`` (smallest doc_id, nulls last) of every component of fingerprints, written to the shared folder; all columns stay, whatever their names.

    Rows that share an id are judged each by its own text; of rows equal in id and text one stays.  An empty table gives
    no rows.  ``stored`` says that ``docs`` is a plain read of Parquet files, see :func:`placed`.
    """
    with scratch() as kept:
        docs = placed(docs, stored)
        marks = settle(fingerprints(keyed(docs, id_col, text_col), "key", "text", shingle, seed).select(F.col("doc_id").alias("key"), F.col("fp").alias("same")), "fingerprints")
        distinct = settle(marks.select("same").distinct(), "distinct")
        roots = components(links(distinct.select(F.col("same").alias("rep"), F.col("same").alias("fp")), radius))
        classes = distinct.join(roots, F.col("same") == F.col("node"), "left").select(F.col("same").alias("of"), F.coalesce("root", "same").alias("root"))
        kept.append(keep_one(docs, marks, classes))
    return kept[0]
