"""Phrases of two and three words that occur together more often than chance would have it.

1. Each task cuts runs of about HELD characters of one group's texts into pieces
   and words, and writes one row per run: its distinct words with their counts,
   and the run itself as codes of those words.
2. Words that occur LEAST times or more in their group form the dictionary, with
   dense ids.  The distinct words of each run meet the dictionary in a join; all
   other words break the pieces they stand in.
3. Neighbouring ids are packed into keys of KEY bytes, radix-sorted and
   run-length counted within the run, and cut at the bounds of key ranges.  The
   bounds come from a sample and set only where work is done.
4. Each range radix-sorts and run-length counts what all runs sent.

Words, codes and keys move as compressed blocks, each of them once.  No table is
broadcast but the bounds of the ranges, one key per GROUPED keys of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausemill.llm.rows import text_slices
from clausemill.storage import discard, settle

#: Characters of a run; a longer text is a run of its own.
HELD = 8_000_000
#: A phrase, and so each of its words, occurs at least so often; a candidate goes if PART of 100 of its places lie in a longer one.
LEAST, PART, TOP = 10, 50, 2000
#: Three ids of 32 bits, big end first.  The third is 0 in a phrase of two words; ids start at 1.
KEY = 12
#: Keys of one range, keys counted at once, and runs that the bounds are taken from at least.
GROUPED, AT_ONCE, SAMPLED = 4_000_000, 4_000_000, 64
#: Every so-manieth key of a sampled run is a candidate for a bound.
STEP = 2048
SLICES = 64

_CUT = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n\n\n\n\n\n\n\n\n ")


def _packed(values: np.ndarray) -> bytes:
    """Fixed-width numbers by byte planes, compressed; sorted ones share most planes."""
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes(), "zstd", asbytes=True) if len(values) else b""


def _unpacked(data: bytes, n: int, width: int) -> np.ndarray:
    """The bytes of ``n`` numbers of ``width`` bytes, a row each."""
    if not n:
        return np.zeros((0, width), np.uint8)
    return np.ascontiguousarray(np.frombuffer(pa.decompress(data, n * width, "zstd", asbytes=True), np.uint8).reshape(width, n).T)


def _run(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """``(words, counts, codes)`` of a run; code -1 stands between pieces."""
    # A line feed can't be in a word, so one by itself marks the border between two pieces.
    blob = b"\n".join(texts).lower().translate(_CUT).replace(b"\n", b" \n ")
    coded = pa.array(blob.split(b" "), pa.binary()).dictionary_encode()
    words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    known = np.array([w not in (b"", b"\n") for w in words], bool)
    number = np.where(known, np.cumsum(known) - 1, -1).astype(np.int32)
    codes = number[codes[codes != (words.index(b"") if b"" in words else -1)]]
    return pa.array([w for w, k in zip(words, known) if k], pa.binary()).cast(pa.string()), np.bincount(codes[codes >= 0], minlength=known.sum()), codes


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per run of texts of a group."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    task, number = TaskContext.get().partitionId(), 0

    def row(group: str) -> pa.RecordBatch:
        nonlocal number
        words, counts, codes = _run(held.pop(group))
        size.pop(group)
        number += 1
        values = [f"{task}-{number}", group, int((codes >= 0).sum()), len(codes), pa.compress(codes.tobytes(), "zstd", asbytes=True)]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), x) for x in (words, pa.array(counts, pa.int64()))]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([*(pa.array([v], t) for v, t in zip(values, kinds)), *lists], names=["run", "grp", "n", "n_codes", "codes", "words", "counts"])

    for batch in batches:
        groups = batch.column(0)
        for a, b, texts in text_slices(batch.column(1)):
            for group, text in zip(groups.slice(a, b - a).to_pylist(), texts):
                if text:
                    held.setdefault(group, []).append(text.encode())
                    size[group] = size.get(group, 0) + len(text)
                    # Many groups share the room; the largest goes first.
                    if sum(size.values()) >= HELD:
                        yield row(max(size, key=size.get))
    for group in list(held):
        yield row(group)


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The order of rows of big-endian bytes, by 16 bits at a time from the last; digits that never vary are left out."""
    order = None
    for at in range(keys.shape[1] - 2, -1, -2):
        digit = keys[:, at].astype(np.uint16) << 8 | keys[:, at + 1]
        if len(digit) and (digit != digit[0]).any():
            order = np.argsort(digit, kind="stable") if order is None else order[np.argsort(digit[order], kind="stable")]
    return np.arange(len(keys)) if order is None else order


def counted(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, with the sum of their times."""
    order = radix_order(keys)
    keys, times = keys[order], times[order]
    if not len(keys):
        return keys, times
    starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
    return keys[starts], np.add.reduceat(times, starts)


def grams(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and times of all phrases of two and three words; id 0 breaks them."""
    two = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
    three = two[two + 2 < len(ids)]
    three = three[ids[three + 2] > 0]
    first, second = np.r_[two, three], np.r_[two, three] + 1
    third = np.r_[np.zeros(len(two), ids.dtype), ids[three + 2]]
    keys = np.stack([ids[first], ids[second], third], axis=1).astype(">u4").view(np.uint8).reshape(-1, KEY)
    return counted(keys, np.ones(len(keys), np.int64))


def _as_text(keys: np.ndarray) -> np.ndarray:
    """Keys as fixed-width strings of bytes, which compare in the order of the keys."""
    return np.ascontiguousarray(keys).view(f"V{KEY}").reshape(-1)


def _coded_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Counted keys of every row ``(codes, n_codes, at, id)``."""
    for batch in batches:
        for i in range(batch.num_rows):
            codes = np.frombuffer(pa.decompress(batch.column(0)[i].as_py(), 4 * batch.column(1)[i].as_py(), "zstd", asbytes=True), np.int32)
            at, number = (batch.column(c)[i].values.to_numpy().astype(np.int64) for c in (2, 3))
            ids = np.zeros(max(int(codes.max(initial=-1)), int(at.max(initial=-1))) + 2, np.int64)
            ids[at] = number
            yield grams(ids[codes])  # code -1 reads the last place, which holds 0


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for keys, _ in _coded_runs(batches):
        yield pa.RecordBatch.from_arrays([pa.array([k.tobytes() for k in keys[::STEP]], pa.binary())], names=["key"])


def _dealt(bounds: list[bytes]):
    """Cut the sorted keys of each run at the bounds, which are sorted too."""
    marks = np.frombuffer(b"".join(bounds), np.uint8).reshape(-1, KEY)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = [m.tobytes() for m in marks]
        for keys, times in _coded_runs(batches):
            text = _as_text(keys)
            cuts = [0, *(_first_not_below(text, e) for e in edges), len(keys)]
            parts = [(i, a, b) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
            columns = [pa.array([p[0] for p in parts], pa.int32()), pa.array([b - a for _, a, b in parts], pa.int64())]
            columns += [pa.array([_packed(x[a:b]) for _, a, b in parts], pa.binary()) for x in (keys, times.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["range", "n", "keys", "times"])

    return deal


def _first_not_below(text: np.ndarray, edge: bytes) -> int:
    low, high = 0, len(text)
    while low < high:
        mid = (low + high) // 2
        if text[mid].tobytes() < edge:
            low = mid + 1
        else:
            high = mid
    return low


def _totals(least: int):
    """Phrases that occur ``least`` times or more in a range; rows come ordered by range."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, waiting = None, [], 0

        def squeeze() -> None:
            nonlocal held, waiting
            held, waiting = [counted(np.concatenate([k for k, _ in held]), np.concatenate([t for _, t in held]))], 0

        def rows() -> pa.RecordBatch:
            squeeze()
            keys, times = held[0]
            keys, times = keys[times >= least], times[times >= least]
            ids = keys.reshape(-1).view(">u4").reshape(-1, 3).astype(np.int64)
            return pa.RecordBatch.from_arrays([*(pa.array(ids[:, c]) for c in range(3)), pa.array(times)], names=["w1", "w2", "w3", "a"])

        for batch in batches:
            for i in range(batch.num_rows):
                place, n, keys, times = (batch.column(c)[i].as_py() for c in range(4))
                if held and place != now:
                    yield rows()
                    held, waiting = [], 0
                now = place
                held.append((_unpacked(keys, n, KEY), np.ascontiguousarray(_unpacked(times, n, 8)).view(np.int64).reshape(-1)))
                waiting += n
                # Room grows with what is known to differ, so each key is sorted a bounded number of times.
                if waiting > max(AT_ONCE, len(held[0][0])):
                    squeeze()
        if held:
            yield rows()

    return total


def _numbered(words: DataFrame) -> DataFrame:
    """``words`` with dense ids from 1 on; ``words`` must be a written table."""
    place = F.spark_partition_id().alias("p")
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("r")
    placed = settle(words.select("*", place, within), "numbered")
    sizes = sorted((r["p"], r["n"]) for r in placed.groupBy("p").agg(F.count("*").alias("n")).collect())
    starts = np.cumsum([1, *(n for _, n in sizes)])
    offsets = placed.sparkSession.createDataFrame([(p, int(s)) for (p, _), s in zip(sizes, starts)], "p int, first bigint")
    out = settle(placed.join(F.broadcast(offsets), "p").select("grp", "word", "f", (F.col("first") + F.col("r")).alias("id")), "dictionary")
    discard(placed)
    return out


def _score(a: str, l: str, r: str) -> Column:
    """floor(1,000,000 a^2 / (l r)), exact up to counts of 10^15."""
    whole = lambda c: f"CAST({c} AS DECIMAL(16,0))"
    return F.expr(f"CAST(({whole(a)} * {whole(a)} * CAST(1000000 AS DECIMAL(7,0))) div ({whole(l)} * {whole(r)}) AS BIGINT)")


def phrase_counts(docs: DataFrame, group_col: str = "lang", text_col: str = "text", least: int = LEAST, missing: str = "und") -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(sizes, dictionary, grams)``, written tables that the caller discards.

    ``sizes (grp, n)`` counts all words of a group, ``dictionary (grp, word, f, id)`` holds the words that occur ``least``
    times or more, ``grams (w1, w2, w3, a)`` the phrases that do, w3 being 0 in those of two words.
    """
    group = F.coalesce(F.col(f"`{group_col}`").cast("string"), F.lit(missing))
    source = docs.where(F.length(f"`{text_col}`") > 0).select(group.alias("grp"), F.col(f"`{text_col}`").alias("text"))
    runs = settle(source.mapInArrow(_runs, "run string, grp string, n bigint, n_codes bigint, codes binary, words array<string>, counts array<bigint>"), "runs")
    sizes = settle(runs.groupBy("grp").agg(F.sum("n").alias("n")).where("n > 0"), "sizes")
    words = runs.select("grp", F.explode(F.arrays_zip("words", "counts")).alias("x")).groupBy("grp", F.col("x.words").alias("word")).agg(F.sum("x.counts").alias("f"))
    frequent = settle(words.where(F.col("f") >= least), "frequent")
    dictionary = _numbered(frequent)

    spark = docs.sparkSession
    number, volume = runs.agg(F.count("*"), F.sum("n_codes")).first()
    ranges = max(1, -(-2 * (volume or 0) // GROUPED))
    tasks = max(spark.sparkContext.defaultParallelism, -(-(number or 0) // 4))

    def coded(part: DataFrame, tasks: int) -> DataFrame:
        known = part.select("run", "grp", F.posexplode("words").alias("at", "word")).join(dictionary, ["grp", "word"]).groupBy("run").agg(F.collect_list(F.struct("at", "id")).alias("ids"))
        return part.select("run", "codes", "n_codes").repartition(tasks, "run").join(known.repartition(tasks, "run"), "run").select("codes", "n_codes", "ids.at", "ids.id")

    share = min(1.0, max(SAMPLED / max(number or 0, 1), 1 / SAMPLED))
    taken = coded(runs.where(F.pmod(F.xxhash64("run"), F.lit(1_000_000)) < int(share * 1_000_000)), min(tasks, SAMPLED)).mapInArrow(_sample, "key binary")
    sample = settle(taken, "sample")
    firsts = sample.repartitionByRange(ranges, "key").groupBy(F.spark_partition_id().alias("p")).agg(F.min("key").alias("key")).collect()
    bounds = sorted({bytes(r["key"]) for r in firsts})[1:]
    parts = coded(runs, tasks).mapInArrow(_dealt(bounds), "range int, n bigint, keys binary, times binary")
    grams = settle(parts.repartition(len(bounds) + 1, "range").sortWithinPartitions("range").mapInArrow(_totals(least), "w1 bigint, w2 bigint, w3 bigint, a bigint"), "grams")
    discard(runs, sample, frequent)
    return sizes, dictionary, grams


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, part: int = PART, group_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each group's ``top`` phrases by score, then a, descending, then phrase.

    a, l and r count a phrase and its two parts at the cut that scores least (the first of equals), n all words of the
    group, score is floor(1,000,000 a^2 / (l r)).  A phrase must occur ``least`` times; one of two words goes if ``part``
    of 100 of its places or more lie within one phrase of three.

    A null group counts as ``und``.  Null and empty texts hold no words.  Repeated rows count each time.  Other columns
    are not read.  A group without a phrase, and so an empty table, gives no rows.  Texts are read whole.
    """
    sizes, dictionary, grams = phrase_counts(docs, group_col, text_col, least)
    word = lambda i: dictionary.select(F.col("id").alias(f"w{i}"), F.col("word").alias(f"t{i}"), F.col("f").alias(f"f{i}"))
    two = grams.where("w3 = 0").drop("w3")
    three = grams.where("w3 > 0")
    three = three.join(two.select("w1", "w2", F.col("a").alias("f12")), ["w1", "w2"]).join(two.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("f23")), ["w2", "w3"])
    three = longer = settle(three, "three")
    within = three.select("w1", "w2", "a").unionAll(three.select("w2", "w3", "a")).groupBy("w1", "w2").agg(F.max("a").alias("most"))
    two = two.join(within, ["w1", "w2"], "left").where(F.coalesce(F.col("most") * 100 < F.col("a") * part, F.lit(True)))
    group = dictionary.select(F.col("id").alias("w1"), F.col("grp").alias("lang"))
    two = two.join(word(1), "w1").join(word(2), "w2").join(group, "w1")
    two = two.select("lang", F.concat_ws(" ", "t1", "t2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), _score("a", "f1", "f2").alias("score"))
    three = three.join(word(1), "w1").join(word(2), "w2").join(word(3), "w3").join(group, "w1")
    three = three.withColumn("s1", _score("a", "f1", "f23")).withColumn("s2", _score("a", "f12", "f3"))
    early = F.col("s1") <= F.col("s2")
    three = three.select(
        "lang",
        F.concat_ws(" ", "t1", "t2", "t3").alias("phrase"),
        "a",
        F.when(early, F.col("f1")).otherwise(F.col("f12")).alias("l"),
        F.when(early, F.col("f23")).otherwise(F.col("f3")).alias("r"),
        F.least("s1", "s2").alias("score"),
    )
    # The best of each slice of a group first, so that no task ranks a whole group.
    best = [F.desc("score"), F.desc("a"), "phrase"]
    ranked = two.unionByName(three).withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(SLICES)))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*best))).where(F.col("rank") <= top)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= top)
    out = settle(ranked.join(sizes, F.col("lang") == F.col("grp")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "phrases")
    discard(sizes, dictionary, grams, longer)
    return out
