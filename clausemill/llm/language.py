"""Language identification: word-first backoff.

A word that the model knows scores by its log frequency in each language.  An
unseen word falls back to its longest character n-grams that the model knows,
then to shorter ones.  Training counts words and n-grams with Spark on a bounded
sample of labelled rows and keeps the most frequent ones per language, so the
model's size does not depend on the corpus.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausemill.llm.rows import per_text, text_slices

#: Bounds of the model: labelled rows in the sample (expected), words and n-grams (of each length) per language.
ROWS, WORDS, GRAMS = 4_000, 20_000, 10_000
LONGEST = 5
#: Vectors of unseen words that a task remembers.
REMEMBERED = 100_000
#: Share of the log-likelihood that enters the score; words of a text are far from independent.
EVIDENCE = 0.3
UNDETERMINED = "und"


def _ranges(characters: Iterable[str]) -> str:
    """Characters in rising order as the inside of a character class."""
    out: list[list[str]] = []
    for c in characters:
        if out and ord(c) == ord(out[-1][1]) + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(a if a == b else f"{a}-{b}" for a, b in out)


# Word characters but for the underline and all kinds of digits and numerals: ``str.isalpha``.
_NUMERALS = _ranges(c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
_WORD = re.compile(rf"[^\W\d_{_NUMERALS}]+")


def held_out(id_col: str) -> Column:
    """Whether a row is kept from training: CRC-32 of the id as text, modulo 4, is 2.  False without an id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _packed(table: dict[str, np.ndarray], width: int) -> tuple[dict[str, int], np.ndarray]:
    """Keys with their rows in one matrix, which takes far less memory than an array per key."""
    rows = np.stack(list(table.values())).astype(np.float32) if table else np.zeros((0, width), np.float32)
    return {k: i for i, k in enumerate(table)}, rows


class Model:
    """Per-language log frequencies of words and character n-grams."""

    def __init__(self, languages: list[str], words: dict[str, np.ndarray], grams: list[dict[str, np.ndarray]]):
        self.languages = languages
        self.words = _packed(words, len(languages))
        self.grams = [_packed(g, len(languages)) for g in grams]
        self._fresh()

    def _fresh(self) -> None:
        self.row = dict(self.words[0])
        self.used = len(self.row)
        self.table = np.zeros((self.used + REMEMBERED, max(1, len(self.languages))), np.float32)
        self.table[: self.used, : len(self.languages)] = self.words[1]

    def __getstate__(self):
        return self.languages, self.words, self.grams

    def __setstate__(self, state):
        self.languages, self.words, self.grams = state
        self._fresh()

    def back_off(self, word: str) -> np.ndarray:
        """The mean log frequencies of the longest known n-grams of a word; zeros if none is known."""
        padded = f" {word} "
        for n in range(min(LONGEST, len(padded)), 0, -1):
            known, rows = self.grams[n - 1]
            found = [r for i in range(len(padded) - n + 1) if (r := known.get(padded[i : i + n])) is not None]
            if found:
                return rows[found].mean(axis=0)
        return np.zeros(len(self.languages), np.float32)

    def knows(self, text: str) -> bool:
        """Whether any word of a text, or any n-gram of one, is known."""
        for word in set(_WORD.findall(text.lower())):
            if word in self.words[0] or any(c in self.grams[0][0] for c in word):  # a longer known n-gram has known letters, unless the bound cut them
                return True
            if any(f" {word} "[i : i + n] in self.grams[n - 1][0] for n in range(2, LONGEST + 1) for i in range(len(word) + 3 - n)):
                return True
        return False

    def score(self, text: str) -> tuple[str, float]:
        """Most likely language and its share of the evidence; undetermined without a letter."""
        words = _WORD.findall(text.lower())
        if not words or not self.languages:
            return UNDETERMINED, 0.0
        if new := set(words).difference(self.row):
            if self.used + len(new) > len(self.table):
                self._fresh()
                new = set(words).difference(self.row)
            if self.used + len(new) > len(self.table):  # one text with more new words than the table holds
                self.table = np.concatenate([self.table, np.zeros((len(new), self.table.shape[1]), np.float32)])
            for w in new:
                self.table[self.used] = self.back_off(w)
                self.row[w] = self.used
                self.used += 1
        rows = np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))
        total = EVIDENCE * self.table[rows].sum(axis=0, dtype=np.float64)
        share = np.exp(total - total.max())
        best = int(total.argmax())
        return self.languages[best], float(share[best] / share.sum())


def _log_frequencies(counts: Iterable[tuple[str, str, int]], languages: list[str], totals: dict[str, int]) -> dict[str, np.ndarray]:
    place = {x: i for i, x in enumerate(languages)}
    table: dict[str, np.ndarray] = {}
    for lang, key, n in counts:
        table.setdefault(key, np.full(len(languages), 0.5))[place[lang]] += n
    total = np.array([totals.get(x, 0) for x in languages]) + 0.5 * max(1, len(table))
    return {k: np.log(v / total).astype(np.float32) for k, v in table.items()}


def train(docs: DataFrame, rows: int = ROWS, words: int = WORDS, grams: int = GRAMS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on about ``rows`` labelled rows that are not held out: an equal number of each language, or all of a rarer one.

    A hash of the id draws them.  The driver gets the number of labels per language, and about ``words`` words and
    ``LONGEST * grams`` n-grams of each; of the equally frequent ones around that limit a hash draws as many as fit on average.
    Rows without id, text or label are not used; without any usable row the model knows no language.
    """
    usable = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    usable = usable.where(F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("id"))
    labels = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not labels:
        return Model([], {}, [{} for _ in range(LONGEST)])
    most_of = F.create_map(*[F.lit(x) for lang, n in labels.items() for x in (lang, min(1.0, rows / len(labels) / n) * 1_000_003)])
    drawn = usable.where(F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1_000_003)) < most_of[F.col("lang")])
    seen = drawn.select("lang", F.explode(F.regexp_extract_all(F.lower(F.col("text")), F.lit(r"\p{L}+"), F.lit(0))).alias("key"))
    counted = seen.groupBy("lang", "key").agg(F.count("*").alias("n")).cache()

    def most(df: DataFrame, by: list[str], limit: int) -> tuple[list[tuple], dict]:
        totals = {tuple(r[:-1]): r[-1] for r in df.groupBy("lang", *by).agg(F.sum("n")).collect()}
        levels = df.groupBy("lang", *by, "n").agg(F.count("*").alias("entries"))  # few: as many as there are different counts
        upto = F.sum("entries").over(Window.partitionBy("lang", *by).orderBy(F.desc("n")))
        over = levels.withColumn("upto", upto).where(F.col("upto") > limit)
        last = over.groupBy("lang", *by).agg(F.max_by(F.struct("n", ((limit - F.col("upto") + F.col("entries")) / F.col("entries")).alias("share")), "n").alias("last"))
        drawn_tie = (F.col("n") == F.col("last.n")) & (F.pmod(F.xxhash64("key"), F.lit(1_000_003)) < F.col("last.share") * 1_000_003)
        top = df.join(F.broadcast(last), ["lang", *by], "left").where(F.col("last").isNull() | (F.col("n") > F.col("last.n")) | drawn_tie).select("lang", "key", "n", *by).toArrow()
        return list(zip(*(c.to_pylist() for c in top.columns))), totals

    top, totals = most(counted.where("length(key) <= 64"), [], words)
    languages = sorted({lang for (lang,) in totals})
    known = _log_frequencies(top, languages, {k[0]: v for k, v in totals.items()})
    padded = counted.where("length(key) <= 64").select("lang", F.concat(F.lit(" "), "key", F.lit(" ")).alias("w"), "n")
    cut = padded.select("lang", "w", "n", F.explode(F.sequence(F.lit(1), F.lit(LONGEST))).alias("size")).where("length(w) >= size")
    cut = cut.select("lang", "size", "n", F.explode(F.expr("transform(sequence(1, length(w) - size + 1), i -> substr(w, i, size))")).alias("key"))
    top, totals = most(cut.groupBy("lang", "size", "key").agg(F.sum("n").alias("n")).where("key <> ' '"), ["size"], grams)
    by_size = [_log_frequencies((r[:3] for r in top if r[3] == s), languages, {k[0]: v for k, v in totals.items() if k[1] == s}) for s in range(1, LONGEST + 1)]
    counted.unpersist()
    return Model(languages, known, by_size)


def identify(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", **training) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` per row of ``docs``; ``model`` defaults to one trained on ``docs`` itself.

    Text that is null or has no letter is ``und`` with score 0.  Ids may be null or repeat.  An empty table gives no rows.
    """
    model = model or train(docs, id_col=id_col, text_col=text_col, **training)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by the model's parameters

    def of(texts: list[str]) -> dict:
        found = [shared.value.score(t) for t in texts]
        return {"lang_pred": [f[0] for f in found], "score": [f[1] for f in found]}

    out = per_text(docs, of, "lang_pred string,score double", id_col, text_col)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **training) -> DataFrame:
    """The rows of ``docs`` whose language can be told, with a score of at least ``least``; all columns stay, whatever their names.

    Texts without a letter go, null and empty ones among them.  So do unlabelled ones of which the model knows no word
    and no n-gram; a short text scores low, but that is no reason to lose it.  If no row can teach, nothing is known
    about any language, and only texts without a letter go.  A missing language label is filled with the prediction, if
    there is a model.  Repeated rows and ids are judged alike and all stay; an empty table gives no rows.
    """
    model = train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, **training)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by the model's parameters

    text_at, lang_at = docs.columns.index(text_col), docs.columns.index(lang_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_slices(batch.column(text_at)):
                part = batch.slice(a, b - a)
                labels, model = part.column(lang_at), shared.value
                if model.languages:
                    found = [model.score(t) for t in texts]
                    told = [f[0] != UNDETERMINED and f[1] >= least and (has or model.knows(t)) for f, has, t in zip(found, labels.is_valid().to_pylist(), texts)]
                    labels = pc.coalesce(labels, pa.array([f[0] for f in found], labels.type))
                else:
                    told = [bool(_WORD.search(t)) for t in texts]
                yield part.set_column(lang_at, part.schema.field(lang_at), labels).filter(pa.array(told, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
