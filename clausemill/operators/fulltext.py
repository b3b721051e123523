"""Full-text search over chunks: stems, phrases, exclusions, alternatives, and ranks by cover density.

The index holds, for every lexeme of a chunk's text or heading, the places where
it stands.  It is stored by hash of the lexeme, so a search reads only the folders
of the lexemes it asks for; new chunks are appended.  Stems are computed once per
distinct word and joined back.  A phrase holds where the places of its words,
each moved by its distance from the first, meet.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausemill.functions import text as T
from clausemill.functions.patterns import ENGLISH_STOP_WORDS
from clausemill.storage import discard, settle

BUCKETS = 64
LIMIT, WEAK, HEADING_BOOST, DEFINITION_BOOST, WEIGHT = 40, 3, 1.5, 1.2, 0.1
KEY = ("doc_id", "chunk", "field")

# --- stems (the published Porter2 rules)

_KEPT = frozenset("sky news howe atlas cosmos bias andes".split())
_SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_AFTER_PLURAL = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
_STEP4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()
_SHORT = re.compile("(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")
_REGION = re.compile("[aeiouy][^aeiouy]")


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def stem(word: str) -> str:
    """The English stem of a lower-case word; words of other letters mostly stay as they are."""
    if len(word) < 3 or word in _KEPT:
        return word
    if word in _SPECIAL:
        return _SPECIAL[word]
    w = re.sub("(?<=[aeiouy])y|^y", "Y", word)
    head = re.match("gener|commun|arsen", w)
    first = head.end() if head else m.end() if (m := _REGION.search(w)) else len(w)
    second = m.end() if (m := _REGION.search(w, first)) else len(w)
    within = lambda suffix, start: len(w) - len(suffix) >= start
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search("[aeiouy].", w[:-1]):
        w = w[:-1]
    if w in _AFTER_PLURAL:
        return w
    # -eed, -ed, -ing
    s = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if s in ("eed", "eedly"):
        w = w[: len(w) - len(s)] + "ee" if within(s, first) else w
    elif s and re.search("[aeiouy]", w[: -len(s)]):
        w = w[: -len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif re.search("(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
            w = w[:-1]
        elif first >= len(w) and _SHORT.search(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    s = _longest(w, _STEP2)
    if s and within(s, first) and not (s == "ogi" and w[-4] != "l") and not (s == "li" and w[-3] not in "cdeghkmnrt"):
        w = w[: len(w) - len(s)] + _STEP2[s]
    s = _longest(w, _STEP3)
    if s and within(s, first) and (s != "ative" or within(s, second)):
        w = w[: len(w) - len(s)] + _STEP3[s]
    s = _longest(w, _STEP4)
    if s and within(s, second) and (s != "ion" or w[-4] in "st"):
        w = w[: len(w) - len(s)]
    if w.endswith("e") and (within("e", second) or within("e", first) and not _SHORT.search(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and within("l", second):
        w = w[:-1]
    return w.replace("Y", "y")


def words_of(c: Column) -> Column:
    """Lower-cased words of letters and digits, in order."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _stemmed(rows: DataFrame) -> DataFrame:
    """``rows (word, ...)`` without stop words and with ``lexeme``; each distinct word is stemmed once."""
    rows = rows.where(~F.col("word").isin(list(ENGLISH_STOP_WORDS)))

    def stems(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield part.assign(lexeme=part["word"].map(stem))

    # As a function of the table, not of a column, it can't be moved below the grouping, where it would see every word.
    known = rows.select("word").distinct().mapInPandas(stems, "word string, lexeme string")
    return rows.join(known, "word").drop("word")


# --- the index


def postings(chunks: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """``(doc_id, chunk, field, lexeme, positions)`` of ``chunks (doc_id, chunk, heading, text)``; field is ``text`` or ``heading``.

    Positions count all words from 1, stop words too, and rise.  ``asked (doc_id, lexeme)`` leaves out what no search asks for;
    chunks of other documents go before they are cut into words.
    """
    if asked is not None:
        chunks = chunks.join(asked.select("doc_id").distinct(), "doc_id", "left_semi")
    fields = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in ("text", "heading")))).alias("x")
    rows = chunks.select("doc_id", "chunk", fields).select("doc_id", "chunk", "x.field", F.posexplode(words_of(F.col("x.text"))).alias("pos", "word"))
    rows = _stemmed(rows.withColumn("pos", F.col("pos") + 1))
    if asked is not None:
        rows = rows.join(asked.select("doc_id", "lexeme").distinct(), ["doc_id", "lexeme"], "left_semi")
    return rows.groupBy(*KEY, "lexeme").agg(F.array_sort(F.collect_list("pos")).alias("positions"))


def chunks_asked(chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """``chunks`` of the documents that ``questions`` ask about; no other can be in a result."""
    return chunks.join(questions.select("doc_id").distinct(), "doc_id", "left_semi")


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("lexeme"), F.lit(buckets)).cast("int").alias("bucket")


def store_index(chunks: DataFrame, path: str, buckets: int = BUCKETS, mode: str = "append") -> None:
    """Add the postings of ``chunks`` to the index at ``path``; chunks must not be in it yet."""
    rows = postings(chunks).withColumn("bucket", _bucket(buckets))
    rows.repartition("bucket").sortWithinPartitions("bucket", "lexeme").write.mode(mode).partitionBy("bucket").parquet(path)


def open_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _posted(asked: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """``asked (doc_id, lexeme, ...)`` joined with the postings; a stored index is read in the folders of the asked lexemes only."""
    if "bucket" in index.columns:
        return asked.withColumn("bucket", _bucket(buckets)).join(index, ["bucket", "lexeme", "doc_id"]).drop("bucket")
    return asked.join(index, ["doc_id", "lexeme"])


# --- searches


def units(questions: DataFrame) -> DataFrame:
    """``(query_id, doc_id, grp, unit, negated, n_words, off, lexeme)`` of web-style ``questions (query_id, doc_id, question)``.

    A unit is a word or a quoted phrase; ``-`` before it excludes it; ``or`` between units parts groups, one of which has
    to hold.  Stop words count in the distances within a phrase and are left out; so is a unit of nothing else.
    """
    tokens = F.regexp_extract_all("question", F.lit(r'-?"[^"]*"?|[^\s"]+'), F.lit(0))
    rows = questions.select("query_id", "doc_id", tokens.alias("tokens"))
    is_or = lambda t: F.lower(t) == "or"
    place = F.transform("tokens", lambda t, i: F.struct(i.alias("unit"), F.size(F.filter(F.slice("tokens", F.lit(1), i), is_or)).alias("grp"), t.alias("token")))
    rows = rows.select("query_id", "doc_id", F.explode(F.filter(place, lambda x: ~is_or(x["token"]))).alias("x"))
    rows = rows.select("query_id", "doc_id", "x.grp", "x.unit", F.col("x.token").startswith("-").alias("negated"), F.posexplode(words_of(F.col("x.token"))).alias("off", "word"))
    own = Window.partitionBy("query_id", "doc_id", "grp", "unit")
    return _stemmed(rows).withColumn("n_words", F.count("*").over(own)).withColumn("off", F.col("off") - F.min("off").over(own))


def any_units(questions: DataFrame) -> DataFrame:
    """The same columns for searches of any of a question's terms, every term a group of its own."""
    terms = questions.select("query_id", "doc_id", F.posexplode(T.search_terms(F.col("question"))).alias("grp", "word"))
    return _stemmed(terms).select("query_id", "doc_id", "grp", F.col("grp").alias("unit"), F.lit(False).alias("negated"), F.lit(1).cast("bigint").alias("n_words"), F.lit(0).alias("off"), "lexeme")


def _cover(entries: str, groups: str) -> Column:
    """WEIGHT / (1 + words between) summed over the smallest stretches that satisfy a group.

    ``groups`` is an array of groups, a group an array of units, a unit an array of ``(s, e)``.  Going through the places
    in order, a stretch ends where the latest start from which some group holds moves on.
    """
    start_of = lambda q: lambda unit: F.coalesce(F.array_max(F.transform(F.filter(unit, lambda x: x["e"] <= q), lambda x: x["s"])), F.lit(0))
    latest = lambda q: F.array_max(F.transform(groups, lambda g: F.array_min(F.transform(g, start_of(q)))))
    zero = F.struct(F.lit(0).alias("p"), F.lit(0.0).alias("score"))

    def step(acc: Column, x: Column) -> Column:
        noise = x["q"] - x["p"] - F.size(F.filter(entries, lambda y: (y >= x["p"]) & (y <= x["q"]))) + 1
        return F.when(x["p"] > acc["p"], F.struct(x["p"].alias("p"), (acc["score"] + WEIGHT / (1 + noise)).alias("score"))).otherwise(acc)

    ends = F.transform(entries, lambda q: F.struct(q.alias("q"), F.coalesce(latest(q), F.lit(0)).alias("p")))
    return F.aggregate(ends, zero, step, lambda acc: acc["score"])


def matches(asked: DataFrame, index: DataFrame, chunks: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``(query_id, doc_id, chunk, field, score, n_hits)``: where a question's groups hold; ``asked`` comes from :func:`units`.

    n_hits counts the different lexemes of the question that stand there.  A group of exclusions alone holds wherever
    none of them stands, with a score of 0.
    """
    key = ["query_id", *KEY]
    hits = _posted(asked, index, buckets)
    moved = F.transform("positions", lambda p: p - F.col("off"))
    found = hits.groupBy(*key, "grp", "unit", "negated", "n_words").agg(F.count("*").alias("n"), F.collect_list(moved).alias("starts"), F.max("off").alias("width"), F.collect_set("lexeme").alias("lexemes"), F.flatten(F.collect_list("positions")).alias("places"))
    meeting = F.aggregate("starts", F.col("starts")[0], lambda a, b: F.array_intersect(a, b))
    found = found.withColumn("starts", F.when(F.col("n") == F.col("n_words"), meeting).otherwise(F.array().cast("array<int>")))
    there = F.size("starts") > 0
    spans = F.transform("starts", lambda s: F.struct(s.alias("s"), (s + F.col("width")).alias("e")))
    per_group = found.groupBy(*key, "grp").agg(
        F.count_if(there & ~F.col("negated")).alias("held"),
        F.count_if(there & F.col("negated")).alias("barred"),
        F.collect_list(F.when(there & ~F.col("negated"), spans)).alias("units"),
        F.flatten(F.collect_list("places")).alias("places"),
        F.flatten(F.collect_list("lexemes")).alias("lexemes"),
    )
    wanted = asked.groupBy("query_id", "doc_id", "grp").agg(F.count_distinct(F.when(~F.col("negated"), F.col("unit"))).alias("wanted"))
    per_group = settle(per_group.join(wanted, ["query_id", "doc_id", "grp"]), "groups")
    holds = (F.col("barred") == 0) & (F.col("held") == F.col("wanted"))
    rows = per_group.groupBy(*key).agg(
        F.max(holds).alias("holds"),
        F.collect_list(F.when(holds & (F.col("wanted") > 0), F.col("units"))).alias("groups"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("entries"),
        F.size(F.array_distinct(F.flatten(F.collect_list("lexemes")))).cast("bigint").alias("n_hits"),
    )
    rows = settle(rows.where("holds").select(*key, _cover("entries", "groups").alias("score"), "n_hits"), "held")
    # Groups of exclusions alone also hold where nothing of them stands.
    only = wanted.where("wanted = 0").select("query_id", "doc_id", "grp")
    both = F.explode(F.array(F.lit("text"), F.lit("heading"))).alias("field")
    open_ = only.join(chunks.select("doc_id", "chunk", both), "doc_id").join(per_group.where("barred > 0").select(*key, "grp"), [*key, "grp"], "left_anti").select(*key).distinct()
    rest = open_.join(rows.select(*key), key, "left_anti").select(*key, F.lit(0.0).alias("score"), F.lit(0).cast("bigint").alias("n_hits"))
    out = settle(rows.unionByName(rest), "matches")
    discard(per_group, rows)
    return out


def _ranked(asked: DataFrame, index: DataFrame, chunks: DataFrame, limit: int, buckets: int) -> DataFrame:
    """The best ``limit`` chunks of every question, with their place in the list."""
    held = matches(asked, index, chunks, buckets)
    heads = held.where("field = 'heading'").select("query_id", "doc_id", "chunk", F.lit(HEADING_BOOST).alias("boost"))
    rows = held.where("field = 'text'").join(heads, ["query_id", "doc_id", "chunk"], "left").join(chunks.select("doc_id", "chunk", "heading"), ["doc_id", "chunk"])
    defines = F.when(F.contains(F.lower(F.coalesce("heading", F.lit(""))), F.lit("definition")), DEFINITION_BOOST).otherwise(1.0)
    rows = rows.withColumn("score", F.col("score") * F.coalesce("boost", F.lit(1.0)) * defines)
    place = F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy(F.round("score", 9).desc(), "chunk"))
    return rows.withColumn("place", place).where(F.col("place") <= limit).select("query_id", "doc_id", "chunk", "score", "n_hits", "place")


def search(chunks: DataFrame, questions: DataFrame, limit: int = LIMIT, index: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    """``(query_id, doc_id, chunk, score, n_hits, mode, rank)``: the best ``limit`` chunks of a question's document.

    First all of a question has to hold (mode ``strict``); with under WEAK such chunks, those with any of its terms are
    added (mode ``any``), and a chunk in both lists keeps its strict score.  Scores are cover densities, times
    HEADING_BOOST if the question holds in the heading and DEFINITION_BOOST if that names definitions.  Ties go by the
    chunk's place in its own list.  Null or empty questions and texts find nothing; a question of stop words alone neither.

    ``questions (query_id, doc_id, question)``, one row per query_id and doc_id; ``chunks (doc_id, chunk, heading, text)``
    without boilerplate.  ``index`` is what :func:`open_index` gives, otherwise postings are made for what is asked.
    """
    questions = settle(questions.select("query_id", "doc_id", "question"), "questions")
    chunks = settle(chunks_asked(chunks.select("doc_id", "chunk", "heading", "text"), questions), "chunks")
    strict_units, loose_units = settle(units(questions), "units"), settle(any_units(questions), "units")
    own = index is None
    if own:
        index = settle(postings(chunks, strict_units.select("doc_id", "lexeme").unionByName(loose_units.select("doc_id", "lexeme"))), "postings")
    strict = settle(_ranked(strict_units, index, chunks, limit, buckets), "strict")
    enough = strict.groupBy("query_id", "doc_id").agg(F.count("*").alias("n")).where(F.col("n") >= WEAK)
    loose = settle(_ranked(loose_units.join(enough, ["query_id", "doc_id"], "left_anti"), index, chunks, limit, buckets), "loose")
    key = ["query_id", "doc_id", "chunk"]
    both = strict.select(*key, F.struct("score", "n_hits", "place").alias("s")).join(loose.select(*key, F.struct("score", "n_hits", "place").alias("o")), key, "full")
    rows = both.select(*key, F.coalesce("s.score", "o.score").alias("score"), F.coalesce("s.n_hits", "o.n_hits").alias("n_hits"), F.when(F.col("s").isNotNull(), "strict").otherwise("any").alias("mode"), F.coalesce(F.col("o.place"), limit + F.col("s.place")).alias("place"))
    rank = F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy(F.round("score", 9).desc(), "place"))
    out = settle(rows.withColumn("rank", rank).where(F.col("rank") <= limit).drop("place"), "found")
    discard(chunks, questions, strict_units, loose_units, strict, loose, *([index] if own else []))
    return out
