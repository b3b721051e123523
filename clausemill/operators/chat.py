"""Conversations: history, titles, citations, quote payloads and streamed answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausemill.functions import text as T

DELIMITER = "---QUOTES---"


def previous_question(turns: DataFrame) -> DataFrame:
    """``turns (conv_id, turn, role, text)`` with the last earlier user text as ``previous``."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn("previous", F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(before))


def history_text(turns: DataFrame, limit: int = 6) -> DataFrame:
    """``(conv_id, history)``: the last turns, labelled, without citation marks, user texts cut at 400 and others at 600 characters."""
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    rows = turns.where(F.col("role").isin("user", "assistant") & (T.trim(F.col("text")) != "")).withColumn("rank", rank).where(F.col("rank") <= limit)
    plain = T.strip_citations(F.col("text"))
    line = F.when(F.col("role") == "user", F.concat(F.lit("User: "), T.cut_at_word(plain, 400, 0.7, "…"))).otherwise(F.concat(F.lit("Assistant: "), T.cut_at_word(plain, 600, 0.7, "…")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("x")))), lambda t: t["x"])
    return rows.groupBy("conv_id").agg(F.array_join(lines, "\n").alias("history"))


def titles(turns: DataFrame) -> DataFrame:
    """``(conv_id, title)``: first 60 characters of the first user text."""
    return turns.where("role = 'user'").groupBy("conv_id").agg(F.substring(F.min_by("text", "turn"), 1, 60).alias("title"))


QUOTE = "array<struct<n:string,doc:string,text:string>>"


def parse_quotes(raw: Column) -> Column:
    """The quotes of a model's payload, or null if none can be read: bare array, fenced, ``{"quotes": …}``, inside prose, trailing commas.

    Entries without a positive number or text are dropped one by one.
    """
    text = T.trim(raw)
    between = lambda a, z: F.regexp_extract(text, rf"(?s)(\{a}.*\{z})", 1)
    candidates = [text, F.trim(F.regexp_extract(text, r"(?is)```(?:json)?\s*(.*?)```", 1)), between("[", "]"), between("{", "}")]
    candidates += [F.regexp_replace(c, r",\s*([\]}])", "$1") for c in candidates]
    read = [F.when(c.startswith("["), F.from_json(c, QUOTE)) for c in candidates] + [F.when(c.startswith("{"), F.from_json(c, f"quotes {QUOTE}")["quotes"]) for c in candidates]
    order = [r for pair in zip(read[: len(candidates)], read[len(candidates) :]) for r in pair]
    number = lambda x: x["n"].try_cast("int")
    kept = F.filter(F.coalesce(*order), lambda x: x.isNotNull() & (number(x) > 0) & (F.coalesce(x["text"], F.lit("")) != ""))
    return F.when(text == "", F.array().cast("array<struct<n:int,doc:string,text:string>>")).otherwise(F.transform(kept, lambda x: F.struct(number(x).alias("n"), x["doc"].alias("doc"), x["text"].alias("text"))))


def split_answer(chunks: DataFrame) -> DataFrame:
    """``(message_id, answer, quotes_text, saw_delimiter)`` of streamed ``chunks (message_id, seq, chunk)``: prose before the delimiter, payload after it."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "chunk"))), lambda c: c["chunk"]), "")
    rows = chunks.groupBy("message_id").agg(whole.alias("w"))
    at = F.instr("w", DELIMITER)
    prose = F.when(at > 0, F.substr("w", F.lit(1), at - 1)).otherwise(F.col("w"))
    return rows.select("message_id", F.regexp_replace(prose, r"\s+$", "").alias("answer"), F.when(at > 0, F.substr("w", at + len(DELIMITER))).otherwise("").alias("quotes_text"), (at > 0).alias("saw_delimiter"))


def citation_links(answers: DataFrame, quotes: DataFrame) -> DataFrame:
    """``(message_id, citation, quote_id)``: each distinct marker with the last quote of its number, or null."""
    marks = answers.select("message_id", F.explode(T.citation_markers(F.col("answer"))).alias("citation"))
    last = quotes.groupBy("message_id", "citation").agg(F.max_by("quote_id", "seq").alias("quote_id"))
    return marks.join(last, ["message_id", "citation"], "left")


def attribute(quotes: DataFrame, aliases: DataFrame) -> DataFrame:
    """``quotes (chat_id, alias, …)`` with the document of their alias (upper case, trimmed); an unknown alias stays without one and is UNVERIFIED."""
    known = aliases.select("chat_id", F.col("alias").alias("known"), "doc_id")
    out = quotes.withColumn("known", F.upper(T.trim(F.col("alias")))).join(known, ["chat_id", "known"], "left").drop("known")
    return out.withColumn("status", F.when(F.col("doc_id").isNull(), "UNVERIFIED").otherwise("PENDING"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def render_excerpts(rows: DataFrame, key: str) -> DataFrame:
    """``(key, prompt)`` of ``rows (key, n, ref, heading, text)``: labelled excerpts in order."""
    name = F.concat_ws(" ", F.when(F.col("ref") != "", F.col("ref")), F.when(F.col("heading") != "", F.col("heading")))
    label = F.when(name != "", name).otherwise(F.concat(F.lit("Excerpt "), F.row_number().over(Window.partitionBy(key).orderBy("n")).cast("string")))
    piece = F.concat(F.lit("### "), label, F.lit("\n"), F.col("text"))
    return rows.withColumn("x", piece).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "x"))), lambda c: c["x"]), "\n\n").alias("prompt"))


LONGEST_QUESTION, MOST_DOCUMENTS = 2000, 5


def question_error(question: Column, n_documents: Column) -> Column:
    """Why a question can't be asked, else null: blank, over 2,000 characters, about no document or about too many."""
    asked = T.trim(F.coalesce(question, F.lit("")))
    return (
        F.when(asked == "", "EMPTY")
        .when(F.length(asked) > LONGEST_QUESTION, "TOO_LONG")
        .when(n_documents == 0, "NO_DOCUMENT")
        .when(n_documents > MOST_DOCUMENTS, "TOO_MANY_DOCUMENTS")
    )
