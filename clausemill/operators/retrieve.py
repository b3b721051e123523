"""Token budgets over retrieved chunks, whole-document scans, and honest coverage."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausemill.functions import text as T
from clausemill.operators import verify
from clausemill.operators.structure import page_ranges
from clausemill.storage import spread

RESERVE, FEWEST = 1600, 500


def budget(rows: DataFrame, most: Column, *texts: str) -> DataFrame:
    """``rows`` with ``excerpt_tokens`` and ``exhausted``: what is left of the input limit after fixed texts and the reserve."""
    left = most - sum((T.tokens(F.col(t)) for t in texts), F.lit(0)) - RESERVE
    return rows.withColumn("excerpt_tokens", F.greatest(left, F.lit(0))).withColumn("exhausted", left < FEWEST)


def select_budget(chunks: DataFrame, key: str, limit: int) -> DataFrame:
    """``(key, chunk, selected)``: best score first, a chunk that does not fit is skipped and the next one tried."""
    row = F.struct((-F.coalesce("score", F.lit(0.0))).alias("s"), "chunk", "tokens")
    rows = chunks.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("cs"))
    zero = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<int>").alias("ids"))
    fits = lambda acc, x: acc["used"] + x["tokens"] <= limit
    fold = F.aggregate("cs", zero, lambda acc, x: F.struct((acc["used"] + F.when(fits(acc, x), x["tokens"]).otherwise(0)).cast("bigint").alias("used"), F.when(fits(acc, x), F.concat(acc["ids"], F.array(x["chunk"].cast("int")))).otherwise(acc["ids"]).alias("ids")))
    rows = rows.select(key, "cs", fold.alias("f"))
    return rows.select(key, F.explode("cs").alias("c"), "f").select(key, "c.chunk", F.array_contains("f.ids", F.col("c.chunk").cast("int")).alias("selected"))


def batch_chunks(chunks: DataFrame, key: str, limit: int) -> DataFrame:
    """``(key, chunk, batch)``: consecutive chunks up to ``limit`` tokens a batch; a larger one is a batch of its own."""
    rows = chunks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("chunk", "tokens"))).alias("cs"))
    zero = F.struct(F.lit(0).cast("bigint").alias("used"), F.lit(0).alias("batch"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        new = (acc["used"] + x["tokens"] > limit) & (F.size(acc["out"]) > 0) & (acc["used"] > 0)
        batch = acc["batch"] + F.when(new, 1).otherwise(0)
        return F.struct((F.when(new, F.lit(0)).otherwise(acc["used"]) + x["tokens"]).cast("bigint").alias("used"), batch.alias("batch"), F.concat(acc["out"], F.array(batch)).alias("out"))

    rows = rows.select(key, "cs", F.aggregate("cs", zero, step, lambda acc: acc["out"]).alias("bs"))
    return rows.select(key, F.explode(F.arrays_zip("cs", "bs")).alias("x")).select(key, F.col("x.cs.chunk").alias("chunk"), F.col("x.bs").alias("batch"))


def top_up(found: DataFrame, chunks: DataFrame, least: int = 2) -> DataFrame:
    """``found (doc_id, chunk)`` plus the first other chunks of documents that have under ``least``."""
    have = chunks.select("doc_id").distinct().join(found.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "left").withColumn("n", F.coalesce("n", F.lit(0))).where(F.col("n") < least)
    rest = chunks.select("doc_id", "chunk").join(found, ["doc_id", "chunk"], "left_anti").join(have, "doc_id")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk"))
    more = rest.withColumn("rank", rank).where(F.col("rank") <= least - F.col("n"))
    return found.select("doc_id", "chunk").unionByName(more.select("doc_id", "chunk"))


def coverage(read: DataFrame, total: DataFrame, pages: DataFrame) -> DataFrame:
    """One honest row per document: sections read and in all, pages that the read ones touch, scanned pages, and whether that is everything.

    ``read (doc_id, start, end)``, ``total (doc_id, n)``, ``pages (doc_id, page, r_start, r_end, is_scanned)``.
    """
    on = (read["doc_id"] == pages["doc_id"]) & (read["start"] < pages["r_end"]) & (pages["r_start"] < read["end"])
    touched = page_ranges(read.join(pages, on).select(read["doc_id"], "page"), "pages_covered")
    seen = read.groupBy("doc_id").agg(F.count("*").alias("n_read"))
    skipped = pages.where("is_scanned").groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("page")).cast("array<string>"), ", ").alias("skipped_pages"))
    rows = total.join(seen, "doc_id", "left").join(touched, "doc_id", "left").join(skipped, "doc_id", "left")
    n_read = F.coalesce("n_read", F.lit(0))
    every = (F.col("n") > 0) & (n_read >= F.col("n"))
    return rows.select("doc_id", n_read.alias("chunks_read"), F.col("n").alias("chunks_total"), F.coalesce("pages_covered", F.lit("")).alias("pages_covered"), F.coalesce("skipped_pages", F.lit("")).alias("skipped_pages"), (every & F.col("skipped_pages").isNull()).alias("complete"))


def coverage_line() -> Column:
    """The sentence about a coverage row with ``chunks_read, chunks_total, pages_covered, sections, n_sections, skipped_pages, complete, stopped``."""
    of = F.concat(F.col("chunks_read").cast("string"), F.lit(" of "), F.col("chunks_total").cast("string"), F.lit(" sections"))
    every = (F.col("chunks_total") > 0) & (F.col("chunks_read") >= F.col("chunks_total"))
    return (
        F.when(F.col("stopped"), F.concat(F.lit("Read "), of, F.lit(" — stopped early because the AI service was busy.")))
        .when(every & (F.col("skipped_pages") != ""), F.concat(F.lit("Read the whole document except pages "), F.col("skipped_pages"), F.lit(" (no readable text)")))
        .when(F.col("complete"), F.lit("Read the whole document"))
        .when(F.col("pages_covered") != "", F.concat(F.lit("Searched "), of, F.lit(" (pages "), F.col("pages_covered"), F.lit(")")))
        .when(F.col("n_sections").between(1, 6), F.concat(F.lit("Searched "), of, F.lit(" (clauses "), F.col("sections"), F.lit(")")))
        .otherwise(F.concat(F.lit("Searched "), of))
    )


FAILURES, KEPT = 3, 5


def thorough_scan(chunks: DataFrame, questions: DataFrame, limit: int, map_fn=None) -> DataFrame:
    """Whole-document scan: ``(query_id, doc_id, batch, n_chunks, start, end, outcome, relevant, findings, quotes)`` per batch of chunks.

    ``map_fn(question, texts) -> (relevant, findings, quotes)`` stands for the model; by default it keeps sentences that
    hold a term of the question.  A document's batches are read in order.  One that raises is FAILED and the scan goes
    on; after FAILURES failures in a row the rest are not asked and come back NOT_READ.  Others are READ, also if they had
    nothing to say.  The first KEPT quotes that are not blank count.  ``questions (query_id, doc_id, question)``,
    ``chunks (doc_id, chunk, tokens, text)``; ``start`` and ``end`` are the first and last chunk of a batch.
    """
    map_fn = map_fn or keyword_findings
    chunks = chunks.join(questions.select("doc_id").distinct(), "doc_id", "left_semi")  # a document that no question asks about is not read
    batches = batch_chunks(chunks, "doc_id", limit).join(chunks.select("doc_id", "chunk", "text"), ["doc_id", "chunk"])
    ordered = F.array_sort(F.collect_list(F.struct("chunk", "text")))
    texts = batches.groupBy("doc_id", "batch").agg(ordered.alias("cs")).select("doc_id", "batch", F.col("cs.text").alias("texts"), F.col("cs.chunk").alias("ids"))
    scans = texts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("batch", "texts", "ids"))).alias("batches"))

    @F.pandas_udf("array<struct<batch:int,n_chunks:int,start:bigint,end:bigint,outcome:string,relevant:boolean,findings:string,quotes:array<string>>>")
    def read(questions: pd.Series, scans: pd.Series) -> pd.Series:
        out = []
        for question, batches in zip(questions, scans):
            rows, failed = [], 0
            for b in batches:
                outcome, relevant, findings, quotes = "NOT_READ", False, "", []
                if failed < FAILURES:
                    try:
                        relevant, findings, quotes = map_fn(question, list(b["texts"]))
                        outcome, failed = "READ", 0
                    except Exception:  # noqa: BLE001 - whatever the model's client raises, the batch was not read
                        outcome, failed = "FAILED", failed + 1
                quotes = [q for q in quotes if q and q.strip()][:KEPT]
                rows.append({"batch": b["batch"], "n_chunks": len(b["texts"]), "start": b["ids"][0], "end": b["ids"][-1], "outcome": outcome, "relevant": bool(relevant), "findings": findings or "", "quotes": quotes})
            out.append(rows)
        return pd.Series(out)

    # One row a scan: a document's batches are put in order once, not for each question, and no table is made in Python for each scan.
    rows = spread(questions.join(scans, "doc_id"), "query_id")
    return rows.select("query_id", "doc_id", F.inline(read("question", "batches")))


def scan_coverage(results: DataFrame, total: DataFrame) -> DataFrame:
    """``(query_id, doc_id, batches_read, chunks_read, chunks_total, stopped_reason, complete, usable)``: what a scan's own outcomes say that it has read.

    ``total (doc_id, n)`` counts the chunks of a document.  A scan that read less than all of them says why; one that read
    nothing supports no answer.
    """
    read = F.col("outcome") == "READ"
    sums = results.groupBy("query_id", "doc_id").agg(F.count_if(read).alias("batches_read"), F.sum(F.when(read, F.col("n_chunks")).otherwise(0)).alias("chunks_read"))
    rows = sums.join(total.select("doc_id", F.col("n").alias("chunks_total")), "doc_id")
    short = F.col("chunks_read") < F.col("chunks_total")
    return rows.select("query_id", "doc_id", "batches_read", "chunks_read", "chunks_total", F.when(short, "the AI service was unavailable").alias("stopped_reason"), (~short & (F.col("chunks_total") > 0)).alias("complete"), (F.col("chunks_read") > 0).alias("usable"))


def scan_answers(results: DataFrame, docs: DataFrame, coverage_rows: DataFrame) -> DataFrame:
    """``(query_id, doc_id, findings, quotes, n_quotes, error)``: what is left to answer from.

    Findings of relevant batches stand in the order of the document under the sections that they come from.  Quotes are
    those that the text ``docs (doc_id, text)`` really holds, each once, in first-seen order.  A scan that read nothing
    has the error LLM_UNAVAILABLE and nothing else.
    """
    # A quotation is known by its question, its batch and its place there.
    cited = results.select("query_id", "doc_id", "batch", F.posexplode("quotes").alias("pos", "text"))
    cited = cited.withColumn("quote_id", F.struct("query_id", "batch", "pos"))
    docs = docs.join(cited.select("doc_id").distinct(), "doc_id", "left_semi")  # before anything is made of their texts
    true = verify.verify(cited.select("quote_id", "doc_id", "text"), docs).where("status = 'VERIFIED'").select("quote_id", "doc_id")
    kept = cited.join(true, ["quote_id", "doc_id"], "left_semi").groupBy("query_id", "doc_id", "text").agg(F.min(F.struct("batch", "pos")).alias("at"))
    quotes = kept.groupBy("query_id", "doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]).alias("quotes"))
    told = results.where("relevant").where(F.trim("findings") != "")
    label = F.when(F.col("start") == F.col("end"), F.concat(F.lit("Part "), (F.col("start") + 1).cast("string"))).otherwise(F.concat(F.lit("Parts "), (F.col("start") + 1).cast("string"), F.lit("–"), (F.col("end") + 1).cast("string")))
    part = F.concat(F.lit("### "), label, F.lit("\n"), F.trim("findings"))
    findings = told.groupBy("query_id", "doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("batch", part.alias("x")))), lambda p: p["x"]), "\n\n").alias("findings"))
    rows = coverage_rows.join(findings, ["query_id", "doc_id"], "left").join(quotes, ["query_id", "doc_id"], "left")
    ok = F.col("usable")
    listed = F.when(ok, F.coalesce("quotes", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    return rows.select("query_id", "doc_id", F.when(ok, F.coalesce("findings", F.lit(""))).otherwise("").alias("findings"), listed.alias("quotes"), F.size(listed).cast("bigint").alias("n_quotes"), F.when(~ok, "LLM_UNAVAILABLE").alias("error"))


def map_quotes(results: DataFrame, most: int = 5, key: str = "query_id") -> DataFrame:
    """``(key, n, quote)``: the first ``most`` quotes of every batch, each once per key and numbered in first-seen order.

    ``results (key, batch, quotes)``; blank quotes go, and do not count.
    """
    firsts = F.slice(F.filter("quotes", lambda q: F.trim(q) != ""), 1, most)
    rows = results.select(key, "batch", F.posexplode(firsts).alias("pos", "quote"))
    seen = rows.groupBy(key, "quote").agg(F.min(F.struct("batch", "pos")).alias("at"))
    return seen.select(key, F.row_number().over(Window.partitionBy(key).orderBy("at", "quote")).alias("n"), "quote")


def keyword_findings(question: str, texts: list[str]) -> tuple[bool, str, list[str]]:
    terms = {w for w in re.findall(r"\w{4,}", (question or "").lower())}
    quotes = [s.strip() for t in texts for s in re.split(r"(?<=[.;])\s+", t) if terms & set(re.findall(r"\w{4,}", s.lower()))]
    return bool(quotes), f"{len(quotes)} passages" if quotes else "", list(dict.fromkeys(quotes))[:5]
