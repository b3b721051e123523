"""Streams of requests and files: throttles in event time, and documents processed as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.functions import text as T
from clausemill.operators import events, ingest, structure
from clausemill.sources import files


def throttled(requests: DataFrame, limit: int, seconds: int = 60, late: str = "2 minutes") -> DataFrame:
    """Windows of a request stream in which a user exceeds the limit; late rows count until the watermark passes."""
    return events.throttle(requests.withWatermark("ts", late), limit, seconds).where("over")


def _texts(accepted: DataFrame) -> DataFrame:
    """``(path, text, chars, scanned)`` of accepted files: what their reader finds, and whether a PDF is only pictures of pages."""
    pages = files.pdf_texts(accepted.where("kind = 'PDF'"))
    verdict = structure.scan_verdict(pages.select(F.col("path").alias("doc_id"), "page", T.readable_chars(F.col("text")).alias("text_chars")))
    parts = F.array_sort(F.collect_list(F.struct("page", "text")))
    pdf = pages.groupBy("path").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))
    pdf = pdf.join(verdict.select(F.col("doc_id").alias("path"), F.col("fully_scanned").alias("scanned")), "path")
    found = pdf.unionByName(files.docx_texts(accepted.where("kind = 'DOCX'")).withColumn("scanned", F.lit(False)))
    rows = accepted.select("path", "kind").join(found, "path", "left").withColumn("scanned", F.coalesce("scanned", F.col("kind") == "PDF"))
    return rows.select("path", "text", T.readable_chars(F.coalesce("text", F.lit(""))).alias("chars"), "scanned")


def process_files(spark: SparkSession, folder: str, out: str, checkpoint: str):
    """Sniff, hash, read and index PDF and DOCX documents that arrive in ``folder``; returns the stream to start.

    Every file gets a row in ``out/documents`` with its final status and, if it failed, why; the clauses of those that
    are READY go to ``out/clauses``.  Both are written by epoch, so a micro-batch that is run again replaces its own
    rows.  The checkpoint makes a restart resume where it stopped, which also recovers work that was stuck.
    """
    arriving = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)

    def process(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        rows = batch.select("path", "content", F.sha2("content", 256).alias("sha256"), ingest.sniff(F.col("content")).alias("v")).select("path", "content", "sha256", "v.kind", "v.reason")
        read = rows.join(_texts(rows.where("reason is null")), "path", "left")
        status, code = ingest.next_status(F.col("kind"), F.col("chars"), F.col("scanned"))
        refused = F.col("reason").isNotNull()
        docs = read.select("path", "sha256", "kind", "text", F.when(refused, "FAILED").otherwise(status).alias("status"), F.coalesce("reason", code).alias("error_code"), F.lit(epoch).alias("epoch"))
        upsert_partition(docs.drop("text"), f"{out}/documents", "epoch")
        clauses = structure.segment_clauses(docs.where("status = 'READY'"), ["path"])
        upsert_partition(clauses.withColumn("epoch", F.lit(epoch)), f"{out}/clauses", "epoch")
        batch.unpersist()

    return arriving.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)


def upsert_partition(df: DataFrame, path: str, by: str) -> None:
    """Replace only the partitions of ``path`` that ``df`` has rows for."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
