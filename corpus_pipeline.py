"""A training-corpus pipeline: each stage reads all that its predecessor kept, as Parquet from the shared folder.

Stages, in order: language identification (texts whose language can't be told
go), near-duplicate removal (the smallest doc_id of each group stays), secret
redaction, sampling to target source weights, and best-fit packing.  All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clausemill.llm import language, mixing, overlap, packing, secrets
from clausemill.session import table
from clausemill.storage import scratch, settle, settled


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language can be told; a missing label is filled in.  Written to the shared folder, as that takes short Arrow batches."""
    return settle(language.keep_identified(docs), "identified")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of every group of near copies: candidates are operator 1's components (SimHash, 4 bits) and bands of minima, and an exact check asks for five-word shingles that overlap by 0.8 or more."""
    return overlap.keep_first(docs, stored=True, radius=4)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets inside texts; every document stays."""
    return secrets.redact_secrets(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample documents so that source, language and topic meet their target weights."""
    return mixing.keep_sampled(docs, stored=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the token sequences of all documents left."""
    return packing.pack(docs).drop("bound_gap", "corpus_bound")


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("source_mix", source_mix), ("pack", pack)]

#: Language models, fingerprints and packing are not SQL; tests hold the run against its stages, and stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the packed pieces of what they keep.

    The result is one table in the shared folder; all others that the stages wrote there are deleted.
    """
    docs = table(spark, sf_dir, "documents")
    with scratch() as kept:
        for name, stage in STAGES[:-1]:
            docs = settled(stage(spark, docs, sf_dir), name)
        kept.append(settle(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0]))
    return kept[0]
