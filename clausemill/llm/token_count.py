"""Token counts of documents by the whole-token shortcut (see ``tokens``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausemill.llm.rows import per_text
from clausemill.llm.tokens import count_tokens, default_vocabulary


def token_counts(docs: DataFrame, vocabulary: str | None = None, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` per row of ``docs``; map only, one pass.

    Null text counts as empty (0 bytes, 0 tokens); ids may be null or repeat; an empty table gives no rows.
    """
    path = vocabulary or default_vocabulary()

    def of(texts: list[str]) -> dict:
        return {"n_bytes": [len(t.encode()) for t in texts], "n_tokens": [count_tokens(t, path) for t in texts]}

    return per_text(docs, of, "n_bytes bigint,n_tokens bigint", id_col, text_col).withColumn("over_limit", F.col("n_tokens") > limit)
