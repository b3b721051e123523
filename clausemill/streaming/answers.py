"""Streamed answers: prose is passed on as it comes, the quote payload after the delimiter is held back."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from clausemill.operators.chat import DELIMITER

OUTPUT = "message_id long, delta string, quotes_text string, done boolean"


def push(pending: str, quotes: str, found: bool, chunk: str, last: bool) -> tuple[str, str, str, bool]:
    """One step: ``(delta, pending, quotes, found)``.  What may be the start of the delimiter, and white space before it, waits."""
    if found:
        return "", "", quotes + chunk, True
    pending += chunk
    at = pending.find(DELIMITER)
    if at >= 0:
        return pending[:at].rstrip(), "", pending[at + len(DELIMITER) :], True
    if last:
        return pending.rstrip(), "", quotes, False
    keep = max(0, len(pending) - (len(DELIMITER) - 1))
    keep = len(pending[:keep].rstrip())
    return pending[:keep], pending[keep:], quotes, False


def split_stream(chunks: DataFrame) -> DataFrame:
    """Deltas of a stream of ``chunks (message_id, seq, chunk, last)``, one state per message.

    Chunks of a message come in order of seq; the row with ``last`` ends it and drops its state.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, quotes, found = state.get if state.exists else ("", "", False)
        rows = pd.concat(list(parts)).sort_values("seq")
        deltas, done = [], False
        for chunk, last in zip(rows["chunk"], rows["last"]):
            delta, pending, quotes, found = push(pending, quotes, found, chunk, bool(last))
            deltas.append(delta)
            done = done or bool(last)
        if done:
            state.remove()
        else:
            state.update((pending, quotes, found))
        yield pd.DataFrame({"message_id": [key[0]], "delta": ["".join(deltas)], "quotes_text": [quotes if done else None], "done": [done]})

    return chunks.groupBy("message_id").applyInPandasWithState(step, OUTPUT, "pending string, quotes string, found boolean", "append", GroupStateTimeout.NoTimeout)
