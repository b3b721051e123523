"""Time-stamped operations: stuck work, throttles, failure streaks, token buckets, usage."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def older_than(ts: Column, now: str, minutes: int) -> Column:
    return ts < F.expr(f"timestamp'{now}' - interval {minutes} minutes")


def throttle(events: DataFrame, limit: int, seconds: int = 60, key: str = "user_id") -> DataFrame:
    """``(key, window_start, n, over)``: requests per fixed window, and whether they exceed the limit.  Works on streams with a watermark."""
    rows = events.groupBy(key, F.window("ts", f"{seconds} seconds").alias("w")).agg(F.count("*").alias("n"))
    return rows.select(key, F.col("w.start").alias("window_start"), "n", (F.col("n") > limit).alias("over"))


def failure_streaks(outcomes: DataFrame, key: str, order: str, failed: Column, stop: int = 3) -> DataFrame:
    """``outcomes`` with ``streak``, the failures in a row up to each, and ``stopped``: whether an earlier or this row completed ``stop`` in a row."""
    upto = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = outcomes.withColumn("island", F.count_if(~failed).over(upto))
    rows = rows.withColumn("streak", F.count_if(failed).over(Window.partitionBy(key, "island").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("stopped", F.max((F.col("streak") >= stop).cast("int")).over(upto) == 1).drop("island")


SHORTEST_WAIT = 25


def grant(costs: list[float], at: list[float], per_minute: float) -> list[float]:
    """Times (ms) at which a token bucket that starts full and refills evenly grants each cost, in order.

    Costs over the bucket count as a full one.  A wait is of whole milliseconds, SHORTEST_WAIT at least.
    """
    room, seen, out = per_minute, None, []
    for cost, t in zip(costs, at):
        t = t if seen is None else max(t, seen)
        room = per_minute if seen is None else min(per_minute, room + (t - seen) / 60_000 * per_minute)
        need = min(max(cost, 0), per_minute)
        if need > room:
            wait = max(SHORTEST_WAIT, math.ceil((need - room) / per_minute * 60_000))
            t, room = t + wait, max(need, min(per_minute, room + wait / 60_000 * per_minute))
        room, seen = room - need, t
        out.append(t)
    return out


def token_bucket(requests: DataFrame, per_minute: float, key: str = "user_id") -> DataFrame:
    """``(key, event_id, wait_ms)`` of ``requests (key, event_id, ts, cost)``: each key has a bucket of its own."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["ts", "event_id"])
        ms = rows["ts"].astype("datetime64[us]").astype("int64").to_numpy() / 1000
        rows["wait_ms"] = [g - t for g, t in zip(grant(rows["cost"].tolist(), ms.tolist(), per_minute), ms)]
        return rows[[key, "event_id", "wait_ms"]]

    kind = requests.schema[key].dataType.simpleString()
    return requests.groupBy(key).applyInPandas(run, f"{key} {kind}, event_id bigint, wait_ms double")


def usage_rollup(calls: DataFrame, by: list[str]) -> DataFrame:
    """Calls, tokens and mean cost by every prefix of ``by``, totals included; an absent level is null."""
    return calls.rollup(*by).agg(F.count("*").alias("n_calls"), F.round(F.sum("value"), 4).alias("total"))
