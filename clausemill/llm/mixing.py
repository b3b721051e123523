"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed into cells (source, language, topic).  Each sweep scales the
cell weights to the target marginal of one dimension after the other.  A
document's sampling probability is its cell's weight per token, scaled so that
the most wanted cell keeps everything or so that a stated share of all tokens
stays, where wanted cells saturate at 1; a hash of the id decides, so a rerun
draws the same documents.  All of it is built-in functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from clausemill.llm.keep import place, placed, sift
from clausemill.storage import discard, scratch, settle

#: Most sweeps, and the largest relative miss of a marginal inside a sweep at which the sweeps end.
SWEEPS, TOLERANCE = 10, 1e-6
#: Without explicit targets a dimension aims at shares proportional to tokens ** power.
POWERS = {"source": 0.7, "lang": 0.8, "topic": 0.9}
#: Share of all tokens that is expected to stay.
KEEP = 0.75
_DRAWS = 2**32

# Strings that speak for a topic (with any first letter), runs that are decoration, and one string in how many words makes the topic.
TOPICS = {
    "legal": ("icense", "opyright", "arranty", "iability", "greement"),
    "access": ("assword", "ecret", "ccount", "mail", "oken"),
    "trade": ("ustomer", "rder", "ayment", "nvoice", "rice"),
}
MARKS = ("###", "$$$", "%%%", "&&&", "***")
DENSITY = 25


def topic(text: Column) -> Column:
    """Topic of a text: ``table`` (cells), ``noise`` (runs of symbols), ``shout`` (upper case), else by its words, else ``prose``."""
    head = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(head), F.lit(1))
    without = head
    for mark in MARKS:
        without = F.replace(without, F.lit(mark), F.lit(""))
    bars = F.length(head) - F.length(F.replace(head, F.lit(" | "), F.lit("  ")))
    loud = (head == F.upper(head)) & (head != F.lower(head))
    found = F.when(bars * 40 > n, "table").when((n - F.length(without)) * 10 > n, "noise").when(loud, "shout")
    for name, strings in TOPICS.items():
        times = [(F.length(head) - F.length(F.replace(head, F.lit(s), F.lit("")))) / len(s) for s in strings]
        found = found.when(sum(times[1:], times[0]) * DENSITY * 6 > n, name)
    return found.otherwise("prose")


def weighed(docs: DataFrame, carry: list[str] | None = None, topic_of: Callable[[Column], Column] = topic) -> DataFrame:
    """``(doc, source, lang, topic, tokens)`` per row: doc holds the columns ``carry`` (all), tokens counts words between white space.

    A missing source or language is a group of its own.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry or docs.columns]).alias("doc"),
        F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce("lang", F.lit("")).alias("lang"),
        topic_of(F.col("text")).alias("topic"),
        F.size(F.array_remove(F.split(text, r"[\x09-\x0D\x20]+"), "")).cast("double").alias("tokens"),
    )


def _with_target(cells: DataFrame, name: str, power: float, explicit: dict[str, float] | None) -> DataFrame:
    """``cells`` with ``t_name``: the target share of the cell's group; shares sum to 1 over the groups that have tokens."""
    if explicit is None:
        raw = F.pow(F.sum("tokens"), F.lit(power))
    else:
        given = F.create_map(*[F.lit(x) for kv in explicit.items() for x in kv]) if explicit else F.create_map().cast("map<string,double>")
        raw = F.coalesce(F.element_at(given, F.col(name)).cast("double"), F.lit(0.0))
    aim = cells.groupBy(name).agg(raw.alias("raw"))
    total = aim.agg(F.sum("raw")).first()[0] or 1.0
    return cells.join(aim.select(name, (F.col("raw") / total).alias(f"t_{name}")), name)


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, powers: dict[str, float] | None = None, sweeps: int = SWEEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """``cells (source, lang, topic, tokens)`` with ``weight`` and ``residual``.

    Weights are shares that meet the target marginals as far as the cells allow; residual is the largest distance of
    the cell's marginals from their targets.  Sweeps end early once no marginal was off by more than ``tolerance``.
    The cells are a summary of the corpus, one row per combination.  A sweep is one plan without joins, and is written,
    so plans do not grow with the sweeps.
    """
    powers, targets = powers or POWERS, targets or {}
    dims = list(powers)
    now = settle(cells.where("tokens > 0"), "cells")
    aimed = now
    for name, power in powers.items():
        aimed = _with_target(aimed, name, power, targets.get(name))
    have = lambda name: F.sum("weight").over(Window.partitionBy(name))
    now, before = settle(aimed.withColumns({"weight": F.col("tokens"), "off": F.lit(0.0)}), "aimed"), now
    for turn in range(sweeps):
        rows = now.withColumn("off", F.lit(0.0))
        for name in dims:
            rows = rows.withColumn("factor", F.col(f"t_{name}") / F.when(have(name) > 0, have(name)))
            rows = rows.withColumns({"weight": F.col("weight") * F.coalesce("factor", F.lit(0.0)), "off": F.coalesce(F.greatest("off", F.abs(F.col("factor") - 1)), F.col("off"))})
        seen = Observation()
        after = settle(rows.drop("factor").observe(seen, F.max("off").alias("off")), "sweep")
        discard(before)
        now, before = after, now
        if (seen.get.get("off") or 0.0) <= tolerance:
            break
    out = settle(now.select(*dims, "tokens", "weight", F.greatest(*[F.abs(have(n) - F.col(f"t_{n}")) for n in dims]).alias("residual")), "raked")
    discard(before, now)
    return out


def scale_for(rates: DataFrame, keep: float) -> float:
    """The ``c`` at which ``min(1, c * rate)`` over ``rates (tokens, weight, rate)`` keeps the share ``keep`` of all tokens.

    Cells that would pass 1 are held at 1 and the rest is scaled anew, until no more cells pass.  If the cells that
    have a rate hold less than that share, all of them stay whole.
    """
    total = rates.agg(F.sum("tokens")).first()[0] or 0.0
    c, full = 0.0, -1
    while True:
        held = F.col("rate") * c >= 1.0
        n, tokens, weight = rates.agg(F.count(F.when(held, 1)), F.sum(F.when(held, F.col("tokens")).otherwise(0.0)), F.sum(F.when(held, 0.0).otherwise(F.col("weight")))).first()
        if n == full or not weight or tokens >= keep * total:
            break
        c, full = max(c, (keep * total - tokens) / weight), n
    least = rates.where("rate > 0").agg(F.min("rate")).first()[0]
    return c if c or not least else 1.0 / least


def _drawn(rows: DataFrame, targets, powers, sweeps: int, tolerance: float, seed: str, keep: float | None) -> DataFrame:
    """``rows`` of :func:`weighed` with ``probability``, ``residual`` and ``sampled``."""
    dims = ["source", "lang", "topic"]
    cells = rows.groupBy(*dims).agg(F.sum("tokens").alias("tokens"))
    rates = rake(cells, targets, powers, sweeps, tolerance).withColumn("rate", F.col("weight") / F.col("tokens"))
    if keep is None:
        chance = F.col("rate") / (rates.agg(F.max("rate")).first()[0] or 1.0)
    else:
        chance = F.least(F.lit(1.0), F.col("rate") * scale_for(rates, keep))
    joined = rows.join(rates.select(*dims, chance.alias("chance"), "residual"), dims, "left")
    chance = F.when(F.col("tokens") > 0, F.coalesce("chance", F.lit(0.0))).otherwise(0.0)
    draw = F.conv(F.substr(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc.doc_id").cast("string"), F.lit("")))), F.lit(1), F.lit(8)), 16, 10).cast("double") / _DRAWS
    return joined.select("doc", *dims, "tokens", "residual", chance.alias("probability"), (draw < chance).alias("sampled"))


def mix(
    docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, powers: dict[str, float] | None = None, sweeps: int = SWEEPS, seed: str = "mix",
    keep: float | None = None, tolerance: float = TOLERANCE, carry: list[str] | None = None, topic_of: Callable[[Column], Column] = topic,
) -> DataFrame:
    """Every row of ``docs`` (its columns ``carry``, or all) with ``__source, __lang, __topic, __tokens, __probability, __sampled, __residual``.

    Rows without a word belong to no cell and are not sampled; their residual is that of their cell, or null.  A null
    source or language is a group of its own.  Rows that repeat an id are drawn alike; a null id draws as the empty
    string.  An empty table gives no rows.  Columns of ``docs`` may have any names; those with one of the seven names
    above are shadowed.  ``keep`` is the share of all tokens that is expected to stay; without it the cell with the
    highest rate stays whole.  Texts are read once if ``carry`` leaves the text out, else twice.
    """
    rows = weighed(docs, carry, topic_of)
    if carry and "text" not in carry:
        rows = settle(rows, "weighed")
    out = _drawn(rows, targets, powers, sweeps, tolerance, seed, keep)
    added = ("source", "lang", "topic", "tokens", "probability", "sampled", "residual")
    return out.select(*[F.col(f"doc.`{c}`") for c in carry or docs.columns if c not in {f"__{a}" for a in added}], *[F.col(c).alias(f"__{c}") for c in added])


def keep_sampled(
    docs: DataFrame, keep: float = KEEP, targets: dict[str, dict[str, float]] | None = None, powers: dict[str, float] | None = None, sweeps: int = SWEEPS, seed: str = "mix",
    tolerance: float = TOLERANCE, topic_of: Callable[[Column], Column] = topic, stored: bool = False,
) -> DataFrame:
    """The sampled rows of ``docs``, about the share ``keep`` of all tokens, written to the shared folder; all columns stay, whatever their names.

    Null, repeated and empty cases as in :func:`mix`: rows without a word go, an empty table gives no rows.  Places of
    rows are joined with their cells, texts are not.  ``stored`` says that ``docs`` is a plain read of Parquet files, see
    :func:`placed`.
    """
    with scratch() as kept:
        docs = placed(docs, stored)
        rows = settle(weighed(docs.withColumns({"__place": place(docs)}), ["doc_id", "__place"], topic_of), "weighed")
        gone = _drawn(rows, targets, powers, sweeps, tolerance, seed, keep).where("not sampled").select("doc.__place.file", "doc.__place.row")
        kept.append(sift(docs, settle(gone, "gone"), "left_anti"))
    return kept[0]
