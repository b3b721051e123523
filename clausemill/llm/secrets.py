"""Secret scan with built-in SQL functions only: three fixed formats, and sliding-window entropy for the rest.

Entropy method: candidate strings are runs of token characters.  A window
slides over each; the counts of the characters inside it change by one entering
and one leaving character, and so does the sum of ``c * log2(c)`` that Shannon
entropy needs.  Each character class (hexadecimal, small or large letters with
digits, letters alone, mixed, base64) has its own alphabet and threshold.
Allow-listed shapes (words, numbers, identifiers, placeholders) of hot ranges are suppressed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausemill.llm.spans import listed, matches, tagged

# The base patterns in their listed order.  A run of 14 (16) or more characters is found at the
# same places as a run of any length that is then held against the least length.
ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGNED = 12

#: Candidates: runs of letters and digits, and runs that may hold the other signs of base64 as well.
NARROW, WIDE = r"[A-Za-z0-9]{20,}", r"[A-Za-z0-9+/_-]{20,}={0,2}"
WINDOW = 20

_SMALL, _LARGE, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Character classes, tried in this order: shape of the run, alphabet, and bits per character from which a window counts
#: as random: what 99 of 100 windows of 20 random characters of that alphabet reach.
CLASSES = (
    ("hex", NARROW, r"^(?=.*[0-9])(?=.*[A-Fa-f])[0-9a-fA-F]+$", _DIGITS + "abcdefABCDEF", 2.90),
    ("lower", NARROW, r"^(?=.*[0-9])(?=.*[g-z])[a-z0-9]+$", _SMALL + _DIGITS, 3.40),
    ("upper", NARROW, r"^(?=.*[0-9])(?=.*[G-Z])[A-Z0-9]+$", _LARGE + _DIGITS, 3.34),
    ("letters", NARROW, r"^(?=.*[b-df-hj-np-tv-xzB-DF-HJ-NP-TV-XZ]{6})(?:[a-z]+|[A-Z]+)$", _SMALL + _LARGE, 3.22),
    ("mixed", NARROW, r"^(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9]+$", _SMALL + _LARGE + _DIGITS, 3.64),
    ("wide", WIDE, r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])(?=.*[+/_-])", _SMALL + _LARGE + _DIGITS + "+/_=-", 3.64),
)

# Shapes of hot ranges that are never secrets.
ALLOWED = (
    r"^(?=.*[a-z])(?=.*[A-Z])(?:[A-Z]?[a-z]{2,}+|[A-Z]{3,}+)+[0-9]{0,8}$",  # words in camel case, with a number behind
    r"^(?:(?:[A-Z]?[a-z]{2,}+|[A-Z]{3,}+|[0-9]{1,8}+)[+/_=-]++)++(?:[A-Z]?[a-z]*+|[A-Z]++|[0-9]++)$",  # words and numbers joined by signs
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",  # UUID
    r"(?i)example|placeholder|changeme|redacted|x{8}|0{8}",
    r"(?i)abcdefghij|0123456789|1234567890|qwertyuiop",
)

_ALPHABET = _LARGE + _SMALL + _DIGITS + "+/_=-"


def _part(c: Column) -> Column:
    return F.when(c > 0, c * F.log2(c)).otherwise(0.0)


def hot_range(value: Column, window: int, threshold: Column, alphabet: str = _ALPHABET) -> Column:
    """``(first, last)``: start of the first and end of the last window over the threshold, or null; one pass over ``value``."""
    chars = F.split(value, "")
    leaving = F.concat(F.array_repeat(F.lit(""), window), chars)
    pairs = F.filter(
        F.zip_with(chars, leaving, lambda a, b: F.struct(F.instr(F.lit(alphabet), a).alias("a"), F.when(b == "", 0).otherwise(F.instr(F.lit(alphabet), b)).alias("b"))),
        lambda x: x["a"].isNotNull(),
    )
    zero = F.struct(
        F.lit(0).alias("i"),
        F.array_repeat(F.lit(0), len(alphabet)).alias("n"),
        F.lit(0.0).alias("sum"),
        F.lit(None).cast("int").alias("first"),
        F.lit(None).cast("int").alias("last"),
    )

    def seen(acc: Column) -> tuple[Column, Column]:
        hot = (acc["i"] >= window) & (F.log2(F.lit(float(window))) - acc["sum"] / window >= threshold)
        return (
            F.when(acc["first"].isNull() & hot, acc["i"] - window).otherwise(acc["first"]),
            F.when(hot, acc["i"]).otherwise(acc["last"]),
        )

    def step(acc: Column, x: Column) -> Column:
        first, last = seen(acc)
        enters = F.element_at(acc["n"], x["a"])
        leaves = F.when(x["b"] > 0, F.element_at(acc["n"], F.greatest(x["b"], F.lit(1)))).otherwise(1)
        change = _part(enters + 1) - _part(enters) + _part(leaves - 1) - _part(leaves)
        counts = F.transform(acc["n"], lambda c, j: c + F.when(j + 1 == x["a"], 1).otherwise(0) - F.when(j + 1 == x["b"], 1).otherwise(0))
        return F.struct(
            (acc["i"] + 1).alias("i"),
            F.when(x["a"] == x["b"], acc["n"]).otherwise(counts).alias("n"),
            F.when(x["a"] == x["b"], acc["sum"]).otherwise(acc["sum"] + change).alias("sum"),
            first.alias("first"),
            last.alias("last"),
        )

    return F.aggregate(pairs, zero, step, lambda acc: F.struct(*[c.alias(n) for c, n in zip(seen(acc), ("first", "last"))]))


def _free_parts(hot: Column, base: Column, window: int) -> Column:
    """The parts of a hot range before and after the base spans that it overlaps, where they are a window long."""
    over = F.filter(base, lambda o: (o["s"] < hot["e"]) & (hot["s"] < o["e"]))
    sides = F.array(F.struct(hot["s"].alias("s"), F.array_min(F.transform(over, lambda o: o["s"])).alias("e")), F.struct(F.array_max(F.transform(over, lambda o: o["e"])).alias("s"), hot["e"].alias("e")))
    return F.when(F.size(over) == 0, F.array(hot)).otherwise(F.filter(sides, lambda p: p["e"] - p["s"] >= window))


def _hot(text: str, runs: str, shape: str, alphabet: str, bits: float, window: int) -> Column:
    """``(s, e)`` of the hot ranges of a class's runs that are not allow-listed."""
    scored = F.transform(F.filter(F.col(runs), lambda x: x["v"].rlike(shape)), lambda x: F.struct(x["s"].alias("at"), hot_range(x["v"], window, F.lit(bits), alphabet).alias("hot"), x["v"].alias("v")))

    def suspect(x: Column) -> Column:
        part, allowed = F.substr(x["v"], x["hot"]["first"] + 1, x["hot"]["last"] - x["hot"]["first"]), F.lit(False)
        for pattern in ALLOWED:
            allowed = allowed | part.rlike(pattern)
        return x["hot"]["first"].isNotNull() & ~allowed

    return F.transform(F.filter(scored, suspect), lambda x: F.struct((x["at"] + x["hot"]["first"]).alias("s"), (x["at"] + x["hot"]["last"]).alias("e")))


def _found(rows: DataFrame, window: int) -> DataFrame:
    """``rows (text, ...)`` with the arrays ``assign, access, hexes, base, spans`` of ``(s, k, e, kind)``."""
    value = lambda x: F.length(F.regexp_extract(x["v"], ASSIGN, 1)) >= ASSIGNED
    rows = rows.select(
        "*",
        tagged(F.filter(matches("text", ASSIGN), value), 0, "assign").alias("assign"),
        tagged(matches("text", ACCESS), 1, "access").alias("access"),
        tagged(matches("text", HEX), 2, "hex").alias("hexes"),
        matches("text", NARROW).alias("narrow"),
        matches("text", WIDE).alias("broad"),
    )
    rows = rows.withColumn("base", F.concat("assign", "access", "hexes"))
    narrow, wide = ([_hot("text", c, *rest, window) for _, kind, *rest in CLASSES if kind == p] for c, p in (("narrow", NARROW), ("broad", WIDE)))
    rows = rows.withColumn("hot", F.concat(*narrow))
    apart = F.filter(F.concat(*wide), lambda x: ~F.exists("hot", lambda o: (o["s"] < x["e"]) & (x["s"] < o["e"])))
    free = F.flatten(F.transform(F.concat("hot", apart), lambda x: _free_parts(x, F.col("base"), window)))
    spans = F.transform(free, lambda x: F.struct(x["s"].alias("s"), F.lit(3).alias("k"), x["e"].alias("e"), F.lit("entropy").alias("kind")))
    return rows.withColumn("spans", F.concat("base", spans)).drop("narrow", "broad", "hot")


def find_secrets(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base, spans)`` per row of ``docs``: arrays of ``(s, k, e, kind)``; map only.

    base holds the three fixed formats, spans those and the entropy method's (kind ``entropy``, never over a base span).

    Null text counts as empty and has no spans.  Ids may be null or repeat.  An empty table gives no rows.  Other columns are not read.
    """
    found = _found(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")), window)
    sizes = [F.size(c).cast("bigint").alias(n) for c, n in (("assign", "n_assign"), ("access", "n_access"), ("hexes", "n_hex"))]
    return found.select("doc_id", *sizes, "base", "spans")


def secret_report(docs: DataFrame, **options) -> DataFrame:
    """:func:`find_secrets` with the spans listed as text and the base ones hashed."""
    found = find_secrets(docs, **options)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]", window: int = WINDOW, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with every span that :func:`find_secrets` reports replaced by ``mark``; overlapping spans become one mark.

    All rows and columns stay, whatever their names; ``length_col``, where there is one, follows a changed text.  Null
    text stays null.  Repeated rows and ids are treated alike; an empty table gives no rows.
    """
    text = F.col(f"`{text_col}`")
    rows = _found(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.coalesce(text, F.lit("")).alias("text")), window)
    rows = rows.select("doc", "text", F.array_sort(F.transform("spans", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))).alias("spans"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        before = F.substr(F.col("text"), acc["at"] + 1, F.greatest(x["s"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(x["s"] >= acc["at"], F.concat(acc["out"], F.array(before, F.lit(mark)))).otherwise(acc["out"]).alias("out"))

    rest = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(F.col("text"), acc["at"] + 1))
    rows = rows.withColumn("changed", F.when(F.size("spans") > 0, F.aggregate("spans", zero, step, rest)))
    out = {text_col: F.coalesce("changed", F.col(f"doc.`{text_col}`"))}
    if length_col in docs.columns:
        out[length_col] = F.when(F.col("changed").isNotNull(), F.length("changed")).otherwise(F.col(f"doc.`{length_col}`")).cast(docs.schema[length_col].dataType)
    return rows.select(*[out.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])
