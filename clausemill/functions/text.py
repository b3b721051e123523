"""Scalar text operators as column expressions; all of them stay inside the JVM."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from clausemill.functions import patterns as P
from clausemill.functions.patterns import WS, java


def trim(c: Column) -> Column:
    """Without white space, in the wide sense, at both ends; looks at the ends only."""
    return F.btrim(c, F.lit(P.SPACES))


def rtrim(c: Column) -> Column:
    """Without white space, in the wide sense, at the end."""
    return F.rtrim(c, F.lit(P.SPACES))


#: Anything but printable ASCII, and ASCII punctuation; one range and single characters are what Java tests fastest.
_NOT_PLAIN, _PUNCTUATION = "[^ -~]", "[!\"#$%&'()*+,\\-./:;<=>?@\\[\\\\\\]\\^`{|}~]"


def fold(c: Column) -> Column:
    """Trimmed, with every run of white space as one space; plain text with single spaces is passed by after one look."""
    spaces = f"(?![!-~]| [!-~])(?:{WS}{{2,}}|(?! ){WS})"
    return once(c, lambda t: F.when(t.rlike(_NOT_PLAIN) | t.contains("  "), F.regexp_replace(trim(t), spaces, " ")).otherwise(F.btrim(t)))


def bare(c: Column) -> Column:
    """Lower case without punctuation, folded; plain text is looked through for ASCII punctuation only."""
    plain = lambda t: once(F.regexp_replace(t, _PUNCTUATION, ""), lambda x: F.btrim(F.when(x.contains("  "), F.regexp_replace(x, " {2,}", " ")).otherwise(x)))
    wide = lambda t: fold(F.regexp_replace(t, r"(?![a-z ])[^A-Za-z0-9_\t-\r \x{A0}]", ""))
    return once(F.lower(c), lambda t: F.when(t.rlike(_NOT_PLAIN), wide(t)).otherwise(plain(t)))


def rows_of(c: Column) -> Column:
    """An array column to explode.  Of a bare column Spark infers a filter on its size, which it moves below and there computes the array anew, twice."""
    return F.flatten(F.array(c))


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f(c)`` with ``c`` computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


QUOTES, DASHES = ("‘’‚‛′", "“”„‟″"), "‐‑‒–—―−"


@functools.lru_cache(maxsize=1)
def compatibility() -> tuple[dict[str, str], dict[str, str]]:
    """Characters that NFKC replaces, by the form it gives them: one character, or several.  Quotes and dashes have their own plain forms."""
    own, one, many = set("".join(QUOTES) + DASHES), {}, {}
    for i in (*range(0xA0, 0xD800), *range(0xE000, 0x110000)):
        c = chr(i)
        if (n := unicodedata.normalize("NFKC", c)) != c and c not in own:
            (one if len(n) == 1 else many)[c] = n
    return one, many


#: The commonest characters that become several; texts that have no others are spared the walk over every character.
_COMMON = "…ﬀﬁﬂﬃﬄﬅﬆ½¼¾™№"
#: Outside of these, NFKC changes nothing.
_MAY_CHANGE = r"[\u00A0-\u00BF\u0132-\uFFFF\x{10000}-\x{10FFFF}]"


def nfkc(c: Column) -> Column:
    """Every character by its NFKC form; sequences are not composed.  Text of plain Latin letters passes through untouched.

    Characters that become several are looked for once and replaced kind by kind, so one of them costs no look at all others.
    """
    one, many = compatibility()
    single = c
    for x in _COMMON:
        single = F.replace(single, F.lit(x), F.lit(many[x]))
    single = F.translate(single, "".join(one), "".join(one.values()))
    forms = F.map_from_arrays(F.lit(list(many)), F.lit(list(many.values())))
    ranges = "".join(a if a == b else f"{a}-{b}" for a, b in _ranges(many))
    rare = F.lit(rf"(?![\x00-\u00A0])[{ranges}]")
    # As the one element of an array the text is computed once, however often the lambda names it.
    several = F.transform(F.array(single), lambda t: F.aggregate(F.array_distinct(F.regexp_extract_all(t, rare, F.lit(0))), t, lambda out, x: F.replace(out, x, F.element_at(forms, x))))
    return F.when(c.rlike(_MAY_CHANGE), several[0]).otherwise(c)


def _ranges(characters: dict[str, str]) -> list[list[str]]:
    out: list[list[str]] = []
    for c in characters:
        if out and ord(c) == ord(out[-1][1]) + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return out


def normalize(c: Column) -> Column:
    """The form in which quotations are compared: invisible characters out, spaces, quotes and dashes plain, all others by their NFKC form."""
    invisible = F.regexp_replace(c, "[\u00ad\u200b\u200c\u200d\ufeff]", "")
    plain = F.translate(fold(invisible), "".join(QUOTES) + DASHES, "'" * 5 + '"' * 5 + "-" * 7)
    return nfkc(plain)


def strip_spaces(norm: Column) -> Column:
    return F.replace(norm, F.lit(" "), F.lit(""))


HYPHEN_BREAK = rf"(?<=\p{{L}})-{WS}*[\r\n]{WS}*(?=\p{{L}})"


def join_hyphens(c: Column) -> Column:
    """Words that a line break split at a hyphen, joined again; compounds stay."""
    return F.regexp_replace(c, HYPHEN_BREAK, "")


def clean_quote(c: Column) -> Column:
    """A quotation without an ellipsis at either end and without up to four layers of matching quote marks."""
    out = trim(c)
    out = trim(F.regexp_replace(out, r"^(\.\.\.|…)", ""))
    out = trim(F.regexp_replace(out, r"(\.\.\.|…)$", ""))
    for _ in range(4):
        out = trim(F.regexp_replace(out, "^(?s:\"(.*)\"|'(.*)'|“(.*)”|‘(.*)’)$", "$1$2$3$4"))
    return out


def tokens(c: Column) -> Column:
    """Estimated tokens: one for each 3.5 characters, rounded up."""
    return F.ceil(F.length(c) / F.lit(3.5)).cast("int")


def cut_at_word(c: Column, limit: int, share: float, mark: str = "") -> Column:
    """At most ``limit`` characters, cut at the last space if that keeps over ``share`` of them; ``mark`` follows a cut."""
    head = F.substring(c, 1, limit)
    last = F.length(head) - F.instr(F.reverse(head), " ")  # 0-based place of the last space
    cut = F.when((F.instr(head, " ") > 0) & (last > limit * share), F.substr(head, F.lit(1), last)).otherwise(head)
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(cut, F.lit(mark)) if mark else cut)


def truncate_to_tokens(c: Column, limit: int) -> Column:
    return cut_at_word(c, int(limit * 3.5), 0.8)


def readable_chars(c: Column) -> Column:
    return F.length(F.when(c.rlike("[^ -~]"), F.regexp_replace(c, WS, "")).otherwise(F.replace(c, F.lit(" "), F.lit(""))))


def page_marker(c: Column) -> Column:
    """A line as a page marker (digit runs as #), or null if it has no digit or over ten letters."""
    mark = lambda low: F.when(~low.rlike("^(?:[^a-z]*+[a-z]){11}") & low.rlike("[0-9]"), F.regexp_replace(fold(low), "[0-9]+", "#"))
    return once(F.lower(c), mark)


def heading(c: Column) -> Column:
    """``struct(ref, heading, depth)`` of a heading line, else null; the first rule that fits wins."""
    return once(trim(c), _heading)


def _heading(line: Column) -> Column:
    """:func:`heading` of a trimmed line; a rule is tried only where its first character allows it."""
    none = F.lit(None).cast("string")
    blank = lambda x: once(trim(x), lambda t: F.when(t != "", t))
    depth = lambda ref: (F.length(ref) - F.length(F.replace(ref, F.lit("."), F.lit(""))) + 1).cast("int")
    rules = {k: java(p) for k, p in P.HEADINGS}
    part = lambda k, i: F.regexp_extract(line, rules[k], i)
    fits = lambda k: F.substring(line, 1, 1).isin(*P.HEADING_STARTS[k]) & line.rlike(rules[k])
    row = lambda ref, head, d: F.struct(ref.alias("ref"), head.alias("heading"), d.alias("depth"))
    caps = ~line.rlike("[a-z]") & line.rlike("^(?:[^A-Z]*+[A-Z]){4}") & (F.length(line) <= 80) & ~line.endswith(".")
    return F.when(
        F.length(line).between(1, 120),
        F.when(fits("article"), row(F.concat_ws(" ", part("article", 1), part("article", 2)), blank(part("article", 3)), F.lit(1)))
        .when(fits("section"), once(part("section", 2), lambda n: row(F.concat_ws(" ", part("section", 1), n), blank(part("section", 3)), depth(n))))
        .when(fits("numbered"), once(part("numbered", 1), lambda n: row(n, blank(part("numbered", 2)), depth(n))))
        .when(fits("lettered"), row(part("lettered", 1), blank(part("lettered", 2)), F.lit(3)))
        .when(caps, row(none, line, F.lit(1))),
    )


def clause_body(text: Column, ref: Column) -> Column:
    """Clause text without its leading reference."""
    t = F.ltrim(text, F.lit(P.SPACES))
    rest = F.when(F.startswith(t, F.concat(F.lit("("), ref)), F.substr(t, F.length(ref) + 2)).when(F.startswith(t, ref), F.substr(t, F.length(ref) + 1))
    return trim(F.when(ref.isNull(), text).otherwise(F.coalesce(F.regexp_replace(rest, rf"^\)?\.?{WS}*[.:–—-]?{WS}*", ""), t)))


def classify_question(c: Column) -> Column:
    """``struct(intent, whole_document, reason)``: COMPLETENESS rules first, then EXISTENCE, else SPECIFIC."""
    text = trim(c)
    row = lambda intent, whole, reason: F.struct(F.lit(intent).alias("intent"), F.lit(whole).alias("whole_document"), F.lit(reason).alias("reason"))
    out = None
    for intent, rules in (("COMPLETENESS", P.COMPLETENESS), ("EXISTENCE", P.EXISTENCE)):
        for reason, pattern in rules:
            tested = F.regexp_replace(text, java(P.GUARDED[reason]), "#") if reason in P.GUARDED else text
            test = tested.rlike(java(pattern))
            out = F.when(test, row(intent, True, reason)) if out is None else out.when(test, row(intent, True, reason))
    return out.otherwise(row("SPECIFIC", False, P.SPECIFIC))


def search_query(question: Column, previous: Column) -> Column:
    """The question, with the previous one appended unless it has six words of over three characters itself."""
    current = trim(question)
    long_words = F.size(F.filter(F.split(current, f"{WS}+"), lambda w: F.length(w) > 3))
    return F.when(previous.isNull() | (previous == "") | (long_words >= 6), current).otherwise(F.concat_ws(" ", current, trim(previous)))


def search_terms(c: Column) -> Column:
    """Distinct search terms: the first 24 words of over two letters or digits that are not stop words."""
    words = F.split(F.lower(c), r"[^\p{L}\p{N}]+")
    kept = F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(P.STOP_WORDS))
    return F.array_distinct(F.slice(kept, 1, 24))


def answer_mode(requested: Column, n_documents: Column, question: Column) -> Column:
    """RETRIEVAL or THOROUGH: always RETRIEVAL over several documents, else what was asked for, else THOROUGH if the question needs the whole document."""
    whole = F.when(classify_question(question)["whole_document"], "THOROUGH").otherwise("RETRIEVAL")
    return F.when(n_documents > 1, "RETRIEVAL").otherwise(F.coalesce(requested, whole))


def any_match(c: Column, rules: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (c.rlike(java(p)) for p in rules))


def has_citation(c: Column) -> Column:
    return c.rlike(r"\[[0-9]{1,2}\]")


def looks_not_found(c: Column) -> Column:
    """Whether an answer reports absence; one that cites something never does."""
    text = trim(c)
    return (text != "") & ~has_citation(text) & any_match(text, P.NOT_FOUND)


def claims_absence(c: Column) -> Column:
    return any_match(c, P.ABSENCE)


def citation_markers(c: Column) -> Column:
    """Distinct citation numbers of an answer, sorted."""
    numbers = F.transform(F.regexp_extract_all(c, F.lit(r"\[([0-9]{1,2})\]"), F.lit(1)), lambda x: x.cast("int"))
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda n: n > 0)))


def strip_citations(c: Column) -> Column:
    return trim(F.regexp_replace(F.regexp_replace(c, r"\[[0-9]{1,2}\]", ""), " {2,}", " "))


def answer_status(message_status: Column, answer: Column, n_verified: Column) -> Column:
    return (
        F.when(message_status == "STOPPED", "PARTIAL")
        .when(message_status.isin("ERROR", "STREAMING"), F.lit(None).cast("string"))
        .when(n_verified > 0, "ANSWERED")
        .when(looks_not_found(answer), "NOT_FOUND")
        .when(trim(answer) == "", F.lit(None).cast("string"))
        .otherwise("UNSUPPORTED")
    )


def is_critical(title: Column, body: Column) -> Column:
    """Whether title and first 300 characters name a critical topic (as a substring)."""
    return once(F.lower(F.concat(title, F.lit(" "), F.substring(body, 1, 300))), lambda seen: reduce(lambda a, b: a | b, (seen.contains(t) for t in P.CRITICAL_TOPICS)))


def distinct_matches(c: Column, pattern: str) -> Column:
    """Trimmed matches in order, without repeats that differ in case only; the text is searched once."""
    found = F.transform(F.regexp_extract_all(c, F.lit(java(pattern)), F.lit(0)), trim)
    return once(found, lambda every: F.filter(every, lambda x, i: F.array_position(F.transform(every, F.lower), F.lower(x)) == i + 1))


def section_label(ref: Column, title: Column, ordinal: Column) -> Column:
    short = F.when(F.length(title) <= 40, title).otherwise(F.concat(F.substring(title, 1, 39), F.lit("…")))
    return F.when(F.coalesce(ref, F.lit("")) != "", ref).when(F.coalesce(title, F.lit("")) != "", short).otherwise(F.concat(F.lit("Part "), (ordinal + 1).cast("string")))


def safe_name(c: Column) -> Column:
    """Last path segment, at most 255 characters."""
    return F.substring(F.element_at(F.split(c, r"[\\/]"), -1), 1, 255)


def out_of_scope(c: Column) -> Column:
    """Why an instruction can't be a tracked change, else null."""
    text = F.lower(trim(c))
    some = lambda tests: reduce(lambda a, b: a | b, tests)
    new = some([*(text.startswith(s) for s in P.SCOPE_START), *(text.contains(w) for w in P.SCOPE_WORDS)])
    layout = some([*(text.startswith(s) for s in P.FORMAT_START), *(text.contains(w) for w in P.FORMAT_WORDS)])
    return F.when(new, P.OUT_OF_SCOPE_NEW).when(layout, P.OUT_OF_SCOPE_FORMAT)


_FEW = 12


def offsets(lengths: Column, gap: int = 0, run: int = 256) -> Column:
    """Offsets of the pieces of a text from their lengths, ``gap`` characters between neighbours.

    A few are summed anew for each piece; more are gathered in runs, since adding to an array copies it.
    """
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("run"), F.array().cast("array<array<int>>").alias("done"))

    def step(acc: Column, n: Column) -> Column:
        full = F.size(acc["run"]) >= run
        return F.struct(
            (acc["at"] + n + gap).alias("at"),
            F.when(full, F.array(acc["at"])).otherwise(F.concat(acc["run"], F.array(acc["at"]))).alias("run"),
            F.when(full, F.concat(acc["done"], F.array(acc["run"]))).otherwise(acc["done"]).alias("done"),
        )

    few = lambda ns: F.transform(ns, lambda _, i: F.aggregate(F.slice(ns, F.lit(1), i), i * gap, lambda at, n: at + n))
    many = lambda ns: F.aggregate(ns, zero, step, lambda acc: F.concat(F.flatten(acc["done"]), acc["run"]))
    return once(lengths, lambda ns: F.when(F.size(ns) <= _FEW, few(ns)).otherwise(many(ns)))


def _cut_before(hay: Column, needle: Column) -> Column:
    """The pieces of ``hay`` when it is cut before every place of ``needle``, overlapping ones included."""
    literal = F.replace(needle, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    return F.split(hay, F.concat(F.lit("(?=\\Q"), literal, F.lit("\\E)")), -1)


def occurrences(hay: Column, needle: Column) -> Column:
    """0-based places of ``needle`` in ``hay``, overlapping ones included; one pass over ``hay``."""
    starts = offsets(F.transform(_cut_before(hay, needle), lambda x: F.length(x)))
    found = F.filter(starts, lambda at, i: (i > 0) | F.startswith(hay, needle))
    return F.when((F.length(needle) > 0) & F.contains(hay, needle), found).otherwise(F.array().cast("array<int>"))


def count_occurrences(hay: Column, needle: Column) -> Column:
    """The number of places of ``needle`` in ``hay``, overlapping ones included."""
    n = F.size(_cut_before(hay, needle)) - 1 + F.startswith(hay, needle).cast("int")
    return F.when((F.length(needle) > 0) & F.contains(hay, needle), n).otherwise(0)


def straight_quotes(c: Column) -> Column:
    return F.translate(c, "‘’“”", "''\"\"")
