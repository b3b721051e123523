"""Personal data: four fixed formats, and candidates judged by boosted trees.

High-recall generators propose spans that may overlap.  Each proposal becomes a
row of format features (digits, separators, checksums) and context features
(words before and after it); boosted trees score it, and a threshold per kind,
calibrated on examples kept from training, selects.  The trees learn from
examples that are generated here by rule, ``EXAMPLES`` of them.
"""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausemill.llm.boosting import Boosted
from clausemill.llm.rows import per_text

#: Generated examples to learn from (a fourth of them calibrates), and the precision each kind must reach there.
EXAMPLES, PRECISION = 4_000, 0.97

# The base formats, in their listed order.
BASE_KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")  # a match never starts inside a run of digits: what fails at its start fails there too
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

# High-recall generators of the method's own kinds.
_GENERATORS = (
    ("email_words", re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,63} ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z]{2,}")),
    ("phone_local", re.compile(r"(?<![0-9.+-])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9-])")),
    ("national_id", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("account", re.compile(r"(?<![0-9.-])[0-9]{8,12}(?![0-9.-])")),
)
KINDS = tuple(k for k, _ in _GENERATORS)
# Context words, by what they speak for.
_CONTEXT = (
    ("phone", "tel", "call", "mobile", "fax", "cell"),
    ("mail", "contact", "write", "reach"),
    ("ssn", "social", "security", "tax id", "national"),
    ("iban", "account", "bank", "transfer", "routing"),
    ("order", "invoice", "version", "part", "serial", "isbn", "ticket", "ref", "build", "item"),
    ("date", "year", "page", "rows", "total", "price", "score"),
)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses: around each @, the run of local characters before it and the domain after it."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the fixed formats, sorted."""
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in m[0].split("."))]
        out += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out)


def proposals(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of all generators; spans may overlap."""
    out = []
    if _DIGIT.search(text):
        for k in range(1, len(_GENERATORS)):
            out += [(m.start(), k, m.end()) for m in _GENERATORS[k][1].finditer(text)]
    if "dot" in text:
        out += [(m.start(), 0, m.end()) for m in _GENERATORS[0][1].finditer(text)]
    return out


def features(text: str, span: tuple[int, int, int]) -> list[int]:
    """Format and context features of a proposal, each in 0..63."""
    s, k, e = span
    found, before, after = text[s:e], text[max(0, s - 40) : s].lower(), text[e : e + 20].lower()
    digits = _digits(found)
    letters = sum(c.isalpha() for c in found)
    area = int(digits[:3] or 0)
    iban = 0
    if k == 3:
        flat = found.replace(" ", "")
        iban = int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97
    row = [
        k, min(63, e - s), min(63, len(digits)), min(63, letters), min(63, e - s - len(digits) - letters), len(set(digits)),
        int(luhn(digits)) if digits else 0, int(iban == 1), int(area == 0 or area == 666 or area >= 900), int("(" in found), int("." in found), int(" " in found),
        int(before[-1:].isalnum()), int(before[-1:] in "#/$=_"), int(after[:1] in "%/$_"), sum(c.isdigit() for c in before[-10:]), sum(c.isdigit() for c in after[:10]),
    ]
    return row + [sum(w in before for w in words) for words in _CONTEXT] + [sum(w in after for w in words) for words in _CONTEXT[:1]]


def _examples(n: int, seed: int = 7) -> Iterator[tuple[str, tuple[int, int, int], int]]:
    """``(text, proposal, label)``: proposals inside generated sentences, true ones and look-alikes by turns."""
    rng = random.Random(seed)
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("aeioutnrslmdbc") for _ in range(rng.randint(2, 9)))
    prose = lambda: " ".join(word() for _ in range(rng.randint(2, 7)))

    def iban() -> str:
        country, body = rng.choice(("DE", "FR", "GB", "ES")), d(18)
        check = 98 - int(body + "".join(str(int(c, 36)) for c in country) + "00") % 97
        return f"{country}{check:02d}{body}"

    true = (
        lambda: (f"{word()}{rng.choice((' at ', ' (at) ', '[at]'))}{word()}{rng.choice((' dot ', ' (dot) ', '[dot]'))}com", ("mail me:", "contact", "write to", "reach me:")),
        lambda: (rng.choice(("({}) {}-{}", "{}-{}-{}", "{} {} {}", "{}.{}.{}")).format(d(3), d(3), d(4)), ("phone", "tel.", "call", "mobile:", "fax")),
        lambda: (f"{rng.randint(1, 665):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}", ("ssn", "social security", "national id", prose())),
        lambda: (iban(), ("iban", "account", "bank transfer to", prose())),
        lambda: (d(rng.randint(8, 12)), ("account", "bank account no", "phone", "call", "mobile")),
    )
    false = (
        lambda: (f"{word()} at {word()} dot {word()}", (prose(), "the", "look")),
        lambda: (rng.choice(("{}.{}.{}", "{} {} {}", "{}-{}-{}")).format(d(3), d(3), d(4)), ("version", "part", "order", "total", "serial", "rows", "$")),
        lambda: (f"{rng.choice((0, 666, 950)):03d}-{d(2)}-{d(4)}", ("part", "item", "order", prose())),
        lambda: (f"{rng.choice('ABCDEF')}{rng.choice('XYZ')}{d(2)}{d(rng.randint(8, 20))}", ("serial", "part", "build", prose())),
        lambda: (d(rng.randint(8, 12)), ("order", "invoice", "isbn", "ticket", prose(), "score", "date", "total")),
    )
    for i in range(n):
        label = i % 2
        found, cues = rng.choice((false, true)[label])()
        text = f"{prose()} {rng.choice(cues)} {found} {prose()}"
        at = text.index(found)
        for span in proposals(text):
            if span[0] < at + len(found) and at < span[2]:
                yield text, span, label


@functools.lru_cache(maxsize=1)
def model(examples: int = EXAMPLES) -> tuple[Boosted, tuple[float, ...]]:
    """The trees and each kind's threshold: the lowest score from which calibration examples reach PRECISION."""
    rows = list(_examples(examples))
    x, y = np.array([features(t, s) for t, s, _ in rows]), np.array([v for *_, v in rows])
    apart = np.arange(len(y)) % 4 == 3
    trees = Boosted().fit(x[~apart], y[~apart])
    raw, kind, thresholds = trees.raw(x[apart]), x[apart][:, 0], []
    for k in range(len(KINDS)):
        order = np.argsort(-raw[kind == k])
        scores, right = raw[kind == k][order], y[apart][kind == k][order].cumsum() / np.arange(1, len(order) + 1)
        good = np.flatnonzero(right >= PRECISION)
        thresholds.append(max(0.0, float(scores[good[-1]])) if len(good) else np.inf)
    return trees, tuple(thresholds)


def method_spans(texts: list[str], base: list[list[tuple[int, int, int]]], trained: tuple[Boosted, tuple[float, ...]]) -> list[list[tuple[int, int, int]]]:
    """Selected proposals of each text: over their kind's threshold, best first, none over another or over a base span."""
    rows = [(i, span) for i, t in enumerate(texts) for span in proposals(t)]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if rows:
        trees, thresholds = trained
        raw = trees.raw(np.array([features(texts[i], s) for i, s in rows]))
        taken: dict[int, list[tuple[int, int]]] = {}
        for score, i, (s, k, e) in sorted(((-v, i, s) for v, (i, s) in zip(raw, rows) if v >= thresholds[s[1]])):
            if i not in taken:
                taken[i] = sorted((a, b) for a, _, b in base[i])
            spans = taken[i]
            at = _place(spans, s)
            if (at == 0 or spans[at - 1][1] <= s) and (at == len(spans) or spans[at][0] >= e):
                spans.insert(at, (s, e))
                out[i].append((s, k, e))
    return out


def _place(spans: list[tuple[int, int]], start: int) -> int:
    from bisect import bisect_left

    return bisect_left(spans, (start, 0))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base, n_spans, spans)`` per row of ``docs``; base and spans list ``kind:start:end``.

    Null text counts as empty and has no spans.  Ids may be null or repeat.  An empty table gives no rows.  Other columns are not read.
    """
    trained = model()  # a few kilobytes, sent with the task

    def of(texts: list[str]) -> dict:
        base = [base_spans(t) for t in texts]
        more = method_spans(texts, base, trained)
        n = len(BASE_KINDS)
        out: dict[str, list] = {f"n_{k}": [sum(s[1] == i for s in b) for b in base] for i, k in enumerate(BASE_KINDS)}
        out["base"] = [",".join(f"{BASE_KINDS[k]}:{s}:{e}" for s, k, e in b) for b in base]
        every = [sorted([*b, *((s, n + k, e) for s, k, e in m)]) for b, m in zip(base, more)]
        out["n_spans"] = [len(spans) for spans in every]
        out["spans"] = [",".join(f"{(*BASE_KINDS, *KINDS)[k]}:{s}:{e}" for s, k, e in spans) for spans in every]
        return out

    return per_text(docs, of, "n_email bigint,n_ip bigint,n_card bigint,n_phone bigint,base string,n_spans bigint,spans string", id_col, text_col)


def pii_report(docs: DataFrame, **options) -> DataFrame:
    """:func:`find_pii` with the base list hashed."""
    found = find_pii(docs, **options)
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "n_spans", "spans")


def redact_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every found span replaced by its kind in brackets; all rows and columns stay, null text stays null."""
    trained = model()

    @F.pandas_udf("string")
    def redacted(texts):
        plain = [t or "" for t in texts]
        base = [base_spans(t) for t in plain]
        names = (*BASE_KINDS, *KINDS)
        out = []
        for t, b, m in zip(plain, base, method_spans(plain, base, trained)):
            parts, at = [], 0
            for s, k, e in sorted([*b, *((s, len(BASE_KINDS) + k, e) for s, k, e in m)]):
                if s >= at:
                    parts += [t[at:s], f"[{names[k].upper()}]"]
                at = max(at, e)
            out.append("".join([*parts, t[at:]]))
        return texts.where(texts.isna(), texts.__class__(out, index=texts.index, dtype=object))

    return docs.withColumn(text_col, redacted(F.col(text_col)))
