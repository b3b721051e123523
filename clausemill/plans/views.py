"""Contract-shaped tables derived from the order tables by one SQL text that both engines run.

``{name}`` stands for a base table.  Every text is a plain projection or window
over an equi-key, so Catalyst sees ordinary SQL.

Clauses and pages have a second text for Spark, with the same rows: line items
are dealt once, by contract or by bundle, with their own columns alone, and all
texts are made where they lie, so no made text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.session import table
from clausemill.storage import spread

_TOPICS = ("PAYMENT", "TERM", "LIMITATION OF LIABILITY", "CONFIDENTIALITY", "TERMINATION", "NOTICES", "GOVERNING LAW", "ENTIRE AGREEMENT")
_LAWS = ("DIFC", "ADGM", "Dubai", "Abu Dhabi", "England and Wales")


def _pick(key: str, values: tuple[str, ...]) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


_FACTS = f"""SELECT l_orderkey AS doc_id,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS INT) AS ordinal,
  {_pick('l_suppkey', _TOPICS)} AS topic, CASE WHEN l_returnflag = 'A' THEN 'may' ELSE 'shall' END AS modal,
  CAST(floor(l_extendedprice) AS BIGINT) AS amount, CAST(floor(l_discount * 100 + 0.5) AS INT) AS pct, CAST(l_quantity AS INT) AS days,
  {_pick('l_partkey', _LAWS)} AS law
FROM {{lineitem}}"""

_BODY = "'The Supplier ' || {modal} || ' pay AED ' || CAST({amount} AS STRING) || ' with interest of ' || CAST({pct} AS STRING) || ' per cent. of the fee, within ' || CAST({days} AS STRING) || ' days. It is governed by the laws of ' || {law} || '{end}'"
_TITLE = "topic || ' ' || chr(64 + ordinal)"
_SAME = {"modal": "modal", "amount": "amount", "pct": "pct", "days": "days", "law": "law", "end": "."}


def _body(**changes: str) -> str:
    return _BODY.format(**(_SAME | changes))


#: Clauses of both versions.  Edits of the revised one go by (doc_id + ordinal) % 12: amount, modal, law, days, percentage, punctuation, deletion, insertion.
_KEYED = f"WITH facts AS ({_FACTS}), keyed AS (SELECT *, (doc_id + ordinal) % 12 AS edit FROM facts)\n"
_BASE = f"""SELECT doc_id, 'base' AS version, ordinal, CAST(ordinal AS STRING) AS ref, {_TITLE} AS title, {_body()} AS body FROM keyed"""
_REVISED = f"""SELECT doc_id, 'revised' AS version, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ordinal, extra) AS INT) AS ordinal, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ordinal, extra) AS STRING) AS ref, title, body FROM (
  SELECT doc_id, ordinal, 0 AS extra, {_TITLE} AS title, CASE edit
    WHEN 0 THEN {_body(amount='amount + 1000')} WHEN 1 THEN {_body(modal="CASE modal WHEN 'may' THEN 'shall' ELSE 'may' END")}
    WHEN 2 THEN {_body(law="CASE law WHEN 'DIFC' THEN 'ADGM' ELSE 'DIFC' END")} WHEN 3 THEN {_body(days='days + 15')}
    WHEN 4 THEN {_body(pct='pct + 1')} WHEN 5 THEN {_body(end='')} ELSE {_body()} END AS body
  FROM keyed WHERE edit <> 6
  UNION ALL SELECT doc_id, ordinal, 1, 'SCHEDULE ' || chr(64 + ordinal), 'Each party may inspect the records upon ' || CAST(days AS STRING) || ' days notice.' FROM keyed WHERE edit = 7
) x"""
CLAUSES = f"{_KEYED}{_BASE}\nUNION ALL\n{_REVISED}"
#: The same, one version alone: a filter on the version stays above the windows, so the other one would be made and dropped.
VERSIONS = {"base": _KEYED + _BASE, "revised": _KEYED + _REVISED}

#: One text per document and version: heading line, body line, blank line.
LINE = "ref || '. ' || title || chr(10) || body"
DOCS_RE2 = f"WITH clauses AS ({CLAUSES}) SELECT doc_id, version, string_agg({LINE}, chr(10) || chr(10) ORDER BY ordinal) AS full_text FROM clauses GROUP BY doc_id, version"

#: Up to 32 neighbouring contracts make a document, so documents grow in number, not in size.
_BUNDLE = "CAST(floor(doc_id / 32) AS BIGINT)"
#: Pages of three clauses each of the base version, with a running header and a numbered footer; each 7th page is empty.
PAGES = f"""WITH clauses AS ({CLAUSES}), base AS (SELECT {_BUNDLE} AS doc_id, row_number() OVER (PARTITION BY {_BUNDLE} ORDER BY doc_id, ordinal) AS n, body FROM clauses WHERE version = 'base'),
numbered AS (SELECT doc_id, CAST((n - 1 - (n - 1) % 3) / 3 + 1 AS INT) AS page, (n - 1) % 3 AS pos, body FROM base)
SELECT doc_id, page, pos + 1 AS line, CASE WHEN (doc_id + page) % 7 = 0 THEN '' ELSE body END AS line_text FROM numbered
UNION ALL SELECT doc_id, page, 0, CASE WHEN (doc_id + page) % 7 = 0 THEN '' ELSE 'CONFIDENTIAL -  Draft' END FROM numbered GROUP BY doc_id, page
UNION ALL SELECT doc_id, page, 9, CASE WHEN (doc_id + page) % 7 = 0 THEN '' ELSE 'Page ' || CAST(page AS STRING) || ' of 99' END FROM numbered GROUP BY doc_id, page"""

# --- the same for Spark

#: The columns of a line item that say its place in a contract; what a clause says is made of them.
_PLACE = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus")
_BY_PLACE = ", ".join(_PLACE)
_SAYS = f"""{_pick('l_suppkey', _TOPICS)} AS topic, CASE WHEN l_returnflag = 'A' THEN 'may' ELSE 'shall' END AS modal, CAST(floor(l_extendedprice) AS BIGINT) AS amount,
  CAST(floor(l_discount * 100 + 0.5) AS INT) AS pct, CAST(l_quantity AS INT) AS days, {_pick('l_partkey', _LAWS)} AS law"""
_PLACED = f"SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY {_BY_PLACE}) AS INT) AS ordinal FROM {{items}}"
_BASE_DEALT = f"SELECT doc_id, 'base' AS version, ordinal, CAST(ordinal AS STRING) AS ref, {_TITLE} AS title, {_body()} AS body FROM (SELECT doc_id, ordinal, {_SAYS} FROM ({_PLACED}))"
#: ``last`` is the place of an item's last clause in the revised version; ``kind`` is -1 for its base clause, 0 for its revised one, 1 for what is inserted after it.
_KINDS_DEALT = f"""SELECT doc_id, ordinal, last, kind, CASE WHEN kind = 0 THEN edit ELSE -1 END AS edit, edit = 7 AND kind = 0 AS followed, {_SAYS} FROM (
  SELECT *, CAST(sum(CASE WHEN edit = 7 THEN 2 WHEN edit <> 6 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY {_BY_PLACE} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INT) AS last
  FROM (SELECT *, (doc_id + ordinal) % 12 AS edit FROM ({_PLACED}))) LATERAL VIEW explode({{kinds}}) k AS kind"""
_CHANGED = {
    "amount": "(amount + CASE WHEN edit = 0 THEN 1000 ELSE 0 END)", "modal": "CASE WHEN edit <> 1 THEN modal WHEN modal = 'may' THEN 'shall' ELSE 'may' END", "law": "CASE WHEN edit <> 2 THEN law WHEN law = 'DIFC' THEN 'ADGM' ELSE 'DIFC' END",
    "days": "(days + CASE WHEN edit = 3 THEN 15 ELSE 0 END)", "pct": "(pct + CASE WHEN edit = 4 THEN 1 ELSE 0 END)", "end": "' || CASE WHEN edit = 5 THEN '' ELSE '.' END || '",
}
_CLAUSES_DEALT = f"""SELECT doc_id, version, ordinal, CAST(ordinal AS STRING) AS ref, title, body FROM (
  SELECT doc_id, CASE WHEN kind < 0 THEN 'base' ELSE 'revised' END AS version, CASE WHEN kind < 0 THEN ordinal WHEN followed THEN last - 1 ELSE last END AS ordinal, CASE WHEN kind = 1 THEN 'SCHEDULE ' || chr(64 + ordinal) ELSE {_TITLE} END AS title,
    CASE WHEN kind = 1 THEN 'Each party may inspect the records upon ' || CAST(days AS STRING) || ' days notice.' ELSE {_body(**_CHANGED)} END AS body FROM ({_KINDS_DEALT}))"""
_DEALT = {
    None: _CLAUSES_DEALT.replace("{kinds}", "CASE WHEN edit = 7 THEN array(-1, 0, 1) WHEN edit <> 6 THEN array(-1, 0) ELSE array(-1) END"),
    "base": _BASE_DEALT,
    "revised": _CLAUSES_DEALT.replace("{kinds}", "CASE WHEN edit = 7 THEN array(0, 1) WHEN edit <> 6 THEN array(0) ELSE array() END"),
}
#: The first clause of a page brings its header and its footer.
_PAGES_DEALT = f"""SELECT doc_id, page, line, CASE WHEN (doc_id + page) % 7 = 0 THEN '' WHEN line = 0 THEN 'CONFIDENTIAL -  Draft' WHEN line = 9 THEN 'Page ' || CAST(page AS STRING) || ' of 99' ELSE {_body()} END AS line_text FROM (
  SELECT doc_id, CAST((n - 1 - (n - 1) % 3) / 3 + 1 AS INT) AS page, (n - 1) % 3 AS pos, {_SAYS} FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY contract, {_BY_PLACE}) AS n FROM {{items}})
) LATERAL VIEW explode(CASE WHEN pos = 0 THEN array(0, 1, 9) ELSE array(pos + 1) END) l AS line"""

_SUBJECTS = ("indemnity", "payment", "notice", "insurance", "audit")
#: Questions by template over conversations: one per turn.
QUESTIONS = f"""SELECT conv_id, turn, role, CASE (conv_id + turn) % 12
  WHEN 0 THEN 'Is there a ' || subject || ' clause?' WHEN 1 THEN 'List all ' || subject || ' obligations' WHEN 2 THEN 'What is the ' || subject || ' period after the agreement has been signed by both parties?'
  WHEN 3 THEN 'How many ' || subject || ' dates are set' WHEN 4 THEN '  and what about ' || subject || '?  ' WHEN 5 THEN 'What does the contract say about ' || subject || '?'
  WHEN 6 THEN 'Does the contract mention ' || subject || '?' WHEN 7 THEN 'Is any ' || subject || ' provision missing?' WHEN 8 THEN 'Summarise the whole ' || subject
  WHEN 9 THEN 'Explain whether the lease includes ' || subject WHEN 10 THEN '' ELSE 'Which party pays for ' || subject || ' and when?' END AS question
FROM (SELECT conv_id, turn, role, {_pick('(conv_id * 7 + turn)', _SUBJECTS)} AS subject FROM {{conversations}}) q"""

#: Answers by template, with message status and the number of verified quotes.
ANSWERS = f"""SELECT conv_id, turn, CASE turn % 5 WHEN 4 THEN CASE conv_id % 3 WHEN 0 THEN 'STOPPED' WHEN 1 THEN 'ERROR' ELSE 'STREAMING' END ELSE 'COMPLETE' END AS status,
  CASE WHEN (conv_id + turn) % 4 = 0 THEN 1 ELSE 0 END AS n_verified,
  CASE (conv_id * 3 + turn) % 7 WHEN 0 THEN 'The ' || subject || ' is AED 500 [1] and the period 30 days [12].' WHEN 1 THEN 'There is no ' || subject || ' clause. The document does not mention it.'
  WHEN 2 THEN 'I could not find any information about ' || subject || '.' WHEN 3 THEN '   ' WHEN 4 THEN 'The cap is set [2]. The sections do not specify a sub-limit [2][3].'
  WHEN 5 THEN 'It was not found anywhere in the text.' ELSE 'The ' || subject || ' runs for two years.' END AS answer
FROM (SELECT conv_id, turn, {_pick('(conv_id * 5 + turn)', _SUBJECTS)} AS subject FROM {{conversations}}) q"""


TABLES = ("lineitem", "orders", "customer", "conversations", "documents", "events", "pages", "benchmark", "labels", "nation", "supplier", "part")


def view(spark: SparkSession, sf_dir: str, sql: str, **more: DataFrame) -> DataFrame:
    """The rows of a view text over the tables of a data folder, or over those given in their place."""
    sql = f"SELECT * FROM ({sql})" if sql in (CLAUSES, PAGES) else sql
    made = {f"({PAGES})": ("page_lines", lambda: page_lines(spark, sf_dir, more.get("lineitem")))}  # holds the text of the clauses
    made |= {f"({CLAUSES}) WHERE version = '{v}'": (f"{v}_clauses", lambda v=v: clauses(spark, sf_dir, v, more.get("lineitem"))) for v in VERSIONS}
    made[f"({CLAUSES})"] = ("all_clauses", lambda: clauses(spark, sf_dir, None, more.get("lineitem")))
    args = dict(more)
    for text, (name, rows) in made.items():
        if text in sql:
            sql, args[name] = sql.replace(text, f"{{{name}}}"), rows()
    return spark.sql(sql, **({n: table(spark, sf_dir, n) for n in TABLES if f"{{{n}}}" in sql} | {n: df for n, df in args.items() if f"{{{n}}}" in sql}))


def plain(sql: str) -> str:
    """The same text over plain table names."""
    for n in TABLES:
        sql = sql.replace(f"{{{n}}}", n)
    return sql


def clauses(spark: SparkSession, sf_dir: str, version: str | None = None, lineitem: DataFrame | None = None) -> DataFrame:
    """The rows of CLAUSES, or of one version, dealt by doc_id."""
    items = table(spark, sf_dir, "lineitem") if lineitem is None else lineitem
    return spark.sql(_DEALT[version], items=spread(items.select(F.col("l_orderkey").alias("doc_id"), *_PLACE), "doc_id"))


def page_lines(spark: SparkSession, sf_dir: str, lineitem: DataFrame | None = None) -> DataFrame:
    """The rows of PAGES, dealt by doc_id."""
    items = table(spark, sf_dir, "lineitem") if lineitem is None else lineitem
    items = items.select(F.floor(F.col("l_orderkey") / 32).alias("doc_id"), F.col("l_orderkey").alias("contract"), *_PLACE)
    return spark.sql(_PAGES_DEALT, items=spread(items, "doc_id"))


def contract_docs(spark: SparkSession, sf_dir: str, version: str | None = None, lineitem: DataFrame | None = None) -> DataFrame:
    """``(doc_id, version, full_text)``; a contract has few clauses, so its ordered list is small."""
    lines = clauses(spark, sf_dir, version, lineitem).select("doc_id", "version", F.struct("ordinal", F.expr(LINE).alias("x")).alias("c"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["x"]), "\n\n")
    return lines.groupBy("doc_id", "version").agg(joined.alias("full_text"))
