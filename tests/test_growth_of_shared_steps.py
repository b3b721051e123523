"""Steps that many queries share: what they must not do twice, and what they give on odd texts."""

import re

from pyspark.sql import functions as F

from clausemill import storage
from clausemill.functions import text as T
from clausemill.operators import compare, fulltext, redline, structure
from clausemill.plans import catalogue
from clausemill.plans import views as V
from clausemill.sources import docx, tracked


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_version_is_made_without_the_other(spark, data):
    """The base version was made beside the revised one, which a filter dropped afterwards."""
    for rows in (V.clauses(spark, data, "base"), V.view(spark, data, f"SELECT doc_id FROM ({V.CLAUSES}) WHERE version = 'base'")):
        assert "Union" not in plan(rows)
    both = V.clauses(spark, data).where("version = 'base'")
    assert both.exceptAll(V.clauses(spark, data, "base")).count() == 0 < both.count() == V.clauses(spark, data, "base").count()
    revised = V.clauses(spark, data).where("version = 'revised'")
    assert revised.exceptAll(V.clauses(spark, data, "revised")).count() == 0 < revised.count()


def test_bare_and_fold_on_plain_and_odd_texts(spark):
    texts = ["", " ", "A, b; C.", "x  -  y", "the 'End'_of [it] ^ ` {a|b}~ \\ @ 7%", "tab\there,\nand there", "Straße – §4", " wide ", "a! !b", " ﻿. "]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    wide = T.fold(F.regexp_replace(F.lower("t"), r"[^A-Za-z0-9_\t-\r \x{A0}]", ""))
    rows = df.select("t", T.bare(F.col("t")).alias("got"), wide.alias("want"), T.fold(F.col("t")).alias("f")).collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]
    assert {r["t"]: r["f"] for r in rows}["x  -  y"] == "x - y" and {r["t"]: r["f"] for r in rows}[" wide "] == "wide"


def test_edits_are_located_without_a_shuffle_by_more_than_the_document(spark):
    """Texts were joined to the edits three times and everything was computed twice, for the overlaps and for the rest."""
    pars = spark.createDataFrame([(1, i, f"aa aaa {i} “x” b", None if i == 3 else i == 2) for i in range(4)] + [(2, 0, None, False)], "doc_id int, paragraph int, text string, has_revisions boolean")
    edits = [(1, 1, "aaa 0", "y"), (1, 2, "aa 0 \"x\"", "z"), (1, 3, "aa", "q"), (1, 4, "2 ", "q"), (1, 5, "3 ", "q"), (1, 6, "", "q"), (1, 7, "b\n\naa", "q"), (1, 8, "x” b", "q"), (1, 9, "a 0 ", "r"), (2, 1, "a", "b"), (3, 1, "a", "b"), (3, 2, "a", " a")]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = redline.locate(spark.createDataFrame(edits, "doc_id int, edit_id int, find string, replace string"), pars)
        assert plan(got).split("Initial Plan")[0].count("Exchange hashpartitioning") == 2
        rows = {(r["doc_id"], r["edit_id"]): (r["reason"] or r["status"], r["paragraph"], r["start"], r["end"]) for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    none = (None, None, None)
    assert rows == {
        (1, 1): ("APPLICABLE", 0, 3, 8), (1, 2): ("OVERLAPS", 0, 4, 12), (1, 3): ("AMBIGUOUS:12", *none), (1, 4): ("HAS_EXISTING_REVISIONS", 2, 7, 9), (1, 5): ("APPLICABLE", 3, 7, 9),
        (1, 6): ("CROSS_PARAGRAPH", *none), (1, 7): ("CROSS_PARAGRAPH", *none), (1, 8): ("AMBIGUOUS:4", *none), (1, 9): ("OVERLAPS", 0, 5, 9), (2, 1): ("NOT_FOUND", *none), (3, 1): ("NOT_FOUND", *none), (3, 2): ("NO_OP", *none),
    }


def test_equal_texts_are_one_operation(spark):
    rows = spark.createDataFrame([("a b", "a b"), ("", ""), (None, None), (None, "a"), ("a b", "a c")], "text string, accepted string")
    ops = [[tuple(o) for o in r["ops"]] for r in redline.word_diff(rows).collect()]
    assert ops == [[("equal", "a b")], [], [], [("insert", "a")], [("equal", "a "), ("delete", "b"), ("insert", "c")]]


def test_only_chunks_of_asked_documents_are_cut_into_words(spark):
    """All chunks were cut into words and joined with their stems before those of other documents went."""
    chunks = spark.createDataFrame([(d, c, "Head", f"fees of {d}") for d in (1, 2, 3, None) for c in range(2)], "doc_id int, chunk int, heading string, text string")
    asked = spark.createDataFrame([(2, "fee"), (2, "head")], "doc_id int, lexeme string")
    assert "LeftSemi" in plan(fulltext.postings(chunks, asked).where("true")).split("Generate")[-1]
    want = sorted(map(str, fulltext.postings(chunks).where("doc_id = 2 and lexeme in ('fee', 'head')").collect()))
    assert sorted(map(str, fulltext.postings(chunks, asked).collect())) == want


def test_pages_are_cleaned_row_by_row(spark, data):
    """An Arrow batch held 10,000 pages in a worker at once."""
    from clausemill.operators import ingest

    pages = spark.read.parquet(f"{data}/pages.parquet")
    rows = pages.select("html", ingest.sanitized(F.col("html")).alias("got"))
    assert "BatchEvalPython" in plan(rows) and "ArrowEvalPython" not in plan(rows)
    assert all(r["got"] == ingest.clean_html(r["html"])[0] for r in rows.collect())


def dealings(df):
    return re.findall(r"Exchange (?:hash|range|round)\w*\(([^)]*)", plan(df))


def test_packages_are_checked_in_their_own_row(spark, data, monkeypatch):
    """Packages were stored, then dealt three times with all texts; the contract's line items were dealt nine times."""
    monkeypatch.setattr(storage, "settle_all", None)
    for query in (catalogue.redline_written, catalogue.redline_validate):
        assert all("content" not in x for x in dealings(query(spark, data))) and len(dealings(query(spark, data))) <= 2


def test_checked_edits_are_those_of_written_files(spark):
    runs = {"a": [[("Pay AED 5", "b"), (" now", "")], [("Then <rest> & more", "l")]], "b": [[("No edit", "")]], "c": [[("Other text", "")]], "d": []}
    ops = {"a": [(0, 4, "AED 5", "USD 1"), (1, 5, "<rest>", "&stop")], "b": None, "c": [(0, 0, "Pay", "x")], "d": None}
    kinds = "path string, runs array<array<struct<text:string,marks:string>>>, ops array<struct<paragraph:int,start:int,find:string,replace:string>>"
    docs = spark.createDataFrame([(k, runs[k], ops[k]) for k in runs], kinds).coalesce(1)
    got = {r["path"]: [tuple(s) for s in r["states"]] for r in docx.check_edits(docs).collect()}
    files = {k: docx.build(runs[k]) for k in runs}
    want = {k: [(i, *s) for i, s in enumerate(tracked.states(files[k], tracked.track(files[k], ops[k] or [])))] for k in "abd"} | {"c": [(-1, None, None, None)]}
    assert got == want and want["a"][0][1:] == ("Pay AED 5 now", "Pay AED 5 now", "Pay USD 1 now")


def test_clauses_and_pages_are_made_where_their_line_items_lie(spark, data):
    """Texts of both versions were dealt once more for each document, and pages four times."""
    for query in (catalogue.segment_clauses, catalogue.align_clauses, catalogue.clause_moves, catalogue.boilerplate):
        got = dealings(query(spark, data))
        assert len(got) == 1 and "Join" not in plan(query(spark, data)), (query.__name__, got)
    for sql, rows in ((V.CLAUSES, V.clauses(spark, data)), (V.PAGES, V.page_lines(spark, data)), (catalogue._SHUFFLED, catalogue._shuffled(spark, data)), (catalogue._EDITS, catalogue._edits(spark, data))):
        want = spark.sql(sql, lineitem=spark.read.parquet(f"{data}/lineitem.parquet"))
        assert want.dtypes == rows.dtypes and want.exceptAll(rows).count() == rows.exceptAll(want).count() == 0 < rows.count()


def test_scans_read_only_contracts_that_are_asked_about(spark, data, monkeypatch):
    """The chunks of all contracts were stored, and the texts of all of them made, for questions about a few."""
    stored, made = [], []
    settle, docs = catalogue.settle, V.contract_docs
    monkeypatch.setattr(catalogue, "settle", lambda df, label: stored.append(df) or settle(df, label))
    monkeypatch.setattr(V, "contract_docs", lambda *args: made.append(docs(*args)) or made[-1])
    assert catalogue.thorough_answers(spark, data).count() > 0
    asked = {r[0] for r in V.view(spark, data, catalogue._FTS_QUERIES).select("doc_id").distinct().collect()}
    for df in (stored[0], made[0]):
        assert {r[0] for r in df.select("doc_id").distinct().collect()} <= asked


def test_page_edges_with_gaps(spark):
    rows = [(d, p, n, t) for d, pages in ((1, (1, 2, 3, 4, None)), (2, (1, 2, 3)), (None, (1, 2, 3, 4))) for p in pages for n, t in ((0, " Top  LINE"), (1, f"Body {d} {p} of words enough"), (2, f"Page {p}"))]
    rows += [(1, 4, 3, "   "), (3, 1, 0, "Same"), (3, 2, 0, ""), (3, 3, 0, "same"), (3, 4, 0, None), (3, 5, 0, "SAME")]
    df = spark.createDataFrame(rows, "doc_id int, page int, line int, line_text string")
    got = {tuple(r) for r in structure.boilerplate(df).collect()}
    assert got == {(1, p, 0, "exact") for p in (1, 2, 3, 4, None)} | {(1, p, 2, "marker") for p in (1, 2, 3, 4)} | {(3, p, 0, "exact") for p in (1, 3, 5)}


def test_alignment_of_odd_sides(spark):
    kinds = "doc_id int, version string, ordinal int, ref string, title string, body string"
    rows = [(1, "base", 1, None, "A", "Alpha beta"), (1, "base", 2, None, None, "Gamma delta"), (1, "revised", 5, "x", "A", "ALPHA beta"), (1, "revised", 7, None, None, "Gamma  delta"), (2, "base", 3, None, "B", "Only base"), (3, "revised", 4, "4", None, "Only revised"), (3, "other", 1, None, "C", "no side")]
    got = sorted(tuple(r) for r in compare.align(spark.createDataFrame(rows, kinds)).collect())
    assert got == [(1, 1, "COSMETIC", 1, 5, None, "x", 0.99), (1, 2, "UNCHANGED", 2, 7, "1", "1", 1.0), (2, 1, "REMOVED", 3, None, None, None, 0.0), (3, 1, "ADDED", None, 4, None, "4", 0.0)]


def test_edited_documents_hold_the_applicable_edits(spark):
    texts = ["The “Cap” is 5, the fee 5.", "Pay 'Cap' now", "none", "", None]
    pars = [(d, p, texts[(d + p) % 5], (d * p) % 4 == 1) for d in range(12) for p in range(1, 4)]
    finds = [("Cap", "cap"), ('"Cap"', "x"), ("5", "6"), ("fee", "sum"), ("the fee", "y"), ("Pay", " Pay "), ("", "z"), (None, "z"), ("now", None), ("no such", "a"), ("is 5, the", "b")]
    edits = [(d, 100 * d + (7 * i) % 11, *finds[i]) for d in range(1, 14) for i in range(11) if (d + i) % 3]
    pars, edits = spark.createDataFrame(pars, "doc_id int, paragraph int, text string, has_revisions boolean"), spark.createDataFrame(edits, "doc_id int, edit_id int, find string, replace string")
    got = {(r["doc_id"], *tuple(o)) for r in redline.edited_documents(edits, pars).collect() for o in r["ops"] or []}
    want = {tuple(r) for r in redline.located(edits, pars).where("status = 'APPLICABLE'").select("doc_id", "paragraph", "start", "end", "replace").collect()}
    assert got == want and len(want) > 5
    assert redline.edited_documents(edits, pars).count() == 12
