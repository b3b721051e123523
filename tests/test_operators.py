"""Operators on literal rows: one small case for each rule."""

import re
import io
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clausemill.functions import text as T
from clausemill.functions.format import format_bytes
from clausemill.operators import chat, compare, events, fulltext, ingest, ranges, redline, retrieve, structure, verify
from clausemill.sources import files
from clausemill.streaming import answers


def values(spark, fn, texts, *more):
    df = spark.createDataFrame([(i, t, *m) for i, (t, *m) in enumerate(texts if more else [(t,) for t in texts])], ", ".join(["i int", "t string", *more]))
    return [r["v"] for r in df.withColumn("v", fn).orderBy("i").collect()]


def test_classify_questions(spark):
    cases = {
        "Is there a termination clause?": "EXISTENCE", "Are any indemnity provisions included?": "EXISTENCE", "Does it mention insurance?": "EXISTENCE", "What does it say about rent?": "SPECIFIC",
        "What does the contract say about rent?": "SPECIFIC", "List all deadlines": "COMPLETENESS", "How many parties are there?": "COMPLETENESS", "Summarise the whole agreement": "COMPLETENESS",
        "When is rent due?": "SPECIFIC", "  ": "SPECIFIC", "Is the notice period omitted": "EXISTENCE",
    }
    got = values(spark, T.classify_question(F.col("t"))["intent"], list(cases))
    assert got == list(cases.values())


def test_headings(spark):
    got = values(spark, T.heading(F.col("t")), ["ARTICLE IV – Payment", "Section 5.2 Fees", "4.2.1 Exclusions", "(iv) each party", "LIMITATION OF LIABILITY", "THE END.", "see clause 4", "", "30 days after delivery", "A" * 130])
    assert [tuple(h) if h else None for h in got] == [("ARTICLE IV", "– Payment", 1), ("Section 5.2", "Fees", 2), ("4.2.1", "Exclusions", 3), ("iv", "each party", 3), (None, "LIMITATION OF LIABILITY", 1), None, None, None, ("30", "days after delivery", 1), None]


def test_segments_keep_the_preamble_and_cut_at_headings(spark):
    docs = spark.createDataFrame([(1, "Between A and B.\n\n1. TERM\nTwo years.  \n\n2. FEES\nAED 5."), (2, "no heading here"), (3, "   "), (4, None), (5, "1. ONLY\ntext")], "doc_id int, text string")
    rows = structure.segment_clauses(docs, ["doc_id"]).orderBy("doc_id", "ordinal").collect()
    assert [(r["doc_id"], r["ref"], r["start"], r["end"], r["body"]) for r in rows] == [
        (1, None, 0, 16, "Between A and B."), (1, "1", 18, 36, "TERM\nTwo years."), (1, "2", 40, 54, "FEES\nAED 5."), (2, None, 0, 15, "no heading here"), (5, "1", 0, 12, "ONLY\ntext"),
    ]


def test_boilerplate_needs_half_of_four_pages(spark):
    lines = [(1, p, n, t) for p in range(1, 7) for n, t in enumerate(["ACME  Draft", "", f"body {p} alpha beta gamma delta", "more", "x", "yy", "zz", f"Page {p} of 6"])]
    lines += [(2, p, 0, "Same") for p in range(1, 4)]
    rows = structure.boilerplate(spark.createDataFrame(lines, "doc_id int, page int, line int, line_text string")).collect()
    found = {(r["doc_id"], r["line"]) for r in rows}
    assert {(1, 0), (1, 7)} <= found and not any(d == 2 for d, _ in found) and (1, 2) not in found


def test_scan_verdict(spark):
    rows = [(1, p, 0) for p in range(1, 4)] + [(2, p, 0 if 12 <= p <= 14 else 900) for p in range(1, 31)] + [(3, 1, 20)]
    got = {r["doc_id"]: (r["n_scanned"], r["fully_scanned"]) for r in structure.scan_verdict(spark.createDataFrame(rows, "doc_id int, page int, text_chars int")).collect()}
    assert got == {1: (3, True), 2: (3, False), 3: (0, True)}


def test_page_ranges(spark):
    rows = spark.createDataFrame([(1, p) for p in (3, 4, 5, 41, 88, 89, 3)], "doc_id int, page int")
    assert structure.page_ranges(rows).first()["ranges"] == "3–5, 41, 88–89"


def test_chunks_cover_every_clause_in_budget(spark):
    text = "\n".join(f"{i}. TITLE {i}\n" + "Some words of a clause. " * (5 + i * 40) for i in range(1, 12))
    rows = structure.chunks(spark.createDataFrame([(1, text), (2, ""), (3, "plain")], "doc_id int, text string"), ["doc_id"], target=300).orderBy("doc_id", "chunk").collect()
    spans = [(r["start"], r["end"]) for r in rows if r["doc_id"] == 1]
    seen = set()
    for a, b in spans:
        seen |= set(range(a, b))
    assert all(i in seen for i, c in enumerate(text) if not c.isspace())
    assert {r["doc_id"] for r in rows} == {1, 3}


def test_quote_passes_and_reasons(spark):
    docs = spark.createDataFrame([(1, "The fee is  “AED 500”\nper month. Obli-\ngations survive. ONE two Three four. gluedwords here again"), (2, "   ")], "doc_id int, text string")
    cases = [
        (1, 1, 'fee is "AED 500" per month', "EXACT_WS"), (2, 1, "Obligations survive", "HYPHEN_BREAK"), (3, 1, "glued words here again", "WS_INSENSITIVE"), (4, 1, "one TWO three four", "CASE_INSENSITIVE"),
        (5, 1, "fee is AED 900", "NOT_FOUND"), (6, 1, "fee ... month", "INNER_ELLIPSIS"), (7, 1, "fee", "TOO_SHORT"), (8, 1, "x" * 1600, "TOO_LONG"), (9, 2, "anything at all", "EMPTY_DOCUMENT"), (10, 7, "anything at all", "UNKNOWN_DOCUMENT"),
        (11, 1, "“…per month…”", "INNER_ELLIPSIS"), (12, 1, "…“per month.”…", "EXACT_WS"),
    ]
    got = verify.verify(spark.createDataFrame([c[:3] for c in cases], "quote_id int, doc_id int, text string"), docs).collect()
    assert {r["quote_id"]: r["match_kind"] or r["reason"] for r in got} == {c[0]: c[3] for c in cases}


def test_offsets_end_inside_a_ligature(spark):
    pairs = spark.createDataFrame([(1, 1, "a  ﬁne­ day, A FINE DAY", "ﬁne day"), (2, 1, "straight “quotes” here", '"quotes"')], "quote_id int, doc_id int, text string, quote string")
    rows = {(r["quote_id"], r["start"], r["end"]) for r in verify.quote_offsets(pairs).collect()}
    assert rows == {(1, 3, 11), (2, 9, 17)}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\t-–“'ﬁ­​\xa0é", max_size=40))
def test_normalising_keeps_a_monotone_map_and_is_stable(text):
    norm, places = verify.normalize_with_map(text)
    assert len(norm) == len(places) and places == sorted(places) and all(0 <= p < len(text) for p in places)
    assert verify.normalize_with_map(norm)[0] == norm and norm == norm.strip()


def test_normalize_column_equals_the_map_form(spark):
    texts = ["  a \n\t b ", "“x” ‘y’ – —", "soft­hyphen zero​width", "nb\xa0sp", ""]
    assert values(spark, T.normalize(F.col("t")), texts) == [verify.normalize_with_map(t)[0] for t in texts]


def test_detectors(spark):
    rows = [
        ("FEES", "pay AED 100,000, and shall within thirty (30) days", "pay AED 250,000, and may within sixty (60) days"), ("X", "at 1.5% under DIFC law", "at 2 per cent. under ADGM law"), ("X", "pay $500", "pay $600"), ("X", "pay US$500 now", "pay US$600 now"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, h string, a string, b string")
    got = [[tuple(f) for f in r["f"]] for r in compare.with_findings(df, F.col("h"), F.col("a"), F.col("b")).withColumnRenamed("found", "f").orderBy("i").collect()]
    assert got[0] == [("MONEY", "AED 100,000", "AED 250,000", "HIGH"), ("OBLIGATION_FLIP", "mandatory (shall/must)", "optional (may)", "HIGH"), ("DURATION", "thirty (30) days", "sixty (60) days", "MEDIUM")]
    assert [f[0] for f in got[1]] == ["PERCENTAGE", "GOVERNING_LAW"] and got[2] == [] and got[3][0][1:3] == ("$500", "$600")


def test_alignment_finds_additions_removals_moves_and_edits(spark):
    bodies = {t: f"{t} body with several distinct {t}words and {t}terms" for t in ("alpha", "beta", "gamma", "delta", "omega")}
    base = [(1, "base", i, t.upper(), bodies[t]) for i, t in enumerate(("alpha", "beta", "gamma", "delta"), 1)]
    revised = [(1, "revised", i, t.upper(), bodies[t]) for i, t in enumerate(("delta", "alpha", "gamma", "omega"), 1)]
    revised[2] = (1, "revised", 3, "GAMMA", bodies["gamma"] + " changed")
    df = spark.createDataFrame(base + revised + [(2, "base", 1, "A", "same"), (2, "revised", 1, "A", "same")], "doc_id int, version string, ordinal int, title string, body string")
    rows = compare.align(df).orderBy("doc_id", "n").collect()
    got = [(r["type"], r["base_ordinal"], r["revised_ordinal"]) for r in rows if r["doc_id"] == 1]
    assert sorted(got, key=str) == sorted([("UNCHANGED", 1, 2), ("REMOVED", 2, None), ("MODIFIED", 3, 3), ("ADDED", None, 4), ("MOVED", 4, 1)], key=str)
    assert [r["type"] for r in rows if r["doc_id"] == 2] == ["UNCHANGED"]


def test_edits_are_decided_in_order(spark):
    pars = spark.createDataFrame([(1, 0, "The fee is “AED 5” and the term is two years", False), (1, 1, "two words, two words", False), (1, 2, "tracked text", True)], "doc_id int, paragraph int, text string, has_revisions boolean")
    edits = [(1, 1, "fee is \"AED 5\"", "cost"), (1, 2, "AED 5", "USD 1"), (1, 3, "two words", "x"), (1, 4, "tracked", "x"), (1, 5, "absent", "x"), (1, 6, "same ", " same"), (1, 7, "two years\n\ntwo", "x"), (1, 8, "term", "period")]
    located = redline.locate(spark.createDataFrame(edits, "doc_id int, edit_id int, find string, replace string"), pars)
    got = {r["edit_id"]: r["reason"] or r["status"] for r in located.collect()}
    assert got == {1: "APPLICABLE", 2: "OVERLAPS", 3: "AMBIGUOUS:2", 4: "HAS_EXISTING_REVISIONS", 5: "NOT_FOUND", 6: "NO_OP", 7: "CROSS_PARAGRAPH", 8: "APPLICABLE"}
    done = redline.accepted_texts(pars, located, spark.createDataFrame(edits, "doc_id int, edit_id int, find string, replace string"))
    rows = {r["paragraph"]: r for r in redline.simulate(redline.word_diff(done)).collect()}
    assert rows[0]["accepted"] == "The cost and the period is two years"
    assert all(r["if_accepted"] == r["accepted"] and r["if_rejected"] == r["text"] for r in rows.values())


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab \n", max_size=30), st.text(alphabet="ab \n", max_size=30))
def test_word_ops_are_lossless(a, b):
    ops = redline.word_ops(a, b)
    assert "".join(t for o, t in ops if o != "insert") == a and "".join(t for o, t in ops if o != "delete") == b


def test_quote_payloads(spark):
    raws = ['[{"n":1,"text":"a"}]', '```json\n[{"n":"2","doc":"D1","text":"b"}]\n```', '{"quotes":[{"n":3,"text":"c"}]}', 'Sure: [{"n":4,"text":"d"},] ok', '[{"n":"x","text":"bad"},{"n":5,"text":"e"}]', "nothing", "  "]
    got = values(spark, chat.parse_quotes(F.col("t")), raws)
    assert [None if g is None else [tuple(q) for q in g] for g in got] == [[(1, None, "a")], [(2, "D1", "b")], [(3, None, "c")], [(4, None, "d")], [(5, None, "e")], None, []]


def test_answer_status(spark):
    rows = [("STOPPED", "x", 0), ("ERROR", "x", 0), ("COMPLETE", "x [1]", 1), ("COMPLETE", "It does not mention rent.", 0), ("COMPLETE", "It does not mention rent [1].", 0), ("COMPLETE", " ", 0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, s string, a string, n int").withColumn("v", T.answer_status(F.col("s"), F.col("a"), F.col("n")))
    assert [r["v"] for r in df.orderBy("i").collect()] == ["PARTIAL", None, "ANSWERED", "NOT_FOUND", "UNSUPPORTED", None]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab -QUOTES\n", max_size=8), max_size=8), st.booleans())
def test_stream_split_does_not_depend_on_the_chunking(parts, delimited):
    whole = "".join(parts) + (chat.DELIMITER + "[1]" if delimited else "")
    for size in (1, 3, len(whole) or 1):
        pending, quotes, found, out = "", "", False, ""
        cuts = [whole[i : i + size] for i in range(0, len(whole), size)] or [""]
        for i, c in enumerate(cuts):
            delta, pending, quotes, found = answers.push(pending, quotes, found, c, i == len(cuts) - 1)
            out += delta
        at = whole.find(chat.DELIMITER)
        assert out == (whole[:at] if at >= 0 else whole).rstrip()
        assert quotes == (whole[at + len(chat.DELIMITER) :] if at >= 0 else "")


def test_streamed_answers(spark, tmp_path):
    schema = "message_id long, seq int, chunk string, last boolean"
    parts = ["The cap is ", "AED 5. \n--", "-QUOTES---[{", '"n":1}]']
    spark.createDataFrame([(1, i, c, i == 3) for i, c in enumerate(parts)] + [(2, 0, "plain ", True)], schema).write.json(str(tmp_path / "in"))
    q = answers.split_stream(spark.readStream.schema(schema).json(str(tmp_path / "in"))).writeStream.format("memory").queryName("split_answers").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {r["message_id"]: (r["delta"], r["quotes_text"], r["done"]) for r in spark.table("split_answers").collect()}
    assert got == {1: ("The cap is AED 5.", '[{"n":1}]', True), 2: ("plain", "", True)}


def test_files_are_processed_as_they_arrive(spark, tmp_path):
    """Final states of every kind of file; a micro-batch that runs again replaces its rows."""
    import zlib as z

    from clausemill.streaming import jobs

    inside, out = tmp_path / "in", tmp_path / "out"
    inside.mkdir()
    (inside / "a.txt").write_text("1. TERM\nTwo years.")
    (inside / "scan.pdf").write_bytes(b"%PDF-1.7 x")
    shown = b"".join(b"BT /F1 12 Tf 1 0 0 1 50 %d Tm (%s) Tj ET\n" % (700 - 20 * i, t) for i, t in enumerate((b"1. TERM", b"The agreement lasts for two years.", b"2. FEES", b"AED 5 a month.")))
    (inside / "text.pdf").write_bytes(b"%PDF-1.7\n1 0 obj << /Filter /FlateDecode " + b"/X 1 " * 100 + b">> stream\n" + z.compress(shown) + b"\nendstream")
    (inside / "good.docx").write_bytes(docx("<w:p><w:r><w:t>1. SCOPE</w:t></w:r></w:p>", "<w:p><w:r><w:t>All of it.</w:t></w:r></w:p>"))
    (inside / "empty.docx").write_bytes(docx("<w:p/>"))
    (inside / "broken.docx").write_bytes(docx("<w:p/>")[:-40])
    run = jobs.process_files(spark, str(inside), str(out), str(tmp_path / "cp"))
    q = run.start()
    q.processAllAvailable()
    q.stop()
    read = lambda: {r["path"].rsplit("/", 1)[1]: (r["kind"], r["status"], r["error_code"]) for r in spark.read.parquet(str(out / "documents")).collect()}
    want = {
        "a.txt": ("rejected", "FAILED", "UNSUPPORTED_TYPE"), "scan.pdf": ("PDF", "FAILED", "SCANNED_DOCUMENT"), "text.pdf": ("PDF", "READY", None),
        "good.docx": ("DOCX", "READY", None), "empty.docx": ("DOCX", "FAILED", "EXTRACTION_FAILED"), "broken.docx": ("DOCX", "FAILED", "EXTRACTION_FAILED"),
    }
    assert read() == want
    headings = [(r["heading"], r["body"]) for r in spark.read.parquet(str(out / "clauses")).orderBy("path", "ordinal").collect()]
    assert sorted(h for h, _ in headings) == ["FEES", "SCOPE", "TERM"]
    q = jobs.process_files(spark, str(inside), str(out), str(tmp_path / "cp2")).start()  # a fresh checkpoint: the same first epoch again
    q.processAllAvailable()
    q.stop()
    assert read() == want and spark.read.parquet(str(out / "documents")).count() == 6 and spark.read.parquet(str(out / "clauses")).count() == 3


def test_token_bucket():
    assert events.grant([60, 30, 30], [0, 0, 0], 60) == [0, 30_000, 60_000]
    assert events.grant([600, 0, -1, 60], [0, 0, 0, 120_000], 60) == [0, 0, 0, 120_000]
    assert events.grant([7, 1, 1], [0, 0, 0], 7) == [0, 8572, 17_143]  # whole milliseconds; what a longer wait refills is kept
    assert events.grant([600_000, 1], [0, 0], 600_000) == [0, 25]  # the shortest wait


def test_budget_selection_skips_what_does_not_fit(spark):
    chunks = spark.createDataFrame([(1, 0, 500, 0.9), (1, 1, 600, 0.8), (1, 2, 400, 0.7), (1, 3, 50, None)], "doc_id int, chunk int, tokens int, score double")
    got = {r["chunk"]: r["selected"] for r in retrieve.select_budget(chunks, "doc_id", 950).collect()}
    assert got == {0: True, 1: False, 2: True, 3: True}
    batches = {r["chunk"]: r["batch"] for r in retrieve.batch_chunks(chunks, "doc_id", 550).collect()}
    assert batches == {0: 0, 1: 1, 2: 2, 3: 2}


def test_search_falls_back_to_any_term(spark):
    chunks = spark.createDataFrame([(1, i, h, t) for i, (h, t) in enumerate([("Fees", "fee and interest due"), (None, "interest only"), ("Definitions", "fee means"), (None, "nothing")])], "doc_id int, chunk int, heading string, text string")
    rows = fulltext.search(chunks, spark.createDataFrame([(1, 1, "fee interest")], "query_id int, doc_id int, question string")).orderBy("rank").collect()
    assert [(r["chunk"], r["mode"], round(r["score"], 9)) for r in rows] == [(2, "any", 0.12), (1, "any", 0.1), (0, "strict", 0.05)]
    assert [fulltext.stem(w) for w in ("parties", "running", "agreed", "fees", "class")] == ["parti", "run", "agre", "fee", "class"]


def test_sniffing(spark):
    ole, wide = bytes.fromhex("D0CF11E0A1B11AE1"), "WordDocument".encode("utf-16-le")
    cases = [(b"", "EMPTY_FILE"), (b"%PDF-1.4", "PDF"), (b"PK\3\4..word/document.xml", "DOCX"), (b"PK\3\4..", "UNSUPPORTED_TYPE"), (b"PK\5\6", "UNSUPPORTED_TYPE"), (ole + wide, "LEGACY_DOC_FORMAT"), (ole + "EncryptedPackage".encode("utf-16-le"), "ENCRYPTED_DOCX"), (ole, "UNSUPPORTED_TYPE"), (b"\x89PNG", "UNSUPPORTED_TYPE"), (b"PK\3\4" + bytes(200_000) + b"word/document.xml", "DOCX"), (None, "EMPTY_FILE")]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, c binary").withColumn("v", ingest.sniff(F.col("c"))).orderBy("i")
    assert [r["v"]["reason"] or r["v"]["kind"] for r in df.collect()] == [w for _, w in cases]


def test_html_keeps_leaf_blocks_only():
    html, blocks = ingest.clean_html('<div onclick="x"><p>One &amp; <b>two</b></p><script>bad()</script><table><tr><td colspan="2"><p>cell</p></td><td>bare  cell</td></tr></table><img src=x><p></p></div>')
    assert blocks == [("p", "One & two"), ("p", "cell"), ("td", "bare cell"), ("p", "")]
    assert "script" not in html and "onclick" not in html and "img" not in html and 'colspan="2"' in html


def test_separators(spark):
    items = [(1, 0, "a", 0.0, 700.0, 10.0, 10.0), (1, 1, "b", 10.5, 700.0, 10.0, 10.0), (1, 2, "c", 30.0, 700.0, 10.0, 10.0), (1, 3, " d", 60.0, 700.0, 10.0, 10.0), (1, 4, "e", 0.0, 680.0, 10.0, 10.0)]
    rows = ingest.separators(spark.createDataFrame(items, "page int, item int, str string, x double, y double, width double, height double")).orderBy("item").collect()
    assert [r["separator"] for r in rows] == ["", "", " ", "", "\n"]


def test_ranges(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 5, 9), (1, 20, 30), (1, 22, 25), (1, 40, 40)], "doc_id int, start int, end int")
    assert {(r["start"], r["end"]) for r in ranges.merge_ranges(df).collect()} == {(0, 9), (20, 30)}


def test_range_joins_never_become_nested_loops(spark):
    left = spark.range(10).selectExpr("id as doc_id", "cast(id as int) as start", "cast(id + 5 as int) as end")
    right = spark.range(10).selectExpr("id as doc_id", "cast(id as int) as r_start", "cast(id + 2 as int) as r_end")
    plan = ranges.range_join(left, right)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def docx(*paragraphs):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{''.join(paragraphs)}</w:body></w:document>")
        z.writestr("other.xml", "<x/>")
    return out.getvalue()


def test_docx_round_trip_of_tracked_changes(spark, tmp_path):
    source = docx("<w:p><w:r><w:t>Pay AED 5 now</w:t></w:r></w:p>", '<w:p><w:r><w:t>a</w:t><w:tab/></w:r><w:del w:id="7"><w:r><w:delText>x</w:delText></w:r></w:del></w:p>')
    assert [(p["text"], p["has_revisions"]) for p in files.docx_paragraphs_of(source)] == [("Pay AED 5 now", False), ("a\t", True)]
    changed = files.write_tracked(source, {0: redline.word_ops("Pay AED 5 now", "Pay AED 9 now")}, "Reviewer", "2026-01-01T00:00:00Z")
    (tmp_path / "c.docx").write_bytes(changed)
    rows = files.docx_paragraphs(files.binary_files(spark, str(tmp_path))).orderBy("paragraph").collect()
    assert rows[0]["text"] == "Pay AED 9 now" and rows[0]["has_revisions"]
    assert zipfile.ZipFile(io.BytesIO(changed)).read("other.xml") == b"<x/>"


def test_pdf_items():
    import zlib as z

    page = b"BT /F1 10 Tf 50 700 Td (Hello \\(you\\)) Tj 0 -12 Td (Next) Tj ET"
    packed = z.compress(b"BT /F1 8 Tf 1 0 0 1 20 30 Tm (Two) Tj ET")
    pdf = b"%PDF-1.4 1 0 obj <</Length 9>> stream\n" + page + b"\nendstream endobj 2 0 obj <</Filter /FlateDecode>> stream\n" + packed + b"\nendstream"
    got = [(i["page"], i["str"], i["x"], i["y"]) for i in files.pdf_items_of(pdf)]
    assert got == [(1, "Hello (you)", 50, 700), (1, "Next", 50, 688), (2, "Two", 20, 30)]


def test_server_events(spark):
    assert values(spark, files.server_events(F.col("t")), ["data: {\"a\":1}\n\n: ping\n\ndata: x\ndata: y\n\n"]) == [['{"a":1}', "x\ny"]]


@pytest.mark.parametrize("n, want", [(0, "0 B"), (1023, "1023 B"), (1536, "1.5 KB"), (20_480, "20 KB"), (5 << 20, "5.0 MB"), (3 << 40, "3072 GB")])
def test_format_bytes(spark, n, want):
    assert spark.range(1).select(format_bytes(F.lit(n)).alias("v")).first()["v"] == want


def test_normalize_column_equals_the_map_form_over_all_of_unicode(spark):
    points = [i for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000]
    texts = ["".join(f"x{chr(i)}y" for i in points[a : a + 500]) for a in range(0, len(points), 500)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)
    got = {r["i"]: r["n"] for r in rows.select("i", T.normalize(F.col("t")).alias("n")).collect()}
    spaces = re.compile("[\x1c-\x1f\x85]")  # white space to one library only
    wrong = [hex(points[500 * i + j]) for i, t in enumerate(texts) if got[i] != verify.normalize_with_map(t)[0] for j in range(500) if 500 * i + j < len(points) and not spaces.match(c := chr(points[500 * i + j])) and verify.normalize_with_map(f"x{c}y")[0] not in got[i]]
    assert not wrong


def test_occurrences_overlap_and_are_literal(spark):
    rows = [("aaaa", "aa"), ("a.b.c", "."), ("x\\Ey\\Ez", "\\E"), ("abc", ""), ("", "a"), ("abab", "ab"), ("😀a😀a", "a"), ("abc", "abcd"), (None, "a")]
    got = spark.createDataFrame(rows, "h string, n string").select("h", "n", T.occurrences(F.col("h"), F.col("n")).alias("at"), T.count_occurrences(F.col("h"), F.col("n")).alias("c")).collect()
    for r in got:
        want = [i for i in range(len(r["h"])) if r["n"] and r["h"].startswith(r["n"], i)] if r["h"] else []
        assert (r["at"], r["c"]) == (want, len(want)), r


def test_offsets_of_every_pass():
    text = "Intro. The ﬁnal  finding of ＡＢＣ holds; com-\n  pany law “applies” here."
    for quote, part in (
        ("the final finding of ABC holds", "The ﬁnal  finding of ＡＢＣ holds"), ("company law", "com-\n  pany law"), ("findingofABCholds", "finding of ＡＢＣ holds"), ('"applies" here', "“applies” here"), ("FINAL FINDING", "ﬁnal  finding"), ("no such words", None),
    ):
        found = verify.places_of(text, quote)
        assert ([text[a:b] for a, b in found] == [part]) if part else found == []
    assert verify.places_of("", "quote") == [] == verify.places_of("text", "")
    assert verify.places_of("ﬁ ﬁ", "fi fi") == [(0, 3)] and verify.places_of("aﬁ", "af") == [(0, 2)]


def test_quotes_are_found_through_ligatures_and_without_a_nested_loop(spark):
    docs = spark.createDataFrame([(1, "It says: the ﬁnal finding of ＡＢＣ holds."), (2, "nothing of the kind"), (3, None), (4, "com-\n pany meetings com- pany")], "doc_id int, text string")
    quotes = spark.createDataFrame([(10, "the final finding of ABC holds"), (11, "company meetings"), (12, "THE FINAL FINDING"), (13, "short"), (14, None)], "quote_id int, text string")
    found = verify.find_quotes(docs, quotes)
    assert sorted(tuple(r) for r in found.collect()) == [(10, 1, "EXACT_WS", 1), (11, 4, "HYPHEN_BREAK", 1), (12, 1, "CASE_INSENSITIVE", 1)]
    assert "NestedLoop" not in found._jdf.queryExecution().toString()
    assert verify.find_quotes(docs, quotes.where("quote_id = 13")).count() == 0


def test_lists_inside_list_items_stand_after_them():
    html, blocks = ingest.clean_html("<ul><li>outer <ul><li>inner <p>para</p></li><li>two</li></ul> tail</li><li>last</li></ul><table><tr><td>cell<ol><li>x</li></ol></td></tr></table>")
    assert blocks == [("li", "outer tail"), ("p", "para"), ("li", "two"), ("li", "last"), ("li", "x")]


def test_chunks_cut_at_the_later_sentence_mark_and_know_boilerplate(spark):
    text = "x" * 150 + ". " + "y" * 20 + "; " + "z" * 200
    assert structure.split_range(text, 0, len(text), 50)[0] == (0, 173)
    assert structure.split_range("a" * 500, 0, 500, 50)[0] == (0, 200)
    docs = spark.createDataFrame([(1, "1. TERM\n" + "word " * 40 + "\n2. FEES\n" + "pay " * 400)], "doc_id int, text string")
    ranges = spark.createDataFrame([(1, 0, 150), (1, 100, 190)], "doc_id int, start int, end int")
    rows = structure.chunks(docs, ["doc_id"], target=60, boilerplate_ranges=ranges).orderBy("chunk").collect()
    assert [r["is_boilerplate"] for r in rows][0] and not any(r["is_boilerplate"] for r in rows[1:])
    assert list(structure.chunk_segments("a" * 40 + "b" * 40, [(0, 40, None, None), (40, 80, "2", "B")]))[0][2:4] == (None, None)


def test_lookups_and_guards_of_null_and_odd_rows(spark):
    from clausemill.operators import compare, ingest, ranges, retrieve

    rows = spark.createDataFrame([(1, 404, [[1.0] * 7, [1.0] * 6, [None] + [1.0] * 6, None]), (2, None, None), (3, 599, [])], "id int, s int, items array<array<double>>")
    got = rows.select("id", ingest.code_for_status(F.col("s")).alias("c"), F.size(ingest.valid_items(F.col("items"))).alias("n"), ranges.valid_window(F.col("id"), F.col("s")).alias("v"), ranges.valid_window(F.col("id"), F.col("id") + 9).alias("w"))
    assert sorted(map(tuple, got.collect())) == [(1, "NOT_FOUND", 1, False, True), (2, "INTERNAL", 0, False, True), (3, "INTERNAL", 0, False, True)]

    quotes = spark.createDataFrame([(1, 2, ["b", " ", "a"]), (1, 1, ["a", "c", "d", "e", "f", "g"]), (2, 1, None)], "query_id int, batch int, quotes array<string>")
    assert sorted(map(tuple, retrieve.map_quotes(quotes).collect())) == [(1, 1, "a"), (1, 2, "c"), (1, 3, "d"), (1, 4, "e"), (1, 5, "f"), (1, 6, "b")]

    asked, stored = spark.createDataFrame([(1, "a"), (2, None)], "doc_id int, sha string"), spark.createDataFrame([("a", 4)], "sha string, high int")
    assert sorted((r["doc_id"], r["status"], r["high"]) for r in compare.read_back(asked, stored, ["sha"], ["high"]).collect()) == [(1, "READY", 4), (2, "PENDING", 0)]
