"""Full-text search, whole-document scans, alignment, chunks and DOCX files, against plain versions and by round trip."""

import io
import random
import re
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausemill.functions import patterns as P
from clausemill.functions.diff import TOKENS, matched, word_ops
from clausemill.operators import compare, fulltext, ingest, retrieve, structure
from clausemill.sources import docx, tracked

# --- search


def test_stems():
    want = dict(x.split(":") for x in "consigned:consign consistency:consist consolations:consol conspiracy:conspiraci constables:constabl knackeries:knackeri knavish:knavish knives:knive generously:generous communities:communiti goodness:good cries:cri ties:tie gas:gas hopping:hop hoping:hope happily:happili sensational:sensat electricity:electr skies:sky news:news proceed:proceed exceeded:exceed by:by say:say".split())
    assert {w: fulltext.stem(w) for w in want} == want


def stems_of(text):
    words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    return {i: fulltext.stem(w) for i, w in enumerate(words, 1) if w not in P.ENGLISH_STOP_WORDS}


def plain_units(question):
    groups = [[]]
    for token in re.findall(r'-?"[^"]*"?|[^\s"]+', question):
        if token.lower() == "or":
            groups.append([])
            continue
        found = stems_of(token)
        if found:
            first = min(found)
            groups[-1].append((token.startswith("-"), [(i - first, s) for i, s in found.items()]))
    return [g for g in groups if g]


def spans(unit, words):
    return [(i, i + max(o for o, _ in unit)) for i in words if all(words.get(i + o) == s for o, s in unit)]


def plain_score(groups, words):
    """None if no group holds, else the cover density over all smallest stretches."""
    lexemes = {s for g in groups for _, u in g for _, s in u}
    entries = sorted(i for i, s in words.items() if s in lexemes)
    good = [g for g in groups if all(bool(spans(u, words)) != bar for bar, u in g)]
    if not good:
        return None
    holds = lambda a, b: any(any(not bar for bar, _ in g) and all(bar or any(a <= s and e <= b for s, e in spans(u, words)) for bar, u in g) for g in good)
    windows = [(a, b) for a in entries for b in entries if a <= b and holds(a, b)]
    least = [w for w in windows if not any(v != w and w[0] <= v[0] and v[1] <= w[1] for v in windows)]
    return sum(0.1 / (1 + (b - a) - (sum(a <= e <= b for e in entries) - 1)) for a, b in least)


def plain_search(chunks, question):
    def ranked(groups):
        rows = []
        for chunk, head, text in chunks:
            score = plain_score(groups, stems_of(text))
            if score is not None:
                rows.append((chunk, score * (1.5 if plain_score(groups, stems_of(head)) is not None else 1.0) * (1.2 if "definition" in (head or "").lower() else 1.0)))
        return sorted(rows, key=lambda r: (-round(r[1], 9), r[0]))

    strict = ranked(g) if (g := plain_units(question)) else []
    if len(strict) >= 3:
        return [(c, round(s, 6), "strict") for c, s in strict]
    terms = list(dict.fromkeys([w for w in re.split(r"[\W_]+", question.lower()) if len(w) > 2 and w not in P.STOP_WORDS][:24]))
    terms = [t for t in terms if t not in P.ENGLISH_STOP_WORDS]
    loose = ranked([[(False, [(0, fulltext.stem(t))])] for t in terms]) if terms else []
    place = {c: i for i, (c, _) in enumerate(loose)}
    merged = {c: (s, "any") for c, s in loose} | {c: (s, "strict") for c, s in strict}
    return sorted(((c, round(s, 6), m) for c, (s, m) in merged.items()), key=lambda r: (-r[1], place.get(r[0], 1000 + r[0])))


QUESTIONS = ["payment fees", '"notice of termination"', "fees -interest", 'interest or "notice of termination"', "-notice", "the of and", "", "absent", '"fee interest" payments notices', 'payments -"of fees"', "fee fee", "or", '"unclosed notice', "ÉTÉ payments"]


def search_data(spark):
    rng = random.Random(1)
    vocabulary = "payment payments of fees fee interest the notice termination été absentee and".split()
    chunks = [(d, c, rng.choice([None, "", "Definitions", "Fees and payments", "Notice of termination"]), rng.choice([None, "x"]) if c == 9 else " ".join(rng.choices(vocabulary, k=rng.randint(0, 14)))) for d in (1, 2) for c in range(10)]
    questions = [(i, 1 + i % 2, q) for i, q in enumerate(QUESTIONS)] + [(100 + i, 1, q) for i, q in enumerate(QUESTIONS)] + [(200, 3, "payments"), (201, 1, None)]
    return chunks, questions, spark.createDataFrame(chunks, "doc_id int, chunk int, heading string, text string"), spark.createDataFrame(questions, "query_id int, doc_id int, question string")


def found_by_query(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["chunk"], round(r["score"], 6), r["mode"]))
    return out


def test_search_against_its_definition_and_on_a_stored_index(spark, tmp_path):
    chunks, questions, chunk_rows, asked = search_data(spark)
    got = found_by_query(fulltext.search(chunk_rows, asked).collect())
    for i, d, q in questions:
        want = plain_search([c[1:] for c in chunks if c[0] == d], q or "")
        assert got.get(i, []) == want, (q, got.get(i), want)
    path = str(tmp_path / "index")
    for d in (1, 2):  # in two parts
        fulltext.store_index(chunk_rows.where(F.col("doc_id") == d), path, 8)
    index = fulltext.open_index(spark, path)
    assert found_by_query(fulltext.search(chunk_rows, asked, index=index, buckets=8).collect()) == got
    plan = fulltext._posted(fulltext.units(asked), index, 8)._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan and "dynamicpruning" in plan  # folders of other lexemes are not read
    assert fulltext.search(chunk_rows.where("doc_id > 5"), asked).count() == 0


# --- scans


def test_scan_stops_after_three_failures_in_a_row_and_says_what_it_read(spark):
    plans = {1: "rrrr", 2: "rfrf", 3: "fffrr", 4: "ffrffr", 5: "fff"}
    chunks = [(d, i, 10, f"{p} text {i}; AED {i} is due.") for d, plan in plans.items() for i, p in enumerate(plan)]
    df = spark.createDataFrame(chunks, "doc_id int, chunk int, tokens int, text string")
    asked = spark.createDataFrame([(d * 10, d, "q") for d in plans], "query_id int, doc_id int, question string")

    def reader(question, texts):
        if texts[0].startswith("f"):
            raise RuntimeError("busy")
        return True, f" found {texts[0][7]} ", [texts[0], "not in the text at all", " ", texts[0]]

    results = retrieve.thorough_scan(df, asked, 10, reader)
    outcome = {}
    for r in sorted(results.collect(), key=lambda r: r["batch"]):
        outcome.setdefault(r["doc_id"], []).append(r["outcome"])
    assert outcome == {1: ["READ"] * 4, 2: ["READ", "FAILED"] * 2, 3: ["FAILED"] * 3 + ["NOT_READ"] * 2, 4: ["FAILED", "FAILED", "READ"] * 2, 5: ["FAILED"] * 3}
    total = df.groupBy("doc_id").agg(F.count("*").alias("n"))
    covered = retrieve.scan_coverage(results, total)
    got = {r["doc_id"]: (r["chunks_read"], r["chunks_total"], r["complete"], r["usable"], r["stopped_reason"] is None) for r in covered.collect()}
    assert got == {1: (4, 4, True, True, True), 2: (2, 4, False, True, False), 3: (0, 5, False, False, False), 4: (2, 6, False, True, False), 5: (0, 3, False, False, False)}
    docs = spark.createDataFrame([(d, "\n".join(c[3] for c in chunks if c[0] == d)) for d in plans], "doc_id int, text string")
    answers = {r["doc_id"]: r for r in retrieve.scan_answers(results, docs, covered).collect()}
    assert answers[2]["findings"] == "### Part 1\nfound 0\n\n### Part 3\nfound 2"
    assert answers[2]["quotes"] == ["r text 0; AED 0 is due.", "r text 2; AED 2 is due."] and answers[2]["error"] is None
    assert (answers[3]["error"], answers[3]["quotes"], answers[3]["findings"]) == ("LLM_UNAVAILABLE", [], "")


# --- clauses, chunks, alignment


def test_clauses_of_rows_that_share_a_key(spark):
    docs = spark.createDataFrame([(1, "1. A\nx\n2. B\ny"), (1, "no headings\nat all"), (None, "lead\n(a) item one\nSECTION 2.1 Fees\n\n"), (1, ""), (2, None)], "doc_id int, text string")
    got = [(r["doc_id"] or 0, r["ordinal"], r["ref"], r["start"], r["end"], r["body"]) for r in structure.segment_clauses(docs, ["doc_id"]).collect()]
    assert sorted(got, key=str) == sorted([(0, 0, None, 0, 4, "lead"), (0, 1, "a", 5, 17, "item one"), (0, 2, "SECTION 2.1", 18, 34, "Fees"), (1, 0, "1", 0, 6, "A\nx"), (1, 1, "2", 7, 13, "B\ny"), (1, 0, None, 0, 18, "no headings\nat all")], key=str)
    assert "Exchange" not in structure.segment_clauses(docs, ["doc_id"])._jdf.queryExecution().executedPlan().toString()


def test_merged_segments_and_boilerplate_ranges(spark):
    rng = random.Random(3)
    rows, want = [], []
    for d in range(40):
        at, segments = 0, []
        for o in range(rng.randint(1, 12)):
            n = rng.choice([10, 60, 200, 420])
            rows.append((d, o, at, at + n))
            segments.append((at, at + n, None, None))
            at += n + 2
        want += [(d, i, c[0], c[1], c[4]) for i, c in enumerate(structure.chunk_segments("x" * at, segments, 120, 200, 60))]
    df = spark.createDataFrame(rows, "doc_id int, ordinal int, start int, end int")
    assert sorted(map(tuple, structure.merge_segments(df, ["doc_id"], 120, 200, 60).collect())) == want
    text = "\n".join(f"HEADER\nline {i} of its own {'z' * i}\nPage {i} of 9" for i in range(9))
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string")
    page = len(text) // 9 - 2
    lines = {text[r["start"] : r["end"]] for r in structure.boilerplate_ranges(docs, page).collect()}
    assert lines <= {"HEADER"} | {f"Page {i} of 9" for i in range(9)} and "HEADER" in lines
    cuts = [tuple(r)[1:] for r in structure.split_texts(docs, ["doc_id"], target=20).orderBy("n").collect()]
    assert cuts[0][1] == 0 and cuts[-1][2] == len(text) and all(a[1] < b[1] <= a[2] for a, b in zip(cuts, cuts[1:]))


def test_best_scores_by_diagonals():
    rng = np.random.default_rng(2)
    for n, m in ((0, 0), (0, 3), (1, 1), (5, 2), (7, 9)):
        gain = rng.normal(size=(n, m))
        best = np.zeros((n + 1, m + 1))
        best[:, 0], best[0] = compare.GAP * np.arange(n + 1), compare.GAP * np.arange(m + 1)
        for i in range(1, n + 1):
            for j in range(1, m + 1):
                best[i, j] = max(best[i - 1, j - 1] + gain[i - 1, j - 1], best[i - 1, j] + compare.GAP, best[i, j - 1] + compare.GAP)
        assert np.allclose(compare.best_scores(gain), best)


def test_refs_default_to_the_place(spark):
    rows = [(1, v, i, ref, f"T{i}", f"body number{i} with words of{i} its{i} own{i}") for v in ("base", "revised") for i, ref in enumerate([None, None, "9.2"], 1)]
    got = compare.align(spark.createDataFrame(rows + [(2, "base", 1, None, "A", "x")], "doc_id int, version string, ordinal int, ref string, title string, body string")).orderBy("doc_id", "n").collect()
    assert [(r["type"], r["base_ref"], r["revised_ref"]) for r in got] == [("UNCHANGED", None, None), ("UNCHANGED", "1", "1"), ("UNCHANGED", "9.2", "9.2"), ("REMOVED", None, None)]


# --- word diffs and tracked changes


def test_word_diff_is_shortest():
    rng = random.Random(4)
    for _ in range(500):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        pairs = matched(a, b)
        assert len(pairs) == table[-1][-1] and all(a[i] == b[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
    before, after = "Pay AED 250,000 within 30 days.\r\n", "Pay  AED 300,000, at once,\nwithin 30 days"
    ops = word_ops(before, after)
    assert "".join(t for o, t in ops if o != "insert") == before and "".join(t for o, t in ops if o != "delete") == after
    assert "".join(TOKENS.findall(before)) == before and word_ops("", "") == []


_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_FORMATS = (
    '<w:p><w:pPr><w:b/></w:pPr><w:r><w:t xml:space="preserve">The </w:t></w:r><w:r><w:rPr><w:b/></w:rPr><w:t>fee is </w:t><w:tab/><w:t>AED 250</w:t></w:r>'
    '<w:hyperlink r:id="x"><w:r><w:rPr><w:u/></w:rPr><w:t>,000 &amp; costs</w:t></w:r></w:hyperlink><w:r><w:rPr><w:i/></w:rPr><w:t xml:space="preserve"> within 30 days.</w:t></w:r></w:p>'
    '<w:p><w:r><w:t>Old </w:t></w:r><w:ins w:id="7" w:author="x"><w:r><w:t>new</w:t></w:r></w:ins><w:del w:id="8" w:author="x"><w:r><w:delText>gone</w:delText></w:r></w:del></w:p><w:p/>'
)


def package(body, **parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.bin", b"\x00\x01\xff")
        z.writestr("word/document.xml", f'<w:document {_W} xmlns:r="http://r" xmlns:mc="http://mc" xmlns:w14="http://w14" mc:Ignorable="w14"><w:body>{body}</w:body></w:document>')
        for name, data in parts.items():
            z.writestr(f"word/{name}.xml", data)
    return out.getvalue()


def test_tracked_changes_keep_formats_links_older_revisions_and_other_parts():
    source = package(_FORMATS)
    edits = [(0, 8, "is \tAED 250,000 & costs within", "was AED 300,000 and charges inside"), (0, 0, "The", "Any"), (2, 0, "", "first words")]
    written = tracked.track(source, edits)
    assert tracked.states(source, written) == [
        ("The fee is \tAED 250,000 & costs within 30 days.",) * 2 + ("Any fee was AED 300,000 and charges inside 30 days.",), ("Old new", "Old new", "Old new"), ("", "", "first words"),
    ]
    assert tracked.texts(tracked.accept(written, 8))[0] == "Any fee was AED 300,000 and charges inside 30 days."
    assert tracked.texts(tracked.reject(written, 8)) == tracked.texts(source)
    assert tracked.texts(tracked.reject(written))[1] == "Old gone" and tracked.texts(tracked.accept(written))[1] == "Old new"
    body = tracked.read_part(written).decode()
    assert 'mc:Ignorable="w14"' in body and 'xmlns:w14' in body
    link = re.search("<w:hyperlink.*?</w:hyperlink>", body)[0]
    assert "".join(re.findall(r"<w:(?:t|delText)[^>]*>([^<]*)<", re.sub("<w:ins.*?</w:ins>", "", link))) == ",000 &amp; costs"
    assert all("<w:b/>" in r for r in re.findall("<w:r>(?:(?!</w:r>).)*fee(?:(?!</w:r>).)*</w:r>", body)) and "<w:i/>" in body
    ids = [int(i) for i in re.findall(r'w:id="(\d+)"', body)]
    assert len(ids) == len(set(ids)) and min(set(ids) - {7, 8}) == 9
    assert zipfile.ZipFile(io.BytesIO(written)).read("a.bin") == b"\x00\x01\xff"


def test_random_edits_survive_a_round_trip():
    rng = random.Random(8)
    for _ in range(60):
        text = " ".join(rng.choice(["pay", "AED", "5,000", "to", "“us”", "&", "<b>"]) for _ in range(rng.randint(1, 12)))
        cuts = sorted({0, len(text), *(rng.randrange(len(text) + 1) for _ in range(4))})
        source = docx.build([[(text[a:b], rng.choice(["", "b", "iu", "l"])) for a, b in zip(cuts, cuts[1:])]])
        a = rng.randrange(len(text) + 1)
        b = rng.randrange(a, len(text) + 1)
        new = " ".join(rng.choice(["pay", "USD", "us"]) for _ in range(rng.randint(0, 3)))
        assert tracked.states(source, tracked.track(source, [(0, a, text[a:b], new)])) == [(text, text, text[:a] + new + text[b:])]


def test_returns_in_new_text_are_written_by_number():
    source = docx.build([[("Pay now", "")]])
    assert tracked.texts(tracked.track(source, [(0, 3, "", "\r\n<all> & more")])) == ["Pay\r\n<all> & more now"]


def test_comments_and_instructions_inside_a_body_stay():
    source = package("<w:p><!--note--><w:r><w:t>Pay<?mark x?> now</w:t></w:r></w:p>")
    written = tracked.track(source, [(0, 0, "", "Do ")])
    assert tracked.texts(written) == ["Do Pay now"] and all(x in tracked.read_part(written) for x in (b"<!--note-->", b"<?mark x?>"))


def test_an_unchanged_package_is_parsed_once(monkeypatch):
    source, seen, parse = docx.build([[("Pay", "b"), (" now", "")]]), [], tracked.parse
    monkeypatch.setattr(tracked, "parse", lambda xml: seen.append(xml) or parse(xml))
    assert tracked.states(source, source) == [("Pay now",) * 3] and len(seen) == 1


def test_files_with_edits_and_without_and_damaged_ones(spark):
    good = docx.build([[("Pay AED 5", "b"), (" now", "")], [("Second", "")]])
    files = spark.createDataFrame([("a", good), ("b", good), ("c", b"no zip"), ("d", None), ("e", good)], "path string, content binary")
    edits = spark.createDataFrame([("a", 0, 4, "AED 5", "USD 7"), ("a", 1, 0, "Second", "2nd"), ("c", 0, 0, "x", "y"), ("e", 0, 0, "other text", "y")], "path string, paragraph int, start int, find string, replace string")
    written = tracked.track_files(files, edits)
    assert {r["path"]: r["reason"] for r in written.collect()} == {"a": None, "b": None, "c": "CORRUPT_FILE", "d": None, "e": "TEXT_CHANGED"}
    expected = spark.createDataFrame([("a", 0, "Pay USD 7 now"), ("a", 1, "2nd"), ("b", 0, "something else")], "path string, paragraph int, text string")
    verdict = {r["path"]: r["reason"] for r in tracked.validate(tracked.check_files(files, written), expected).collect()}
    assert verdict == {"a": None, "b": "ACCEPT_DIFFERS", "c": "PARAGRAPH_COUNT", "d": "PARAGRAPH_COUNT", "e": "PARAGRAPH_COUNT"}


def test_a_scan_orders_the_batches_of_a_document_once_and_makes_no_table_for_each(spark):
    chunks = spark.createDataFrame([(1, c, 10, f"Fee {c}.") for c in range(12)] + [(2, 0, 10, "Rent.")], "doc_id long, chunk int, tokens int, text string")
    asked = spark.createDataFrame([(5, 1, "fee"), (6, 1, None), (7, 3, "fee")], "query_id long, doc_id long, question string")
    rows = retrieve.thorough_scan(chunks, asked, 10)
    assert "FlatMapGroupsInPandas" not in rows._jdf.queryExecution().optimizedPlan().toString()
    got = rows.orderBy("query_id", "batch").select("query_id", "batch", "start", "end", "n_chunks", "outcome").collect()
    assert [tuple(r) for r in got] == [(q, c, c, c, 1, "READ") for q in (5, 6) for c in range(12)]


# --- DOCX as HTML


def _p(text, style=None, num=None, level=0, form=""):
    look = (f'<w:pStyle w:val="{style}"/>' if style else "") + (f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{num}"/></w:numPr>' if num else "")
    return f"<w:p><w:pPr>{look}</w:pPr><w:r>{f'<w:rPr>{form}</w:rPr>' if form else ''}<w:t>{text}</w:t></w:r></w:p>"


def styled():
    style = lambda i, name, more="": f'<w:style w:type="paragraph" w:styleId="{i}"><w:name w:val="{name}"/>{more}</w:style>'
    styles = f"<w:styles {_W}>{style('T', 'Title')}{style('H2', 'heading 2')}{style('Mine', 'Mine', '<w:basedOn w:val=\"H2\"/>')}{style('LB', 'List Bullet', '<w:pPr><w:numPr><w:numId w:val=\"2\"/></w:numPr></w:pPr>')}{style('Loop', 'Loop', '<w:basedOn w:val=\"Loop\"/>')}</w:styles>"
    level = lambda n, kind: f'<w:lvl w:ilvl="{n}"><w:numFmt w:val="{kind}"/></w:lvl>'
    numbering = f'<w:numbering {_W}><w:abstractNum w:abstractNumId="0">{level(0, "decimal")}</w:abstractNum><w:abstractNum w:abstractNumId="1">{level(0, "bullet")}{level(1, "bullet")}</w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="1"/></w:num></w:numbering>'
    cell = lambda text, look="": f"<w:tc><w:tcPr>{look}</w:tcPr>{_p(text)}</w:tc>"
    table = f'<w:tbl><w:tr><w:trPr><w:tblHeader/></w:trPr>{cell("Head", "<w:gridSpan w:val=\"2\"/>")}</w:tr><w:tr>{cell("a", "<w:vMerge w:val=\"restart\"/>")}{cell("b")}</w:tr><w:tr>{cell("", "<w:vMerge/>")}{cell("c")}</w:tr></w:tbl>'
    body = _p("The Agreement", "T") + _p("Scope", "Mine") + _p("one &amp; only", num=1) + _p("deep", num=2, level=1) + _p("two", num=1) + _p("bold", "Loop", form="<w:b/>") + _p("off", form='<w:i w:val="0"/>') + _p("  ") + table + _p("by style", "LB")
    body += '<w:p><w:r><w:t>kept</w:t></w:r><w:del w:id="1"><w:r><w:delText>gone</w:delText></w:r></w:del><w:ins w:id="2"><w:r><w:br/><w:t>added</w:t></w:r></w:ins></w:p>'
    return package(body, styles=styles, numbering=numbering)


def test_docx_becomes_headings_lists_and_tables():
    assert docx.to_html(styled()) == (
        "<h1>The Agreement</h1><h2>Scope</h2><ol><li>one &amp; only<ul><li>deep</li></ul></li><li>two</li></ol><p><strong>bold</strong></p><p>off</p>"
        '<table><tr><th colspan="2"><p>Head</p></th></tr><tr><td rowspan="2"><p>a</p></td><td><p>b</p></td></tr><tr><td><p>c</p></td></tr></table><ul><li>by style</li></ul><p>kept<br />added</p>'
    )


def test_block_offsets_are_text_slices(spark):
    files = spark.createDataFrame([("a", styled()), ("b", b"PK\x03\x04 broken"), ("c", None), ("d", package("")), ("e", package("<w:p>"))], "path string, content binary")
    rows = {r["path"]: r for r in docx.html_files(files).collect()}
    assert [rows[p]["reason"] for p in "abcde"] == [None, "CORRUPT_FILE", "CORRUPT_FILE", None, "INVALID_XML"]
    text, html = rows["a"]["full_text"], rows["a"]["html"]
    blocks = sorted((r["n"], r["tag"], r["start"], r["end"], r["text"]) for r in docx.html_file_blocks(files).where("path = 'a'").collect())
    assert [b[1] for b in blocks] == ["h1", "h2", "li", "li", "li", "p", "p", "p", "p", "p", "p", "li", "p"]
    assert all(text[s:e] == t for _, _, s, e, t in blocks) and "\n".join(b[4] for b in blocks) == text
    assert [(int(a), int(b)) for a, b in re.findall('data-start="([0-9]+)" data-end="([0-9]+)"', html)] == [(s, e) for _, _, s, e, _ in blocks]
    assert rows["d"]["full_text"] == "" and ingest.annotated("") == ("", "")


@pytest.mark.parametrize("xml", [b'<!DOCTYPE w [<!ENTITY a "b">]><w/>'])
def test_entities_are_refused(xml):
    with pytest.raises(tracked.DamagedPackage):
        tracked.parse(xml)


def test_structured_replies_list_every_fault_and_are_repaired_once(spark):
    from pyspark.sql import functions as F

    from clausemill.operators import reply

    shape = {"ok": "boolean", "items?": [{"n": "number", "tags?": ["string"]}]}
    raws = {
        1: '{"ok": true, "more": {}}', 2: '{"ok": 1, "items": [{"n": 1}, {"n": null, "tags": ["a", 2]}, 5]}', 3: "not json", 4: None, 5: "", 6: "[]", 7: '{"ok": false, "items": {}}',
        8: '{"ok": true, "items": [{"n": 1.5, "tags": []}]}', 9: "null", 10: '{"ok": true} tail', 11: '{"ok": true}] tail',
    }
    df = spark.createDataFrame(list(raws.items()), "message_id int, raw string")
    got = {r["message_id"]: r for r in reply.structured(df, shape).collect()}
    wrong = "Invalid input: expected {}, received {}".format
    assert [k for k in raws if got[k]["code"] is None] == [1, 8] and got[8]["reply"] == raws[8]
    assert got[2]["error"] == f"ok: {wrong('boolean', 'number')}; items.1.n: {wrong('number', 'null')}; items.1.tags.1: {wrong('string', 'number')}; items.2: {wrong('object', 'number')}"
    assert all(got[k]["error"] == reply.NOT_JSON for k in (3, 4, 5, 10, 11)) and got[6]["error"] == f": {wrong('object', 'array')}"
    assert got[7]["error"] == f"items: {wrong('array', 'object')}" and got[9]["error"] == f": {wrong('object', 'null')}"
    seen = []

    def ask(asked):
        seen.extend(r["prompt"] for r in asked.collect())
        return asked.where("message_id <> 4").select("message_id", F.when(F.col("message_id") == 3, "still not").otherwise('{"ok": true}').alias("raw"))

    got = {r["message_id"]: (r["reply"], r["attempts"], r["code"]) for r in reply.structured(df, shape, ask).collect()}
    assert len(seen) == 9 and all("required shape" in p for p in seen)
    assert got[1] == (raws[1], 1, None) and got[2] == ('{"ok": true}', 2, None) and got[3] == got[4] == (None, 2, reply.INVALID)
    assert reply.structured(df.limit(0), shape, ask).count() == 0
