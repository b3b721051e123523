"""Expensive expressions are computed once per row, and cheaper forms keep their results."""

import re

from pyspark.sql import functions as F

from clausemill.functions import text as T
from clausemill.operators import compare, structure
from clausemill.plans import catalogue
from clausemill.plans import views as V


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_clauses_are_cut_once_per_text(spark):
    docs = spark.createDataFrame([(1, "1. A\nx")], "doc_id long, text string").repartition(1)
    assert plan(structure.segment_clauses(docs, ["doc_id"])).count("split(") == 1


def test_change_type_is_computed_once_per_pair(spark, data):
    filters = [x for x in plan(catalogue.comparison_report(spark, data)).splitlines() if "Filter" in x]
    assert filters and not any("regexp_replace" in x or "trim(" in x for x in filters)


def test_headings_are_read_once_per_line(spark, data):
    assert plan(catalogue.headings(spark, data)).count("ARTICLE|Article") <= 4


def test_alignment_joins_folded_forms_without_bodies(spark, data):
    assert "base_body" not in plan(compare.align(V.clauses(spark, data)))


def test_trim_ends_at_the_end_of_the_text(spark):
    row = spark.range(1).select(T.trim(F.lit(" ﻿a b \x85")).alias("a"), T.trim(F.lit("　\n \t")).alias("b"), T.fold(F.lit(" a\n b  c d e ")).alias("c")).head()
    assert tuple(row) == ("a b \x85", "", "a b c d e")


def test_clause_body_takes_references_literally(spark):
    rows = spark.createDataFrame([(r"a\Eb. Text", r"a\Eb"), ("(iv) – Text ", "iv"), ("(1) x", "(1"), (" 2 Text", "3"), (" Text ", None)], "t string, r string")
    assert [r[0] for r in rows.select(T.clause_body(F.col("t"), F.col("r"))).collect()] == ["Text", "Text", "x", "2 Text", "Text"]


def test_offsets_of_few_and_many_pieces(spark):
    for n in (0, 1, 12, 13, 600):
        got = spark.range(1).select(T.offsets(F.array(*[F.lit(i % 7) for i in range(n)]).cast("array<int>"), 1).alias("x")).head()[0]
        assert got == [sum(j % 7 + 1 for j in range(i)) for i in range(n)]


def test_a_filter_on_severity_does_not_search_texts_again(spark, data):
    assert plan(catalogue.change_filter(spark, data)).count("regexp_extract_all") == plan(catalogue.comparison_report(spark, data)).count("regexp_extract_all") > 0


def test_detectors_and_the_distance_make_no_types(spark, data):
    assert all("COSMETIC" not in plan(catalogue.QUERIES[q](spark, data)) for q in ("detect_money", "detect_percent", "detect_duration", "contract_distance", "renumber_note"))
    assert "regexp" not in plan(catalogue.contract_distance(spark, data))


def test_page_edges_take_one_sort_and_scan_warnings_one_reading(spark, data):
    assert not re.search(r"line#[0-9]+ DESC", plan(catalogue.boilerplate(spark, data))) and "Join" not in plan(catalogue.scan_warning(spark, data))


def test_page_markers_and_readable_characters(spark):
    texts = [" Page  3 of\u00a012 ", "PAGE 1 abcdefg", "abcdefghij 1", "abcdefghijk 1", "ABCDEFGHIJK 1", "no digit", "", "\u212a 7", None, "a\u2003b c"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(T.page_marker(F.col("t")), T.readable_chars(F.col("t"))).collect()
    assert [r[0] for r in rows] == ["page # of #", None, "abcdefghij #", None, None, None, None, "k #", None, None]
    assert [r[1] for r in rows] == [9, 12, 11, 12, 12, 7, 0, 2, None, 3]
