"""Behaviour of single functions and operators on rows made for the purpose."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dossierlake.functions import text as T
from dossierlake.operators import answers, corpus, layout, ranking, retrieval


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("text", "want"), [("Cà Phê Đắk Lắk", "coffee dak lak"), ("woodchips â€” dry", "wood chips — dry"), (None, ""), ("  A  ", "a")])
def test_normalize(spark, text, want):
    assert one(spark, text, T.normalize_search) == want


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet=st.characters(blacklist_categories=("Cs",), blacklist_characters="\x00"), max_size=40))
def test_normalize_is_idempotent(spark, text):
    once = one(spark, text, T.fold)
    assert one(spark, once, T.fold) == once


def test_tokens_and_phrases(spark):
    assert one(spark, "Which is the dried, roasted bean 12.5 of 3?", T.meaningful_tokens) == ["dry", "roast", "bean", "12.5", "3"]
    assert one(spark, "moisture 12,5 % or 20-30 cm", T.numeric_ranges) == ["12.5 %", "20-30 cm", "30 cm"]
    assert one(spark, "see 0901.11.10 and 0901.11.10, 0902.10.00", T.codes) == ["0901.11.10", "0902.10.00"]
    assert one(spark, "One. Two! Three", T.sentences) == ["One.", "Two!", "Three"]
    assert len(one(spark, "word " * 100, T.preview)) <= 180


def test_signals_drop_the_contrast_baseline(spark):
    q = spark.createDataFrame([("a", "small bolt instead of red widget"), ("b", "gear")], "query_id string, question string")
    rows = {r.query_id: r for r in retrieval.signals(q).collect()}
    assert rows["a"].contrast == ["instead of"] and rows["a"].baseline == ["red", "widget"]
    assert "red" not in rows["a"].tokens and rows["b"].contrast == []


SECTION = "section_id long, document string, chapter string, hs_code string, title string, section string, page_start int, page_end int, source string, text string"


def run(spark, question, sections, scope=None):
    q = spark.createDataFrame([("q", question)], "query_id string, question string")
    s = spark.createDataFrame(sections, SECTION)
    sig = retrieval.signals(q)
    scored = retrieval.field_scores(sig, retrieval.search_fields(s)).select("query_id", "section_id", "score")
    return {r.section_id: r for r in ranking.validate(ranking.relevance(scored.join(sig, "query_id").join(s, "section_id")), scope).collect()}


def section(i, document="A.pdf", code="1111.11.11", title="CARBON FIBER SHEETS", text="Carbon fiber sheets."):
    return (i, document, "CHAPTER 11", code, title, f"{code} - {title}", 1, 2, "source", text)


def test_exact_code_inside_and_outside_scope(spark):
    rows = run(spark, "lookup 9999.88.77", [section(1, code="9999.88.77", title="REFERENCE MATERIAL")])
    assert rows[1].accepted and rows[1].confidence == "high" and rows[1].state == "exact code"
    rows = run(spark, "carbon fiber sheets", [section(1, document="Outside.pdf")], scope=["A.pdf"])
    assert not rows[1].accepted and rows[1].state == "outside scope"


def test_weak_tokens_are_no_evidence(spark):
    rows = run(spark, "content", [section(1, title="GENERAL CONTENT", text="Document content summary.")])
    assert rows[1].confidence == "low"
    rows = run(spark, "carbon fiber sheets", [section(1), section(2, title="STEEL SHEETS", text="Steel.")])
    assert rows[1].accepted and rows[1].relevance > rows[2].relevance


@pytest.mark.parametrize(("question", "want"), [("Hello!", "simple_chat"), ("code 0901.11.10?", "exact_code_lookup"), ("summary of chapter 9", "chapter_summary"), ("20 %", "clarification_needed"), ("which code is tea", "product_classification"), ("what is tea", "definition"), ("tea versus coffee", "comparison"), ("how wide", "selected_section_qa")])
def test_intents(spark, question, want):
    assert one(spark, question, answers.intent) == want


def test_json_trees(spark):
    tree = '{"nodes": [{"title": "a", "text": "x", "nodes": [{"title": "b", "summary": "s"}, {"title": "c", "children": [{"title": "d"}]}]}, {"title": "e"}]}'
    rows = corpus.flatten_json_tree(spark.createDataFrame([("doc", tree), ("none", "{}")], "document string, tree string")).collect()
    assert [(r.path, r.level, r.title, r.child_count) for r in sorted(rows, key=lambda r: r.path)] == [("0000", 1, "a", 2), ("0000/0000", 2, "b", 0), ("0000/0001", 2, "c", 1), ("0000/0001/0000", 3, "d", 0), ("0001", 1, "e", 0)]


def test_range_join_equals_brute_force(spark):
    points = [("k", i) for i in range(0, 60, 7)]
    ranges = [("k", a, a + n) for a, n in ((0, 3), (5, 40), (20, 0), (16, 16))]
    got = corpus.range_join(spark.createDataFrame(points, "key string, at int"), spark.createDataFrame(ranges, "key string, low int, high int"), "key", "at", "low", "high").select("at", "low", "high").collect()
    assert sorted(map(tuple, got)) == sorted((p, a, b) for _, p in points for _, a, b in ranges if a <= p <= b)


def test_greedy_dedupe_is_not_transitive(spark):
    boxes = [(1, 1, 0, 0, 100, 100), (1, 2, 30, 0, 130, 98), (1, 3, 60, 0, 160, 96)]
    rows = {r.block_id: r.duplicate_of for r in layout.greedy_dedupe(spark.createDataFrame(boxes, "page long, block_id long, x0 long, y0 long, x1 long, y1 long")).collect()}
    assert rows == {1: None, 2: 1, 3: None}


def test_a_tree_deeper_than_given_raises(spark):
    tree = '{"title": "leaf"}'
    for _ in range(5):
        tree = '{"title": "x", "nodes": [' + tree + "]}"
    trees = spark.createDataFrame([("d", '{"nodes": [' + tree + "]}")], "document string, tree string")
    assert corpus.flatten_json_tree(trees, depth=6).count() == 6
    with pytest.raises(ValueError):
        corpus.flatten_json_tree(trees, depth=5)
