"""Plans, fields, forms and markers on single texts."""

import random

import pytest
from pyspark.sql import functions as F

from dossierlake.functions import forms as X
from dossierlake.functions import text as T
from dossierlake.operators import alignment, integrity, planning, retrieval


def one(spark, expression, text):
    return spark.createDataFrame([(text,)], "t string").select(expression(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(("question", "plan"), [
    ("Which goods are 0901.21.10?", ("exact_hscode_lookup", "0901.21.10", "en")), ("tóm tắt chương 9", ("chapter_summary", "chapter 9", "vi")), ("summary of chapter_12", ("chapter_summary", "chapter 12", "en")),
    ("What is green tea?", None), ("", None), ("tóm tắt document Coffee Guide.pdf", ("document_summary", "Coffee Guide pdf", "mixed")), (None, None),
])
def test_plans(spark, question, plan):
    got = planning.plans(spark.createDataFrame([(question,)], "question string")).first().plan
    assert (got and (got.intent, got.target, got.language)) == plan


@pytest.mark.parametrize(("question", "language"), [("green tea", "en"), ("mã HS của chè", "vi"), ("what là gì", "mixed"), ("12 / 7", "unknown"), ("", "unknown"), ("  ", "unknown")])
def test_languages(spark, question, language):
    assert one(spark, planning.query_language, question) == language


@pytest.mark.parametrize(("question", "term"), [("What is the green  tea?", "green tea"), ("define arabica!", "arabica"), ("chè xanh là gì?", "chè xanh"), ("which code", None), ("", None), (None, None)])
def test_definitions(spark, question, term):
    assert one(spark, planning.definition_term, question) == term


@pytest.mark.parametrize(("text", "field"), [("ngoại quan cần đáp ứng gì", "appearance requirements"), ("Weight & size", "weight and size"), ("what is its purpose", "usage"), ("hue", None), ("", None), ("ghi chú", "note")])
def test_fields(spark, text, field):
    got = one(spark, lambda c: planning.requested_field(planning.field_groups(X.field_form(c), X.field_tokens(c))), text)
    assert got == field


def test_forms_and_cuts(spark):
    assert one(spark, X.alignment_form, "**Cà-phê** ![x](y) 1.5–2.0 kg... (a.b) “Đá”") == "ca phe 1.5 2.0 kg a b da"
    assert one(spark, lambda c: X.shorten_sentence(c, 12), "some words that go on") == "some words."
    assert one(spark, lambda c: X.shorten_to_sentences(c, 16), "One two. Three four. Five.") == "One two."
    assert one(spark, lambda c: X.shorten_to_sentences(c, 5), "Unbroken words here") == "Unbro"
    assert one(spark, X.title_case, "THE OIL OF OLIVES AND OF") == "The Oil of Olives and Of"
    assert one(spark, X.heading_title, "### 0901.21.10 — Coffee") == "Coffee" and one(spark, X.heading_title, "") is None
    assert one(spark, lambda c: X.strip_codes(c, F.array(F.lit("0901.21.10"))), "0901.21.10 and 0901.22.20 x") == "0901.21.10 and x"
    assert one(spark, X.direct_answer, "Tea. <doc=a> Nguồn: b") == "Tea." and one(spark, X.direct_answer, "The document context is insufficient") == ""
    assert one(spark, X.quoted_terms, 'a "Green Tea" and ‘x’ b') == ["green tea"]


def test_markers(spark):
    d = spark.createDataFrame([("a" * 1501 + " <doc=x>", "a" * 1501), ("word " * 121, "")], "answer string, context string")
    got = [tuple(r) for r in d.select(*integrity.answer_markers(F.col("answer"), F.col("context"))).collect()]
    assert got == [(1, True, 1501, False, 2, True), (0, False, 0, True, 121, False)]


def test_alignment_scores(spark):
    row = lambda i, t, box=(0, 0, 10, 10): ("d", 1, i, t, i, *box)
    schema = "document string, page long, id long, text string, block_id long, x0 long, y0 long, x1 long, y1 long"
    spans = spark.createDataFrame([row(1, "Green tea 0902.10.10"), row(2, "#"), row(3, "nothing alike")], schema)
    units = spark.createDataFrame([row(1, "# green  TEA 0902.10.10"), row(9, "tea", (90, 90, 95, 95))], schema)
    blocks = units.filter("id = 1")
    units = units.select("document", "page", "id", "text", "block_id")
    pairs = alignment.scored(spans, units, blocks)
    got = {(r.span_id, r.unit_id): r.score for r in pairs.collect()}
    assert got[1, 1] == 80 + 34 + 34 + 26 + 34 + 8 + 12 + 18 and got[2, 1] == 0
    best = {r.span_id: (r.unit_id, r.confidence) for r in alignment.best(spans, pairs, "span_id", "unit_id", alignment.SPAN_THRESHOLD).collect()}
    assert best == {1: (1, "high"), 2: (None, "none"), 3: (None, "low")}


def test_a_span_without_units_on_its_page_meets_its_document(spark):
    schema = "document string, page long, id long, text string, block_id long, x0 long, y0 long, x1 long, y1 long"
    spans = [("d", 1, 1, "green tea leaves", None, 0, 0, 10, 10), ("d", 7, 2, "green tea leaves", None, 0, 0, 10, 10), ("d", None, 3, "een te", 5, None, None, None, None), ("d", 8, 4, "!", None, 0, 0, 1, 1), ("e", 1, 5, "green tea leaves", None, 0, 0, 10, 10), ("d", 9, 6, "no word of it", 5, 0, 0, 10, 10)]
    spans = spark.createDataFrame(spans, schema)
    units = spark.createDataFrame([("d", 1, 10, "coffee", None), ("d", 2, 11, "Green tea leaves", 5), ("d", 2, 12, "", 5), ("d", None, 13, "beans", 5)], "document string, page long, id long, text string, block_id long")
    blocks = spark.createDataFrame([("d", 2, 5, "x", 1, 0, 0, 10, 5), ("d", None, 6, "green tea", 1, 0, 0, 10, 10)], "document string, page long, id long, text string, block_id long, x0 long, y0 long, x1 long, y1 long")
    pairs = alignment.scored(spans, units, blocks)
    got = {(r.span_id, r.unit_id): r.score for r in pairs.collect()}
    # span 1 keeps to its page; 2 meets its words, 3 holds by characters and block, 6 by block alone
    assert set(got) == {(1, 10), (2, 11), (3, 11), (3, 13), (6, 11), (6, 13)}
    assert got[1, 10] == 8 + 18 and got[2, 11] == 80 + 34 + 34 + 9 and got[3, 11] == round(58 + 12 * 6 / 16 + 12, 6) and got[6, 13] == 21
    best = {r.span_id: r.unit_id for r in alignment.best(spans, pairs, "span_id", "unit_id", alignment.SPAN_THRESHOLD).collect()}
    assert best == {1: None, 2: 11, 3: 11, 4: None, 5: None, 6: None}
    fallen = {r.span_id: (r.block_id, r.confidence) for r in alignment.fallback_blocks(spans, blocks).collect()}
    assert fallen[1] == (6, "fallback") and fallen[3] == (6, "fallback") and fallen[5] == (None, "none")


@pytest.mark.parametrize(("block", "by_unit"), [(1024, False), (12, True)])
def test_blocks_of_a_page_are_scored_as_the_whole_page(spark, monkeypatch, block, by_unit):
    """Whatever the blocks, pairs are those of the rule, scored as text_score does, and the pairs kept for the best give the same best."""
    monkeypatch.setattr(alignment, "BLOCK", block)
    draw = random.Random(7)
    words = ["tea", "green", "leaf", "10.5", "0902.10", "a", "xtea"]
    text = lambda: draw.choice([None, "", "#", "ea le"]) if draw.random() < 0.15 else " ".join(draw.choices(words, k=draw.randint(1, 5)))
    box = lambda: (x := draw.randint(0, 20), y := draw.randint(0, 20), x + 10, y + 5) if draw.random() < 0.8 else (None,) * 4
    schema = "document string, page long, id long, text string, block_id long, x0 long, y0 long, x1 long, y1 long"
    made = lambda n, at: [("d", draw.choice([1, at, None]), i, text(), draw.choice([1, 2, 9, None]), *box()) for i in range(n)]
    spans, units = spark.createDataFrame(made(40, 2), schema), spark.createDataFrame(made(30, 3), schema)
    blocks = spark.createDataFrame([("d", 1, 1, "x", None, 0, 0, 20, 10), ("d", 1, 2, "y", None, 10, 8, 25, 20)], schema)
    a, b = alignment.with_terms(units if by_unit else spans, "a_"), alignment.with_terms(spans if by_unit else units, "b_")
    b = b.withColumnRenamed("page", "b_page")
    own = [r.page for r in b.select(F.col("b_page").alias("page")).distinct().collect() if r.page is not None]
    same, known = F.coalesce(F.col("page") == F.col("b_page"), F.lit(False)), F.coalesce(F.col("page").isin(own), F.lit(False))
    met = F.arrays_overlap("a_tokens", "b_tokens") | F.arrays_overlap("a_numbers", "b_numbers") | F.contains("a_form", "b_form") | F.contains("b_form", "a_form") | F.coalesce(F.col("a_block_id") == F.col("b_block_id"), F.lit(False))
    rest = ~known & (F.col("a_form") != "") & (F.col("b_form") != "") & met
    want = a.join(b, "document").filter((known & same) | rest).select(F.col("b_id" if by_unit else "a_id").alias("span_id"), F.col("a_id" if by_unit else "b_id").alias("unit_id"), alignment.text_score("a_", "b_").alias("least"), (F.when(same, 8).otherwise(0) + F.when(F.col("a_block_id") == F.col("b_block_id"), 12).otherwise(0)).alias("place"))
    want = {(r.span_id, r.unit_id): r for r in want.collect()}
    held = lambda df: spark.createDataFrame(df.collect(), df.schema)
    pairs = held(alignment.scored(spans, units, blocks, by_unit))
    got = {(r.span_id, r.unit_id): r.score for r in pairs.collect()}
    assert set(got) == set(want) and len(got) == pairs.count() > 100
    for key, score in got.items():
        low = want[key].least
        assert (score is None and low is None) or (low == 0 and score == 0) or low + want[key].place - 1e-6 <= score <= low + want[key].place + 18 + 1e-6
    sides = (units, "unit_id", "span_id") if by_unit else (spans, "span_id", "unit_id")
    best = lambda p: sorted(map(tuple, alignment.best(sides[0], p, *sides[1:], 20).collect()), key=repr)
    few = held(alignment.scored(spans, units, blocks, by_unit, only_best=True))
    assert best(few) == best(pairs) and few.count() < pairs.count()


def test_equal_beginnings_alone_are_no_meeting(spark):
    schema = "document string, page long, id long, text string, block_id long, x0 long, y0 long, x1 long, y1 long"
    spans = spark.createDataFrame([("d", 7, 1, "green tea", None, 0, 0, 10, 10)], schema)
    units = spark.createDataFrame([("d", 1, 10, "greenish", None), ("d", 1, 11, "tea", None)], "document string, page long, id long, text string, block_id long")
    blocks = spans.filter("id < 0")
    assert [(r.span_id, r.unit_id) for r in alignment.scored(spans, units, blocks).collect()] == [(1, 11)]


def test_only_contenders_are_scored_and_the_best_stay_the_same(spark):
    sections = spark.createDataFrame([(i, "d", "C 1", f"0000.00.{i % 100:02d}", f"tea {'green tea ' * (i % 50)}", f"tea number {i}", "s", f"green tea of kind {i % 7} under 20 cm") for i in range(200)], "section_id long, document string, chapter string, hs_code string, title string, section string, source string, text string")
    queries = retrieval.signals(spark.createDataFrame([("q", "green tea of kind 3 under 20 cm"), ("r", "tea")], "query_id string, question string"))
    fields = retrieval.search_fields(sections)
    order = (F.col("score").desc(), F.col("section_id"))
    want = [tuple(r) for r in retrieval.top_k(retrieval.field_scores(queries, fields), 5, *order).orderBy("query_id", "rank").collect()]
    few = retrieval.field_scores(queries, fields, 5)
    assert [tuple(r) for r in retrieval.top_k(few, 5, *order).orderBy("query_id", "rank").collect()] == want and len(want) == 10
    assert few.count() < retrieval.field_scores(queries, fields).count()
    assert T.STOPWORDS
