"""What plans ship, repeat and hold, told by the plans themselves: on small rows everything is fast."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossierlake.operators import alignment, checks, retrieval, sections
from dossierlake.plans import checks as checked
from dossierlake.plans import citations, corpus, figures, forms, passages, places, qa, rank
from dossierlake.sources.tables import part_sections

SF = "/root/testdata/sf0.001"


def plan(df) -> list[str]:
    return df._jdf.queryExecution().executedPlan().toString().split("\n")


def below(lines: list[str], at: int) -> list[str]:
    """The lines of a plan's branch under its line `at`."""
    deep = lambda x: len(x) - len(x.lstrip(" :+-"))
    end = next((i for i in range(at + 1, len(lines)) if deep(lines[i]) <= deep(lines[at])), len(lines))
    return lines[at + 1 : end]


@pytest.mark.parametrize("name", ["scores", "few", "candidates"])
def test_no_section_is_broadcast_for_a_question(spark, name):
    made = {"scores": lambda: qa.scores(spark, SF), "few": lambda: qa.scores(spark, SF, 10), "candidates": lambda: rank.candidates(spark, SF)}
    lines = plan(made[name]())
    shipped = [i for i, x in enumerate(lines) if "BroadcastExchange" in x]
    assert shipped and any("SortMergeJoin [section_id" in x for x in lines)
    for i in shipped:
        rows = below(lines, i)
        summed = any("WindowGroupLimit" in x for x in rows)  # the k-th best score of each question
        assert summed or not any("p_type" in x for x in rows), rows


def test_signals_are_told_once_a_question(spark):
    q = retrieval.signals(qa.questions(spark, SF))
    lines = plan(retrieval.token_scores(q, retrieval.search_fields(part_sections(spark, SF))))
    assert not [x for x in lines if " Filter " in x and "size(array_" in x]


def test_markdown_is_split_once_a_document(spark):
    text = "# CHAPTER 1\n\n" + "\n\n".join(f"## 0000.00.{i:02d} — TITLE {i}\n\nbody {i}\n\n# CHAPTER {i}" for i in range(30)) + "\n\n## 0001.00.00 — LAST\n\nend (Source: book)"
    found = sections.markdown_sections(spark.createDataFrame([("d", text), ("e", "plain"), ("f", None)], "document string, markdown string"))
    rows = sorted(tuple(r) for r in found.collect())
    assert rows == [("d", i, f"0000.00.{i:02d}", f"TITLE {i}", f"body {i}", None) for i in range(30)] + [("d", 30, "0001.00.00", "LAST", "end (Source: book)", "book")]
    lines = plan(found)
    assert not any("markdown#" in x for x in lines[: next(i for i, x in enumerate(lines) if "Generate" in x)])


@pytest.mark.parametrize(("name", "told"), [("heading_blocks", {"translate(": 2}), ("answer_blocks", {"translate(": 2, "(?i)<doc=": 1}), ("definition_paragraphs", {"(?i)<doc=": 2})])
def test_texts_of_blocks_are_told_once(spark, name, told):
    """Forms of a line are not copied into every label that is looked for, nor an answer's text into the filters on it."""
    shown = getattr(passages, name)(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert {x: shown.count(x) for x in told} == told
    assert "RepartitionByExpression [section_id" in shown


@pytest.mark.parametrize("name", ["text_forms", "token_sets", "question_names", "section_answers"])
def test_texts_made_of_short_rows_are_spread(spark, name):
    """Parts are a few megabytes in one split; adaptive execution merges partitions by bytes unless their number is given."""
    lines = plan(getattr(forms, name)(spark, SF))
    assert any("REPARTITION_BY_NUM" in x for x in lines)


@pytest.mark.parametrize("name", ["alignment_score", "align_best_match", "overlap_coefficient_pairs"])
def test_equal_texts_are_aligned_once(spark, name):
    """Spans are dealt before they are worked on, none is broadcast, and it is texts that meet units."""
    lines = plan(getattr(checked, name)(spark, SF))
    assert any("REPARTITION_BY_NUM" in x for x in lines)
    for i in [i for i, x in enumerate(lines) if "BroadcastExchange" in x]:
        assert not any("span_id" in x for x in below(lines, i))
    generated = [x for x in lines if "Generate explode" in x]
    assert generated and not any("span_id" in x for x in generated)


def test_spans_of_one_id_are_aligned_by_their_own_rows(spark):
    spans = spark.createDataFrame([(1, "red bolt", ["red", "bolt"]), (1, "red bolt", ["red", "bolt"]), (1, "red", ["red"]), (2, "", [])], "span_id long, text string, tokens array<string>")
    units = spark.createDataFrame([("u", "the red bolt", ["the", "red", "bolt"]), ("v", "red", ["red"])], "unit_id string, text string, tokens array<string>")
    got = lambda df: sorted(tuple(r) for r in df.collect())
    assert got(checks.aligned(spans, units)) == sorted([(1, "u", 126000), (1, "v", 34000)] * 2 + [(1, "u", 92000), (1, "v", 114000)])
    assert got(checks.best_aligned(spans, units, 32000)) == [(1, "u", 126000)]
    assert got(checks.overlaps(spans, units)) == sorted([(1, "u", 1000), (1, "v", 1000)] * 3)


def test_postings_are_counted_where_their_section_is(spark):
    lines = plan(qa.inverted_index(spark, SF))
    shuffles = [x for x in lines if " Exchange " in x]
    assert len(shuffles) == 2 and "REPARTITION_BY_NUM" in shuffles[-1]


def test_ranges_meet_points_in_the_sessions_partitions(spark):
    lines = plan(corpus.page_range_join(spark, SF))
    assert not any("BroadcastExchange" in x for x in lines) and sum("REPARTITION_BY_NUM" in x for x in lines) == 2


def test_rows_of_tables_are_told_where_their_section_is(spark):
    lines = plan(passages.answer_table_rows(spark, SF))
    assert any("REPARTITION_BY_NUM" in x for x in lines) and not any("BroadcastExchange" in x for x in lines)


@pytest.mark.parametrize("name", ["source_excerpts", "source_marks"])
def test_chunks_of_sources_are_told_once(spark, name):
    """Once for the source and once for the answer, and documents of one split are spread."""
    found = getattr(citations, name)(spark, SF)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("(?=(?:Appearance|") == 2
    assert any("REPARTITION_BY_NUM" in x for x in plan(found))


def test_blocks_are_scored_once_for_an_answer(spark):
    lines = plan(passages.focused_answers(spark, SF))
    assert sum("SortMergeJoin [section_id" in x for x in lines) == 1 and not any("BroadcastExchange" in x for x in lines)


def test_lines_of_markdown_are_dealt_once(spark):
    """By document; the pages' blocks are numbered before, and images and tables of the parts come from the blocks again."""
    lines = plan(figures.markdown_parts(spark, SF))
    shuffles = [x for x in lines if " Exchange " in x]
    assert len(shuffles) <= 4 and not any("Join" in x for x in lines), shuffles


def test_blocks_of_pages_are_dealt_once_for_links(spark):
    """Rows are dealt as they are read, by page, and branches share that; only clusters, told in Python, are dealt again."""
    found = figures.image_links(spark, SF)
    found.collect()
    lines = plan(found)
    final = lines[: next(i for i, x in enumerate(lines) if "Initial Plan" in x)]
    shuffles = [x for x in final if " Exchange " in x and "ReusedExchange" not in x]
    assert len(shuffles) == 2 and sum("ReusedExchange" in x for x in final) == 1, shuffles
    assert not any("Generate explode(_" in x for x in final)  # pairs with notes and peers are not written out


def test_scores_of_pairs_are_rounded_where_they_are_made(spark):
    """As Spark rounds, halves of what is written upwards, but not by writing out every number; each pair was once more work for that."""
    shown = places.placed_alignment(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in shown and "round(" not in shown
    draw = np.random.default_rng(3)
    x = np.concatenate([draw.uniform(0, 250, 3000), np.round(draw.uniform(0, 250, 3000), 7), draw.integers(0, 10**6, 3000) / 4096, draw.integers(0, 10**9, 3000) / 1e7, [0.0, 5e-7, 1.5e-6, 80.0000005]])
    x = np.concatenate([x, np.nextafter(x, 0), np.nextafter(x, 999)])
    rows = spark.createDataFrame([(float(v),) for v in x], "x double").select("x", F.round("x", 6).alias("r")).collect()
    assert [r.r for r in rows] == alignment.rounded(np.array([r.x for r in rows])).tolist()


def test_texts_that_hold_each_other_are_found(spark):
    """By single comparisons only where the terms allow it; repeated, cut and one-letter words, and texts without terms."""
    draw = random.Random(9)
    words = ["bolt", "bol", "olt", "red", "a", "x", "12.5", "2.5", "é", "reds", "red.5"]
    told = lambda n, m: spark.createDataFrame([(i, " ".join(draw.choices(words, k=draw.randint(0, m)))) for i in range(n)] + [(n, "olt red"), (n + 1, "bolt reds"), (n + 2, "é")], "id long, text string").withColumn("document", F.lit("d")).withColumn("page", F.lit(1))
    a, b = (alignment.with_terms(told(60, m), "").cache() for m in (3, 9))
    want = {(r.a_id, r.b_id): round(r.s, 9) for r in alignment.with_terms(a.select("document", "page", "id", "text"), "a_").join(alignment.with_terms(b.select("document", "page", "id", "text"), "b_"), ["document", "page"]).select("a_id", "b_id", F.coalesce(alignment.text_score("a_", "b_"), F.lit(0.0)).alias("s")).collect()}
    one, two = (x.select("id", "form", "tokens", "numbers", "codes").toArrow() for x in (a, b))
    for looked_up in (1 << 17, 0):
        held, alignment.LOOKED_UP = alignment.LOOKED_UP, looked_up
        try:
            scores, _ = alignment._texts_scored(one, two)
        finally:
            alignment.LOOKED_UP = held
        said = [t.column("form").to_pylist() for t in (one, two)]
        got = {(i, j): round(float(scores[m, n]), 9) for m, i in enumerate(one.column("id").to_pylist()) for n, j in enumerate(two.column("id").to_pylist()) if said[0][m] and said[1][n]}
        assert got == {k: want[k] for k in got} and sum(v >= 58 for v in got.values()) > 30
