"""Local answers and sources: blocks, scores, tables and marks on texts as documents have them."""

import random
import re

import pytest
from pyspark.sql import functions as F

from dossierlake.functions import forms as X
from dossierlake.functions import text as T
from dossierlake.operators import citations as C
from dossierlake.operators import passages as W

TEXT = """## 0901.21.10 — COFFEE
Grouped HS code set: 0901.21.10, 0901.21.20.
Shared description:
Roasted beans of one kind. Appearance: round and smooth. Usage: for espresso.
• keeps dry for 12 days
• packed in bags
| Part | Mature | Young |
| --- | --- | --- |
| Protein mg% | 1.5 | 2.25 |
Source: a book
The taste is bitter and the aroma is strong. It grows high up. Weight and size: small"""


def blocks_of(spark, text):
    return [(r.heading, r.kind, r.text) for r in W.answer_blocks(spark.createDataFrame([("s", text)], "section_id string, text string")).orderBy("block").collect()]


def test_blocks_of_a_section(spark):
    assert blocks_of(spark, TEXT) == [
        ("", "paragraph", "Roasted beans of one kind."), ("Appearance", "paragraph", "round and smooth."), ("Usage", "paragraph", "for espresso."),
        ("Usage", "bullet", "Usage: keeps dry for 12 days: packed in bags"), ("Usage", "table", "| Part | Mature | Young |"), ("Usage", "table", "| Protein mg% | 1.5 | 2.25 |"),
        ("Usage", "paragraph", "The taste is bitter and the aroma is strong. It grows high up."),
    ]
    assert blocks_of(spark, "") == [] and blocks_of(spark, "12 34") == []


def asked(spark, *questions):
    return W.signals(spark.createDataFrame([(f"q{i}", "s", q) for i, q in enumerate(questions)], "query_id string, section_id string, question string"))


def sections(spark, text):
    return spark.createDataFrame([("s", text)], "section_id string, text string")


def test_answers_from_blocks(spark):
    q = asked(spark, "What is its appearance?", "How bitter is the taste of the strong aroma?", "zebra crossing velocity")
    found = {r.query_id: r.answer for r in W.focused_answers(W.best_blocks(q, W.answer_blocks(sections(spark, TEXT)))).collect()}
    assert found == {"q0": "round and smooth.", "q1": "The taste is bitter and the aroma is strong."}
    assert W.definitions(sections(spark, TEXT)).first().definition == "Roasted beans of one kind."
    assert W.definitions(sections(spark, "")).count() == 0


def test_scores_count_words_ranges_and_what_is_missing(spark):
    q = asked(spark, "smooth roasted beans under 12 cm")
    rows = [("s", "", "paragraph", "roasted beans, under 12 cm"), ("s", "", "bullet", "smooth"), ("s", "", "paragraph", "nothing here")]
    got = {r.text: r.score for r in W.scored_passages(q, spark.createDataFrame(rows, "section_id string, heading string, kind string, text string")).collect()}
    signals = q.first()
    for _, _, kind, text in rows:
        n = text.lower()
        words = set(re.findall(r"[a-z0-9.]+", n))
        want = sum(3.5 for p in signals.phrases if p in n) + sum(3 for r in signals.ranges if r in n)
        equal = {"smooth": {"smooth", "smoother"}}
        held = lambda t: bool(equal.get(t, {t}) & words)  # noqa: B023, E731
        want += sum(1.7 if len(t) >= 5 or re.search(r"\d", t) else 0.6 for t in signals.tokens if held(t))
        want -= max(0, sum(1 for t in signals.tokens if (len(t) >= 5 or re.search(r"\d", t)) and not held(t)) - 3) * 1.2 - (0.8 if kind == "bullet" else 0)
        assert got[text] == round(want, 6), text
    assert signals.field is None and "beans under 12" in signals.phrases


def test_fields_of_a_section(spark):
    q = asked(spark, "What is its appearance?", "what is its packaging", "How is it used?", "How bitter is it")
    got = {r.query_id: (r.extracted, r.matched_heading, r.confidence, r.fallback) for r in W.extracted_fields(q, sections(spark, "Appearance: round and smooth\n- and brown\nUsage\nSource: a book\nIt is a bean of purpose.")).collect()}
    assert got["q0"] == ("round and smooth and brown", "Appearance", "high", False) and got["q2"] == ("Usage", "Usage", "high", False)
    assert set(got) <= {"q0", "q1", "q2"}  # the last asks for no field


def flattened(text):
    """Runs of a label and two numbers, told word by word."""
    words, out, since = text.split(), [], 0
    number = re.compile(r"-?\d+(\.\d+)?$")
    i = 1
    while i + 1 < len(words):
        if number.match(words[i]) and number.match(words[i + 1]) and (i + 2 == len(words) or words[i + 2][0].isalpha()):
            label = re.search(r"[A-Za-z][A-Za-z /()%.-]*$", " ".join(words[since:i]))
            if label:
                out.append((label[0], words[i], words[i + 1]))
            since = i + 2
            i += 2
        i += 1
    return out


def test_flattened_tables(spark):
    draw = random.Random(2)
    cells = ["Fat", "Ash (total)", "Vitamin C mg%", "raw 7", "B12 rich", "Dry/wet part"]
    text = "Kinds of it: mature and young " + " ".join(f"{draw.choice(cells)} {draw.randint(0, 90)} {draw.randint(0, 90) / 4}" for _ in range(40))
    q = asked(spark, "which has more fat, mature or young")
    got = [(r.label, r["values"][0].raw, r["values"][1].raw) for r in W.flattened_rows(q, sections(spark, text)).orderBy("place").collect()]
    assert got == flattened(text) and len(got) > 30
    assert W.flattened_rows(q, sections(spark, "Fat 1 2 Ash 3 4")).count() == 2  # the question speaks of both kinds
    assert W.flattened_rows(asked(spark, "fat?"), sections(spark, "Fat 1 2 Ash 3 4")).count() == 0


@pytest.mark.parametrize(("question", "answer"), [
    ("Which has higher protein, arabica or robusta?", "Robusta has higher protein: 2.25 mg% compared with arabica 1.5 mg%."),
    ("Is the protein lower in robusta or excelsa?", "Excelsa has lower protein: 1 mg% compared with robusta 2.25 mg%."),
    ("How much protein?", None), ("Which has more sugar?", None),
])
def test_comparisons(spark, question, answer):
    text = "| Part | Arabica | Robusta | Excelsa |\n| --- | --- | --- | --- |\n| Protein mg% | 1.5 | 2.25 | 1 |\n| Fat % | 9 | 8 | 7 |"
    q = asked(spark, question)
    found = W.comparison_answers(W.compared_values(q, W.table_rows(q, sections(spark, text)))).collect()
    assert [r.answer for r in found] == ([answer] if answer else [])


def test_equal_values_and_first_rows_of_a_label(spark):
    text = "| x | A | B |\n|---|---|---|\n| Fat % | 3 | 3 |\n| Fat % | 4 | 9 |\nshort\n| Lost | 1 | 2 |"
    q = asked(spark, "which has more fat")
    rows = W.table_rows(q, sections(spark, text)).collect()
    assert [(r.label, [v.raw for v in r["values"]]) for r in rows if r.label == "Fat %"] == [("Fat %", ["3", "3"])]
    assert W.comparison_answers(W.compared_values(q, W.table_rows(q, sections(spark, text)))).first().answer == "A and b have the same fat: 3%."


def test_lists_are_trimmed_and_keep_their_digits(spark):
    one = lambda f, t: spark.createDataFrame([(t,)], "t string").select(f(F.col("t")).alias("x")).first().x
    assert one(T.sentences, "0 is none. 1 is one.  2 and 2. Size 3") == ["0 is none.", "1 is one.", "2 and 2.", "Size 3"]
    assert one(X.paragraphs, "0 is the first of all\n\n 1 is the second of all ") == ["0 is the first of all", "1 is the second of all"]
    assert one(X.captions, "*Caption: 0 roots *") == ["0 roots"]


def excerpt(spark, source, answer):
    return C.with_excerpts(spark.createDataFrame([(source, answer)], "source string, answer string")).first().excerpt


def test_excerpts(spark):
    source = "# Coffee\n\nIt is grown in the high lands of the south. The beans are roasted twice.<!-- x --> Usage: for espresso and for cakes."
    assert excerpt(spark, source, "Well. It is grown in the HIGH lands of the south.") == "It is grown in the HIGH lands of the south."
    assert excerpt(spark, source, "roasted beans twice") == "The beans are roasted twice."
    assert excerpt(spark, source, None) == "It is grown in the high lands of the south." == excerpt(spark, source, "??")
    assert excerpt(spark, "", "x") == "" and excerpt(spark, None, "x") == ""
    assert len(excerpt(spark, "word " * 400, None)) <= 523 and excerpt(spark, "word " * 400, None).endswith("word...")


def test_marks(spark):
    rows = [("a <b> c & the end of it", "THE END"), ("one two three", "zzz"), ("one", ""), ("one", None), ("The beans are dry. The leaves are green and long.", "green leaves, long ones")]
    got = [(r.mark_start, r.mark_end, r.marked) for r in C.with_marks(spark.createDataFrame([(s, a, i) for i, (s, a) in enumerate(rows)], "source string, answer string, i int")).orderBy("i").collect()]
    assert got[0] == (10, 17, 'a &lt;b&gt; c &amp; <mark id="source-hit">the end</mark> of it') and got[1] == (0, 13, '<mark id="source-hit">one two three</mark>')
    assert got[2] == (None, None, "one") == got[3] and rows[4][0][got[4][0] : got[4][1]] == "The leaves are green and long."
