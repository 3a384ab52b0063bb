"""Reconstruction, section maps, markers, artefacts, strategies and the stream form of job progress."""

import json

from pyspark.sql import functions as F

from dossierlake.operators import expansion, sections
from dossierlake.sources import artefacts
from dossierlake.streaming.jobs import progress_stream

LINES = [
    ("d", 1, 10.0, 0.0, "CHAPTER 9"), ("d", 1, 40.0, 0.0, "0901.11.10"), ("d", 1, 60.0, 0.0, "0901.11.20 COFFEE BEANS"), ("d", 1, 80.0, 0.0, "Green beans of coffee."), ("d", 1, 95.0, 0.0, "(Source: Board)"),
    ("d", 2, 10.0, 0.0, "0902.10.00"), ("d", 2, 30.0, 0.0, "GREEN TEA"), ("d", 2, 50.0, 0.0, "Leaves of tea."),
]


def made(spark):
    lines = spark.createDataFrame(LINES, "document string, page int, y double, x double, text string")
    blocks = lines.select("document", F.concat_ws("-", "page", "y").alias("block_id"), "page", (F.col("page") * 100000 + F.col("y")).alias("order"), "text")
    return sections.build_markdown(lines), blocks


def test_markdown_and_section_map(spark):
    docs, blocks = made(spark)
    text = docs.first().markdown
    assert text.startswith("# CHAPTER 9") and "## 0901.11.10 — COFFEE BEANS" in text and "## 0901.11.20 — COFFEE BEANS" in text and "## 0902.10.00 — GREEN TEA" in text
    rows = {r.code: r for r in sections.section_map(docs, blocks).collect()}
    assert set(rows) == {"0901.11.10", "0901.11.20", "0902.10.00"}
    assert (rows["0902.10.00"].page_start, rows["0902.10.00"].page_end) == (2, 2) and rows["0901.11.20"].source == "Board"
    assert "Grouped HS code set: 0901.11.10, 0901.11.20" in rows["0901.11.10"].body and "Leaves" not in rows["0901.11.20"].body


def test_markers(spark):
    docs, blocks = made(spark)
    assert all(r.passed for r in sections.markers(docs, blocks).collect())
    bad = docs.withColumn("markdown", F.lit("## 0901.11.10 — X\n\n*Caption: 0901.11.10 (Source: y)*\n\n# CHAPTER 9"))
    assert {r.marker for r in sections.markers(bad, blocks).collect() if not r.passed} == {"code_order", "missing_codes", "caption_source", "caption_fusion"}


def test_ragged_tables(spark):
    text = "| a | b |\n|---|---|\n| 1 |\n\n```\n| x |\n| y | z |\n```"
    docs = spark.createDataFrame([("d", text), ("n", None)], "document string, markdown string")
    got = {r.document: r.markdown for r in sections.normalize_tables(docs).collect()}
    assert got["n"] is None and got["d"].split("\n")[2] == "| 1 |  |" and "```\n| x |\n| y | z |\n```" in got["d"]


def test_section_files_and_trees(spark, tmp_path):
    a, b = tmp_path / "all.sections.json", tmp_path / "d.sections.json"
    a.write_text(json.dumps([{"document": "d", "hsCode": "1", "section": "s", "title": "first", "pageStart": 0}]))
    b.write_text(json.dumps([{"document": "d", "hsCode": "1", "section": "s", "title": "second"}, {"document": " ", "title": "none"}, {"document": "d", "hsCode": "2", "section": "t", "textPreview": "p"}]))
    rows = {r.hs_code: r for r in artefacts.read_sections(spark, f"file://{a}", f"file://{b}").collect()}
    assert set(rows) == {"1", "2"} and rows["1"].title == "first" and rows["1"].page_start is None and rows["2"].text == "p"
    (tmp_path / "x.tree.json").write_text(json.dumps({"structure": [{"title": "a"}], "tree": [{"title": "b"}]}))
    (tmp_path / "y.tree.json").write_text("broken")
    trees = {r.document: r.tree for r in artefacts.read_trees(spark, f"file://{tmp_path}").collect()}
    assert json.loads(trees["x"]) == {"nodes": [{"title": "a"}]} and trees["y"] is None
    assert artefacts.newest(artefacts.files(spark, f"file://{tmp_path}", "*.json")).first().path
    assert artefacts.expired(artefacts.files(spark, f"file://{tmp_path}"), F.current_timestamp()).count() == 4


def test_upsert_and_pages(spark):
    old = spark.createDataFrame([("a", "old", None), ("b", "old", None)], "document string, parse_status string, updated_at timestamp")
    new = spark.createDataFrame([("b", "new", None), ("c", "new", None)], "document string, parse_status string, updated_at timestamp")
    assert sorted((r.document, r.parse_status) for r in artefacts.upserted(old, new).collect()) == [("a", "old"), ("b", "new"), ("c", "new")]
    d = spark.createDataFrame([("a\fb", 2), ("a<!-- PageBreak -->b", 2), ("ab", 2)], "t string, n int")
    assert [r.p for r in d.select(artefacts.pages_of(F.col("t"), F.col("n")).alias("p")).collect()] == [["a", "b"], ["a", "b"], ["ab"]]


def test_strategies(spark):
    q = spark.createDataFrame([("1", "green tea"), ("2", "coffee")], "query_id string, question string")
    assert all(r.expansion == [] for r in expansion.expand(q).collect())
    give = lambda _: spark.createDataFrame([("1", ["Tea", "Leaves", "leaves", "camellia"])], "query_id string, terms array<string>")
    assert {r.query_id: r.expansion for r in expansion.expand(q, give, most=2).collect()} == {"1": ["leaves", "camellia"], "2": []}
    ranked = spark.createDataFrame([("q", 1, 1), ("q", 2, 2), ("q", 3, 3)], "query_id string, section_id long, rank int")
    name = lambda _: spark.createDataFrame([("q", 3, "high"), ("q", 2, "low")], "query_id string, section_id long, confidence string")
    assert [r.section_id for r in expansion.rerank(ranked, name).orderBy("rank").collect()] == [3, 1, 2]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = progress_stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("progress").option("checkpointLocation", str(tmp_path / "at")).start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted(map(str, df.select("window.start", "user_id", "n_events", "progress", "failed").collect()))
    assert key(spark.table("progress")) == key(progress_stream(events))
