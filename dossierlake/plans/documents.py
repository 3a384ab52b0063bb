"""Reconstruction of documents from lines; the coded sections of `part`, line by line, stand for layout text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierlake.operators import corpus, sections
from dossierlake.registry import query
from dossierlake.sources.tables import part_sections, part_sections_sql, table

SECTIONS = part_sections_sql()


def layout_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = part_sections(spark, sf_dir)
    each = s.select("document", F.col("page_start").alias("page"), "section_id", F.posexplode(F.array("hs_code", "title", "text")).alias("i", "text"))
    return each.select("document", "page", (F.col("section_id") * 30.0 + F.col("i") * 10.0).alias("y"), F.lit(0.0).alias("x"), "text")


def layout_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout_lines(spark, sf_dir).select("document", F.concat_ws("-", "page", "y").alias("block_id"), "page", (F.col("page") * 1e9 + F.col("y")).alias("order"), "text")


@query("markdown_sections", f"SELECT document, hs_code AS code, title, text AS body FROM ({SECTIONS})")
def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines to Markdown and back to sections: a round trip that returns every section as it was."""
    built = sections.build_markdown(layout_lines(spark, sf_dir))
    return sections.markdown_sections(built).select("document", "code", "title", "body")


@query("section_map", f"SELECT document, hs_code AS code, title, page_start, page_start AS page_end, CAST(NULL AS VARCHAR) AS warning FROM ({SECTIONS})")
def section_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = sections.build_markdown(layout_lines(spark, sf_dir))
    return sections.section_map(built, layout_blocks(spark, sf_dir)).select("document", "code", "title", "page_start", "page_end", "warning")


@query("document_markers", f"SELECT document, m.marker, m.passed FROM (SELECT DISTINCT document FROM ({SECTIONS})), (VALUES ('headers', true), ('code_order', true), ('missing_codes', true), ('caption_source', true), ('caption_fusion', true)) m(marker, passed)")
def document_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = sections.build_markdown(layout_lines(spark, sf_dir))
    return sections.markers(built, layout_blocks(spark, sf_dir)).select("document", "marker", "passed")


@query(
    "json_tree_flatten",
    """WITH k AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1 AS i FROM conversations)
    SELECT CAST(conv_id AS VARCHAR) AS document, lpad(CAST(i AS VARCHAR), 4, '0') AS path, 1 AS level, role AS title, 1 AS child_count FROM k UNION ALL
    SELECT CAST(conv_id AS VARCHAR), lpad(CAST(i AS VARCHAR), 4, '0') || '/0000', 2, 'turn ' || turn, 0 FROM k""",
)
def json_tree_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as trees: a node per turn with one child, written as JSON and flattened again."""
    c = table(spark, sf_dir, "conversations")
    node = F.struct("turn", "role", F.struct(F.col("role").alias("title"), F.array(F.struct(F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("title"))).alias("children")).alias("node"))
    trees = c.groupBy(F.col("conv_id").cast("string").alias("document")).agg(F.to_json(F.struct(F.transform(F.sort_array(F.collect_list(node)), lambda x: x["node"]).alias("nodes"))).alias("tree"))
    return corpus.flatten_json_tree(trees).select("document", "path", "level", "title", "child_count")
