"""The supplied tables and the views of them that stand for sections, blocks, questions and jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coded sections: one per part, its brand as the document."""
    p = table(spark, sf_dir, "part")
    digits = F.lpad(F.col("p_partkey").cast("string"), 8, "0")
    code = F.concat(F.substring(digits, 1, 4), F.lit("."), F.substring(digits, 5, 2), F.lit("."), F.substring(digits, 7, 2))
    title = F.upper("p_name")
    return p.select(
        F.col("p_partkey").alias("section_id"),
        F.col("p_brand").alias("document"),
        F.concat(F.lit("CHAPTER "), F.col("p_size").cast("string")).alias("chapter"),
        code.alias("hs_code"),
        title.alias("title"),
        F.concat(code, F.lit(" — "), title).alias("section"),
        F.col("p_size").cast("int").alias("page_start"),
        (F.col("p_size") + 1).cast("int").alias("page_end"),
        F.lit("parts list").alias("source"),
        F.concat(F.lit("Type "), F.lower("p_type"), F.lit(". Size "), F.col("p_size").cast("string"), F.lit(" cm. Sold as "), F.col("p_name"), F.lit(".")).alias("text"),
    )


def part_sections_sql() -> str:
    code = "substr(d, 1, 4) || '.' || substr(d, 5, 2) || '.' || substr(d, 7, 2)"
    return f"""SELECT p_partkey AS section_id, p_brand AS document, 'CHAPTER ' || p_size AS chapter, {code} AS hs_code, upper(p_name) AS title, {code} || ' — ' || upper(p_name) AS section,
    CAST(p_size AS INT) AS page_start, CAST(p_size + 1 AS INT) AS page_end, 'parts list' AS source, 'Type ' || lower(p_type) || '. Size ' || p_size || ' cm. Sold as ' || p_name || '.' AS text
    FROM (SELECT *, lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS d FROM part)"""


def document_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections with running text: one per document row, its first line as the title."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.col("source").alias("document"), F.substring_index("text", "\n", 1).alias("title"), "text", "lang")
