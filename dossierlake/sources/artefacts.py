"""Artefacts of parsed documents as tables: sections, trees, manifests, file listings; and their sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SECTION = "document string, chapter string, hsCode string, groupedHsCodes array<string>, title string, section string, pageStart int, pageEnd int, source string, text string, textPreview string, captions array<string>, markdownHeading string"
MANIFEST = "document string, input_path string, input_hash string, markdown_hash string, sections_hash string, tree_source_markdown_hash string, parse_status string, page_index_status string, document_type string, hs_section_count int, image_count int, error string, updated_at timestamp"


def _blank(c: str) -> Column:
    """Blank strings count as missing."""
    return F.nullif(F.trim(F.col(c)), F.lit(""))


def read_sections(spark: SparkSession, *paths: str) -> DataFrame:
    """Sections of JSON files, in the order of the paths: normalised, first wins per (document, code, section)."""
    parts = [spark.read.schema(SECTION).option("multiLine", True).json(p).withColumn("_from", F.lit(i)).withColumn("_at", F.monotonically_increasing_id()) for i, p in enumerate(paths)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    page = lambda c: F.when(F.col(c) > 0, F.col(c))
    rows = rows.withColumns({**{c: _blank(c) for c in ("document", "chapter", "hsCode", "title", "section", "source", "text", "textPreview", "markdownHeading")}, "pageStart": page("pageStart"), "pageEnd": page("pageEnd")}).filter("document IS NOT NULL")
    w = Window.partitionBy("document", "hsCode", "section").orderBy("_from", "_at")
    first = rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_from", "_at")
    return first.select("document", "chapter", F.col("hsCode").alias("hs_code"), F.coalesce("groupedHsCodes", F.array().cast("array<string>")).alias("grouped_hs_codes"), "title", "section", F.col("pageStart").alias("page_start"), F.col("pageEnd").alias("page_end"), "source", F.coalesce("text", "textPreview").alias("text"), F.coalesce("captions", F.array().cast("array<string>")).alias("captions"))


def read_trees(spark: SparkSession, folder: str) -> DataFrame:
    """document and tree payload of every *.tree.json: `structure`, else `result`, else `tree`; broken files give a null tree."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.tree.json").text(folder).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.tree\.json$", 1).alias("document"), "value")
    v = files.withColumn("v", F.try_parse_json("value"))
    picked = F.coalesce(*[F.expr(f"try_variant_get(v, '{p}', 'variant')") for p in ("$.structure", "$.rawResponse.structure", "$.result", "$.tree")])
    return v.select("document", F.to_json(picked).alias("nodes")).select("document", F.when(F.col("nodes").isNotNull(), F.concat(F.lit('{"nodes":'), F.col("nodes"), F.lit("}"))).alias("tree"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest records; those without a document or a status go."""
    return spark.read.schema(MANIFEST).json(path).filter("document IS NOT NULL AND parse_status IS NOT NULL")


def upserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """One record per document: the one updated last, of equally old ones the new one."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy("document").orderBy(F.col("updated_at").desc_nulls_last(), F.col("_new").desc())
    return both.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_new")


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, name, modified and length of the files below a folder; their contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return found.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("modificationTime").alias("modified"), "length")


def newest(listing: DataFrame) -> DataFrame:
    return listing.agg(F.max_by("path", F.struct("modified", "length", "path")).alias("path"))


def expired(listing: DataFrame, before: Column) -> DataFrame:
    """Files that a retention rule would delete; .gitkeep stays."""
    return listing.filter((F.col("modified") <= before) & (F.col("name") != ".gitkeep"))


def pages_of(text: Column, n: Column) -> Column:
    """A parsed text by pages: the first of three kinds of breaks that gives as many parts as there are pages, else the whole."""
    kinds = [F.split(text, "\f"), F.split(text, r"(?i)<!--\s*page\s*break\s*-->"), F.split(text, r"(?i)<!--\s*end of page[^>]*-->")]
    return F.coalesce(*[F.when(F.size(k) == n, k) for k in kinds], F.array(text))


def write_artefacts(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as Parquet below the folder."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
