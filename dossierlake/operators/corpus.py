"""Corpus operators: dedupe, merging, hydration, ranges, scope, trees and ordered sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dossierlake.operators.rows import spread


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of every key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def merge_candidates(df: DataFrame) -> DataFrame:
    """Candidates of one (document, title): highest score, longest text, all captions in order."""
    return df.groupBy("document", "title").agg(
        F.max("score").alias("score"),
        F.max_by("text", F.struct(F.length("text"), F.col("text"))).alias("text"),
        F.array_join(F.sort_array(F.collect_set("section")), "|").alias("sections"),
    )


def quality_of(text: Column) -> Column:
    """How much of a section a text holds: its length, less 500 if it looks like a clipped preview."""
    return F.length(text) - F.when((F.length(text) < 700) & F.contains(text, F.lit("...")), 500).otherwise(0)


def best_text(*texts: Column) -> Column:
    """The text of the highest quality; the earlier one on ties."""
    scored = [F.struct(F.coalesce(quality_of(t), F.lit(-(10**9))).alias("q"), F.lit(-i).alias("i"), t.alias("t")) for i, t in enumerate(texts)]
    return F.greatest(*scored)["t"]


def repair_page_ranges(df: DataFrame, keys: list[str]) -> DataFrame:
    """Missing page ranges of grouped sections, from the least and greatest page of their group."""
    w = Window.partitionBy(*keys)
    return df.withColumns({
        "page_start": F.coalesce("page_start", F.min("page_start").over(w)),
        "page_end": F.coalesce("page_end", F.max("page_end").over(w)),
    })


def sessions(df: DataFrame, by: list[str], at: str, order: list[str], gap: float) -> DataFrame:
    """A running number per key that grows where the distance to the row before exceeds the gap."""
    w = Window.partitionBy(*by).orderBy(*order)
    new = (F.col(at) - F.lag(at).over(w) > gap).cast("int")
    return df.withColumn("session", F.sum(F.coalesce(new, F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def carried(df: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The last value that is not null up to each row."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def zip_by_place(left: DataFrame, right: DataFrame, by: list[str], left_order: list[str], right_order: list[str]) -> DataFrame:
    """Rows of both sides with the same place in their key's order, side by side; what has no partner stays."""
    number = lambda df, order: df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return number(left, left_order).join(number(right, right_order), [*by, "place"], "full_outer")


def range_join(points: DataFrame, ranges: DataFrame, key: str, at: str, low: str, high: str, width: int = 16) -> DataFrame:
    """Points inside closed ranges of the same key: both are filed by cells of `width`, so the join is by equality."""
    cells = ranges.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    filed = points.withColumn("_cell", F.floor(F.col(at) / width))
    # short rows that meet in many pairs: the session's partitions share them out, none is shipped to all
    return spread(filed, key, "_cell").join(spread(cells, key, "_cell").hint("merge"), [key, "_cell"]).filter(F.col(at).between(F.col(low), F.col(high))).drop("_cell")


def html_nodes(pages: DataFrame) -> DataFrame:
    """page_id, place, level, kind and text of a page's headings, paragraphs and links, in reading order."""
    tags = F.regexp_extract_all("html", F.lit(r"(?s)<(h1|h2|p|li)\b[^>]*>[^<]*"), F.lit(0))
    each = pages.select("page_id", F.posexplode(tags).alias("place", "raw"))
    kind = F.regexp_extract("raw", r"^<(\w+)", 1)
    return each.select("page_id", F.col("place").cast("long").alias("place"), F.when(kind == "h1", 1).when(kind == "h2", 2).otherwise(3).alias("level"), kind.alias("kind"), F.trim(F.regexp_replace("raw", r"^<[^>]*>", "")).alias("text"))


def tree_of(nodes: DataFrame) -> DataFrame:
    """Every node's parent: the last earlier node of a lower level on its page; at the top none."""
    w = Window.partitionBy("page_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda level: F.max(F.when(F.col("level") == level, F.col("place"))).over(w)
    return nodes.withColumn("parent", F.when(F.col("level") == 2, last(1)).when(F.col("level") == 3, F.greatest(last(1), last(2))))


def flatten_json_tree(trees: DataFrame, key: str = "document", payload: str = "tree", depth: int = 64) -> DataFrame:
    """Nodes of nested JSON trees, level by level: `nodes` of a node, or else its `children`; text joins text, summary and prefix summary.

    Each level is one projection and explode over what the level above left; it ends when no node has
    children. Trees of more than `depth` levels raise an error: nothing is left out.
    """
    children = F.coalesce(F.expr("variant_get(node, '$.nodes', 'array<variant>')"), F.expr("variant_get(node, '$.children', 'array<variant>')"))
    now = trees.select(key, F.lit("").alias("path"), F.lit(0).alias("level"), F.parse_json(payload).alias("node"))
    out = None
    for level in range(depth + 1):
        now = now.select(key, "path", "level", F.posexplode(children).alias("i", "child")).select(key, F.concat_ws("/", F.nullif("path", F.lit("")), F.lpad(F.col("i").cast("string"), 4, "0")).alias("path"), (F.col("level") + 1).alias("level"), F.col("child").alias("node"))
        now = now.persist()
        if now.isEmpty():
            break
        if level == depth:
            raise ValueError(f"a tree has more than {depth} levels")
        text = F.concat_ws(" ", *[F.expr(f"variant_get(node, '$.{x}', 'string')") for x in ("text", "summary", "prefix_summary")])
        rows = now.select(key, "path", "level", F.expr("variant_get(node, '$.title', 'string')").alias("title"), text.alias("text"), F.coalesce(F.size(children), F.lit(0)).alias("child_count"))
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else trees.sparkSession.createDataFrame([], f"{key} string, path string, level int, title string, text string, child_count int")
