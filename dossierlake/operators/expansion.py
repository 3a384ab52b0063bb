"""Query expansion, reranking and verification as replaceable strategies; by default they change nothing."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossierlake.functions import text as T


class Expander(Protocol):
    def __call__(self, queries: DataFrame) -> DataFrame:
        """query_id and terms (array<string>) for some or all queries."""


class Reranker(Protocol):
    def __call__(self, ranked: DataFrame) -> DataFrame:
        """query_id, section_id and confidence (low, medium, high) of the candidates to move to the front."""


def expand(queries: DataFrame, expander: Expander | None = None, cached: DataFrame | None = None, most: int = 12) -> DataFrame:
    """Queries with an array of expansion terms: from the cache, else from the expander, else none.

    Terms are normalised, each once, without those the question has; at most `most` stay.
    """
    key = T.normalize_search(F.col("question"))
    q = queries.withColumn("_key", key)
    none = F.array().cast("array<string>")
    known = q.join(cached.select("_key", F.col("terms").alias("_cached")), "_key", "left") if cached is not None else q.withColumn("_cached", F.lit(None).cast("array<string>"))
    made = known.join(expander(queries).select("query_id", F.col("terms").alias("_made")), "query_id", "left") if expander else known.withColumn("_made", F.lit(None).cast("array<string>"))
    terms = F.transform(F.coalesce("_cached", "_made", none), T.normalize_search)
    clean = F.slice(F.filter(F.array_distinct(terms), lambda t: (t != "") & ~F.contains(F.col("_key"), t)), 1, most)
    return made.withColumn("expansion", clean).drop("_key", "_cached", "_made")


def rerank(ranked: DataFrame, reranker: Reranker | None = None) -> DataFrame:
    """Ranked candidates (query_id, section_id, rank), those that the reranker names with at least medium confidence first."""
    if reranker is None:
        return ranked
    from pyspark.sql.window import Window

    named = reranker(ranked).filter(F.col("confidence").isin("medium", "high")).select("query_id", "section_id", F.lit(0).alias("_first"))
    w = Window.partitionBy("query_id").orderBy(F.coalesce("_first", F.lit(1)), "rank")
    return ranked.join(named, ["query_id", "section_id"], "left").withColumn("rank", F.row_number().over(w)).drop("_first")
