"""Markers of trees, answers and contexts: what is missing, what is too large, and whether they pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierlake.functions import forms
from dossierlake.functions import text as T

# The most characters of a targeted context, and the most words of an answer.
CONTEXT_CHARS, ANSWER_WORDS = 1500, 120


def tree_integrity(expected: DataFrame, nodes: DataFrame, sections: DataFrame) -> DataFrame:
    """Per document: whether tree and section map hold every expected code.

    expected: document, code. nodes: document, text, summary. sections: document, code, page_start, page_end.
    Missing summaries and page ranges are warnings; a document without codes needs a tree only.
    """
    told = nodes.select("document", F.explode(T.codes(F.col("text"))).alias("code"), F.col("summary").isNull().alias("bare"))
    in_tree = told.groupBy("document", "code").agg(F.min("bare").alias("no_summary"))
    in_map = sections.groupBy("document", "code").agg(F.max(F.col("page_start").isNull() | F.col("page_end").isNull()).alias("no_range"))
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), "|")
    both = expected.distinct().join(in_tree, ["document", "code"], "left").join(in_map, ["document", "code"], "left")
    codes = both.groupBy("document").agg(
        F.count(F.lit(1)).alias("n_codes"),
        joined(F.when(F.col("no_summary").isNull(), F.col("code"))).alias("missing_in_tree"),
        joined(F.when(F.col("no_range").isNull(), F.col("code"))).alias("missing_in_map"),
        joined(F.when(F.col("no_summary"), F.col("code"))).alias("missing_summaries"),
        joined(F.when(F.col("no_range"), F.col("code"))).alias("missing_ranges"),
    )
    counts = nodes.groupBy("document").agg(F.count(F.lit(1)).alias("n_nodes"), F.count("summary").alias("n_summaries"))
    maps = sections.groupBy("document").agg(F.countDistinct("code").alias("n_mapped"))
    every = codes.join(counts, "document", "full_outer").join(maps, "document", "left").fillna(0, ["n_codes", "n_nodes", "n_summaries", "n_mapped"])
    coded = F.col("n_codes") > 0
    errors = F.array_compact(F.array(
        F.when(F.col("n_nodes") == 0, "tree-missing-or-invalid"),
        F.when(coded & (F.col("missing_in_tree") != ""), "missing-hs-codes-in-tree"),
        F.when(coded & (F.col("n_mapped") == 0), "section-map-missing-or-invalid"),
        F.when(coded & (F.col("missing_in_map") != ""), "missing-hs-codes-in-section-map"),
    ))
    return every.select("*", F.array_join(errors, "|").alias("errors"), (F.size(errors) == 0).alias("passed"))


def answer_markers(answer: Column, context: Column) -> list[Column]:
    """Citations, context size and answer size, each with whether it passes."""
    n = F.size(forms.citations(answer)).cast("long")
    words = F.size(T.words_of(F.btrim(answer))).cast("long")
    return [
        n.alias("n_citations"), (n > 0).alias("cited"),
        F.length(context).cast("long").alias("context_chars"), (F.length(context) <= CONTEXT_CHARS).alias("context_fits"),
        words.alias("answer_words"), (words <= ANSWER_WORDS).alias("answer_fits"),
    ]
