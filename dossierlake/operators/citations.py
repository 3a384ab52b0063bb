"""Excerpts of sources for answers, and where a source is to be marked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierlake.functions import forms as X
from dossierlake.operators.rows import once

# Lengths, and labels before which a source is split.
MOST_EXCERPT, MOST_LINK, LEAST_PHRASE, LEAST_CHUNK = 520, 360, 24, 12
LABELS = "Appearance|Usage|Definition|General requirements|Activeness|Weight and size|Source|HS Code"


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def source_form(c: Column) -> Column:
    """A source as it is shown: comments and heading marks off, images and captions as their words, blanks collapsed, line ends kept."""
    x = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?s)<!--.*?-->", " "), r"!\[([^\]]*)\]\([^)]+\)", "$1")
    x = F.regexp_replace(F.regexp_replace(x, r"(?i)\*Caption:\s*([^*]+)\*", "Caption: $1"), r"(?m)^#{1,6}\s+", "")
    x = F.regexp_replace(F.regexp_replace(x, r"\r\n?", "\n"), r"[ \t]+", " ")
    return _trim(F.regexp_replace(x, r"\n{3,}", "\n\n"))


def source_chunks(c: Column) -> Column:
    """Lines and sentences of twelve characters and more; the whole text where there are none."""
    parts = F.split(F.regexp_replace(c, rf"(?i)\s+(?=(?:{LABELS})\s*:)", "\n"), r"\n+|(?<=[.!?])\s+(?=[A-Z0-9])")
    kept = F.filter(F.transform(parts, lambda p: source_form(p)), lambda p: F.length(p) >= LEAST_CHUNK)
    return X.let(kept, lambda k: F.when(F.size(k) > 0, k).otherwise(F.array(c)))


def truncated(c: Column, most: int) -> Column:
    cut = lambda x: F.concat(_trim(F.regexp_replace(F.left(x, F.lit(most)), r"\s+\S*$", "")), F.lit("..."))
    return X.let(source_form(c), lambda x: F.when(F.length(x) <= most, x).otherwise(cut(x)))


def with_excerpts(rows: DataFrame, source: str = "source", answer: str = "answer") -> DataFrame:
    """The rows with excerpt: the longest chunk of the answer that the source holds word for word, else the chunk of the
    source that shares the most tokens with the answer (the first on ties), else the source's first chunk; shortened."""
    laid = once(rows, {"_clean": source_form(F.col(source)), "_asked": F.coalesce(F.col(answer), F.lit(""))})
    laid = once(laid, {"_lower": F.lower("_clean"), "_chunks": source_chunks(F.col("_clean")), "_said": F.array_distinct(X.source_tokens(F.col("_asked"))), "_parts": source_chunks(F.col("_asked"))})
    exact = F.filter(F.transform("_parts", lambda p: source_form(p)), lambda p: (F.length(p) >= LEAST_PHRASE) & F.contains(F.col("_lower"), F.lower(p)))
    longest = F.array_min(F.transform(exact, lambda p, i: F.struct((-F.length(p)).alias("less"), i.alias("i"), p.alias("text"))))["text"]
    scored = F.transform("_chunks", lambda t, i: F.struct((-F.size(F.array_intersect(X.source_tokens(t), F.col("_said")))).alias("less"), i.alias("i"), t.alias("text")))
    best = F.when((F.btrim("_asked") == "") | (F.size("_said") == 0), F.col("_chunks")[0]).otherwise(F.array_min(scored)["text"])
    # chunks are only counted where no part of the answer stands there as it is
    excerpt = F.when(F.col("_clean") == "", "").otherwise(truncated(F.coalesce(longest, best), MOST_EXCERPT))
    return once(laid, {"excerpt": excerpt}).drop("_clean", "_asked", "_lower", "_chunks", "_said", "_parts")


def escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def with_marks(rows: DataFrame, source: str = "source", answer: str = "answer") -> DataFrame:
    """The rows with mark_start and mark_end (characters from 0) and marked, the escaped source with that part in a mark.

    The part is where the source holds the answer as a whole, else where it holds the answer's excerpt, else all of it; an
    empty answer marks nothing (null).
    """
    asked = _trim(F.regexp_replace(source_form(F.col(answer)), r"\.\.\.$", ""))
    laid = with_excerpts(rows.withColumn("_whole", asked), source, "_whole").withColumn("_low", F.lower(F.col(source)))
    at = F.position(F.lower("_whole"), F.col("_low")) - 1
    bare = F.regexp_replace("excerpt", r"\.\.\.$", "")
    then = F.when(bare != "", F.position(F.lower(bare), F.col("_low")) - 1).otherwise(-1)
    laid = laid.withColumns({"_at": at, "_then": then})
    start = F.when(F.col("_whole") == "", F.lit(None)).when(F.col("_at") >= 0, F.col("_at")).when(F.col("_then") >= 0, F.col("_then")).otherwise(0)
    length = F.when(F.col("_at") >= 0, F.length("_whole")).when(F.col("_then") >= 0, F.length("excerpt")).otherwise(F.length(source))
    laid = laid.withColumn("mark_start", start).withColumn("mark_end", F.when(F.col("mark_start").isNotNull(), F.least(F.col("mark_start") + length, F.length(source))))
    cut = lambda a, b: escaped(F.substring(F.col(source), a + 1, b - a))
    a, b = F.col("mark_start"), F.col("mark_end")
    marked = F.concat(cut(F.lit(0), a), F.lit('<mark id="source-hit">'), cut(a, b), F.lit("</mark>"), cut(b, F.length(source)))
    return laid.withColumn("marked", F.when(a.isNull(), escaped(F.col(source))).otherwise(marked)).drop("_whole", "_low", "_at", "_then")


def with_links(citations: DataFrame) -> DataFrame:
    """Citations (document, hs_code, section, page_start, page_end, excerpt) with pdf_url, page_url and source_url; null for documents that are no PDF."""
    name = F.element_at(F.split("document", "/"), -1)
    known = F.lower(name).endswith(".pdf")
    page = F.when(F.col("page_start") > 0, F.col("page_start")).when(F.col("page_end") > 0, F.col("page_end"))
    # encodes as a form does: blanks as plus signs
    given = [("page", page.cast("string")), ("hsCode", F.col("hs_code")), ("section", truncated(F.col("section"), 180)), ("q", truncated(F.col("excerpt"), MOST_LINK))]
    query = F.array_join(F.array_compact(F.array(*[F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{k}="), F.url_encode(v))) for k, v in given])), "&")
    path = F.replace(F.url_encode(name), F.lit("+"), F.lit("%20"))
    pdf = F.when(known, F.concat(F.lit("/api/uploads/"), path))
    return citations.withColumns({
        "pdf_url": pdf,
        "page_url": F.when(page.isNotNull(), F.concat(pdf, F.lit("#page="), page.cast("string"))),
        "source_url": F.when(known & (F.coalesce("excerpt", F.lit("")) != ""), F.concat(F.lit("/api/source/"), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""), F.lit("#source-hit"))),
    })
