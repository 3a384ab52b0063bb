"""Excerpts, marks and links of sources: documents answered by a piece of their own, by words of theirs, or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierlake.functions import forms as X
from dossierlake.operators import citations
from dossierlake.operators.rows import spread
from dossierlake.plans.forms import _low, _search_form, _sub
from dossierlake.registry import query
from dossierlake.sources.tables import part_sections, part_sections_sql, table

_ANSWER = "CASE doc_id % 4 WHEN 0 THEN translate(substr(text, 21, 60), 'aeinrst', 'AEINRST') WHEN 1 THEN 'Of it: ' || substr(text, 40, 25) || '. And ' || substr(text, 140, 150) || ' so' WHEN 2 THEN substr(text, 200, 300) || '...' ELSE NULL END"


def answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select("doc_id", F.col("text").alias("source"), F.expr(_ANSWER).alias("answer"))


_TRIM = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _source(x: str) -> str:
    x = _sub(_sub(f"coalesce({x}, '')", "(?s)<!--.*?-->", " "), r"!\[([^\]]*)\]\([^)]+\)", r"\1")
    x = _sub(_sub(x, r"(?i)\*Caption:\s*([^*]+)\*", r"Caption: \1"), r"(?m)^#{1,6}\s+", "")
    return _TRIM(_sub(_sub(_sub(x, r"\r\n?", "\n"), r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def _chunks(x: str) -> str:
    parts = _sub(_sub(x, rf"(?i)\s+(({citations.LABELS})\s*:)", "\n\\1"), r"([.!?])\s+([A-Z0-9])", "\\1\n\\2")
    kept = f"list_filter(list_transform(string_split_regex({parts}, '\\n+'), lambda p: {_source('p')}), lambda p: length(p) >= 12)"
    return f"CASE WHEN len({kept}) > 0 THEN {kept} ELSE [{x}] END"


def _tokens(x: str) -> str:
    form = _sub(_sub(_low(x), r"\bca\s+phe\b", "coffee"), r"\bwoodchips\b", "wood chips")
    stop = ", ".join(f"'{w}'" for w in X.SEARCH_STOPWORDS)
    return f"list_distinct(list_filter(list_transform(string_split_regex({form}, '[^a-z0-9.]+'), lambda t: {_search_form('t')}), lambda t: length(t) >= 3 AND t NOT IN ({stop})))"


def _short(x: str, most: int) -> str:
    return f"CASE WHEN length({x}) <= {most} THEN {x} ELSE {_TRIM(f'''regexp_replace(left({x}, {most}), '\\s+\\S*$', '')''')} || '...' END"


def _excerpts(source: str) -> str:
    """ex: key, source, whole (the answer as it is looked for) and excerpt of the rows of `source`."""
    return f"""a0 AS (SELECT *, {_source("source")} AS clean FROM {source}), a1 AS (SELECT *, {_chunks("clean")} AS chunks, {_tokens("whole")} AS said, list_transform({_chunks("whole")}, lambda p: {_source("p")}) AS parts FROM a0),
    a2 AS (SELECT *, list_filter(parts, lambda p: length(p) >= 24 AND contains(lower(clean), lower(p))) AS exact, list_transform(chunks, lambda c: len(list_intersect({_tokens("c")}, said))) AS points FROM a1),
    a3 AS (SELECT *, CASE WHEN len(exact) > 0 THEN exact[list_position(list_transform(exact, lambda p: length(p)), list_max(list_transform(exact, lambda p: length(p))))] WHEN len(said) = 0 THEN chunks[1] ELSE chunks[list_position(points, list_max(points))] END AS found FROM a2),
    ex AS (SELECT *, CASE WHEN clean = '' THEN '' ELSE {_short("found", 520)} END AS excerpt FROM (SELECT * REPLACE ({_source("found")} AS found) FROM a3))"""


_ROWS = f"(SELECT doc_id, text AS source, coalesce({_ANSWER}, '') AS whole FROM documents)"


@query("source_excerpts", f"WITH {_excerpts(_ROWS)} SELECT doc_id, excerpt FROM ex")
def source_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of each document that bears out its answer."""
    return citations.with_excerpts(answered(spark, sf_dir)).select("doc_id", "excerpt")


_WHOLE = f"(SELECT doc_id, text AS source, {_TRIM('regexp_replace(' + _source(_ANSWER) + ', ' + chr(39) + chr(92) + '.' + chr(92) + '.' + chr(92) + '.$' + chr(39) + ', ' + chr(39) * 2 + ')')} AS whole FROM documents)"
_ESCAPED = lambda x: f"replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@query(
    "source_marks",
    f"""WITH {_excerpts(_WHOLE)}, m AS (SELECT doc_id, source, whole, excerpt, strpos(lower(source), lower(whole)) - 1 AS at_, CASE WHEN excerpt <> '' THEN strpos(lower(source), lower(regexp_replace(excerpt, '\\.\\.\\.$', ''))) - 1 ELSE -1 END AS then_ FROM ex),
    n AS (SELECT *, CASE WHEN whole = '' THEN NULL WHEN at_ >= 0 THEN at_ WHEN then_ >= 0 THEN then_ ELSE 0 END AS a, CASE WHEN at_ >= 0 THEN length(whole) WHEN then_ >= 0 THEN length(excerpt) ELSE length(source) END AS l FROM m),
    o AS (SELECT *, least(a + l, length(source)) AS b FROM n) SELECT doc_id, CAST(a AS INT) AS mark_start, CASE WHEN a IS NOT NULL THEN CAST(b AS INT) END AS mark_end, md5(CASE WHEN a IS NULL THEN {_ESCAPED("source")} ELSE {_ESCAPED("left(source, a)")} || '<mark id="source-hit">' || {_ESCAPED("substr(source, a + 1, b - a)")} || '</mark>' || {_ESCAPED("substr(source, b + 1)")} END) AS marked FROM o""",
)
def source_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document is marked for its answer, and the marked text."""
    return citations.with_marks(answered(spark, sf_dir)).select("doc_id", "mark_start", "mark_end", F.md5("marked").alias("marked"))


_PLUS = lambda x: f"replace(replace(url_encode({x}), '%20', '+'), '~', '%7E')"


@query(
    "citation_links",
    f"""WITH s AS (SELECT section_id, hs_code, section, CASE section_id % 3 WHEN 0 THEN document || ' list.pdf' WHEN 1 THEN 'in/' || document || '.PDF' ELSE document END AS document, CASE WHEN section_id % 5 > 0 THEN page_start END AS page_start, CASE WHEN section_id % 7 > 0 THEN page_end END AS page_end, left(text, CAST(section_id % 4 * 10 AS BIGINT)) AS excerpt FROM ({part_sections_sql()})),
    n AS (SELECT *, replace(url_encode(list_last(string_split(document, '/'))), '~', '%7E') AS name, regexp_matches(document, '(?i)\\.pdf$') AS known, coalesce(page_start, page_end) AS page, trim(excerpt) AS said FROM s)
    SELECT section_id, CASE WHEN known THEN '/api/uploads/' || name END AS pdf_url, CASE WHEN known THEN '/api/uploads/' || name || '#page=' || page END AS page_url, CASE WHEN known AND excerpt <> '' THEN '/api/source/' || name || '?' || concat_ws('&', 'page=' || page, 'hsCode=' || hs_code, 'section=' || {_PLUS("section")}, 'q=' || {_PLUS("said")}) || '#source-hit' END AS source_url FROM n""",
)
def citation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links to a citation's document, page and place."""
    i = F.col("section_id")
    document = F.when(i % 3 == 0, F.concat("document", F.lit(" list.pdf"))).when(i % 3 == 1, F.concat(F.lit("in/"), "document", F.lit(".PDF"))).otherwise(F.col("document"))
    s = part_sections(spark, sf_dir).select("section_id", "hs_code", "section", document.alias("document"), F.when(i % 5 > 0, F.col("page_start")).alias("page_start"), F.when(i % 7 > 0, F.col("page_end")).alias("page_end"), F.left("text", (i % 4 * 10).cast("int")).alias("excerpt"))
    return citations.with_links(s).select("section_id", "pdf_url", "page_url", "source_url")
