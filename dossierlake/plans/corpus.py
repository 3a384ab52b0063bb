"""Corpus and sequence operators over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dossierlake.functions import text as T
from dossierlake.operators import corpus
from dossierlake.plans import duck as D
from dossierlake.registry import query
from dossierlake.sources.tables import part_sections, part_sections_sql, table

SECTIONS = part_sections_sql()


@query("section_normalize", f"SELECT section_id, document, hs_code, {D.normalize('title')} AS title, {D.flat('text')} AS text, CASE WHEN page_start > 0 THEN page_start END AS page_start FROM ({SECTIONS})")
def section_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = part_sections(spark, sf_dir)
    return s.select("section_id", "document", "hs_code", T.normalize_search(F.col("title")).alias("title"), F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"), F.when(F.col("page_start") > 0, F.col("page_start")).alias("page_start"))


@query("section_first_wins_dedupe", f"SELECT section_id, document, title FROM (SELECT *, row_number() OVER (PARTITION BY document, title ORDER BY section_id) AS n FROM ({SECTIONS})) WHERE n = 1")
def section_first_wins_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.first_wins(part_sections(spark, sf_dir), ["document", "title"], ["section_id"]).select("section_id", "document", "title")


@query("section_line_explode", "SELECT doc_id, CAST(i - 1 AS INT) AS line, length(x[i]) AS n_chars FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents), unnest(range(1, len(x) + 1)) AS t(i)")
def section_line_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "x"))
    return lines.select("doc_id", "line", F.length("x").cast("long").alias("n_chars"))


@query(
    "section_offsets_lead",
    """WITH l AS (SELECT doc_id, i - 1 AS line, length(x[i]) + 1 AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents), unnest(range(1, len(x) + 1)) AS t(i)),
    s AS (SELECT doc_id, line, sum(n) OVER (PARTITION BY doc_id ORDER BY line) - n AS start_at FROM l)
    SELECT doc_id, CAST(line AS INT) AS line, CAST(start_at AS BIGINT) AS start_at, CAST(lead(start_at) OVER (PARTITION BY doc_id ORDER BY line) AS BIGINT) AS end_at FROM s""",
)
def section_offsets_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start of every line, and where the next one starts."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "x"))
    w = Window.partitionBy("doc_id").orderBy("line")
    at = lines.select("doc_id", "line", (F.sum(F.length("x") + 1).over(w) - F.length("x") - 1).cast("long").alias("start_at"))
    return at.withColumn("end_at", F.lead("start_at").over(w))


_NODES = """nodes AS (SELECT page_id, i - 1 AS place, x[i] AS raw, regexp_extract(x[i], '^<(\\w+)', 1) AS kind FROM (SELECT page_id, regexp_extract_all(html, '<(?:h1|h2|p|li)\\b[^>]*>[^<]*') AS x FROM pages), unnest(range(1, len(x) + 1)) AS t(i)),
leveled AS (SELECT page_id, place, CASE kind WHEN 'h1' THEN 1 WHEN 'h2' THEN 2 ELSE 3 END AS level, kind, trim(regexp_replace(raw, '^<[^>]*>', '')) AS text FROM nodes)"""


@query(
    "page_tree_flatten",
    f"""WITH {_NODES}, w AS (SELECT *, max(CASE WHEN level = 1 THEN place END) OVER p AS one, max(CASE WHEN level = 2 THEN place END) OVER p AS two FROM leveled WINDOW p AS (PARTITION BY page_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT page_id, place, level, kind, md5(text) AS text, CASE level WHEN 2 THEN one WHEN 3 THEN greatest(one, two) END AS parent FROM w""",
)
def page_tree_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.tree_of(corpus.html_nodes(table(spark, sf_dir, "pages"))).withColumn("text", F.md5("text"))


@query(
    "grouped_page_range_repair",
    f"""WITH s AS (SELECT section_id, document, title, CASE WHEN page_start % 3 > 0 THEN page_start END AS page_start, CASE WHEN page_start % 3 > 0 THEN page_end END AS page_end FROM ({SECTIONS}))
    SELECT section_id, coalesce(page_start, min(page_start) OVER g) AS page_start, coalesce(page_end, max(page_end) OVER g) AS page_end FROM s WINDOW g AS (PARTITION BY document, title)""",
)
def grouped_page_range_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.col("page_start") % 3 > 0
    s = part_sections(spark, sf_dir).select("section_id", "document", "title", F.when(known, F.col("page_start")).alias("page_start"), F.when(known, F.col("page_end")).alias("page_end"))
    return corpus.repair_page_ranges(s, ["document", "title"]).select("section_id", "page_start", "page_end")


def _quality(x: str) -> str:
    return f"(length({x}) - CASE WHEN length({x}) < 700 AND contains({x}, '...') THEN 500 ELSE 0 END)"


_CLIPPED = f"(CASE WHEN length({D.flat('text')}) > 180 THEN rtrim(left({D.flat('text')}, 177)) || '...' ELSE {D.flat('text')} END)"


@query("hydrate_best_text", f"WITH s AS (SELECT doc_id, {_CLIPPED} AS a, text AS b, string_split(text, chr(10))[1] AS c FROM documents) SELECT doc_id, md5(CASE WHEN {_quality('a')} >= {_quality('b')} AND {_quality('a')} >= {_quality('c')} THEN a WHEN {_quality('b')} >= {_quality('c')} THEN b ELSE c END) AS text FROM s")
def hydrate_best_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    best = corpus.best_text(T.preview(F.col("text")), F.col("text"), F.substring_index("text", "\n", 1))
    return d.select("doc_id", F.md5(best).alias("text"))


@query("candidate_keyed_merge", f"SELECT document, title, max(page_start) AS score, arg_max(text, (length(text), text)) AS text, array_to_string(list_sort(list(DISTINCT section)), '|') AS sections FROM ({SECTIONS}) GROUP BY document, title")
def candidate_keyed_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.merge_candidates(part_sections(spark, sf_dir).withColumn("score", F.col("page_start")))


_SCOPE = ["Brand#1", "Brand#2", "Brand#7"]


@query("scope_semi", f"SELECT section_id, document FROM ({SECTIONS}) WHERE document IN ('Brand#1', 'Brand#2', 'Brand#7')")
def scope_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = spark.createDataFrame([(x,) for x in _SCOPE], "document string")
    return part_sections(spark, sf_dir).join(F.broadcast(scope), "document", "left_semi").select("section_id", "document")


@query("scope_anti_count", f"SELECT document, count(*) AS filtered_out FROM ({SECTIONS}) WHERE document NOT IN ('Brand#1', 'Brand#2', 'Brand#7') GROUP BY document")
def scope_anti_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = spark.createDataFrame([(x,) for x in _SCOPE], "document string")
    return part_sections(spark, sf_dir).join(F.broadcast(scope), "document", "left_anti").groupBy("document").agg(F.count(F.lit(1)).alias("filtered_out"))


@query("exact_code_lookup", f"SELECT o_orderkey AS query_id, section_id, document, title FROM orders JOIN ({SECTIONS}) ON o_custkey = section_id")
def exact_code_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code look-ups as a join: every order asks for the code of its customer's number."""
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), F.lpad(F.col("o_custkey").cast("string"), 8, "0").alias("d"))
    asked = asked.select("query_id", F.concat_ws(".", F.substring("d", 1, 4), F.substring("d", 5, 2), F.substring("d", 7, 2)).alias("hs_code"))
    return asked.join(part_sections(spark, sf_dir), "hs_code").select("query_id", "section_id", "document", "title")


@query("chapter_summary", f"SELECT chapter, title, count(*) AS n_codes, min(section_id) AS first_section, array_to_string(list_sort(list(DISTINCT hs_code)), '|') AS codes FROM ({SECTIONS}) GROUP BY chapter, title")
def chapter_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_sections(spark, sf_dir).groupBy("chapter", "title").agg(F.count(F.lit(1)).alias("n_codes"), F.min("section_id").alias("first_section"), F.array_join(F.sort_array(F.collect_set("hs_code")), "|").alias("codes"))


@query("document_summary", f"SELECT document, count(*) AS n_sections, count(DISTINCT title) AS n_titles, min(page_start) AS first_page, max(page_end) AS last_page, arg_min(title, section_id) AS first_title FROM ({SECTIONS}) GROUP BY document")
def document_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_sections(spark, sf_dir).groupBy("document").agg(F.count(F.lit(1)).alias("n_sections"), F.countDistinct("title").alias("n_titles"), F.min("page_start").alias("first_page"), F.max("page_end").alias("last_page"), F.min_by("title", "section_id").alias("first_title"))


@query("citation_format", f"SELECT section_id, 'Source: ' || document || ', pages ' || page_start || '–' || page_end || ', section \"' || section || '\"' AS citation FROM ({SECTIONS})")
def citation_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dossierlake.operators.answers import citation

    return part_sections(spark, sf_dir).select("section_id", citation(F.col("document"), F.col("page_start"), F.col("page_end"), F.col("section")).alias("citation"))


@query(
    "gap_sessionize",
    """WITH e AS (SELECT event_id, user_id, ts, epoch_us(ts) - lag(epoch_us(ts)) OVER w > 1800000000 AS far FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT event_id, user_id, CAST(sum(CAST(coalesce(far, false) AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM e""",
)
def gap_sessionize(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    return corpus.sessions(e, ["user_id"], "at", ["ts", "event_id"], 1800000000).select("event_id", "user_id", "session")


@query(
    "carry_forward_section",
    """SELECT event_id, user_id, last(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS section FROM events""",
)
def carry_forward_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The active section of every event: the last heading-like event before it."""
    heading = F.when(F.col("event_type") == "signup", F.col("event_id"))
    return corpus.carried(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], heading, "section").select("event_id", "user_id", "section")


@query("page_range_join", f"SELECT a.section_id, b.section_id AS inside FROM ({SECTIONS}) a JOIN ({SECTIONS}) b ON a.document = b.document AND a.title = b.title AND b.page_start BETWEEN a.page_start AND a.page_end WHERE a.section_id <> b.section_id")
def page_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = part_sections(spark, sf_dir).withColumn("home", F.concat_ws("|", "document", "title"))
    points = s.select("home", F.col("section_id").alias("inside"), F.col("page_start").alias("page"))
    return corpus.range_join(points, s.select("home", "section_id", "page_start", "page_end"), "home", "page", "page_start", "page_end", width=2).filter("inside <> section_id").select("section_id", "inside")


@query(
    "positional_zip_pairing",
    """WITH a AS (SELECT o_custkey AS k, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place FROM orders), b AS (SELECT user_id AS k, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events)
    SELECT coalesce(a.k, b.k) AS k, CAST(coalesce(a.place, b.place) AS INT) AS place, o_orderkey, event_id FROM a FULL JOIN b ON a.k = b.k AND a.place = b.place""",
)
def positional_zip_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", "o_orderdate")
    right = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), "event_id", "ts")
    return corpus.zip_by_place(left, right, ["k"], ["o_orderdate", "o_orderkey"], ["ts", "event_id"]).select("k", "place", "o_orderkey", "event_id")
