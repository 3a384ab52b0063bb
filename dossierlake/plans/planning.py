"""Query plans, requested fields and told states, over questions made from `part` and states made from `events`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierlake.functions import forms as X
from dossierlake.operators import planning as P
from dossierlake.plans.forms import _low, _sub
from dossierlake.plans.text import joined
from dossierlake.registry import query
from dossierlake.sources.tables import table

CASES = ["Summarize  chapter {size}", "What is {name}?", "tóm tắt document {brand} file.pdf?", "HS code of the {name}", "code 0000.00.{size2} now", "define  {name}!", "{name} là gì?", "What is the weight and the usage of {name}", "{type} file contents", "Ngoại quan cần đáp ứng gì của {name}", "12", "mô tả chapter_{size} gồm các note"]


#: Marks of the cases and what stands for them, in SQL that both sides read alike.
PARTS = {"{size2}": "lpad(CAST(p_size AS STRING), 2, '0')", "{size}": "CAST(p_size AS STRING)", "{name}": "p_name", "{brand}": "p_brand", "{type}": "p_type"}


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, q = F.col("p_partkey") % len(CASES), None
    for i, case in enumerate(CASES):
        c = F.lit(case)
        for mark, sql in PARTS.items():
            c = F.replace(c, F.lit(mark), F.expr(sql))
        q = F.when(n == i, c) if q is None else q.when(n == i, c)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), q.alias("q"))


def _questions() -> str:
    out = "CASE p_partkey % " + str(len(CASES))
    for i, case in enumerate(CASES):
        c = "'" + case + "'"
        for mark, sql in PARTS.items():
            c = f"replace({c}, '{mark}', {sql})"
        out += f" WHEN {i} THEN {c}"
    return f"(SELECT p_partkey AS query_id, {out} END AS q FROM part)"


def _flat(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def _target(x: str) -> str:
    x = f"regexp_replace(regexp_replace({x}, '(?i)\\s*(?:là|la)\\s+(?:gì|gi)\\s*[?!.]*\\s*$', ' '), '(?i)^\\s*what\\s+is\\s+', ' ')"
    # words between blanks, so that neighbours do not share one
    x = f"list_filter(string_split_regex({_sub(x, '[?!.:,;]+', ' ')}, '\\s+'), lambda w: lower(w) NOT IN ('product', 'item', 'goods', 'con', 'cái', 'cai', 'the', 'a', 'an'))"
    return _flat(f"array_to_string({x}, ' ')")


_N = f"trim(regexp_replace({_low('f')}, '\\s+', ' ', 'g'))"
_VI = f"(regexp_matches(lower(q), '{X.VIETNAMESE_LETTERS}') OR regexp_matches(n, '{P.PLAN_VIETNAMESE}'))"
_EN = f"regexp_matches(n, '{P.PLAN_ENGLISH}')"
_LANGUAGE = f"CASE WHEN n = '' THEN 'unknown' WHEN {_VI} AND {_EN} THEN 'mixed' WHEN {_VI} THEN 'vi' WHEN regexp_matches(q, '[a-zA-Z]') THEN 'en' ELSE 'unknown' END"
_SIGNALS = lambda x: _flat(f"regexp_replace(regexp_replace({x}, '(?i){P.SUMMARY}', ' ', 'g'), '(?i)(có\\s+gì|nội\\s+dung|nói\\s+về|tóm\\s+tắt|gồm|liệt\\s+kê)', ' ', 'g')")
_TERM = f"CASE WHEN regexp_matches(n, '^define\\s+(.+)$') THEN substr(f, 8) WHEN regexp_matches(n, '^(.+?)\\s+la\\s+gi\\??$') THEN f WHEN regexp_matches(n, '^what\\s+is\\s+(.+?)\\??$') THEN substr(f, 9) END"
BASE = f"""q0 AS (SELECT *, {_flat("q")} AS f FROM {_questions()}), q1 AS (SELECT *, {_N} AS n FROM q0),
q2 AS (SELECT *, regexp_extract(q, '\\b\\d{{4}}\\.\\d{{2}}\\.\\d{{2}}\\b') AS code, {_LANGUAGE} AS language, regexp_extract(n, '{P.CHAPTER}', 1) AS chapter, regexp_matches(n, '{P.SUMMARY}') AS sums, regexp_extract(n, '{P.DOCUMENT}', 1) AS marker, {_TERM} AS term FROM q1),
q3 AS (SELECT *, {_SIGNALS("substr(f, strpos(n, marker) + length(marker))")} AS after, {_SIGNALS("left(f, strpos(n, marker) - 1)")} AS before FROM q2),
q4 AS (SELECT *, CASE WHEN marker <> '' AND sums THEN nullif({_target("CASE WHEN after <> '' THEN after ELSE before END")}, '') END AS name, nullif({_target("regexp_replace(trim(term), '[?.!]+$', '')")}, '') AS definition FROM q3)"""


@query(
    "query_plan",
    f"""WITH {BASE} SELECT query_id, language, CASE WHEN code <> '' THEN 'exact_hscode_lookup' WHEN chapter <> '' AND sums THEN 'chapter_summary' WHEN name IS NOT NULL THEN 'document_summary' END AS intent,
    CASE WHEN code <> '' THEN code WHEN chapter <> '' AND sums THEN 'chapter ' || CAST(chapter AS INT) WHEN name IS NOT NULL THEN name END AS target, definition, regexp_matches(n, '{P.CODE_QUESTION}') AS asks_code FROM q4""",
)
def query_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan of every question that rules settle, with its language, and the term whose definition it asks for."""
    p = P.plans(questions(spark, sf_dir).select("query_id", "q"), "q")
    return p.select("query_id", "language", "plan.intent", "plan.target", F.col("definition_term").alias("definition"), "asks_code")


_FIELD = f"trim(regexp_replace(regexp_replace({_low('q')}, '[_-]+', ' ', 'g'), '\\s+', ' ', 'g'))"
_STOP = ", ".join(f"'{w}'" for w in X.FIELD_STOPWORDS)


def _group(labels: list[str]) -> str:
    hits = []
    for label in labels:
        words = [w for w in label.split() if len(w) >= 3]
        hits.append(f"contains(n, '{label}')" + (" OR (" + " AND ".join(f"list_contains(t, '{w}')" for w in words) + ")" if words else ""))
    return " OR ".join(hits)


_GROUPS = "[" + ", ".join(f"CASE WHEN {_group(labels)} THEN '{name}' END" for name, labels in P.FIELD_GROUPS.items()) + "]"
_ONE = "CASE WHEN list_contains(g, 'appearance') AND list_contains(g, 'requirements') THEN 'appearance requirements' " + " ".join(f"WHEN list_contains(g, '{x}') THEN '{x}'" for x in P.FIELD_ORDER) + " END"


@query(
    "requested_fields",
    f"""WITH q0 AS (SELECT *, {_FIELD} AS n FROM {_questions()}), q1 AS (SELECT *, list_distinct(list_filter(string_split_regex(n, '[^a-z0-9]+'), lambda w: length(w) >= 3 AND w NOT IN ({_STOP}))) AS t FROM q0),
    q2 AS (SELECT *, list_filter({_GROUPS}, lambda x: x IS NOT NULL) AS g FROM q1)
    SELECT query_id, array_to_string(list_sort(g), '|') AS groups, {_ONE} AS field, round(least(1.0::DOUBLE, CASE WHEN len(g) > 0 THEN len(list_intersect(g, ['weight and size'])) / len(g) ELSE 0.0::DOUBLE END * 0.78::DOUBLE + CASE WHEN len(t) > 0 THEN len(list_intersect(t, ['weight', 'size'])) / least(len(t), 4) ELSE 0.0::DOUBLE END * 0.22::DOUBLE), 6) AS size_match FROM q2""",
)
def requested_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields every question asks for, the one that is meant, and how well the label 'weight and size' answers it."""
    sides = lambda p, c: [P.field_groups(F.col(f"{p}_form"), F.col(f"{p}_tokens")).alias(f"{p}_groups")]
    q = questions(spark, sf_dir).select("query_id", X.field_form(F.col("q")).alias("a_form"), X.field_tokens(F.col("q")).alias("a_tokens"), X.field_form(F.lit("weight and size")).alias("b_form"), X.field_tokens(F.lit("weight and size")).alias("b_tokens"))
    g = q.select("*", *sides("a", "q"), *sides("b", "label"))
    return g.select("query_id", joined("a_groups").alias("groups"), P.requested_field(F.col("a_groups")).alias("field"), F.round(P.field_match("a", "b"), 6).alias("size_match"))


_STATE = "CASE WHEN event_id % 97 = 0 THEN 'failed' WHEN event_id % 31 = 0 THEN 'stale' WHEN event_id % 5 = 0 THEN 'missing' ELSE 'fresh' END"


@query(
    "upload_states",
    f"""SELECT user_id, CASE WHEN bool_or(s = 'failed') THEN 'failed' WHEN bool_or(s = 'stale') THEN 'stale' WHEN bool_and(s = 'fresh') THEN 'fresh' ELSE 'skipped' END AS status,
    CASE user_id % 5 WHEN 0 THEN 'local_sections' WHEN 1 THEN 'bm25_fallback' WHEN 2 THEN 'pageindex_live' WHEN 3 THEN CASE WHEN bool_or(s = 'stale') THEN 'stale_cached_tree' ELSE 'fresh_cached_tree' END ELSE 'unknown' END AS source FROM (SELECT user_id, {_STATE} AS s FROM events) GROUP BY user_id""",
)
def upload_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One state and index source for the documents of each user; of states a set is enough."""
    e = F.col("event_id")
    s = F.when(e % 97 == 0, "failed").when(e % 31 == 0, "stale").when(e % 5 == 0, "missing").otherwise("fresh")
    k = F.col("user_id") % 5
    source = F.when(k == 0, "local-sections").when(k == 1, "bm25-fallback").when(k == 2, "pageindex-tree").when(k == 3, "cached-pageindex-tree").otherwise("other")
    grouped = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(s).alias("states"))
    return grouped.select("user_id", P.upload_status(F.col("states")).alias("status"), P.index_source(source, F.array_contains("states", "stale")).alias("source"))


_MESSAGES = ["Request timed out", "403 Forbidden", "RESOURCE EXHAUSTED: quota", "Too Many Requests", "empty answer", "Invalid API key"]
_STATUS = "CASE event_id % 7 WHEN 0 THEN 401 WHEN 1 THEN 429 WHEN 2 THEN 500 END"


@query(
    "error_kinds",
    f"""SELECT event_id, CASE WHEN i = 0 THEN 'timeout' WHEN s IN (401) OR i IN (1, 5) THEN 'permission' WHEN i = 2 THEN 'quota' WHEN s = 429 OR i = 3 THEN 'rate_limit' ELSE 'unknown' END AS kind FROM (SELECT event_id, event_id % 6 AS i, {_STATUS} AS s FROM events)""",
)
def error_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    message = F.get(F.array(*map(F.lit, _MESSAGES)), (e % 6).cast("int"))
    status = F.when(e % 7 == 0, 401).when(e % 7 == 1, 429).when(e % 7 == 2, 500)
    return table(spark, sf_dir, "events").select("event_id", P.error_kind(message, F.coalesce(status, F.lit(0))).alias("kind"))
