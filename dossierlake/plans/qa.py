"""Batch question answering over the coded sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierlake.functions import text as T
from dossierlake.operators import ranking, retrieval
from dossierlake.operators.rows import spread
from dossierlake.plans import duck as D
from dossierlake.registry import query
from dossierlake.sources.tables import part_sections, part_sections_sql, table

LITERAL = ["small bolt instead of red bolt", "hot gear rather than cold gear 20%", "which code is 0000.00.07", "20%", "gear", "hello", "blue widget for raw use at least 5 cm", "chapter 12 summary"]


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question per distinct part name, and literal ones with contrast, codes, numbers and small talk."""
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    made = names.select(F.concat(F.lit("which code is a "), F.col("p_name"), F.lit(" under 20 cm")).alias("question"))
    literal = spark.createDataFrame([(q,) for q in LITERAL], "question string")
    return made.unionByName(literal).select(F.md5("question").alias("query_id"), "question")


_LITERALS = ", ".join(f"('{q}')" for q in LITERAL)
QUESTIONS = f"(SELECT md5(question) AS query_id, question FROM (SELECT DISTINCT 'which code is a ' || p_name || ' under 20 cm' AS question FROM part UNION ALL SELECT * FROM (VALUES {_LITERALS})))"


def _list(xs: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


def _includes(text: str, term: str) -> str:
    return f"(CASE WHEN {term} = '' THEN false WHEN regexp_matches({term}, '^[a-z0-9.]+$') THEN list_contains({D.raw(text)}, {term}) ELSE contains({text}, {term}) END)"


_AFTER = "string_split_regex(n, '(?:^|[^a-z0-9])' || p || '(?:$|[^a-z0-9])')"
_GRAMS = "list_filter(list_concat(list_transform(range(1, greatest(len(tokens) - 1, 1)), lambda i: tokens[i] || ' ' || tokens[i + 1] || ' ' || tokens[i + 2]), list_transform(range(1, greatest(len(tokens), 1)), lambda i: tokens[i] || ' ' || tokens[i + 1])), lambda g: length(g) >= 7 AND contains(n, g))"
_NUMERIC = "list_distinct(list_transform(list_concat(list_transform(regexp_extract_all(m, '" + T.NUMERIC_PATTERNS[0] + "'), lambda x: regexp_replace(x, '%[^a-z0-9]$', '%')), regexp_extract_all(m, '" + "'), regexp_extract_all(m, '".join(T.NUMERIC_PATTERNS[1:]) + "')), lambda y: trim(regexp_replace(y, '\\s+', ' ', 'g'))))"


def _ordered(x: str) -> str:
    """Distinct values in order of first standing."""
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


SIGNALS = f"""
q0 AS (SELECT query_id, question, {D.normalize("question")} AS n FROM {QUESTIONS}),
q1 AS (SELECT *, replace(n, ',', '.') AS m, list_filter({_list(T.CONTRAST_PHRASES)}, lambda p: regexp_matches(n, '(?:^|[^a-z0-9])' || p || '(?:$|[^a-z0-9])')) AS c0,
    list_filter({_list(T.PHYSICAL_TERMS + T.USAGE_TERMS + T.TRADE_TERMS)}, lambda t: {_includes("n", "t")}) AS known, {D.meaningful("question").replace("list_distinct(", "(", 1)} AS t0 FROM q0),
q2 AS (SELECT *, list_filter(c0, lambda p: len(list_filter(c0, lambda o: o <> p AND contains(o, p))) = 0) AS contrast FROM q1),
q3 AS (SELECT *, flatten(list_transform(contrast, lambda p: list_filter({D.raw(f"array_to_string({_AFTER}[2:], ' ')")}, lambda t: length(t) >= 3)[1:4])) AS b0,
    list_concat(t0, flatten(list_transform(known, lambda k: list_filter(list_transform(string_split(k, ' '), lambda t: {D.form("t")}), lambda x: length(x) >= 3)))) AS t1 FROM q2),
q4 AS (SELECT *, {_ordered("b0")} AS baseline, {_ordered("t1")} AS t2 FROM q3),
q5 AS (SELECT *, list_filter(t2, lambda t: NOT list_contains(baseline, t)) AS tokens FROM q4),
q6 AS (SELECT *, list_concat({_GRAMS}, list_filter(known, lambda k: contains(k, ' '))) AS ph FROM q5),
sig AS (SELECT query_id, question, tokens, list_filter({_ordered("ph")}, lambda p: len(list_filter(baseline, lambda b: {_includes("p", "b")})) = 0) AS phrases, {_NUMERIC} AS numeric, list_distinct(regexp_extract_all(question, '\\b\\d{{4}}\\.\\d{{2}}\\.\\d{{2}}\\b')) AS codes, contrast, baseline FROM q6)
"""


@query("query_signals", f"WITH {SIGNALS} SELECT query_id, array_to_string(tokens, '|') AS tokens, {D.joined('phrases')} AS phrases, {D.joined('numeric')} AS numeric, {D.joined('codes')} AS codes, {D.joined('contrast')} AS contrast, array_to_string(baseline, '|') AS baseline FROM sig")
def query_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = retrieval.signals(questions(spark, sf_dir))
    sorted_ = lambda c: F.array_join(F.sort_array(c), "|").alias(c)
    return s.select("query_id", F.array_join("tokens", "|").alias("tokens"), sorted_("phrases"), sorted_("numeric"), sorted_("codes"), sorted_("contrast"), F.array_join("baseline", "|").alias("baseline"))


_FIELDS = {"title": "coalesce(hs_code, '') || ' ' || coalesce(title, '') || ' ' || coalesce(hs_code, '')", "heading": "coalesce(section, '') || ' ' || coalesce(title, '')", "body": "coalesce(text, '')", "captions": "''", "source": "coalesce(source, '') || ' ' || coalesce(chapter, '') || ' ' || coalesce(document, '')"}
FIELDS = f"sec AS (SELECT *, {', '.join(f'{D.normalize(x)} AS f_{f}' for f, x in _FIELDS.items())} FROM ({part_sections_sql()}))"
INDEX = "idx AS (SELECT section_id, field, token, count(*) AS tf FROM (" + " UNION ALL ".join(f"SELECT section_id, '{f}' AS field, unnest({D.raw(f'f_{f}')}) AS token FROM sec" for f in _FIELDS) + ") GROUP BY ALL)"


@query("inverted_index", f"WITH {FIELDS}, {INDEX} SELECT field, token, count(*) AS n_sections, CAST(sum(tf) AS BIGINT) AS n FROM idx GROUP BY ALL")
def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = retrieval.inverted_index(retrieval.search_fields(spread(part_sections(spark, sf_dir), "section_id")))
    return index.groupBy("field", "token").agg(F.count(F.lit(1)).alias("n_sections"), F.sum("tf").alias("n"))


def _case(weights: dict[str, int]) -> str:
    return "CASE field " + " ".join(f"WHEN '{f}' THEN {w}" for f, w in weights.items()) + " ELSE 0 END"


def _hit(array: str, text: str) -> str:
    return f"len(list_filter({array}, lambda x: {_includes(text, 'x')}))"


_LONG = "list_filter(phrases, lambda p: contains(p, ' '))"
SCORES = f"""
hit AS (SELECT query_id, section_id, {", ".join(f"sum(CASE WHEN NOT against AND field = '{f}' THEN tf * {w} ELSE 0 END) AS t_{f}" for f, w in retrieval.TOKEN_WEIGHT.items())},
    sum(CASE WHEN NOT against AND field = 'title' AND regexp_matches(token, '\\b\\d{{4}}\\.\\d{{2}}\\.\\d{{2}}\\b') THEN tf * 40 ELSE 0 END) AS p_hs_code, -sum(CASE WHEN against THEN tf * {_case(retrieval.CONTRAST_WEIGHT)} ELSE 0 END) AS p_contrast_penalty
    FROM idx JOIN (SELECT query_id, unnest(tokens) AS token, false AS against FROM sig UNION ALL SELECT query_id, unnest(baseline), true FROM sig) USING (token) GROUP BY ALL),
parts AS (SELECT query_id, section_id, p_hs_code, p_contrast_penalty, {", ".join(f"t_{f}" + (f" + {retrieval.PHRASE_WEIGHT[f]} * {_hit(_LONG, f'f_{f}')}" if f in retrieval.PHRASE_WEIGHT else "") + f" AS p_{f}" for f in _FIELDS)},
    11 * {_hit("numeric", "(f_title || ' ' || f_heading || ' ' || f_body || ' ' || f_captions)")} AS p_numeric FROM hit JOIN sig USING (query_id) JOIN sec USING (section_id)),
scored AS (SELECT query_id, section_id, {", ".join(f"CAST(p_{x} AS BIGINT) AS p_{x}" for x in retrieval.PARTS)}, CAST({" + ".join(f"p_{x}" for x in retrieval.PARTS)} AS BIGINT) AS score FROM parts)
"""
RETRIEVED = f"WITH {SIGNALS}, {FIELDS}, {INDEX}, {SCORES}"


def scores(spark: SparkSession, sf_dir: str, k: int | None = None) -> DataFrame:
    return retrieval.field_scores(retrieval.signals(questions(spark, sf_dir)), retrieval.search_fields(part_sections(spark, sf_dir)), k)


@query("score_breakdown", f"{RETRIEVED} SELECT * FROM scored")
def score_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir)


@query("contrast_penalty", f"{RETRIEVED} SELECT query_id, section_id, p_contrast_penalty FROM scored WHERE p_contrast_penalty < 0")
def contrast_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).filter("p_contrast_penalty < 0").select("query_id", "section_id", "p_contrast_penalty")


TOP = 10


@query("field_weighted_score", f"{RETRIEVED} SELECT query_id, section_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, section_id) AS INT) AS rank FROM scored WHERE score > 0) WHERE rank <= {TOP}")
def field_weighted_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = retrieval.top_k(scores(spark, sf_dir, TOP).filter("score > 0"), TOP, F.col("score").desc(), F.col("section_id"))
    return best.select("query_id", "section_id", "score", "rank")
