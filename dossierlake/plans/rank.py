"""Relevance, validation, ranking, broadness and answers for the question batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dossierlake.functions import text as T
from dossierlake.operators import answers, ranking, retrieval
from dossierlake.plans import duck as D
from dossierlake.plans.qa import FIELDS, INDEX, QUESTIONS, SCORES, SIGNALS, TOP, _hit, _includes, _list, _ordered, questions, scores
from dossierlake.registry import query
from dossierlake.sources.tables import part_sections, part_sections_sql


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = retrieval.top_k(scores(spark, sf_dir, TOP).filter("score > 0"), TOP, F.col("score").desc(), F.col("section_id")).select("query_id", "section_id", "score")
    found = best.join(retrieval.signals(questions(spark, sf_dir)), "query_id").join(part_sections(spark, sf_dir).hint("merge"), "section_id")
    return ranking.section_features(found)


def rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.relevance(candidates(spark, sf_dir))


def validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.validate(rated(spark, sf_dir))


def _filter(array: str, condition: str) -> str:
    return f"list_filter({array}, lambda v: {condition})"


_WEAK = f"(regexp_matches(t, '^\\d+$') OR t IN ({', '.join(repr(x) for x in T.WEAK_TOKENS)}))"
_DISTINCTIVE = f"(t NOT IN ({', '.join(repr(x) for x in T.STOPWORDS)}) AND NOT {_WEAK} AND (length(t) >= 4 OR regexp_matches(t, '\\d')))"
_NUMBERS = "list_transform(regexp_extract_all(replace({}, ',', '.'), '\\d+(?:\\.\\d+)?'), lambda z: CAST(z AS DOUBLE))"

RATED = f"""
best AS (SELECT query_id, section_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, section_id) AS rank FROM scored WHERE score > 0) WHERE rank <= {TOP}),
c0 AS (SELECT *, {D.normalize("concat_ws(' ', coalesce(title, ''), coalesce(section, ''))")} AS title_text, {D.normalize("text")} AS body_text, {D.normalize("concat_ws(' ', coalesce(source, ''), coalesce(chapter, ''), document)")} AS source_text,
    {D.meaningful("concat_ws(' ', title, section)")} AS title_tokens, {D.meaningful("text")} AS body_tokens, {D.meaningful("concat_ws(' ', source, chapter, document)")} AS source_tokens
    FROM best JOIN sig USING (query_id) JOIN ({part_sections_sql()}) USING (section_id)),
c1 AS (SELECT *, title_text || ' ' || body_text || ' ' || source_text AS all_text, title_text || ' ' || body_text AS tb, {_filter("tokens", "list_contains(title_tokens, v)")} AS in_title,
    {_filter("tokens", "NOT list_contains(title_tokens, v) AND list_contains(body_tokens, v)")} AS in_body, {_filter("tokens", "NOT list_contains(title_tokens, v) AND NOT list_contains(body_tokens, v)")} AS rest FROM c0),
c2 AS (SELECT *, {_filter("rest", _includes("source_text", "v"))} AS in_source, {_filter("phrases", _includes("all_text", "v"))} AS phrase_hits,
    {_filter("tokens", "(list_contains(title_tokens, v) OR list_contains(body_tokens, v) OR list_contains(source_tokens, v)) AND (length(v) >= 6 OR regexp_matches(v, '[0-9]'))")} AS rare,
    {_filter("numeric", _includes("tb", "v") + f" OR len(list_filter({_NUMBERS.format('v')}, lambda a: len(list_filter({_NUMBERS.format('tb')}, lambda b: abs(a - b) < 0.0001)) > 0)) > 0")} AS numeric_hits,
    {_filter("list_distinct(list_concat(contrast, baseline))", _includes("all_text", "v"))} AS contrast_hits, {_filter("[hs_code]", "contains(lower(question), v)")} AS code_hits FROM c1),
c3 AS (SELECT *, {_filter("phrase_hits", _includes("title_text", "v"))} AS title_phrases, {_filter("phrase_hits", _includes("body_text", "v"))} AS body_phrases, {_filter("phrase_hits", f"len(list_filter({D.meaningful('v')}, lambda t: NOT {_WEAK})) > 0")} AS strong_phrases,
    {_ordered("list_concat(code_hits, in_title, in_body, in_source, rare)")} AS matched FROM c2),
c4 AS (SELECT *, len(code_hits) + len(in_title) + len(in_body) + len(in_source) + len(phrase_hits) + len(numeric_hits) AS evidence, len(code_hits) + len(title_phrases) + len(numeric_hits) + len(strong_phrases) + len(rare) AS n_strong,
    len(in_title) + len(in_body) + len(phrase_hits) + len(numeric_hits) AS overlap, len(list_filter(list_distinct(list_concat(in_title, in_body, in_source, rare)), lambda t: NOT {_WEAK})) AS meaning FROM c3),
c5 AS (SELECT *, evidence = 0 AND len(contrast_hits) > 0 AS only_contrast, len(code_hits) + len(strong_phrases) + len(numeric_hits) + meaning = 0 AND len(in_title) + len(in_body) + len(in_source) + len(phrase_hits) > 0 AS only_weak FROM c4),
c6 AS (SELECT *, score + 24 * len(code_hits) + 14 * len(title_phrases) + 8 * len(in_title) + 8 * len(body_phrases) + 3 * len(in_body) + len(in_source) + 10 * len(numeric_hits) + 5 * len(rare)
    - CASE WHEN only_contrast THEN 20 ELSE 0 END - CASE WHEN len(contrast_hits) > 0 AND evidence <= len(contrast_hits) THEN 3 * len(contrast_hits) ELSE 0 END - CASE WHEN overlap = 0 THEN 10 ELSE 0 END AS relevance, CASE WHEN n_strong > 0 THEN 5 ELSE 8 END AS least FROM c5),
rated AS (SELECT *, CASE WHEN only_contrast THEN 'only contrast terms match' WHEN only_weak THEN 'only weak generic tokens match' WHEN relevance < least THEN 'score below ' || least WHEN overlap = 0 THEN 'low token, phrase and numeric overlap' END AS reject_reason FROM c6)
"""
WITH_RATED = f"WITH {SIGNALS}, {FIELDS}, {INDEX}, {SCORES}, {RATED}"


@query("relevance_components", f"{WITH_RATED} SELECT query_id, section_id, len(in_title) AS n_title, len(in_body) AS n_body, len(in_source) AS n_source, len(phrase_hits) AS n_phrases, len(numeric_hits) AS n_numeric, len(rare) AS n_rare, len(contrast_hits) AS n_contrast, CAST(relevance AS BIGINT) AS relevance FROM rated")
def relevance_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = {"n_title": "in_title", "n_body": "in_body", "n_source": "in_source", "n_phrases": "phrase_hits", "n_numeric": "numeric_hits", "n_rare": "rare", "n_contrast": "contrast_hits"}
    return rated(spark, sf_dir).select("query_id", "section_id", *[F.size(v).cast("long").alias(k) for k, v in n.items()], "relevance")


@query("reject_reasons", f"{WITH_RATED} SELECT query_id, section_id, reject_reason FROM rated WHERE reject_reason IS NOT NULL")
def reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rated(spark, sf_dir).filter("reject_reason IS NOT NULL").select("query_id", "section_id", "reject_reason")


_VIABLE = "(reject_reason IS NULL AND len(matched) + len(phrase_hits) + len(numeric_hits) > 0)"
VALIDATED = f"""
v0 AS (SELECT *, sum(CAST({_VIABLE} AS INT)) OVER (PARTITION BY query_id) AS n_viable, CASE WHEN {_VIABLE} THEN relevance - coalesce(lead(relevance) OVER (PARTITION BY query_id, {_VIABLE} ORDER BY relevance DESC, section_id), 0) ELSE 0 END AS margin,
    list_filter(matched, lambda t: {_DISTINCTIVE}) AS distinctive, len(numeric_hits) > 0 AS has_numeric, len(tokens) <= 1 AS single, list_filter(title_tokens, lambda t: {_DISTINCTIVE} AND NOT regexp_matches(t, '^\\d+(?:\\.\\d+)*$')) AS own_title FROM rated),
v1 AS (SELECT *, len(list_filter(phrase_hits, lambda p: len({D.meaningful("p")}) >= 2)) > 0 OR len(distinctive) >= 1 AS product, len(list_filter(list_concat(matched, phrase_hits, numeric_hits), lambda x: {_includes("tb", "x")})) > 0 AS supported,
    len(list_filter(own_title, lambda t: list_contains(tokens, t) AND {_DISTINCTIVE})) AS shared, {_hit("list_concat(contrast, baseline)", "title_text")} > 0 AS against FROM v0),
v2 AS (SELECT *, list_filter([CASE WHEN len(title_phrases) > 0 OR ((shared >= 2 OR (len(own_title) = 1 AND shared = 1)) AND NOT against) THEN 'title_phrase' END, CASE WHEN len(list_filter(phrase_hits, lambda p: len(list_filter({D.meaningful("p")}, lambda t: {_DISTINCTIVE})) >= 2)) > 0 THEN 'distinctive_phrase' END,
    CASE WHEN len(distinctive) >= 2 THEN 'distinctive_tokens' END, CASE WHEN has_numeric AND product THEN 'numeric_with_product' END, CASE WHEN len(body_phrases) > 0 THEN 'body_phrase' END], lambda s: s IS NOT NULL) AS strong FROM v1),
v3 AS (SELECT *, list_filter([CASE WHEN single THEN 'very_short_query' END, CASE WHEN single AND n_viable > 1 THEN 'single_token_many_candidates' END, CASE WHEN n_viable > 1 AND margin < 10 THEN 'no_dominance' END, CASE WHEN has_numeric AND NOT product THEN 'numeric_without_product' END,
    CASE WHEN len(phrase_hits) = 0 THEN 'no_phrase' END, CASE WHEN NOT supported THEN 'no_text_support' END, CASE WHEN len(distinctive) <= 1 AND len(phrase_hits) = 0 AND NOT has_numeric THEN 'one_common_token' END, CASE WHEN only_contrast THEN 'only_contrast' END,
    CASE WHEN relevance >= 70 AND len(strong) = 0 THEN 'high_score_without_strong' END], lambda s: s IS NOT NULL) AS weak FROM v2),
v4 AS (SELECT *, CASE WHEN len(codes) > 0 AND list_contains(codes, hs_code) THEN 'exact code' WHEN len(codes) > 0 THEN 'other code' WHEN reject_reason IS NOT NULL THEN 'rejected by relevance' WHEN has_numeric AND NOT product THEN 'numbers without product'
    WHEN len(strong) = 0 AND single AND supported THEN 'broad lookup only' WHEN len(strong) = 0 THEN 'weak evidence only' WHEN len(strong) >= 2 AND len(weak) = 0 THEN 'several strong signals' ELSE 'sufficient evidence' END AS state FROM v3),
validated AS (SELECT *, state IN ('exact code', 'broad lookup only', 'several strong signals', 'sufficient evidence') AS accepted, CASE WHEN state IN ('exact code', 'several strong signals') THEN 'high' WHEN state = 'sufficient evidence' AND (len(strong) >= 2 OR relevance >= 50) THEN 'high' WHEN state = 'sufficient evidence' THEN 'medium' ELSE 'low' END AS confidence FROM v4)
"""
WITH_VALIDATED = f"{WITH_RATED}, {VALIDATED}"


@query("strong_weak_signals", f"{WITH_VALIDATED} SELECT query_id, section_id, array_to_string(strong, '|') AS strong, array_to_string(weak, '|') AS weak FROM validated")
def strong_weak_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validated(spark, sf_dir).select("query_id", "section_id", F.array_join("strong", "|").alias("strong"), F.array_join("weak", "|").alias("weak"))


@query("validation_matrix", f"{WITH_VALIDATED} SELECT query_id, section_id, accepted, confidence, state FROM validated")
def validation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validated(spark, sf_dir).select("query_id", "section_id", "accepted", "confidence", "state")


@query("ambiguity_margin", f"{WITH_VALIDATED} SELECT query_id, section_id, CAST(n_viable AS BIGINT) AS n_viable, CAST(margin AS BIGINT) AS margin FROM validated")
def ambiguity_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validated(spark, sf_dir).select("query_id", "section_id", F.col("n_viable").cast("long").alias("n_viable"), F.col("margin").cast("long").alias("margin"))


_ORDER = "accepted DESC, CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, len(strong) DESC, len(weak), relevance DESC, score DESC, document, section_id"


@query("seven_key_rank", f"{WITH_VALIDATED} SELECT query_id, section_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {_ORDER}) AS INT) AS rank FROM validated")
def seven_key_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validated(spark, sf_dir).select("query_id", "section_id", F.row_number().over(Window.partitionBy("query_id").orderBy(*ranking.rank_order())).alias("rank"))


GROUPS = """grp AS (SELECT query_id, document, title, CAST(max(relevance) AS BIGINT) AS relevance, arg_max(section_id, relevance * 1000000000 - section_id) AS section_id, array_to_string(list_sort(list(DISTINCT hs_code)), '|') AS codes,
    arg_max(confidence, relevance * 1000000000 - section_id) AS confidence, bool_or(len(strong) > 0) AS any_strong FROM validated WHERE accepted GROUP BY ALL)"""


@query("distinct_groups_best", f"{WITH_VALIDATED}, {GROUPS} SELECT * FROM grp")
def distinct_groups_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.group_best(validated(spark, sf_dir))


BROAD = """
br AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, section_id) AS rank, lead(relevance) OVER (PARTITION BY query_id ORDER BY relevance DESC, section_id) AS next FROM grp),
bg AS (SELECT query_id, count(*) AS n, sum(CAST(confidence = 'low' AS INT)) AS n_low, bool_or(any_strong) AS strong, max(CASE WHEN rank = 1 THEN relevance - next END) AS margin FROM br GROUP BY query_id),
bq AS (SELECT sig.query_id, question, len(codes) AS n_codes, len(tokens) AS n_tokens, coalesce(n, 0) AS n, coalesce(n_low, 0) AS n_low, coalesce(strong, false) AS strong, margin FROM sig LEFT JOIN bg USING (query_id)),
broad AS (SELECT query_id, CAST(n AS BIGINT) AS n_groups, CAST(coalesce(margin, 0) AS BIGINT) AS margin, CASE WHEN n_codes > 0 AND n > 0 THEN 'normal: exact code' WHEN n = 1 AND (strong OR n_low = 0) THEN 'normal: single candidate' WHEN strong AND (n < 2 OR margin >= 10) THEN 'normal: strong evidence'
    WHEN regexp_matches(question, '^\\s*\\d+(?:[.,]\\d+)?\\s*%?\\s*$') THEN 'clarification: bare number' WHEN n_tokens <= 1 AND n >= 2 THEN 'broad_lookup: single token' WHEN n_tokens <= 1 AND NOT strong THEN CASE WHEN n > 0 THEN 'broad_lookup: too few tokens' ELSE 'clarification: too few tokens' END
    WHEN n >= 2 AND (margin < 10 OR n_low >= 2) THEN 'broad_lookup: no dominance' ELSE 'normal: enough support' END AS mode FROM bq)
"""


@query("broad_decision", f"{WITH_VALIDATED}, {GROUPS}, {BROAD} SELECT * FROM broad")
def broad_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = ranking.group_best(validated(spark, sf_dir))
    return ranking.broad_decision(groups, retrieval.signals(questions(spark, sf_dir)))


INTENTS = f"""
i0 AS (SELECT query_id, question, {D.normalize("question")} AS n FROM {QUESTIONS}),
intents AS (SELECT query_id, CASE WHEN list_contains({_list(answers.SMALL_TALK)}, regexp_replace(n, '[!?. ]+$', '')) THEN 'simple_chat' WHEN regexp_matches(question, '\\d{{4}}\\.\\d{{2}}\\.\\d{{2}}') THEN 'exact_code_lookup'
    WHEN regexp_matches(n, '\\b(chapter|chuong)\\s*\\d+') AND regexp_matches(n, '{answers.SUMMARY_WORDS}') THEN 'chapter_summary' WHEN regexp_matches(question, '^\\s*\\d+(?:[.,]\\d+)?\\s*%?\\s*$') THEN 'clarification_needed'
    WHEN regexp_matches(n, '{answers.CODE_WORDS}') THEN 'product_classification' WHEN regexp_matches(n, '{answers.DEFINITION_WORDS}') THEN 'definition' WHEN regexp_matches(n, '{answers.COMPARISON_WORDS}') THEN 'comparison' ELSE 'selected_section_qa' END AS intent FROM i0)
"""


@query("intent_route", f"WITH {INTENTS} SELECT * FROM intents")
def intent_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.intents(questions(spark, sf_dir))


def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = validated(spark, sf_dir)
    first = v.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*ranking.rank_order()))).filter("rank = 1").drop("question")
    q = questions(spark, sf_dir)
    return answers.gate(first, q, ranking.broad_decision(ranking.group_best(v), retrieval.signals(q)))


_CASES = [
    ("intent = 'simple_chat'", "chat", "high", "small talk"),
    ("intent = 'clarification_needed'", "numeric_lookup", "low", "a bare number is no question"),
    ("section_id IS NULL", "clarification", "low", "no candidate"),
    ("NOT accepted", "clarification", "low", "candidate not accepted"),
    ("state = 'exact code'", "classification", "high", "exact code"),
    ("starts_with(mode, 'broad_lookup')", "broad_lookup", "low", "question too broad"),
    ("confidence = 'low'", "lookup", "low", "low confidence"),
    ("coalesce(relevance, 0) < 20", "clarification", "low", "score too low"),
    ("NOT (coalesce(relevance, 0) >= 35 OR (coalesce(relevance, 0) >= 30 AND list_contains(strong, 'title_phrase'))) OR coalesce(len(strong), 0) < 1", "lookup", "low", "evidence too thin"),
    ("relevance >= 70", "classification", "high", "score and evidence suffice"),
]


def _pick(i: int, last: str) -> str:
    return "CASE " + " ".join(f"WHEN {c[0]} THEN '{c[i]}'" for c in _CASES) + f" ELSE '{last}' END"


GATED = f"""
top1 AS (SELECT * EXCLUDE (question) FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {_ORDER}) AS rank FROM validated) WHERE rank = 1),
gated AS (SELECT *, {_pick(1, "classification")} AS answer_mode, {_pick(2, "medium")} AS answer_confidence, {_pick(3, "score and evidence suffice")} AS answer_reason FROM intents LEFT JOIN (SELECT query_id, mode FROM broad) USING (query_id) LEFT JOIN top1 USING (query_id))
"""
WITH_GATED = f"{WITH_VALIDATED}, {GROUPS}, {BROAD}, {INTENTS}, {GATED}"


@query("product_gate", f"{WITH_GATED} SELECT query_id, answer_mode, answer_confidence, answer_reason FROM gated")
def product_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gated(spark, sf_dir).select("query_id", "answer_mode", "answer_confidence", "answer_reason")


_TITLE = "array_to_string(list_transform(string_split(lower(title), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"
_CITED = "'Source: ' || document || ', pages ' || page_start || '–' || page_end || ', section \"' || section || '\"'"


@query(
    "qa_answers",
    f"""{WITH_GATED} SELECT query_id, intent, answer_mode, answer_confidence, answer_reason, hs_code AS code, CASE WHEN answer_mode = 'chat' THEN 'Hello. Ask about a product, a code, a chapter or a document.' WHEN answer_mode IN ('clarification', 'numeric_lookup') THEN 'Please say more about the product.'
    WHEN answer_mode = 'classification' THEN {_TITLE} || ' has the code ' || hs_code || '. ' || {_CITED} ELSE 'Possibly ' || {_TITLE} || ' (' || hs_code || '). ' || {_CITED} END AS answer FROM gated""",
)
def qa_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole question batch, answered: signals, retrieval, relevance, validation, ranking, broadness, gate and reply."""
    return answers.reply(gated(spark, sf_dir))


_CODED = "section_id % 9 <> 0"  # sections that stand for those with a code


@query("usability_rank", f"{WITH_VALIDATED} SELECT query_id, section_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN {_CODED} THEN 0 ELSE 1 END, score DESC, document, seven) AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {_ORDER}) AS seven FROM validated)")
def usability_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections with a code before others, then by score and document; the ranking for the question decides among equals."""
    seven = F.row_number().over(Window.partitionBy("query_id").orderBy(*ranking.rank_order()))
    ranked = validated(spark, sf_dir).withColumn("seven", seven)
    order = (F.when(F.expr(_CODED), 0).otherwise(1), F.col("score").desc(), F.col("document"), F.col("seven"))
    return ranked.select("query_id", "section_id", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).alias("rank"))


@query("topk_per_query", f"WITH {SIGNALS}, {FIELDS}, {INDEX}, {SCORES} SELECT query_id, max(score) AS best, min(score) AS least, count(*) AS n FROM (SELECT query_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, section_id) AS r FROM scored WHERE score > 0) WHERE r <= 3 GROUP BY query_id")
def topk_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best sections of every query, summed up."""
    best = retrieval.top_k(scores(spark, sf_dir, 3).filter("score > 0"), 3, F.col("score").desc(), F.col("section_id"))
    return best.groupBy("query_id").agg(F.max("score").alias("best"), F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
