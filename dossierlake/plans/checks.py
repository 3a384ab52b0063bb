"""Markers, lineage, jobs, evaluation, alignment and answer texts over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dossierlake.functions import text as T
from dossierlake.operators import checks
from dossierlake.operators.rows import spread
from dossierlake.plans import duck as D
from dossierlake.registry import query
from dossierlake.sources.tables import part_sections, part_sections_sql, table

SECTIONS = part_sections_sql()
LINES = "lines AS (SELECT doc_id, i - 1 AS n, x[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents), unnest(range(1, len(x) + 1)) AS t(i))"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))


@query(
    "marker_table_width",
    f"""WITH {LINES}, r AS (SELECT *, len(string_split(line, '|')) AS width, n - row_number() OVER (PARTITION BY doc_id ORDER BY n) AS run FROM lines WHERE contains(line, '|'))
    SELECT doc_id, CAST(min(n) AS INT) AS first_line, count(*) AS n_lines, max(width) AS width, min(width) = max(width) AS passed FROM r GROUP BY doc_id, run""",
)
def marker_table_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.table_widths(lines(spark, sf_dir))


@query("marker_orphan_ratio", "SELECT source, count(*) AS n, count(*) FILTER (WHERE quality IS NULL) AS n_orphans, count(*) FILTER (WHERE quality IS NULL) * 20 <= count(*) AS passed FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def marker_orphan_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source, documents without a label, and whether they are at most one in twenty."""
    joined = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    orphans = F.count_if(F.col("quality").isNull())
    return joined.groupBy("source").agg(F.count(F.lit(1)).alias("n"), orphans.alias("n_orphans"), (orphans * 20 <= F.count(F.lit(1))).alias("passed"))


@query("marker_missing_codes", "SELECT DISTINCT o_custkey AS code FROM orders WHERE o_custkey NOT IN (SELECT p_partkey FROM part)")
def marker_missing_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("code")).distinct()
    return asked.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("code")), "code", "left_anti")


@query("marker_order_equal", "SELECT conv_id, list(turn ORDER BY turn) = list_sort(list(DISTINCT turn)) AND min(turn) = 0 AND max(turn) = count(*) - 1 AS passed FROM conversations GROUP BY conv_id")
def marker_order_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the turns of a conversation are 0, 1, 2 ... without gaps or repeats."""
    t = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("x"))
    return t.select("conv_id", (F.col("x") == F.sequence(F.lit(0).cast("long"), F.size("x").cast("long") - 1)).alias("passed"))


@query(
    "cache_status_matrix",
    """SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.h IS NULL THEN 'orphaned' WHEN l.h IS NULL THEN 'missing' WHEN d.h = l.h THEN 'fresh' ELSE 'stale' END AS state
    FROM (SELECT doc_id, md5(text) AS h FROM documents) d FULL JOIN (SELECT l.doc_id, CASE WHEN quality = 1 THEN md5(text) ELSE md5(text || '.') END AS h FROM labels l JOIN documents USING (doc_id)) l ON d.doc_id = l.doc_id""",
)
def cache_status_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents stand for parsed ones; those of low quality for a source that has changed since."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("hash_now"), F.md5(F.concat("text", F.lit("."))).alias("other"))
    then = table(spark, sf_dir, "labels").join(d, "doc_id").select("doc_id", F.when(F.col("quality") == 1, F.col("hash_now")).otherwise(F.col("other")).alias("hash_then"))
    return checks.cache_status(d.select("doc_id", "hash_now"), then)


@query("hash_duplicates", "SELECT md5(text) AS hash, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY md5(text) HAVING count(*) > 1")
def hash_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("hash"))
    return hashed.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).filter("n > 1")


@query("freshness_groups", "SELECT source, CASE WHEN quality IS NULL THEN 'missing' WHEN quality = 1 THEN 'fresh' ELSE 'stale' END AS state, count(*) AS n, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL")
def freshness_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    state = F.when(F.col("quality").isNull(), "missing").when(F.col("quality") == 1, "fresh").otherwise("stale")
    return joined.groupBy("source", state.alias("state")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


_STEP = "CASE event_type " + " ".join(f"WHEN '{w}' THEN '{s}'" for w, s, _ in checks.STEPS) + " ELSE 'unknown' END"
_OWN = "CASE event_type " + " ".join(f"WHEN '{w}' THEN {p}" for w, _, p in checks.STEPS) + " ELSE 10 END"


@query("step_infer", f"SELECT event_id, {_STEP} AS step, {_OWN} AS percent FROM events")
def step_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = checks.step_of(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", step.alias("step"), checks.progress_of(step).alias("percent"))


@query("job_progress", f"SELECT event_id, max({_OWN}) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS progress FROM events")
def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.running_progress(table(spark, sf_dir, "events")).select("event_id", "progress")


@query("job_latest_state", f"SELECT user_id, arg_max({_STEP}, (ts, event_id)) AS step, count(*) AS n_events, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000 AS elapsed_ms, CAST(floor(avg({_OWN}) + 0.5) AS BIGINT) AS mean_percent FROM events GROUP BY user_id")
def job_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = checks.running_progress(table(spark, sf_dir, "events")).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return e.groupBy("user_id").agg(F.max_by("step", F.struct("ts", "event_id")).alias("step"), F.count(F.lit(1)).alias("n_events"), F.floor((F.max("us") - F.min("us")) / 1000).alias("elapsed_ms"), F.floor(F.avg("own") + 0.5).alias("mean_percent"))


@query("active_count", f"SELECT step, count(*) AS n_jobs FROM (SELECT user_id, arg_max({_STEP}, (ts, event_id)) AS step FROM events GROUP BY user_id) GROUP BY step")
def active_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return job_latest_state(spark, sf_dir).groupBy("step").agg(F.count(F.lit(1)).alias("n_jobs"))


@query("chat_history", "SELECT conv_id, turn, role, count(*) OVER w AS n_before, md5(coalesce(string_agg(role || ':' || text, '|') OVER w, '')) AS history FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def chat_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the model has seen before each turn."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    said = F.collect_list(F.concat_ws(":", "role", "text")).over(w)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.count(F.lit(1)).over(w).alias("n_before"), F.md5(F.array_join(said, "|")).alias("history"))


_REASONS = "concat_ws('|', CASE WHEN n_chars < 200 THEN 'too_short' END, CASE WHEN quality = 0 THEN 'low_quality' END, CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN contains(lower(text), 'token =') THEN 'holds_secret' END)"


@query("eval_pass_reasons", f"SELECT doc_id, {_REASONS} AS reasons, {_REASONS} = '' AS passed FROM documents JOIN labels USING (doc_id)")
def eval_pass_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    reasons = F.array_compact(F.array(F.when(F.col("n_chars") < 200, "too_short"), F.when(F.col("quality") == 0, "low_quality"), F.when(F.col("toxic") == 1, "toxic"), F.when(F.contains(F.lower("text"), F.lit("token =")), "holds_secret")))
    return d.select("doc_id", F.array_join(reasons, "|").alias("reasons"), (F.size(reasons) == 0).alias("passed"))


@query("eval_pass_rate", f"SELECT source, count(*) AS n, count(*) FILTER (WHERE {_REASONS} = '') AS n_passed, round(floor(1000 * count(*) FILTER (WHERE {_REASONS} = '') / count(*) + 0.5) / 10, 1) AS rate FROM documents JOIN labels USING (doc_id) GROUP BY source")
def eval_pass_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = eval_pass_reasons(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    n, passed = F.count(F.lit(1)), F.count_if("passed")
    return told.groupBy("source").agg(n.alias("n"), passed.alias("n_passed"), F.round(F.floor(1000 * passed / n + 0.5) / 10, 1).alias("rate"))


def spans_and_units(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    names = spread(table(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").alias("span_id"), T.normalize_search(F.col("p_name")).alias("text"))
    titles = table(spark, sf_dir, "part").select("p_name").distinct().select(F.md5("p_name").alias("unit_id"), T.normalize_search(F.concat(F.lit("the "), F.col("p_name"), F.lit(" 20 cm"))).alias("text"))
    with_tokens = lambda df: df.withColumn("tokens", F.array_distinct(F.filter(T.raw_tokens(F.col("text")), lambda t: F.length(t) > 1)))
    return with_tokens(names), with_tokens(titles)


def _tok(x: str) -> str:
    return f"list_filter({D.raw(x)}, lambda t: length(t) > 1)"


def _overlap(a: str, b: str) -> str:
    return f"(CASE WHEN least(len({a}), len({b})) = 0 THEN 0 ELSE CAST(floor(1000 * len(list_intersect({a}, {b})) / least(len({a}), len({b}))) AS BIGINT) END)"


def _pairs(x: str) -> str:
    return f"list_transform(range(1, greatest(len({x}), 1)), lambda i: {x}[i] || ' ' || {x}[i + 1])"


ALIGNED = f"""sp AS (SELECT p_partkey AS span_id, p_name AS ta, {_tok("p_name")} AS a FROM (SELECT p_partkey, {D.normalize("p_name")} AS p_name FROM part)),
un AS (SELECT unit_id, tb, {_tok("tb")} AS b FROM (SELECT md5(p_name) AS unit_id, {D.normalize("'the ' || p_name || ' 20 cm'")} AS tb FROM (SELECT DISTINCT p_name FROM part))),
al AS (SELECT span_id, unit_id, CAST(CASE WHEN ta = tb THEN 80000 WHEN contains(tb, ta) THEN 58000 ELSE 0 END + 34 * {_overlap("a", "b")} + 34 * {_overlap(_pairs("a"), _pairs("b"))} + 26 * {_overlap("list_filter(a, lambda t: regexp_matches(t, '[0-9]'))", "list_filter(b, lambda t: regexp_matches(t, '[0-9]'))")} AS BIGINT) AS score
FROM sp JOIN un ON len(list_intersect(a, b)) > 0)"""


@query("overlap_coefficient_pairs", f"WITH {ALIGNED} SELECT span_id, unit_id, {_overlap('a', 'b')} AS overlap FROM sp JOIN un ON len(list_intersect(a, b)) > 0")
def overlap_coefficient_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.overlaps(*spans_and_units(spark, sf_dir))


@query("alignment_score", f"WITH {ALIGNED} SELECT * FROM al")
def alignment_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.aligned(*spans_and_units(spark, sf_dir))


@query("align_best_match", f"WITH {ALIGNED} SELECT span_id, unit_id, score FROM (SELECT *, row_number() OVER (PARTITION BY span_id ORDER BY score DESC, unit_id) AS n FROM al WHERE score >= 32000) WHERE n = 1")
def align_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.best_aligned(*spans_and_units(spark, sf_dir), 32000)


_FIELDS = "(SELECT section_id, string_split(text, '. ') AS x FROM (" + SECTIONS + "))"


@query("field_extract", f"SELECT section_id, lower(trim(regexp_extract(y, '^(Type|Size|Sold as)\\b', 1))) AS field, trim(regexp_replace(regexp_replace(y, '^(Type|Size|Sold as)\\s+', ''), '\\.$', '')) AS value FROM (SELECT section_id, unnest(x) AS y FROM {_FIELDS}) WHERE regexp_matches(y, '^(Type|Size|Sold as)\\b')")
def field_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled statements of a section's text as rows of field and value."""
    each = part_sections(spark, sf_dir).select("section_id", F.explode(F.split("text", r"\. ")).alias("y"))
    label = r"^(Type|Size|Sold as)\b"
    value = F.trim(F.regexp_replace(F.regexp_replace("y", r"^(Type|Size|Sold as)\s+", ""), r"\.$", ""))
    return each.filter(F.col("y").rlike(label)).select("section_id", F.lower(F.regexp_extract("y", label, 1)).alias("field"), value.alias("value"))


@query(
    "block_segment",
    f"""WITH {LINES}, k AS (SELECT doc_id, n, line, CASE WHEN trim(line) = '' THEN 'blank' WHEN contains(line, '|') THEN 'table' WHEN regexp_matches(line, '^\\s*[-*]\\s') THEN 'bullet' WHEN length(line) <= 60 AND NOT regexp_matches(line, '[.!?]\\s*$') THEN 'heading' ELSE 'paragraph' END AS kind FROM lines),
    r AS (SELECT *, n - row_number() OVER (PARTITION BY doc_id, kind ORDER BY n) AS run FROM k WHERE kind <> 'blank') SELECT doc_id, kind, CAST(min(n) AS INT) AS first_line, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM r GROUP BY doc_id, kind, run""",
)
def block_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of neighbouring lines of one kind."""
    kind = F.when(F.trim("line") == "", "blank").when(F.contains(F.col("line"), F.lit("|")), "table").when(F.col("line").rlike(r"^\s*[-*]\s"), "bullet").when((F.length("line") <= 60) & ~F.col("line").rlike(r"[.!?]\s*$"), "heading").otherwise("paragraph")
    k = lines(spark, sf_dir).withColumn("kind", kind).filter("kind <> 'blank'")
    runs = k.withColumn("run", F.col("n") - F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy("n")))
    return runs.groupBy("doc_id", "kind", "run").agg(F.min("n").alias("first_line"), F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("n_chars")).drop("run")


@query("table_long_form", f"WITH {LINES} SELECT doc_id, CAST(n AS INT) AS line, CAST(i - 1 AS INT) AS cell, trim(x[i]) AS value FROM (SELECT doc_id, n, string_split(line, '|') AS x FROM lines WHERE contains(line, '|')), unnest(range(1, len(x) + 1)) AS t(i) WHERE trim(x[i]) <> ''")
def table_long_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = lines(spark, sf_dir).filter(F.contains(F.col("line"), F.lit("|"))).select("doc_id", F.col("n").alias("line"), F.posexplode(F.split("line", r"\|")).alias("cell", "value"))
    return cells.select("doc_id", "line", "cell", F.trim("value").alias("value")).filter("value <> ''")


@query("table_compare", "SELECT p_brand, p_type, arg_max(p_name, (p_retailprice, p_partkey)) AS most, arg_min(p_name, (p_retailprice, p_partkey)) AS least, round(max(p_retailprice) - min(p_retailprice), 2) AS apart FROM part GROUP BY p_brand, p_type")
def table_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.struct("p_retailprice", "p_partkey")
    return table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.max_by("p_name", key).alias("most"), F.min_by("p_name", key).alias("least"), F.round(F.max("p_retailprice") - F.min("p_retailprice"), 2).alias("apart"))


@query("best_excerpt", f"WITH {LINES} SELECT doc_id, CAST(n AS INT) AS line, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, n) AS r FROM (SELECT doc_id, n, CAST(len(list_intersect({D.raw(D.normalize('line'))}, ['the', 'license', 'and', 'of', 'under', 'work'])) AS BIGINT) AS score FROM lines)) WHERE r = 1 AND score > 0")
def best_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line of each document that shares the most words with an answer; the earlier one on ties."""
    answer = F.array(*map(F.lit, ("the", "license", "and", "of", "under", "work")))
    scored = lines(spark, sf_dir).select("doc_id", F.col("n").alias("line"), F.size(F.array_intersect(T.raw_tokens(T.normalize_search(F.col("line"))), answer)).cast("long").alias("score"))
    best = scored.groupBy("doc_id").agg(F.max(F.struct("score", -F.col("line"))).alias("b"))
    return best.select("doc_id", (-F.col("b")["col2"]).alias("line"), F.col("b.score").alias("score")).filter("score > 0")


_CLEAN = "trim(regexp_replace(regexp_replace(regexp_replace(text, '<[^>]*>|token = \"[^\"]*\"', '', 'g'), '[#*$%&|<>]{2,}', '', 'g'), '\\s+', ' ', 'g'))"


@query("sanitize_answer", f"SELECT doc_id, md5(array_to_string(string_split({_CLEAN}, ' ')[1:180], ' ')) AS answer, least(len(string_split({_CLEAN}, ' ')), 180) AS n_words FROM documents")
def sanitize_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markup, secrets and symbol runs go; the answer keeps at most 180 words."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("text", '<[^>]*>|token = "[^"]*"', ""), r"[#*$%&|<>]{2,}", ""), r"\s+", " "))
    words = F.slice(F.split(clean, " "), 1, 180)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.array_join(words, " ")).alias("answer"), F.size(words).cast("long").alias("n_words"))
