"""Text operators over `documents`, `part` and `benchmark`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierlake.functions import text as T
from dossierlake.plans import duck as D
from dossierlake.registry import query
from dossierlake.sources.tables import part_sections, part_sections_sql, table


def joined(c):
    return F.array_join(F.sort_array(c), "|")


@query("tok_normalize", f"SELECT doc_id, md5({D.normalize('text')}) AS normalized FROM documents")
def tok_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalize_search(F.col("text"))).alias("normalized"))


@query("tok_distinct_terms", f"SELECT doc_id, len(x) AS n_terms, md5({D.joined('x')}) AS terms FROM (SELECT doc_id, {D.ranking('text')} AS x FROM documents)")
def tok_distinct_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = table(spark, sf_dir, "documents").select("doc_id", T.ranking_tokens(F.col("text")).alias("x"))
    return terms.select("doc_id", F.size("x").cast("long").alias("n_terms"), F.md5(joined("x")).alias("terms"))


@query("tok_stopword_filter", f"SELECT doc_id, len(x) AS n_terms, md5({D.joined('x')}) AS terms FROM (SELECT doc_id, {D.meaningful('text')} AS x FROM documents)")
def tok_stopword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = table(spark, sf_dir, "documents").select("doc_id", T.meaningful_tokens(F.col("text")).alias("x"))
    return terms.select("doc_id", F.size("x").cast("long").alias("n_terms"), F.md5(joined("x")).alias("terms"))


@query(
    "tok_ngrams",
    f"""WITH t AS (SELECT item_id, {D.raw(D.normalize("text"))} AS x FROM benchmark)
    SELECT item_id, array_to_string(list_transform(range(1, greatest(len(x), 1)), lambda i: x[i] || ' ' || x[i + 1]), '|') AS pairs,
           array_to_string(list_transform(range(1, greatest(len(x) - 1, 1)), lambda i: x[i] || ' ' || x[i + 1] || ' ' || x[i + 2]), '|') AS triples FROM t""",
)
def tok_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "benchmark").select("item_id", T.raw_tokens(T.normalize_search(F.col("text"))).alias("x"))
    return t.select("item_id", F.array_join(T.ngrams(F.col("x"), 2), "|").alias("pairs"), F.array_join(T.ngrams(F.col("x"), 3), "|").alias("triples"))


@query(
    "term_boundary_count",
    f"""SELECT doc_id, term, len(list_filter(x, lambda t: t = term)) AS n
    FROM (SELECT doc_id, {D.raw(D.normalize("text"))} AS x FROM documents), (SELECT unnest(['the', 'license', 'of', 'example.com']) AS term) WHERE list_contains(x, term)""",
)
def term_boundary_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundary-delimited counts of given terms: the terms meet the exploded tokens, so one pass serves any number of terms."""
    terms = spark.createDataFrame([(x,) for x in ("the", "license", "of", "example.com")], "term string")
    tokens = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.raw_tokens(T.normalize_search(F.col("text")))).alias("term"))
    return tokens.join(F.broadcast(terms), "term").groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))


@query("phrase_contains", f"SELECT doc_id, phrase FROM (SELECT doc_id, {D.normalize('text')} AS n FROM documents), (SELECT unnest(['mit license', 'public license', 'apache license', 'licensed under']) AS phrase) WHERE contains(n, phrase)")
def phrase_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrases = ["mit license", "public license", "apache license", "licensed under"]
    text = table(spark, sf_dir, "documents").select("doc_id", T.normalize_search(F.col("text")).alias("n"))
    found = text.select("doc_id", F.filter(F.array(*map(F.lit, phrases)), lambda p: F.contains(F.col("n"), p)).alias("p"))
    return found.select("doc_id", F.explode("p").alias("phrase"))


_NUMERIC_CASES = ["moisture 12,5 % and 20-30 cm at least 5 kg", "from 3 to 7 percent under 40 mm", "no number here", "20%", "about 15 ppm or 15 ppm", "it hon 9 g"]
_NUMERIC_ROWS = ", ".join(f"({i}, '{q}')" for i, q in enumerate(_NUMERIC_CASES))


@query(
    "numeric_ranges",
    f"""WITH q AS (SELECT id, replace({D.normalize("question")}, ',', '.') AS t FROM (VALUES {_NUMERIC_ROWS}) v(id, question)),
    f AS (SELECT id, list_concat(list_transform(regexp_extract_all(t, '{T.NUMERIC_PATTERNS[0]}'), lambda x: regexp_replace(x, '%[^a-z0-9]$', '%')), regexp_extract_all(t, '{T.NUMERIC_PATTERNS[1]}'),
        regexp_extract_all(t, '{T.NUMERIC_PATTERNS[2]}'), regexp_extract_all(t, '{T.NUMERIC_PATTERNS[3]}')) AS x FROM q)
    SELECT CAST(id AS BIGINT) AS query_id, {D.joined("list_distinct(list_transform(x, lambda y: trim(regexp_replace(y, '\\s+', ' ', 'g'))))")} AS ranges FROM f""",
)
def numeric_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = spark.createDataFrame(list(enumerate(_NUMERIC_CASES)), "query_id long, question string")
    return cases.select("query_id", joined(T.numeric_ranges(F.col("question"))).alias("ranges"))


@query("code_extract_format", f"SELECT section_id, array_to_string(regexp_extract_all(section, '\\d{{4}}\\.\\d{{2}}\\.\\d{{2}}'), '|') AS codes, left(hs_code, 4) AS heading FROM ({part_sections_sql()})")
def code_extract_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_sections(spark, sf_dir).select("section_id", F.array_join(T.codes(F.col("section")), "|").alias("codes"), F.left("hs_code", F.lit(4)).alias("heading"))


@query(
    "sentence_split",
    """WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS x FROM documents)
    SELECT doc_id, len(x) AS n_sentences, md5(x[1]) AS first_sentence, list_max(list_transform(x, lambda y: length(y))) AS longest FROM s""",
)
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").select("doc_id", T.sentences(F.col("text")).alias("x"))
    return s.select("doc_id", F.size("x").cast("long").alias("n_sentences"), F.md5(F.get("x", F.lit(0))).alias("first_sentence"), F.array_max(F.transform("x", F.length)).cast("long").alias("longest"))


@query("preview_clip", f"SELECT doc_id, CASE WHEN length(f) > 180 THEN rtrim(left(f, 177)) || '...' ELSE f END AS preview FROM (SELECT doc_id, {D.flat('text')} AS f FROM documents)")
def preview_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.preview(F.col("text")).alias("preview"))


@query(
    "uppercase_ratio",
    """SELECT doc_id, CASE WHEN l = 0 THEN 0.0 ELSE round(u / l, 6) END AS ratio FROM (SELECT doc_id, len(regexp_extract_all(text, '\\p{L}')) AS l, len(regexp_extract_all(text, '\\p{Lu}')) AS u FROM documents)""",
)
def uppercase_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.round(T.uppercase_ratio(F.col("text")), 6).alias("ratio"))


_LANGUAGE_CASES = ["what is the code of green tea", "mã HS của chè xanh là gì", "which mã of tea", "xyz 12", "Thuộc chương nào", "chapter 9"]
_LANGUAGE_ROWS = ", ".join(f"({i}, '{q}')" for i, q in enumerate(_LANGUAGE_CASES))


@query(
    "language_detect",
    f"""WITH q AS (SELECT CAST(id AS BIGINT) AS query_id,
        regexp_matches(question, '[ăâđêôơưĂÂĐÊÔƠƯạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ]') OR regexp_matches({D.normalize("question")}, '\\b(la|gi|nao|cua|cho|ma|trong|va|thuoc)\\b') AS vi,
        regexp_matches({D.normalize("question")}, '\\b(what|which|how|is|are|the|of|for|code|does|document|chapter)\\b') AS en FROM (VALUES {_LANGUAGE_ROWS}) v(id, question))
    SELECT query_id, CASE WHEN vi AND en THEN 'mixed' WHEN vi THEN 'vi' WHEN en THEN 'en' ELSE 'unknown' END AS language FROM q""",
)
def language_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = spark.createDataFrame(list(enumerate(_LANGUAGE_CASES)), "query_id long, question string")
    return cases.select("query_id", T.language(F.col("question")).alias("language"))
