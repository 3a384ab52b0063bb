"""Normal forms, token sets, names and answer texts over sections and questions made from `part`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierlake.functions import forms as X
from dossierlake.functions import text as T
from dossierlake.operators import integrity
from dossierlake.operators.rows import spread
from dossierlake.plans import duck as D
from dossierlake.plans.text import joined
from dossierlake.registry import query
from dossierlake.sources.tables import part_sections, part_sections_sql, table

SECTIONS = part_sections_sql()


# ---- the same raw text on both sides, with accents, dashes, dots, quotes and comparatives

_RAW = "'## ' || title || ' — “Đất” Cà-phê_x..y ‘' || text || ' [1.5-2 kg] higher longest code 12 -- 3.5.'"


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spread(part_sections(spark, sf_dir), "section_id")
    return s.select("section_id", F.concat(F.lit("## "), "title", F.lit(" — “Đất” Cà-phê_x..y ‘"), "text", F.lit(" [1.5-2 kg] higher longest code 12 -- 3.5.")).alias("raw"))


def _low(x: str, dee: bool = True, broken: str = "") -> str:
    extra = ("đĐ" if dee else "") + broken
    return f"lower(translate({x}, '{X.ACCENTED}{extra}', '{X.PLAIN}{'d' * len(extra)}'))"


def _sub(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, '{pattern.replace(chr(39), chr(39) * 2)}', '{by}', 'g')"


def _alignment(x: str) -> str:
    x = _sub(x, r"!\[[^\]]*\]\([^)]*\)|[`*_~>#\[\]()]", " ")
    x = _sub(_sub(_sub(x, "[–—−]", "-"), "[“”„‟]", '"'), "[‘’‚‛]", "''").replace("''''''", "''''")
    x = _sub(_sub(_low(x), r"\.{2,}", " "), "-{2,}", " ")
    x = _sub(x, "-", " ")
    # dots between digits are kept apart twice, as neighbours share a digit
    for _ in range(2):
        x = _sub(x, r"([0-9])\.([0-9])", r"\1§\2")
    x = f"replace(replace({x}, '.', ' '), '§', '.')"
    return D.flat(_sub(x, "[,;:!?/\\\\|+=%$€£¥^\"'{}<>-]", " "))


_FORMS = {
    "planner": D.flat(_low("raw")),
    "intent": D.flat(_low("raw", broken=X.BROKEN_INTENT)),
    "local": D.flat(_low("raw", False, X.BROKEN_INTENT)),
    "lookup": D.flat(_low("raw", False, X.BROKEN_LOOKUP)),
    "field": D.flat(_sub(_low("raw"), "[_-]+", " ")),
    "fusion": D.flat(_sub(_low("raw", False), "[^a-z0-9:._/<>= -]+", " ")),
    "search": _sub(_sub(_low("raw"), r"\bca\s+phe\b", "coffee"), r"\bwoodchips\b", "wood chips"),
    "inline": D.flat("replace(raw, 'ï¿½', '-')"),
    "alignment": _alignment("raw"),
}
_RAWS = f"(SELECT section_id, {_RAW} AS raw FROM ({SECTIONS}))"


@query("text_forms", "SELECT section_id, " + ", ".join(f"{v} AS {k}" for k, v in _FORMS.items()) + f" FROM {_RAWS}")
def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text in the form of every caller."""
    c = F.col("raw")
    own = {"planner": X.planner_form(c), "intent": X.intent_form(c), "local": X.local_form(c), "lookup": X.lookup_form(c), "field": X.field_form(c), "fusion": X.fusion_form(c), "search": X.search_form(c), "inline": X.inline_form(c), "alignment": X.alignment_form(c)}
    return raw(spark, sf_dir).select("section_id", *[v.alias(k) for k, v in own.items()])


def _in(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in dict.fromkeys(words))


def _search_form(t: str) -> str:
    return f"CASE {t} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in X.SEARCH_FORMS.items()) + f" ELSE {t} END"


def _tokens(form: str, stop: list[str] | None, least: int = 3, shaped: bool = False, split: str = "[^a-z0-9.]+", more: str = "true") -> str:
    each = f"string_split_regex({form}, '{split}')"
    if shaped:
        each = f"list_transform({each}, lambda t: {_search_form('t')})"
    kept = f"t NOT IN ({_in(stop)})" if stop else "true"
    return f"array_to_string(list_sort(list_distinct(list_filter({each}, lambda t: (length(t) >= {least}) AND ({more}) AND {kept}))), '|')"


_TOKEN_SETS = {
    "search_terms": _tokens(_FORMS["search"], X.SEARCH_STOPWORDS, shaped=True),
    "source_terms": _tokens(_FORMS["search"], X.SEARCH_STOPWORDS, shaped=True),
    "planner_terms": _tokens(_FORMS["planner"], X.PLANNER_STOPWORDS, 2),
    "intent_terms": _tokens(_FORMS["intent"], X.INTENT_STOPWORDS, 1, more="(length(t) >= 3 OR regexp_matches(t, '^[0-9]+([.][0-9]+)?$')) AND NOT regexp_matches(t, '^[0-9]+$')"),
    "local_terms": _tokens(_FORMS["local"], X.LOCAL_STOPWORDS, shaped=True),
    "field_terms": _tokens(_FORMS["field"], X.FIELD_STOPWORDS, split="[^a-z0-9]+"),
    "alignment_terms": _tokens(_FORMS["alignment"], None, 2),
}
_MATCHED = f"regexp_matches('|' || {_TOKEN_SETS['local_terms']} || '|', '[|](highest|high|higher)[|]') AS matches_highest, regexp_matches('|' || {_TOKEN_SETS['local_terms']} || '|', '[|](rounder|round)[|]') AS matches_round"


@query("token_sets", "SELECT section_id, " + ", ".join(f"{v} AS {k}" for k, v in _TOKEN_SETS.items()) + f", {_MATCHED} FROM {_RAWS}")
def token_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token sets of every caller; the equivalents of a local token match too."""
    c = F.col("raw")
    own = {"search_terms": X.search_tokens(c), "source_terms": X.source_tokens(c), "planner_terms": X.planner_tokens(c), "intent_terms": X.intent_tokens(c), "local_terms": X.local_tokens(c), "field_terms": X.field_tokens(c), "alignment_terms": X.alignment_tokens(c)}
    sets = raw(spark, sf_dir).select("section_id", *[v.alias(k) for k, v in own.items()])
    return sets.select("section_id", *[joined(k).alias(k) for k in own], X.matches_local(F.col("local_terms"), F.lit("higher")).alias("matches_highest"), X.matches_local(F.col("local_terms"), F.lit("round")).alias("matches_round"))


# ---- names and comparisons of questions

_QUESTION = "CASE p_partkey % 4 WHEN 0 THEN 'Tell me: Green ' || p_name || ' in \"' || p_brand || '\" longer in size than ' || lower(p_type) || ' and Coffea arabica?' WHEN 1 THEN 'Which Robusta beans are sweeter than red ' || p_name || ' with ‘' || p_brand || '’' WHEN 2 THEN 'mã của ' || p_name ELSE '12 / ' || p_size END"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    first = F.concat(F.lit("Tell me: Green "), "p_name", F.lit(' in "'), "p_brand", F.lit('" longer in size than '), F.lower("p_type"), F.lit(" and Coffea arabica?"))
    second = F.concat(F.lit("Which Robusta beans are sweeter than red "), "p_name", F.lit(" with ‘"), "p_brand", F.lit("’"))
    q = F.when(k == 0, first).when(k == 1, second).when(k == 2, F.concat(F.lit("mã của "), "p_name")).otherwise(F.concat(F.lit("12 / "), F.col("p_size").cast("string")))
    return spread(table(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").alias("query_id"), q.alias("question"))


_STARTS = _in(X.QUESTION_STARTERS)
_STOPS = _in(T.STOPWORDS)
_WORDS = D.raw("n")
_MEANT = f"len(list_filter(list_transform({_WORDS}, lambda t: {D.form('t')}), lambda t: (length(t) >= 3 OR regexp_matches(t, '^[0-9]+([.][0-9]+)?$')) AND t NOT IN ({_STOPS})))"
_NORMAL = lambda pattern: f"list_transform(regexp_extract_all(question, '{pattern}'), lambda m: {D.normalize('m')})"
_QUOTED = "regexp_extract_all(question, '[\"''“”‘’]([^\"''“”‘’]{2,80})[\"''“”‘’]', 1)"


@query(
    "question_names",
    f"""WITH q AS (SELECT p_partkey AS query_id, {_QUESTION} AS question FROM part), n AS (SELECT query_id, question, {D.normalize("question")} AS norm, list_transform({_QUOTED}, lambda m: {D.normalize("m")}) AS quoted,
        {_NORMAL(X._NAMES % 0)} AS one, {_NORMAL(X._NAMES % 1)} AS two FROM q),
    cap AS (SELECT query_id, list_sort(list(DISTINCT n)) AS x FROM (SELECT query_id, unnest(one) AS n FROM n) WHERE {_MEANT} > 0 AND ({_WORDS})[1] NOT IN ({_STARTS}) AND NOT list_has_any({_WORDS}, ['and', 'or', 'has', 'have', 'is', 'are']) GROUP BY query_id),
    sci AS (SELECT query_id, list_sort(list(DISTINCT n)) AS x FROM (SELECT query_id, n FROM (SELECT query_id, unnest(two) AS n FROM n) WHERE len({_WORDS}) >= 2 AND NOT list_has_any(({_WORDS})[2:], [{_STOPS}]) UNION ALL SELECT query_id, unnest(quoted) AS n FROM n)
        WHERE len({_WORDS}) > 0 AND ({_WORDS})[1] NOT IN ({_STARTS}) AND len(list_filter({_WORDS}, lambda t: t NOT IN ({_STOPS}))) > 0 GROUP BY query_id),
    base AS (SELECT query_id, list_sort(list_distinct(flatten(list_transform(regexp_extract_all(norm, '{X.COMPARED}', 1), lambda b: list_filter(string_split_regex(regexp_replace(b, '{X.BROKEN_OFF}', ''), '[^a-z0-9.]+'), lambda t: length(t) >= 3)[1:3])))) AS x FROM n)
    SELECT n.query_id, array_to_string(list_sort(list_distinct(quoted)), '|') AS quoted, coalesce(array_to_string(cap.x, '|'), '') AS capitalised, coalesce(array_to_string(sci.x, '|'), '') AS scientific, array_to_string(base.x, '|') AS baseline,
        regexp_matches(lower(question), '{X.VIETNAMESE_LETTERS}') OR regexp_matches(norm, '{X.VIETNAMESE_WORDS}') OR NOT regexp_matches(question, '[a-zA-Z]') AS vietnamese
    FROM n LEFT JOIN cap ON n.query_id = cap.query_id LEFT JOIN sci ON n.query_id = sci.query_id JOIN base ON n.query_id = base.query_id""",
)
def question_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted terms, names, what a comparison is against, and the language to answer in."""
    c = F.col("question")
    sets = questions(spark, sf_dir).select("query_id", "question", X.quoted_terms(c).alias("quoted"), X.capitalised_terms(c).alias("capitalised"), X.scientific_names(c).alias("scientific"), X.baseline_tokens(T.normalize_search(c)).alias("baseline"))
    return sets.select("query_id", *[joined(k).alias(k) for k in ("quoted", "capitalised", "scientific", "baseline")], X.prefers_vietnamese(c).alias("vietnamese"))


# ---- answer texts

_MD = "'## ' || section || chr(10) || '![a](b.png)' || chr(10) || '<!-- x' || chr(10) || 'y --> ' || text || chr(10) || '*Caption: The ' || title || '*' || chr(10) || '(Source: book)' || chr(10) || 'It is of use. Goods of ' || lower(title) || ' should be classified under ' || hs_code || ' if dry and clean. Codes 1234.56.78 do not apply. <doc=a.pdf;page=1>' || chr(10) || chr(10) || 'Nguồn: x'"


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.lit("\n")
    md = F.concat(F.lit("## "), "section", n, F.lit("![a](b.png)"), n, F.lit("<!-- x"), n, F.lit("y --> "), "text", n, F.lit("*Caption: The "), "title", F.lit("*"), n, F.lit("(Source: book)"), n, F.lit("It is of use. Goods of "), F.lower("title"), F.lit(" should be classified under "), "hs_code", F.lit(" if dry and clean. Codes 1234.56.78 do not apply. <doc=a.pdf;page=1>"), n, n, F.lit("Nguồn: x"))  # noqa: E501
    return spread(part_sections(spark, sf_dir), "section_id").select("section_id", "section", "title", "hs_code", "text", md.alias("md"))


_CLEAN = D.flat(_sub(_sub(_sub(_sub(_sub("md", "(?m)^#{1,6}\\s+.*$", ""), "!\\[[^\\]]*\\]\\([^)]+\\)", ""), "(?s)<!--.*?-->", ""), "(?im)^\\*Caption:\\s*[^*]+\\*$", ""), "(?im)^\\(Source:[^)]+\\)$", ""))
_SENTENCES = lambda x: f"list_filter(list_transform(string_split(regexp_replace({x}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda y: trim(y)), lambda y: y <> '')"
_END = lambda x: f"CASE WHEN regexp_matches(trim({x}), '[.!?]$') THEN trim({x}) ELSE trim({x}) || '.' END"
_CLIP = lambda x, n: f"trim(regexp_replace(left({x}, {n}), '\\s+\\S*$', ''))"
_TITLE = "list_filter(string_split_regex(lower(title), '\\s+'), lambda w: true)"


@query(
    "section_answers",
    f"""WITH m AS (SELECT section_id, section, title, hs_code, {_MD} AS md FROM ({SECTIONS})), c AS (SELECT *, {_CLEAN} AS clean FROM m), s AS (SELECT *, {_SENTENCES("clean")} AS x, {_TITLE} AS w FROM c),
    t AS (SELECT *, x[list_position(list_transform(x, lambda y: regexp_matches(y, '{X.NOTE}')), true)] AS note FROM s)
    SELECT section_id, clean AS retrieved, array_to_string(list_transform(regexp_extract_all(md, '(?i)\\*Caption:\\s*([^*]+)\\*', 1), lambda y: trim(y)), '|') AS captions,
        CASE WHEN length(note) <= 220 THEN note WHEN length(note) > 220 THEN {_END(_CLIP("note", 180))} END AS note, {_END(_CLIP("clean", 60))} AS shortened,
        coalesce(list_last(list_filter(list_transform(range(1, len(x) + 1), lambda i: array_to_string(x[1:i], ' ')), lambda p: length(p) <= 90)), {_CLIP("clean", 90)}) AS sentences,
        array_to_string(list_filter(list_transform(string_split_regex(regexp_replace(md, '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), '\\n{{2,}}|' || chr(1)), lambda p: trim(p, ' ')), lambda p: length(p) >= 8), '|') AS paragraphs,
        trim(regexp_replace(section, '^[0-9.]{{10}}[\\s—–-]+', '')) AS heading, array_to_string(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN w[i] IN ({_in(X.SMALL_TITLE_WORDS)}) AND i > 1 AND i < len(w) THEN w[i] ELSE upper(w[i][1]) || w[i][2:] END), ' ') AS title_case,
        {D.flat("replace(md, '1234.56.78', '')")} AS stripped, {D.flat("regexp_replace(regexp_replace(md, '(?i)<doc=[^>]+>', '', 'g'), '(?is)\\s*(Trích dẫn|Citation|Nguồn):.*$', '')")} AS direct
    FROM t""",
)
def section_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that answers are made of: running text, captions, notes, shortened forms, titles."""
    m = markdown(spark, sf_dir).withColumn("clean", X.retrieved_text(F.col("md")))
    c, md = F.col("clean"), F.col("md")
    return m.select(
        "section_id", c.alias("retrieved"), F.array_join(X.captions(md), "|").alias("captions"), X.classification_note(md).alias("note"), X.shorten_sentence(c, 60).alias("shortened"), X.shorten_to_sentences(c, 90).alias("sentences"),
        F.array_join(X.paragraphs(md), "|").alias("paragraphs"), X.heading_title(F.concat(F.lit("## "), "section")).alias("heading"), X.title_case(F.col("title")).alias("title_case"),
        X.strip_codes(md, F.array("hs_code")).alias("stripped"), X.direct_answer(md).alias("direct"),
    )


# ---- markers of answers and trees

_CITED = "text || CASE WHEN doc_id % 2 = 0 THEN ' <doc=a.pdf;page=1> <DOC=b>' ELSE '' END"


@query(
    "answer_markers",
    f"""SELECT doc_id, len(regexp_extract_all(a, '(?i)<doc=[^>]+>')) AS n_citations, len(regexp_extract_all(a, '(?i)<doc=[^>]+>')) > 0 AS cited, length(text) AS context_chars, length(text) <= 1500 AS context_fits,
    len(list_filter(string_split_regex(a, '[\\s\\x0B]+'), lambda w: w <> '')) AS answer_words, len(list_filter(string_split_regex(a, '[\\s\\x0B]+'), lambda w: w <> '')) <= 120 AS answer_fits FROM (SELECT doc_id, text, {_CITED} AS a FROM documents)""",
)
def answer_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat("text", F.when(F.col("doc_id") % 2 == 0, " <doc=a.pdf;page=1> <DOC=b>").otherwise("")).alias("a"))
    return d.select("doc_id", *integrity.answer_markers(F.col("a"), F.col("text")))


@query(
    "tree_integrity",
    f"""WITH s AS ({SECTIONS}), e AS (SELECT DISTINCT document, hs_code AS code FROM s), n AS (SELECT document, hs_code AS code, CASE WHEN section_id % 5 <> 0 THEN title END AS summary FROM s WHERE section_id % 70 <> 0 AND document <> 'Brand#5'),
    m AS (SELECT document, hs_code AS code, CASE WHEN section_id % 3 <> 0 THEN page_start END AS page_start, page_end FROM s WHERE section_id % 110 <> 0 AND document <> 'Brand#3'),
    b AS (SELECT e.document, e.code, t.bare, t.code IS NULL AS no_node, m.code IS NULL AS no_map, m.page_start IS NULL OR m.page_end IS NULL AS no_range FROM e LEFT JOIN (SELECT document, code, bool_and(summary IS NULL) AS bare FROM n GROUP BY ALL) t USING (document, code) LEFT JOIN m ON m.document = e.document AND m.code = e.code),
    c AS (SELECT document, count(*) AS n_codes, coalesce(string_agg(code, '|' ORDER BY code) FILTER (WHERE no_node), '') AS missing_in_tree, coalesce(string_agg(code, '|' ORDER BY code) FILTER (WHERE no_map), '') AS missing_in_map,
        coalesce(string_agg(code, '|' ORDER BY code) FILTER (WHERE bare), '') AS missing_summaries, coalesce(string_agg(code, '|' ORDER BY code) FILTER (WHERE no_range AND NOT no_map), '') AS missing_ranges FROM b GROUP BY document),
    r AS (SELECT c.*, coalesce(n_nodes, 0) AS n_nodes, coalesce(n_summaries, 0) AS n_summaries, coalesce(n_mapped, 0) AS n_mapped FROM c LEFT JOIN (SELECT document, count(*) AS n_nodes, count(summary) AS n_summaries FROM n GROUP BY document) USING (document) LEFT JOIN (SELECT document, count(DISTINCT code) AS n_mapped FROM m GROUP BY document) USING (document)),
    x AS (SELECT *, concat_ws('|', CASE WHEN n_nodes = 0 THEN 'tree-missing-or-invalid' END, CASE WHEN missing_in_tree <> '' THEN 'missing-hs-codes-in-tree' END, CASE WHEN n_mapped = 0 THEN 'section-map-missing-or-invalid' END, CASE WHEN missing_in_map <> '' THEN 'missing-hs-codes-in-section-map' END) AS errors FROM r)
    SELECT *, errors = '' AS passed FROM x""",
)
def tree_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose tree or section map lost codes, and some that lost them all, beside those that pass."""
    s = part_sections(spark, sf_dir)
    expected = s.select("document", F.explode(T.codes(F.col("section"))).alias("code"))
    nodes = s.filter((F.col("section_id") % 70 != 0) & (F.col("document") != "Brand#5")).select("document", F.col("section").alias("text"), F.when(F.col("section_id") % 5 != 0, F.col("title")).alias("summary"))
    mapped = s.filter((F.col("section_id") % 110 != 0) & (F.col("document") != "Brand#3")).select("document", F.col("hs_code").alias("code"), F.when(F.col("section_id") % 3 != 0, F.col("page_start")).alias("page_start"), "page_end")
    return integrity.tree_integrity(expected, nodes, mapped)


_BLOCK = "CASE section_id % 6 WHEN 0 THEN 'Source: ' || title WHEN 1 THEN section WHEN 2 THEN 'Chapter ' || page_start WHEN 3 THEN title WHEN 4 THEN text ELSE '# ' || title END"
_KIND = "CASE WHEN section_id % 12 = 3 THEN 'IMAGE' WHEN section_id % 5 = 0 THEN 'other' ELSE 'text' END"


@query(
    "block_types",
    f"""SELECT section_id, CASE WHEN lower(k) IN ('image', 'table', 'caption') THEN lower(k) WHEN regexp_matches(t, '(?i)^source\\b') THEN 'source' WHEN regexp_matches(t, '\\b\\d{{4}}\\.\\d{{2}}\\.\\d{{2}}\\b') THEN 'hs-code' WHEN regexp_matches(t, '(?i)^chapter\\s+\\d+') OR regexp_matches(t, '^#+\\s+') THEN 'heading'
    WHEN length(t) > 0 AND length(t) < 150 AND t = upper(t) AND regexp_matches(t, '[A-Z]') THEN 'title' WHEN lower(k) = 'text' THEN 'paragraph' ELSE 'unknown' END AS type FROM (SELECT section_id, {_BLOCK} AS t, {_KIND} AS k FROM ({SECTIONS}))""",
)
def block_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("section_id")
    t = F.when(i % 6 == 0, F.concat(F.lit("Source: "), "title")).when(i % 6 == 1, F.col("section")).when(i % 6 == 2, F.concat(F.lit("Chapter "), F.col("page_start").cast("string"))).when(i % 6 == 3, F.col("title")).when(i % 6 == 4, F.col("text")).otherwise(F.concat(F.lit("# "), "title"))
    k = F.when(i % 12 == 3, "IMAGE").when(i % 5 == 0, "other").otherwise("text")
    return part_sections(spark, sf_dir).select("section_id", X.block_type(k, t).alias("type"))
