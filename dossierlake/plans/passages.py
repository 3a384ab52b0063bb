"""Local answers from sections of parts: lists, labels, piped and flattened tables, asked about by questions of several kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierlake.functions import forms as X
from dossierlake.operators import passages as W
from dossierlake.operators.rows import spread
from dossierlake.plans import duck as D
from dossierlake.plans.forms import _low, _tokens
from dossierlake.plans.planning import _FIELD, _GROUPS, _ONE, _STOP
from dossierlake.registry import query
from dossierlake.sources.tables import table

#: Texts and questions, the same in both languages; NL stands for a line's end.
_TEXT = """'## ' || p_partkey || ' ' || upper(p_name) || NL || CASE p_partkey % 5
    WHEN 0 THEN 'It is a ' || lower(p_type) || ' kind. Appearance: smooth and ' || p_name || '. Usage: for salads of ' || p_size || ' cm.'
    WHEN 1 THEN '- keeps ' || p_size || ' days in a cool place' || NL || '- comes dried and packed' || NL || 'Activeness' || NL || 'Moves ' || p_size || ' times an hour' || NL || 'and then rests. Source: book'
    WHEN 2 THEN 'Table of mature and young coconut water. Protein mg% 1.5 2.25 Fat ' || p_size || '.5 ' || (p_size + 1) || ' Ash (total) 3 3 B12 rich water 4 5 water 6 7'
    WHEN 3 THEN '| Part | Mature | Young |' || NL || '| --- | :--: | --- |' || NL || '| Sugar mg% | 4.5 | ' || p_size || ' |' || NL || '| Salt | none | 2 |' || NL || '| Fat % | ' || p_size || ' | ' || p_size || ' |' || NL || 'Cold tender fat ' || p_size || ' 9'
    ELSE 'Source: a book' || NL || 'Weight and size: about ' || p_size || ' cm' || NL || 'must be dry' || NL || p_name || ' is grown by hand. It needs sun. Sold as ' || lower(p_type) || ' in bags.' END"""
_ASK = """CASE p_partkey % 4 WHEN 0 THEN 'Which has higher protein, mature or young coconut water?' WHEN 1 THEN 'Is the fat lower in tender or mature ones?' WHEN 2 THEN 'How is ' || p_name || ' used and what is its appearance?' ELSE 'How many days does it keep in a cool place, ' || p_size || ' cm or more?' END"""
_SECTIONS = f"(SELECT CAST(p_partkey AS VARCHAR) AS section_id, {_TEXT.replace('NL', 'chr(10)')} AS text FROM part)"
_ASKED = f"(SELECT 'q' || p_partkey AS query_id, CAST(p_partkey AS VARCHAR) AS section_id, {_ASK} AS question FROM part)"


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("section_id"), F.expr(_TEXT.replace("NL", r"'\n'")).alias("text"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.expr("'q' || p_partkey").alias("query_id"), F.col("p_partkey").cast("string").alias("section_id"), F.expr(_ASK).alias("question"))
    return W.signals(spread(p, "section_id"))


# -- tables: the twin reads numbers by words, not by one pattern

_LOCAL = lambda x: f"trim(regexp_replace({_low(x, False, X.BROKEN_INTENT)}, '\\s+', ' ', 'g'))"
_LABEL = lambda x: f"trim(regexp_replace(regexp_replace({x}, '(?i)\\b(mature\\s+coconut\\s+water|tender/young\\s+coconut(\\s+water)?|water)\\b', ' ', 'g'), '\\s+', ' ', 'g'))"
_ROWS = f"""ask AS {_ASKED}, sec AS {_SECTIONS},
    ln AS (SELECT section_id, n, string_split(regexp_replace(regexp_replace(line, '^\\|', ''), '\\|$', ''), '|') AS c FROM (SELECT section_id, unnest(list_filter(string_split(text, chr(10)), lambda l: contains(l, '|'))) AS line, unnest(range(len(list_filter(string_split(text, chr(10)), lambda l: contains(l, '|'))))) AS n FROM sec)),
    piped AS (SELECT b.section_id, 0 AS kind, h.n AS head, b.n, {_LABEL("b.c[1]")} AS label, list_filter(list_transform(range(2, len(b.c) + 1), lambda i: struct_pack("column" := lower(trim(h.c[i])), raw := regexp_extract(b.c[i], '-?\\d+(\\.\\d+)?'))), lambda v: v.raw <> '') AS vals FROM ln h JOIN ln s ON s.section_id = h.section_id AND s.n = h.n + 1 AND len(list_filter(s.c, lambda x: regexp_matches(trim(x), '^:?-{{2,}}:?$'))) > 0 JOIN ln b ON b.section_id = h.section_id AND b.n >= h.n + 2),
    wd AS (SELECT query_id, section_id, said, string_split(trim(regexp_replace(regexp_replace(text, '[|]+', ' ', 'g'), '\\s+', ' ', 'g')), ' ') AS w FROM (SELECT *, {_LOCAL("question || ' ' || text")} AS said FROM ask JOIN sec USING (section_id)) WHERE regexp_matches(said, '\\bmature\\b') AND regexp_matches(said, '\\b(tender|young)\\b')),
    met AS (SELECT *, unnest(list_filter(range(2, len(w)), lambda i: regexp_full_match(w[i], '-?\\d+(\\.\\d+)?') AND regexp_full_match(w[i + 1], '-?\\d+(\\.\\d+)?') AND (i + 1 = len(w) OR regexp_matches(w[i + 2], '^[A-Za-z]')))) AS i FROM wd),
    lead_ AS (SELECT *, coalesce(lag(i) OVER (PARTITION BY query_id ORDER BY i) + 2, 1) AS since FROM met),
    flat AS (SELECT query_id, section_id, 1 AS kind, 0 AS head, row_number() OVER (PARTITION BY query_id ORDER BY i) - 1 AS n, {_LABEL("regexp_extract(array_to_string(w[since:i - 1], ' '), '[A-Za-z][A-Za-z /()%.-]*$')")} AS label, CASE WHEN regexp_matches(said, '\\bcoconut\\s+water\\b') THEN ' coconut water' ELSE '' END AS suffix, w[i] AS a, w[i + 1] AS b FROM lead_),
    al AS (SELECT query_id, p.section_id, kind, head, n, label, vals FROM piped p JOIN ask USING (section_id) WHERE label <> '' AND len(vals) >= 2 UNION ALL SELECT query_id, section_id, kind, head, n, label, [struct_pack("column" := 'mature' || suffix, raw := a), struct_pack("column" := 'tender/young' || suffix, raw := b)] FROM flat WHERE {_LOCAL("label")} NOT IN ('', 'water') AND NOT suffix_(label)),
    rw AS (SELECT *, {_LOCAL("label")} AS form FROM al QUALIFY row_number() OVER (PARTITION BY query_id, {_LOCAL("label")} ORDER BY kind, head, n) = 1)""".replace("NOT suffix_(label)", f"NOT regexp_matches({_LOCAL('label')}, ' coconut water$|table ')")


@query("answer_table_rows", f"WITH {_ROWS} SELECT query_id, label, array_to_string(list_transform(vals, lambda v: v.\"column\" || '=' || v.raw), '|') AS vals FROM rw")
def answer_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of pipe tables and of flattened runs of labels and numbers, each label once."""
    rows = W.table_rows(asked(spark, sf_dir), sections(spark, sf_dir))
    return rows.select("query_id", "label", F.array_join(F.transform("values", lambda v: F.concat(v["column"], F.lit("="), v["raw"])), "|").alias("vals"))


_ORDERED = lambda x: f"list_filter(list_transform(range(1, len({x}) + 1), lambda i: CASE WHEN list_position({x}, {x}[i]) = i THEN {x}[i] END), lambda t: t IS NOT NULL)"
_RUNS = lambda k: f"list_transform(range(1, greatest(len(m) - {k - 2}, 1)), lambda i: array_to_string(m[i:i + {k - 1}], ' '))"
_HELD = lambda x: f"list_filter(string_split_regex({x}, '[^a-z0-9.]+'), lambda t: length(t) >= 3)"
_SPOKEN = f"""sg AS (SELECT *, list_filter(list_concat({_RUNS(3)}, {_RUNS(2)}), lambda p: length(p) >= 7 AND contains(norm, p)) AS phrases FROM (SELECT *, {_ORDERED("m0")} AS m FROM (SELECT *, {D.meaningful_in_order("question")} AS m0, {D.normalize("question")} AS norm, {_LOCAL("question")} AS said, string_split({_tokens(_LOCAL("question"), X.LOCAL_STOPWORDS, shaped=True)}, '|') AS toks FROM ask))),
    sc AS (SELECT query_id, label, vals, said, regexp_matches(said, '\\b(higher|more|greater|larger)\\b') AS higher, CASE WHEN contains(said, form) THEN 6 ELSE 0 END + 4 * len(list_filter(list_distinct(phrases), lambda p: contains(form, p) OR contains(p, form))) + 2 * len(list_intersect(string_split({_tokens(_LOCAL("label"), X.LOCAL_STOPWORDS, shaped=True)}, '|'), toks)) AS score, kind, head, n FROM rw JOIN sg USING (query_id) WHERE regexp_matches(said, '\\b(higher|more|greater|larger|lower|less|smaller)\\b')),
    one AS (SELECT *, list_filter(vals, lambda v: len(list_filter(string_split_regex(v."column", '\\s+|/'), lambda t: length(t) >= 3 AND contains(said, t))) > 0) AS named FROM sc WHERE score >= 2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, kind, head, n) = 1),
    vs AS (SELECT query_id, label, higher, v."column" AS col, v.raw AS raw, CAST(v.raw AS DOUBLE) * CASE WHEN higher THEN -1 ELSE 1 END AS ord, i FROM (SELECT *, unnest(CASE WHEN len(named) >= 2 THEN named ELSE vals END) AS v, unnest(range(10)[1:len(CASE WHEN len(named) >= 2 THEN named ELSE vals END)]) AS i FROM one)),
    st AS (SELECT query_id, any_value(label) AS label, any_value(higher) AS higher, list(col ORDER BY ord, i) AS c, list(raw ORDER BY ord, i) AS r FROM vs GROUP BY query_id)"""
_METRIC = "lower(trim(regexp_replace(regexp_replace(label, '(?i)\\s*(mg\\s*)?%', '', 'g'), '\\s+', ' ', 'g')))"
_UNIT = "CASE WHEN regexp_matches(label, '(?i)mg\\s*%') THEN ' mg%' WHEN contains(label, '%') THEN '%' ELSE '' END"
_BEGIN = "upper(c[1][1]) || c[1][2:]"


@query(
    "table_answers",
    f"""WITH {_ROWS}, {_SPOKEN} SELECT query_id, CASE WHEN CAST(r[1] AS DOUBLE) = CAST(r[2] AS DOUBLE) THEN 'medium' ELSE 'high' END AS confidence, CASE WHEN CAST(r[1] AS DOUBLE) = CAST(r[2] AS DOUBLE) THEN {_BEGIN} || ' and ' || c[2] || ' have the same ' || {_METRIC} || ': ' || r[1] || {_UNIT} || '.'
    ELSE {_BEGIN} || ' has ' || CASE WHEN higher THEN 'higher' ELSE 'lower' END || ' ' || {_METRIC} || ': ' || r[1] || {_UNIT} || ' compared with ' || c[2] || ' ' || r[2] || {_UNIT} || '.' END AS answer FROM st""",
)
def table_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of two kinds has more or less of what a question asks for, as a sentence."""
    own = asked(spark, sf_dir)
    return W.comparison_answers(W.compared_values(own, W.table_rows(own, sections(spark, sf_dir))))


_LINE = "list_filter(list_transform(string_split_regex(broken, '\\n+'), lambda l: trim(l)), lambda l: l <> '')"
_NOT = " OR ".join(f"regexp_matches(line, '{p}')" for p in W.NOISE)
_SPLIT = "'^([^:]{3,100}):\\s*(.*)$'"
_FEW = lambda x: f"(trim({x}) <> '' AND len(string_split_regex(trim({x}), '\\s+')) <= 14 AND length({x}) <= 100)"
_BLOCKS = f"""sec AS {_SECTIONS}, br AS (SELECT section_id, regexp_replace(regexp_replace(text, '{W.INLINE_LABEL}', chr(10) || '\\1:' || chr(10), 'g'), '(^|\\n)\\s+-\\s+', chr(10) || '- ', 'g') AS broken FROM sec),
    li AS (SELECT section_id, n, line, regexp_replace(line, '^[-*]\\s+', '') AS q FROM (SELECT section_id, unnest(range(len({_LINE}))) AS n, unnest({_LINE}) AS line FROM br) WHERE NOT ({_NOT})),
    f1 AS (SELECT *, {_FIELD} AS fn FROM li), f2 AS (SELECT *, fn AS n_, list_distinct(list_filter(string_split_regex(fn, '[^a-z0-9]+'), lambda w: length(w) >= 3 AND w NOT IN ({_STOP}))) AS t FROM f1),
    f3 AS (SELECT *, list_filter({_GROUPS.replace("contains(n,", "contains(n_,")}, lambda x: x IS NOT NULL) AS g FROM f2),
    f4 AS (SELECT *, {_ONE} AS field, regexp_extract(q, '^#{{1,6}}\\s+(.+)$', 1) AS mark, regexp_extract(q, {_SPLIT}, 1) AS lead_, regexp_extract(q, {_SPLIT}, 2) AS rest FROM f3),
    f5 AS (SELECT section_id, n, line, q, CASE WHEN mark <> '' THEN trim(mark) WHEN lead_ <> '' AND {_FEW("lead_")} THEN trim(lead_) WHEN {_FEW("q")} AND field IS NOT NULL THEN trim(q) END AS own, CASE WHEN mark = '' AND lead_ <> '' AND {_FEW("lead_")} THEN trim(rest) ELSE '' END AS inline_ FROM f4),
    f6 AS (SELECT *, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY section_id ORDER BY n), '') AS heading, CASE WHEN own IS NOT NULL THEN 'heading' WHEN regexp_matches(line, '^[-*]\\s+') THEN 'bullet' WHEN contains(line, '|') THEN 'table' ELSE 'paragraph' END AS kind FROM f5),
    f7 AS (SELECT *, CAST(sum(b) OVER (PARTITION BY section_id ORDER BY n) AS INT) AS block FROM (SELECT *, CASE WHEN kind IN ('heading', 'table') OR coalesce(lag(kind) OVER (PARTITION BY section_id ORDER BY n) <> kind, true) THEN 1 ELSE 0 END AS b FROM f6)),
    bl AS (SELECT * FROM (SELECT section_id, block, heading, kind, {D.flat("CASE kind WHEN 'bullet' THEN CASE WHEN heading <> '' THEN heading || ': ' ELSE '' END || string_agg(q, ': ' ORDER BY n) WHEN 'heading' THEN first(inline_ ORDER BY n) ELSE string_agg(line, ' ' ORDER BY n) END")} AS text FROM f7 GROUP BY section_id, block, heading, kind) WHERE length(text) >= 8 AND regexp_matches(text, '\\p{{L}}{{3,}}'))"""


@query("answer_blocks", f"WITH {_BLOCKS} SELECT * FROM bl")
def answer_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of sections under their headings: labels, bullets, table lines and paragraphs."""
    return W.answer_blocks(sections(spark, sf_dir))


@query("focused_answers")
def focused_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.focused_answers(W.best_blocks(asked(spark, sf_dir), W.answer_blocks(sections(spark, sf_dir))))


@query("definition_paragraphs", f"WITH {_BLOCKS} SELECT section_id, CASE WHEN regexp_matches(text, '[.!?]$') THEN text ELSE text || '.' END AS definition FROM bl QUALIFY row_number() OVER (PARTITION BY section_id ORDER BY block) = 1")
def definition_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first block of each section that describes something."""
    return W.definitions(sections(spark, sf_dir))


_HEADS = f"""sec AS {_SECTIONS}, br AS (SELECT section_id, regexp_replace(text, '{W.FIELD_LABEL}', chr(10) || '\\1:' || chr(10), 'g') AS broken FROM sec), li AS (SELECT section_id, unnest(range(len({_LINE}))) AS n, unnest({_LINE}) AS q FROM br),
    f1 AS (SELECT *, {_FIELD} AS n_ FROM li), f2 AS (SELECT *, list_distinct(list_filter(string_split_regex(n_, '[^a-z0-9]+'), lambda w: length(w) >= 3 AND w NOT IN ({_STOP}))) AS t FROM f1),
    f3 AS (SELECT *, list_filter({_GROUPS.replace("contains(n,", "contains(n_,")}, lambda x: x IS NOT NULL) AS g, {" OR ".join(f"regexp_matches(q, '{p}')" for p in W.BOUNDARY)} AS ends, regexp_extract(q, '^#{{1,6}}\\s+(.+)$', 1) AS mark, regexp_extract(q, '^(?:\\d+(?:\\.\\d+)*[.)]?\\s+)([^:]{{3,100}}):?\\s*(.*)$', 1) AS num, regexp_extract(q, '^(?:\\d+(?:\\.\\d+)*[.)]?\\s+)([^:]{{3,100}}):?\\s*(.*)$', 2) AS num2, regexp_extract(q, {_SPLIT}, 1) AS col, regexp_extract(q, {_SPLIT}, 2) AS col2 FROM f2),
    f4 AS (SELECT *, CASE WHEN ends THEN NULL WHEN mark <> '' THEN mark WHEN num <> '' AND {_FEW("num")} THEN num WHEN col <> '' AND {_FEW("col")} THEN col WHEN {_FEW("q")} AND len(string_split_regex(q, '\\s+')) <= 6 AND NOT regexp_matches(q, '[.!?]$') AND len(g) > 0 THEN q END AS head, CASE WHEN mark <> '' THEN '' WHEN num <> '' AND {_FEW("num")} THEN num2 WHEN col <> '' AND {_FEW("col")} THEN col2 ELSE '' END AS inl FROM f3),
    f5 AS (SELECT *, CAST(sum(CASE WHEN ends OR head IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY section_id ORDER BY n) AS INT) AS block, trim(CASE WHEN head IS NOT NULL THEN inl ELSE regexp_replace(q, '^[-*•▪◦]\\s+', '') END) AS said FROM f4)"""


@query("heading_blocks", f"WITH {_HEADS} SELECT section_id, block, {D.flat('first(head ORDER BY n)')} AS heading, coalesce({D.flat('''string_agg(said, ' ' ORDER BY n) FILTER (said <> '')''')}, '') AS body FROM f5 GROUP BY section_id, block HAVING first(head ORDER BY n) IS NOT NULL")
def heading_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands below each heading and label of a section."""
    return W.heading_blocks(sections(spark, sf_dir))
