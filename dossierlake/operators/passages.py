"""Local answers: a section's text cut into blocks, scored against a question, and what they say.

Sections are rows with section_id and text; questions are rows of `asked` with query_id, section_id (the section
they are answered from) and question. Lines, chunks and table rows are exploded and folded by windows inside a section.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dossierlake.functions import forms as X
from dossierlake.functions import text as T
from dossierlake.operators import planning as P
from dossierlake.operators.rows import once, spread

# Patterns of texts that are taken out or split at, and the points of blocks.
GROUPED, SHARED = r"(?is)\bGrouped HS code set:\s*.*?(?=\bShared description:|\n|$)", r"(?i)\bShared description:\s*"
DEBUG = r"(?is)\b(Index source|PageIndex logs?|cache freshness|final score|candidate debug|candidate|cache status|Primary citation|Related citation|Retrieval|PageIndex|raw JSON):.*$"
NOISE = [r"(?i)^\s*(?:source|citation|page|index source|pageindex|cache status|final score)\b", r"(?i)^\s*(?:grouped hs code set|shared description)\b", r"(?i)^\s*\(?Source:[^)]+\)?\s*$", r"^#{1,6}\s*\d{4}\.\d{2}\.\d{2}\b", r"^\s*\d{4}\.\d{2}\.\d{2}\s*[-—–]"]
MORE_LABELS = ["general requirements on appearance", "scientific name", "dimension", "dimensions", "process", "processing", "material", "composition"]
CHUNK_LABELS = "Physical|The content of|Content of|Aroma|Usage|Appearance|Activeness|Weight and size|Condition"
HIGHER, LOWER = r"\b(higher|more|greater|larger|cao\s+hon|nhieu\s+hon)\b", r"\b(lower|less|smaller|thap\s+hon|it\s+hon)\b"
PHRASE, DISTINCT, PLAIN, RANGE, FIELD, UNDER_HEADING, LISTED = 3.5, 1.7, 0.6, 3.0, 5.0, 1.5, 0.8
MOST_CHARS, LEAST_BLOCK, HIGH_BLOCK, LEAST_CHUNK = 420, 3.2, 6.0, 1.4
KEPT_LABELS = r"(?i)\b(?:mature\s+coconut\s+water|tender/young\s+coconut(?:\s+water)?|water)\b"
NUMBER = r"-?\d+(?:\.\d+)?"

_labels = sorted({x for labels in P.FIELD_GROUPS.values() for x in labels} | set(MORE_LABELS), key=lambda x: (-len(x), x))
INLINE_LABEL = r"(?i)\b((?:" + "|".join(x for x in _labels if len(x) >= 4) + r")(?:\s+(?:requirements?|characteristics?|notes?))?)\s*:"


def section_text(c: Column) -> Column:
    x = F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), r"(?s)<!--.*?-->", "")
    x = F.regexp_replace(F.regexp_replace(x, r"!\[[^\]]*\]\([^)]+\)", ""), GROUPED, "\n")
    return F.btrim(F.regexp_replace(F.regexp_replace(x, SHARED, "\n"), r"\n{3,}", "\n\n"), F.lit(" \n\t"))


def _one_space(c: Column) -> Column:
    return F.btrim(F.regexp_replace(c, r"\s+", " "))


def answer_text(c: Column, most: int = MOST_CHARS) -> Column:
    """Text of an answer: debug tails, marks, sources, code lines and bullets taken off, shortened to whole sentences."""
    x = F.regexp_replace(F.regexp_replace(c, "(?i)<doc=[^>]+>", " "), DEBUG, " ")
    x = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"(?m)^#{1,6}\s+", ""), GROUPED, " "), SHARED, " ")
    x = F.regexp_replace(F.regexp_replace(x, "[•▪◦]", " "), r"(?im)^\s*(?:Source|Citation|Page|Image|Picture|Caption):.*$", " ")
    x = F.regexp_replace(F.regexp_replace(x, r"(?im)^\s*\(?Source:[^)]+\)?\s*$", " "), r"(?m)^\s*\d{4}\.\d{2}\.\d{2}\s*[-—–].*$", " ")
    x = _one_space(F.regexp_replace(x, r"(?s)\{.*\}", " "))
    return X.shorten_to_sentences(_one_space(F.regexp_replace(x, r"(?i)(?:^|\s)HS Code:\s*\d{4}\.\d{2}\.\d{2}\.?", " ")), most)


def _compact(c: Column) -> Column:
    return (F.btrim(c) != "") & (F.size(F.split(F.btrim(c), r"\s+")) <= 14) & (F.length(c) <= 100)


def letters(c: Column) -> Column:
    return c.rlike(r"\p{L}{3,}")


def answer_blocks(sections: DataFrame) -> DataFrame:
    """section_id, block, heading, kind and text of the blocks of each section, in order.

    A field label within a line begins a line of its own. Headings carry on to what follows them; neighbouring bullets
    make one block, so do neighbouring plain lines; a line of a table and the text beside a label are blocks each.
    """
    broken = F.regexp_replace(section_text(F.col("text")), INLINE_LABEL, "\n$1:\n")
    broken = F.regexp_replace(F.regexp_replace(broken, "[•▪◦]", "\n- "), r"(?:^|\n)\s+-\s+", "\n- ")
    lines = spread(sections, "section_id").select("section_id", F.posexplode_outer(F.filter(F.transform(F.split(broken, r"\n+"), lambda x: F.btrim(x)), lambda x: x != "")).alias("n", "raw"))
    # the table test looks for blank runs, which the stripping of debug tails collapses, so it sees what is left of them
    lines = once(lines, {"line": _one_space(F.regexp_replace("raw", DEBUG, " "))}).filter("line <> ''")
    noise = F.lit(False)
    for pattern in NOISE:
        noise = noise | F.col("line").rlike(pattern)
    lines = lines.filter(~noise).withColumn("bare", F.regexp_replace("line", r"^[-*]\s+", ""))
    lines = lines.withColumns({"form": X.field_form(F.col("bare")), "words": X.field_tokens(F.col("bare"))})
    lines = lines.withColumn("groups", P.field_groups(F.col("form"), F.col("words"))).withColumn("field", P.requested_field(F.col("groups")))
    mark, before, after = F.regexp_extract("bare", r"^#{1,6}\s+(.+)$", 1), F.regexp_extract("bare", r"^([^:]{3,100}):\s*(.*)$", 1), F.regexp_extract("bare", r"^([^:]{3,100}):\s*(.*)$", 2)
    heading = F.when(mark != "", F.btrim(mark)).when((before != "") & _compact(before), F.btrim(before)).when(_compact(F.col("bare")) & F.col("field").isNotNull(), F.btrim("bare"))
    inline = F.when((mark == "") & (before != "") & _compact(before), F.btrim(after)).otherwise("")
    kind = F.when(heading.isNotNull(), "heading").when(F.col("line").rlike(r"^[-*]\s+"), "bullet").when(F.contains("line", F.lit("|")), "table").otherwise("paragraph")
    lines = lines.select("section_id", "n", "line", "bare", heading.alias("own"), inline.alias("inline"), kind.alias("kind"))
    down = Window.partitionBy("section_id").orderBy("n")
    lines = lines.withColumn("heading", F.coalesce(F.last("own", ignorenulls=True).over(down), F.lit("")))
    alone = F.col("kind").isin("heading", "table")
    begins = alone | F.coalesce(F.lag("kind").over(down) != F.col("kind"), F.lit(True))
    lines = lines.withColumn("begins", begins.cast("int")).withColumn("block", F.sum("begins").over(down))
    whole = lines.groupBy("section_id", "block", "heading", "kind").agg(F.array_sort(F.collect_list(F.struct("n", "line", "bare", "inline"))).alias("l"))
    each = lambda name: F.transform("l", lambda x: x[name])
    bullets = F.array_join(F.concat(F.when(F.col("heading") != "", F.array("heading")).otherwise(F.array().cast("array<string>")), each("bare")), ": ")
    text = F.when(F.col("kind") == "bullet", bullets).when(F.col("kind") == "heading", F.col("l")[0]["inline"]).otherwise(F.array_join(each("line"), " "))
    told = once(whole.select("section_id", F.col("block").cast("int").alias("block"), "heading", "kind", text.alias("said")), {"text": answer_text(F.col("said"))}).drop("said")
    return told.filter((F.length("text") >= 8) & letters(F.col("text")))


# -- questions ---------------------------------------------------------------------------------------------------


def signals(asked: DataFrame) -> DataFrame:
    """The questions with what blocks are scored by: local tokens without those of contrasts, phrases, ranges, the field that is asked for."""
    q = asked.withColumns({"_n": T.normalize_search(F.col("question")), "_f": X.field_form(F.col("question")), "_t": X.field_tokens(F.col("question"))})
    q = q.withColumn("_g", P.field_groups(F.col("_f"), F.col("_t"))).withColumns({"field": P.requested_field(F.col("_g")), "tokens": X.local_tokens(F.col("question"))})
    baseline = X.baseline_tokens(F.col("_n"))
    phrases = F.filter(F.transform(T.useful_phrases(T.meaningful_tokens(F.col("question")), F.col("_n")), X.local_form), lambda p: F.length(p) >= 6)
    ranges = F.transform(T.numeric_ranges(F.col("question")), X.local_form)
    return q.withColumns({"tokens": F.array_except("tokens", F.coalesce(baseline, F.array().cast("array<string>"))), "phrases": phrases, "ranges": ranges}).drop("_n", "_f", "_t", "_g")


def _held(tokens: str, token: Column) -> Column:
    return X.matches_local(F.col(tokens), token)


def _with_field(asked: DataFrame) -> DataFrame:
    """The questions with form, words and groups of the field that is asked for, before sections meet them."""
    laid = asked.withColumns({"_field_form": X.field_form(F.col("field")), "_field_words": X.local_tokens(F.col("field")), "_field_tokens": X.field_tokens(F.col("field"))})
    return laid.withColumn("_field_groups", P.field_groups(F.col("_field_form"), F.col("_field_tokens")))


def field_overlap(form: Column, tokens: Column, groups: Column) -> Column:
    """How well a text (its field form, local tokens and groups) answers the field of _with_field, 0 to 1."""
    words, asked = F.col("_field_words"), F.col("_field_groups")
    share = F.size(F.array_intersect(words, tokens)) / F.greatest(F.lit(1), F.size(words)) * 0.45 + F.when(F.arrays_overlap(asked, groups), 0.55).otherwise(0.0)
    return F.when(form == "", 0.0).when(F.contains(form, F.col("_field_form")), 1.0).otherwise(F.least(F.lit(1.0), share))


def scored_passages(asked: DataFrame, passages: DataFrame) -> DataFrame:
    """The passages (section_id, heading, kind, text and any other columns) of each question's section, with score.

    Phrases, tokens (long ones and numbers more) and ranges that stand there count, and the field that is asked for; long
    tokens that are missing count against it beyond the few that are allowed.
    """
    # neither side is broadcast: questions and passages may both be as many as the sections
    return _scored(_with_field(asked).join(_with_label(passages).hint("merge"), "section_id"))


def _with_label(passages: DataFrame) -> DataFrame:
    """The passages with form and tokens, and those of their label, before questions meet them."""
    laid = passages.withColumn("_form", X.local_form(F.concat_ws(" ", "heading", "text")))
    laid = laid.withColumns({"_tokens": X.local_tokens(F.col("_form")), "_label": F.when(F.col("heading") != "", F.col("heading")).otherwise(F.col("text"))})
    laid = laid.withColumns({"_label_form": X.field_form(F.col("_label")), "_label_tokens": X.local_tokens(F.col("_label")), "_label_words": X.field_tokens(F.col("_label"))})
    return laid.withColumn("_label_groups", P.field_groups(F.col("_label_form"), F.col("_label_words")))


def _scored(d: DataFrame) -> DataFrame:
    """Rows of _with_field and _with_label, with score instead of what these have laid down."""
    distinct = lambda t: (F.length(t) >= 5) | t.rlike(r"\d")
    total = lambda items, points: F.aggregate(items, F.lit(0.0), lambda a, x: a + points(x))
    d = d.withColumn("_overlap", F.when(F.col("field").isNotNull(), field_overlap(F.col("_label_form"), F.col("_label_tokens"), F.col("_label_groups"))))
    words = total("phrases", lambda p: F.when(F.contains(F.col("_form"), p), PHRASE).otherwise(0.0)) + total("tokens", lambda t: F.when(_held("_tokens", t), F.when(distinct(t), DISTINCT).otherwise(PLAIN)).otherwise(0.0)) + total("ranges", lambda r: F.when(F.contains(F.col("_form"), r), RANGE).otherwise(0.0))
    headed = F.col("heading") != ""
    asks = F.col("field").isNotNull()
    field = F.when(asks, F.col("_overlap") * FIELD + F.when(headed & (F.col("_overlap") > 0), UNDER_HEADING).when(headed, -UNDER_HEADING).otherwise(0.0)).otherwise(0.0)
    missing = F.size(F.filter("tokens", lambda t: distinct(t) & ~_held("_tokens", t)))
    lost = F.greatest(F.lit(0), missing - F.when(asks, 2).otherwise(3)) * F.when(asks, 0.4).otherwise(1.2)
    listed = F.when(F.col("kind").isin("bullet", "heading"), LISTED).otherwise(0.0)
    kept = [c for c in d.columns if not c.startswith("_")]
    return d.select(*kept, F.round(words + field - lost + listed, 6).alias("score"))


def best_blocks(asked: DataFrame, blocks: DataFrame) -> DataFrame:
    """The best block of each question's section, the earlier one on ties."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "block")
    return scored_passages(asked, blocks).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def evidence_chunks(c: Column) -> Column:
    """The sentences and labelled parts of a text that say something."""
    x = F.regexp_replace(F.regexp_replace(c, "[•▪◦]", "\n"), rf"(?i)\s+(?=(?:{CHUNK_LABELS})\s*:)", "\n")
    parts = F.split(F.btrim(F.regexp_replace(x, r"[ \t]+", " ")), r"(?<=[.!?])\s+|\n+")
    return F.filter(F.transform(parts, lambda p: answer_text(p, 260)), lambda p: (F.length(p) >= 12) & letters(p))


def focused_answers(best: DataFrame, most: int = MOST_CHARS) -> DataFrame:
    """query_id, score, confidence and answer: the two best chunks of the best block, in their order; the whole block where a field is
    asked for or nothing in it stands out. Blocks below LEAST_BLOCK give no answer."""
    good = best.filter(F.col("score") >= LEAST_BLOCK)
    whole = F.when((F.col("kind") == "heading") & (F.col("heading") != ""), F.concat("heading", F.lit(": "), "text")).otherwise(F.col("text"))
    # the block and what it was chosen by go along with its chunks, so that it is worked out once
    good = once(good.withColumn("block_score", F.col("score")), {"whole": whole})
    good = once(good, {"chunks": F.when(F.col("field").isNull() & F.col("query_id").isNotNull(), evidence_chunks(F.col("whole")))})
    chunks = F.when(F.size("chunks") > 1, F.col("chunks"))
    pieces = good.select("query_id", "block_score", "whole", "field", "tokens", "phrases", "ranges", "heading", F.lit("paragraph").alias("kind"), F.posexplode_outer(chunks).alias("place", "text"))
    scored = _scored(_with_label(_with_field(pieces)))
    stands = F.col("place").isNotNull() & (F.col("score") >= LEAST_CHUNK)
    found = F.collect_list(F.when(stands, F.struct((-F.col("score")).alias("less"), "place", "text")))
    out = scored.groupBy("query_id", "block_score", "whole").agg(F.slice(F.array_sort(found), 1, 2).alias("two"))
    told = F.array_join(F.transform(F.array_sort(F.transform("two", lambda x: F.struct(x["place"], x["text"]))), lambda x: x["text"]), " ")
    out = once(out, {"told": F.when(F.size("two") > 0, told).otherwise(F.col("whole"))})
    return out.select("query_id", F.col("block_score").alias("score"), F.when(F.col("block_score") >= HIGH_BLOCK, "high").otherwise("medium").alias("confidence"), answer_text(F.col("told"), most).alias("answer"))


def definitions(sections: DataFrame, most: int = MOST_CHARS) -> DataFrame:
    """section_id and the first block of each section that describes something, as a sentence."""
    x = F.regexp_replace(answer_text(F.col("text"), most), r"(?i)^Definition:\s*", "")
    told = once(answer_blocks(sections), {"told": X.shorten_to_sentences(F.btrim(x), most)}).filter((F.col("told") != "") & letters(F.col("told")))
    return told.groupBy("section_id").agg(F.min_by("told", "block").alias("told")).select("section_id", X.sentence_end(F.col("told")).alias("definition"))


# -- tables ------------------------------------------------------------------------------------------------------


def _row_label(c: Column) -> Column:
    return _one_space(F.regexp_replace(c, KEPT_LABELS, " "))


def piped_rows(sections: DataFrame) -> DataFrame:
    """section_id, place, label and values (column, raw) of the rows of pipe tables that hold two numbers or more."""
    lines = sections.select("section_id", F.posexplode(F.filter(F.transform(F.split("text", r"\n+"), lambda x: F.btrim(x)), lambda x: F.contains(x, F.lit("|")))).alias("n", "line"))
    cells = F.transform(F.split(F.regexp_replace(F.regexp_replace("line", r"^\s*\|", ""), r"\|\s*$", ""), r"\|"), lambda x: F.btrim(x))
    down = Window.partitionBy("section_id").orderBy("n")
    rows = lines.withColumn("cells", cells).withColumn("next", F.lead("cells").over(down))
    head = (F.size("cells") >= 3) & F.exists(F.coalesce("next", F.array().cast("array<string>")), lambda c: c.rlike(r"^:?-{2,}:?$"))
    rows = rows.withColumn("head", F.when(head, F.struct(F.col("n").alias("at"), "cells"))).withColumn("short", (F.size("cells") < 3).cast("int"))
    # a table ends at its first short line; every header above that line has it as a row
    rows = rows.withColumn("ended", F.sum("short").over(down))
    heads = rows.filter("head IS NOT NULL").select("section_id", F.col("n").alias("at"), F.col("cells").alias("columns"), F.col("ended").alias("ended_"))
    below = rows.filter("short = 0").join(heads.hint("merge"), "section_id").filter((F.col("n") >= F.col("at") + 2) & (F.col("ended") == F.col("ended_")))
    named = F.filter(F.transform(F.slice("columns", 2, 1000), lambda c: F.lower(_one_space(c))), lambda c: c != "")
    values = F.filter(F.transform(F.slice("cells", 2, 1000), lambda c, i: F.struct(F.get(named, i).alias("column"), F.regexp_extract(c, NUMBER, 0).alias("raw"))), lambda v: (v["raw"] != "") & v["column"].isNotNull())
    found = below.select("section_id", F.struct(F.lit(0).alias("kind"), F.col("at").alias("at"), F.col("n").alias("n")).alias("place"), _row_label(F.col("cells")[0]).alias("label"), values.alias("values"))
    return found.filter((F.col("label") != "") & (F.size("values") >= 2))


def flattened_rows(asked: DataFrame, sections: DataFrame) -> DataFrame:
    """query_id, section_id, place, label and values of runs `label number number` in a text whose table has lost its lines.

    The two columns are the kinds that question and text speak of: mature, and tender or young.
    """
    d = asked.select("query_id", "section_id", "question").join(sections.hint("merge"), "section_id")
    said = X.local_form(F.concat_ws(" ", "question", "text"))
    d = d.withColumn("said", said).filter(F.col("said").rlike(r"\bmature\b") & F.col("said").rlike(r"\btender\s*/\s*young\b|\btender\b|\byoung\b"))
    suffix = F.when(F.col("said").rlike(r"\bcoconut\s+water\b"), " coconut water").otherwise("")
    flat = _one_space(F.regexp_replace(section_text(F.col("text")), r"\|+", " "))
    found = F.regexp_extract_all(flat, F.lit(rf"([A-Za-z][A-Za-z /()%.-]{{0,90}}?)\s+({NUMBER})\s+({NUMBER})(?=\s+[A-Za-z]|$)"), F.lit(0))
    rows = d.select("query_id", "section_id", suffix.alias("suffix"), F.posexplode(found).alias("n", "run"))
    number = lambda k: F.regexp_extract("run", rf"({NUMBER})\s+({NUMBER})$", k)
    label = _row_label(F.regexp_replace("run", rf"\s+{NUMBER}\s+{NUMBER}$", ""))
    named = lambda name, k: F.struct(F.concat(F.lit(name), "suffix").alias("column"), number(k).alias("raw"))
    rows = rows.select("query_id", "section_id", F.struct(F.lit(1).alias("kind"), F.lit(0).alias("at"), F.col("n").alias("n")).alias("place"), label.alias("label"), F.array(named("mature", 1), named("tender/young", 2)).alias("values"))
    form = X.local_form(F.col("label"))
    return rows.filter((form != "") & (form != "water") & ~form.endswith(" coconut water") & ~F.contains(form, F.lit("table ")))


def table_rows(asked: DataFrame, sections: DataFrame) -> DataFrame:
    """Rows of both kinds for each question, the first of each label."""
    sections = spread(sections, "section_id")
    piped = asked.select("query_id", "section_id").join(piped_rows(sections).hint("merge"), "section_id").select("query_id", "section_id", "place", "label", "values")
    both = piped.unionByName(flattened_rows(asked, sections)).withColumn("form", X.local_form(F.col("label")))
    w = Window.partitionBy("query_id", "form").orderBy("place")
    return both.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def compared_values(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """query_id, label, higher, and the chosen value beside the one it is held against, for questions that ask which is higher or lower.

    The row is the one whose label the question speaks of most (the earlier on ties); columns that the question names come
    alone, if it names two or more.
    """
    q = asked.withColumn("said", X.local_form(F.col("question")))
    q = q.withColumn("higher", F.when(F.col("said").rlike(HIGHER), True).when(F.col("said").rlike(LOWER), False)).filter("higher IS NOT NULL")
    d = q.select("query_id", "said", "higher", "tokens", "phrases").join(rows, "query_id")
    phrases = F.filter("phrases", lambda p: F.length(p) >= 4)
    met = F.size(F.filter(phrases, lambda p: F.contains(F.col("form"), p) | F.contains(p, F.col("form"))))
    score = F.when(F.contains("said", F.col("form")), 6).otherwise(0) + 4 * met + 2 * F.size(F.array_intersect(X.local_tokens(F.col("label")), "tokens"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "place")
    best = d.withColumn("score", score).filter("score >= 2").withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    spoken = F.filter("values", lambda v: F.exists(F.split(X.local_form(v["column"]), r"\s+|/"), lambda t: (F.length(t) >= 3) & F.contains(F.col("said"), t)))
    values = F.when(F.size(spoken) >= 2, spoken).otherwise(F.col("values"))
    sign = F.when(F.col("higher"), -1.0).otherwise(1.0)
    order = F.array_sort(F.transform(values, lambda v, i: F.struct((v["raw"].cast("double") * sign).alias("by"), i.alias("i"), v["column"].alias("column"), v["raw"].alias("raw"))))
    best = best.withColumn("order", order)
    first = F.col("order")[0]
    other = F.coalesce(F.get(F.filter("order", lambda v: v["column"] != first["column"]), F.lit(0)), F.get("order", F.lit(1)))
    return best.select("query_id", "label", "higher", "score", first["column"].alias("chosen"), first["raw"].alias("value"), other["column"].alias("against"), other["raw"].alias("other")).filter("other IS NOT NULL")


def comparison_answers(compared: DataFrame) -> DataFrame:
    """query_id, confidence and answer of compared values."""
    metric = F.lower(_one_space(F.regexp_replace("label", r"(?i)\s*(?:mg\s*)?%", "")))
    unit = F.when(F.col("label").rlike(r"(?i)mg\s*%"), " mg%").when(F.contains("label", F.lit("%")), "%").otherwise("")
    shown = lambda c: F.concat(F.btrim(c), unit)
    equal = F.abs(F.col("value").cast("double") - F.col("other").cast("double")) < 0.000001
    begin = F.concat(F.upper(F.left("chosen", F.lit(1))), F.substr("chosen", F.lit(2)))
    same = F.concat(begin, F.lit(" and "), "against", F.lit(" have the same "), metric, F.lit(": "), shown("value"), F.lit("."))
    more = F.concat(begin, F.lit(" has "), F.when(F.col("higher"), "higher").otherwise("lower"), F.lit(" "), metric, F.lit(": "), shown("value"), F.lit(" compared with "), "against", F.lit(" "), shown("other"), F.lit("."))
    return compared.select("query_id", F.when(equal, "medium").otherwise("high").alias("confidence"), F.when(equal, same).otherwise(more).alias("answer"))


# -- fields ------------------------------------------------------------------------------------------------------

# Lines at which a field's text ends, least scores of headings and paragraphs, and of what counts as sure.
BOUNDARY = [r"(?i)^(source|citation|page|section|chapter|hs\s*code)\b", r"(?i)^#{1,6}\s*chapter\b", r"^#{1,6}\s*\d{4}\.\d{2}\.\d{2}\b"]
LEAST_HEADING, SURE_HEADING, LEAST_PARAGRAPH, SURE_PARAGRAPH = 0.58, 0.82, 0.4, 0.72
_field_labels = sorted({x for labels in P.FIELD_GROUPS.values() for x in labels} | {"general requirements on appearance", "appearance requirements"}, key=lambda x: (-len(x), x))
FIELD_LABEL = r"(?i)\b((?:general\s+)?(?:" + "|".join(x for x in _field_labels if len(x) >= 5) + r")(?:\s+(?:requirements?|characteristics?|notes?))?)\s*:"


def heading_blocks(sections: DataFrame) -> DataFrame:
    """section_id, block, heading and body: what stands below each heading or label of a section, up to the next or to a line that ends it."""
    broken = F.regexp_replace(section_text(F.col("text")), FIELD_LABEL, "\n$1:\n")
    lines = spread(sections, "section_id").select("section_id", F.posexplode_outer(F.filter(F.transform(F.split(broken, r"\n+"), lambda x: F.btrim(x)), lambda x: x != "")).alias("n", "line")).filter("line IS NOT NULL")
    ends = F.lit(False)
    for pattern in BOUNDARY:
        ends = ends | F.col("line").rlike(pattern)
    part = lambda pattern, k: F.regexp_extract("line", pattern, k)
    mark, listed, colon = r"^#{1,6}\s+(.+)$", r"^(?:\d+(?:\.\d+)*[.)]?\s+)([^:]{3,100}):?\s*(.*)$", r"^([^:]{3,100}):\s*(.*)$"
    lines = lines.withColumns({"form": X.field_form(F.col("line")), "words": X.field_tokens(F.col("line"))})
    lines = lines.withColumns({"ends": ends, "groups": P.field_groups(F.col("form"), F.col("words"))})
    label = _compact(F.col("line")) & (F.size(F.split("line", r"\s+")) <= 6) & ~F.col("line").rlike(r"[.!?]$") & (F.size("groups") > 0)
    kinds = [(part(mark, 1) != "", part(mark, 1), F.lit("")), ((part(listed, 1) != "") & _compact(part(listed, 1)), part(listed, 1), part(listed, 2)), ((part(colon, 1) != "") & _compact(part(colon, 1)), part(colon, 1), part(colon, 2)), (label, F.col("line"), F.lit(""))]
    heading, inline = (F.coalesce(*[F.when(c, _one_space(x[k])) for c, *x in kinds]) for k in (0, 1))
    lines = lines.withColumns({"heading": F.when(~F.col("ends"), heading), "inline": inline})
    starts = (F.col("ends") | F.col("heading").isNotNull()).cast("int")
    lines = lines.withColumn("block", F.sum(starts).over(Window.partitionBy("section_id").orderBy("n")))
    said = F.when(F.col("heading").isNotNull(), F.col("inline")).otherwise(_one_space(F.regexp_replace("line", r"^[-*•▪◦]\s+", "")))
    whole = lines.withColumn("said", said).groupBy("section_id", "block").agg(F.min_by("heading", "n").alias("heading"), F.array_sort(F.collect_list(F.struct("n", "said"))).alias("l"))
    body = F.array_join(F.filter(F.transform("l", lambda x: x["said"]), lambda x: x != ""), " ")
    return whole.filter("heading IS NOT NULL").select("section_id", F.col("block").cast("int").alias("block"), "heading", body.alias("body"))


def _matched(asked: DataFrame, given: DataFrame, text: str, order: str) -> DataFrame:
    """The text of each question's section that answers its field best, with match; the earlier one on ties."""
    laid = given.withColumns({"g_form": X.field_form(F.col(text)), "g_tokens": X.field_tokens(F.col(text))}).withColumn("g_groups", P.field_groups(F.col("g_form"), F.col("g_tokens")))
    q = asked.filter("field IS NOT NULL").select("query_id", "section_id", X.field_form(F.col("field")).alias("a_form"), X.field_tokens(F.col("field")).alias("a_tokens"))
    both = q.withColumn("a_groups", P.field_groups(F.col("a_form"), F.col("a_tokens"))).join(laid, "section_id").withColumn("match", F.round(P.field_match("a", "g"), 6))
    w = Window.partitionBy("query_id").orderBy(F.col("match").desc(), order)
    return both.withColumn("_n", F.row_number().over(w)).filter("_n = 1")


def extracted_fields(asked: DataFrame, sections: DataFrame) -> DataFrame:
    """query_id, extracted, matched_heading, confidence and fallback for questions that ask for a field of their section.

    The best heading gives what stands below it; where none fits, the best paragraph does, with less confidence; else nothing.
    """
    heads = _matched(asked, heading_blocks(sections), "heading", "block").select("query_id", "heading", F.when(F.col("body") != "", F.col("body")).otherwise(F.col("heading")).alias("below"), F.col("match").alias("head_match"))
    cut = F.filter(F.transform(F.split(section_text(F.col("text")), r"\n{2,}|(?<=[.!?])\s+(?=[A-Z])"), lambda p: _one_space(p)), lambda p: F.length(p) >= 12)
    parts = sections.select("section_id", F.posexplode(F.when(F.size(cut) > 0, cut).otherwise(F.array(section_text(F.col("text"))))).alias("place", "paragraph"))
    best = _matched(asked, parts, "paragraph", "place").select("query_id", "paragraph", F.col("match").alias("part_match"))
    d = asked.filter("field IS NOT NULL").select("query_id").join(heads, "query_id", "left").join(best, "query_id", "left")
    headed, told = F.coalesce(F.col("head_match") >= LEAST_HEADING, F.lit(False)), F.coalesce(F.col("part_match") >= LEAST_PARAGRAPH, F.lit(False))
    sure = F.when(headed, F.when(F.col("head_match") >= SURE_HEADING, "high").otherwise("medium")).when(told & (F.col("part_match") >= SURE_PARAGRAPH), "medium").otherwise("low")
    return d.select("query_id", F.when(headed, F.col("below")).when(told, _one_space(F.col("paragraph"))).otherwise("").alias("extracted"), F.when(headed | ~told, F.col("heading")).alias("matched_heading"), sure.alias("confidence"), (~headed).alias("fallback"))

