"""Batch retrieval: question signals, an inverted index, and the transparent field-weighted score.

Questions are rows. A question meets the sections that share a token with it through the index, so the
work follows the postings, not questions times sections; phrases and numbers are then looked at on those
candidates alone, and where only the best are wanted, on those that can still be among them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dossierlake.functions import text as T

FIELDS = ("title", "heading", "body", "captions", "source")
# Integer weights per field of tokens, phrases and contrast tokens.
TOKEN_WEIGHT = {"title": 7, "heading": 6, "body": 3, "captions": 4, "source": 1}
PHRASE_WEIGHT = {"title": 14, "heading": 11, "body": 8, "captions": 6}
CONTRAST_WEIGHT = {"title": 6, "heading": 4, "body": 1}
CODE_WEIGHT, NUMERIC_WEIGHT = 40, 11


def _known(normalized: Column, words: Column, terms: list[str]) -> Column:
    return F.filter(F.array(*map(F.lit, terms)), lambda t: T.includes_term(normalized, words, t))


def _phrase_pattern(phrase: Column) -> Column:
    return F.concat(F.lit("(?:^|[^a-z0-9])"), phrase, F.lit("(?=$|[^a-z0-9])"))


def _contrast(normalized: Column) -> Column:
    """Contrast phrases of a text; one inside a longer one that also stands is left out."""
    found = F.filter(F.array(*map(F.lit, T.CONTRAST_PHRASES)), lambda p: F.regexp_like(normalized, _phrase_pattern(p)))
    return F.filter(found, lambda p: ~F.exists(found, lambda q: (q != p) & F.contains(q, p)))


def signals(queries: DataFrame) -> DataFrame:
    """query_id, question and its arrays: tokens, phrases, numeric, codes, contrast (terms) and baseline (tokens set off against)."""
    n = F.col("n")
    q = queries.select("query_id", "question", T.normalize_search(F.col("question")).alias("n"))
    q = q.withColumn("contrast", _contrast(n))
    after = lambda p: F.get(F.split(n, _phrase_pattern(p), 2), F.lit(1))
    baseline = F.flatten(F.transform("contrast", lambda p: F.slice(F.filter(T.raw_tokens(after(p)), lambda t: F.length(t) >= 3), 1, 4)))
    q = q.withColumn("baseline", F.array_distinct(baseline))
    q = q.withColumn("words", T.raw_tokens(n))
    known = F.concat(*[_known(n, F.col("words"), terms) for terms in (T.PHYSICAL_TERMS, T.USAGE_TERMS, T.TRADE_TERMS)])
    q = q.withColumn("known", known)
    more = F.flatten(F.transform("known", lambda t: F.filter(F.transform(F.split(t, " "), T.token_form), lambda x: F.length(x) >= 3)))
    q = q.withColumn("tokens", F.array_except(F.array_distinct(F.concat(T.meaningful_tokens(F.col("question")), more)), F.col("baseline")))
    phrases = F.concat(T.useful_phrases(F.col("tokens"), n), F.filter("known", lambda t: F.contains(t, F.lit(" "))))
    clear = F.filter(F.array_distinct(phrases), lambda p: ~F.exists("baseline", lambda b: T.includes_signal(p, b)))
    return q.select("query_id", "question", "tokens", clear.alias("phrases"), T.numeric_ranges(F.col("question")).alias("numeric"), T.codes(F.col("question")).alias("codes"), "contrast", "baseline")


def search_fields(sections: DataFrame) -> DataFrame:
    """Sections with the normalised text of every field; a code and a title count in the title and in the heading."""
    text = lambda *cs: T.normalize_search(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in cs]))
    return sections.withColumns({
        "f_title": text("hs_code", "title", "hs_code"),
        "f_heading": text("section", "title"),
        "f_body": text("text"),
        "f_captions": F.lit(""),
        "f_source": text("source", "chapter", "document"),
    })


def inverted_index(fields: DataFrame, key: str = "section_id") -> DataFrame:
    """key, field, token and tf: how often a token stands in a field."""
    tokens = F.array(*[F.struct(F.lit(f).alias("field"), T.raw_tokens(F.col(f"f_{f}")).alias("tokens")) for f in FIELDS])
    each = fields.select(key, F.explode(tokens).alias("x")).select(key, "x.field", F.explode("x.tokens").alias("token"))
    return each.groupBy(key, "field", "token").agg(F.count(F.lit(1)).alias("tf"))


def _weight(weights: dict[str, int]) -> Column:
    out = F.lit(0)
    for field, w in weights.items():
        out = F.when(F.col("field") == field, w).otherwise(out)
    return out


PARTS = ("hs_code", "title", "heading", "body", "captions", "source", "numeric", "contrast_penalty")


def token_scores(queries: DataFrame, fields: DataFrame) -> DataFrame:
    """query_id, section_id and the parts of the score that the index alone decides (t_*, p_hs_code, p_contrast_penalty), for sections that share a token with the question.

    Sections are dealt by their id first, so their tokens meet the questions' where they stand: neither postings nor pairs are shuffled.
    What is broadcast is named: by Spark's estimates, made from the size of the files, the sections' texts look smaller than the questions.
    """
    # explode_outer: explode makes a filter on the signals, which is pushed below the questions' distinct and told for every row they are drawn from
    tokens = lambda name, against: queries.select("query_id", F.explode_outer(name).alias("token"), F.lit(against).alias("against"))
    asked = tokens("tokens", False).unionByName(tokens("baseline", True))
    each = F.array(*[F.struct(F.lit(f).alias("field"), T.raw_tokens(F.col(f"f_{f}")).alias("tokens")) for f in FIELDS])
    found = by_section(fields).select("section_id", F.explode(each).alias("x")).select("section_id", "x.field", F.explode("x.tokens").alias("token"))
    hits = found.join(F.broadcast(asked), "token")
    summed = lambda keep, weight: F.sum(F.when(keep, weight).otherwise(0))
    positive = ~F.col("against")
    return hits.groupBy("query_id", "section_id").agg(
        *[summed(positive & (F.col("field") == f), F.lit(w)).alias(f"t_{f}") for f, w in TOKEN_WEIGHT.items()],
        summed(positive & (F.col("field") == "title") & F.col("token").rlike(T.CODE), F.lit(CODE_WEIGHT)).alias("p_hs_code"),
        (-summed(F.col("against"), _weight(CONTRAST_WEIGHT))).alias("p_contrast_penalty"),
    )


def by_section(fields: DataFrame) -> DataFrame:
    """The search texts dealt by section; both sides of the score take the same rows."""
    return fields.select("section_id", *[f"f_{f}" for f in FIELDS]).repartition("section_id")


def _long(phrases: str) -> Column:
    return F.filter(phrases, lambda p: F.contains(p, F.lit(" ")))


def contenders(found: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The scored pairs that can still be among the k best of their query.

    Phrases and numbers only add, and no more than all of them in every field; so a pair that stays below
    the k-th best token score even with all of them cannot come in.
    """
    sure = sum((F.col(f"t_{f}") for f in FIELDS), F.col("p_hs_code") + F.col("p_contrast_penalty"))
    room = queries.select("query_id", (F.size(_long("phrases")) * sum(PHRASE_WEIGHT.values()) + F.size("numeric") * NUMERIC_WEIGHT).alias("_room"))
    w = Window.partitionBy("query_id").orderBy(F.col("_sure").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = found.withColumn("_sure", sure).withColumn("_n", F.row_number().over(w))
    least = ranked.filter(F.col("_n") <= k).groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("_sure")).alias("_least"))
    kept = found.withColumn("_sure", sure).join(F.broadcast(room), "query_id").join(F.broadcast(least), "query_id", "left").filter(F.col("_least").isNull() | (F.col("_sure") + F.col("_room") >= F.col("_least")))
    return kept.drop("_sure", "_room", "_least")


def field_scores(queries: DataFrame, fields: DataFrame, k: int | None = None) -> DataFrame:
    """query_id, section_id, the parts of the score (p_*) and their sum, for sections that share a token with the question; with k, of those alone that can be among a query's k best."""
    found = token_scores(queries, fields)
    if k is not None:
        found = contenders(found, queries, k)
    texts = by_section(fields).select("section_id", *[f"f_{f}" for f in FIELDS], F.concat_ws(" ", "f_title", "f_heading", "f_body", "f_captions").alias("_all"))
    texts = texts.withColumn("_words", T.raw_tokens(F.col("_all")))
    asked = queries.select("query_id", _long("phrases").alias("_long"), "numeric")
    both = found.join(F.broadcast(asked), "query_id").join(texts.hint("merge"), "section_id")
    hit = lambda text: F.size(F.filter("_long", lambda x: F.contains(text, x)))
    parts = {f"p_{f}": F.col(f"t_{f}") + (hit(F.col(f"f_{f}")) * PHRASE_WEIGHT[f] if f in PHRASE_WEIGHT else 0) for f in FIELDS}
    parts["p_numeric"] = F.size(F.filter("numeric", lambda x: T.includes_term(F.col("_all"), F.col("_words"), x))) * NUMERIC_WEIGHT
    scored = both.withColumns(parts).select("query_id", "section_id", *[F.col(f"p_{x}").cast("long").alias(f"p_{x}") for x in PARTS])
    return scored.withColumn("score", sum((F.col(f"p_{x}") for x in PARTS), F.lit(0)).cast("long"))


def top_k(scored: DataFrame, k: int, *order: Column, by: str = "query_id") -> DataFrame:
    """The k best rows of every query under a total order, with their rank."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= k)
