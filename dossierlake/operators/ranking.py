"""Candidate relevance, validation against explicit evidence, and the ranking that follows from both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dossierlake.functions import text as T

LOW, MEDIUM, HIGH = "low", "medium", "high"


def _hits(array: str | Column, name: str) -> Column:
    """The terms that stand in a text of section_features."""
    return F.filter(array, lambda x: T.includes_term(F.col(f"{name}_text"), F.col(f"{name}_words"), x))


def _weak(token: Column) -> Column:
    return token.rlike(r"^\d+$") | token.isin(*T.WEAK_TOKENS)


def _distinctive(token: Column) -> Column:
    return ~token.isin(*T.STOPWORDS) & ~_weak(token) & ((F.length(token) >= 4) | token.rlike(r"\d"))


def section_features(sections: DataFrame) -> DataFrame:
    """Sections with the normalised texts, words and tokens that relevance looks at: once a section, before any question meets it."""
    text = lambda *cs: T.normalize_search(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in cs]))
    d = sections.withColumns({
        "title_text": text("title", "section"), "body_text": T.normalize_search(F.col("text")), "source_text": text("source", "chapter", "document"),
        "title_tokens": T.meaningful_tokens(F.concat_ws(" ", "title", "section")), "body_tokens": T.meaningful_tokens(F.col("text")), "source_tokens": T.meaningful_tokens(F.concat_ws(" ", "source", "chapter", "document")),
    })
    d = d.withColumns({"all_text": F.concat_ws(" ", "title_text", "body_text", "source_text"), "own_text": F.concat_ws(" ", "title_text", "body_text")})
    d = d.withColumns({f"{x}_words": T.raw_tokens(F.col(f"{x}_text")) for x in ("title", "body", "source", "all", "own")})
    return d.withColumn("own_numbers", T.numbers(F.col("own_text")))


def relevance(candidates: DataFrame) -> DataFrame:
    """Evidence, score and first reason of rejection of candidate rows.

    Rows carry the question's signals, the section's fields (with section_features or without) and the
    retrieval score. A token counts once, in the best field that has it.
    """
    d = candidates if "own_numbers" in candidates.columns else section_features(candidates)
    d = d.withColumn("in_title", F.array_intersect("tokens", "title_tokens"))
    d = d.withColumn("in_body", F.array_intersect(F.array_except("tokens", "title_tokens"), "body_tokens"))
    rest = F.array_except(F.array_except("tokens", "title_tokens"), "body_tokens")
    d = d.withColumns({
        "in_source": _hits(rest, "source"),
        "phrase_hits": _hits("phrases", "all"),
        "rare": F.filter(F.array_intersect("tokens", F.array_union(F.array_union("title_tokens", "body_tokens"), "source_tokens")), lambda t: (F.length(t) >= 6) | t.rlike(r"\d")),
        "numeric_hits": F.filter("numeric", lambda r: T.includes_term(F.col("own_text"), F.col("own_words"), r) | F.exists(T.numbers(r), lambda a: F.exists("own_numbers", lambda b: F.abs(a - b) < 0.0001))),
        "contrast_hits": _hits(F.array_distinct(F.concat("contrast", "baseline")), "all"),
        "code_hits": F.filter(F.array("hs_code"), lambda c: F.contains(F.lower(F.col("question")), c)),
    })
    d = d.withColumns({"title_phrases": _hits("phrase_hits", "title"), "body_phrases": _hits("phrase_hits", "body"), "strong_phrases": F.filter("phrase_hits", lambda p: F.exists(T.meaningful_tokens(p), lambda t: ~_weak(t)))})
    n = {x: F.size(x) for x in ("in_title", "in_body", "in_source", "phrase_hits", "rare", "numeric_hits", "contrast_hits", "code_hits", "title_phrases", "body_phrases", "strong_phrases")}
    evidence = n["code_hits"] + n["in_title"] + n["in_body"] + n["in_source"] + n["phrase_hits"] + n["numeric_hits"]
    strong = n["code_hits"] + n["title_phrases"] + n["numeric_hits"] + n["strong_phrases"] + n["rare"]
    overlap = n["in_title"] + n["in_body"] + n["phrase_hits"] + n["numeric_hits"]
    meaningful = F.size(F.filter(F.array_distinct(F.concat("in_title", "in_body", "in_source", "rare")), lambda t: ~_weak(t)))
    only_contrast = (evidence == 0) & (n["contrast_hits"] > 0)
    only_weak = (n["code_hits"] + n["strong_phrases"] + n["numeric_hits"] + meaningful == 0) & (n["in_title"] + n["in_body"] + n["in_source"] + n["phrase_hits"] > 0)
    added = 24 * n["code_hits"] + 14 * n["title_phrases"] + 8 * n["in_title"] + 8 * n["body_phrases"] + 3 * n["in_body"] + n["in_source"] + 10 * n["numeric_hits"] + 5 * n["rare"]
    taken = F.when(only_contrast, 20).otherwise(0) + F.when((n["contrast_hits"] > 0) & (evidence <= n["contrast_hits"]), 3 * n["contrast_hits"]).otherwise(0) + F.when(overlap == 0, 10).otherwise(0)
    final = (F.col("score") + added - taken).cast("long")
    least = F.when(strong > 0, 5).otherwise(8)
    reason = (
        F.when(only_contrast, "only contrast terms match")
        .when(only_weak, "only weak generic tokens match")
        .when(final < least, F.concat(F.lit("score below "), least.cast("string")))
        .when(overlap == 0, "low token, phrase and numeric overlap")
    )
    return d.withColumns({"relevance": final, "only_contrast": only_contrast, "reject_reason": reason, "matched": F.array_distinct(F.concat("code_hits", "in_title", "in_body", "in_source", "rare"))})


def validate(rated: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Strong and weak signals, acceptance, confidence and reason of rated candidates.

    Inside a query, the margin of a viable candidate is its distance to the next best one.
    """
    viable = F.col("reject_reason").isNull() & (F.size("matched") + F.size("phrase_hits") + F.size("numeric_hits") > 0)
    w = Window.partitionBy("query_id", viable).orderBy(F.col("relevance").desc(), "section_id")
    d = rated.withColumns({
        "n_viable": F.sum(viable.cast("int")).over(Window.partitionBy("query_id")),
        "margin": F.when(viable, F.col("relevance") - F.coalesce(F.lead("relevance").over(w), F.lit(0))).otherwise(0),
        "distinctive": F.filter("matched", _distinctive),
    })
    many = lambda p: F.size(F.filter(T.meaningful_tokens(p), _distinctive)) >= 2
    product = F.exists("phrase_hits", lambda p: F.size(T.meaningful_tokens(p)) >= 2) | (F.size("distinctive") >= 1)
    supported = F.exists(F.concat("matched", "phrase_hits", "numeric_hits"), lambda t: T.includes_term(F.col("own_text"), F.col("own_words"), t))
    own_title = F.filter("title_tokens", lambda t: _distinctive(t) & ~t.rlike(r"^\d+(?:\.\d+)*$"))
    shared = F.size(F.array_intersect(own_title, F.filter("tokens", _distinctive)))
    near_title = (shared >= 2) | ((F.size(own_title) == 1) & (shared == 1))
    against = F.exists(F.array_distinct(F.concat("contrast", "baseline")), lambda t: T.includes_term(F.col("title_text"), F.col("title_words"), t))
    numeric = F.size("numeric_hits") > 0
    d = d.withColumns({"product_evidence": product, "supported": supported})
    d = d.withColumn("strong", F.array_compact(F.array(
        F.when((F.size("title_phrases") > 0) | (near_title & ~against), "title_phrase"),
        F.when(F.exists("phrase_hits", many), "distinctive_phrase"),
        F.when(F.size("distinctive") >= 2, "distinctive_tokens"),
        F.when(numeric & F.col("product_evidence"), "numeric_with_product"),
        F.when(F.size("body_phrases") > 0, "body_phrase"),
    )))
    single = F.size("tokens") <= 1
    d = d.withColumn("weak", F.array_compact(F.array(
        F.when(single, "very_short_query"),
        F.when(single & (F.col("n_viable") > 1), "single_token_many_candidates"),
        F.when((F.col("n_viable") > 1) & (F.col("margin") < 10), "no_dominance"),
        F.when(numeric & ~F.col("product_evidence"), "numeric_without_product"),
        F.when(F.size("phrase_hits") == 0, "no_phrase"),
        F.when(~F.col("supported"), "no_text_support"),
        F.when((F.size("distinctive") <= 1) & (F.size("phrase_hits") == 0) & ~numeric, "one_common_token"),
        F.when(F.col("only_contrast"), "only_contrast"),
        F.when((F.col("relevance") >= 70) & (F.size("strong") == 0), "high_score_without_strong"),
    )))
    inside = F.lit(True) if scope is None else F.col("document").isin(*scope)
    coded, exact = F.size("codes") > 0, F.array_contains("codes", F.col("hs_code"))
    none = F.size("strong") == 0
    state = (
        F.when(~inside, "outside scope")
        .when(coded & exact, "exact code")
        .when(coded, "other code")
        .when(F.col("reject_reason").isNotNull(), "rejected by relevance")
        .when(numeric & ~F.col("product_evidence"), "numbers without product")
        .when(none & single & F.col("supported"), "broad lookup only")
        .when(none, "weak evidence only")
        .when((F.size("strong") >= 2) & (F.size("weak") == 0), "several strong signals")
        .otherwise("sufficient evidence")
    )
    d = d.withColumn("state", state)
    accepted = F.col("state").isin("exact code", "broad lookup only", "several strong signals", "sufficient evidence")
    confidence = (
        F.when(F.col("state").isin("exact code", "several strong signals"), HIGH)
        .when((F.col("state") == "sufficient evidence") & ((F.size("strong") >= 2) | (F.col("relevance") >= 50)), HIGH)
        .when(F.col("state") == "sufficient evidence", MEDIUM)
        .otherwise(LOW)
    )
    return d.withColumns({"accepted": accepted, "confidence": confidence})


def rank_order() -> list[Column]:
    """Seven keys, and the section's id against ties: accepted, confidence, strong signals, fewest weak ones, relevance, retrieval score, document."""
    level = F.when(F.col("confidence") == HIGH, 3).when(F.col("confidence") == MEDIUM, 2).otherwise(1)
    return [F.col("accepted").desc(), level.desc(), F.size("strong").desc(), F.size("weak"), F.col("relevance").desc(), F.col("score").desc(), F.col("document"), F.col("section_id")]


def group_best(validated: DataFrame) -> DataFrame:
    """The best accepted candidate of every (document, title) of a query, with all codes of the group."""
    best = F.max_by("section_id", F.struct("relevance", -F.col("section_id")))
    return validated.filter("accepted").groupBy("query_id", "document", "title").agg(F.max("relevance").alias("relevance"), best.alias("section_id"), F.array_join(F.sort_array(F.collect_set("hs_code")), "|").alias("codes"), F.max_by("confidence", F.struct("relevance", -F.col("section_id"))).alias("confidence"), F.bool_or(F.size("strong") > 0).alias("any_strong"))


def broad_decision(groups: DataFrame, queries: DataFrame) -> DataFrame:
    """Whether a question is too broad for one answer, with the mode to answer in."""
    w = Window.partitionBy("query_id").orderBy(F.col("relevance").desc(), "section_id")
    ranked = groups.withColumns({"rank": F.row_number().over(w), "next": F.lead("relevance").over(w)})
    per = ranked.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("confidence") == LOW).cast("int")).alias("n_low"), F.bool_or("any_strong").alias("strong"), F.max(F.when(F.col("rank") == 1, F.col("relevance") - F.col("next"))).alias("margin"))
    d = queries.select("query_id", "question", F.size("codes").alias("n_codes"), F.size("tokens").alias("n_tokens")).join(per, "query_id", "left").na.fill({"n": 0, "n_low": 0, "strong": False})
    number = F.col("question").rlike(r"^\s*\d+(?:[.,]\d+)?\s*%?\s*$")
    mode = (
        F.when((F.col("n_codes") > 0) & (F.col("n") > 0), "normal: exact code")
        .when((F.col("n") == 1) & (F.col("strong") | (F.col("n_low") == 0)), "normal: single candidate")
        .when(F.col("strong") & ((F.col("n") < 2) | (F.col("margin") >= 10)), "normal: strong evidence")
        .when(number, "clarification: bare number")
        .when((F.col("n_tokens") <= 1) & (F.col("n") >= 2), "broad_lookup: single token")
        .when((F.col("n_tokens") <= 1) & ~F.col("strong"), F.when(F.col("n") > 0, "broad_lookup: too few tokens").otherwise("clarification: too few tokens"))
        .when((F.col("n") >= 2) & ((F.col("margin") < 10) | (F.col("n_low") >= 2)), "broad_lookup: no dominance")
        .otherwise("normal: enough support")
    )
    return d.select("query_id", F.col("n").cast("long").alias("n_groups"), F.coalesce("margin", F.lit(0)).cast("long").alias("margin"), mode.alias("mode"))
