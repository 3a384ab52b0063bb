"""Intents, gates and answers: what a question asks, whether the evidence suffices, and the cited reply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierlake.functions import text as T

# Small talk, and the word patterns that tell intents apart (folded text).
SMALL_TALK = ["hi", "hello", "hey", "xin chao", "chao ban", "thanks", "thank you", "cam on", "bye", "goodbye", "tam biet"]
SUMMARY_WORDS = r"\b(summary|summarize|content|contents|list|main|tom tat|noi dung|liet ke)\b"
CODE_WORDS = r"\b(hs code|hscode|which code|what code|classify|classified|classification|ma hs|phan loai)\b"
DEFINITION_WORDS = r"\b(what is|define|definition|meaning|la gi|dinh nghia)\b"
COMPARISON_WORDS = r"\b(vs|versus|compare|comparison|difference|different|instead of|rather than|less than|more than|khac|so sanh|phan biet)\b"


def intent(question: Column) -> Column:
    n = T.normalize_search(question)
    return (
        F.when(F.regexp_replace(n, r"[!?. ]+$", "").isin(*SMALL_TALK), "simple_chat")
        .when(question.rlike(r"\d{4}\.\d{2}\.\d{2}"), "exact_code_lookup")
        .when(n.rlike(r"\b(chapter|chuong)\s*\d+") & n.rlike(SUMMARY_WORDS), "chapter_summary")
        .when(question.rlike(r"^\s*\d+(?:[.,]\d+)?\s*%?\s*$"), "clarification_needed")
        .when(n.rlike(CODE_WORDS), "product_classification")
        .when(n.rlike(DEFINITION_WORDS), "definition")
        .when(n.rlike(COMPARISON_WORDS), "comparison")
        .otherwise("selected_section_qa")
    )


def intents(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", intent(F.col("question")).alias("intent"))


LEAST_SCORE, TITLE_SCORE, CLASS_SCORE, HIGH_SCORE, LEAST_STRONG = 20, 30, 35, 70, 1


def gate(ranked: DataFrame, queries: DataFrame, broad: DataFrame) -> DataFrame:
    """query_id, intent, answer mode, confidence and reason, from the best ranked candidate of every question."""
    d = intents(queries).join(broad.select("query_id", F.col("mode").alias("broadness")), "query_id", "left").join(ranked, "query_id", "left")
    score, n = F.coalesce(F.col("relevance"), F.lit(0)), F.coalesce(F.size("strong"), F.lit(0))
    enough = (score >= CLASS_SCORE) | ((score >= TITLE_SCORE) & F.array_contains("strong", "title_phrase"))
    cases = [
        (F.col("intent") == "simple_chat", "chat", "high", "small talk"),
        (F.col("intent") == "clarification_needed", "numeric_lookup", "low", "a bare number is no question"),
        (F.col("section_id").isNull(), "clarification", "low", "no candidate"),
        (~F.col("accepted"), "clarification", "low", "candidate not accepted"),
        (F.col("state") == "exact code", "classification", "high", "exact code"),
        (F.col("broadness").startswith("broad_lookup"), "broad_lookup", "low", "question too broad"),
        (F.col("confidence") == "low", "lookup", "low", "low confidence"),
        (score < LEAST_SCORE, "clarification", "low", "score too low"),
        (~enough | (n < LEAST_STRONG), "lookup", "low", "evidence too thin"),
        (score >= HIGH_SCORE, "classification", "high", "score and evidence suffice"),
    ]
    pick = lambda i, last: F.coalesce(*[F.when(c[0], F.lit(c[i])) for c in cases], F.lit(last))
    return d.withColumns({"answer_mode": pick(1, "classification"), "answer_confidence": pick(2, "medium"), "answer_reason": pick(3, "score and evidence suffice")})


def citation(document: Column, start: Column, end: Column, section: Column) -> Column:
    pages = F.when(start.isNull(), F.lit("")).when(end.isNull() | (start == end), F.concat(F.lit(", page "), start.cast("string"))).otherwise(F.concat(F.lit(", pages "), start.cast("string"), F.lit("–"), end.cast("string")))
    return F.concat(F.lit("Source: "), document, pages, F.coalesce(F.concat(F.lit(', section "'), section, F.lit('"')), F.lit("")))


def reply(gated: DataFrame) -> DataFrame:
    """query_id, intent, mode, confidence and the text of the answer with its citation."""
    cited = citation(F.col("document"), F.col("page_start"), F.col("page_end"), F.col("section"))
    text = (
        F.when(F.col("answer_mode") == "chat", "Hello. Ask about a product, a code, a chapter or a document.")
        .when(F.col("answer_mode").isin("clarification", "numeric_lookup"), "Please say more about the product.")
        .when(F.col("answer_mode") == "classification", F.concat(F.initcap(F.lower("title")), F.lit(" has the code "), F.col("hs_code"), F.lit(". "), cited))
        .otherwise(F.concat(F.lit("Possibly "), F.initcap(F.lower("title")), F.lit(" ("), F.col("hs_code"), F.lit("). "), cited))
    )
    return gated.select("query_id", "intent", "answer_mode", "answer_confidence", "answer_reason", F.col("hs_code").alias("code"), text.alias("answer"))
