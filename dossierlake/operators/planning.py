"""Query plans by rules, the fields a question asks for, and states that are told from texts.

Everything is a Column expression over the question; white space is collapsed first, so places found in the
folded text are places in the question.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierlake.functions import forms as X
from dossierlake.functions import text as T

# Fields and the words that ask for them.
FIELD_GROUPS = {
    "appearance": ["appearance", "external appearance", "visual appearance", "ngoai quan", "nhin ngoai", "trong nhu", "trong nhu nao", "look", "looks"],
    "requirements": ["requirement", "requirements", "required", "must", "need", "needs", "yeu cau", "can dap ung", "phai", "can gi"],
    "activeness": ["activeness", "activity", "active", "liveliness", "hoat dong", "linh hoat"],
    "weight and size": ["weight and size", "weight", "size", "dimension", "dimensions", "trong luong", "kich thuoc"],
    "usage": ["usage", "use", "uses", "purpose", "function", "cong dung", "muc dich", "su dung"],
    "definition": ["definition", "define", "meaning", "means", "dinh nghia", "la gi"],
    "characteristics": ["characteristic", "characteristics", "feature", "features", "dac diem", "tinh chat"],
    "condition": ["condition", "state", "status", "quality", "dieu kien", "tinh trang", "trang thai"],
    "note": ["note", "notes", "remark", "remarks", "chu thich", "ghi chu", "luu y"],
    "origin": ["origin", "country of origin", "provenance", "xuat xu", "nguon goc", "nuoc xuat xu"],
    "composition": ["composition", "ingredient", "ingredients", "material", "thanh phan", "chat lieu", "nguyen lieu"],
    "packaging": ["packaging", "package", "container", "wrapping", "dong goi", "bao bi", "bao goi"],
    "color": ["color", "colour", "hue", "shade", "mau sac", "mau"],
    "processing": ["processing", "process", "method", "technique", "preparation", "che bien", "phuong phap", "ky thuat", "xu ly"],
    "classification": ["classification", "category", "phan loai", "loai", "nhom"],
}
# The order in which a requested field is told by its groups.
FIELD_ORDER = ("weight and size", "activeness", "usage", "definition", "characteristics", "appearance", "requirements", "condition", "note")
# Fixed patterns of the planner.
PLAN_VIETNAMESE = r"\b(la|gi|can|phai|yeu|cau|ngoai|quan|nhin|trong|nhu|nao|chuong|tom|tat|noi|dung|cong|dung|dac|diem)\b"
PLAN_ENGLISH = r"\b(what|which|how|definition|define|chapter|document|requirements?|appearance|activeness|usage|compare|difference)\b"
SUMMARY = r"\b(summary|summarize|about|contents?|cover|tom\s+tat|noi\s+dung|noi\s+ve|co\s+gi|gom|liet\s+ke)\b"
CHAPTER = r"\b(?:(?:chuong|chapter)\s+|chapter[\s_-]*)(\d{1,3})\b"
DOCUMENT = r"\b(document|file)\b"
CODE_QUESTION = r"\b(hs\s*code|hscode|ma\s+hs|ma\s+hscode|tariff\s+code|customs\s+code|classified?|classification|phan\s+loai|thuoc\s+ma)\b|\bcode\s*\??$"
FILLER = r"(?i)(?<![A-Za-z0-9_])(?:product|item|goods|sản phẩm|san pham|hàng hóa|hang hoa|con|cái|cai|the|a|an)(?![A-Za-z0-9_])"


def flat(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def query_language(c: Column, form: Column | None = None) -> Column:
    """vi, en, mixed or unknown, as the planner tells it: any Latin letter is English unless Vietnamese stands there."""
    n = X.planner_form(c) if form is None else form
    vi, en = F.lower(c).rlike(X.VIETNAMESE_LETTERS) | n.rlike(PLAN_VIETNAMESE), n.rlike(PLAN_ENGLISH)
    return F.when(n == "", "unknown").when(vi & en, "mixed").when(vi, "vi").when(c.rlike("[a-zA-Z]"), "en").otherwise("unknown")


def chapter_number(c: Column, form: Column | None = None) -> Column:
    found = F.regexp_extract(X.planner_form(c) if form is None else form, CHAPTER, 1)
    return F.when(found != "", found.cast("int"))


def clean_target(c: Column) -> Column:
    """What a question is about: without question words, marks, articles and words for goods."""
    x = F.regexp_replace(F.regexp_replace(c, r"(?i)\s*(?:là|la)\s+(?:gì|gi)\s*[?!.]*\s*$", " "), r"(?i)^\s*what\s+is\s+", " ")
    return flat(F.regexp_replace(F.regexp_replace(x, "[?!.:,;]+", " "), FILLER, " "))


def _from(question: Column, folded: Column, pattern: str, group: int) -> Column:
    """The part of the question where a group of the pattern stands in the folded text; null where it does not match."""
    found = F.regexp_extract(folded, pattern, group)
    return F.when(folded.rlike(pattern), F.substring(question, F.position(found, folded), F.length(question)))


def definition_term(c: Column, form: Column | None = None) -> Column:
    """The term whose definition is asked for; null where none is. With a form, c has its white space collapsed."""
    q = flat(c) if form is None else c
    n = X.planner_form(q) if form is None else form
    each = [_from(q, n, p, 1) for p in (r"^define\s+(.+)$", r"^(.+?)\s+la\s+gi\??$", r"^what\s+is\s+(.+?)\??$")]
    told = clean_target(F.regexp_replace(F.btrim(F.coalesce(*each)), "[?.!]+$", ""))
    return F.when(told != "", told)


def document_name(c: Column, form: Column | None = None) -> Column:
    """The document whose summary is asked for: what stands after the marker, or else before it; null where none is asked for. With a form, c has its white space collapsed."""
    q = flat(c) if form is None else c
    n = X.planner_form(q) if form is None else form
    at = F.regexp_instr(n, F.lit(DOCUMENT))
    signals = lambda x: flat(F.regexp_replace(F.regexp_replace(x, "(?i)" + SUMMARY, " "), r"(?i)(?<![A-Za-z0-9_])(có\s+gì|nội\s+dung|nói\s+về|tóm\s+tắt|gồm|liệt\s+kê)(?![A-Za-z0-9_])", " "))
    after = signals(F.substring(q, at + F.length(F.regexp_extract(n, DOCUMENT, 1)), F.length(q)))
    before = signals(F.substring(q, F.lit(1), F.greatest(at - 1, F.lit(0))))
    name = F.regexp_replace(clean_target(F.when(after != "", after).otherwise(before)), "[?.!]+$", "")
    return F.when(n.rlike(DOCUMENT) & n.rlike(SUMMARY) & (name != ""), name)


def asks_for_code(c: Column, form: Column | None = None) -> Column:
    return (X.planner_form(c) if form is None else form).rlike(CODE_QUESTION)


# Why a rule has settled a question.
REASONS = ("query contains an exact HS code", "query asks for chapter contents", "query asks for a document summary")


def plans(questions: DataFrame, question: str = "question") -> DataFrame:
    """The questions with plan: intent, target, needs_code, language, confidence and reason where the rules settle one, else null;
    and with language, definition_term and asks_code.

    Folded texts are columns of their own before patterns look at them, so no expression holds them twice.
    """
    laid = questions.withColumn("_flat", flat(F.col(question))).withColumn("_form", X.planner_form(F.col("_flat")))
    q, n = F.col("_flat"), F.col("_form")
    laid = laid.withColumns({"language": query_language(F.col(question), n), "definition_term": definition_term(q, n), "asks_code": asks_for_code(q, n), "_name": document_name(q, n)})
    laid = laid.withColumns({"_code": F.regexp_extract(question, T.CODE, 0), "_chapter": F.when(n.rlike(SUMMARY), chapter_number(q, n))})
    rules = [
        ("exact_hscode_lookup", F.when(F.col("_code") != "", F.col("_code")), True),
        ("chapter_summary", F.concat(F.lit("chapter "), F.col("_chapter").cast("string")), False),
        ("document_summary", F.col("_name"), False),
    ]
    plan = lambda intent, target, needs, reason: F.struct(F.lit(intent).alias("intent"), target.alias("target"), F.lit(needs).alias("needs_code"), F.col("language"), F.lit("high").alias("confidence"), F.lit(reason).alias("reason"))
    found = F.coalesce(*[F.when(target.isNotNull(), plan(intent, target, needs, reason)) for (intent, target, needs), reason in zip(rules, REASONS, strict=True)])
    return laid.withColumn("plan", found).drop("_flat", "_form", "_name", "_code", "_chapter")


def field_groups(form: Column, tokens: Column) -> Column:
    """The fields that a text asks for: a label stands in its field form, or all of a label's longer words are among its tokens."""
    found = []
    for name, labels in FIELD_GROUPS.items():
        # a label that holds another of its field stands only where that one does
        any_ = reduce(or_, (F.contains(form, F.lit(label)) for label in labels if not any(x != label and x in label for x in labels)))
        for label in labels:
            # a word alone among the tokens stands in the form too
            if (words := [w for w in label.split() if len(w) >= 3]) and label != words[0]:
                any_ = any_ | reduce(and_, (F.array_contains(tokens, w) for w in words))
        found.append(F.when(any_, name))
    return F.array_compact(F.array(*found))


def requested_field(groups: Column) -> Column:
    """The one field that is asked for; null for none of those that sections have."""
    has = lambda name: F.array_contains(groups, name)
    out = F.when(has("appearance") & has("requirements"), "appearance requirements")
    for name in FIELD_ORDER:
        out = out.when(has(name), name)
    return out


def field_match(asked: str, given: str) -> Column:
    """How well a given label answers an asked field, 0 to 1: shared groups count 0.78, shared tokens 0.22. Columns <asked>_groups, <asked>_tokens and the same of given."""
    g, t = F.col(f"{asked}_groups"), F.col(f"{asked}_tokens")
    groups = F.when(F.size(g) > 0, F.size(F.array_intersect(g, f"{given}_groups")) / F.size(g)).otherwise(0.0)
    tokens = F.when(F.size(t) > 0, F.size(F.array_intersect(t, f"{given}_tokens")) / F.least(F.size(t), F.lit(4))).otherwise(0.0)
    return F.least(F.lit(1.0), groups * 0.78 + tokens * 0.22)


def error_kind(message: Column, status: Column) -> Column:
    """The kind of a failed call, by its message and status."""
    m = F.lower(F.coalesce(message, F.lit("")))
    any_ = lambda *xs: m.rlike("|".join(xs))
    return (
        F.when(any_("timeout", "timed out", "deadline"), "timeout")
        .when(status.isin(401, 403) | any_("api key not valid", "invalid api key", "unauthorized", "permission denied", "forbidden"), "permission")
        .when(any_("quota", "resource exhausted"), "quota")
        .when((status == 429) | any_("rate limit", "too many requests"), "rate_limit")
        .otherwise("unknown")
    )


def upload_status(states: Column) -> Column:
    """One state of many documents' cache states (an array): failed before stale, fresh only where all are."""
    return (
        F.when(F.size(states) == 0, "missing")
        .when(F.array_contains(states, "failed"), "failed")
        .when(F.array_contains(states, "stale"), "stale")
        .when(F.forall(states, lambda s: s == "fresh"), "fresh")
        .otherwise("skipped")
    )


def index_source(source: Column, any_stale: Column) -> Column:
    return (
        F.when(source == "local-sections", "local_sections")
        .when(source == "bm25-fallback", "bm25_fallback")
        .when(source == "pageindex-tree", "pageindex_live")
        .when(source == "cached-pageindex-tree", F.when(any_stale, "stale_cached_tree").otherwise("fresh_cached_tree"))
        .otherwise("unknown")
    )
