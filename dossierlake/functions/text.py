"""Text functions as Column expressions: folding, tokens, signals, numbers, sentences, languages."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folds() -> tuple[str, str]:
    """Accented Latin letters (Vietnamese included) and the plain letters they fold to, by decomposition."""
    pairs = []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        c = chr(code)
        plain = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        if plain != c and len(plain) == 1 and plain.isascii():
            pairs.append((c, plain))
    pairs += [("đ", "d"), ("Đ", "D")]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _folds()

# Words that carry no meaning in a query.
STOPWORDS = [
    "the", "and", "for", "with", "what", "which", "how", "does", "define", "defined", "definition", "code", "hscode", "hang", "hoa", "san", "pham", "duoc", "dinh", "nghia", "thuoc", "loai", "nao",
    "cua", "cho", "trong", "mot", "cac", "voi", "hon", "khac", "thay", "khong", "phai", "more", "less", "than", "compared", "compare", "versus", "which", "has", "have", "having", "belong", "belongs",
    "is", "are", "was", "were", "this", "that",
]

# Words too general to be evidence on their own.
WEAK_TOKENS = ["chapter", "chuong", "noi", "dung", "tom", "tat", "liet", "ke", "main", "content", "summary", "document", "file"]

# Phrases that set a query off against something else.
CONTRAST_PHRASES = [
    "so voi", "khac voi", "khac", "thay vi", "khong phai", "it hon", "nhieu hon", "dai hon", "dang hon", "hon", "less than", "more than", "compared to", "rather than", "instead of", "different from",
]

# Physical attributes, usages and trade forms that a query may name.
PHYSICAL_TERMS = [
    "bitter", "sweet", "mild", "smooth", "coarse", "coarser", "aroma", "texture", "caffeine", "high caffeine", "higher caffeine", "low acidity", "higher acidity", "acidity", "round", "rounder", "oval", "long",
    "longer", "large", "larger", "balanced", "deformity", "wound", "disease", "appearance", "physical", "shape", "size", "weight", "moisture", "content",
]
USAGE_TERMS = [
    "usage", "used", "use", "ingredient", "instant coffee", "specialty coffee", "espresso", "breeding", "sowing", "planting", "incense", "perfume", "human consumption", "laboratory", "demonstration",
]
TRADE_TERMS = [
    "fresh", "frozen", "dry", "dried", "roast", "roasted", "raw", "processed", "beans", "chips", "wood chips", "powder", "seedling", "seedlings", "budwood", "stumps", "meat paste", "deboned", "separated",
]

# Comparative and participle forms and the words they stand for.
TOKEN_FORMS = {
    "higher": "high", "highest": "high", "lower": "low", "lowest": "low", "larger": "large", "largest": "large", "longer": "long", "shorter": "short", "rounder": "round",
    "bitterer": "bitter", "milder": "mild", "smoother": "smooth", "coarser": "coarse", "fresher": "fresh", "drier": "dry", "dried": "dry", "roasted": "roast", "processed": "process",
}

CODE = r"\b\d{4}\.\d{2}\.\d{2}\b"


def fold(c: Column) -> Column:
    """Lower case without accents."""
    return F.lower(F.translate(c, ACCENTED, PLAIN))


def normalize_search(c: Column) -> Column:
    """The form in which texts and queries are compared: dashes repaired, folded, two spellings unified, trimmed."""
    shown = F.trim(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("â€”"), F.lit("—")), F.lit("â€“"), F.lit("–")))
    return F.regexp_replace(F.regexp_replace(fold(shown), r"\bca\s+phe\b", "coffee"), r"\bwoodchips\b", "wood chips")


def raw_tokens(normalized: Column) -> Column:
    """Runs of a-z, 0-9 and dots, with repeats, in order."""
    return F.filter(F.split(normalized, "[^a-z0-9.]+"), lambda t: t != "")


def token_form(t: Column) -> Column:
    out = t
    forms = F.create_map(*[F.lit(x) for pair in TOKEN_FORMS.items() for x in pair])
    return F.coalesce(forms[t], out)


def ranking_tokens(c: Column) -> Column:
    """Distinct tokens of three characters and more, in their standing form."""
    return F.array_distinct(F.filter(F.transform(raw_tokens(normalize_search(c)), token_form), lambda t: F.length(t) >= 3))


def meaningful_tokens(c: Column) -> Column:
    """Ranking tokens and bare numbers, without stopwords."""
    forms = F.transform(raw_tokens(normalize_search(c)), token_form)
    return F.array_distinct(F.filter(forms, lambda t: ((F.length(t) >= 3) | t.rlike(r"^\d+(?:\.\d+)?$")) & ~t.isin(*STOPWORDS)))


def count_token(normalized: Column, token: Column) -> Column:
    """How often a token stands between boundaries; equal to counting it among the raw tokens."""
    return F.size(F.filter(raw_tokens(normalized), lambda t: t == token))


def includes_signal(normalized: Column, term: Column) -> Column:
    """A term of one token must stand as a token; any other must occur as text. An empty term never does."""
    return F.when(term == "", False).when(term.rlike("^[a-z0-9.]+$"), F.array_contains(raw_tokens(normalized), term)).otherwise(F.contains(normalized, term))


def includes_term(text: Column, words: Column, term: Column) -> Column:
    """includes_signal where the text's raw tokens are at hand: inside a lambda they would be split off again for every term."""
    return F.when(term == "", False).when(term.rlike("^[a-z0-9.]+$"), F.array_contains(words, term)).otherwise(F.contains(text, term))


def ngrams(tokens: Column, n: int) -> Column:
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))


def useful_phrases(tokens: Column, normalized: Column) -> Column:
    """Three-token then two-token runs of seven characters and more that the text has word for word."""
    return F.array_distinct(F.filter(F.concat(ngrams(tokens, 3), ngrams(tokens, 2)), lambda p: (F.length(p) >= 7) & F.contains(normalized, p)))


# Fixed patterns: percentages; ranges with units; comparisons with a number; numbers with units.
NUMERIC_PATTERNS = [
    r"\b\d+(?:\.\d+)?\s*%(?:$|[^a-z0-9])",
    r"\b\d+(?:\.\d+)?\s*(?:-|–|to|den|toi)\s*\d+(?:\.\d+)?\s*(?:%|cm|mm|m|kg|g|mg|ppm|do|degree|percent)?\b",
    r"\b(?:less than|more than|at least|at most|under|over|duoi|tren|hon|it hon|nhieu hon|toi thieu|toi da)\s+\d+(?:\.\d+)?\s*(?:%|cm|mm|m|kg|g|mg|ppm)?\b",
    r"\b\d+(?:\.\d+)?\s*(?:%|cm|mm|m|kg|g|mg|ppm)\b",
]


def numeric_ranges(c: Column) -> Column:
    """Numeric statements of a text, each once: percentages, ranges, comparisons, numbers with units."""
    text = F.replace(normalize_search(c), F.lit(","), F.lit("."))
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in NUMERIC_PATTERNS]
    cleaned = F.transform(F.concat(*found), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"(?<=%)[^a-z0-9]$", ""), r"\s+", " ")))
    return F.array_distinct(cleaned)


def numbers(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.replace(c, F.lit(","), F.lit(".")), F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), lambda x: x.cast("double"))


def codes(c: Column) -> Column:
    """Distinct codes NNNN.NN.NN of a text, in order."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(CODE), F.lit(0)))


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda s: s != "")


def preview(c: Column, most: int = 180) -> Column:
    """White space collapsed, clipped to `most` characters with an ellipsis."""
    flat = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.rtrim(F.left(flat, F.lit(most - 3))), F.lit("..."))).otherwise(flat)


def uppercase_ratio(c: Column) -> Column:
    letters = F.regexp_count(c, F.lit(r"\p{L}"))
    return F.when(letters == 0, 0.0).otherwise(F.regexp_count(c, F.lit(r"\p{Lu}")) / letters)


def words_of(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def language(c: Column) -> Column:
    """vi, en, mixed or unknown, by accented Vietnamese letters and function words of both."""
    vi = c.rlike("[ăâđêôơưĂÂĐÊÔƠƯạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ]") | normalize_search(c).rlike(r"\b(la|gi|nao|cua|cho|ma|trong|va|thuoc)\b")
    en = normalize_search(c).rlike(r"\b(what|which|how|is|are|the|of|for|code|does|document|chapter)\b")
    return F.when(vi & en, "mixed").when(vi, "vi").when(en, "en").otherwise("unknown")
