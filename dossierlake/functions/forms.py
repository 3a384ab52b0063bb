"""Normal forms, token sets and answer texts as Column expressions; each caller of the engine has a form of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossierlake.functions import text as T

# Words that searches over sections, and over sources, pass over.
SEARCH_STOPWORDS = [
    "the", "and", "are", "for", "with", "what", "which", "define", "defined", "definition", "duoc", "dinh", "nghia", "gi", "la", "loai", "co", "ca", "phe", "more", "less", "than", "has", "have", "having",
    "compared", "compare", "cua", "cho", "thuoc", "trong", "mot", "cac",
]
# The same of the planner, of intents, of local answers and of fields.
PLANNER_STOPWORDS = [
    "the", "and", "for", "with", "what", "which", "how", "does", "code", "hs", "hscode", "hang", "hoa", "san", "pham", "duoc", "dinh", "nghia", "thuoc", "loai", "nao", "cua", "cho", "trong", "mot", "cac",
    "voi", "hon", "khac", "khong", "phai", "can", "yeu", "cau", "dap", "ung", "la", "gi", "is", "are", "chapter", "chuong", "document", "file",
]
INTENT_STOPWORDS = [
    "the", "and", "for", "with", "what", "which", "define", "definition", "code", "hscode", "hang", "hoa", "san", "pham", "duoc", "dinh", "nghia", "thuoc", "loai", "nao", "cua", "cho", "trong", "mot", "cac",
    "voi", "hon", "khac", "thay", "khong", "phai", "is", "are", "was", "were", "it", "this", "that", "these", "those", "nay", "day", "do", "chapter", "chuong", "noi", "dung", "tom", "tat", "document", "file",
]
LOCAL_STOPWORDS = [
    "the", "and", "or", "for", "with", "what", "which", "how", "does", "are", "is", "was", "were", "this", "that", "these", "those", "code", "hscode", "hs", "hang", "hoa", "san", "pham", "cua", "cho", "trong",
    "mot", "cac", "nhung", "nao", "gi", "la", "co", "ve", "noi", "dung", "more", "less", "than", "has", "have", "having", "compared", "compare", "versus",
]
FIELD_STOPWORDS = ["the", "and", "or", "on", "of", "for", "to", "a", "an", "general", "which", "what", "how", "nao", "gi", "nhung", "cac", "ve", "la", "co"]
# Forms that searches and local answers unify, and what a local token also stands for.
SEARCH_FORMS = {
    "higher": "high", "highest": "high", "lower": "low", "lowest": "low", "larger": "large", "largest": "large", "longer": "long", "longest": "long", "rounder": "round", "coarser": "coarse", "smoother": "smooth",
    "dried": "dry", "drier": "dry",
}
EQUIVALENTS = {
    "high": ["higher", "highest"], "higher": ["high", "highest"], "low": ["lower", "lowest"], "lower": ["low", "lowest"], "large": ["larger", "largest"], "larger": ["large", "largest"],
    "long": ["longer", "longest"], "longer": ["long", "longest"], "round": ["rounder"], "rounder": ["round"], "coarse": ["coarser"], "coarser": ["coarse"], "smooth": ["smoother"], "smoother": ["smooth"],
    "dry": ["dried", "drier"], "dried": ["dry", "drier"],
}
# Words that begin a question, and small words of a title.
QUESTION_STARTERS = ["what", "which", "who", "where", "when", "why", "how", "does", "do", "is", "are"]
SMALL_TITLE_WORDS = ["of", "the", "and", "or", "for", "to", "in", "on", "with", "not"]
VIETNAMESE_WORDS = r"\b(la|gi|can|phai|yeu|cau|ngoai|quan|nhin|trong|nhu|nao|chuong|tom|tat|noi|dung|cong|dung|dac|diem|ma|thuoc)\b"
VIETNAMESE_LETTERS = "[ăâđêôơưáàảãạấầẩẫậắằẳẵặéèẻẽẹếềểễệíìỉĩịóòỏõọốồổỗộớờởỡợúùủũụứừửữựýỳỷỹỵ]"

ACCENTED, PLAIN = T.ACCENTED.replace("đ", "").replace("Đ", ""), "".join(b for a, b in zip(T.ACCENTED, T.PLAIN, strict=True) if a not in "đĐ")
#: Letters left over from a broken decoding, which two of the forms read as d.
BROKEN_INTENT, BROKEN_LOOKUP = "‘", "„€˜"


def let(c: Column, of: Callable[[Column], Column]) -> Column:
    """What `of` makes of a value that is told once, however often `of` names it."""
    return F.get(F.transform(F.array(c), of), F.lit(0))


def _flat(c: Column) -> Column:
    return F.btrim(F.regexp_replace(c, r"\s+", " "))


def _lower(c: Column, dee: bool = True, broken: str = "") -> Column:
    """Lower case without accents; the barred d too unless dee is False; broken characters become d."""
    extra = ("đĐ" if dee else "") + broken
    return F.lower(F.translate(c, ACCENTED + extra, PLAIN + "d" * len(extra)))


def planner_form(c: Column) -> Column:
    return _flat(_lower(c))


def intent_form(c: Column) -> Column:
    return _flat(_lower(c, broken=BROKEN_INTENT))


def local_form(c: Column) -> Column:
    return _flat(_lower(c, dee=False, broken=BROKEN_INTENT))


def lookup_form(c: Column) -> Column:
    return _flat(_lower(c, dee=False, broken=BROKEN_LOOKUP))


def field_form(c: Column) -> Column:
    return _flat(F.regexp_replace(_lower(c), "[_-]+", " "))


def fusion_form(c: Column) -> Column:
    return _flat(F.regexp_replace(_lower(c, dee=False), "[^a-z0-9:._/\\-<>= ]+", " "))


def search_form(c: Column) -> Column:
    """As the search over sections compares texts: untrimmed, two spellings unified."""
    return F.regexp_replace(F.regexp_replace(_lower(c), r"\bca\s+phe\b", "coffee"), r"\bwoodchips\b", "wood chips")


def inline_form(c: Column) -> Column:
    return _flat(F.replace(c, F.lit("ï¿½"), F.lit("-")))


def alignment_form(c: Column) -> Column:
    """As spans and parsed units are compared: without markdown, marks and single dots; a dot between digits stays."""
    x = F.regexp_replace(c, r"[`*_~>#\[\]()]|!\[[^\]]*\]\([^)]*\)", " ")
    x = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "[–—−]", "-"), "[“”„‟]", '"'), "[‘’‚‛]", "'")
    x = F.regexp_replace(F.regexp_replace(_lower(x), r"\.{2,}", " "), "-{2,}", " ")
    x = F.regexp_replace(F.regexp_replace(x, r"(?<=\d)-(?=\d)", " "), r"(?<!\d)\.|\.(?!\d)", " ")
    return _flat(F.regexp_replace(x, "[,;:!?/\\\\|+=%$€£¥^\"'{}<>-]", " "))


def _kept(tokens: Column, stop: list[str]) -> Column:
    return F.array_distinct(F.filter(tokens, lambda t: ~t.isin(*stop)))


def _formed(tokens: Column) -> Column:
    forms = F.create_map(*[F.lit(x) for pair in SEARCH_FORMS.items() for x in pair])
    return F.transform(tokens, lambda t: F.coalesce(forms[t], t))


def _long(tokens: Column, least: int = 3) -> Column:
    return F.filter(tokens, lambda t: F.length(t) >= least)


def search_tokens(c: Column) -> Column:
    """Distinct search tokens without stopwords; with them where nothing else is left."""
    all_ = F.array_distinct(_long(_formed(T.raw_tokens(search_form(c)))))
    return let(all_, lambda each: let(_kept(each, SEARCH_STOPWORDS), lambda kept: F.when(F.size(kept) > 0, kept).otherwise(each)))


def source_tokens(c: Column) -> Column:
    return _kept(_long(_formed(T.raw_tokens(search_form(c)))), SEARCH_STOPWORDS)


def planner_tokens(c: Column) -> Column:
    return _kept(_long(T.raw_tokens(planner_form(c)), 2), PLANNER_STOPWORDS)


def intent_tokens(c: Column) -> Column:
    fit = F.filter(T.raw_tokens(intent_form(c)), lambda t: ((F.length(t) >= 3) | t.rlike(r"^\d+(?:\.\d+)?$")) & ~t.rlike(r"^\d+$"))
    return _kept(fit, INTENT_STOPWORDS)


def local_tokens(c: Column) -> Column:
    return _kept(_long(_formed(T.raw_tokens(local_form(c)))), LOCAL_STOPWORDS)


def field_tokens(c: Column) -> Column:
    return _kept(_long(F.split(field_form(c), "[^a-z0-9]+")), FIELD_STOPWORDS)


def alignment_tokens(c: Column) -> Column:
    return F.array_distinct(_long(T.raw_tokens(alignment_form(c)), 2))


def matches_local(tokens: Column, token: Column) -> Column:
    """Whether a token or what it also stands for is among the tokens."""
    others = F.create_map(*[x for k, v in EQUIVALENTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.array_contains(tokens, token) | F.coalesce(F.arrays_overlap(tokens, others[token]), F.lit(False))


def quoted_terms(c: Column) -> Column:
    found = F.regexp_extract_all(c, F.lit("[\"'“”‘’]([^\"'“”‘’]{2,80})[\"'“”‘’]"), F.lit(1))
    return F.array_distinct(F.transform(found, T.normalize_search))


_NAMES = r"\b[A-Z][a-z]{2,}(?:\s+[A-Z]?[a-z]{2,}){%s,2}\b"


def capitalised_terms(c: Column) -> Column:
    """Names of one to three words that do not begin as a question does and hold no joining word."""
    fit = lambda n: (F.size(T.meaningful_tokens(n)) > 0) & ~F.get(T.raw_tokens(n), F.lit(0)).isin(*QUESTION_STARTERS) & ~F.arrays_overlap(T.raw_tokens(n), F.array(*map(F.lit, ("and", "or", "has", "have", "is", "are"))))
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(c, F.lit(_NAMES % 0), F.lit(0)), T.normalize_search), fit))


def scientific_names(c: Column) -> Column:
    """Capitalised names of two or three words without stopwords after the first, and quoted terms that say something."""
    words = T.raw_tokens
    stop = F.array(*map(F.lit, dict.fromkeys(T.STOPWORDS)))
    named = F.transform(F.regexp_extract_all(c, F.lit(_NAMES % 1), F.lit(0)), T.normalize_search)
    named = F.filter(named, lambda n: (F.size(words(n)) >= 2) & ~F.arrays_overlap(F.slice(words(n), 2, F.greatest(F.size(words(n)) - 1, F.lit(0))), stop))
    told = lambda n: (F.size(words(n)) > 0) & ~F.get(words(n), F.lit(0)).isin(*QUESTION_STARTERS) & (F.size(F.array_except(words(n), stop)) > 0)
    return F.array_distinct(F.filter(F.concat(named, quoted_terms(c)), told))


COMPARED = r"\b(?:more|less|higher|lower|longer|shorter|bigger|smaller|stronger|weaker|sweeter|bitterer|milder|drier|fresher)\s+(?:[a-z0-9.]+\s+){0,4}?than\s+([a-z0-9.]+(?:\s+[a-z0-9.]+){0,3})"
BROKEN_OFF = r"\b(?:and|or|but|with|without|has|have|having|plus|also)\b[\s\S]*$"


def baseline_tokens(normalized: Column) -> Column:
    """What a comparison with `than` sets its subject against: up to three tokens a comparison."""
    found = F.regexp_extract_all(normalized, F.lit(COMPARED), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(found, lambda b: F.slice(_long(T.raw_tokens(F.regexp_replace(b, BROKEN_OFF, ""))), 1, 3))))


def prefers_vietnamese(c: Column) -> Column:
    """An answer in Vietnamese: for blank questions, Vietnamese letters or words, and questions without a Latin letter."""
    return F.coalesce(F.btrim(c), F.lit("")).eqNullSafe("") | F.lower(c).rlike(VIETNAMESE_LETTERS) | T.normalize_search(c).rlike(VIETNAMESE_WORDS) | ~c.rlike("[a-zA-Z]")


def sentence_end(c: Column) -> Column:
    return F.when(F.btrim(c).rlike("[.!?]$"), F.btrim(c)).otherwise(F.concat(F.btrim(c), F.lit(".")))


def _clipped(c: Column, most: int) -> Column:
    return F.btrim(F.regexp_replace(F.left(c, F.lit(most)), r"\s+\S*$", ""))


def shorten_sentence(c: Column, most: int) -> Column:
    return let(let(_flat(c), lambda flat: F.when(F.length(flat) <= most, flat).otherwise(_clipped(flat, most))), sentence_end)


def shorten_to_sentences(c: Column, most: int) -> Column:
    """As many whole sentences as fit, or words where the first one does not."""
    return let(_flat(c), lambda flat: F.when(F.length(flat) <= most, flat).otherwise(_first_sentences(flat, most)))


def _first_sentences(flat: Column, most: int) -> Column:
    each = T.sentences(flat)
    fits = F.aggregate(each, F.struct(F.lit("").alias("text"), F.lit(True).alias("open")), lambda a, s: F.when(a["open"] & (F.length(_after(a["text"], s)) <= most), F.struct(_after(a["text"], s).alias("text"), F.lit(True).alias("open"))).otherwise(F.struct(a["text"].alias("text"), F.lit(False).alias("open"))))  # noqa: E501
    return let(fits["text"], lambda text: F.when(text != "", text).otherwise(_clipped(flat, most)))


def _after(text: Column, sentence: Column) -> Column:
    return F.when(text == "", sentence).otherwise(F.concat(text, F.lit(" "), sentence))


def paragraphs(c: Column) -> Column:
    parts = F.transform(F.split(c, r"\n{2,}|(?<=[.!?])\s+(?=[A-Z])"), lambda x: F.btrim(x))
    return F.filter(parts, lambda p: F.length(p) >= 8)


def heading_title(c: Column) -> Column:
    """A heading's text without its marks and code; null for an empty one."""
    shown = F.btrim(F.regexp_replace(F.coalesce(c, F.lit("")), r"^#{1,6}\s+", ""))
    bare = F.btrim(F.regexp_replace(F.regexp_replace(shown, T.CODE, ""), r"^[\s—–-]+", ""))
    return F.when(shown == "", F.lit(None)).when(bare != "", bare).otherwise(shown)


def title_case(c: Column) -> Column:
    words = F.split(F.lower(c), r"\s+")
    small = lambda w, i: w.isin(*SMALL_TITLE_WORDS) & (i > 0) & (i < F.size(words) - 1)
    return F.array_join(F.transform(words, lambda w, i: F.when(small(w, i), w).otherwise(F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2))))), " ")


def retrieved_text(c: Column) -> Column:
    """Running text of a section: headings, images, comments, captions and source lines taken off."""
    x = F.regexp_replace(F.regexp_replace(c, r"(?m)^#{1,6}\s+.*$", ""), r"!\[[^\]]*\]\([^)]+\)", "")
    x = F.regexp_replace(F.regexp_replace(x, r"(?s)<!--.*?-->", ""), r"(?im)^\*Caption:\s*[^*]+\*$", "")
    return _flat(F.regexp_replace(x, r"(?im)^\(Source:[^)]+\)$", ""))


def captions(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(r"(?i)\*Caption:\s*([^*]+)\*"), F.lit(1)), lambda x: F.btrim(x))


NOTE = r"(?i)\b(should be classified under|classified under|remain in heading|does not apply|however|except|provided that|if)\b"


def classification_note(c: Column) -> Column:
    """The first sentence that says where something belongs, shortened when it is long."""
    note = F.get(F.filter(T.sentences(retrieved_text(c)), lambda x: x.rlike(NOTE)), F.lit(0))
    return let(note, lambda s: F.when(F.length(s) <= 220, s).otherwise(shorten_sentence(s, 180)))


def strip_codes(c: Column, allowed: Column) -> Column:
    """Codes that are not allowed go; with none allowed the answer stays as it is."""
    each = F.array_except(F.regexp_extract_all(c, F.lit(T.CODE), F.lit(0)), allowed)
    return F.when(F.size(allowed) == 0, c).otherwise(_flat(F.aggregate(each, c, lambda a, x: F.replace(a, x, F.lit("")))))


def direct_answer(c: Column) -> Column:
    """A model's answer without citations and codes; empty where it says that the context does not suffice."""
    x = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "(?i)<doc=[^>]+>", ""), r"(?is)\s*(Trích dẫn|Citation|Nguồn):.*$", "")
    x = _flat(F.regexp_replace(x, r"(?i)HS Code:\s*\d{4}\.\d{2}\.\d{2}\.?", ""))
    return F.when(x.rlike("(?i)document context is insufficient|không đủ ngữ cảnh"), "").otherwise(x)


def citations(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("(?i)<doc=[^>]+>"), F.lit(0))


def block_type(kind: Column, c: Column) -> Column:
    """The type of a mapped block: told by its kind, else by how its text begins or looks."""
    k, t = F.lower(F.coalesce(kind, F.lit(""))), F.btrim(c)
    return (
        F.when(k.isin("image", "table", "caption"), k)
        .when(t.rlike(r"(?i)^source\b"), "source")
        .when(t.rlike(T.CODE), "hs-code")
        .when(t.rlike(r"(?i)^chapter\s+\d+") | t.rlike(r"^#+\s+"), "heading")
        .when((F.length(t) > 0) & (F.length(t) < 150) & (t == F.upper(t)) & t.rlike("[A-Z]"), "title")
        .when(k == "text", "paragraph")
        .otherwise("unknown")
    )
