"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossierlake.llm.common import map_batches, text_or_empty, texts_of

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "local_phone")
BASE_KINDS = KINDS[:4]

# Runs of digits end every match of a dotted or spaced number, so a start inside a run never matches
# where the run's own start does not: looking behind and possessive runs keep the scan linear.
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{2,4}+){3,8}(?:\x20?[A-Z0-9])?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9])")

#: Words that speak for a kind when they stand within CONTEXT characters before a span, or just after it.
CONTEXT_WORDS = {
    "email": ("email", "mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "payment"),
    "phone": ("phone", "call", "tel", "telephone", "mobile", "fax", "contact"),
    "iban": ("iban", "bank", "account", "transfer", "konto"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
    "local_phone": ("phone", "call", "tel", "telephone", "mobile", "fax", "contact"),
}
CONTEXT = 48
_WORD = re.compile(r"[a-z]+")
#: Score before context, and the least score at which a span of an added kind counts.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.4, "local_phone": 0.4}
LEAST = 0.6


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        if i % 2:
            x = 2 * x - 9 if x > 4 else 2 * x
        total += x
    return total % 10 == 0


def mod97(iban: str) -> bool:
    rest = 0
    for c in iban[4:] + iban[:4]:
        rest = int(f"{rest}{int(c, 36)}") % 97
    return rest == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str):
    last = 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            last = m.end()
            yield start, last


def _ibans(text: str):
    """Confirmed account numbers; groups of capitals that follow one are taken off until the checksum fits."""
    m = _IBAN.search(text)
    while m:
        at, own = m.end(), m[0]
        while len(s := own.replace(" ", "")) >= 15:
            if len(s) <= 34 and mod97(s):
                at = m.start() + len(own)
                yield m.start(), at
                break
            own = own.rpartition(" ")[0]
        m = _IBAN.search(text, at)


def propose(text: str) -> list[tuple[str, int, int]]:
    """Spans that a pattern proposes and its checksum or range test confirms."""
    found = []
    if "@" in text:
        found += [("email", a, b) for a, b in _emails(text)]
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m[0].split(".")):
                found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                found.append(("phone", m.start(), m.end()))
    found += [("iban", a, b) for a, b in _ibans(text)]
    for m in _SSN.finditer(text):
        area, group, serial = m[0].split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            found.append(("ssn", m.start(), m.end()))
    found += [("local_phone", m.start(), m.end()) for m in _LOCAL_PHONE.finditer(text)]
    return found


def score(text: str, kind: str, start: int, end: int) -> float:
    """The kind's prior, raised when a word that speaks for it stands near; lowered next to letters or digits."""
    near = _WORD.findall(text[max(0, start - CONTEXT) : start].lower()) + _WORD.findall(text[end : end + CONTEXT // 2].lower())
    s = PRIOR[kind] + 0.3 * any(w in CONTEXT_WORDS[kind] for w in near)
    glued = text[start - 1 : start].isalnum() or text[end : end + 1].isalnum()
    return round(max(0.0, min(1.0, s - 0.3 * glued)), 3)


def find(text: str) -> list[tuple[str, int, int, float]]:
    """All spans by start and kind: those of the base kinds whatever their score, the others from LEAST up and outside base spans."""
    found, taken = [], []
    for kind, a, b in propose(text):
        s = score(text, kind, a, b)
        if kind in BASE_KINDS:
            found.append((kind, a, b, s))
            taken.append((a, b))
        elif s >= LEAST and not any(a < y and x < b for x, y in taken):
            found.append((kind, a, b, s))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def redact(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """Each span becomes its kind in square brackets; of overlapping spans the first stands for all."""
    out, at = [], 0
    for kind, a, b, _ in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


SPANS = "array<struct<kind:string,start:long,end:long,score:double>>"


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, spans and redacted text of every whole text.

    Null and empty texts have no spans and the empty text. Offsets are code points, end exclusive.
    Rows are independent: repeated rows repeat, an empty table gives no rows, further columns are not read.
    """

    def work(part: pa.RecordBatch) -> dict:
        texts = texts_of(part)
        spans = [find(x) for x in texts]
        return {
            "doc_id": part.column("doc_id"),
            "spans": [[{"kind": k, "start": a, "end": b, "score": s} for k, a, b, s in x] for x in spans],
            "redacted": [redact(t, x) if x else t for t, x in zip(texts, spans, strict=True)],
        }

    return map_batches(docs.select("doc_id", text_or_empty().alias("text")), work, f"doc_id long, spans {SPANS}, redacted string")


def span_digest(docs: DataFrame) -> DataFrame:
    """Counts and digests of the spans of every document, without the texts."""
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE_KINDS))
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return find_pii(docs).select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.coalesce(F.array_max(F.transform("spans", lambda x: x["score"])), F.lit(0.0)).alias("best_score"),
    )


def redact_pii(docs: DataFrame) -> DataFrame:
    """The documents with every found span replaced by its kind; n_chars, if there, follows the text.

    Null texts stay null. All other columns pass through unread.
    """
    columns = docs.columns
    schema = docs.schema

    def work(part: pa.RecordBatch) -> dict:
        out = {name: part.column(name) for name in columns}
        texts = [None if t is None else redact(t, find(t)) for t in part.column("text").to_pylist()]
        out["text"] = texts
        if "n_chars" in out:
            out["n_chars"] = [n if t is None else len(t) for t, n in zip(texts, part.column("n_chars").to_pylist(), strict=True)]
        return out

    return map_batches(docs, work, schema)
