"""From layout blocks to Markdown and section maps, and the markers that check both."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CODE_LINE = re.compile(r"^\s*((?:\d{4}\.\d{2}\.\d{2}\s*)+)(.*)$")
CHAPTER_LINE = re.compile(r"^\s*CHAPTER\s+\w+", re.I)
SOURCE_LINE = re.compile(r"\(Source:", re.I)
HEADING = r"(?m)^## (\d{4}\.\d{2}\.\d{2}) (?:—|-) (.+)$"


def is_title(line: str) -> bool:
    """Capital lines of at most 14 words and 110 characters that are no code, chapter, source, table or list line."""
    s = line.strip()
    if not s or len(s) > 110 or len(s.split()) > 14 or CODE_LINE.match(s) or CHAPTER_LINE.match(s) or SOURCE_LINE.search(s) or s[0] in "|-*•#":
        return False
    letters = [c for c in s if c.isalpha()]
    return bool(letters) and sum(c.isupper() for c in letters) >= 0.6 * len(letters)


def markdown_of(lines: list[tuple[int, float, str]], gap: float = 45.0) -> str:
    """Markdown of one document's lines (page, y, text) in reading order.

    Neighbouring code lines form a group until a title comes; all codes of the group share the title and
    the text that follows, up to the next code or chapter.
    """
    out, codes, title, body, at = [], [], "", [], (0, 0.0)

    def close() -> None:
        if codes:
            shared = ["Grouped HS code set: " + ", ".join(codes)] if len(codes) > 1 else []
            for c in codes:
                out.append("\n\n".join(x for x in (f"## {c} — {title or 'UNTITLED'}", *shared, " ".join(body)) if x))
        elif body:
            out.append(" ".join(body))

    for page, y, text in lines:
        m = CODE_LINE.match(text)
        if CHAPTER_LINE.match(text):
            close()
            codes, title, body = [], "", []
            out.append(f"# {text.strip()}")
        elif m:
            own = re.findall(r"\d{4}\.\d{2}\.\d{2}", m[1])
            if not codes or title or body or page != at[0] or y - at[1] > gap:
                close()
                codes, title, body = [], "", []
            codes += [c for c in own if c not in codes]
            if is_title(m[2]):
                title = m[2].strip()
        elif codes and not body and is_title(text):
            title = f"{title} {text.strip()}".strip()
        else:
            body.append(text.strip())
        at = (page, y)
    close()
    return "\n\n".join(x for x in out if x)


def build_markdown(lines: DataFrame) -> DataFrame:
    """document and markdown, from lines (document, page, y, x, text); a document is one state machine, so it is one group."""

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values(["page", "y", "x", "text"])
        return pd.DataFrame({"document": [g["document"].iloc[0]], "markdown": [markdown_of(list(zip(g["page"], g["y"], g["text"], strict=True)))]})

    return lines.select("document", "page", "y", "x", "text").groupBy("document").applyInPandas(fold, "document string, markdown string")


def markdown_sections(docs: DataFrame) -> DataFrame:
    """document, place, code, title, body and source of every coded heading; a body ends where the next heading begins."""
    heads = F.regexp_extract_all("markdown", F.lit(HEADING), F.lit(0))
    # the text after the n-th heading, up to the next heading of any level; a document is split once, not once a heading
    parts = F.split("markdown", HEADING)
    pairs = F.arrays_zip(heads.alias("heading"), F.slice(parts, F.lit(2), F.size(parts)).alias("after"))
    each = docs.select("document", F.posexplode(pairs).alias("place", "x")).select("document", "place", "x.heading", "x.after")
    body = F.get(F.split("after", r"(?m)^#{1,2} "), F.lit(0))
    out = each.select("document", "place", F.regexp_extract("heading", HEADING, 1).alias("code"), F.trim(F.regexp_extract("heading", HEADING, 2)).alias("title"), F.trim(F.regexp_replace(body, r"^\s+|\s+$", "")).alias("body"))
    return out.withColumn("source", F.nullif(F.regexp_extract("body", r"\(Source:\s*([^)]*)\)", 1), F.lit("")))


def layout_sections(blocks: DataFrame) -> DataFrame:
    """First code of every block in reading order, first occurrence per code, with the pages up to the next section's block."""
    code = F.regexp_extract("text", r"\d{4}\.\d{2}\.\d{2}", 0)
    w = Window.partitionBy("document").orderBy("order", "block_id")
    marked = blocks.withColumns({"code": F.nullif(code, F.lit("")), "n": F.row_number().over(w)})
    nth = F.when(F.col("code").isNotNull(), F.row_number().over(Window.partitionBy("document", "code").orderBy("n")))
    opened = F.last(F.when(F.col("nth") == 1, F.col("code")), ignorenulls=True).over(Window.partitionBy("document").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    held = marked.withColumn("nth", nth).withColumn("section", opened).filter("section IS NOT NULL")
    return held.groupBy("document", F.col("section").alias("code")).agg(F.min("page").alias("page_start"), F.max("page").alias("page_end"))


def section_map(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Markdown sections with their pages; a warning where the layout does not know the code."""
    pages = layout_sections(blocks)
    return markdown_sections(docs).join(pages, ["document", "code"], "left").withColumn("warning", F.when(F.col("page_start").isNull(), F.concat(F.lit("no page range for "), F.col("code"))))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def markers(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """document, marker, passed and message of the checks of a Markdown text against its layout."""
    md = F.col("markdown")
    captions = F.regexp_extract_all(md, F.lit(r"\*Caption: ([^*]*)\*"), F.lit(1))
    chapter, first = F.regexp_instr(md, F.lit(r"(?mi)^# CHAPTER")), F.regexp_instr(md, F.lit(HEADING))
    codes = F.regexp_extract_all(md, F.lit(HEADING), F.lit(1))
    layout = layout_sections(blocks).groupBy("document").agg(F.collect_set("code").alias("laid"))
    d = docs.join(layout, "document", "left").withColumns({"laid": F.coalesce("laid", F.array().cast("array<string>")), "captions": captions, "codes": codes})
    missing = F.array_sort(F.array_except("laid", "codes"))
    checks = {
        "headers": (_count(md, r"(?m)^#{1,6} ") > 0, F.lit("at least one heading")),
        "code_order": ((chapter == 0) | (first == 0) | (chapter < first), F.lit("the chapter stands before the first code")),
        "missing_codes": (F.size(missing) == 0, F.concat(F.lit("missing: "), F.array_join(missing, ", "))),
        "caption_source": (~F.exists("captions", lambda c: F.contains(c, F.lit("(Source:"))), F.lit("no source inside a caption")),
        "caption_fusion": (~F.exists("captions", lambda c: c.rlike(r"\d{4}\.\d{2}\.\d{2}") | (F.size(F.split(F.trim(c), r"\s+")) > 25)), F.lit("captions hold no code and at most 25 words")),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("marker"), p.alias("passed"), m.alias("message")) for k, (p, m) in checks.items()])
    return d.select("document", F.explode(rows).alias("m")).select("document", "m.*")


def padded_table(markdown: str) -> str:
    """Pipe tables with ragged rows padded to their widest; code fences stay as they are."""
    out, run, fenced = [], [], False

    def close() -> None:
        if len(run) > 1 and any(re.fullmatch(r"\s*\|?[\s:|-]+\|?\s*", r) and "-" in r for r in run):
            cells = [[c.strip() for c in r.strip().strip("|").split("|")] for r in run]
            width = max(map(len, cells))
            for row in cells:
                rule = all(re.fullmatch(r":?-+:?", c) for c in row if c) and any(row)
                out.append("| " + " | ".join(row + ["---" if rule else ""] * (width - len(row))) + " |")
        else:
            out.extend(run)
        run.clear()

    for line in markdown.split("\n"):
        if line.lstrip().startswith("```"):
            fenced = not fenced
        if not fenced and line.lstrip().startswith("|"):
            run.append(line)
        else:
            close()
            out.append(line)
    close()
    return "\n".join(out)


def normalize_tables(docs: DataFrame) -> DataFrame:
    padded = F.pandas_udf(lambda s: s.map(lambda x: x if x is None else padded_table(x)), "string")
    return docs.withColumn("markdown", padded("markdown"))
