"""Reconstruction of Markdown from layout blocks by windows over a document's lines.

Blocks are rows with document, page, block_id, kind (text, image, table), order, a box, text, lines (with boxes, or null),
anchored (a caption that fusion has tied to an image), and for images and tables alt, path and markdown. Lines in
reading order are told apart once; what a code line takes with it (further codes, its title, what codes share) is then a
matter of positions, so no document passes through one fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dossierlake.functions import forms as X
from dossierlake.operators.rows import spread

# Patterns of lines, and the distances within which codes and titles belong together.
CODES, CHAPTER, SOURCE, PICTURE = r"^((?:\d{4}\.\d{2}\.\d{2}\b\s*)+)(.*)$", r"(?i)^CHAPTER\s+\d+", r"(?i)^\(Source:", r"(?i)^(pictures?|fig(?:ure)?|hinh|anh|ảnh)\b"
TABLE_HEADERS = r"\bgaharu tree species\b|\bscientific name\s*/?\s*genus\b|\bdimension\b.*\b(color|identification)\b|\bcabbage\b.*\bdescription\b|\bbrassica\b.*\bspecies\b"
LISTED = r"(?i)^\d+\.?\s*$|^\d+\.\s+\S+|^[ivxlcdm]+\.\s+"
NEXT_CODE, TITLE_REACH, TITLE_LINES, CAPITALS, BODY_CAPITALS, PAGE_FOOT = 45, 140, 30, 0.6, 0.45, 650
KEY = ["document", "page", "block_id"]


def capitals(c: Column) -> Column:
    """The share of a text's letters that are capitals."""
    letters = F.length(F.regexp_replace(c, r"\P{L}", ""))
    return F.when(letters == 0, 0.0).otherwise(F.length(F.regexp_replace(c, r"\P{Lu}", "")) / letters)


def text_lines(blocks: DataFrame, *more: str) -> DataFrame:
    """The lines of text blocks, each with its place in its block (i) and a box: its own, or its share of the block's; with more columns of the block."""
    kept = F.filter(F.transform(F.split("text", "\n"), lambda t: X.inline_form(t)), lambda t: t != "")
    b = blocks.filter("kind = 'text' AND text IS NOT NULL").withColumn("kept", kept)
    foot = F.btrim("text").rlike(r"^\d{1,3}$") & (F.col("y0") >= PAGE_FOOT)
    each = b.filter(~F.coalesce(foot, F.lit(False))).select(*KEY, "rank", "anchored", "x0", "x1", "y0", "y1", "lines", *more, F.size("kept").alias("of"), F.posexplode("kept").alias("i", "text"))
    height = F.greatest(F.lit(1.0), (F.col("y1") - F.col("y0")) / F.col("of"))
    own = F.get(F.col("lines"), F.col("i"))
    place = {"lx0": F.coalesce(own["x0"], F.col("x0")), "lx1": F.coalesce(own["x1"], F.col("x1")), "ly0": F.coalesce(own["y0"], F.col("y0") + height * F.col("i")), "ly1": F.coalesce(own["y1"], F.col("y0") + height * (F.col("i") + 1))}
    each = each.withColumns({k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in place.items()})
    return each.select(*KEY, "rank", "i", "anchored", "text", *place, *more)


def in_reading_order(blocks: DataFrame) -> DataFrame:
    """The blocks with rank, their place in the document: by page, by rows of about one height, from left to right, texts before images before tables."""
    top = F.coalesce("y0", F.lit(1e15))
    down = Window.partitionBy("document", "page").orderBy(top, "block_id")
    kind = F.when(F.col("kind") == "text", 0).when(F.col("kind") == "image", 1).otherwise(2)
    order = Window.partitionBy("document").orderBy("page", "_row", F.coalesce("x0", F.lit(1e15)), kind, "order", "block_id")
    # dealt by document at once, which the pages' windows are content with
    jumps = spread(blocks, "document").withColumn("_jump", F.when(top - F.coalesce(F.lag(top).over(down), top) > 4, 1).otherwise(0))
    rows = jumps.withColumn("_row", F.sum("_jump").over(down))
    return rows.withColumn("rank", F.row_number().over(order)).drop("_jump", "_row")


def in_tables(tables: Column) -> Column:
    """Whether the middle of a line lies in one of the tables of its page."""
    x, y = (F.col("lx0") + F.col("lx1")) / 2, (F.col("ly0") + F.col("ly1")) / 2
    return F.coalesce(F.exists(tables, lambda t: (x >= t["x0"]) & (x <= t["x1"]) & (y >= t["y0"] + 2) & (y <= t["y1"])), F.lit(False))


def _is_title(text: Column) -> Column:
    plain = X.fusion_form(text)
    folded = F.lower(F.translate(text, X.ACCENTED, X.PLAIN))
    no = text.rlike(CODES) | text.rlike(CHAPTER) | text.rlike(SOURCE) | plain.rlike(PICTURE) | folded.rlike(TABLE_HEADERS) | text.rlike(LISTED)
    return (text != "") & ~no & (F.size(F.split(text, r"\s+")) <= 14) & (F.length(text) <= 110) & (capitals(text) >= CAPITALS)


def told_lines(blocks: DataFrame) -> DataFrame:
    """Every text line with what it is: codes, rest (after the codes), title (could be one), ends (no title can lie beyond it), and
    role: code, title, shared or body; group is the line number of the code line that it belongs to, in_group how many codes that has."""
    ranked = in_reading_order(blocks.filter("kind IN ('text', 'image', 'table')"))
    # lines take their page's tables along, so that neither is dealt again to meet the other
    table = F.when((F.col("kind") == "table") & (F.coalesce("reason", F.lit("")) != "aligned") & F.col("x0").isNotNull(), F.struct(*[F.col(x).cast("double").alias(x) for x in ("x0", "y0", "x1", "y1")]))
    ranked = ranked.withColumn("_tables", F.collect_list(table).over(Window.partitionBy("document", "page")))
    lines = text_lines(ranked, "_tables").withColumn("in_table", in_tables(F.col("_tables"))).drop("_tables")
    d = lines.withColumn("n", F.row_number().over(Window.partitionBy("document").orderBy("rank", "i")))
    codes = F.regexp_extract_all(F.regexp_extract("text", CODES, 1), F.lit(r"\d{4}\.\d{2}\.\d{2}"), F.lit(0))
    d = d.withColumns({"codes": codes, "rest": F.btrim(F.regexp_extract("text", CODES, 2))}).withColumn("is_code", F.size("codes") > 0)
    plain, folded = X.fusion_form(F.col("text")), F.lower(F.translate("text", X.ACCENTED, X.PLAIN))
    boundary = F.col("text").rlike(CHAPTER) | F.col("text").rlike(SOURCE) | plain.rlike(PICTURE) | folded.rlike(TABLE_HEADERS) | F.col("text").rlike(LISTED)
    bodily = (F.size(F.split("text", r"\s+")) > 14) | F.col("text").rlike(r"[.!?]\s*$") | (capitals(F.col("text")) < BODY_CAPITALS)
    d = d.withColumns({"title": _is_title(F.col("text")) & ~F.col("in_table"), "ends": boundary | bodily, "rest_title": F.col("is_code") & _is_title(F.col("rest")) & ~F.col("in_table")})
    down = Window.partitionBy("document").orderBy("n")
    before = lambda c: F.lag(c).over(down)
    goes_on = before("is_code") & (before("rest") == "") & (before("page") == F.col("page")) & (F.col("ly0") - before("ly1") <= NEXT_CODE)
    d = d.withColumn("begins", F.col("is_code") & ~F.coalesce(goes_on, F.lit(False)))
    d = d.withColumn("group", F.last(F.when(F.col("begins"), F.col("n")), ignorenulls=True).over(down))
    whole = Window.partitionBy("document", "group")
    along = whole.orderBy("n")
    last_code = F.max(F.when(F.col("is_code"), F.struct("n", "page", "ly1", "rest_title", "rest"))).over(whole)
    d = d.withColumns({"last": last_code, "in_group": F.sum(F.when(F.col("is_code"), F.size("codes")).otherwise(0)).over(whole), "home": F.first(F.struct("page", "block_id")).over(along)})
    far = (F.col("page") != F.col("last.page")) | (F.greatest(F.lit(0.0), F.col("ly0") - F.col("last.ly1")) > TITLE_REACH)
    after = F.col("n") > F.col("last.n")
    first = F.when(F.col("last.rest_title"), F.col("last.n")).otherwise(F.min(F.when(after & F.col("title"), F.col("n"))).over(whole))
    stop = F.when(F.col("last.rest_title"), F.lit(None)).otherwise(F.min(F.when(after & (far | (~F.col("title") & F.col("ends"))), F.col("n"))).over(whole))
    d = d.withColumns({"first": first, "stop": stop}).withColumn("first", F.when(F.col("stop").isNull() | (F.col("first") < F.col("stop")), F.col("first")))
    # the line before a later title line is a title line itself, so its lower edge is the one to measure from
    breaks = (F.col("n") > F.col("first")) & ~(F.col("title") & (F.col("ly0") - before("ly1") <= TITLE_LINES))
    d = d.withColumn("broken", F.min(F.when(breaks, F.col("n"))).over(whole))
    titled = after & (F.col("n") >= F.col("first")) & (F.col("broken").isNull() | (F.col("n") < F.col("broken")))
    d = d.withColumn("titled", F.coalesce(titled, F.lit(False)))
    d = d.withColumn("last_title", F.coalesce(F.max(F.when(F.col("titled"), F.col("n"))).over(whole), F.col("last.n")))
    d = d.withColumn("chapter", F.col("text").rlike(CHAPTER)).withColumn("over", F.min(F.when((F.col("n") > F.col("last_title")) & F.col("chapter"), F.col("n"))).over(whole))
    number = F.btrim("text").rlike(r"^\d{1,3}$") & (F.col("ly0") >= PAGE_FOOT)
    shares = (F.col("in_group") > 1) & (F.col("n") > F.col("last_title")) & (F.col("over").isNull() | (F.col("n") < F.col("over"))) & ~number
    role = F.when(F.col("group").isNull(), "body").when(F.col("is_code"), "code").when(F.col("titled"), "title").when(shares, "shared").otherwise("body")
    d = d.withColumn("role", role)
    # what lies before a taken line in a block other than the code's own goes with it
    own_block = (F.col("home.page") == F.col("page")) & (F.col("home.block_id") == F.col("block_id"))
    block = Window.partitionBy(*KEY)
    taken = F.max(F.when((F.col("role") != "body") & ~own_block, F.col("i"))).over(block)
    gone = (F.col("role") == "body") & (F.col("i") < F.coalesce(taken, F.lit(-1)))
    structural = F.max((F.col("is_code") | F.col("chapter")).cast("int")).over(block) > 0
    quiet = F.col("anchored") & ~structural & ~F.col("text").rlike(SOURCE) & (F.col("role") == "body")
    return d.withColumn("role", F.when(gone | quiet, "dropped").otherwise(F.col("role")))


def markdown_parts(blocks: DataFrame) -> DataFrame:
    """document, rank, place and text of the parts of each document's Markdown, in order of (rank, place)."""
    d = told_lines(blocks)
    by_group = Window.partitionBy("document", "group")
    listed = lambda role, value: F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("n", value.alias("x")))).over(by_group))
    texts = lambda c: F.transform(c, lambda s: s["x"])
    d = d.withColumns({"all_codes": F.flatten(F.transform(listed("code", F.to_json("codes")), lambda s: F.from_json(s["x"], "array<string>"))), "titles": texts(listed("title", F.col("text"))), "shared": listed("shared", F.col("text"))})
    inline = F.when(F.col("last.rest_title"), F.array(F.col("last.rest"))).otherwise(F.array().cast("array<string>"))
    title = F.array_join(F.concat(inline, F.col("titles")), " ")
    group_line = F.when(F.size("all_codes") > 1, F.array(F.concat(F.lit("Grouped HS code set: "), F.array_join("all_codes", ", "), F.lit(".")))).otherwise(F.array().cast("array<string>"))
    sources = lambda x: x.rlike(SOURCE)
    # shared lines make paragraphs between the source lines, which stand alone
    folded = F.aggregate(texts(F.col("shared")), F.array().cast("array<string>"), lambda a, x: F.when(sources(x) | (F.size(a) == 0) | sources(F.coalesce(F.get(a, F.size(a) - 1), F.lit(""))), F.concat(a, F.array(x))).otherwise(F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.concat(F.element_at(a, -1), F.lit(" "), x)))))
    shared = F.when(F.size("shared") > 0, F.concat(F.array(F.lit("Shared description:")), folded)).otherwise(F.array().cast("array<string>"))
    each = F.transform("all_codes", lambda c: F.concat(F.array(F.concat(F.lit("## "), c, F.when(F.col("head_title") != "", F.concat(F.lit(" — "), F.col("head_title"))).otherwise(""))), group_line, shared))
    # headings stand at the lines that begin a group, so they are told in the same pass as the paragraphs
    d = d.withColumn("head_title", F.when(F.col("begins"), title)).withColumn("headed", F.when(F.col("begins"), F.array_join(F.flatten(each), "\n\n")))
    own = Window.partitionBy(*KEY).orderBy("i")
    # a paragraph is a run of body lines of a block that no code line, chapter or source line parts
    parts = d.filter("role IN ('body', 'code')").select(*KEY, "rank", "i", "text", "role", "chapter", "begins", "headed")
    parts = parts.withColumn("alone", F.col("chapter") | F.col("text").rlike(SOURCE) | F.col("begins"))
    parts = parts.withColumn("run", F.sum((F.col("alone") | F.coalesce(F.lag("alone").over(own), F.lit(False))).cast("int")).over(own)).filter("role = 'body' OR begins")
    shown = F.when(F.col("begins"), F.col("headed")).when(F.col("chapter"), F.concat(F.lit("# "), F.regexp_extract("text", CHAPTER, 0))).otherwise(F.col("text"))
    told = parts.groupBy("document", "rank", *KEY[1:], "begins", "run").agg(F.min("i").alias("place"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", shown.alias("t")))), lambda s: s["t"]), " ").alias("text"))
    ranked = in_reading_order(blocks.filter("kind IN ('text', 'image', 'table')"))
    caption = F.coalesce("caption", F.lit(""))
    image = F.when(F.col("path").isNotNull(), F.concat(F.lit("!["), F.regexp_replace(F.when(caption != "", caption).otherwise(F.col("block_id").cast("string")), r"[\[\]]", ""), F.lit("]("), "path", F.lit(")\n\n<!-- image-id: "), F.col("block_id").cast("string"), F.lit(" -->"))).otherwise(F.concat(F.lit("<!-- image: "), F.col("block_id").cast("string"), F.lit(" -->")))
    image = F.concat(image, F.when(caption != "", F.concat(F.lit("\n\n*Caption: "), caption, F.lit("*"))).otherwise(""))
    others = ranked.filter("(kind = 'image' AND NOT decorative) OR (kind = 'table' AND btrim(coalesce(text, '')) <> '')")
    others = others.select("document", "rank", F.lit(0).alias("place"), F.when(F.col("kind") == "image", image).otherwise(F.btrim("text")).alias("text"))
    return told.select("document", "rank", "place", "text").unionByName(others)


def markdown(blocks: DataFrame) -> DataFrame:
    """document and markdown: the parts of each document, one below the other."""
    parts = markdown_parts(blocks)
    return parts.groupBy("document").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "place", "text"))), lambda p: p["text"]), "\n\n").alias("markdown"))
