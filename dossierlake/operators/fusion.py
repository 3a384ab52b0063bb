"""Fusion of a page's blocks: duplicate images, table candidates, and captions linked to images.

Rows are blocks with document, page, block_id, kind, order, a box (x0, y0, x1, y1), text, lines, layout_only, decorative,
avg_font_size, area_ratio, page_width and page_height. Everything happens inside a page, and a page holds few
blocks, so what is folded in order is folded as one array of the page, in the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from dossierlake.functions import forms
from dossierlake.functions import geometry as G
from dossierlake.operators.rows import once, spread

PAGE = ["document", "page"]
BOX = ["x0", "y0", "x1", "y1"]
Block = Column | dict[str, Column]
# Distances, paddings and least scores of links.
PAD_X, PAD_Y, REACH, SOURCE_REACH, SAME_CLUSTER, GROUP_REACH = 120, 140, 120, 140, 42, 96
LEAST_LINK, LEAST_AFFINITY, DUPLICATE, BACKGROUND = 0.52, 0.62, 0.92, 0.85
# Tolerances of rows and columns, least rows and columns, least drawings, confidences of tables.
ROW_TOLERANCE, COLUMN_TOLERANCE, LEAST_ROWS, LEAST_COLUMNS, LEAST_DRAWINGS, APART = 8, 18, 4, 3, 12, 12
EXPLICIT, RULED, ALIGNED = 0.95, 0.62, 0.54
MOST_PAIRS = 1 << 20  # pairs of candidates looked at in one go
# Patterns of lines that are or are not captions, and what a caption's words are worth.
CODE_LINE, SOURCE_LINE, CHAPTER_LINE = r"^\d{4}\.\d{2}\.\d{2}\b", r"(?i)^\(Source:", r"(?i)^CHAPTER\s+\d+"
FIGURE_LINE = r"(?i)^(pictures?|fig(?:ure)?|hinh|ảnh|anh)\b"
CAPTION_WORD = r"\b(hinh|fig|figure|bieu do|so do|anh|chart|diagram|caption|plate|map)\b"
CAPTION_NUMBER, PART_NAME, ARROW = r"(?i)\b(hinh|fig|figure)\s*[:.-]?\s*\d+", r"(?i)\b(part|item|view|detail|section)\s*[:.-]?\s*[a-z0-9]", r"->|<-|=>|<=|[\x{2190}-\x{21FF}]|[\x{27F0}-\x{27FF}]"
SHORT_LABEL, LETTER_LABEL = r"^[A-Za-z0-9()._/\- ]{1,16}$", r"^[A-Za-z]\d{0,2}$"


def _boxed(c: Column) -> Column:
    return F.struct(*[c[x].alias(x) for x in BOX])


def _columns(p: str) -> dict[str, Column]:
    """A block given by the prefix of its columns, read like one that is a struct."""
    return {x: F.col(f"{p}{x}") for x in (*BOX, "page_width", "page_height")}


def _gap_squared(a: Block, b: Block) -> Column:
    dx = F.greatest(F.lit(0), a["x0"] - b["x1"], b["x0"] - a["x1"])
    dy = F.greatest(F.lit(0), a["y0"] - b["y1"], b["y0"] - a["y1"])
    return dx * dx + dy * dy


def _gap(a: Block, b: Block) -> Column:
    return F.sqrt(_gap_squared(a, b))


def _kept_in_order(items: Column, kind: str, meets) -> Column:
    """The items of an array, in its order, that meet none of those kept before them."""
    none = F.array().cast(kind)
    return F.aggregate(items, none, lambda kept, x: F.when(F.exists(kept, lambda k: meets(k, x)), kept).otherwise(F.concat(kept, F.array(x))))


# -- tables --------------------------------------------------------------------------------------------------


def bands(values: Column, tolerance: float) -> Column:
    """How many groups sorted coordinates fall into; one joins the group before it if it lies within the tolerance of its mean."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("sum"), F.lit(0).alias("held"))

    def step(s: Column, v: Column) -> Column:
        begins = (s["n"] == 0) | (F.abs(s["sum"] / F.greatest(F.lit(1), s["held"]) - v) > tolerance)
        return F.struct(
            F.when(begins, s["n"] + 1).otherwise(s["n"]).alias("n"),
            F.when(begins, v).otherwise(s["sum"] + v).alias("sum"),
            F.when(begins, 1).otherwise(s["held"] + 1).alias("held"),
        )

    return F.aggregate(F.array_sort(values), start, step, lambda s: s["n"])


def table_candidates(blocks: DataFrame) -> DataFrame:
    """Tables of each page before merging: those the parser gave, the frame of many drawings, lines that stand in rows and columns."""
    given = blocks.filter("kind = 'table'").select(*PAGE, F.lit("given").alias("reason"), F.lit(EXPLICIT).alias("confidence"), F.col("block_id").alias("place"), F.lit(None).cast("int").alias("n_rows"), F.lit(None).cast("int").alias("n_columns"), *BOX)
    around = lambda cond: [f(F.when(cond, F.col(x))).alias(x) for f, x in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))]
    is_drawing, is_text = F.col("kind") == "drawing", F.col("kind") == "text"
    ruled = blocks.groupBy(*PAGE).agg(F.sum(is_drawing.cast("int")).alias("drawings"), F.sum(is_text.cast("int")).alias("texts"), *around(is_drawing))
    ruled = ruled.filter((F.col("drawings") >= LEAST_DRAWINGS) & (F.col("texts") >= LEAST_ROWS))
    ruled = ruled.select(*PAGE, F.lit("ruled").alias("reason"), F.lit(RULED).alias("confidence"), F.lit(0).cast("long").alias("place"), F.lit(None).cast("int").alias("n_rows"), F.lit(None).cast("int").alias("n_columns"), *BOX)
    lines = blocks.filter(is_text).select(*PAGE, F.explode("lines").alias("l")).select(*PAGE, *[F.col(f"l.{x}").alias(x) for x in BOX])
    middle = (F.col("y0") + F.greatest(F.col("y1") - F.col("y0"), F.lit(0)) / 2).cast("double")
    grid = lines.groupBy(*PAGE).agg(bands(F.collect_list(middle), ROW_TOLERANCE).alias("n_rows"), bands(F.collect_list(F.col("x0").cast("double")), COLUMN_TOLERANCE).alias("n_columns"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    grid = grid.filter((F.col("n_rows") >= LEAST_ROWS) & (F.col("n_columns") >= LEAST_COLUMNS))
    grid = grid.select(*PAGE, F.lit("aligned").alias("reason"), F.lit(ALIGNED).alias("confidence"), F.lit(1).cast("long").alias("place"), "n_rows", "n_columns", *BOX)
    return given.unionByName(ruled).unionByName(grid)


def tables(blocks: DataFrame) -> DataFrame:
    """The tables of each page: of candidates nearer than APART the surest stays, among equals the one with the smaller place, then by box."""
    columns = ["confidence", "place", "reason", "n_rows", "n_columns", *BOX]
    fields = table_candidates(blocks).select(*PAGE, F.struct((-F.col("confidence")).alias("less"), "place", *BOX, "reason", "n_rows", "n_columns", "confidence").alias("c"))
    whole = fields.groupBy(*PAGE).agg(F.array_sort(F.collect_list("c")).alias("all"))
    kept = _kept_in_order(F.col("all"), whole.schema["all"].dataType.simpleString(), lambda k, c: _gap(k, c) < APART)
    return whole.select(*PAGE, F.explode(kept).alias("c")).select(*PAGE, *[F.col(f"c.{x}").alias(x) for x in columns])


# -- images --------------------------------------------------------------------------------------------------


def _same_image(a: Column, b: Column) -> Column:
    w = F.greatest(F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]), F.lit(0))
    h = F.greatest(F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]), F.lit(0))
    size = lambda c: F.greatest(c["x1"] - c["x0"], F.lit(0)) * F.greatest(c["y1"] - c["y0"], F.lit(0))
    whole = size(a) + size(b) - w * h
    middle = lambda c, x: c[f"{x}0"] + F.greatest(c[f"{x}1"] - c[f"{x}0"], F.lit(0)) / 2
    dx, dy = middle(a, "x") - middle(b, "x"), middle(a, "y") - middle(b, "y")
    alike = lambda x: F.abs((a[f"{x}1"] - a[f"{x}0"]) - (b[f"{x}1"] - b[f"{x}0"])) <= 8
    return ((whole > 0) & (w * h >= DUPLICATE * whole)) | ((F.sqrt(dx * dx + dy * dy) <= 6) & alike("x") & alike("y"))


def _seen(blocks: DataFrame) -> list[str]:
    return [x for x in ("decorative", "area_ratio", "page_width", "page_height") if x in blocks.columns]


def _images_in_order(blocks: DataFrame, are: Column) -> Column:
    """Of a page: its images, largest first."""
    size = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return F.array_sort(F.collect_list(F.when(are, F.struct((-size).alias("less"), "block_id", *BOX, *_seen(blocks)))))


def _that_stay(whole: DataFrame, blocks: DataFrame, *more: str) -> DataFrame:
    """The images of each page's array `all` that stay, with more of the page's columns."""
    kept = _kept_in_order(F.col("all"), whole.schema["all"].dataType.simpleString(), _same_image)
    return whole.select(*PAGE, *more, F.explode(kept).alias("c")).select(*PAGE, *more, *[F.col(f"c.{x}").alias(x) for x in ("block_id", *BOX, *_seen(blocks))])


def kept_images(blocks: DataFrame) -> DataFrame:
    """The images that stay, with what links look at: largest first, one goes if one that stays covers nearly the same place."""
    images = blocks.filter("kind = 'image' AND x0 IS NOT NULL")
    return _that_stay(images.groupBy(*PAGE).agg(_images_in_order(blocks, F.lit(True)).alias("all")), blocks)


def distinct_images(blocks: DataFrame) -> DataFrame:
    """document, page, block_id of the images that stay."""
    return kept_images(blocks).select(*PAGE, "block_id")


# -- caption candidates ----------------------------------------------------------------------------------------


def text_lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\n"), lambda x: F.btrim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")


def _short(c: Column) -> Column:
    return (c != "") & ~c.rlike(SOURCE_LINE) & ~c.rlike(CODE_LINE) & (F.size(F.split(c, r"\s+")) <= 25)


def _let(value: Column, body) -> Column:
    """body of a value that is told once, however often it stands there; inside lambdas nothing else would share it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def caption_text(c: Column) -> Column:
    """What of a block's text could be a caption: the line after a code line, else its lines but chapters, sources and page numbers; empty if none or too long."""
    said = lambda x: _let(x, lambda v: F.when(_short(v), v).otherwise(""))
    plain = lambda lines: F.filter(lines, lambda x: ~x.rlike(CHAPTER_LINE) & ~x.rlike(SOURCE_LINE) & ~x.rlike(r"^\d{1,3}$"))
    code = lambda lines: F.array_position(F.transform(lines, lambda x: x.rlike(CODE_LINE)), True).cast("int")
    after = lambda lines, at: F.coalesce(F.get(lines, at), F.lit(""))
    return _let(text_lines(c), lambda lines: _let(code(lines), lambda at: F.when(at > 0, said(after(lines, at))).otherwise(said(F.array_join(plain(lines), " ")))))


def caption_kind(c: Column) -> Column:
    kind = lambda lines: (
        F.when(F.exists(lines, lambda x: x.rlike(CODE_LINE)), "section-title")
        .when(F.exists(lines, lambda x: forms.fusion_form(x).rlike(FIGURE_LINE)), "figure-caption")
        .otherwise("generic")
    )
    return _let(text_lines(c), kind)


def caption_candidates(blocks: DataFrame) -> DataFrame:
    """Texts that may be captions: document, page, candidate, parent, line, order, text, kind, avg_font_size and a box.

    A block of several lines gives a candidate for each line that could be a caption, with an order of its own
    between its block's and the next; if none could, or the block has one line, the block is the candidate (line null).
    """
    fit = blocks.filter("x0 IS NOT NULL AND text IS NOT NULL AND kind IN ('text', 'caption', 'unknown') AND (layout_only OR kind = 'caption')")
    fit = once(fit, {"own": caption_text(F.col("text"))}).filter("own <> '' AND length(own) <= 500")
    lines = F.filter(F.transform("lines", lambda l, i: F.struct(i.alias("line"), caption_text(l["text"]).alias("text"), *[l[x].alias(x) for x in BOX])), lambda l: l["text"] != "")
    several = F.when(F.size("lines") > 1, lines).otherwise(F.array().cast("array<struct<line:int,text:string,x0:bigint,y0:bigint,x1:bigint,y1:bigint>>"))
    alone = F.array(F.struct(F.lit(None).cast("int").alias("line"), F.col("text").alias("text"), *BOX))
    parts = once(fit, {"parts": several}).select(*PAGE, "block_id", "order", "avg_font_size", F.explode(F.when(F.size("parts") > 0, F.col("parts")).otherwise(alone)).alias("p"))
    candidate = F.concat(F.col("block_id").cast("string"), F.coalesce(F.concat(F.lit("-line-"), F.col("p.line").cast("string")), F.lit("")))
    return parts.select(*PAGE, candidate.alias("candidate"), F.col("block_id").alias("parent"), F.col("p.line").alias("line"), (F.col("order") + F.coalesce(F.col("p.line"), F.lit(0)) / 100).alias("order"), F.col("p.text").alias("text"), caption_kind(F.col("p.text")).alias("kind"), "avg_font_size", *[F.col(f"p.{x}").alias(x) for x in BOX])


def _clusters_of(pages: np.ndarray, kind: np.ndarray, box: dict[str, np.ndarray], reach: float) -> np.ndarray:
    """For rows whose pages (numbered) lie together: the place of the first row of each one's connected group.

    Pairs are held MOST_PAIRS at a time (a row's own at least), of which those that are near stay.
    """
    n = len(pages)
    first = np.searchsorted(pages, pages)  # where each row's page begins
    many = np.searchsorted(pages, pages, "right") - first
    ends = np.cumsum(many)
    middle = {x: box[f"{x}0"] + np.maximum(box[f"{x}1"] - box[f"{x}0"], 0) / 2 for x in "xy"}
    left, right, at = [], [], 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + MOST_PAIRS, "right")))
        a = np.repeat(np.arange(at, to), many[at:to])
        b = np.arange(len(a)) - np.repeat(ends[at:to] - many[at:to] - (ends[at - 1] if at else 0), many[at:to]) + first[a]
        apart = lambda x: np.maximum(0, np.maximum(box[f"{x}0"][a] - box[f"{x}1"][b], box[f"{x}0"][b] - box[f"{x}1"][a]))  # noqa: B023, E731
        near = (np.hypot(apart("x"), apart("y")) <= reach) | (np.hypot(middle["x"][a] - middle["x"][b], middle["y"][a] - middle["y"][b]) <= reach * 1.5)
        near = (near & (kind[a] == kind[b])) | (a == b)
        left.append(a[near])
        right.append(b[near])
        at = to
    a, b = np.concatenate(left), np.concatenate(right)
    starts = np.searchsorted(a, np.arange(n))
    least = np.arange(n)
    while True:  # the least place reaches a neighbour further each time, and what that one has reached
        then = np.minimum.reduceat(least[b], starts)
        then = then[then]
        if (then == least).all():
            return least
        least = then


def candidate_clusters(candidates: DataFrame, reach: float = SAME_CLUSTER) -> DataFrame:
    """The candidates with their number n on the page (by order) and `cluster`, the first candidate of the connected group of near ones of one kind on the page.

    Pages are sorted by the window that numbers them, which deals them only where they do not lie together yet, and worked on as
    many at a time as a batch brings; one that a batch cuts waits for the next.
    Rows without a document or page are on no page.
    """
    placed = candidates.withColumn("n", F.row_number().over(Window.partitionBy(*PAGE).orderBy("order", "candidate")))
    schema = T.StructType([*placed.schema.fields, T.StructField("cluster", T.IntegerType())])

    def told(rows: pa.Table, pages: np.ndarray) -> pa.RecordBatch:
        box = {x: rows.column(x).to_numpy().astype(float) for x in BOX}
        kind = rows.column("kind").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        cluster = _clusters_of(pages, kind, box, reach)
        first = np.searchsorted(pages, pages)
        out = rows.append_column("cluster", pa.array(cluster - first + 1, pa.int32()))
        return out.combine_chunks().to_batches()[0]

    def numbers(rows: pa.Table) -> np.ndarray:
        document = rows.column("document").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        page = rows.column("page").to_numpy()
        return np.concatenate([[0], np.cumsum((document[1:] != document[:-1]) | (page[1:] != page[:-1]))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            batch = batch.filter(pc.and_(*[pc.is_valid(batch.column(x)) for x in PAGE]))  # here, since a filter would part the shuffle from that of other branches
            if not batch.num_rows:
                continue
            waiting.append(batch)
            if len(waiting) > 1 and _place(batch, -1) == _place(waiting[0], 0):
                continue  # all of it is one page so far
            rows = pa.Table.from_batches(waiting)
            pages = numbers(rows)
            whole = int(np.searchsorted(pages, pages[-1]))
            if whole:
                yield told(rows.slice(0, whole), pages[:whole])
            waiting = rows.slice(whole).to_batches()
        if waiting:
            rows = pa.Table.from_batches(waiting)
            yield told(rows, numbers(rows))

    return placed.mapInArrow(work, schema)


def _place(batch: pa.RecordBatch, at: int) -> tuple:
    return tuple(batch.column(x)[at if at >= 0 else batch.num_rows + at].as_py() for x in PAGE)


def caption_clusters(candidates: DataFrame) -> DataFrame:
    """One row a cluster: its box, its members' captions in reading order, kind of the first, mean font size, members."""
    told = candidates.select(*PAGE, "candidate", "order", "text", "kind", "avg_font_size", *BOX)
    placed = spread(candidate_clusters(told).drop("order"), *PAGE)  # by page, as what they are joined with
    own = [*PAGE, "cluster"]
    down = Window.partitionBy(*own).orderBy("y0", "x0", "n")
    new_row = (F.col("y0") - F.coalesce(F.lag("y0").over(down), F.col("y0")) > 4).cast("int")
    rows = placed.withColumn("new_row", new_row).withColumn("row", F.sum("new_row").over(down))
    member = F.struct("row", "x0", "n", "candidate", caption_text(F.col("text")).alias("caption"), F.col("text").alias("full"))
    whole = rows.groupBy(*own).agg(F.array_sort(F.collect_list(member)).alias("m"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.avg("avg_font_size").alias("avg_font_size"))
    text = F.array_join(F.filter(F.transform("m", lambda m: m["caption"]), lambda x: x != ""), " ")
    return whole.select(*own, *BOX, F.btrim(F.regexp_replace(text, r"\s+", " ")).alias("text"), caption_kind(F.col("m")[0]["full"]).alias("kind"), "avg_font_size", F.size("m").alias("n_members"), F.array_join(F.transform("m", lambda m: m["candidate"]), "|").alias("members"))


# -- links -----------------------------------------------------------------------------------------------------


def keyword_score(text: Column) -> Column:
    arrow = F.when(text.rlike(ARROW), 0.08).otherwise(0.0)
    points = lambda plain: F.when(plain.rlike(CAPTION_WORD), 0.24).otherwise(0.0) + F.when(plain.rlike(CAPTION_NUMBER), 0.08).otherwise(0.0) + F.when(plain.rlike(PART_NAME), 0.06).otherwise(0.0)
    return F.least(_let(forms.fusion_form(text), points) + arrow, F.lit(0.34))


def font_score(size: Column, members: Column, text: Column) -> Column:
    return F.when((size > 0) & (size <= 10.5), 0.06).otherwise(0.0) + F.when((members <= 3) & (F.length(text) <= 160), 0.05).otherwise(0.0)


def symbol_score(text: Column, gap: Column) -> Column:
    trimmed = F.btrim(text)
    return F.when(gap > 100, 0.0).when(trimmed.rlike(SHORT_LABEL), 0.1).when(trimmed.rlike(LETTER_LABEL), 0.12).otherwise(0.0)


def _overlap(a: Block, b: Block, x: str) -> Column:
    a0, a1, b0, b1 = a[f"{x}0"], a[f"{x}1"], b[f"{x}0"], b[f"{x}1"]
    return F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0)) / F.greatest(F.lit(1), F.least(a1 - a0, b1 - b0))


def direction_score(a: str, b: str) -> Column:
    """Where a cluster (b) stands to an image (a): below, above, beside, or on it."""
    sideways, upright = (_overlap(_columns(a), _columns(b), x) for x in "xy")
    beside = (F.col(f"{b}x1") <= F.col(f"{a}x0")) | (F.col(f"{b}x0") >= F.col(f"{a}x1"))
    return (
        F.when((F.col(f"{b}y0") >= F.col(f"{a}y1")) & (sideways >= 0.25), 0.18)
        .when((F.col(f"{b}y1") <= F.col(f"{a}y0")) & (sideways >= 0.25), 0.1)
        .when(beside & (upright >= 0.15), 0.1)
        .when(G.intersects(a, b), 0.12)
        .otherwise(0.0)
    )


def _prefixed(df: DataFrame, p: str) -> DataFrame:
    return df.select(*PAGE, *[F.col(c).alias(f"{p}{c}") for c in df.columns if c not in PAGE])


def _in_context(a: Block, b: Block, reach: float) -> Column:
    """Whether b touches a's padded box, or lies within the reach of a."""
    x0, y0 = F.greatest(F.lit(0), a["x0"] - PAD_X), F.greatest(F.lit(0), a["y0"] - PAD_Y)
    x1, y1 = F.least(a["page_width"], a["x1"] + PAD_X), F.least(a["page_height"], a["y1"] + PAD_Y)
    touches = (x0 <= b["x1"]) & (x1 >= b["x0"]) & (y0 <= b["y1"]) & (y1 >= b["y0"])
    return touches | (_gap(a, b) <= reach)


def _caption_score() -> Column:
    """The score of a cluster (b_*, with its `words`) as the caption of an image (a_*)."""
    gap = F.sqrt(G.gap_squared("a_", "b_"))
    w, h = F.col("a_x1") - F.col("a_x0"), F.col("a_y1") - F.col("a_y0")
    near = G.clamp(1 - gap / F.greatest(F.lit(120.0), F.sqrt((w * w + h * h).cast("double")) * 0.75), F.lit(0.0), F.lit(1.0))
    points = near * 0.56 + F.col("b_words") + direction_score("a_", "b_") + font_score(F.col("b_avg_font_size"), F.col("b_n_members"), F.col("b_text")) + symbol_score(F.col("b_text"), gap)
    passed = (F.col("b_kind") == "section-title") & (F.col("b_y0") > F.col("a_y1") + 8)
    return F.round(F.when(passed, 0.0).otherwise(G.clamp(points, F.lit(0.0), F.lit(1.0))), 6)


def _beside(images: DataFrame, clusters: DataFrame, how: str) -> DataFrame:
    """Images (a_*) and the clusters (b_*) in their context, with their score."""
    worded = once(clusters, {"words": keyword_score(F.col("text"))})  # once a cluster, not once a pair
    a, b = _prefixed(images, "a_"), _prefixed(worded, "b_").withColumnsRenamed({x: f"b_{x}" for x in PAGE})
    near = _in_context(_columns("a_"), _columns("b_"), REACH)
    pairs = a.join(b, (F.col("document") == F.col("b_document")) & (F.col("page") == F.col("b_page")) & near, how)
    return once(pairs, {"score": _caption_score()})


def caption_scores(images: DataFrame, clusters: DataFrame) -> DataFrame:
    """document, page, block_id, cluster, score, caption, members for each image and each cluster near it that is good enough."""
    told = _beside(images.filter("NOT decorative AND x0 IS NOT NULL"), clusters, "inner")
    return told.select(*PAGE, F.col("a_block_id").alias("block_id"), F.col("b_cluster").alias("cluster"), "score", F.col("b_text").alias("caption"), F.col("b_members").alias("members")).filter(F.col("score") >= LEAST_LINK)


def affinity(a: Block, b: Block) -> Column:
    """How much two images look like parts of one figure: near, in line, of one size; 0 beyond GROUP_REACH."""
    gap = _gap(a, b)
    near = G.clamp(1 - gap / GROUP_REACH, F.lit(0.0), F.lit(1.0))
    in_line = F.greatest(_overlap(a, b, "x"), _overlap(a, b, "y"))
    size = lambda p: F.greatest(F.lit(1), (p["x1"] - p["x0"]) * (p["y1"] - p["y0"]))
    alike = F.least(size(a), size(b)) / F.greatest(size(a), size(b))
    return F.round(F.when(gap > GROUP_REACH, 0.0).otherwise(G.clamp(near * 0.45 + in_line * 0.35 + alike * 0.2, F.lit(0.0), F.lit(1.0))), 6)


#: The images of one number on their page, which share their link.
_SAME_NUMBER = [*PAGE, "block_id"]


def _noted_images(blocks: DataFrame) -> DataFrame:
    """The images that stay and are no decoration, with their `shape` (no picture of nearly a whole page) and the nearest source note in their context.

    A page is one row with its images and notes, so nothing is joined and no pair is written out.
    """
    is_note = (F.col("kind") == "text") & F.exists(text_lines(F.col("text")), lambda x: x.rlike(SOURCE_LINE))
    rows = blocks.filter(F.col("x0").isNotNull() & ((F.col("kind") == "image") | is_note))
    whole = rows.groupBy(*PAGE).agg(_images_in_order(blocks, F.col("kind") == "image").alias("all"), F.collect_list(F.when(F.col("kind") == "text", F.struct("block_id", *BOX))).alias("notes"))
    shape = ~F.coalesce(F.col("area_ratio") >= BACKGROUND, F.lit(False))
    near = F.filter("notes", lambda n: _in_context(_columns(""), n, SOURCE_REACH))
    nearest = F.array_min(F.transform(near, lambda n: F.struct(_gap_squared(_columns(""), n).alias("gap"), n["block_id"].alias("block_id"))))
    placed = F.col("document").isNotNull() & F.col("page").isNotNull()
    told = _that_stay(whole, blocks, "notes").filter("NOT decorative").withColumn("shape", shape)
    return told.withColumn("note", F.when(F.col("shape") & placed, nearest)).drop("notes")


def _by_caption(images: DataFrame, clusters: DataFrame) -> DataFrame:
    """Images with their link to the best cluster that is good enough, else to their note."""
    pairs = _beside(images, clusters, "left")
    pairs = pairs.select(*PAGE, *[F.col(f"a_{x}").alias(x) for x in ("block_id", *BOX, "shape", "note")], F.when(F.col("score") >= LEAST_LINK, F.struct((-F.col("score")).alias("less"), F.col("b_cluster").alias("cluster"), F.col("b_text").alias("caption"), F.col("b_members").alias("members"))).alias("link"))
    first = Window.partitionBy(*_SAME_NUMBER, *BOX).orderBy(F.col("link").isNull(), F.col("link.less"), F.col("link.cluster"))
    told = pairs.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    same = Window.partitionBy(*_SAME_NUMBER)  # in the order of the window before
    told = told.withColumn("link", F.min("link").over(same))
    told = told.withColumn("note", F.min(F.when(F.col("link").isNull(), F.col("note"))).over(same))
    by = lambda caption, note: F.when(F.col("link").isNotNull(), caption).when(F.col("note").isNotNull(), note)
    return told.select(*PAGE, "block_id", *BOX, "shape", by(F.lit("caption"), F.lit("source")).alias("how"), by(-F.col("link.less"), F.lit(0.58)).alias("score"), F.col("link.caption").alias("caption"), by(F.col("link.members"), F.col("note.block_id").cast("string")).alias("source"))


def _by_peer(images: DataFrame) -> DataFrame:
    """Images without a link take over the caption of the linked one of their page that they look most like."""
    peer = F.struct("block_id", *BOX, "score", "caption")
    linked = F.collect_list(F.when(F.col("how").isNotNull() & F.col("shape"), peer)).over(Window.partitionBy(*PAGE))
    alone = F.col("how").isNull() & F.col("shape") & F.col("document").isNotNull() & F.col("page").isNotNull()
    likes = F.transform("peers", lambda p: F.struct((-affinity(_columns(""), p)).alias("less"), p["block_id"].alias("block_id"), p["score"].alias("score"), p["caption"].alias("caption")))
    best = F.array_min(F.filter(likes, lambda p: p["less"] <= -LEAST_AFFINITY))
    told = images.withColumn("peers", linked).withColumn("peer", F.when(alone, best)).drop("peers")
    told = told.withColumn("peer", F.min("peer").over(Window.partitionBy(*_SAME_NUMBER)))
    score = F.round(G.clamp(F.col("peer.score") * -F.col("peer.less"), F.lit(0.0), F.lit(0.95)), 6)
    link = {"how": F.lit("group"), "score": score, "caption": F.col("peer.caption"), "source": F.col("peer.block_id").cast("string")}
    return told.withColumns({k: F.when(F.col("peer").isNotNull(), v).otherwise(F.col(k)) for k, v in link.items()}).drop("peer")


def linked_images(blocks: DataFrame, rounds: int = 1) -> DataFrame:
    """document, page, block_id, how, score, caption, source for every distinct image that is no decoration.

    how: `caption` where a cluster of texts is good enough; `source` where only a source note is near; `group` where the
    image takes over the caption of the linked image it belongs to; null where nothing links it. Pictures of nearly a
    whole page take part in neither of the last two. Ties go to the smaller cluster, block or image. Each round
    carries captions one image further through a group; one round is what fusion does.
    """
    # images lie by page and stay there: only what Python has told of the clusters is dealt again
    told = _by_caption(_noted_images(blocks), caption_clusters(caption_candidates(blocks)))
    for _ in range(rounds):
        told = _by_peer(told)
    return told.select(*PAGE, "block_id", "how", "score", "caption", "source")
