"""Layout operators: page metrics and routes, artefacts, links between images and texts, clusters, greedy dedupe."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dossierlake.functions import geometry as G

PAGE_WIDTH, PAGE_HEIGHT = 600, 400


def keys(blocks: DataFrame) -> list[str]:
    """What tells a page: its number, with the document where blocks of several are given, since pages begin anew in each."""
    return ["document", "page"] if "document" in blocks.columns else ["page"]


def page_metrics(blocks: DataFrame) -> DataFrame:
    """Per page: blocks by kind, text characters, share of the page that images cover (in thousandths)."""
    is_image = F.col("kind") == "image"
    return blocks.groupBy(*keys(blocks)).agg(
        F.count(F.lit(1)).alias("n_blocks"),
        F.sum(is_image.cast("long")).alias("n_images"),
        F.sum(F.when(~is_image, F.col("n_chars")).otherwise(0)).cast("long").alias("n_chars"),
        F.floor(F.sum(F.when(is_image, G.area()).otherwise(0)) * 1000 / (PAGE_WIDTH * PAGE_HEIGHT)).cast("long").alias("coverage"),
    )


def page_route(metrics: DataFrame) -> DataFrame:
    """Scanned pages and pages with images beside little text take the accurate route."""
    scanned = ((F.col("n_chars") < 120) & (F.col("coverage") >= 350)) | ((F.col("n_chars") == 0) & (F.col("n_images") > 0))
    reasons = F.array_compact(F.array(F.when(scanned, "scanned"), F.when((F.col("n_images") > 0) & (F.col("n_chars") < 240), "images"), F.when(F.col("n_blocks") >= 6, "dense")))
    return metrics.select(*keys(metrics), scanned.alias("scanned"), F.array_join(reasons, "|").alias("reasons"), F.when(F.size(reasons) > 0, "accurate").otherwise("fast").alias("route"))


def prefixed(df: DataFrame, p: str) -> DataFrame:
    return df.select(*[F.col(c).alias(c if c in ("document", "page") else f"{p}{c}") for c in df.columns])


def page_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Blocks of the same page side by side, as a_* and b_*; a page holds few blocks, so its pairs are few."""
    return prefixed(left, "a_").join(prefixed(right, "b_"), keys(left))


def repeated_positions(blocks: DataFrame, least_pages: int = 3) -> DataFrame:
    """Images that stand at the same rounded place on many pages."""
    keyed = blocks.filter("kind = 'image'").withColumn("place", G.position_key())
    own = keys(blocks)
    often = keyed.groupBy(*own[:-1], "place").agg(F.countDistinct("page").alias("n_pages")).filter(F.col("n_pages") >= least_pages)
    return keyed.join(often, [*own[:-1], "place"]).select(*own, "block_id", "n_pages")


def artefacts(blocks: DataFrame) -> DataFrame:
    """Why an image is decoration rather than content: tiny, an edge icon, elongated, or nearly the whole page."""
    share = G.area() / (PAGE_WIDTH * PAGE_HEIGHT)
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    edge = (F.col("x0") < 40) | (F.col("y0") < 40) | (F.col("x1") > PAGE_WIDTH - 40) | (F.col("y1") > PAGE_HEIGHT - 40)
    reasons = F.array_compact(F.array(F.when((share <= 0.00225) | (F.least(w, h) <= 24), "icon"), F.when((share <= 0.005) & edge, "edge_icon"), F.when((10 * w >= 22 * h) | (10 * h >= 22 * w), "elongated"), F.when(share >= 0.9, "full_page")))
    return blocks.filter("kind = 'image'").select(*keys(blocks), "block_id", F.array_join(reasons, "|").alias("reasons"), (F.size(reasons) > 0).alias("decorative"))


def nearest(blocks: DataFrame) -> DataFrame:
    """Each image's nearest text block on its page, by gap, then id."""
    pairs = page_pairs(blocks.filter("kind = 'image'"), blocks.filter("kind = 'text'"))
    w = Window.partitionBy(*keys(blocks), "a_block_id").orderBy("gap", "b_block_id")
    return pairs.withColumn("gap", G.gap_squared("a_", "b_")).withColumn("n", F.row_number().over(w)).filter("n = 1").select(*keys(blocks), F.col("a_block_id").alias("image"), F.col("b_block_id").alias("text"), "gap")


def caption_links(blocks: DataFrame, most_gap: int = 120) -> DataFrame:
    """The best caption of each image: near, below rather than above, overlapping sideways, short. Scores are whole thousandths."""
    pairs = page_pairs(blocks.filter("kind = 'image'"), blocks.filter("kind = 'text'")).withColumn("gap", G.gap_squared("a_", "b_")).filter(F.col("gap") <= most_gap * most_gap)
    below, above = F.col("b_y0") >= F.col("a_y1"), F.col("b_y1") <= F.col("a_y0")
    sideways = (F.least("a_x1", "b_x1") > F.greatest("a_x0", "b_x0")).cast("int")
    score = 560 - F.floor(F.lit(560) * F.col("gap") / (most_gap * most_gap)) + F.when(below, 180).when(above, 100).otherwise(120) + 100 * sideways + F.when(F.col("b_n_chars") <= 80, 110).otherwise(0)
    w = Window.partitionBy(*keys(blocks), "a_block_id").orderBy(F.col("score").desc(), "b_block_id")
    return pairs.withColumn("score", score.cast("long")).filter("score >= 520").withColumn("n", F.row_number().over(w)).filter("n = 1").select(*keys(blocks), F.col("a_block_id").alias("image"), F.col("b_block_id").alias("caption"), "score")


def near_any(blocks: DataFrame, most_gap: int = 96) -> DataFrame:
    """Images with any short text near them."""
    own = keys(blocks)
    texts = prefixed(blocks.filter("kind = 'text' AND n_chars <= 240"), "b_").withColumnsRenamed({k: f"b_{k}" for k in own})
    images = prefixed(blocks.filter("kind = 'image'"), "a_")
    met = G.gap_squared("a_", "b_") <= most_gap * most_gap
    for k in own:
        met = met & (F.col(k) == F.col(f"b_{k}"))
    return images.join(texts, met, "left_semi").select(*own, F.col("a_block_id").alias("block_id"))


def _by_page(blocks: DataFrame, columns: list[str], fold, result: str) -> DataFrame:
    """fold over the rows of every page, which gives (block_id, result); neighbouring pages share a group, since a call for each page would cost more than its work.

    A group is 256 pages of one document; ids and results stay whole numbers, null or not.
    """
    own = keys(blocks)
    names = [*own, "block_id", result]

    def pages(group: pd.DataFrame) -> pd.DataFrame:
        by_page: dict[tuple, list[dict]] = {}
        for r in group.to_dict("records"):
            by_page.setdefault(tuple(r[k] for k in own), []).append(r)
        rows = [(*page, *row) for page, rows in by_page.items() for row in fold(rows)]
        # column by column, since a null among whole numbers would make them floating
        return pd.DataFrame({name: pd.Series([r[i] for r in rows], dtype="object" if name == "document" else "Int64") for i, name in enumerate(names)})

    types = ["document string"] * (len(own) - 1) + ["page long", "block_id long", f"{result} long"]
    return blocks.select(*own, *columns).groupBy(*own[:-1], F.floor(F.col("page") / 256).alias("_pages")).applyInPandas(lambda _, g: pages(g), ", ".join(types))


def clusters(blocks: DataFrame, most_gap: int = 42, least_points: int = 1) -> DataFrame:
    """Density clusters of near blocks of one kind on a page: block_id and cluster (its smallest id).

    A block with fewer than least_points neighbours (itself included) is a cluster of its own when it is
    met first, and only joins a cluster that reaches it; with least_points of 1 or 2 clusters are connected groups.
    Blocks are met by id.
    """

    def join_up(rows: list[dict]) -> list[tuple]:
        rows = sorted(rows, key=lambda r: r["block_id"])

        def near(i: int) -> list[int]:
            a = rows[i]
            gap = lambda b: max(0, a["x0"] - b["x1"], b["x0"] - a["x1"]) ** 2 + max(0, a["y0"] - b["y1"], b["y0"] - a["y1"]) ** 2
            return [j for j, b in enumerate(rows) if a["kind"] == b["kind"] and gap(b) <= most_gap * most_gap]

        around = [near(i) for i in range(len(rows))]
        core = [len(x) >= least_points for x in around]
        of: dict[int, int] = {}
        spread = [False] * len(rows)
        for i in range(len(rows)):
            if i in of:
                continue
            of[i], waiting = i, [i] if core[i] else []
            while waiting:
                k = waiting.pop()
                if spread[k]:
                    continue
                spread[k] = True
                for j in around[k]:
                    if j not in of:
                        of[j] = i
                        if core[j]:
                            waiting.append(j)
        return [(r["block_id"], rows[of[i]]["block_id"]) for i, r in enumerate(rows)]

    return _by_page(blocks, ["block_id", "kind", "x0", "y0", "x1", "y1"], join_up, "cluster")


def greedy_dedupe(blocks: DataFrame, least_iou: float = 0.5) -> DataFrame:
    """Largest first, a block stays unless it overlaps one that stays by `least_iou`; the order matters, so pages are folded one by one."""

    def fold(rows: list[dict]) -> list[tuple]:
        kept, of = [], {}
        for r in sorted(rows, key=lambda r: (-(r["x1"] - r["x0"]) * (r["y1"] - r["y0"]), r["block_id"])):
            for k in kept:
                w, h = min(r["x1"], k["x1"]) - max(r["x0"], k["x0"]), min(r["y1"], k["y1"]) - max(r["y0"], k["y0"])
                both = max(w, 0) * max(h, 0)
                whole = (r["x1"] - r["x0"]) * (r["y1"] - r["y0"]) + (k["x1"] - k["x0"]) * (k["y1"] - k["y0"]) - both
                if whole > 0 and both >= least_iou * whole:
                    of[r["block_id"]] = k["block_id"]
                    break
            else:
                kept.append(r)
        return [(r["block_id"], of.get(r["block_id"])) for r in rows]

    return _by_page(blocks, ["block_id", "x0", "y0", "x1", "y1"], fold, "duplicate_of")
