"""Layout operators; `lineitem` stands for blocks on pages, with whole-number boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dossierlake.functions import geometry as G
from dossierlake.operators import layout
from dossierlake.registry import query
from dossierlake.sources.tables import table


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    x0, y0 = F.col("l_quantity").cast("long") * 10, F.col("l_linenumber").cast("long") * 45
    return li.select(
        F.col("l_orderkey").alias("page"),
        F.row_number().over(w).cast("long").alias("block_id"),
        F.when(F.col("l_returnflag") == "R", "image").otherwise("text").alias("kind"),
        (F.col("l_partkey") % 300).alias("n_chars"),
        x0.alias("x0"),
        y0.alias("y0"),
        (x0 + F.round(F.col("l_discount") * 1000).cast("long") + 20).alias("x1"),
        (y0 + F.round(F.col("l_tax") * 1000).cast("long") + 10).alias("y1"),
    )


BLOCKS = """blk AS (SELECT l_orderkey AS page, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS BIGINT) AS block_id, CASE WHEN l_returnflag = 'R' THEN 'image' ELSE 'text' END AS kind, l_partkey % 300 AS n_chars,
    CAST(l_quantity AS BIGINT) * 10 AS x0, l_linenumber * 45 AS y0, CAST(l_quantity AS BIGINT) * 10 + CAST(round(l_discount * 1000) AS BIGINT) + 20 AS x1, l_linenumber * 45 + CAST(round(l_tax * 1000) AS BIGINT) + 10 AS y1 FROM lineitem)"""
_AREA = "((x1 - x0) * (y1 - y0))"
_GAP = "(greatest(0, a.x0 - b.x1, b.x0 - a.x1) * greatest(0, a.x0 - b.x1, b.x0 - a.x1) + greatest(0, a.y0 - b.y1, b.y0 - a.y1) * greatest(0, a.y0 - b.y1, b.y0 - a.y1))"
_BOTH = "(greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0))"
METRICS = f"met AS (SELECT page, count(*) AS n_blocks, CAST(sum(CAST(kind = 'image' AS INT)) AS BIGINT) AS n_images, CAST(sum(CASE WHEN kind <> 'image' THEN n_chars ELSE 0 END) AS BIGINT) AS n_chars, CAST(sum(CASE WHEN kind = 'image' THEN {_AREA} ELSE 0 END) * 1000 // 240000 AS BIGINT) AS coverage FROM blk GROUP BY page)"


@query("page_metrics", f"WITH {BLOCKS}, {METRICS} SELECT * FROM met")
def page_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.page_metrics(blocks(spark, sf_dir))


@query(
    "page_route",
    f"""WITH {BLOCKS}, {METRICS}, r AS (SELECT page, (n_chars < 120 AND coverage >= 350) OR (n_chars = 0 AND n_images > 0) AS scanned, n_images > 0 AND n_chars < 240 AS images, n_blocks >= 6 AS dense FROM met)
    SELECT page, scanned, concat_ws('|', CASE WHEN scanned THEN 'scanned' END, CASE WHEN images THEN 'images' END, CASE WHEN dense THEN 'dense' END) AS reasons, CASE WHEN scanned OR images OR dense THEN 'accurate' ELSE 'fast' END AS route FROM r""",
)
def page_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.page_route(layout.page_metrics(blocks(spark, sf_dir)))


@query("bbox_iou_pairs", f"WITH {BLOCKS} SELECT a.page, a.block_id AS a, b.block_id AS b, round({_BOTH} / ((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - {_BOTH}), 6) AS iou FROM blk a JOIN blk b ON a.page = b.page AND a.block_id < b.block_id WHERE {_BOTH} > 0")
def bbox_iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks(spark, sf_dir)
    pairs = layout.page_pairs(b, b).filter(F.col("a_block_id") < F.col("b_block_id")).filter(G.intersection("a_", "b_") > 0)
    return pairs.select("page", F.col("a_block_id").alias("a"), F.col("b_block_id").alias("b"), F.round(G.iou("a_", "b_"), 6).alias("iou"))


_KEY = "concat_ws(':', " + ", ".join(f"CAST(floor({x} / 50 + 0.5) * 50 AS BIGINT)" for x in ("x0", "y0", "x1", "y1")) + ")"


@query("repeated_position_noise", f"WITH {BLOCKS}, k AS (SELECT *, {_KEY} AS place FROM blk WHERE kind = 'image'), o AS (SELECT place, count(DISTINCT page) AS n_pages FROM k GROUP BY place HAVING count(DISTINCT page) >= 3) SELECT page, block_id, n_pages FROM k JOIN o USING (place)")
def repeated_position_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.repeated_positions(blocks(spark, sf_dir))


@query(
    "artifact_classify",
    f"""WITH {BLOCKS}, i AS (SELECT *, {_AREA} / 240000 AS share, x1 - x0 AS w, y1 - y0 AS h, x0 < 40 OR y0 < 40 OR x1 > 560 OR y1 > 360 AS edge FROM blk WHERE kind = 'image'),
    r AS (SELECT page, block_id, concat_ws('|', CASE WHEN share <= 0.00225 OR least(w, h) <= 24 THEN 'icon' END, CASE WHEN share <= 0.005 AND edge THEN 'edge_icon' END, CASE WHEN 10 * w >= 22 * h OR 10 * h >= 22 * w THEN 'elongated' END, CASE WHEN share >= 0.9 THEN 'full_page' END) AS reasons FROM i) SELECT *, reasons <> '' AS decorative FROM r""",
)
def artifact_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.artefacts(blocks(spark, sf_dir))


@query("nearest_neighbor_link", f"WITH {BLOCKS}, p AS (SELECT a.page, a.block_id AS image, b.block_id AS text, {_GAP} AS gap FROM blk a JOIN blk b ON a.page = b.page AND a.kind = 'image' AND b.kind = 'text') SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY page, image ORDER BY gap, text) AS n FROM p) WHERE n = 1")
def nearest_neighbor_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.nearest(blocks(spark, sf_dir))


@query(
    "caption_best_link",
    f"""WITH {BLOCKS}, p AS (SELECT a.page, a.block_id AS image, b.block_id AS caption, CAST(560 - floor(560 * {_GAP} / 14400) + CASE WHEN b.y0 >= a.y1 THEN 180 WHEN b.y1 <= a.y0 THEN 100 ELSE 120 END + 100 * CAST(least(a.x1, b.x1) > greatest(a.x0, b.x0) AS INT) + CASE WHEN b.n_chars <= 80 THEN 110 ELSE 0 END AS BIGINT) AS score
    FROM blk a JOIN blk b ON a.page = b.page AND a.kind = 'image' AND b.kind = 'text' WHERE {_GAP} <= 14400)
    SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY page, image ORDER BY score DESC, caption) AS n FROM p WHERE score >= 520) WHERE n = 1""",
)
def caption_best_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.caption_links(blocks(spark, sf_dir))


@query("spatial_semi", f"WITH {BLOCKS} SELECT page, block_id FROM blk a WHERE kind = 'image' AND EXISTS (SELECT 1 FROM blk b WHERE b.page = a.page AND b.kind = 'text' AND b.n_chars <= 240 AND {_GAP} <= 9216)")
def spatial_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.near_any(blocks(spark, sf_dir))


@query(
    "cluster_components",
    f"""WITH RECURSIVE {BLOCKS}, e AS (SELECT a.page, a.block_id AS a, b.block_id AS b FROM blk a JOIN blk b ON a.page = b.page AND a.kind = b.kind AND {_GAP} <= 1764), r AS (SELECT page, a, b FROM e UNION SELECT r.page, r.a, e.b FROM r JOIN e ON r.page = e.page AND r.b = e.a)
    SELECT page, a AS block_id, min(b) AS cluster FROM r GROUP BY page, a""",
)
def cluster_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.clusters(blocks(spark, sf_dir))


@query("greedy_dedupe")
def greedy_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.greedy_dedupe(blocks(spark, sf_dir))
