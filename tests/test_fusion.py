"""Tables, images and captions of pages against plain re-statements, on the rows that are easily got wrong."""

import math
import random

import pytest
from pyspark.sql import functions as F

from dossierlake.operators import fusion as U

SCHEMA = "document string, page long, block_id long, kind string, order double, x0 long, y0 long, x1 long, y1 long, text string, lines array<struct<text:string,x0:long,y0:long,x1:long,y1:long>>, layout_only boolean, decorative boolean, avg_font_size double, area_ratio double, page_width int, page_height int"


def block(i, kind, box, text=None, lines=None, page=1, document="d", layout=True, decorative=False, font=9.0):
    area = (box[2] - box[0]) * (box[3] - box[1]) / (600 * 800) if kind == "image" and box[0] is not None else None
    return (document, page, i, kind, float(i), *box, text, lines, layout, decorative, font, area, 600, 800)


def line(text, x, y):
    return (text, x, y, x + 40, y + 10)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(2)


def test_bands_follow_the_mean(spark):
    rng = random.Random(1)
    rows = [(i, [float(rng.randrange(60)) for _ in range(rng.randint(0, 12))]) for i in range(50)]

    def groups(values, tolerance):
        out = []
        for v in sorted(values):
            if out and abs(sum(out[-1]) / len(out[-1]) - v) <= tolerance:
                out[-1].append(v)
            else:
                out.append([v])
        return len(out)

    got = spark.createDataFrame(rows, "i int, v array<double>").select("i", U.bands(F.col("v"), 8).alias("n")).collect()
    assert {r.i: r.n for r in got} == {i: groups(v, 8) for i, v in rows}


def test_tables_of_pages(spark):
    grid = [block(k, "text", (0, 0, 600, 700), "x", [line("c", 100 * c, 40 * k) for c in range(3)]) for k in range(4)]
    plain = [block(k, "text", (0, 40 * k, 50, 40 * k + 10), "x", [line("c", 5 * k, 40 * k)], page=2) for k in range(6)]
    near = [block(20, "table", (0, 0, 200, 160)), block(21, "table", (205, 0, 300, 160)), block(22, "table", (320, 300, 500, 400))]
    drawn = [block(30 + k, "drawing", (10 * k, 0, 10 * k + 5, 90), page=3) for k in range(12)] + [block(50 + k, "text", (0, 0, 9, 9), "x", [line("c", 0, 0)], page=3) for k in range(4)]
    found = U.tables(frame(spark, grid + near + plain + drawn)).collect()
    # the second table is too near to the first; the grid covers the given ones
    assert sorted((r.page, r.reason, r.place, r.x1) for r in found) == [(1, "given", 20, 200), (1, "given", 22, 500), (3, "ruled", 0, 115)]
    alone = U.table_candidates(frame(spark, grid)).collect()
    assert [(r.reason, r.n_rows, r.n_columns) for r in alone] == [("aligned", 4, 3)]
    assert U.tables(frame(spark, plain)).count() == 0 and U.tables(frame(spark, plain).limit(0)).count() == 0


def test_doubled_images_go(spark):
    rows = [block(1, "image", (0, 0, 100, 100)), block(2, "image", (1, 1, 101, 101)), block(3, "image", (200, 0, 210, 10)), block(4, "image", (202, 3, 217, 12)), block(5, "image", (None,) * 4), block(6, "image", (0, 0, 100, 100), document="e")]
    got = sorted((r.document, r.block_id) for r in U.distinct_images(frame(spark, rows)).collect())
    assert got == [("d", 1), ("d", 4), ("e", 6)]  # 3 and 4 have one middle and nearly one size; 4 is larger


@pytest.mark.parametrize(("text", "caption", "kind"), [
    ("Figure 3: seeds", "Figure 3: seeds", "figure-caption"), ("0101.21.00\nLIVE HORSES\nmore", "LIVE HORSES", "section-title"), ("0101.21.00", "", "section-title"), ("(Source: desk)\n12\nHình 4", "Hình 4", "figure-caption"),
    ("CHAPTER 4\nRoots", "Roots", "generic"), ("w " * 26, "", "generic"), ("", "", "generic"), ("  a   b ", "a b", "generic"),
])
def test_caption_texts(spark, text, caption, kind):
    r = spark.createDataFrame([(text,)], "t string").select(U.caption_text(F.col("t")).alias("c"), U.caption_kind(F.col("t")).alias("k")).first()
    assert (r.c, r.k) == (caption, kind)


def test_candidates_by_line(spark):
    two = [line("Figure 1", 0, 0), line("(Source: x)", 0, 12)]
    rows = [block(1, "text", (0, 0, 50, 24), "Figure 1\n(Source: x)", two), block(2, "text", (0, 50, 50, 60), "plain", [line("plain", 0, 50)]), block(3, "text", (0, 0, 9, 9), "body", layout=False), block(4, "caption", (0, 90, 9, 99), "Map", None, layout=False), block(5, "text", (None,) * 4, "x")]
    got = sorted((r.candidate, r.line, r.text, r.order) for r in U.caption_candidates(frame(spark, rows)).collect())
    assert got == [("1-line-0", 0, "Figure 1", 1.0), ("2", None, "plain", 2.0), ("4", None, "Map", 4.0)]


def test_clusters_are_connected_groups(spark):
    rng = random.Random(3)
    rows = [block(k, "caption", (x := rng.randrange(500), y := rng.randrange(700), x + 40, y + 12), rng.choice(["Figure 1", "note", "0101.21.00\nROOT"]), page=p) for p in (1, 2) for k in range(100 * p, 100 * p + 25)]
    got = {(r.page, r.parent): (r.cluster, r.n) for r in U.candidate_clusters(U.caption_candidates(frame(spark, rows))).collect()}
    gap = lambda a, b: math.hypot(max(0, a[5] - b[7], b[5] - a[7]), max(0, a[6] - b[8], b[6] - a[8]))
    near = lambda a, b: a[1] == b[1] and a[9] == b[9] and (gap(a, b) <= 42 or math.hypot(a[5] - b[5], a[6] - b[6]) <= 63)
    for a in rows:
        reached, waiting = {a[2]}, [a]
        while waiting:
            for b in [b for b in rows if b[2] not in reached and near(waiting[-1], b)] or [waiting.pop()]:
                if b[2] not in reached:
                    reached.add(b[2])
                    waiting.append(b)
        assert got[a[1], a[2]][0] == min(got[a[1], k][1] for k in reached)


def test_links_of_images(spark):
    rows = [
        block(1, "image", (100, 100, 200, 200)), block(2, "caption", (100, 205, 200, 217), "Figure 1: a root"),
        block(3, "image", (210, 100, 310, 200)),  # beside it, of its size: same caption
        block(4, "image", (420, 600, 480, 660)), block(5, "text", (420, 670, 500, 680), "(Source: desk)", layout=False),
        block(6, "image", (0, 0, 600, 799)),  # a whole page
        block(7, "image", (500, 300, 560, 330), decorative=True), block(8, "image", (330, 100, 430, 200)),
    ]
    far = U.linked_images(frame(spark, [*rows, block(9, "image", (10, 500, 70, 560))])).collect()
    got = {r.block_id: (r.how, r.caption, r.source) for r in far}
    assert got[1] == ("caption", "Figure 1: a root", "2") and got[4] == ("source", None, "5") and got[9] == (None, None, None) and 7 not in got
    assert got[3][0] in ("caption", "group") and got[3][1] == "Figure 1: a root"
    # a second round reaches the image beside the one that took the caption over
    chain = [block(1, "image", (0, 100, 100, 200)), block(2, "caption", (0, 203, 90, 212), "Figure 1"), block(3, "image", (150, 500, 250, 600)), *[block(10 + k, "image", (110 * k + 150, 500, 110 * k + 250, 600), document="e") for k in range(4)], block(20, "caption", (20, 540, 140, 552), "Figure 9: x", document="e")]
    hows = lambda n: {r.block_id: r.how for r in U.linked_images(frame(spark, chain), n).filter("document = 'e'").collect()}
    one, three = hows(1), hows(3)
    assert one[10] == "caption" and sum(v is not None for v in three.values()) >= sum(v is not None for v in one.values())
    assert all(v is not None for v in three.values())
    assert U.linked_images(frame(spark, rows).limit(0)).count() == 0


def test_clusters_of_pages_that_batches_cut(spark):
    """Groups against a plain walk, with pages that arrive in several batches and pairs looked at in several goes."""
    rng = random.Random(3)
    rows = []
    for d in ("a", "b"):
        for p, n in ((1, 1), (2, 40), (3, 7)):
            for i in range(n):
                x, y = rng.randrange(600), rng.randrange(500)
                rows.append((d, p, f"c{i:02d}", float(i % 5), rng.choice(["generic", "figure-caption"]), x, y, x + 30, y + 12))
    schema = "document string, page long, candidate string, `order` double, kind string, x0 long, y0 long, x1 long, y1 long"
    held = U.MOST_PAIRS
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "6")
    U.MOST_PAIRS = 30
    try:
        got = {(r.document, r.page, r.candidate): (r.n, r.cluster) for r in U.candidate_clusters(spark.createDataFrame([*rows, (None, 1, "z", 0.0, "generic", 0, 0, 1, 1)], schema)).collect()}
    finally:
        U.MOST_PAIRS = held
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for page in {r[:2] for r in rows}:
        own = sorted((r for r in rows if r[:2] == page), key=lambda r: (r[3], r[2]))
        near = lambda a, b: a[4] == b[4] and (math.hypot(max(0, a[5] - b[7], b[5] - a[7]), max(0, a[6] - b[8], b[6] - a[8])) <= 42 or math.hypot(a[5] - b[5], a[6] - b[6]) <= 63)
        group = list(range(len(own)))
        for _ in own:
            group = [min(group[j] for j, b in enumerate(own) if near(a, b)) for a in own]
        want.update({(*page, r[2]): (i + 1, group[i] + 1) for i, r in enumerate(own)})
    assert got == want


def test_captions_are_found_once_for_links(spark):
    from dossierlake.plans import figures

    shown = figures.image_links(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert shown.count("MapInArrow") == 1 and "FlatMapGroups" not in shown


def test_images_of_one_number_share_their_link(spark):
    """As joins by the block's number do: the note beside one of them, the peer of one of them."""
    rows = [block(1, "image", (10, 10, 60, 60)), block(1, "image", (480, 600, 540, 700)), block(2, "text", (10, 70, 90, 80), "(Source: desk)"), block(3, "image", (480, 480, 540, 590))]
    got = [tuple(r) for r in U.linked_images(frame(spark, rows)).select("block_id", "how", "source").collect()]
    assert sorted(got) == [(1, "source", "2"), (1, "source", "2"), (3, "group", "1")]
