"""Layout operators over blocks of several documents, and folds against plain re-statements."""

import itertools
import random

import pytest

from dossierlake.operators import layout

SCHEMA = "document string, page long, block_id long, kind string, n_chars long, x0 long, y0 long, x1 long, y1 long"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = []
    for d, p in itertools.product("ab", (1, 2, 300)):
        for i in range(12):
            x, y = rng.randrange(400), rng.randrange(300)
            out.append((d, p, 9007199254740993 + i, rng.choice(["image", "text"]), rng.randrange(200), x, y, x + rng.randrange(10, 150), y + rng.randrange(10, 90)))
    return out


@pytest.fixture(scope="module")
def blocks(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def overlap(a, b):
    w, h = min(a[7], b[7]) - max(a[5], b[5]), min(a[8], b[8]) - max(a[6], b[6])
    both = max(w, 0) * max(h, 0)
    return both / ((a[7] - a[5]) * (a[8] - a[6]) + (b[7] - b[5]) * (b[8] - b[6]) - both)


def test_dedupe_keeps_ids_whole_and_documents_apart(blocks, rows):
    got = {(r.document, r.page, r.block_id): r.duplicate_of for r in layout.greedy_dedupe(blocks, 0.2).collect()}
    want = {}
    for page in {r[:2] for r in rows}:
        kept = []
        for r in sorted((r for r in rows if r[:2] == page), key=lambda r: (-(r[7] - r[5]) * (r[8] - r[6]), r[2])):
            first = next((k for k in kept if overlap(r, k) >= 0.2), None)
            want[r[:3]] = first and first[2]
            kept += [] if first else [r]
    assert got == want and any(want.values())


@pytest.mark.parametrize("least", [1, 2, 3, 4])
def test_density_clusters(blocks, rows, least):
    got = {(r.document, r.page, r.block_id): r.cluster for r in layout.clusters(blocks, 30, least).collect()}
    for page in {r[:2] for r in rows}:
        own = sorted((r for r in rows if r[:2] == page), key=lambda r: r[2])

        def near(a, b):
            dx, dy = max(0, a[5] - b[7], b[5] - a[7]), max(0, a[6] - b[8], b[6] - a[8])
            return a[3] == b[3] and dx * dx + dy * dy <= 900

        core = {a[2] for a in own if sum(near(a, b) for b in own) >= least}
        for a, b in itertools.combinations(own, 2):
            if a[2] in core and b[2] in core and near(a, b):
                assert got[a[:3]] == got[b[:3]]  # cores that touch share a cluster
        for a in own:
            members = [b for b in own if got[b[:3]] == got[a[:3]]]
            assert got[a[:3]] in {b[2] for b in members}
            if len(members) > 1:
                assert any(b[2] in core and near(a, b) for b in members)  # every member is reached from a core


def test_operators_keep_documents_apart(blocks, rows):
    pairs = layout.page_pairs(blocks, blocks)
    assert pairs.count() == 6 * 144
    for f in (layout.nearest, layout.caption_links, layout.near_any, layout.artefacts, layout.page_metrics):
        assert f(blocks).columns[:2] == ["document", "page"]
    assert layout.page_metrics(blocks).count() == 6
    alone = {r.block_id for r in layout.near_any(blocks.filter("document = 'a' AND page = 1")).collect()}
    assert {r.block_id for r in layout.near_any(blocks).filter("document = 'a' AND page = 1").collect()} == alone
