"""Resampling, spelling variants and top-k search against plain re-computations, with their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from dossierlake.llm import metricsearch, resample, variants
from dossierlake.llm.common import table

SF = "/root/testdata/sf0.001"
LOWERED = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def texts_of(frame):
    return [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]


# -- resampling ---------------------------------------------------------------------------------------------


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWERED))
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def resampled(docs, bench, percent=5, least=20):
    def counted(texts):
        return Counter(zlib.crc32(f.encode()) % 10000 for t in texts for f in features(t)[1])

    s, t = counted(t for _, t in docs), counted(bench)
    low, high = sum(s.values()) + 10000, sum(t.values()) + 10000
    gain = [math.floor(1000 * math.log((t[b] + 1) * low / ((s[b] + 1) * high))) for b in range(10000)]
    rows = []
    for doc_id, text in docs:
        words, found = features(text)
        weight = sum(gain[zlib.crc32(f.encode()) % 10000] for f in found)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)])
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = percent * len(able) // 100
    ranks = {id(r): k + 1 for k, r in enumerate(able) if k < drawn}
    return Counter((*r[:4], ranks.get(id(r))) for r in rows)


def test_resampling_of_a_table(spark):
    docs, bench = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    got = Counter(map(tuple, resample.resample(docs, bench).collect()))
    assert got == resampled(texts_of(docs), [r.text for r in bench.collect()])


def test_resampling_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(resample, "CHUNK", 3000)
    draw = random.Random(3)
    vocabulary = ["Ä1", "apple", "Über", "b", "0", "x" * 300, "naïve", "日本", "Z"]
    docs = [(i, " ".join(draw.choices(vocabulary, k=draw.randint(0, 60))) + draw.choice(["", "\n-", "..."])) for i in range(120)]
    docs += [(None, docs[3][1]), (7, docs[7][1]), (7, "other " * 25), (200, None), (201, ""), (202, " ,.; "), (203, "y " * 9000)]
    bench = ["apple b apple", None, "", "日本 Über naïve"]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, feature string, n long").repartition(3)
    target = spark.createDataFrame([(1, t) for t in bench], "item_id long, text string")
    assert Counter(map(tuple, resample.resample(frame, target, percent=30).collect())) == resampled(docs, bench, 30)
    assert resample.resample(frame.limit(0), target).count() == 0
    assert Counter(map(tuple, resample.resample(frame, target.limit(0)).collect())) == resampled(docs, [])


def test_features_of_many_shards_are_counted_once(spark, monkeypatch):
    monkeypatch.setattr(resample, "CHUNK", 200_000)
    docs = table(spark, SF, "documents").repartition(3)
    got = {r.feature: r.n for r in resample.feature_counts(docs, shard_bytes=20_000).collect()}
    assert got == Counter(f for _, t in texts_of(docs) for f in features(t)[1])


def test_sums_carried_over_bytes():
    draw = random.Random(1)
    a, b = [draw.randbytes(draw.randint(0, 9)) for _ in range(300)], [draw.randbytes(draw.randint(0, 90)) for _ in range(300)]
    first, second = (np.array([zlib.crc32(x) for x in y], np.uint32) for y in (a, b))
    assert ((resample.shifted(first, np.array(list(map(len, b)))) ^ second) == np.array([zlib.crc32(x + y) for x, y in zip(a, b, strict=True)], np.uint32)).all()


# -- spelling variants --------------------------------------------------------------------------------------


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def variants_of(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWERED)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    others = {w: [v for v in words if near(v, w)] for w in words}
    form = {w: v for w in words if others[w] and words[v := min(others[w], key=lambda x: (-words[x], x))] >= 5 * words[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n, len(others[w]), words[form[w]] if w in form else None) for w, n in words.items()}


@pytest.mark.parametrize("block", [16_384, 20])
def test_variants_of_odd_rows(spark, monkeypatch, block):
    """With small blocks letters have blocks of their own, several of them."""
    monkeypatch.setattr(variants.near_words, "__defaults__", (block,))
    monkeypatch.setattr(variants, "HELD", 50)
    draw = random.Random(5)
    words = sorted({"".join(draw.choices("abé", k=draw.randint(5, 8))) for _ in range(400)})
    docs = [(i, " ".join(draw.choices(words[:80], k=200) + draw.choices(words, k=80))) for i in range(40)]
    docs += [(None, "ABCDEF " * 7), (2, docs[2][1]), (3, None), (4, ""), (5, "abcdéf×÷ abcdef-ABCDEFŸabcdef"), (6, "q" * 5000 + " 12 " + "aaaaaaa " * 900 + "aaaaaab " * 30 + "aaaaabb " * 6)]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, word string, n long").repartition(3)
    got = [tuple(r) for r in variants.spelling_variants(frame).collect()]
    want = variants_of(docs)
    assert len(got) == len(want) and set(got) == want
    chain = {r[0]: r for r in got}["aaaaabb"]
    assert chain[1] == "aaaaaab" and chain[2] == "aaaaaaa"
    assert variants.spelling_variants(frame.limit(0)).count() == 0
    assert variants.spelling_variants(frame.filter("doc_id = 4")).count() == 0


def test_variants_of_a_table(spark):
    docs = table(spark, SF, "documents")
    got = [tuple(r) for r in variants.spelling_variants(docs).collect()]
    assert set(got) == variants_of(texts_of(docs)) and len(got) == len(set(got))


def test_automata_number_words_and_complete_halves():
    draw = random.Random(2)
    words = sorted({"".join(draw.choices("abc", k=draw.randint(1, 7))) for _ in range(900)})
    automaton = variants.Automaton(words)
    assert automaton.size == len(words) and [automaton.follow(w)[1] for w in words] == list(range(len(words)))
    states = {0}
    while more := {t for s in states for t in automaton.edges[s].values()} - states:
        states |= more
    assert len(states) < sum(map(len, words)) / 4  # equal ends are shared
    for w in words[::7]:
        got = {words[k] for k in automaton.one_error(w, len(w) // 2)} - {w}
        assert got == {v for v in words if v[: len(w) // 2] == w[: len(w) // 2] and near(v, w) and near(v[len(w) // 2 :], w[len(w) // 2 :])}


# -- top-k search -------------------------------------------------------------------------------------------


def best_of(rows, k=5):
    """Ranks by comparing every query with every row; rows are (vec_id, components)."""
    whole = []
    for vec_id, x in rows:
        if x is not None and all(c is not None and math.isfinite(c) for c in x) and (row := (vec_id, tuple(math.floor(256 * c) for c in x))) not in whole:
            whole.append(row)
    out = set()
    for q in whole:
        if q[0] is not None and q[0] % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q[1], v, strict=False)), i is None, i or 0) for i, v in whole if (i, v) != q)
            out |= {(q[0], n + 1, None if none else i, -s) for n, (s, none, i) in enumerate(scores[:k])}
    return out


def ranked(frame, **given):
    got = [tuple(r) for r in metricsearch.exact_top_k(frame, **given).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_top_k_of_a_table(spark):
    frame = table(spark, SF, "embeddings")
    assert ranked(frame) == best_of([(r.vec_id, r.embedding) for r in frame.collect()])


def test_top_k_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(metricsearch, "LEAF", 4)
    monkeypatch.setattr(metricsearch, "TREE_VALUES", 60)
    monkeypatch.setattr(metricsearch, "ROUTERS", 5)
    monkeypatch.setattr(metricsearch, "SLOT_VALUES", 12)
    draw = random.Random(4)
    rows = [(i, [float(np.float32(draw.gauss(i % 5, 0.3))) for _ in range(3)]) for i in range(260)]
    rows += [(i, [1.0, 2.0, 3.0]) for i in range(300, 420)] + [(i, [0.0, -0.0, 0.0]) for i in range(450, 470)]
    rows += [(500, None), (550, [1.0, None, 2.0]), (600, [float("nan"), 1.0, 1.0]), (650, [1.0, float("inf"), 1.0]), (700, []), (750, [0.5]), (800, [0.25] * 7), (None, [4.0, 4.0, 4.0]), (None, [1.0, 2.0, 3.0]), (100, rows[100][1]), (850, [0.5, 0.5, 0.5]), (850, [0.5, 0.5, 0.25]), (-50, [-9.0, 1.0, 0.125])]
    frame = spark.createDataFrame([(i, x, 1, "a") for i, x in rows], "vec_id long, embedding array<float>, dim int, v string").repartition(3)
    assert ranked(frame) == best_of(rows)
    assert ranked(frame.filter("vec_id IN (50, 51, 52)")) == best_of([r for r in rows if r[0] in (50, 51, 52)])
    assert ranked(frame.filter("vec_id = 50")) == set() and ranked(frame.limit(0)) == set()


def test_top_k_of_very_large_components(spark):
    draw = random.Random(6)
    rows = [(i, [float(np.float32(draw.choice([1e12, 3e38, 1.0]) * draw.uniform(-1, 1))) for _ in range(2)]) for i in range(60)]
    got = ranked(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    held = 2**63 - 1
    assert got == {(q, n, i, max(-held - 1, min(held, s))) for q, n, i, s in best_of(rows)}


def test_bounds_spare_distances():
    draw = np.random.default_rng(0)
    middles = draw.normal(size=(30, 16))
    vectors = np.floor(256 * (middles[draw.integers(0, 30, 3000)] + draw.normal(scale=0.02, size=(3000, 16))))
    sphere = metricsearch.Sphere(float((vectors**2).sum(axis=1).max()))
    pages = {p["page"]: {**p, "vectors": p["vectors"].reshape(len(p["radius"]), 16), "radius": np.array(p["radius"])} for p in metricsearch.build_tree(vectors, [[i] for i in range(3000)], sphere)}
    total = 0
    for q in range(0, 3000, 100):
        rows, computed = metricsearch.search_tree(pages, max(pages), vectors[q], q, 5, None, sphere)
        scores = vectors @ vectors[q]
        assert [(r[2], -r[0]) for r in sorted(rows)[:5]] == [(int(i), int(scores[i])) for i in np.lexsort((np.arange(3000), -scores)) if i != q][:5]
        total += computed
    assert total < 30 * 3000 / 2
