"""Operators that compare documents with each other, against brute force on a small table."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from dossierlake.llm import decontaminate, graph, mixing, neardup, sharding, substrings

ODD = "doc_id long, text string, lang string, source string, n_chars long, n_words long, shard int, size long, row long, component_id long"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    some = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(60).collect()]
    base = some[1] + " " + some[2] + " " + some[3]
    words = base.split()
    near = [" ".join(w if k % 97 != j else f"changed{j}" for k, w in enumerate(words)) for j in range(6)]
    texts = [*some, None, "", "  ", "one", "One", "one two", "ONE TWO", base, base.upper(), *near, "a b c d e " * 40, "x y " * 100, some[5] + "\n" + some[6], "long " * 20000]
    rows = [(i, t, "en", "s", None, 1, 2, 3, 4, 5) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[3], (None, "nothing has this id " * 10, None, None, None, None, None, None, None, None)], ODD).repartition(5)


def given(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def lowered(text):
    return "".join(c.lower() if c.isascii() else c for c in text)


def test_repeated_windows(docs):
    all_ = [(i, words_of(t)) for i, t in given(docs)]
    seen = collections.Counter(tuple(w[k : k + 35]) for _, w in all_ for k in range(len(w) - 34))
    want = collections.Counter()
    for i, w in all_:
        gone = {j for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for j in range(k, k + 35)}
        want[i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)] += 1
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substrings.drop_repeated_windows(docs).collect())
    assert got == want


def test_suffix_automaton_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(40):
        reference = [[str(x) for x in rng.integers(0, 3, rng.integers(0, 25))] for _ in range(3)]
        automaton = substrings.SuffixAutomaton(reference)
        words = [str(x) for x in rng.integers(0, 3, 30)]
        known = {tuple(r[a:b]) for r in reference for a in range(len(r)) for b in range(a, len(r) + 1)} | {()}
        want = [max(n for n in range(i + 2) if tuple(words[i + 1 - n : i + 1]) in known) for i in range(len(words))]
        assert automaton.matching_statistics(words) == want


def test_reference_spans(docs, spark):
    given_ = [(1, "p q " + "r " * 3 + "a b c d e f g h"), (2, None)]
    rows = substrings.drop_reference_spans(spark.createDataFrame(given_, "doc_id long, text string"), ["z a b c d e f y", "g h"], least=4).collect()
    assert {r.doc_id: (r.n_removed, r.kept_text) for r in rows} == {1: (6, "p q r r r g h"), 2: (0, "")}
    with pytest.raises(ValueError):
        substrings.drop_reference_spans(docs, ["a b c"], most_words=2)


@pytest.mark.parametrize(("shingle", "part", "whole"), [(3, 85, 100), (5, 80, 100)])
def test_near_duplicates(docs, shingle, part, whole):
    sets = []
    for i, t in given(docs):
        w = words_of(lowered(t))
        sets.append((i, frozenset(tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))) if w else frozenset()))
    up = {i: i for i, _ in sets if i is not None}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[n + 1 :]:
            if a and b and i is not None and j is not None and whole * len(a & b) >= part * len(a | b):
                p, q = sorted((top(i), top(j)))
                up[q] = p
    want = collections.Counter((i, len(s), None if i is None else top(i), i is None or top(i) == i) for i, s in sets)
    got = neardup.near_duplicates(docs, shingle, (part, whole)).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == want


def test_blocks_of_one_family_find_all_links(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 200)]
    texts = []
    for _ in range(60):
        own = list(base)
        for k in rng.integers(0, 200, rng.integers(0, 16)):
            own[k] = f"n{rng.integers(0, 10**6)}"
        texts.append(" ".join(own))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    test_near_duplicates.__wrapped__(frame, 3, 85, 100) if hasattr(test_near_duplicates, "__wrapped__") else test_near_duplicates(frame, 3, 85, 100)


def test_odd_sketch_estimates():
    rng = np.random.default_rng(5)
    for share in (0.95, 0.85, 0.7):
        n = 2000
        both = rng.integers(0, 1 << 63, int(n * share), dtype=np.uint64)
        rest = rng.integers(0, 1 << 63, n - len(both), dtype=np.uint64)
        a, b = np.concatenate([both, rest[::2]]), np.concatenate([both, rest[1::2]])
        bits = [np.frombuffer(neardup.odd_sketch(neardup.minhash(x)), np.uint64) for x in (a, b)]
        assert abs(neardup.estimate(np.bitwise_count(bits[0] ^ bits[1]).sum()) - share) < neardup.MARGIN


def test_components(spark):
    rng = np.random.default_rng(7)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(i, i + 1) for i in range(200, 240)] + [(500, k) for k in range(501, 540)]
    up = {x: x for e in links for x in e}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        p, q = sorted((top(a), top(b)))
        up[q] = p
    linked = {x for a, b in links if a != b for x in (a, b)}
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: top(x) for x in linked}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shards(docs):
    got = sharding.shard_by_splitters(docs, ranges=16).collect()
    want = collections.Counter((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in given(docs))
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots, held = collections.defaultdict(list), collections.Counter()
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 8
        slots[r.shard].append(r.slot)
        held[r.shard] += r["size"]
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    most = max(len(t.encode()) + 1 for _, t in given(docs))
    assert max(held.values()) - sum(held.values()) / 8 <= most
    assert sharding.shard_by_splitters(docs.limit(0)).count() == 0


def test_shards_of_one_hot_text(spark):
    frame = spark.range(2000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot text' ELSE concat('text ', id) END AS text")
    held = collections.Counter()
    for r in sharding.shard_by_splitters(frame, ranges=64).collect():
        held[r.shard] += r["size"]
    assert max(held.values()) - min(held.values()) <= 40


def test_templates(spark):
    item = "If Anna buys 12 apples for 3 dollars each and gives 12 of them to Peter, how much does Anna pay for the rest of them today"
    other = item.replace("Anna", "Maria").replace("12", "40").replace("3 dollars", "5 euros").replace("Peter", "Paul")
    torn = item.replace("buys 12", "buys 40").replace("Anna pay", "Maria pay")
    filler = "nothing of this stands in any question and it goes on for a while "
    rows = [(1, filler + other + " " + filler), (2, filler + item.upper()), (3, filler + torn), (4, filler * 5), (5, None), (6, ""), (7, "is seven words the least we search"), (8, "well, is seven words the least we search then"), (9, filler + item.replace(" ", "\n"))]
    frame = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string")
    bench = spark.createDataFrame([(10, item), (11, "is seven words the least we search"), (12, "too short"), (13, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(frame, bench).collect()}
    # document 3 holds 15 words of the item in a row, more than a literal window
    assert set(got) == {(1, 10), (2, 10), (3, 10), (9, 10), (7, 11), (8, 11)}
    assert got[1, 10].n_changed > 0 and got[9, 10].n_changed == 0
    assert decontaminate.contaminated(frame.limit(0), bench).count() == 0 and decontaminate.contaminated(frame, bench.limit(0)).count() == 0
    assert {r.doc_id for r in decontaminate.drop_contaminated(frame, bench).collect()} == {4, 5, 6}


def test_windows_whose_slots_contradict_are_none(spark):
    """One number of the item became several: no window of it matches, neither literally nor by its slots."""
    item = "Take 12 pears from 12 trees and put 12 of them on 12 plates then move 12 plates to 12 tables at last"
    numbers = iter("31 32 33 34 35 36".split())
    rows = [(1, item.replace("12", "40")), (2, " ".join(next(numbers) if w == "12" else w for w in item.split()))]
    found = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(10, item)], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(1, 10)}


def test_literal_windows_count_alone_and_slots_may_become_equal(spark):
    item = "A farmer sells 3 boxes of pears and then 5 boxes of plums at the market, so how many boxes of fruit are sold by him today in all"
    twice = "A train with 12 coaches leaves the northern station at noon and carries some people home while another one with 12 coaches waits on the other side"
    rows = [(1, item.replace("3", "4").replace("5", "4")), (2, twice.replace("12", "30", 1)), (3, " ".join(item.split()[:12])), (4, "A train with 12 coaches leaves the town")]
    frame, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(10, item), (11, twice)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(frame, bench).collect()}
    assert set(got) == {(1, 10), (2, 11)}
    assert got[1, 10].n_changed == 2 and got[2, 11].n_words == 27
    assert {r.doc_id for r in decontaminate.drop_contaminated(frame, bench).collect()} == {3, 4}


def test_names_that_begin_a_sentence_glued_units_and_short_items(spark):
    run = "The runner covers 5km on each of the first days and then adds 20kg to the bag that is carried"
    bench = [(10, "Tom has 3 apples and buys 4 more"), (11, run), (12, "fruit of spring")]
    rows = [(1, "Well. Mary has 5 apples and buys 6 more today"), (2, run.replace("5km", "8km").replace("20kg", "30 kg")), (3, "the FRUIT of spring!"), (4, "fruit of late spring"), (5, "and tom has 5 apples and buys 6 more")]
    schema = "long, text string"
    got = decontaminate.contaminated(spark.createDataFrame(rows, f"doc_id {schema}"), spark.createDataFrame(bench, f"item_id {schema}")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 10), (2, 11), (3, 12), (5, 10)}


def test_benchmark_passages_of_the_supplied_table(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r.item_id: " ".join(words_of(lowered(r.text))) for r in bench.collect()}
    want = {(r.doc_id, k) for r in docs.collect() for k, v in items.items() if v in " ".join(words_of(lowered(r.text or "")))}
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()} == want


def test_base_scores(docs):
    rows = [(i, [*words_of(lowered(t)), None], t) for i, t in given(docs)]
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = collections.Counter(w for i, ws, _ in rows if not out(i) for w in ws)
    n, kinds = sum(counts.values()), len(counts)
    want = sorted((-1 if i is None else i, out(i), len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 1) / (n + kinds + 1)) for w in ws)) for i, ws, _ in rows)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in mixing.mixing_scores(docs).collect())
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert all(math.isclose(a[5], b[5], rel_tol=1e-9) for a, b in zip(got, want))


def test_model_is_a_distribution_and_learns():
    texts = [f"the quick brown fox {k % 7} jumps over the lazy dog and runs away again" for k in range(400)]
    counts = np.bincount(np.frombuffer("".join(texts).encode(), np.uint8), minlength=256).astype(float)
    trainer = mixing.Trainer(mixing.Code(counts))
    for k in range(0, 400, 40):
        trainer.add(texts[k : k + 40])
    import zlib as z

    pieces = []
    for r in trainer.rows():
        raw = z.decompress(r["data"])
        data = mixing.pack_odds(*np.frombuffer(raw, np.uint32).astype(float).reshape(-1, 2).T).tobytes() if r["what"] < mixing.CONTEXTS else raw
        pieces.append((r["what"], r["block"], z.compress(data)))
    model = mixing.Model(counts, pieces)
    seen, unseen = model.log10(["the quick brown fox 3 jumps over the lazy dog and runs away again", "qzx vvkp 9910 wwy hjkq zzx qqw"])
    assert seen > -12 and unseen < seen
    # batches do not matter, and the next symbols' probabilities add up to one
    assert np.allclose(model.log10(["b", "the fox"])[1], model.log10(["the fox"])[0])
    one = {bytes([s]): model.code.depth[s] for s in range(256)}
    assert sum(2.0**-d for d in one.values()) == pytest.approx(1)


def test_every_part_adjusts_the_weights_and_the_map():
    texts = [f"part {k} of a long task, which learns from all of them" for k in range(40)]
    counts = np.bincount(mixing.symbols(texts)[0], minlength=256).astype(float)
    trainer = mixing.Trainer(mixing.Code(counts))
    for t in texts:
        trainer.add([t])
    made = sum(int(trainer.code.depth[mixing.symbols([t])[0]].sum()) for t in texts[1:])  # the first part meets empty counts
    assert trainer.mixer.grown.sum() == made
    assert (trainer.mixer.map[1] - mixing.Mixer().map[1]).sum() == made


def test_contexts_reach_from_one_byte_to_the_word_before():
    def contexts(text, *before):
        data, offsets = mixing.symbols([*before, text])
        return [int(c[-2]) for c in mixing.context_hashes(data, offsets)]  # at the last byte of the text

    def same(a, b):
        return [x == y for x, y in zip(contexts(a), contexts(b), strict=True)]

    #                                              1      2      3      5      word   word with the word before
    assert same("one apple", "one angle") == [True, False, False, False, False, False]
    assert same("one apple", "one maple") == [True, True, False, False, False, False]
    assert same("one apples", "two apples") == [True, True, True, True, True, False]
    assert same("one  \n apples", "one apples") == [True] * 6
    assert contexts("one apple", "some text") == contexts("one apple")
    assert contexts("apple", "one") == contexts("apple", "two") == contexts("apple")


def test_held_out_texts_cost_less_than_under_a_two_byte_model(spark):
    """Against another proper distribution over texts, learned from the same documents: counts after the last two bytes, smoothed over 257 symbols."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    after = collections.defaultdict(collections.Counter)
    coded = {r.doc_id: [0, 0, *lowered(r.text or "").encode(), 256] for r in docs.collect()}
    for i, x in coded.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            for k in range(2, len(x)):
                after[x[k - 2], x[k - 1]][x[k]] += 1
    totals = {c: sum(n.values()) for c, n in after.items()}
    got = mixing.mixing_scores(docs).filter("held_out").collect()
    cost = sum(math.log10((after[x[k - 2], x[k - 1]][x[k]] + 0.1) / (totals.get((x[k - 2], x[k - 1]), 0) + 25.7)) for x in (coded[r.doc_id] for r in got) for k in range(2, len(x)))
    assert sum(r.score for r in got) > 0.9 * cost


def test_pipeline_runs_and_keeps_its_contract(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, SF).cache()
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= now.count()
        now = out
    final = {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, now, SF).collect()}
    assert final == {r.doc_id for r in now.collect()}
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect()}
    kept = {r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, docs, SF).collect()}
    long_enough = {r.doc_id for r in docs.collect() if r.doc_id in good and len(words_of(r.text or "")) >= 50}
    assert len(long_enough - kept) <= 0.05 * len(long_enough)
    assert hashlib.sha256(b"").hexdigest()
