"""The word model: its code is complete, lookups and tables equal plain re-statements, and it predicts held-out texts better than counts of single words."""

import collections
import math
import pickle

import numpy as np
import pytest

from dossierlake.llm import mixing, wordmix
from dossierlake.llm.common import Words


def vocabulary(n=500, seed=1):
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(n)]
    keys = Words(words).hashes.view(np.int64)
    return words, wordmix.Vocabulary(keys, rng.zipf(1.5, n) % 1000 + 2, 50, 5000)


def test_paths_are_a_complete_code():
    words, v = vocabulary()
    assert sum(2.0 ** -int(d) for d in v.depth) == pytest.approx(1)
    paths = {tuple(v.places[a : a + d]) for a, d in zip(v.first, v.depth)}
    assert len(paths) == len(words) + 2
    # groups: decisions that share the node of their third-last level differ in their place
    seen = collections.defaultdict(set)
    for a, d in zip(v.first, v.depth):
        for k in range(d):
            seen[int(v.groups[a + k])].add(int(v.places[a + k] >> 1))
    assert all(len(x) == 1 for x in seen.values()) and all(1 <= g % 8 <= 7 for g in seen)


def test_symbols_and_escapes():
    words, v = vocabulary()
    symbol, hashes, inside, escaped = v.symbols(Words(["w3 nothing W4 w3", "", "w499"], lower=True))
    ids = {w: int(v.symbols(Words([w]))[0][0]) for w in ("w3", "w4", "w499")}
    assert symbol.tolist() == [ids["w3"], v.escape, ids["w4"], ids["w3"], v.end, v.end, ids["w499"], v.end]
    assert escaped.tolist() == [1] and inside.tolist() == [0, 1, 2, 3, 4, 0, 0, 1] and len(set(ids.values())) == 3


def test_guesses_agree_as_far_as_paths_do():
    _, v = vocabulary()
    rng = np.random.default_rng(2)
    symbol, guess = rng.integers(0, 502, 400), rng.integers(-1, 502, 400)
    d = wordmix.Decisions(v, symbol)
    odds = np.ones(400, np.float32)
    places, x, kinds = wordmix.run_input(d, guess, odds)
    got, kind = np.zeros(len(d.of)), np.zeros(len(d.of), int)
    got[places], kind[places] = x, kinds
    assert len(set(places.tolist())) == len(places)
    at = 0
    for s, g in zip(symbol, guess):
        own = v.places[v.first[s] : v.first[s] + v.depth[s]].tolist()
        other = v.places[v.first[g] : v.first[g] + v.depth[g]].tolist() if g >= 0 else []
        for k in range(len(own)):
            on = k < len(other) and own[:k] == other[:k] and own[k] >> 1 == other[k] >> 1
            assert got[at] == ((1 if other[k] & 1 else -1) if on else 0) and (kind[at] > 0) == on
            at += 1
    x = rng.integers(0, 1 << 63, 1000, dtype=np.uint64) >> rng.integers(0, 64, 1000, dtype=np.uint64)
    assert wordmix.leading(x).tolist() == [64 - int(y).bit_length() for y in x]


def test_runs_count_and_blocks_add_up():
    rng = np.random.default_rng(3)
    contexts = rng.integers(0, 1 << 63, 40, dtype=np.uint64) * np.uint64(2)
    whole, parts = wordmix.Runs(13), [wordmix.Runs(13) for _ in range(3)]
    for k in range(30):
        c = rng.integers(0, 40, 50)
        s = np.where(rng.random(50) < 0.8, c, c + 100)  # mostly one symbol for each context
        whole.add(contexts[c], s)
        parts[k % 3].add(contexts[c], s)
    total = wordmix.BlockSum(True)
    for p in parts:
        total.add(wordmix.sparse(p.entry, p.hits, p.seen))
    for r in (whole, total.total):
        guess, odds = wordmix.guesses(r, contexts)
        assert guess.tolist() == list(range(40)) and (odds > 0).all()
    assert total.total.seen.sum() == whole.seen.sum() == 1500
    at, entry, odds = wordmix.from_sparse(total.packed(mixing.pack_odds), "<u4", "<i2")
    assert (entry == total.total.entry[at]).all() and len(at) == len(np.unique(wordmix.slots(contexts, 13)[0]))


def test_gaps_are_what_stands_between_words():
    w = Words([" a  b\n", "a b", "", "  "])
    of, edge, plain, length = wordmix.gaps(w)
    assert of.tolist() == [0, 0, 0, 1, 1, 1, 2, 3]
    assert length.tolist() == [1, 2, 1, 0, 1, 0, 0, 2]
    assert plain.tolist() == [False, False, False, True, True, True, True, False]
    assert edge.tolist() == [True, False, True, True, False, True, True, True]


def test_held_out_texts_cost_less_than_under_single_words(spark):
    """Against the base score, which gives an unseen word next to nothing to pay, on the larger supplied table."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").repartition(4)
    got = mixing.mixing_scores(docs).filter("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert got["sum(score)"] > 0.97 * got["sum(base_score)"]


def test_a_text_seen_before_costs_less():
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 500, 60)) for _ in range(40)]
    _, v = vocabulary()
    trainer = wordmix.WordTrainer(v, 16, mixing.Mixer(inputs=wordmix.INPUTS))
    for k in range(0, 40, 4):
        trainer.add(Words([*texts[k : k + 4], *texts[:2]], lower=True), mixing.pack_odds)
    sums = {}
    for r in trainer.rows(0):
        s = sums.setdefault((r["what"], r["block"]), wordmix.BlockSum(r["what"] < wordmix.RUNS))
        s.add(r["data"])
    model = wordmix.WordModel(v, 16, trainer.mixer, [(what, block, s.packed(mixing.pack_odds)) for (what, block), s in sums.items()])
    model = pickle.loads(pickle.dumps(model))  # as it reaches the workers
    logs, _ = model.log10(Words([texts[0], " ".join(f"w{x}" for x in rng.integers(0, 500, 60))]))
    assert logs[0] > 0.6 * logs[1] and math.isfinite(logs[1]) and logs[1] < 0
