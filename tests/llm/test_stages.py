"""Edge cases of whole operators and pipeline stages: groups, null and shared ids, clashing names, empty tables, long texts."""

import collections

import pytest

from dossierlake.llm import decontaminate, neardup, pii, quality, sharding
from dossierlake.llm.common import shared_dir, table

SF = "/root/testdata/sf0.001"
ITEM = "If a farmer sells 3 boxes of pears and then 5 boxes of plums at the market, how many boxes of fruit are sold by him today in all"
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, id_ long, mark_ long, _gone long, _c0 string, mark long"
STAGES = {
    "quality": quality.filter_quality,
    "near": neardup.drop_near_duplicates,
    "contaminated": lambda d: decontaminate.drop_contaminated(d, d.sparkSession.createDataFrame([(1, ITEM)], "item_id long, text string")),
    "pii": pii.redact_pii,
}


def prose(i, n=80):
    return " ".join(f"word{i}x{k} plain{k % 7} text" for k in range(n // 3))


@pytest.fixture(scope="module")
def docs(spark):
    texts = [(i, prose(i)) for i in range(30)]
    texts += [(None, prose(100)), (None, ITEM + " " + prose(101)), (5, ITEM), (5, prose(102)), (31, None), (32, ""), (33, prose(103) + " x" * 30000), (34, prose(3)), (None, prose(3)), (3, prose(3))]
    rows = [(i, t, "en", "s", 1, 2, 3, 4, "x", 5) for i, t in texts]
    return spark.createDataFrame(rows, CLASHING).repartition(3)


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_columns_whatever_their_names(docs, name):
    out = STAGES[name](docs)
    assert out.columns == docs.columns and out.count() <= docs.count()
    assert STAGES[name](docs.limit(0)).count() == 0


def test_rows_with_null_or_shared_ids_are_told_apart(docs):
    kept = collections.Counter((r.doc_id, r.text) for r in STAGES["contaminated"](docs).collect())
    want = collections.Counter((r.doc_id, r.text) for r in docs.collect() if not (r.text or "").startswith("If a farmer"))
    assert kept == want
    near = collections.Counter((r.doc_id, r.text) for r in STAGES["near"](docs).collect())
    assert near[5, ITEM] == near[5, prose(102)] == near[None, prose(3)] == 1 and (34, prose(3)) not in near and near[3, prose(3)] == 2


def test_a_changed_repeat_of_a_number_and_a_null_id_beside_it(spark):
    """A document that holds an item but for its last repeated number is found; a clean one without an id stays."""
    item = "A train with 12 coaches leaves the northern station at noon and carries some people home while another one with 12 coaches waits on the other side"
    rows = [(None, item[::-1]), (None, item.replace("one with 12", "one with 30"))]
    kept = decontaminate.drop_contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [r.text for r in kept] == [item[::-1]]


def test_benchmarks_of_several_blocks_give_the_same(spark, monkeypatch):
    docs, bench = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    want = sorted(map(tuple, decontaminate.contaminated(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "MOST_BROADCAST", 300)
    assert sorted(map(tuple, decontaminate.contaminated(docs, bench).collect())) == want and want


def test_long_runs_of_marks_and_digits(spark):
    texts = ["x " + "." * 200000 + " y", "1." * 50000 + "1", "a" + "-" * 100000 + "b", "\x01 a\x01b . C", "“…” ‘—’"]
    got = [r.literal for r in decontaminate.canonical_words(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id").orderBy("doc_id").collect()]
    assert got[0] == ["x", "y"] and got[1] == [texts[1]] and got[2] == [texts[2]] and got[3] == ["a", "b", "c"] and got[4] == []


def test_equal_texts_share_a_shard(spark):
    rows = [(i, f"text {i // 3} " + "y" * (i // 3 % 50)) for i in range(3000)]
    got = sharding.shard_by_splitters(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), ranges=64).collect()
    of = collections.defaultdict(set)
    for r in got:
        of[r.text_crc32].add(r.shard)
    assert all(len(x) == 1 for x in of.values()) and {r.shard for r in got} == set(range(8))
    held = collections.Counter()
    for r in got:
        held[r.shard] += r["size"]
    assert max(held.values()) - min(held.values()) <= 2 * 3 * 62


def test_rows_that_repeat_exactly_are_spread(spark):
    frame = spark.range(4000).selectExpr("CASE WHEN id % 2 = 0 THEN 7 ELSE id END AS doc_id", "CASE WHEN id % 2 = 0 THEN 'the same' ELSE concat('text ', id) END AS text")
    got = sharding.shard_by_splitters(frame, ranges=64).collect()
    held, slots = collections.Counter(), collections.defaultdict(list)
    for r in got:
        held[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert max(held.values()) - min(held.values()) <= 40 and all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_a_cluster_must_name_its_shared_folder():
    class Context:
        master = "yarn"

        class _jsc:  # noqa: N801
            @staticmethod
            def sc():
                class Scala:
                    @staticmethod
                    def getCheckpointDir():
                        class Nothing:
                            @staticmethod
                            def isDefined():
                                return False

                        return Nothing

                return Scala

    class Session:
        sparkContext = Context

        class conf:  # noqa: N801
            @staticmethod
            def get(_, default):
                return default

    with pytest.raises(RuntimeError):
        shared_dir(Session)
