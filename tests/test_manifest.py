"""The manifest store: versions that appear whole, writers that meet, repeated writes."""

import datetime
import threading

import pytest

from dossierlake.sources.artefacts import MANIFEST
from dossierlake.sources.manifest import ManifestStore, manifest_records


def record(document, minute, status="fresh", error=None):
    return (document, f"in/{document}.pdf", "h", "m", "s", "t", status, "fresh", "hs-chapter", 1, 0, error, datetime.datetime(2026, 1, 1, 0, minute))


@pytest.fixture
def store(spark, tmp_path):
    return ManifestStore(spark, f"file://{tmp_path}/manifest")


def told(store):
    return {r.document: (r.parse_status, r.updated_at.minute) for r in store.read().collect()}


def test_upserts_and_repeated_writes(spark, store, tmp_path):
    write = lambda rows, token: store.upsert(spark.createDataFrame(rows, MANIFEST), token)
    assert store.read().count() == 0
    assert write([record("a", 1), record("b", 1), record("a", 3, "stale")], "one") == 1
    assert told(store) == {"a": ("stale", 3), "b": ("fresh", 1)}
    assert write([record("b", 2, "missing"), record("a", 2, "fresh"), record("c", 0)], "two") == 2
    assert told(store) == {"a": ("stale", 3), "b": ("missing", 2), "c": ("fresh", 0)}
    assert write([record("b", 9)], "two") == 2 and told(store)["b"] == ("missing", 2)  # the token is known
    assert write([], "three") == 3 and len(told(store)) == 3
    assert {r.document for r in store.read(1).collect()} == {"a", "b"}
    store.expire(1)
    assert told(store)["a"] == ("stale", 3) and write([record("z", 1)], "one") == 1
    assert not [x for x in (tmp_path / "manifest").iterdir() if x.name.startswith("draft")]


def test_writers_that_meet_lose_nothing(spark, store):
    errors = []

    def write(k):
        try:
            store.upsert(spark.createDataFrame([record(f"d{k}", k), record("shared", k, f"s{k}")], MANIFEST), f"token {k}")
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and store._versions() == [1, 2, 3, 4, 5, 6]
    assert told(store) == {**{f"d{k}": ("fresh", k) for k in range(6)}, "shared": ("s5", 5)}


def test_a_writer_that_dies_before_its_claim_changes_nothing(spark, store, monkeypatch):
    store.upsert(spark.createDataFrame([record("a", 1)], MANIFEST), "one")
    monkeypatch.setattr(ManifestStore, "_claim", lambda *_: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        store.upsert(spark.createDataFrame([record("a", 5, "stale")], MANIFEST), "two")
    monkeypatch.undo()
    assert told(store) == {"a": ("fresh", 1)}
    assert store.upsert(spark.createDataFrame([record("a", 5, "stale")], MANIFEST), "two") == 2


def test_records_of_inspected_documents(spark):
    schema = "document string, input_path string, input_hash string, markdown_hash string, sections_hash string, tree_source_markdown_hash string, parse_status string, page_index_status string, document_kind string, sections array<string>, images array<string>, error string, updated_at timestamp"
    at = datetime.datetime(2026, 1, 1)
    rows = [("a", "p", "h", "m", "s", "t", "fresh", "fresh", None, ["1", "2"], ["x.png", "y.PNG", "z.jpg"], None, at), ("b", "p", "h", "m", "s", "t", "fresh", "fresh", "non-hs-reference", ["1"], None, "new", at), ("c", "p", "h", "m", "s", "t", "fresh", "fresh", "hs-chapter", None, [], None, at)]
    before = spark.createDataFrame([record("a", 1, error="old"), record("b", 1, error="old")], MANIFEST)
    got = {r.document: (r.document_type, r.hs_section_count, r.image_count, r.error) for r in manifest_records(spark.createDataFrame(rows, schema), before).collect()}
    assert got == {"a": ("hs-chapter", 2, 2, "old"), "b": ("non-hs-reference", 1, 0, "new"), "c": ("non-hs-reference", 0, 0, None)}
