"""Near duplicates: MinHash bands propose, odd sketches estimate, full shingle sets confirm.

Documents with equal shingle sets collapse first. Bands join the distinct sets into families (everything
reachable through shared buckets). A family is cut into blocks, and every pair of blocks is looked at in
one task: odd sketches (MinHash samples folded into a parity bitmap) rank the pairs by the population
count of their XOR, and full sets decide, as long as a pair is not yet connected by confirmed links.
Only a spanning forest leaves a task, so no group of copies is ever written out as pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossierlake.llm.common import BASE, BASE_INV, SECOND, SECOND_INV, Words, map_batches, mix, range_hash, signed, slices, staged, text_mark, text_or_empty, texts_of, without
from dossierlake.llm.graph import components

SAMPLES = 512
BITS = 2048
ROWS = 4
#: How far below the threshold an estimate may lie and the pair still be checked: over five standard errors.
MARGIN = 0.1
BLOCK = 256
_RNG = np.random.Generator(np.random.PCG64(20240229))
_MULTIPLY = _RNG.integers(0, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2)
_PLACE = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64))


def bands_for(similarity: float, miss: float = 1e-6) -> int:
    """Bands of ROWS samples so that a pair at the threshold shares none with a probability of at most `miss`."""
    return math.ceil(math.log(miss) / math.log(1 - similarity**ROWS))


def shingle_sets(texts: list[str], shingle: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles; a shorter text has its whole sequence as one, one without words none."""
    w = Words(texts, lower=True)
    out = []
    for lo, n in zip(w.bounds[:-1], w.counts, strict=True):
        if not n:
            out.append(np.zeros(0, np.uint64))
        else:
            at = lo + np.arange(max(1, n - shingle + 1))
            out.append(np.unique(range_hash(w.hashes[lo : lo + n], at - lo, np.minimum(at - lo + shingle, n))))
    return out


def minhash(items: np.ndarray) -> np.ndarray:
    """SAMPLES minima over the items, in tiles so that a long text needs no more memory than a short one."""
    least = np.full(SAMPLES, ~np.uint64(0), np.uint64)
    for i in range(0, len(items), 256):
        part = items[i : i + 256, None] * _MULTIPLY[None, :]
        part += _ADD
        np.minimum(least, part.min(axis=0), out=least)
    return least


def odd_sketch(samples: np.ndarray) -> bytes:
    """The samples, each with its place, toggled into BITS parity bits."""
    at = (mix(samples ^ _PLACE) % np.uint64(BITS)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=BITS) & 1).astype(np.uint8)).tobytes()


def estimate(differing_bits: np.ndarray) -> np.ndarray:
    """Similarity from the number of bits in which two odd sketches differ."""
    share = np.minimum(2 * differing_bits / BITS, 1 - 1e-9)
    return 1 + BITS / 2 * np.log1p(-share) / (2 * SAMPLES)


def signatures(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """doc_id, mark (a check of the text), n_shingles, the set's 128-bit hash, band keys and odd sketch."""
    bands = bands_for(similarity)
    at = np.arange(bands) * ROWS

    def work(part: pa.RecordBatch) -> dict:
        sets = shingle_sets(texts_of(part), shingle)
        out: dict[str, list] = {"doc_id": part.column("doc_id"), "mark": part.column("mark"), "n_shingles": [len(x) for x in sets], "s1": [], "s2": [], "bands": [], "odd": []}
        for x in sets:
            end = np.array([len(x)])
            out["s1"].append(int(signed(range_hash(x, end * 0, end, BASE, BASE_INV))[0]))
            out["s2"].append(int(signed(range_hash(x, end * 0, end, SECOND, SECOND_INV))[0]))
            m = minhash(x)
            out["bands"].append(signed(mix(range_hash(m, at, at + ROWS) + _PLACE[:bands])) if len(x) else [])
            out["odd"].append(odd_sketch(m) if len(x) else b"")
        return out

    rows = docs.select("doc_id", text_mark(), text_or_empty().alias("text"))
    return map_batches(rows, work, "doc_id long, mark long, n_shingles long, s1 long, s2 long, bands array<long>, odd binary")


class Forest:
    """Union-find over places of one task."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        self.up[self.find(x)] = self.find(y)


def links_between(left: list[int], right: list[int], odd: np.ndarray, sets: list[np.ndarray], similarity: tuple[int, int]) -> list[tuple[int, int]]:
    """A spanning forest of the true links between two blocks (or inside one, if they are the same)."""
    part, whole = similarity
    sizes = np.array([len(x) for x in sets])
    a_all, b_all, d_all = [], [], []
    for k, a in enumerate(left):
        others = np.array(right[k + 1 :] if left is right else right, np.int64)
        if not len(others):
            continue
        d = np.bitwise_count(odd[others] ^ odd[a]).sum(axis=1)
        near = (estimate(d) >= part / whole - MARGIN) & (np.minimum(sizes[others], sizes[a]) * whole >= np.maximum(sizes[others], sizes[a]) * part)
        a_all.append(np.full(near.sum(), a))
        b_all.append(others[near])
        d_all.append(d[near])
    if not a_all:
        return []
    a_all, b_all, d_all = map(np.concatenate, (a_all, b_all, d_all))
    forest, out = Forest(len(sets)), []
    for i in np.argsort(d_all, kind="stable"):
        a, b = int(a_all[i]), int(b_all[i])
        if forest.find(a) != forest.find(b):
            shared = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if whole * shared >= part * (sizes[a] + sizes[b] - shared):
                forest.join(a, b)
                out.append((a, b))
    return out


def _confirmed(members: DataFrame, shingle: int, similarity: tuple[int, int]) -> DataFrame:
    """Links (a, b) of the block pairs, which arrive sorted by family and block pair."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, blocks, odd, sets = None, [], [], [], []
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def close() -> pa.RecordBatch | None:
            if len(ids) < 2:
                return None
            _, i, j = key
            left = [k for k, x in enumerate(blocks) if x == i]
            right = left if i == j else [k for k, x in enumerate(blocks) if x == j]
            found = links_between(left, right, np.frombuffer(b"".join(odd), np.uint64).reshape(len(odd), -1), sets, similarity)
            return pa.RecordBatch.from_arrays([pa.array([ids[a] for a, _ in found], pa.int64()), pa.array([ids[b] for _, b in found], pa.int64())], schema=schema) if found else None

        for batch in batches:
            for part in slices(batch):
                rows = zip(*(part.column(k).to_pylist() for k in ("family", "i", "j", "doc_id", "block", "odd")), shingle_sets(texts_of(part), shingle), strict=True)
                for family, i, j, doc_id, block, sketch, items in rows:
                    if (family, i, j) != key:
                        if (out := close()) is not None:
                            yield out
                        key, ids, blocks, odd, sets = (family, i, j), [], [], [], []
                    ids.append(doc_id)
                    blocks.append(block)
                    odd.append(sketch)
                    sets.append(items)
        if (out := close()) is not None:
            yield out

    sorted_ = members.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "doc_id")
    return sorted_.mapInArrow(work, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) and kept for every document.

    A link: similarity[1] * |intersection| >= similarity[0] * |union| of the sets of word shingles, A-Z
    lowered. Null and empty texts have an empty set and link with nothing. Rows that share an id are judged
    by their own texts, but stand for one node where they represent their sets. A row without an id links with nothing, has a null
    component and is kept. Repeated rows repeat. An empty table gives no rows; columns besides doc_id
    and text are not read.
    """
    return _judged(docs, shingle, similarity).drop("mark")


def _judged(docs: DataFrame, shingle: int, similarity: tuple[int, int]) -> DataFrame:
    """near_duplicates, with the mark of each row's text."""
    signed_ = staged(signatures(docs, shingle, similarity[0] / similarity[1]), "signatures")
    usable = signed_.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    best = F.min(F.struct("doc_id", "mark"))
    distinct = staged(usable.groupBy("s1", "s2").agg(best.alias("rep"), F.any_value("bands").alias("bands"), F.any_value("odd").alias("odd")).select("s1", "s2", F.col("rep.doc_id").alias("rep"), F.col("rep.mark").alias("mark"), "bands", "odd"), "distinct-sets")

    filed = distinct.select("rep", F.explode("bands").alias("bucket"))
    shared = staged(filed.groupBy(F.col("bucket").alias("bucket_")).agg(F.min("rep").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "shared-buckets")
    near = filed.join(shared, F.col("bucket") == F.col("bucket_")).select(F.col("rep").alias("a"), F.col("first").alias("b"))
    families = staged(components(near), "families").withColumnsRenamed({"node": "node_", "component": "family"})

    blocks = families.groupBy(F.col("family").alias("family_")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = families.join(blocks, F.col("family") == F.col("family_")).select("node_", "family", "blocks", F.pmod(F.xxhash64("node_"), F.col("blocks")).cast("int").alias("block"))
    sketches = distinct.select("rep", F.col("mark").alias("mark_"), "odd")
    known = staged(placed.join(sketches, F.col("node_") == F.col("rep")).drop("rep"), "family-members")
    rows = docs.select("doc_id", text_mark(), text_or_empty().alias("text"))
    with_text = rows.join(known, (F.col("doc_id") == F.col("node_")) & (F.col("mark") == F.col("mark_")))
    paired = with_text.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "doc_id", "block", "odd", "text")
    links = components(_confirmed(paired, shingle, similarity)).withColumnsRenamed({"node": "node_", "component": "linked"})

    classes = distinct.join(links, F.col("rep") == F.col("node_"), "left").select(F.col("s1").alias("s1_"), F.col("s2").alias("s2_"), F.coalesce("linked", "rep").alias("class"))
    classes = staged(classes, "classes")
    told = signed_.select("doc_id", "mark", "n_shingles", "s1", "s2").join(classes, (F.col("s1") == F.col("s1_")) & (F.col("s2") == F.col("s2_")) & (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), "left")
    component = F.coalesce("class", "doc_id")
    return told.select("doc_id", "mark", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """The documents that stay, one of each group, with all their columns, whatever their names.

    Rows are told apart by id and text: of rows that share an id only those in a group with a smaller id go. Rows without an
    id and without words stay; rows that repeat stay or go together; an empty table gives no rows.
    """
    return without(docs, _judged(docs, shingle, similarity).filter("NOT kept").select("doc_id", "mark"), "dropped-documents")
