"""Importance resampling towards a target distribution by a dictionary of distinct features.

Features are runs of one to three words. They are counted as strings over all texts, every distinct string
is hashed once, and the counts are summed by bucket. The buckets' gains (a table of fixed size) are then
joined back to the features of each document. Inside a task the words are numbered by an Arrow dictionary,
so that runs are pairs of whole numbers until they leave the task as strings.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossierlake.llm.common import LOWER, give_back, slices, staged, text_or_empty

BUCKETS = 10_000
#: Bytes of text whose features are brought together before they leave a task.
CHUNK = 6 << 20
#: Bytes of text for which there is a shard of the dictionary.
SHARD_BYTES = 4 << 20
SPACE = pa.scalar(b" ", pa.large_binary())
#: Runs sampled for each shard, to find where shards part.
SAMPLED = 32
#: Words of more bytes are hashed byte by byte where they end a run.
LONG = 200
#: Bytes that are no part of a word: ASCII other than digits and letters. UTF-8 writes all other code points above them.
APART = np.ones(256, bool)
APART[0x30:0x3A] = APART[0x41:0x5B] = APART[0x61:0x7B] = APART[0x80:] = False


class Runs:
    """The words of many texts, numbered in their order, and their distinct runs of one, two and three words."""

    def __init__(self, texts: pa.Array):
        plain = [x or b"" for x in texts.cast(pa.binary()).to_pylist()]
        lengths = np.fromiter(map(len, plain), np.int64, len(plain))
        joined = np.frombuffer(b" ".join([*plain, b""]) or b" ", np.uint8)
        ends = np.cumsum(lengths + 1)
        apart = APART[joined]
        edge = np.flatnonzero(np.diff(apart, prepend=True))  # where words start and end, by turns; the last byte is apart
        starts, stops = edge[::2], edge[1::2]
        offsets = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(stops - starts, out=offsets[1:])
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(LOWER[joined[~apart]])])
        coded = words.dictionary_encode()
        order = pc.array_sort_indices(coded.dictionary)
        self.words = coded.dictionary.take(order)
        number = np.empty(len(order), np.int64)
        number[order.to_numpy()] = np.arange(len(order))
        #: By run length: the run's number at each place where a run of that length starts, and the place's text.
        self.at: list[np.ndarray] = [number[coded.indices.to_numpy()]]
        self.n_words = np.diff(np.searchsorted(starts, ends), prepend=0)
        owner = np.repeat(np.arange(len(plain)), self.n_words)
        self.owner: list[np.ndarray] = [owner]
        #: For each distinct longer run: the number of the run without its last word, and its last word.
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        for n in (2, 3):
            same = owner[n - 1 :] == owner[: max(len(owner) - n + 1, 0)]
            head, last = self.at[-1][: len(same)] if n == 2 else self._heads(same), self.at[0][n - 1 :]
            pairs, number = np.unique(head[same] * max(len(self.words), 1) + last[same], return_inverse=True)
            self.at.append(number)
            self.owner.append(owner[: len(same)][same])
            self.parts.append(np.divmod(pairs, max(len(self.words), 1)))

    def _heads(self, same: np.ndarray) -> np.ndarray:
        """The number of the two-word run at each place where a run of three could start."""
        out = np.zeros(len(same), np.int64)
        there = self.owner[0][1:] == self.owner[0][:-1] if len(self.owner[0]) else np.zeros(0, bool)
        full = np.zeros(len(there), np.int64)
        full[there] = self.at[1]
        out[:] = full[: len(same)]
        return out

    def strings(self) -> Iterator[tuple[pa.Array, np.ndarray]]:
        """The distinct runs as strings, and how often each stands in the texts."""
        (first, second), (two, third) = self.parts
        yield self.words, np.bincount(self.at[0], minlength=len(self.words))
        pairs = pc.binary_join_element_wise(self.words.take(pa.array(first)), self.words.take(pa.array(second)), SPACE)
        yield pairs, np.bincount(self.at[1], minlength=len(pairs))
        yield pc.binary_join_element_wise(pairs.take(pa.array(two)), self.words.take(pa.array(third)), SPACE), np.bincount(self.at[2], minlength=len(two))

    def buckets(self, buckets: int) -> Iterator[np.ndarray]:
        """The buckets of the distinct runs: the hash of each is made once, out of those of its head and its last word."""
        crc = np.fromiter(map(zlib.crc32, self.words.to_pylist()), np.uint32, len(self.words))
        spaced = np.fromiter((zlib.crc32(b" " + x) for x in self.words.to_pylist()), np.uint32, len(self.words))
        length = pc.binary_length(self.words).to_numpy().astype(np.int64) + 1
        yield crc.astype(np.int64) % buckets
        for head, last in self.parts:
            before, long = crc[head], np.flatnonzero(length[last] > LONG)
            crc = shifted(before, np.minimum(length[last], LONG)) ^ spaced[last]
            crc[long] = [zlib.crc32(b" " + self.words[int(w)].as_py(), int(c)) for w, c in zip(last[long], before[long], strict=True)]
            yield crc.astype(np.int64) % buckets


def _byte_step(crc: np.ndarray) -> np.ndarray:
    """CRC-32 registers after one more byte, of zeros."""
    for _ in range(8):
        crc = (crc >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (crc & np.uint32(1)))
    return crc


def shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRC-32 sums carried over n bytes each: crc(a + b) = shifted(crc(a), len(b)) ^ crc(b). A shift is linear in the bits."""
    out = np.empty_like(crc)
    most = int(n.max(initial=0))
    order = np.argsort(n, kind="stable")
    ends = np.searchsorted(n[order], np.arange(most + 2))
    step = np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], np.uint32)  # by byte of the register, its image
    for k in range(most + 1):
        if (at := order[ends[k] : ends[k + 1]]).size:
            x = crc[at]
            out[at] = step[0][x & 255] ^ step[1][x >> 8 & 255] ^ step[2][x >> 16 & 255] ^ step[3][x >> 24]
        step = _byte_step(step)
    return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, size = [], 0
    for batch in batches:
        for part in slices(batch, CHUNK):
            n = pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
            if held and size + n > CHUNK:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
            held.append(part)
            size += n
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _texts(chunk: pa.Table) -> pa.Array:
    column = chunk.column("text")
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays([pa.array([], column.type), *column.chunks])


def _packed(features: pa.Array, n: np.ndarray) -> bytes:
    """Features in word order, so that each shares its beginning with the one before, and their counts."""
    out = pa.BufferOutputStream()
    block = pa.table({"feature": features.cast(pa.binary()), "n": pa.array(n, pa.int32())})
    pq.write_table(block, out, compression="zstd", use_dictionary=False, column_encoding={"feature": "DELTA_BYTE_ARRAY", "n": "DELTA_BINARY_PACKED"}, write_statistics=False, store_schema=False)
    return out.getvalue().to_pybytes()


def _splitters(docs: DataFrame, shards: int, total: int) -> list[bytes]:
    """Features, in order, that part those of all texts into about equal shares: quantiles of SAMPLED runs a share, taken
    at even distances through all texts from a start that the text's hash decides, each once. They only balance the shares."""
    text, letters = text_or_empty(), "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    step = F.lit(max(1, total // (SAMPLED * shards)))
    start = F.pmod(F.xxhash64(text), step)
    places = F.when(start < F.length(text), F.sequence(start, F.length(text).cast("long") - 1, step))
    pieces = docs.select(F.explode(F.transform(places, lambda at: F.substr(text, (at + 1).cast("int"), F.lit(100)))).alias("piece"))
    words = F.regexp_extract_all(F.translate("piece", letters, letters.lower()), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    run = F.array_join(F.slice(words, 2, 3), " ")  # the first may be cut
    runs = sorted(r.run.encode() for r in pieces.select(run.alias("run")).filter("run <> ''").distinct().collect())
    return sorted({runs[k * len(runs) // shards] for k in range(1, shards)}) if runs else []


def feature_counts(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """feature, n: how often each run of one to three words stands in all texts (null: none).

    Tasks count their distinct runs and send them, packed, to the shard whose range of runs they lie in; a run
    costs an entry per task however often it stands there, and the runs that go on from one frequent word
    may lie in many shards. Shards are as many as the bytes of all texts ask for, so each fits a task.
    """
    schema = pa.schema([("shard", pa.int64()), ("packed", pa.binary())])
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    splitters = _splitters(docs, max(1, math.ceil(total / shard_bytes)), total)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            kinds = []
            for features, n in Runs(_texts(chunk)).strings():  # in order, since a blank sorts before all that words hold
                kinds.append((features, n, [0, *(bisect_left(features, x, key=lambda f: f.as_py()) for x in splitters), len(n)]))
            shards, packed = [], []
            for k in range(len(splitters) + 1):
                parts = [(f.slice(e[k], e[k + 1] - e[k]), n[e[k] : e[k + 1]]) for f, n, e in kinds]
                if any(len(n) for _, n in parts):
                    shards.append(k)
                    packed.append(_packed(pa.concat_arrays([f for f, _ in parts]), np.concatenate([n for _, n in parts])))
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), pa.array(packed, pa.binary())], schema=schema)
            give_back()

    def together(group: pa.Table) -> pa.Table:
        blocks = pa.concat_tables(pq.read_table(pa.BufferReader(x)) for x in group.column("packed").to_pylist())
        counted = blocks.group_by("feature").aggregate([("n", "sum")])
        del blocks
        give_back()
        return pa.table({"feature": counted.column("feature").cast(pa.string()), "n": counted.column("n_sum").cast(pa.int64())})

    parts = docs.select(text_or_empty().alias("text")).mapInArrow(work, "shard long, packed binary")
    return parts.groupBy("shard").applyInArrow(together, "feature string, n long")


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: the features of all texts by bucket; each distinct string of the whole table is hashed once."""
    bucket = F.pmod(F.crc32(F.col("feature").cast("binary")), F.lit(buckets)).alias("bucket")
    return feature_counts(docs).groupBy(bucket).agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """For each bucket floor(1000 ln((t+1)(S+buckets)/((s+1)(T+buckets)))): an array whose size does not depend on the data."""
    counts = []
    for table in (docs, target):
        n = np.zeros(buckets, np.int64)
        for r in bucket_counts(table, buckets).collect():  # a row for each bucket at most
            n[r.bucket] = r.n
        counts.append(n)
    s, t = counts
    low, high = int(s.sum()) + buckets, int(t.sum()) + buckets
    return np.array([math.floor(1000 * math.log((b + 1) * low / ((a + 1) * high))) for a, b in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def importance_weights(docs: DataFrame, gains: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight for every document: the sum of the gains of its features, repeats counted."""
    kept = docs.sparkSession.sparkContext.broadcast(gains)  # 80 KB
    schema = pa.schema([(x, pa.int64()) for x in ("doc_id", "n_words", "n_features", "weight")])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = kept.value
        for chunk in _chunks(batches):
            runs = Runs(_texts(chunk))
            n, weight = np.zeros(len(chunk), np.int64), np.zeros(len(chunk), np.int64)
            for number, owner, bucket in zip(runs.at, runs.owner, runs.buckets(len(gain)), strict=True):
                total = np.concatenate([[0], np.cumsum(gain[bucket][number])])
                ends = np.searchsorted(owner, np.arange(len(chunk) + 1))
                n += np.diff(ends)
                weight += total[ends[1:]] - total[ends[:-1]]
            ids = pa.concat_arrays([pa.array([], pa.int64()), *chunk.column("doc_id").chunks])
            yield pa.RecordBatch.from_arrays([ids, pa.array(runs.n_words), pa.array(n), pa.array(weight)], schema=schema)
            give_back()

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(work, "doc_id long, n_words long, n_features long, weight long")


def _noise(seed: int) -> Column:
    """floor(-1000 ln(-ln(u))) with u from the SHA-256 of the seed and the id; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(u)))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; rank is null for documents not drawn.

    Of the N documents with at least `least_words` words the floor(percent * N / 100) of the highest scores are
    drawn, ties to the smaller doc_id, a null id last. A null or empty text has no features, weight 0 and is not
    drawn. Repeated rows are documents of their own and count in all sums. Empty tables give no rows; an empty
    target leaves t and T at 0. Columns besides doc_id and text are not read.
    """
    gains = bucket_gains(docs, target, buckets)
    scored = staged(importance_weights(docs, gains).withColumn("score", F.col("weight") + _noise(seed)), "scored")
    best = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features")]
    able = F.col("n_words") >= least_words
    n, n_able = scored.agg(F.count(F.lit(1)), F.count(F.when(able, 1))).first()
    drawn = percent * n_able // 100
    # ranges of scores, numbered, whose counts give each range the rank it begins with: no task orders all rows
    ranges = max(1, min(4096, math.ceil(n / 100_000)))
    dealt = staged(scored.filter(able).repartitionByRange(ranges, *best).withColumn("range", F.spark_partition_id()), "ranges")
    counts = {r.range: r["count"] for r in dealt.groupBy("range").count().collect()}  # a row for each range
    before = [0, *np.cumsum([counts.get(k, 0) for k in range(max(counts, default=0))]).tolist()]
    place = F.row_number().over(Window.partitionBy("range").orderBy(*best)) + F.lit(before)[F.col("range")]
    ranked = dealt.withColumn("rank", place.cast("long"))
    rank = F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")
    rest = scored.filter(~able).withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score"]
    return ranked.select(*columns, rank).unionByName(rest.select(*columns, "rank"))
