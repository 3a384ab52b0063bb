"""Language-model scores by logistic context mixing.

A text is coded as binary decisions. Words of a vocabulary are paths in a code tree over words (see
wordmix); any other word is escaped there and spelled here, byte by byte (A-Z lowered), each byte as a path
in a code tree over bytes. White space other than single blanks is spelled too. For every decision several
predictors look up counts under hashed contexts (of the bytes: the last 1, 2, 3 and 5 bytes, the word so
far, and the word so far with the word before). Their log odds are mixed by weights chosen by a gate, and
an adaptive map refines the result.

Training runs over all training texts: each task predicts a chunk with what it has learned, adjusts its
weights, then adds the chunk's counts. Counts are summed over tasks slot by slot and weights averaged.
Scoring uses the merged model, unchanged, on whole texts. Tables grow with the training tokens up to a
bound, so that the model can be broadcast.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossierlake.llm.common import LOWER, SEPARATOR, Words, map_batches, mix, powers, signed, slices, staged, text_or_empty, texts_of
from dossierlake.llm.common import BASE, BASE_INV, give_back
from dossierlake.llm.wordmix import INPUTS, BlockSum, RUNS, Vocabulary, WordModel, WordTrainer, gaps, table_bits

END = 255  # never a byte of UTF-8
ORDERS = (1, 2, 3, 5)
CONTEXTS = len(ORDERS) + 2
GATING = (2, 3, 4)  # the contexts whose counts choose the gate: orders 3 and 5, and the word so far
BITS = 19
SLOTS = 1 << BITS
BLOCK = 1 << 13  # slots summed together
PRIOR = 0.1
SCALE = 512.0  # steps of a stored log odd
GATES = 4**3
MAP = 33
START = 0.2  # the weights at first
RATE = 0.1
PART_BYTES = 1 << 17  # spelled text that is predicted at once, so that its arrays stay in the cache
WORD_PART_BYTES = 1 << 17  # the same of words, which have more decisions at a time
STEP = 1 << 14  # decisions between two changes of the weights
FREQUENT = 1 << 18  # tokens whose counts are broadcast
WORDS = 16  # the first number of the word model's tables in what tasks hand over; LETTERS_MIX and WORDS_MIX are the mixers
LETTERS_MIX, WORDS_MIX = CONTEXTS, WORDS + RUNS + 1
GAP_BYTES = 7  # six separators and a stop


class Code:
    """A binary code tree over the 256 symbols: depth, and node and branch at each level."""

    def __init__(self, counts: np.ndarray):
        weight = counts.astype(np.float64) + counts.sum() / 65536 + 1
        heap = [(float(weight[s]), s, s) for s in range(256)]
        heapq.heapify(heap)
        children: dict[int, tuple[int, int]] = {}
        made = 256
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            children[made] = (a[2], b[2])
            heapq.heappush(heap, (a[0] + b[0], made, made))
            made += 1
        paths: dict[int, list[tuple[int, int]]] = {made - 1: []}
        for node in range(made - 1, 255, -1):
            for branch, child in enumerate(children[node]):
                paths[child] = [*paths[node], (node - 256, branch)]
        self.depth = np.array([len(paths[s]) for s in range(256)], np.int64)
        self.node = np.zeros((int(self.depth.max()), 256), np.uint32)
        self.branch = np.zeros((int(self.depth.max()), 256), np.uint8)
        for s in range(256):
            for level, (node, branch) in enumerate(paths[s]):
                self.node[level, s], self.branch[level, s] = node, branch


def symbols(texts: list[str] | list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts in a row, each text ended by END, and the offsets of the texts."""
    encoded = [x if isinstance(x, bytes) else x.encode("utf-8", "surrogatepass") for x in texts]
    data = LOWER[np.frombuffer(b"\xff".join([*encoded, b""]), np.uint8)]
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in encoded], out=offsets[1:])
    return data, offsets


def context_hashes(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """A 32-bit hash of every context at every symbol; contexts end at their text's start."""
    n = len(data)
    inside = np.arange(n) - np.repeat(offsets[:-1], np.diff(offsets))
    before = []
    for k in range(1, max(ORDERS) + 1):
        b = np.zeros(n, np.uint64)
        b[k:] = data[:-k]
        b[inside < k] = 0
        before.append(b)
    out = []
    packed = np.zeros(n, np.uint64)
    for k, b in enumerate(before, 1):
        packed |= b << np.uint64(8 * (k - 1))
        if k in ORDERS:
            out.append((mix(packed + np.uint64(k << 56)) >> np.uint64(32)).astype(np.uint32))
    # the word so far, and the same with the word before it in the text
    apart = SEPARATOR[data]
    start = np.zeros(n, np.int64)
    begins = np.zeros(n, bool)
    begins[offsets[:-1]] = True
    begins[1:] |= apart[:-1]
    places = np.flatnonzero(begins)
    start[places] = places
    np.maximum.accumulate(start, out=start)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=prefix[1:])
    word = mix((prefix[:n] - prefix[start]) * powers(BASE_INV, n)[start])
    out.append((word >> np.uint64(32)).astype(np.uint32))
    ended = np.where(apart & (start < np.arange(n)), np.arange(n), -1)  # separators that end a word
    np.maximum.accumulate(ended, out=ended)
    ended = ended[start - 1]  # the last one before the word; at 0 what it takes is not used
    last = np.where(ended >= start - inside[start], word[ended], np.uint64(0))
    last[start == 0] = 0
    out.append((mix(word + last * np.uint64(3) + np.uint64(1)) >> np.uint64(32)).astype(np.uint32))
    return out


def slot_of(context: np.ndarray, node: np.ndarray) -> np.ndarray:
    x = node * np.uint32(0x9E3779B1)
    x ^= context
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(15)
    x &= np.uint32(SLOTS - 1)
    return x.astype(np.intp)


def decisions(code: Code, data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Level by level: the symbols that still have a decision, its node and its branch."""
    here = np.arange(len(data))
    for level in range(len(code.node)):
        here = here[code.depth[data[here]] > level]
        if not len(here):
            return
        yield here, code.node[level][data[here]], code.branch[level][data[here]]


def pack_odds(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log odds and a class of how much was seen, in 16 bits."""
    n = n0 + n1
    odds = np.log((n1 + n1.dtype.type(PRIOR)) / (n0 + n0.dtype.type(PRIOR)))
    seen = (n >= 1).astype(np.int16) + (n >= 4) + (n >= 32)
    return (np.clip(np.rint(odds * SCALE), -8191, 8191).astype(np.int16) << 2) | seen


class Mixer:
    """Gated weights and the adaptive map."""

    def __init__(self, weights: np.ndarray | None = None, map_: np.ndarray | None = None, inputs: int = CONTEXTS):
        # one row of gates per predictor
        self.weights = np.full((inputs, GATES), START, np.float32) if weights is None else weights
        # the map: for each gate and step of the mixed log odds, (branches of 1, all), begun with the odds themselves
        if map_ is None:
            middle = 1 / (1 + np.exp(-np.linspace(-8, 8, MAP)))
            map_ = np.stack([np.tile(middle * 8, (GATES, 1)), np.full((GATES, MAP), 8.0)])
        self.map = map_
        self.grown = np.zeros(GATES)

    def inputs(self, packed: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        """Log odds per context, and the gate: how much the longer contexts have seen."""
        odds = [(p >> 2).astype(np.float32) * np.float32(1 / SCALE) for p in packed]
        gate = packed[GATING[0]] & 3
        gate |= (packed[GATING[1]] & 3) << 2
        gate |= (packed[GATING[2]] & 3) << 4
        return odds, gate.astype(np.intp)

    def mixed(self, odds: list, gate: np.ndarray) -> np.ndarray:
        """The mixed log odds; of predictors that say little, the decisions and their log odds are given."""
        out = odds[0] * self.weights[0].take(gate)
        for k in range(1, len(self.weights)):
            if isinstance(odds[k], tuple):
                at, x = odds[k]
                out[at] += x * self.weights[k].take(gate[at])
            else:
                out += odds[k] * self.weights[k].take(gate)
        return np.clip(out, -12, 12, out=out)

    @staticmethod
    def place(mixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.clip(mixed, -7.999, 7.999)
        x += 8
        x *= (MAP - 1) / 16
        low = x.astype(np.intp)
        x -= low
        return low, x

    def refined(self, mixed: np.ndarray, gate: np.ndarray, rates: np.ndarray) -> np.ndarray:
        """Half the mixed probability, half the map's, between its two nearest steps."""
        low, part = self.place(mixed)
        low += gate * MAP
        p = rates.take(low)
        low += 1
        p += (rates.take(low) - p) * part
        p += 1 / (1 + np.exp(-mixed))
        p *= 0.5
        return p

    def rates(self) -> np.ndarray:
        return (self.map[0] / self.map[1]).ravel().astype(np.float32)

    def learn(self, odds: list, gate: np.ndarray, branch: np.ndarray) -> None:
        """Steps of every gate's weights along the gradient, each divided by its curvature, and the map's counts."""

        def part(o, i: int):
            if not isinstance(o, tuple):
                return o[i : i + STEP]
            a, b = np.searchsorted(o[0], (i, i + STEP))
            return o[0][a:b] - i, o[1][a:b]

        for i in range(0, len(gate), STEP):
            self._step([part(o, i) for o in odds], gate[i : i + STEP], branch[i : i + STEP])

    def _step(self, odds: list, gate: np.ndarray, branch: np.ndarray) -> None:
        m = self.mixed(odds, gate)
        p = 1 / (1 + np.exp(-m))
        error, curve = branch.astype(np.float32) - p, p * (1 - p)
        n = np.bincount(gate, minlength=GATES)
        for k in range(len(self.weights)):
            if isinstance(odds[k], tuple):
                at, own = odds[k]
                g, e, c = gate[at], error[at], curve[at]
            else:
                own, g, e, c = odds[k], gate, error, curve
            push = np.bincount(g, own * e, GATES)
            c = c * own
            c *= own
            self.weights[k] += (RATE * push / (np.bincount(g, c, GATES) + 0.01 * n + 1)).astype(np.float32)
        # the nearest step of the map
        np.clip(m, -8, 8, out=m)
        m += 8
        m *= (MAP - 1) / 16
        at = np.rint(m, out=m).astype(np.intp)
        at += gate * MAP
        at *= 2
        at += branch
        seen = np.bincount(at, minlength=2 * GATES * MAP).reshape(GATES, MAP, 2)
        self.map[0] += seen[:, :, 1]
        self.map[1] += seen.sum(axis=2)
        self.grown += n

    def data(self) -> bytes:
        """The weights by how much they have learned, that itself, and the map: what is added up over tasks."""
        return zlib.compress(np.concatenate([(self.weights * self.grown).ravel(), self.grown, self.map[0].ravel(), self.map[1].ravel()]).astype("<f8").tobytes(), 1)

    @classmethod
    def merged(cls, raw: bytes, inputs: int = CONTEXTS) -> Mixer:
        w, grown, ones, all_ = np.split(np.frombuffer(raw, "<f8"), np.cumsum([GATES * inputs, GATES, GATES * MAP]))
        w = np.where(grown > 0, w.reshape(inputs, GATES) / np.maximum(grown, 1), START)
        return cls(w.astype(np.float32), np.stack([ones.reshape(GATES, MAP), all_.reshape(GATES, MAP)]), inputs)


class Trainer:
    """Counts and weights of one task's spelled words."""

    def __init__(self, code: Code):
        self.code, self.mixer, self.parts = code, Mixer(), 0
        self.counts = np.zeros((CONTEXTS, 2 * SLOTS), np.uint32)

    def add(self, texts: list[str] | list[bytes]) -> None:
        data, offsets = symbols(texts)
        contexts = context_hashes(data, offsets)
        learn = self.parts > 0  # before the first part is counted, all log odds are zero
        seen: list[list[np.ndarray]] = [[] for _ in range(CONTEXTS)]
        for here, node, branch in decisions(self.code, data):
            own = [slot_of(c[here], node) for c in contexts]
            for x in own:
                x *= 2
            if learn:
                counts = [(self.counts[k].take(x).astype(np.float32), self.counts[k].take(x + 1).astype(np.float32)) for k, x in enumerate(own)]
                odds, gate = self.mixer.inputs([pack_odds(n0, n1) for n0, n1 in counts])
                self.mixer.learn(odds, gate, branch)
            for k, x in enumerate(own):
                x += branch
                seen[k].append(x)
        for k in range(CONTEXTS):
            np.add.at(self.counts[k], np.concatenate(seen[k]), np.uint32(1))
        self.parts += 1

    def rows(self) -> Iterator[dict]:
        for k in range(CONTEXTS):
            for b in range(SLOTS // BLOCK):
                part = self.counts[k, 2 * b * BLOCK : 2 * (b + 1) * BLOCK]
                if part.any():
                    yield {"what": k, "block": b, "data": zlib.compress(part.tobytes(), 1)}
        yield {"what": LETTERS_MIX, "block": 0, "data": self.mixer.data()}


_PIECE = pa.schema([("what", pa.int32()), ("block", pa.int32()), ("data", pa.binary())])


def _summed(parts: DataFrame) -> DataFrame:
    """The parts of each (what, block) added up, in an order that their contents decide; a task holds one block at a time."""

    class Whole:
        """Sums of arrays: counts of spelled words (packed at the end) and mixers."""

        def __init__(self, packed: bool):
            self.kind, self.sum, self.total = (np.uint32, np.uint64, None) if packed else ("<f8", "<f8", None)

        def add(self, data: bytes) -> None:
            own = np.frombuffer(zlib.decompress(data), self.kind).astype(self.sum)
            self.total = own if self.total is None else self.total + own

        def packed(self, pack) -> bytes:
            return zlib.compress((self.total if self.kind == "<f8" else pack(*self.total.astype(np.float64).reshape(-1, 2).T)).tobytes(), 1)

    def fresh(what: int) -> Whole | BlockSum:
        return BlockSum(what < WORDS + RUNS) if WORDS <= what < WORDS_MIX else Whole(what < CONTEXTS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if (row["what"], row["block"]) != key:
                    if key is not None:
                        yield pa.RecordBatch.from_pylist([{"what": key[0], "block": key[1], "data": total.packed(pack_odds)}], _PIECE)
                    key, total = (row["what"], row["block"]), fresh(row["what"])
                total.add(row["data"])
        if key is not None:
            yield pa.RecordBatch.from_pylist([{"what": key[0], "block": key[1], "data": total.packed(pack_odds)}], _PIECE)

    sorted_ = parts.repartition("what", "block").sortWithinPartitions("what", "block", F.xxhash64("data"))
    return sorted_.mapInArrow(work, "what int, block int, data binary")


class Model:
    """The merged model of spelled words: packed log odds per context and slot, weights and map."""

    def __init__(self, code_counts: np.ndarray, pieces: list[tuple[int, int, bytes]]):
        self.code = Code(code_counts)
        self.odds = np.zeros((CONTEXTS, SLOTS), np.int16)
        self.mixer = Mixer()
        for what, block, data in pieces:
            raw = zlib.decompress(data)
            if what < CONTEXTS:
                self.odds[what, block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(raw, np.int16)
            else:
                self.mixer = Mixer.merged(raw)
        self.rates = self.mixer.rates()

    def log10(self, texts: list[str] | list[bytes]) -> np.ndarray:
        """The log10 probability of each whole text, spelled."""
        data, offsets = symbols(texts)
        contexts = context_hashes(data, offsets)
        whole = np.ones(len(data))  # of each symbol: the product over its few decisions
        for here, node, branch in decisions(self.code, data):
            odds, gate = self.mixer.inputs([self.odds[k].take(slot_of(c[here], node)) for k, c in enumerate(contexts)])
            p = self.mixer.refined(self.mixer.mixed(odds, gate), gate, self.rates)
            # the probability of the branch taken
            np.subtract(1, p, out=p, where=branch == 0)
            whole[here] *= np.maximum(p, 1e-6, out=p)
        return np.add.reduceat(np.log10(whole), offsets[:-1]) if len(texts) else np.zeros(0)


def held_out() -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2


TOKENS = 1 << 21  # token hashes that a task holds before it counts them


def _tokens(docs: DataFrame) -> DataFrame:
    """Per task: token hashes with counts (kind 0; the end token is hash 0), byte counts (kind 1), and gaps (kind 2; 0 and 1 between words, 2 and 3 at an edge, odd ones plain).

    A task counts what it holds whenever that reaches TOKENS; where most of that stays apart, it is handed on.
    """
    schema = "kind int, key long, n long"

    def rows(kind: int, key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(key), 1 << 16):
            own = key[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), kind, np.int32)), pa.array(own.astype(np.int64)), pa.array(n[i : i + (1 << 16)].astype(np.int64))], names=["kind", "key", "n"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0
        bytes_, kinds, texts_seen = np.zeros(256, np.int64), np.zeros(4, np.int64), 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            own, back = np.unique(np.concatenate(keys), return_inverse=True)
            return own, np.bincount(back, np.concatenate(counts), len(own)).astype(np.int64)

        for batch in batches:
            for part in slices(batch, 1 << 20):
                texts = texts_of(part)
                w = Words(texts, lower=True)
                own, n = np.unique(w.hashes, return_counts=True)
                keys.append(signed(own))
                counts.append(n)
                held += len(own)
                bytes_ += np.bincount(symbols(texts)[0], minlength=256)
                _, edge, plain, _ = gaps(w)
                kinds += np.bincount(2 * edge + plain, minlength=4)
                texts_seen += len(texts)
                if held >= TOKENS:
                    own, n = summed()
                    if 2 * len(own) > TOKENS:
                        yield from rows(0, own, n)
                        own, n = own[:0], n[:0]
                    keys, counts, held = [own], [n], len(own)
        if texts_seen:
            own, n = summed()
            yield from rows(0, np.append(own, 0), np.append(n, texts_seen))
            yield from rows(1, np.flatnonzero(bytes_), bytes_[bytes_ > 0])
            yield from rows(2, np.arange(4), kinds)
        give_back()

    return docs.select(text_or_empty().alias("text")).mapInArrow(work, schema)


def spelled(words: Words, numbers: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The words with these numbers, joined text by text, and the texts that have any."""
    if not len(numbers):
        return [], np.zeros(0, np.int64)
    data = words.data.tobytes()
    of = np.searchsorted(words.bounds, numbers, "right") - 1
    own = [data[a:b] for a, b in zip(words.starts[numbers].tolist(), words.ends[numbers].tolist(), strict=True)]
    texts, first = np.unique(of, return_index=True)
    ends = [*first[1:].tolist(), len(own)]
    return [b" ".join(own[a:b]) for a, b in zip(first.tolist(), ends, strict=True)], texts


class TextModel:
    """Words, spelled words and gaps together."""

    def __init__(self, letters: Model, words: WordModel, gap_counts: np.ndarray):
        self.letters, self.words = letters, words
        n = gap_counts.reshape(2, 2) + 0.5
        self.gap_logs = np.log10(n / n.sum(axis=1, keepdims=True))  # by edge and plain

    def log10(self, texts: list[str]) -> np.ndarray:
        """The log10 probability of each whole text."""
        w = Words(texts, lower=True)
        out, escaped, done = np.zeros(len(texts)), [], 0
        sizes = np.cumsum(np.diff(w.offsets))
        while done < len(texts):  # runs of texts of about WORD_PART_BYTES
            end = max(done + 1, int(np.searchsorted(sizes, (sizes[done - 1] if done else 0) + WORD_PART_BYTES, "right")))
            out[done:end], rare = self.words.log10(w.part(done, end))
            escaped.append(rare + w.bounds[done])
            done = end
        own, at = spelled(w, np.concatenate(escaped)) if escaped else ([], None)
        if own:
            out[at] += self.letters.log10(own)
        of, edge, plain, length = gaps(w)
        logs = self.gap_logs[edge.astype(np.intp), plain.astype(np.intp)] - np.where(plain, 0, (length + 1) * math.log10(GAP_BYTES))
        return out + np.bincount(of, logs, len(texts))


def train(docs: DataFrame) -> tuple[TextModel, DataFrame, tuple[np.ndarray, np.ndarray]]:
    """The model, the token counts (key, n) of all given texts, and the frequent ones of them."""
    spark = docs.sparkSession
    counted = staged(_tokens(docs).groupBy("kind", "key").agg(F.sum("n").alias("n")), "token-counts")
    byte_counts, gap_counts = np.zeros(256), np.zeros(4)
    for r in counted.filter("kind > 0").collect():  # 260 rows at most
        (byte_counts if r["kind"] == 1 else gap_counts)[r["key"]] = r["n"]
    counts = counted.filter("kind = 0").select("key", "n")
    n_all, n_texts = (int(x or 0) for x in counts.agg(F.sum("n"), F.sum(F.when(F.col("key") == 0, F.col("n")))).first())
    frequent = frequent_tokens(counts)
    own = (frequent[0] != 0) & (frequent[1] > 1)  # words seen once are escaped, which tells how often new ones come
    vocabulary, bits = Vocabulary(frequent[0][own], frequent[1][own], n_texts, n_all), table_bits(n_all)
    sent = spark.sparkContext.broadcast(vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = words = None
        rare, held = [], 0  # spelled words wait until they make a part
        for batch in batches:
            for part in slices(batch, WORD_PART_BYTES):
                letters = letters or Trainer(Code(byte_counts))
                words = words or WordTrainer(sent.value, bits, Mixer(inputs=INPUTS))
                w = Words(texts_of(part), lower=True)
                own, _ = spelled(w, words.add(w, pack_odds))
                rare += own
                held += sum(map(len, own))
                if held >= PART_BYTES:
                    letters.add(rare)
                    rare, held = [], 0
        if words is not None:
            if rare:
                letters.add(rare)
            rows = []
            for row in (*letters.rows(), *words.rows(WORDS), {"what": WORDS_MIX, "block": 0, "data": words.mixer.data()}):
                rows.append(row)
                if len(rows) == 16:
                    yield pa.RecordBatch.from_pylist(rows, _PIECE)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, _PIECE)
        give_back()

    parts = docs.select(text_or_empty().alias("text")).mapInArrow(work, "what int, block int, data binary")
    merged = staged(_summed(parts), "model")
    pieces = [(r["what"], r["block"], bytes(r["data"])) for r in merged.toLocalIterator()]  # bounded by the tables' sizes
    mixer = next((Mixer.merged(zlib.decompress(d), INPUTS) for what, _, d in pieces if what == WORDS_MIX), Mixer(inputs=INPUTS))
    words = WordModel(vocabulary, bits, mixer, [(what - WORDS, block, data) for what, block, data in pieces if WORDS <= what < WORDS_MIX])
    letters = Model(byte_counts, [x for x in pieces if x[0] <= LETTERS_MIX])
    return TextModel(letters, words, gap_counts), counts, frequent


def frequent_tokens(counts: DataFrame, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and counts of the most frequent tokens, `most` at the most: all those counted at least 2**k times, for the least such k."""
    sizes = dict(counts.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).count().collect())
    held, least = 0, max(sizes, default=0) + 1
    while least - 1 in sizes or least > 0:
        held += sizes.get(least - 1, 0)
        if held > most:
            break
        least -= 1
    rows = counts.filter(F.col("n") >= F.lit(2**least)).toPandas()
    rows = rows.sort_values("key")
    return rows["key"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)


def mixing_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of every document.

    The model learns from the documents whose crc32(doc_id as text) modulo 7 is not 2 (null ids: of the
    empty text) and scores all. Null and empty texts are the end token alone. Rows that repeat are
    learned and scored each on its own. With no training document all predictions are even and no token
    is known. An empty table gives no rows; columns besides doc_id and text are not read.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", text_or_empty().alias("text"), held_out().alias("held_out"))
    model, counts, frequent = train(rows.filter("NOT held_out"))
    n_all, n_kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    sent = spark.sparkContext.broadcast((model, *frequent))

    def work(part: pa.RecordBatch) -> dict:
        model, keys, numbers = sent.value
        texts = texts_of(part)
        w = Words(texts, lower=True)
        of = np.repeat(np.arange(len(texts)), w.counts)
        own = np.concatenate([signed(w.hashes), np.zeros(len(texts), np.int64)])  # with the end of each text
        of = np.concatenate([of, np.arange(len(texts))])
        at = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
        known = (keys[at] == own) if len(keys) else np.zeros(len(own), bool)
        part_sum = np.bincount(of[known], np.log10(numbers[at[known]] + 1.0), len(texts)) if known.any() else np.zeros(len(texts))
        left = np.flatnonzero(~known)
        pairs = mix(own[left].view(np.uint64) + of[left].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, at, n = np.unique(pairs, return_index=True, return_counts=True)
        at = left[at]
        by_text = np.argsort(of[at], kind="stable")
        at, n = at[by_text], n[by_text]
        ends = np.concatenate([[0], np.cumsum(np.bincount(of[at], minlength=len(texts)))]).astype(np.int32)
        rare = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(own[at]), pa.array(n.astype(np.int64))], names=["key", "k"]))
        return {
            "row": part.column("row"), "doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "n_tokens": w.counts + 1, "n_known": np.bincount(of[known], minlength=len(texts)),
            "part_sum": part_sum, "score": model.log10(texts), "n_bytes": np.diff(w.offsets) - 1, "rare": rare,
        }

    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text")
    scored = staged(map_batches(numbered, work, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, part_sum double, score double, n_bytes long, rare array<struct<key:long,k:long>>"), "scored")
    tail = scored.select("row", F.explode("rare").alias("r")).select("row", "r.key", "r.k")
    found = tail.join(counts.select(F.col("key").alias("key_"), "n"), F.col("key") == F.col("key_"))
    sums = found.groupBy(F.col("row").alias("row_")).agg(F.sum(F.col("k") * F.log10(F.col("n") + 1.0)).alias("more"), F.sum("k").alias("k"))
    joined = scored.join(sums, F.col("row") == F.col("row_"), "left")
    base = F.col("part_sum") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(math.log10(n_all + n_kinds + 1))
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(int(n_all)).cast("long").alias("train_tokens"), base.alias("base_score"), "score",
        (-F.col("score") * math.log2(10) / F.greatest(F.col("n_bytes"), F.lit(1))).alias("bits_per_byte"),
    )
