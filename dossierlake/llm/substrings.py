"""Substring dedup: every word covered by a window of words that also starts elsewhere is removed.

Whole corpus against itself (`drop_repeated_windows`): each window is filed under the smallest hash of
its short word grams. Windows that stand in a row under one hash form a segment. Equal windows have
equal smallest hashes, so hashes seen once hold no repeats; segments seen twice are repeats as a whole;
only what is left is settled window by window, by counts of 128-bit hashes. Nothing pairs documents.

Corpus against a bounded reference (`drop_reference_spans`): suffix automata of the reference's shards
are broadcast, documents are streamed through them for matching statistics, and maximal spans from the
threshold up are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossierlake.llm.common import BASE, BASE_INV, SECOND, SECOND_INV, Words, map_batches, range_hash, signed, staged, text_or_empty, texts_of

WINDOW = 35
GRAM = 8


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours, by doubling."""
    done, out = 1, x
    while 2 * done <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    return np.minimum(out[: len(x) - width + 1], out[width - done : len(x) - done + 1]) if width > done else out


def window_starts(w: Words, window: int) -> np.ndarray:
    """Places in the word array where a whole window of one text starts."""
    n = len(w.starts) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(w.counts)), w.counts)
    return np.flatnonzero(of[:n] == of[window - 1 :])


def segments(w: Words, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """First and last window start, smallest gram hash, content hash and a flag for each segment; the flag: a window repeats inside."""
    at = window_starts(w, window)
    if not len(at):
        return (at, at, at.view(np.uint64), at.view(np.uint64), at.astype(bool))
    grams = np.arange(len(w.starts) - gram + 1)
    least = sliding_min(range_hash(w.hashes, grams, grams + gram), window - gram + 1)[at]
    new = np.append(True, (at[1:] != at[:-1] + 1) | (least[1:] != least[:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    run = np.cumsum(new) - 1
    keys = range_hash(w.hashes, at, at + window) + run.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(keys)
    twice = np.zeros(len(first), bool)
    twice[run[order[1:][keys[order[1:]] == keys[order[:-1]]]]] = True
    content = range_hash(w.hashes, at[first], at[last] + window, SECOND, SECOND_INV)
    return at[first], at[last], least[first], content, twice


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, a check of the text (so that rows that share an id and differ in text stay apart) and the text."""
    text = text_or_empty()
    return docs.select("doc_id", F.hash(text).alias("mark"), text.alias("text"))


def _segments(rows: DataFrame, window: int, gram: int) -> DataFrame:
    def work(part: pa.RecordBatch) -> dict | None:
        w = Words(texts_of(part))
        a, b, least, content, twice = segments(w, window, gram)
        if not len(a):
            return None
        of = np.searchsorted(w.bounds, a, "right") - 1
        home = w.bounds[of]
        pick = pa.array(of)
        return {"doc_id": part.column("doc_id").take(pick), "mark": part.column("mark").take(pick), "first": (a - home).astype(np.int32), "last": (b - home).astype(np.int32), "least": signed(least), "content": signed(content), "twice": twice}

    return map_batches(rows, work, "doc_id long, mark int, first int, last int, least long, content long, twice boolean")


def _open_windows(marked: DataFrame, window: int) -> DataFrame:
    """128-bit hashes of the windows of open segments, with their place."""

    def work(part: pa.RecordBatch) -> dict | None:
        w = Words(texts_of(part))
        at, of, settled = [], [], []
        for i, segs in enumerate(part.column("segs").to_pylist()):
            for s in segs:
                if s["open"]:
                    at.append(np.arange(s["first"], s["last"] + 1) + w.bounds[i])
                    of.append(np.full(len(at[-1]), i))
                    settled.append(np.full(len(at[-1]), s["repeated"]))
        if not at:
            return None
        at, of, settled = map(np.concatenate, (at, of, settled))
        pick = pa.array(of)
        return {
            "doc_id": part.column("doc_id").take(pick), "mark": part.column("mark").take(pick), "start": (at - w.bounds[of]).astype(np.int32), "settled": settled,
            "h1": signed(range_hash(w.hashes, at, at + window, BASE, BASE_INV)), "h2": signed(range_hash(w.hashes, at, at + window, SECOND, SECOND_INV)),
        }

    return map_batches(marked.select("doc_id", "mark", "text", "segs"), work, "doc_id long, mark int, start int, settled boolean, h1 long, h2 long")


RESULT = "doc_id long, n_words long, n_removed long, kept_text string"


def _without(marked: DataFrame, window: int) -> DataFrame:
    def work(part: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"doc_id": part.column("doc_id"), "n_words": [], "n_removed": [], "kept_text": []}
        for text, segs, starts in zip(texts_of(part), part.column("segs").to_pylist(), part.column("starts").to_pylist(), strict=True):
            words = text.encode("utf-8", "surrogatepass").split()
            cover = np.zeros(len(words) + 1, np.int64)
            for s in segs:
                if s["repeated"]:
                    cover[s["first"]] += 1
                    cover[s["last"] + window] -= 1
            for s in starts or ():
                cover[s] += 1
                cover[s + window] -= 1
            stay = np.cumsum(cover)[:-1] == 0
            out["n_words"].append(len(words))
            out["n_removed"].append(int(len(words) - stay.sum()))
            out["kept_text"].append(b" ".join(x for x, k in zip(words, stay, strict=True) if k).decode("utf-8", "surrogatepass"))
        return out

    return map_batches(marked, work, RESULT)


def drop_repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words (joined by one blank) of every document.

    Windows are judged on the input, all at once; equal windows in one document count as repeats too.
    Null and empty texts have no words. Rows that share an id are documents of their own, so a repeated
    row loses all words that a window covers. An empty table gives no rows; columns besides doc_id and
    text are not read.
    """
    rows = _rows(docs)
    every = _segments(rows, window, gram)
    seen = every.groupBy("least").agg(F.count(F.lit(1)).alias("n"), F.max("twice").alias("any_twice")).filter("n > 1 or any_twice").select(F.col("least").alias("least_"))
    found = staged(every.join(staged(seen, "repeated-hashes"), F.col("least") == F.col("least_")).drop("least_"), "segments")

    by_content = found.groupBy("least", "content").agg(F.count(F.lit(1)).alias("n"))
    open_ = found.groupBy("least", "content").agg(F.count(F.lit(1)).alias("n")).groupBy(F.col("least").alias("least_")).agg((F.min("n") == 1).alias("open"))
    status = staged(by_content.join(open_, F.col("least") == F.col("least_")).select("least_", F.col("content").alias("content_"), (F.col("n") > 1).alias("repeated"), "open"), "segment-status")
    told = found.join(status, (F.col("least") == F.col("least_")) & (F.col("content") == F.col("content_")))
    segs = told.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("first", "last", "repeated", "open")).alias("segs")).withColumnsRenamed({"doc_id": "id_", "mark": "mark_"})
    same = F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("mark") == F.col("mark_"))
    marked = staged(rows.join(segs, same).drop("id_", "mark_"), "marked-documents")

    windows = _open_windows(marked, window)
    again = windows.groupBy(F.col("h1").alias("h1_"), F.col("h2").alias("h2_")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    hits = windows.filter(~F.col("settled")).join(staged(again, "repeated-windows"), (F.col("h1") == F.col("h1_")) & (F.col("h2") == F.col("h2_")))
    starts = hits.groupBy(F.col("doc_id").alias("id_"), F.col("mark").alias("mark_")).agg(F.collect_set("start").alias("starts"))
    cleaned = _without(marked.join(starts, same, "left").drop("id_", "mark_"), window)

    def untouched(part: pa.RecordBatch) -> dict:
        words = [x.encode("utf-8", "surrogatepass").split() for x in texts_of(part)]
        n = [len(x) for x in words]
        return {"doc_id": part.column("doc_id"), "n_words": n, "n_removed": [0] * len(n), "kept_text": [b" ".join(x).decode("utf-8", "surrogatepass") for x in words]}

    touched = marked.select(F.col("doc_id").alias("id_"), F.col("mark").alias("mark_"))
    return map_batches(rows.join(touched, same, "left_anti"), untouched, RESULT).unionByName(cleaned)


# ---- a bounded reference, by suffix automata


def _words(text: str) -> list[str]:
    return [x.decode("utf-8", "surrogatepass") for x in text.encode("utf-8", "surrogatepass").split()]


class SuffixAutomaton:
    """All word sequences of one reference shard; states are arrays of transitions, links and lengths."""

    def __init__(self, texts: Iterable[list[str]]):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        for i, words in enumerate(texts):
            last = 0
            for w in [*words, (i,)]:  # a mark of its own ends each text, so no sequence runs across two
                last = self._extend(last, w)

    def _state(self, transitions: dict, link: int, length: int) -> int:
        self.next.append(transitions)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _parted(self, p: int, w) -> int:
        """The state for p's sequences followed by w: the target itself, or its copy when that holds longer ones too."""
        q = self.next[p][w]
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1)
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, w) -> int:
        if w in self.next[last]:
            return self._parted(last, w)
        own = self._state({}, 0, self.length[last] + 1)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = own
            p = self.link[p]
        self.link[own] = self._parted(p, w) if p >= 0 else 0
        return own

    def matching_statistics(self, words: list[str]) -> list[int]:
        """For each word, the length of the longest sequence ending there that the reference has."""
        out, state, n = [], 0, 0
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if w in self.next[state]:
                state, n = self.next[state][w], n + 1
            else:
                n = 0
            out.append(n)
        return out

    def spans(self, words: list[str], least: int) -> list[tuple[int, int]]:
        """Maximal spans of at least `least` words, joined where they overlap."""
        out: list[tuple[int, int]] = []
        for i, n in enumerate(self.matching_statistics(words)):
            if n >= least:
                a = i + 1 - n
                if out and a <= out[-1][1]:
                    out[-1] = (min(out[-1][0], a), i + 1)
                else:
                    out.append((a, i + 1))
        return out


def drop_reference_spans(docs: DataFrame, reference: list[str], least: int = WINDOW, shard_words: int = 100_000, most_words: int = 5_000_000) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words after removing spans that the reference has.

    The reference is given by the caller and refused beyond `most_words`, which bounds what is broadcast.
    Null and empty texts have no words; rows are independent.
    """
    split = [_words(x) for x in reference]
    if sum(map(len, split)) > most_words:
        raise ValueError(f"the reference has more than {most_words} words; use drop_repeated_windows")
    shards: list[list[list[str]]] = [[]]
    held = 0
    for words in split:
        if held and held + len(words) > shard_words:
            shards.append([])
            held = 0
        shards[-1].append(words)
        held += len(words)
    sent = docs.sparkSession.sparkContext.broadcast(shards)
    built: list[SuffixAutomaton] = []

    def work(part: pa.RecordBatch) -> dict:
        if not built:
            built.extend(SuffixAutomaton(s) for s in sent.value)
        out: dict[str, list] = {"doc_id": part.column("doc_id"), "n_words": [], "n_removed": [], "kept_text": []}
        for text in texts_of(part):
            words = _words(text)
            stay = np.ones(len(words), bool)
            for automaton in built:
                for a, b in automaton.spans(words, least):
                    stay[a:b] = False
            out["n_words"].append(len(words))
            out["n_removed"].append(int(len(words) - stay.sum()))
            out["kept_text"].append(" ".join(x for x, k in zip(words, stay, strict=True) if k))
        return out

    return map_batches(docs.select("doc_id", text_or_empty().alias("text")), work, RESULT)
