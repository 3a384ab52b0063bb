"""Spelling variants: words one error apart, found through forward and backward minimal acyclic automata.

A word is cut into halves. With one error at most, one half is intact: the forward automaton matches the first
half exactly and completes the second with one error, the backward automaton, over the words reversed, does the
same from the other end. Words that can meet share their first (or last) three letters, so Spark deals the words
by those; every automaton numbers its words without gaps or collisions, and the numbers address counts and words.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossierlake.llm.common import give_back, slices, staged, text_or_empty

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWERED = str.maketrans({chr(x): chr(x + 32) for x in range(65, 91)})
#: Words an automaton holds, about; letters that deal them.
BLOCK, DEAL = 16_384, 3
#: Distinct words whose counts a task keeps before they leave it.
HELD = 1 << 18


class Automaton:
    """The minimal acyclic automaton of words given in order; a word's number is how many words stand before it."""

    def __init__(self, words: Iterable[str]):
        self.edges: list[dict[str, int]] = [{}]
        self.final = [False]
        known: dict[tuple, int] = {}
        path, last = [0], ""
        free: list[int] = []

        def settle(keep: int) -> None:
            """States below the first `keep` letters of the last word are replaced by equal ones that are known."""
            while len(path) > keep + 1:
                state = path.pop()
                same = known.setdefault((self.final[state], *self.edges[state].items()), state)
                if same != state:
                    self.edges[path[-1]][last[len(path) - 1]] = same
                    free.append(state)

        for word in words:
            if word == last and last:
                continue
            keep = next((k for k, (a, b) in enumerate(zip(word, last, strict=False)) if a != b), min(len(word), len(last)))
            settle(keep)
            for c in word[keep:]:
                if free:
                    state = free.pop()
                    self.edges[state], self.final[state] = {}, False
                else:
                    state = len(self.edges)
                    self.edges.append({})
                    self.final.append(False)
                self.edges[path[-1]][c] = state
                path.append(state)
            self.final[path[-1]] = True
            last = word
        settle(0)
        #: For each state the words that its edges lead to, by edge: how many words stand before those of the edge.
        self.before: list[dict[str, int]] = [{} for _ in self.edges]
        size = [-1] * len(self.edges)
        stack = [0]
        while stack:
            state = stack[-1]
            if waiting := [x for x in self.edges[state].values() if size[x] < 0]:
                stack += waiting
                continue
            stack.pop()
            n = int(self.final[state])
            for c, x in self.edges[state].items():
                self.before[state][c] = n
                n += size[x]
            size[state] = n
        self.size = size[0]

    def follow(self, word: str, state: int = 0, number: int = 0) -> tuple[int, int] | None:
        """The state and the number reached by exactly these letters."""
        for c in word:
            if (then := self.edges[state].get(c)) is None:
                return None
            state, number = then, number + self.before[state][c]
        return state, number

    def one_error(self, word: str, half: int) -> set[int]:
        """Numbers of the words that begin with the first `half` letters and whose rest differs by one letter put in, left out or replaced."""
        found: set[int] = set()
        at = self.follow(word[:half])
        for k in range(half, len(word) + 1):
            if at is None:
                break
            state, number = at
            tails = [(at, word[k + 1 :])] if k < len(word) else []  # left out
            for c, then in self.edges[state].items():
                here = then, number + self.before[state][c]
                tails.append((here, word[k:]))  # put in
                if k < len(word) and c != word[k]:
                    tails.append((here, word[k + 1 :]))  # replaced
            for (s, n), tail in tails:
                if (end := self.follow(tail, s, n)) is not None and self.final[end[0]]:
                    found.add(end[1])
            at = self.follow(word[k : k + 1], state, number) if k < len(word) else None
        return found


def word_counts(docs: DataFrame, one_in: int = 199) -> DataFrame:
    """word, n: the lower-cased runs of letters of all texts; where one_in divides the CRC-32 of id and run, the run has lost a letter.

    Tasks send a word once for about every HELD distinct words, so frequent words cost little.
    """
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def out(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], schema=schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for part in slices(batch):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    for run, n in Counter(RUN.findall(text.translate(LOWERED))).items():
                        h = zlib.crc32(run.encode(), start)
                        held[run if h % one_in else run[: (at := h % len(run))] + run[at + 1 :]] += n
                if len(held) > HELD:
                    yield out(held)
                    held = Counter()
        if held:
            yield out(held)
        give_back()

    parts = docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(work, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def _pairs(group: pa.Table, backward: bool) -> dict[str, list]:
    """The near pairs of one block: the rows that are searched in, and those that are searched for."""
    rows = list(zip(*(group.column(x).to_pylist() for x in ("word", "n", "held")), strict=True))
    turned = (lambda w: w[::-1]) if backward else (lambda w: w)
    inside = sorted((turned(w), n) for w, n, held in rows if held)
    automaton = Automaton(w for w, _ in inside)
    found: dict[str, list] = {x: [] for x in ("word", "n", "near", "near_n")}
    for word, n, held in rows:
        if not held:
            half = (len(word) + 1) // 2 if backward else len(word) // 2
            for k in automaton.one_error(turned(word), half):
                near, near_n = inside[k]
                if near != turned(word):
                    for name, x in zip(found, (word, n, turned(near), near_n), strict=True):
                        found[name].append(x)
    return found


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, n, near, near_n: every ordered pair of words (word, n) one letter put in, left out or replaced apart; words of DEAL * 2 letters or more.

    Letters that begin (or end) more than `block` words have blocks of their own, each of which meets all the words
    with those letters, block by block; the other letters share blocks. No block holds more than about
    `block` words to search in and as many to search for.
    """
    ends = F.explode(F.array(F.struct(F.lit(False).alias("backward"), F.substring("word", 1, DEAL).alias("letters")), F.struct(F.lit(True).alias("backward"), F.substring("word", -DEAL, DEAL).alias("letters"))))
    dealt = words.select("word", "n", ends.alias("e")).select("word", "n", "e.backward", "e.letters")
    total = words.count()
    counts = staged(dealt.groupBy(F.col("backward").alias("backward_"), F.col("letters").alias("letters_")).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts")), "letters")
    shared = max(1, math.ceil(total / block))
    known = dealt.join(counts, (F.col("backward") == F.col("backward_")) & (F.col("letters") == F.col("letters_")))
    own = F.col("parts") > 1
    home = F.when(own, F.pmod(F.xxhash64("word"), F.col("parts"))).otherwise(F.pmod(F.xxhash64("letters"), F.lit(shared))).cast("int")
    placed = known.select("word", "n", "backward", F.when(own, F.col("letters")).otherwise("").alias("letters"), "parts", home.alias("home"))
    others = F.when(F.col("letters") == "", F.array("home")).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    held = placed.withColumn("other", F.explode(others)).select("word", "n", "backward", "letters", F.col("home").alias("inside"), F.col("other").alias("outside"), F.lit(True).alias("held"))
    sought = placed.withColumn("other", F.explode(others)).select("word", "n", "backward", "letters", F.col("other").alias("inside"), F.col("home").alias("outside"), F.lit(False).alias("held"))

    def work(group: pa.Table) -> pa.Table:
        return pa.table(_pairs(group, group.column("backward")[0].as_py()), schema=pa.schema([("word", pa.string()), ("n", pa.int64()), ("near", pa.string()), ("near_n", pa.int64())]))

    keys = ["backward", "letters", "inside", "outside"]
    return held.unionByName(sought).groupBy(*keys).applyInArrow(work, "word string, n long, near string, near_n long").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: from each word with a form, forms followed to the last, by doubling. Counts grow fivefold along a
    chain, so the rounds are the logarithm of a logarithm; each is written and depends on the one before alone."""
    now = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("word_"), F.col("root").alias("next"))
        then = staged(now.join(further, F.col("root") == F.col("word_"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if then.filter("moved").isEmpty():
            return then.drop("moved")
        now = then.drop("moved")


def spelling_variants(docs: DataFrame, least_letters: int = 6, least_n: int = 5, times: int = 5, one_in: int = 199) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of at least `least_letters` code points and `least_n` occurrences.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF with only A-Z lowered, counted over all whole texts (null: none); every
    one_in-th pair of document and run has lost a letter, as word_counts says. A word's form is the near word of largest
    n (ties: smallest in code-point order) if that n is `times` its own or more, else null, and form_n that n or null; its root is
    where forms lead from it, itself if it has none. A null id counts as an empty one; repeated rows count again; an
    empty table gives no rows; columns besides doc_id and text are not read.
    """
    if least_letters < 2 * DEAL:
        raise ValueError(f"words of fewer than {2 * DEAL} letters cannot be dealt by {DEAL} of a half's letters")
    words = staged(word_counts(docs, one_in).filter((F.char_length("word") >= least_letters) & (F.col("n") >= least_n)), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = near_words(words).groupBy(F.col("word").alias("word_")).agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    told = words.join(near, F.col("word") == F.col("word_"), "left").drop("word_")
    has = -F.col("best.less") >= times * F.col("n")
    told = staged(told.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best.near")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n")), "forms")
    roots = _roots(told.filter("form IS NOT NULL")).withColumnRenamed("word", "word_")
    return told.join(roots, F.col("word") == F.col("word_"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
