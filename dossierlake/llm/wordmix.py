"""Word by word context mixing: words of a vocabulary as paths of binary decisions.

Each text is a row of symbols: words of the vocabulary, an escape for any other word, and an end. A symbol
is coded as the decisions of a code tree over the training counts. The predictors of a decision are the
counts of its node (order 0), hashed counts of the node after the word before, and three run predictors:
the word that followed most often in the hashed context of the last one, two and three words, with how
sure that was. Their log odds go through the gated mixer and the adaptive map.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np

from dossierlake.llm.common import Words, mix

VOCABULARY = (1 << 18) - 2  # words with a symbol of their own, at most
PREVIOUS = 1 << 13  # words after which the nodes are counted; after others the run predictors stand alone
LEAST_BITS, MOST_BITS = 16, 22  # table slots as a power of two: about one for four training tokens, between these
RUNS = 3
INPUTS = 2 + RUNS
SYMBOL_BITS = 18  # of a run's entry; the other 14 check the context
SYMBOL = np.uint32((1 << SYMBOL_BITS) - 1)
BLOCK = 1 << 13
#: Log odds of a run from which it counts as fair and as sure.
FAIR, SURE = 0.5, 1.9
PREFIX_BITS = 18
CEILING = 65535


def table_bits(tokens: int) -> int:
    return int(np.clip(int(max(tokens, 4) // 4).bit_length(), LEAST_BITS, MOST_BITS))


class Vocabulary:
    """Symbols 0.. for the given words by falling count, then END and ESCAPE; depth, first place and places (node * 2 + branch) of their paths."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, texts: int, tokens: int):
        order = np.lexsort((keys, -counts))[:VOCABULARY]
        own, n = keys[order], counts[order].astype(np.float64)
        place = np.argsort(own.view(np.uint64), kind="stable")
        # sorted as unsigned numbers, so that their first bits lead to their place
        self.keys, self.ids = np.append(own.view(np.uint64)[place], ~np.uint64(0)), np.append(place, -1)
        self.end, self.escape = len(own), len(own) + 1
        weight = np.concatenate([n, [max(texts, 1), max(tokens - texts - n.sum(), 1)]])
        size = len(weight)
        parent = np.zeros(2 * size - 1, np.int64)
        branch = np.zeros(2 * size - 1, np.int64)
        odds = np.zeros(size - 1, np.float32)
        heap = [(w, i) for i, w in enumerate(weight.tolist())]
        heapq.heapify(heap)
        for made in range(size, 2 * size - 1):
            (w0, a), (w1, b) = heapq.heappop(heap), heapq.heappop(heap)
            parent[a] = parent[b] = made
            branch[b] = 1
            odds[made - size] = np.log(w1 / w0)
            heapq.heappush(heap, (w0 + w1, made))
        self.node_odds = odds
        self.parent, self.turn = parent.astype(np.int32), branch.astype(np.int8)
        self._lay_paths()

    def __getstate__(self) -> dict:
        """The tree, from which the paths are laid again: a tenth of their size."""
        return {k: getattr(self, k) for k in ("keys", "ids", "end", "escape", "node_odds", "parent", "turn")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._lay_paths()

    def _lay_paths(self) -> None:
        self.starts = np.searchsorted(self.keys, np.arange(1 << PREFIX_BITS, dtype=np.uint64) << np.uint64(64 - PREFIX_BITS))
        # level by level, so that no more than one entry a symbol is held beside the paths
        size = self.escape + 1
        root = 2 * size - 2
        depth, now = np.zeros(size, np.int64), np.arange(size, dtype=np.int32)
        while (here := np.flatnonzero(now != root)).size:
            depth[here] += 1
            now[here] = self.parent[now[here]]
        self.depth = depth
        self.first = np.concatenate([[0], np.cumsum(depth)[:-1]])
        self.places = np.zeros(int(depth.sum()), np.int32)
        # a symbol's branches from the top, as the leading bits of a number: paths have fewer than 64 decisions up to 10**13 tokens
        self.codes = np.zeros(size, np.uint64)
        left, now = depth.copy(), np.arange(size, dtype=np.int32)
        while (here := np.flatnonzero(left)).size:
            left[here] -= 1
            own = now[here]
            place = (self.parent[own] - size) * 2 + self.turn[own]
            self.places[self.first[here] + left[here]] = place
            self.codes[here] |= (place & 1).astype(np.uint64) << (63 - left[here]).astype(np.uint64)
            now[here] = self.parent[own]
        # a decision's group (the node three decisions are reached from) * 8 + its place there, so that three lookups share a cache line
        self.groups = np.zeros(len(self.places), np.int32)
        for level in range(int(depth.max())):
            at = self.first[np.flatnonzero(depth > level)] + level
            inner = level % 3
            within = 1
            for k in range(inner, 0, -1):
                within = 2 * within + (self.places[at - k] & 1)
            self.groups[at] = (self.places[at - inner] >> 1) * 8 + within

    def symbols(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Symbol and hash of every word and every end, the symbols' place in their text, and the numbers of the words that are escaped."""
        at = self.starts[words.hashes >> np.uint64(64 - PREFIX_BITS)]
        below = np.flatnonzero(self.keys[at] < words.hashes)
        while len(below):
            at[below] += 1
            below = below[self.keys[at[below]] < words.hashes[below]]
        known = (self.keys[at] == words.hashes) & (self.ids[at] >= 0)
        own = np.where(known, self.ids[at], self.escape)
        texts = len(words.counts)
        n = words.counts + 1
        last = np.cumsum(n) - 1
        is_end = np.zeros(len(own) + texts, bool)
        is_end[last] = True
        symbol = np.full(len(is_end), self.end, np.int64)
        symbol[~is_end] = own
        hash_ = np.zeros(len(is_end), np.uint64)
        hash_[~is_end] = words.hashes
        inside = np.arange(len(is_end)) - np.repeat(last - n + 1, n)
        return symbol, hash_, inside, np.flatnonzero(~known)


def contexts(hashes: np.ndarray, inside: np.ndarray) -> list[np.ndarray]:
    """64-bit hashes of the last one, two and three words before each symbol; words before the text are zero."""
    out, now = [], np.zeros(len(hashes), np.uint64)
    for k in range(1, RUNS + 1):
        before = np.zeros(len(hashes), np.uint64)
        before[k:] = hashes[:-k]
        before[inside < k] = 0
        now = mix(now + before + np.uint64(k))
        out.append(now)
    return out


RUN = np.dtype([("entry", "<u4"), ("hits", "<u2"), ("seen", "<u2")])  # entry: check and symbol
CHECK = np.uint64((1 << (32 - SYMBOL_BITS)) - 1)
GUESS = np.dtype([("entry", "<u4"), ("odds", "<i2"), ("there", "<u2")])


class Runs:
    """For each slot of a hashed context: the symbol that followed most, the votes it is ahead by, and how often the context was seen."""

    def __init__(self, bits: int):
        self.bits = bits
        table = np.zeros(1 << bits, RUN)  # side by side, for one cache line a lookup
        self.entry, self.hits, self.seen = table["entry"], table["hits"], table["seen"]
        self.whole = table.view(np.uint64)

    def add(self, context: np.ndarray, symbol: np.ndarray) -> None:
        slot, check = slots(context, self.bits)
        pairs, n = np.unique((slot << np.uint64(32)) | (check << np.uint64(SYMBOL_BITS)) | symbol.astype(np.uint64), return_counts=True)
        rise = np.argsort(n, kind="stable")  # of several new entries of a slot, the last one written stays
        pairs, n = pairs[rise], n[rise]
        slot, entry = (pairs >> np.uint64(32)).astype(np.intp), (pairs & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        self.put(slot, entry, n, n)

    def put(self, slot: np.ndarray, entry: np.ndarray, hits: np.ndarray, seen: np.ndarray) -> None:
        """Add (entry, hits, seen) to their slots. Hits are votes: equal entries add up, another symbol of the same context takes off and comes in when none are left, so a majority always stays. Of two contexts in a slot that seen more stays, and the other one wears it down."""
        old, held = self.entry[slot], self.seen[slot]
        context = (old >> np.uint32(SYMBOL_BITS) == entry >> np.uint32(SYMBOL_BITS)) & (held > 0)
        places, back = np.unique(slot[context], return_inverse=True)
        if len(places):
            more = np.bincount(back, seen[context], len(places)).astype(np.int64)
            self.seen[places] = np.minimum(self.seen[places] + more, CEILING)
            same = old[context] == entry[context]
            own = hits[context]
            votes = self.hits[places] + np.bincount(back, np.where(same, own, -own), len(places)).astype(np.int64)
            self.hits[places] = np.minimum(np.abs(votes), CEILING)
            over = ~same & (votes < 0)[back]
            self.entry[slot[context][over]] = entry[context][over]
        win = ~context & (seen >= held)
        self.entry[slot[win]], self.hits[slot[win]], self.seen[slot[win]] = entry[win], np.minimum(hits[win], CEILING), np.minimum(seen[win], CEILING)
        worn = slot[~context & (seen < held)]
        self.seen[worn] -= np.minimum(self.seen[worn], 1)
        self.hits[worn] = np.minimum(self.hits[worn], self.seen[worn])
        # of several new entries for a slot one stands now; others of its context count too
        again = win & (self.entry[slot] != entry) & (self.entry[slot] >> np.uint32(SYMBOL_BITS) == entry >> np.uint32(SYMBOL_BITS))
        if again.any():
            self.put(slot[again], entry[again], hits[again], seen[again])

    def odds(self) -> np.ndarray:
        return run_odds(self.hits, self.seen)


def slots(context: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Slot and 14-bit check of each context."""
    return context >> np.uint64(64 - bits), (context >> np.uint64(20)) & np.uint64((1 << (32 - SYMBOL_BITS)) - 1)


def run_odds(hits: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Log odds of the standing symbol: its votes and all others' tell how often it came."""
    came = (np.minimum(hits, seen).astype(np.float32) + seen) * np.float32(0.5)
    return np.log((came + np.float32(0.4)) / (seen - came + np.float32(0.4)))


class Decisions:
    """The decisions of all symbols in a row: the symbol's number, the level, node and branch."""

    def __init__(self, v: Vocabulary, symbol: np.ndarray):
        self.v, self.symbol, self.depth = v, symbol, v.depth[symbol]
        self.first = np.cumsum(self.depth) - self.depth
        self.of = np.repeat(np.arange(len(symbol)), self.depth)
        self.level = np.arange(len(self.of)) - np.repeat(self.first, self.depth)
        at = np.repeat(v.first[symbol], self.depth) + self.level
        place = v.places[at]
        self.node, self.branch, self.group = place >> 1, place & 1, v.groups[at]
        self.sign = (2 * self.branch - 1).astype(np.float32)


def leading(x: np.ndarray) -> np.ndarray:
    """The number of leading zeros of 64-bit numbers."""
    high, low = (x >> np.uint64(32)).astype(np.float64), (x & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return 64 - np.where(high > 0, np.frexp(high)[1] + 32, np.frexp(low)[1])


def run_input(d: Decisions, guess: np.ndarray, odds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The decisions that a guessed symbol's path shares, the log odds it gives each, and their class.

    A guess shares a symbol's path as far as their codes agree: up to there it is right, at the next decision wrong.
    """
    some = np.flatnonzero(guess >= 0)
    depth = d.depth[some]
    shared = np.minimum(leading(d.v.codes[guess[some]] ^ d.v.codes[d.symbol[some]]), depth)
    n = np.minimum(shared + 1, depth)
    level = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(d.first[some], n) + level
    x = np.repeat(odds[some], n) * d.sign[at]
    np.negative(x, out=x, where=level == np.repeat(shared, n))
    own = odds[some]
    return at, x, np.repeat(1 + (own >= FAIR) + (own >= SURE), n)


def predictions(d: Decisions, counted: np.ndarray, packed: np.ndarray, guessed: list[tuple[np.ndarray, np.ndarray]]) -> tuple[list, np.ndarray]:
    """The predictors' inputs, all but the first one given only where they have something to say, and the gate."""
    gate = np.zeros(len(d.of), np.intp)
    seen = packed & 3
    gate[counted] = seen
    told = seen > 0
    inputs: list = [d.v.node_odds[d.node], (counted[told], (packed[told] >> 2).astype(np.float32) / np.float32(512))]
    for k, g in enumerate(guessed):
        at, x, kind = run_input(d, *g)
        inputs.append((at, x))
        if k:
            gate[at] |= kind << (2 * k)
    return inputs, gate


def node_slot(previous: np.ndarray, group: np.ndarray, bits: int) -> np.ndarray:
    x = (previous.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
    x ^= (group >> 3).astype(np.uint32) * np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(13)
    return (((x & np.uint32((1 << (bits - 3)) - 1)) << np.uint32(3)) | (group & 7).astype(np.uint32)).astype(np.intp)


def followers(symbol: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """The symbol before each, -1 where it is none or not among the PREVIOUS most frequent."""
    before = np.full(len(symbol), -1, np.int64)
    before[1:] = symbol[:-1]
    before[(inside == 0) | (before >= PREVIOUS)] = -1
    return before


def sparse(*columns: np.ndarray) -> bytes:
    """The entries of a block whose last column is not zero: a bit for every place, then the columns byte by byte, which packs well."""
    there = columns[-1] != 0
    planes = [np.ascontiguousarray(c[there].view(np.uint8).reshape(-1, c.itemsize).T).tobytes() for c in columns]
    return np.packbits(there).tobytes() + b"".join(planes)


def from_sparse(data: bytes, *types: str) -> tuple[np.ndarray, ...]:
    """Places and columns of a block."""
    raw = np.frombuffer(data, np.uint8)
    places = np.flatnonzero(np.unpackbits(raw[: BLOCK // 8]))
    n, out, at = len(places), [places], BLOCK // 8
    for t in map(np.dtype, types):
        out.append(np.ascontiguousarray(raw[at : at + n * t.itemsize].reshape(t.itemsize, n).T).view(t).ravel())
        at += n * t.itemsize
    return tuple(out)


class WordTrainer:
    """Tables and mixer of one task: every part is predicted with what was learned so far, then learned."""

    def __init__(self, v: Vocabulary, bits: int, mixer):
        self.v, self.bits, self.mixer, self.parts = v, bits, mixer, 0
        self.runs = [Runs(bits) for _ in range(RUNS)]
        self.nodes = np.zeros(2 << bits, np.uint32)

    def add(self, words: Words, pack_odds) -> np.ndarray:
        """Learns the texts' words; returns the numbers of the escaped ones."""
        v = self.v
        symbol, hashes, inside, escaped = v.symbols(words)
        hashed = contexts(hashes, inside)
        d = Decisions(v, symbol)
        before = followers(symbol, inside)[d.of]
        counted = np.flatnonzero(before >= 0)
        at = 2 * node_slot(before[counted], d.group[counted], self.bits)
        guessed = [guesses(r, c) for r, c in zip(self.runs, hashed, strict=True)]
        if self.parts:
            packed = pack_odds(self.nodes[at].astype(np.float32), self.nodes[at + 1].astype(np.float32))
            inputs, gate = predictions(d, counted, packed, guessed)
            self.mixer.learn(inputs, gate, d.branch)
        np.add.at(self.nodes, at + d.branch[counted], np.uint32(1))
        for k, (r, c) in enumerate(zip(self.runs, hashed, strict=True)):
            # contexts grow: one of three words is kept once its two last words have been met before
            grown = guessed[k - 1][0] >= 0 if k == RUNS - 1 else slice(None)
            r.add(c[grown], symbol[grown])
        self.parts += 1
        return escaped

    def rows(self, first: int) -> Iterator[dict]:
        """Blocks of the run tables (what: first to first + RUNS - 1) and of the node counts (first + RUNS)."""
        for b in range((1 << self.bits) // BLOCK):
            part = slice(b * BLOCK, (b + 1) * BLOCK)
            for k, r in enumerate(self.runs):
                if r.seen[part].any():
                    yield {"what": first + k, "block": b, "data": sparse(r.entry[part], r.hits[part], r.seen[part])}
            n = self.nodes[2 * b * BLOCK : 2 * (b + 1) * BLOCK].reshape(-1, 2)
            if n.any():
                yield {"what": first + RUNS, "block": b, "data": sparse(n[:, 0].copy(), n[:, 1].copy(), n.any(axis=1).view(np.uint8))}


def guesses(r: Runs, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The standing symbol of each context, -1 for none, and its log odds."""
    slot, check = slots(context, r.bits)
    found = r.whole[slot.astype(np.intp)]
    seen = (found >> np.uint64(48)).astype(np.uint16)
    there = (seen > 0) & ((found >> np.uint64(SYMBOL_BITS)) & CHECK == check)
    return np.where(there, (found & np.uint64(SYMBOL)).astype(np.int64), -1), run_odds(((found >> np.uint64(32)) & np.uint64(CEILING)).astype(np.uint16), seen)


class BlockSum:
    """The parts of one block added up: run entries (kind 'runs') or pairs of counts."""

    def __init__(self, runs: bool):
        self.runs = runs
        bits = BLOCK.bit_length() - 1
        self.total = Runs(bits) if runs else np.zeros((BLOCK, 2), np.uint64)

    def add(self, data: bytes) -> None:
        if self.runs:
            at, entry, hits, seen = from_sparse(data, "<u4", "<u2", "<u2")
            self.total.put(at, entry, hits.astype(np.int64), seen.astype(np.int64))
        else:
            at, n0, n1 = from_sparse(data, "<u4", "<u4")
            self.total[at, 0] += n0
            self.total[at, 1] += n1

    def packed(self, pack_odds) -> bytes:
        """What scoring needs: of runs the entry and the odds in steps of 1/512, of counts the packed odds."""
        if self.runs:
            odds = np.clip(np.rint(self.total.odds() * 512), -32000, 32000).astype(np.int16)
            there = self.total.seen > 0
            return sparse(np.where(there, self.total.entry, 0), np.where(there, odds, 0), there.view(np.uint8))
        both = self.total.astype(np.float64)
        return sparse(pack_odds(both[:, 0], both[:, 1]), both.any(axis=1).view(np.uint8))


class WordModel:
    """The merged tables and the mixer, for scoring. It travels as the blocks it was made of, which hold no empty slots; where it arrives, tables stand for them."""

    def __init__(self, v: Vocabulary, bits: int, mixer, blocks: list[tuple[int, int, bytes]]):
        self.v, self.bits, self.mixer, self.blocks, self.runs = v, bits, mixer, blocks, None

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in ("v", "bits", "mixer", "blocks")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._lay_tables()
        self.blocks = None

    def _lay_tables(self) -> None:
        self.rates = self.mixer.rates()
        self.runs = np.zeros((RUNS, 1 << self.bits), GUESS)
        self.nodes = np.zeros(1 << self.bits, np.int16)
        for k, block, data in self.blocks:
            if k < RUNS:
                at, entry, odds = from_sparse(data, "<u4", "<i2")
                own = self.runs[k, block * BLOCK : (block + 1) * BLOCK]
                own["entry"][at], own["odds"][at], own["there"][at] = entry, odds, 1
            else:
                at, packed = from_sparse(data, "<i2")
                self.nodes[block * BLOCK + at] = packed

    def log10(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """The log10 probability of each text's symbols, and the numbers of the escaped words."""
        if self.runs is None:
            self._lay_tables()
        v = self.v
        symbol, hashes, inside, escaped = v.symbols(words)
        d = Decisions(v, symbol)
        before = followers(symbol, inside)[d.of]
        counted = np.flatnonzero(before >= 0)
        packed = self.nodes[node_slot(before[counted], d.group[counted], self.bits)]
        guessed, whole = [], self.runs.view(np.uint64)
        for k, c in enumerate(contexts(hashes, inside)):
            slot, check = slots(c, self.bits)
            found = whole[k][slot.astype(np.intp)]
            there = (found >> np.uint64(48) > 0) & ((found >> np.uint64(SYMBOL_BITS)) & CHECK == check)
            odds = ((found >> np.uint64(32)) & np.uint64(CEILING)).astype(np.uint16).view(np.int16)
            guessed.append((np.where(there, (found & np.uint64(SYMBOL)).astype(np.int64), -1), odds.astype(np.float32) / np.float32(512)))
        inputs, gate = predictions(d, counted, packed, guessed)
        p = self.mixer.refined(self.mixer.mixed(inputs, gate), gate, self.rates)
        # the probability of the branch taken
        p -= np.float32(0.5)
        p *= d.sign
        p += np.float32(0.5)
        logs = np.log(np.maximum(p, np.float32(1e-6), out=p), out=p)
        begin = d.first[np.flatnonzero(inside == 0)]  # of each text, which has its end at least
        return np.add.reduceat(logs, begin, dtype=np.float64) / np.log(10) if len(begin) else np.zeros(0), escaped


def gaps(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every gap (before, between and after the words of each text): its text, whether it is at an edge, whether it is plain (one blank, or nothing at an edge), and its bytes."""
    texts = len(words.counts)
    n = words.counts + 1
    of = np.repeat(np.arange(texts), n)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    begin, end = np.empty(len(of), np.int64), np.empty(len(of), np.int64)
    first, last = nth == 0, nth == words.counts[of]
    begin[first], begin[~first] = words.offsets[:-1], words.ends
    end[last], end[~last] = words.offsets[1:] - 1, words.starts
    edge = first | last
    length = end - begin
    plain = np.where(edge, length == 0, (length == 1) & (words.data[np.minimum(begin, len(words.data) - 1)] == 32))
    return of, edge, plain, length
