"""Best-fit packing by the sum-of-squares rule.

A document is tokenised, gets the end id, and is cut only when longer than a sequence. Pieces are dealt
into blocks; in each block they go, longest first, into the open sequence that leaves the smallest sum
of squared counts of open sequences per residual gap; a new sequence opens only where none has room.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossierlake.llm.common import map_batches, staged, text_or_empty, texts_of

SEQUENCE = 2048
END_ID = 0
BLOCK_PIECES = 16384
CACHE_BYTES = 28 << 20  # of one of the two generations of cached chunks; an entry counts ENTRY_BYTES beside its text and ids
ENTRY_BYTES = 200
#: Blanks at which a text is cut, blanks at which it isn't, and the mark that stands there meanwhile.
CUT, ODD, MARK = re.compile(r" (?=\S)"), re.compile(r" (?!\S)"), "\0"


def _byte_of() -> dict[str, int]:
    """The visible character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_encoding(path: str):
    """The byte-level BPE of a tokenizers file, as an encoding of tiktoken (the faster library; tests hold it against tokenizers), and the ids of the file's added tokens, which no ordinary text may become part of."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    added = model.get("added_tokens", [])
    if any(x[k] for x in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens with conditions or normalisation are not supported")
    special = {x["content"]: x["id"] for x in added}
    byte_of = _byte_of()
    ranks = {bytes(byte_of[c] for c in word): rank for word, rank in model["model"]["vocab"].items() if word not in special}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), special


class WordCache(dict):
    """Little-endian ids of a chunk of text, filled on demand.

    When the entries reach CACHE_BYTES they become the older generation, from which those asked for again
    come back, and the one before it goes: common words stay, and a worker holds twice CACHE_BYTES at most.
    """

    def __init__(self, path: str):
        encoding, special = load_encoding(path)
        self.encode = encoding.encode_ordinary
        self.special = {x: np.array([i], "<u4").tobytes() for x, i in special.items()}
        self.split = re.compile("(" + "|".join(re.escape(x) for x in sorted(special, key=len, reverse=True)) + ")").split if special else None
        self.older: dict[str, bytes] = {}
        self.held = 0

    def __missing__(self, chunk: str) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            ids = array("I", self.encode(chunk))
            if sys.byteorder == "big":
                ids.byteswap()
            ids = ids.tobytes()
        if len(chunk) <= 64:
            self.held += ENTRY_BYTES + len(chunk) + len(ids)
            if self.held > CACHE_BYTES:
                self.older = dict(self)
                self.clear()
                self.held = 0
            self[chunk] = ids
        return ids

    def ids(self, text: str) -> bytes:
        """Ids of a whole text, cut at the added tokens first."""
        if self.split and any(x in text for x in self.special):
            return b"".join(self.special.get(x) or self.ordinary(x) for x in self.split(text))
        return self.ordinary(text)

    def ordinary(self, text: str) -> bytes:
        """Ids of a text without added tokens. A blank before a non-blank always begins a new token, so chunks cut there encode alone."""
        if not text:
            return b""
        if MARK in text:
            chunks = [text]
        elif ODD.search(text):
            chunks = CUT.sub(MARK + " ", text).split(MARK)
        else:
            chunks = text.replace(" ", MARK + " ").split(MARK)
        return b"".join(map(self.__getitem__, chunks))


_CACHES: dict[str, WordCache] = {}


def word_cache(path: str) -> WordCache:
    if path not in _CACHES:
        _CACHES[path] = WordCache(path)
    return _CACHES[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cut(n: int, most: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; the first takes what is left over."""
    first = n % most or most
    return [(0, min(first, n))] + [(s, most) for s in range(first, n, most)]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str | None = None, most: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """One row per piece of every document (null text: the end id alone)."""
    path = tokenizer or default_tokenizer()
    end = np.array([END_ID], "<u4").tobytes()

    def work(part: pa.RecordBatch) -> dict:
        cache = word_cache(path)
        out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
        for doc_id, text in zip(part.column("doc_id").to_pylist(), texts_of(part), strict=True):
            ids = cache.ids(text) + end
            for k, (start, length) in enumerate(cut(len(ids) // 4, most)):
                own = ids[4 * start : 4 * (start + length)]
                for name, value in zip(out, (doc_id, k, start, length, zlib.crc32(own), np.frombuffer(own, "<u4").astype(np.int32) if with_ids else None), strict=True):
                    out[name].append(value)
        return out

    return map_batches(docs.select("doc_id", text_or_empty().alias("text")), work, PIECES + (", ids array<int>" if with_ids else ""))


def sum_of_squares(lengths: np.ndarray, most: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each length, placed longest first."""
    n = len(lengths)
    sequence, offset = np.empty(n, np.int64), np.empty(n, np.int64)
    open_: list[list[int]] = [[] for _ in range(most + 1)]
    count = np.zeros(most + 1, np.int64)  # open sequences per gap; a full one is not open
    cost_of = np.zeros(most + 1, np.int64)  # the same, with none at gap 0
    opened = 0
    for i in np.argsort(-lengths, kind="stable"):
        s = int(lengths[i])
        there = np.flatnonzero(count[s:])  # gaps s, s+1, ... that some sequence has
        if len(there):
            gaps = there + s
            change = 2 * (cost_of[gaps - s] - count[gaps]) + 2
            change[gaps == s] -= 1
            gap = int(gaps[np.argmin(change)])
            own = open_[gap].pop()
            count[gap] -= 1
            cost_of[gap] -= 1
        else:
            own, gap, opened = opened, most, opened + 1
        sequence[i], offset[i] = own, most - gap
        left = gap - s
        if left:
            open_[left].append(own)
            count[left] += 1
            cost_of[left] += 1
    return sequence, offset


def pack(pieces_: DataFrame, most: int = SEQUENCE, block: int = BLOCK_PIECES) -> DataFrame:
    """The pieces with sequence_id and offset. Needs the pieces written, since it counts them first.

    Whole-sequence pieces need no partner. The others are dealt by hash into blocks of about `block`
    pieces, so no task holds more and a block leaves about one sequence short of full.
    """
    columns = pieces_.columns
    full, rest = pieces_.filter(F.col("length") == most), pieces_.filter(F.col("length") < most)
    blocks = max(1, -(-rest.count() // block))
    dealt = rest.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks)))

    def place(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True])
        group["sequence_id"], group["offset"] = sum_of_squares(group["length"].to_numpy(), most)
        group["sequence_id"] = group["sequence_id"] * blocks + group["block"]
        return group[[*columns, "sequence_id", "offset"]]

    schema = f"{rest._jdf.schema().toDDL()}, sequence_id long, offset long"
    packed = dealt.groupBy("block").applyInPandas(place, schema)
    alone = full.withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return packed.unionByName(alone)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, most: int = SEQUENCE, block: int = BLOCK_PIECES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every document.

    Null and empty texts give one piece, the end id. Rows that repeat are packed each on its own; an
    empty table gives no rows; columns besides doc_id and text are not read. Whole-sequence pieces have
    negative sequence ids.
    """
    return pack(staged(pieces(docs, tokenizer, most), "pieces"), most, block)
