"""Quality rules: adaptive thresholds from mergeable quantile sketches per language and source.

Every document gets exact text measures in one pass. KLL sketches of its ratios are built per
(language, source); their quartiles, and for the language the median over its sources of these, give
fences that replace fixed cut-offs; the fences (one row per group) are joined back and judge the documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dossierlake.llm.common import Words, map_batches, mix, range_hash, staged, text_or_empty, texts_of

SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(x) for x in "#*$%&|<>"]] = True

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
RATIOS = ("symbol_ratio", "dup_line_ratio", "repeat_ratio", "word_length")
QUARTILES = {"low": 0.25, "mid": 0.5, "high": 0.75}
#: The least distance from median to fence, so that groups without any spread keep ordinary documents.
SLACK = {"symbol_ratio": 0.2, "dup_line_ratio": 0.4, "repeat_ratio": 0.35, "word_length": 4.0}


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def measure_texts(texts: list[str]) -> dict[str, np.ndarray]:
    w = Words(texts)
    n = len(texts)
    whole = np.append(w.offsets[:-1], w.offsets[-1])
    apart = np.zeros(len(w.data) + 1, np.int64)
    np.cumsum(np.isin(w.data, (9, 10, 11, 12, 13, 32)), out=apart[1:])
    head = (w.data & 0xC0) != 0x80  # a byte that begins a code point
    inside = np.zeros(len(w.data) + 1, np.int8)
    np.add.at(inside, w.starts, 1)
    np.add.at(inside, w.ends, -1)
    in_word = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)

    # lines: cut at \n and at the blank that stands after each text
    cut = w.data == 10
    cut[w.offsets[1:] - 1] = True
    ends = np.flatnonzero(cut)
    starts = np.append(0, ends[:-1] + 1) if len(ends) else ends
    worded = (ends - starts) > (apart[ends] - apart[starts])
    starts, ends = starts[worded], ends[worded]
    owner = np.searchsorted(w.offsets, starts, "right") - 1
    keys = mix(range_hash(w.data, starts, ends) + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    first = np.unique(keys, return_index=True)[1]
    n_lines = np.bincount(owner, minlength=n)
    n_dup = n_lines - np.bincount(owner[first], minlength=n)

    # words in 3-word windows found twice or more in the same text
    m = len(w.starts)
    of = np.repeat(np.arange(n), w.counts)
    at = np.flatnonzero(of[2:] == of[:-2]) if m > 2 else np.zeros(0, np.int64)
    keys = mix(range_hash(w.hashes, at, at + 3) + of[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, back, found = np.unique(keys, return_inverse=True, return_counts=True)
    again = at[found[back] > 1]
    cover = np.zeros(m + 3, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + 3, -1)
    repeated = np.cumsum(cover)[:m] > 0
    return {
        "n_words": w.counts,
        "word_chars": _per_text(head & in_word, whole),
        "n_symbols": _per_text(SYMBOL[w.data], whole),
        "n_dup_lines": n_dup,
        "n_repeat_words": np.bincount(of[repeated], minlength=n),
        "n_lines": n_lines,
    }


def measures(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns, lang, source and the text measures of every whole text (null: no words)."""
    rows = docs.select(*carry, F.col("lang").cast("string").alias("lang_of"), F.col("source").cast("string").alias("source_of"), text_or_empty().alias("text"))
    schema = StructType([*docs.select(*carry).schema, *StructType.fromDDL(f"lang_of string, source_of string, {MEASURES}")])

    def work(part: pa.RecordBatch) -> dict:
        return {k: part.column(k) for k in (*carry, "lang_of", "source_of")} | measure_texts(texts_of(part))

    return map_batches(rows, work, schema)


def _ratios(df: DataFrame) -> DataFrame:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return df.withColumns({
        "symbol_ratio": F.col("n_symbols") / words,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_ratio": F.col("n_repeat_words") / words,
        "word_length": F.col("word_chars") / words,
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    })


def thresholds(measured: DataFrame, reach: float = 8.0, least_rows: int = 100) -> DataFrame:
    """One row per (lang, source) with the upper and lower fence of every ratio.

    A fence stands `reach` times the distance from median to the nearer quartile beyond the median, at
    least SLACK: junk on one side, up to half of the rows, does not widen it. The language's quartiles are
    medians over its sources, whatever their size, so a hot source counts once; sources with fewer than
    `least_rows` documents are merged and count once for each `least_rows` of them. Such a source takes
    the language's fences, and none goes beyond twice the language's distance, so that a source made
    mostly of junk does not set its own measure.
    """
    usable = _ratios(measured).filter(~F.col("base_failed"))
    sketches = usable.groupBy("lang_of", "source_of").agg(F.count(F.lit(1)).alias("rows"), *[F.kll_sketch_agg_double(x).alias(x) for x in RATIOS])
    quartile = lambda x, q: F.kll_sketch_get_quantile_double(F.col(x), F.lit(q))
    quartiles = [quartile(x, q).alias(f"{x}_{name}") for x in RATIOS for name, q in QUARTILES.items()]
    per = staged(sketches, "sketches")
    large = per.filter(F.col("rows") >= least_rows).select("lang_of", F.lit(1).alias("times"), *quartiles)
    merged = per.filter(F.col("rows") < least_rows).groupBy("lang_of").agg(F.sum("rows").alias("rows"), *[F.kll_merge_agg_double(x).alias(x) for x in RATIOS])
    small = merged.select("lang_of", F.ceil(F.col("rows") / least_rows).cast("int").alias("times"), *quartiles)
    voices = large.unionByName(small).withColumn("voice", F.explode(F.sequence(F.lit(1), F.col("times"))))
    # of an even number the lower one, not a value between two sources
    whole = voices.groupBy(F.col("lang_of").alias("lang_")).agg(*[F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {x}_{name})").alias(f"{x}_{name}_l") for x in RATIOS for name in QUARTILES])
    both = per.join(whole, F.col("lang_of").eqNullSafe(F.col("lang_")))
    out = {}
    for x in RATIOS:
        low, mid, high = (quartile(x, q) for q in QUARTILES.values())
        low_l, mid_l, high_l = (F.col(f"{x}_{name}_l") for name in QUARTILES)
        reach_l = F.greatest(F.lit(reach) * F.least(high_l - mid_l, mid_l - low_l), F.lit(SLACK[x]))
        own = F.greatest(F.lit(reach) * F.least(high - mid, mid - low), F.lit(SLACK[x]))
        few = F.col("rows") < least_rows
        out[f"{x}_most"] = F.when(few, mid_l + reach_l).otherwise(F.least(mid + own, mid_l + 2 * reach_l))
        out[f"{x}_least"] = F.when(few, mid_l - reach_l).otherwise(F.greatest(mid - own, mid_l - 2 * reach_l))
    return both.select(F.col("lang_of").alias("lang_"), F.col("source_of").alias("source_"), *[v.alias(k) for k, v in out.items()])


def judge(measured: DataFrame, fences: DataFrame) -> DataFrame:
    """The measures with base_failed and kept: within all fences of the document's language and source.

    The fences are written first, so Spark knows their size and broadcasts them only while they are small.
    """
    f = staged(fences, "fences")
    joined = _ratios(measured).join(f, F.col("lang_of").eqNullSafe(F.col("lang_")) & F.col("source_of").eqNullSafe(F.col("source_")), "left")
    fine = F.lit(True)
    for x in RATIOS:
        fine &= F.coalesce(F.col(x) <= F.col(f"{x}_most"), F.lit(True))
    fine &= F.coalesce(F.col("word_length") >= F.col("word_length_least"), F.lit(True))
    return joined.withColumn("kept", ~F.col("base_failed") & fine).drop("lang_", "source_", *[f"{x}_{y}" for x in RATIOS for y in ("most", "least")])


def quality_rules(docs: DataFrame, reach: float = 8.0, least_rows: int = 100) -> DataFrame:
    """One row per document: doc_id, lang_of, source_of, measures, ratios, base_failed and kept.

    Null texts are empty; empty texts fail the base rule (under 50 words). Rows with a null language or
    source form groups of their own. A table without rows gives no rows. Columns besides doc_id, text,
    lang and source are not read. Repeated rows are judged alike, each on its own.
    """
    measured = staged(measures(docs), "measures")
    return judge(measured, thresholds(measured, reach, least_rows))


def filter_quality(docs: DataFrame, reach: float = 8.0, least_rows: int = 100) -> DataFrame:
    """The documents that the rules keep, with all their own columns, whatever their names."""
    fences = thresholds(measures(docs), reach, least_rows)
    names = docs.columns
    hidden = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(names)], "lang", "source", "text")
    judged = judge(measures(hidden, tuple(f"_c{i}" for i in range(len(names)))), fences)
    return judged.filter("kept").select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)])
