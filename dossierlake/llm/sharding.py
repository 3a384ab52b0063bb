"""Sharding by sampled splitters, with DataFrame functions only.

Size-weighted samples of the key give quantile boundaries; every record falls into a key range by
them, ranges that turn out overfull are subdivided, and shards are runs of ranges cut at equal bytes,
equal texts together. Only keys, sizes and ids are moved, never the texts.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate, groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dossierlake.llm.common import staged

HEAD = 3  # hex digits of the key by which its range is looked up
SPLIT = 64  # a group of equal texts above 1 / SPLIT of a shard is split


def sized_texts(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, hash of the text, and a number for every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(text.cast("binary")).alias("hash"),
        F.monotonically_increasing_id().alias("row"),
    )


def keyed_groups(sized: DataFrame, most: int) -> DataFrame:
    """With the key: the text's hash, so that a group of equal texts is one point; only for groups of more than `most` bytes (fewer than total / most) id and row follow."""
    large = sized.groupBy(F.col("hash").alias("hash_")).agg(F.sum("size").alias("bytes")).filter(F.col("bytes") > most).select("hash_")
    apart = F.concat("hash", F.coalesce(F.hex("doc_id"), F.lit("-")), F.lit("."), F.hex("row"))
    return sized.join(F.broadcast(large), F.col("hash") == F.col("hash_"), "left").select("doc_id", "size", "text_crc32", "row", F.when(F.col("hash_").isNull(), F.col("hash")).otherwise(apart).alias("key"))


def weighted_sample(keyed: DataFrame, total: int, draws: int) -> list[tuple[str, int]]:
    """About `draws` draws in proportion to size, as sorted (key, times drawn): systematic sampling with a phase from the key's hash."""
    phase = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    times = F.floor(F.col("size") * F.lit(draws / max(total, 1)) + phase).cast("long")
    return sorted((r[0], r[1]) for r in keyed.select("key", times.alias("times")).filter("times > 0").collect())


def quantile_splitters(sample: list[tuple[str, int]], ranges: int) -> list[str]:
    """Keys that cut the drawn weight into `ranges` near equal parts."""
    if not sample:
        return []
    sums = list(accumulate(n for _, n in sample))
    return sorted({sample[bisect_left(sums, sums[-1] * i / ranges)][0] for i in range(1, ranges)})


def with_range(keyed: DataFrame, splitters: list[str]) -> DataFrame:
    """The records with their range, the number of splitters up to the key: found by the key's head, then among the few splitters of that head."""
    own = {head: list(x) for head, x in groupby(splitters, lambda s: s[:HEAD])}
    heads, before = [], 0
    for k in range(16**HEAD):
        head = f"{k:0{HEAD}x}"
        heads.append((head, before, own.get(head, [])))
        before += len(own.get(head, []))
    table = keyed.sparkSession.createDataFrame(heads, "head string, before int, inside array<string>")
    joined = keyed.join(F.broadcast(table), F.left("key", F.lit(HEAD)) == F.col("head"))
    return joined.select(*keyed.columns, (F.col("before") + F.size(F.filter("inside", lambda s: s <= F.col("key")))).alias("range"))


def shard_by_splitters(docs: DataFrame, shards: int = 8, ranges: int = 1024, draws_per_range: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law 'bytes', shard, slot and a null grown_shard for every document.

    Shards hold near equal bytes: a group of equal texts belongs where its middle byte falls, so shards
    differ by about one group. A group above 1 / SPLIT of a shard is split at the shards' edges, each of its records
    where its own middle byte falls. The sample is bounded by ranges * draws_per_range draws whatever the
    input, and so are the splitters and the range totals. Null texts have size 1 and equal the empty text; rows
    that repeat are records of their own. An empty table gives no rows; columns besides doc_id and text are not read.
    """
    sized = staged(sized_texts(docs), "shard-sizes")
    total = sized.agg(F.sum("size")).first()[0] or 0
    keyed = staged(keyed_groups(sized, total // (shards * SPLIT)), "shard-keys")
    splitters = quantile_splitters(weighted_sample(keyed, total, ranges * draws_per_range), ranges)
    ranged = staged(with_range(keyed, splitters), "shard-ranges")

    full = max(1, 2 * total // ranges)
    parts = ranged.groupBy("range").agg(F.ceil(F.sum("size") / full).cast("long").alias("parts"), F.count(F.lit(1)).alias("of"))
    parted = ranged.join(F.broadcast(parts), "range").withColumn("part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("key"), F.least("parts", "of"))).otherwise(0))
    before = Window.orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parted.groupBy("range", "part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    offsets = offsets.select("range", "part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"))

    within = Window.partitionBy("range", "part").orderBy("key", "row")
    group = Window.partitionBy("range", "part", "key")
    ended = F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0))
    placed = parted.select("*", ended.alias("ended"), F.row_number().over(within).alias("nth"))
    placed = placed.select("*", F.min(F.col("ended") - F.col("size")).over(group).alias("begun"), F.sum("size").over(group).alias("held"))
    middle = 2 * (F.col("bytes_before") + F.col("begun")) + F.col("held")
    placed = placed.join(F.broadcast(offsets), ["range", "part"]).select(
        "doc_id", "size", "text_crc32",
        F.floor(middle * shards / F.lit(2 * max(total, 1))).cast("int").alias("shard"),
        (F.col("rows_before") + F.col("nth") - 1).alias("rank"),
    )
    placed = staged(placed, "shard-ranks")
    firsts = placed.groupBy("shard").agg(F.min("rank").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
