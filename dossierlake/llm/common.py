"""Shared pieces: tables, staging in the shared folder, and vectorised text hashing.

Word arrays are built on UTF-8 bytes: the separators are ASCII, so splitting bytes equals splitting
code points. Hashes are polynomials modulo 2**64 over prefix sums, finished with a mixing step.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

CHUNK_BYTES = 1 << 18
POWERS = 1 << 19  # powers kept between calls
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SECOND = np.uint64(0xC2B2AE3D27D4EB4F)
SECOND_INV = np.uint64(pow(0xC2B2AE3D27D4EB4F, -1, 1 << 64))

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it; one of our own only in local runs where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        checkpoint = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = checkpoint.get() if checkpoint.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def clear_staged(spark: SparkSession) -> None:
    """Remove what operators of this application have written below `staged`; results that still read it become unreadable."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/staged/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a result to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, work, schema: str | StructType) -> DataFrame:
    """mapInArrow where `work` takes a pyarrow table of bounded text size and returns a dict of columns.

    An Arrow batch is cut into slices of about CHUNK_BYTES of its column `text`, so that the arrays of
    the vectorised steps stay small; a single longer text makes a slice of its own.
    """
    arrow = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = work(part)
                if out is not None:
                    yield pa.RecordBatch.from_arrays([_column(out[f.name], f.type) for f in arrow], schema=arrow)
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return memory that a task has freed: workers live on, and the next stage's JVM needs it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim is not None:
        trim(0)


def _column(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, kind)


def slices(batch: pa.RecordBatch, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = 0
    while at < batch.num_rows:
        total = np.cumsum(lengths[at:])
        n = max(1, int(np.searchsorted(total, most, "right")))
        yield batch.slice(at, n)
        at += n


def texts_of(batch: pa.RecordBatch) -> list[str]:
    return [x or "" for x in batch.column("text").to_pylist()]


def powers(base: np.uint64, n: int, _kept: dict = {}) -> np.ndarray:  # noqa: B006
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    got = _kept.get(int(base))
    if got is None or len(got) < n:
        got = np.full(max(n, POWERS), base, np.uint64)
        got[0] = 1
        np.multiply.accumulate(got, out=got)
        if n <= POWERS:
            _kept[int(base)] = got
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64 = BASE, inverse: np.uint64 = BASE_INV) -> np.ndarray:
    """Hash of values[start:end] for each range, equal for equal contents wherever they stand."""
    n = len(values)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * powers(base, n), out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * powers(inverse, n + 1)[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Words:
    """The words of many texts: byte ranges, the text each belongs to, and 64-bit hashes."""

    def __init__(self, texts: Iterable[str], lower: bool = False, hashed: bool = True):
        encoded = [x.encode("utf-8", "surrogatepass") for x in texts]
        joined = b" ".join([*encoded, b""]) or b" "
        data = np.frombuffer(joined, np.uint8)
        self.data = LOWER[data] if lower else data
        lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
        self.offsets = np.zeros(len(encoded) + 1, np.int64)
        np.cumsum(lengths + 1, out=self.offsets[1:])
        apart = np.empty(len(data) + 2, bool)
        apart[0] = apart[-1] = True
        apart[1:-1] = SEPARATOR[data]
        change = np.flatnonzero(apart[1:] != apart[:-1])
        self.starts, self.ends = change[::2], change[1::2]
        self.bounds = np.searchsorted(self.starts, self.offsets)  # words of text i: bounds[i]:bounds[i+1]
        self.counts = np.diff(self.bounds)
        self.hashes = range_hash(self.data, self.starts, self.ends) if hashed else None

    def part(self, first: int, end: int) -> Words:
        """The words of texts first to end - 1, over the same bytes."""
        out = object.__new__(Words)
        a, b = self.bounds[first], self.bounds[end]
        out.data, out.offsets = self.data, self.offsets[first : end + 1]
        out.starts, out.ends, out.bounds, out.counts = self.starts[a:b], self.ends[a:b], self.bounds[first : end + 1] - a, self.counts[first:end]
        out.hashes = None if self.hashes is None else self.hashes[a:b]
        return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def text_or_empty() -> F.Column:
    return F.coalesce(F.col("text"), F.lit(""))


def text_mark(name: str = "mark") -> F.Column:
    """A 64-bit check of the text, to tell rows that share an id apart."""
    return F.xxhash64(text_or_empty()).alias(name)


def without(docs: DataFrame, gone: DataFrame, name: str) -> DataFrame:
    """The rows of docs whose id and text mark are not among (doc_id, mark) of `gone`, with all their columns, whatever their names."""
    keys = staged(gone.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).distinct(), name)
    names = docs.columns
    hidden = docs.select(F.col("doc_id").alias("_doc"), text_mark("_own"), *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(names)])
    kept = hidden.join(keys, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_mark")), "left_anti")
    return kept.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)])
