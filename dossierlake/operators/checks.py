"""Quality markers, lineage states, job progress, evaluation and text alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dossierlake.functions import text as T


def table_widths(lines: DataFrame) -> DataFrame:
    """Runs of neighbouring pipe lines are tables: per table its lines, its width, and whether all lines agree."""
    rows = lines.filter(F.col("line").contains("|")).withColumn("width", F.size(F.split("line", r"\|")))
    w = Window.partitionBy("doc_id").orderBy("n")
    runs = rows.withColumn("run", F.col("n") - F.row_number().over(w))
    return runs.groupBy("doc_id", "run").agg(F.min("n").alias("first_line"), F.count(F.lit(1)).alias("n_lines"), F.max("width").cast("long").alias("width"), (F.min("width") == F.max("width")).alias("passed")).drop("run")


#: Words of a job's log lines, the step each tells, and the step's progress; the first that stands decides.
STEPS = [("signup", "queued", 5), ("view", "layout", 20), ("click", "fusion", 45), ("purchase", "validation", 80), ("error", "failed", 100)]


def step_of(event: Column) -> Column:
    return F.coalesce(*[F.when(F.contains(event, F.lit(word)), F.lit(step)) for word, step, _ in STEPS], F.lit("unknown"))


def progress_of(step: Column) -> Column:
    return F.coalesce(*[F.when(step == s, F.lit(p)) for _, s, p in STEPS], F.lit(10))


def running_progress(events: DataFrame) -> DataFrame:
    """Progress of a job after every event; it never falls."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    step = step_of(F.col("event_type"))
    return events.select("event_id", "user_id", "ts", step.alias("step"), progress_of(step).alias("own")).withColumn("progress", F.max("own").over(w))


def cache_status(left: DataFrame, right: DataFrame) -> DataFrame:
    """State of every document from the hashes of its source now and when it was parsed: fresh, stale, missing or orphaned."""
    both = left.join(right, "doc_id", "full_outer")
    state = F.when(F.col("hash_now").isNull(), "orphaned").when(F.col("hash_then").isNull(), "missing").when(F.col("hash_now") == F.col("hash_then"), "fresh").otherwise("stale")
    return both.select("doc_id", state.alias("state"))


def overlap(a: Column, b: Column) -> Column:
    """Shared share of the smaller of two sets, in thousandths."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, 0).otherwise(F.floor(1000 * F.size(F.array_intersect(a, b)) / least)).cast("long")


def _met(texts: DataFrame, units: DataFrame, *keys: str) -> DataFrame:
    """The keys of texts, token and unit_id of every token that a text shares with a unit."""
    token = lambda df, *key: df.select(*key, F.explode("tokens").alias("token"))
    return token(texts.withColumn("_tokens", F.col("tokens")), *keys, "_tokens").join(token(units, "unit_id"), "token").withColumnRenamed("_tokens", "a")


def _each_span(spans: DataFrame, found: DataFrame, *keys: str) -> DataFrame:
    """What was found for a text, for every span that has it; by the size of their files spans would look small enough to be broadcast."""
    same = F.col("tokens") == F.col("a")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_"))
    return spans.join(found.hint("merge"), same)


def overlaps(spans: DataFrame, units: DataFrame) -> DataFrame:
    """span_id, unit_id and overlap of spans and the units they share a token with; equal token sets are held against units once."""
    sizes = units.select(F.col("unit_id").alias("unit_id_"), F.size("tokens").alias("n"))
    met = _met(spans.select("tokens").distinct(), units).groupBy("a", "unit_id").agg(F.count(F.lit(1)).alias("both"))
    found = met.join(sizes, F.col("unit_id") == F.col("unit_id_")).select("a", "unit_id", F.floor(1000 * F.col("both") / F.least(F.size("a"), "n")).cast("long").alias("overlap"))
    return _each_span(spans, found).select("span_id", "unit_id", "overlap")


def _scored_texts(spans: DataFrame, units: DataFrame) -> DataFrame:
    """text_, its tokens a, unit_id and score: equality, containment, shared tokens, pairs and numbers."""
    texts = spans.select("text", "tokens").distinct().withColumnRenamed("text", "text_")
    met = _met(texts, units, "text_").select("text_", "a", "unit_id").distinct()
    d = met.join(units.withColumnsRenamed({"tokens": "b", "text": "tb"}), "unit_id")
    pairs = lambda x: T.ngrams(F.col(x), 2)
    digits = lambda x: F.filter(x, lambda t: t.rlike(r"\d"))
    score = F.when(F.col("text_") == F.col("tb"), 80000).when(F.contains(F.col("tb"), F.col("text_")), 58000).otherwise(0) + 34 * overlap(F.col("a"), F.col("b")) + 34 * overlap(pairs("a"), pairs("b")) + 26 * overlap(digits("a"), digits("b"))
    return d.select("text_", "a", "unit_id", score.cast("long").alias("score"))


def aligned(spans: DataFrame, units: DataFrame) -> DataFrame:
    """Scores of spans against the units they share a token with; equal texts are scored once."""
    return _each_span(spans, _scored_texts(spans, units), "text").select("span_id", "unit_id", "score")


def best_aligned(spans: DataFrame, units: DataFrame, least: int) -> DataFrame:
    """The best unit of each span that scores `least` or more, the smaller unit_id on ties; told for each text first."""
    top = lambda df, *by: df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").desc(), "unit_id"))).filter("_n = 1").drop("_n")
    found = top(_scored_texts(spans, units).filter(F.col("score") >= least), "text_", "a")
    return top(_each_span(spans, found, "text").select("span_id", "unit_id", "score"), "span_id")
