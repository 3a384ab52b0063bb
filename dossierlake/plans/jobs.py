"""Pipeline jobs: the events of a user stand for those of a job, the first of them for its creation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierlake.operators import jobs
from dossierlake.registry import query
from dossierlake.sources.tables import table

_STEPS = [*jobs.STEP_PROGRESS, "something else"]
_KIND = "CASE WHEN n = 1 AND user_id % 9 > 0 THEN 'create' WHEN event_id % 211 = 0 THEN 'complete' WHEN event_id % 223 = 0 THEN 'fail' ELSE CASE event_type WHEN 'view' THEN 'start_file' WHEN 'click' THEN 'file_step' WHEN 'purchase' THEN 'complete_file' WHEN 'error' THEN 'fail_file' ELSE 'step' END END"
_FILE = "CASE WHEN kind LIKE '%file%' THEN 'f' || event_id % 5 END"
_ERROR = "CASE WHEN kind LIKE 'fail%' THEN 'error ' || event_id % 7 END"


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of up to four files; some are never created."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    first = e.groupBy(F.col("user_id").alias("user_")).agg(F.min(F.struct("ts", "event_id"))["event_id"].alias("first"))
    e = e.join(first, F.col("user_id") == F.col("user_")).withColumn("n", F.when(F.col("event_id") == F.col("first"), 1).otherwise(2)).withColumn("kind", F.expr(_KIND))
    step = F.element_at(F.array(*map(F.lit, _STEPS)), (F.col("event_id") % len(_STEPS) + 1).cast("int"))
    files = F.when(F.col("kind") == "create", F.slice(F.array(*[F.lit(f"f{k}") for k in range(4)]), 1, (F.col("user_id") % 5).cast("int")))
    return e.select(F.col("user_id").cast("string").alias("job_id"), F.col("event_id").alias("seq"), "ts", "kind", F.expr(_FILE).alias("file"), F.when(F.col("kind").isin(*jobs.STEPPED), step).alias("step"), F.expr(_ERROR).alias("error"), files.alias("files"))


_case = lambda values: "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"
_POINTS = "CASE " + " ".join(f"WHEN contains(step, '{w}') THEN {n}" for w, n in jobs.STEP_PROGRESS.items()) + f" ELSE {jobs.OTHER_STEP} END"
_latest = lambda x: f"arg_max({x}, (ts, event_id)) FILTER ({x} IS NOT NULL)"


@query(
    "job_store",
    f"""WITH e0 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), e1 AS (SELECT *, {_KIND} AS kind FROM e0),
    e AS (SELECT *, {_FILE} AS file, CASE WHEN kind IN ('run', 'start_file', 'file_step', 'step') THEN {_STEPS}[event_id % {len(_STEPS)} + 1] END AS step, {_ERROR} AS error FROM e1),
    s AS (SELECT *, {_case(jobs.JOB_STATUS)} AS st, coalesce(step, {_case(jobs.FIXED_STEP)}) AS cs, CASE WHEN kind IN ('start_file', 'file_step') THEN file END AS cf, CASE WHEN kind = 'fail' THEN error END AS er FROM e),
    j AS (SELECT user_id, {_latest("st")} AS status, {_latest("cs")} AS current_step, {_latest("cf")} AS current_file, {_latest("er")} AS error, min(ts) FILTER (kind = 'create') AS started_at, max(ts) FILTER (kind IN ('complete', 'fail')) AS completed_at, max(ts) AS last_at FROM s GROUP BY user_id HAVING count(*) FILTER (kind = 'create') > 0),
    f AS (SELECT user_id, file, arg_max({_case(jobs.FILE_STATUS)}, (ts, event_id)) FILTER ({_case(jobs.FILE_STATUS)} IS NOT NULL) AS fs, max(CASE WHEN kind IN ('start_file', 'file_step') THEN {_POINTS} WHEN kind IN ('complete_file', 'fail_file') THEN 100 END) AS fp FROM e WHERE file IS NOT NULL GROUP BY user_id, file),
    l AS (SELECT j.user_id, count(k) AS total_files, count(*) FILTER (fs IN ('passed', 'failed')) AS completed_files, sum(coalesce(fp, 0)) AS total FROM j LEFT JOIN range(4) r(k) ON k < j.user_id % 5 LEFT JOIN f ON f.user_id = j.user_id AND f.file = 'f' || k GROUP BY j.user_id)
    SELECT CAST(user_id AS VARCHAR) AS job_id, status, current_step, current_file, total_files, completed_files, CAST(CASE WHEN status = 'completed' THEN 100 WHEN total_files = 0 THEN 0 ELSE floor(total / total_files + 0.5) END AS BIGINT) AS progress_percent, error, started_at, completed_at, greatest(0, epoch_us(coalesce(completed_at, last_at)) // 1000 - epoch_us(started_at) // 1000) AS elapsed_ms FROM j JOIN l USING (user_id)""",
)
def job_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of every job after all its events."""
    return jobs.snapshots(job_events(spark, sf_dir))
