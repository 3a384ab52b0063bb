"""States of pipeline jobs from their events, by aggregation; `streaming.jobs` keeps the same states over a stream.

An event has job_id, seq and ts (its order), kind (create, run, start_file, file_step, complete_file, fail_file, step,
complete, fail), and file, step, error and files (array, of create) where the kind needs them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of a step and the progress they stand for, the first that stands deciding; the progress of other steps.
STEP_PROGRESS = {
    "upload received": 4, "file saved": 8, "parse started": 12, "layout analysis started": 18, "layout/docling": 28, "artifact filtering started": 38, "semantic fusion started": 46, "export assets started": 56,
    "validation started": 66, "section map": 74, "pageindex upload": 82, "pageindex polling": 90, "tree validation": 96, "completed": 100, "failed": 100,
}
OTHER_STEP = 10
FILE_STATUS = {"start_file": "running", "complete_file": "passed", "fail_file": "failed"}
JOB_STATUS = {"create": "queued", "run": "running", "start_file": "running", "complete": "completed", "fail": "failed"}
FIXED_STEP = {"create": "queued", "complete": "completed", "fail": "failed"}
STEPPED = ["run", "start_file", "file_step", "step"]


def step_progress(step: Column) -> Column:
    low = F.lower(step)
    return F.coalesce(*[F.when(F.contains(low, F.lit(word)), F.lit(n)) for word, n in STEP_PROGRESS.items()], F.lit(OTHER_STEP))


def _mapped(values: dict[str, str]) -> Column:
    return F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in values.items()])


def snapshots(events: DataFrame) -> DataFrame:
    """One row a job that was created: status, current_step, current_file, total_files, completed_files, progress_percent, error, started_at, completed_at, elapsed_ms.

    The last event of a kind decides; a file's progress never falls. Events of files that the job
    doesn't list move the job on but count for no file. Events of jobs never created give nothing.
    """
    order = F.struct("ts", "seq")
    latest = lambda value: F.max_by(value, F.when(value.isNotNull(), order))
    status, fixed = _mapped(JOB_STATUS), _mapped(FIXED_STEP)
    step = F.when(F.col("kind").isin(*STEPPED), F.col("step")).otherwise(fixed)
    over = F.col("kind").isin("complete", "fail")
    jobs = events.groupBy("job_id").agg(
        F.max((F.col("kind") == "create").cast("int")).alias("created"), latest(status).alias("status"), latest(step).alias("current_step"), latest(F.when(F.col("kind").isin("start_file", "file_step"), F.col("file"))).alias("current_file"),
        latest(F.when(F.col("kind") == "fail", F.col("error"))).alias("error"), F.min(F.when(F.col("kind") == "create", F.col("ts"))).alias("started_at"), F.max(F.when(over, F.col("ts"))).alias("completed_at"), F.max("ts").alias("last_at"),
        F.min_by("files", F.when(F.col("kind") == "create", order)).alias("files"),
    )
    jobs = jobs.filter("created = 1").drop("created")
    progress = F.when(F.col("kind").isin("start_file", "file_step"), step_progress(F.col("step"))).when(F.col("kind").isin("complete_file", "fail_file"), 100)
    done = events.filter("file IS NOT NULL").groupBy(F.col("job_id").alias("job_"), "file").agg(latest(_mapped(FILE_STATUS)).alias("file_status"), F.max(progress).alias("file_progress"))
    listed = jobs.select("job_id", F.explode("files").alias("name"))
    per = listed.join(done, (F.col("job_id") == F.col("job_")) & (F.col("name") == F.col("file")), "left").groupBy(F.col("job_id").alias("job_")).agg(
        F.count(F.lit(1)).alias("total_files"), F.count(F.when(F.col("file_status").isin("passed", "failed"), 1)).alias("completed_files"), F.sum(F.coalesce("file_progress", F.lit(0))).alias("sum"))
    d = jobs.join(per, F.col("job_id") == F.col("job_"), "left")
    total = F.coalesce("total_files", F.lit(0))
    percent = F.when(F.col("status") == "completed", 100).when(total == 0, 0).otherwise(F.floor(F.col("sum") / total + 0.5))
    elapsed = F.unix_millis(F.coalesce("completed_at", "last_at").cast("timestamp")) - F.unix_millis(F.col("started_at").cast("timestamp"))
    return d.select("job_id", "status", "current_step", "current_file", total.cast("long").alias("total_files"), F.coalesce("completed_files", F.lit(0)).cast("long").alias("completed_files"), percent.cast("long").alias("progress_percent"), "error", "started_at", "completed_at", F.greatest(F.lit(0), elapsed).alias("elapsed_ms"))
