"""Job states over a stream, its micro-batches in any order, against the batch form and a plain replay."""

import datetime
import random

import pytest

from dossierlake.operators import jobs
from dossierlake.streaming.jobs import job_states

SCHEMA = "job_id string, seq long, ts timestamp, kind string, file string, step string, error string, files array<string>"
BEGIN = datetime.datetime(2026, 1, 1)


def made():
    rng, rows = random.Random(8), []
    for j in range(12):
        files = [f"f{k}.pdf" for k in range(rng.randint(0, 3))]
        at = BEGIN + datetime.timedelta(seconds=rng.randint(0, 60))
        if j != 5:
            rows.append((f"j{j}", 0, at, "create", None, None, None, files))
        for k in range(1, rng.randint(2, 14)):
            at += datetime.timedelta(seconds=rng.choice([0, 1, 20]))
            kind = rng.choice(["run", "start_file", "file_step", "file_step", "complete_file", "fail_file", "step"] + ["complete", "fail"] * (k > 9))
            step = rng.choice([*jobs.STEP_PROGRESS, "something else"])
            rows.append((f"j{j}", k, at, kind, rng.choice([*files, "other.pdf"]) if "file" in kind else None, step if kind in jobs.STEPPED else None, "broken" if "fail" in kind else None, None))
    return rows


def replayed(rows):
    """Each job's state, event after event."""
    out = {}
    for job, _, at, kind, file, step, error, files in sorted(rows, key=lambda r: (r[2], r[1])):
        if kind == "create":
            out[job] = {"status": "queued", "step": "queued", "file": None, "files": {f: [None, 0] for f in files}, "error": None, "start": at, "end": None, "last": at}
        j = out.get(job)
        if j is None:
            continue
        j["last"] = at
        own = j["files"].get(file)
        told = next((n for w, n in jobs.STEP_PROGRESS.items() if step and w in step.lower()), 10)
        if kind in ("run", "start_file"):
            j["status"] = "running"
        if kind in jobs.STEPPED:
            j["step"] = step
        if kind in ("start_file", "file_step"):
            j["file"] = file
            if own:
                own[1] = max(own[1], told)
        if own and kind in jobs.FILE_STATUS:
            own[0] = jobs.FILE_STATUS[kind]
            own[1] = 100 if kind != "start_file" else own[1]
        if kind in ("complete", "fail"):
            j |= {"status": jobs.JOB_STATUS[kind], "step": jobs.FIXED_STEP[kind], "end": at, "error": error if kind == "fail" else j["error"]}
    return {k: (j["status"], j["step"], j["file"], len(j["files"]), sum(f[0] in ("passed", "failed") for f in j["files"].values()), 100 if j["status"] == "completed" else int(sum(f[1] for f in j["files"].values()) / len(j["files"]) + 0.5) if j["files"] else 0, j["error"], j["start"], j["end"]) for k, j in out.items()}


def told(rows):
    return {r.job_id: (r.status, r.current_step, r.current_file, r.total_files, r.completed_files, r.progress_percent, r.error, r.started_at, r.completed_at) for r in rows}


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(key, before)


def test_snapshots(spark):
    rows = made()
    assert told(jobs.snapshots(spark.createDataFrame(rows, SCHEMA)).collect()) == replayed(rows)
    assert jobs.snapshots(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_states_over_batches_in_any_order(rocks, tmp_path, seed):
    rows, batches = made(), []
    random.Random(seed).shuffle(rows)
    for k in range(4):
        rocks.createDataFrame(rows[k::4], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = rocks.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    keep = lambda df, n: batches.append((n, df.collect()))
    run = job_states(stream).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/state").foreachBatch(keep).trigger(availableNow=True).start()
    run.awaitTermination()
    last = {r.job_id: r for _, found in sorted(batches, key=lambda b: b[0]) for r in found}
    assert told(last.values()) == replayed(rows) and len(batches) >= 4


def test_silent_jobs_are_ended(rocks, tmp_path):
    at = lambda s: BEGIN + datetime.timedelta(seconds=s)
    steps = [[("a", 0, at(0), "create", None, None, None, ["f"]), ("b", 0, at(0), "create", None, None, None, ["f"]), ("b", 1, at(1), "complete", None, None, None, None)], [("c", 0, at(9000), "create", None, None, None, [])], [("c", 1, at(9001), "run", None, "parse started", None, None)]]
    found = []
    rocks.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/in")
    stream = rocks.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in")
    for rows in steps:
        rocks.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run = job_states(stream, "1 second", 60_000).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/state").foreachBatch(lambda df, n: found.extend(df.collect())).trigger(availableNow=True).start()
        run.awaitTermination()
    ended = [r for r in found if r.error]
    assert [(r.job_id, r.status, r.error) for r in ended] == [("a", "failed", "no event for 60000 ms")]
