"""Job states and progress over streams of events; the batch forms are in operators.jobs and operators.checks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from dossierlake.operators.checks import progress_of, step_of
from dossierlake.operators.jobs import FILE_STATUS, FIXED_STEP, JOB_STATUS, OTHER_STEP, STEP_PROGRESS, STEPPED


def progress_stream(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Per job and window: events, greatest progress and whether the job failed; rows later than `late` are left out."""
    step = step_of(F.col("event_type"))
    e = events.select("user_id", F.col("ts").cast("timestamp").alias("ts"), step.alias("step"), progress_of(step).alias("percent"))
    return e.withWatermark("ts", late).groupBy(F.window("ts", width), "user_id").agg(F.count(F.lit(1)).alias("n_events"), F.max("percent").alias("progress"), F.bool_or(F.col("step") == "failed").alias("failed"))


OUT = "job_id string, status string, current_step string, current_file string, total_files long, completed_files long, progress_percent long, error string, started_at timestamp, completed_at timestamp, elapsed_ms long"
_LATEST = "at long, seq long, value string"


class JobStates(StatefulProcessor):
    """The state of one job: what was told last of each kind, by event time, and of each file; events may come in any order.

    A timer at the last event plus `idle` milliseconds ends a job that says nothing any more (it counts as failed
    unless it is over) and gives its state back.
    """

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.told = handle.getMapState("told", "kind string", _LATEST)
        self.files = handle.getMapState("files", "file string", "at long, seq long, value string, progress long")
        self.listed = handle.getValueState("listed", "files array<string>, at long, seq long, first long, last long, timer long")

    def _keep(self, kind: str, at: int, seq: int, value: str | None) -> None:
        if value is None:
            return
        before = self.told.getValue((kind,)) if self.told.containsKey((kind,)) else None
        if before is None or (at, seq) > (before[0], before[1]):
            self.told.updateValue((kind,), (at, seq, value))

    def _keep_file(self, file: str, at: int, seq: int, status: str | None, progress: int | None) -> None:
        before = self.files.getValue((file,)) if self.files.containsKey((file,)) else (-1, -1, None, 0)
        newer = status is not None and (at, seq) > (before[0], before[1])
        self.files.updateValue((file,), (*((at, seq, status) if newer else before[:3]), max(before[3], progress or 0)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.listed.get() if self.listed.exists() else (None, 2**62, 2**62, 2**62, -1, -1)
        files, first_at, first_seq, started, last, timer = held
        for frame in rows:
            for r in frame.itertuples(index=False):
                at, seq, kind = int(r.ts.timestamp() * 1000), int(r.seq), r.kind
                text = lambda x: x if isinstance(x, str) else None
                file, step = text(r.file), text(r.step)
                last = max(last, at)
                if kind == "create":
                    started = min(started, at)
                    if (at, seq) < (first_at, first_seq):
                        files, first_at, first_seq = list(r.files), at, seq
                self._keep("status", at, seq, JOB_STATUS.get(kind))
                self._keep("step", at, seq, step if kind in STEPPED else FIXED_STEP.get(kind))
                if kind in ("start_file", "file_step"):
                    self._keep("file", at, seq, file)
                if kind == "fail":
                    self._keep("error", at, seq, text(r.error))
                if kind in ("complete", "fail"):
                    self._keep("over", at, 0, "over")
                if file is not None:
                    told = next((n for word, n in STEP_PROGRESS.items() if step is not None and word in step.lower()), OTHER_STEP)
                    self._keep_file(file, at, seq, FILE_STATUS.get(kind), told if kind in ("start_file", "file_step") else 100 if kind in ("complete_file", "fail_file") else None)
        if timer != last + self.idle:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            timer = last + self.idle
            self.handle.registerTimer(timer)
        self.listed.update((files, first_at, first_seq, started, last, timer))
        if files is not None:
            yield self._row(key[0])

    def _row(self, job: str, error: str | None = None) -> pd.DataFrame:
        files, _, _, started, last, _ = self.listed.get()
        value = lambda kind: self.told.getValue((kind,)) if self.told.containsKey((kind,)) else None
        said = {k: v[2] if (v := value(k)) else None for k in ("status", "step", "file", "error")}
        over = value("over")
        own = [self.files.getValue((f,)) if self.files.containsKey((f,)) else (0, 0, None, 0) for f in files]
        percent = 100 if said["status"] == "completed" else int(sum(x[3] for x in own) / len(own) + 0.5) if own else 0
        if error is not None:
            said |= {"status": "failed", "step": "failed", "error": error}
        stamp = lambda ms: pd.Timestamp(ms, unit="ms")
        row = {"job_id": job, "status": said["status"], "current_step": said["step"], "current_file": said["file"], "total_files": len(files), "completed_files": sum(x[2] in ("passed", "failed") for x in own), "progress_percent": percent, "error": said["error"], "started_at": stamp(started), "completed_at": stamp(over[0]) if over else None, "elapsed_ms": max(0, (over[0] if over else last) - started)}
        return pd.DataFrame([row])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        files = self.listed.get()[0]
        over = self.told.containsKey(("status",)) and self.told.getValue(("status",))[2] in ("completed", "failed")
        if files is not None and not over:
            yield self._row(key[0], f"no event for {self.idle} ms")
        for state in (self.told, self.files, self.listed):
            state.clear()

    def close(self) -> None:
        pass


def job_states(events: DataFrame, late: str = "1 hour", idle: int = 600_000) -> DataFrame:
    """The state of each job after each micro-batch that told something of it (update mode), as operators.jobs.snapshots has it.

    Needs the RocksDB state store. Events later than `late` behind the watermark are left out; a job without events for
    `idle` milliseconds of event time is ended by a timer.
    """
    return events.withWatermark("ts", late).groupBy("job_id").transformWithStateInPandas(statefulProcessor=JobStates(idle), outputStructType=OUT, outputMode="Update", timeMode="EventTime")
