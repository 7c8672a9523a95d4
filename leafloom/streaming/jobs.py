"""State of ingest jobs from their events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from leafloom.streaming.state import drain, use_state_store

TERMINAL = ["pipeline_complete", "stage_error"]
RUNNING = ["stage_start", "stage_progress"]


def job_state(events: DataFrame) -> DataFrame:
    """``(job_id, state, started_at, completed_at, total_nodes)`` for ``(job_id, event_id, ts, event, total_nodes)``.

    The first terminal event decides and later ones change nothing. Everything is a minimum or a maximum, so
    events may come in any order.
    """
    order = F.struct("ts", "event_id")
    ends = F.col("event").isin(TERMINAL)
    first_end = F.min_by(F.when(ends, F.struct("event", "ts", "total_nodes")), F.when(ends, order))
    rows = events.groupBy("job_id").agg(
        first_end.alias("_end"),
        F.max(F.col("event").isin(RUNNING)).alias("_ran"),
        F.min("ts").alias("started_at"),
    )
    state = (
        F.when(F.col("_end.event") == "pipeline_complete", "complete")
        .when(F.col("_end.event") == "stage_error", "failed")
        .when(F.col("_ran"), "running")
        .otherwise("queued")
    )
    nodes = F.when(F.col("_end.event") == "pipeline_complete", F.col("_end.total_nodes"))
    return rows.select("job_id", state.alias("state"), "started_at", F.col("_end.ts").alias("completed_at"), nodes.alias("total_nodes"))


STATE = "started long, ran boolean, event string, ended long, event_id long, total_nodes int, timer long"
ROWS = "job_id string, state string, started long, completed long, total_nodes int"
LATE, IDLE_MS = "10 minutes", 3_600_000


class JobProcessor(StatefulProcessor):
    """State of a job: one small row, its first terminal event being the mark that later ones do not change.

    It leaves the store when the watermark is an hour past the job's last event, finished or not.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", STATE)

    def handleInputRows(self, key, rows, timerValues):
        known = self.job.get() if self.job.exists() else None
        started, ran, *end, timer = known or (None, False, None, None, None, None, None)
        last = None
        for r in rows:
            started = r.us if started is None else min(started, r.us)
            last = r.us if last is None else max(last, r.us)
            ran = ran or r.event in RUNNING
            if r.event in TERMINAL and (end[0] is None or (r.us, r.event_id) < (end[1], end[2])):
                end = [r.event, r.us, r.event_id, r.total_nodes]
        wake = max(timer or 0, last // 1000 + IDLE_MS)
        if wake != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(wake)
        now = (started, ran, *end, wake)
        if known is None or tuple(known) != now:
            self.job.update(now)
        if known is None or tuple(known)[:-1] != now[:-1]:
            state = {"pipeline_complete": "complete", "stage_error": "failed"}.get(end[0], "running" if ran else "queued")
            yield Row(job_id=key[0], state=state, started=started, completed=end[1], total_nodes=end[3] if state == "complete" else None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.job.clear()
        return iter(())

    def close(self) -> None:
        pass


def job_updates(events: DataFrame, late: str = LATE) -> DataFrame:
    """`ROWS` of every job that a batch changes; times are microseconds. Events later than ``late`` are left out by the watermark."""
    use_state_store(events.sparkSession)
    rows = events.select("job_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event", "total_nodes")
    return rows.withWatermark("ts", late).groupBy("job_id").transformWithState(JobProcessor(), ROWS, "Update", "EventTime")


def run_job_state(events: DataFrame, out: str | None = None, late: str = LATE) -> DataFrame:
    """Drains an event stream and returns the latest state per job. A finished job stays finished, also if events reach it after its state has left the store."""
    finished = F.col("state").isin("complete", "failed").cast("int")
    kind = events.schema["ts"].dataType
    rows = drain(job_updates(events, late), ROWS, "job_id", "job-state", out, finished)
    time = lambda c: F.timestamp_micros(c).cast(kind)
    return rows.select("job_id", "state", time("started").alias("started_at"), time("completed").alias("completed_at"), "total_nodes")
