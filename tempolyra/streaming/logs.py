"""Streaming forms over the event log and ticket heartbeats.

Watermark delays are parameters. Keyed state lives in Spark's state store (RocksDB for large state) and
goes by time-to-live or timers; results equal the batch forms on the same rows in time order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.events import THROTTLE_KEY, level_gate
from ..operators.queues import ACTIVE_TICKET
from ..operators.redaction import redact


def stream_ingest(events: DataFrame, threshold: str = "INFO", debug: bool = False) -> DataFrame:
    """Level gate and redaction; append the result with writeStream."""
    return redact(level_gate(events, threshold, debug))


class _Throttle(StatefulProcessor):
    """Keeps the time of the last row let through."""

    def __init__(self, every_ms: int, ttl_ms: int | None, key: tuple[str, ...], columns: list[str]):
        self.every_ms, self.ttl_ms, self.key, self.columns = every_ms, ttl_ms, key, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at bigint", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self.last.get()[0] if self.last.exists() else None
        batch = pd.concat(list(rows)).sort_values(["created_at", "id"])
        kept = []
        for k, at in enumerate(batch["created_at"]):
            if last is None or at - last >= self.every_ms:
                kept.append(k)
                last = int(at)
        self.last.update((last,))
        yield batch.iloc[kept][self.columns]

    def close(self) -> None:
        pass


def stream_throttle(events: DataFrame, every_ms: int, key: tuple[str, ...] = THROTTLE_KEY, ttl_ms: int | None = 86_400_000) -> DataFrame:
    """Per key, rows at least every_ms (of created_at milliseconds) after the last one let through. A key that lets
    nothing through for ttl_ms of processing time is forgotten (a day, which should exceed every_ms by far); None
    keeps every key for ever."""
    return events.groupBy(*key).transformWithStateInPandas(_Throttle(every_ms, ttl_ms, key, events.columns), events.schema, "append", "processingTime" if ttl_ms else "none")


class _JobState(StatefulProcessor):
    """Keeps a job's status; a canceled job takes nothing but a requeue."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "status string, applied bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        status, n = self.state.get() if self.state.exists() else (None, 0)
        for r in pd.concat(list(rows)).sort_values(["created_at", "id"]).itertuples():
            if status != "CANCELED" or r.requeue:
                status, n = r.status, n + 1
        self.state.update((status, n))
        yield pd.DataFrame({"reference_id": [key[0]], "status": [status], "applied": [n]})

    def close(self) -> None:
        pass


def stream_job_state(changes: DataFrame) -> DataFrame:
    """Each job's status after every batch of changes (reference_id, status, requeue, created_at, id)."""
    kind = changes.schema["reference_id"].dataType.simpleString()
    return changes.groupBy("reference_id").transformWithStateInPandas(_JobState(), f"reference_id {kind}, status string, applied bigint", "update", "none")


def stream_expire(touches: DataFrame, waiting: str = "120 seconds", uploading: str = "3600 seconds", delay: str = "0 seconds") -> DataFrame:
    """Tickets (id, status, ts) without a touch for their status's time: a session that closed, with its end.
    A ticket whose last touch left it in a final status does not expire."""
    gap = F.when(F.col("status") == "UPLOADING", uploading).otherwise(waiting)
    closed = touches.withWatermark("ts", delay).groupBy("id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("touches"), F.max_by("status", "ts").alias("last"))
    return closed.where(F.col("last").isin(*ACTIVE_TICKET)).select("id", F.col("session_window.end").alias("expired_at"), "touches")


def stream_stale_sessions(chunks: DataFrame, gap: str, delay: str = "0 seconds") -> DataFrame:
    """Upload sessions (ticket_id, ts) whose last chunk lies a gap behind."""
    return chunks.withWatermark("ts", delay).groupBy("ticket_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("chunks")).select("ticket_id", F.col("session_window.end").alias("stale_at"), "chunks")


TRACE_KEY = ["reference_id", "run_id", "stage", "component"]


class _Traces(StatefulProcessor):
    """Keeps the start that waits for its end. The next event of its key ends it or leaves it open; so does
    the watermark, once it is within_ms past the start."""

    def __init__(self, within_ms: int):
        self.within_ms = within_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.start = handle, handle.getValueState("start", "id bigint, at bigint")

    def _row(self, key, ended_at, outcome: str) -> dict:
        start_id, at = self.start.get()
        self.start.clear()
        times = {"started_at": pd.Timestamp(at, unit="ms"), "ended_at": pd.NaT if ended_at is None else pd.Timestamp(ended_at, unit="ms")}
        return dict(zip(TRACE_KEY, key)) | {"start_id": start_id} | times | {"outcome": outcome}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = []
        for r in pd.concat(list(rows)).sort_values(["at", "id"]).itertuples():
            if self.start.exists():
                ends = r.event != "stage.started"
                out.append(self._row(key, r.at if ends else None, r.event.removeprefix("stage.") if ends else "open"))
            if r.event == "stage.started":
                self.start.update((int(r.id), int(r.at)))
                self.handle.registerTimer(int(r.at) + self.within_ms)
        yield pd.DataFrame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        late = self.start.exists() and self.start.get()[1] + self.within_ms <= expiredTimerInfo.getExpiryTimeInMs()
        yield pd.DataFrame([self._row(key, None, "open")] if late else [])

    def close(self) -> None:
        pass


def stream_traces(events: DataFrame, within_ms: int = 7_200_000, delay: str = "10 minutes") -> DataFrame:
    """Stage starts with what ended them: the key, start_id, started_at, ended_at and outcome (completed, failed,
    or open where the key's next event is another start or none came within_ms). events has the key, id,
    event and ts; a key's events count in order of time within each batch."""
    marks = events.where(F.col("event").isin("stage.started", "stage.completed", "stage.failed")).withWatermark("ts", delay)
    types = {f.name: f.dataType.simpleString() for f in marks.schema.fields}
    shape = ", ".join(f"{c} {types[c]}" for c in TRACE_KEY) + ", start_id bigint, started_at timestamp, ended_at timestamp, outcome string"
    rows = marks.select(*TRACE_KEY, F.col("id").cast("long").alias("id"), "event", "ts", F.unix_millis("ts").alias("at"))
    return rows.groupBy(*TRACE_KEY).transformWithStateInPandas(_Traces(within_ms), shape, "append", "eventTime")


def stream_run_timings(
    events: DataFrame, queued: str = "job.queued", assigned: str = "worker.assigned", ended: tuple[str, ...] = ("worker.released", "worker.failed"),
    within: str = "2 hours", delay: str = "10 minutes",
) -> DataFrame:
    """Assignments (reference_id, assigned_id, wait_ms, run_ms) of events (reference_id, id, event, ts), as run_timings
    has them, from the marks that lie `within` their time on either side. Two sides of one stream meet by an
    interval join, both with a watermark, so state is bounded by `within` and `delay`; rows later than the watermark
    are dropped, and an assignment comes out when the watermark has passed what could change it."""
    marks = events.where(F.col("event").isin(queued, assigned, *ended)).withWatermark("ts", delay)
    runs = marks.where(F.col("event") == assigned).select(F.col("reference_id").alias("ref"), F.col("id").alias("assigned_id"), F.col("ts").alias("at"))
    near = marks.select("reference_id", "id", "event", F.col("ts").alias("mark_ts"))
    reach = F.expr(f"INTERVAL {within}")
    met = runs.join(near, (F.col("ref") == F.col("reference_id")) & (F.col("mark_ts") >= F.col("at") - reach) & (F.col("mark_ts") <= F.col("at") + reach) & (F.col("id") != F.col("assigned_id")), "leftOuter")
    before = (F.col("mark_ts") < F.col("at")) | ((F.col("mark_ts") == F.col("at")) & (F.col("id") < F.col("assigned_id")))
    after = F.when(~before, F.struct("mark_ts", "id", "event"))
    found = met.groupBy("ref", "assigned_id", "at").agg(F.max(F.when(before & (F.col("event") == queued), F.col("mark_ts"))).alias("queued_at"), F.min(after).alias("next"))
    run = F.when(F.col("next.event").isin(*ended), F.unix_millis("next.mark_ts") - F.unix_millis("at"))
    return found.select(F.col("ref").alias("reference_id"), "assigned_id", (F.unix_millis("at") - F.unix_millis("queued_at")).alias("wait_ms"), run.alias("run_ms"))


def stream_dedup(requests: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The first request of each client_submission_id within the watermark's delay."""
    return requests.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["client_submission_id"])


def stream_retain(events: DataFrame, keep: str = "30 days", now: Column | None = None) -> DataFrame:
    """Events (ts) no older than `keep` at the time of their batch, or at `now`. What has been stored ages by
    retain_events."""
    at = F.current_timestamp() if now is None else now
    return events.where(F.col("ts") >= at - F.expr(f"INTERVAL {keep}"))
