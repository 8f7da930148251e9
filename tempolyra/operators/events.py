"""Event-log operators: search, timelines, classes, throttling, traces, retention.

An event row has id, level, category, event, message, reference_id, run_id, stage, component,
duration_ms, details (JSON text) and created_at (epoch milliseconds, or any ordered type).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

# fixed values: levels and their ranks
LEVELS = {"DEBUG": 10, "INFO": 20, "WARNING": 30, "ERROR": 40, "CRITICAL": 50}
# fixed values: stages with the error code and the progress of a failure
FAILURES = {
    "REMOVING_VOCALS": ("VOCAL_REMOVAL_FAILED", 25),
    "EXTRACTING_AUDIO": ("AUDIO_EXTRACTION_FAILED", 15),
    "TRANSCRIBING": ("TRANSCRIPTION_FAILED", 40),
    "PROCESSING_LYRICS": ("LYRIC_PROCESSING_FAILED", 75),
    "ALIGNING": ("ALIGNMENT_FAILED", 90),
    "GENERATING_SUBTITLE": ("SUBTITLE_GENERATION_FAILED", 95),
    "RENDERING_VIDEO": ("VIDEO_RENDERING_FAILED", 98),
}
DAY_MS = 86_400_000
#: Text columns that a keyword search reads.
SEARCHED = ("event", "message", "reference_id", "details")


def search_events(
    events: DataFrame, query: str | None = None, since=None, until=None, limit: int = 100, offset: int = 0,
    descending: bool = True, **equal,
) -> tuple[DataFrame, DataFrame]:
    """One page of the matching events by (created_at, id), and their number as (total). `equal` holds
    column filters; None filters nothing. The time range includes both ends. A keyword matches like SQL
    LIKE '%keyword%' without regard to case; a blank one matches all."""
    found = events
    for name, value in equal.items():
        if value is not None:
            found = found.where(F.col(name) == value)
    if since is not None:
        found = found.where(F.col("created_at") >= since)
    if until is not None:
        found = found.where(F.col("created_at") <= until)
    if query and query.strip():
        pattern = f"%{query.strip()}%"
        hits = [F.coalesce(F.col(c).cast("string"), F.lit("")).ilike(pattern) for c in SEARCHED if c in events.columns]
        any_hit = hits[0]
        for h in hits[1:]:
            any_hit = any_hit | h
        found = found.where(any_hit)
    way = F.desc if descending else F.asc
    return found.orderBy(way("created_at"), way("id")).offset(offset).limit(limit), found.agg(F.count(F.lit(1)).alias("total"))


def level_rank(level: Column) -> Column:
    rank = F.lit(LEVELS["INFO"])
    for name, value in LEVELS.items():
        rank = F.when(F.upper(level) == name, value).otherwise(rank)
    return rank


def level_gate(events: DataFrame, threshold: str = "INFO", debug: bool = False) -> DataFrame:
    """Events at or above a threshold; DEBUG ones only with the debug flag. Unknown levels rank as INFO."""
    least = LEVELS.get(threshold.upper(), LEVELS["INFO"])
    kept = level_rank(F.col("level")) >= least
    return events.where(kept if debug else kept & (F.upper("level") != "DEBUG"))


def event_state(events: DataFrame) -> DataFrame:
    """Adds state: failed, fallback, skipped, completed or none; the first that applies."""
    has = F.col("event").contains
    return events.withColumn(
        "state",
        F.when(has("failed") | (F.col("level") == "ERROR"), "failed")
        .when(has("fallback") | (F.col("level") == "WARNING"), "fallback")
        .when(has("skipped"), "skipped")
        .when(has("completed"), "completed")
        .otherwise("none"),
    )


def failure_code(jobs: DataFrame, tool_missing: Column | None = None) -> DataFrame:
    """Adds error_code and progress of a failure in the job's stage; null for other stages."""
    code, progress = F.lit(None).cast("string"), F.lit(None).cast("int")
    for stage, (c, p) in FAILURES.items():
        code = F.when(F.col("stage") == stage, c).otherwise(code)
        progress = F.when(F.col("stage") == stage, p).otherwise(progress)
    if tool_missing is not None:
        code = F.when(tool_missing, "FFMPEG_UNAVAILABLE").otherwise(code)
    return jobs.withColumn("error_code", code).withColumn("progress", progress)


def job_presentation(jobs: DataFrame) -> DataFrame:
    """Adds tone, terminal and phase from status, stage and input_mode."""
    s, g = F.col("status"), F.col("stage")
    active = list(FAILURES)
    tone = (
        F.when(s == "CANCELED", "canceled")
        .when(s.isin("COMPLETED", "SUBTITLE_GENERATED", "ALIGNED", "TRANSCRIBED"), "success")
        .when((s == "LYRICS_PROCESSED") & (g == "READING_REVIEW_SAVING"), "active")
        .when((s == "LYRICS_PROCESSED") & (g == "READING_REVIEW_REQUIRED"), "pending")
        .when(s == "LYRICS_PROCESSED", "success")
        .when(s == "FAILED", "error")
        .when(g.isin(*active), "active")
        .otherwise("pending")
    )
    terminal = s.isin("CANCELED", "COMPLETED", "SUBTITLE_GENERATED", "ALIGNED", "TRANSCRIBED", "FAILED") | (
        (s == "LYRICS_PROCESSED") & (g != "READING_REVIEW_SAVING")
    )
    phase = (
        F.when(s == "CANCELED", "canceled").when(s == "COMPLETED", "finished")
        .when((s == "SUBTITLE_GENERATED") & (F.col("input_mode") == "AUDIO_ONLY"), "subtitle ready, video local")
        .when(s == "SUBTITLE_GENERATED", "subtitle ready").when(s == "ALIGNED", "timeline ready")
        .when((s == "LYRICS_PROCESSED") & (g == "READING_REVIEW_SAVING"), "saving readings")
        .when((s == "LYRICS_PROCESSED") & (g == "READING_REVIEW_REQUIRED"), "readings to confirm")
        .when(s == "LYRICS_PROCESSED", "lyrics ready").when(s == "TRANSCRIBED", "transcribed")
        .when(s == "FAILED", F.concat(F.lit("failed: "), F.lower(g)))
        .when(g == "CLOUD_RENDER_QUEUED", "cloud render queued")
        .when(g.isin(*active), F.lower(g)).otherwise("queued")
    )
    return jobs.withColumns({"tone": tone, "terminal": F.coalesce(terminal, F.lit(False)), "phase": phase})


def parse_details(events: DataFrame, *fields: str) -> DataFrame:
    """Replaces details by JSON text that is never null ('{}'), and adds the named fields as text."""
    details = F.coalesce(F.col("details"), F.lit("{}"))
    wanted = T.StructType([T.StructField(f, T.StringType()) for f in fields])
    parsed = F.from_json(details, wanted) if fields else None
    return events.withColumn("details", details).withColumns({f: parsed[f] for f in fields} if fields else {})


def duration_label(ms: Column) -> Column:
    """Under 1000: whole milliseconds; else seconds with two decimals; null has none."""
    return F.when(ms < 1000, F.concat(F.floor(ms + 0.5).cast("string"), F.lit(" ms"))).when(
        ms.isNotNull(), F.concat(F.format_string("%.2f", (F.floor(ms / 10 + 0.5) / 100).cast("double")), F.lit(" s"))
    )


def job_timeline(events: DataFrame, tickets: DataFrame, jobs: DataFrame | None = None, run_id=None) -> DataFrame:
    """Adds job_id: every event of a job or of one of its upload tickets, once per job. `jobs` (id) narrows
    the jobs. Events without reference are left out before anything is shuffled."""
    known = events.where("reference_id is not null")
    if run_id is not None:
        known = known.where(F.col("run_id") == run_id)
    owner = tickets.where("job_id is not null").select(F.col("id").alias("reference_id"), "job_id")
    direct = known.withColumn("job_id", F.col("reference_id"))
    if jobs is not None:
        ids = jobs.select(F.col("id").alias("job_id")).distinct()
        direct, owner = direct.join(ids, "job_id", "left_semi"), owner.join(ids, "job_id", "left_semi")
    through = known.join(owner.where("reference_id <> job_id").distinct(), "reference_id")
    return direct.unionByName(through)


def run_ids(events: DataFrame) -> DataFrame:
    """Runs of each reference with their first event's id, and the run's place in that order from 0."""
    first = events.where("run_id is not null").groupBy("reference_id", "run_id").agg(F.min("id").alias("first_id"))
    place = F.row_number().over(W.partitionBy("reference_id").orderBy("first_id", "run_id")) - 1
    return first.withColumn("place", place.cast("long"))


def rows_before(counts: DataFrame) -> DataFrame:
    """Of counts (day, bucket, n), the rows of all earlier buckets: (bucket, before, total). Buckets add up
    inside their day; the one window without a partition runs over a row a day."""
    inside = F.sum("n").over(W.partitionBy("day").orderBy("bucket")) - F.col("n")
    days = counts.groupBy("day").agg(F.sum("n").alias("m"))
    days = days.select("day", (F.sum("m").over(W.orderBy("day")) - F.col("m")).alias("earlier"), F.sum("m").over(W.partitionBy(F.lit(0))).alias("total"))
    return counts.select("day", "bucket", inside.alias("inside")).join(days, "day").select("bucket", (F.col("inside") + F.col("earlier")).alias("before"), "total")


def retain_events(events: DataFrame, older_than, max_rows: int, bucket_ms: int = 60_000) -> DataFrame:
    """Drops what is older, then keeps the newest max_rows by (created_at, id). Counts by time find the bucket
    in which the limit falls; newer buckets stay as they are, and rows are ranked in that one only."""
    bucket = F.floor(F.col("created_at") / bucket_ms)
    rows = events.where(F.col("created_at") >= older_than)
    counts = rows.groupBy((-bucket).alias("bucket")).agg(F.count(F.lit(1)).alias("n")).withColumn("day", F.floor(F.col("bucket") * bucket_ms / DAY_MS))
    last = F.broadcast(rows_before(counts).where(F.col("before") < max_rows).agg((-F.max("bucket")).alias("__cut"), F.max("before").alias("__before")))  # one row
    near = rows.crossJoin(last).where(bucket >= F.col("__cut"))
    place = F.row_number().over(W.orderBy(F.desc("created_at"), F.desc("id")))  # of one bucket
    some = near.where(bucket == F.col("__cut")).withColumn("__place", place).where(F.col("__place") <= F.lit(max_rows) - F.col("__before"))
    return near.where(bucket > F.col("__cut")).select(*events.columns).unionByName(some.select(*events.columns))


THROTTLE_KEY = ("event", "reference_id", "run_id", "stage", "component")


#: Chunks of time, as multiples of the least distance, in which a key's events are walked on their own.
CHUNK = 64


def _groups(batches: Iterator[pa.RecordBatch], of: int) -> Iterator[tuple[tuple, dict[str, np.ndarray]]]:
    """The runs of rows that agree in their first `of` columns, and their other columns, which are numbers."""
    key, held = None, []
    for rows in batches:
        if not rows.num_rows:
            continue
        new = np.zeros(rows.num_rows - 1, bool)
        for c in rows.columns[:of]:
            new |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        edge = [0, *(np.nonzero(new)[0] + 1).tolist(), rows.num_rows]
        for x, z in zip(edge, edge[1:]):
            mine = tuple(c[x].as_py() for c in rows.columns[:of])
            if key is not None and mine != key:
                yield key, {n: np.concatenate([h[n] for h in held]) for n in held[0]}
                held = []
            key = mine
            held.append({n: rows.column(n)[x:z].to_numpy() for n in rows.schema.names[of:]})
    if held:
        yield key, {n: np.concatenate([h[n] for h in held]) for n in held[0]}


def throttle_progress(events: DataFrame, every_ms: int, key: tuple[str, ...] = THROTTLE_KEY) -> DataFrame:
    """Of each key's events, those at least every_ms after the last one kept; the first is kept.

    A key's time is cut into chunks, and a chunk's events are walked without those before it: an event kept before
    leaves only the events of the chunk's first every_ms, and the first one after them, as the chunk's first kept
    one, and for each of these entries the last one kept in the chunk is found. Only entries meet by key, to tell
    which one each chunk begins with; then the chunks are walked, side by side."""
    if every_ms <= 0:
        return events
    columns, width = events.columns, CHUNK * every_ms

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (name, chunk), c in _groups(batches, 2):
            at = np.unique(c["at"])
            n = int(np.searchsorted(at, chunk * width + every_ms)) + 1
            then = np.searchsorted(at, at + every_ms)
            last = np.where(then < len(at), then, np.arange(len(at)))
            while (last[last] != last).any():
                last = last[last]
            enter, leave = at[:n], at[last[:n]]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(enter)), pa.array(np.full(len(enter), chunk)), pa.array(enter), pa.array(leave)], ["name", "chunk", "enter", "leave"])

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last = None, 0
        for (name, chunk), c in _groups(batches, 2):
            k = int(np.searchsorted(c["enter"], last + every_ms)) if name == at else 0
            if k < len(c["enter"]):
                at, last = name, int(c["leave"][k])
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([chunk]), pa.array([int(c["enter"][k])])], ["__key", "__chunk", "__at"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, free = None, None  # free: the time from which on the next one is kept; none where nothing is
        for rows in batches:
            if not rows.num_rows:
                continue
            name, chunk, time, event = (rows.column(c) for c in ("__key", "__chunk", "__at", "__event"))
            time, event = time.to_numpy(), event.to_numpy(zero_copy_only=False)
            keep = np.zeros(len(time), bool)
            new = (pc.not_equal(name[1:], name[:-1]).to_numpy(zero_copy_only=False)) | (pc.not_equal(chunk[1:], chunk[:-1]).to_numpy(zero_copy_only=False))
            edge = [0, *(np.nonzero(new)[0] + 1).tolist(), len(time)]
            for a, z in zip(edge, edge[1:]):
                mine = name[a].as_py(), chunk[a].as_py()
                if mine != at:
                    at, free = mine, None
                if not event[a]:  # where the chunk begins, ahead of its events
                    free, a = int(time[a]), a + 1
                k = a + int(np.searchsorted(time[a:z], free)) if free is not None else z
                while k < z:
                    keep[k], free = True, int(time[k]) + every_ms
                    k += max(1, int(np.searchsorted(time[k:z], free)))
            yield rows.filter(pa.array(keep)).select(columns)

    # a key as text, with nulls told from empty texts
    text = F.to_json(F.struct(*key), {"ignoreNullFields": "false"})
    ms = F.unix_millis("created_at") if isinstance(events.schema["created_at"].dataType, T.TimestampType) else F.col("created_at").cast("long")
    rows = events.withColumns({"__key": text, "__at": ms, "__event": F.lit(True)}).withColumn("__chunk", F.expr(f"floor(__at / {width}D)").cast("long"))
    times = rows.where("__at is not null").select(F.col("__key").alias("name"), F.col("__chunk").alias("chunk"), F.col("__at").alias("at"))
    entries = times.repartition("name", "chunk").sortWithinPartitions("name", "chunk", "at").mapInArrow(ends, "name string, chunk bigint, enter bigint, leave bigint")
    starts = entries.repartition("name").sortWithinPartitions("name", "chunk", "enter").mapInArrow(begin, "__key string, __chunk bigint, __at bigint")
    both = rows.where("__at is not null").unionByName(starts.withColumn("__event", F.lit(False)), allowMissingColumns=True)
    order = ["__key", "__chunk", "__event", "__at", "id"]
    return both.repartition("__key", "__chunk").sortWithinPartitions(*order).mapInArrow(walk, events.schema)


def stage_traces(events: DataFrame) -> DataFrame:
    """Pairs each stage.started with the next event of its (reference, run, stage, component) that ends it.
    Rows: the key, started_at, ended_at, outcome (completed, failed or open) and duration_ms."""
    key = ["reference_id", "run_id", "stage", "component"]
    marks = events.where(F.col("event").isin("stage.started", "stage.completed", "stage.failed"))
    w = W.partitionBy(*key).orderBy("created_at", "id")
    nxt = marks.withColumns({"next_event": F.lead("event").over(w), "next_at": F.lead("created_at").over(w)})
    ends = F.col("next_event").isin("stage.completed", "stage.failed")
    return nxt.where("event = 'stage.started'").select(
        *key, F.col("id").alias("start_id"), F.col("created_at").alias("started_at"),
        F.when(ends, F.col("next_at")).alias("ended_at"),
        F.when(ends, F.regexp_replace("next_event", "^stage\\.", "")).otherwise("open").alias("outcome"),
        F.when(ends, F.col("next_at") - F.col("created_at")).alias("elapsed_ms"),
    )


def run_timings(events: DataFrame, queued: str = "job.queued", assigned: str = "worker.assigned", ended: tuple[str, ...] = ("worker.released", "worker.failed")) -> DataFrame:
    """Per reference, each assignment with the wait since the last queueing and the time until it ended."""
    w = W.partitionBy("reference_id").orderBy("created_at", "id")
    marks = events.where(F.col("event").isin(queued, assigned, *ended)).withColumns(
        {
            "queued_at": F.last(F.when(F.col("event") == queued, F.col("created_at")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)),
            "next_event": F.lead("event").over(w),
            "next_at": F.lead("created_at").over(w),
        }
    )
    over = F.col("next_event").isin(*ended)
    return marks.where(F.col("event") == assigned).select(
        "reference_id", F.col("id").alias("assigned_id"), (F.col("created_at") - F.col("queued_at")).alias("wait_ms"),
        F.when(over, F.col("next_at") - F.col("created_at")).alias("run_ms"),
    )


def job_states(events: DataFrame) -> DataFrame:
    """The state of each job after its changes (reference_id, status, requeue boolean, created_at, id) in
    order: a canceled job takes no later change until it is requeued. Changes from one requeue to the next
    are a section; it ends with its first CANCELED."""
    w = W.partitionBy("reference_id").orderBy("created_at", "id")
    rows = events.withColumns({"__k": F.row_number().over(w), "__s": F.sum(F.col("requeue").cast("long")).over(w)})
    sections = rows.groupBy("reference_id", "__s").agg(
        F.max_by("status", "__k").alias("last"), F.min(F.when(F.col("status") == "CANCELED", F.col("__k"))).alias("hit"), F.min("__k").alias("lo"), F.count(F.lit(1)).alias("n")
    )
    status, taken = F.when(F.col("hit").isNull(), F.col("last")).otherwise("CANCELED"), F.when(F.col("hit").isNull(), F.col("n")).otherwise(F.col("hit") - F.col("lo") + 1)
    return sections.groupBy("reference_id").agg(F.max_by(status, "__s").alias("status"), F.sum(taken).cast("long").alias("applied"))
