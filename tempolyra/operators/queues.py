"""Job and upload-queue operators: positions, admission, expiry, commands, chunks, validation."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from ipaddress import ip_network

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.shared import small_batches
from .events import DAY_MS, retain_events, rows_before

# fixed values: statuses
TERMINAL = ("COMPLETED", "FAILED", "CANCELED", "TRANSCRIBED", "LYRICS_PROCESSED", "ALIGNED", "SUBTITLE_GENERATED")
ACTIVE_JOB = ("UPLOADED", "PROCESSING")
ACTIVE_TICKET = ("WAITING", "READY", "UPLOADING")
# fixed values: command, table, statuses it may start from, stage it may start from, new status, new stage, new progress
COMMANDS = [
    ("cancel", "job", ("UPLOADED", "PROCESSING"), None, "CANCELED", "CANCELED_BY_USER", None),
    ("requeue", "job", ("FAILED", "CANCELED"), None, "UPLOADED", "REQUEUED_BY_ADMIN", 0),
    ("retry", "job", ("FAILED",), None, "UPLOADED", "REQUEUED_BY_USER", 0),
    ("claim_review", "job", ("LYRICS_PROCESSED",), "READING_REVIEW_REQUIRED", "LYRICS_PROCESSED", "READING_REVIEW_SAVING", 80),
    ("queue_alignment", "job", ("LYRICS_PROCESSED",), "READING_REVIEW_SAVING", "UPLOADED", "ALIGNMENT_QUEUED", 80),
    ("cloud_render", "job", ("ALIGNED", "SUBTITLE_GENERATED", "COMPLETED"), None, "UPLOADED", "CLOUD_RENDER_QUEUED", 10),
    ("begin", "ticket", ("READY",), None, "UPLOADING", None, None),
    ("complete", "ticket", ("UPLOADING",), None, "COMPLETED", None, None),
    ("cancel", "ticket", ("WAITING", "READY", "UPLOADING"), None, "CANCELED", None, None),
]
#: Largest media for local processing, least cores, least memory, and room that the models need.
LOCAL_MEDIA_BYTES, LOCAL_CORES, LOCAL_GB = 300 * 1024 * 1024, 6, 6


def status_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def active_work(jobs: DataFrame, tickets: DataFrame) -> DataFrame:
    """Active jobs and tickets as one list: kind, id, client_key, status."""
    of = lambda df, kind, statuses: df.where(F.col("status").isin(*statuses)).select(F.lit(kind).alias("kind"), "id", "client_key", "status")
    return of(jobs, "job", ACTIVE_JOB).unionByName(of(tickets, "ticket", ACTIVE_TICKET))


def active_by_client(jobs: DataFrame, tickets: DataFrame) -> DataFrame:
    """Active jobs and tickets per client."""
    return active_work(jobs, tickets).groupBy("client_key").agg(
        F.count_if(F.col("kind") == "job").alias("jobs"), F.count_if(F.col("kind") == "ticket").alias("tickets")
    )


def queue_positions(rows: DataFrame, waiting: str, bucket_ms: int = 60_000) -> DataFrame:
    """Adds position (from 1, by created_at and id) and queue_size to rows in the waiting status; null for
    others. No window runs over the whole queue: rows are ranked inside a bucket of time, and what stands
    before a bucket comes from the buckets' counts."""
    queue = rows.where(F.col("status") == waiting).select(F.col("id").alias("__id"), F.col("created_at").alias("__at"), F.floor(F.col("created_at") / bucket_ms).alias("bucket"))
    counts = queue.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("day", F.floor(F.col("bucket") * bucket_ms / DAY_MS))
    place = F.row_number().over(W.partitionBy("bucket").orderBy("__at", "__id"))
    ranked = queue.withColumn("__place", place).join(rows_before(counts), "bucket").select(
        "__id", (F.col("before") + F.col("__place")).cast("long").alias("position"), F.col("total").alias("queue_size")
    )
    return rows.join(ranked, F.col("id") == F.col("__id"), "left").drop("__id")


def activate_tickets(tickets: DataFrame, slots: int) -> DataFrame:
    """The oldest WAITING tickets that free slots let in, with their new status: slots less the READY and
    UPLOADING ones."""
    busy = tickets.where(F.col("status").isin("READY", "UPLOADING")).agg(F.count(F.lit(1)).alias("__busy"))
    ranked = queue_positions(tickets.where("status = 'WAITING'"), "WAITING").crossJoin(F.broadcast(busy))  # one row
    return ranked.where(F.col("position") <= F.lit(slots) - F.col("__busy")).select(*tickets.columns).withColumn("status", F.lit("READY"))


def queue_health(jobs: DataFrame, tickets: DataFrame, heartbeats: DataFrame, now, most_age_ms: int) -> DataFrame:
    """One row: waiting uploads, waiting jobs, and ok or degraded by the last heartbeat's age."""
    a = tickets.agg(F.count_if(F.col("status") == "WAITING").alias("waiting_uploads"))
    b = jobs.agg(F.count_if(F.col("status") == "UPLOADED").alias("waiting_jobs"))
    c = heartbeats.agg(F.max("at").alias("last"))
    fresh = F.coalesce(F.lit(now) - F.col("last") <= most_age_ms, F.lit(False))
    return a.crossJoin(b).crossJoin(c).select("waiting_uploads", "waiting_jobs", F.when(fresh, "ok").otherwise("degraded").alias("health"))


def liveness(heartbeats: DataFrame, now, interval_ms: int) -> DataFrame:
    """Per worker, alive while its last heartbeat is no older than the greater of 5 s and three intervals."""
    return heartbeats.groupBy("worker").agg(F.max("at").alias("last")).withColumn("alive", F.lit(now) - F.col("last") <= max(5000, 3 * interval_ms))


def expired_jobs(jobs: DataFrame, cutoff) -> DataFrame:
    """Terminal jobs last updated before the cutoff, oldest first."""
    return jobs.where(F.col("status").isin(*TERMINAL) & (F.col("updated_at") < cutoff)).orderBy("updated_at", "id")


def stale_tickets(tickets: DataFrame, waiting_cutoff, uploading_cutoff) -> DataFrame:
    """WAITING and READY tickets not seen, and UPLOADING ones not updated, since their cutoffs."""
    quiet = F.col("status").isin("WAITING", "READY") & (F.col("last_seen_at") < waiting_cutoff)
    return tickets.where(quiet | ((F.col("status") == "UPLOADING") & (F.col("updated_at") < uploading_cutoff)))


def monitored_jobs(jobs: DataFrame, now, limit: int) -> DataFrame:
    """Active and failed jobs, running ones first, then queued, then the rest, oldest first, with
    stage_age_seconds, never negative."""
    order = F.when(F.col("status") == "PROCESSING", 0).when(F.col("status") == "UPLOADED", 1).otherwise(2)
    age = F.greatest(F.lit(0), F.floor((F.lit(now) - F.col("updated_at")) / 1000)).cast("long")
    return jobs.where(F.col("status").isin(*ACTIVE_JOB, "FAILED")).withColumn("stage_age_seconds", age).orderBy(order, "created_at", "id").limit(limit)


def active_tickets(tickets: DataFrame, n: int = 200) -> DataFrame:
    return tickets.where(F.col("status").isin(*ACTIVE_TICKET)).orderBy("created_at", "id").limit(n)


def fifo(jobs: DataFrame, status: str) -> DataFrame:
    return jobs.where(F.col("status") == status).orderBy("created_at", "id")


def audit_tail(audits: DataFrame, n: int) -> DataFrame:
    return audits.orderBy(F.desc("id")).limit(n)


def overview(jobs: DataFrame, tickets: DataFrame, audits: DataFrame, now, limit: int = 50) -> dict[str, DataFrame]:
    """The tables of an overview page."""
    return {
        "job_counts": status_counts(jobs), "ticket_counts": status_counts(tickets),
        "tickets": active_tickets(queue_positions(tickets, "WAITING")), "jobs": monitored_jobs(jobs, now, limit), "audits": audit_tail(audits, limit),
    }


def admit(requests: DataFrame, jobs: DataFrame, tickets: DataFrame, limit: int) -> DataFrame:
    """Adds admitted: a client's requests, in order of (created_at, id), get in while its active jobs and
    tickets and the requests before them stay under the limit."""
    busy = active_work(jobs, tickets).groupBy("client_key").agg(F.count(F.lit(1)).alias("__busy"))
    place = F.row_number().over(W.partitionBy("client_key").orderBy("created_at", "id"))
    return requests.withColumn("__place", place).join(busy, "client_key", "left").withColumn("admitted", F.coalesce("__busy", F.lit(0)) + F.col("__place") <= limit).drop("__busy", "__place")


def new_submissions(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """Requests whose client_submission_id made no job yet, the first of each id; requests without one all stay."""
    anonymous = requests.where("client_submission_id is null")
    first = F.row_number().over(W.partitionBy("client_submission_id").orderBy("created_at", "id"))
    fresh = requests.where("client_submission_id is not null").join(jobs.where("client_submission_id is not null").select("client_submission_id").distinct(), "client_submission_id", "left_anti")
    return anonymous.unionByName(fresh.withColumn("__k", first).where("__k = 1").drop("__k"))


def apply_commands(rows: DataFrame, commands: DataFrame, kind: str = "job", now=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Applies one command (id, command) to each row that allows it. Returns the rows after it, and the
    commands applied and rejected, the latter with a reason. Of several commands for a row, the first by
    (seq) counts where that column is there; created_at is kept, so a requeued job regains its place."""
    spark = rows.sparkSession
    rules = [(c, f, stage, s, g, p) for c, k, froms, stage, s, g, p in COMMANDS if k == kind for f in froms]
    rule = F.broadcast(spark.createDataFrame(rules, "command string, from_status string, from_stage string, new_status string, new_stage string, new_progress int"))  # a few rows
    order = "seq" if "seq" in commands.columns else "command"
    one = commands.withColumn("__k", F.row_number().over(W.partitionBy("id").orderBy(order))).where("__k = 1").drop("__k")
    at = rows.select(F.col("id").alias("id"), F.col("status").alias("at_status"), *([F.col("stage").alias("at_stage")] if "stage" in rows.columns else [F.lit(None).cast("string").alias("at_stage")]), *([F.col("input_mode").alias("at_mode")] if "input_mode" in rows.columns else [F.lit("AUDIO_ONLY").alias("at_mode")]))
    met = one.join(at, "id", "left").join(rule.withColumnRenamed("command", "__c"), (F.col("command") == F.col("__c")) & (F.col("at_status") == F.col("from_status")), "left")
    ok = F.col("new_status").isNotNull() & (F.col("from_stage").isNull() | (F.col("from_stage") == F.col("at_stage"))) & ((F.col("command") != "cloud_render") | (F.col("at_mode") == "AUDIO_ONLY"))
    judged = met.withColumn("__ok", F.coalesce(ok, F.lit(False)))
    applied = judged.where("__ok").select("id", "command", "new_status", "new_stage", "new_progress")
    rejected = judged.where("not __ok").select("id", "command", F.when(F.col("at_status").isNull(), "unknown id").otherwise(F.concat(F.lit("not allowed from "), F.col("at_status"))).alias("reason"))
    changed = rows.join(applied.withColumnRenamed("id", "__id"), F.col("id") == F.col("__id"), "left")
    new = {"status": F.coalesce("new_status", "status")}
    if "stage" in rows.columns:
        new["stage"] = F.coalesce("new_stage", "stage")
    if "progress" in rows.columns:
        new["progress"] = F.coalesce("new_progress", "progress")
    if now is not None and "updated_at" in rows.columns:
        new["updated_at"] = F.when(F.col("new_status").isNotNull(), F.lit(now)).otherwise(F.col("updated_at"))
    return changed.withColumns(new).select(*rows.columns), applied, rejected


def recover_interrupted(jobs: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """After a restart: saved-reading claims go back to review, running jobs fail. Returns the jobs and one
    event for each changed row."""
    saving = (F.col("status") == "LYRICS_PROCESSED") & (F.col("stage") == "READING_REVIEW_SAVING")
    running = F.col("status") == "PROCESSING"
    after = jobs.withColumns({
        "status": F.when(running, "FAILED").otherwise(F.col("status")),
        "stage": F.when(saving, "READING_REVIEW_REQUIRED").otherwise(F.col("stage")),
        "updated_at": F.when(saving | running, F.lit(now)).otherwise(F.col("updated_at")),
    })
    events = jobs.where(saving | running).select(F.col("id").alias("reference_id"), F.when(running, "job.recovered_failed").otherwise("job.review_restored").alias("event"), F.lit("WARNING").alias("level"), F.lit(now).alias("created_at"))
    return after, events


def chunk_plan(sessions: DataFrame) -> DataFrame:
    """Rows (ticket_id, chunk_index, expected_bytes): size / chunk rounded up; the last takes the rest."""
    n = F.ceil(F.col("size_bytes") / F.col("chunk_bytes"))
    return sessions.where("size_bytes > 0 and chunk_bytes > 0").select("ticket_id", "size_bytes", "chunk_bytes", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("chunk_index")).select(
        "ticket_id", "chunk_index", F.least(F.col("chunk_bytes"), F.col("size_bytes") - F.col("chunk_index") * F.col("chunk_bytes")).alias("expected_bytes")
    )


def received_chunks(sessions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunk numbers of the plan that arrived, each once."""
    return chunk_plan(sessions).join(chunks.select("ticket_id", "chunk_index").distinct(), ["ticket_id", "chunk_index"], "left_semi").select("ticket_id", "chunk_index")


def missing_chunks(sessions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunk numbers of the plan that did not."""
    return chunk_plan(sessions).join(chunks.select("ticket_id", "chunk_index"), ["ticket_id", "chunk_index"], "left_anti").select("ticket_id", "chunk_index")


def stale_sessions(files: DataFrame, cutoff) -> DataFrame:
    """Sessions whose last file is older than the cutoff."""
    return files.groupBy("ticket_id").agg(F.max("mtime").alias("last_activity")).where(F.col("last_activity") < cutoff)


def content_digests(chunks: DataFrame) -> DataFrame:
    """Rows (ticket_id, sha256): the digest of a session's chunks (ticket_id, chunk_index, size_bytes, content) one
    after the other. Of several rows of a chunk the largest counts, then the one whose content sorts first; rows
    without content add nothing, rows without a number come last as one chunk. A session is read in order by one
    task, since the digest is a fold, but only a batch of it is held; sessions share their task with others."""
    small_batches(chunks.sparkSession)
    kind = chunks.schema["ticket_id"].dataType.simpleString()
    placed = chunks.select("ticket_id", "chunk_index", "size_bytes", "content").repartition("ticket_id").sortWithinPartitions(
        "ticket_id", F.col("chunk_index").asc_nulls_last(), F.desc_nulls_last("size_bytes"), F.col("content").asc_nulls_last())

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ticket = chunk = object()
        digest = None
        for batch in batches:
            done: list[tuple] = []
            for t, c, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if t != ticket:
                    if digest is not None:
                        done.append((ticket, digest.hexdigest()))
                    ticket, chunk, digest = t, object(), hashlib.sha256()
                if c != chunk:
                    chunk = c
                    if x.is_valid:
                        digest.update(x.as_buffer())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], batch.schema.field(0).type), pa.array([d[1] for d in done], pa.string())], ["ticket_id", "sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([ticket], batch.schema.field(0).type), pa.array([digest.hexdigest()], pa.string())], ["ticket_id", "sha256"])

    return placed.select("ticket_id", "chunk_index", F.col("content").cast("binary").alias("content")).mapInArrow(fold, f"ticket_id {kind}, sha256 string")


def assemble_sessions(sessions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per session: chunks, total_bytes, complete (every chunk of the planned size, once, and nothing else)
    and, where chunks have content, sha256 of their content in order (see content_digests); a session that got
    none has the digest of nothing."""
    seen = chunks.groupBy("ticket_id", "chunk_index").agg(F.max("size_bytes").alias("size_bytes"))
    both = chunk_plan(sessions).join(seen, ["ticket_id", "chunk_index"], "full_outer")
    out = both.groupBy("ticket_id").agg(
        F.count("size_bytes").alias("chunks"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"), F.bool_and(F.coalesce(F.col("size_bytes") == F.col("expected_bytes"), F.lit(False))).alias("complete")
    )
    if "content" not in chunks.columns:
        return out
    made = content_digests(chunks).withColumnRenamed("ticket_id", "__ticket")
    return out.join(made, F.col("ticket_id").eqNullSafe(F.col("__ticket")), "left").withColumn("sha256", F.coalesce("sha256", F.sha2(F.lit(""), 256))).drop("__ticket")


def select_route(snapshots: DataFrame, model_bytes: int) -> DataFrame:
    """Adds route: LOCAL, AUDIO_ONLY or REMOTE_VIDEO for a media size on a device."""
    size = F.col("video_size_bytes")
    flags = [F.coalesce(F.col(c), F.lit(False)) for c in ("web_assembly", "web_gpu", "audio_extraction", "cache_storage", "cross_origin_isolated", "models_cached")]
    able = flags[0]
    for f in flags[1:]:
        able = able & f
    able = able & (F.col("cores") >= LOCAL_CORES) & (F.coalesce("memory_gb", F.lit(0)) >= LOCAL_GB) & F.coalesce(F.col("storage_bytes") >= size * 2 + model_bytes, F.lit(False))
    return snapshots.withColumn(
        "route",
        F.when((size <= 0) | (size > LOCAL_MEDIA_BYTES), "REMOTE_VIDEO").when(able, "LOCAL")
        .when(F.coalesce("audio_extraction", F.lit(False)), "AUDIO_ONLY").otherwise("REMOTE_VIDEO"),
    )


def validate_submissions(requests: DataFrame, max_bytes: int, max_chunk: int, suffixes: tuple[str, ...] = (".mp4",), audio: tuple[str, ...] = (".wav", ".mp3", ".m4a", ".aac", ".flac", ".ogg", ".mp4")) -> DataFrame:
    """Adds reason, the first check that fails, or null."""
    suffix = F.lower(F.regexp_extract("file_name", r"(\.[^./]+)$", 1))
    kind = F.when(F.col("input_mode") == "AUDIO_ONLY", suffix.isin(*audio)).otherwise(suffix.isin(*suffixes))
    chunks = F.ceil(F.col("size_bytes") / F.col("chunk_bytes"))
    return requests.withColumn(
        "reason",
        F.when(~F.coalesce(kind, F.lit(False)), "unsupported file type").when(F.coalesce(F.col("size_bytes") <= 0, F.lit(True)), "empty file")
        .when(F.col("size_bytes") > max_bytes, "file too large").when(F.col("lyrics_file") & F.col("lyrics_text"), "lyrics given twice")
        .when((F.col("chunk_bytes") <= 0) | (F.col("chunk_bytes") > max_chunk), "bad chunk size").when(F.col("total_chunks") != chunks, "bad chunk count"),
    )


def ipv4(text: Column) -> Column:
    """An IPv4 address as a number, or null."""
    p = F.split(F.trim(text), r"\.")
    ok = F.trim(text).rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])$")
    return F.when(ok, sum((F.get(p, F.lit(k)).try_cast("long") * F.lit(256 ** (3 - k)) for k in range(1, 4)), F.get(p, F.lit(0)).try_cast("long") * F.lit(256**3)))


def ipv6(text: Column) -> Column:
    """An IPv6 address as 32 hexadecimal digits, or null. Shortened forms and a last part in IPv4 form count; zones
    do not."""
    t = F.lower(F.trim(text))
    tail = F.regexp_extract(t, r"[^:]*$", 0)
    last = F.lpad(F.lower(F.hex(ipv4(tail))), 8, "0")
    t = F.when(tail.contains("."), F.concat(F.regexp_extract(t, "^.*:", 0), F.substring(last, 1, 4), F.lit(":"), F.substring(last, 5, 4))).otherwise(t)
    side = lambda k: F.array_remove(F.split(F.split_part(t, F.lit("::"), F.lit(k)), ":"), "")
    wide = lambda parts: F.array_join(F.transform(parts, lambda p: F.lpad(p, 4, "0")), "")
    part, short = "[0-9a-f]{1,4}", t.contains("::")
    n = F.size(side(1)) + F.when(short, F.size(side(2))).otherwise(0)
    whole = t.rlike(f"^{part}(:{part}){{7}}$")
    cut = t.rlike(f"^({part}(:{part})*)?::({part}(:{part})*)?$") & (n <= 7)
    return F.when(whole, wide(side(1))).when(cut, F.concat(wide(side(1)), F.repeat(F.lit("0000"), 8 - n), wide(side(2))))


def ipv6_text(digits: Column) -> Column:
    """The shortest form of 32 digits: no leading zeros, the first longest run of zero parts as ::, and the last
    part of mapped addresses in IPv4 form."""
    t = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.regexp_replace(F.substring(digits, k * 4 + 1, F.lit(4)), "^0{1,3}", "")), ":")
    out = t
    for k in range(2, 9):
        run = rf"^(?:(.*?):)??0(?::0){{{k - 1}}}(?::(.*))?$"
        out = F.when(t.rlike(run), F.regexp_replace(t, run, "$1::$2")).otherwise(out)
    byte = lambda k: F.conv(F.substring(digits, 25 + 2 * k, 2), 16, 10)
    mapped = F.concat(F.lit("::ffff:"), F.concat_ws(".", *[byte(k) for k in range(4)]))
    return F.when(digits.startswith("0" * 20 + "ffff"), mapped).when(digits.isNotNull(), out)


def trusted_address(text: Column, trusted: list[str]) -> Column:
    """Whether an address equals one of the trusted, in any spelling, or lies in one of the networks among them.
    Entries that are no network are compared as texts only."""
    hit = text.isin(*trusted)
    for net in trusted:
        try:
            network = ip_network(net, strict=False)
        except ValueError:
            continue
        low, high = int(network.network_address), int(network.broadcast_address)
        inside = ipv4(text).between(low, high) if network.version == 4 else ipv6(text).between(f"{low:032x}", f"{high:032x}")
        hit = hit | F.coalesce(inside, F.lit(False))
    return hit


def client_key(requests: DataFrame, trusted: list[str]) -> DataFrame:
    """Adds client_key: the peer, unless it is trusted; then the right-most address of forwarded_for that is
    not, IPv6 ones in their shortest form, and the peer if all are."""
    shown = lambda x: F.coalesce(F.when(ipv4(x).isNotNull(), F.trim(x)), ipv6_text(ipv6(x)))
    chain = F.filter(F.transform(F.split(F.coalesce("forwarded_for", F.lit("")), ","), shown), lambda x: x.isNotNull())
    foreign = F.filter(F.reverse(chain), lambda x: ~trusted_address(x, trusted))
    given = F.coalesce(F.length("forwarded_for") > 0, F.lit(False))
    return requests.withColumn("client_key", F.when(given & trusted_address(F.col("peer_host"), trusted), F.coalesce(F.get(foreign, F.lit(0)), F.col("peer_host"))).otherwise(F.col("peer_host")))


def normalise_ids(requests: DataFrame, default_name: str = "video") -> DataFrame:
    """Adds submission_ok (a UUID or null), request_ok (8 to 64 of letters, digits, . _ -) and display_name:
    the base name without control characters, at most 255 long."""
    base = F.regexp_replace(F.regexp_replace(F.coalesce("file_name", F.lit("")), r"^.*[/\\]", ""), r"[\x00-\x1f\x7f]", "")
    name = F.substring(F.trim(base), 1, 255)
    return requests.withColumns({
        "submission_ok": F.coalesce(F.col("client_submission_id").rlike("(?i)^[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}$"), F.lit(True)),
        "request_ok": F.coalesce(F.col("request_id").rlike(r"^[A-Za-z0-9._-]{8,64}$"), F.lit(False)),
        "display_name": F.when(name == "", default_name).otherwise(name),
    })


def sniff_media(files: DataFrame, content: str = "content", suffix: str = "suffix") -> DataFrame:
    """Adds media_ok: whether the leading bytes fit the suffix."""
    h = F.hex(F.substring(content, 1, 12))
    first, second = F.substring(h, 1, 2), F.conv(F.substring(h, 3, 2), 16, 10).cast("int")
    s = F.lower(F.col(suffix))
    mp4 = (F.length(content) >= 12) & (F.substring(h, 9, 8) == "66747970")
    sync = lambda bits: (F.length(content) >= 2) & (first == "FF") & (second.bitwiseAND(F.lit(bits)) == bits)
    return files.withColumn("media_ok", F.coalesce(
        F.when(s == ".wav", (F.length(content) >= 12) & h.startswith("52494646") & (F.substring(h, 17, 8) == "57415645"))
        .when(s == ".mp3", h.startswith("494433") | sync(0xE0)).when(s.isin(".m4a", ".mp4"), mp4).when(s == ".aac", sync(0xF0))
        .when(s == ".flac", h.startswith("664C6143")).when(s == ".ogg", h.startswith("4F676753")), F.lit(False)))


def housekeeping(jobs: DataFrame, tickets: DataFrame, events: DataFrame, now: int, waiting_ms: int, uploading_ms: int, slots: int, keep_ms: int, max_rows: int, job_ms: int) -> dict[str, DataFrame]:
    """Expires quiet tickets, lets in waiting ones, retains the log and lists old jobs; `changes` has one
    event for each changed row."""
    stale = stale_tickets(tickets, now - waiting_ms, now - uploading_ms)
    after = tickets.join(stale.select(F.col("id").alias("__id")), F.col("id") == F.col("__id"), "left").withColumn("status", F.when(F.col("__id").isNotNull(), "EXPIRED").otherwise(F.col("status"))).drop("__id")
    let_in = activate_tickets(after, slots)
    changes = stale.select(F.lit("upload.expired").alias("event"), F.col("id").alias("reference_id")).unionByName(let_in.select(F.lit("upload.activated").alias("event"), F.col("id").alias("reference_id")))
    return {"tickets": after, "activated": let_in, "changes": changes, "events": retain_events(events, now - keep_ms, max_rows), "expired_jobs": expired_jobs(jobs, now - job_ms)}
