"""Queries over the driver's tables for the event-log, queue and benchmark operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import benchmarks, events, queues
from .adapters import adapt, oracle
from .catalog import ORACLES, QUERIES

#: "Now" and other instants are parameters, never the clock (epoch milliseconds).
NOW = 1_000_000_000_000
LOG_NOW = 1_706_000_000_000


def add(name, fn, sql=None):
    QUERIES[name] = fn
    if sql:
        ORACLES[name] = sql


ENGINES = """r AS (SELECT song_id AS c, seq, reading, start_ms, end_ms FROM moras),
    cand AS (SELECT song_id AS c, 'a' AS engine, seq, reading, cand_start_ms, cand_end_ms FROM moras
             UNION ALL SELECT song_id, 'b', seq, CASE WHEN engine_no = 0 THEN reading + 1 ELSE reading END,
                              start_ms + 5, cand_end_ms FROM moras),
    pairs AS (SELECT c, engine, r.seq, abs(cand_start_ms - start_ms) AS es, abs(cand_end_ms - end_ms) AS ee,
                     r.reading = cand.reading AS same FROM r JOIN cand USING (c, seq)),
    ok AS (SELECT c, engine, bool_and(same) AS ok FROM pairs GROUP BY c, engine),
    errors AS (SELECT c, engine, unnest([es, ee]) AS e FROM pairs JOIN ok USING (c, engine) WHERE ok),
    case_rows AS (SELECT c, engine, avg(e) AS mae_ms, median(e) AS median_ms, max(e) AS max_ms, CAST(count(*) / 2 AS BIGINT) AS n_moras
              FROM errors GROUP BY c, engine)"""


def _benchmark(spark, d):
    m = adapt(spark, d, "moras").withColumnRenamed("song_id", "case")
    ref = m.select("case", "seq", "reading", "start_ms", "end_ms")
    a = m.select("case", F.lit("a").alias("engine"), "seq", "reading", F.col("cand_start_ms").alias("start_ms"), F.col("cand_end_ms").alias("end_ms"))
    b = m.select("case", F.lit("b").alias("engine"), "seq", F.when(F.col("engine_no") == 0, F.col("reading") + 1).otherwise(F.col("reading")).alias("reading"),
                 (F.col("start_ms") + 5).alias("start_ms"), F.col("cand_end_ms").alias("end_ms"))
    runs = m.select("case").distinct().select("case", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("engine"),
                                              (F.col("case") % 50 / 10).alias("elapsed_seconds"), (F.col("case") % 900).cast("double").alias("peak_rss_mb"))
    return benchmarks.compare(ref, a.unionByName(b), runs)


def _round(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


add("case_errors", lambda s, d: _round(_benchmark(s, d)[0].where("ok").select("case", "engine", "mae_ms", "median_ms", "max_ms", "n_moras"), "mae_ms", "median_ms"),
    oracle(ENGINES + """ SELECT c AS "case", engine, round(mae_ms, 6) AS mae_ms, round(median_ms, 6) AS median_ms, max_ms, n_moras FROM case_rows""", "moras"))
add("pair_moras", lambda s, d: _benchmark(s, d)[0].select("case", "engine", "ok"),
    oracle(ENGINES + """ SELECT c AS "case", engine, ok FROM ok""", "moras"))
add("engine_summary", lambda s, d: _round(_benchmark(s, d)[1], "failure_rate", "mean_mae_ms", "mean_median_ms", "mean_elapsed_seconds"),
    oracle(ENGINES + """ SELECT engine, count(*) AS cases, count(*) FILTER (ok) AS successes,
        round(count(*) FILTER (NOT ok) / count(*), 6) AS failure_rate, round(avg(mae_ms), 6) AS mean_mae_ms,
        round(avg(median_ms), 6) AS mean_median_ms, round(avg(CASE WHEN ok THEN c % 50 / 10 END), 6) AS mean_elapsed_seconds,
        max(CASE WHEN ok THEN CAST(c % 900 AS DOUBLE) END) AS peak_rss_mb
        FROM ok LEFT JOIN case_rows USING (c, engine) GROUP BY engine""", "moras"))

# events
add("search_events", lambda s, d: events.search_events(adapt(s, d, "event_logs"), query="stage.F", since=1_704_100_000_000, until=1_705_900_000_000, limit=50, offset=10, category="task")[0].select("id", "created_at", "event"),
    oracle("""SELECT id, created_at, event FROM event_logs WHERE category = 'task' AND created_at BETWEEN 1704100000000 AND 1705900000000
        AND (event ILIKE '%stage.F%' OR message ILIKE '%stage.F%' OR CAST(reference_id AS VARCHAR) ILIKE '%stage.F%' OR details ILIKE '%stage.F%')
        ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 10""", "event_logs"))
add("search_events_total", lambda s, d: events.search_events(adapt(s, d, "event_logs"), query="_K", level="ERROR")[1],
    oracle("""SELECT count(*) AS total FROM event_logs WHERE level = 'ERROR' AND (event ILIKE '%_K%' OR message ILIKE '%_K%'
        OR CAST(reference_id AS VARCHAR) ILIKE '%_K%' OR details ILIKE '%_K%')""", "event_logs"))
add("level_gate", lambda s, d: events.level_gate(adapt(s, d, "event_logs"), "warning").groupBy("level").agg(F.count(F.lit(1)).alias("n")),
    oracle("SELECT level, count(*) AS n FROM event_logs WHERE level IN ('WARNING', 'ERROR', 'CRITICAL') GROUP BY level", "event_logs"))
add("event_state", lambda s, d: events.event_state(adapt(s, d, "event_logs")).select("id", "state"),
    oracle("""SELECT id, CASE WHEN event LIKE '%failed%' OR level = 'ERROR' THEN 'failed' WHEN event LIKE '%fallback%' OR level = 'WARNING' THEN 'fallback'
        WHEN event LIKE '%skipped%' THEN 'skipped' WHEN event LIKE '%completed%' THEN 'completed' ELSE 'none' END AS state FROM event_logs""", "event_logs"))
add("failure_code", lambda s, d: events.failure_code(adapt(s, d, "jobs")).where("status = 'FAILED'").groupBy("error_code", "progress").agg(F.count(F.lit(1)).alias("n")),
    oracle("""SELECT CASE stage WHEN 'REMOVING_VOCALS' THEN 'VOCAL_REMOVAL_FAILED' WHEN 'EXTRACTING_AUDIO' THEN 'AUDIO_EXTRACTION_FAILED'
        WHEN 'TRANSCRIBING' THEN 'TRANSCRIPTION_FAILED' WHEN 'PROCESSING_LYRICS' THEN 'LYRIC_PROCESSING_FAILED' WHEN 'ALIGNING' THEN 'ALIGNMENT_FAILED'
        WHEN 'GENERATING_SUBTITLE' THEN 'SUBTITLE_GENERATION_FAILED' ELSE 'VIDEO_RENDERING_FAILED' END AS error_code,
        CASE stage WHEN 'REMOVING_VOCALS' THEN 25 WHEN 'EXTRACTING_AUDIO' THEN 15 WHEN 'TRANSCRIBING' THEN 40 WHEN 'PROCESSING_LYRICS' THEN 75
        WHEN 'ALIGNING' THEN 90 WHEN 'GENERATING_SUBTITLE' THEN 95 ELSE 98 END AS progress, count(*) AS n
        FROM jobs WHERE status = 'FAILED' GROUP BY ALL""", "jobs"))
add("job_presentation", lambda s, d: events.job_presentation(adapt(s, d, "jobs")).groupBy("tone", "terminal", "phase").agg(F.count(F.lit(1)).alias("n")),
    oracle("""SELECT CASE status WHEN 'CANCELED' THEN 'canceled' WHEN 'COMPLETED' THEN 'success' WHEN 'LYRICS_PROCESSED' THEN 'success' WHEN 'FAILED' THEN 'error'
        ELSE 'active' END AS tone, status IN ('CANCELED', 'COMPLETED', 'LYRICS_PROCESSED', 'FAILED') AS terminal,
        CASE status WHEN 'CANCELED' THEN 'canceled' WHEN 'COMPLETED' THEN 'finished' WHEN 'LYRICS_PROCESSED' THEN 'lyrics ready'
        WHEN 'FAILED' THEN 'failed: ' || lower(stage) ELSE lower(stage) END AS phase, count(*) AS n FROM jobs GROUP BY ALL""", "jobs"))
add("parse_details", lambda s, d: events.parse_details(adapt(s, d, "event_logs"), "k").select("id", F.col("k").cast("long").alias("k")),
    oracle("SELECT id, CAST(json_extract_string(coalesce(details, '{}'), '$.k') AS BIGINT) AS k FROM event_logs", "event_logs"))
add("duration_label", lambda s, d: adapt(s, d, "event_logs").select("id", events.duration_label(F.col("duration_ms") * 40).alias("label")),
    oracle("""SELECT id, CASE WHEN duration_ms * 40 < 1000 THEN CAST(CAST(floor(duration_ms * 40 + 0.5) AS BIGINT) AS VARCHAR) || ' ms'
        ELSE printf('%.2f', floor(duration_ms * 40 / 10 + 0.5) / 100) || ' s' END AS label FROM event_logs""", "event_logs"))
add("job_timeline", lambda s, d: events.job_timeline(adapt(s, d, "event_logs"), adapt(s, d, "upload_tickets")).select("job_id", "id", "created_at"),
    oracle("""SELECT reference_id AS job_id, id, created_at FROM event_logs WHERE reference_id IS NOT NULL
        UNION ALL SELECT t.job_id, e.id, e.created_at FROM event_logs e JOIN upload_tickets t ON e.reference_id = t.id AND t.job_id <> t.id""", "event_logs", "upload_tickets"))
add("run_ids", lambda s, d: events.run_ids(adapt(s, d, "event_logs")),
    oracle("""SELECT reference_id, run_id, first_id, row_number() OVER (PARTITION BY reference_id ORDER BY first_id, run_id) - 1 AS place
        FROM (SELECT reference_id, run_id, min(id) AS first_id FROM event_logs GROUP BY ALL)""", "event_logs"))
add("retain_events", lambda s, d: events.retain_events(adapt(s, d, "event_logs"), 1_704_500_000_000, 3000).select("id"),
    oracle("SELECT id FROM event_logs WHERE created_at >= 1704500000000 ORDER BY created_at DESC, id DESC LIMIT 3000", "event_logs"))
add("throttle_progress", lambda s, d: events.throttle_progress(adapt(s, d, "event_logs").where("event = 'stage.progress'"), 86_400_000, ("event", "reference_id")).select("id"),
    "WITH RECURSIVE " + oracle("""p AS (SELECT reference_id, id, created_at, row_number() OVER (PARTITION BY reference_id ORDER BY created_at, id) AS k FROM event_logs WHERE event = 'stage.progress'),
        walk AS (SELECT reference_id, k, id, created_at AS last, true AS kept FROM p WHERE k = 1
                 UNION ALL SELECT p.reference_id, p.k, p.id, CASE WHEN p.created_at - last >= 86400000 THEN p.created_at ELSE last END,
                           p.created_at - last >= 86400000 FROM walk w JOIN p ON p.reference_id = w.reference_id AND p.k = w.k + 1)
        SELECT id FROM walk WHERE kept""", "event_logs")[5:])
add("stage_traces", lambda s, d: events.stage_traces(adapt(s, d, "event_logs")).select("start_id", "outcome", "elapsed_ms"),
    oracle("""m AS (SELECT id, event, created_at, lead(event) OVER w AS ne, lead(created_at) OVER w AS na FROM event_logs
              WHERE event IN ('stage.started', 'stage.completed', 'stage.failed') WINDOW w AS (PARTITION BY reference_id, run_id, stage, component ORDER BY created_at, id))
        SELECT id AS start_id, CASE ne WHEN 'stage.completed' THEN 'completed' WHEN 'stage.failed' THEN 'failed' ELSE 'open' END AS outcome,
               CASE WHEN ne IN ('stage.completed', 'stage.failed') THEN na - created_at END AS elapsed_ms FROM m WHERE event = 'stage.started'""", "event_logs"))
add("run_timings", lambda s, d: events.run_timings(adapt(s, d, "event_logs"), "stage.progress", "stage.started", ("stage.completed", "stage.failed")),
    oracle("""m AS (SELECT reference_id, id, event, created_at, lead(event) OVER w AS ne, lead(created_at) OVER w AS na,
              max(CASE WHEN event = 'stage.progress' THEN created_at END) OVER (PARTITION BY reference_id ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS q
              FROM event_logs WHERE event IN ('stage.progress', 'stage.started', 'stage.completed', 'stage.failed') WINDOW w AS (PARTITION BY reference_id ORDER BY created_at, id))
        SELECT reference_id, id AS assigned_id, created_at - q AS wait_ms, CASE WHEN ne IN ('stage.completed', 'stage.failed') THEN na - created_at END AS run_ms
        FROM m WHERE event = 'stage.started'""", "event_logs"))

# queues
add("status_counts", lambda s, d: queues.status_counts(adapt(s, d, "jobs")), oracle("SELECT status, count(*) AS n FROM jobs GROUP BY status", "jobs"))
ACTIVE = "w AS (SELECT 'job' AS kind, id, client_key, status FROM jobs WHERE status IN ('UPLOADED', 'PROCESSING') UNION ALL SELECT 'ticket', id, client_key, status FROM upload_tickets WHERE status IN ('WAITING', 'READY', 'UPLOADING'))"
add("active_work", lambda s, d: queues.active_work(adapt(s, d, "jobs"), adapt(s, d, "upload_tickets")), oracle(ACTIVE + " SELECT * FROM w", "jobs", "upload_tickets"))
add("active_by_client", lambda s, d: queues.active_by_client(adapt(s, d, "jobs"), adapt(s, d, "upload_tickets")),
    oracle(ACTIVE + " SELECT client_key, count(*) FILTER (kind = 'job') AS jobs, count(*) FILTER (kind = 'ticket') AS tickets FROM w GROUP BY client_key", "jobs", "upload_tickets"))
add("queue_positions", lambda s, d: queues.queue_positions(adapt(s, d, "jobs"), "UPLOADED").select("id", "position", "queue_size"),
    oracle("""SELECT id, CASE WHEN status = 'UPLOADED' THEN row_number() OVER (PARTITION BY status ORDER BY created_at, id) END AS position,
        CASE WHEN status = 'UPLOADED' THEN count(*) OVER (PARTITION BY status) END AS queue_size FROM jobs""", "jobs"))


def _activated(s, d, free=200):
    """As many slots as are taken, and `free` more."""
    tickets = adapt(s, d, "upload_tickets")
    return queues.activate_tickets(tickets, tickets.where("status IN ('READY', 'UPLOADING')").count() + free).select("id", "status")


add("activate_tickets", _activated,
    oracle("""b AS (SELECT count(*) AS busy, count(*) + 200 AS slots FROM upload_tickets WHERE status IN ('READY', 'UPLOADING')),
        k AS (SELECT id, row_number() OVER (ORDER BY created_at, id) AS place FROM upload_tickets WHERE status = 'WAITING')
        SELECT id, 'READY' AS status FROM k, b WHERE place <= slots - busy""", "upload_tickets"))
add("queue_health", lambda s, d: queues.queue_health(adapt(s, d, "jobs"), adapt(s, d, "upload_tickets"), adapt(s, d, "event_logs").select(F.col("created_at").alias("at")), LOG_NOW, 10**12),
    oracle("""SELECT (SELECT count(*) FROM upload_tickets WHERE status = 'WAITING') AS waiting_uploads, (SELECT count(*) FROM jobs WHERE status = 'UPLOADED') AS waiting_jobs,
        CASE WHEN 1706000000000 - (SELECT max(created_at) FROM event_logs) <= 1000000000000 THEN 'ok' ELSE 'degraded' END AS health""", "jobs", "upload_tickets", "event_logs"))
add("liveness", lambda s, d: queues.liveness(adapt(s, d, "event_logs").select(F.col("reference_id").alias("worker"), F.col("created_at").alias("at")), LOG_NOW, 86_400_000),
    oracle("""SELECT reference_id AS worker, max(created_at) AS last, 1706000000000 - max(created_at) <= 259200000 AS alive FROM event_logs GROUP BY reference_id""", "event_logs"))
add("expired_jobs", lambda s, d: queues.expired_jobs(adapt(s, d, "jobs"), 900_000_000_000).select("id"),
    oracle("SELECT id FROM jobs WHERE status IN ('COMPLETED', 'FAILED', 'CANCELED', 'LYRICS_PROCESSED') AND updated_at < 900000000000", "jobs"))
add("stale_tickets", lambda s, d: queues.stale_tickets(adapt(s, d, "upload_tickets"), 800_000_000_000, 850_000_000_000).select("id"),
    oracle("""SELECT id FROM upload_tickets WHERE (status IN ('WAITING', 'READY') AND last_seen_at < 800000000000) OR (status = 'UPLOADING' AND updated_at < 850000000000)""", "upload_tickets"))
add("monitored_jobs", lambda s, d: queues.monitored_jobs(adapt(s, d, "jobs"), 900_000_000_000, 500).select("id", "stage_age_seconds"),
    oracle("""SELECT id, CAST(greatest(0, floor((900000000000 - updated_at) / 1000)) AS BIGINT) AS stage_age_seconds FROM jobs WHERE status IN ('UPLOADED', 'PROCESSING', 'FAILED')
        ORDER BY CASE status WHEN 'PROCESSING' THEN 0 WHEN 'UPLOADED' THEN 1 ELSE 2 END, created_at, id LIMIT 500""", "jobs"))
add("active_tickets", lambda s, d: queues.active_tickets(adapt(s, d, "upload_tickets")).select("id"),
    oracle("SELECT id FROM upload_tickets WHERE status IN ('WAITING', 'READY', 'UPLOADING') ORDER BY created_at, id LIMIT 200", "upload_tickets"))
add("fifo", lambda s, d: queues.fifo(adapt(s, d, "jobs"), "PROCESSING").select("id", "created_at"), oracle("SELECT id, created_at FROM jobs WHERE status = 'PROCESSING'", "jobs"))
add("audit_tail", lambda s, d: queues.audit_tail(adapt(s, d, "event_logs"), 40).select("id"), oracle("SELECT id FROM event_logs ORDER BY id DESC LIMIT 40", "event_logs"))
add("admit", lambda s, d: queues.admit(adapt(s, d, "jobs").where("status = 'FAILED'").select("id", "client_key", "created_at"), adapt(s, d, "jobs"), adapt(s, d, "upload_tickets"), 30).select("id", "admitted"),
    oracle(ACTIVE + """, b AS (SELECT client_key, count(*) AS busy FROM w GROUP BY client_key), r AS (SELECT id, client_key, row_number() OVER (PARTITION BY client_key ORDER BY created_at, id) AS k FROM jobs WHERE status = 'FAILED')
        SELECT id, coalesce(busy, 0) + k <= 30 AS admitted FROM r LEFT JOIN b USING (client_key)""", "jobs", "upload_tickets"))
_SUB = "CASE WHEN id % 5 = 0 THEN NULL ELSE 's' || CAST(id % 4000 AS VARCHAR) END"
add("new_submissions", lambda s, d: queues.new_submissions(adapt(s, d, "jobs").selectExpr("id", "created_at", _SUB.replace("VARCHAR", "STRING") + " AS client_submission_id"),
    adapt(s, d, "jobs").where("status = 'FAILED'").selectExpr(_SUB.replace("VARCHAR", "STRING") + " AS client_submission_id")).select("id"),
    oracle(f"""r AS (SELECT id, created_at, status, {_SUB} AS sub FROM jobs), made AS (SELECT DISTINCT sub FROM r WHERE status = 'FAILED' AND sub IS NOT NULL),
        k AS (SELECT id, row_number() OVER (PARTITION BY sub ORDER BY created_at, id) AS n FROM r WHERE sub IS NOT NULL AND sub NOT IN (SELECT sub FROM made))
        SELECT id FROM r WHERE sub IS NULL UNION ALL SELECT id FROM k WHERE n = 1""", "jobs"))


def _commands(s, d):
    jobs = adapt(s, d, "jobs")
    commands = jobs.where("id % 5 = 0").selectExpr("id", "element_at(array('cancel', 'requeue', 'retry', 'cloud_render'), cast(id % 4 + 1 as int)) AS command")
    return queues.apply_commands(jobs, commands)


_COMMANDS = """c AS (SELECT id, ['cancel', 'requeue', 'retry', 'cloud_render'][id % 4 + 1] AS command FROM jobs WHERE id % 5 = 0),
    a AS (SELECT id, command, status, CASE WHEN command = 'cancel' AND status IN ('UPLOADED', 'PROCESSING') THEN 'CANCELED' WHEN command = 'requeue' AND status IN ('FAILED', 'CANCELED') THEN 'UPLOADED'
          WHEN command = 'retry' AND status = 'FAILED' THEN 'UPLOADED' WHEN command = 'cloud_render' AND status = 'COMPLETED' AND input_mode = 'AUDIO_ONLY' THEN 'UPLOADED' END AS new FROM c JOIN jobs USING (id))"""
add("apply_commands", lambda s, d: _commands(s, d)[0].select("id", "status"), oracle(_COMMANDS + " SELECT jobs.id, coalesce(a.new, jobs.status) AS status FROM jobs LEFT JOIN a USING (id)", "jobs"))
add("rejected_commands", lambda s, d: _commands(s, d)[2], oracle(_COMMANDS + " SELECT id, command, 'not allowed from ' || status AS reason FROM a WHERE new IS NULL", "jobs"))
add("recover_interrupted", lambda s, d: queues.recover_interrupted(adapt(s, d, "jobs"), NOW)[1].select("reference_id", "event"),
    oracle("SELECT id AS reference_id, 'job.recovered_failed' AS event FROM jobs WHERE status = 'PROCESSING'", "jobs"))


def _sessions(s, d):
    lines = adapt(s, d, "upload_tickets")
    sessions = lines.select(F.col("job_id").alias("ticket_id")).distinct().selectExpr("ticket_id", "7 * 8192 - ticket_id % 8000 AS size_bytes", "cast(8192 as long) AS chunk_bytes")
    chunks = lines.selectExpr("job_id AS ticket_id", "cast(id % 20 as long) AS chunk_index", "case when id % 20 = 6 then 8192 - job_id % 8000 else cast(8192 as long) end AS size_bytes", "created_at AS mtime")
    return sessions, chunks


_SESSIONS = """x AS (SELECT DISTINCT job_id AS ticket_id FROM upload_tickets), c AS (SELECT job_id AS ticket_id, id % 20 AS chunk_index, created_at AS mtime FROM upload_tickets),
    p AS (SELECT ticket_id, unnest(range(7)) AS chunk_index FROM x)"""
add("missing_chunks", lambda s, d: queues.missing_chunks(*_sessions(s, d)), oracle(_SESSIONS + " SELECT * FROM p ANTI JOIN c USING (ticket_id, chunk_index)", "upload_tickets"))
add("received_chunks", lambda s, d: queues.received_chunks(*_sessions(s, d)), oracle(_SESSIONS + " SELECT * FROM p SEMI JOIN c USING (ticket_id, chunk_index)", "upload_tickets"))
add("chunk_plan", lambda s, d: queues.chunk_plan(_sessions(s, d)[0]),
    oracle(_SESSIONS + " SELECT ticket_id, chunk_index, CASE WHEN chunk_index = 6 THEN 8192 - ticket_id % 8000 ELSE 8192 END AS expected_bytes FROM p", "upload_tickets"))
add("stale_sessions", lambda s, d: queues.stale_sessions(_sessions(s, d)[1], 900_000_000_000),
    oracle(_SESSIONS + " SELECT ticket_id, max(mtime) AS last_activity FROM c GROUP BY ticket_id HAVING max(mtime) < 900000000000", "upload_tickets"))
def _uploads(s, d):
    """The same chunks with content: the row's id, repeated."""
    sessions, chunks = _sessions(s, d)
    content = adapt(s, d, "upload_tickets").selectExpr("job_id AS ticket_id", "cast(id % 20 as long) AS chunk_index", "case when id % 20 = 6 then 8192 - job_id % 8000 else cast(8192 as long) end AS size_bytes", "encode(repeat(concat(cast(id as string), ';'), cast(1 + id % 50 as int)), 'utf-8') AS content")
    return sessions, content


add("assemble_sessions", lambda s, d: queues.assemble_sessions(*_uploads(s, d)).select("ticket_id", "chunks", "total_bytes", "complete", "sha256"),
    oracle("""x AS (SELECT job_id AS ticket_id, id % 20 AS chunk_index, CASE WHEN id % 20 = 6 THEN 8192 - job_id % 8000 ELSE 8192 END AS size_bytes, repeat(CAST(id AS VARCHAR) || ';', CAST(1 + id % 50 AS INTEGER)) AS content FROM upload_tickets),
        k AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY ticket_id, chunk_index ORDER BY size_bytes DESC, content) = 1)
        SELECT ticket_id, count(*) AS chunks, CAST(sum(size_bytes) AS BIGINT) AS total_bytes, count(*) FILTER (chunk_index < 7) = 7 AND max(chunk_index) < 7 AS complete, sha256(string_agg(content, '' ORDER BY chunk_index)) AS sha256 FROM k GROUP BY ticket_id""", "upload_tickets"))
