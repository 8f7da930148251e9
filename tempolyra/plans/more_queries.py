"""Queries over the driver's tables for request checks, redaction, edits and streams' batch forms."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import align, characters, edits, events, queues, redaction, ruby
from ..operators import intervals as iv
from ..operators import subtitles as st
from .adapters import adapt, oracle
from .catalog import ORACLES, QUERIES
from .corpus import build_timelines
from .song_queries import _song_lines, _surfaces, _worded, lines, moras


def add(name, fn, sql=None):
    QUERIES[name] = fn
    if sql:
        ORACLES[name] = sql


def table(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


_DEVICE = ["web_assembly", "web_gpu", "audio_extraction", "cache_storage", "cross_origin_isolated", "models_cached"]


def _devices(s, d):
    flags = {f: F.col("p_partkey") % (k + 5) != 0 for k, f in enumerate(_DEVICE)}
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 1_000_003 % 400_000_000).alias("video_size_bytes"), *[c.alias(f) for f, c in flags.items()],
                                      (F.col("p_size") % 12).alias("cores"), F.when(F.col("p_size") % 9 != 0, F.col("p_size") % 16).alias("memory_gb"), (F.col("p_partkey") * 7_000_003 % 900_000_000).alias("storage_bytes"))


add("select_route", lambda s, d: queues.select_route(_devices(s, d), 60_000_000).select("id", "route"),
    """SELECT p_partkey AS id, CASE WHEN v <= 0 OR v > 314572800 THEN 'REMOTE_VIDEO'
        WHEN p_partkey % 5 <> 0 AND p_partkey % 6 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 8 <> 0 AND p_partkey % 9 <> 0 AND p_partkey % 10 <> 0 AND p_size % 12 >= 6
             AND p_size % 9 <> 0 AND p_size % 16 >= 6 AND p_partkey * 7000003 % 900000000 >= v * 2 + 60000000 THEN 'LOCAL' WHEN p_partkey % 7 <> 0 THEN 'AUDIO_ONLY' ELSE 'REMOTE_VIDEO' END AS route
        FROM (SELECT *, p_partkey * 1000003 % 400000000 AS v FROM part)""")
add("validate_submissions", lambda s, d: queues.validate_submissions(adapt(s, d, "jobs").selectExpr(
    "id", "input_mode", "concat('f', id, element_at(array('.mp4', '.MP4', '.wav', '.txt'), cast(id % 4 + 1 as int))) AS file_name", "video_size_bytes - 2000 AS size_bytes", "id % 11 = 0 AS lyrics_file", "id % 2 = 0 AS lyrics_text",
    "id % 13 * 1000 AS chunk_bytes", "cast(ceil((video_size_bytes - 2000) / 5000) as bigint) AS total_chunks"), 200_000, 10_000).select("id", "reason"),
    oracle("""r AS (SELECT id, input_mode, id % 4 AS k, video_size_bytes - 2000 AS z, id % 13 * 1000 AS c FROM jobs)
        SELECT id, CASE WHEN k = 3 OR (k = 2 AND input_mode = 'VIDEO') THEN 'unsupported file type' WHEN z <= 0 THEN 'empty file' WHEN z > 200000 THEN 'file too large' WHEN id % 22 = 0 THEN 'lyrics given twice'
        WHEN c <= 0 OR c > 10000 THEN 'bad chunk size' WHEN ceil(z / 5000) <> ceil(z / c) THEN 'bad chunk count' END AS reason FROM r""", "jobs"))
add("client_key", lambda s, d: queues.client_key(table(s, d, "supplier").selectExpr("s_suppkey AS id", "case when s_suppkey % 3 = 0 then '127.0.0.1' else concat('10.1.', s_suppkey % 200, '.7') end AS peer_host",
    "case when s_suppkey % 7 = 0 then null else concat('203.0.113.', s_suppkey % 250, ', junk,10.2.3.', s_suppkey % 250) end AS forwarded_for"), ["127.0.0.1", "10.0.0.0/9"]).select("id", "client_key"),
    """SELECT s_suppkey AS id, CASE WHEN s_suppkey % 7 = 0 THEN CASE WHEN s_suppkey % 3 = 0 THEN '127.0.0.1' ELSE '10.1.' || s_suppkey % 200 || '.7' END ELSE '203.0.113.' || s_suppkey % 250 END AS client_key FROM supplier""")
add("normalise_ids", lambda s, d: queues.normalise_ids(table(s, d, "pages").selectExpr("page_id", "url AS file_name", "case when page_id % 2 = 0 then 'x' end AS client_submission_id", "concat('req-', page_id) AS request_id")).select("page_id", "submission_ok", "request_ok", "display_name"),
    """SELECT page_id, page_id % 2 <> 0 AS submission_ok, length('req-' || page_id) >= 8 AS request_ok, CASE WHEN n = '' THEN 'video' ELSE n END AS display_name FROM (SELECT *, trim(regexp_replace(url, '^.*[/\\\\]', '')) AS n FROM pages)""")
add("redact_text", lambda s, d: adapt(s, d, "song_lines").select("song_id", redaction.redact_text(F.col("text")).alias("safe")),
    oracle("""r AS (SELECT song_id, regexp_replace(regexp_replace(text, '(?i)(bearer\\s+)[^\\s,;]+', '\\1[REDACTED]', 'g'), '(?i)\\b(token|api[_-]?key|password|secret|signature|credential)\\s*[=:]\\s*[^\\s,;]+', '\\1=[REDACTED]', 'g') AS t FROM song_lines)
        SELECT song_id, CASE WHEN length(t) > 4000 THEN t[length(t)-3999:] || chr(10) || '...[truncated]' ELSE t END AS safe FROM r""", "song_lines"))
add("redact_url", lambda s, d: table(s, d, "pages").select("page_id", redaction.redact_url(F.regexp_replace("url", "ref=", "token=")).alias("safe")),
    """SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, 'ref=', 'token='), '#.*$', ''), 'token=[^&]*', 'token=[REDACTED]', 'g') AS safe FROM pages""")
add("redact_json", lambda s, d: adapt(s, d, "event_logs").select("id", redaction.redact_json(F.regexp_replace("details", '"k": (\\d)\\d*', '"k": $1, "password": "p"')).alias("safe")),
    oracle("""SELECT id, regexp_replace(details, '"k": (\\d)\\d*', '"k": \\1, "password": "[REDACTED]"') AS safe FROM event_logs""", "event_logs"))
add("error_rows", lambda s, d: redaction.error_rows(adapt(s, d, "event_logs"), {"1": "first", "2": "second"}).select("id", "public_message"),
    oracle("SELECT id, CASE stage WHEN 1 THEN 'first' WHEN 2 THEN 'second' ELSE 'processing failed' END AS public_message FROM event_logs WHERE event LIKE '%failed%'", "event_logs"))
add("job_states", lambda s, d: events.job_states(adapt(s, d, "event_logs").selectExpr("reference_id", "case when level = 'ERROR' then 'CANCELED' else event end AS status", "event = 'stage.started' AS requeue", "created_at", "id")).select("reference_id", "status"),
    oracle("""e AS (SELECT reference_id, id, created_at, level = 'ERROR' AS bad, event = 'stage.started' AS rq, event, row_number() OVER w AS k, sum(CAST(event = 'stage.started' AS INT)) OVER w AS g FROM event_logs WINDOW w AS (PARTITION BY reference_id ORDER BY created_at, id)),
        l AS (SELECT reference_id, g, arg_max(event, k) AS last, max(CAST(bad AS INT)) AS hit FROM e GROUP BY ALL), m AS (SELECT reference_id, max(g) AS g FROM l GROUP BY reference_id)
        SELECT reference_id, CASE WHEN hit = 1 THEN 'CANCELED' ELSE last END AS status FROM l JOIN m USING (reference_id, g)""", "event_logs"))
add("housekeeping_changes", lambda s, d: queues.housekeeping(adapt(s, d, "jobs"), adapt(s, d, "upload_tickets"), adapt(s, d, "event_logs"), 900_000_000_000, 10**10, 2 * 10**10, adapt(s, d, "upload_tickets").count(), 10**10, 1000, 10**10)["changes"],
    oracle("""t AS (SELECT *, (status IN ('WAITING', 'READY') AND last_seen_at < 890000000000) OR (status = 'UPLOADING' AND updated_at < 880000000000) AS stale FROM upload_tickets),
        b AS (SELECT count(*) AS busy FROM t WHERE NOT stale AND status IN ('READY', 'UPLOADING')), k AS (SELECT id, row_number() OVER (ORDER BY created_at, id) AS n FROM t WHERE NOT stale AND status = 'WAITING')
        SELECT 'upload.expired' AS event, id AS reference_id FROM t WHERE stale UNION ALL SELECT 'upload.activated', id FROM k, b WHERE n <= (SELECT count(*) FROM upload_tickets) - busy""", "upload_tickets"))


def _edits(s, d):
    """Every sixth line is edited; each line has two tokens."""
    ls = iv.push_lines(lines(s, d))
    e = ls.where("line_idx % 6 = 3").selectExpr("song_id", "line_idx", "element_at(array('move', 'start', 'end'), cast(song_id % 3 + 1 as int)) AS kind", "song_id % 900 - 450 AS offset_ms")
    half = "start_ms + (end_ms - start_ms) div 2"
    tokens = ls.selectExpr("song_id", "line_idx", "0L AS token_idx", "start_ms", f"{half} AS end_ms").unionByName(ls.selectExpr("song_id", "line_idx", "1L AS token_idx", f"{half} AS start_ms", "end_ms"))
    new, inner = edits.edit_lines(ls, tokens, e)
    return new.select("song_id", "line_idx", F.lit(-1).cast("long").alias("token_idx"), "start_ms", "end_ms").unionByName(inner)


add("edit_lines", _edits, oracle(f"""r AS (SELECT song_id, line_idx, start_ms AS s, CASE WHEN end_ms > start_ms THEN end_ms - start_ms ELSE 100 END AS d FROM gap_lines),
        c AS (SELECT *, CAST(sum(d) OVER (PARTITION BY song_id ORDER BY line_idx) AS BIGINT) AS c FROM r),
        p AS (SELECT song_id, line_idx, d, c + greatest(0, max(s - (c - d)) OVER (PARTITION BY song_id ORDER BY line_idx)) AS e FROM c),
        n AS (SELECT song_id, line_idx, d, e - d AS s, e, coalesce(lag(e) OVER w, 0) AS low, lead(e - d) OVER w AS ns, CASE WHEN line_idx % 6 = 3 THEN ['move', 'start', 'end'][song_id % 3 + 1] END AS kind,
                     song_id % 900 - 450 AS off, least({edits.LEAST_LINE}, greatest(1, d)) AS room FROM p WINDOW w AS (PARTITION BY song_id ORDER BY line_idx)),
        a AS (SELECT *, CASE kind WHEN 'move' THEN CASE WHEN ns IS NULL THEN greatest(low, s + off) ELSE least(greatest(low, ns - d), greatest(low, s + off)) END
                             WHEN 'start' THEN least(e - room, greatest(low, s + off)) ELSE s END AS s2 FROM n),
        b AS (SELECT *, CASE kind WHEN 'move' THEN s2 + d WHEN 'end' THEN least(greatest(s + room, e + off), coalesce(ns, 1000000000000000)) ELSE e END AS e2 FROM a),
        t AS (SELECT *, 0 AS token_idx, s AS x, s + d // 2 AS y FROM b UNION ALL SELECT *, 1, s + d // 2, e FROM b)
        SELECT song_id, line_idx, CAST(-1 AS BIGINT) AS token_idx, s2 AS start_ms, e2 AS end_ms FROM b
        UNION ALL SELECT song_id, line_idx, token_idx, CASE WHEN kind IS NULL THEN x ELSE CAST(floor(s2 + (x - s) / (e - s) * (e2 - s2) + 0.5) AS BIGINT) END,
                         CASE WHEN kind IS NULL THEN y ELSE CAST(floor(s2 + (y - s) / (e - s) * (e2 - s2) + 0.5) AS BIGINT) END FROM t""", "gap_lines"))
add("target_moras", lambda s, d: align.target_moras(_surfaces(s, d)[1].withColumn("reading", F.lower("surface"))).groupBy("song_id").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last")),
    oracle("""l AS (SELECT song_id, unnest(regexp_split_to_array(text, 'LINE_END')) AS raw FROM song_lines), m AS (SELECT song_id, length(regexp_replace(raw, '[BLANKS\\p{P}\\p{S}]', '', 'g')) AS n FROM l)
        SELECT song_id, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n) - 1 AS BIGINT) AS last FROM m GROUP BY song_id HAVING sum(n) > 0""", "song_lines"))


def _turns(s, d):
    """Lines, tokens, segments, words and durations: every turn of a conversation as a song: segments of nine words, timed by the words' places; lines of six
    words, whose reading leaves out each seventh word of the turn."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "text"))
    turns = table(s, d, "conversations").select((F.col("conv_id") * 1000 + place).cast("long").alias("song_id"), "text")
    w = turns.select("song_id", F.posexplode(F.split("text", r"\s+")).alias("k", "text")).selectExpr("song_id", "cast(k div 9 as bigint) AS seg_idx", "cast(k as bigint) AS word_idx", "text", "k * 400L AS start_ms", "k * 400L + 380 AS end_ms")
    segs = w.groupBy("song_id", "seg_idx").agg(F.lit("").alias("text"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    tokens = w.where("word_idx % 7 <> 6").selectExpr("song_id", "word_idx div 6 AS line_idx", "word_idx AS token_idx", "text AS surface", "text AS reading")
    ls = edits.joined_reading(tokens).withColumn("surface", F.col("reading"))
    return ls, tokens, segs, w, segs.groupBy("song_id").agg(F.max("end_ms").alias("duration_ms"))


def _corpus(s, d):
    """The whole run over all turns. Every second one is reviewed, which adds a mora to each fifth token; reviews of
    every sixth lost their first line. Every fourth has acoustic spans, of 100 ms a mora, and every eighth a stamp
    for its first line."""
    ls, tokens, *heard = _turns(s, d)
    read = F.when(F.col("token_idx") % 5 == 0, F.concat("reading", F.lit("a"))).otherwise(F.col("reading"))
    reviewed = tokens.where("song_id % 2 = 0").withColumn("reading", read)
    spans = align.target_moras(reviewed.where("song_id % 4 = 0")).selectExpr("song_id", "seq", "seq * 100 AS start_ms", "seq * 100 + 100 AS end_ms", "(seq % 5 + 5) / 10D AS score")
    stamps = ls.where("song_id % 8 = 0 and line_idx = 0").selectExpr("song_id", "line_idx", "5000L AS stamp_ms")
    out, rejects = build_timelines(ls, tokens, *heard, spans, stamps, reviewed.where("song_id % 6 <> 0 or line_idx > 0"))
    timed = out["summaries"].join(out["timelines"].select("song_id", "engine", F.array_join("warnings", ";").alias("warnings")), "song_id").join(out["fallbacks"], "song_id", "left")
    return timed.withColumn("reason", F.lit(None).cast("string")).unionByName(rejects, allowMissingColumns=True)


add("align_corpus", lambda s, d: align.align_corpus(*_turns(s, d))[0]["lines"].select("song_id", "line_idx", "start_ms", "end_ms"))
add("build_timelines", _corpus)
add("align_from_spans", lambda s, d: align.align_from_spans(moras(s, d).select(*iv.TOKEN).distinct(), moras(s, d).select(*iv.TOKEN, "mora_idx", "seq", "reading"), moras(s, d).select("song_id", "seq", "start_ms", "end_ms", "score"))[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n")))
add("ruby_placements", lambda s, d: ruby.ruby_placements(_surfaces(s, d)[1].withColumnRenamed("surface", "said").withColumn("surface", F.concat(F.lit("今"), "said")).withColumn("reading", F.concat(F.lit("いま"), F.lower("said")))).groupBy("song_id", "line_idx").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("left")))
add("render_karaoke", lambda s, d: characters.karaoke_lines(_worded(_song_lines(s, d)), fit=False))
