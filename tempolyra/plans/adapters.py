"""The driver's tables in the shapes of the service and song tables. Each adapter is one SQL text that
both Spark and DuckDB run: {table} names an input, MS(x) stands for a timestamp's epoch milliseconds."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import BLANK_CLASS, LINE_END

TABLES = "region nation customer supplier part orders lineitem events documents pages conversations embeddings".split()

ADAPTERS: dict[str, str] = {
    "jobs": """
        SELECT o_orderkey AS id, o_custkey AS client_key,
               CASE WHEN o_orderstatus = 'O' THEN 'UPLOADED' WHEN o_orderstatus = 'P' THEN 'PROCESSING'
                    WHEN o_orderpriority = '1-URGENT' THEN 'FAILED' WHEN o_orderpriority = '5-LOW' THEN 'CANCELED'
                    WHEN o_orderpriority = '2-HIGH' THEN 'LYRICS_PROCESSED' ELSE 'COMPLETED' END AS status,
               CASE o_orderkey % 7 WHEN 0 THEN 'REMOVING_VOCALS' WHEN 1 THEN 'EXTRACTING_AUDIO' WHEN 2 THEN 'TRANSCRIBING'
                    WHEN 3 THEN 'PROCESSING_LYRICS' WHEN 4 THEN 'ALIGNING' WHEN 5 THEN 'GENERATING_SUBTITLE'
                    ELSE 'RENDERING_VIDEO' END AS stage,
               CASE WHEN o_orderkey % 3 = 0 THEN 'AUDIO_ONLY' ELSE 'VIDEO' END AS input_mode,
               CAST(floor(o_totalprice) AS BIGINT) AS video_size_bytes,
               MS(o_orderdate) AS created_at, MS(o_orderdate) + o_orderkey % 1000 AS updated_at
        FROM {orders}""",
    "upload_tickets": """
        SELECT l_orderkey * 20 + l_linenumber AS id, l_orderkey AS job_id, min(l_suppkey) AS client_key,
               CASE WHEN min(l_returnflag) = 'A' THEN 'WAITING' WHEN min(l_linestatus) = 'F' THEN 'UPLOADING'
                    ELSE 'READY' END AS status,
               CAST(floor(sum(l_quantity)) AS BIGINT) AS video_size_bytes,
               MS(min(l_shipdate)) AS created_at, MS(max(l_shipdate)) AS updated_at, MS(max(l_shipdate)) AS last_seen_at
        FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    "event_logs": """
        SELECT event_id AS id,
               CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARNING' ELSE 'INFO' END AS level,
               CASE WHEN event_id % 2 = 0 THEN 'task' ELSE 'upload' END AS category,
               CASE event_type WHEN 'error' THEN 'stage.failed' WHEN 'signup' THEN 'stage.fallback' WHEN 'view' THEN 'stage.progress'
                    WHEN 'click' THEN 'stage.started' ELSE 'stage.completed' END AS event,
               'value ' || event_type AS message, user_id AS reference_id, user_id * 10 + event_id % 3 AS run_id,
               event_id % 7 AS stage, event_id % 2 AS component, value AS duration_ms, props AS details, MS(ts) AS created_at
        FROM {events}""",
    "song_lines": """
        SELECT doc_id AS song_id, text FROM {documents}""",
    "moras": """
        WITH k AS (SELECT l_orderkey AS song_id, l_linenumber AS n, min(l_partkey) AS p, min(l_suppkey) AS s
                   FROM {lineitem} GROUP BY l_orderkey, l_linenumber),
        r AS (SELECT song_id, p, s, CAST(row_number() OVER (PARTITION BY song_id ORDER BY n) - 1 AS BIGINT) AS seq FROM k)
        SELECT song_id, seq, p % 5 AS reading, seq * 200 + p % 60 AS start_ms, seq * 200 + 100 + p % 90 AS end_ms,
               seq * 200 + p % 60 + s % 41 - 20 AS cand_start_ms, seq * 200 + 100 + p % 90 - (s % 31) + 15 AS cand_end_ms,
               s % 7 AS engine_no, s % 11 AS score_no
        FROM r""",
    "gap_lines": """
        WITH e AS (SELECT user_id AS song_id, MS(ts) - min(MS(ts)) OVER (PARTITION BY user_id) AS off,
                          CAST(floor(value * 400) AS BIGINT) AS len, event_id
                   FROM {events})
        SELECT song_id, CAST(row_number() OVER (PARTITION BY song_id ORDER BY off, event_id) - 1 AS BIGINT) AS line_idx,
               CAST(floor(off / 2000) AS BIGINT) AS start_ms, CAST(floor(off / 2000) AS BIGINT) + len AS end_ms
        FROM e""",
}


def _ms(sql: str, engine: str) -> str:
    form = {"spark": r"unix_millis(cast(\1 as timestamp))", "duckdb": r"(epoch_us(\1) // 1000)"}[engine]
    return re.sub(r"MS\(((?:\w+\(\w+\))|\w+)\)", form, sql)


def adapt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An adapter's rows."""
    sql = ADAPTERS[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(_ms(sql, "spark"), **used)


def oracle(body: str, *names: str) -> str:
    """DuckDB SQL: the adapters as common tables before a body that starts with SELECT or with more of them.
    BLANKS and LINE_END in it stand for the classes of the text functions."""
    body = body.replace("BLANKS", BLANK_CLASS).replace("LINE_END", LINE_END)
    tables = {t: t for t in TABLES}
    heads = [f"{n} AS ({_ms(ADAPTERS[n], 'duckdb').format(**tables)})" for n in names]
    joint = "," if body.lstrip()[:6].upper() != "SELECT" else ""
    return f"WITH {', '.join(heads)}{joint} {body}" if heads else body
