"""Documents, tables, redaction and streams on golden cases."""

import json

from pyspark.sql import Row
from pyspark.sql import functions as F

from tempolyra.functions import text
from tempolyra.operators import events, redaction
from tempolyra.sources import documents, tables
from tempolyra.streaming import logs

TIMELINE = {
    "confidence": 0.5, "warnings": ["x_fallback:y", "z"], "alignment_model": None,
    "lines": [{"surface": "ab", "reading": "ab", "start_ms": 0, "end_ms": 20, "confidence": 1.0, "tokens": [
        {"surface": "ab", "reading": "ab", "start_ms": 0, "end_ms": 20, "confidence": 1.0, "moras": [
            {"reading": "a", "start_ms": 0, "end_ms": 10, "matched": True, "confidence": 1.0}, {"reading": "b", "start_ms": 10, "end_ms": 20, "matched": False, "confidence": 0.0}]}]}],
}


def test_timelines_round_trip(spark):
    bad = json.loads(json.dumps(TIMELINE))
    del bad["lines"][0]["tokens"][0]["moras"][1]["matched"]
    docs = spark.createDataFrame([("s", json.dumps(TIMELINE)), ("b", json.dumps(bad)), ("n", "nothing"), ("e", '{"confidence": 1}')], "song_id string, json string")
    good, rejects = documents.timelines(docs)
    assert {r.song_id: r.reason for r in rejects.collect()} == {"b": "a required key is missing", "n": "not a timeline"}
    assert good["moras"].count() == 2
    back = {r.song_id: json.loads(r.json) for r in documents.timeline_json(good["timelines"], good["lines"], good["tokens"], good["moras"]).collect()}
    assert back["s"]["lines"] == TIMELINE["lines"] and back["s"]["alignment_engine"] == "whisper_mora"
    assert [tuple(r) for r in documents.fallback_runs(good["timelines"]).collect()] == [("s", "x_fallback:y")]


def test_transcripts_and_lyrics(spark):
    t = {"language": "ja", "duration_seconds": 3.0, "segments": [{"id": 0, "text": "ab", "start_ms": 0, "end_ms": 9, "words": [{"text": "a", "start_ms": 0, "end_ms": 4}, {"text": "b", "start_ms": 4, "end_ms": 9}]}]}
    docs = spark.createDataFrame([("s", json.dumps(t))], "song_id string, json string")
    seg, words = documents.transcripts(docs)
    assert seg.count() == 1 and [r.text for r in words.orderBy("word_idx").collect()] == ["a", "b"]
    assert documents.transcript_summary(docs).first()[3:] == (1, 2)
    ly = {"provider": "p", "source_text": "[00:01]ab\n\nc", "warnings": [], "lines": [{"source": "ab", "surface": "ab", "reading": "ab", "tokens": [{"surface": "ab", "reading": "ab"}]}]}
    docs = spark.createDataFrame([("s", json.dumps(ly))], "song_id string, json string")
    lines, tokens = documents.lyric_documents(docs)
    assert lines.count() == tokens.count() == 1
    assert documents.lyric_summary(docs).first()[1:5] == (2, 12, 1, True)


def test_lyric_files(spark):
    rows = [("a", b" x \n", None), ("b", None, "t"), ("c", b"x", "t"), ("d", b"\xff\xfe", None), ("e", b"", " "), ("f", b"y" * 30, None)]
    got = {r.song_id: (r.lyrics, r.source, r.reason) for r in documents.lyric_files(spark.createDataFrame(rows, "song_id string, content binary, text string"), 20).collect()}
    assert got == {"a": ("x", "file", None), "b": ("t", "text", None), "c": (None, None, "lyrics given twice"), "d": (None, None, "not UTF-8"), "e": (None, None, None), "f": (None, None, "lyrics too large")}


def test_manifest(spark):
    m = {"cases": [{"name": "c", "reference": "r.json", "engines": {"a": {"timeline": "a.json", "elapsed_seconds": 1.5}, "b": {"timeline": "b.json", "peak_rss_mb": 2.0}}}]}
    got = documents.manifest(spark.createDataFrame([("m", json.dumps(m))], "song_id string, json string")).collect()
    assert {(r.case, r.engine, r.timeline) for r in got} == {("c", "a", "a.json"), ("c", "b", "b.json")}


def test_conform_and_append(spark, tmp_path):
    old = spark.createDataFrame([("1", "UPLOADED", 5)], "id string, status string, progress long")
    got = tables.conform(old, tables.SCHEMAS["jobs"], tables.DEFAULTS["jobs"])
    assert got.dtypes == spark.createDataFrame([], tables.SCHEMAS["jobs"]).dtypes and got.first().input_mode == "VIDEO" and got.first().progress == 5
    ev = spark.sql("SELECT 1L AS id, 'info' AS level, 'Task' AS category, map('b', '2', 'a', '1') AS details, timestamp'2024-01-02 03:04:05' AS created_at")
    tables.append_events(ev, str(tmp_path / "log"))
    r = spark.read.parquet(str(tmp_path / "log")).first()
    assert (r.level, r.category, r.details, str(r.date)) == ("INFO", "task", '{"a":"1","b":"2"}', "2024-01-02")


def test_redaction(spark):
    details = {"token": "t", "nested": {"url": "https://h/p?key=1&q=2#f", "list": ["bearer abc"]}, "argv": ["ffmpeg", "--token", "x", "/tmp/a.mp4"], "log_path": "/a/b.txt", "n": 1, "long": "z" * 5000}
    df = spark.createDataFrame([(1, json.dumps(details), "Bearer abc, password: hunter"), (2, None, None), (3, "plain token=abc", "x")], "id long, details string, message string")
    got = {r.id: r for r in redaction.redact(df).collect()}
    d = json.loads(got[1].details)
    assert d["token"] == "[REDACTED]" and d["nested"] == {"url": "https://h/p?key=%5BREDACTED%5D&q=2", "list": ["bearer [REDACTED]"]}
    assert d["argv"] == ["ffmpeg", "--token", "[REDACTED]", "a.mp4"] and d["log_path"] == "b.txt" and d["n"] == 1
    assert d["long"] == "z" * 4000 + "\n...[truncated]"
    assert got[1].message == "Bearer [REDACTED], password=[REDACTED]" and got[2].details == "{}" and got[3].details == "plain token=[REDACTED]"
    url = spark.createDataFrame([("https://h/p?token=1&q=2#f",), ("no url?x=1",)], "u string").select(redaction.redact_url(F.col("u")).alias("u"))
    assert [r.u for r in url.collect()] == ["https://h/p?token=[REDACTED]&q=2", "no url?x=1"]


def test_redaction_by_leaves(spark):
    cases = [
        ({"a": {"auth_token": {"deep": [1, 2]}, "b": []}, "c": {}}, {"a": {"auth_token": "[REDACTED]", "b": []}, "c": {}}),
        ({"cmd": ["x", "--token", "--token", "y", "--key=1", "password=1", 5, "/a/b", "Bearer q"]}, {"cmd": ["x", "--token", "[REDACTED]", "y", "--key=1", "[REDACTED]", "5", "b", "[REDACTED]"]}),
        ({"args": "Bearer q", "dir": "C/x", "k": "/x/y/", "p": "a /x/y"}, {"args": "Bearer [REDACTED]", "dir": "x", "k": "y", "p": "a /x/y"}),
        ({"traceback": 'at /x/y.py in C:\\a\\b.py, token: 1'}, {"traceback": "at <path> in <path>/b.py, token=[REDACTED]"}),
        ({"u": "HTTP://h/p?a=1+2&&b&Key=~*#z", "v": "http://h/p?token=1 and more"}, {"u": "http://h/p?a=1+2&b=&Key=%5BREDACTED%5D", "v": "http://h/p?token=[REDACTED] and more"}),
        ([[["x"], []], {"n": None, "t": True}], [[["x"], []], {"n": None, "t": True}]), ("plain", "plain"), (7, 7), ({"é": "\u2028"}, {"é": "\u2028"}),
    ]
    df = spark.createDataFrame([(k, json.dumps(x)) for k, (x, _) in enumerate(cases)], "id long, details string")
    got = {r.id: json.loads(r.x) for r in df.select("id", redaction.redact_json(F.col("details")).alias("x")).collect()}
    assert [got[k] for k in range(len(cases))] == [want for _, want in cases]


def test_lrc_golden(spark):
    df = spark.createDataFrame([(1, "[ar:artist]\n[00:01.00]{今日|きょう}も\n[00:03:50]歌う\n@Ruby1=x\nplain")], "song_id long, text string")
    assert [(r.lyric, r.start_ms) for r in text.parse_lrc(df).orderBy("line_idx").collect()] == [("今日も", 1000), ("歌う", 3500), ("plain", None)]
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(text.split_moras(F.lit("きゃっと"))) == ["きゃ", "っ", "と"] and one(text.split_moras(F.lit("すーぱー"))) == ["す", "ー", "ぱ", "ー"]
    assert one(text.normalise_reading(F.lit("カラ・Ｏケ！ A"))) == "からoけa" and one(text.normalise_reading(text.nfkc(F.lit("ｶﾗ")))) == "から"
    assert one(text.line_width(F.lit("あ" * 21))) == 1188
    tokens, rejects = text.parse_annotations(spark.createDataFrame([(1, "{知|し}るも[の|n]は"), (2, "{知|しる"), (3, "a}b")], "id long, line string"))
    assert [(r.surface, r.reading, r.alignment_pronunciation) for r in tokens.orderBy("token_idx").collect()] == [("知", "し", None), ("るも", "るも", None), ("の", "の", "n"), ("は", "は", None)]
    assert {r.id for r in rejects.collect()} == {2, 3}
    words = spark.createDataFrame([("LOVE", "らぶ")], "word string, kana string")
    got = text.foreign_readings(spark.createDataFrame([(1, "LOVE 39-ab")], "id long, surface string"), words, ["id"]).first()
    assert got.foreign_reading == "らぶ さんきゅうえーびー"


def _stream(spark, tmp_path, df):
    df.write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))


def _drain(out, tmp_path, mode="append"):
    q = out.writeStream.outputMode(mode).format("memory").queryName("t" + tmp_path.name.replace("-", "_")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return out.sparkSession.table("t" + tmp_path.name.replace("-", "_"))


def test_stream_ingest_and_dedup(spark, tmp_path):
    df = spark.createDataFrame([Row(id=1, level="DEBUG", message="a", details=None), Row(id=2, level="ERROR", message="token=x", details='{"password": "p"}')], "id long, level string, message string, details string")
    got = _drain(logs.stream_ingest(_stream(spark, tmp_path, df)), tmp_path).collect()
    assert [(r.id, r.message, r.details) for r in got] == [(2, "token=[REDACTED]", '{"password": "[REDACTED]"}')]


def test_stream_dedup(spark, tmp_path):
    df = spark.sql("SELECT client_submission_id, ts FROM VALUES ('a', timestamp'2024-01-01 00:00:00'), ('a', timestamp'2024-01-01 00:01:00'), ('b', timestamp'2024-01-01 00:02:00') AS t(client_submission_id, ts)")
    assert sorted(r.client_submission_id for r in _drain(logs.stream_dedup(_stream(spark, tmp_path, df)), tmp_path).collect()) == ["a", "b"]


def test_stream_sessions(spark, tmp_path):
    df = spark.sql("SELECT id, status, ts FROM VALUES (1, 'WAITING', timestamp'2024-01-01 00:00:00'), (1, 'WAITING', timestamp'2024-01-01 00:01:00'), (2, 'UPLOADING', timestamp'2024-01-01 00:00:00'), (3, 'WAITING', timestamp'2024-01-01 00:30:00') AS t(id, status, ts)")
    got = _drain(logs.stream_expire(_stream(spark, tmp_path, df)), tmp_path).collect()
    assert [(r.id, str(r.expired_at), r.touches) for r in got] == [(1, "2024-01-01 00:03:00", 2)]


def test_stream_traces(spark, tmp_path):
    """Two starts in a row, an end within time, one without a start, a start that nothing ends; as in the batch form."""
    rows = [(1, "a", "stage.started", "00:00:00"), (2, "a", "stage.started", "00:01:00"), (3, "a", "stage.failed", "00:05:00"), (4, "a", "stage.completed", "00:06:00"),
            (5, "b", "stage.started", "00:02:00"), (6, "c", "stage.completed", "05:00:00")]
    df = spark.createDataFrame([(i, r, "u", "s", "c", e, f"2024-01-01 {t}") for i, r, e, t in rows], "id long, reference_id string, run_id string, stage string, component string, event string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    got = _drain(logs.stream_traces(_stream(spark, tmp_path, df)), tmp_path).collect()
    want = events.stage_traces(df.withColumn("created_at", F.unix_millis("ts"))).collect()
    assert sorted((r.start_id, r.outcome) for r in got) == sorted((r.start_id, r.outcome) for r in want) == [(1, "open"), (2, "failed"), (5, "open")]
    assert {r.start_id: str(r.ended_at) for r in got}[2] == "2024-01-01 00:05:00"


def test_stream_expire_final(spark, tmp_path):
    df = spark.sql("SELECT id, status, ts FROM VALUES (1, 'WAITING', timestamp'2024-01-01 00:00:00'), (1, 'COMPLETED', timestamp'2024-01-01 00:01:00'), (3, 'WAITING', timestamp'2024-01-01 00:30:00') AS t(id, status, ts)")
    assert _drain(logs.stream_expire(_stream(spark, tmp_path, df)), tmp_path).count() == 0


def test_stream_stale_sessions(spark, tmp_path):
    df = spark.sql("SELECT ticket_id, ts FROM VALUES (1, timestamp'2024-01-01 00:00:00'), (1, timestamp'2024-01-01 00:01:00'), (2, timestamp'2024-01-01 02:00:00') AS t(ticket_id, ts)")
    got = _drain(logs.stream_stale_sessions(_stream(spark, tmp_path, df), "10 minutes"), tmp_path).collect()
    assert [(r.ticket_id, str(r.stale_at), r.chunks) for r in got] == [(1, "2024-01-01 00:11:00", 2)]


def test_stream_retain(spark, tmp_path):
    df = spark.sql("SELECT id, ts FROM VALUES (1, timestamp'2024-01-01 00:00:00'), (1, timestamp'2024-02-20 00:00:00'), (2, timestamp'2024-02-20 00:00:00') AS t(id, ts)")
    got = _drain(logs.stream_retain(_stream(spark, tmp_path, df), "30 days", F.lit("2024-03-01 00:00:00").cast("timestamp")), tmp_path)
    assert sorted(r.id for r in got.collect()) == [1, 2]


def test_stream_job_state(spark, tmp_path):
    rows = [("j", "UPLOADED", False, 1, 1), ("j", "CANCELED", False, 2, 2), ("j", "COMPLETED", False, 3, 3), ("j", "UPLOADED", True, 4, 4), ("k", "CANCELED", False, 1, 5), ("k", "FAILED", False, 2, 6)]
    df = spark.createDataFrame(rows, "reference_id string, status string, requeue boolean, created_at long, id long")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    got = _drain(logs.stream_job_state(_stream(spark, tmp_path, df)), tmp_path, "update")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in events.job_states(df).collect()}


def test_job_states(spark):
    rows = [("j", "UPLOADED", False, 1, 1), ("j", "CANCELED", False, 2, 2), ("j", "COMPLETED", False, 3, 3), ("j", "UPLOADED", True, 4, 4), ("k", "CANCELED", False, 1, 5), ("k", "FAILED", False, 2, 6)]
    df = spark.createDataFrame(rows, "reference_id string, status string, requeue boolean, created_at long, id long")
    assert {tuple(r) for r in events.job_states(df).collect()} == {("j", "UPLOADED", 3), ("k", "CANCELED", 1)}


def test_stream_throttle_equals_batch(spark, tmp_path):
    rows = [(k, "e", "r", k * 700) for k in range(20)] + [(100 + k, "e", "q", k * 2500) for k in range(5)]
    df = spark.createDataFrame(rows, "id long, event string, reference_id string, created_at long")
    key = ("event", "reference_id")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    got = _drain(logs.stream_throttle(_stream(spark, tmp_path, df), 2000, key), tmp_path, "append")
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in events.throttle_progress(df, 2000, key).collect())
