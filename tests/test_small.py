"""Operators that no query reaches, and the streaming form of run timings."""

import json
import random

from pyspark.sql import functions as F

from tempolyra.functions import text
from tempolyra.operators import edits, events, queues
from tempolyra.operators import intervals as iv
from tempolyra.sources import documents, tables
from tempolyra.streaming import logs
from tests.test_sources import _drain


def test_read_table(spark, tmp_path):
    spark.createDataFrame([("j", "FAILED", "extra")], "id string, status string, odd string").write.parquet(str(tmp_path / "jobs"))
    got = tables.read_table(spark, "jobs", str(tmp_path / "jobs"))
    assert got.schema == tables.SCHEMAS["jobs"]
    assert [(r.id, r.status, r.stage, r.created_at) for r in got.collect()] == [("j", "FAILED", None, None)]


def test_lyrics_json_round_trip_and_files(spark, tmp_path):
    doc = {"provider": "p", "source_text": "今日", "warnings": ["w"], "lines": [
        {"source": "s", "surface": "今日も", "reading": "きょうも", "tokens": [{"surface": "今日", "reading": "きょう", "alignment_pronunciation": "kyo"}, {"surface": "も", "reading": "も"}]},
        {"source": "t", "surface": "x", "reading": "x"}]}
    docs = spark.createDataFrame([("a", json.dumps(doc))], "song_id string, json string")
    lines, tokens = documents.lyric_documents(docs)
    songs = spark.createDataFrame([("a", "p", "今日", ["w"]), ("none", "q", "", [])], "song_id string, provider string, source_text string, warnings array<string>")
    out = documents.lyrics_json(lines, tokens, songs)
    got = {r.song_id: json.loads(r.json) for r in out.collect()}
    assert got["a"] == doc and got["none"] == {"provider": "q", "source_text": "", "warnings": []}
    documents.write_json(out, str(tmp_path / "out"))
    back = {r.song_id: json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()}
    assert back == got
    documents.write_ass(spark.createDataFrame([("a", "x\ny")], "song_id string, content string"), str(tmp_path / "ass"))
    assert [(r.song_id, r.value) for r in spark.read.text(str(tmp_path / "ass"), wholetext=True).collect()] == [("a", "x\ny\n")]


def test_report_json(spark):
    cases = spark.createDataFrame([("b", "x", True, 1.0, 1.0, 2.0, None), ("a", "x", False, None, None, None, "bad"), ("a", "w", True, 3.0, 3.0, 3.0, None)], "case string, engine string, ok boolean, mae_ms double, median_ms double, max_ms double, error string")
    summary = spark.createDataFrame([("x", 2), ("w", 1)], "engine string, n long")
    got = json.loads(documents.report_json(cases, summary).first().json)
    assert [(e["engine"], e["summary"], [(c["case"], c.get("mae_ms"), c.get("error")) for c in e["cases"]]) for e in got["engines"]] == [("w", {"n": 1}, [("a", 3.0, None)]), ("x", {"n": 2}, [("a", None, "bad"), ("b", 1.0, None)])]


def test_sniff_media(spark):
    cases = [
        (b"RIFF0000WAVEx", ".wav", True), (b"RIFF0000WAV", ".wav", False), (b"ID3", ".mp3", True), (b"\xff\xe0", ".MP3", True), (b"\xff\xd0", ".mp3", False), (b"0000ftypM4A ", ".m4a", True), (b"0000ftypM4A", ".mp4", False),
        (b"\xff\xf1", ".aac", True), (b"\xff\xe1", ".aac", False), (b"fLaC", ".flac", True), (b"OggS", ".ogg", True), (b"OggS", ".txt", False), (b"", ".wav", False), (None, ".mp3", False), (b"ID3", None, False),
    ]
    df = spark.createDataFrame([(k, c, s) for k, (c, s, _) in enumerate(cases)], "k int, content binary, suffix string")
    assert [r.media_ok for r in queues.sniff_media(df).orderBy("k").collect()] == [ok for *_, ok in cases]


def test_merge_reviewed_lyrics(spark):
    tok = "song_id long, line_idx long, token_idx long, surface string, reading string"
    lyric = spark.createDataFrame([(1, 0, 0, "今", "いま"), (1, 0, 1, "日", "ひ"), (2, 0, 0, "x", "x")], tok)
    seen = spark.createDataFrame([(1, 0, 1, "日", "び")], tok)
    songs = spark.createDataFrame([(1, ["browser_reviewed"]), (2, [])], "song_id long, warnings array<string>")
    merged, lines, warned = edits.merge_reviewed_lyrics(lyric, seen, songs)
    assert sorted((r.song_id, r.token_idx, r.reading) for r in merged.collect()) == [(1, 0, "いま"), (1, 1, "び"), (2, 0, "x")]
    assert sorted((r.song_id, r.reading) for r in lines.collect()) == [(1, "いまび"), (2, "x")]
    assert sorted((r.song_id, r.warnings) for r in warned.collect()) == [(1, ["browser_reviewed"]), (2, [])]


def test_timeline_summary(spark):
    lines = spark.createDataFrame([(1, 0.5), (1, 0.25)], "song_id long, confidence double")
    songs = spark.createDataFrame([(1, 0.4, ["a", "b"]), (2, 0.1, [])], "song_id long, confidence double, warnings array<string>")
    assert sorted(tuple(r) for r in documents.timeline_summary(lines, songs).select("song_id", "confidence", "n_warnings", "lines", "least_confidence").collect()) == [(1, 0.4, 2, 2, 0.25), (2, 0.1, 0, None, None)]


def test_overview(spark):
    jobs = spark.createDataFrame([(1, "FAILED", "x", 5, 6), (2, "PROCESSING", "y", 7, 8), (3, "PROCESSING", "y", 9, 9)], "id long, status string, stage string, created_at long, updated_at long")
    tickets = spark.createDataFrame([(k, s, k) for k, s in enumerate(["WAITING", "READY", "WAITING", "EXPIRED"])], "id long, status string, created_at long")
    audits = spark.range(5)
    got = queues.overview(jobs, tickets, audits, F.lit(20), 2)
    assert {r.status: r[1] for r in got["job_counts"].collect()} == {"FAILED": 1, "PROCESSING": 2}
    assert {r.status: r[1] for r in got["ticket_counts"].collect()} == {"WAITING": 2, "READY": 1, "EXPIRED": 1}
    assert {r.id for r in got["tickets"].collect()} == {0, 1, 2} and got["jobs"].count() <= 2
    assert [r.id for r in got["audits"].collect()] == [4, 3]


def test_line_windows_by_a_walk(spark):
    rng, rows, songs, want = random.Random(8), [], [], {}
    for song in range(60):
        n, median, t, made = rng.randint(1, 9), rng.randint(50, 300), 0, []
        for k in range(n):
            t += rng.randint(0, 2000)
            window = (t, t + rng.randint(1, 1500)) if rng.random() < 0.5 else None
            t = window[1] if window else t
            made.append((rng.randint(0, 8), window))
        last = t + rng.randint(0, 3000)
        songs.append((song, median, last))
        rows += [(song, k, m, *(w or (None, None))) for k, (m, w) in enumerate(made)]
        if not any(w for _, w in made):
            continue
        k = 0
        while k < n:
            if made[k][1]:
                want[song, k] = made[k][1]
                k += 1
                continue
            z = k
            while z < n and not made[z][1]:
                z += 1
            sizes = [max(1, m) for m, _ in made[k:z]]
            end = made[z][1][0] if z < n else last
            at = made[k - 1][1][1] if k else max(0, end - sum(sizes) * median)
            scale = max(0, end - at) / max(1, sum(sizes) * median)
            for j, size in enumerate(sizes):
                stop = min(end, at + round(size * median * scale))
                want[song, k + j] = at, stop
                at = stop
            k = z
    lines = spark.createDataFrame(rows, "song_id long, line_idx long, n_moras long, w_start long, w_end long")
    got = iv.complete_line_windows(lines, spark.createDataFrame(songs, "song_id long, median_ms long, last_end_ms long")).collect()
    found = {(r.song_id, r.line_idx): (r.w_start, r.w_end) for r in got}
    assert found.keys() == want.keys()
    wrong = {k: (found[k], want[k]) for k in want if found[k] != want[k]}
    assert not wrong, wrong


def test_particles_and_foreign_readings(spark):
    tok = spark.createDataFrame([(0, "は", "助詞,係助詞"), (1, "へ", "助詞"), (2, "は", "名詞"), (3, "を", "助詞"), (4, "は", None)], "id int, surface string, part_of_speech string")
    assert [r.alignment_pronunciation for r in text.particle_pronunciation(tok).orderBy("id").collect()] == ["wa", "e", None, None, None]
    rows = [(1, 0, "LOVE", None), (1, 1, "を", "を"), (1, 2, "A1", "a1"), (2, 0, "OK", "おーけー"), (2, 1, "b", " ")]
    words = spark.createDataFrame([("Love", "らぶ")], "word string, kana string")
    fixed, lines = text.fix_foreign_readings(spark.createDataFrame(rows, "line long, token_idx long, surface string, reading string"), words, ["line"])
    got = {(r.line, r.token_idx): r.reading for r in fixed.collect()}
    assert got == {(1, 0): "らぶ", (1, 1): "を", (1, 2): "えーいち", (2, 0): "おーけー", (2, 1): "びー"}
    assert {r.line: r.reading for r in lines.collect()} == {1: "らぶをえーいち", 2: "おーけーびー"}


def test_upper_median_of_a_large_key(spark):
    rows = spark.range(200_001).select(F.lit(1).alias("k"), (F.col("id") * 7919 % 200_001 - 10).alias("v")).unionByName(spark.createDataFrame([(2, -1), (3, None), (4, 5), (4, 9)], "k int, v long"))
    assert {r.k: r.median for r in iv.upper_median(rows, ["k"], "v").collect()} == {1: 99_996, 2: 200, 3: 200, 4: 9}


def test_stream_run_timings(spark, tmp_path):
    """As in the batch form, for rows in order; a row later than the watermark is dropped."""
    q, a, r, f = "job.queued", "worker.assigned", "worker.released", "worker.failed"
    first = [(1, "x", q, "00:00:00"), (2, "x", q, "00:01:00"), (3, "x", a, "00:03:00"), (4, "x", r, "00:10:00"), (5, "x", a, "00:11:00"), (6, "x", a, "00:12:00"), (7, "y", a, "00:05:00"), (8, "y", a, "00:05:00"), (9, "y", f, "00:05:00"), (10, "z", r, "00:06:00"), (11, "y", q, "00:05:00")]
    frame = lambda rows: spark.createDataFrame([(i, k, e, f"2024-01-01 {t}") for i, k, e, t in rows], "id long, reference_id string, event string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    late = [(20, "z", a, "00:06:30"), (21, "w", q, "14:00:00")]
    path = str(tmp_path / "in")
    for k, rows in enumerate([first, [(12, "w", q, "09:00:00")], [(13, "w", q, "09:30:00")], late, [(22, "w", q, "20:00:00")]]):
        frame(rows).coalesce(1).write.mode("append").parquet(f"{path}/{k}")
    stream = spark.readStream.schema(frame(first).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(path)
    got = _drain(logs.stream_run_timings(stream), tmp_path).collect()
    want = events.run_timings(frame(first).withColumn("created_at", F.unix_millis("ts"))).collect()
    assert sorted(tuple(r) for r in got if r.assigned_id != 20) == sorted(((r.reference_id, r.assigned_id, r.wait_ms, r.run_ms) for r in want), key=lambda t: t[:2])
    assert 20 not in {r.assigned_id for r in got}
