"""Golden cases and sequential folds for alignment, intervals and subtitles."""

import numpy as np
import random

from pyspark.sql import functions as F

from tempolyra.operators import align, intervals as iv, subtitles as st


def test_exact_and_interpolated_alignment(spark):
    lines = spark.createDataFrame([(1, 0, "物語", "ものがたり"), (1, 1, "いつも", "いつも"), (2, 0, "きみの物語", "きみのものがたり"), (3, 0, "x", "あいう"), (4, 0, "x", "かきくけこさしすせそ")], "song_id long, line_idx long, surface string, reading string")
    tokens = spark.createDataFrame([(1, 0, 0, "物語", "ものがたり"), (1, 1, 0, "いつも", "いつも"), (2, 0, 0, "きみ", "きみ"), (2, 0, 1, "の", "の"), (2, 0, 2, "物語", "ものがたり"), (3, 0, 0, "x", "あいう"), (4, 0, 0, "x", "かきくけこさしすせそ")], "song_id long, line_idx long, token_idx long, surface string, reading string")
    segs = spark.createDataFrame([(1, 0, "", 1000, 3000), (1, 1, "", 3300, 4200), (2, 0, "", 1000, 3500), (4, 0, "", 0, 900)], "song_id long, seg_idx long, text string, start_ms long, end_ms long")
    words = spark.createDataFrame([(1, 0, 0, "ものがたり", 1000, 3000), (1, 1, 0, "いつも", 3300, 4200), (2, 0, 0, "きみ", 1000, 1600), (2, 0, 1, "ものがたり", 2000, 3500), (4, 0, 0, "なにぬねの", 0, 900)], "song_id long, seg_idx long, word_idx long, text string, start_ms long, end_ms long")
    out, rejects = align.align_corpus(lines, tokens, segs, words, spark.createDataFrame([(k, 5000) for k in range(1, 5)], "song_id long, duration_ms long"))
    assert {r.song_id: r.reason for r in rejects.collect()} == {3: "no words", 4: "too few matches"}
    assert sorted((r.song_id, r.line_idx, r.start_ms, r.end_ms) for r in out["lines"].collect())[:2] == [(1, 0, 1000, 3000), (1, 1, 3300, 4200)]
    no = [r for r in out["moras"].collect() if r.song_id == 2 and r.reading == "の"][0]
    assert (no.start_ms, no.end_ms, no.matched) == (1600, 2000, False)
    t = {r.song_id: r for r in out["timelines"].collect()}
    assert t[1].confidence == 1 and t[1].warnings == [] and t[2].warnings == ["partial_alignment"]


def test_retime_golden(spark):
    def run(rows):
        df = spark.createDataFrame([(1, k, *r) for k, r in enumerate(rows)], "song_id long, line_idx long, start_ms long, end_ms long, stamp_ms long")
        return [(r.new_start, r.new_end) for r in iv.retime_lines(df).orderBy("line_idx").collect()]
    assert run([(2000, 3000, 1000), (4000, 5000, 3500)]) == [(1000, 2000), (3500, 4500)]
    assert run([(0, 5000, 1000), (6000, 7000, 4000)]) == [(1000, 4000), (4000, 5000)]


def _fold_retime(rows):
    out = []
    for k, (s, e, stamp) in enumerate(rows):
        a = stamp if stamp is not None else max(out[-1][1] if out else 0, s)
        z = a + max(1, e - s)
        nxt = rows[k + 1][2] if k + 1 < len(rows) else None
        out.append((a, min(z, nxt) if nxt is not None and nxt > a else z))
    return out if any(r[2] is not None for r in rows) else [(s, e) for s, e, _ in rows]


def _fold_slots(lines, entry=4166, hold=2000, protect=1000, margin=2500):
    raw, para, place, head = [], 0, 0, lines[0][0]
    for k, (s, e) in enumerate(lines):
        if k and s - lines[k - 1][1] > entry + hold:
            para, place, head = para + 1, 0, s
        raw.append([para, place, (head if place == 1 else s) - entry, e])
        place += 1
    for k in range(len(raw) - 2):
        if raw[k + 2][0] == raw[k][0] and raw[k + 2][2] > lines[k][1] + hold:
            raw[k][3] = raw[k + 2][2] = lines[k][1] + hold
    for k in range(len(raw) - 2):
        if raw[k + 2][0] == raw[k][0] and lines[k + 2][0] >= raw[k][3] + protect + margin:
            raw[k][3] += protect
    starts = [max(0, r[2], raw[k - 2][3] if k > 1 and raw[k - 2][0] == r[0] else r[2]) for k, r in enumerate(raw)]
    ends = []
    for k, r in enumerate(raw):
        nxt = [starts[j] for j in range(k + 1, len(raw)) if raw[j][1] % 2 == r[1] % 2][:1]
        ends.append(max(starts[k], min([lines[k][1] + hold, *nxt])))
    return list(zip(starts, ends))


def test_folds(spark):
    rng = random.Random(6)
    songs, stamps = {}, {}
    for k in range(60):
        at, rows = 0, []
        for _ in range(rng.randint(1, 9)):
            at += rng.choice([-300, 0, 800, 3000, 7000, 20000])
            rows.append((max(0, at), max(0, at) + rng.choice([0, 400, 2500, 6000])))
            at = rows[-1][1]
        songs[k] = rows
        stamps[k] = [(s, e, rng.choice([None, s + rng.randint(-900, 900)])) for s, e in rows]
    df = spark.createDataFrame([(k, i, s, e, p) for k, rows in stamps.items() for i, (s, e, p) in enumerate(rows)], "song_id long, line_idx long, start_ms long, end_ms long, stamp_ms long")
    got = {(r.song_id, r.line_idx): (r.new_start, r.new_end) for r in iv.retime_lines(df).collect()}
    slots = {(r.song_id, r.line_idx): (r.display_start_ms, r.display_end_ms) for r in st.slot_timings(df).collect()}
    pushed = {(r.song_id, r.line_idx): (r.start_ms, r.end_ms) for r in iv.push_lines(df).collect()}
    for k in songs:
        for i, want in enumerate(_fold_retime(stamps[k])):
            assert got[k, i] == want, (k, i, stamps[k])
        for i, want in enumerate(_fold_slots(songs[k])):
            assert slots[k, i] == want, (k, i, songs[k])
        end = 0
        for i, (s, e) in enumerate(songs[k]):
            s2 = max(end, s)
            end = s2 + (e - s if e > s else 100)
            assert pushed[k, i] == (s2, end)


def test_two_slot_golden(spark):
    rows = [(10, 12), (13, 15), (17, 19), (30, 32), (33, 35)]
    df = spark.createDataFrame([(1, k, s * 1000, e * 1000) for k, (s, e) in enumerate(rows)], "song_id long, line_idx long, start_ms long, end_ms long")
    layout = st.slot_timings(df)
    got = [(r.display_start_ms, r.display_end_ms) for r in layout.orderBy("line_idx").collect()]
    assert got == [(5834, 13000), (5834, 17000), (13000, 21000), (25834, 34000), (25834, 37000)]
    assert st.indicator_events(layout).count() == 8


def test_character_and_line_chunks(spark):
    def run(line, tokens, moras):
        ls = spark.createDataFrame([(1, 0, *line)], "song_id long, line_idx long, start_ms long, end_ms long")
        ts = spark.createDataFrame([(1, 0, k, *t) for k, t in enumerate(tokens)], "song_id long, line_idx long, token_idx long, surface string, start_ms long, end_ms long")
        ms = spark.createDataFrame([(1, 0, *m) for m in moras], "song_id long, line_idx long, token_idx long, mora_idx long, reading string, start_ms long, end_ms long")
        chars = st.character_chunks(ts, ms)
        return [r.duration_cs for r in chars.orderBy("token_idx", "char_idx").collect()], st.line_chunks(chars, ts, ls)
    assert run((0, 1000), [("かな", 0, 1000)], [(0, 0, "か", 0, 200), (0, 1, "な", 200, 1000)])[0] == [20, 80]
    lines = run((1000, 2500), [("あ", 1000, 1800), ("い", 2000, 2500)], [(0, 0, "あ", 1000, 1800), (1, 0, "い", 2000, 2500)])[1]
    assert [r.duration_cs for r in lines.orderBy("token_idx").collect()] == [100, 50]
    assert st.render_karaoke(lines).first().karaoke == "{\\kf100}あ{\\kf50}い"
    short = run((0, 30), [("あい，", 0, 30)], [(0, 0, "あ", 0, 15), (0, 1, "い", 15, 30)])[1]
    assert [r.duration_cs for r in short.orderBy("char_idx").collect()] == [2, 1, 0]


def test_validate_and_romanise(spark):
    targets = spark.createDataFrame([(1, k, m, None) for k, m in enumerate(["き", "っ", "て", "ー", "ー"])] + [(2, 0, "?", None), (3, 0, "あ", "Ya!")], "song_id long, seq long, reading string, pronunciation string")
    table = spark.createDataFrame([("き", "ki"), ("て", "te"), ("っ", ""), ("ー", "")], "mora string, romaji string")
    good, bad = align.iv.romanise(targets, table)
    assert [r.romaji for r in good.where("song_id = 1").orderBy("seq").collect()] == ["ki", "t", "te", "e", "e"]
    assert good.where("song_id = 3").first().romaji == "ya" and [r.song_id for r in bad.collect()] == [2]
    got = spark.range(1).select(align.seq_blocks(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c"))).alias("r")).first().r
    assert [tuple(x) for x in got] == [(1, 0, 1)] and align.likeness(np.array([0, 1]), np.array([1, 2])) == 0.5


def test_build_timelines_and_files(spark):
    from tempolyra.operators import ruby
    from tempolyra.plans.corpus import build_timelines

    lines = spark.createDataFrame([(k, 0, "物語", "ものがたり") for k in (1, 2, 3)], "song_id long, line_idx long, surface string, reading string")
    tokens = spark.createDataFrame([(k, 0, 0, "物語", "ものがたり") for k in (1, 2, 3)], "song_id long, line_idx long, token_idx long, surface string, reading string")
    segs = spark.createDataFrame([(1, 0, "", 1000, 3000), (2, 0, "", 1000, 3000)], "song_id long, seg_idx long, text string, start_ms long, end_ms long")
    words = spark.createDataFrame([(k, 0, 0, "ものがたり", 1000, 3000) for k in (1, 2)], "song_id long, seg_idx long, word_idx long, text string, start_ms long, end_ms long")
    spans = spark.createDataFrame([(1, k, 500 + 100 * k, 600 + 100 * k, 0.9) for k in range(5)] + [(2, 0, 5, 5, 0.9)], "song_id long, seq long, start_ms long, end_ms long, score double")
    stamps = spark.createDataFrame([(2, 0, 7000)], "song_id long, line_idx long, stamp_ms long")
    out, rejects = build_timelines(lines, tokens, segs, words, spark.createDataFrame([(k, 5000) for k in (1, 2, 3)], "song_id long, duration_ms long"), spans, stamps)
    t = {r.song_id: (r.engine, r.warnings) for r in out["timelines"].collect()}
    assert t == {1: ("primary", []), 2: ("fallback", ["primary_fallback:wrong number of spans", "lrc_timing_applied"])}
    assert {(r.song_id, r.start_ms, r.end_ms) for r in out["lines"].collect()} == {(1, 500, 1000), (2, 7000, 9000)}
    assert {r.song_id for r in rejects.collect()} == {3}
    files = st.two_slot_subtitles(out["lines"].select("song_id", "line_idx", "start_ms", "end_ms"), out["tokens"], out["moras"], "[Script Info]", rubies=ruby.ruby_placements(out["tokens"]))
    content = {r.song_id: r.content for r in files.collect()}
    rows = content[2].split("\n")
    assert rows[0] == "﻿[Script Info]" and ",Indicator," in rows[1] and rows[5].endswith("{\\kf100}物{\\kf100}語") and rows[6].endswith("{\\an5\\pos(960,620)}ものがたり")


def test_timed_chunks_equal_the_steps(spark):
    """Tokens without moras, unsung and empty ones, gaps, overlaps, lines too short and too long."""
    rng = random.Random(6)
    lines, tokens, moras = [], [], []
    for song in range(6):
        at = 0
        for line in range(5):
            start = at
            for token in range(rng.randint(0, 5)):
                end = at + rng.randint(0, 900)
                surface = rng.choice(["今日", "うた", "...", "", "a-b", "ながいことば"])
                tokens.append((song, line, token, surface, at, end))
                for k in range(rng.randint(0, 4)):
                    moras.append((song, line, token, k, "あ", 0, at + rng.randint(-50, 1000)))
                at = end + rng.randint(-60, 200)
            if rng.random() < 0.9:
                lines.append((song, line, start - rng.randint(0, 90), at + rng.randint(-400, 300)))
    keys = "song_id long, line_idx long, "
    ls = spark.createDataFrame(lines, keys + "start_ms long, end_ms long")
    ts = spark.createDataFrame(tokens, keys + "token_idx long, surface string, start_ms long, end_ms long")
    ms = spark.createDataFrame(moras, keys + "token_idx long, mora_idx long, reading string, start_ms long, end_ms long")
    one = sorted(map(tuple, st.timed_chunks(ls, ts, ms).collect()))
    two = sorted(map(tuple, st.line_chunks(st.character_chunks(ts, ms), ts, ls).collect()))
    assert one == two and len(one) > 50


def test_fixed_slot_file(spark):
    """A whole file: sections in order, styles with the song's sizes and as many fields as their format, rows in order."""
    lines = spark.createDataFrame([(1, 0, "うた", 1000, 2000), (1, 1, "こえ", 2500, 3500)], "song_id long, line_idx long, surface string, start_ms long, end_ms long")
    tokens = lines.selectExpr("song_id", "line_idx", "0L AS token_idx", "surface", "start_ms", "end_ms")
    moras = tokens.selectExpr("song_id", "line_idx", "token_idx", "explode(array(0L, 1L)) AS mora_idx", "'あ' AS reading", "start_ms", "end_ms").selectExpr("song_id", "line_idx", "token_idx", "mora_idx", "reading", "start_ms + mora_idx * 600 AS start_ms", "start_ms + 600 + mora_idx * 400 AS end_ms")
    rubies = spark.createDataFrame([(1, 1, 0, "こえ", 900, 400)], "song_id long, line_idx long, token_idx long, reading string, x long, y long")
    rows = st.fixed_slot_subtitles(lines, tokens, moras, rubies=rubies).first().content.rstrip("\n").split("\n")
    assert rows[0] == "﻿[Script Info]" and "PlayResX: 1920" in rows
    style = rows.index("[V4+ Styles]")
    assert [len(r.split(":", 1)[1].split(",")) for r in rows[style + 1 : style + 5]] == [23] * 4 and rows[style + 2].startswith("Style: Main,Noto Sans CJK JP,120,") and rows[style + 3].split(",")[2] == "48"
    events = rows.index("[Events]")
    assert rows[events + 1] == "Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text"
    assert rows[events + 2 :] == [
        "Dialogue: 0,0:00:00.00,0:00:02.50,Main,,0,0,0,,{\\kf60}う{\\kf40}た", "Dialogue: 0,0:00:01.00,0:00:03.50,Main,,0,0,0,,{\\kf60}こ{\\kf40}え",
        "Dialogue: 1,0:00:01.00,0:00:03.50,Ruby,,0,0,0,,{\\an5\\pos(900,400)}こえ",
    ]


def test_mora_violations(spark):
    lines = spark.createDataFrame([(1, 0, 0, 1000)], "song_id long, line_idx long, start_ms long, end_ms long")
    tokens = spark.createDataFrame([(1, 0, k, "かな", 100 * k, 100 * k + 100) for k in range(4)], "song_id long, line_idx long, token_idx long, reading string, start_ms long, end_ms long")
    rows = [(0, 0, "か", 0, 50), (0, 1, "な", 50, 100), (1, 0, "か", 100, 150), (1, 1, "に", 150, 200), (2, 0, "か", 150, 300), (2, 1, "な", 250, 300), (3, 0, "か", 300, 400)]
    moras = spark.createDataFrame([(1, 0, *r) for r in rows], "song_id long, line_idx long, token_idx long, mora_idx long, reading string, start_ms long, end_ms long")
    got = sorted(r.problem for r in iv.timeline_violations(lines, tokens, moras).collect())
    assert got == ["mora out of range", "moras differ from the reading", "number of moras differs"]
