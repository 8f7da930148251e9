"""Golden cases of reviews and edits."""

from tempolyra.operators import edits as ed


def frames(spark):
    lines = spark.createDataFrame([(1, 0, "こ", 1000, 2000), (1, 1, "い", 3000, 4000)], "song_id long, line_idx long, surface string, start_ms long, end_ms long")
    tokens = spark.createDataFrame([(1, 0, 0, "今", "きょう", 1000, 1500), (1, 0, 1, "は", "は", 1500, 2000), (1, 1, 0, "い", "い", 3000, 4000)], "song_id long, line_idx long, token_idx long, surface string, reading string, start_ms long, end_ms long")
    moras = spark.createDataFrame([(1, 0, 0, 0, "きょ", 1000, 1200, True), (1, 0, 0, 1, "う", 1200, 1500, True), (1, 0, 1, 0, "は", 1500, 2000, True), (1, 1, 0, 0, "い", 3000, 4000, True)], "song_id long, line_idx long, token_idx long, mora_idx long, reading string, start_ms long, end_ms long, matched boolean")
    return lines, tokens, moras


def times(df, *keys):
    return [(r.start_ms, r.end_ms) for r in df.orderBy("song_id", "line_idx", *keys).collect()]


def test_line_edits(spark):
    lines, tokens, _ = frames(spark)
    run = lambda k, kind, off: ed.edit_lines(lines, tokens, spark.createDataFrame([(1, k, kind, off)], "song_id long, line_idx long, kind string, offset_ms long"))
    a, b = run(0, "move", 5000)
    assert times(a) == [(2000, 3000), (3000, 4000)] and times(b, "token_idx")[:2] == [(2000, 2500), (2500, 3000)]
    assert times(run(1, "start", -5000)[0])[1] == (2000, 4000)
    assert times(run(0, "end", -5000)[0])[0] == (1000, 1100)
    assert times(run(0, "end", 5000)[0])[0] == (1000, 3000)


def test_boundaries(spark):
    _, tokens, moras = frames(spark)
    run = lambda b, t: ed.edit_boundaries(moras, tokens, spark.createDataFrame([(1, 0, b, t)], "song_id long, line_idx long, boundary_idx long, time_ms long"))
    m, t = run(1, 1700)
    assert times(m, "token_idx", "mora_idx")[:3] == [(1000, 1200), (1200, 1700), (1700, 2000)] and times(t, "token_idx")[:2] == [(1000, 1700), (1700, 2000)]
    assert times(run(0, 0)[0], "token_idx", "mora_idx")[:2] == [(1000, 1010), (1010, 1500)]


def test_readings_and_repair(spark):
    _, tokens, moras = frames(spark)
    t, m, lines = ed.edit_readings(tokens, moras, spark.createDataFrame([(1, 0, 0, " こんにち ")], "song_id long, line_idx long, token_idx long, reading string"))
    assert times(m, "token_idx", "mora_idx")[:4] == [(1000, 1125), (1125, 1250), (1250, 1375), (1375, 1500)]
    assert lines.orderBy("line_idx").first().reading == "こんにちは"
    broken = moras.where("not (line_idx = 0 and token_idx = 0 and mora_idx = 1)")
    assert times(ed.repair_moras(tokens, broken), "token_idx", "mora_idx")[:2] == [(1000, 1250), (1250, 1500)]


def test_reading_review(spark):
    _, tokens, _ = frames(spark)
    src = tokens.selectExpr("song_id", "line_idx", "token_idx", "surface", "reading", "'x' AS alignment_pronunciation")
    review = spark.createDataFrame([(1, 0, 0, "今", "いま"), (1, 0, 1, "は", " "), (1, 1, 0, "い", "い")], "song_id long, line_idx long, token_idx long, surface string, reading string")
    out, rejects = ed.apply_reading_review(src, review)
    assert [(r.reading, r.alignment_pronunciation) for r in out.orderBy("line_idx", "token_idx").collect()] == [("いま", None), ("は", "x"), ("い", "x")] and rejects.count() == 0
    assert ed.apply_reading_review(src, review.where("token_idx = 0"))[1].first().reason == "line or token count differs"


def test_timeline_review(spark):
    lines, tokens, moras = frames(spark)
    none = moras.limit(0)
    new = tokens.selectExpr("song_id", "line_idx", "token_idx", "case when line_idx = 1 then 'こんにち' else reading end AS reading", "start_ms", "case when line_idx = 1 then 3200 else end_ms end AS end_ms")
    out, rejects = ed.apply_timeline_review(lines, tokens, lines, new, none)
    assert rejects.count() == 0
    assert times(out["moras"].where("line_idx = 1"), "mora_idx") == [(3000, 3050), (3050, 3100), (3100, 3150), (3150, 3200)]
    late = lines.selectExpr("song_id", "line_idx", "surface", "case when line_idx = 1 then 1500 else start_ms end AS start_ms", "end_ms")
    assert ed.apply_timeline_review(lines, tokens, late, new, none)[1].first().reason == "line overlaps the one before"
    assert ed.apply_timeline_review(lines, tokens, lines, tokens, moras.withColumn("end_ms", moras.start_ms))[1].first().reason == "mora timing is invalid"
    assert ed.apply_timeline_review(lines, tokens, lines, tokens, moras)[1].count() == 0


def test_style(spark):
    rows = spark.createDataFrame([("x" * 201, "70.5", None, "abc", "900", "430", "#FF0080", "red")], "font_family string, font_size string, ruby_size string, stroke_width string, upper_y string, lower_y string, colour_before string, colour_after string")
    r = ed.normalise_style(rows).first()
    assert (r.font_family, r.font_size, r.ruby_size, r.stroke_width, r.upper_y, r.lower_y) == (ed.STYLE_FONT, 71, 26, 5, 560, 440)
    assert (r.colour_before, r.colour_after, r.colour_before_ass, r.font_size_scaled) == ("#ff0080", "#a50000", "&H008000FF", 107)
