"""Golden cases of ruby, layout and project text."""

from pyspark.sql import functions as F

from tempolyra.operators import ruby

TOK = "song_id long, line_idx long, token_idx long, surface string, reading string, start_ms long, end_ms long"
MOR = "song_id long, line_idx long, token_idx long, mora_idx long, reading string, start_ms long, end_ms long"


def test_readings_and_placements(spark):
    t = spark.createDataFrame([(1, 0, 0, "食べる", "たべる", 0, 1), (1, 0, 1, "物語", "ものがたり", 1, 2), (1, 1, 0, "かな", "かな", 0, 1), (1, 1, 1, "今x", "いま", 0, 1)], TOK)
    got = {(r.line_idx, r.token_idx): [(x.start, x.end, x.reading) for x in r.runs] for r in ruby.kanji_readings(t).collect()}
    assert got == {(0, 0): [(0, 1, "た")], (0, 1): [(0, 2, "ものがたり")], (1, 0): [], (1, 1): [(0, 1, "今")]}
    p = ruby.ruby_placements(t.where("line_idx = 0")).orderBy("token_idx").collect()
    assert [(r.reading, r.x, r.y) for r in p] == [("た", 830, 620), ("ものがたり", 1058, 620)]


def test_ruby_chunks(spark):
    t = spark.createDataFrame([(1, 0, 0, "今日", "きょう", 0, 900), (1, 0, 1, "x", "あ", 900, 1000)], TOK).withColumn("ruby", F.when(F.col("token_idx") == 0, "きょ").otherwise("いう"))
    m = spark.createDataFrame([(1, 0, 0, 0, "きょ", 0, 600), (1, 0, 0, 1, "う", 600, 900), (1, 0, 1, 0, "あ", 900, 1000)], MOR)
    got = ruby.ruby_chunks(t, m).orderBy("token_idx", "char_idx").collect()
    assert [(r.text, r.duration_cs, r.start_ms) for r in got] == [("き", 30, 0), ("ょ", 30, 0), ("い", 5, 900), ("う", 5, 900)]


def test_layout(spark):
    t = spark.createDataFrame([(1, 0, 0, "食べ", "たべ", 0, 1), (1, 1, 0, "ab", "ab", 0, 1)], TOK)
    g = spark.createDataFrame([(c, f, w) for c in "食べab" for f, w in (("base", 100.0), ("ruby", 40.0))] + [("た", "ruby", 300.0)], "char string, font string, advance double")
    got = [(r.text, r.reading, r.x, r.width) for r in ruby.layout_lines(t, g).orderBy("line_idx", "group_idx").collect()]
    assert got == [("食", "た", 192.0, 300.0), ("べ", None, 506.0, 100.0), ("a", None, 1514.0, 100.0), ("b", None, 1628.0, 100.0)]


def test_repair_collapsed(spark):
    t = spark.createDataFrame([(1, 0, 0, "a", "", 0, 0), (1, 0, 1, "b", "", 0, 900), (1, 1, 0, "a", "", 0, 600), (1, 1, 1, "b", "", 600, 600), (1, 2, 0, "a", "", 5, 5)], TOK)
    got = [(r.start_ms, r.end_ms) for r in ruby.repair_collapsed(t, F.col("token_idx") + 1).orderBy("line_idx", "token_idx").collect()]
    assert got == [(0, 300), (300, 900), (0, 200), (200, 600), (5, 5)]


def test_project_text(spark):
    t = spark.createDataFrame([(1, 0, 0, "今日", "きょう", 1000, 1500), (1, 0, 1, "も", "も", 1500, 1800)], TOK)
    m = spark.createDataFrame([(1, 0, 0, 0, "きょ", 1000, 1200), (1, 0, 0, 1, "う", 1200, 1500), (1, 0, 1, 0, "も", 1500, 1800)], MOR)
    lines = spark.createDataFrame([(1, 0, 1000, 1800)], "song_id long, line_idx long, start_ms long, end_ms long")
    got = ruby.project_text(spark.createDataFrame([(1, "{}")], "song_id long, config string"), lines, t, m).first().content
    assert got == "config {}\n\n\n@Ruby=今日,きょ[00:00:20]う,[00:01:00],[00:01:50]\n[00:01:00]今日[00:01:50]も[00:01:80]"


def test_split_by_kanji(spark):
    known = {"今": "いま", "日": "ひ", "花": "はな", "火": "ひ", "見": "み"}
    cases = [
        (("花火", "はなび"), [("花", "はな"), ("火", "び")]), (("今日は", "きょうは"), [("今", "きょ"), ("日", "う"), ("は", "は")]),
        (("お花見ス", "おはなみす"), [("お", "お"), ("花", "はな"), ("見", "み"), ("ス", "す")]), (("花", "はな"), [("花", "はな")]), (("かな", "かな"), [("かな", "かな")]),
        (("花と火", "あいう"), [("花", "あ"), ("と", "い"), ("火", "う")]), (("山川", "や"), [("山", "や"), ("川", "")]), (("東西南", "とうざい"), [("東", "とう"), ("西", "ざ"), ("南", "い")]),
    ]
    for (surface, reading), want in cases:
        assert ruby.split_surface(surface, reading, known) == want, surface
    tokens = spark.createDataFrame([(1, "花火", "はなび", None), (2, "今日", "きょう", "kyou"), (3, None, None, None), (4, "うた", "うた", None)], "id long, surface string, reading string, alignment_pronunciation string")
    got = ruby.split_by_kanji(tokens, spark.createDataFrame(list(known.items()), "char string, kana string"), ["id"])
    assert sorted((r.id, r.part_idx, r.surface, r.reading) for r in got.collect()) == [(1, 0, "花", "はな"), (1, 1, "火", "び"), (2, 0, "今日", "きょう"), (4, 0, "うた", "うた")]
