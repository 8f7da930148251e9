"""Golden cases of the lyric functions with white space and forms beyond ASCII."""

from pyspark.sql import functions as F

from tempolyra.functions import text

WIDE = "　"


def test_wide_blanks(spark):
    song = f"{WIDE}きみの{WIDE}うた{WIDE}\n{WIDE}\n\x85\n \xa0\nはな とり\x0bかぜ"
    df = spark.createDataFrame([(1, song)], "song_id long, text string")
    assert [tuple(r) for r in text.normalised_lines(df).collect()] == [(1, 0, f"きみの{WIDE}うた"), (1, 1, "はな"), (1, 2, "とり"), (1, 3, "かぜ")]
    one = df.select(text.normalise_reading(F.lit(f"きみの{WIDE}うた")).alias("r"), text.split_moras(F.lit(f"きゃ{WIDE}く")).alias("m")).first()
    assert one.r == "きみのうた" and one.m == ["きゃ", "く"]


def test_lrc(spark):
    song = f"﻿[00:01.5]{WIDE}あ{{い|x}}{WIDE}\r\n[ar:だれか]\n@Ruby1=x\n{WIDE}[01:02:25][02:00]う\nえ"
    df = spark.createDataFrame([(1, song), (2, None), (3, "")], "song_id long, text string")
    assert [tuple(r) for r in text.parse_lrc(df).orderBy("song_id", "line_idx").collect()] == [(1, 0, "あい", 1500), (1, 1, "う", 62250), (1, 2, "え", None)]


def test_visible(spark):
    song = f"﻿[00:01.50]{{漢|か}}字{WIDE}\n[ti:x]{WIDE}\n\n@ruby a\n[歌|うた]"
    df = spark.createDataFrame([(1, song)], "song_id long, text string")
    assert [tuple(r) for r in text.visible_lines(df).collect()] == [(1, 1, "漢字"), (1, 5, "歌")]


def test_compatibility_forms(spark):
    df = spark.createDataFrame([("ｶﾗｵｹ", "からおけ"), ("カラオケ", "からおけ"), ("ガ", "が"), ("Ａｂｃ！", "abc"), ("㌔", "きろ"), (None, None), ("", "")], "x string, want string")
    for r in df.select(text.normalise_reading(F.col("x")).alias("got"), "want").collect():
        assert r.got == r.want


def test_widths(spark):
    df = spark.createDataFrame([("",), ("ab c",), ("漢字 かな",), ("é€",)], "visible string")
    got = {r.visible: r.width_px for r in text.line_widths(df).collect()}
    assert got == {"": 0, "ab c": 3 * 24 + 12 + 27, "漢字 かな": 2 * 57 + 12 + 2 * 48 + 4 * 9, "é€": 24 + 48 + 9}
