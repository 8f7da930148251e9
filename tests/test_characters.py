"""Characters timed by batches of lines, against a fold over single characters."""

from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tempolyra.operators import characters
from tempolyra.operators import subtitles as st
from tempolyra.plans import catalog

SF = "/root/testdata/sf0.001"
LINES = "song_id long, line_idx long, start_ms long, end_ms long, surface string"
TOKENS = "song_id long, line_idx long, token_idx long, surface string, start_ms long, end_ms long"
MORAS = "song_id long, line_idx long, token_idx long, mora_idx long, end_ms long"


def _even(x):
    return round(Fraction(x))


def _expected(line, tokens, moras):
    """(token_idx, character, sung, hundredths) by a fold, for times that are not null."""
    out = []
    shown = [k for k, t in enumerate(tokens) if t[1]]
    for k, (idx, surface, a, z) in enumerate(tokens):
        ends = [e for _, e in sorted(moras.get(idx, []))]
        sung = [c.isalnum() for c in surface]
        n, m, place, rows = sum(sung), len(ends), 0, []
        starts = [max(a, x) for x in [a, *ends]][:m]
        segs = [(s, min(z, max(s, z if j == m - 1 else e))) for j, (s, e) in enumerate(zip(starts, ends))]

        def at(i):
            if i == n:
                return z
            whole, part = divmod(Fraction(m * i, n), 1)
            return _even(segs[whole][0] + (segs[whole][1] - segs[whole][0]) * part)

        total = max(0, _even(Fraction(z - a, 10)))
        for c, one in zip(surface, sung):
            cs = 0
            if one:
                cs = max(0, _even(Fraction(at(place + 1) - at(place), 10))) if m else total // n + (place >= n - total % n)
                place += 1
                if place == n:
                    cs += _even(Fraction(max(0, (tokens[k + 1][2] if k + 1 < len(tokens) else line[1]) - z), 10))
                    cs += _even(Fraction(max(0, a - line[0]), 10)) if k == shown[0] else 0
            rows.append([idx, c, one, cs])
        out += rows
    over = sum(r[3] for r in out) - _even(Fraction(line[1] - line[0], 10))
    own = [r for r in out if r[2]]
    if own and over < 0:
        own[-1][3] -= over
    for r in reversed(own):
        cut = min(r[3], max(0, over))
        r[3], over = r[3] - cut, over - cut
    return [tuple(r) for r in out]


def _case(spark):
    songs = {
        (1, 0): ((0, 2000), [(0, "ab, c", 100, 900), (1, "", 900, 950), (2, "(音)x", 1000, 1555)], {0: [(0, 333), (1, 320), (2, 700)], 2: [(0, 1100)]}),
        (1, 1): ((3000, 3300), [(3, "{long}\\", 3000, 3400), (5, "𝒳é!", 3400, 3905)], {5: [(1, 3500), (0, 3450)]}),
        (2, 0): ((0, 100), [(0, "!?", 0, 90)], {}),
        (2, 5): ((50, 10), [(0, "zzzzzzz", 5, 8), (1, "a", 2, 1)], {1: [(0, 4)]}),
        (3, 0): ((500, 900), [(0, "", 500, 900)], {}),
    }
    lines = spark.createDataFrame([(*k, *v[0], "".join(t[1] for t in v[1])) for k, v in songs.items()], LINES)
    tokens = spark.createDataFrame([(*k, *t) for k, v in songs.items() for t in v[1]] + [(9, 9, 0, "stray", 0, 1)], TOKENS)
    moras = spark.createDataFrame([(*k, i, *m) for k, v in songs.items() for i, ms in v[2].items() for m in ms] + [(1, 0, 77, 0, 5)], MORAS)
    return songs, lines, tokens, moras


def test_timed_chunks_equal_a_fold(spark):
    songs, lines, tokens, moras = _case(spark)
    got = {}
    for r in st.timed_chunks(lines, tokens, moras).orderBy("song_id", "line_idx", "token_idx", "char_idx").collect():
        got.setdefault((r.song_id, r.line_idx), []).append((r.token_idx, r.text, r.sung, r.duration_cs))
    assert got == {k: _expected(*v) for k, v in songs.items() if any(t[1] for t in v[1])}


def test_karaoke_lines_equal_rendered_rows(spark):
    _, lines, tokens, moras = _case(spark)
    whole = st.with_tokens(lines, tokens, moras)
    by_rows = {(r.song_id, r.line_idx): r.karaoke for r in st.render_karaoke(st.timed_chunks(lines, tokens, moras)).collect()}
    assert {(r.song_id, r.line_idx): r.karaoke for r in characters.karaoke_lines(whole).collect()} == by_rows
    plain = {(r.song_id, r.line_idx): r.karaoke for r in st.render_karaoke(st.character_chunks(tokens.where("song_id < 9"), moras)).collect()}
    assert {(r.song_id, r.line_idx): r.karaoke for r in characters.karaoke_lines(whole, fit=False).collect()} == plain


def test_files_of_lines_and_of_rows(spark):
    _, lines, tokens, moras = _case(spark)
    layout, karaoke = st.simple_display(lines), st.render_karaoke(st.timed_chunks(lines, tokens, moras))
    rubies = spark.createDataFrame([(1, 1, 3, "か", 5, 6), (1, 1, 2, "な", 7, 8), (3, 0, 0, "r", 1, 2)], "song_id long, line_idx long, token_idx long, reading string, x long, y long")
    rows = st.dialogue_rows(layout, karaoke).select(*st.LINE, F.lit(1).alias("layer"), F.lit(0).cast("long").alias("seq"), "row").unionByName(st.ruby_rows(layout, rubies))
    want = sorted(st.ass_files(rows, "<base> <ruby>", st.auto_font_size(lines)).collect())
    assert sorted(st.fixed_slot_subtitles(lines, tokens, moras, "<base> <ruby>", rubies).collect()) == want
    two = st.ass_files(st.layered_rows(st.slot_timings(lines), karaoke, rubies), "<base> <ruby>")
    assert sorted(st.two_slot_subtitles(lines, tokens, moras, "<base> <ruby>", rubies).collect()) == sorted(two.collect())


def _shuffled(spark, query):
    """Rows that a query shuffles."""
    status, seen = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    stages = lambda: status.stageList(None, False, False, seen.new_array(spark.sparkContext._jvm.double, 0), None)
    total = lambda: sum(stages().apply(k).shuffleWriteRecords() for k in range(stages().size()))
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = total()
    query.write.format("noop").mode("overwrite").save()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return total() - before


@pytest.mark.parametrize("name", ["fixed_slot_subtitles", "render_karaoke", "two_slot_subtitles", "line_chunks"])
def test_lines_are_shuffled_and_not_their_characters(spark, name):
    n = catalog.QUERIES["auto_font_size"](spark, SF).count(), catalog.QUERIES["uniform_chunks"](spark, SF).count()
    assert _shuffled(spark, catalog.QUERIES[name](spark, SF)) < 2 * sum(n)


def test_trimmed_ends(spark):
    from tempolyra.functions.text import trim_blanks

    texts = ["　 a b \x1c\n", "\x85\xa0", "", "x﻿", None, "é "]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(trim_blanks(F.col("t")).alias("t")).collect()
    assert [r.t for r in got] == [t.strip() if t is not None else None for t in texts]
