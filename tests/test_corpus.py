"""The corpus run with reviewed readings."""

import pytest

from tempolyra.plans import catalog, more_queries
from tempolyra.plans.corpus import build_timelines

TOKEN = "song_id long, line_idx long, token_idx long, surface string, reading string"


def tables(spark, songs):
    lines = spark.createDataFrame([(k, i, "物語", "ぶつご") for k in songs for i in (0, 1)], "song_id long, line_idx long, surface string, reading string")
    tokens = spark.createDataFrame([(k, i, 0, "物語", "ぶつご") for k in songs for i in (0, 1)], TOKEN)
    segs = spark.createDataFrame([(k, i, "", 1000 + 3000 * i, 3000 + 3000 * i) for k in songs for i in (0, 1)], "song_id long, seg_idx long, text string, start_ms long, end_ms long")
    words = spark.createDataFrame([(k, i, 0, "ものがたり", 1000 + 3000 * i, 3000 + 3000 * i) for k in songs for i in (0, 1)], "song_id long, seg_idx long, word_idx long, text string, start_ms long, end_ms long")
    return lines, tokens, segs, words, spark.createDataFrame([(k, 9000) for k in songs], "song_id long, duration_ms long")


def test_reviewed_readings_reach_the_timeline(spark):
    """1 reviewed, 2 not, 3 with another surface, 4 with a line too few, 5 with blank readings, 9 unknown."""
    lines, tokens, *heard = tables(spark, (1, 2, 3, 4, 5))
    new = [(k, i, 0, "物語", "ものがたり") for k in (1, 9) for i in (0, 1)] + [(3, 0, 0, "物語", "ものがたり"), (3, 1, 0, "物", "もの"), (4, 0, 0, "物語", "ものがたり")] + [(5, i, 0, "物語", "  ") for i in (0, 1)]
    review = spark.createDataFrame(new, TOKEN)
    spans = spark.createDataFrame([(1, k, 500 + 100 * k, 600 + 100 * k, 0.9) for k in range(10)], "song_id long, seq long, start_ms long, end_ms long, score double")
    out, rejects = build_timelines(lines, tokens.withColumn("alignment_pronunciation", tokens.reading), *heard, spans, review=review)
    reasons = {r.song_id: r.reason for r in rejects.collect()}
    assert reasons.pop(2) == reasons.pop(5) == "too few matches"
    assert reasons == {3: "surface changed", 4: "line or token count differs", 9: "line or token count differs"}
    assert {(r.song_id, r.line_idx, r.reading, r.start_ms, r.end_ms) for r in out["lines"].collect() if "reading" in out["lines"].columns} <= {(1, 0, "ものがたり", 500, 1000), (1, 1, "ものがたり", 1000, 1500)}
    assert [(r.song_id, r.lines, r.confidence, r.least_confidence, r.n_warnings) for r in out["summaries"].collect()] == [(1, 2, pytest.approx(0.9), pytest.approx(0.9), 0)]
    assert out["fallbacks"].count() == 0 and {r.reading for r in out["tokens"].collect()} == {"ものがたり"}


def test_review_equals_readings_given_at_once(spark):
    """Word alignment after the review is that of lyrics which had the readings from the start."""
    lines, tokens, *heard = tables(spark, (1, 2))
    review = tokens.selectExpr("song_id", "line_idx", "token_idx", "surface", "'ものがたり' AS reading")
    a, ra = build_timelines(lines, tokens, *heard, review=review)
    given = lambda df: df.selectExpr(*[c if c != "reading" else "'ものがたり' AS reading" for c in df.columns])
    b, rb = build_timelines(given(lines), given(tokens), *heard)
    for name in ("timelines", "lines", "tokens", "moras", "summaries"):
        assert sorted(map(str, a[name].collect())) == sorted(map(str, b[name].collect())) and a[name].count() > 0
    assert ra.count() == rb.count() == 0


def test_songs_wait_for_their_review(spark):
    lines, tokens, *heard = tables(spark, (1, 2))
    review = tokens.where("song_id = 1").selectExpr("song_id", "line_idx", "token_idx", "surface", "'ものがたり' AS reading")
    spans = spark.createDataFrame([(k, n, 5, 5, 0.9) for k in (1, 2) for n in range(10)], "song_id long, seq long, start_ms long, end_ms long, score double")
    out, rejects = build_timelines(lines, tokens, *heard, spans, review=review, require_review=True)
    assert [(r.song_id, r.reason) for r in rejects.collect()] == [(2, "reading review required")]
    assert [(r.song_id, r.fallback.split(":")[0]) for r in out["fallbacks"].collect()] == [(1, "primary_fallback")]
    with pytest.raises(ValueError):
        build_timelines(lines, tokens, *heard, require_review=True)
    empty, none = build_timelines(lines, tokens, *heard, review=review.limit(0), require_review=True)
    assert empty["lines"].count() == 0 and none.count() == 2


def test_registered_run_tells_of_every_song(spark):
    """Songs by the rules of the query: a row each, refused where the review lost a line, by spans where there are."""
    sf = "/root/testdata/sf0.001"
    lines = {r.song_id: r.n for r in more_queries._turns(spark, sf)[0].groupBy("song_id").agg({"*": "count"}).toDF("song_id", "n").collect()}
    rows = catalog.QUERIES["build_timelines"](spark, sf).collect()
    assert sorted(r.song_id for r in rows) == sorted(lines) and len(rows) > 20
    for r in rows:
        lost = r.song_id % 6 == 0 and lines[r.song_id] > 1
        assert (r.reason == "line or token count differs") == lost, r
        if r.reason is None:
            assert r.lines == lines[r.song_id] and 0 <= r.least_confidence <= 1 and 0 <= r.confidence <= 1
            stamped = "lrc_timing_applied" in r.warnings
            assert stamped == (r.song_id % 8 == 0), r
            if r.song_id % 4 == 0 and r.song_id % 6:
                assert r.engine == "primary" and 0.5 <= r.confidence <= 0.9, r
    assert {r.engine for r in rows} == {"primary", "fallback", None}
