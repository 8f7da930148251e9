"""Throttling by chunks against the walk over a key, and line ends against all pairs."""

import math
import random

from pyspark.sql import functions as F

from tempolyra.operators import events
from tempolyra.operators import intervals as iv


def walked(rows, every):
    kept, last = set(), {}
    for key, at, i in sorted(rows, key=lambda r: (r[1], r[2])):
        if key not in last or at - last[key] >= every:
            kept.add(i)
            last[key] = at
    return kept


def test_throttle_like_the_walk(spark, monkeypatch):
    rng, rows = random.Random(5), []
    for key, n, span in (("a", 900, 3000), ("b", 300, 100_000), ("c", 1, 5), (None, 200, 900), ("", 200, 900), ("d", 50, 0)):
        rows += [(key, rng.randint(-500, span), len(rows) + k) for k in range(n)]
    df = spark.createDataFrame(rows, "event string, created_at long, id long")
    for chunk, every in ((1, 7), (2, 50), (64, 10), (64, 5000), (3, 0)):
        monkeypatch.setattr(events, "CHUNK", chunk)
        got = events.throttle_progress(df, every, ("event",)).collect()
        assert {r.id for r in got} == walked(rows, every) and len(got) == len({r.id for r in got}), (chunk, every)


def test_hot_key_is_spread(spark):
    """One key with all events: its chunks go to all tasks, and what meets by key is a small share."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(200_000).select(F.lit("hot").alias("event"), (F.col("id") * 3).alias("created_at"), "id")
        kept = events.throttle_progress(df, 100, ("event",))
        sizes = [r["count"] for r in kept.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 200_000 * 3 // 102 + 1 and len(sizes) == 4 and max(sizes) < 0.5 * sum(sizes)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_line_ends_like_all_pairs(spark):
    rng, lines, ranges = random.Random(6), [], []
    for song in range(40):
        at = 0
        for k in range(rng.randint(1, 12)):
            start = at + rng.randint(-300, 25_000)
            end = start + rng.randint(0, 3000)
            lines.append((song, k, start, start, end))
            at = end
        ranges += [("fine", song, k, s / 1000, (s + rng.randint(0, 30_000)) / 1000) for k, s in enumerate(rng.randint(0, max(1, at)) for _ in range(rng.randint(0, 15)))]
    want = {}
    for j, (song, k, start, _, end) in enumerate(lines):
        after = lines[j + 1][2] if j + 1 < len(lines) and lines[j + 1][0] == song else None
        mine = [(round(s * 1000), math.ceil(e * 1000)) for _, q, _, s, e in ranges if q == song]
        hit = next((e for _, e in mine if end <= e and (after is None or e < after)), None)
        if hit is not None:
            end = max(start, hit)
        elif after is not None and any(s <= end and e >= after for s, e in mine):
            end = max(end, after - 20)
        want[song, k] = end
    got = iv.fix_line_ends(spark.createDataFrame(lines, "song_id long, line_idx long, start_ms long, last_start_ms long, end_ms long"), spark.createDataFrame(ranges, "kind string, song_id long, range_idx long, start_s double, end_s double"))
    assert {(r.song_id, r.line_idx): r.end_ms for r in got.collect()} == want
