"""Acoustic spans in the time of their song, against a fold over each song."""

import math
import random

from tempolyra.operators import align


def unpacked(ms, ranges):
    before = 0.0
    for s, e in ranges:
        if ms / 1000 < before + (e - s):
            return round((s + ms / 1000 - before) * 1000)
        before += e - s
    return round(ranges[-1][1] * 1000) if ranges else round(ms)


def folded(lines, spans, coarse, fine):
    t = {k: [unpacked(s, coarse), unpacked(e, coarse)] for k, (s, e) in spans.items()}
    inside = lambda x, r: round(r[0] * 1000) <= x <= math.ceil(r[1] * 1000)
    for a, z in lines:
        start, end = t[a][0], t[z][1]
        if not any(inside(start, r) and end <= math.ceil(r[1] * 1000) for r in coarse):
            hit = next((r for r in coarse if inside(end, r)), None)
            if hit:
                t[a][0] = min(t[a][1], round(hit[0] * 1000))
    for k, (a, z) in enumerate(lines):
        end, after = t[z][1], t[lines[k + 1][0]][0] if k + 1 < len(lines) else math.inf
        hit = next((math.ceil(e * 1000) for _, e in fine if end <= math.ceil(e * 1000) < after), None)
        if hit is not None:
            t[z][1] = max(t[z][0], hit)
        elif after < math.inf and any(round(s * 1000) <= end and math.ceil(e * 1000) >= after for s, e in fine):
            t[z][1] = max(end, after - 20)
    return t


def cut(rng, n, longest):
    at, out = 0.0, []
    for _ in range(n):
        at += rng.choice([0.1, 0.5, 2.0, 7.0]) + rng.randint(0, 9) / 16
        end = at + rng.randint(1, longest) / 8
        out.append((at, end))
        at = end
    return out


def test_spans_like_a_fold(spark):
    rng, targets, spans, activity, want = random.Random(9), [], [], [], {}
    for song in range(50):
        coarse, fine = cut(rng, rng.randint(1, 5), 60), cut(rng, rng.randint(0, 12), 20)
        activity += [(song, kind, k, s, e) for kind, rs in (("coarse", coarse), ("fine", fine)) for k, (s, e) in enumerate(rs)]
        at, seq, lines, mine = 0, 0, [], {}
        for line in range(rng.randint(1, 8)):
            n = rng.randint(1, 4)
            lines.append((seq, seq + n - 1))
            for _ in range(n):
                at += rng.randint(0, 900)
                mine[seq] = at, at + rng.randint(0, 700)
                at = mine[seq][1]
                targets.append((song, line, seq))
                spans.append((song, seq, *mine[seq], 0.5))
                seq += 1
        want |= {(song, k): tuple(t) for k, t in folded(lines, mine, coarse, fine).items()}
    frame = spark.createDataFrame
    got = align.spans_in_song(
        frame(targets, "song_id long, line_idx long, seq long"), frame(spans, "song_id long, seq long, start_ms long, end_ms long, score double"),
        frame(activity, "song_id long, kind string, range_idx long, start_s double, end_s double"),
    )
    found = {(r.song_id, r.seq): (r.start_ms, r.end_ms) for r in got.collect()}
    assert found.keys() == want.keys()
    wrong = {k: (found[k], want[k]) for k in want if found[k] != want[k]}
    assert not wrong, wrong
