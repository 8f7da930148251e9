"""Matching blocks against the standard library's, and a song's windows against the whole table."""

import random
from difflib import SequenceMatcher

import numpy as np

from tempolyra.operators import align


def test_blocks_and_likeness():
    rng = random.Random(1)
    for _ in range(600):
        v = rng.choice([1, 2, 4, 20])
        a, b = ([rng.randint(0, v) for _ in range(rng.randint(0, 30))] for _ in "ab")
        if rng.random() < 0.5:
            b = a[: rng.randint(0, 30)] + b[:5]
        want = SequenceMatcher(None, a, b, autojunk=False)
        x, y = np.array(a, np.int64), np.array(b, np.int64)
        pairs = {(i + k, j + k) for i, j, n in align.matching_blocks(x, y) for k in range(n)}
        assert pairs == {(m.a + k, m.b + k) for m in want.get_matching_blocks() for k in range(m.size)}
        assert align.likeness(x, y) == want.ratio()


def whole_table(lines, segments):
    score = lambda p, q: SequenceMatcher(None, sum(p, []), sum(q, []), autojunk=False).ratio() * 2 - 0.8
    said, best = [s[0] for s in segments], {(0, 0): (0.0, None)}
    for i in range(len(lines) + 1):
        for j in range(len(said) + 1):
            ways = [
                (best[i - di, j - dj][0] + (score(lines[i - di : i], said[j - dj : j]) if di and dj else 0.0) + cost, (di, dj))
                for di, dj, cost in [(1, 0, -0.35), (0, 1, -0.15), (1, 1, 0.0), (1, 2, -0.05), (2, 1, -0.05)] if di <= i and dj <= j and i + j
            ]
            if ways:
                best[i, j] = max(ways, key=lambda x: x[0])
    i, j, out = len(lines), max(range(len(said) + 1), key=lambda k: best[len(lines), k][0]), {}
    while i or j:
        di, dj = best[i, j][1]
        if di and dj:
            a, z = segments[j - dj][1], segments[j - 1][2]
            n, m = max(1, len(lines[i - di])), max(1, len(lines[i - 1]))
            edge = [a, z] if di == 1 else [a, a + (z - a) * n // (n + m), z]
            out |= {i - di + k: (edge[k], edge[k + 1]) for k in range(di)}
        i, j = i - di, j - dj
    return out


def song(rng, n, v, noise):
    lines, segments, k, t = [[chr(97 + rng.randint(0, v)) for _ in range(rng.randint(0, 12))] for _ in range(n)], [], 0, 0
    while k < n:
        d = rng.random()
        if d < 0.1:
            k += 1
            continue
        two = 0.2 <= d < 0.35 and k + 1 < n
        body = [chr(97 + rng.randint(0, v)) for _ in range(6)] if d < 0.2 else lines[k] + (lines[k + 1] if two else [])
        k += 0 if d < 0.2 else 1 + two
        body = [x if rng.random() > noise else chr(97 + rng.randint(0, v)) for x in body]
        for part in [body[: len(body) // 2], body[len(body) // 2 :]] if d > 0.85 else [body]:
            segments.append((part, t, t + 900))
            t += 1000
    return lines, segments


def test_windows_like_the_whole_table(monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr(align._Bounds, "ROWS", 4)
    for _ in range(120):
        lines, segments = song(rng, rng.randint(1, 12), rng.choice([2, 6, 20]), rng.choice([0, 0.2, 0.6]))
        assert not segments or align._windows_of_song(lines, segments) == whole_table(lines, segments), (lines, segments)


def test_few_cells_of_a_long_song():
    lines, segments = song(random.Random(3), 400, 45, 0.2)
    x = align._numbered([*lines, *(s[0] for s in segments)])
    seen = []

    def score(i0, i1, j0, j1):
        seen.append((i1, j1))
        return align.likeness(np.concatenate(x[i0:i1]), np.concatenate(x[len(lines) + j0 : len(lines) + j1])) * 2 - 0.8

    band = align._band(align._Bounds(x[: len(lines)], x[len(lines) :]), score)
    cells = len(lines) * len(segments)
    assert sum(map(len, band)) < cells / 50 and len(seen) < cells / 10
