"""Hard negatives against all scores, and against SQL."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from tempolyra.llm import negatives, queries
from tests.oracle import compare

SF = "/root/testdata/sf0.01"


def brute(rows, positives=5, negs=10, low=30, high=90, every=100):
    ok = {(i, lab, tuple(v)) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    q = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in sorted(ok)]
    out = []
    for a, lab, v in {i: (i, lab, v) for i, lab, v in reversed(q) if i % every == 0}.values():
        s = {(i, l2, sum(x * y for x, y in zip(v, w))) for i, l2, w in q if i != a}
        pos = sorted({(-x, i) for i, l2, x in s if l2 == lab})[:positives]
        for ps, p in pos:
            fits = sorted({(-x, i) for i, l2, x in s if l2 != lab and low * -ps <= 100 * x <= high * -ps})[:negs]
            out += [(a, p, k, i, -ps, -x) for k, (x, i) in enumerate(fits, 1)]
    return sorted(out)


def clustered(rng, n, d=8):
    centres = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(5)]
    return [(k, [x + rng.gauss(0, 0.1) for x in centres[k % 5]], rng.choice([0, 0, 0, 1, 2])) for k in range(n)]


def test_sql(spark):
    compare(queries.op11_hard_negatives(spark, SF), queries.ORACLES["op11_hard_negatives"], SF)


def test_against_all_scores(spark, monkeypatch):
    rng = random.Random(3)
    rows = clustered(rng, 900)
    rows += [(2000 + k, rows[k % 7][1], k % 2) for k in range(300)]  # many ties
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)
    want = brute(rows, every=10)
    for block, size in ((512, 32 << 20), (7, 2000)):  # one round, and many
        monkeypatch.setattr(negatives, "BLOCK", block)
        monkeypatch.setattr(negatives, "ROUND_BYTES", size)
        got = sorted(tuple(r) for r in negatives.mine_negatives(docs, F.col("vec_id") % 10 == 0).collect())
        assert got == want
    assert len(want) > 1000


def test_bounds_spare_scores():
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 200, (20, 16))
    m = np.floor(np.concatenate([c + rng.normal(0, 4, (200, 16)) for c in centres]))
    order, parent, edge = negatives.spanning_tree(m[:200:2])
    place = np.argsort(order)
    up = [int(place[parent[k]]) if parent[k] >= 0 else -1 for k in order]
    row = {"label": "a", "ids": list(range(100)), "vectors": m[:200:2][order].astype(np.int64).tobytes(), "parent": up, "edge": edge[order].tolist(), "lows": [[600_000]] * 100, "highs": [[900_000]] * 100}
    block = negatives.Block(row, 10)
    block.see(np.arange(1000, 5000), m, np.sqrt((m**2).sum(1)) * (1 + 1e-9))
    assert block.scored < block.met / 5
    for a, best in enumerate(block.best):
        s = m @ m[:200:2][order][a]
        want = sorted((-int(x), k + 1000) for k, x in enumerate(s) if 600_000 <= x <= 900_000)[:10]
        assert [(-int(x), int(i)) for x, i in zip(best[0].score, best[0].id)] == want


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (0, [1.0, 0.5], 1), (1, [0.9, 0.5], 1), (2, [0.5, 0.1], 2), (3, None, 1), (4, [1.0, None], 1), (5, [nan, 1.0], 2), (6, [inf], 2), (None, [1.0, 1.0], 2),
        (8, [1.0, 1.0], None), (9, [], 2), (10, [0.5, 0.1], 2), (10, [0.5, 0.1], 2), (11, [0.5, 0.1, 7.0], 3), (100, [], 1), (200, [-1.0], 2), (300, [nan], 2), (12, [0.3], 1),
    ]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("id", F.lit("x")).withColumn("score", F.lit(0))
    got = sorted(tuple(r) for r in negatives.mine_negatives(docs, F.col("vec_id") % 100 == 0).collect())
    assert got == brute(rows) and (0, 1) in {r[:2] for r in got}
    assert negatives.mine_negatives(docs.limit(0), F.col("vec_id") % 100 == 0).collect() == []
    huge = spark.createDataFrame([(0, [1e300], 1), (1, [1e300], 1), (2, [1e290], 2), (3, [1.0], 2)], "vec_id long, embedding array<double>, label int")
    assert {r.positive_score for r in negatives.mine_negatives(huge, F.col("vec_id") == 0).collect()} <= {(1 << 63) - 1}
