"""Periodic runs against all periods tried at all places."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempolyra.llm import periodic, queries

SF = "/root/testdata/sf0.001"


def brute(w, least=24, times=3):
    n, out = len(w), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                out.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, length, q) for (s, length), q in out.items())


def made_up(rng):
    a, w = rng.choice([1, 2, 3, 6, 50]), []
    while len(w) < rng.randint(0, 260):
        if rng.random() < 0.5:
            w += [rng.randint(0, a) for _ in range(rng.randint(1, 20))]
        else:
            p = [rng.randint(0, a) for _ in range(rng.randint(1, 30))]
            w += (p * 8)[: int(len(p) * (1 + 6 * rng.random()))]
    return w


def test_lyndon_arrays():
    rng = random.Random(1)
    for _ in range(300):
        w = [rng.randint(0, rng.choice([1, 2, 4])) for _ in range(rng.randint(1, 20))]
        for sign in (1, -1):
            x = [sign * v for v in w]
            want = [max(j - i for j in range(i + 1, len(x) + 1) if all(x[i:j] < x[k:j] for k in range(i + 1, j))) for i in range(len(x))]
            assert periodic.lyndon_array(np.array(w), sign < 0).tolist() == want


def test_all_runs():
    rng, n = random.Random(2), 0
    for _ in range(400):
        docs = [made_up(rng) for _ in range(rng.randint(1, 4))]
        found = periodic._runs_of_batch([[b"%d" % x for x in w] for w in docs], 24, 3)
        for w, got in zip(docs, found):
            n += len(got)
            assert [tuple(r) for r in got.tolist()] == brute(w)
            assert [tuple(r) for r in periodic.runs_of(np.array(w, np.int64), 2, 2).tolist()] == brute(w, 2, 2)
    assert n > 500


def contract(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)),
    )


def test_query_whole_table(spark):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op13_periodic_runs(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert got == {d.doc_id: contract(d.doc_id, d.text) for d in docs}
    assert sum(r[0] > 0 for r in got.values()) > 5


def test_odd_rows(spark):
    run = "x y z " * 20
    rows = [(1, None), (2, ""), (None, run), (3, "a" * 50_000), (4, "é " * 30 + "\x85　 end"), (5, run), (5, run), (6, "a b " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit(1)).withColumn("id", F.lit("clash"))
    got = sorted(((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.find_runs(docs).collect()), key=repr)
    assert got == sorted(
        [(1, 0, [], ""), (2, 0, [], ""), *[(i, 60, [(0, 60, 3)], "x y z") for i in (0, 5, 5)], (3, 1, [], "a" * 50_000),
         (4, 32, [(0, 30, 1)], "é \x85　 end"), (6, 60_000, [(0, 60_000, 2)], "a b")], key=repr)
    assert periodic.find_runs(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        periodic.find_runs(docs, least=10)


def test_fold(spark):
    docs = spark.createDataFrame([(1, " ".join(map(str, range(40))))], "doc_id long, text string")
    fold = F.struct(F.lit(4).cast("long").alias("start"), F.lit(5).cast("long").alias("period"))
    (row,) = periodic.find_runs(docs, fold=fold).collect()
    assert [tuple(x) for x in row.runs] == [(4, 36, 5)] and row.collapsed == "0 1 2 3 4 5 6 7 8"
