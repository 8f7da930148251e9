import hashlib

import pytest

from tempolyra.llm.exact_dedup import exact_dedup
from tempolyra.llm.queries import ORACLES, QUERIES
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


def brute(rows):
    strip = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
    groups = {}
    for i, t in rows:
        groups.setdefault(strip(t), []).append((-len(t or ""), i is None, i))
    out = []
    for i, t in rows:
        g = groups[strip(t)]
        keep = min(g, key=lambda x: (x[0], x[1], x[2] or 0))[2]
        out.append((i, keep, len(g), i == keep, hashlib.sha256(strip(t).encode()).hexdigest()))
    return sorted(out, key=repr)


ROWS = [(1, "a b"), (2, "ab"), (3, " a b"), (4, None), (5, ""), (6, "x"), (7, "x"), (7, "x"), (8, "é "), (9, "é"), (None, "ab"), (10, "q" * 50000), (11, "q" * 50000 + "\n")]


@pytest.mark.parametrize("digest_bytes", [32, 1, 0])
def test_small(spark, digest_bytes):
    """Short digests make texts collide; byte verification keeps the results the same."""
    df = spark.createDataFrame([(i, t, "z", 1) for i, t in ROWS], "doc_id long, text string, key string, size int")
    got = exact_dedup(df, digest_bytes=digest_bytes, rows_per_salt=2)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(ROWS)


def test_string_ids(spark):
    rows = [("b", "x y"), ("a", "xy"), ("c", "x y"), (None, "x y"), ("z", None)]
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(spark.createDataFrame(rows, "doc_id string, text string"), rows_per_salt=1).collect()}
    assert got == {("b", "b", 4, True), ("a", "b", 4, False), ("c", "b", 4, False), (None, "b", 4, False), ("z", "z", 1, True)}


def test_empty(spark):
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_oracle(spark):
    compare(QUERIES["op10_exact_dedup"](spark, SF), ORACLES["op10_exact_dedup"], SF)
