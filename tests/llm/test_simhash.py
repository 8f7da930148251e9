import random

import numpy as np
import pytest
import xxhash

from tempolyra.llm.components import components
from tempolyra.llm.queries import QUERIES
from tempolyra.llm.simhash import fingerprint, gray_rank, keep_first_of_group, links, simhash_dedup


def brute_fp(text):
    w = [x for x in "".join(c.lower() if c.isascii() else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if x]
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << k for k in range(64) if sum(x >> k & 1 for x in h) * 2 > len(h))


def brute_components(rows):
    """rows: (id, fp). The smallest id reachable."""
    fps = sorted({f for _, f in rows})
    up = {f: f for f in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                up[find(a)] = find(b)
    least = {}
    for i, f in rows:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return sorted(((i, f"{f:016x}", least.get(find(f))) for i, f in rows), key=repr)


def test_fingerprint():
    rng = random.Random(5)
    for _ in range(300):
        t = "".join(rng.choice(["a", "B", "é", "É", "\x1f", "\xa0", " ", "\n", "\x0b", "the "]) for _ in range(rng.randint(0, 40)))
        assert fingerprint(t.encode()) == brute_fp(t), repr(t)
    assert fingerprint(None) == 0


def test_gray_rank():
    g = np.arange(4096, dtype=np.uint64)
    assert np.array_equal(gray_rank(g ^ (g >> np.uint64(1))), g)


@pytest.mark.parametrize("held", [1 << 20, 50])
def test_index_against_all_pairs(monkeypatch, held):
    """Buckets of one to hundreds of fingerprints, near and far ones, under different limits."""
    import tempolyra.llm.simhash as m

    monkeypatch.setattr(m, "HELD", held)
    rng = np.random.default_rng(3)
    size = np.array([1, 2, 3, 8, 9, 64, 65, 400, 1, 7])
    bucket = np.repeat(np.arange(len(size)) * 5, size)
    center = rng.integers(0, 1 << 63, len(size), np.uint64)[bucket // 5]
    fps = center ^ (np.uint64(1) << rng.integers(0, 64, len(bucket), np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, len(bucket), np.uint64))
    for most in (0, 2, 3, 7):
        index = m.GrayIndex(bucket, fps)
        got = sorted((int(a), int(b)) for i, j in index.near(most) for a, b in zip(i, j))
        x, of = index.fps, index.bucket
        want = [(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if of[i] == of[j] and int(x[i] ^ x[j]).bit_count() <= most]
        assert got == want


@pytest.mark.parametrize("most_in_bucket", [50_000, 5])
def test_links_lose_nothing(spark, most_in_bucket):
    """Clusters of near fingerprints, chains, hot blocks."""
    rng = random.Random(7)
    fps = {0, (1 << 64) - 1}
    for _ in range(40):
        c = rng.getrandbits(64)
        for _ in range(rng.randint(1, 30)):
            f = c
            for _ in range(rng.randint(0, 5)):
                f ^= 1 << rng.randrange(64)
            fps.add(f)
    base = rng.getrandbits(64)
    for _ in range(300):  # share three blocks
        fps.add(base & ~0xFFFF | rng.getrandbits(16))
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    root = {r.node: r.root for r in components(links(df, most_in_bucket=most_in_bucket)).collect()}
    got = {}
    for f in fps:
        got.setdefault(root.get(signed(f), signed(f)), set()).add(f)
    want = {}
    for i, _, c in brute_components([(f, f) for f in fps]):
        want.setdefault(c, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_frame(spark):
    rows = [(5, "a b c d"), (3, "A  B c D"), (3, "A  B c D"), (9, None), (8, ""), (None, " "), (None, "only one"), (1, "w " * 30000)]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, fp int, root int")
    got = sorted(((r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in simhash_dedup(df).collect()), key=repr)
    assert got == brute_components([(i, brute_fp(t)) for i, t in rows])
    assert simhash_dedup(df.limit(0)).count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, brute_fp(r.text)) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in QUERIES["op3_simhash"](spark, d).collect()]
    assert sorted(got, key=repr) == brute_components(rows)


def test_one_of_each_group_stays(spark):
    rows = [(5, "a b c d", "p"), (3, "a b c d", "q"), (3, "A b c  d", "r"), (3, "a b c d", "s"), (9, None, "t"), (8, "", "u"), (None, "x y", "v"), (None, "x y", "w"), (7, "alone here now", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, root string")
    got = sorted(((r.doc_id, (r.text or "").lower().split(), r.root) for r in keep_first_of_group(df).collect()), key=repr)
    assert [(i, w) for i, w, _ in got] == sorted([(3, "a b c d".split()), (8, []), (None, ["x", "y"]), (7, "alone here now".split())], key=repr)
    assert keep_first_of_group(df.limit(0)).count() == 0
