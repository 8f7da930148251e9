import hashlib
import random
import tracemalloc
from collections import Counter

import pyarrow as pa
import pytest

import tempolyra.llm.suffix_dedup as suffix_dedup
from tempolyra.llm.queries import QUERIES
from tempolyra.llm.suffix_dedup import LENGTH, blocks, remove_repeats


def brute(texts):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[k : k + LENGTH] for r in raw for k in range(len(r) - LENGTH + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for k in range(len(r) - LENGTH + 1):
            if seen[r[k : k + LENGTH]] > 1:
                gone[k : k + LENGTH] = b"\1" * LENGTH
        kept = bytes(b for b, g in zip(r, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(r), sum(gone), spans, kept))
    return out


def corpus():
    rng = random.Random(8)
    prose = lambda n: "".join(rng.choices("abcde é\n", k=n))
    passages = [prose(k) for k in (150, 199, 200, 201, 260, 420)]
    texts = [None, "", "short", "a" * 199, "a" * 200, "ab" * 150, "x" * 700, prose(900)]
    texts += [texts[-1], texts[-1] + "!", passages[5] + passages[5]]
    for k in range(40):
        t = prose(rng.randint(0, 400))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(60) if rng.random() < 0.3 else 0
            t += p[a:] + prose(rng.randint(0, 150))
        texts.append(t)
    base = prose(1500)
    for k in range(25):  # near copies of one text
        t = list(base)
        for _ in range(3):
            t[rng.randrange(len(t))] = "#"
        texts.append("".join(t))
    return texts


@pytest.mark.parametrize("most_kinds", [5000, 2])
def test_brute_force(spark, most_kinds):
    texts = corpus()
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in enumerate(texts)], "doc_id long, text string, th int, start int")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeats(df, most_kinds=most_kinds).collect()}
    for k, want in enumerate(brute(texts)):
        assert got[k] == want, (k, got[k][:3], want[:3])


def test_segments(monkeypatch):
    """A text's blocks cover its windows once, whatever the segment."""
    import tempolyra.llm.suffix_dedup as m

    text = random.Random(1).randbytes(5000)
    for segment in (1 << 19, 333):
        monkeypatch.setattr(m, "SEGMENT", segment)
        covered = [k for lo, hi, *_ in blocks(text) for a, z in zip(lo, hi) for k in range(a, z + 1)]
        assert covered == list(range(len(text) - LENGTH + 1))


def test_odd_rows(spark):
    p = "".join(random.Random(3).choices("abcdefgh", k=300))
    rows = [(1, p), (1, p), (None, p + "tail"), (None, None), (2, p[:250] * 2), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeats(df).collect()), key=repr)
    assert got == sorted(((i, *w) for (i, _), w in zip(rows, brute([t for _, t in rows]))), key=repr)
    assert remove_repeats(df.limit(0)).count() == 0


def test_colliding_digests(spark, monkeypatch):
    """Windows of one digest are told apart by their bytes."""
    import numpy as np

    import tempolyra.llm.suffix_dedup as m

    rng = random.Random(4)
    data = np.frombuffer(bytes(rng.choices(b"ab", k=900)) + bytes(rng.choices(b"ab", k=900)) * 2, np.uint8)
    start = np.arange(len(data) - LENGTH)
    seen = Counter(data[k : k + LENGTH].tobytes() for k in start)
    want = [seen[data[k : k + LENGTH].tobytes()] > 1 for k in start]
    for digest in (np.zeros(len(start), np.uint64), (start % 900 % 7).astype(np.uint64)):
        assert m._again(data, start, digest).tolist() == want


def test_long_periods(spark):
    """Texts of some megabytes, of one period each, and one that holds such a stretch."""
    rng = random.Random(5)
    period = "".join(rng.choices("abcdefgh", k=311))
    head = "".join(rng.choices("abcdefgh", k=500))
    texts = ["a" * 3_000_000, "abc" * 700_000, period * 7000, head + "xyz" * 300_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans, len(r.kept)) for r in remove_repeats(df).collect()}
    assert [got[k][:2] for k in range(3)] == [(len(t), 1) for t in texts[:3]]
    assert got[3][:2] == (900_000, 1) and got[3][2] == 500


def test_query(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op6_suffix_dedup"](spark, d).collect()}
    assert len(got) == len(docs)
    for r, w in zip(docs, brute([r.text for r in docs])):
        assert got[r.doc_id] == (*w[:3], hashlib.sha256(w[3]).hexdigest()), r.doc_id


def test_memory_of_workers():
    """What a Python worker holds besides its batches is bounded: a long text's blocks, and the comparison of many blocks."""
    import tempolyra.llm.suffix_dedup as m

    rng = random.Random(4)
    text = rng.randbytes(3_000_000)
    n = 20_000
    cols = [[k // 4 for k in range(n)], list(range(n)), [1] * n, [80] * n, [rng.randbytes(280) for _ in range(n)]]
    kinds = pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == 4 else pa.int64()) for k, c in enumerate(cols)], ["gram", "around", "n", "at", "bytes"])
    m.Digests.power = m.Digests.inverse = m.Digests.power[:0]
    for run in (lambda: [len(b[0]) for b in blocks(text)], lambda: [b.num_rows for b in m._compare(iter([kinds]))]):
        tracemalloc.start()
        run()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 30_000_000


def test_single_blocks_stay_and_texts_move_once(spark, monkeypatch):
    """Blocks that stand once are not grouped with their surroundings, and hot blocks do not move the texts again."""
    made = {}

    def cut(df, label, **options):
        made[label] = real(df, label, **options)
        return made[label]

    real = suffix_dedup.cut
    monkeypatch.setattr(suffix_dedup, "cut", cut)
    rng = random.Random(12)
    prose = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    passage = prose(400)
    texts = [prose(1500) for _ in range(40)] + [prose(300) + passage + prose(300) for _ in range(4)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), most_kinds=2).collect()}
    assert [got[k] for k in range(len(texts))] == brute(texts)
    assert made["blocks"].count() > 600
    assert made["kinds"].count() < 60
    assert made["surroundings"].where("hot").count() > 0
