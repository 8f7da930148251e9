import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tempolyra.llm import lm
from tempolyra.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute_base(docs):
    """docs: {id: text}. (held_out, n_tokens, n_known, train_tokens, base_score) by plain counting."""
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    words = {i: [*(t or "").encode().lower().split(), b""] for i, t in docs.items()}
    c = Counter(w for i, ws in words.items() if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    return {i: (held(i), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in words.items()}


@pytest.mark.parametrize("most_head", [1, 50, 80_000])
def test_base_and_gain(spark, most_head):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute_base({r.doc_id: r.text for r in docs.collect()})
    rows = lm.lm_scores(docs, most_head=most_head).collect() if most_head < 80_000 else QUERIES["op2_lm"](spark, SF).collect()
    assert len(rows) == len(want)
    for r in rows:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert r.base_score == pytest.approx(w[4], rel=1e-9)
        assert r.score < 0
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_probabilities_add_up():
    """Over all units, and within a class over its words and one unknown word."""
    rng = np.random.default_rng(0)
    values, noise = lm.Network.start(rng.integers(1, 100, lm.UNITS).astype(float))
    net = lm.Network({k: v + rng.normal(0, 0.3, v.shape) for k, v in values.items()}, noise)
    a, b, z = (x.astype(float) for x in net.tables())
    for h1, h2 in rng.integers(0, lm.UNITS, (20, 2)):
        assert (10 ** (a[h1] + b[h2] - z[h1, h2])).sum() == pytest.approx(1, abs=1e-4)
    words = [f"word{k}".encode() for k in range(3000)]
    cls = np.array([lm.class_of(w) for w in words])
    head = lm.UNITS - lm.CLASSES - 1
    n = np.bincount(cls[head:], minlength=lm.CLASSES) * 2.0
    vocab = lm.Vocabulary(words, [2] * 3000, n, n / 2, 6001, 3001)
    place, unit, _, inner = vocab.tables()
    for k in range(lm.CLASSES):
        mine = [10 ** inner[place[w]] for w in words if unit[place[w]] == lm.UNITS - lm.CLASSES + k]
        assert sum(mine) + 10 ** -vocab.inner_log()[k] == pytest.approx(1)


def test_class_matches_spark(spark):
    words = [b"a", b"ab", "é".encode(), b"long-word", "größe".encode()]
    got = spark.createDataFrame([(w,) for w in words], "word binary").selectExpr(f"pmod(crc32(substring(word, -{lm.TAIL}, {lm.TAIL})), {lm.CLASSES}) AS k").collect()
    assert [r.k for r in got] == [lm.class_of(w) for w in words]


def test_few_long_texts(spark):
    """The end mark counts although all words share one count and are more than the head takes."""
    rows = [(1, " ".join(f"w{k}" for k in range(90_000))), (4, "w1 w2")]
    got = lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_base(dict(rows))
    for r in got:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert r.base_score == pytest.approx(want[r.doc_id][4], rel=1e-12)


def test_score_by_definition(spark):
    """The score against a softmax over all units, word by word, from the parameters themselves."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    texts = docs.where(lm.crc_mod(docs.doc_id, 7) != 2).select("text")
    counts = lm.count_words(texts)
    vocab = lm.vocabulary(counts)
    p = {k: v.astype(float) for k, v in lm.train(texts, vocab).p.items()}
    c = {bytes(r.word): r.c for r in counts.collect()}
    single = {w: k + 1 for k, w in enumerate(vocab.words[: lm.UNITS - lm.CLASSES - 1])}
    size = Counter()
    for w, n in c.items():
        if w and w not in single:
            size[lm.class_of(w)] += n + 1
    want = {}
    for r in docs.collect():
        u1 = u2 = 0
        total = 0.0
        for w in [*lm.tokens((r.text or "").encode()), None]:
            k = None if w is None or w in single else lm.class_of(w)
            unit = 0 if w is None else single[w] if k is None else lm.UNITS - lm.CLASSES + k
            z = (p["r"][u1] @ p["c1"] + p["r"][u2] @ p["c2"]) @ p["t"].T + p["b"]
            total += (z[unit] - z.max() - np.log(np.exp(z - z.max()).sum())) / np.log(10)
            if k is not None:
                total += math.log10((c.get(w, 0) + 1) / (size[k] + 1))
            u1, u2 = unit, u1
        want[r.doc_id] = total
    got = {r.doc_id: r.score for r in lm.lm_scores(docs).collect()}
    assert got.keys() == want.keys()
    for i in got:
        assert got[i] == pytest.approx(want[i], rel=2e-3)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "A b A"), (4, "zzz"), (None, "a"), (5, "w " * 50000), (6, "\x1f é")]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, word int, n int")
    want = brute_base(dict(rows))
    got = lm.lm_scores(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert r.base_score == pytest.approx(want[r.doc_id][4])
    assert lm.lm_scores(df.unionAll(df)).count() == len(rows)
    assert lm.lm_scores(df.limit(0)).count() == 0
