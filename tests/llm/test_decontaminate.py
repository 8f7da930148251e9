import random

import pytest

from tempolyra.llm.decontaminate import MASKS, decontaminate, find_overlaps
from tempolyra.llm.queries import ORACLES, QUERIES
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


def brute(docs, items, least=10):
    out = set()
    for i, t in docs:
        w = (t or "").lower().split()
        for j, u in items:
            v = (u or "").lower().split()
            best = 0
            for shift in range(-len(v), len(w)):
                seeded = any(
                    all(0 <= k + o < len(v) and 0 <= k + o + shift < len(w) and v[k + o] == w[k + o + shift] for o in m)
                    for m in MASKS for k in range(len(v))
                )
                if not seeded:
                    continue
                run = 0
                for k in range(len(v)):
                    if 0 <= k + shift < len(w):
                        run = max(0, run + (1 if v[k] == w[k + shift] else -4))
                        best = max(best, run)
            if len(v) > 4 and best >= min(least, len(v)):
                out.add((i, j, best))
    return sorted(out, key=repr)


def cases():
    rng = random.Random(2)
    vocab = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.choices(vocab, k=rng.randint(3, 30)))) for k in range(12)] + [(90, None), (91, "")]
    docs = [(0, None), (1, ""), (2, "w1"), (None, items[5][1] + " " + items[5][1]), (4, "w1 " * 3000)]
    for k in range(10, 50):
        passage = items[rng.randrange(12)][1].split()
        for _ in range(rng.randint(0, 4)):
            passage[rng.randrange(len(passage))] = "other"
        docs.append((k, " ".join(rng.choices(vocab, k=8)) + "\n " + " ".join(passage).upper() + "\t" + " ".join(rng.choices(vocab, k=8))))
    return docs + docs[-1:], items


@pytest.mark.parametrize("most_broadcast", [1000, 0])
def test_brute_force(spark, most_broadcast):
    docs, items = cases()
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, words int, hash int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = find_overlaps(d, b, most_broadcast=most_broadcast).select("doc_id", "item_id", "overlap").collect()
    want = brute(docs, items)
    assert sorted(map(tuple, got), key=repr) == want and len(want) > 10
    bad = {w[0] for w in want}
    clean = decontaminate(d, b)
    assert clean.columns == d.columns
    assert sorted((r.doc_id for r in clean.collect()), key=repr) == sorted((i for i, _ in docs if i not in bad), key=repr)
    assert find_overlaps(d.limit(0), b).count() == 0 and decontaminate(d, b.limit(0)).count() == len(docs)


def test_oracle(spark):
    compare(QUERIES["op8_decontaminate"](spark, SF), ORACLES["op8_decontaminate"], SF)
