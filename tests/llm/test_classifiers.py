"""Held-out accuracy on the labelled rows, and defined results for odd input."""

import zlib

import numpy as np
import pytest

from tempolyra.llm.quality import N_STATS, fit_quality, isotonic, keep_quality, score_quality, statistics
from tempolyra.llm.queries import QUERIES
from tempolyra.llm.toxicity import fit_chain, fit_toxicity, score_toxicity

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "x y"), (4, "word " * 40000), (5, "\n")]


@pytest.mark.parametrize("query,label,least", [("op1_quality", "quality", 0.95), ("op4_toxicity", "toxic", 0.93)])
def test_held_out(spark, query, label, least):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = QUERIES[query](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r.predicted == labels[r.doc_id] for r in rows if r.held_out and r.doc_id in labels]
    assert len(held) > 50 and np.mean(held) >= least


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, 1, 2.0) for i, t in ODD], "doc_id long, text string, label int, score double")
    for labels in ([(3, 1, 0), (4, 0, 1), (3, 1, 0), (None, 1, 1), (2, None, None)], [(3, 1, 1)], []):
        lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        q = fit_quality(docs, lab)
        got = score_quality(docs, q).collect()
        assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
        kept = keep_quality(docs, q)
        assert kept.columns == docs.columns and kept.count() == sum(r.score >= 0.5 for r in got)
        assert score_toxicity(docs, fit_toxicity(docs, lab, least=1)).count() == len(ODD)
    none = docs.limit(0)
    assert score_quality(none, fit_quality(none, lab)).count() == 0
    assert score_toxicity(none, fit_toxicity(none, lab)).count() == 0


def test_statistics():
    assert statistics(None) == statistics(b" \n") == [0.0] * N_STATS
    assert len(statistics("é ü 1!".encode())) == N_STATS


def test_isotonic():
    knots, level = isotonic(np.arange(4.0), np.array([0.0, 3, 1, 9]), np.array([10.0, 10, 10, 10]))
    assert (np.diff(level) >= 0).all() and level[1] == level[2] and list(knots) == [0, 1, 2, 3]


def test_chain_feeds_earlier_links():
    rng = np.random.default_rng(1)
    x = np.hstack([rng.normal(size=(600, 3)), np.ones((600, 1))])
    a = (x[:, 0] > 0).astype(float)
    w = fit_chain(x, np.stack([a, a], axis=1))
    assert len(w[1]) == 5 and w[1][0] > 1


def test_toxicity_by_definition(spark):
    """Scores against the chain worked out word by word from the model, and ties in order of the terms."""
    import math

    from tempolyra.llm.toxicity import TERMS, terms_of

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = fit_toxicity(docs, labels)
    assert 1 < len(model.names) == len(model.weights) <= 4 and model.names[-1] == "toxic" and len(model.terms) <= TERMS
    again = fit_toxicity(docs, labels)
    assert again.terms == model.terms and all(np.allclose(a, b) for a, b in zip(model.weights, again.weights))
    got = {r.doc_id: r for r in score_toxicity(docs, model).collect()}
    for r in docs.limit(40).collect():
        held = {t for w in (r.text or "").lower().split() for t in terms_of(w)}
        p = []
        for w in model.weights:
            z = sum(a * b for a, b in zip(p, w)) + sum(w[len(p) + k] for t, k in model.terms.items() if t in held)
            z += w[-2] * math.log1p(len(r.text or "")) / 10 + w[-1]
            p.append(1 / (1 + math.exp(-max(-30, min(30, z)))))
        assert got[r.doc_id].p_toxic == pytest.approx(p[-1]) and [got[r.doc_id].p_links[n] for n in model.names] == pytest.approx(p)


def test_folds_see_no_labels_of_their_own(spark):
    """A term that only one fold's flagged rows hold is no feature of that fold's predictions."""
    from tempolyra.llm.toxicity import FOLDS, _terms

    cells = [0] * FOLDS + [0, 0, 30, 0, 0]
    counts = spark.createDataFrame([("only", cells), ("both", [0] * FOLDS + [9] * FOLDS)], "term string, cells array<bigint>")
    rows = np.array([[50] * FOLDS, [40] * FOLDS])
    assert set(_terms(counts, rows, None, 8)) == {"only", "both"} and _terms(counts, rows, 2, 8) == ["both"]
