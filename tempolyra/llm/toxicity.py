"""Toxicity by a classifier chain.

The labels hold one flag, and a column of the documents (by default the language) says where flagged texts
come from. The chain's earlier links are the flag within each of its most frequent values, `toxic:<value>`,
and the last one is `toxic`, the flag itself. Each link is a linear model over term features and the
probabilities of the links before it; in training those are out-of-fold predictions, so a later link sees
earlier ones as it will find them. The column is read for training only: scores depend on the text alone.

Terms are words and word beginnings, chosen by their association with the flag over a bounded sample of
labelled rows (most_rows); for the out-of-fold predictions of a fold, over the other folds only. Scoring is
one pass without a shuffle, and looks at every word of a text.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .labelled import labelled_texts, sample_labels

#: Most links before the last one.
CATEGORIES = 3
TERMS = 400
STEMS = (4, 5, 6, 7)
FOLDS = 5
_EDGE = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~¡¿«»„“”‘’…"
KEPT_WORDS = 300_000


def terms_of(word: str) -> list[str]:
    """The word without marks around it, and its beginnings."""
    w = word.strip(_EDGE)
    return [w, *(w[:k] + "*" for k in STEMS if len(w) > k)] if w else []


def text_terms(text: str | None) -> set[str]:
    return {t for w in set((text or "").lower().split()) for t in terms_of(w)}


@dataclass
class ToxicityModel:
    names: list[str] = field(default_factory=lambda: ["toxic"])
    terms: dict[str, int] = field(default_factory=dict)
    weights: list[np.ndarray] = field(default_factory=list)
    cache: dict[str, tuple[int, ...]] = field(default_factory=dict, repr=False)

    def found(self, text: str | None) -> set[int]:
        """The terms of the model that a text holds."""
        out: set[int] = set()
        for w in set((text or "").lower().split()):
            hit = self.cache.get(w)
            if hit is None:
                if len(self.cache) >= KEPT_WORDS:
                    self.cache.clear()
                hit = self.cache[w] = tuple(self.terms[t] for t in terms_of(w) if t in self.terms)
            if hit:
                out.update(hit)
        return out

    def rows(self, texts: list[str | None]) -> np.ndarray:
        x = np.zeros((len(texts), len(self.terms) + 2))
        for k, t in enumerate(texts):
            if hit := self.found(t):
                x[k, list(hit)] = 1
            x[k, -2] = math.log1p(len(t or "")) / 10
        x[:, -1] = 1
        return x

    def chain(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the categories, one column each, every link fed with those before it."""
        p = np.zeros((len(x), len(self.names)))
        for k, w in enumerate(self.weights):
            p[:, k] = _sigmoid(np.hstack([p[:, :k], x]) @ w)
        return p


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 12) -> np.ndarray:
    """A linear model by Newton steps with a ridge penalty; the constant is not penalised."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-5:
            break
    return w


def fit_chain(x: np.ndarray, targets: np.ndarray, fold: np.ndarray | None = None, columns: list[np.ndarray] | None = None) -> list[np.ndarray]:
    """Weights of each link; later links are trained with out-of-fold predictions of earlier ones. columns
    names the features that each fold's predictions, and last the links themselves, may use."""
    fold = np.arange(len(x)) % FOLDS if fold is None else fold
    columns = [np.arange(x.shape[1])] * (FOLDS + 1) if columns is None else columns
    before, weights = np.zeros((len(x), 0)), []
    for k in range(targets.shape[1]):
        y, oof = targets[:, k], np.zeros(len(x))
        for f in range(FOLDS):
            if (fold == f).any() and (fold != f).any():
                xf = np.hstack([before, x[:, columns[f]]])
                oof[fold == f] = _sigmoid(xf[fold == f] @ _logistic(xf[fold != f], y[fold != f]))
        weights.append(_logistic(np.hstack([before, x[:, columns[-1]]]), y))
        before = np.hstack([before, oof[:, None]])
    return weights


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads (text, label, fold), gives (term, cells): texts that hold the term by fold, unflagged ones first."""
    seen: list[Counter] = [Counter() for _ in range(2 * FOLDS)]

    def out():
        names = list(set().union(*seen))
        cells = pa.FixedSizeListArray.from_arrays(pa.array([c[t] for t in names for c in seen], pa.int64()), 2 * FOLDS)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), cells.cast(pa.list_(pa.int64()))], ["term", "cells"])

    for b in batches:
        for t, y, f in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()):
            seen[f + FOLDS * int(y != 0)].update(text_terms(t.as_py()))
            if sum(map(len, seen)) > 400_000:
                yield out()
                for c in seen:
                    c.clear()
    yield out()


def _terms(counts: DataFrame, rows: np.ndarray, without: int | None, least: int) -> list[str]:
    """The terms most associated with the flag, over all folds but one. rows: rows by flag and fold."""
    used = [f for f in range(FOLDS) if f != without]
    neg, pos = (float(rows[k, used].sum()) for k in (0, 1))
    a, b = (sum((F.col("cells")[f + FOLDS * k] for f in used), F.lit(0)) for k in (1, 0))
    lift = (F.col("pos") + 0.5) / (pos + 1) / ((F.col("neg") + 0.5) / (neg + 1))
    found = counts.select("term", a.alias("pos"), b.alias("neg")).where((F.col("pos") >= least) & (lift > 1.5))
    return [r.term for r in found.orderBy(F.desc(F.col("pos") * F.log(lift)), "term").limit(TERMS).collect()]


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", group_col: str = "lang",
    most_rows: int = 20_000, least: int = 8,
) -> ToxicityModel:
    """Learns from at most most_rows labelled rows whose crc32(doc_id) mod 3 is not 1. To the driver go the
    TERMS strongest terms of each fold, ties in order of the terms, and the sample's term lists. Where docs
    lacks group_col the chain is its last link. Without labelled rows of both classes, every probability is
    the share of the flag, or 0.5 without rows."""
    group = group_col if group_col in docs.columns else None
    fold = F.pmod(F.xxhash64("label_id", F.lit(3)), F.lit(FOLDS)).cast("int")
    texts = labelled_texts(docs, sample_labels(labels, label, most_rows), id_col, text_col, group).withColumn("fold", fold).persist()
    try:
        rows = np.zeros((2, FOLDS))
        for r in texts.groupBy((F.col("label") != 0).alias("flag"), "fold").count().collect():
            rows[int(r.flag), r.fold] += r["count"]
        neg, pos = rows.sum(axis=1)
        model = ToxicityModel()
        if group:
            flagged = texts.where((F.col("label") != 0) & F.col("group").isNotNull()).groupBy("group").count()
            top = flagged.orderBy(F.desc("count"), "group").limit(CATEGORIES).collect()
            model.names = [*(f"toxic:{r.group}" for r in top), "toxic"]
        if not pos or not neg:
            p = 0.5 if not pos + neg else pos / (pos + neg)
            model.weights = [np.append(np.zeros(k + 1), math.log((p + 1e-3) / (1 - p + 1e-3))) for k in range(len(model.names))]
            return model
        counts = texts.select("text", "label", "fold").mapInArrow(_count_terms, "term string, cells array<bigint>")
        counts = cut(counts.groupBy("term").agg(F.array(*[F.sum(F.col("cells")[k]) for k in range(2 * FOLDS)]).alias("cells")), "term-counts")
        chosen = [_terms(counts, rows, f, least) for f in (*range(FOLDS), None)]
        every = {t: k for k, t in enumerate(dict.fromkeys(t for terms in chosen[::-1] for t in terms))}  # those of the model first
        found = ToxicityModel(terms=every)

        def lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                hit = [sorted(found.found(t)) for t in pdf["text"]]
                yield pdf.drop(columns="text").assign(n=[len(t or "") for t in pdf["text"]], hit=hit)

        shape = "label_id bigint, label int, fold int, group string, n bigint, hit array<int>"
        plain = texts.select("label_id", "text", "label", "fold", F.col("group") if group else F.lit(None).cast("string").alias("group"))
        got = plain.select("label_id", "label", "fold", "group", "text").mapInPandas(lists, shape).orderBy(F.xxhash64("label_id"), "label_id", "label", "n").toPandas()
        x = np.zeros((len(got), len(every) + 2))
        for k, hit in enumerate(got["hit"]):
            x[k, list(hit)] = 1
        x[:, -2], x[:, -1] = np.log1p(got["n"]) / 10, 1
        columns = [np.array([*(every[t] for t in terms), len(every), len(every) + 1]) for terms in chosen]
        y = (got["label"] != 0).to_numpy(float)
        within = [y * (got["group"] == name.partition(":")[2]).to_numpy(float) for name in model.names[:-1]]
        model.terms = {t: k for k, t in enumerate(chosen[-1])}
        model.weights = fit_chain(x, np.stack([*within, y], axis=1), got["fold"].to_numpy(), columns)
        return model
    finally:
        texts.unpersist()


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, p_toxic, and p_links, a map from each link of the chain to its probability.
    Null counts as empty, and empty texts are scored like any other. Repeated rows and null ids come back as
    they are. Other columns are ignored."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                p = model.chain(model.rows(b.column(1).to_pylist()))
                links = pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), len(model.names)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p[:, -1]), links], ["id", "p_toxic", "links"])

    scored = rows.mapInArrow(run, f"id {kind}, p_toxic double, links array<double>")
    return scored.select(F.col("id").alias(id_col), "p_toxic", F.map_from_arrays(F.array(*map(F.lit, model.names)), "links").alias("p_links"))
