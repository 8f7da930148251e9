"""Quality classifier: random Fourier features over document statistics, ridge regression from
partition-summed normal equations, isotonic calibration.

Fitting reads a bounded sample of labelled rows (most_rows). Each partition adds up its share of the
normal equations; what reaches the driver is `parts` matrices and at most BINS calibration counts,
whatever the input. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import labelled_texts, sample_labels

WAVES = 384
BINS = 3072  # of raw scores from -1 to 2
SEED = 11

_UPPER, _LOWER, _DIGIT = slice(65, 91), slice(97, 123), slice(48, 58)
_MARKS = [c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:?'\"-()"]
_STOPS = [ord(c) for c in ".,;:?'\"-()"]
N_STATS = 20


def statistics(text: bytes | None) -> list[float]:
    """Statistics of one UTF-8 text; an empty text has zeros."""
    text = text or b""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * N_STATS
    bytes_ = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size = len(text)
    share = bytes_ / size
    upper, lower = float(share[_UPPER].sum()), float(share[_LOWER].sum())
    seen = share[share > 0]
    lines = text.split(b"\n")
    pairs = set(zip(words, words[1:]))
    distinct = set(words)
    long_words = max(map(len, distinct))
    return [
        math.log1p(size), math.log1p(n), math.log1p(len(lines)),
        upper, lower, upper / (upper + lower + 1e-9),
        float(share[_DIGIT].sum()), float(share[_MARKS].sum()), float(share[_STOPS].sum()),
        float(share[124]), float(share[128:].sum()), float(share[33]),
        float(-(seen * np.log2(seen)).sum()),
        size / n, math.log1p(long_words),
        len(distinct) / n, math.log(len(distinct)) / math.log(n + 1), (len(pairs) + 1) / n,
        len(set(lines)) / len(lines), n / len(lines) / 100,
    ]


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phase: np.ndarray
    weight: np.ndarray
    knots: np.ndarray
    level: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        """Cosines whose inner products approximate a Gaussian kernel, and a constant."""
        x = np.clip((stats - self.mean) / self.scale, -8, 8)
        z = np.cos(x @ self.waves + self.phase) * math.sqrt(2 / self.waves.shape[1])
        return np.hstack([z, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weight

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.knots, self.level)


def isotonic(x: np.ndarray, total: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over ordered bins: places and never falling levels between 0 and 1."""
    blocks: list[list[float]] = []
    for a, s, k in zip(x, total, n):
        blocks.append([a, a, s, k])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            low = blocks.pop()
            blocks[-1] = [blocks[-1][0], low[1], blocks[-1][2] + low[2], blocks[-1][3] + low[3]]
    knots, level = [], []
    for a, b, s, k in blocks:
        p = (s + 0.5) / (k + 1)  # never quite 0 or 1 from a few rows
        knots += [a, b] if b > a else [a]
        level += [p, p] if b > a else [p]
    return np.array(knots), np.maximum.accumulate(np.array(level))


def fit_quality(
    docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text",
    most_rows: int = 50_000, ridge: float = 1e-4, parts: int = 8,
) -> QualityModel:
    """Learns from at most most_rows labelled rows whose crc32(doc_id) mod 3 is not 1: four in five for
    the ridge scores, the rest for the calibration. Without labelled rows every score is 0.5; with one
    class only it is near that class."""
    sample = sample_labels(labels, label, most_rows)
    stats = (
        labelled_texts(docs, sample, id_col, text_col)
        .mapInArrow(_stats_rows, "id bigint, label int, stats array<double>")
        .persist()
    )
    try:
        sums = stats.agg(F.count(F.lit(1)), *[f(F.col("stats")[k]) for k in range(N_STATS) for f in (F.avg, F.stddev_pop)]).first()
        n = sums[0]
        mean = np.array([x or 0.0 for x in sums[1::2]])
        scale = np.array([x if x and x > 1e-9 else 1.0 for x in sums[2::2]])
        rng = np.random.default_rng(SEED)
        model = QualityModel(
            mean, scale, rng.normal(size=(N_STATS, WAVES)) / math.sqrt(N_STATS / 2), rng.uniform(0, 2 * math.pi, WAVES),
            np.zeros(WAVES + 1), np.array([0.0]), np.array([0.5]),
        )
        if not n:
            return model
        fit = F.pmod(F.xxhash64(F.col("id"), F.lit(5)), F.lit(5)) != 0

        def equations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            a, b = np.zeros((WAVES + 1, WAVES + 1)), np.zeros(WAVES + 1)
            for pdf in batches:
                if len(pdf):
                    z = model.features(np.stack(pdf["stats"].to_numpy()))
                    a += z.T @ z
                    b += z.T @ pdf["label"].to_numpy(float)
            yield pd.DataFrame({"m": [np.vstack([a, b]).tobytes()]})

        total = np.zeros((WAVES + 2, WAVES + 1))
        for row in stats.where(fit).coalesce(parts).mapInPandas(equations, "m binary").toLocalIterator():
            total += np.frombuffer(row.m).reshape(WAVES + 2, WAVES + 1)
        a, b = total[:-1], total[-1]
        model.weight = np.linalg.solve(a + ridge * max(1.0, a[-1, -1]) * np.eye(WAVES + 1), b)

        def bins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    raw = model.raw(np.stack(pdf["stats"].to_numpy()))
                    yield pd.DataFrame({"bin": np.floor((np.clip(raw, -1, 1.999) + 1) * BINS / 3).astype(np.int64), "label": pdf["label"].astype(np.int64)})

        held = stats.where(~fit).mapInPandas(bins, "bin bigint, label bigint").groupBy("bin").agg(F.sum("label").alias("s"), F.count(F.lit(1)).alias("n")).orderBy("bin").collect()
        if held:
            place = np.array([(r.bin + 0.5) * 3 / BINS - 1 for r in held])
            model.knots, model.level = isotonic(place, np.array([float(r.s) for r in held]), np.array([float(r.n) for r in held]))
        else:
            p = float(total[-1, -1] / a[-1, -1])
            model.level = np.array([p])
        return model
    finally:
        stats.unpersist()


def _stats_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        stats = [statistics(t.as_py()) for t in b.column("text").cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([b.column("label_id").cast(pa.int64()), b.column("label"), pa.array(stats, pa.list_(pa.float64()))], ["id", "label", "stats"])


def _scores(model: QualityModel, texts: pa.Array) -> np.ndarray:
    stats = [statistics(t.as_py()) for t in texts.cast(pa.binary())]
    return model.score(np.array(stats).reshape(-1, N_STATS))


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and score, from 0 to 1, of the text alone. Null counts as empty, and
    empty texts are scored like any other. Repeated rows and null ids come back as they are."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_scores(model, b.column(1)), pa.float64())], ["id", "score"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)


def keep_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows, all columns, whose text scores at least `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_scores(model, b.column(text_col)) >= least, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
