"""Language-model scoring by a log-bilinear neural model, trained with noise-contrastive estimation.

The model predicts a unit from the two units before it: q = C1 r(u1) + C2 r(u2), score of unit w =
q . t(w) + b(w). Units are the most frequent words, the end of a text, and classes that hold all other
words by the digest of their last letters. P(word) = P(unit | context) * P(word | unit); within a class a
word has its smoothed share, so probabilities over all words and one unknown word a class add up to 1.
Because a context is two units, matrix products give every context's normaliser once, after training;
scoring a token is then a few table look-ups.

Everything is gathered from all training documents: token counts exactly, and the network's gradients
from every token of every document once, by rounds of local training whose parameters Spark averages.
Each round takes the documents of one remainder of the text's hash. Counts of the most frequent words go
to every worker (most_head words, a fixed size); all rarer words meet their counts in a shuffle, which no
single word can dominate since frequent ones are not in it.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, cut

UNITS, CLASSES, DIM, NOISE = 768, 160, 24, 48
END = b""  # no word is empty
TAIL = 4  # bytes of a word's end that choose its class
BATCH = 2048
HELD = 1 << 18  # tokens that are shuffled among each other before they become batches


def tokens(text: bytes | None) -> list[bytes]:
    """Words between white space with A-Z in lower case."""
    return (text or b"").lower().split()


def class_of(word: bytes) -> int:
    return zlib.crc32(word[-TAIL:]) % CLASSES


def count_words(texts: DataFrame) -> DataFrame:
    """Exact counts (word binary, c) of the texts' tokens, the end of each text included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["word", "c"])

        for b in batches:
            for t in b.column(0).cast(pa.binary()):
                seen.update(tokens(t.as_py()))
                seen[END] += 1
                if len(seen) > 400_000:
                    yield out()
                    seen.clear()
        yield out()

    return texts.mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """Counts of the head, and totals; its size is fixed by most_head and CLASSES."""

    words: list[bytes]  # head words, most frequent first
    counts: list[int]
    class_n: np.ndarray  # occurrences of the words in each class, and how many words
    class_v: np.ndarray
    total: int
    distinct: int
    end: int = 0  # count of the end mark, which is not among the words

    def tables(self) -> tuple[dict[bytes, int], np.ndarray, np.ndarray, np.ndarray]:
        """Place of each head word; by place: its unit, log10(c + 1), log10 P(word | unit)."""
        words, c = self.words, self.counts
        singles = UNITS - CLASSES - 1
        unit = [k + 1 if k < singles else UNITS - CLASSES + class_of(w) for k, w in enumerate(words)]
        log_c = np.log10(np.array(c, float) + 1)
        inner = np.where(np.array(unit) < UNITS - CLASSES, 0.0, log_c - self.inner_log()[np.maximum(np.array(unit) - (UNITS - CLASSES), 0)]) if words else log_c
        return {w: k for k, w in enumerate(words)}, np.array(unit, np.int64), log_c, inner

    def inner_log(self) -> np.ndarray:
        """log10 of what a class's counts are divided by: every word, and one unknown word, has one more."""
        return np.log10(self.class_n + self.class_v + 1.0)


def vocabulary(counts: DataFrame, most_head: int = 80_000) -> Vocabulary:
    # the least count that at most most_head words reach, found from a histogram of a few hundred steps
    step = F.floor(F.log2("c") * 8).cast("int")
    least, seen = None, 0
    words_only = counts.where(F.length("word") > 0)
    for r in words_only.groupBy(step.alias("k")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("k")).collect():
        seen += r.n
        if seen > most_head:
            break
        least = r.k
    head = words_only.where(step >= least).collect() if least is not None else []
    head.sort(key=lambda r: (-r.c, bytes(r.word)))
    words = [bytes(r.word) for r in head]
    singles = words[: UNITS - CLASSES - 1]
    cls = F.pmod(F.crc32(F.expr(f"substring(word, -{TAIL}, {TAIL})")), F.lit(CLASSES))
    class_n, class_v = np.zeros(CLASSES), np.zeros(CLASSES)
    total = distinct = end = 0
    for r in counts.groupBy(F.when(F.length("word") > 0, cls).alias("k")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        total, distinct = total + r.n, distinct + r.v
        if r.k is None:
            end = r.n
        else:
            class_n[r.k], class_v[r.k] = r.n, r.v
    by = {bytes(r.word): r.c for r in head}
    for w in singles:
        class_n[class_of(w)] -= by[w]
        class_v[class_of(w)] -= 1
    return Vocabulary(words, [r.c for r in head], class_n, class_v, total, distinct, end)


class Encoder:
    """A worker's look-up tables."""

    def __init__(self, vocab: Vocabulary):
        self.place, unit, log_c, inner = vocab.tables()
        pad = lambda a, x: np.append(a, x)  # noqa: E731  the last place stands for words outside the head
        self.unit, self.log_c, self.inner = pad(unit, 0), pad(log_c, 0.0), pad(inner, 0.0)
        self.inner_log = vocab.inner_log()

    def units(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Units of a text with its end; places in the head (-1: not there); the words not there."""
        at = np.array([self.place.get(w, -1) for w in words], np.int64)
        unit = np.zeros(len(words) + 1, np.int64)
        unit[:-1] = self.unit[at]
        rare = np.nonzero(at < 0)[0]
        rest = [words[k] for k in rare]
        unit[rare] = [UNITS - CLASSES + class_of(w) for w in rest]
        return unit, at, rest


def contexts(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two units before each; before a text stands its end mark, unit 0."""
    return np.concatenate([[0], unit[:-1]]), np.concatenate([[0, 0], unit[:-2]])[: len(unit)]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, np.float32(-30), np.float32(30))))


def _add(to: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """to[at] += rows, with all rows of a place added up."""
    order = np.argsort(at.astype(np.uint16), kind="stable")
    places = at[order]
    first = np.nonzero(np.concatenate([[True], places[1:] != places[:-1]]))[0]
    to[places[first]] += np.add.reduceat(rows[order], first, axis=0)


class Network:
    """Log-bilinear parameters and noise-contrastive steps."""

    SHAPES = {"r": (UNITS, DIM), "t": (UNITS, DIM), "c1": (DIM, DIM), "c2": (DIM, DIM), "b": (UNITS,)}

    def __init__(self, values: dict[str, np.ndarray], noise: np.ndarray):
        self.p = {k: v.astype(np.float32).copy() for k, v in values.items()}
        self.g = {k: np.full_like(v, 0.1) for k, v in self.p.items()}
        self.cdf, self.log_kn = np.cumsum(noise), np.log(NOISE * noise).astype(np.float32)

    @staticmethod
    def start(unit_counts: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        share = (unit_counts + 1.0) / (unit_counts + 1.0).sum()
        rng = np.random.default_rng(5)
        p = {k: rng.normal(0, 0.1, s) for k, s in Network.SHAPES.items()}
        p["c1"], p["c2"], p["b"] = np.eye(DIM) * 0.6, np.eye(DIM) * 0.3, np.log(share)
        return {k: v.astype(np.float32) for k, v in p.items()}, share

    def step(self, h1: np.ndarray, h2: np.ndarray, w: np.ndarray, rng: np.random.Generator, rate: float) -> None:
        """One batch: tell the words that came from NOISE words drawn once for the whole batch."""
        p, n = self.p, len(w)
        noise = np.searchsorted(self.cdf, rng.random(NOISE) * self.cdf[-1])
        log_kn = self.log_kn
        r1, r2 = p["r"][h1], p["r"][h2]
        q = r1 @ p["c1"] + r2 @ p["c2"]
        tw, tn = p["t"][w], p["t"][noise]
        e_w = _sigmoid((q * tw).sum(1) + p["b"][w] - log_kn[w]) - 1  # gradient of the loss by the score
        e_n = _sigmoid(q @ tn.T + (p["b"][noise] - log_kn[noise]))
        dq = e_w[:, None] * tw + e_n @ tn
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        _add(grad["t"], w, e_w[:, None] * q)
        np.add.at(grad["t"], noise, e_n.T @ q)
        grad["b"] += np.bincount(w, e_w, UNITS).astype(np.float32)
        np.add.at(grad["b"], noise, e_n.sum(0))
        grad["c1"], grad["c2"] = r1.T @ dq, r2.T @ dq
        _add(grad["r"], h1, dq @ p["c1"].T)
        _add(grad["r"], h2, dq @ p["c2"].T)
        for k, g in grad.items():
            g /= n
            self.g[k] += g * g * n
            p[k] -= rate * g * np.float32(np.sqrt(n)) / np.sqrt(self.g[k])

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 tables: score of w after u1, score of w after u2, normaliser of (u1, u2).
        Normalisers come from batched products over all pairs of units."""
        p = {k: v.astype(np.float64) for k, v in self.p.items()}
        a = p["r"] @ p["c1"] @ p["t"].T + p["b"]
        b = p["r"] @ p["c2"] @ p["t"].T
        ea = np.exp(a - a.max(1, keepdims=True))
        eb = np.exp(b - b.max(1, keepdims=True))
        z = np.log(np.maximum(ea @ eb.T, 1e-300)) + a.max(1)[:, None] + b.max(1)[None, :]
        return tuple((x / np.log(10)).astype(np.float32) for x in (a, b, z))


@lru_cache(2)
def _encoder(key: str) -> Encoder:
    return Encoder(_vocab_by_key[key])


_vocab_by_key: dict[str, Vocabulary] = {}


def _local(key: str, shared) -> Encoder:
    """The worker's tables for a broadcast vocabulary, built once."""
    if key not in _vocab_by_key:
        _vocab_by_key.clear()
        _vocab_by_key[key] = shared.value
    return _encoder(key)


def train(texts: DataFrame, vocab: Vocabulary, rounds: int = 3, rate: float = 0.1) -> Network:
    """Local training over each partition's documents, then averages weighted by tokens, `rounds` times;
    each document takes part in one round. The driver gets one set of parameters a round. Parameters
    depend a little on how documents lie in partitions."""
    spark = texts.sparkSession
    shared, key = spark.sparkContext.broadcast(vocab), uuid.uuid4().hex
    counts = np.zeros(UNITS)
    singles = UNITS - CLASSES - 1
    counts[1 : 1 + min(singles, len(vocab.counts))] = vocab.counts[:singles]
    counts[0], counts[UNITS - CLASSES :] = vocab.end, vocab.class_n
    values, noise = Network.start(counts)
    for k in range(rounds):
        chosen = texts.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == k)
        given, step_rate = spark.sparkContext.broadcast(values), rate / (k + 1)

        def run(batches: Iterator[pa.RecordBatch], given=given, step_rate=step_rate) -> Iterator[pa.RecordBatch]:
            enc, net, rng, seen = _local(key, shared), Network(given.value, noise), np.random.default_rng(9), 0
            held: list[tuple[np.ndarray, ...]] = []
            size = 0

            def flush():
                h1, h2, w = (np.concatenate(x) for x in zip(*held))
                order = rng.permutation(len(w))
                for at in range(0, len(w), BATCH):
                    i = order[at : at + BATCH]
                    net.step(h1[i], h2[i], w[i], rng, step_rate)
                held.clear()

            for b in batches:
                for t in b.column(0).cast(pa.binary()):
                    unit = enc.units(tokens(t.as_py()))[0]
                    held.append((*contexts(unit), unit))
                    size, seen = size + len(unit), seen + len(unit)
                    if size >= HELD:
                        flush()
                        size = 0
            if held:
                flush()
            if seen:
                flat = np.concatenate([net.p[k].ravel() for k in Network.SHAPES]).astype(np.float64)
                for at in range(0, len(flat), 1024):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.arange(at, min(len(flat), at + 1024))), pa.array(flat[at : at + 1024] * seen), pa.array(np.full(len(flat[at : at + 1024]), float(seen)))],
                        ["k", "v", "n"],
                    )

        mean = chosen.mapInArrow(run, "k bigint, v double, n double").groupBy("k").agg((F.sum("v") / F.sum("n")).alias("v")).orderBy("k").toPandas()
        given.destroy()
        if len(mean):
            flat, at = mean["v"].to_numpy(), 0
            for name, shape in Network.SHAPES.items():
                n = int(np.prod(shape))
                values[name], at = flat[at : at + n].reshape(shape).astype(np.float32), at + n
    return Network(values, noise)


def lm_scores(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: tuple[int, int] = (7, 2),
    most_head: int = 80_000, rounds: int = 3,
) -> DataFrame:
    """One row per id: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the documents whose crc32(id) leaves another remainder than held_out[1] by held_out[0].
    base_score is the smoothed unigram score, score the model's log10 probability of the whole text and
    its end. Null and empty texts hold the end only. Rows that share an id are taken as one document and
    their figures add up; null ids are one document too. Other columns are ignored. Without training
    documents every unit is equally likely. The score depends a little on how documents lie in partitions
    (see train); all other columns do not.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = rows.where(crc_mod(F.col("id"), held_out[0]) != held_out[1]).select("text")
    counts = cut(count_words(texts), "word-counts")
    vocab = vocabulary(counts, most_head)
    tables = train(texts, vocab, rounds).tables()
    spark = docs.sparkSession
    shared, given, key = spark.sparkContext.broadcast(vocab), spark.sparkContext.broadcast(tables), uuid.uuid4().hex
    base_log = float(np.log10(vocab.total + vocab.distinct + 1))
    end_log, end_known = float(np.log10(vocab.end + 1)), int(vocab.end > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, (a, b_, z) = _local(key, shared), given.value
        for batch in batches:
            ids, out = batch.column(0), []
            for k, t in enumerate(batch.column(1).cast(pa.binary())):
                words = tokens(t.as_py())
                unit, at, rest = enc.units(words)
                h1, h2 = contexts(unit)
                logp = (a[h1, unit] + b_[h2, unit] - z[h1, h2]).sum(dtype=np.float64)
                known = at[at >= 0]
                base = enc.log_c[known].sum() + end_log - base_log * len(unit)
                score = logp + enc.inner[known].sum() - sum(enc.inner_log[class_of(w)] for w in rest)
                out.append((k, None, 1, len(unit), len(known) + end_known, base, score))
                out += [(k, w, n, 0, 0, 0.0, 0.0) for w, n in Counter(rest).items()]
                if len(out) > 20_000:
                    yield _parts(ids, out)
                    out = []
            yield _parts(ids, out)

    kind = rows.schema["id"].dataType.simpleString()
    parts = rows.mapInArrow(run, f"id {kind}, word binary, n bigint, n_tokens bigint, n_known bigint, base double, score double")
    # rows of a document itself get a key that no word has, one for each document
    key_col = F.coalesce("word", F.concat(F.lit(b"\n"), F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")))
    rare = counts.select(F.col("word").alias("key"), "c")
    gain = F.when(F.col("word").isNotNull(), F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(1.0))).otherwise(0.0)
    return (
        parts.withColumn("key", key_col)
        .join(rare, "key", "left")
        .groupBy("id")
        .agg(
            F.sum("n_tokens").alias("n_tokens"),
            F.sum(F.col("n_known") + F.when(F.col("word").isNotNull() & F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("n_known"),
            F.sum(F.col("base") + gain).alias("base_score"),
            F.sum(F.col("score") + gain).alias("score"),
        )
        .select(
            F.col("id").alias(id_col), (crc_mod(F.col("id"), held_out[0]) == held_out[1]).alias("held_out"),
            "n_tokens", "n_known", F.lit(vocab.total).cast("long").alias("train_tokens"), "base_score", "score",
        )
    )


def _parts(ids: pa.Array, out: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*out)) if out else [()] * 7
    kinds = [pa.binary(), *[pa.int64()] * 3, *[pa.float64()] * 2]
    return pa.RecordBatch.from_arrays(
        [ids.take(pa.array(cols[0], pa.int64())), *[pa.array(c, t) for c, t in zip(cols[1:], kinds)]],
        ["id", "word", "n", "n_tokens", "n_known", "base", "score"],
    )
