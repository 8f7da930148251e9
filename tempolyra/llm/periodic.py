"""Periodic runs of words, by Lyndon arrays from suffix grouping.

A run is a maximal stretch with a smallest period q. Every run that holds its period twice contains a Lyndon
root: under one of the two orders of the words (an order or its reverse) some position's longest Lyndon word
has length q and begins inside the run. `lyndon_array` finds these words for all positions by the first phase of
suffix grouping: positions stand in groups by the Lyndon word known of them so far, from one word on; groups are
gone through from the highest down, each member hands its word to the nearest position to its left that is still
open, and a position that got k copies moves to a new group just above its old one (below those that got more).
When a group's turn comes, its word is the longest Lyndon word of its members. Done for an order and its reverse
this gives all roots, and the longest common extensions of i and i + q in both directions turn a root into its run.
Extensions come from ranks of blocks of 1, 2, 4, ... words, by exact comparison at every level.

A run asked for here has at least three periods and at least `least` words, so each of its stretches of GRAM words
begins a second time inside it. Documents, and parts of documents, without a row of such repeated stretches hold no
run and are not grouped: this is told by hashes of the stretches, where a collision only adds work.

One pass over the rows, no shuffle; a document is one row, and its arrays are a small multiple of its words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Words of the stretches whose repetition is looked for first. With runs of at least MIN_LENGTH words and three
#: periods, a stretch that begins in the run begins again one period on or one period back.
GRAM = 8
#: Shortest run that may be asked for: 2 * GRAM words.
MIN_LENGTH = 2 * GRAM

_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def lyndon_array(words: np.ndarray, reverse: bool = False) -> np.ndarray:
    """The length of the longest Lyndon word that begins at each position, under the order of the numbers or its
    reverse; the end is smaller than any word."""
    n = len(words)
    values, first = np.unique(words, return_inverse=True)
    if reverse:
        first = len(values) - 1 - first
    # groups 0 .. m-1 in ascending order of their words; below[g] is the next lower group, above[g] the next higher
    m = len(values)
    group = first.tolist()
    cut = np.cumsum(np.bincount(first, minlength=m))[:-1]
    members = [x.tolist() for x in np.split(np.argsort(first, kind="stable"), cut)]
    size, below, above = [1] * m, list(range(-1, m - 1)), [*range(1, m), -1]
    left, right = list(range(-1, n)), list(range(1, n + 2))  # open positions; n is the end
    out = [0] * n
    g = m - 1
    while g >= 0:
        length, got = size[g], []  # (copies, position) of those that get this group's word
        last, count = -1, 0
        for i in members[g]:
            if group[i] != g:
                continue
            out[i] = length
            p, r = left[i], right[i]
            left[r] = p
            if p >= 0:
                right[p] = r
                if p == last:
                    count += 1
                else:
                    if count:
                        got.append((count, last))
                    last, count = p, 1
        if count:
            got.append((count, last))
        members[g] = None
        if got:
            # a position that received and closed in the same group hands on what it got: such positions are
            # members of g themselves and were taken off the list before, so p is always of a lower group
            if len(got) > 1:
                got.sort(key=lambda x: -x[0])  # stable: positions stay in order
            new: dict[tuple[int, int], int] = {}
            for count, p in got:
                old = group[p]
                h = new.get((count, old))
                if h is None:
                    h = new[count, old] = len(size)
                    size.append(size[old] + count * length)
                    members.append([])
                    up = above[old]
                    below.append(old)
                    above.append(up)
                    above[old] = h
                    if up >= 0:
                        below[up] = h
                group[p] = h
                members[h].append(p)
        g = below[g]
    return np.array(out, np.int64)


class Blocks:
    """Ranks of the blocks of 1, 2, 4, ... words that begin at each position."""

    def __init__(self, words: np.ndarray):
        self.n, self.levels = len(words), [words.astype(np.int64)]
        while 2 << (len(self.levels) - 1) <= self.n:
            low, half = self.levels[-1], 1 << (len(self.levels) - 1)
            key = low[:-half] * (int(low.max()) + 1) + low[half:]
            ranks = np.unique(key, return_inverse=True)[1]
            if int(ranks.max()) + 1 == len(ranks):  # no longer block stands twice
                break
            self.levels.append(ranks)

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal words from a and from b on, a < b."""
        got = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            level, step = self.levels[k], 1 << k
            for _ in range(2 if k == len(self.levels) - 1 else 1):
                fits = np.nonzero(b + got + step <= self.n)[0]
                at = fits[level[a[fits] + got[fits]] == level[b[fits] + got[fits]]]
                got[at] += step
        return got

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal words before a and before b, a < b."""
        got = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            level, step = self.levels[k], 1 << k
            for _ in range(2 if k == len(self.levels) - 1 else 1):
                fits = np.nonzero(a - got >= step)[0]
                at = fits[level[a[fits] - got[fits] - step] == level[b[fits] - got[fits] - step]]
                got[at] += step
        return got


def runs_of(words: np.ndarray, least: int = 24, times: int = 3) -> np.ndarray:
    """Rows (start, length, period) of the runs of at least `least` words and `times` periods (two or more), in
    order. words: their numbers."""
    n, found = len(words), []
    if n < max(least, 2):
        return np.zeros((0, 3), np.int64)
    blocks = Blocks(words)
    for reverse in (False, True):
        q = lyndon_array(words, reverse)
        i = np.nonzero(np.arange(n) + q <= n)[0]
        q = q[i]
        ahead, back = blocks.forward(i, np.minimum(i + q, n)), blocks.backward(i, i + q)
        length = back + q + ahead
        good = length >= np.maximum(least, times * q)
        found.append(np.stack([i - back, length, q], 1)[good])
    rows = np.unique(np.concatenate(found), axis=0)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def repeated_parts(words: np.ndarray, doc: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and ends of the parts, none across documents, in which every stretch of GRAM words stands twice
    or more in its document, and which have room for `least` words."""
    m = len(words) - GRAM + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    w = (words.astype(np.uint64) + np.uint64(1)) * _SPREAD
    key = np.zeros(m, np.uint64)
    for k in range(GRAM):
        key = key * np.uint64(0xD6E8FEB86659FD93) + (w[k : k + m] ^ (w[k : k + m] >> np.uint64(31)))
    whole = doc[:m] == doc[GRAM - 1 :]
    key = (key ^ (key >> np.uint64(29))) + doc[:m].astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    at = np.nonzero(whole)[0]
    order = at[np.argsort(key[at])]
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(words) + 1, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    # rows of repeated stretches, cut where the document changes
    new = np.zeros(len(words) + 1, bool)
    new[1 : len(words)] = doc[1:] != doc[:-1]
    begin = np.nonzero(twice & (np.append(True, ~twice[:-1]) | new))[0]
    stop = np.nonzero(twice & (np.append(~twice[1:], True) | np.append(new[1:], True)))[0] + 1
    long = stop - begin + GRAM - 1 >= least
    return begin[long], stop[long] + GRAM - 1


def _numbers(words: list[bytes]) -> np.ndarray:
    at = {w: k for k, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(at.__getitem__, words), np.int64, len(words))


def find_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 24, times: int = 3,
    fold: Column | None = None, digests: bool = False,
) -> DataFrame:
    """One row per input row: id, n_words, runs (array of start, length, period, in order of start, then period)
    and collapsed, the words joined by one blank without those that a run contains after its first period. With
    digests: n_runs, the run of the greatest length / period (ties: smallest start, then period; nulls without a
    run) and SHA-256 of the runs' lines and of the collapsed text.

    A run is a stretch of words (between blanks, tabs and line ends of ASCII) with smallest period q and at least
    max(least, times * q) words that no neighbouring word extends; least is at least MIN_LENGTH, times at least 3.
    fold, a column struct(start, period) of longs, makes words periodic first: word i from start on becomes word
    start + (i - start) % period; null leaves a row as it is. Null counts as empty, without words or runs. Whole
    texts are read, however long. Repeated rows and null ids come back as they are; other columns are ignored.
    """
    if least < MIN_LENGTH or times < 3:
        raise ValueError(f"least must be {MIN_LENGTH} or more, times 3 or more")
    small_batches(docs.sparkSession)
    no_fold = F.lit(None).cast("struct<start:bigint,period:bigint>")
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b"")).alias("text"), (no_fold if fold is None else fold).alias("fold")
    )
    kind = rows.schema["id"].dataType.simpleString()
    if digests:
        tail = "n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"
    else:
        tail = "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words_of = [x.as_py().split() for x in batch.column(1)]
            for k, fold in enumerate(batch.column(2).to_pylist()):
                if fold and 0 <= fold["start"] < (n := len(words_of[k])) and fold["period"] > 0:
                    a, p, w = fold["start"], fold["period"], words_of[k]
                    words_of[k] = w[:a] + (w[a : a + p] * ((n - a) // p + 1))[: n - a]
            out = _runs_of_batch(words_of, least, times)
            yield pa.RecordBatch.from_pylist([_row(i, w, r, digests) for i, w, r in zip(batch.column(0).to_pylist(), words_of, out)], schema)

    def _row(key: object, words: list[bytes], runs: np.ndarray, digests: bool) -> dict:
        kept = words
        if len(runs):
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
            np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
            kept = [words[k] for k in np.nonzero(np.cumsum(edge)[:-1] == 0)[0].tolist()]
        collapsed, found = b" ".join(kept), runs.tolist()
        if not digests:
            return {"id": key, "n_words": len(words), "runs": [dict(zip(("start", "length", "period"), r)) for r in found], "collapsed": collapsed.decode()}
        best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else None
        lines = "".join([f"{s},{n},{q}\n" for s, n, q in found])
        start, length, period = best or (None, None, None)
        return {
            "id": key, "n_runs": len(found), "start": start, "length": length, "period": period, "exponent_milli": 1000 * length // period if best else None,
            "runs_sha256": hashlib.sha256(lines.encode()).hexdigest(), "collapsed_sha256": hashlib.sha256(collapsed).hexdigest(),
        }

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(rows.schema["id"].dataType)
    long = pa.int64()
    if digests:
        fields = [("id", id_type), *[(c, long) for c in ("n_runs", "start", "length", "period", "exponent_milli")], ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]
    else:
        fields = [("id", id_type), ("n_words", long), ("runs", pa.list_(pa.struct([(c, long) for c in ("start", "length", "period")]))), ("collapsed", pa.string())]
    schema = pa.schema(fields)
    return rows.mapInArrow(find, f"id {kind}, {tail}").withColumnRenamed("id", id_col)


def _runs_of_batch(words_of: list[list[bytes]], least: int, times: int) -> list[np.ndarray]:
    """The runs of each document."""
    sizes = np.fromiter(map(len, words_of), np.int64, len(words_of))
    first = np.cumsum(sizes) - sizes
    flat = _numbers([w for words in words_of for w in words])
    doc = np.repeat(np.arange(len(words_of)), sizes)
    found: list[list[np.ndarray]] = [[] for _ in words_of]
    for a, b in zip(*(x.tolist() for x in repeated_parts(flat, doc, least))):
        runs = runs_of(flat[a:b], least, times)
        if len(runs):
            runs[:, 0] += a - first[doc[a]]
            found[doc[a]].append(runs)
    none = np.zeros((0, 3), np.int64)
    return [np.concatenate(x) if x else none for x in found]
