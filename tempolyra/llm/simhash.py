"""SimHash near-duplicates by a hierarchical index in Gray order.

Fingerprints are made of word shingles in one pass. Distinct fingerprints are dealt by blocks: two that
differ in at most three bits agree in one of four blocks of 16 bits, so each goes to four buckets, and
in a bucket of over most_in_bucket fingerprints to four finer ones each. Buckets are the upper nodes of
one index over all that a task holds: in them fingerprints are sorted by Gray rank, and runs of
neighbours share a masked bit pattern, which moves to a node above them, level by level. A search carries
the differences counted so far down the levels and drops a group as soon as they pass the limit. Buckets
give a spanning forest of their links, never all pairs; links become components by star rounds on Spark.

Scale: copies of a text collapse before anything is compared. Every bucket holds 8 bytes a fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_filter, cut, flag_maybe, packed, text_hash, unpacked, without
from .components import components

BITS, BLOCKS = 64, 4
BLOCK_BITS = BITS // BLOCKS
FAN = 8
HELD = 1 << 20  # most pairs of a search that are held at once


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """The SimHash of a UTF-8 text; null and empty texts have fingerprint 0."""
    parts = (text or b"").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = list(accumulate(map(len, parts), lambda a, n: a + 1 + n))
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_intdigest
    total, n = np.zeros(BITS, np.int64), len(parts) - words + 1
    for k in range(0, n, 65536):  # bounded memory for long texts
        h = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[k : min(n, k + 65536)], ends[k + words - 1 :])), np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << k for k in range(BITS) if 2 * total[k] > n)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """Rows (id, row_hash, fp): the fingerprint of each row's whole text as a signed long."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), text_hash(F.col(text_col)).alias("row_hash"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), words) for t in b.column(1).cast(pa.binary())], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fp.view(np.int64))], ["id", "row_hash", "fp"])

    return rows.mapInArrow(scan, f"id {rows.schema['id'].dataType.simpleString()}, row_hash bigint, fp bigint")


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Place of each value in the reflected Gray sequence."""
    rank = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Hierarchical index over buckets of fingerprints: at the top a node for each bucket with the bits that
    all of it shares, below it groups of FAN neighbours in Gray order, down to the fingerprints."""

    def __init__(self, bucket: np.ndarray, fps: np.ndarray):
        order = np.lexsort((gray_rank(fps), bucket))
        self.fps, bucket = fps[order], bucket[order]
        new = np.ones(len(bucket), bool)
        new[1:] = bucket[1:] != bucket[:-1]
        self.bucket = of = np.cumsum(new) - 1
        mask, value = np.full(len(self.fps), ~np.uint64(0)), self.fps
        levels, self.first = [(mask, value)], []
        while len(mask) > of[-1] + 1:
            start = np.searchsorted(of, np.arange(of[-1] + 1))
            at = np.nonzero((np.arange(len(of)) - start[of]) % FAN == 0)[0]
            ones, zeros = np.bitwise_and.reduceat(mask & value, at), np.bitwise_and.reduceat(mask & ~value, at)
            mask, value, of = ones | zeros, ones, of[at]
            levels.append((mask, value))
            self.first.append(np.append(at, len(levels[-2][0])))
        # what a node above already says is left out below
        self.own = [levels[-1]]
        for (mask, value), first, (up, _) in zip(levels[-2::-1], self.first[::-1], levels[:0:-1]):
            rest = mask & ~np.repeat(up, np.diff(first))
            self.own.insert(0, (rest, value & rest))

    def near(self, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (i, j), i < j, of a bucket's fingerprints at distance of at most `most`, some HELD at once."""
        top = len(self.own) - 1
        stack = [(top, np.arange(len(self.fps)), self.bucket, np.zeros(len(self.fps), np.int64))]
        while stack:
            level, q, node, acc = stack.pop()
            mask, value = self.own[level]
            acc = acc + np.bitwise_count((self.fps[q] ^ value[node]) & mask[node])
            close = acc <= most
            if level == 0:
                close &= q < node
                yield q[close], node[close]
                continue
            q, node, acc = q[close], node[close], acc[close]
            first = self.first[level - 1]
            n = first[node + 1] - first[node]
            for part in np.split(np.arange(len(q)), np.searchsorted(np.cumsum(n), np.arange(HELD, n.sum(), HELD))):
                m = n[part]
                below = np.repeat(first[node[part]], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                stack.append((level - 1, np.repeat(q[part], m), below, np.repeat(acc[part], m)))


def _settle(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Joins the classes of i and j: every class takes its smallest label."""
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        while not np.array_equal(new, jumped := new[new]):
            new = jumped
        if np.array_equal(new, label):
            return label
        label = new


def forest(bucket: np.ndarray, fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the links within buckets connect: each linked fingerprint and its class's first."""
    index = GrayIndex(bucket, fps)
    label = np.arange(len(fps))
    for i, j in index.near(most):
        apart = label[i] != label[j]
        if apart.any():
            label = _settle(label, i[apart], j[apart])
    linked = np.nonzero(label != np.arange(len(fps)))[0]
    return index.fps[linked], index.fps[label[linked]]


def _forests(most: int):
    """Reads rows (bucket, fp) sorted by bucket; gives edges (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = [], []

        def flush(last: bool):
            key, fp = np.concatenate(keys), np.concatenate(fps)
            end = len(key) if last else np.searchsorted(key == key[-1], True)
            keys[:], fps[:] = [key[end:]], [fp[end:]]
            if end:
                a, b = forest(key[:end], fp[:end], most)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for b in batches:
            if b.num_rows:
                keys.append(b.column(0).to_numpy(zero_copy_only=False))
                fps.append(b.column(1).to_numpy(zero_copy_only=False).view(np.uint64))
                if keys[0][0] != keys[-1][-1]:
                    yield from flush(False)
        if keys:
            yield from flush(True)

    return run


def links(distinct: DataFrame, most: int = 3, most_in_bucket: int = 50_000) -> DataFrame:
    """Edges (a, b) between distinct fingerprints `fp` that connect whatever chains of links connect."""
    if most >= BLOCKS:
        raise ValueError(f"most must be under {BLOCKS}")
    part = lambda col, shift, bits: F.shiftrightunsigned(col, shift).bitwiseAND(F.lit((1 << bits) - 1))
    dealt = distinct.select(
        "fp",
        F.posexplode(F.array(*[part(F.col("fp"), k * BLOCK_BITS, BLOCK_BITS) for k in range(BLOCKS)])).alias("block", "v"),
    ).select("fp", "block", (F.shiftleft(F.col("block").cast("long"), BLOCK_BITS) + F.col("v")).alias("coarse"))
    # at most 4 * 65,536 different keys, whatever the input
    hot = dealt.groupBy("coarse").count().where(F.col("count") > most_in_bucket).select("coarse", F.lit(True).alias("hot"))
    fine_bits = BLOCK_BITS - BLOCK_BITS // BLOCKS
    rest = F.concat_ws("", *[F.when(F.col("block") != k, F.lpad(F.bin(part(F.col("fp"), k * BLOCK_BITS, BLOCK_BITS)), BLOCK_BITS, "0")) for k in range(BLOCKS)])
    fine = [
        F.shiftleft(F.col("coarse"), fine_bits + 2) + F.lit(k << fine_bits) + F.conv(F.substring("rest", 1 + k * fine_bits, fine_bits), 2, 10).cast("long") + F.lit(1 << 48)
        for k in range(BLOCKS)
    ]
    keyed = (
        dealt.join(F.broadcast(hot), "coarse", "left")
        .withColumn("rest", F.when(F.col("hot"), rest))
        .select("fp", F.explode(F.when(F.col("hot"), F.array(*fine)).otherwise(F.array("coarse"))).alias("bucket"))
    )
    return keyed.select("bucket", "fp").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_forests(most), "a bigint, b bigint")


def simhash_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, most: int = 3, most_in_bucket: int = 50_000
) -> DataFrame:
    """One row per input row: id, row_hash (tells rows of one id apart), fp (signed long), root (the
    component's smallest fingerprint) and component_id (smallest id reachable by links).

    Texts link when their fingerprints differ in at most `most` bits (under 4); equal texts always do,
    and so do all null and empty texts, whose fingerprint is 0. Repeated rows come back as they are. A
    row with a null id belongs to its component; only where no row has an id is component_id null.
    Other columns are ignored.
    """
    made = cut(fingerprints(docs, id_col, text_col, words), "fingerprints")
    distinct = cut(made.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    root = components(links(distinct, most, most_in_bucket))
    rooted = distinct.join(root, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(named, "root").select(F.col("fp").alias("cfp"), "root", "component_id")
    return made.join(classes, F.col("fp") == F.col("cfp")).select(F.col("id").alias(id_col), "row_hash", "fp", "root", "component_id")


def keep_first_of_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params: int) -> DataFrame:
    """The rows, all columns, of one document of each component; see keep_first."""
    return keep_first(docs, simhash_dedup(docs, id_col, text_col, **params), id_col, text_col)


def keep_first(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows, all columns, of one document of each component (id, row_hash, root, component_id): the one
    whose id is component_id.

    Where several rows of a component have that id (or, in a component without ids, none has one), the
    row of the smallest text hash stays, and of equal rows one.
    """
    groups = cut(groups.withColumnRenamed(id_col, "id"), "groups")
    first = groups.where("id <=> component_id")
    chosen = first.groupBy("root").agg(F.min("row_hash").alias("chosen"), F.count(F.lit(1)).alias("n"))
    several = cut(chosen.where("n > 1"), "several")
    gone = groups.where("not id <=> component_id").select("id", "row_hash")
    if several.isEmpty():
        return without(docs, gone, id_col, text_col)
    others = first.join(several, "root").where("row_hash <> chosen").select("id", "row_hash")
    left = packed(without(docs, gone.unionAll(others), id_col, text_col), id_col, text_col)
    rows = flag_maybe(left, F.col("row"), cut(bit_filter(several, F.col("chosen")), "several-filter"))
    once = rows.where("__maybe").dropDuplicates(["id", "row"])
    return unpacked(rows.where("not __maybe").unionByName(once), docs)
