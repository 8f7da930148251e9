"""Removal of repeated passages by a depth-limited suffix order over bytes.

Suffixes are ordered only through `LENGTH` bytes, by passes of digits; after each pass only groups that
are still equal go on. The first digit is a block of GRAM bytes: of the blocks within a window the one
with the least digest is read first, so equal windows read the same block at the same place, and about
one block in eighty stands for all windows that read it. The second digit is the block's surroundings,
all bytes of its windows: equal surroundings are one kind with a count, and every window of a kind that
occurs twice repeats. The third, for blocks with kinds that occur once, is the window itself, compared
byte by byte within the group of its block.

(Plain leading bytes as the first digit would need one row a byte of text, some 16 bytes each, where the
blocks need one row of 48 bytes for eighty bytes of text. Blocks, surroundings and texts are compared by
digests: 64 bits for a block, 64 more for its surroundings, 128 for a text. Within a block of over
most_kinds kinds, windows are compared by 64 bits besides the block's.)

Scale: equal texts are taken once (their windows all repeat). Blocks are computed once and written;
counts of kinds and of blocks are combined before they are shuffled, so a passage that stands in a third
of all texts is one row a task, and a run of one period within a text is one row. Blocks that stand once
are counted by their digest alone and go no further, but for some that a bounded filter lets through.
Only kinds that are to
be compared send their bytes, once each, however often they occur. Texts move only where bounded filters
say that something in them is compared or repeats. Memory follows a segment of a text, or most_kinds
surroundings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_filter, cut, flag_maybe, maybe_in, small_batches

LENGTH, GRAM = 200, 32
SEGMENT = 1 << 17  # window starts taken at once
CHUNK = 1 << 18  # bytes of surroundings compared at once
BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64."""
    inverse = pow(BASE, -1, 1 << 64)
    with np.errstate(over="ignore"):
        return tuple(np.concatenate([[_U(1)], np.cumprod(np.full(n - 1, b % (1 << 64), _U))]) for b in (BASE, inverse))


class Digests:
    """Digests of any stretch of a byte array that depend on its content only."""

    table = np.random.default_rng(17).integers(1, 1 << 63, 256, dtype=_U) * _U(2) + _U(1)
    power = inverse = np.zeros(0, _U)

    def __init__(self, data: np.ndarray):
        if len(Digests.power) < len(data) + 1:
            Digests.power, Digests.inverse = _powers(max(len(data) + len(data) // 4 + 2, 1 << 16))
        self.sums = np.zeros(len(data) + 1, _U)
        np.cumsum(Digests.table[data] * Digests.power[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * Digests.inverse[start]
        return mixed(h)

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return mixed((self.sums[length:] - self.sums[:n]) * Digests.inverse[:n])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(29))) * _U(0xA0761D6478BD642F)
    return h ^ (h >> _U(32))


def blocks(text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By segment: first and last window start that reads a block, its place, its digest, and the
    digest of its surroundings, from the first window's start to the last one's end."""
    n = len(text) - LENGTH + 1
    for at in range(0, n, SEGMENT):
        data = np.frombuffer(text, np.uint8, min(SEGMENT, n - at) + LENGTH - 1, at)
        dig = Digests(data)
        gram = dig.all(GRAM)
        least = (gram >> _U(32) << _U(32)) | np.arange(len(gram), dtype=_U)  # the leftmost of equals
        width, span = LENGTH - GRAM + 1, 1
        while span * 2 <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
        place = (least & _U(0xFFFFFFFF)).astype(np.int64)
        lo = np.concatenate([[0], np.nonzero(place[1:] != place[:-1])[0] + 1])
        hi = np.append(lo[1:] - 1, len(place) - 1)
        mid = place[lo]
        around = mixed(dig.of(lo, hi + LENGTH) ^ ((mid - lo).astype(_U) << _U(16)) ^ (hi - lo).astype(_U))
        yield lo + at, hi + at, mid + at, gram[mid], around


def _pack(lo: np.ndarray, hi: np.ndarray, mid: np.ndarray) -> np.ndarray:
    return (lo << 16) | ((mid - lo) << 8) | (hi - lo)


def _unpack(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lo = at >> 16
    return lo, lo + (at & 255), lo + (at >> 8 & 255)


def _batch(names: str, *cols: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if isinstance(c, np.ndarray) and c.dtype == _U else c) for c in cols], names.split())


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads (th, tc, text), gives (th, tc, gram, around, at, m): blocks, m neighbours of one kind as one row."""
    for b in batches:
        held, size = [], 0
        for th, tc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary())):
            for lo, hi, mid, gram, around in blocks(t.as_py()):
                first = np.nonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (around[1:] != around[:-1])]))[0]
                m = np.diff(np.append(first, len(lo)))
                held.append([np.full(len(m), th), np.full(len(m), tc), gram[first], around[first], _pack(lo, hi, mid)[first], m])
                size += len(m)
                if size > 20_000:
                    yield _batch("th tc gram around at m", *map(np.concatenate, zip(*held)))
                    held, size = [], 0
        if held:
            yield _batch("th tc gram around at m", *map(np.concatenate, zip(*held)))


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads (text, kinds array<struct<gram, around, n, at, hot>>), gives (gram, around, n, at, hot, bytes)."""
    names = ["gram", "around", "n", "at", "hot"]
    for b in batches:
        for t, kinds in zip(b.column(0).cast(pa.binary()), b.column(1)):
            text, kinds = t.as_py(), kinds.values
            at = kinds.field("at").to_numpy()
            lo, hi, _ = _unpack(at)
            for k in range(0, len(at), 2_000):
                part = slice(k, k + 2_000)
                data = pa.array([text[a:z] for a, z in zip(lo[part].tolist(), (hi[part] + LENGTH).tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([*(kinds.field(c).slice(k, 2_000) for c in names), data], [*names, "bytes"])


def _windows(gram: np.ndarray, at: np.ndarray, data: bytes, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window: the row, its start in the joined bytes, and the digest of block, place and content."""
    lo, hi, mid = _unpack(at)
    offset = np.cumsum(size) - size
    n = hi - lo + 1
    row = np.repeat(np.arange(len(at)), n)
    k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    start = offset[row] + k
    h = Digests(np.frombuffer(data, np.uint8)).of(start, start + LENGTH)
    place = (mid[row] - lo[row] - k).astype(_U)
    return row, start, mixed(h ^ (gram.view(_U)[row] * _U(0x9FB21C651E98DF25)) ^ (place << _U(56)))


def _differ(data: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the windows at i and j differ in a byte. Neighbouring pairs are compared as one stretch."""
    new = np.ones(len(i), bool)
    new[1:] = (i[1:] != i[:-1] + 1) | (j[1:] != j[:-1] + 1)
    first = np.nonzero(new)[0]
    windows = np.diff(np.append(first, len(i)))
    size = windows + LENGTH - 1
    out, group = np.zeros(len(i), bool), np.cumsum(size) // CHUNK
    for g in np.unique(group):  # about CHUNK bytes at once
        f, n, w = first[group == g], size[group == g], windows[group == g]
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        unlike = np.cumsum(np.append(0, data[np.repeat(i[f], n) + k] != data[np.repeat(j[f], n) + k]))
        at = np.arange(w.sum()) + np.repeat(np.arange(len(f)) * (LENGTH - 1), w)
        out[f[0] : f[0] + w.sum()] = unlike[at + LENGTH] > unlike[at]
    return out


def _again(data: np.ndarray, start: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """Which windows have a second one of the same bytes. Windows of one digest are compared with the
    first of them; those that differ, by a chance in 2^64, are compared as whole bytes."""
    order = np.argsort(digest, kind="stable")
    d, s = digest[order], start[order]
    same = d[1:] == d[:-1]
    first = np.concatenate([[0], np.nonzero(~same)[0] + 1]) if len(d) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(d)))
    of = np.repeat(s[first], size)
    other = np.nonzero(of != s)[0]
    by_place = other[np.argsort(s[other], kind="stable")]
    unlike = np.zeros(len(d), bool)
    unlike[by_place] = _differ(data, s[by_place], of[by_place])
    hit = np.repeat(size > 1, size)
    for f in np.unique(np.repeat(first, size)[unlike]):
        group = slice(f, f + size[np.searchsorted(first, f)])
        content = [data[x : x + LENGTH].tobytes() for x in s[group]]
        hit[group] = [content.count(c) > 1 for c in content]
    out = np.zeros(len(d), bool)
    out[order] = hit
    return out


_STRETCHES = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (gram, around, n, at, bytes) sorted by gram, the repeated stretches (gram, around, stretches)
    of kinds that occur once, counted from the beginning of the surroundings."""
    held: list[pa.RecordBatch] = []

    def done(rows: pa.Table) -> pa.RecordBatch:
        gram, around, n, at = (rows.column(k).to_numpy() for k in range(4))
        data = rows.column(4).to_pylist()
        size = np.fromiter(map(len, data), np.int64, len(data))
        joined = b"".join(data)
        row, start, digest = _windows(gram, at, joined, size)
        hit = _again(np.frombuffer(joined, np.uint8), start, digest) & (n[row] == 1)
        r, s = row[hit], start[hit] - (np.cumsum(size) - size)[row[hit]]
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (s[1:] != s[:-1] + 1)
        first = np.nonzero(new)[0]
        last = np.append(first[1:] - 1, len(r) - 1)[: len(first)]
        kinds, k = np.unique(r[first], return_index=True)
        values = pa.StructArray.from_arrays([pa.array(s[first]), pa.array(s[last] + LENGTH)], ["start", "stop"])
        stretches = pa.ListArray.from_arrays(pa.array(np.append(k, len(first)), pa.int32()), values)
        return pa.RecordBatch.from_arrays([pa.array(gram[kinds]), pa.array(around[kinds]), stretches.cast(_STRETCHES)], ["gram", "around", "stretches"])

    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        step = max(1, b.num_rows * CHUNK // max(b.nbytes, 1))
        for k in range(0, b.num_rows, step):
            held.append(b.slice(k, step))
            size += held[-1].nbytes
            if size >= CHUNK and held[0].column(0)[0] != held[-1].column(0)[-1]:
                rows = pa.Table.from_batches(held)
                gram = rows.column(0).to_numpy()
                end = int(np.argmax(gram == gram[-1]))
                yield done(rows.slice(0, end))
                rest = rows.slice(end)
                held, size = [x for x in rest.to_batches()], rest.nbytes
    if held:
        yield done(pa.Table.from_batches(held))


def _hot_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of rows (gram, around, n, at, bytes): (gram, around, n, digest, start)."""
    for whole in batches:
        for k in range(0, whole.num_rows, 500):
            b = whole.slice(k, 500)
            gram, around, n, at = (b.column(k).to_numpy() for k in range(4))
            data = b.column(4).to_pylist()
            size = np.fromiter(map(len, data), np.int64, len(data))
            row, start, digest = _windows(gram, at, b"".join(data), size)
            yield _batch("gram around n digest start", gram[row], around[row], n[row], digest, start - (np.cumsum(size) - size)[row])


def repeated_ranges(texts: DataFrame, most_kinds: int = 5000) -> DataFrame:
    """Rows (th, tc, ranges array<struct<start, stop>>): stretches of distinct texts (th, tc, text) that lie
    in windows of LENGTH bytes which start more than once. Blocks with up to most_kinds kinds are compared
    as a group, the others by counting; the rows are the same either way."""
    found = cut(texts.select("th", "tc", "text").mapInArrow(_block_rows, "th bigint, tc bigint, gram bigint, around bigint, at bigint, m bigint"), "blocks")
    # most blocks stand once and have nothing to be compared with
    twice = found.groupBy("gram").agg(F.sum("m").alias("n")).where("n > 1")
    some = maybe_in(found, F.col("gram"), cut(bit_filter(twice, F.col("gram")), "twice-filter"))
    kinds = cut(some.groupBy("gram", "around").agg(F.sum("m").alias("n"), F.min(F.struct("th", "tc", "at")).alias("first")), "kinds")
    grams = kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds"), F.count_if(F.col("n") == 1).alias("once")).where("kinds > 1 and once > 0")
    grams = cut(grams.select("gram", (F.col("kinds") > most_kinds).alias("hot")), "grams")
    compared = maybe_in(kinds, F.col("gram"), cut(bit_filter(grams, F.col("gram")), "grams-filter")).join(grams, "gram")
    by_text = cut(
        compared.groupBy("first.th", "first.tc").agg(F.collect_list(F.struct("gram", "around", "n", "first.at", "hot")).alias("kinds")), "places"
    )
    moved = maybe_in(texts, F.col("th"), cut(bit_filter(by_text, F.col("th")), "places-filter")).join(by_text, ["th", "tc"])
    around = moved.select("text", "kinds").mapInArrow(_surroundings, "gram bigint, around bigint, n bigint, at bigint, hot boolean, bytes binary")
    any_hot = not grams.where("hot").isEmpty()
    if any_hot:  # read twice: the texts move once
        around = cut(around, "surroundings", compression="zstd")
    stretch = "array<struct<start: bigint, stop: bigint>>"
    cold = around.where("not hot").drop("hot").repartition("gram").sortWithinPartitions("gram").mapInArrow(_compare, f"gram bigint, around bigint, stretches {stretch}")
    whole = kinds.where("n > 1").select("gram", "around", F.lit(None).cast(stretch).alias("stretches"))
    again = whole.unionAll(cold)
    if any_hot:
        windows = cut(around.where("hot").drop("hot").mapInArrow(_hot_windows, "gram bigint, around bigint, n bigint, digest bigint, start bigint"), "hot-windows")
        twice = windows.groupBy("gram", "digest").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("gram", "digest")
        single = windows.where("n = 1").join(twice, ["gram", "digest"], "left_semi")
        again = again.unionAll(single.groupBy("gram", "around").agg(F.collect_list(F.struct("start", (F.col("start") + LENGTH).alias("stop"))).alias("stretches")))
    again = cut(again, "repeated")
    lo, span = F.shiftright("at", 16), F.col("at").bitwiseAND(F.lit(255))
    all_of = F.array(F.struct(lo.alias("start"), (lo + F.col("m") * (span + 1) - 1 + LENGTH).alias("stop")))
    part = F.transform("stretches", lambda x: F.struct((x["start"] + lo).alias("start"), (x["stop"] + lo).alias("stop")))
    key = F.xxhash64("gram", "around")
    places = maybe_in(found, key, cut(bit_filter(again, key), "repeated-filter")).join(again, ["gram", "around"])
    ranges = places.select("th", "tc", F.coalesce(part, all_of).alias("r")).groupBy("th", "tc").agg(F.flatten(F.collect_list("r")).alias("ranges"))
    return ranges


def _cut_out(text: bytes, ranges: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """Bytes removed, number of maximal removed runs, and the bytes that stay."""
    kept, at, spans, end = [], 0, 0, -1
    for s, e in sorted(ranges):
        if s > end:
            spans += 1
            kept.append(text[at:s])
        end = max(end, e)
        at = max(at, end)
    rest = b"".join([*kept, text[at:]])
    return len(text) - len(rest), spans, rest


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_kinds: int = 5000) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept (binary, the remaining bytes).

    Removes every byte covered by a string of LENGTH bytes that also starts anywhere else in the
    documents' UTF-8 texts, the same text included. Matches never cross texts, and are judged on the
    input. Null counts as empty. Texts under LENGTH bytes stay whole. Equal texts, repeated rows
    included, repeat each other and are removed in all their rows if they are long enough. Null ids
    come back as they are. Other columns are ignored. The session's Arrow batches are bounded (see
    small_batches).
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("th"), F.xxhash64(F.lit(1), text).alias("tc"))
    long_rows = rows.where(F.octet_length("text") >= LENGTH)
    copies = cut(long_rows.groupBy("th", "tc").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id")).alias("first")).where("n > 1").select("th", "tc", "first.id"), "copies")
    copied = cut(bit_filter(copies, F.xxhash64("th", "tc")), "copies-filter")
    # of equal texts one row goes on; the others stay where they are
    firsts = cut(bit_filter(copies, F.xxhash64("th", "tc", "id")), "firsts-filter")
    long_rows = flag_maybe(long_rows, F.xxhash64("th", "tc"), copied)
    some = long_rows.where("__maybe").drop("__maybe")
    one = maybe_in(some, F.xxhash64("th", "tc", "id"), firsts).dropDuplicates(["th", "tc"])
    alone = some.join(copies, ["th", "tc"], "left_anti")
    texts = long_rows.where("not __maybe").select("th", "tc", "text")
    texts = texts.unionAll(one.join(copies, ["th", "tc"], "left_semi").select("th", "tc", "text")).unionAll(alone.select("th", "tc", "text"))

    # equal texts are covered from end to end
    whole = copies.select("th", "tc", F.lit(True).alias("whole"))
    marks = cut(repeated_ranges(texts, most_kinds).join(whole, ["th", "tc"], "full_outer").select("th", "tc", F.when(F.col("whole").isNull(), F.col("ranges")).alias("ranges"), F.coalesce("whole", F.lit(False)).alias("whole")), "marks")
    marked = flag_maybe(rows, F.xxhash64("th", "tc"), cut(bit_filter(marks, F.xxhash64("th", "tc")), "marks-filter"))
    kind = rows.schema["id"].dataType.simpleString()
    joined = (
        marked.where("__maybe").join(marks, ["th", "tc"], "left").select("id", "text", "ranges", "whole")
        .unionByName(marked.where("not __maybe").select("id", "text"), allowMissingColumns=True)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, r, whole in zip(b.column(1).cast(pa.binary()), b.column(2), b.column(3).to_pylist()):
                t = t.as_py()
                if whole:
                    out.append((len(t), len(t), 1, b""))
                elif r.is_valid:
                    v = r.values
                    out.append((len(t), *_cut_out(t, list(zip(v.field("start").to_pylist(), v.field("stop").to_pylist())))))
                else:
                    out.append((len(t), 0, 0, t))
            cols = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(run, f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary").withColumnRenamed("id", id_col)
