"""The characters of timed lines, worked out for a batch of lines at once.

A character that becomes a row costs a sort and several windows. Here a line is a row that has its tokens in arrays, and a
batch of lines is timed by whole arrays of its characters; what comes out is a row a line or a song. Spark deals the
songs out and brings their lines into order; a batch is all that is held, or a song where files are made."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_sung
from ..sources.shared import small_batches

#: Columns of a line that hold an array each of its tokens, in order; a token's moras are their ends, in order.
TOKENS = ["token_idx", "surfaces", "starts", "ends", "mora_ends"]


@cache
def _unsung() -> np.ndarray:
    """The code points that is_sung does not count, as Spark sees them: none is beyond the first two planes."""
    spark = SparkSession.getActiveSession()
    points = spark.range(0x20000).where("id < 55296 or id > 57343").select("id", F.decode(F.unhex(F.lpad(F.hex("id"), 8, F.lit("0"))), "UTF-32").alias("c"))
    return np.array(sorted(r.id for r in points.where(~is_sung(F.col("c"))).collect()), np.uint32)


def _changes(column: pa.Array) -> np.ndarray:
    """Whether a row's value is another than that of the row before; nulls are equal."""
    codes = pc.dictionary_encode(column, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.append(True, codes[1:] != codes[:-1])[: len(codes)]


def _units(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches that end where a key does."""
    held: list[pa.RecordBatch] = []
    ready = lambda: pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    same = lambda a, b: all(a.column(k)[a.num_rows - 1].as_py() == b.column(k)[0].as_py() for k in keys)
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and not same(held[-1], batch):
            yield ready()
            held = []
        last = int(np.nonzero(np.logical_or.reduce([_changes(batch.column(k)) for k in keys]))[0][-1])
        if last:
            held.append(batch.slice(0, last))
            yield ready()
            held = []
        held.append(batch.slice(last))
    if held:
        yield ready()


def _floats(column: pa.Array) -> np.ndarray:
    """Whole numbers as floats, nulls as nan; greatest and least skip nulls as fmax and fmin do."""
    return pc.cast(column, pa.float64()).to_numpy(zero_copy_only=False)


def _sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of the stretches between edges."""
    total = np.append(0, np.cumsum(values))
    return total[edges[1:]] - total[edges[:-1]]


class TimedLines:
    """Lines of a batch (song_id, line_idx, start_ms, end_ms and TOKENS): chars are all their characters and hundredths
    theirs, edges where a line's characters begin and end.

    A sung character takes its share of its token's mora times, or without moras an even share of the token's, the
    remainder to the last ones. With fit, the gap up to the next token goes to a token's last sung character, as does
    what lies before the first token; then the total is made the line's, by the last sung character where it falls
    short, and backwards from the end where it is over."""

    def __init__(self, batch: pa.RecordBatch, marks: np.ndarray, fit: bool):
        listed = {c: batch.column(c) for c in TOKENS}
        count = pc.fill_null(pc.list_value_length(listed["surfaces"]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.batch, self.tokens = batch, np.append(0, np.cumsum(count))
        surface = pc.fill_null(listed["surfaces"].flatten().cast(pa.string()), "")
        start, end = _floats(listed["starts"].flatten()), _floats(listed["ends"].flatten())
        line = np.repeat(np.arange(len(count)), count)
        # characters
        offsets = np.frombuffer(surface.buffers()[1] or bytes(4), np.int32)[surface.offset : surface.offset + len(surface) + 1]
        data = np.frombuffer(surface.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        begins = np.nonzero((data & 0xC0) != 0x80)[0].astype(np.int32)
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        token_edges = np.searchsorted(begins, offsets - offsets[0])
        self.sung = ~marks[points]
        size = np.diff(token_edges)
        self.edges = token_edges[self.tokens]
        self.points = points
        self.chars = pa.StringArray.from_buffers(len(points), pa.py_buffer(np.append(begins, np.int32(len(data))).astype(np.int32)), pa.py_buffer(data))
        self.token_edges = token_edges
        # sung characters: their token, place in it and the number there
        n = _sums(self.sung, token_edges)
        token = np.repeat(np.arange(len(n)), n)
        first = np.cumsum(n) - n
        k = np.arange(len(token)) - first[token]
        # moras as segments without gaps inside their token
        moras = listed["mora_ends"].flatten()
        m = pc.fill_null(pc.list_value_length(moras), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = _floats(moras.flatten())
        of, head = np.repeat(np.arange(len(m)), m), np.cumsum(m) - m
        before = np.where(np.arange(len(ends)) == head[of], np.nan, np.append(np.nan, ends[:-1])[: len(ends)])
        seg = np.fmax(start[of], np.where(np.isnan(before), start[of], before))
        to = np.fmin(end[of], np.fmax(seg, np.where(np.arange(len(ends)) == head[of] + m[of] - 1, end[of], ends)))
        # shares
        hundredths = np.zeros(len(token))
        timed = np.nonzero(m[token] > 0)[0]
        if len(timed):
            mine, place = token[timed], k[timed]
            position = m[mine] * place / n[mine]
            whole = np.floor(position).astype(np.int64)
            at = head[mine] + whole
            low = np.rint(seg[at] + (to[at] - seg[at]) * (position - whole))
            high = np.where(place == n[mine] - 1, end[mine], np.append(low[1:], np.nan))
            hundredths[timed] = np.fmax(0, np.rint((high - low) / 10))
        bare = np.nonzero(m[token] == 0)[0]
        if len(bare):
            mine, count = token[bare], n[token[bare]]
            total = np.fmax(0, np.rint((end[mine] - start[mine]) / 10))
            base = np.floor(total / count)
            hundredths[bare] = base + (k[bare] >= count - (total - base * count))
        if fit and len(token):
            hundredths = self._fitted(hundredths, line[token], n, first, size, line, start, end)
        self.hundredths = np.zeros(len(points), np.int64)
        self.hundredths[self.sung] = hundredths

    def _fitted(self, hundredths, own, n, first, size, line, start, end):  # noqa: ANN001
        from_, until = (_floats(self.batch.column(c)) for c in ("start_ms", "end_ms"))
        last = np.append(line[1:] != line[:-1], True)
        following = np.where(last, np.nan, np.append(start[1:], np.nan))
        gap = np.rint(np.fmax(0, np.where(np.isnan(following), until[line], following) - end) / 10)
        shown = np.cumsum(size > 0)
        head = (size > 0) & (shown - np.append(0, shown)[self.tokens[:-1]][line] == 1)
        gap += np.where(head, np.rint(np.fmax(0, start - from_[line]) / 10), 0)
        some = n > 0
        hundredths[(first + n - 1)[some]] += gap[some]
        edges = np.append(first, len(own))[self.tokens]
        total = _sums(hundredths, edges)
        over = total - np.rint((until - from_) / 10)  # nan: nothing to fit to
        after = total[own] - (np.cumsum(hundredths) - np.append(0, np.cumsum(hundredths))[edges[:-1]][own])
        hundredths = hundredths - np.where(over[own] > 0, np.fmin(hundredths, np.fmax(0, over[own] - after)), 0)
        short = np.nonzero((over < 0) & (np.diff(edges) > 0))[0]
        hundredths[edges[1:][short] - 1] -= over[short]
        return hundredths

    def shown(self) -> np.ndarray:
        """Whether a line has characters."""
        return np.diff(self.edges) > 0

    def karaoke(self) -> pa.StringArray:
        """The text of each line, durations before sung characters, backslashes and braces made harmless."""
        if not len(self.points):
            return pa.array([""] * self.batch.num_rows, pa.string())
        kinds, which = np.unique(np.where(self.sung & (self.hundredths > 0), self.hundredths, -np.isin(self.points, [92, 123, 125]).astype(np.int64)), return_inverse=True)
        names = pa.array(["" if x == 0 else "\\" if x < 0 else f"{{\\kf{x}}}" for x in kinds.tolist()], pa.string())
        pieces = pc.binary_join_element_wise(names.take(pa.array(which)), self.chars, "")
        return pa.StringArray.from_buffers(self.batch.num_rows, pa.py_buffer(np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset :][self.edges].copy()), pieces.buffers()[2] or pa.py_buffer(b""))


def timed(lines: DataFrame, schema: str, emit: Callable[[TimedLines], pa.RecordBatch], songs: bool = False, fit: bool = True) -> DataFrame:
    """What emit gives for batches of lines; with songs, which then stand one after the other, of whole songs."""
    unsung = _unsung()
    small_batches(lines.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.zeros(0x110000, bool)
        marks[unsung] = True
        for batch in _units(batches, ["song_id"]) if songs else batches:
            if batch.num_rows:
                yield emit(TimedLines(batch, marks, fit))

    return lines.mapInArrow(run, schema)


def _key(lines: DataFrame) -> str:
    return ", ".join(f"{c} {lines.schema[c].dataType.simpleString()}" for c in ("song_id", "line_idx"))


def karaoke_lines(lines: DataFrame, fit: bool = True) -> DataFrame:
    """Rows (song_id, line_idx, karaoke) of the lines that have characters."""

    def emit(x: TimedLines) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([x.batch.column("song_id"), x.batch.column("line_idx"), x.karaoke()], ["song_id", "line_idx", "karaoke"])
        return out.filter(pa.array(x.shown()))

    return timed(lines, _key(lines) + ", karaoke string", emit, fit=fit)


def line_durations(lines: DataFrame) -> DataFrame:
    """Rows (song_id, line_idx, cs, durations): hundredths of each character of a line, in order, and their sum."""

    def emit(x: TimedLines) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(x.edges.astype(np.int32)), pa.array(x.hundredths))
        out = pa.RecordBatch.from_arrays([x.batch.column("song_id"), x.batch.column("line_idx"), pa.array(_sums(x.hundredths, x.edges)), lists], ["song_id", "line_idx", "cs", "durations"])
        return out.filter(pa.array(x.shown()))

    return timed(lines, _key(lines) + ", cs bigint, durations array<bigint>", emit)


def song_events(lines: DataFrame) -> DataFrame:
    """Rows (song_id, font_size, events) of the songs that have dialogue rows: a line's rows before, its karaoke after
    head (no row without characters or without head), and its rows after; all texts, null for none. Lines of a
    song stand one after the other, in order."""
    kind = lines.schema["song_id"].dataType.simpleString()

    def emit(x: TimedLines) -> pa.RecordBatch:
        head, before, after = (x.batch.column(c) for c in ("head", "before", "after"))
        main = pc.if_else(pa.array(x.shown()), pc.binary_join_element_wise(head, x.karaoke(), ""), pa.scalar(None, pa.string()))
        # of three texts a line, those that are there
        parts = pa.concat_arrays([before, main, after]).take(pa.array(np.arange(3 * len(main)).reshape(3, -1).T.ravel()))
        there = pc.is_valid(parts).to_numpy(zero_copy_only=False)
        song = np.nonzero(_changes(x.batch.column("song_id")))[0]
        edges = np.append(0, np.cumsum(there))[np.append(song * 3, len(parts))]
        events = pc.binary_join(pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), parts.drop_null()), "\n")
        at = pa.array(song)
        out = pa.RecordBatch.from_arrays([x.batch.column("song_id").take(at), x.batch.column("font_size").take(at), events], ["song_id", "font_size", "events"])
        return out.filter(pa.array(np.diff(edges) > 0))

    return timed(lines, f"song_id {kind}, font_size bigint, events string", emit, songs=True)


def character_rows(lines: DataFrame) -> DataFrame:
    """Rows (song_id, line_idx, token_idx, char_idx, text, sung, duration_cs)."""

    def emit(x: TimedLines) -> pa.RecordBatch:
        size = np.diff(x.token_edges)
        token = pa.array(np.repeat(np.arange(len(size)), size))
        place = np.arange(len(x.points)) - np.repeat(x.token_edges[:-1], size)
        line = pa.array(np.repeat(np.arange(x.batch.num_rows), np.diff(x.edges)))
        columns = [x.batch.column("song_id").take(line), x.batch.column("line_idx").take(line), x.batch.column("token_idx").flatten().take(token), pa.array(place), x.chars, pa.array(x.sung), pa.array(x.hundredths)]
        return pa.RecordBatch.from_arrays(columns, ["song_id", "line_idx", "token_idx", "char_idx", "text", "sung", "duration_cs"])

    return timed(lines, _key(lines) + ", token_idx bigint, char_idx bigint, text string, sung boolean, duration_cs bigint", emit)
