"""Word-based alignment of a lyric corpus.

Two small helpers work on one line or one song: matching blocks of mora sequences, and the alignment of a song's lines
with its segments. The latter first bounds every match by the moras in common, finds by these bounds which pairs can
lie on a best path at all, and scores only those; its memory is a few rows of the table and a byte a cell."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions.text import normalise_reading, split_moras
from ..sources.shared import settle
from . import intervals as iv

# fixed values: costs of the alignment of lines with segments, and the least share of matched moras
SKIP_LINE, SKIP_SEGMENT, MATCH_BASE, PAIR = -0.35, -0.15, -0.8, -0.05
LEAST_MATCH = 0.15


#: Lines and segments of a move, and its cost besides a match's gain.
_MOVES = [(1, 0, SKIP_LINE), (0, 1, SKIP_SEGMENT), (1, 1, 0.0), (1, 2, PAIR), (2, 1, PAIR)]


def matching_blocks(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int]]:
    """Blocks (i, j, size) of equal stretches of two arrays: the longest one, the first in a and then in b of those,
    and so on before and after it. All stretches that no neighbour extends are found once, by diagonal; a part of
    the table sees them cut to it."""
    i, j = np.nonzero(a[:, None] == b[None, :])
    order = np.lexsort((i, j - i))
    i, j = i[order], j[order]
    first = np.nonzero(np.append(True, (i[1:] != i[:-1] + 1) | (j[1:] != j[:-1] + 1)))[0] if len(i) else i
    size = np.diff(np.append(first, len(i)))
    i, j = i[first], j[first]
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        skip = np.maximum(0, np.maximum(i0 - i, j0 - j))
        left = np.minimum(size, np.minimum(i1 - i, j1 - j)) - skip
        if not len(left) or (most := int(left.max())) <= 0:
            continue
        x, y = min(zip((i + skip)[left == most].tolist(), (j + skip)[left == most].tolist()))
        out.append((x, y, most))
        todo += [(i0, x, j0, y), (x + most, i1, y + most, j1)]
    return sorted(out)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of two arrays that lies in matching blocks, from 0 to 1."""
    n = len(a) + len(b)
    return 2.0 * sum(k for *_, k in matching_blocks(a, b)) / n if n else 1.0


def seq_blocks(a: Column, b: Column) -> Column:
    """Matching blocks of two arrays of texts, as an array of (a, b, size)."""

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([[list(m) for m in matching_blocks(*_numbered([list(p), list(q)]))] for p, q in zip(x, y)])

    return F.transform(run(a, b), lambda m: F.struct(m[0].alias("a"), m[1].alias("b"), m[2].alias("size")))


def _numbered(rows: list[list[str]]) -> list[np.ndarray]:
    number: dict[str, int] = {}
    return [np.array([number.setdefault(x, len(number)) for x in row], np.int64) for row in rows]


class _Bounds:
    """Upper bounds of the scores of a song's matches, row by row of its table, from the moras in common."""

    #: Rows that are bounded together; of all others nothing is held but every ROWS-th row.
    ROWS = 64

    def __init__(self, lines: list[np.ndarray], segments: list[np.ndarray]):
        self.n, self.m = len(lines), len(segments)
        self.size = [np.array([len(x) for x in side], float) for side in (lines, segments)]
        # a column for the k-th time that a mora stands in a line: the dot product counts moras in common
        place: dict[tuple[int, int], int] = {}
        at: list[list[list[int]]] = [[], []]
        for side, rows in enumerate((lines, segments)):
            for row in rows:
                seen: dict[int, int] = {}
                mine = []
                for x in row.tolist():
                    seen[x] = seen.get(x, 0) + 1
                    mine.append(place.setdefault((x, seen[x]), len(place)))
                at[side].append(mine)
        self.lines, self.width = at[0], max(1, len(place))
        self.segments = np.zeros((self.width, self.m), np.float32)
        for k, mine in enumerate(at[1]):
            self.segments[mine, k] = 1
        self.block = (-1, np.zeros((0, 0), np.float32))
        #: Scores that are known, by line and kind of match.
        self.exact: list[list[dict[int, float]]] = [[{}, {}, {}] for _ in lines]

    def common(self, i: int) -> np.ndarray:
        """Moras that line i has in common with each segment."""
        k = i // self.ROWS
        if self.block[0] != k:
            rows = self.lines[k * self.ROWS : (k + 1) * self.ROWS]
            here = np.zeros((len(rows), self.width), np.float32)
            for r, mine in enumerate(rows):
                here[r, mine] = 1
            self.block = k, here @ self.segments
        return self.block[1][i % self.ROWS]

    def gains(self, i: int) -> list[np.ndarray]:
        """Bounds of the matches that end with line i: with segment j, with j - 1 and j, and of line i - 1 too; the
        score itself where it is known."""
        def bound(common: np.ndarray, a: float, b: np.ndarray) -> np.ndarray:
            size = a + b
            share = np.divide(2 * np.minimum(common, np.minimum(a, b)), size, out=np.ones(len(b)), where=size > 0)
            return 2 * share + MATCH_BASE

        here, (a, b) = self.common(i).astype(float), self.size
        one = bound(here, a[i], b)
        two = bound(np.append(0, here[:-1]) + here, a[i], np.append(0, b[:-1]) + b)
        two[:1] = -np.inf
        before = bound(self.common(i - 1) + here, a[i - 1] + a[i], b) if i else np.full(self.m, -np.inf)
        out = [one, two + PAIR, before + PAIR]
        for row, exact in zip(out, self.exact[i]):
            if exact:
                row[list(exact)] = list(exact.values())
        return out

    def forward(self, i: int, above: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Row i of the bounds of paths from the beginning, from the two rows above, and the move that gives each."""
        step = SKIP_SEGMENT * np.arange(self.m + 1)
        if not i:
            return step, np.full(self.m + 1, 1, np.uint8)
        one, two, before = self.gains(i - 1)
        ways = np.full((4, self.m + 1), -np.inf)
        ways[0] = above[-1] + SKIP_LINE
        ways[1, 1:] = above[-1][:-1] + one
        ways[2, 2:] = above[-1][:-2] + two[1:]
        if i > 1:
            ways[3, 1:] = above[-2][:-1] + before
        move = ways.argmax(0)
        top = ways[move, np.arange(self.m + 1)]
        best = np.maximum.accumulate(top - step) + step
        return best, np.where(best > top + 1e-9, 1, np.array([0, 2, 3, 4])[move]).astype(np.uint8)

    def backward(self, i: int, below: list[np.ndarray]) -> np.ndarray:
        """Row i of the bounds of paths to the end, from the two rows below."""
        if i == self.n:
            return np.zeros(self.m + 1)
        one, two, _ = self.gains(i)
        best = below[0] + SKIP_LINE
        best[:-1] = np.maximum(best[:-1], below[0][1:] + one)
        best[:-2] = np.maximum(best[:-2], below[0][2:] + two[1:])
        if i + 1 < self.n:
            best[:-1] = np.maximum(best[:-1], below[1][1:] + self.gains(i + 1)[2])
        step = SKIP_SEGMENT * np.arange(self.m + 1)
        return np.maximum.accumulate((best + step)[::-1])[::-1] - step


def _band(bounds: _Bounds, score, near: int = 2) -> list[np.ndarray]:  # noqa: ANN001
    """By row the columns that a best path can touch. The best path by the bounds is scored, with what lies `near` it,
    and these scores take the place of their bounds, until such a path has scores only: no path is better than it,
    and a column stays where the bounds of the paths through it are no less."""
    n, m, every = bounds.n, bounds.m, bounds.ROWS
    while True:
        kept: dict[int, np.ndarray] = {}
        moves, above = np.zeros((n + 1, m + 1), np.uint8), []
        for i in range(n + 1):
            row, moves[i] = bounds.forward(i, above)
            above = [*above[-1:], row]
            if i % every < 2:
                kept[i] = row
        i, j, least = n, int(above[-1].argmax()), float(above[-1].max())
        new = False
        while i or j:
            di, dj = [(1, 0), (0, 1), (1, 1), (1, 2), (2, 1)][moves[i, j] if i else 1]
            if di and dj and j - 1 not in bounds.exact[i - 1][dj - 1 if di == 1 else 2]:
                new = True
                for c in range(max(1, j - near), min(m, j + near) + 1):
                    for exact, (a, b, cost) in zip(bounds.exact[i - 1], [(1, 1, 0.0), (1, 2, PAIR), (2, 1, PAIR)]):
                        if a <= i and b <= c and c - 1 not in exact:
                            exact[c - 1] = score(i - a, i, c - b, c) + cost
            i, j = i - di, j - dj
        del moves
        if not new:
            break
    band: list[np.ndarray] = [np.zeros(0, np.int64)] * (n + 1)
    below: list[np.ndarray] = []
    for k in range(n // every, -1, -1):
        first, rows = k * every, {}
        for i in range(first, min(n, first + every - 1) + 1):
            rows[i] = kept[i] if i in kept else bounds.forward(i, [rows[i - 2], rows[i - 1]])[0]
        for i in sorted(rows, reverse=True):
            row = bounds.backward(i, below)
            below = [row, *below[:1]]
            band[i] = np.nonzero(rows[i] + row >= least - 1e-6)[0]
    return band


def _windows_of_song(lines: list[list[str]], segments: list[tuple[list[str], int, int]]) -> dict[int, tuple[int, int]]:
    """Windows of a song's lines (moras) by its segments (moras, start, end). Moves: leave out a line or a
    segment, or match one with one, one with two, two with one; the first of equal moves; segments after the
    last line cost nothing."""
    numbers = _numbered([*lines, *(s[0] for s in segments)])
    x, y = numbers[: len(lines)], numbers[len(lines) :]
    known: dict[tuple[int, int, int, int], float] = {}

    def score(i0: int, i1: int, j0: int, j1: int) -> float:
        key = i0, i1, j0, j1
        if key not in known:
            known[key] = likeness(np.concatenate(x[i0:i1]), np.concatenate(y[j0:j1])) * 2 + MATCH_BASE
        return known[key]

    rows: list[dict[int, tuple[float, tuple[int, int]]]] = []
    for i, columns in enumerate(_band(_Bounds(x, y), score)):
        rows.append({})
        for j in columns.tolist():
            top, move = (0.0, (0, 0)) if not i + j else (-np.inf, None)
            for di, dj, cost in _MOVES:
                if di > i or dj > j or not i + j or (before := rows[i - di].get(j - dj)) is None:
                    continue
                total = before[0] + (score(i - di, i, j - dj, j) if di and dj else 0.0) + cost
                if total > top:
                    top, move = total, (di, dj)
            if move:
                rows[i][j] = top, move
    i, j = len(lines), max(rows[-1], key=lambda k: (rows[-1][k][0], -k))
    out: dict[int, tuple[int, int]] = {}
    while i or j:
        di, dj = rows[i][j][1]
        if di == 1 and dj:
            out[i - 1] = segments[j - dj][1], segments[j - 1][2]
        elif di == 2:
            a, z = segments[j - 1][1:]
            n, m = max(1, len(lines[i - 2])), max(1, len(lines[i - 1]))
            cut = a + (z - a) * n // (n + m)
            out[i - 2], out[i - 1] = (a, cut), (cut, z)
        i, j = i - di, j - dj
    return out


def line_windows(lines: DataFrame, segments: DataFrame) -> DataFrame:
    """Windows (song_id, line_idx, w_start, w_end) of the lines (song_id, line_idx, moras) that segments
    (song_id, seg_idx, moras, start_ms, end_ms) match."""
    kind = lines.schema["song_id"].dataType.simpleString()
    segments = segments.select(*[F.col(c).alias(c) for c in segments.columns])  # the two sides may share a source

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values("line_idx"), b.sort_values("seg_idx")
        if a.empty or b.empty:
            return pd.DataFrame({"song_id": [], "line_idx": [], "w_start": [], "w_end": []})
        found = _windows_of_song([list(m) for m in a["moras"]], [(list(m), int(s), int(e)) for m, s, e in zip(b["moras"], b["start_ms"], b["end_ms"])])
        ids = a["line_idx"].tolist()
        rows = [(a["song_id"].iloc[0], ids[k], s, e) for k, (s, e) in sorted(found.items())]
        return pd.DataFrame(rows, columns=["song_id", "line_idx", "w_start", "w_end"])

    return lines.groupBy("song_id").cogroup(segments.groupBy("song_id")).applyInPandas(run, f"song_id {kind}, line_idx bigint, w_start bigint, w_end bigint")


def mora_matches(targets: DataFrame, seen: DataFrame) -> DataFrame:
    """Matches (song_id, seq, start_ms, end_ms) of targets (song_id, line_idx, seq, reading) with the
    observations of their line (song_id, line_idx, obs_idx, reading, start_ms, end_ms), by matching blocks."""
    a = targets.groupBy("song_id", "line_idx").agg(F.sort_array(F.collect_list(F.struct("seq", "reading"))).alias("t"))
    b = seen.groupBy("song_id", "line_idx").agg(F.sort_array(F.collect_list(F.struct("obs_idx", "reading", "start_ms", "end_ms"))).alias("o"))
    met = a.join(b, ["song_id", "line_idx"]).withColumn("m", F.explode(seq_blocks(F.transform("t", lambda x: x["reading"]), F.transform("o", lambda x: x["reading"]))))
    pair = met.select("song_id", "t", "o", "m", F.explode(F.sequence(F.lit(0), F.col("m.size") - 1)).alias("k"))
    return pair.select("song_id", F.get("t", F.col("m.a") + F.col("k"))["seq"].alias("seq"), F.get("o", F.col("m.b") + F.col("k"))["start_ms"].alias("start_ms"), F.get("o", F.col("m.b") + F.col("k"))["end_ms"].alias("end_ms"))


def target_moras(tokens: DataFrame) -> DataFrame:
    """Moras (song_id, line_idx, token_idx, mora_idx, seq, reading) of lyric tokens."""
    rows = tokens.select("song_id", "line_idx", "token_idx", F.posexplode(split_moras(normalise_reading(F.col("reading")))).alias("mora_idx", "mora"))
    place = F.row_number().over(W.partitionBy("song_id").orderBy("line_idx", "token_idx", "mora_idx")) - 1
    return rows.select("song_id", "line_idx", "token_idx", F.col("mora_idx").cast("long").alias("mora_idx"), place.cast("long").alias("seq"), F.col("mora").alias("reading"))


def observed_moras(words: DataFrame) -> DataFrame:
    """Timed moras (song_id, obs_idx, reading, start_ms, end_ms) of words (song_id, seg_idx, word_idx, text, ...)."""
    rows = iv.spread_moras(words, split_moras(normalise_reading(F.col("text"))))
    place = F.row_number().over(W.partitionBy("song_id").orderBy("seg_idx", "word_idx", "mora_idx")) - 1
    timed = rows.select("song_id", place.cast("long").alias("seq"), F.col("mora").alias("reading"), "start_ms", "end_ms")
    return iv.monotone(timed).withColumnRenamed("seq", "obs_idx")


def align_corpus(lines: DataFrame, tokens: DataFrame, segments: DataFrame, words: DataFrame, durations: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Word-based timelines of a corpus: tables timelines, lines, tokens and moras, and rejects (song_id,
    reason) of songs without words or with too few matches. lines: song_id, line_idx, surface, reading;
    tokens: song_id, line_idx, token_idx, surface, reading; durations: song_id, duration_ms."""
    targets = settle(target_moras(tokens), "targets")
    obs = settle(observed_moras(words), "observations")
    moras_of = lambda c: split_moras(normalise_reading(c))
    spoken = words.groupBy("song_id", "seg_idx").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word_idx", "text"))), lambda x: x["text"]), "").alias("said"))
    segs = segments.join(spoken, ["song_id", "seg_idx"], "left").select("song_id", "seg_idx", moras_of(F.coalesce(F.nullif("said", F.lit("")), "text")).alias("moras"), "start_ms", "end_ms")
    read = lines.select("song_id", "line_idx", moras_of(F.col("reading")).alias("moras"))
    songs = iv.upper_median(obs.withColumn("d", F.col("end_ms") - F.col("start_ms")), ["song_id"], "d").withColumnRenamed("median", "median_ms").join(obs.groupBy("song_id").agg(F.max_by("end_ms", "obs_idx").alias("last_end_ms")), "song_id")
    windows = read.select("song_id", "line_idx", F.size("moras").cast("long").alias("n_moras")).join(line_windows(read, segs), ["song_id", "line_idx"], "left")
    songs = settle(songs, "songs")
    windows = settle(iv.complete_line_windows(windows, songs).select("song_id", "line_idx", "w_start", "w_end"), "windows")
    seen = iv.assign_observations(obs, windows).select("song_id", "line_idx", "obs_idx", "reading", "start_ms", "end_ms")
    matches = settle(mora_matches(targets, seen), "matches")
    share = targets.groupBy("song_id").agg(F.count(F.lit(1)).alias("n")).join(matches.groupBy("song_id").agg(F.count(F.lit(1)).alias("hits")), "song_id", "left")
    verdict = lines.select("song_id").distinct().join(share, "song_id", "left").join(songs.select("song_id", F.lit(True).alias("heard")), "song_id", "left").select(
        "song_id", F.when(F.col("heard").isNull(), "no words").when(F.col("n").isNull() | (F.coalesce("hits", F.lit(0)) < F.col("n") * LEAST_MATCH), "too few matches").alias("reason"))
    verdict = settle(verdict, "verdicts")
    good = verdict.where("reason is null").select("song_id")
    info = songs.select("song_id", F.col("median_ms").alias("default_ms")).join(durations, "song_id").join(good, "song_id", "left_semi")
    timed = settle(iv.monotone(iv.interpolate_moras(targets, matches, windows, info)), "timed-moras")
    toks = settle(iv.assemble_tokens(tokens.join(good, "song_id", "left_semi"), timed, True), "timed-tokens")
    moras, toks_closed = iv.close_mora_gaps(timed, toks)
    return {
        "timelines": iv.confidence_rollup(timed), "lines": lines.join(iv.assemble_lines(toks), ["song_id", "line_idx"]), "tokens": toks_closed, "moras": moras,
    }, verdict.where("reason is not null")


def spans_in_song(targets: DataFrame, spans: DataFrame, activity: DataFrame) -> DataFrame:
    """Spans (song_id, seq, start_ms, end_ms, score) that were heard on the packed coarse ranges of activity (song_id,
    kind coarse or fine, range_idx, start_s, end_s), in the time of the song: unpacked, then a line's first start
    and last end set by the ranges as fix_line_starts and fix_line_ends say. targets: song_id, line_idx, seq."""
    ends = spans.select("song_id", "seq", F.explode(F.map_from_arrays(F.array(F.lit("start_ms"), F.lit("end_ms")), F.array(F.col("start_ms").cast("double"), F.col("end_ms").cast("double")))).alias("edge", "packed_ms"))
    coarse = activity.where("kind = 'coarse'")
    wide = iv.unpack_times(ends, coarse).groupBy("song_id", "seq").agg(*[F.max(F.when(F.col("edge") == c, F.col("source_ms"))).alias(c) for c in ("start_ms", "end_ms")])
    wide = settle(targets.select("song_id", "line_idx", "seq").join(wide, ["song_id", "seq"]), "song-spans")
    edge = lambda f, by: f(F.struct("seq", "start_ms", "end_ms"), "seq").alias(by)
    lines = wide.groupBy("song_id", "line_idx").agg(edge(F.min_by, "a"), edge(F.max_by, "z"))
    lines = lines.select("song_id", "line_idx", F.col("a.start_ms").alias("start_ms"), F.col("a.end_ms").alias("first_end_ms"), F.col("z.end_ms").alias("end_ms"), F.col("a.seq").alias("first_seq"), F.col("z.seq").alias("last_seq"), F.col("z.start_ms").alias("last_start_ms"))
    lines = iv.fix_line_starts(lines, activity)
    lines = lines.withColumn("last_start_ms", F.when(F.col("first_seq") == F.col("last_seq"), F.col("start_ms")).otherwise(F.col("last_start_ms")))
    fixed = iv.fix_line_ends(lines, activity).select("song_id", "line_idx", F.col("start_ms").alias("__s"), F.col("end_ms").alias("__e"), "first_seq", "last_seq")
    start, end = F.when(F.col("seq") == F.col("first_seq"), F.col("__s")).otherwise(F.col("start_ms")), F.when(F.col("seq") == F.col("last_seq"), F.col("__e")).otherwise(F.col("end_ms"))
    moved = wide.join(fixed, ["song_id", "line_idx"]).select("song_id", "seq", start.alias("start_ms"), end.alias("end_ms"))
    return moved.join(spans.select("song_id", "seq", "score"), ["song_id", "seq"])


def align_from_spans(tokens: DataFrame, targets: DataFrame, spans: DataFrame, activity: DataFrame | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """Timelines from acoustic spans (song_id, seq, start_ms, end_ms, score) of target moras: with activity taken back
    to the song's time (see spans_in_song), validated, put together and closed; rejects (song_id, reason)."""
    if activity is not None:
        spans = spans_in_song(targets, spans, activity)
    met = targets.join(spans, ["song_id", "seq"])
    expected = targets.groupBy("song_id").agg(F.count(F.lit(1)).alias("n"))
    met = settle(met, "span-moras")
    verdict = settle(iv.validate_spans(met, expected), "span-verdicts")
    good = verdict.where("reason is null").select("song_id")
    timed = met.join(good, "song_id", "left_semi").withColumns({"matched": F.lit(True), "confidence": F.col("score")})
    toks = settle(iv.assemble_tokens(tokens.join(good, "song_id", "left_semi"), timed, False), "span-tokens")
    moras, closed = iv.close_mora_gaps(timed.drop("score"), toks)
    return {"timelines": iv.score_rollup(timed), "lines": iv.assemble_lines(toks), "tokens": closed, "moras": moras}, verdict.where("reason is not null")
