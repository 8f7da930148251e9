"""Time-interval operators over song tables: spreading, gap filling, clamping, activity, span repair, retiming.

Times are whole milliseconds (BIGINT) and activity ranges seconds (DOUBLE). Everything is local to a song,
so one partitioning by song_id serves a chain of these operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import normalise_reading, split_moras
from ..sources.shared import small_side

SONG, LINE, TOKEN = ["song_id"], ["song_id", "line_idx"], ["song_id", "line_idx", "token_idx"]
_BEFORE, _AFTER = (W.unboundedPreceding, -1), (1, W.unboundedFollowing)


def floor_div(a: Column, b: Column) -> Column:
    """Division rounded down, also below zero; exact for whole numbers."""
    return F.floor((a - F.pmod(a, b)) / b).cast("long")


def spread_moras(words: DataFrame, moras: Column) -> DataFrame:
    """Rows (words' columns, mora_idx, mora, start_ms, end_ms): a timed word shared evenly, rounded down.
    Words without moras give none."""
    rows = words.withColumns({"__s": F.col("start_ms"), "__d": F.col("end_ms") - F.col("start_ms"), "__n": F.size(moras)})
    keep = [c for c in words.columns if c not in ("start_ms", "end_ms")]
    out = rows.where("__n > 0").select(*keep, "__s", "__d", "__n", F.posexplode(moras).alias("mora_idx", "mora"))
    share = lambda k: F.col("__s") + floor_div(F.col("__d") * k, F.col("__n"))
    return out.select(*keep, F.col("mora_idx").cast("long").alias("mora_idx"), "mora", share(F.col("mora_idx")).alias("start_ms"), share(F.col("mora_idx") + 1).alias("end_ms"))


def monotone(spans: DataFrame, keys: list[str] = SONG, order: str = "seq") -> DataFrame:
    """Starts not before the end before them, ends not before their starts."""
    w = W.partitionBy(*keys).orderBy(order)
    top = F.max(F.greatest("start_ms", "end_ms"))
    return spans.withColumns({
        "start_ms": F.greatest(F.col("start_ms"), top.over(w.rowsBetween(*_BEFORE))),
        "end_ms": top.over(w.rowsBetween(W.unboundedPreceding, 0)),
    })


def close_mora_gaps(moras: DataFrame, tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Moras reach to the next mora's start in their line; token edges follow, and tokens without moras
    inside a closed gap collapse to its end. Gaps between lines stay."""
    w = W.partitionBy(*LINE).orderBy("token_idx", "mora_idx")
    wide = moras.withColumns({"__next": F.lead("start_ms").over(w), "__prev": F.lag("end_ms").over(w)})
    closed = wide.withColumn("end_ms", F.greatest("end_ms", "__next")).drop("__next", "__prev")
    edge = wide.groupBy(*TOKEN).agg(F.min_by("start_ms", "mora_idx").alias("__s"), F.max_by("end_ms", "mora_idx").alias("__e"), F.max_by("__next", "mora_idx").alias("__n"), F.min_by("__prev", "mora_idx").alias("__p"))
    t = W.partitionBy(*LINE).orderBy("token_idx")
    met = tokens.join(edge, TOKEN, "left").withColumns({
        "__le": F.last("__e", ignorenulls=True).over(t.rowsBetween(*_BEFORE)),
        "__fs": F.first("__s", ignorenulls=True).over(t.rowsBetween(*_AFTER)),
    })
    gap = F.col("__s").isNull() & (F.col("__le") < F.col("__fs"))
    out = met.withColumns({
        "__start": F.when(gap, F.col("__fs")).when(F.col("__p") < F.col("__s"), F.col("__s")).otherwise(F.col("start_ms")),
        "__end": F.when(gap, F.col("__fs")).when(F.col("__e") < F.col("__n"), F.col("__n")).otherwise(F.col("end_ms")),
    })
    return closed, out.withColumns({"start_ms": F.col("__start"), "end_ms": F.col("__end")}).select(*tokens.columns)


def upper_median(rows: DataFrame, keys: list[str], value: str, default: int = 200) -> DataFrame:
    """Per key, the upper middle of the positive whole numbers, or the default where there is none. Values are
    counted before they are shuffled, so a key holds a count for each different one, not its rows."""
    middle = F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY CASE WHEN `{value}` > 0 THEN `{value}` END DESC)")
    return rows.groupBy(*keys).agg(F.coalesce(middle, F.lit(default)).cast("long").alias("median"))


def assign_observations(obs: DataFrame, windows: DataFrame, bin_ms: int = 10_000) -> DataFrame:
    """Pairs of line windows (song_id, line_idx, w_start, w_end) and observations (song_id, obs_idx, start_ms,
    end_ms) whose middle, rounded down, lies in the window, both ends included. Windows are dealt to bins of
    time, so the join is an equality join."""
    mid = floor_div(F.col("start_ms") + F.col("end_ms"), F.lit(2))
    a = obs.withColumn("mid", mid).withColumn("bin", floor_div(F.col("mid"), F.lit(bin_ms)))
    b = windows.where("w_end >= w_start").withColumn("bin", F.explode(F.sequence(floor_div(F.col("w_start"), F.lit(bin_ms)), floor_div(F.col("w_end"), F.lit(bin_ms)))))
    return a.join(b, ["song_id", "bin"]).where("mid between w_start and w_end").drop("bin", "mid")


def interpolate_moras(targets: DataFrame, matches: DataFrame, windows: DataFrame, songs: DataFrame) -> DataFrame:
    """Times for every target mora (song_id, line_idx, seq, ...): matched ones (song_id, seq, start_ms, end_ms)
    keep theirs; a run of others shares the time between its neighbours, or from the neighbour to the line
    window's edge (before the first match at most default_ms each), or the whole window; shares round down.
    songs has song_id, default_ms and duration_ms. Adds start_ms, end_ms, matched, confidence."""
    base = targets.join(matches.select("song_id", "seq", "start_ms", "end_ms"), ["song_id", "seq"], "left").join(windows, LINE, "left").join(songs, "song_id")
    line = W.partitionBy(*LINE).orderBy("seq")
    whole = W.partitionBy(*LINE).orderBy("seq").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    hit = F.col("start_ms").isNotNull()
    rows = base.withColumns({
        "__pe": F.last("end_ms", ignorenulls=True).over(line.rowsBetween(*_BEFORE)),
        "__fs": F.first("start_ms", ignorenulls=True).over(line.rowsBetween(*_AFTER)),
        "__isle": F.sum(hit.cast("int")).over(line),
        "__ws": F.coalesce("w_start", F.first("start_ms").over(whole), F.lit(0)),
        "__we": F.coalesce("w_end", F.last("end_ms").over(whole), F.col("duration_ms")),
    })
    isle = W.partitionBy(*LINE, "__isle", hit)
    rows = rows.withColumns({"__k": F.row_number().over(isle.orderBy("seq")) - 1, "__n": F.count(F.lit(1)).over(isle)})
    pe, fs, ws, we = (F.col(c) for c in ("__pe", "__fs", "__ws", "__we"))
    start = F.when(pe.isNotNull(), pe).when(fs.isNotNull(), F.greatest(ws, fs - F.col("default_ms") * F.col("__n"))).otherwise(ws)
    end = (
        F.when(pe.isNotNull() & fs.isNotNull(), F.greatest(pe, fs)).when(fs.isNotNull(), fs).when(pe.isNotNull(), F.greatest(pe, we))
        .otherwise(F.greatest(ws, F.least(F.col("duration_ms"), we)))
    )
    rows = rows.withColumns({"__s": start, "__d": end - start})
    share = lambda k: F.col("__s") + floor_div(F.col("__d") * k, F.col("__n"))
    return rows.withColumns({
        "matched": hit, "confidence": hit.cast("double"),
        "start_ms": F.when(hit, F.col("start_ms")).otherwise(share(F.col("__k"))), "end_ms": F.when(hit, F.col("end_ms")).otherwise(share(F.col("__k") + 1)),
    }).select(*targets.columns, "start_ms", "end_ms", "matched", "confidence")


def complete_line_windows(lines: DataFrame, songs: DataFrame) -> DataFrame:
    """Adds windows to lines (song_id, line_idx, n_moras, w_start, w_end) that lack one: a gap between
    windows is shared by mora counts, rounded half to even and cut at the next start. songs has song_id,
    median_ms and last_end_ms. Songs without any window give no rows."""
    w = W.partitionBy("song_id").orderBy("line_idx")
    has = F.col("w_start").isNotNull()
    rows = lines.join(songs, "song_id").withColumns({
        "__any": F.max(has).over(W.partitionBy("song_id")), "__isle": F.sum(has.cast("int")).over(w), "__len": F.greatest(F.lit(1), F.col("n_moras")),
        "__pe": F.last("w_end", ignorenulls=True).over(w.rowsBetween(*_BEFORE)), "__fs": F.first("w_start", ignorenulls=True).over(w.rowsBetween(*_AFTER)),
    }).where("__any")
    isle = W.partitionBy("song_id", "__isle", has)
    total = F.sum("__len").over(isle) * F.col("median_ms")
    nxt = F.coalesce("__fs", "last_end_ms")
    prev = F.coalesce(F.col("__pe"), F.greatest(F.lit(0), nxt - total))
    rows = rows.withColumns({"__next": nxt, "__prev": prev, "__total": total})
    scale = F.greatest(F.lit(0), F.col("__next") - F.col("__prev")) / F.greatest(F.lit(1), F.col("__total"))
    rows = rows.withColumn("__d", F.bround(F.col("__len") * F.col("median_ms") * scale).cast("long"))
    run = F.sum("__d").over(isle.orderBy("line_idx"))
    rows = rows.withColumns({"__run": run, "__first": F.row_number().over(isle.orderBy("line_idx")) == 1})
    start = F.when(F.col("__first"), F.col("__prev")).otherwise(F.least(F.col("__prev") + F.col("__run") - F.col("__d"), F.col("__next")))
    return rows.withColumns({
        "w_end": F.when(has, F.col("w_end")).otherwise(F.least(F.col("__prev") + F.col("__run"), F.col("__next"))),
        "w_start": F.when(has, F.col("w_start")).otherwise(start),
    }).select(*lines.columns)


def activity_ranges(frames: DataFrame, hop_s: float, frame_s: float, duration: DataFrame, top_percent: float = 90.0, ratio: float = 0.1) -> DataFrame:
    """Rows (song_id, range_idx, start_s, end_s): runs of frames whose energy is over a percentile of the
    song's times ratio, widened by a quarter frame and kept inside the duration (song_id, duration_s)."""
    limit = frames.groupBy("song_id").agg((F.percentile("rms", (100 - top_percent) / 100) * ratio).alias("__limit"), F.max("frame_idx").alias("__last"))
    w = W.partitionBy("song_id").orderBy("frame_idx")
    on = frames.join(limit, "song_id").withColumn("__on", F.col("rms") > F.col("__limit"))
    edge = on.withColumn("__isle", F.sum((F.col("__on") & ~F.coalesce(F.lag("__on").over(w), F.lit(False))).cast("int")).over(w)).where("__on")
    runs = edge.groupBy("song_id", "__isle", "__last").agg(F.min("frame_idx").alias("__a"), F.max("frame_idx").alias("__b")).join(duration, "song_id")
    start = F.greatest(F.col("__a") * F.lit(hop_s) - F.lit(frame_s / 4), F.lit(0.0))
    end = F.when(F.col("__b") == F.col("__last"), F.col("__last") * F.lit(hop_s)).otherwise((F.col("__b") + 1) * F.lit(hop_s) + F.lit(frame_s / 4))
    out = runs.select("song_id", "__isle", start.alias("start_s"), F.least(end, F.col("duration_s")).alias("end_s")).where("end_s > start_s")
    return out.withColumn("range_idx", (F.row_number().over(W.partitionBy("song_id").orderBy("__isle")) - 1).cast("long")).select("song_id", "range_idx", "start_s", "end_s")


def frame_rms(samples: DataFrame, frame: int) -> DataFrame:
    """Rows (song_id, frame_idx, rms) of (song_id, sample_idx, value): centred frames of `frame` samples every
    half frame, zeros outside; each sample is sent to the frames that hold it and sums combine map-side."""
    hop = max(1, frame // 2)
    lo = F.greatest(F.lit(0), F.ceil((F.col("sample_idx") + 1 - (frame - frame // 2)) / hop))
    rows = samples.withColumn("frame_idx", F.explode(F.sequence(lo.cast("long"), F.floor((F.col("sample_idx") + frame // 2) / hop).cast("long"))))
    size = samples.groupBy("song_id").agg((F.floor((F.max("sample_idx") + 1) / hop)).alias("__last"))
    sums = rows.groupBy("song_id", "frame_idx").agg(F.sum(F.col("value") * F.col("value")).alias("__e"))
    return sums.join(size, "song_id").where("frame_idx <= __last").select("song_id", "frame_idx", F.sqrt(F.col("__e") / frame).alias("rms"))


def unpack_times(times: DataFrame, activity: DataFrame) -> DataFrame:
    """Adds source_ms to times (song_id, packed_ms): packed time runs through the activity ranges one after
    the other; past them lies the last end, and without ranges time stays. A running sum and a backward
    as-of join, done by a union and a window."""
    w = W.partitionBy("song_id").orderBy("range_idx")
    r = activity.withColumn("__len", F.col("end_s") - F.col("start_s")).withColumn("__to", F.sum("__len").over(w)).withColumn("__from", F.coalesce(F.lag("__to").over(w), F.lit(0.0)))
    last = r.groupBy("song_id").agg(F.max_by("end_s", "range_idx").alias("__last"))
    t = times.withColumn("__row", F.struct(*times.columns)).select("song_id", (F.col("packed_ms") / 1000).alias("__at"), F.lit(1).alias("__k"), "__row", F.lit(None).cast("struct<f:double,s:double,t:double>").alias("__r"))
    m = r.select("song_id", F.col("__from").alias("__at"), F.lit(0).alias("__k"), F.lit(None).cast(t.schema["__row"].dataType).alias("__row"), F.struct(F.col("__from").alias("f"), F.col("start_s").alias("s"), F.col("__to").alias("t")).alias("__r"))
    seen = F.last("__r", ignorenulls=True).over(W.partitionBy("song_id").orderBy("__at", "__k").rowsBetween(W.unboundedPreceding, 0))
    out = t.unionByName(m).withColumn("__r", seen).where("__k = 1").join(last, "song_id", "left")
    inside = F.bround((F.col("__r.s") + F.col("__at") - F.col("__r.f")) * 1000)
    source = F.when(F.col("__last").isNull(), F.bround(F.col("__at") * 1000)).when(F.col("__at") < F.col("__r.t"), inside).otherwise(F.bround(F.col("__last") * 1000))
    return out.select("__row.*", source.cast("long").alias("source_ms"))


def _range_ms(activity: DataFrame, kind: str) -> DataFrame:
    return activity.where(F.col("kind") == kind).select("song_id", "range_idx", F.bround(F.col("start_s") * 1000).cast("long").alias("r_start"), F.ceil(F.col("end_s") * 1000).cast("long").alias("r_end"))


def _at_ranges(lines: DataFrame, ranges: DataFrame, at: str, bin_ms: int) -> tuple[DataFrame, DataFrame, Column]:
    """Lines and ranges dealt to bins of time, ranges to all that they touch, and the condition that a range
    holds the time `at` of a line."""
    bins = F.sequence(floor_div(F.col("r_start"), F.lit(bin_ms)), floor_div(F.greatest("r_start", "r_end"), F.lit(bin_ms)))
    r = ranges.withColumn("__rbin", F.explode(bins)).withColumnRenamed("song_id", "__song")
    a = lines.withColumn("__bin", floor_div(F.col(at), F.lit(bin_ms)))
    return a, r, (F.col("song_id") == F.col("__song")) & (F.col("__bin") == F.col("__rbin")) & F.col(at).between(F.col("r_start"), F.col("r_end"))


def uncovered_lines(lines: DataFrame, activity: DataFrame, bin_ms: int = 10_000) -> DataFrame:
    """Lines that no single coarse range covers. Ranges are dealt to bins of time."""
    a, r, held = _at_ranges(lines, _range_ms(activity, "coarse"), "start_ms", bin_ms)
    return a.join(r, held & (F.col("r_end") >= F.col("end_ms")), "left_anti").select(*lines.columns)


def fix_line_starts(lines: DataFrame, activity: DataFrame, bin_ms: int = 10_000) -> DataFrame:
    """Lines (song_id, line_idx, start_ms, first_end_ms, end_ms): where no coarse range covers a line, it starts
    with the first one that holds its end, but not after its first mora's end."""
    a, r, held = _at_ranges(uncovered_lines(lines, activity, bin_ms), _range_ms(activity, "coarse"), "end_ms", bin_ms)
    hit = a.join(r, held).groupBy(*LINE).agg(F.min_by("r_start", "range_idx").alias("__s"))
    return lines.join(hit, LINE, "left").withColumn("start_ms", F.when(F.col("__s").isNotNull(), F.least("first_end_ms", "__s")).otherwise(F.col("start_ms"))).drop("__s")


def fix_line_ends(lines: DataFrame, activity: DataFrame, bin_ms: int = 10_000) -> DataFrame:
    """Lines (song_id, line_idx, start_ms, last_start_ms, end_ms): the end moves to the first fine range's end
    between it and the next line's start; else, where one range spans the gap, to 20 ms before that start. Gaps are
    dealt to bins of time, up to the song's last range; whether a range spans one is told by the largest end of the
    ranges that begin before it, a running maximum."""
    w = W.partitionBy("song_id").orderBy("line_idx")
    rows = lines.withColumn("__next", F.lead("start_ms").over(w))
    r = _range_ms(activity, "fine").select(F.col("song_id").alias("__song"), "range_idx", "r_start", "r_end")
    last = r.groupBy("__song").agg(F.max("r_end").alias("__last"))
    gaps = rows.select(*LINE, "end_ms", "__next").join(last, F.col("song_id") == F.col("__song")).drop("__song")
    gaps = gaps.withColumn("__to", F.least("__last", F.coalesce(F.col("__next") - 1, F.col("__last")))).where("__to >= end_ms")
    gaps = gaps.withColumn("__bin", F.explode(F.sequence(floor_div(F.col("end_ms"), F.lit(bin_ms)), floor_div(F.col("__to"), F.lit(bin_ms)))))
    ends = r.withColumn("__rbin", floor_div(F.col("r_end"), F.lit(bin_ms)))
    held = (F.col("song_id") == F.col("__song")) & (F.col("__bin") == F.col("__rbin")) & F.col("r_end").between(F.col("end_ms"), F.col("__to"))
    first = gaps.join(ends, held).groupBy(*LINE).agg(F.min_by("r_end", "range_idx").alias("__c"))
    marks = r.select(F.col("__song").alias("song_id"), F.col("r_start").alias("__at"), F.lit(0).alias("__k"), F.lit(None).cast("long").alias("line_idx"), F.col("r_end").alias("__e"), F.lit(None).cast("long").alias("__next"))
    probes = rows.select("song_id", F.col("end_ms").alias("__at"), F.lit(1).alias("__k"), "line_idx", F.lit(None).cast("long").alias("__e"), "__next")
    most = F.max("__e").over(W.partitionBy("song_id").orderBy("__at", "__k").rowsBetween(W.unboundedPreceding, 0))
    over = marks.unionByName(probes).withColumn("__most", most).where("__k = 1").select(*LINE, (F.col("__most") >= F.col("__next")).alias("__over"))
    end = F.when(F.col("__c").isNotNull(), F.greatest("last_start_ms", "__c")).when(F.col("__over"), F.greatest(F.col("end_ms"), F.col("__next") - 20)).otherwise(F.col("end_ms"))
    return rows.join(first, LINE, "left").join(over, LINE, "left").withColumn("end_ms", end).select(*lines.columns)


def token_scores(frame_spans: DataFrame, keys: list[str]) -> DataFrame:
    """Per key, the mean score weighted by frames (at least one a span), between 0 and 1."""
    n = F.greatest(F.lit(1), F.col("end_frame") - F.col("start_frame"))
    return frame_spans.groupBy(*keys).agg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.sum(F.col("score") * n) / F.sum(n))).alias("score"))


def validate_spans(spans: DataFrame, expected: DataFrame, max_ms: int = 15_000, least: float = 0.15) -> DataFrame:
    """Per song of expected (song_id, n), the first reason against its spans (song_id, line_idx, seq, start_ms,
    end_ms, score), or null."""
    w = W.partitionBy("song_id").orderBy("seq")
    s, e = F.col("start_ms"), F.col("end_ms")
    bad = (
        F.when((s < F.coalesce(F.lag("end_ms").over(w), F.lit(0))) | (e < s) | ~F.col("score").between(0, 1), "invalid span")
        .when(e == s, "span without duration").when(e - s > max_ms, "span too long")
    )
    first = spans.withColumn("__bad", bad).groupBy("song_id").agg(F.min_by("__bad", F.when(F.col("__bad").isNotNull(), F.col("seq"))).alias("__bad"), F.count(F.lit(1)).alias("__n"), F.avg("score").alias("__mean"))
    lines = spans.groupBy(*LINE).agg(F.avg("score").alias("__c")).where(F.col("__c") < least).groupBy("song_id").agg(F.min("line_idx").alias("__line"))
    met = expected.join(first, "song_id", "left").join(lines, "song_id", "left")
    return met.select("song_id", F.when(F.coalesce("__n", F.lit(0)) != F.col("n"), "wrong number of spans").when(F.col("__bad").isNotNull(), F.col("__bad"))
                      .when(F.col("__mean") < least, "song confidence too low").when(F.col("__line").isNotNull(), F.concat(F.lit("line confidence too low: "), F.col("__line").cast("string"))).alias("reason"))


def assemble_tokens(tokens: DataFrame, moras: DataFrame, next_anchor: bool) -> DataFrame:
    """Adds start_ms, end_ms and confidence to tokens (song_id, line_idx, token_idx, ...): those of their moras;
    a token without moras stands at the end of the token before it in the line, else (with next_anchor) at
    the next mora of the song, else at 0, with confidence 1."""
    own = moras.groupBy(*TOKEN).agg(F.min_by("start_ms", "mora_idx").alias("__s"), F.max_by("end_ms", "mora_idx").alias("__e"), F.avg("confidence").alias("__c"))
    line, song = W.partitionBy(*LINE).orderBy("token_idx"), W.partitionBy("song_id").orderBy("line_idx", "token_idx")
    nxt = F.first("__s", ignorenulls=True).over(song.rowsBetween(*_AFTER)) if next_anchor else F.lit(None).cast("long")
    met = tokens.join(own, TOKEN, "left").withColumns({"__le": F.last("__e", ignorenulls=True).over(line.rowsBetween(*_BEFORE)), "__ns": nxt})
    # within a line's leading tokens without moras, the first one's anchor holds for those after it
    anchor = F.coalesce("__le", F.first("__ns").over(line.rowsBetween(W.unboundedPreceding, 0)), F.lit(0))
    return met.withColumns({"start_ms": F.coalesce("__s", anchor), "end_ms": F.coalesce("__e", anchor), "confidence": F.coalesce("__c", F.lit(1.0))}).select(*tokens.columns, "start_ms", "end_ms", "confidence")


def assemble_lines(tokens: DataFrame) -> DataFrame:
    """Lines (song_id, line_idx, start_ms, end_ms, confidence) of timed tokens; confidence is the tokens' mean."""
    return tokens.groupBy(*LINE).agg(F.min_by("start_ms", "token_idx").alias("start_ms"), F.max_by("end_ms", "token_idx").alias("end_ms"), F.avg("confidence").alias("confidence"))


def confidence_rollup(moras: DataFrame) -> DataFrame:
    """Per song: the share of matched moras (or mean score) and the warnings that follow."""
    return moras.groupBy("song_id").agg(F.avg("confidence").alias("confidence")).withColumn("warnings", F.when(F.col("confidence") == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("partial_alignment"))))


def score_rollup(spans: DataFrame, least: float = 0.5) -> DataFrame:
    """Per song: the mean score, and low where it is under `least`."""
    return spans.groupBy("song_id").agg(F.avg("score").alias("confidence")).withColumn("low", F.col("confidence") < least)


def romanise(moras: DataFrame, table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Latin tokens of moras (song_id, seq, reading, pronunciation) by a table (mora, romaji), and rejects:
    a given pronunciation goes first; っ doubles the next token's first letter (else t); ー repeats the last
    vowel (else u). The table of a language's moras is broadcast if it is small when counted."""
    met = moras.join(small_side(table.select(F.col("mora").alias("reading"), F.col("romaji").alias("__r"))), "reading", "left")
    given = F.col("pronunciation").isNotNull()
    raw = F.regexp_replace(F.lower(F.when(given, F.col("pronunciation")).otherwise(F.coalesce("__r", F.lit("")))), "[^a-z']", "")
    w = W.partitionBy("song_id").orderBy("seq")
    rows = met.withColumn("__raw", raw).withColumn("__nxt", F.lead("__raw").over(w))
    small, long = ~given & (F.col("reading") == "っ"), ~given & (F.col("reading") == "ー")
    own = F.when(small, F.when(F.coalesce("__nxt", F.lit("")) == "", "t").otherwise(F.substring("__nxt", 1, 1))).when(~long, F.col("__raw"))
    rows = rows.withColumn("__own", own)
    vowel = F.when(~long, F.coalesce(F.nullif(F.regexp_extract("__own", "([aeiou])[^aeiou]*$", 1), F.lit("")), F.lit("u")))
    before = F.last(vowel, ignorenulls=True).over(w.rowsBetween(*_BEFORE))
    out = rows.withColumn("romaji", F.when(long, F.coalesce(before, F.lit("u"))).otherwise(F.col("__own"))).select("song_id", "seq", "reading", "romaji")
    return out.where("romaji <> ''"), out.where("romaji = ''").select("song_id", "seq", "reading")


def map_time(value: Column, old_start: Column, old_end: Column, new_start: Column, new_end: Column) -> Column:
    """A time's place between the old ends put between the new ones, half to even."""
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(value - old_start, (old_end - old_start).cast("double"))))
    return F.when(old_end <= old_start, new_start).otherwise(F.bround(new_start + p * (new_end - new_start)).cast("long"))


def retime_lines(lines: DataFrame) -> DataFrame:
    """Adds new_start and new_end to lines (song_id, line_idx, start_ms, end_ms, stamp_ms): a stamped line moves
    to its stamp, another follows the line before it; durations stay, but a line ends at the next stamp.
    Songs without any stamp keep their times."""
    w = W.partitionBy("song_id").orderBy("line_idx")
    stamped = F.col("stamp_ms").isNotNull()
    rows = lines.withColumns({
        "__any": F.max(stamped).over(W.partitionBy("song_id")), "__isle": F.sum(stamped.cast("int")).over(w),
        "__d": F.greatest(F.lit(1), F.col("end_ms") - F.col("start_ms")), "__ns": F.lead("stamp_ms").over(w),
    })
    isle = W.partitionBy("song_id", "__isle").orderBy("line_idx")
    rows = rows.withColumn("__c", F.sum("__d").over(isle))
    lift = F.coalesce("stamp_ms", F.greatest(F.col("start_ms"), F.lit(0))) - (F.col("__c") - F.col("__d"))
    rows = rows.withColumn("__end", F.col("__c") + F.max(lift).over(isle))
    rows = rows.withColumn("__start", F.col("__end") - F.col("__d"))
    cut = F.when(F.col("__ns") > F.col("__start"), F.least("__end", "__ns")).otherwise(F.col("__end"))
    return rows.withColumns({"new_start": F.when(F.col("__any"), F.col("__start")).otherwise(F.col("start_ms")), "new_end": F.when(F.col("__any"), cut).otherwise(F.col("end_ms"))}).select(*lines.columns, "new_start", "new_end")


def retime_from_lrc(lines: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Retimed lines and their tokens or moras (song_id, line_idx, ..., start_ms, end_ms)."""
    moved = retime_lines(lines)
    edge = moved.select(*LINE, F.col("start_ms").alias("__a"), F.col("end_ms").alias("__b"), "new_start", "new_end")
    at = lambda c: map_time(F.col(c), F.col("__a"), F.col("__b"), F.col("new_start"), F.col("new_end"))
    inner = parts.join(edge, LINE).withColumns({"start_ms": at("start_ms"), "end_ms": at("end_ms")}).select(*parts.columns)
    return moved.withColumns({"start_ms": F.col("new_start"), "end_ms": F.col("new_end")}).select(*lines.columns), inner


def shift_timeline(parts: DataFrame, offsets: DataFrame) -> DataFrame:
    """Moves a song by offset_ms, but no time below 0."""
    low = parts.groupBy("song_id").agg(F.min("start_ms").alias("__low"))
    by = F.greatest(F.coalesce("offset_ms", F.lit(0)), -F.col("__low"))
    return parts.join(offsets, "song_id", "left").join(low, "song_id").withColumns({"start_ms": F.col("start_ms") + by, "end_ms": F.col("end_ms") + by}).select(*parts.columns)


def push_lines(lines: DataFrame, least_ms: int = 100) -> DataFrame:
    """Lines (song_id, line_idx, start_ms, end_ms) moved so that none overlaps the one before: each starts at
    its own start or the end before it, whichever is later, and keeps its duration (at least least_ms)."""
    w = W.partitionBy("song_id").orderBy("line_idx")
    rows = lines.withColumn("__d", F.when(F.col("end_ms") > F.col("start_ms"), F.col("end_ms") - F.col("start_ms")).otherwise(F.lit(least_ms))).withColumn("__c", F.sum("__d").over(w))
    end = F.col("__c") + F.greatest(F.lit(0), F.max(F.col("start_ms") - (F.col("__c") - F.col("__d"))).over(w))
    return rows.withColumn("__end", end).withColumns({"end_ms": F.col("__end"), "start_ms": F.col("__end") - F.col("__d")}).select(*lines.columns)


def push_timeline(lines: DataFrame, tokens: DataFrame, moras: DataFrame, least_ms: int = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
    """push_lines with the lines' tokens and moras, which move by as much as their line; their ends are not before
    their starts."""
    pushed = push_lines(lines, least_ms)
    moved = lines.select(*LINE, F.col("start_ms").alias("__from")).join(pushed.select(*LINE, F.col("start_ms").alias("__to")), LINE).select(*LINE, (F.col("__to") - F.col("__from")).alias("__by"))
    shift = lambda rows: rows.join(moved, LINE).withColumns({"end_ms": F.greatest("start_ms", "end_ms") + F.col("__by"), "start_ms": F.col("start_ms") + F.col("__by")}).select(*rows.columns)
    return pushed, shift(tokens), shift(moras)


def timeline_violations(lines: DataFrame, tokens: DataFrame, moras: DataFrame | None = None) -> DataFrame:
    """One row (song_id, line_idx, problem) for every overlap, inverted line and token outside its line. With
    moras (reading), of tokens (reading) also for every mora outside its token, and for every token whose
    moras are another number than its reading's, or read otherwise."""
    w = W.partitionBy("song_id").orderBy("line_idx")
    a = lines.withColumn("__p", F.lag("end_ms").over(w))
    found = [
        a.where("start_ms < __p").select(*LINE, F.lit("overlaps the line before").alias("problem")),
        a.where("end_ms <= start_ms").select(*LINE, F.lit("line without duration").alias("problem")),
        tokens.join(lines.select(*LINE, F.col("start_ms").alias("__s"), F.col("end_ms").alias("__e")), LINE).where("start_ms < __s or end_ms > __e or end_ms < start_ms").select(*LINE, F.lit("token out of range").alias("problem")),
    ]
    if moras is not None:
        own = moras.groupBy(*TOKEN).agg(F.sort_array(F.collect_list(F.struct("mora_idx", "reading"))).alias("m"), F.min("start_ms").alias("__ms"), F.max("end_ms").alias("__me"), F.bool_or(F.col("end_ms") < F.col("start_ms")).alias("__bad"))
        met = tokens.join(own, TOKEN, "left").withColumns({"__want": split_moras(normalise_reading(F.col("reading"))), "__has": F.coalesce(F.transform("m", lambda x: x["reading"]), F.array().cast("array<string>"))})
        found += [
            met.where("__ms < start_ms or __me > end_ms or __bad").select(*LINE, F.lit("mora out of range").alias("problem")),
            met.where("size(__has) <> size(__want)").select(*LINE, F.lit("number of moras differs").alias("problem")),
            met.where("size(__has) = size(__want) and __has <> __want").select(*LINE, F.lit("moras differ from the reading").alias("problem")),
        ]
    return reduce(DataFrame.unionByName, found)


def choose_alignment(primary: DataFrame, fallback: DataFrame, errors: DataFrame) -> DataFrame:
    """Per song (song_id, confidence, warnings), the primary timeline unless errors (song_id, reason) names it
    or it is missing; the fallback then carries a warning with the reason."""
    a = primary.join(errors, "song_id", "left_anti").withColumn("engine", F.lit("primary"))
    b = fallback.join(a.select("song_id"), "song_id", "left_anti").join(errors, "song_id", "left")
    warned = F.array_append("warnings", F.concat(F.lit("primary_fallback:"), F.coalesce("reason", F.lit("missing"))))
    return a.unionByName(b.withColumn("warnings", warned).drop("reason").withColumn("engine", F.lit("fallback")))
