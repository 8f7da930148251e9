"""The composite corpus job: reviewed readings, timelines from acoustic spans, else from words, retimed where lines
have stamps, and what a run tells of each song."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import align, edits
from ..operators import intervals as iv
from ..sources.documents import fallback_runs, timeline_summary
from ..sources.shared import settle


def reviewed_lyrics(lines: DataFrame, tokens: DataFrame, review: DataFrame, require: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines and tokens with the reviewed readings (song_id, line_idx, token_idx, surface, reading), the lines' own
    made anew from their tokens, and rejects (song_id, reason): songs whose review does not fit, and with require
    also those without one, which wait. A line without tokens keeps its reading."""
    reviewed = settle(review, "review")
    said_as = [] if "alignment_pronunciation" in tokens.columns else [F.lit(None).cast("string").alias("alignment_pronunciation")]
    new, bad = edits.apply_reading_review(tokens.select("*", *said_as), reviewed)
    if require:
        waiting = lines.select("song_id").unionByName(tokens.select("song_id")).distinct().join(reviewed.select("song_id").distinct(), "song_id", "left_anti")
        bad = bad.unionByName(waiting.withColumn("reason", F.lit("reading review required")))
    bad = settle(bad, "refused-songs")
    new = settle(new.join(bad.select("song_id"), "song_id", "left_anti").select(*tokens.columns), "reviewed-tokens")
    said = edits.joined_reading(new.join(reviewed.select("song_id").distinct(), "song_id", "left_semi")).withColumnRenamed("reading", "__said")
    kept = lines.join(bad.select("song_id"), "song_id", "left_anti").join(said, iv.LINE, "left")
    return kept.withColumn("reading", F.coalesce("__said", "reading")).select(*lines.columns), new, bad


def build_timelines(
    lines: DataFrame, tokens: DataFrame, segments: DataFrame, words: DataFrame, durations: DataFrame, spans: DataFrame | None = None, stamps: DataFrame | None = None,
    review: DataFrame | None = None, activity: DataFrame | None = None, require_review: bool = False,
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables timelines (song_id, confidence, warnings, engine), lines, tokens and moras, summaries (see
    timeline_summary) and fallbacks (see fallback_runs) of the songs that were timed, and rejects (song_id,
    reason) of the others. review (see reviewed_lyrics) changes readings before anything is timed, so spans are
    numbered by the reviewed moras. spans (song_id, seq, start_ms, end_ms, score) are the first choice, with
    activity in packed time (see spans_in_song); stamps (song_id, line_idx, stamp_ms) retime the songs that have
    any. Songs in spans, words, stamps or activity that have no lines are left out."""
    refused = None
    if review is not None:
        lines, tokens, refused = reviewed_lyrics(lines, tokens, review, require_review)
    elif require_review:
        raise ValueError("require_review needs a table of reviews")
    out, rejects = align.align_corpus(lines, tokens, segments, words, durations)
    chosen = out["timelines"].withColumn("engine", F.lit("fallback"))
    if spans is not None:
        first, errors = align.align_from_spans(tokens, align.target_moras(tokens), spans, activity)
        low = F.when(F.col("low"), F.array(F.lit("mms_low_confidence"))).otherwise(F.array().cast("array<string>"))
        primary = first["timelines"].select("song_id", "confidence", low.alias("warnings"))
        chosen = iv.choose_alignment(primary, out["timelines"].select("song_id", "confidence", "warnings"), errors)
        chosen = settle(chosen, "chosen")
        for name in ("lines", "tokens", "moras"):
            cols = [c for c in out[name].columns if c in first[name].columns]
            by = lambda engine: chosen.where(F.col("engine") == engine).select("song_id")
            out[name] = first[name].join(by("primary"), "song_id", "left_semi").select(*cols).unionByName(out[name].join(by("fallback"), "song_id", "left_semi").select(*cols))
        rejects = rejects.join(chosen.select("song_id"), "song_id", "left_anti")
    if stamps is not None:
        timed = settle(out["lines"].join(stamps, ["song_id", "line_idx"], "left"), "stamped-lines")
        for name in ("tokens", "moras"):
            moved, out[name] = iv.retime_from_lrc(timed, out[name])
        out["lines"] = moved.drop("stamp_ms")
        hit = stamps.where("stamp_ms is not null").select("song_id").distinct().withColumn("__hit", F.lit(True))
        chosen = chosen.join(hit, "song_id", "left").withColumn("warnings", F.when(F.col("__hit"), F.array_append("warnings", F.lit("lrc_timing_applied"))).otherwise(F.col("warnings"))).drop("__hit")
    if refused is not None:
        rejects = rejects.unionByName(refused)
    summaries, fallbacks = timeline_summary(out["lines"], chosen), fallback_runs(chosen)
    return {"timelines": chosen, "lines": out["lines"], "tokens": out["tokens"], "moras": out["moras"], "summaries": summaries, "fallbacks": fallbacks}, rejects
