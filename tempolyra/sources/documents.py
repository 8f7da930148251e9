"""Nested song documents: transcripts, lyrics, timelines, manifests; read to long tables and written back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = "struct<text:string,start_ms:bigint,end_ms:bigint,confidence:double>"
SEGMENT = f"struct<id:int,text:string,start_ms:bigint,end_ms:bigint,confidence:double,no_speech_probability:double,words:array<{WORD}>>"
TRANSCRIPT = f"struct<language:string,language_probability:double,duration_seconds:double,text:string,segments:array<{SEGMENT}>>"
TOKEN = "struct<surface:string,reading:string,alignment_pronunciation:string>"
LYRICS = f"struct<provider:string,source_text:string,warnings:array<string>,lines:array<struct<source:string,surface:string,reading:string,tokens:array<{TOKEN}>>>>"
MORA = "struct<reading:string,start_ms:bigint,end_ms:bigint,matched:boolean,confidence:double>"
TIMED = f"struct<surface:string,reading:string,start_ms:bigint,end_ms:bigint,confidence:double,moras:array<{MORA}>>"
TIMELINE = f"struct<confidence:double,warnings:array<string>,alignment_engine:string,alignment_model:string,lines:array<struct<surface:string,reading:string,start_ms:bigint,end_ms:bigint,confidence:double,tokens:array<{TIMED}>>>>"
MANIFEST = "struct<cases:array<struct<name:string,reference:string,engines:map<string,struct<timeline:string,elapsed_seconds:double,peak_rss_mb:double>>>>>"


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Rows (song_id, json): a file each, named by its base name without suffix."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("song_id"), F.col("value").alias("json"))


def _parsed(docs: DataFrame, kind: str) -> DataFrame:
    return docs.withColumn("d", F.from_json("json", kind))


def transcripts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments (song_id, seg_idx, text, start_ms, end_ms) and words (song_id, seg_idx, word_idx, ...)."""
    seg = _parsed(docs, TRANSCRIPT).select("song_id", F.posexplode("d.segments").alias("seg_idx", "s"))
    words = seg.select("song_id", "seg_idx", F.posexplode("s.words").alias("word_idx", "w"))
    return seg.select("song_id", F.col("seg_idx").cast("long").alias("seg_idx"), "s.text", "s.start_ms", "s.end_ms"), words.select(
        "song_id", F.col("seg_idx").cast("long").alias("seg_idx"), F.col("word_idx").cast("long").alias("word_idx"), "w.text", "w.start_ms", "w.end_ms"
    )


def transcript_summary(docs: DataFrame) -> DataFrame:
    """Per song: language, duration_seconds, segments, words."""
    d = _parsed(docs, TRANSCRIPT)
    words = F.aggregate(F.coalesce("d.segments", F.array().cast(f"array<{SEGMENT}>")), F.lit(0), lambda a, s: a + F.greatest(F.lit(0), F.size(s["words"])))
    return d.select("song_id", "d.language", "d.duration_seconds", F.greatest(F.lit(0), F.size("d.segments")).cast("long").alias("segments"), words.cast("long").alias("words"))


def lyric_documents(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines (song_id, line_idx, source, surface, reading) and tokens (song_id, line_idx, token_idx, ...)."""
    lines = _parsed(docs, LYRICS).select("song_id", F.posexplode("d.lines").alias("line_idx", "l")).withColumn("line_idx", F.col("line_idx").cast("long"))
    tokens = lines.select("song_id", "line_idx", F.posexplode("l.tokens").alias("token_idx", "t"))
    return lines.select("song_id", "line_idx", "l.source", "l.surface", "l.reading"), tokens.select("song_id", "line_idx", F.col("token_idx").cast("long").alias("token_idx"), "t.*")


def lyric_summary(docs: DataFrame) -> DataFrame:
    """Per song: source lines and characters, processed lines, whether it has stamps, warnings."""
    d = _parsed(docs, LYRICS)
    source = F.coalesce("d.source_text", F.lit(""))
    blank = F.filter(F.split(source, r"\r?\n"), lambda x: F.trim(x) != "")
    return d.select("song_id", F.size(blank).cast("long").alias("source_lines"), F.char_length(source).cast("long").alias("source_chars"), F.greatest(F.lit(0), F.size("d.lines")).cast("long").alias("lines"),
                    source.rlike(r"\[\d+:\d+(?:[.:]\d+)?\]").alias("has_timing"), F.coalesce("d.warnings", F.array().cast("array<string>")).alias("warnings"))


def _missing(x: Column, *fields: str) -> Column:
    out = x.isNull()
    for f in fields:
        out = out | x[f].isNull()
    return out


def timelines(docs: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Good documents as tables timelines, lines, tokens and moras, and rejects (song_id, reason). Missing
    lists and an engine take defaults; a document that lacks a required key is rejected whole."""
    d = _parsed(docs, TIMELINE)
    lines = F.coalesce("d.lines", F.array().cast(TIMELINE[TIMELINE.index("lines:") + 6 : -1]))
    token_bad = lambda t: _missing(t, "surface", "reading", "start_ms", "end_ms", "confidence") | F.exists(F.coalesce(t["moras"], F.array().cast(f"array<{MORA}>")), lambda m: _missing(m, "reading", "start_ms", "end_ms", "matched", "confidence"))
    line_bad = lambda x: _missing(x, "surface", "reading", "start_ms", "end_ms", "confidence") | F.exists(F.coalesce(x["tokens"], F.array().cast(f"array<{TIMED}>")), token_bad)
    reason = F.when(F.col("d").isNull() | F.col("d.confidence").isNull(), "not a timeline").when(F.exists(lines, line_bad), "a required key is missing")
    judged = d.withColumn("reason", reason)
    good = judged.where("reason is null").withColumn("lines", lines)
    ls = good.select("song_id", F.posexplode("lines").alias("line_idx", "l")).withColumn("line_idx", F.col("line_idx").cast("long"))
    ts = ls.select("song_id", "line_idx", F.posexplode("l.tokens").alias("token_idx", "t")).withColumn("token_idx", F.col("token_idx").cast("long"))
    ms = ts.select("song_id", "line_idx", "token_idx", F.posexplode("t.moras").alias("mora_idx", "m"))
    tables = {
        "timelines": good.select("song_id", F.coalesce("d.alignment_engine", F.lit("whisper_mora")).alias("engine"), F.col("d.alignment_model").alias("model"), "d.confidence", F.coalesce("d.warnings", F.array().cast("array<string>")).alias("warnings")),
        "lines": ls.select("song_id", "line_idx", "l.surface", "l.reading", "l.start_ms", "l.end_ms", "l.confidence"),
        "tokens": ts.select("song_id", "line_idx", "token_idx", "t.surface", "t.reading", "t.start_ms", "t.end_ms", "t.confidence"),
        "moras": ms.select("song_id", "line_idx", "token_idx", F.col("mora_idx").cast("long").alias("mora_idx"), "m.*"),
    }
    return tables, judged.where("reason is not null").select("song_id", "reason")


def timeline_summary(lines: DataFrame, timelines_: DataFrame) -> DataFrame:
    """Per song: lines, confidence, least line confidence, number of warnings."""
    agg = lines.groupBy("song_id").agg(F.count(F.lit(1)).alias("lines"), F.min("confidence").alias("least_confidence"))
    return timelines_.select("song_id", "confidence", F.size("warnings").cast("long").alias("n_warnings")).join(agg, "song_id", "left")


def fallback_runs(timelines_: DataFrame) -> DataFrame:
    """Songs whose warnings tell of a fallback, with those warnings joined."""
    hit = F.filter("warnings", lambda w: F.lower(w).contains("fallback") | F.lower(w).contains("unavailable"))
    return timelines_.where(F.size(hit) > 0).select("song_id", F.array_join(hit, "; ").alias("fallback"))


def _nest(rows: DataFrame, keys: list[str], order: str, fields: list[str], name: str) -> DataFrame:
    """Per key, the rows as an ordered array of structs."""
    listed = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.struct(*fields).alias("v"))))
    return rows.groupBy(*keys).agg(F.transform(listed, lambda x: x["v"]).alias(name))


def timeline_json(timelines_: DataFrame, lines: DataFrame, tokens: DataFrame, moras: DataFrame) -> DataFrame:
    """Rows (song_id, json), the inverse of timelines()."""
    m = _nest(moras, ["song_id", "line_idx", "token_idx"], "mora_idx", ["reading", "start_ms", "end_ms", "matched", "confidence"], "moras")
    t = tokens.join(m, ["song_id", "line_idx", "token_idx"], "left").withColumn("moras", F.coalesce("moras", F.array().cast(f"array<{MORA}>")))
    t = _nest(t, ["song_id", "line_idx"], "token_idx", ["surface", "reading", "start_ms", "end_ms", "confidence", "moras"], "tokens")
    x = _nest(lines.join(t, ["song_id", "line_idx"], "left"), ["song_id"], "line_idx", ["surface", "reading", "start_ms", "end_ms", "confidence", "tokens"], "lines")
    doc = F.to_json(F.struct("confidence", "warnings", F.col("engine").alias("alignment_engine"), F.col("model").alias("alignment_model"), "lines"))
    return timelines_.join(x, "song_id", "left").select("song_id", doc.alias("json"))


def lyrics_json(lines: DataFrame, tokens: DataFrame, songs: DataFrame) -> DataFrame:
    """Rows (song_id, json), the inverse of lyric_documents(); songs has song_id, provider, source_text, warnings."""
    t = _nest(tokens, ["song_id", "line_idx"], "token_idx", ["surface", "reading", "alignment_pronunciation"], "tokens")
    x = _nest(lines.join(t, ["song_id", "line_idx"], "left"), ["song_id"], "line_idx", ["source", "surface", "reading", "tokens"], "lines")
    return songs.join(x, "song_id", "left").select("song_id", F.to_json(F.struct("provider", "source_text", "warnings", "lines")).alias("json"))


def write_json(rows: DataFrame, path: str, column: str = "json") -> None:
    """One folder a song, partitioned by song_id."""
    rows.select("song_id", F.col(column).alias("value")).write.mode("overwrite").partitionBy("song_id").text(path)


def write_ass(files: DataFrame, path: str) -> None:
    """Subtitle files (song_id, content)."""
    write_json(files, path, "content")


def manifest(docs: DataFrame) -> DataFrame:
    """One row a (case, engine): reference and timeline paths, elapsed_seconds, peak_rss_mb."""
    cases = _parsed(docs, MANIFEST).select(F.explode("d.cases").alias("c"))
    return cases.select(F.col("c.name").alias("case"), "c.reference", F.explode("c.engines").alias("engine", "e")).select("case", "reference", "engine", "e.*")


def report_json(cases: DataFrame, summary: DataFrame) -> DataFrame:
    """One row (json): per engine its summary and cases, engines and cases in order."""
    per = cases.groupBy("engine").agg(F.sort_array(F.collect_list(F.struct("case", "ok", "mae_ms", "median_ms", "max_ms", "error"))).alias("cases"))
    both = summary.join(per, "engine")
    rows = F.sort_array(F.collect_list(F.struct("engine", F.struct(*[c for c in summary.columns if c != "engine"]).alias("summary"), "cases")))
    return both.agg(F.to_json(F.struct(rows.alias("engines"))).alias("json"))


def lyric_files(files: DataFrame, max_bytes: int = 1 << 20) -> DataFrame:
    """Of (song_id, content binary, text string): song_id, lyrics, source (file, text or null) and reason for
    rejects: both given, too large, or not UTF-8. Empty lyrics are null."""
    has_file, has_text = F.coalesce(F.length("content") > 0, F.lit(False)), F.coalesce(F.trim("text") != "", F.lit(False))
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    lyrics = F.trim(F.when(has_file, F.try_validate_utf8(F.col("content").cast("string"))).when(has_text, F.col("text")), F.lit(" \t\r\n"))
    reason = F.when(has_file & has_text, "lyrics given twice").when(has_file & (F.length("content") > max_bytes), "lyrics too large").when(has_file & ~valid, "not UTF-8").when(has_text & (F.octet_length("text") > max_bytes), "lyrics too large")
    return files.select("song_id", F.when(reason.isNull() & (lyrics != ""), lyrics).alias("lyrics"), F.when(reason.isNull() & (lyrics != ""), F.when(has_file, "file").otherwise("text")).alias("source"), reason.alias("reason"))
