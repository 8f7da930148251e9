"""Phonetic ruby over kanji: readings, placement, timing, layout and project text."""

from __future__ import annotations

import re
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions.text import SMALL_KANA, lrc_time, normalise_reading
from ..sources.shared import small_side
from .subtitles import LINE, TOKEN, _segs, paragraphs

_TO_HIRAGANA = {c: c - 0x60 for c in range(0x30A1, 0x30F7)}
_RUN = re.compile("([㐀-䶿一-鿿]+)")
RUNS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("reading", T.StringType())]))


def kanji_runs(surface: str | None, plain: str | None, reading: str | None) -> list[dict]:
    """Kanji runs of a surface with their readings: the kana around them anchor a lazy match; a run without
    one keeps its own characters. plain is the normalised surface, of equal length, reading normalised."""
    pieces = _RUN.split(surface or "")  # kana and kanji by turns
    edge = [0, *accumulate(map(len, pieces))]
    kana = ["".join(re.findall(r"\w", (plain or "")[edge[k] : edge[k + 1]])) for k in range(0, len(pieces), 2)]
    hit = re.fullmatch("(.*?)".join(map(re.escape, kana)), reading or "")
    said = hit.groups() if hit else [""] * len(kana)
    return [{"start": edge[k], "end": edge[k + 1], "reading": said[k // 2] or pieces[k]} for k in range(1, len(pieces), 2)]


def kanji_readings(tokens: DataFrame) -> DataFrame:
    """Adds runs (array of start, end, reading) to tokens with surface and reading."""

    @F.pandas_udf(RUNS)
    def run(surface: pd.Series, plain: pd.Series, reading: pd.Series) -> pd.Series:
        return pd.Series([kanji_runs(*x) for x in zip(surface, plain, reading)])

    kana = F.lower(F.translate("surface", "".join(map(chr, range(0x30A1, 0x30F7))), "".join(map(chr, range(0x3041, 0x3097)))))
    return tokens.withColumn("runs", run(F.col("surface"), kana, normalise_reading(F.col("reading"))))


_KANJI = "㐀-䶿一-鿿\uf900-\ufaff"
PARTS = T.ArrayType(T.StructType([T.StructField("surface", T.StringType()), T.StructField("reading", T.StringType())]))


def even_shares(reading: str, n: int) -> list[str]:
    """A reading in n parts of as many moras, one more for the first ones; by characters where moras are too
    few, and whole in the first part where those are too."""
    for units in (re.findall(f"(?s).[{SMALL_KANA}]*", reading), list(reading)):
        if len(units) >= n:
            size, more = divmod(len(units), n)
            ends = [k * size + min(k, more) for k in range(n + 1)]
            return ["".join(units[a:z]) for a, z in zip(ends, ends[1:])]
    return [reading, *[""] * (n - 1)]


def run_shares(run: str, said: str, known: dict[str, str]) -> list[str]:
    """The reading of a kanji run by character: characters whose known reading stands at the beginning, then at
    the end, take it as long as a mora is left for each other one; those between share what is left evenly."""
    inner = list(run)
    outer: tuple[list[str], list[str]] = ([], [])  # from the front, from the back
    for found, at in zip(outer, (0, -1)):
        while inner and (own := known.get(inner[at])):
            rest = said.removesuffix(own) if at else said.removeprefix(own)
            if rest == said or len(re.findall(f"(?s).[{SMALL_KANA}]*", rest)) < len(inner) - 1:
                break
            said = rest
            found.append(own)
            inner.pop(at)
    return [*outer[0], *(even_shares(said, len(inner)) if inner else []), *outer[1][::-1]]


def split_surface(surface: str, reading: str, known: dict[str, str]) -> list[tuple[str, str]]:
    """A surface as single kanji and runs of other characters with their readings."""
    pieces = re.split(f"([{_KANJI}]+)", surface)
    kana = ["".join(known.get(c, c) for c in x.translate(_TO_HIRAGANA)) for x in pieces[::2]]
    groups = [g for k, x in enumerate(pieces) for g in (x if k % 2 else [x]) if g]
    if len(pieces) == 1 or len(groups) == 1:
        return [(surface, reading)]
    hit = re.fullmatch("(.*?)".join(map(re.escape, kana)), reading)
    if not hit or not all(hit.groups()):
        return list(zip(groups, even_shares(reading, len(groups))))
    shares = [run_shares(run, said, known) for run, said in zip(pieces[1::2], hit.groups())]
    return [pair for k, x in enumerate(pieces) if x for pair in (zip(x, shares[k // 2]) if k % 2 else [(x, kana[k // 2])])]


def split_by_kanji(tokens: DataFrame, literal: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, part_idx, surface, reading) of tokens (keys, surface, reading, alignment_pronunciation): one for
    each kanji and each run of other characters. literal (char, kana) holds the readings of single kanji; it
    is broadcast if small when counted. Tokens with a given pronunciation stay whole."""
    chars = tokens.select(*keys, F.explode(F.array_distinct(F.regexp_extract_all("surface", F.lit(f"[{_KANJI}]"), 0))).alias("char"))
    known = chars.join(small_side(literal.select("char", "kana")), "char").groupBy(*keys).agg(F.map_from_entries(F.collect_set(F.struct("char", "kana"))).alias("known"))

    @F.pandas_udf(PARTS)
    def run(surface: pd.Series, reading: pd.Series, readings: pd.Series) -> pd.Series:
        split = lambda s, r, k: [] if s is None else [{"surface": a, "reading": b} for a, b in split_surface(s, r or "", dict(k) if k is not None else {})]
        return pd.Series([split(*x) for x in zip(surface, reading, readings)])

    given = F.col("alignment_pronunciation").isNotNull() | ~F.col("surface").rlike(f"[{_KANJI}]")
    rows = tokens.join(known, keys, "left")
    whole = rows.where(given).select(*keys, F.lit(0).cast("long").alias("part_idx"), "surface", "reading")
    parts = rows.where(~given).select(*keys, F.posexplode(run("surface", "reading", "known")).alias("part_idx", "p"))
    return whole.unionByName(parts.select(*keys, F.col("part_idx").cast("long").alias("part_idx"), "p.surface", "p.reading"))


def token_offsets(tokens: DataFrame) -> DataFrame:
    """Adds char_offset, the token's place in its line in characters."""
    before = F.sum(F.char_length("surface")).over(W.partitionBy(*LINE).orderBy("token_idx").rowsBetween(W.unboundedPreceding, -1))
    return tokens.withColumn("char_offset", F.coalesce(before, F.lit(0)))


def ruby_placements(tokens: DataFrame, centre_x: int = 960, baseline_y: int = 670, size: int = 96, ratio: float = 0.68, spacing: float = 0.0) -> DataFrame:
    """Rows (song_id, line_idx, token_idx, reading, x, y): the middle of each kanji run, by one width a character."""
    unit = float(round(size * ratio))
    width = lambda n: n * unit + F.greatest(F.lit(0), n - 1) * spacing
    t = token_offsets(kanji_readings(tokens)).withColumn("__n", F.sum(F.char_length("surface")).over(W.partitionBy(*LINE)))
    r = t.select(*TOKEN, "char_offset", "__n", F.explode("runs").alias("r"))
    first = F.col("char_offset") + F.col("r.start")
    x = F.lit(float(centre_x)) - width(F.col("__n")) / 2 + width(first) + F.when(first > 0, spacing).otherwise(0.0) + width(F.col("r.end") - F.col("r.start")) / 2
    return r.select(*TOKEN, F.col("r.reading").alias("reading"), F.bround(x).cast("long").alias("x"), F.lit(baseline_y - size // 2 - 2).cast("long").alias("y"))


def _timed_characters() -> Column:
    """The characters of a token's mora texts with their times."""
    def of(seg: Column) -> Column:
        n = F.char_length(seg["reading"])
        step = lambda i: seg["s"] + (seg["e"] - seg["s"]) * i / n
        return F.transform(F.split(seg["reading"], ""), lambda c, i: F.struct(c.alias("c"), step(i).alias("s"), step(i + 1).alias("e")))

    return F.flatten(F.transform("segs", of))


def _segments(tokens: DataFrame, moras: DataFrame) -> DataFrame:
    """Adds segs to tokens: their moras' (reading, s, e) inside the token, in order, without gaps."""
    part = F.struct("mora_idx", "end_ms", "reading")
    met = moras.withColumn("reading", normalise_reading(F.col("reading"))).groupBy(*TOKEN).agg(F.sort_array(F.collect_list(part)).alias("__m"))
    none = F.expr("cast(array() as array<struct<mora_idx:bigint,end_ms:bigint,reading:string>>)")
    t = tokens.join(met, TOKEN, "left").withColumn("__m", F.coalesce("__m", none))
    return t.withColumn("segs", F.zip_with(_segs(F.col("__m")), "__m", lambda a, b: F.struct(b["reading"].alias("reading"), a["s"].alias("s"), a["e"].alias("e")))).drop("__m")


def ruby_chunks(tokens: DataFrame, moras: DataFrame) -> DataFrame:
    """Rows (song_id, line_idx, token_idx, char_idx, text, duration_cs, start_ms) for tokens with a column ruby
    (reading), and ruby_idx where the tokens have one, as those with several rubies do: the reading is found in the token's mora text and takes its times; otherwise an
    even share, the remainder to the last ones, from the token's start."""
    t = _segments(tokens, moras).withColumns({"__r": normalise_reading(F.col("ruby")), "__full": F.array_join(F.transform("segs", lambda x: x["reading"]), "")})
    t = t.where("__r <> ''").withColumns({"__at": F.expr("locate(__r, __full)"), "__chars": _timed_characters()})
    n = F.char_length("__r")
    total = F.greatest(F.lit(0), F.bround((F.col("end_ms") - F.col("start_ms")) / 10)).cast("long")
    c = t.select("*", F.posexplode(F.split("__r", "")).alias("char_idx", "text"))
    hit = F.get("__chars", F.col("__at") - 1 + F.col("char_idx"))
    even = F.floor(total / n) + (F.col("char_idx") >= n - total % n).cast("long")
    found = F.col("__at") > 0
    first = F.get("__chars", F.col("__at") - 1)["s"]
    return c.select(*TOKEN, *[x for x in ("ruby_idx",) if x in tokens.columns], F.col("char_idx").cast("long").alias("char_idx"), "text",
                    F.when(found, F.greatest(F.lit(0), F.bround((hit["e"] - hit["s"]) / 10))).otherwise(even).cast("long").alias("duration_cs"),
                    F.when(found, F.bround(first)).otherwise(F.col("start_ms")).cast("long").alias("start_ms"))


def layout_lines(tokens: DataFrame, glyphs: DataFrame, base_spacing: int = 14, ruby_spacing: int = 8, left_x: int = 192, right_x: int = 1728) -> DataFrame:
    """Rows (song_id, line_idx, group_idx, token_idx, text, reading, x, width, base_width, ruby_width): a line's groups,
    a kanji run with its ruby or one character, each as wide as the wider of base and ruby, from the left in even
    lines and up to the right in odd ones; a column slot of the tokens takes the place of the line's number. glyphs (char, font, advance; fonts base and ruby) is broadcast if it is small when
    counted."""
    g = glyphs.where("font = 'base'").select(F.col("char").alias("ch"), F.col("advance").alias("base_w")).join(glyphs.where("font = 'ruby'").select(F.col("char").alias("ch"), F.col("advance").alias("ruby_w")), "ch", "full_outer")
    slot = F.col("slot") if "slot" in tokens.columns else F.col("line_idx")
    t = token_offsets(kanji_readings(tokens)).withColumn("__slot", slot % 2)
    cuts = F.transform(F.sequence(F.lit(1), F.char_length("surface")), lambda p: F.struct((p - 1).alias("p"), F.get(F.filter("runs", lambda r: (r["start"] < p) & (p <= r["end"])), F.lit(0)).alias("r")))
    c = t.where("surface <> ''").select(*TOKEN, "__slot", "surface", "char_offset", F.explode(cuts).alias("x"))
    c = c.select(*TOKEN, "__slot", (F.col("char_offset") + F.coalesce("x.r.start", "x.p")).alias("group_idx"), F.struct("x.p", F.expr("substring(surface, x.p + 1, 1)").alias("ch")).alias("c"), F.col("x.r.reading").alias("reading"))
    grouped = c.groupBy(*LINE, "group_idx").agg(F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda x: x["ch"]), "").alias("text"), F.first("reading").alias("reading"), F.first("token_idx").alias("token_idx"), F.first("__slot").alias("__slot"))
    letters = grouped.select(*LINE, "group_idx", F.explode(F.array(F.struct(F.lit("base_w").alias("k"), F.col("text").alias("s")), F.struct(F.lit("ruby_w").alias("k"), F.coalesce("reading", F.lit("")).alias("s")))).alias("z")).select(*LINE, "group_idx", "z.k", F.explode(F.split("z.s", "")).alias("ch")).where("ch <> ''")
    w = letters.join(small_side(g), "ch", "left").groupBy(*LINE, "group_idx").agg(
        (F.sum(F.when(F.col("k") == "base_w", F.coalesce("base_w", F.lit(0.0)))) + (F.count_if(F.col("k") == "base_w") - 1) * base_spacing).alias("b"),
        F.coalesce(F.sum(F.when(F.col("k") == "ruby_w", F.coalesce("ruby_w", F.lit(0.0)))) + (F.count_if(F.col("k") == "ruby_w") - 1) * ruby_spacing, F.lit(0.0)).alias("r"))
    rows = grouped.join(w, [*LINE, "group_idx"]).withColumn("width", F.greatest("b", "r"))
    line = W.partitionBy(*LINE)
    run = F.sum(F.col("width") + base_spacing).over(line.orderBy("group_idx")) - F.col("width") - base_spacing
    total = F.sum(F.col("width") + base_spacing).over(line) - base_spacing
    x = F.when(F.col("__slot") == 0, F.lit(float(left_x))).otherwise(F.lit(float(right_x)) - total) + run
    return rows.select(*LINE, F.col("group_idx").cast("long").alias("group_idx"), "token_idx", "text", "reading", x.alias("x"), "width", F.col("b").alias("base_width"), F.col("r").alias("ruby_width"))


def repair_collapsed(tokens: DataFrame, weight: Column) -> DataFrame:
    """Tokens of a line where one with moras has no length: from it to the next token with length (else back to
    the last one) the time is shared by weight (moras, at least one), halves rounded up. Nothing changes in a
    line without any length. weight is 0 for tokens without moras. A fold over one line's tokens."""
    kind = tokens.schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("token_idx").reset_index(drop=True)
        s, e, w = pdf["start_ms"].tolist(), pdf["end_ms"].tolist(), pdf["__w"].tolist()
        done = -1
        for k in range(len(s)):
            if k <= done or e[k] > s[k] or not w[k]:
                continue
            a, z = k, next((j for j in range(k + 1, len(s)) if e[j] > s[j]), None)
            if z is None:
                a, z = next((j for j in range(k - 1, -1, -1) if e[j] > s[j]), None), k
            if a is None:
                continue
            share = [max(1, w[j]) for j in range(a, z + 1)]
            first, span, total, used = s[a], e[z] - s[a], sum(share), 0
            for j, q in enumerate(share):
                s[a + j] = first + (2 * span * used + total) // (2 * total)
                used += q
                e[a + j] = first + (2 * span * used + total) // (2 * total)
            done = max(k, z)
        return pdf.assign(start_ms=s, end_ms=e).drop(columns="__w")

    return tokens.withColumn("__w", weight.cast("long")).groupBy(*LINE).applyInPandas(run, kind)


def project_text(config: DataFrame, lines: DataFrame, tokens: DataFrame, moras: DataFrame) -> DataFrame:
    """Rows (song_id, content): config JSON, ruby directives, then timed lyrics with a blank line between
    paragraphs. config has song_id and config (JSON text)."""
    m = moras.join(tokens.select(*TOKEN, F.col("start_ms").alias("__ts")), TOKEN).withColumn("__last", F.lead("mora_idx").over(W.partitionBy(*TOKEN).orderBy("mora_idx")).isNull())
    piece = F.when(F.col("__last"), F.col("reading")).otherwise(F.concat("reading", lrc_time(F.col("end_ms") - F.col("__ts"))))
    said = m.groupBy(*TOKEN).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("mora_idx", piece.alias("p")))), lambda x: x["p"]), "").alias("__said"))
    ruby = tokens.where(F.col("surface").rlike("[㐀-䶿一-鿿]") & (F.trim("reading") != "") & ~F.col("surface").rlike("[\r\n,]")).join(said, TOKEN, "left")
    row = F.concat(F.lit("@Ruby="), F.col("surface"), F.lit(","), F.coalesce("__said", "reading"), F.lit(","), lrc_time(F.col("start_ms")), F.lit(","), lrc_time(F.col("end_ms")))
    rubies = ruby.groupBy("song_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("line_idx", "token_idx", row.alias("p")))), lambda x: x["p"]).alias("rubies"))
    body = tokens.groupBy(*LINE).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("token_idx", F.concat(lrc_time(F.col("start_ms")), "surface").alias("p")))), lambda x: x["p"]), "").alias("__body"))
    p = paragraphs(lines).join(body, LINE)
    text = F.concat(F.when((F.col("line_in_paragraph") == 0) & (F.col("paragraph") > 0), "\n").otherwise(""), F.col("__body"), lrc_time(F.col("end_ms")))
    lyrics = p.groupBy("song_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("line_idx", text.alias("p")))), lambda x: x["p"]).alias("lyrics"))
    empty = F.array().cast("array<string>")
    return config.join(rubies, "song_id", "left").join(lyrics, "song_id", "left").select("song_id", F.concat(F.lit("config "), F.col("config"), F.lit("\n\n\n"), F.array_join(F.concat(F.coalesce("rubies", empty), F.coalesce("lyrics", empty)), "\n")).alias("content"))
