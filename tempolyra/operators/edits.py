"""Reviews and edits of lyric documents and timelines, given as tables of changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import normalise_reading, split_moras
from .intervals import LINE, TOKEN, floor_div, spread_moras

# fixed values: least lengths of a resized line and of a mora, in milliseconds
LEAST_LINE, LEAST_MORA = 100, 10
# fixed values: style fields with default, least and most
STYLE_NUMBERS = {"font_size": (64, 48, 80), "ruby_size": (26, 18, 38), "stroke_width": (5, 2, 8), "upper_y": (430, 320, 560), "lower_y": (563, 440, 680)}
STYLE_COLOURS = {"colour_before": "#ffffff", "colour_after": "#a50000"}
STYLE_FONT = '"Noto Sans JP", "Yu Gothic", sans-serif'


def round_up(x: Column) -> Column:
    """To the nearest whole number, halves up."""
    return F.floor(x + 0.5).cast("long")


def joined_reading(tokens: DataFrame) -> DataFrame:
    """Each line's reading, its tokens' readings in order."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("token_idx", "reading"))), lambda x: x["reading"])
    return tokens.groupBy(*LINE).agg(F.array_join(ordered, "").alias("reading"))


def apply_reading_review(tokens: DataFrame, review: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tokens (song_id, line_idx, token_idx, surface, reading, alignment_pronunciation) with reviewed readings
    (song_id, line_idx, token_idx, surface, reading), and rejects (song_id, reason). A song's tokens must be
    the same in number and surface. Blank readings and white-space tokens keep the source's; a changed
    reading clears the pronunciation. Songs without a review stay as they are."""
    r = review.select(*TOKEN, F.col("surface").alias("__surface"), F.col("reading").alias("__reading"), F.lit(True).alias("__there"))
    both = tokens.withColumn("__source", F.lit(True)).join(r, TOKEN, "full_outer")
    seen = both.groupBy("song_id").agg(F.bool_or(F.coalesce("__there", F.lit(False))).alias("__any"), F.bool_and(F.col("__source").isNotNull() & F.col("__there").isNotNull()).alias("__count"),
                                       F.bool_and(F.coalesce(F.col("surface") == F.col("__surface"), F.lit(False))).alias("__same"))
    rejects = seen.where("__any and not (__count and __same)").select("song_id", F.when(~F.col("__count"), "line or token count differs").otherwise("surface changed").alias("reason"))
    kept = both.where("__source").join(rejects.select("song_id"), "song_id", "left_anti")
    typed = F.when(F.col("surface").rlike(r"^\s+$"), None).otherwise(F.nullif(F.trim("__reading"), F.lit("")))
    new = F.coalesce(typed, F.col("reading"))
    out = kept.withColumn("__new", new).withColumn("alignment_pronunciation", F.when(F.col("__new") == F.col("reading"), F.col("alignment_pronunciation")))
    return out.withColumn("reading", F.col("__new")).select(*tokens.columns), rejects


def apply_timeline_review(lines: DataFrame, tokens: DataFrame, review_lines: DataFrame, review_tokens: DataFrame, review_moras: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Reviewed timelines (tables lines, tokens, moras) and rejects (song_id, reason) by song. Lines must be the
    same in number, not empty and not overlap; tokens the same in number, in their line, in order, and with
    length where the source had one; given moras must match the reading and lie in order in their token, and
    a token without given moras gets even ones."""
    rl = review_lines.select(*LINE, F.col("start_ms").alias("__s"), F.col("end_ms").alias("__e"))
    a = lines.withColumn("__src", F.lit(True)).join(rl, LINE, "full_outer").withColumn("__p", F.lag("__e").over(W.partitionBy("song_id").orderBy("line_idx")))
    line_bad = F.when(F.col("__src").isNull() | F.col("__s").isNull(), "line count differs").when((F.col("__s") < 0) | (F.col("__e") <= F.col("__s")), "invalid line range").when(F.col("__s") < F.col("__p"), "line overlaps the one before")
    rt = review_tokens.select(*TOKEN, F.trim("reading").alias("__reading"), F.col("start_ms").alias("__ts"), F.col("end_ms").alias("__te"))
    t = tokens.withColumn("__src", F.lit(True)).join(rt, TOKEN, "full_outer").join(rl, LINE, "left")
    t = t.withColumn("__p", F.lag("__te").over(W.partitionBy(*LINE).orderBy("token_idx")))
    token_bad = F.when(F.col("__src").isNull() | F.col("__ts").isNull() | F.col("__reading").isNull(), "token count differs").when(
        (F.col("__ts") < F.col("__s")) | (F.col("__te") > F.col("__e")) | (F.col("__te") < F.col("__ts")) | ((F.col("__te") == F.col("__ts")) & (F.col("end_ms") > F.col("start_ms"))) | (F.col("__ts") < F.col("__p")), "token timing is invalid")
    want = split_moras(normalise_reading(F.col("__reading")))
    given = review_moras.groupBy(*TOKEN).agg(F.sort_array(F.collect_list(F.struct("mora_idx", normalise_reading(F.col("reading")).alias("r"), F.col("start_ms").alias("s"), F.col("end_ms").alias("e")))).alias("__m"))
    m = t.join(given, TOKEN, "left").withColumn("__want", want)
    starts = F.concat(F.array(F.col("__ts")), F.transform("__m", lambda x: x["e"]))
    order = F.forall(F.arrays_zip(F.transform("__m", lambda x, i: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.get(starts, i).alias("p"))).alias("z")), lambda z: (z["z"]["s"] >= z["z"]["p"]) & (z["z"]["e"] > z["z"]["s"]) & (z["z"]["s"] >= F.col("__ts")) & (z["z"]["e"] <= F.col("__te")))
    mora_bad = F.when(F.col("__m").isNotNull() & ((F.size("__m") != F.size("__want")) | (F.transform("__m", lambda x: x["r"]) != F.col("__want"))), "moras do not fit the reading").when(F.col("__m").isNotNull() & ~order, "mora timing is invalid")
    found = a.select("song_id", line_bad.alias("reason"), F.lit(0).alias("k")).unionByName(t.select("song_id", token_bad.alias("reason"), F.lit(1).alias("k"))).unionByName(m.select("song_id", mora_bad.alias("reason"), F.lit(2).alias("k")))
    rejects = found.where("reason is not null").groupBy("song_id").agg(F.min_by("reason", F.struct("k", "reason")).alias("reason"))
    good = m.join(rejects.select("song_id"), "song_id", "left_anti")
    new_tokens = good.select(*TOKEN, "surface", F.col("__reading").alias("reading"), F.col("__ts").alias("start_ms"), F.col("__te").alias("end_ms"), F.lit(1.0).alias("confidence"), "__m")
    timed = new_tokens.where("__m is not null").select(*TOKEN, F.explode("__m").alias("x")).select(*TOKEN, F.col("x.mora_idx").alias("mora_idx"), F.col("x.r").alias("reading"), F.col("x.s").alias("start_ms"), F.col("x.e").alias("end_ms"))
    even = spread_moras(new_tokens.where("__m is null").select(*TOKEN, F.col("reading").alias("said"), "start_ms", "end_ms"), split_moras(normalise_reading(F.col("said"))))
    moras = timed.unionByName(even.select(*TOKEN, "mora_idx", F.col("mora").alias("reading"), "start_ms", "end_ms")).withColumns({"matched": F.lit(True), "confidence": F.lit(1.0)})
    new_lines = a.join(rejects.select("song_id"), "song_id", "left_anti").select(*LINE, "surface", F.col("__s").alias("start_ms"), F.col("__e").alias("end_ms"), F.lit(1.0).alias("confidence")).join(joined_reading(new_tokens), LINE, "left")
    return {"lines": new_lines, "tokens": new_tokens.drop("__m"), "moras": moras}, rejects


def merge_reviewed_lyrics(lyric_tokens: DataFrame, timeline_tokens: DataFrame, songs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lyric tokens with the reviewed timeline's readings, the lines' readings, and songs (song_id, warnings)
    with the review's warning once."""
    new = timeline_tokens.select(*TOKEN, F.col("reading").alias("__r"))
    merged = lyric_tokens.join(new, TOKEN, "left").withColumn("reading", F.coalesce("__r", "reading")).drop("__r")
    hit = timeline_tokens.select("song_id").distinct().withColumn("__hit", F.lit(True))
    warned = songs.join(hit, "song_id", "left").withColumn("warnings", F.when(F.col("__hit"), F.array_union("warnings", F.array(F.lit("browser_reviewed")))).otherwise(F.col("warnings"))).drop("__hit")
    return merged, joined_reading(merged), warned


def edit_lines(lines: DataFrame, parts: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines and their parts (tokens or moras) after one edit a line: edits (song_id, line_idx, kind, offset_ms)
    of kind move, start or end, kept between the unedited neighbours. A moved line keeps its length; an edge
    leaves at least LEAST_LINE or the line's own length. Parts follow, halves rounded up."""
    w = W.partitionBy("song_id").orderBy("line_idx")
    rows = lines.withColumns({"__pe": F.lag("end_ms").over(w), "__ns": F.lead("start_ms").over(w), "__d": F.col("end_ms") - F.col("start_ms")}).join(edits, LINE, "left")
    low = F.greatest(F.lit(0), F.coalesce("__pe", F.lit(0)))
    least = F.least(F.lit(LEAST_LINE), F.greatest(F.lit(1), F.col("__d")))
    off = F.col("offset_ms")
    at = F.greatest(low, F.col("start_ms") + off)
    moved = F.when(F.col("__ns").isNull(), at).otherwise(F.least(F.greatest(low, F.col("__ns") - F.col("__d")), at))
    start = F.when(F.col("kind") == "move", moved).when(F.col("kind") == "start", F.least(F.col("end_ms") - least, at)).otherwise(F.col("start_ms"))
    end = F.when(F.col("kind") == "move", moved + F.col("__d")).when(F.col("kind") == "end", F.least(F.greatest(F.col("start_ms") + least, F.col("end_ms") + off), F.coalesce("__ns", F.lit(2**62)))).otherwise(F.col("end_ms"))
    new = rows.withColumns({"__s": start, "__e": end})
    edge = new.where("kind is not null").select(*LINE, F.col("start_ms").alias("__os"), F.col("end_ms").alias("__oe"), "__s", "__e")
    put = lambda c: F.when(F.col("__os").isNull(), F.col(c)).when(F.col("__oe") <= F.col("__os"), F.col("__s")).otherwise(round_up(F.col("__s") + (F.col(c) - F.col("__os")) / (F.col("__oe") - F.col("__os")) * (F.col("__e") - F.col("__s"))))
    inner = parts.join(edge, LINE, "left").withColumns({"start_ms": put("start_ms"), "end_ms": put("end_ms")}).select(*parts.columns)
    return new.withColumns({"start_ms": F.col("__s"), "end_ms": F.col("__e")}).select(*lines.columns), inner


def edit_boundaries(moras: DataFrame, tokens: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Moras and tokens after moving boundaries between neighbouring moras of a line: edits (song_id, line_idx,
    boundary_idx, time_ms), at most one a line; each side keeps LEAST_MORA, or half of what there is. The
    token edges on a moved boundary go with it, and tokens without moras between collapse onto it."""
    w = W.partitionBy(*LINE).orderBy("token_idx", "mora_idx")
    tok = tokens.select(*TOKEN, F.col("start_ms").alias("__ts"), F.col("end_ms").alias("__te"))
    t = W.partitionBy(*TOKEN).orderBy("mora_idx")
    rows = moras.join(tok, TOKEN).withColumns({
        "__k": F.row_number().over(w) - 1, "__left": F.coalesce(F.lag("end_ms").over(t), F.col("__ts")), "__right": F.when(F.lead("mora_idx").over(t).isNull(), F.col("__te")).otherwise(F.col("end_ms")),
    }).withColumns({"__nr": F.lead("__right").over(w), "__nt": F.lead("token_idx").over(w)})
    met = rows.join(edits, LINE).where((F.col("__k") == F.col("boundary_idx")) & F.col("__nr").isNotNull())
    room = F.least(F.lit(LEAST_MORA), floor_div(F.greatest(F.lit(0), F.col("__nr") - F.col("__left")), F.lit(2)))
    cut = met.select(*LINE, F.col("__k").alias("__b"), F.least(F.col("__nr") - room, F.greatest(F.col("__left") + room, F.col("time_ms"))).alias("__at"), F.col("token_idx").alias("__lt"), F.col("__nt").alias("__rt"))
    new = rows.join(cut, LINE, "left").withColumns({
        "end_ms": F.when(F.col("__k") == F.col("__b"), F.col("__at")).otherwise(F.col("end_ms")), "start_ms": F.when(F.col("__k") == F.col("__b") + 1, F.col("__at")).otherwise(F.col("start_ms")),
    }).select(*moras.columns)
    across = F.col("__lt") != F.col("__rt")
    between = across & (F.col("token_idx") > F.col("__lt")) & (F.col("token_idx") < F.col("__rt"))
    out = tokens.join(cut, LINE, "left").withColumns({
        "start_ms": F.when(between | (across & (F.col("token_idx") == F.col("__rt"))), F.col("__at")).otherwise(F.col("start_ms")),
        "end_ms": F.when(between | (across & (F.col("token_idx") == F.col("__lt"))), F.col("__at")).otherwise(F.col("end_ms")),
    }).select(*tokens.columns)
    return new, out


def edit_readings(tokens: DataFrame, moras: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tokens, moras and lines' readings after edits (song_id, line_idx, token_idx, reading): a changed reading
    gets new moras, spread evenly over its token."""
    e = edits.select(*TOKEN, F.trim("reading").alias("__new"))
    met = tokens.join(e, TOKEN, "left").withColumn("__changed", F.coalesce(F.col("__new") != F.col("reading"), F.lit(False)))
    changed = met.where("__changed")
    made = spread_moras(changed.select(*TOKEN, F.col("__new").alias("said"), "start_ms", "end_ms"), split_moras(normalise_reading(F.col("said"))))
    made = made.select(*TOKEN, "mora_idx", F.col("mora").alias("reading"), "start_ms", "end_ms", F.lit(True).alias("matched"))
    kept = moras.join(changed.select(*TOKEN), TOKEN, "left_anti").select(*TOKEN, "mora_idx", "reading", "start_ms", "end_ms", "matched")
    out = met.withColumn("reading", F.when(F.col("__changed"), F.col("__new")).otherwise(F.col("reading"))).select(*tokens.columns)
    return out, kept.unionByName(made), joined_reading(out)


def repair_moras(tokens: DataFrame, moras: DataFrame) -> DataFrame:
    """Moras of all tokens; where their number is not the reading's, or one has no length, overlaps the one
    before or leaves its token, the token's moras are spread evenly instead."""
    want = split_moras(normalise_reading(F.col("reading")))
    t = W.partitionBy(*TOKEN).orderBy("mora_idx")
    tok = tokens.select(*TOKEN, F.size(want).alias("__n"), F.col("start_ms").alias("__ts"), F.col("end_ms").alias("__te"))
    m = moras.withColumn("__p", F.lag("end_ms").over(t)).join(tok, TOKEN)
    bad = (F.col("end_ms") <= F.col("start_ms")) | (F.col("start_ms") < F.coalesce("__p", "__ts")) | (F.col("end_ms") > F.col("__te"))
    sound = m.groupBy(*TOKEN, "__n").agg(F.count(F.lit(1)).alias("n"), F.bool_or(bad).alias("bad")).where("n = __n and not bad").select(*TOKEN)
    broken = tokens.join(sound, TOKEN, "left_anti").select(*TOKEN, F.col("reading").alias("said"), "start_ms", "end_ms")
    made = spread_moras(broken, split_moras(normalise_reading(F.col("said")))).select(*TOKEN, "mora_idx", F.col("mora").alias("reading"), "start_ms", "end_ms")
    return moras.join(sound, TOKEN, "left_semi").select(*TOKEN, "mora_idx", "reading", "start_ms", "end_ms").unionByName(made)


def normalise_style(styles: DataFrame, scale: float = 1.5) -> DataFrame:
    """Style rows with numbers kept in range, colours and fonts checked, defaults for what is missing; adds the
    numbers at subtitle scale (halves up) and the colours as &H00BBGGRR."""
    new: dict[str, Column] = {}
    for name, (default, low, high) in STYLE_NUMBERS.items():
        x = F.col(name).cast("string").try_cast("double")
        new[name] = F.coalesce(F.when(x.isNotNull() & ~F.isnan(x), F.least(F.lit(high), F.greatest(F.lit(low), round_up(F.least(F.lit(1e9), F.greatest(F.lit(-1e9), x)))))), F.lit(default)).cast("long")
    for name, default in STYLE_COLOURS.items():
        new[name] = F.when(F.col(name).rlike("(?i)^#[0-9a-f]{6}$"), F.lower(name)).otherwise(default)
    font = F.trim("font_family")
    new["font_family"] = F.when((font != "") & (F.char_length(font) <= 200) & ~font.rlike(r"[\x00-\x1f\x7f<>;{}]"), font).otherwise(STYLE_FONT)
    out = styles.withColumns(new)
    ass = lambda c: F.upper(F.concat(F.lit("&H00"), F.substring(c, 6, 2), F.substring(c, 4, 2), F.substring(c, 2, 2)))
    return out.withColumns({f"{c}_scaled": round_up(F.col(c) * scale) for c in STYLE_NUMBERS} | {f"{c}_ass": ass(c) for c in STYLE_COLOURS})
