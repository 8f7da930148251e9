"""Subtitle generation: paragraphs, slots, character rows, karaoke text and dialogue rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import ass_escape, ass_time, is_sung
from . import characters
from .intervals import floor_div

LINE, TOKEN = ["song_id", "line_idx"], ["song_id", "line_idx", "token_idx"]

# fixed values: milliseconds of the two-slot layout
ENTRY_MS, HOLD_MS, PROTECT_MS, PROTECT_MARGIN_MS = 4166, 2000, 1000, 2500
# fixed values: milliseconds of the simple layout
LEAD_MS, INTERLUDE_MS = 3000, 12_000


def paragraphs(lines: DataFrame, entry_ms: int = ENTRY_MS, hold_ms: int = HOLD_MS) -> DataFrame:
    """Adds paragraph (a new one after a gap of over entry_ms + hold_ms) and line_in_paragraph, both from 0."""
    w = W.partitionBy("song_id").orderBy("line_idx")
    new = F.coalesce(F.col("start_ms") - F.lag("end_ms").over(w) > entry_ms + hold_ms, F.lit(False)).cast("long")
    rows = lines.withColumn("__new", new).withColumn("paragraph", F.sum("__new").over(w)).drop("__new")
    place = F.row_number().over(W.partitionBy("song_id", "paragraph").orderBy("line_idx")) - 1
    return rows.withColumn("line_in_paragraph", place.cast("long"))


def slot_timings(lines: DataFrame, entry_ms: int = ENTRY_MS, hold_ms: int = HOLD_MS, protect_ms: int = PROTECT_MS, margin_ms: int = PROTECT_MARGIN_MS) -> DataFrame:
    """Adds entry_ms, walk_done_ms, display_start_ms, display_end_ms, is_first and is_last of the two-slot
    layout. A slot's next line is two lines on while the paragraph lasts; a line's display ends when its
    slot's next line in the song begins."""
    w = W.partitionBy("song_id").orderBy("line_idx")
    p = paragraphs(lines, entry_ms, hold_ms)
    head = F.first("start_ms").over(W.partitionBy("song_id", "paragraph").orderBy("line_idx"))
    entry = F.when(F.col("line_in_paragraph") == 1, head).otherwise(F.col("start_ms")) - entry_ms
    rows = p.withColumn("entry_ms", entry).withColumns({
        "__p2": F.lead("paragraph", 2).over(w), "__s2": F.lead("start_ms", 2).over(w), "__pb": F.lag("paragraph", 2).over(w), "__np": F.lead("paragraph").over(w),
    })
    # the entry of the line two on is pulled to this line's end and hold where it would come later
    rows = rows.withColumn("__e2", F.lead("entry_ms", 2).over(w))
    pull = F.coalesce((F.col("__p2") == F.col("paragraph")) & (F.col("__e2") > F.col("end_ms") + hold_ms), F.lit(False))
    rows = rows.withColumn("__pull", pull).withColumn("walk_done_ms", F.when(pull, F.col("end_ms") + hold_ms).otherwise(F.col("end_ms")))
    rows = rows.withColumn("entry_ms", F.when(F.coalesce(F.lag("__pull", 2).over(w), F.lit(False)), F.lag("walk_done_ms", 2).over(w)).otherwise(F.col("entry_ms")))
    late = F.coalesce((F.col("__p2") == F.col("paragraph")) & (F.col("__s2") >= F.col("walk_done_ms") + protect_ms + margin_ms), F.lit(False))
    rows = rows.withColumn("walk_done_ms", F.when(late, F.col("walk_done_ms") + protect_ms).otherwise(F.col("walk_done_ms")))
    same_slot = F.when(F.col("__pb") == F.col("paragraph"), F.lag("walk_done_ms", 2).over(w))
    rows = rows.withColumn("display_start_ms", F.greatest(F.lit(0), F.col("entry_ms"), F.coalesce(same_slot, F.col("entry_ms"))))
    nxt = F.lead("display_start_ms").over(W.partitionBy("song_id", F.col("line_in_paragraph") % 2).orderBy("line_idx"))
    rows = rows.withColumn("display_end_ms", F.greatest(F.col("display_start_ms"), F.least(F.col("end_ms") + hold_ms, nxt)))
    return rows.withColumns({"is_first": F.col("line_in_paragraph") <= 1, "is_last": F.coalesce(F.col("__np") != F.col("paragraph"), F.lit(True))}).select(
        *lines.columns, "paragraph", "line_in_paragraph", "entry_ms", "walk_done_ms", "display_start_ms", "display_end_ms", "is_first", "is_last"
    )


def simple_display(lines: DataFrame, lead_ms: int = LEAD_MS, interlude_ms: int = INTERLUDE_MS) -> DataFrame:
    """Adds display_start_ms and display_end_ms: a line shows from the start of the line before it, or lead_ms
    ahead after an interlude, to the start of the next one, or its own end before an interlude."""
    w = W.partitionBy("song_id").orderBy("line_idx")
    prev_s, prev_e, nxt = F.lag("start_ms").over(w), F.lag("end_ms").over(w), F.lead("start_ms").over(w)
    section = prev_s.isNull() | (F.col("start_ms") - prev_e >= interlude_ms)
    return lines.withColumns({
        "display_start_ms": F.when(section, F.greatest(F.lit(0), F.col("start_ms") - lead_ms)).otherwise(prev_s),
        "display_end_ms": F.when(nxt.isNull() | (nxt - F.col("end_ms") >= interlude_ms), F.col("end_ms")).otherwise(nxt),
    })


def indicator_events(layout: DataFrame, dots: int = 4, lead_ms: int = 3000) -> DataFrame:
    """Rows (song_id, paragraph, dot, dot_start_ms, dot_end_ms): countdown dots ahead of each paragraph's first
    line, going out one by one over lead_ms; only those that end after its display starts."""
    first = layout.where("line_in_paragraph = 0")
    rows = first.select("song_id", "paragraph", "start_ms", "display_start_ms", F.explode(F.sequence(F.lit(0), F.lit(dots - 1))).alias("dot"))
    end = F.col("start_ms") - lead_ms + F.col("dot") * (lead_ms // dots)
    return rows.select("song_id", "paragraph", F.col("dot").cast("long").alias("dot"), F.col("display_start_ms").alias("dot_start_ms"), end.cast("long").alias("dot_end_ms")).where("dot_end_ms > dot_start_ms")


def _segs(ends: Column) -> Column:
    """A token's moras as times inside the token, without gaps: of the sorted ends (mora_idx, end_ms)."""
    s = lambda k: F.greatest(F.col("start_ms"), F.coalesce(F.get(ends, k - 1)["end_ms"], F.col("start_ms")))
    last = lambda x, k: F.when(k == F.size(ends) - 1, F.col("end_ms")).otherwise(x["end_ms"])
    return F.transform(ends, lambda x, k: F.struct(s(k).alias("s"), F.least(F.col("end_ms"), F.greatest(s(k), last(x, k))).alias("e")))


def _at(position: Column) -> Column:
    """The time at a position on the segments, half to even; past them the token's end."""
    n = F.size("segs")
    k = F.least(n - 1, F.floor(position).cast("int"))
    seg = F.get("segs", k)
    return F.when(n == 0, F.col("start_ms")).when(position >= n, F.col("end_ms")).otherwise(F.bround(seg["s"] + (seg["e"] - seg["s"]) * (position - k)).cast("long"))


def _characters(tokens: DataFrame) -> DataFrame:
    """The characters of tokens (surface, start_ms, end_ms, segs) with duration_cs and, among a token's sung
    characters, place __k from 0 and number __n."""
    t = tokens.where(F.length("surface") > 0).withColumn("__total", F.greatest(F.lit(0), F.bround((F.col("end_ms") - F.col("start_ms")) / 10).cast("long")))
    c = t.select("*", F.posexplode(F.split("surface", "")).alias("char_idx", "text")).withColumn("sung", is_sung(F.col("text")))
    w, one = W.partitionBy(*TOKEN).orderBy("char_idx"), F.col("sung").cast("long")
    c = c.withColumns({"__k": F.sum(one).over(w) - 1, "__n": F.sum(one).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))})
    m = F.size("segs")
    timed = F.greatest(F.lit(0), F.bround((_at(m * (F.col("__k") + 1) / F.col("__n")) - _at(m * F.col("__k") / F.col("__n"))) / 10).cast("long"))
    base = F.floor(F.col("__total") / F.col("__n"))
    even = base + (F.col("__k") >= F.col("__n") - (F.col("__total") - base * F.col("__n"))).cast("long")
    duration = F.when(~F.col("sung"), F.lit(0)).when(m > 0, timed).otherwise(even)
    return c.withColumns({"char_idx": F.col("char_idx").cast("long"), "duration_cs": duration.cast("long")})


def character_chunks(tokens: DataFrame, moras: DataFrame) -> DataFrame:
    """Rows (song_id, line_idx, token_idx, char_idx, text, sung, duration_cs): each sung character of a token
    takes its share of the mora times; without moras an even share, the remainder to the last ones."""
    ends = moras.groupBy(*TOKEN).agg(F.sort_array(F.collect_list(F.struct("mora_idx", "end_ms"))).alias("__m"))
    none = F.expr("cast(array() as array<struct<mora_idx:bigint,end_ms:bigint>>)")
    met = tokens.join(ends, TOKEN, "left").withColumn("__m", F.coalesce("__m", none)).withColumn("segs", _segs(F.col("__m")))
    return _characters(met).select(*TOKEN, "char_idx", "text", "sung", "duration_cs")


def _reconciled(rows: DataFrame) -> DataFrame:
    """Characters whose line total is made the line's (__ls to __le), by the last sung character where it falls
    short, and backwards from the end where it is over."""
    w = W.partitionBy(*LINE).orderBy("token_idx", "char_idx")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = rows.withColumns({"__cs": F.when(F.col("sung"), F.col("duration_cs")).otherwise(0), "__one": F.col("sung").cast("long")})
    rows = rows.withColumns({
        "__diff": F.bround((F.col("__le") - F.col("__ls")) / 10).cast("long") - F.sum("duration_cs").over(whole),
        "__after": F.sum("__cs").over(whole) - F.sum("__cs").over(w), "__left": F.sum("__one").over(whole) - F.sum("__one").over(w),
    })
    more = F.when(F.col("sung") & (F.col("__left") == 0) & (F.col("__diff") > 0), F.col("__diff")).otherwise(0)
    less = F.when(F.col("sung") & (F.col("__diff") < 0), F.least(F.col("duration_cs"), F.greatest(F.lit(0), -F.col("__diff") - F.col("__after")))).otherwise(0)
    return rows.withColumn("duration_cs", F.col("duration_cs") + more - less).select(*TOKEN, "char_idx", "text", "sung", "duration_cs")


def with_tokens(lines: DataFrame, tokens: DataFrame, moras: DataFrame) -> DataFrame:
    """Lines with the columns characters.TOKENS, songs whole and in order. Lines, tokens and moras meet in one shuffle
    by song; tokens of no line are left out."""
    own = F.struct(*[c for c in lines.columns if c not in LINE])
    none = F.lit(None).cast("long").alias("token_idx")
    parts = [
        lines.select(*LINE, none, own.alias("l")), tokens.select(*LINE, "token_idx", F.struct("surface", "start_ms", "end_ms").alias("t")),
        moras.select(*LINE, "token_idx", F.struct("mora_idx", "end_ms").alias("m")),
    ]
    rows = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True).repartition("song_id")
    met = rows.groupBy(*TOKEN).agg(F.first("l", ignorenulls=True).alias("l"), F.first("t", ignorenulls=True).alias("t"), F.sort_array(F.collect_list("m")).alias("m"))
    token = F.struct(F.col("token_idx").cast("long").alias("token_idx"), F.col("t.surface").alias("surfaces"), F.col("t.start_ms").cast("long").alias("starts"), F.col("t.end_ms").cast("long").alias("ends"), F.col("m.end_ms").cast("array<bigint>").alias("mora_ends"))
    whole = met.groupBy(*LINE).agg(F.first("l", ignorenulls=True).alias("l"), F.sort_array(F.collect_list(F.when(F.col("t").isNotNull(), token))).alias("t")).where("l is not null")
    return whole.select(*LINE, "l.*", *[F.col(f"t.{c}").alias(c) for c in characters.TOKENS]).sortWithinPartitions(*LINE)


def timed_chunks(lines: DataFrame, tokens: DataFrame, moras: DataFrame) -> DataFrame:
    """line_chunks of character_chunks in one go: lines, tokens and moras meet in one shuffle by song, and the
    characters of a line are timed together."""
    return characters.character_rows(with_tokens(lines.where("start_ms is not null").select(*LINE, "start_ms", "end_ms"), tokens, moras))


def line_chunks(chunks: DataFrame, tokens: DataFrame, lines: DataFrame) -> DataFrame:
    """Chunks reconciled with their line: gaps between tokens go to the last sung character before them; then
    the total is made the line's, by the last sung character where it falls short, and backwards from the
    end where it is over."""
    w = W.partitionBy(*LINE).orderBy("token_idx")
    edge = lines.select(*LINE, F.col("start_ms").alias("__ls"), F.col("end_ms").alias("__le"))
    met = tokens.join(edge, LINE).withColumns({"__next": F.coalesce(F.lead("start_ms").over(w), F.col("__le")), "__shown": F.sum((F.length("surface") > 0).cast("long")).over(w)})
    gap = F.bround(F.greatest(F.lit(0), F.col("__next") - F.col("end_ms")) / 10) + F.when(F.col("__shown") == 1, F.bround(F.greatest(F.lit(0), F.col("start_ms") - F.col("__ls")) / 10)).otherwise(0)
    gaps = met.where(F.length("surface") > 0).select(*TOKEN, "__ls", "__le", gap.cast("long").alias("__gap"))
    last_sung = F.max(F.when(F.col("sung"), F.col("char_idx"))).over(W.partitionBy(*TOKEN))
    return _reconciled(chunks.join(gaps, TOKEN).withColumn("duration_cs", F.col("duration_cs") + F.when(F.col("char_idx") == last_sung, F.col("__gap")).otherwise(0)))


def uniform_chunks(lines: DataFrame) -> DataFrame:
    """Every character of a line (surface, start_ms, end_ms) with an even share, the remainder to the last ones."""
    c = lines.select("*", F.posexplode(F.split("surface", "")).alias("char_idx", "text")).where("text <> ''")
    n = F.count(F.lit(1)).over(W.partitionBy(*LINE))
    total = F.greatest(F.lit(0), F.bround((F.col("end_ms") - F.col("start_ms")) / 10)).cast("long")
    c = c.withColumns({"__n": n, "__t": total})
    base = F.floor(F.col("__t") / F.col("__n"))
    return c.select(*LINE, F.col("char_idx").cast("long").alias("char_idx"), "text", (base + (F.col("char_idx") >= F.col("__n") - (F.col("__t") - base * F.col("__n"))).cast("long")).cast("long").alias("duration_cs"))


def render_karaoke(chunks: DataFrame) -> DataFrame:
    """Rows (song_id, line_idx, karaoke): the line's chunks as text with durations before sung characters."""
    piece = F.when(F.col("sung") & (F.col("duration_cs") > 0), F.concat(F.lit("{\\kf"), F.col("duration_cs").cast("string"), F.lit("}"), ass_escape(F.col("text")))).otherwise(ass_escape(F.col("text")))
    listed = F.sort_array(F.collect_list(F.struct("token_idx", "char_idx", piece.alias("p"))))
    return chunks.groupBy(*LINE).agg(F.array_join(F.transform(listed, lambda x: x["p"]), "").alias("karaoke"))


def fitting_size(longest: Column, width: int = 1766, ratio: float = 0.68, base: int = 120, least: int = 40) -> Column:
    """The font size at which a line of so many characters fits the width."""
    n = F.greatest(F.lit(1), F.bround(longest * ratio).cast("long"))
    return F.least(F.lit(base), F.greatest(F.lit(least), F.floor(F.lit(width) / n))).cast("long")


def fitting_ruby(font_size: Column) -> Column:
    """The size of rubies for a font size; null without one."""
    return F.when(font_size.isNotNull(), F.greatest(F.lit(20), F.bround(font_size * 0.4)).cast("long"))


def auto_font_size(lines: DataFrame, width: int = 1766, ratio: float = 0.68, base: int = 120, least: int = 40) -> DataFrame:
    """Per song, base and ruby font size at which its longest line fits the width."""
    size = fitting_size(F.max(F.char_length("surface")), width, ratio, base, least)
    return lines.groupBy("song_id").agg(size.alias("font_size")).withColumn("ruby_size", fitting_ruby(F.col("font_size")))


def _dialogue_head(style: str = "Main") -> Column:
    return F.concat(F.lit("Dialogue: 0,"), ass_time(F.col("display_start_ms")), F.lit(","), ass_time(F.col("display_end_ms")), F.lit(f",{style},,0,0,0,,"))


def dialogue_rows(layout: DataFrame, karaoke: DataFrame, style: str = "Main") -> DataFrame:
    """Rows (song_id, line_idx, row): one dialogue row a line, in emission order by (song_id, line_idx)."""
    return layout.join(karaoke, LINE).select(*LINE, F.concat(_dialogue_head(style), F.col("karaoke")).alias("row"))


def ruby_rows(layout: DataFrame, rubies: DataFrame) -> DataFrame:
    """Rows (song_id, line_idx, layer, seq, row) of rubies (song_id, line_idx, token_idx, reading, x, y) while their
    line shows."""
    span = F.concat(ass_time(F.col("display_start_ms")), F.lit(","), ass_time(F.col("display_end_ms")))
    text = F.concat(F.lit("Dialogue: 1,"), span, F.lit(",Ruby,,0,0,0,,{\\an5\\pos("), F.col("x").cast("string"), F.lit(","), F.col("y").cast("string"), F.lit(")}"), ass_escape(F.col("reading")))
    return rubies.join(layout, LINE).select(*LINE, F.lit(2).alias("layer"), F.col("token_idx").cast("long").alias("seq"), text.alias("row"))


def layered_rows(layout: DataFrame, karaoke: DataFrame, rubies: DataFrame | None = None) -> DataFrame:
    """Rows (song_id, line_idx, layer, seq, row) of a two-slot song in emission order: the indicator dots ahead
    of a paragraph's first line, the line, and its rubies (song_id, line_idx, token_idx, reading, x, y)."""
    base = dialogue_rows(layout, karaoke).select(*LINE, F.lit(1).alias("layer"), F.lit(0).cast("long").alias("seq"), "row")
    dot = F.concat(F.lit("Dialogue: 0,"), ass_time(F.col("dot_start_ms")), F.lit(","), ass_time(F.col("dot_end_ms")), F.lit(",Indicator,,0,0,0,,{\\p1}"))
    heads = layout.where("line_in_paragraph = 0").select(*LINE, "paragraph")
    dots = indicator_events(layout).join(heads, ["song_id", "paragraph"]).select(*LINE, F.lit(0).alias("layer"), F.col("dot").alias("seq"), dot.alias("row"))
    rows = dots.unionByName(base)
    if rubies is not None:
        rows = rows.unionByName(ruby_rows(layout, rubies))
    return rows


# fixed values: fields of the format's style and event lines
STYLE_FIELDS = (
    "Name", "Fontname", "Fontsize", "PrimaryColour", "SecondaryColour", "OutlineColour", "BackColour", "Bold", "Italic", "Underline", "StrikeOut", "ScaleX",
    "ScaleY", "Spacing", "Angle", "BorderStyle", "Outline", "Shadow", "Alignment", "MarginL", "MarginR", "MarginV", "Encoding",
)
EVENT_FIELDS = ("Layer", "Start", "End", "Style", "Name", "MarginL", "MarginR", "MarginV", "Effect", "Text")
#: What a style has unless it says otherwise; sizes in angle brackets are filled in song by song.
PLAIN_STYLE = dict.fromkeys(STYLE_FIELDS, 0) | {
    "Fontname": "Noto Sans CJK JP", "Fontsize": "<base>", "PrimaryColour": "&H000000FF", "SecondaryColour": "&H00FFFFFF", "OutlineColour": "&H00000000", "BackColour": "&H60000000",
    "Bold": -1, "ScaleX": 100, "ScaleY": 100, "BorderStyle": 1, "Outline": 4, "Alignment": 5, "MarginL": 40, "MarginR": 40, "MarginV": 40, "Encoding": 1,
}
STYLES = ({"Name": "Main"}, {"Name": "Ruby", "Fontsize": "<ruby>", "Outline": 3}, {"Name": "Indicator", "Fontsize": 10, "Bold": 0, "Alignment": 7})


def ass_header(styles: tuple[dict, ...] = STYLES, width: int = 1920, height: int = 1080, title: str = "Karaoke") -> str:
    """The sections before the dialogue rows; styles name what differs from PLAIN_STYLE."""
    info = {"Title": title, "ScriptType": "v4.00+", "WrapStyle": 2, "ScaledBorderAndShadow": "yes", "PlayResX": width, "PlayResY": height}
    rows = ["Style: " + ",".join(str((PLAIN_STYLE | style)[f]) for f in STYLE_FIELDS) for style in styles]
    sections = {"Script Info": [f"{k}: {v}" for k, v in info.items()], "V4+ Styles": ["Format: " + ", ".join(STYLE_FIELDS), *rows], "Events": ["Format: " + ", ".join(EVENT_FIELDS)]}
    return "\n\n".join("\n".join([f"[{name}]", *lines]) for name, lines in sections.items())


def ass_files(rows: DataFrame, header: str, sizes: DataFrame | None = None, base: int = 96, ruby: int = 38) -> DataFrame:
    """One row a song (song_id, content): header and dialogue rows in order, with a byte order mark. sizes
    (song_id, font_size, ruby_size) fills in a song's font sizes, base and ruby those of all others."""
    order = [c for c in ("line_idx", "layer", "seq", "row") if c in rows.columns]
    ordered = F.transform(F.sort_array(F.collect_list(F.struct(*order))), lambda x: x["row"])
    files = rows.groupBy("song_id").agg(F.array_join(ordered, "\n").alias("events"))
    files = files.withColumns({"font_size": F.lit(None), "ruby_size": F.lit(None)}) if sizes is None else files.join(sizes, "song_id", "left")
    return _headed(files, header, base, ruby)


def _headed(files: DataFrame, header: str, base: int = 96, ruby: int = 38) -> DataFrame:
    """Files of songs (song_id, events, font_size, ruby_size)."""
    head = F.lit("\ufeff" + header + "\n")
    for mark, column, default in (("<base>", "font_size", base), ("<ruby>", "ruby_size", ruby)):
        head = F.replace(head, F.lit(mark), F.coalesce(F.col(column).cast("string"), F.lit(str(default))))
    return files.select("song_id", F.concat(head, "events", F.lit("\n")).alias("content"))


def ass_event_count(files: DataFrame) -> DataFrame:
    """Dialogue rows of each file (song_id, content)."""
    return files.select("song_id", F.size(F.filter(F.split("content", "\n"), lambda x: x.startswith("Dialogue:"))).cast("long").alias("events"))


def _line_files(layout: DataFrame, tokens_of: Callable[[DataFrame], DataFrame], header: str | None, rubies: DataFrame | None, before: Column, sized: bool) -> DataFrame:
    """Files of laid out lines, with the rows before a line's own and those of its rubies after it. tokens_of
    adds the columns of with_tokens."""
    longest = F.max(F.char_length("surface")).over(W.partitionBy("song_id")) if sized else F.lit(None).cast("int")
    texts = {"head": F.when(F.col("start_ms").isNotNull(), _dialogue_head()), "before": before, "after": F.lit(None).cast("string"), "font_size": fitting_size(longest) if sized else F.lit(None).cast("long")}
    rows = layout.withColumns(texts)
    if rubies is not None:
        listed = F.sort_array(F.collect_list(F.struct("seq", "row")))
        own = ruby_rows(layout, rubies).groupBy(*LINE).agg(F.array_join(F.transform(listed, lambda x: x["row"]), "\n").alias("after"))
        rows = rows.drop("after").join(own, LINE, "left").repartition("song_id")
    shown = [c for c in ("surface",) if c in layout.columns]
    rows = tokens_of(rows.select(*LINE, *shown, "start_ms", "end_ms", *texts).sortWithinPartitions(*LINE))
    files = characters.song_events(rows.select(*LINE, "start_ms", "end_ms", *texts, *characters.TOKENS)).withColumn("ruby_size", fitting_ruby(F.col("font_size")))
    return _headed(files, ass_header() if header is None else header)


def fixed_slot_files(lines: DataFrame, tokens_of: Callable[[DataFrame], DataFrame], header: str | None = None, rubies: DataFrame | None = None) -> DataFrame:
    """fixed_slot_subtitles of lines to which tokens_of adds the columns of with_tokens."""
    return _line_files(simple_display(lines), tokens_of, header, rubies, F.lit(None).cast("string"), "surface" in lines.columns)


def fixed_slot_subtitles(lines: DataFrame, tokens: DataFrame, moras: DataFrame, header: str | None = None, rubies: DataFrame | None = None) -> DataFrame:
    """The fixed-slot subtitle job: timed lines (surface), tokens, moras and placed rubies to one file a song,
    with the font sizes at which the song's longest line fits."""
    return fixed_slot_files(lines, lambda rows: with_tokens(rows, tokens, moras), header, rubies)


def two_slot_files(lines: DataFrame, tokens_of: Callable[[DataFrame], DataFrame], header: str | None = None, rubies: DataFrame | None = None, dots: int = 4, lead_ms: int = 3000) -> DataFrame:
    """two_slot_subtitles of lines to which tokens_of adds the columns of with_tokens."""
    def dot(k: int) -> Column:
        end = F.col("start_ms") - lead_ms + k * (lead_ms // dots)
        text = F.concat(F.lit("Dialogue: 0,"), ass_time(F.col("display_start_ms")), F.lit(","), ass_time(end), F.lit(",Indicator,,0,0,0,,{\\p1}"))
        return F.when((F.col("line_in_paragraph") == 0) & (end > F.col("display_start_ms")), text)

    before = F.nullif(F.concat_ws("\n", *[dot(k) for k in range(dots)]), F.lit(""))
    return _line_files(slot_timings(lines), tokens_of, header, rubies, before, False)


def two_slot_subtitles(lines: DataFrame, tokens: DataFrame, moras: DataFrame, header: str | None = None, rubies: DataFrame | None = None) -> DataFrame:
    """The two-slot subtitle job: timed lines, tokens, moras and placed rubies to one file a song."""
    return two_slot_files(lines, lambda rows: with_tokens(rows, tokens, moras), header, rubies)


def active_frames(layout: DataFrame, times: DataFrame, after_ms: int = HOLD_MS, bin_ms: int = 10_000) -> DataFrame:
    """Lines shown at sampled times (song_id, t_ms), at most one a slot: of those from entry_ms to after_ms past
    their end, in line order, a later one replaces the pick unless that is of its paragraph and still walking. Lines are dealt to bins
    of time, so the join is an equality join."""
    shown = F.sequence(floor_div(F.col("entry_ms"), F.lit(bin_ms)), floor_div(F.greatest("entry_ms", F.col("end_ms") + after_ms), F.lit(bin_ms)))
    dealt = times.withColumn("__bin", floor_div(F.col("t_ms"), F.lit(bin_ms)))
    seen = layout.withColumn("__bin", F.explode(shown)).join(dealt, ["song_id", "__bin"]).where(F.col("t_ms").between(F.col("entry_ms"), F.col("end_ms") + after_ms)).withColumn("slot", F.col("line_in_paragraph") % 2)
    rows = F.sort_array(F.collect_list(F.struct("line_idx", "paragraph", "walk_done_ms")))
    kind = "struct<line_idx:bigint,paragraph:bigint,walk_done_ms:bigint>"
    pick = lambda acc, x: F.when(acc.isNull() | (acc["paragraph"] != x["paragraph"]) | (F.col("t_ms") >= acc["walk_done_ms"]), x).otherwise(acc)
    return seen.groupBy("song_id", "t_ms", "slot").agg(rows.alias("rows")).select("song_id", "t_ms", "slot", F.aggregate("rows", F.lit(None).cast(kind), pick)["line_idx"].alias("line_idx"))
