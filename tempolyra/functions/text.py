"""Lyric text functions over corpora: lines, stamps, annotations, moras, widths, formats."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..sources.shared import small_side

# fixed values: small kana that attach to the character before them
SMALL_KANA = "ゃゅょぁぃぅぇぉゎゕゖ"
# fixed values: readings of digits and letters
DIGITS = {"0": "ぜろ", "1": "いち", "2": "に", "3": "さん", "4": "よん", "5": "ご", "6": "ろく", "7": "なな", "8": "はち", "9": "きゅう"}
LETTERS = {
    "a": "えー", "b": "びー", "c": "しー", "d": "でぃー", "e": "いー", "f": "えふ", "g": "じー", "h": "えいち", "i": "あい",
    "j": "じぇー", "k": "けー", "l": "える", "m": "えむ", "n": "えぬ", "o": "おー", "p": "ぴー", "q": "きゅー", "r": "あーる",
    "s": "えす", "t": "てぃー", "u": "ゆー", "v": "ぶい", "w": "だぶりゅー", "x": "えっくす", "y": "わい", "z": "ぜっと",
}
# fixed values: widths in pixels of the estimate
LINE_WIDTH, FULL, HALF, BLANK, SPACING, RUBY_PAIR = 1280 - 128, 48, 24, 12, 9, 2 * 26 + 5

#: Katakana with a hiragana partner, U+30A1 to U+30F6, and the partners 0x60 before them.
_KATAKANA = "".join(map(chr, range(0x30A1, 0x30F7)))
_HIRAGANA = "".join(map(chr, range(0x3041, 0x3097)))

# fixed values: white space and line ends of Unicode, as classes for regular expressions of Java and RE2
BLANK_CLASS = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LINE_END = r"\r\n|[\x{a}-\x{d}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
# the white space of a browser's trim
SHOWN_BLANK_CLASS = r"\x{9}-\x{d}\x{20}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
# fixed values: patterns of stamps and annotations
_STAMP = r"\[(\d+):(\d+)(?:[.:](\d+))?\]"
_STRICT_STAMP = r"\[(?:\d{1,3}):(?:\d{1,2})(?:[.:]\d{1,3})?\]"
_ANNOTATION = r"\{[^}]*\}|\[[^\]]*\]|[^{}\[\]]+|[{}\[\]]"


def nfkc(text: Column) -> Column:
    """Compatibility composition, the one step that SQL lacks. Only texts that hold anything but ASCII, kana
    and common kanji are composed; the others pass as they are."""

    @F.pandas_udf(T.StringType())
    def compose(rows: pd.Series) -> pd.Series:
        return rows.str.normalize("NFKC")

    odd = text.rlike("[^\\x{0}-\\x{7f}\\x{3001}-\\x{3098}\\x{309d}-\\x{30ff}\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}]")
    return F.coalesce(compose(F.when(odd, text)), text)


def _members(blanks: str) -> str:
    """The characters of a class that is written in code points and ranges of them."""
    ends = [(int(a, 16), int(z or a, 16)) for a, z in re.findall(r"\\x\{(\w+)\}(?:-\\x\{(\w+)\})?", blanks)]
    return "".join(chr(c) for a, z in ends for c in range(a, z + 1))


def trim_blanks(text: Column, blanks: str = BLANK_CLASS) -> Column:
    """Without white space at either end, that of Unicode included. Only the ends are looked at."""
    return F.btrim(text, F.lit(_members(blanks)))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: an argument of a lambda is never written out again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _each_line(texts: DataFrame, text_col: str, ends: str, make: Callable[[Column], Column], name: str) -> DataFrame:
    """Rows (keys, line_no, name) of the lines for which make gives a value. Lines are made before they become
    rows, so a filter on them is not computed a second time further down."""
    keys = [c for c in texts.columns if c != text_col]
    made = F.transform(F.split(F.coalesce(text_col, F.lit("")), ends), make)
    return texts.select(*keys, F.posexplode_outer(made).alias("line_no", name)).where(F.col(name).isNotNull())


def _numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    place = F.row_number().over(W.partitionBy(*keys).orderBy("line_no")) - 1
    return rows.withColumn("line_idx", place.cast("long"))


def normalised_lines(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """Trimmed lines that are not blank, numbered from 0 as line_idx."""
    keys = [c for c in texts.columns if c != text_col]
    rows = _each_line(texts, text_col, LINE_END, lambda raw: _let(trim_blanks(raw), lambda x: F.when(x != "", x)), "line")
    return _numbered(rows, keys).select(*keys, "line_idx", "line")


def stamp_ms(minutes: Column, seconds: Column, fraction: Column) -> Column:
    """Milliseconds of a stamp; the fraction counts by its number of digits, half to even."""
    part = F.when(fraction == "", F.lit(0.0)).otherwise(F.bround(fraction.cast("double") * 1000 / F.pow(F.lit(10.0), F.length(fraction))))
    return (minutes.cast("long") * 60 + seconds.cast("long")) * 1000 + part.cast("long")


def parse_lrc(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows (keys, line_idx, lyric, start_ms): the first stamp of a line or null. Stamps go, {x|y} becomes x;
    blank lines, @ruby directives and metadata lines are skipped."""
    keys = [c for c in texts.columns if c != text_col]

    def line(raw: Column) -> Column:
        lyric = trim_blanks(F.regexp_replace(F.regexp_replace(raw, _STAMP, ""), r"\{([^|{}]+)\|[^{}]*\}", "$1"))
        stamp = F.when(raw.rlike(_STAMP), stamp_ms(*(F.regexp_extract(raw, _STAMP, k) for k in (1, 2, 3))))
        kept = (raw != "") & ~F.lower(raw).startswith("@ruby") & (raw.rlike(_STAMP) | ~raw.startswith("["))
        return F.when(kept, _let(lyric, lambda x: F.when(x != "", F.struct(x.alias("lyric"), stamp.alias("start_ms")))))

    bare = lambda raw: F.regexp_replace(trim_blanks(raw), "^\\x{FEFF}+", "")
    rows = _each_line(texts, text_col, LINE_END, lambda raw: _let(bare(raw), line), "p")
    return _numbered(rows, keys).select(*keys, "line_idx", "p.lyric", "p.start_ms")


def visible_lines(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows (keys, line_number, visible): lines as a player shows them, with their original numbers from 1."""
    keys = [c for c in texts.columns if c != text_col]
    trim = lambda c: trim_blanks(c, SHOWN_BLANK_CLASS)

    def line(raw: Column) -> Column:
        def shown(bare: Column) -> Column:
            text = trim(F.regexp_replace(F.regexp_replace(bare, r"\{([^{}|]+)\|[^{}]*\}", "$1"), r"\[([^\[\]|]+)\|[^\[\]]*\]", "$1"))
            lyric = raw.rlike(_STRICT_STAMP) | ~bare.rlike(rf"^\[[^\]|]+:[^\]]*\][{SHOWN_BLANK_CLASS}]*$")
            return F.when(lyric, _let(text, lambda x: F.when(x != "", x)))

        return F.when((raw != "") & ~raw.rlike(r"(?i)^@ruby\b"), _let(trim(F.regexp_replace(raw, _STRICT_STAMP, "")), shown))

    start = lambda raw: trim(F.regexp_replace(raw, "^\\x{FEFF}", ""))
    rows = _each_line(texts, text_col, r"\r?\n", lambda raw: _let(start(raw), line), "visible")
    return rows.select(*keys, (F.col("line_no") + 1).cast("long").alias("line_number"), "visible")


def normalise_reading(text: Column) -> Column:
    """Composed by nfkc, katakana to hiragana, without white space, punctuation and symbols, in lower case."""
    return F.lower(F.regexp_replace(F.translate(nfkc(text), _KATAKANA, _HIRAGANA), rf"[{BLANK_CLASS}\p{{P}}\p{{S}}]", ""))


def split_moras(reading: Column) -> Column:
    """Timing units: one character each, small kana with the one before."""
    return F.regexp_extract_all(F.regexp_replace(reading, rf"[{BLANK_CLASS}\p{{P}}]", ""), F.lit(f"(?s).[{SMALL_KANA}]*"), 0)


def is_sung(text: Column) -> Column:
    """Whether anything but punctuation, symbols and separators is in a text."""
    return text.rlike(r"[^\p{P}\p{S}\p{Z}]")


def parse_annotations(lines: DataFrame, text_col: str = "line") -> tuple[DataFrame, DataFrame]:
    """Tokens (keys, token_idx, surface, reading, alignment_pronunciation) of lines with {surface|reading} and
    [surface|romaji] annotations, and rejects (keys, reason). Plain text keeps its surface as reading."""
    keys = [c for c in lines.columns if c != text_col]
    parts = lines.select(*keys, F.regexp_extract_all(F.coalesce(text_col, F.lit("")), F.lit(_ANNOTATION), 0).alias("parts"))
    inner = lambda p: F.substring(p, 2, F.length(p) - 2)
    marked = lambda p: p.rlike(r"^[{\[]") & (F.length(p) > 1)
    bars = lambda p: F.length(p) - F.length(F.replace(p, F.lit("|"), F.lit("")))
    reason = lambda p: (
        F.when(p.isin("}", "]"), "unmatched closing mark").when(p.isin("{", "["), "annotation is not closed")
        .when(marked(p) & (bars(p) != 1), "annotation needs exactly one |")
        .when(marked(p) & (inner(p).startswith("|") | inner(p).endswith("|")), "empty surface or pronunciation")
        .when(p.startswith("[") & ~F.split_part(inner(p), F.lit("|"), F.lit(2)).rlike("^[A-Za-z']+$"), "pronunciation must be Latin letters")
    )
    judged = parts.withColumn("reason", F.get(F.filter(F.transform("parts", reason), lambda x: x.isNotNull()), F.lit(0)))
    tokens = judged.where("reason is null").select(*keys, F.posexplode("parts").alias("token_idx", "p"))
    first, second = F.split_part(inner(F.col("p")), F.lit("|"), F.lit(1)), F.split_part(inner(F.col("p")), F.lit("|"), F.lit(2))
    curly, square = F.col("p").startswith("{"), F.col("p").startswith("[")
    out = tokens.select(
        *keys, F.col("token_idx").cast("long").alias("token_idx"), F.when(curly | square, first).otherwise(F.col("p")).alias("surface"),
        F.when(curly, second).when(square, first).otherwise(F.col("p")).alias("reading"), F.when(square, F.lower(second)).alias("alignment_pronunciation"),
    )
    return out, judged.where("reason is not null").select(*keys, "reason")


def particle_pronunciation(tokens: DataFrame, particle: str = "助詞") -> DataFrame:
    """Sets alignment_pronunciation of the particles は (wa) and へ (e), by the column part_of_speech."""
    is_particle = F.split_part("part_of_speech", F.lit(","), F.lit(1)) == particle
    return tokens.withColumn("alignment_pronunciation", F.when(is_particle & (F.col("surface") == "は"), "wa").when(is_particle & (F.col("surface") == "へ"), "e"))


def unconverted(tokens: DataFrame) -> DataFrame:
    """Rows whose surface and reading both hold Latin letters or digits."""
    return tokens.where(F.col("surface").rlike("[A-Za-z0-9]") & F.col("reading").rlike("[A-Za-z0-9]"))


def foreign_readings(tokens: DataFrame, words: DataFrame, keys: list[str], most_broadcast: int = 500_000) -> DataFrame:
    """Rows (keys, foreign_reading) for tokens (keys, surface) with Latin letters or digits: words (word, kana)
    give a word's reading, else its letters' names; digits their names; separators none; the rest stays.
    The dictionary is broadcast up to most_broadcast rows and shuffled beyond."""
    side = words.select(F.lower("word").alias("__w"), F.col("kana").alias("__kana"))
    names = F.create_map(*[F.lit(x) for kv in {**LETTERS, **DIGITS}.items() for x in kv])
    spell = lambda p: F.array_join(F.transform(F.split(F.lower(p), ""), lambda c: F.coalesce(names[c], F.lit(""))), "")
    parts = tokens.where(F.col("surface").rlike("[A-Za-z0-9]")).select(*keys, F.posexplode(F.regexp_extract_all("surface", F.lit("[A-Za-z]+|[0-9]+|[^A-Za-z0-9]+"), 0)).alias("__k", "__p"))
    met = parts.join(small_side(side, most_broadcast), F.lower("__p") == F.col("__w"), "left")
    piece = (
        F.when(F.col("__p").rlike("^[A-Za-z]+$"), F.coalesce("__kana", spell(F.col("__p")))).when(F.col("__p").rlike("^[0-9]+$"), spell(F.col("__p")))
        .when(F.col("__p").rlike("^[-'’_]+$"), "").otherwise(F.translate("__p", _KATAKANA, _HIRAGANA))
    )
    return met.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__k", piece.alias("r")))), lambda x: x["r"]), "").alias("foreign_reading"))


def fix_foreign_readings(tokens: DataFrame, words: DataFrame, line_keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Tokens (line_keys, token_idx, surface, reading) with missing or unconverted foreign readings made
    anew, and the lines' readings (line_keys, reading) rebuilt from them in order."""
    keys = [*line_keys, "token_idx"]
    made = foreign_readings(tokens, words, keys)
    bad = F.col("surface").rlike("[A-Za-z0-9]") & (F.col("reading").isNull() | (F.trim("reading") == "") | F.col("reading").rlike("[A-Za-z0-9]"))
    fixed = tokens.join(made, keys, "left").withColumn("reading", F.when(bad, F.col("foreign_reading")).otherwise(F.col("reading"))).drop("foreign_reading")
    lines = fixed.groupBy(*line_keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("token_idx", "reading"))), lambda x: x["reading"]), "").alias("reading"))
    return fixed, lines


def line_width(text: Column) -> Column:
    """Estimated pixels: full, half or blank width of each character, room for a two-kana ruby over each
    kanji, and letter spacing. Counted by lengths, not character by character."""
    n = F.char_length(text)
    wide = F.char_length(F.regexp_replace(text, "[\\x{00}-\\x{ff}]", ""))
    kanji = F.when(wide > 0, n - F.char_length(F.regexp_replace(text, "[㐀-䶿一-鿿]", ""))).otherwise(0)
    blanks = n - F.char_length(F.replace(text, F.lit(" "), F.lit("")))
    total = kanji * max(FULL, RUBY_PAIR) + (wide - kanji) * FULL + blanks * BLANK + (n - wide - blanks) * HALF
    return F.when(n == 0, 0).otherwise(total + (n - 1) * SPACING)


def line_widths(lines: DataFrame, text_col: str = "visible") -> DataFrame:
    """Adds width_px and overflow."""
    return lines.withColumn("width_px", line_width(F.col(text_col)).cast("long")).withColumn("overflow", F.col("width_px") > LINE_WIDTH)


def overflow_report(lines: DataFrame, keys: list[str], most: int = 8, excerpt: int = 40) -> DataFrame:
    """The first `most` overflowing lines of each text, with an excerpt and how many there are."""
    w = W.partitionBy(*keys)
    bad = lines.where("overflow").withColumns({"__k": F.row_number().over(w.orderBy("line_number")), "total": F.count(F.lit(1)).over(w)})
    short = F.when(F.char_length("visible") <= excerpt, F.col("visible")).otherwise(F.concat(F.substring("visible", 1, excerpt), F.lit("...")))
    return bad.where(F.col("__k") <= most).withColumn("excerpt", short).drop("__k", "overflow")


def ass_time(ms: Column) -> Column:
    """H:MM:SS.cc, hundredths half to even."""
    cs = F.bround(ms / 10).cast("long")
    return F.format_string("%d:%02d:%02d.%02d", F.floor(cs / 360000), F.floor(cs / 6000) % 60, F.floor(cs / 100) % 60, cs % 100)


def lrc_time(ms: Column) -> Column:
    """[mm:ss:cc], hundredths half up."""
    cs = F.greatest(F.floor(ms / 10 + 0.5), F.lit(0)).cast("long")
    return F.format_string("[%02d:%02d:%02d]", F.floor(cs / 6000), F.floor(cs / 100) % 60, cs % 100)


def ass_escape(text: Column) -> Column:
    """Backslashes and braces made harmless."""
    x = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(x, F.lit("{"), F.lit("\\{")), F.lit("}"), F.lit("\\}"))
