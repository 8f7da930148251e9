"""Queries over the driver's tables for the text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from .adapters import adapt, oracle
from .catalog import ORACLES, QUERIES


def add(name, fn, sql=None):
    QUERIES[name] = fn
    if sql:
        ORACLES[name] = sql


_LINES = """l AS (SELECT song_id, unnest(range(len(ls))) AS k, unnest(ls) AS raw FROM (SELECT song_id, regexp_split_to_array(coalesce(text, ''), 'LINE_END') AS ls FROM song_lines)),
    n AS (SELECT song_id, k, regexp_replace(raw, '^[BLANKS]+|[BLANKS]+$', '', 'g') AS line FROM l)"""
add("normalised_lines", lambda s, d: text.normalised_lines(adapt(s, d, "song_lines")),
    oracle(_LINES + " SELECT song_id, row_number() OVER (PARTITION BY song_id ORDER BY k) - 1 AS line_idx, line FROM n WHERE line <> ''", "song_lines"))


def _stamped(s, d):
    """Every line gets a stamp, some none, some metadata; a word becomes an annotation."""
    rows = adapt(s, d, "song_lines")
    line = lambda x, i: F.when(i % 3 == 0, F.concat(F.lit("[0"), (i % 10).cast("string"), F.lit(":1"), (i % 10).cast("string"), F.lit("."), (i * 37 % 1000).cast("string"), F.lit("]"), x)).when(i % 3 == 1, F.concat(F.lit("{ab|c}"), x)).otherwise(F.lit("[ar:someone]"))
    return rows.withColumn("text", F.array_join(F.transform(F.split("text", "\n"), line), "\n"))


_STAMPED = _LINES + """, p AS (SELECT song_id, k, line, k % 3 AS kind, CAST((k * 37) % 1000 AS VARCHAR) AS f FROM (SELECT song_id, k, regexp_replace(raw, '[BLANKS]+$', '') AS line FROM l)),
    q AS (SELECT song_id, k, regexp_replace(CASE kind WHEN 0 THEN line ELSE 'ab' || line END, '^[BLANKS]+|[BLANKS]+$', '', 'g') AS lyric,
                 CASE kind WHEN 0 THEN ((k % 10) * 60 + 10 + k % 10) * 1000 + CAST(round_even(CAST(f AS BIGINT) * 1000 / pow(10, length(f)), 0) AS BIGINT) END AS start_ms FROM p WHERE kind < 2)"""
add("parse_lrc", lambda s, d: text.parse_lrc(_stamped(s, d)),
    oracle(_STAMPED + " SELECT song_id, row_number() OVER (PARTITION BY song_id ORDER BY k) - 1 AS line_idx, lyric, start_ms FROM q WHERE lyric <> ''", "song_lines"))
add("visible_lines", lambda s, d: text.visible_lines(_stamped(s, d)), oracle(_STAMPED + " SELECT song_id, k + 1 AS line_number, lyric AS visible FROM q WHERE lyric <> ''", "song_lines"))
_READING = "lower(regexp_replace(line, '[BLANKS\\p{P}\\p{S}]', '', 'g'))"
add("normalise_reading", lambda s, d: text.normalised_lines(adapt(s, d, "song_lines")).select("song_id", "line_idx", text.normalise_reading(F.col("line")).alias("reading")),
    oracle(_LINES + f" SELECT song_id, row_number() OVER (PARTITION BY song_id ORDER BY k) - 1 AS line_idx, {_READING} AS reading FROM n WHERE line <> ''", "song_lines"))
add("split_moras", lambda s, d: text.normalised_lines(adapt(s, d, "song_lines")).select("song_id", "line_idx", F.size(text.split_moras(F.col("line"))).cast("long").alias("n"), F.array_join(text.split_moras(F.col("line")), "/").alias("moras")),
    oracle(_LINES + """, m AS (SELECT song_id, row_number() OVER (PARTITION BY song_id ORDER BY k) - 1 AS line_idx, regexp_extract_all(regexp_replace(line, '[BLANKS\\p{P}]', '', 'g'), '.') AS x FROM n WHERE line <> '')
        SELECT song_id, line_idx, len(x) AS n, array_to_string(x, '/') AS moras FROM m""", "song_lines"))
add("is_sung", lambda s, d: text.normalised_lines(adapt(s, d, "song_lines")).groupBy("song_id").agg(F.count_if(text.is_sung(F.col("line"))).alias("sung"), F.count_if(~text.is_sung(F.substring("line", -1, 1))).alias("open_end")),
    oracle(_LINES + """ SELECT song_id, count(*) FILTER (regexp_matches(line, '[^\\p{P}\\p{S}\\p{Z}]')) AS sung, count(*) FILTER (NOT regexp_matches(line[-1], '[^\\p{P}\\p{S}\\p{Z}]')) AS open_end FROM n WHERE line <> '' GROUP BY song_id""", "song_lines"))


def _annotated(s, d):
    n = text.normalised_lines(adapt(s, d, "song_lines"))
    word = F.split_part("line", F.lit(" "), F.lit(1))
    k = F.col("line_idx") % 4
    plain = F.translate("line", "{}[]|", "()()/")  # the only marks are ours
    return n.withColumn("line", plain).withColumn("line", F.when(k == 0, F.concat(F.lit("{"), word, F.lit("|yo}"), F.col("line"))).when(k == 1, F.concat(F.col("line"), F.lit("[x|Ya]"))).when(k == 2, F.concat(F.col("line"), F.lit("{x|y"))).otherwise(F.concat(F.col("line"), F.lit("[x|]"))))


_ANN = _LINES + """, a AS (SELECT song_id, row_number() OVER (PARTITION BY song_id ORDER BY k) - 1 AS line_idx, translate(line, '{}[]|', '()()/') AS line FROM n WHERE line <> ''), b AS (SELECT * FROM a)"""
add("parse_annotations", lambda s, d: text.parse_annotations(_annotated(s, d))[0],
    oracle(_ANN + """ SELECT song_id, line_idx, t.token_idx, t.surface, t.reading, t.alignment_pronunciation FROM (
        SELECT song_id, line_idx, unnest(CASE line_idx % 4 WHEN 0 THEN [{'token_idx': 0, 'surface': split_part(line, ' ', 1), 'reading': 'yo', 'alignment_pronunciation': NULL}, {'token_idx': 1, 'surface': line, 'reading': line, 'alignment_pronunciation': NULL}]
            ELSE [{'token_idx': 0, 'surface': line, 'reading': line, 'alignment_pronunciation': NULL}, {'token_idx': 1, 'surface': 'x', 'reading': 'x', 'alignment_pronunciation': 'ya'}] END) AS t FROM b WHERE line_idx % 4 < 2)""", "song_lines"))
add("annotation_rejects", lambda s, d: text.parse_annotations(_annotated(s, d))[1],
    oracle(_ANN + " SELECT song_id, line_idx, CASE line_idx % 4 WHEN 2 THEN 'annotation is not closed' ELSE 'empty surface or pronunciation' END AS reason FROM b WHERE line_idx % 4 >= 2", "song_lines"))
add("line_widths", lambda s, d: text.line_widths(text.visible_lines(adapt(s, d, "song_lines"))).select("song_id", "line_number", "width_px", "overflow"),
    oracle(_LINES + """, w AS (SELECT song_id, k + 1 AS line_number, length(line) AS n, length(line) - length(replace(line, ' ', '')) AS blanks, length(regexp_replace(line, '[\\x{00}-\\x{ff}]', '', 'g')) AS wide FROM n WHERE line <> ''),
        x AS (SELECT song_id, line_number, blanks * 12 + wide * 48 + (n - blanks - wide) * 24 + (n - 1) * 9 AS width_px FROM w) SELECT *, width_px > 1152 AS overflow FROM x""", "song_lines"))
add("overflow_report", lambda s, d: text.overflow_report(text.line_widths(text.visible_lines(adapt(s, d, "song_lines"))), ["song_id"]).select("song_id", "line_number", "total", "excerpt"),
    oracle(_LINES + """, w AS (SELECT song_id, k + 1 AS line_number, line, length(line) AS n, length(line) - length(replace(line, ' ', '')) AS blanks, length(regexp_replace(line, '[\\x{00}-\\x{ff}]', '', 'g')) AS wide FROM n WHERE line <> ''),
        x AS (SELECT song_id, line_number, line, row_number() OVER (PARTITION BY song_id ORDER BY line_number) AS r, count(*) OVER (PARTITION BY song_id) AS total FROM w WHERE blanks * 12 + wide * 48 + (n - blanks - wide) * 24 + (n - 1) * 9 > 1152)
        SELECT song_id, line_number, total, CASE WHEN length(line) <= 40 THEN line ELSE line[1:40] || '...' END AS excerpt FROM x WHERE r <= 8""", "song_lines"))
add("ass_time", lambda s, d: adapt(s, d, "moras").select("song_id", "seq", text.ass_time(F.col("start_ms") * 977 + 5).alias("label")),
    oracle("""c AS (SELECT song_id, seq, CAST(round_even((start_ms * 977 + 5) / 10, 0) AS BIGINT) AS cs FROM moras)
        SELECT song_id, seq, printf('%d:%02d:%02d.%02d', cs // 360000, cs // 6000 % 60, cs // 100 % 60, cs % 100) AS label FROM c""", "moras"))
add("lrc_time", lambda s, d: adapt(s, d, "moras").select("song_id", "seq", text.lrc_time(F.col("start_ms") * 77 + 5).alias("label")),
    oracle("""c AS (SELECT song_id, seq, CAST(floor((start_ms * 77 + 5) / 10 + 0.5) AS BIGINT) AS cs FROM moras)
        SELECT song_id, seq, printf('[%02d:%02d:%02d]', cs // 6000, cs // 100 % 60, cs % 100) AS label FROM c""", "moras"))
add("unconverted", lambda s, d: text.unconverted(s.read.parquet(f"{d}/part.parquet").selectExpr("p_partkey AS id", "p_brand AS surface", "p_name AS reading")).select("id"),
    "SELECT p_partkey AS id FROM part WHERE regexp_matches(p_brand, '[A-Za-z0-9]') AND regexp_matches(p_name, '[A-Za-z0-9]')")


def _brands(s, d):
    p = s.read.parquet(f"{d}/part.parquet")
    words = p.selectExpr("p_type AS word", "'た' AS kana").distinct()
    return text.foreign_readings(p.selectExpr("p_partkey AS id", "concat(p_type, '-', p_size) AS surface"), words, ["id"])


add("foreign_readings", _brands,
    """SELECT p_partkey AS id, 'た' || list_reduce(list_transform(regexp_extract_all(CAST(p_size AS VARCHAR), '.'), lambda x: ['ぜろ','いち','に','さん','よん','ご','ろく','なな','はち','きゅう'][CAST(x AS INT) + 1]), lambda a, b: a || b) AS foreign_reading
       FROM part WHERE regexp_matches(p_type, '^[A-Za-z]+$')""")
