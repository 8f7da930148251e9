"""Redaction of event messages and details.

What is hidden is told by expressions alone: on flat texts directly, on nested JSON leaf by leaf. A document is laid
out as an array of its leaves, each with the keys above it; one expression makes every leaf safe, and the leaves
are put together again. Only laying out and putting together, for any depth, are Python, Arrow-batched.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: marks, limits, keys and patterns
HIDDEN, CUT, LIMIT = "[REDACTED]", "\n...[truncated]", 4000
SECRET = r"(?i)(api[_-]?key|authorization|cookie|password|secret|token|signature|credential)"
PATH_KEY = r"(?i)(^|_)(path|file|directory|dir)$"
BEARER = r"(?i)(bearer\s+)[^\s,;]+"
INLINE = r"(?i)\b(token|api[_-]?key|password|secret|signature|credential)\s*[=:]\s*[^\s,;]+"
URL_SECRET = r"(?i)(token|key|signature|credential|password|secret)"
COMMAND_KEYS = ("command", "cmd", "argv", "args")
OPTION_KEYS = ("-headers", "--header", "-authorization", "--token", "--api-key")
TRACE_KEYS = ("traceback", "error_summary", "stderr_tail", "stdout_tail", "diagnostic")
WINDOWS_PATH = r"(?i)(?:[a-z]:[\\/])(?:[^\\/\r\n\"']+[\\/])*([^\\/\r\n\"']+)"
UNIX_PATH = r"(?<!:)(?:/(?:[^/\s\"']+)){2,}"


def tail(text: Column, limit: int = LIMIT) -> Column:
    """The last characters of a long text, with a mark."""
    return F.when(F.char_length(text) > limit, F.concat(F.right(text, F.lit(limit)), F.lit(CUT))).otherwise(text)


def redact_text(text: Column, limit: int = LIMIT) -> Column:
    """Flat text: bearer tokens and inline secrets hidden, the end kept."""
    return tail(F.regexp_replace(F.regexp_replace(text, BEARER, "$1\\[REDACTED\\]"), INLINE, "$1=\\[REDACTED\\]"), limit)


def redact_url(url: Column) -> Column:
    """Secret query parameters hidden, the fragment dropped; other texts as they are."""
    pairs = F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&")
    safe = F.transform(pairs, lambda p: F.when(F.split_part(p, F.lit("="), F.lit(1)).rlike(URL_SECRET), F.concat(F.split_part(p, F.lit("="), F.lit(1)), F.lit("=[REDACTED]"))).otherwise(p))
    bare = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), r"\?.*$", "")
    return F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+"), F.when(url.rlike(r"^[^#]*\?"), F.concat(bare, F.lit("?"), F.array_join(safe, "&"))).otherwise(bare)).otherwise(url)


def _encoded(text: Column) -> Column:
    """Percent encoding of a query's part: blanks as +, and ~ but not * as it is."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def encoded_url(text: Column) -> Column:
    """A text that is one absolute address, with its query encoded anew, secret parameters hidden and without its
    fragment; any other text, also one with blanks in it, as it is. Parameters that are not well encoded are
    encoded as they stand."""
    shape = r"^([A-Za-z][A-Za-z0-9+.-]*)(://[^/?#\s]+[^?#\s]*)(?:\?([^#\s]*))?(?:#\S*)?$"
    part = lambda k: F.regexp_extract(text, shape, k)
    plain = lambda x: F.coalesce(F.try_url_decode(x), x)
    name = lambda p: plain(F.regexp_extract(p, "^[^=]*", 0))
    value = lambda p: plain(F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1))
    safe = lambda p: F.concat(_encoded(name(p)), F.lit("="), _encoded(F.when(name(p).rlike(URL_SECRET), HIDDEN).otherwise(value(p))))
    query = F.array_join(F.transform(F.array_remove(F.split(part(3), "&"), ""), safe), "&")
    return F.when(text.rlike(shape), F.concat(F.lower(part(1)), part(2), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))).otherwise(text)


#: A leaf of a JSON document: path, its steps as JSON; keys, the names among them, and ends, up to which step each
#: reaches; words, the list that the leaf is a word of where that list stands under a command's key, and the words
#: before it, place; text, a string's characters, or the JSON of any other leaf.
LEAF = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("keys", T.ArrayType(T.StringType())), T.StructField("ends", T.ArrayType(T.IntegerType())),
    T.StructField("words", T.ArrayType(T.StringType())), T.StructField("place", T.IntegerType()), T.StructField("is_text", T.BooleanType()), T.StructField("text", T.StringType()),
])


def json_leaves(text: str | None) -> list[dict]:
    """The leaves of a JSON text in order; empty objects and lists are leaves. A text that is no JSON is one leaf
    with a null path; null is an empty object."""
    try:
        todo = [([], [], [], json.loads("{}" if text is None else text))]
    except ValueError:
        return [{"path": None, "keys": [], "ends": [], "words": None, "place": 0, "is_text": True, "text": text}]
    out = []
    while todo:
        path, keys, ends, value = todo.pop()
        if isinstance(value, dict) and value:
            todo += reversed([([*path, k], [*keys, k], [*ends, len(path) + 1], v) for k, v in value.items()])
        elif isinstance(value, list) and value and keys and keys[-1].lower() in COMMAND_KEYS:
            words = list(map(str, value))
            out += [{"path": json.dumps([*path, k]), "keys": keys, "ends": ends, "words": words, "place": k, "is_text": True, "text": w} for k, w in enumerate(words)]
        elif isinstance(value, list) and value:
            todo += reversed([([*path, k], keys, ends, v) for k, v in enumerate(value)])
        else:
            is_text = isinstance(value, str)
            out.append({"path": json.dumps(path), "keys": keys, "ends": ends, "words": None, "place": 0, "is_text": is_text, "text": value if is_text else json.dumps(value)})
    return out


def from_leaves(leaves: list[dict]) -> str:
    """The JSON text of leaves (path, cut, is_text, text), keys sorted; a leaf stands for all that is below the first
    cut of its steps."""
    box: list = []
    for leaf in leaves:
        if leaf["path"] is None:
            return leaf["text"]
        steps = [0, *json.loads(leaf["path"])[: int(leaf["cut"])]]
        value = leaf["text"] if leaf["is_text"] else json.loads(leaf["text"])
        at: list | dict = box
        for step, then in zip(steps, [*steps[1:], None]):
            new = value if then is None else [] if isinstance(then, int) else {}
            if isinstance(at, dict):
                at = at.setdefault(step, new)
            else:
                at += [new] * (step == len(at))
                at = at[step]
    return json.dumps(box[0], ensure_ascii=False, sort_keys=True)


def _safe_leaf(leaf: Column) -> Column:
    """A leaf without secrets, paths and long texts, by the keys above it and its kind."""
    text, key = leaf["text"], F.coalesce(F.try_element_at(leaf["keys"], F.lit(-1)), F.lit(""))
    secret = F.array_position(F.transform(leaf["keys"], lambda k: k.rlike(SECRET)), True)
    last_part = F.regexp_extract(text, "([^/]*)/*$", 1)
    option = lambda w: F.lower(w).isin(*OPTION_KEYS)
    follows = F.aggregate(F.slice(leaf["words"], 1, leaf["place"]), F.lit(False), lambda hidden, w: ~hidden & option(w))
    word = (
        F.when(follows, HIDDEN).when(option(text), text).when(F.split_part(text, F.lit("="), F.lit(1)).rlike(SECRET) | text.rlike(BEARER), HIDDEN)
        .when(text.startswith("/"), last_part).otherwise(tail(encoded_url(text)))
    )
    said = F.regexp_replace(F.regexp_replace(encoded_url(text), BEARER, "$1\\[REDACTED\\]"), INLINE, "$1=\\[REDACTED\\]")
    traced = F.regexp_replace(F.regexp_replace(said, WINDOWS_PATH, "<path>/$1"), UNIX_PATH, "<path>")
    other = F.when(text.startswith("/") | key.rlike(PATH_KEY), last_part).otherwise(tail(F.when(F.lower(key).isin(*TRACE_KEYS), traced).otherwise(said)))
    safe = F.when(secret > 0, HIDDEN).when(~leaf["is_text"], text).when(leaf["words"].isNotNull(), word).otherwise(other)
    return F.struct(leaf["path"].alias("path"), F.coalesce(F.when(secret > 0, F.try_element_at(leaf["ends"], secret.cast("int"))), F.lit(1 << 30)).alias("cut"), (leaf["is_text"] | (secret > 0)).alias("is_text"), safe.alias("text"))


def redact_json(details: Column) -> Column:
    """Nested JSON text without secrets; keys sorted. Text that is no JSON is treated as one flat text, null as {}."""

    @F.pandas_udf(T.ArrayType(LEAF))
    def lay_out(rows: pd.Series) -> pd.Series:
        return rows.map(json_leaves, na_action=None)

    @F.pandas_udf(T.StringType())
    def put_together(rows: pd.Series) -> pd.Series:
        return rows.map(lambda leaves: from_leaves(list(leaves)))

    return put_together(F.transform(lay_out(details), _safe_leaf))


def redact(events: DataFrame, nested: bool = True) -> DataFrame:
    """Events with redacted message and details."""
    out = events.withColumn("message", redact_text(F.col("message")))
    return out.withColumn("details", redact_json(F.col("details")) if nested else redact_text(F.coalesce("details", F.lit("{}"))))


def error_rows(events: DataFrame, public: dict[str, str]) -> DataFrame:
    """Failed events with a bounded error summary and the public message of their stage."""
    message = F.lit("processing failed")
    for stage, text in public.items():
        message = F.when(F.col("stage").cast("string") == stage, text).otherwise(message)
    return events.where(F.col("event").contains("failed")).withColumns({"error_summary": tail(redact_text(F.col("message")), 1000), "public_message": message})
