"""Line de-duplication by a tree of line templates. DataFrame operations only.

The tree has a fixed depth: a line goes to a leaf by its number of tokens and its leading tokens, in
which tokens with digits count as variable. In a leaf, a token that recurs at its place stays in the
template and any other becomes variable. A line whose template keeps at least `alike` of its tokens
without digits, and half of all its tokens, and recurs across documents is dropped from every document.

A template recurs across documents when it stands in enough classes of documents. The leaves of a document that
stand in least_docs documents or more are shared, the others are its own. A document with leaves of its own that
has at most FEW shared ones, or whose own ones are a third or more, is a class for each text: pages that have a
header and a footer in common count page by page. Any other document is mostly made of shared lines, like copies
and near copies of one document, and tells nothing new on its own: it counts by its surroundings, the smallest and
the largest digest of its other shared leaves, and documents that agree in either are one class, and so on from
document to document. So the body of a document stays however often it is copied (near-duplicate removal is there
for it) and boilerplate goes, also from those copies. Documents that hold nothing but the same lines are copies.

Scale: the tree's keys are a few dozen bytes a line and are written once. Counts are combined before
they are shuffled, by (key, surroundings) first, so a line that stands in a third of all documents is no
hot group; where lines meet such a key, the key is repeated for SALTS shares of the lines. Texts move only
for documents with lines in recurring leaves, picked by bounded bit filters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, bit_filter, cut, flag_maybe, maybe_in, packed, text_hash

#: Column of the number of lines that went.
DROPPED = "__dropped"
VARIABLE = "<*>"
SEP = "\x1f"
SALTS = 16
#: Shared leaves up to which a document with a leaf of its own is never taken for a copy.
FEW = 3


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _plain_blanks(text: Column) -> Column:
    """All white space within lines as blanks, so that a line splits at one character."""
    for c in BLANKS:
        if c not in " \n":
            text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def _tokens(line: Column) -> Column:
    """The tokens of a line of plain blanks."""
    return F.array_remove(F.split(line, " "), "")


def _masked(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.when(t.rlike("[0-9]"), VARIABLE).otherwise(t))


def _leaf(line: Column, least_tokens: int, depth: int) -> Column:
    """The leaf's digest; null for lines of too few tokens."""
    def of(tokens: Column) -> Column:
        key = F.concat_ws(SEP, F.size(tokens).cast("string"), _masked(F.slice(tokens, 1, depth)))
        return F.when(F.size(tokens) >= least_tokens, F.unhex(F.md5(key)))

    # one split a line: the tokens are bound as a lambda's argument
    return F.element_at(F.transform(F.array(_tokens(line)), of), 1)


def _meet(rows: DataFrame, table: DataFrame, keys: list[str], how: str, deal: tuple[str, ...] = ("id", "row_hash", "pos")) -> DataFrame:
    """rows joined with a table of distinct keys, a hot key's rows dealt over SALTS shares by the columns deal."""
    salt = F.pmod(F.xxhash64(*deal), F.lit(SALTS)).cast("int")
    spread = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", salt).join(spread, [*keys, "salt"], how).drop("salt")


def _recurring(rows: DataFrame, key: str, least_docs: int) -> DataFrame:
    """The keys of rows (own, lo, hi) that stand in at least least_docs classes: each lo of own rows, and the other
    rows with those that share lo or hi taken as one, from row to row."""
    at = cut(rows.select(key, "own", "lo", "hi").distinct(), "line-places")
    own = at.where("own").groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    # what own rows do not settle, and can still reach least_docs
    near = at.where("not own").groupBy(key).agg(F.count(F.lit(1)).alias("most")).join(own, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    open_ = near.where((F.col("n") < least_docs) & (F.col("n") + F.col("most") >= least_docs)).select(key, "n")
    open_ = cut(open_, "open-keys")
    linked = at.where("not own").join(open_.select(key), key, "left_semi").select(key, "lo", "hi", F.col("lo").alias("m"))
    while True:
        by_hi = linked.groupBy(key, "hi").agg(F.min("m").alias("m"))
        met = linked.select(key, "lo", "hi", F.col("m").alias("old")).join(by_hi, [key, "hi"])
        by_lo = met.groupBy(key, "lo").agg(F.min("m").alias("m"))
        met = cut(met.drop("m").join(by_lo, [key, "lo"]), "line-classes")
        linked = met.select(key, "lo", "hi", "m")
        if met.where("m < old").isEmpty():
            break
    more = linked.select(key, "m").distinct().groupBy(key).agg(F.count(F.lit(1)).alias("more")).join(open_, key).where(F.col("n") + F.col("more") >= least_docs)
    return own.where(F.col("n") >= least_docs).select(key).unionByName(more.select(key))


def recurring_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_docs: int = 5,
    least_tokens: int = 3, depth: int = 3, alike: float = 0.7,
) -> DataFrame:
    """Rows (id, row_hash, pos, template) of the lines to drop; pos counts lines from 0 and row_hash tells
    rows of one id apart. Lines of under least_tokens tokens are never dropped. Null and empty texts have
    no such lines."""
    lines = docs.select(F.col(id_col).alias("id"), text_hash(F.col(text_col)).alias("row_hash"), F.transform(_lines(_plain_blanks(F.col(text_col))), lambda x: _leaf(x, least_tokens, depth)).alias("leaves"))
    lines = lines.withColumn("n_all", F.size(F.array_distinct(F.array_compact("leaves"))))
    # the outer form, for which no filter is inferred that would compute the leaves a second time
    lines = lines.select("id", "row_hash", "n_all", "leaves", F.posexplode_outer("leaves").alias("pos", "leaf")).where("leaf is not null")
    keys = cut(lines.select("id", "row_hash", "n_all", "pos", "leaf", (F.array_position("leaves", F.col("leaf")) == F.col("pos") + 1).alias("first")), "line-keys")
    # a leaf of fewer documents than least_docs cannot recur
    often = keys.where("first").groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_docs).select("leaf")
    often = cut(often, "often-leaves")
    some = _meet(maybe_in(keys, F.col("leaf"), cut(bit_filter(often, F.col("leaf")), "often-filter")), often, ["leaf"], "left_semi")
    some = some.groupBy("id", "row_hash", "n_all").agg(F.collect_set(F.struct("pos", "leaf")).alias("at"))
    some = some.withColumn("shared", F.sort_array(F.array_distinct(F.transform("at", lambda x: x["leaf"]))))
    n = F.size("shared")
    some = some.withColumn("own", (n < F.col("n_all")) & ((n <= FEW) | ((F.col("n_all") - n) * 3 >= F.col("n_all"))))
    some = some.select("id", "row_hash", "own", "shared", F.explode("at").alias("at")).select("id", "row_hash", "own", "shared", "at.pos", "at.leaf")
    least, most = F.get("shared", F.lit(0)), F.get("shared", F.size("shared") - 1)
    lo = F.coalesce(F.when(F.col("leaf") == least, F.get("shared", F.lit(1))).otherwise(least), F.lit(b""))
    hi = F.coalesce(F.when(F.col("leaf") == most, F.get("shared", F.size("shared") - 2)).otherwise(most), F.lit(b""))
    text = F.unhex(F.lpad(F.hex("row_hash"), 16, "0"))
    some = cut(some.select("id", "row_hash", "pos", "leaf", "own", F.when(F.col("own"), text).otherwise(lo).alias("lo"), F.when(F.col("own"), text).otherwise(hi).alias("hi")), "often-lines")
    leaves = cut(_recurring(some, "leaf", least_docs), "leaves")
    near = cut(_meet(maybe_in(some, F.col("leaf"), cut(bit_filter(leaves, F.col("leaf")), "leaf-filter")), leaves, ["leaf"], "left_semi"), "near-lines")
    bits = cut(bit_filter(near, F.col("row_hash")), "line-filter")
    # ids as structs, which are equal where both are null: one shuffle serves the repeats and the join
    source = maybe_in(docs.select(F.struct(F.col(id_col).alias("id")).alias("doc"), text_hash(F.col(text_col)).alias("doc_hash"), F.col(text_col).alias("raw")), F.col("doc_hash"), bits)
    wanted = near.groupBy(F.struct("id").alias("of"), "row_hash").agg(F.collect_set(F.struct("pos", "leaf", "own", "lo", "hi")).alias("at"))
    tokens = cut(
        wanted.join(source.dropDuplicates(["doc", "doc_hash"]), (F.col("of") == F.col("doc")) & (F.col("row_hash") == F.col("doc_hash")))
        .select("of.id", "row_hash", _lines(_plain_blanks(F.col("raw"))).alias("lines"), F.explode("at").alias("at"))
        .select("id", "row_hash", "at.*", _masked(_tokens(F.get("lines", F.col("at.pos")))).alias("tokens"))
        .withColumn("line", F.monotonically_increasing_id()),
        "near-tokens",
    )
    placed = tokens.select("line", "leaf", "lo", F.posexplode("tokens").alias("k", "token")).where(F.col("token") != VARIABLE)
    constant = (
        placed.groupBy("leaf", "k", "token", "lo").agg(F.lit(1).alias("one"))
        .groupBy("leaf", "k", "token").agg(F.count(F.lit(1)).alias("d")).where(F.col("d") >= least_docs).select("leaf", "k", "token")
    )
    # only places go on, and meet the tokens again by line
    stays = _meet(placed.drop("lo"), constant, ["leaf", "k", "token"], "left_semi", ("line",)).groupBy("line").agg(F.sort_array(F.collect_list("k")).alias("kept"))
    kept, n = F.size("kept"), F.size("tokens")
    plain = F.size(F.filter("tokens", lambda t: t != VARIABLE))
    # each place that stays after the variable ones before it; past the last, none
    steps = F.arrays_zip(F.concat(F.array(F.lit(-1)), F.col("kept")), F.concat(F.col("kept"), F.array(n)))
    filled = F.flatten(F.transform(steps, lambda x: F.concat(F.array_repeat(F.lit(VARIABLE), x["1"] - x["0"] - 1), F.array(F.get("tokens", x["1"])))))
    template = cut(
        tokens.join(stays, "line")
        .where((kept >= plain * F.lit(alike)) & (kept * 2 >= n))
        .select("id", "row_hash", "pos", "own", "lo", "hi", F.array_join(filled, " ").alias("template")),
        "templates",
    )
    return _meet(template, _recurring(template, "template", least_docs), ["template"], "left_semi").select("id", "row_hash", "pos", "template")


def drop_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str = DROPPED, **params) -> DataFrame:
    """The rows of docs, all columns, without their recurring lines, and count_col, how many went.

    Every row stays; a text that held nothing else becomes empty. Texts without such lines, null ones
    included, come back as they are. Rows that share id and text lose the same lines. An input column
    named count_col gives way to the count; no other name matters.
    """
    gone = cut(recurring_lines(docs, id_col, text_col, **params).groupBy("id", "row_hash").agg(F.collect_set("pos").alias("gone")), "dropped-lines")
    bits = cut(bit_filter(gone, F.col("row_hash")), "dropped-filter")
    rows = flag_maybe(packed(docs, id_col, text_col), F.col("row"), bits)
    left = F.filter(_lines(F.col("text")), lambda x, i: ~F.array_contains("gone", i))
    columns = lambda text, n: [(text if c == text_col else F.col("doc").getField(c)).alias(c) for c in docs.columns if c != count_col] + [n.cast("long").alias(count_col)]
    same = rows.where("not __maybe").select(*columns(F.col("text"), F.lit(0)))
    changed = (
        rows.where("__maybe")
        .join(gone.withColumnRenamed("id", "gone_id"), F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("row") == F.col("row_hash")), "left")
        .select(*columns(F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")), F.coalesce(F.size("gone"), F.lit(0))))
    )
    return same.unionByName(changed)
