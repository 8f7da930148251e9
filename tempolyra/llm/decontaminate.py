"""Benchmark decontamination by spaced-seed hashing. DataFrame operations only.

A seed mask reads five of seven or eight neighbouring words and ignores the others, so a hit survives
substituted words. Hashes of the benchmark's masked windows are joined with those of the documents; a
hit fixes how a document and an item lie over each other, and the whole overlap on that line is verified
word by word: +1 for an equal word, -penalty for a differing one, best stretch. With a penalty of 4, a
stretch counts while over four in five of its words agree.

Scale: the documents' windows are never shuffled while the benchmark's hashes have a checked size (they
are broadcast); beyond it, both sides are shuffled by hash. Only documents with hits meet the verifier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, bit_filter, cut, maybe_in, text_hash, without

#: Offsets of the words that each mask reads.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 3, 5, 6), (0, 2, 3, 4, 7))
#: Most rows of benchmark hashes that are broadcast (about 40 bytes each).
MOST_BROADCAST = 1_000_000


def words_of(text: Column) -> Column:
    """Lower-case words between white space; null and blank texts have none."""
    trimmed = F.trim(F.lower(F.coalesce(text, F.lit(""))), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def _windows(rows: DataFrame, *keep: str) -> DataFrame:
    """Rows (keep, at, hash): each mask's hash at each place where it fits. The mask's number is hashed too."""
    last = F.size("words") - F.lit(1 + min(max(m) for m in MASKS))
    placed = rows.where(last >= 0).select(*keep, "words", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    hashed = [
        F.when(F.col("at") + m[-1] < F.size("words"), F.xxhash64(F.lit(k), *[F.get("words", F.col("at") + o) for o in m]))
        for k, m in enumerate(MASKS)
    ]
    return placed.select(*keep, "at", F.explode(F.array(*hashed)).alias("hash")).where("hash is not null")


def _best_stretch(doc: Column, item: Column, shift: Column, penalty: int) -> Column:
    """The best stretch's score where word k of the item lies over word k + shift of the document."""
    first = F.greatest(F.lit(0), -shift)
    last = F.least(F.size(item), F.size(doc) - shift)
    pairs = F.zip_with(
        F.slice(item, first + 1, F.greatest(last - first, F.lit(0))),
        F.slice(doc, first + shift + 1, F.greatest(last - first, F.lit(0))),
        lambda a, b: F.when(a == b, 1).otherwise(-penalty),
    )
    zero = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, x: Column) -> Column:
        run = F.greatest(acc["run"] + x, F.lit(0))
        return F.struct(run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(pairs, zero, step, lambda acc: acc["best"])


def find_overlaps(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", least: int = 10, penalty: int = 4, most_broadcast: int = MOST_BROADCAST,
) -> DataFrame:
    """Rows (id, row_hash, item_id, overlap): every pair of a document and a benchmark item that overlap
    with a score of at least `least`, or of the item's number of words if that is less (five at least).

    row_hash tells rows of one id apart. Null, empty and short texts (under five words) overlap nothing.
    Repeated rows count once. Null ids are kept. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_hash(F.col(text_col)).alias("row_hash"), words_of(F.col(text_col)).alias("words"))
    items = benchmark.select(F.col(item_col).alias("item_id"), words_of(F.col(item_text_col)).alias("words")).where(F.size("words") > max(MASKS[0]))
    seeds = cut(_windows(items, "item_id").select("hash", "item_id", F.col("at").alias("item_at")).distinct(), "seeds")
    hashes = seeds.select("hash").distinct()
    small = seeds.count() <= most_broadcast
    hint = F.broadcast if small else (lambda x: x)
    # windows whose hash the benchmark has; then the lines of overlap, once each
    hit = _windows(rows, "id", "row_hash").join(hint(hashes), "hash", "left_semi")
    found = cut(hit.distinct() if not small else hit, "hits")
    lines = cut(
        found.join(hint(seeds), "hash").select("id", "row_hash", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct(),
        "lines",
    )
    bits = cut(bit_filter(lines, F.col("row_hash")), "line-filter")
    source = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("raw")).withColumn("doc_hash", text_hash(F.col("raw")))
    texts = maybe_in(source, F.col("doc_hash"), bits).dropDuplicates(["doc", "doc_hash"]).select("doc", "doc_hash", words_of(F.col("raw")).alias("words"))
    shifts = lines.groupBy("id", "row_hash", "item_id").agg(F.collect_set("shift").alias("shifts"))
    over = (
        shifts.join(texts, F.col("id").eqNullSafe(F.col("doc")) & (F.col("row_hash") == F.col("doc_hash")))
        .join(hint(items.select("item_id", F.col("words").alias("item"))), "item_id")
        .select("id", "row_hash", "item_id", F.size("item").alias("n"),
                F.array_max(F.transform("shifts", lambda s: _best_stretch(F.col("words"), F.col("item"), s, penalty))).alias("overlap"))
    )
    return over.groupBy("id", "row_hash", "item_id", "n").agg(F.max("overlap").cast("long").alias("overlap")).where(
        F.col("overlap") >= F.least(F.lit(least), F.col("n"))
    ).drop("n").withColumnRenamed("id", id_col)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params: int) -> DataFrame:
    """The rows, all columns, that overlap no benchmark item. Rows that share id and text go or stay together."""
    bad = find_overlaps(docs, benchmark, id_col, text_col, **params)
    return without(docs, bad.withColumnRenamed(id_col, "id"), id_col, text_col)
