"""Exact de-duplication by a log-structured merge index. DataFrame operations only.

Rows are dealt to memtables. Each memtable aggregates its rows by digest and flushes one run,
sorted by digest, with Parquet Bloom filters on the digest for later look-ups. Compaction merges
the runs and keeps, for every digest, the row that stays. Rows whose digest was seen more than once
are hits; a hit counts as a copy only after its bytes equal those of the row that stays. Digests
that hold different texts are grouped again by the texts themselves.

Scale: a memtable is a salt, so a digest with a third of all rows reaches compaction as one row for
each memtable. Texts are shuffled for hits only, picked by a bit filter of bounded size, and a hot
digest's texts are dealt over as many salts as its size asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, bit_filter, cut, maybe_in

#: Shares of a digest's rows.
SALTS = 8


def squeezed(text: Column) -> Column:
    """The text without its white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def _best(n: Column, doc_id: Column) -> Column:
    """Order of preference, best first: most code points, then smallest id; a null id comes last."""
    return F.struct((-n).alias("fewer"), doc_id.isNull().alias("no_id"), doc_id.alias("id"))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    memtables: int = 64,
    digest_bytes: int = 32,
    rows_per_salt: int = 2000,
) -> DataFrame:
    """One row per input row: id, keep_id (id of the row that stays), group_size, kept, text_sha256.

    Texts are equal when identical without white space. The row with the most code points stays,
    then the smallest id. Null texts count as empty, and all empty texts are one group. Repeated
    rows (same id and text) each come back and are all kept when their id is the one that stays;
    rows with a null id stay only in groups without any id. digest_bytes shortens the index key;
    results do not depend on it, since hits are checked byte by byte. Other columns are ignored.
    """
    text = squeezed(F.col(text_col))
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("raw"))
    digest = F.sha2(squeezed(F.col("raw")), 256)
    key = F.expr(f"substring(unhex(sha), 1, {int(digest_bytes)})")
    keys = cut(
        source.select("id", F.char_length(F.coalesce("raw", F.lit(""))).cast("long").alias("n"), digest.alias("sha"))
        .withColumn("key", key),
        "exact-keys",
    )

    memtable = F.pmod(F.xxhash64("id", "n"), F.lit(memtables))
    runs = cut(
        keys.groupBy(memtable.alias("run"), "key")
        .agg(F.min(_best(F.col("n"), F.col("id"))).alias("best"), F.count(F.lit(1)).alias("size"))
        .sortWithinPartitions("run", "key"),
        "exact-runs",
        **{"parquet.bloom.filter.enabled#key": "true"},
    )
    merged = runs.groupBy("key").agg(F.min("best").alias("best"), F.sum("size").alias("size"))
    hits = cut(
        merged.where("size > 1").select("key", F.col("best.id").alias("keep_id"), "size"), "exact-hits"
    )

    joined = _meet_hits(keys, hits)
    differing = _differing(source, joined, hits, key, rows_per_salt)
    if differing.isEmpty():
        return _result(
            joined.select(
                "id", "sha", F.coalesce("size", F.lit(1)).alias("size"),
                F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
            ),
            id_col,
        )
    return _result(_by_text(source, joined, differing, key), id_col)


def _meet_hits(keys: DataFrame, hits: DataFrame) -> DataFrame:
    """keys with the hit of each, the rows of a digest dealt over SALTS shares and its hit repeated for each."""
    left = keys.select("id", "sha", "key", F.pmod(F.xxhash64("id", "n"), F.lit(SALTS)).cast("int").alias("salt"))
    right = hits.select("key", "keep_id", "size", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return left.join(right, ["key", "salt"], "left").drop("salt")


def _differing(source: DataFrame, joined: DataFrame, hits: DataFrame, key: Column, rows_per_salt: int) -> DataFrame:
    """Digests of which some hit's bytes differ from those of the row that stays."""
    member = joined.where("size is not null").select("id", "key", "keep_id", "size").distinct()
    bits = cut(bit_filter(member, F.col("id")), "exact-filter")
    texts = (
        maybe_in(source, F.col("id"), bits)
        .select("id", squeezed(F.col("raw")).alias("bytes"), F.sha2(squeezed(F.col("raw")), 256).alias("sha"))
        .withColumn("key", key)
        .drop("sha")
    )
    salts = F.ceil(F.col("size") / F.lit(rows_per_salt)).cast("long")
    held = (
        member.join(texts.withColumnRenamed("id", "tid"), (F.col("id").eqNullSafe(F.col("tid"))) & (member.key == texts.key))
        .select(member.key.alias("key"), "id", "keep_id", "size", "bytes")
        .withColumn("salt", F.pmod(F.xxhash64("id"), salts))
    )
    stays = (
        held.where(F.col("id").eqNullSafe(F.col("keep_id")))
        .groupBy("key", "size")
        .agg(F.min("bytes").alias("kept_bytes"))
        .select("key", "kept_bytes", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"))
    )
    return cut(
        held.join(stays, ["key", "salt"]).where(F.col("bytes") != F.col("kept_bytes")).select("key").distinct(),
        "exact-differing",
    )


def _by_text(source: DataFrame, joined: DataFrame, differing: DataFrame, key: Column) -> DataFrame:
    """The result where some digests stand for several texts: those are grouped by text."""
    plain = joined.join(differing, "key", "left_anti").select(
        "id", "sha", F.coalesce("size", F.lit(1)).alias("size"),
        F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
    )
    rows = (
        source.select("id", F.char_length(F.coalesce("raw", F.lit(""))).cast("long").alias("n"),
                      squeezed(F.col("raw")).alias("bytes"))
        .withColumn("sha", F.sha2("bytes", 256))
        .withColumn("key", key)
        .join(differing, "key", "left_semi")
    )
    groups = (
        rows.groupBy("bytes", F.pmod(F.xxhash64("id"), F.lit(64)).alias("run"))
        .agg(F.min(_best(F.col("n"), F.col("id"))).alias("best"), F.count(F.lit(1)).alias("size"))
        .groupBy("bytes")
        .agg(F.min("best").alias("best"), F.sum("size").alias("size"))
        .select("bytes", F.col("best.id").alias("keep_id"), "size")
    )
    return plain.unionByName(rows.join(groups, "bytes").select("id", "sha", "size", "keep_id"))


def _result(rows: DataFrame, id_col: str) -> DataFrame:
    return rows.select(
        F.col("id").alias(id_col),
        F.col("keep_id"),
        F.col("size").cast("long").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
