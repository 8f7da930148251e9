"""Small helpers the operators share: input rows, the shared folder, bounded bit filters."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six white-space characters U+0020 and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"

#: Size of a bit filter: at most 1024 rows of 4 KiB, 4 MiB in all, whatever the input.
FILTER_BITS = 1 << 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "16m") -> None:
    """Bounds what a Python worker holds at once: Arrow batches of at most `rows` rows and about `size`.
    Smaller settings of the session stay."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def shared_root(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a new one of our own only where that is unset."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        root = spark.sparkContext.getCheckpointDir()
    return root


def cut(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: its lineage ends there,
    it is computed once, and it outlives any executor."""
    path = f"{shared_root(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bit_filter(keys: DataFrame, key: Column) -> DataFrame:
    """A filter of FILTER_BITS bits over a key: rows (bucket, bits). Its size does not depend on the
    number of keys; with very many keys it lets more through, and never loses one."""
    at = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    return (
        keys.select(F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("bit"))
        .groupBy("bucket")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
    )


def flag_maybe(rows: DataFrame, key: Column, bits: DataFrame) -> DataFrame:
    """Adds __maybe: false where the key is for certain not in the filter. The broadcast is bounded by
    FILTER_BITS / 8 bytes."""
    at = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    hit = F.expr(
        "coalesce(getbit(cast(conv(hex(substring(__bits, cast(__bit div 8 + 1 as int), 1)), 16, 10) as int),"
        " cast(__bit % 8 as int)) = 1, false)"
    )
    return (
        rows.withColumns({"__bucket": F.bitmap_bucket_number(at), "__bit": F.bitmap_bit_position(at)})
        .join(F.broadcast(bits.select(F.col("bucket").alias("__bucket"), F.col("bits").alias("__bits"))), "__bucket", "left")
        .withColumn("__maybe", hit)
        .drop("__bucket", "__bit", "__bits")
    )


def maybe_in(rows: DataFrame, key: Column, bits: DataFrame) -> DataFrame:
    """The rows whose key may be in the filter."""
    return flag_maybe(rows, key, bits).where("__maybe").drop("__maybe")


def text_hash(text: Column) -> Column:
    """With the id, tells rows apart that share an id."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (doc, id, text, row): doc holds all columns as they are, so none of them can clash with a
    column of ours; row is the text's hash."""
    text = F.col(f"`{text_col}`")
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(f"`{id_col}`").alias("id"), text.alias("text"), text_hash(text).alias("row"))


def unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again."""
    return rows.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])


def without(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs, all columns, whose id and text hash are not in gone (id, row_hash). Only rows
    that a filter of bounded size lets through are shuffled; every other row stays where it is."""
    gone = cut(gone.select(F.col("id").alias("gone_id"), F.col("row_hash").alias("gone_row")).distinct(), "gone")
    bits = cut(bit_filter(gone, F.col("gone_row")), "gone-filter")
    rows = flag_maybe(packed(docs, id_col, text_col), F.col("row"), bits)
    same = F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("row") == F.col("gone_row"))
    return unpacked(rows.where("not __maybe").unionByName(rows.where("__maybe").join(gone, same, "left_anti")), docs)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of a doc_id's decimal text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))
