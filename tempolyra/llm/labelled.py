"""The bounded, deterministic sample of labelled rows that classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod


def sample_labels(labels: DataFrame, label: str, most: int, held_out: tuple[int, int] = (3, 1)) -> DataFrame:
    """At most `most` rows (label_id, label) in order of an id's hash. Rows whose crc32(doc_id) leaves the
    remainder held_out[1] by held_out[0] are never taken, nor rows without id or label."""
    rows = labels.where(
        F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (crc_mod(F.col("doc_id"), held_out[0]) != held_out[1])
    ).select(F.col("doc_id").alias("label_id"), F.col(label).cast("int").alias("label"))
    share = min(1.0, 1.5 * most / max(1, rows.count()))
    near = rows.where(F.pmod(F.xxhash64("label_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    return near.orderBy(F.xxhash64("label_id"), "label_id", "label").limit(most)


def labelled_texts(docs: DataFrame, sample: DataFrame, id_col: str, text_col: str, group_col: str | None = None) -> DataFrame:
    """Rows (label_id, text, label), with group_col also group, of the sampled documents. The broadcast is
    bounded by the sample's size."""
    group = [F.col(group_col).cast("string").alias("group")] if group_col else []
    rows = docs.select(F.col(id_col).alias("label_id"), F.col(text_col).alias("text"), *group)
    return rows.join(F.broadcast(sample), "label_id")
