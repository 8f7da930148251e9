"""Alignment benchmarks: candidate timelines held against references, mora by mora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CASE = ["case", "engine"]


def _met(ref: DataFrame, cand: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidate moras with the reference mora of their place and `same`, whether the readings agree, and the
    number of reference moras a case (case, n_ref)."""
    r = ref.select("case", "seq", F.col("reading").alias("ref_reading"), F.col("start_ms").alias("ref_start"), F.col("end_ms").alias("ref_end"))
    c = cand.select(*CASE, "seq", F.col("reading").alias("cand_reading"), F.col("start_ms").alias("cand_start"), F.col("end_ms").alias("cand_end"))
    same = F.coalesce(F.col("ref_reading") == F.col("cand_reading"), F.lit(False))
    return c.join(r, ["case", "seq"], "left").withColumn("same", same), r.groupBy("case").agg(F.count(F.lit(1)).alias("n_ref"))


def _ok(n_cand: str, n_same: str) -> Column:
    """As many moras as the reference, some, and all alike."""
    return (F.col("n_ref") > 0) & (F.col(n_cand) == F.col("n_ref")) & (F.col(n_same) == F.col("n_ref"))


def pair_moras(ref: DataFrame, cand: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (case, engine, seq, ref_start, ref_end, cand_start, cand_end) of cases whose reading sequences
    are equal, and verdicts (case, engine, n_ref, n_cand, ok). ref has case, seq, reading, start_ms, end_ms;
    cand has engine too. An empty reference, or another length or reading, fails a case."""
    met, size = _met(ref, cand)
    counts = met.groupBy(*CASE).agg(F.count(F.lit(1)).alias("n_cand"), F.count_if("same").alias("n_same"))
    verdict = counts.join(size, "case", "left").withColumn("n_ref", F.coalesce("n_ref", F.lit(0)))
    verdict = verdict.select(*CASE, "n_ref", "n_cand", _ok("n_cand", "n_same").alias("ok"))
    pairs = met.join(verdict.where("ok").select(*CASE), CASE, "left_semi")
    return pairs.select(*CASE, "seq", "ref_start", "ref_end", "cand_start", "cand_end"), verdict


def case_errors(pairs: DataFrame) -> DataFrame:
    """Mean, interpolated median and maximum of the absolute start and end errors, and the number of moras."""
    error = F.explode(F.array(F.abs(F.col("cand_start") - F.col("ref_start")), F.abs(F.col("cand_end") - F.col("ref_end")))).alias("error")
    return pairs.select(*CASE, error).groupBy(*CASE).agg(
        F.avg("error").alias("mae_ms"), F.median("error").alias("median_ms"),
        F.max("error").cast("long").alias("max_ms"), (F.count(F.lit(1)) / 2).cast("long").alias("n_moras"),
    )


def engine_summary(cases: DataFrame) -> DataFrame:
    """Per engine: cases, successes, failure_rate over all cases; means of the per-case figures over the
    successes, nulls skipped; the largest peak_rss_mb. cases has engine, ok, mae_ms, median_ms,
    elapsed_seconds and peak_rss_mb."""
    good = lambda c: F.when(F.col("ok"), F.col(c))
    return cases.groupBy("engine").agg(
        F.count(F.lit(1)).alias("cases"), F.count_if("ok").alias("successes"),
        (F.count_if(~F.col("ok")) / F.count(F.lit(1))).alias("failure_rate"),
        F.avg(good("mae_ms")).alias("mean_mae_ms"), F.avg(good("median_ms")).alias("mean_median_ms"),
        F.avg(good("elapsed_seconds")).alias("mean_elapsed_seconds"), F.max(good("peak_rss_mb")).alias("peak_rss_mb"),
    )


def compare(ref: DataFrame, cand: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The whole benchmark: case rows and the engines' summary. runs has case, engine, elapsed_seconds and
    peak_rss_mb, a row for each case and engine, also where a timeline is missing."""
    met, size = _met(ref, cand)
    # one grouping of both errors of each mora gives the figures and what the verdict needs
    error = F.explode(F.array(F.abs(F.col("cand_start") - F.col("ref_start")), F.abs(F.col("cand_end") - F.col("ref_end")))).alias("error")
    figures = met.select(*CASE, "same", error).groupBy(*CASE).agg(
        F.avg("error").alias("mae_ms"), F.median("error").alias("median_ms"), F.max("error").cast("long").alias("max_ms"),
        (F.count(F.lit(1)) / 2).cast("long").alias("n_moras"), (F.count_if("same") / 2).cast("long").alias("n_same"),
    )
    judged = figures.join(size, "case", "left").withColumn("ok", F.coalesce(_ok("n_moras", "n_same"), F.lit(False)))
    names = ("mae_ms", "median_ms", "max_ms", "n_moras")
    cases = (
        runs.join(judged.select(*CASE, "ok", *[F.when(F.col("ok"), F.col(c)).alias(c) for c in names]), CASE, "left")
        .withColumn("ok", F.coalesce("ok", F.lit(False)))
        .withColumn("error", F.when(~F.col("ok"), "the timelines' mora sequences differ"))
    )
    return cases, engine_summary(cases)
