"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Rows (node, root): every node of an edge (a, b), both long, with the smallest node of its component.

    Large-star and small-star rounds: each round hangs neighbours under the smallest node around them,
    and the number of edges never grows. Rounds follow the logarithm of a component's width. Each round
    is written to the shared folder, so lineage stays short. Sums are combined before the shuffles, and
    the joins may be split where a node is hot. An edge table without rows gives no rows.
    """
    at = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        both = at.select("a", "b").unionAll(at.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionAll(least.where("m < a").select("a", F.col("m").alias("b"))).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        at = cut(small.unionAll(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        now = tuple(at.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return at.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
        at.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
