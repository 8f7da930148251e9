"""Hard negatives of anchors, with bounds along a spanning tree of the anchors.

The rows that are anchors stand in blocks of one label; each block has a minimum spanning tree by distance,
built in the task that holds it. Scores are inner products, so for a candidate c and an anchor a with parent p,
|<a, c> - <p, c>| <= |a - p| |c|: what is known at the parent, an exact score or a range, bounds the score at the
child. The root's scores are computed; below it a candidate is scored again only if its range meets the child's
window, and goes on with its wider range otherwise.

First the positives are found: the window of an anchor is everything from its k-th best score so far among rows
of its label. They give each anchor the windows of its negatives; those are found in a second pass over the rows
of other labels, the lower edge of a window rising with its k-th best so far. Blocks go to all tasks in rounds of
a fixed size in bytes, so what is broadcast does not grow with the data; each round is one pass over the rows.
A task gives back at most k rows for an anchor and window, and these are ranked by anchor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, small_batches

#: Anchors of a block: its tree is made from all distances within it.
BLOCK = 512
#: Bytes of the blocks that are broadcast in a round.
ROUND_BYTES = 32 << 20
#: Rows whose scores are held at once.
ROWS = 8192

_LAST = (1 << 63) - 1


def vectors(column: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Whether each row has a vector of finite components, and floor(scale * x) of those, shorter ones filled
    with zeros. Components beyond 2^52 are held to it."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(np.asarray(column.offsets)).astype(np.int64)
    # null lists may cover values
    flat = column.values.slice(column.offsets[0].as_py(), int(size.sum()))
    x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    good = np.asarray(column.is_valid()).copy()
    row = np.repeat(np.arange(len(size)), size)
    good[row[~np.isfinite(x)]] = False  # a null component is not a number either
    place = np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size)
    out = np.zeros((len(size), int(size.max()) if len(size) else 0))
    keep = good[row]
    out[row[keep], place[keep]] = np.clip(np.floor(scale * x[keep]), -(1 << 52), 1 << 52)
    return good, out[good]


def widen(m: np.ndarray, d: int) -> np.ndarray:
    return m if m.shape[1] >= d else np.hstack([m, np.zeros((len(m), d - m.shape[1]))])


def scores(m: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of m with a; beyond the range of a long they are held to its ends."""
    if not m.size or float(np.abs(m).max()) * float(np.abs(a).sum()) < 1 << 53:
        return (m @ a).astype(np.int64)
    exact = m.astype(np.int64).astype(object) @ a.astype(np.int64).astype(object)
    return np.array([min(max(int(s), -_LAST - 1), _LAST) for s in exact], np.int64)


def spanning_tree(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A minimum spanning tree over the rows of m: (order with parents first, parent of each row, length of the
    edge to it). The root's parent is -1."""
    n = len(m)
    order, parent, edge = np.zeros(n, np.int64), np.full(n, -1), np.zeros(n)
    near, by, left = np.full(n, np.inf), np.full(n, -1), np.ones(n, bool)
    at = 0
    for k in range(n):
        order[k], left[at] = at, False
        parent[at], edge[at] = by[at], near[at] if k else 0
        gap = np.sqrt(((m - m[at]) ** 2).sum(1))
        closer = left & (gap < near)
        near[closer], by[closer] = gap[closer], at
        if k + 1 < n:
            at = int(np.where(left, near, np.inf).argmin())
    return order, parent, edge


class Best:
    """The best k (score, id) within a window [low, high], higher scores first, ties by smaller id."""

    def __init__(self, k: int, low: int, high: int):
        self.k, self.low, self.high = k, low, high
        self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def offer(self, score: np.ndarray, key: np.ndarray) -> None:
        fits = (score >= self.low) & (score <= self.high)
        if not fits.any():
            return
        s, i = np.append(self.score, score[fits]), np.append(self.id, key[fits])
        order = np.lexsort((i, ~s))  # ~s falls as s rises, and never overflows
        s, i = s[order], i[order]
        new = np.append(True, (s[1:] != s[:-1]) | (i[1:] != i[:-1]))  # equal rows count once
        self.score, self.id = s[new][: self.k], i[new][: self.k]
        if len(self.score) == self.k:
            self.low = max(self.low, int(self.score[-1]))


class Block:
    """Anchors of one label in the order of their tree, and the best rows found for their windows."""

    def __init__(self, row: dict, k: int):
        self.label, self.ids, n = row["label"], row["ids"], len(row["ids"])
        self.m = np.frombuffer(row["vectors"], np.int64).reshape(n, -1).astype(np.float64)
        self.parent, self.edge = row["parent"], row["edge"]
        self.best = [[Best(k, low, high) for low, high in zip(lows, highs)] for lows, highs in zip(row["lows"], row["highs"])]
        self.scored = self.met = 0

    def see(self, key: np.ndarray, m: np.ndarray, norm: np.ndarray) -> None:
        """Candidates: ids, vectors and upper bounds of their norms."""
        d = max(self.m.shape[1], m.shape[1])
        m, mine = widen(m, d), widen(self.m, d)
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        uses = np.bincount(np.array(self.parent, np.int64) + 1, minlength=len(self.ids) + 1)[1:].tolist()
        for a, p in enumerate(self.parent):
            low, high = min((b.low for b in self.best[a]), default=1), max((b.high for b in self.best[a]), default=0)
            if p < 0:
                exact = scores(m, mine[a])
                least, most, open_ = exact.astype(np.float64), exact.astype(np.float64), None
            else:
                # a hair more than the distance, for what floating point leaves out
                reach = norm * (self.edge[a] * (1 + 1e-9)) + 1
                least, most = known[p][0] - reach, known[p][1] + reach
                slack = 1e-12 * np.maximum(np.abs(least), np.abs(most))
                least, most = least - slack, most + slack
                open_ = np.nonzero((most >= low) & (least <= high))[0] if low <= high else np.zeros(0, np.int64)
                exact = scores(m[open_], mine[a])
                least[open_] = most[open_] = exact
                uses[p] -= 1
                if not uses[p]:
                    del known[p]
            self.met += len(m)
            self.scored += len(exact)
            if uses[a]:
                known[a] = least, most
            other = key if open_ is None else key[open_]
            fits = (other != self.ids[a]) & (exact >= low) & (exact <= high)
            if fits.any():
                for b in self.best[a]:
                    b.offer(exact[fits], other[fits])


def _blocks(anchors: DataFrame, scale: float) -> DataFrame:
    """Blocks of anchors (id, vec, label, lows, highs): up to BLOCK of a label, in order of their tree, parents
    first. part and running, the bytes of a task's blocks so far, serve to deal them to rounds."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        part, running = TaskContext.get().partitionId(), 0

        def settle() -> pa.RecordBatch:
            nonlocal running
            m = np.zeros((len(held), max(len(x[1]) for x in held)))
            for k, x in enumerate(held):
                m[k, : len(x[1])] = x[1]
            order, parent, edge = spanning_tree(m)
            place = np.argsort(order)
            up = np.where(parent[order] < 0, -1, place[parent[order]])
            rows = [held[k] for k in order.tolist()]
            block = {
                "label": held[0][2], "ids": [x[0] for x in rows], "vectors": m[order].astype(np.int64).tobytes(), "parent": up.tolist(), "edge": edge[order].tolist(),
                "lows": [x[3] for x in rows], "highs": [x[4] for x in rows], "part": part,
            }
            running += len(block["vectors"]) + sum(40 + 16 * len(x) for x in block["lows"])
            held.clear()
            return pa.RecordBatch.from_pylist([block | {"running": running}], schema)

        for batch in batches:
            good, m = vectors(batch.column(batch.schema.get_field_index("vec")), scale)
            ids, labels, lows, highs = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("id", "label", "lows", "highs"))
            for k, v in zip(np.nonzero(good)[0].tolist(), m):
                if held and (held[0][2] != labels[k] or len(held) >= BLOCK):
                    yield settle()
                held.append((ids[k], v, labels[k], lows[k], highs[k]))
        if held:
            yield settle()

    long = pa.list_(pa.list_(pa.int64()))
    schema = pa.schema([
        ("label", pa.string()), ("ids", pa.list_(pa.int64())), ("vectors", pa.binary()), ("parent", pa.list_(pa.int32())), ("edge", pa.list_(pa.float64())),
        ("lows", long), ("highs", long), ("part", pa.int32()), ("running", pa.int64()),
    ])
    kinds = "label string, ids array<bigint>, vectors binary, parent array<int>, edge array<double>, lows array<array<bigint>>, highs array<array<bigint>>, part int, running bigint"
    order = ["label", F.try_element_at("vec", F.lit(1)), "id"]
    return anchors.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(build, kinds)


def _seeker(sent: Broadcast, scale: float, k: int, same: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [Block(row, k) for row in sent.value]

        def look(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
            d = max(m.shape[1] for _, _, m in held)
            key, label, m = np.concatenate([x for x, _, _ in held]), np.concatenate([x for _, x, _ in held]), np.concatenate([widen(x, d) for _, _, x in held])
            norm = np.sqrt((m**2).sum(1)) * (1 + 1e-9)
            at, chosen = None, np.zeros(0, np.int64)
            for block in blocks:
                if at != block.label:
                    at, chosen = block.label, np.nonzero((label == block.label) == same)[0]
                    mine = key[chosen], m[chosen], norm[chosen]
                if len(chosen):
                    block.see(*mine)

        held, size = [], 0
        for batch in batches:
            good, m = vectors(batch.column(1), scale)
            if len(m):
                key = batch.column(0).to_numpy(zero_copy_only=False)[good].astype(np.int64)
                label = np.array(batch.column(2).to_pylist(), object)[good]
                held.append((key, label, m))
                size += len(m)
            if size >= ROWS:
                look(held)
                held, size = [], 0
        if held:
            look(held)
        for block in blocks:
            rows = [(a, i, s) for a, best in zip(block.ids, block.best) for i, s in {(i, s) for b in best for i, s in zip(b.id.tolist(), b.score.tolist())}]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], ["anchor_id", "id", "score"])

    return seek


def _search(rows: DataFrame, anchors: DataFrame, scale: float, k: int, same: bool) -> DataFrame:
    """Rows (anchor_id, id, score), none twice: for each window of each anchor the best k rows of its label, or of
    the other labels, of every task."""
    spark = rows.sparkSession
    blocks = cut(_blocks(anchors, scale), "negative-blocks")
    # a row for each task that made blocks; a round holds ROUND_BYTES and at most one block more
    sizes = sorted(tuple(r) for r in blocks.groupBy("part").agg(F.max("running").alias("size")).collect())
    total, before = 0, []
    for part, size in sizes:
        before.append((part, total))
        total += size
    starts = spark.createDataFrame(before, "part int, before bigint")
    dealt = blocks.join(F.broadcast(starts), "part").withColumn("round", F.expr(f"(before + running - 1) div {ROUND_BYTES}"))
    out = spark.createDataFrame([], "anchor_id bigint, id bigint, score bigint")
    for number in range(-(-total // ROUND_BYTES)):
        mine = dealt.where(F.col("round") == number).drop("part", "running", "before", "round").collect()
        sent = spark.sparkContext.broadcast(sorted((r.asDict() for r in mine), key=lambda r: (r["label"], r["ids"])))
        out = out.unionByName(rows.mapInArrow(_seeker(sent, scale, k, same), out.schema))
    return out.distinct()


def _ranked(rows: DataFrame, k: int, *by: str) -> DataFrame:
    """The first k rows by score, ties by smaller id, with their rank."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine_negatives(
    rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    scale: float = 256.0, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90),
) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor its first
    `positives` other rows of its label, and for each of them the first `negatives` rows of other labels whose score
    lies between window[0] and window[1] percent of the positive's, 0 <= window[0] <= window[1] <= 100. Scores are
    inner products of floor(scale * x); higher ones come first, ties by smaller id. A positive below zero has an
    empty window.

    Rows with a null id, label or vector, or with a null or non-finite component take no part. Vectors of other
    lengths count as filled with zeros, an empty one scores 0. Components beyond 2^52 are held to it, scores beyond
    a long to its ends. Equal rows count once; rows that share an id but not the score are rows of their own, and an
    anchor with several is the one of the smallest label and vector. Other columns are ignored. Ids are whole numbers.
    """
    low, high = window
    small_batches(rows.sparkSession)
    part = rows.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("vec"), F.col(f"`{label_col}`").cast("string").alias("label"), is_anchor.alias("chosen")
    ).where("id IS NOT NULL AND vec IS NOT NULL AND label IS NOT NULL")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    anchors = part.where(F.col("chosen") & finite).groupBy("id").agg(F.min(F.struct("label", "vec")).alias("row")).select("id", "row.label", "row.vec")
    anchors = cut(anchors, "anchors")
    every = F.array(F.lit(-_LAST - 1)), F.array(F.lit(_LAST))
    found = _search(part.drop("chosen"), anchors.withColumns({"lows": every[0], "highs": every[1]}), scale, positives, True)
    # percentages without a product that could overflow
    share = lambda p, up: F.expr(f"{p} * (score div 100) + ({p} * (score % 100) + {up}) div 100")
    best = _ranked(found, positives, "anchor_id").where("score >= 0").select(
        "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), share(low, 99).alias("low"), share(high, 0).alias("high")
    )
    best = cut(best, "positives")
    windows = best.groupBy("anchor_id").agg(F.collect_list("low").alias("lows"), F.collect_list("high").alias("highs"))
    open_anchors = anchors.join(windows, F.col("id") == F.col("anchor_id")).drop("anchor_id")
    found = _search(part.drop("chosen"), open_anchors, scale, negatives, False)
    fits = best.join(found, "anchor_id").where("score BETWEEN low AND high")
    ranked = _ranked(fits, negatives, "anchor_id", "positive_id", "positive_score")
    return ranked.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
