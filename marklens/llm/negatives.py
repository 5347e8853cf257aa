"""Hard negatives: for each anchor and positive the best other-label rows inside a window of scores.

Slot-decomposed selection.  A positive with score p allows scores from ``low`` to ``high`` percent of p.  The upper
limits of an anchor's positives cut its scores into disjoint slots; a task keeps the best ``negatives`` rows of every
slot, and so does each merge of tasks, so what is kept does not grow with the rows.  Merged from the highest slot that
a positive's window contains downwards, the slots give the best rows below its upper limit; those at or above its
lower limit are its answer.  One pass over the rows so answers all windows, however they overlap.

The anchors are a stated query set: they go over the rows in blocks of ``BLOCK``, one block of integer vectors in
memory at a time, one reading of the rows per block for the positives and one for the slots.  Scores are exact
integers: a product runs in doubles while no score can reach 2^53, in 64-bit integers beyond; scores that do not fit a
long are refused.

Odd inputs: rows without id, label or vector take no part, nor do vectors with a null or non-finite entry (the caller's
``vectors.finite``).  Shorter vectors count as padded with zeros.  A row that repeats is a row of its own, as candidate
and as anchor, but rows with the anchor's own id are never its positives.  A positive with a negative score has an
empty window.  Empty tables, anchors without positives and windows without rows give no result rows.  Other columns are
ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marklens.llm.tables import materialise
from marklens.llm.vectors import matrix, same_length
from marklens.session import scratch_dir

#: Anchors and bytes of one block, scores in memory at once, candidates gathered before they are cut back, anchors of one merge.
BLOCK = 1 << 14
BLOCK_BYTES = 16 << 20
SCORES = 1 << 21
GATHER = 1 << 18
CHUNK = 64

_KEPT = "anchor int, slot int, score long, id long"
_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _products(rows: np.ndarray, anchors: np.ndarray, exact: bool) -> np.ndarray:
    """Exact inner products, rows by anchors."""
    if exact:
        return (rows.astype(np.float64) @ anchors.astype(np.float64).T).astype(np.int64)
    return rows @ anchors.T


def best(group: np.ndarray, score: np.ndarray, ident: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` first entries of each group: higher scores first, then smaller ids."""
    order = np.lexsort((ident, -score, group))
    g = group[order]
    first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
    place = np.arange(len(g)) - np.repeat(first, np.diff(np.r_[first, len(g)]))
    return order[place < most]


class _Kept:
    """The best entries of each (anchor, slot) that a task has seen; cut back whenever enough new ones came."""

    def __init__(self, groups: int, most: int, gather: int):
        self.most, self.gather, self.parts, self.new = most, gather, [], 0
        self.floor = np.full(groups, np.iinfo(np.int64).min)  # a later entry below it cannot be kept

    def add(self, group: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        ok = score >= self.floor[group]
        self.parts.append((group[ok], score[ok], ident[ok]))
        self.new += int(ok.sum())
        if self.new > max(self.gather, len(self.parts[0][0])):
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        group, score, ident = (np.concatenate(x) for x in zip(*self.parts)) if self.parts else (np.zeros(0, np.int64),) * 3
        keep = best(group, score, ident, self.most)
        group, score, ident = group[keep], score[keep], ident[keep]
        full = np.flatnonzero(np.bincount(group, minlength=len(self.floor)) == self.most)
        last = np.searchsorted(group, full, "right") - 1
        self.floor[full] = score[last]
        self.parts, self.new = [(group, score, ident)], 0
        return group, score, ident

    def rows(self, slots: int) -> pa.RecordBatch:
        group, score, ident = self.cut()
        return pa.RecordBatch.from_arrays([pa.array((group // slots).astype(np.int32)), pa.array((group % slots).astype(np.int32)), pa.array(score), pa.array(ident)], ["anchor", "slot", "score", "id"])


def _pieces(batch: pa.RecordBatch, dim: int, wide: int, scores: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    ident, label, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2), dim)
    step = max(1, scores // max(1, wide))
    for i in range(0, len(ident), step):
        yield ident[i : i + step], label[i : i + step], x[i : i + step]


def _same_label(block, dim: int, exact: bool, most: int):
    """Task side of the positives: the first ``most`` rows of the anchor's label, without those of its id."""
    scores, gather = SCORES, GATHER

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, anchors = block.value
        kept = _Kept(len(ids), most, gather)
        for batch in batches:
            for ident, label, x in _pieces(batch, dim, len(ids), scores):
                s = _products(x, anchors, exact)
                row, anchor = np.nonzero((label[:, None] == labels) & (ident[:, None] != ids) & (s >= kept.floor))
                kept.add(anchor, s[row, anchor], ident[row])
        yield kept.rows(1)

    return run


def limits(score: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest integer s with ``low * p <= 100 * s <= high * p``."""
    return -((-low * score) // 100), (high * score) // 100


def _other_label(block, cuts, dim: int, exact: bool, most: int):
    """Task side of the slots: the best ``most`` other-label rows between one upper limit and the next lower one."""
    scores, gather = SCORES, GATHER

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, anchors = block.value
        upper, lowest = cuts.value  # anchors by slots, falling; unused slots hold the least long
        slots = upper.shape[1]
        kept = _Kept(len(ids) * slots, most, gather)
        for batch in batches:
            for ident, label, x in _pieces(batch, dim, len(ids), scores):
                s = _products(x, anchors, exact)
                row, anchor = np.nonzero((label[:, None] != labels) & (s <= upper[:, 0]) & (s >= lowest))
                score = s[row, anchor]
                slot = (score[:, None] <= upper[anchor]).sum(1) - 1
                kept.add(anchor * slots + slot, score, ident[row])
        yield kept.rows(slots)

    return run


def _answer(block, cuts, chosen, low: int, high: int, most: int):
    """Descending suffix merges: slots from the lowest up; each positive reads what lies below its own upper limit."""

    def run(key, found):
        ids, upper = block.value[0], cuts.value[0]
        anchor, slot, score, ident = (found.column(c).to_numpy() for c in ("anchor", "slot", "score", "id"))
        order = np.lexsort((slot, anchor))
        anchor, slot, score, ident = anchor[order], slot[order], score[order], ident[order]
        out: list[tuple] = []
        for a in np.unique(anchor):
            i, j = np.searchsorted(anchor, [a, a + 1])
            top = (np.zeros(0, np.int64), np.zeros(0, np.int64))
            positive, points = chosen.value[a]
            least, largest = limits(points, low, high)
            for k in range(upper.shape[1] - 1, -1, -1):
                here = np.flatnonzero(slot[i:j] == k) + i
                top = np.r_[score[here], top[0]], np.r_[ident[here], top[1]]
                keep = best(np.zeros(len(top[0]), np.int64), *top, most)
                top = top[0][keep], top[1][keep]
                for p in np.flatnonzero((largest == upper[a, k]) & (least <= largest)):
                    n = int((top[0] >= least[p]).sum())
                    out += [(int(ids[a]), int(positive[p]), r + 1, int(top[1][r]), int(points[p]), int(top[0][r])) for r in range(n)]
        columns = list(zip(*out)) if out else [()] * 6
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    return run


def _top(kept: DataFrame, most: int) -> DataFrame:
    """The best ``most`` rows of each (anchor, slot) over all tasks; each task sends at most that many of its own."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    return kept.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def mine(rows: DataFrame, is_anchor: Column, id_col: str = "id", label_col: str = "label", vector_col: str = "x",
         positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every anchor and positive.

    ``vector_col`` holds integer vectors; ``is_anchor`` may read the columns of ``rows``.  Higher scores come first,
    ties by smaller id.
    """
    if not (positives > 0 and negatives > 0 and 0 <= low <= high):
        raise ValueError("positives and negatives must be positive, and 0 <= low <= high")
    spark = rows.sparkSession
    own = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("x"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    own, dim = same_length(own.where("id is not null and label is not null and x is not null"), "x")
    own = materialise(own.withColumn("_place", F.monotonically_increasing_id()), "vectors")
    count, largest = own.agg(F.count_if("anchor"), F.coalesce(F.max(F.array_max(F.transform("x", lambda v: F.abs(v.cast("double"))))), F.lit(0.0))).first()
    if not count:
        return spark.createDataFrame([], _RESULT)
    reach = largest * largest * dim * max(high, 100)  # bounds the scores and the products with percents
    if reach >= 2.0**63:
        raise ValueError("scores of these vectors do not fit a long")
    exact = largest * largest * dim < 2.0**53
    blocks = -(-count // min(BLOCK, max(CHUNK, BLOCK_BYTES // (8 * dim))))
    folder = f"{scratch_dir(spark)}/marklens-negatives-{uuid.uuid4().hex}"
    numbered = materialise(own.where("anchor").select("id", "label", "x", F.pmod(F.xxhash64("_place"), F.lit(blocks)).alias("_block")), "anchors")
    stored = own.select("id", "label", "x")
    for k in range(blocks):
        got = numbered.where(F.col("_block") == k).select("id", "label", "x").toArrow()
        if not got.num_rows:
            continue
        block = spark.sparkContext.broadcast((got.column("id").to_numpy(), got.column("label").to_numpy(), matrix(got.column("x"), dim)))
        near = _top(stored.mapInArrow(_same_label(block, dim, exact, positives), _KEPT), positives).toArrow()
        size = got.num_rows
        chosen, upper, lowest = _windows(size, near, positives, low, high)
        cuts, picked = spark.sparkContext.broadcast((upper, lowest)), spark.sparkContext.broadcast(chosen)
        kept = _top(stored.mapInArrow(_other_label(block, cuts, dim, exact, negatives), _KEPT), negatives)
        kept = kept.withColumn("chunk", F.floor(F.col("anchor") / CHUNK))
        kept.groupBy("chunk").applyInArrow(_answer(block, cuts, picked, low, high, negatives), _RESULT).write.mode("append").parquet(folder)
        for shared in (block, cuts, picked):
            shared.unpersist()
    return spark.read.schema(_RESULT).parquet(folder)


def _windows(size: int, near: pa.Table, positives: int, low: int, high: int) -> tuple[list, np.ndarray, np.ndarray]:
    """Per anchor: its positives with scores, its distinct upper limits from the highest down, its lowest lower limit."""
    anchor, score, ident = (near.column(c).to_numpy() for c in ("anchor", "score", "id"))
    order = np.lexsort((ident, -score, anchor))
    anchor, score, ident = anchor[order], score[order], ident[order]
    cut = np.searchsorted(anchor, np.arange(size + 1))
    upper = np.full((size, positives), np.iinfo(np.int64).min)
    lowest = np.full(size, np.iinfo(np.int64).max)
    chosen = []
    for a in range(size):
        points = score[cut[a] : cut[a + 1]]
        chosen.append((ident[cut[a] : cut[a + 1]], points))
        least, largest = limits(points, low, high)
        live = least <= largest
        ends = np.unique(largest[live])[::-1]
        upper[a, : len(ends)] = ends
        if len(ends):
            lowest[a] = least[live].min()
    return chosen, upper, lowest
