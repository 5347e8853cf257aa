"""Mixture-controlled packing of tokenized documents into full windows.

Every source is a queue of its documents.  In each round of a deficit round-robin, one round per window, a queue earns
its target share of the window in tokens, sends what it has earned and carries the fraction over.  As documents may be
cut anywhere, a queue sends exactly the whole part of its earnings: after round r it has sent ``floor(earned by r)``
tokens.  Earnings are a closed form, so deficits pass across windows and tasks by arithmetic and no task holds a queue:
with targets w and queues of t tokens, all queues have sent ``T(v) = sum of min(t, w v)`` at virtual time v, and round r
ends where T reaches r windows.  By default the targets are the queues' own sizes, and every queue lasts to the end;
with other targets a queue that runs out leaves its share to the others.

A queue that never earns ``LEAST`` tokens a round saves for several rounds, so that pieces do not become splinters; a
window is then off its target by at most that much.  What is sent, in order of (round, source, place in the queue),
forms one stream that is cut at every window.  The last, incomplete window is cut into powers of two, which need no
padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marklens.llm import bytetext as bt
from marklens.llm.tables import materialise, parallel, small_batches

WINDOW = 4096
#: Fewest tokens that a queue sends at once, unless it ends.
LEAST = 32
#: Bytes of text that are tokenized at once; a worker keeps several times as much.
PIECE = 1 << 17
#: Rounds whose packets one task puts in order.
ROUNDS = 1024
#: Tokens that one task cuts and writes; its file is whole in memory before it is written.
TASK_TOKENS = 4_000_000
_GROUP = 4096

_TOKENS = "part int, row long, doc_id long, source string, doc_tokens long, queue_start long, ids binary"


def tokenized(docs: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: packed ids with ``end_id`` last, and its start within its source in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from marklens.llm.subwords import Subwords

        enc, part, row, sums = Subwords.of(vocabulary), TaskContext.get().partitionId(), 0, {}
        for batch in batches:
            data, bounds = bt.raw(batch.column(1))
            for i, j in bt.pieces(bounds, PIECE):
                ids, cut = enc.ids(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                source = batch.column(2).slice(i, j - i).to_pylist()
                size, at = np.diff(cut) + 1, []
                for s, n in zip(source, size.tolist(), strict=True):
                    at.append(sums.get(s, 0))
                    sums[s] = at[-1] + n
                packed = [bt.pack(np.append(ids[a:b], enc.wide(end_id))) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(j - i, part, np.int32)), pa.array(np.arange(row, row + j - i)), batch.column(0).slice(i, j - i),
                        pa.array(source, pa.string()), pa.array(size), pa.array(at, pa.int64()), pa.array(packed, pa.binary()),
                    ],
                    names=["part", "row", "doc_id", "source", "doc_tokens", "queue_start", "ids"],
                )
                row += j - i

    small_batches(docs.sparkSession)
    chosen = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("\0none")).alias("source"),
    )
    return chosen.mapInArrow(run, _TOKENS)


def _before(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Running sum of ``value`` over the rows before, by a long ``key``; no task orders more than a group of keys."""
    grouped = df.withColumn("_g", F.col(key).cast("long").bitwiseAND(~(_GROUP - 1)))
    outer = grouped.groupBy("_g").agg(F.sum(value).alias("_s"))
    outer = outer.withColumn("_o", F.sum("_s").over(Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1))).drop("_s")
    inner = F.sum(value).over(Window.partitionBy("_g").orderBy(key).rowsBetween(Window.unboundedPreceding, -1))
    return grouped.withColumn(name, F.coalesce(inner, F.lit(0))).join(outer, "_g").withColumn(name, F.col(name) + F.coalesce("_o", F.lit(0))).drop("_g", "_o")


def _tail(total: int, window: int) -> list[int]:
    """Starts of the sequences after the last full window: powers of two, largest first."""
    at, out = total // window * window, []
    while at < total:
        out.append(at)
        at += 1 << ((total - at).bit_length() - 1)
    return out


def _earned(total: int, window: int, targets: dict[str, float] | None, sizes: dict[str, int]):
    """Columns of the round that a place in a queue falls into, roughly, and of what a queue has sent after a round."""
    t = F.col("queue_tokens").cast("double")
    if targets is None:
        time_of = lambda x: x / F.lit(float(total))
        sent_at = lambda v: v * F.lit(float(total))
        weight = t
    else:
        ends = sorted((sizes[s] / targets[s], targets[s], s) for s in sizes)  # where queues run out
        live = sum(w for _, w, _ in ends)
        times, sent, speeds, largest = [0.0], [0.0], [live], {}
        for v, w, s in ends:
            largest[s] = w / live  # a queue's share only grows while others run out
            sent.append(sent[-1] + (v - times[-1]) * speeds[-1])
            times.append(v)
            live -= w
            speeds.append(max(live, 1e-300))
        at = lambda xs, x: F.greatest(F.size(F.filter(F.lit(xs), lambda y: y <= x)) - 1, F.lit(0))
        pick = lambda xs, k: F.get(F.lit(xs), k)
        knots = times[:-1], sent[:-1], speeds[:-1]
        time_of = lambda x: pick(knots[0], at(knots[1], x)) + (x - pick(knots[1], at(knots[1], x))) / pick(knots[2], at(knots[1], x))
        sent_at = lambda v: pick(knots[1], at(knots[0], v)) + (v - pick(knots[0], at(knots[0], v))) * pick(knots[2], at(knots[0], v))
        weight, top = F.lit(0.0), F.lit(1.0)
        for s, w in targets.items():
            weight, top = F.when(F.col("source") == s, F.lit(float(w))).otherwise(weight), F.when(F.col("source") == s, F.lit(largest[s])).otherwise(top)
    rounds = max(1, -(-total // window))
    near_round = lambda e: F.floor(sent_at(e.cast("double") / weight) / window).cast("long")
    after = lambda r: F.when(r >= rounds, F.col("queue_tokens")).when(r <= 0, F.lit(0).cast("long")).otherwise(
        F.least(F.floor(weight * time_of(r.cast("double") * window)).cast("long"), F.col("queue_tokens")))
    share = t / total if targets is None else top
    every = F.greatest(F.ceil(F.lit(float(LEAST)) / (share * window)), F.lit(1)).cast("long")
    return near_round, after, every, rounds


def pack(
    docs: DataFrame, vocabulary: str, end_id: int = 2, window: int = WINDOW, targets: dict[str | None, float] | None = None,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """Pieces of documents with their places in sequences.

    Columns: ``doc_id, source, start, length, doc_tokens, sequence_id, offset, sequence_length, ids``; ``ids`` holds
    little-endian unsigned 32-bit ids.  Each id lies in exactly one piece; a sequence has ``window`` tokens, and only
    those at the end of the stream have fewer, a power of two.  ``targets`` maps every source to a positive weight;
    by default a source weighs what it holds.  A null or empty text is ``end_id`` alone; a null source is a source of
    its own; repeated rows and ids are packed as often as they occur; other columns are ignored; no rows give no pieces.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    tokens = materialise(tokenized(docs, vocabulary, end_id, id_col, text_col, source_col), "tokens")
    sent = tokens.groupBy("source", "part").agg(F.sum("doc_tokens").alias("_n"))
    total = sent.agg(F.sum("_n")).first()[0] or 0
    queue = Window.partitionBy("source")
    sent = sent.select(
        "source", "part", F.sum("_n").over(queue).alias("queue_tokens"),
        (F.sum("_n").over(queue.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"),
    )
    sent = materialise(sent, "queues")
    rows = tokens.select("part", "row", "source", "doc_tokens", "queue_start").join(sent, ["source", "part"])
    rows = rows.withColumn("queue_start", F.col("queue_start") + F.col("_before"))
    wanted, sizes = None, {}
    if targets is not None:
        wanted = {"\0none" if k is None else k: float(w) for k, w in targets.items()}
        sizes = {r["source"]: r["n"] for r in sent.groupBy("source").agg(F.max("queue_tokens").alias("n")).collect()}  # as many as targets
        if sizes.keys() - wanted.keys() or any(w <= 0 for w in wanted.values()):
            raise ValueError("every source needs a positive target")
        wanted = {k: w for k, w in wanted.items() if k in sizes}
    near_round, after, every, rounds = _earned(total, window, wanted, sizes)
    first, last = F.col("queue_start"), F.col("queue_start") + F.col("doc_tokens")
    # queues that save send in different rounds, and half of it in advance, so that what is saved evens out
    steps = rows.withColumn("_e", every).withColumn("_phase", F.pmod(F.xxhash64("source"), F.col("_e")))
    steps = steps.withColumn("_shift", F.floor((F.col("_e") - 1) / 2))
    sends = lambda k: k * F.col("_e") + F.col("_phase")
    back = F.col("_phase") + F.col("_shift")
    # the sendings that may hold a part of the document; empty parts fall out below
    span = F.sequence(F.greatest(F.floor((near_round(first) - 1 - back) / F.col("_e")), F.lit(0)), F.greatest(F.ceil((near_round(last) + 2 - back) / F.col("_e")) + 1, F.lit(0)))
    steps = steps.withColumn("_k", F.explode(span))
    sent_by = lambda k: after(sends(k) + F.col("_shift"))
    low, high = F.greatest(first, F.when(F.col("_k") == 0, F.lit(0).cast("long")).otherwise(sent_by(F.col("_k") - 1))), F.least(last, sent_by(F.col("_k")))
    packets = steps.withColumns({"_low": low, "_high": high}).where(F.col("_low") < F.col("_high")).select(
        "part", "row", "source", "queue_start", (F.col("_low") - F.col("queue_start")).alias("start"), (F.col("_high") - F.col("_low")).alias("length"),
        F.least(sends(F.col("_k")), F.lit(rounds)).alias("turn"),
    ).withColumn("block", F.floor(F.col("turn") / ROUNDS))
    packets = materialise(packets.select("part", "row", "source", "queue_start", "start", "length", "turn", "block"), "packets")
    blocks = _before(packets.groupBy("block").agg(F.sum("length").alias("_n")), "block", "_n", "_at")
    order = Window.partitionBy("block").orderBy("turn", "source", F.col("queue_start") + F.col("start")).rowsBetween(Window.unboundedPreceding, -1)
    placed = packets.withColumn("_in", F.coalesce(F.sum("length").over(order), F.lit(0))).join(blocks.select("block", "_at"), "block")
    placed = placed.withColumn("_from", F.col("_at") + F.col("_in")).withColumn("_to", F.col("_from") + F.col("length"))

    whole, tail = total // window, _tail(total, window)
    starts = F.array(*[F.lit(t).cast("long") for t in tail]) if tail else F.array().cast("array<bigint>")

    def sequence_of(x: Column) -> Column:
        return F.when(x < whole * window, F.floor(x / window)).otherwise(F.size(F.filter(starts, lambda t: t <= x)) + F.lit(whole - 1)).cast("long")

    def start_of(q: Column) -> Column:
        return F.when(q < whole, q * window).when(q == whole + len(tail), F.lit(total)).otherwise(F.get(starts, (q - whole).cast("int"))).cast("long")

    pieces = placed.withColumn("sequence_id", F.explode(F.sequence(sequence_of(F.col("_from")), sequence_of(F.col("_to") - 1))))
    opens = F.greatest(F.col("_from"), start_of(F.col("sequence_id")))
    closes = F.least(F.col("_to"), start_of(F.col("sequence_id") + 1))
    pieces = pieces.select(
        "part", "row", (F.col("start") + opens - F.col("_from")).alias("start"), (closes - opens).alias("length"), "sequence_id",
        (opens - start_of(F.col("sequence_id"))).alias("offset"), (start_of(F.col("sequence_id") + 1) - start_of(F.col("sequence_id"))).alias("sequence_length"),
    )
    # the ids are stored packed, so the size of a shuffle does not tell what a task writes
    tasks = max(parallel(docs.sparkSession), -(-total // TASK_TOKENS))
    cuts = pieces.repartition(tasks, "part", "row").groupBy("part", "row").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset", "sequence_length")).alias("cuts"))
    joined = tokens.repartition(tasks, "part", "row").join(cuts.hint("shuffle_hash"), ["part", "row"]).select("doc_id", "source", "doc_tokens", "ids", "cuts")
    return joined.mapInArrow(
        _cut, "doc_id long, source string, start long, length long, doc_tokens long, sequence_id long, offset long, sequence_length long, ids binary"
    ).withColumn("source", F.nullif("source", F.lit("\0none")))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from marklens.llm.subwords import Subwords

    pa.default_memory_pool().release_unused()
    Subwords.close()  # workers are used again, and from here on nothing is tokenized
    for batch in batches:
        step = 256  # documents whose pieces are built at once
        for lo in range(0, batch.num_rows, step):
            part = batch.slice(lo, step)
            cuts = part.column("cuts")
            inner, n = cuts.flatten(), np.diff(np.asarray(cuts.offsets))
            start, length = np.asarray(inner.field("start")), np.asarray(inner.field("length"))
            back = np.repeat(np.arange(part.num_rows), n)
            out, k = [], 0
            for packed, count, m in zip(part.column("ids").to_pylist(), part.column("doc_tokens").to_pylist(), n.tolist(), strict=True):
                flat = bt.unpack(packed, np.uint16) if _narrow(packed, count) else bt.unpack(packed, np.uint32)
                flat = flat.astype("<u4")
                for a, b in zip(start[k : k + m].tolist(), length[k : k + m].tolist(), strict=True):
                    out.append(flat[a : a + b].tobytes())
                k += m
            take = pa.array(back)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").take(take), part.column("source").take(take), inner.field("start"), inner.field("length"),
                    part.column("doc_tokens").take(take), inner.field("sequence_id"), inner.field("offset"), inner.field("sequence_length"), pa.array(out, pa.binary()),
                ],
                names=["doc_id", "source", "start", "length", "doc_tokens", "sequence_id", "offset", "sequence_length", "ids"],
            )


def _narrow(packed: bytes, count: int) -> bool:
    """Whether the ids of a document were stored in two bytes each."""
    import zstandard

    return zstandard.frame_content_size(packed) == 2 * count
