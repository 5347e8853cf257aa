"""Grouped prefix join on word shingles with exact Jaccard similarity, and its connected components.

A document is the set of its distinct word shingles.  Two sets of a and b shingles that are similar by ``t`` share one
of the first ``n - ceil(t n) + 1`` shingles of each in any order of all shingles.  The order here has three classes:

* a third of all shingles, chosen by hash, that at most ``RARE`` documents hold, rarest first;
* the other two thirds, rarest first among the documents that need them, those with too few of the first class;
* the frequent ones of the first third.

Counts are exact, and a shingle of one document alone is never sent anywhere.  Documents of equal prefix and size form
one group; groups meet in the lists of their prefix shingles, pairs of groups are filtered by size and place, and
what is left is expanded to members and verified on whole sets.

Groups of near copies are not expanded into all pairs: in a few rounds each list is compared with one member only, the
one with most links, and only documents that are then still in different components are compared with each other,
all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marklens.llm import bytetext as bt
from marklens.llm.components import components
from marklens.llm.tables import materialise, parallel, texts

#: One shingle in so many is counted; the prefix of a set seldom needs more.
COUNTED = 3
#: Documents that a shingle of the first class is in, at most.
RARE = 16
#: Rounds in which lists are compared with one member.
STARS = 4
#: Shingles of one part, the unit in which counts are asked for and answered.
PART = 1_500_000
#: Distinct shingles that one task counts, about.
BUCKET = 2_000_000
#: Ids known to be few enough to be sent to every task; more are joined by a shuffle.
SMALL = 1_000_000

_SETS = "kind string, part long, bucket int, doc_id long, n long, fp1 long, fp2 long, sel binary, keys binary, cnt binary"


def _sets(docs: DataFrame, k: int, counted: bool, buckets: int) -> DataFrame:
    """A row per document with its chosen shingles as places in its part's list, and the lists, dealt by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, chunk = TaskContext.get().partitionId(), 0
        rows, keys, held = [], [], 0

        def flush():
            part = task << 24 | chunk
            flat = np.concatenate([h for h, _ in keys])
            uniq, back, count = np.unique(flat, return_inverse=True, return_counts=True)
            at, out = 0, []
            for (h, _), (ids, n, fp1, fp2, size) in zip(keys, rows, strict=True):
                own = back[at : at + len(h)].astype(np.uint32)
                at += len(h)
                cut = np.r_[0, np.cumsum(size)]
                out.append(
                    pa.RecordBatch.from_pydict(
                        {
                            "kind": ["doc"] * len(ids), "part": pa.array(np.full(len(ids), part)), "bucket": pa.nulls(len(ids), pa.int32()), "doc_id": ids, "n": n,
                            "fp1": fp1.view(np.int64), "fp2": fp2.view(np.int64), "sel": pa.array([bt.pack(own[a:b], True) for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
                            "keys": pa.nulls(len(ids), pa.binary()), "cnt": pa.nulls(len(ids), pa.binary()),
                        }
                    )
                )
            edges = np.searchsorted(_bucket_of(uniq, buckets), np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(edges)):
                x, y = edges[b], edges[b + 1]
                out.append(
                    pa.RecordBatch.from_pydict(
                        {
                            "kind": ["keys"], "part": pa.array([part], pa.int64()), "bucket": pa.array([b], pa.int32()), **{c: pa.nulls(1, pa.int64()) for c in ("doc_id", "n", "fp1", "fp2")},
                            "sel": pa.nulls(1, pa.binary()), "keys": pa.array([bt.pack(uniq[x:y], True)], pa.binary()), "cnt": pa.array([bt.pack(count[x:y].astype(np.uint32))], pa.binary()),
                        }
                    )
                )
            return out

        for batch in batches:
            data, bounds = bt.raw(batch.column(1))
            for i, j in bt.pieces(bounds):
                doc, h = bt.distinct(*bt.windows(bt.words(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]), k))
                m = j - i
                n = np.bincount(doc, minlength=m)
                full = np.append(np.zeros(0, np.uint64), h)
                cut = np.r_[0, np.cumsum(n)]
                run1, run2 = np.r_[np.uint64(0), np.cumsum(bt.mix(full))], np.r_[np.uint64(0), np.cumsum(bt.mix(full ^ np.uint64(0xA5A5A5A5A5A5A5A5)))]
                fp1, fp2 = run1[cut[1:]] - run1[cut[:-1]], run2[cut[1:]] - run2[cut[:-1]]
                chosen = (h % np.uint64(COUNTED) == 0) == counted
                size = np.bincount(doc[chosen], minlength=m)
                rows.append((batch.column(0).slice(i, m), n, fp1, fp2, size))
                keys.append((h[chosen], None))
                held += len(keys[-1][0])
                if held >= PART:
                    yield from flush()
                    rows, keys, held, chunk = [], [], 0, chunk + 1
        if rows:
            yield from flush()

    return docs.mapInArrow(run, _SETS)


def _bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Range bucket of sorted hashes, so that a part's keys of a bucket are one slice."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _count(group: pa.Table) -> pa.Table:
    """Document counts of one bucket's shingles, and ids of those in two documents or more, for each asking part."""
    bucket = group.column("bucket")[0].as_py()
    keys = [bt.unpack(b, np.uint64, True) for b in group.column("keys").to_pylist()]
    cnt = np.concatenate([bt.unpack(b, np.uint32) for b in group.column("cnt").to_pylist()])
    _, back = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(back, weights=cnt).astype(np.int64)
    df, ids, at = [], [], 0
    for k in keys:
        own = back[at : at + len(k)]
        at += len(k)
        n = np.minimum(total[own], 0xFFFFFFFF).astype(np.uint32)
        df.append(bt.pack(n))
        ids.append(bt.pack((own[n > 1] + (bucket << 32)).astype(np.uint64), True))
    return pa.table({"part": group.column("part"), "bucket": group.column("bucket"), "df": pa.array(df, pa.binary()), "ids": pa.array(ids, pa.binary())})


def _part_counts(counts: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Document counts of a part's list, and the ids of its shingles (0 for those of one document)."""
    rows = sorted(counts.select(["bucket", "df", "ids"]).to_pylist(), key=lambda r: r["bucket"])
    df = np.concatenate([bt.unpack(r["df"], np.uint32) for r in rows] or [np.zeros(0, np.uint32)])
    ids = np.zeros(len(df), np.uint64)
    ids[df > 1] = np.concatenate([bt.unpack(r["ids"], np.uint64, True) for r in rows] or [np.zeros(0, np.uint64)])
    return df, ids


_RANKED = "doc_id long, n long, fp1 long, fp2 long, single long, toks array<long>, hot array<long>"


def _ranked(percent: int, rare: int):
    """Of each document, how many of its chosen shingles it holds alone, and the others' ids in order.

    ``toks`` has those of at most ``rare`` documents, ``hot`` the rest; neither is longer than a prefix.
    """

    def run(docs: pa.Table, counts: pa.Table) -> pa.Table:
        df, ids = _part_counts(counts)
        single, toks, hot = [], [], []
        for n, sel in zip(docs.column("n").to_pylist(), docs.column("sel").to_pylist(), strict=True):
            own = bt.unpack(sel, np.uint32, True)
            p = n - -(-percent * n // 100) + 1 if n else 0
            alone = min(int((df[own] == 1).sum()), p)
            rest = own[df[own] > 1]
            order = rest[np.lexsort((ids[rest], df[rest]))]
            few = int((df[order] <= rare).sum())
            single.append(alone)
            toks.append(ids[order[: min(few, p - alone)]].view(np.int64))
            hot.append(ids[order[few : few + max(0, p - alone - few)]].view(np.int64))
        return pa.table(
            {
                **{c: docs.column(c) for c in ("doc_id", "n", "fp1", "fp2")}, "single": pa.array(single, pa.int64()),
                "toks": pa.array(toks, pa.list_(pa.int64())), "hot": pa.array(hot, pa.list_(pa.int64())),
            }
        )

    return run


def _rank(docs: DataFrame, k: int, percent: int, counted: bool, rare: int) -> DataFrame:
    parts = materialise(_sets(docs, k, counted, parallel(docs.sparkSession)), "sets")
    asked = parts.where("kind = 'keys'").select("part", "bucket", "keys", "cnt")
    own = parts.where("kind = 'doc'").select("part", "doc_id", "n", "fp1", "fp2", "sel")
    counts = asked.groupBy("bucket").applyInArrow(_count, "part long, bucket int, df binary, ids binary")
    return materialise(own.groupBy("part").cogroup(counts.groupBy("part")).applyInArrow(_ranked(percent, rare), _RANKED), "ranked")


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents with these ids, one row each; the ids are sent to every task if they are known to be few."""
    few = ids.limit(SMALL + 1).count() <= SMALL
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])


def _shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = bt.raw(batch.column(1))
            for i, j in bt.pieces(bounds):
                doc, h = bt.distinct(*bt.windows(bt.words(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]), k))
                cut = np.searchsorted(doc, np.arange(j - i + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(cut), pa.array(h.view(np.int64)))], names=["cid", "shingles"])

    return docs.mapInArrow(run, "cid long, shingles array<long>")


def _verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of class ids, a written table, whose whole sets are similar enough."""
    wanted = materialise(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "wanted")
    sets = materialise(_shingle_sets(_only(docs, wanted).select("doc_id", "text"), k), "sets")
    left = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("cid").alias("b"), F.col("shingles").alias("y"))
    common = F.size(F.array_intersect("x", "y")).cast("long")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", common.alias("c"), (F.size("x") + F.size("y")).cast("long").alias("s"))
    return both.where(100 * F.col("c") >= percent * (F.col("s") - F.col("c"))).select("a", "b")


def join(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_shingles, class_id, component_id``.

    ``class_id`` is the smallest id with the same set, ``component_id`` the smallest id reachable over pairs whose
    Jaccard similarity is at least ``percent`` / 100.  A null or empty text, or one without words, has no shingles and is
    linked with nothing; a text of fewer than ``k`` words is one shingle.  Repeated rows stay; ids are taken to name
    one text each.  Null ids are kept with null classes and components, and nothing is linked through them.  Other
    columns are ignored; no rows give no rows.
    """
    rows = texts(docs, id_col, text_col)
    found = _rank(rows, k, percent, True, RARE)
    classes = materialise(found.where("n > 0 and doc_id is not null").groupBy("n", "fp1", "fp2").agg(F.min("doc_id").alias("cid")), "classes")
    one_each = found.join(classes.select(F.col("cid").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    one_each = one_each.withColumn("p", F.col("n") - F.ceil(F.col("n") * F.lit(percent).cast("long") / F.lit(100)) + 1)
    one_each = one_each.withColumn("lack", F.col("single") + F.size("toks") < F.col("p"))
    # Exactness: whoever lacks nothing has a prefix of the first class only, so the second is counted among the others.
    lacking = materialise(one_each.where("lack").select("doc_id"), "lacking")
    further = _rank(_only(rows, lacking).select("doc_id", "text"), k, percent, False, 1 << 62)
    mark = F.lit(1 << 62).cast("bigint")
    further = further.select("doc_id", F.col("single").alias("single2"), F.transform("toks", lambda x: x.bitwiseOR(mark)).alias("toks2"))
    both = one_each.join(further, "doc_id", "left").withColumn("more", F.coalesce("toks2", F.array().cast("array<bigint>")))
    later = F.col("single") + F.size("toks") + F.coalesce("single2", F.lit(0))
    place = lambda array, start: F.transform(array, lambda x, i: F.struct(x.alias("token"), (i + start).alias("pos")))
    spots = F.concat(place("toks", F.col("single")), place("more", later), place("hot", later + F.size("more")))
    both = both.withColumn("spots", F.filter(spots, lambda s: s["pos"] < F.col("p")))
    # A shingle of one document in the prefix keeps a document a group of its own.
    alone = (F.col("single") > 0) | ((F.col("single") + F.size("toks") < F.col("p")) & (F.coalesce("single2", F.lit(0)) > 0))
    key = F.when(alone, F.xxhash64(F.lit("alone"), "doc_id")).otherwise(F.xxhash64("n", F.col("spots")["token"]))
    open_ = materialise(both.where(F.size("spots") > 0).select(F.col("doc_id").alias("cid"), "n", key.alias("gid"), "spots"), "prefixes")
    members = open_.select("cid", "gid", "n")
    groups = open_.groupBy("gid", "n").agg(F.min_by("spots", "cid").alias("spots"))
    lists = groups.select("gid", "n", F.explode("spots").alias("t")).select("gid", "n", F.col("t.token").alias("token"), F.col("t.pos").alias("pos"))
    lists = materialise(lists, "lists")

    close = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent))).alias("band")
    links = tried = state = None
    for turn in range(STARS + 1):
        if links is None:
            state = members.select("cid", "gid", "n", F.col("cid").alias("comp"), F.lit(0).cast("long").alias("degree"))
        else:
            degree = links.select(F.col("a").alias("cid")).union(links.select("b")).groupBy("cid").agg(F.count(F.lit(1)).alias("degree"))
            comp = components(links).select(F.col("node").alias("cid"), "component")
            state = members.join(comp, "cid", "left").join(degree, "cid", "left").select("cid", "gid", "n", F.coalesce("component", "cid").alias("comp"), F.coalesce("degree", F.lit(0)).alias("degree"))
        state = materialise(state, "state")
        heads = state.groupBy("gid", "n").agg(F.max(F.struct("degree", (-F.col("cid")).alias("minus"), F.col("comp"))).alias("h"), F.min("comp").alias("c1"), F.max("comp").alias("c2"))
        heads = heads.select("gid", "n", (-F.col("h.minus")).alias("rep"), F.col("h.comp").alias("comp"), F.col("h.degree").alias("degree"), "c1", "c2")
        placed = lists.join(heads, ["gid", "n"])
        if turn == STARS:
            break
        first = placed.select("token", band, F.struct("degree", (-F.col("rep")).alias("minus"), "n", "comp").alias("head"), "comp").groupBy("token", "band")
        first = first.agg(F.max("head").alias("head"), F.min("comp").alias("l"), F.max("comp").alias("h")).where("l <> h").drop("l", "h")
        stars = placed.select("token", band, "rep", "n", "comp").join(first, ["token", "band"]).where((F.col("head.comp") != F.col("comp")) & close(F.col("head.n"), F.col("n")))
        stars = stars.select((-F.col("head.minus")).alias("x"), F.col("rep").alias("y"))
        inside = state.join(heads.where("c1 <> c2").select("gid", "n", F.col("rep").alias("x"), F.col("comp").alias("hc")), ["gid", "n"]).where("comp <> hc").select("x", F.col("cid").alias("y"))
        pairs = stars.union(inside).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        pairs = materialise(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "candidates")
        fresh = materialise(_verified(pairs, rows, k, percent), "links")
        tried = pairs if tried is None else tried.union(pairs)
        links = fresh if links is None else materialise(links.union(fresh), "links")
        if fresh.isEmpty():
            break

    split = placed.groupBy("token").agg(F.min("c1").alias("l"), F.max("c2").alias("h")).where("l <> h").select("token")
    placed = materialise(placed.join(split, "token", "left_semi").select("token", "gid", "n", "pos", "c1", "c2"), "open-lists")
    x, y = placed.alias("x"), placed.alias("y")
    need = F.ceil(F.lit(percent / (100 + percent)) * (F.col("x.n") + F.col("y.n")) - 1e-9)
    reach = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
    apart = (F.col("x.c1") != F.col("y.c1")) | (F.col("x.c1") != F.col("x.c2")) | (F.col("y.c1") != F.col("y.c2"))
    ahead = (F.col("x.gid") < F.col("y.gid")) | ((F.col("x.gid") == F.col("y.gid")) & (F.col("x.n") < F.col("y.n")))
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & ahead & apart & close(F.col("x.n"), F.col("y.n")) & (reach >= need))
    met = met.select(F.col("x.gid").alias("g1"), F.col("x.n").alias("n1"), F.col("y.gid").alias("g2"), F.col("y.n").alias("n2")).distinct()
    same = heads.where("c1 <> c2").select(F.col("gid").alias("g1"), F.col("n").alias("n1"), F.col("gid").alias("g2"), F.col("n").alias("n2"))
    one = state.select(F.col("gid").alias("g1"), F.col("n").alias("n1"), F.col("cid").alias("a"), F.col("comp").alias("ca"))
    two = state.select(F.col("gid").alias("g2"), F.col("n").alias("n2"), F.col("cid").alias("b"), F.col("comp").alias("cb"))
    across = met.union(same).join(one, ["g1", "n1"]).join(two, ["g2", "n2"]).where("ca <> cb")
    across = across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    rest = _verified(materialise(across, "candidates"), rows, k, percent)
    final = components(links.union(rest))

    by_class = classes.join(final, F.col("cid") == F.col("node"), "left").select("n", "fp1", "fp2", F.col("cid").alias("class_id"), F.coalesce("component", "cid").alias("component_id"))
    out = found.select("doc_id", "n", "fp1", "fp2").join(by_class, ["n", "fp1", "fp2"], "left")
    own_id = lambda c: F.when(F.col("doc_id").isNotNull(), F.coalesce(c, "doc_id")).alias(c)
    return out.select("doc_id", F.col("n").alias("n_shingles"), own_id("class_id"), own_id("component_id"))
