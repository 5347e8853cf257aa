"""A Katz back-off model over words: counted, stored and evaluated in partitioned tables.

Texts are cut into parts.  A part asks the tables for what it needs, its distinct words and pairs of words, by sorted
blocks for each bucket of keys, and is answered by blocks in the same order, so no table is ever sent whole and no key
is sent more than once a part.  Words are keyed by 64-bit hashes, pairs by the two words' exact places in the word
tables.  Pairs of a very frequent first word are dealt by both words.

Level one: P(w) = d_c c / N, and what discounting leaves is the chance of a word that training never saw.
Level two: P(w | h) = d_r r / c(h) where the pair was seen, else a(h) P(w), with a(h) such that the sum over all w is 1.
Counts up to ``K`` are discounted after Good and Turing; where the counts of counts don't allow it, by half a count.
A history whose counts are all above ``K`` leaves nothing; it is given one count more, for unseen successors.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marklens.llm import bytetext as bt
from marklens.llm.tables import materialise, parallel, texts
from marklens.session import scratch_dir

K = 5
START, END = np.uint64(1), np.uint64(2)
#: Tokens of one part; distinct keys of one bucket, about.
PART, BUCKET = 1_000_000, 2_000_000

_PARTS = "kind string, part long, doc_id long, held boolean, n long, own binary, cnt binary"
_ANSWER = "kind string, part long, bucket int, a binary, b binary"


def _parts(docs: DataFrame) -> DataFrame:
    """``doc`` rows with a text's words as places in its part's list, and one ``words`` row of that list per part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, chunk, held_back, tokens = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            part = task << 24 | chunk
            train = ~np.concatenate([h for _, h, _, _ in held_back])
            size = np.concatenate([n for _, _, n, _ in held_back])
            uniq, own = np.unique(np.concatenate([[START, END], *(w for _, _, _, w in held_back)]), return_inverse=True)
            own = own[2:]
            count = np.bincount(own[np.repeat(train, size)], minlength=len(uniq))
            count[np.searchsorted(uniq, [START, END])] = train.sum()
            cut = np.r_[0, np.cumsum(size)]
            n = len(size)
            return pa.RecordBatch.from_pydict(
                {
                    "kind": ["doc"] * n + ["words"], "part": pa.array(np.full(n + 1, part)), "doc_id": pa.array(sum((i for i, _, _, _ in held_back), []) + [None], pa.int64()),
                    "held": pa.array([*(~train).tolist(), None]), "n": pa.array([*size.tolist(), len(uniq)], pa.int64()),
                    "own": pa.array([*(bt.pack(own[a:b].astype(np.uint32)) for a, b in zip(cut[:-1], cut[1:], strict=True)), bt.pack(uniq, True)], pa.binary()),
                    "cnt": pa.array([None] * n + [bt.pack(count.astype(np.uint64))], pa.binary()),
                }
            )

        for batch in batches:
            data, bounds = bt.raw(batch.column(1))
            held = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for i, j in bt.pieces(bounds):
                w = bt.words(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                held_back.append((batch.column(0).slice(i, j - i).to_pylist(), held[i:j], np.bincount(w.doc, minlength=j - i), w.hash))
                tokens += len(w.hash)
                if tokens >= PART:
                    yield flush()
                    held_back, tokens, chunk = [], 0, chunk + 1
        if held_back:
            yield flush()

    return docs.mapInArrow(run, _PARTS)


def _co_located(df: DataFrame, key: str) -> DataFrame:
    """``df`` as a written table bucketed by ``key``, so that later groupings by it need no shuffle."""
    spark = df.sparkSession
    name = f"marklens_parts_{uuid.uuid4().hex}"
    df.write.bucketBy(parallel(spark), key).option("path", f"{scratch_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def _blocks(key: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """Slices of an array of bucket numbers in order."""
    edges = np.searchsorted(key, np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(edges)):
        yield int(b), int(edges[b]), int(edges[b + 1])


def _range_bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _batch(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], names=[n for n, _ in schema])


_ASK = [("bucket", pa.int32()), ("part", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary())]
_OUT = [("kind", pa.string()), ("part", pa.int64()), ("bucket", pa.int32()), ("a", pa.binary()), ("b", pa.binary())]
_ASK_SQL = "bucket int, part long, a binary, b binary, c binary, d binary"


def _ask_words(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, own, cnt in zip(*(batch.column(c).to_pylist() for c in ("part", "own", "cnt")), strict=True):
                keys, count = bt.unpack(own, np.uint64, True), bt.unpack(cnt, np.uint64)
                yield _batch([(b, part, bt.pack(keys[x:y], True), bt.pack(count[x:y]), None, None) for b, x, y in _blocks(_range_bucket(keys, buckets), buckets)], _ASK)

    return run


def _spectrum(count: np.ndarray) -> np.ndarray:
    """Number of keys with count 1..K+1, the sum of all counts, the number of keys."""
    return np.r_[np.bincount(np.minimum(count, K + 2).astype(np.int64), minlength=K + 3)[1 : K + 2], count.sum(), (count > 0).sum()].astype(np.int64)


def _answer_words(group: pa.Table) -> pa.Table:
    """Places in the word table and training counts; one ``stat`` row of the bucket's counts of counts."""
    bucket = group.column("bucket")[0].as_py()
    keys = [bt.unpack(x, np.uint64, True) for x in group.column("a").to_pylist()]
    uniq, back = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(uniq), np.uint64)
    np.add.at(total, back, np.concatenate([bt.unpack(x, np.uint64) for x in group.column("b").to_pylist()]))
    rows, at = [], 0
    for part, k in zip(group.column("part").to_pylist(), keys, strict=True):
        own = back[at : at + len(k)]
        at += len(k)
        rows.append(("word", part, bucket, bt.pack(own.astype(np.uint32), True), bt.pack(total[own])))
    rows.append(("stat", None, bucket, bt.pack(_spectrum(total[uniq != START])), None))
    return pa.Table.from_batches([_batch(rows, _OUT)])


def discounts(n: np.ndarray) -> np.ndarray:
    """Factor of a count r, at r; index K + 1 stands for all larger counts. ``n``: keys with counts 1..K+1."""
    d = np.ones(K + 2)
    r = np.arange(1, K + 1)
    if (n[: K + 1] > 0).all():
        rest = (K + 1) * n[K] / n[0]
        with np.errstate(divide="ignore", invalid="ignore"):
            d[1 : K + 1] = ((r + 1) * n[1 : K + 1] / n[:K] / r - rest) / (1 - rest)
    if not ((d[1 : K + 1] > 0) & (d[1 : K + 1] < 1)).all():
        d[1 : K + 1] = (r - 0.5) / r
    return d


class Level:
    """Word probabilities: ``known`` of counts, ``unseen`` of any other word."""

    def __init__(self, spectrum: np.ndarray):
        self.total = int(spectrum[K + 1])
        self.size = int(spectrum[K + 2])
        self.d = discounts(spectrum)
        left = float(((1 - self.d[1 : K + 1]) * np.arange(1, K + 1) * spectrum[:K]).sum())
        self.scale = 1.0
        if not left:  # nothing to take from: one count more
            self.scale, left = self.total / (self.total + 1), self.total / (self.total + 1)
            left = 1.0
        self.unseen = left / self.total if self.scale == 1.0 and self.total else 1 / (self.total + 1)

    def __call__(self, count: np.ndarray) -> np.ndarray:
        known = self.scale * self.d[np.minimum(count, K + 1).astype(np.int64)] * count / max(self.total, 1)
        return np.where(count > 0, known, self.unseen)


def _part_words(answers: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Exact id, hash bucket and count of a part's words in the order of its list."""
    rows = sorted((r for r in answers if r["kind"] == "word"), key=lambda r: r["bucket"])
    places = [bt.unpack(r["a"], np.uint32, True) for r in rows]
    ids = np.concatenate([p.astype(np.uint64) | np.uint64(r["bucket"]) << np.uint64(32) for p, r in zip(places, rows, strict=True)])
    return ids, np.concatenate([bt.unpack(r["b"], np.uint64) for r in rows])


def _pairs(docs: pa.Table, ids: np.ndarray, count: np.ndarray, buckets: int, hot: int):
    """All (history, word) tokens of a part as local places, its distinct pairs in the order of asking, and back."""
    own = [bt.unpack(x, np.uint32).astype(np.int64) for x in docs.column("own").to_pylist()]
    size = np.array([len(o) for o in own], np.int64) + 1
    end = np.cumsum(size)
    start, stop = docs.column("_start")[0].as_py(), docs.column("_end")[0].as_py()
    word = np.full(int(end[-1]), stop, np.int64)
    inner = np.ones(len(word), bool)
    inner[end - 1] = False
    word[inner] = np.concatenate(own)
    history = np.r_[start, word[:-1]]
    history[end[:-1]] = start
    pair, back = np.unique(history << 32 | word, return_inverse=True)
    h, w = pair >> 32, pair & 0xFFFFFFFF
    spread = bt.mix(ids[h] ^ np.where(count[h] > hot, bt.mix(ids[w]), np.uint64(0)))
    bucket = _range_bucket(spread, buckets)
    order = np.lexsort((ids[w], ids[h], bucket))
    return word, history, size, h[order], w[order], bucket[order], np.argsort(order)[back]


def _with_ends(table: pa.Table) -> pa.Table:
    """The part's documents, with the places of START and END in its list."""
    kind = np.array(table.column("kind").to_pylist())
    keys = bt.unpack(table.column("own")[int(np.flatnonzero(kind == "words")[0])].as_py(), np.uint64, True)
    docs = table.filter(pa.array(kind == "doc"))
    at = np.searchsorted(keys, [START, END])
    for name, x in zip(("_start", "_end"), at.tolist(), strict=True):
        docs = docs.append_column(name, pa.array(np.full(len(docs), x)))
    return docs


def _ask_pairs(buckets: int, hot: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        docs = _with_ends(table)
        ids, count = _part_words(answers.to_pylist())
        _, _, size, h, w, bucket, back = _pairs(docs, ids, count, buckets, hot)
        train = np.repeat(~np.array(docs.column("held").to_pylist(), bool), size)
        times = np.bincount(back[train], minlength=len(h)).astype(np.uint32)
        part = docs.column("part")[0].as_py()
        rows = [
            (b, part, bt.pack(ids[h[x:y]], True), bt.pack(ids[w[x:y]]), bt.pack(times[x:y]), bt.pack(count[w[x:y]]))
            for b, x, y in _blocks(bucket, buckets)
        ]
        return pa.Table.from_batches([_batch(rows, _ASK)])

    return run


def _answer_pairs(word: Level):
    """Training counts of pairs; per history the number of successors by count, the sum of large counts, their level-one sum."""

    def run(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        first = [bt.unpack(x, np.uint64, True) for x in group.column("a").to_pylist()]
        h, w = np.concatenate(first), np.concatenate([bt.unpack(x, np.uint64) for x in group.column("b").to_pylist()])
        times, alone = (np.concatenate([bt.unpack(x, t) for x in group.column(c).to_pylist()]) for c, t in (("c", np.uint32), ("d", np.uint64)))
        order = np.lexsort((w, h))
        h, w = h[order], w[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (w[1:] != w[:-1])]
        key = np.cumsum(new) - 1
        total = np.bincount(key, weights=times[order]).astype(np.int64)
        back = np.empty(len(key), np.int64)
        back[order] = key
        rows, at = [], 0
        for part, k in zip(group.column("part").to_pylist(), first, strict=True):
            rows.append(("pair", part, bucket, bt.pack(total[back[at : at + len(k)]].astype(np.uint64)), None))
            at += len(k)
        seen = total > 0
        h, total, p = h[new][seen], total[seen], word(alone[order][new][seen])
        rows.append(("stat", None, bucket, bt.pack(_spectrum(total.astype(np.uint64))), None))
        if len(h):
            edge = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            many = np.minimum(total, K + 1)
            table = np.stack([np.add.reduceat((many == r).astype(np.int64), edge) for r in range(1, K + 1)], axis=1)
            table = np.c_[table, np.add.reduceat(np.where(many > K, total, 0), edge)]
            sums = np.add.reduceat(p, edge)
            h = h[edge]
            for b, x, y in _blocks((h >> np.uint64(32)).astype(np.int64), int(h[-1] >> np.uint64(32)) + 1):
                body = bt.pack((h[x:y] & np.uint64(0xFFFFFFFF)).astype(np.uint32), True)
                rows.append(("history", None, b, body, bt.pack(np.ascontiguousarray(table[x:y]).reshape(-1)) + b"|sums|" + sums[x:y].tobytes()))
        return pa.Table.from_batches([_batch(rows, _OUT)])

    return run


def _backoff(d: np.ndarray):
    """For each part's words of a bucket: the back-off weight and the scale of seen pairs; NaN for words that are no history."""

    def run(words: pa.Table, histories: pa.Table) -> pa.Table:
        place, table, sums = [np.zeros(0, np.uint32)], [np.zeros((0, K + 1), np.int64)], [np.zeros(0)]
        for a, b in zip(histories.column("a").to_pylist(), histories.column("b").to_pylist(), strict=True):
            place.append(bt.unpack(a, np.uint32, True))
            tail = 8 * len(place[-1])
            table.append(bt.unpack(b[: len(b) - tail - 6], np.int64).reshape(-1, K + 1))
            sums.append(np.frombuffer(b[len(b) - tail :], np.float64))
        uniq, back = np.unique(np.concatenate(place), return_inverse=True)
        m, s = np.zeros((len(uniq), K + 1), np.int64), np.zeros(len(uniq))
        np.add.at(m, back, np.concatenate(table))
        np.add.at(s, back, np.concatenate(sums))
        r = np.arange(1, K + 1)
        count = (m[:, :K] * r).sum(axis=1) + m[:, K]
        left = (m[:, :K] * r * (1 - d[1 : K + 1])).sum(axis=1)
        scale = np.where(left > 0, 1.0, count / (count + 1.0))
        weight = np.where(left > 0, left / np.maximum(count, 1), 1 / (count + 1.0)) / (1 - s)
        rows = []
        for part, bucket, a in zip(*(words.column(c).to_pylist() for c in ("part", "bucket", "a")), strict=True):
            own = bt.unpack(a, np.uint32, True)
            at = np.minimum(np.searchsorted(uniq, own), max(len(uniq) - 1, 0))
            known = uniq[at] == own if len(uniq) else np.zeros(len(own), bool)
            out = np.full((2, len(own)), np.nan)
            out[0, known], out[1, known] = weight[at[known]], scale[at[known]]
            rows.append(("backoff", part, bucket, bt.pack(out[0].view(np.uint64)), bt.pack(out[1].view(np.uint64))))
        return pa.Table.from_batches([_batch(rows, _OUT)])

    return run


def _evaluate(word: Level, d: np.ndarray, buckets: int, hot: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        docs, rows = _with_ends(table), answers.to_pylist()
        ids, count = _part_words(rows)
        token, history, size, h, _, bucket, back = _pairs(docs, ids, count, buckets, hot)
        by = {k: sorted((r for r in rows if r["kind"] == k), key=lambda r: r["bucket"]) for k in ("pair", "backoff")}
        times = np.concatenate([bt.unpack(r["a"], np.uint64) for r in by["pair"]])[back].astype(np.int64)
        weight, scale = (np.concatenate([bt.unpack(r[c], np.uint64).view(np.float64) for r in by["backoff"]]) for c in ("a", "b"))
        c, ch = count[token].astype(np.int64), count[history].astype(np.int64)
        one = word(c)
        two = scale[history] * d[np.minimum(times, K + 1)] * times / np.maximum(ch, 1)
        p = np.where(times > 0, two, np.where(np.isnan(weight[history]), one, weight[history] * one))
        first = np.r_[0, np.cumsum(size)[:-1]]
        base = np.log10((c + 1.0) / (word.total + 1.0 * (word.size + 1)))
        return pa.table(
            {
                "doc_id": docs.column("doc_id"), "held_out": docs.column("held"), "n_tokens": pa.array(size), "n_known": pa.array(np.add.reduceat((c > 0).astype(np.int64), first)),
                "train_tokens": pa.array(np.full(len(size), word.total, np.int64)), "base_score": pa.array(np.add.reduceat(base, first)), "score": pa.array(np.add.reduceat(np.log10(p), first)),
            }
        )

    return run


def _sum_stats(answers: DataFrame) -> np.ndarray:
    """Sum of the buckets' counts of counts, added up as columns; one row reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = [bt.unpack(x, np.int64) for x in batch.column(0).to_pylist()]
            if total:
                yield pa.RecordBatch.from_pydict({"s": pa.array([np.sum(total, axis=0).tolist()], pa.list_(pa.int64()))})

    stats = answers.where("kind = 'stat'").select("a").mapInArrow(run, "s array<long>")
    row = stats.agg(*[F.coalesce(F.sum(F.get("s", F.lit(i))), F.lit(0)) for i in range(K + 3)]).first()
    return np.array(list(row), np.int64)


def score(docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Documents where ``held`` is not true are the training text of the model that scores all.  Tokens are the words,
    with A-Z lower-cased, and one end.  ``score`` is the log10 probability of the text, ``base_score`` that of an
    add-one unigram model.  A null or empty text is its end alone; repeated rows count and are scored each time; null
    ids stay null; other columns are ignored; no rows give no rows.
    """
    spark = docs.sparkSession
    rows = texts(docs.withColumn("_held", F.coalesce(held, F.lit(False))), id_col, text_col, "_held")
    parts = _co_located(_parts(rows), "part")
    words = parts.where("kind = 'words'").select("part", "own", "cnt", "n")
    keys = words.agg(F.sum("n")).first()[0] or 0
    buckets = max(parallel(spark), -(-keys // BUCKET))
    asked = words.select("part", "own", "cnt").mapInArrow(_ask_words(buckets), _ASK_SQL)
    found = materialise(asked.groupBy("bucket").applyInArrow(_answer_words, _ANSWER), "words")
    word = Level(_sum_stats(found))
    known = found.where("kind = 'word'")
    pair_buckets = max(parallel(spark), -(-(word.total + 1) // BUCKET))
    hot = max(1000, word.total // (8 * pair_buckets))
    pairs = parts.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(_ask_pairs(pair_buckets, hot), _ASK_SQL)
    counted = materialise(pairs.groupBy("bucket").applyInArrow(_answer_pairs(word), _ANSWER), "pairs")
    d = discounts(_sum_stats(counted))
    weights = known.groupBy("bucket").cogroup(counted.where("kind = 'history'").groupBy("bucket")).applyInArrow(_backoff(d), _ANSWER)
    answers = known.union(counted.where("kind = 'pair'")).union(weights)
    return parts.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(
        _evaluate(word, d, pair_buckets, hot),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
