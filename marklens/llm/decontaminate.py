"""Benchmark passages in documents: counted candidates, then longest common subsequence, answer and weight checks.

An item of n words is looked for around every step of every text, in the window from there with n more words on either
side.  It is there if enough of its words and of its answer's follow in order, and if they hold enough of its TF-IDF
weight.  At most n - need words may be missing, so of its rarest words all but that many must lie in the region;
regions are found by counting those, which loses none, and every rule is then checked word by word.

Bounds: the corpus's frequencies are a vector of ``BUCKETS`` counts; they weigh and order words but decide no candidate;
items are compared in blocks of ``BLOCK``, one reading of the corpus each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marklens.llm import bytetext as bt
from marklens.llm.tables import materialise, texts

BUCKETS = 1 << 20
_SLICE = 1 << 16
#: Words from one window's start to the next; a window is three steps.
STEP = 16
WINDOW = 3 * STEP
BLOCK = 4096
#: Rarest words of an item that are counted beyond those that may be missing.
BEYOND = 5
#: Words in more than this share of all passages carry no weight; the share is of the passages and ``PRIOR`` more.
MAX_SHARE, PRIOR = 0.05, 1000
#: Cosine of an item with its own words that lie near the place.
MIN_COSINE = 0.3
#: Shares of an item's and its answer's words that must follow in order; a short item must be there whole.
MIN_COMMON, MIN_ANSWER, SHORT = 0.6, 0.5, 8

_KEEP = np.zeros(256, bool)
_KEEP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _plain_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every lower-cased word without its outer ASCII punctuation."""
    data = bt.LOWER[data]
    start, end = bt.spans(data, bounds)
    kept = np.flatnonzero(_KEEP[data])
    if not len(kept) or not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    a, b = np.searchsorted(kept, start), np.searchsorted(kept, end)
    ok = b > a
    start, end = kept[a[ok]], kept[b[ok] - 1] + 1
    return np.searchsorted(bounds, start, "right") - 1, bt.hashes(data, start, end)


def _words_of(text: str | None) -> np.ndarray:
    return _plain_words(*bt.raw(pa.array([text or ""])))[1]


def _place(doc: np.ndarray) -> np.ndarray:
    """Number of each word within its text."""
    if not len(doc):
        return doc
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    return np.arange(len(doc)) - np.repeat(first, np.diff(np.r_[first, len(doc)]))


def _bucket(words: np.ndarray) -> np.ndarray:
    return (words & np.uint64(BUCKETS - 1)).astype(np.int64)


def statistics(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Passage frequency of every bucket and number of passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            data, bounds = bt.raw(batch.column(1))
            for i, j in bt.pieces(bounds):
                doc, h = _plain_words(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                if not len(doc):
                    continue
                passage = _place(doc) // WINDOW
                number = np.cumsum(np.r_[False, (doc[1:] != doc[:-1]) | (passage[1:] != passage[:-1])])
                pairs = np.unique(number * BUCKETS + _bucket(h))
                np.add.at(count, pairs % BUCKETS, 1)
                total += int(number[-1]) + 1
        for s in np.flatnonzero(count.reshape(-1, _SLICE).any(axis=1)):
            yield _row("count", int(s), bt.pack(count[s * _SLICE : (s + 1) * _SLICE]))
        yield _row("total", total, b"")

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(_SLICE, np.int64)
        for b in group.column("counts").to_pylist():
            total += bt.unpack(b, np.int64)
        return pa.table({"slice": group.column("slice")[:1], "counts": pa.array([bt.pack(total)], pa.binary())})

    found = materialise(docs.mapInArrow(run, "kind string, slice long, counts binary"), "passage-counts")
    summed = found.where("kind = 'count'").groupBy("slice").applyInArrow(add, "slice long, counts binary").collect()
    frequency = np.zeros(BUCKETS, np.int64)
    for r in summed:
        frequency[r["slice"] * _SLICE : (r["slice"] + 1) * _SLICE] = bt.unpack(r["counts"], np.int64)
    total = found.where("kind = 'total'").agg(F.sum("slice")).first()[0] or 0
    return frequency, int(total)


def _row(kind: str, part: int, counts: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([part], pa.int64()), pa.array([counts], pa.binary())], names=["kind", "slice", "counts"])


def weights(frequency: np.ndarray, total: int) -> np.ndarray:
    """Inverse passage frequency of every bucket; none for very common ones."""
    out = np.log((total + 1) / (frequency + 1))
    out[frequency > MAX_SHARE * (total + PRIOR)] = 0
    return np.maximum(out, 0)


class _Item:
    """What verifies one item: its distinct words, how often it has each, and each one's share of the squared weight."""

    def __init__(self, item_id: int, words: np.ndarray, answer: np.ndarray, idf: np.ndarray):
        self.id, self.words, self.answer = item_id, words, answer
        self.distinct, self.times = np.unique(words, return_counts=True)
        square = (self.times * idf[_bucket(self.distinct)]) ** 2
        #: Without weighted words it must be there word after word.
        self.plain = not square.any()
        self.share = square / (square.sum() or 1)
        self.need = len(words) if self.plain or len(words) < SHORT else int(np.ceil(MIN_COMMON * len(words) - 1e-9))

    def verify(self, region: np.ndarray) -> tuple[float, float, float] | None:
        """(cosine, common share, answer share) of a region in which the item is."""
        at = np.minimum(np.searchsorted(self.distinct, region), len(self.distinct) - 1)
        there = np.bincount(at[self.distinct[at] == region], minlength=len(self.distinct))
        if np.minimum(there, self.times).sum() < self.need:
            return None
        if self.plain:
            n = len(self.words)
            starts = np.flatnonzero(region[: len(region) - n + 1] == self.words[0])
            right = _common(self.answer.tolist(), region.tolist()) / len(self.answer)
            return (1.0, 1.0, right) if right >= MIN_ANSWER and any((region[i : i + n] == self.words).all() for i in starts) else None
        cosine = float(np.sqrt(self.share[there > 0].sum()))
        if cosine < MIN_COSINE:
            return None
        text = region.tolist()
        common = _common(self.words.tolist(), text)
        right = _common(self.answer.tolist(), text) / len(self.answer)
        return (round(min(cosine, 1.0), 4), common / len(self.words), right) if common >= self.need and right >= MIN_ANSWER else None


class _Index:
    """The rarest words of a block of benchmark items, and the items for verification; one per block."""

    def __init__(self, frequency: np.ndarray, items: list[_Item]):
        self.items = items
        word, owner, times, self.least, self.reach = [], [], [], [], []
        for k, item in enumerate(items):
            rare = np.argsort(frequency[_bucket(item.distinct)], kind="stable")
            missing = len(item.words) - item.need
            had = np.cumsum(item.times[rare])
            cut = int(np.searchsorted(had, missing + min(BEYOND, item.need))) + 1
            word.append(item.distinct[rare[:cut]]), owner.append(np.full(cut, k)), times.append(item.times[rare[:cut]])
            self.least.append(int(had[cut - 1]) - missing)
            self.reach.append(len(item.words) // STEP + 1)
        word, owner, times = np.concatenate(word), np.concatenate(owner), np.concatenate(times)
        order = np.argsort(word, kind="stable")
        self.vocabulary, first = np.unique(word[order], return_index=True)
        self.first, self.owner, self.times = np.r_[first, len(word)], owner[order], times[order]
        self.least, self.reach = np.array(self.least), np.array(self.reach)
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(self.vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True

    def _regions(self, h: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, step) of the first counted word of every region that may hold the item."""
        hit = np.flatnonzero(self.seen[(h & np.uint64(0xFFFF)).astype(np.int64)])
        slot = np.minimum(np.searchsorted(self.vocabulary, h[hit]), len(self.vocabulary) - 1)
        same = self.vocabulary[slot] == h[hit]
        pairs = np.unique(run[hit[same]] * len(self.vocabulary) + slot[same])
        step, slot = np.divmod(pairs, len(self.vocabulary))
        many = self.first[slot + 1] - self.first[slot]
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - self.first[slot], many)
        span = WINDOW // STEP + 2 * self.reach + 1
        width = int(run[-1]) + 1 + int(span.max()) + 1
        key = self.owner[at] * width + np.repeat(step, many)
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        item, times = key // width, np.r_[0, np.cumsum(self.times[at])]
        end = np.searchsorted(key, key + span[item], "right")
        # Counted with repeats first, and where those are enough, each word once.
        lo = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)] & (times[end] - times[:-1] >= self.least[item]))
        out = [np.zeros(0, np.int64)]
        for part in np.array_split(lo, max(1, len(lo) >> 16)):
            many = end[part] - part
            of = np.repeat(np.arange(len(part)), many)
            once = np.unique(of * len(self.times) + at[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - part, many)])
            had = np.bincount(once // len(self.times), self.times[once % len(self.times)], minlength=len(part))
            out.append(part[had >= self.least[item[part]]])
        lo = np.concatenate(out)
        return item[lo], key[lo] % width

    def matches(self, data: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, float, float, float, int]]:
        """(text, item, cosine, common share, answer share, first word) of what is verified; per text and item the best."""
        doc, h = _plain_words(data, bounds)
        if not len(doc):
            return []
        step = _place(doc) // STEP
        new = np.r_[True, (doc[1:] != doc[:-1]) | (step[1:] != step[:-1])]
        first, run = np.flatnonzero(new), np.cumsum(new) - 1
        of = doc[first]
        text_start, text_end = np.searchsorted(doc, of, "left"), np.searchsorted(doc, of, "right")
        item, at = self._regions(h, run)
        back = self.reach[item] + WINDOW // STEP
        many = back + self.reach[item] + 1
        near = np.repeat(at - back, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        inside = (near >= 0) & (near < len(first))
        near, item, at = near[inside], np.repeat(item, many)[inside], np.repeat(at, many)[inside]
        same = of[near] == of[at]
        best: dict[tuple[int, int], tuple] = {}
        for pair in np.unique(item[same] * len(first) + near[same]).tolist():
            k, w = divmod(pair, len(first))
            key = (int(of[w]), k)
            if key in best and best[key][1:3] == (1.0, 1.0):
                continue
            n = len(self.items[k].words)
            a, b = max(text_start[w], first[w] - n), min(text_end[w], first[w] + WINDOW + n)
            found = self.items[k].verify(h[a:b])
            if found and (key not in best or found[1:] > best[key][1:3]):
                best[key] = (*found, int(a - text_start[w]))
        return [(d, self.items[k].id, *v) for (d, k), v in sorted(best.items())]


def _common(pattern: list[int], text: list[int]) -> int:
    """Length of the longest common subsequence, a word of the text per step on a bit vector."""
    mask: dict[int, int] = {}
    for i, w in enumerate(pattern):
        mask[w] = mask.get(w, 0) | 1 << i
    full = (1 << len(pattern)) - 1
    v = full
    for w in text:
        u = v & mask.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(pattern) - v.bit_count()


def _answer(text: str, given: str | None) -> np.ndarray:
    """The stated answer, or else the last sentence; of a very short one, the last five words of the text."""
    words = _words_of(given)
    if not len(words):
        parts = [p for p in text.replace("!", ".").replace("?", ".").replace("\n", " ").split(". ") if len(_words_of(p))]
        words = _words_of(parts[-1]) if parts else words
    return words if len(words) >= 3 else _words_of(text)[-5:]


def indexes(docs: DataFrame, benchmark: DataFrame, answer_col: str | None = None) -> list[_Index]:
    """What the tasks need to search, one per block of benchmark items."""
    frequency, total = statistics(docs)
    idf = weights(frequency, total)
    rows = benchmark.select("item_id", "text", F.col(answer_col) if answer_col else F.lit(None).cast("string").alias("answer"))
    out, block = [], []
    for r in rows.orderBy("item_id").toLocalIterator():
        words = _words_of(r[1])
        if not len(words):
            continue
        block.append(_Item(r[0], words, _answer(r[1], r[2]), idf))
        if len(block) >= BLOCK:
            out.append(_Index(frequency, block))
            block = []
    if block:
        out.append(_Index(frequency, block))
    return out


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", answer_col: str | None = None) -> DataFrame:
    """One row per document and benchmark item found in it: ``doc_id, item_id, cosine, common, answer, first_word``.

    ``cosine`` is that of the item with its own words near the place (1 for an item of common words only); ``common`` and ``answer`` are the shares of the item's and its answer's words that follow in order near the place.
    Null and empty texts hold nothing, and items without words are in nothing; repeated rows are reported as often as
    they occur; null ids on either side are reported with null ids; other columns are ignored; an empty table on either side gives no rows.
    """
    rows = texts(docs, id_col, text_col)
    out = None
    for index in indexes(rows, benchmark, answer_col):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, bounds = bt.raw(batch.column(1))
                ids = batch.column(0).to_pylist()
                for i, j in bt.pieces(bounds):
                    found = shared.value.matches(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                    if found:
                        d, item, cosine, common, right, at = zip(*found, strict=True)
                        yield pa.RecordBatch.from_pydict(
                            {"doc_id": pa.array([ids[i + k] for k in d], pa.int64()), "item_id": pa.array(item, pa.int64()), "cosine": pa.array(cosine), "common": pa.array(common), "answer": pa.array(right), "first_word": pa.array(at, pa.int64())}
                        )

        part = rows.mapInArrow(run, "doc_id long, item_id long, cosine double, common double, answer double, first_word long")
        out = part if out is None else out.union(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], "doc_id long, item_id long, cosine double, common double, answer double, first_word long")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id", answer_col: str | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, in which no benchmark item is found, with an id or without; each row is judged by its own text."""
    for index in indexes(texts(docs, id_col, text_col), benchmark, answer_col):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        place = docs.columns.index(text_col)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, place=place) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, bounds = bt.raw(batch.column(place))
                keep = np.ones(batch.num_rows, bool)
                for i, j in bt.pieces(bounds):
                    for m in shared.value.matches(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]):
                        keep[i + m[0]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
