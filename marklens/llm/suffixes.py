"""Exact removal of byte strings that occur more than once, over sorted suffix runs.

Every 400-byte window of a text names one place inside it, where the hash of the 200 bytes from there is least.  Equal
windows name equal places, so windows whose 200 bytes occur once in all texts are unique, and only the others go on.
Neighbouring windows that name the same place form one suffix, cut to the bytes those windows cover.

1. Parts of about ``PART`` bytes are written, bucketed by part, with their windows' places; hashes are counted.
2. Each part sorts its remaining suffixes into one run without doubles, front-codes it and deals it over ranges of
   strings.  A range merges its runs in a loser tree that compares two strings only behind what both share with the
   last winner, and takes from each neighbour how many windows, from the first on, occur again.
3. Windows that are not settled so lie at the left edge of a repeat.  Suffixes that share their hash with such a one
   have their windows counted by 64-bit hashes, once per part.

A string is sent once per part however often it occurs, and answers go back by place, so no copy group meets in one task.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marklens.llm import bytetext as bt
from marklens.llm.tables import materialise, parallel, texts
from marklens.session import scratch_dir

LENGTH = 400
PART = 6 << 20
#: Suffixes from which a range of strings is made, about; sampled strings per part and in all.
RANGE, SAMPLED, SAMPLES = 60_000, 64, 8192
_SEGMENT = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_tables: list[np.ndarray] = []


def _rolling(data: np.ndarray, size: int) -> np.ndarray:
    """Mixed hash of the ``size`` bytes from every place on."""
    if not _tables:
        steps = np.full(_SEGMENT + 4 * LENGTH + 1, _BASE)
        back = np.full(len(steps), _BACK)
        steps[0] = back[0] = 1
        _tables.extend([np.cumprod(steps), np.cumprod(back)])
    out, reach = [], len(_tables[0]) - 1 - size
    for lo in range(0, max(0, len(data) - size + 1), reach):
        own = (data[lo : lo + reach + size - 1].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        run = np.cumsum(own * _tables[0][: len(own)])
        run = np.concatenate([np.zeros(1, np.uint64), run])
        out.append(bt.mix((run[size:] - run[:-size]) * _tables[1][: len(run) - size]))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def suffixes(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and hash of every suffix, in order; windows lie inside one text."""
    half = length // 2
    span = length - half + 1
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(data) < length:
        return none
    firsts, places, hashes = [], [], []
    end = np.repeat(bounds[1:], np.diff(bounds))
    for lo in range(0, len(data) - length + 1, _SEGMENT):
        h = _rolling(data[lo : lo + _SEGMENT + length - 1], half)
        best, at = h, np.arange(lo, lo + len(h))
        width = 1
        while width < span:  # least of the first ``width`` places, doubled; the leftmost of equals
            step = min(width, span - width)
            less = best[step:] < best[:-step]
            best, at = np.where(less, best[step:], best[:-step]), np.where(less, at[step:], at[:-step])
            width += step
        first = np.arange(lo, lo + len(best))
        inside = first + length <= end[first]
        firsts.append(first[inside]), places.append(at[inside]), hashes.append(best[inside])
    first, at, h = np.concatenate(firsts), np.concatenate(places), np.concatenate(hashes)
    if not len(first):
        return none
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (first[1:] != first[:-1] + 1)])
    return first[new], np.diff(np.r_[new, len(first)]), h[new]


_PARTS = "kind string, part long, row int, doc_id long, a binary, b binary, c binary"
_ASK = "bucket int, part long, keys binary, cnt binary"
_ANSWER = "kind string, part long, bucket int, a binary"
_PART_TYPES = [("kind", pa.string()), ("part", pa.int64()), ("row", pa.int32()), ("doc_id", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())]
_ASK_TYPES = [("bucket", pa.int32()), ("part", pa.int64()), ("keys", pa.binary()), ("cnt", pa.binary())]
_ANSWER_TYPES = [("kind", pa.string()), ("part", pa.int64()), ("bucket", pa.int32()), ("a", pa.binary())]


def _table(rows: list[tuple], types) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(types)
    return pa.table({n: pa.array(c, t) for c, (n, t) in zip(columns, types, strict=True)})


def _parts(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, chunk, held, size, squeeze = TaskContext.get().partitionId(), 0, [], 0, zstandard.ZstdCompressor(level=3)

        def flush() -> pa.Table:
            part = task << 24 | chunk
            rows, found, at, row = [], [], 0, 0
            for ids, data, bounds in held:
                first, count, h = suffixes(data, bounds, length)
                found.append((first + at, count, h))
                for k, i in enumerate(ids):
                    rows.append(("doc", part, row, i, squeeze.compress(data[bounds[k] : bounds[k + 1]].tobytes()), None, None))
                    row += 1
                at += len(data)
            first, count, h = (np.concatenate(x) for x in zip(*found, strict=True))
            rows.append(("places", part, -1, len(first), bt.pack(first.astype(np.uint64), True), bt.pack(count.astype(np.uint32)), bt.pack(h)))
            return _table(rows, _PART_TYPES)

        for batch in batches:
            data, bounds = bt.raw(batch.column(1))
            for i, j in bt.pieces(bounds):
                held.append((batch.column(0).slice(i, j - i).to_pylist(), data[bounds[i] : bounds[j]].copy(), bounds[i : j + 1] - bounds[i]))
                size += int(bounds[j] - bounds[i])
                if size >= PART:
                    yield from flush().to_batches()
                    held, size, chunk = [], 0, chunk + 1
        if held:
            yield from flush().to_batches()

    df = docs.mapInArrow(run, _PARTS)
    spark, name = docs.sparkSession, f"marklens_suffixes_{uuid.uuid4().hex}"
    df.write.bucketBy(parallel(spark), "part").option("path", f"{scratch_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _asks(part: int, keys: np.ndarray, count: np.ndarray, buckets: int) -> pa.Table:
    """Sorted distinct keys with counts, in blocks by bucket."""
    edges = np.searchsorted(_bucket(keys, buckets), np.arange(buckets + 1))
    rows = [(int(b), part, bt.pack(keys[x:y], True), bt.pack(count[x:y].astype(np.uint32))) for b, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if y > x]
    return _table(rows, _ASK_TYPES)


def _flagged(asks: DataFrame, kind: str, least: int) -> DataFrame:
    """For every key of every part whether its counts over all parts come to ``least``, as bits in the keys' order."""

    def run(group: pa.Table) -> pa.Table:
        keys = [bt.unpack(x, np.uint64, True) for x in group.column("keys").to_pylist()]
        count = np.concatenate([bt.unpack(x, np.uint32) for x in group.column("cnt").to_pylist()])
        _, back = np.unique(np.concatenate(keys), return_inverse=True)
        enough = (np.bincount(back, weights=count) >= least)[back]
        rows, at = [], 0
        for part, bucket, k in zip(group.column("part").to_pylist(), group.column("bucket").to_pylist(), keys, strict=True):
            rows.append((kind, part, bucket, len(k).to_bytes(8, "little") + zstandard.compress(np.packbits(enough[at : at + len(k)]).tobytes())))
            at += len(k)
        return _table(rows, _ANSWER_TYPES)

    return materialise(asks.groupBy("bucket").applyInArrow(run, _ANSWER), kind)


def _bits(answers: list[dict], kind: str) -> np.ndarray:
    out = [np.zeros(0, bool)]
    for r in sorted((r for r in answers if r["kind"] == kind), key=lambda r: r["bucket"]):
        n = int.from_bytes(r["a"][:8], "little")
        out.append(np.unpackbits(np.frombuffer(zstandard.decompress(r["a"][8:]), np.uint8), count=n).astype(bool))
    return np.concatenate(out)


class _Part:
    """A part's texts and suffixes, and what the answers so far say about them."""

    def __init__(self, table: pa.Table, answers: pa.Table | None, length: int):
        kind = np.array(table.column("kind").to_pylist())
        places = table.filter(pa.array(kind == "places")).to_pylist()[0]
        docs = table.filter(pa.array(kind == "doc")).sort_by("row")
        self.part, self.length = places["part"], length
        open_ = zstandard.ZstdDecompressor()
        self.ids = docs.column("doc_id").to_pylist()
        bodies = [open_.decompress(x) for x in docs.column("a").to_pylist()]
        self.bounds = np.r_[0, np.cumsum([len(x) for x in bodies])].astype(np.int64)
        self.text = b"".join(bodies)
        self.first, self.count, self.hash = bt.unpack(places["a"], np.uint64, True).astype(np.int64), bt.unpack(places["b"], np.uint32).astype(np.int64), bt.unpack(places["c"], np.uint64)
        self.answers = answers.to_pylist() if answers is not None else []

    def live(self) -> np.ndarray:
        """Suffixes whose hash occurs again."""
        _, back = np.unique(self.hash, return_inverse=True)
        return np.flatnonzero(_bits(self.answers, "hash")[back]) if len(self.hash) else np.zeros(0, np.int64)

    def run(self) -> tuple[list[bytes], list[int], np.ndarray, np.ndarray]:
        """The distinct remaining suffixes in order, how often each occurs here, the suffixes and their places in the order."""
        live = self.live()
        spans = zip(self.first[live].tolist(), (self.first[live] + self.count[live] + self.length - 1).tolist(), strict=True)
        strings = [self.text[a:b] for a, b in spans]
        order: dict[bytes, int] = {}
        for s in strings:
            order[s] = order.get(s, 0) + 1
        ranked = sorted(order)
        place = {s: i for i, s in enumerate(ranked)}
        return ranked, [order[s] for s in ranked], live, np.array([place[s] for s in strings], np.int64)

    def settled(self) -> tuple[np.ndarray, np.ndarray]:
        """The remaining suffixes and how many of their windows, from the first on, are known to occur again."""
        _, _, live, place = self.run()
        known = [np.zeros(0, np.uint32)]
        for r in sorted((r for r in self.answers if r["kind"] == "run"), key=lambda r: r["bucket"]):
            known.append(bt.unpack(r["a"], np.uint32))
        return live, np.concatenate(known)[place].astype(np.int64) if len(live) else np.zeros(0, np.int64)

    def window_keys(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First byte and hash of every window of the chosen suffixes."""
        first, count = self.first[chosen], self.count[chosen]
        if not len(first):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.repeat(first - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
        size = count + self.length - 1
        flat = np.frombuffer(b"".join(self.text[a:b] for a, b in zip(first.tolist(), (first + size).tolist(), strict=True)), np.uint8)
        start = np.r_[0, np.cumsum(size)[:-1]]
        return at, _rolling(flat, self.length)[np.repeat(start - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())]


def _lcp(x: bytes, y: bytes, at: int) -> int:
    """Length of the common prefix, of which ``at`` bytes are known."""
    end = min(len(x), len(y))
    step = 16
    while at < end:
        stop = min(at + step, end)
        if x[at:stop] == y[at:stop]:
            at, step = stop, 2 * step
        elif stop - at == 1:
            return at
        else:
            step = max(1, (stop - at) // 2)
            end_here = at + step
            if x[at:end_here] == y[at:end_here]:
                at = end_here
    return at


def _front_coded(strings: list[bytes], times: list[int]) -> bytes:
    """Lengths shared with the string before, lengths of the rest, counts and the rests, compressed."""
    shared, rest, last = [], [], b""
    for s in strings:
        n = _lcp(last, s, 0)
        shared.append(n), rest.append(s[n:])
        last = s
    head = np.array([shared, [len(r) for r in rest], times], np.uint32)
    return len(strings).to_bytes(8, "little") + zstandard.compress(head.tobytes() + b"".join(rest), 3)


def _decoded(block: bytes) -> Iterator[tuple[bytes, int, int]]:
    """(string, bytes shared with the one before, count) in order."""
    n = int.from_bytes(block[:8], "little")
    body = zstandard.decompress(block[8:])
    shared, size, times = np.frombuffer(body[: 12 * n], np.uint32).reshape(3, n).tolist()
    at, last = 12 * n, b""
    for h, m, t in zip(shared, size, times, strict=True):
        last = last[:h] + body[at : at + m]
        at += m
        yield last, h, t


def merged(runs: list[Iterator[tuple[bytes, int, int]]]) -> Iterator[tuple[int, int, int, int]]:
    """(run, length, bytes shared with the string before in the whole order, count) of all strings in order.

    A tree of losers: every waiting string knows what it shares with the last winner.  Of two, the one that shares more
    is less; only if both share the same are they compared, and from there on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    strings: list[bytes | None] = [None] * k
    shared, times = [0] * k, [0] * k

    def load(r: int) -> None:
        x = next(runs[r], None) if r < len(runs) else None
        strings[r], shared[r], times[r] = x if x is not None else (None, 0, 0)

    def less(a: int, b: int) -> int:
        """The winner of two runs; the loser's shared length is then that with the winner."""
        x, y = strings[a], strings[b]
        if x is None:
            return b
        if y is None:
            return a
        if shared[a] != shared[b]:
            return a if shared[a] > shared[b] else b
        n = _lcp(x, y, shared[a])
        first = n == len(x) or (n < len(y) and x[n] < y[n])
        shared[b if first else a] = n
        return a if first else b

    for r in range(k):
        load(r)
    losers, level = [0] * k, list(range(k))
    while len(level) > 1:
        base, up = len(level) // 2, []
        for i in range(base):
            a, b = level[2 * i], level[2 * i + 1]
            w = less(a, b)
            losers[base + i] = b if w == a else a
            up.append(w)
        level = up
    win = level[0]
    while strings[win] is not None:
        yield win, len(strings[win]), shared[win], times[win]
        load(win)
        node = (win + k) // 2
        while node >= 1:
            w = less(win, losers[node])
            if w != win:
                losers[node], win = win, w
            node //= 2


def _merge(length: int):
    """For every string of every run of a range, how many of its windows, from the first on, occur again."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        known: list[list[int]] = [[] for _ in rows]
        before, before_size = None, 0
        for r, size, shared, times in merged([_decoded(x["a"]) for x in rows]):
            windows = size - length + 1 if times > 1 else max(0, shared - length + 1)
            known[r].append(windows)
            if before is not None and shared >= length:
                own = known[before]
                at = -1 if before != r else -2
                own[at] = max(own[at], min(shared, before_size) - length + 1)
            before, before_size = r, size
        out = [("run", x["part"], x["bucket"], bt.pack(np.array(k, np.uint32))) for x, k in zip(rows, known, strict=True)]
        return _table(out, _ANSWER_TYPES)

    return run


def deduplicate(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_bytes, removed, kept``.

    ``removed`` is an array of (start, end) of the maximal byte runs covered by strings of ``length`` bytes that also
    start elsewhere in any text; ``kept`` holds the other bytes.  A null text is an empty one; texts shorter than
    ``length`` stay whole; repeated rows are texts like others, so all of them go where they are long enough; null ids
    stay null; other columns are ignored; no rows give no rows.
    """
    spark = docs.sparkSession
    parts = _parts(texts(docs, id_col, text_col), length)
    buckets = parallel(spark)
    total = parts.where("kind = 'places'").agg(F.sum("doc_id")).first()[0] or 0
    ranges = max(buckets, -(-total // RANGE))

    def ask_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys, count = np.unique(bt.unpack(c, np.uint64), return_counts=True)
                yield from _asks(part, keys, count, buckets).to_batches()

    hashes = _flagged(parts.where("kind = 'places'").select("part", "c").mapInArrow(ask_hashes, _ASK), "hash", 2)

    def by_part(answers: DataFrame, function, schema: str) -> DataFrame:
        return parts.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(function, schema)

    def sample(table: pa.Table, answers: pa.Table) -> pa.Table:
        p = _Part(table, answers, length)
        live = p.live()
        live = live[np.argsort(bt.mix(p.hash[live] ^ bt.mix(np.array([p.part], np.uint64))))[:SAMPLED]]
        spans = [(p.text[a : a + c + length - 1], a) for a, c in zip(p.first[live].tolist(), p.count[live].tolist(), strict=True)]
        return pa.table({"key": pa.array([s for s, _ in spans], pa.binary()), "at": pa.array([a for _, a in spans], pa.int64())})

    drawn = by_part(hashes, sample, "key binary, at long").orderBy(F.xxhash64("key", "at")).limit(SAMPLES).select("key").collect()
    drawn = sorted(bytes(r["key"]) for r in drawn)
    cuts = sorted({drawn[len(drawn) * i // ranges] for i in range(1, ranges)}) if drawn else []

    def send(table: pa.Table, answers: pa.Table) -> pa.Table:
        from bisect import bisect_left

        p = _Part(table, answers, length)
        strings, times, _, _ = p.run()
        edges = [0, *(bisect_left(strings, c) for c in cuts), len(strings)]
        return _table([("run", p.part, b, _front_coded(strings[x:y], times[x:y])) for b, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if y > x], _ANSWER_TYPES)

    runs = materialise(by_part(hashes, send, _ANSWER).groupBy("bucket").applyInArrow(_merge(length), _ANSWER), "runs")

    def ask_open(table: pa.Table, answers: pa.Table) -> pa.Table:
        p = _Part(table, answers, length)
        live, known = p.settled()
        keys, back = np.unique(p.hash[live], return_inverse=True)
        return _asks(p.part, keys, np.bincount(back, weights=known < p.count[live], minlength=len(keys)), buckets)

    opened = _flagged(by_part(hashes.union(runs), ask_open, _ASK), "open", 1)

    def windows_of(p: _Part) -> tuple[np.ndarray, np.ndarray]:
        live = p.live()
        _, back = np.unique(p.hash[live], return_inverse=True)
        return p.window_keys(live[_bits(p.answers, "open")[back]] if len(live) else live)

    def ask_windows(table: pa.Table, answers: pa.Table) -> pa.Table:
        p = _Part(table, answers, length)
        keys, count = np.unique(windows_of(p)[1], return_counts=True)
        return _asks(p.part, keys, count, buckets)

    counted = _flagged(by_part(hashes.union(opened), ask_windows, _ASK), "window", 2)

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        p = _Part(table, answers, length)
        live, known = p.settled()
        at, keys = windows_of(p)
        again = at[_bits(p.answers, "window")[np.unique(keys, return_inverse=True)[1]]] if len(at) else at
        some = known > 0
        lo = np.r_[p.first[live][some], again]
        hi = np.r_[(p.first[live] + known)[some] - 1, again] + length
        order = np.argsort(lo, kind="stable")
        lo, hi = lo[order], np.maximum.accumulate(hi[order]) if len(order) else hi
        doc = np.searchsorted(p.bounds, lo, "right") - 1
        new = np.flatnonzero(np.r_[True, (lo[1:] > hi[:-1]) | (doc[1:] != doc[:-1])]) if len(lo) else np.zeros(0, np.int64)
        starts, ends, owner = lo[new], hi[np.r_[new[1:], len(lo)] - 1] if len(new) else lo, doc[new]
        removed: list[list[dict]] = [[] for _ in p.ids]
        kept, done = [], p.bounds[:-1].tolist()
        pieces: list[list[bytes]] = [[] for _ in p.ids]
        for a, b, d in zip(starts.tolist(), ends.tolist(), owner.tolist(), strict=True):
            removed[d].append({"start": a - int(p.bounds[d]), "end": b - int(p.bounds[d])})
            pieces[d].append(p.text[done[d] : a])
            done[d] = b
        for d, end in enumerate(p.bounds[1:].tolist()):
            kept.append(b"".join([*pieces[d], p.text[done[d] : end]]))
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({"doc_id": pa.array(p.ids, pa.int64()), "n_bytes": pa.array(np.diff(p.bounds)), "removed": pa.array(removed, span), "kept": pa.array(kept, pa.binary())})

    return by_part(hashes.union(runs).union(opened).union(counted), finish, "doc_id long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary")
