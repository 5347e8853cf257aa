"""Personal data in whole texts: exact patterns, and a skip-chain conditional random field that adds to them.

The field's variables are the tokens with a digit or ``@``; any other token is outside by definition, so inference falls
apart into the stretches between.  Edges join neighbouring tokens and, however far apart, each token to the next one of
the same text or of the same last digits in the document; both ends share a potential, and loopy belief propagation
brings their labels in line.  The potentials are trained piecewise on what the patterns find in a bounded sample:
node weights by softmax regression, edge tables by smoothed log odds.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from marklens.llm import bytetext as bt
from marklens.llm.tables import texts

# Kinds of the base and their patterns.
BASE = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Kinds that the field adds.
ADDED = tuple(f"crf_{k}" for k in BASE)
KINDS = BASE + ADDED

#: Documents with candidate tokens that the field is trained on, the smallest by hash of their ids.
TRAIN_DOCS = 2000
#: Posterior from which a token is added; rounds and damping of the messages; last digits that make tokens similar.
CERTAIN, ROUNDS, DAMPING, SIMILAR = 0.9, 12, 0.5, 7
_L = 1 + len(BASE)
_FEATURES = 128
_TOKEN = re.compile("[^\x20\x09-\x0d]+")
_EDGE = "\"'.,;:!?<>[]{}"
_MARK = np.zeros(256, bool)
_MARK[[*range(48, 58), ord("@")]] = True


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum(divmod(2 * int(d), 10)[0] + 2 * int(d) % 10 for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the patterns, by start, then kind; leftmost and non-overlapping within a kind."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        if at >= done:
            a = at
            while a > done and text[a - 1] in _LOCAL:
                a -= 1
            m = _DOMAIN.match(text, at + 1) if a < at else None
            if m:
                out.append((a, "email", m.end()))
                done = m.end()
        at = text.find("@", at + 1)
    for m in _IP.finditer(text):
        if all(len(q := p.lstrip("0")) < 4 and int(q or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), "ip", m.end()))
    for m in _CARD.finditer(text):
        digits = re.sub(r"[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), "card", m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), "phone", m.end()))
    return sorted(out, key=lambda s: (s[0], BASE.index(s[1])))


def _shape(t: str) -> int:
    digits = sum(c.isdigit() for c in t)
    if "@" in t:
        return 1
    if t.startswith("+"):
        return 2
    if t.startswith("("):
        return 3
    if t.count(".") == 3 and digits + 3 == len(t):
        return 4
    if digits >= 14:
        return 5
    if digits + t.count("-") == len(t):
        return 6
    return 7


def _features(token: str, before: int, after: int) -> list[int]:
    """Numbers of the active features."""
    digits = re.sub("[^0-9]", "", token)
    n = len(digits)
    size = 0 if n == 0 else 1 if n <= 3 else 2 if n <= 6 else 3 if n <= 9 else 4 if n <= 13 else 5 if n <= 19 else 6
    out = [_shape(token), 8 + size, 16 + min(token.count("."), 4), 24 + min(len(token) // 4, 7), 32 + before, 40 + after]
    out.append(48 + ("-" in token) + 2 * any(c.isalpha() for c in token) + 4 * token.startswith("+"))
    if 14 <= n <= 19:
        out.append(56 + luhn(digits))
    if token.count(".") == 3:
        parts = token.split(".")
        out.append(58 + all(p.isdigit() and len(p) < 4 and int(p) <= 255 for p in parts))
    out.append(64 + 8 * _shape(token) + size)
    return [f for f in out if f < _FEATURES]


class _Graph:
    """Tokens, features, edges and labels of one document."""

    __slots__ = ("spans", "features", "chain", "skip", "labels")

    def __init__(self, text: str, base: list[tuple[int, str, int]]):
        self.spans, shapes, keys, self.chain, self.skip = [], [], [], [], []
        number, where = 0, []
        for m in _TOKEN.finditer(text):
            number += 1
            t = m[0]
            if not any(c == "@" or "0" <= c <= "9" for c in t):
                continue
            left = len(t) - len(t.lstrip(_EDGE))
            t = t.strip(_EDGE)
            if not t:
                continue
            self.spans.append((m.start() + left, m.start() + left + len(t)))
            shapes.append(_shape(t)), keys.append(t), where.append(number)
        near = [i > 0 and where[i] == where[i - 1] + 1 for i in range(len(where))] + [False]
        self.features = [_features(t, shapes[i - 1] if near[i] else 0, shapes[i + 1] if near[i + 1] else 0) for i, t in enumerate(keys)]
        last: dict[str, int] = {}
        for i, t in enumerate(keys):
            if near[i]:
                self.chain.append((i - 1, i))
            digits = re.sub("[^0-9]", "", t)
            for key in {t.lower(), f"#{digits[-SIMILAR:]}" if len(digits) >= SIMILAR and "@" not in t else t.lower()}:
                if key in last and (not near[i] or last[key] != i - 1):
                    self.skip.append((last[key], i))
                last[key] = i
        self.labels = [0] * len(self.spans)
        k = 0
        ordered = sorted(base)
        for i, (a, b) in enumerate(self.spans):
            while k < len(ordered) and ordered[k][2] <= a:
                k += 1
            for s in ordered[k:]:
                if s[0] >= b:
                    break
                if s[2] > a:
                    self.labels[i] = 1 + BASE.index(s[1])
                    break


class Field:
    """Trained potentials, and inference over many documents at once."""

    def __init__(self, node: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.node, self.chain, self.skip = node, chain, skip

    @classmethod
    def train(cls, rows: list) -> Field:
        """``rows``: (features, labels, chain, skip) of documents."""
        x, y, pairs = [], [], {"chain": [], "skip": []}
        for features, labels, chain, skip in rows:
            for name, edges in (("chain", chain), ("skip", skip)):
                pairs[name] += [(labels[a], labels[b]) for a, b in edges]
            for f in features:
                row = np.zeros(_FEATURES, np.float32)
                row[f] = 1
                x.append(row)
            y += labels
        node = np.zeros((_FEATURES, _L))
        if y:
            x, y = np.array(x), np.eye(_L)[y]
            for _ in range(300):
                z = x @ node
                z = np.exp(z - z.max(axis=1, keepdims=True))
                node -= 2.0 * (x.T @ (z / z.sum(axis=1, keepdims=True) - y) / len(x) + 1e-4 * node)
        tables = []
        share = np.array(y).reshape(-1, _L).mean(axis=0) if len(y) else np.full(_L, 1 / _L)
        share = (share + 0.01) / (share + 0.01).sum()
        for name in ("chain", "skip"):
            count = np.zeros((_L, _L))
            np.add.at(count, tuple(np.array(pairs[name], np.int64).reshape(-1, 2).T), 1)
            count = count + count.T if name == "skip" else count
            expected = np.outer(share, share) * max(count.sum(), 1)
            tables.append(np.clip(np.log((count + 1) / (expected + 1)), -3, 3))
        return cls(node, *tables)

    def posteriors(self, graphs: list[_Graph]) -> np.ndarray:
        """Label marginals of all tokens after a fixed number of damped rounds of belief propagation."""
        size = [len(g.spans) for g in graphs]
        start = np.r_[0, np.cumsum(size)[:-1]]
        theta = np.array([self.node[f].sum(axis=0) for g in graphs for f in g.features])
        edges = [(a + o, b + o, 0) for g, o in zip(graphs, start.tolist(), strict=True) for a, b in g.chain]
        edges += [(a + o, b + o, 1) for g, o in zip(graphs, start.tolist(), strict=True) for a, b in g.skip]
        belief = theta
        if edges:
            u, v, kind = np.array(edges).T
            table = np.stack([self.chain, self.skip])[kind]
            # Messages along an edge and against it.
            source, target, w = np.r_[u, v], np.r_[v, u], np.concatenate([table, table.transpose(0, 2, 1)])
            back = np.r_[len(u) + np.arange(len(u)), np.arange(len(u))]
            m = np.zeros((len(source), _L))
            for _ in range(ROUNDS):
                belief = theta.copy()
                np.add.at(belief, target, m)
                out = belief[source] - m[back]
                new = out[:, :, None] + w
                top = new.max(axis=1, keepdims=True)
                new = (top + np.log(np.exp(new - top).sum(axis=1, keepdims=True)))[:, 0]
                new -= new.max(axis=1, keepdims=True)
                m = DAMPING * m + (1 - DAMPING) * new
            belief = theta.copy()
            np.add.at(belief, target, m)
        p = np.exp(belief - belief.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[tuple[int, str]]]]:
    """Ids of a piece, and (number, text) of those of its texts that hold a digit or ``@``."""
    for batch in batches:
        data, bounds = bt.raw(batch.column(1))
        for i, j in bt.pieces(bounds):
            own = data[bounds[i] : bounds[j]]
            hits = np.flatnonzero(_MARK[own])
            docs = np.unique(np.searchsorted(bounds[i : j + 1] - bounds[i], hits, "right") - 1)
            yield batch.column(0).slice(i, j - i), [(int(d), own[bounds[i + d] - bounds[i] : bounds[i + d + 1] - bounds[i]].tobytes().decode()) for d in docs]


def train(docs: DataFrame) -> Field:
    """The field of a corpus (``doc_id``, ``text``); trained on at most ``TRAIN_DOCS`` documents."""
    pairs = pa.list_(pa.list_(pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[int, str]] = []
        for ids, found in _documents(batches):
            keys = bt.mix(ids.fill_null(-1).to_numpy().astype(np.uint64))
            limit = best[-1][0] if len(best) >= TRAIN_DOCS else 1 << 64
            best = sorted(best + [(int(keys[d]), t) for d, t in found if int(keys[d]) < limit])[:TRAIN_DOCS]
        for key, text in best:
            g = _Graph(text, base_spans(text))
            yield pa.RecordBatch.from_arrays(
                [pa.array([key - (1 << 63)]), pa.array([g.features], pairs), pa.array([g.labels], pa.list_(pa.int32())), pa.array([g.chain], pairs), pa.array([g.skip], pairs)],
                names=["key", "features", "labels", "chain", "skip"],
            )

    rows = docs.mapInArrow(run, "key long, features array<array<int>>, labels array<int>, chain array<array<int>>, skip array<array<int>>")
    return Field.train([tuple(r)[1:] for r in rows.orderBy("key").limit(TRAIN_DOCS).collect()])


def _found(field: Field, texts_: list[str]) -> list[list[tuple[int, str, int]]]:
    bases = [base_spans(t) for t in texts_]
    graphs = [_Graph(t, b) for t, b in zip(texts_, bases, strict=True)]
    chosen = [g for g in graphs if g.spans]
    p, at = field.posteriors(chosen) if chosen else np.zeros((0, _L)), 0
    out = []
    for text, base, g in zip(texts_, bases, graphs, strict=True):
        own = p[at : at + len(g.spans)]
        at += len(g.spans)
        added: list[tuple[int, str, int]] = []
        for (a, b), label, row in zip(g.spans, g.labels, own, strict=True):
            k = int(row.argmax())
            if k and not label and row[k] >= CERTAIN:
                if added and added[-1][1] == ADDED[k - 1] and len(text[added[-1][2] : a]) == 1 and not any(s[0] < a and s[2] > added[-1][2] for s in base):
                    a = added.pop()[0]
                added.append((a, ADDED[k - 1], b))
        out.append(sorted(base + added, key=lambda s: (s[0], KINDS.index(s[1]))))
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id`` and ``found``, an array of (kind, start, end) by start, then kind.

    ``field`` defaults to one trained on ``docs``.  Null and empty texts hold nothing; repeated rows are scanned as often
    as they occur; null ids stay null; other columns are ignored; texts of any length are read whole; no rows give no rows.
    """
    rows = texts(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(field if field is not None else train(rows))  # a few thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for ids, marked in _documents(batches):
            found: list[list[dict]] = [[] for _ in range(len(ids))]
            for (d, _), spans in zip(marked, _found(shared.value, [t for _, t in marked]), strict=True):
                found[d] = [{"kind": k, "start": a, "end": b} for a, k, b in spans]
            yield pa.RecordBatch.from_arrays([ids, pa.array(found, kind)], names=["doc_id", "found"])

    return rows.mapInArrow(run, "doc_id long, found array<struct<kind:string,start:long,end:long>>")
