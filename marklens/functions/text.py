"""Sentence and token arrays of one text, and diversity measures over ordered words."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed patterns: a sentence runs to a terminator before white space or the end; a token is a run of
# letters, a run of digits, or one other sign, with the space after it.
SENTENCE_PATTERN = r"(?s).*?[.!?](?:\s+|\z)|.+\z"
TOKEN_PATTERN = r"(?:\p{L}+|\p{N}+|[^\s\p{L}\p{N}])\s?"
MTLD_THRESHOLD, MTLD_MIN_TOKENS, WINDOW = 0.72, 10, 50


def sentences(clean: Column) -> Column:
    """Sentence pieces that cover the text, trailing space included."""
    return F.regexp_extract_all(clean, F.lit(SENTENCE_PATTERN), F.lit(0))


def tokens(clean: Column) -> Column:
    """array<struct<sent_id, sent_pos, piece>> in text order; pieces cover the text."""
    return F.flatten(
        F.transform(
            sentences(clean),
            lambda p, i: F.transform(
                F.regexp_extract_all(p, F.lit(TOKEN_PATTERN), F.lit(0)),
                lambda t, j: F.struct(i.alias("sent_id"), j.alias("sent_pos"), t.alias("piece")),
            ),
        )
    )


def fold_word(word: Column) -> Column:
    """Case-folded word; the sharp s folds to two letters."""
    return F.replace(F.lower(word), F.lit("ß"), F.lit("ss"))


def is_alpha(word: Column) -> Column:
    return word.rlike(r"^\p{L}+$")


def _window_diversity(codes: np.ndarray, window: int) -> float:
    """Mean share of distinct words over all windows.

    A position counts in every window in which it is the first of its word, so the total is a sum
    over positions of the number of window starts after the word's previous position.
    """
    n = len(codes)
    if n == 0:
        return 0.0
    w = min(window, n)
    order = np.argsort(codes, kind="stable")
    previous = np.full(n, -1)
    same = codes[order][1:] == codes[order][:-1]
    previous[order[1:][same]] = order[:-1][same]
    at = np.arange(n)
    first = np.maximum(np.maximum(previous + 1, at - w + 1), 0)
    last = np.minimum(at, n - w)
    total = np.maximum(last - first + 1, 0).sum()
    return float(total / (w * (n - w + 1)))


def _mtld_side(codes, threshold: float) -> float:
    factors, seen, count, ratio = 0.0, set(), 0, 1.0
    for c in codes:
        count += 1
        seen.add(c)
        ratio = len(seen) / count
        if ratio <= threshold:
            factors, seen, count = factors + 1, set(), 0
    if count:
        factors += (1 - ratio) / (1 - threshold)
    if factors == 0:
        factors = 1.0  # every word distinct
    return len(codes) / factors


def _mtld(codes: np.ndarray, threshold: float, minimum: int) -> float:
    """Bidirectional measure of textual lexical diversity (McCarthy and Jarvis 2010)."""
    if len(codes) < minimum:
        return 0.0
    seq = codes.tolist()
    return (_mtld_side(seq, threshold) + _mtld_side(seq[::-1], threshold)) / 2


def _codes(words) -> np.ndarray:
    return pd.factorize(np.asarray(words, dtype=object))[0] if len(words) else np.empty(0, dtype=int)


_PROFILE = T.StructType(
    [T.StructField("words", T.LongType()), T.StructField("letters", T.LongType()), T.StructField("mtld", T.DoubleType()), T.StructField("mattr", T.DoubleType())]
)


@F.pandas_udf(_PROFILE)
def diversity(words: pd.Series) -> pd.DataFrame:
    """Count, letters, MTLD and moving-average type-token ratio of ordered words, case-folded."""
    rows = []
    for ws in words:
        ws = [w.casefold() for w in ws] if ws is not None else []
        codes = _codes(ws)
        mattr = _window_diversity(codes, WINDOW) if len(codes) >= 2 else 0.0
        rows.append((len(codes), sum(map(len, ws)), _mtld(codes, MTLD_THRESHOLD, MTLD_MIN_TOKENS), mattr))
    return pd.DataFrame(rows, columns=_PROFILE.names)


@F.pandas_udf(T.DoubleType())
def window_diversity(words: pd.Series) -> pd.Series:
    """Moving-average type-token ratio; a single word counts as 1, no word as 0."""
    return words.map(lambda ws: _window_diversity(_codes(ws if ws is not None else ()), WINDOW))


def _depth(index: np.ndarray, heads: np.ndarray, alpha: np.ndarray) -> int:
    parent = dict(zip(index.tolist(), heads.tolist()))
    known: dict[int, int] = {}
    best = 0
    for start, ok in zip(index.tolist(), alpha.tolist()):
        if not ok:
            continue
        path, seen, node = [], {start}, start
        while node not in known:
            head = parent.get(node, node)
            if head == node:
                known[node] = 0
                break
            if head in seen:  # a cycle: stop here and remember nothing that leads into it
                break
            path.append(node)
            seen.add(head)
            node = head
        if node in known:
            depth = known[node]
            for p in reversed(path):
                depth += 1
                known[p] = depth
            best = max(best, known[start])
        else:
            best = max(best, len(path))
    return best


def _depths(sentence: np.ndarray, index: np.ndarray, heads: np.ndarray, alpha: np.ndarray) -> float:
    """Mean over sentences of the deepest alphabetic token; ``sentence`` rises, tokens are numbered within the document."""
    n = len(index)
    first = np.flatnonzero(np.r_[True, sentence[1:] != sentence[:-1]])
    order = np.argsort(index, kind="stable")
    at = np.minimum(np.searchsorted(index, heads, sorter=order), n - 1)
    parent = order[at]
    parent = np.append(np.where((index[parent] == heads) & (sentence[parent] == sentence), parent, n), n)  # n: a head outside the sentence
    depth = np.append(heads != index, False).astype(np.int64)
    for _ in range(n.bit_length() + 1):  # every step doubles how far up a token has looked
        depth, parent = depth + depth[parent], parent[parent]
    depth, top = depth[:-1], depth[parent[:-1]]
    whole = np.maximum.reduceat(np.where(alpha, depth, 0), first)
    lost = top > 0  # what does not end in a root leads into a cycle
    if lost.any():
        ends = np.r_[first[1:], n]
        for k in np.unique(np.searchsorted(first, np.flatnonzero(lost), "right") - 1):
            part = slice(first[k], ends[k])
            whole[k] = _depth(index[part], heads[part], alpha[part])
    return float(whole.mean())


@F.pandas_udf(T.DoubleType())
def mean_tree_depth(sentence: pd.Series, index: pd.Series, heads: pd.Series, alpha: pd.Series) -> pd.Series:
    """Mean over a document's sentences of the deepest alphabetic token."""
    return pd.Series([_depths(*map(np.asarray, x)) for x in zip(sentence, index, heads, alpha)], dtype=float)


@F.pandas_udf(T.ArrayType(T.LongType()))
def starts(lengths: pd.Series) -> pd.Series:
    """Where each of adjoining pieces starts."""
    return lengths.map(lambda x: np.cumsum(x, dtype=np.int64) - x)


@F.pandas_udf(T.DoubleType())
def untouched(start: pd.Series, end: pd.Series, offset: pd.Series, stop: pd.Series) -> pd.Series:
    """Share of a document's sentences, in text order, that no span overlaps."""
    out = []
    for s, e, a, b in zip(start, end, offset, stop):
        low, high = np.searchsorted(e, a, "right"), np.searchsorted(s, b, "left")
        some = low < high
        steps = np.zeros(len(s) + 1, np.int64)
        np.add.at(steps, low[some], 1)
        np.add.at(steps, high[some], -1)
        out.append(1 - np.count_nonzero(np.cumsum(steps)[:-1]) / len(s))
    return pd.Series(out, dtype=float)


@F.pandas_udf(T.IntegerType())
def tree_depth(index: pd.Series, heads: pd.Series, alpha: pd.Series) -> pd.Series:
    """Largest number of steps from an alphabetic token to its root, per sentence."""
    out = [_depth(np.asarray(i), np.asarray(h), np.asarray(a)) for i, h, a in zip(index, heads, alpha)]
    return pd.Series(out, dtype="int32")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def prefix_rests(weights: pd.Series, threshold: pd.Series) -> pd.Series:
    """Length of what follows each leading term, up to the term after which it is below the threshold."""
    out = []
    for w, t in zip(weights, threshold):
        tail = np.cumsum((w * w)[::-1])[::-1]  # this term and all after it
        k = int(np.count_nonzero(tail >= t * t - 1e-9))
        out.append(np.sqrt(np.append(tail[1:], 0.0))[: max(k, 1)])
    return pd.Series(out)
