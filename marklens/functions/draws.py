"""Random numbers as functions of (seed, replicate, key), and draws from exact laws by inversion.

The hash works in integers below the prime P = 2^31 - 1, where x -> x^5 is a bijection, so that numpy and any SQL engine
with 64-bit integers agree on every number.  Laws are tables around their mode whose size grows with the spread of the
law, not with the population.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

P = 2**31 - 1
#: Offsets that tell keys from replicates.
KEY_OFFSET, REP_OFFSET = 742_938_285, 1_343_714_438
#: Standard deviations around the mode; the mass beyond is far below the resolution of a draw.
REACH = 10.0


def _folded(x: np.ndarray, spare: np.ndarray) -> None:
    """Bring x, in place, to at most P + 5 without changing it mod P: P is a Mersenne prime, so two folds do."""
    for _ in range(2):
        np.right_shift(x, np.uint64(31), out=spare)
        np.bitwise_and(x, np.uint64(P), out=x)
        np.add(x, spare, out=x)


def _fifth(x: np.ndarray) -> np.ndarray:
    """x^5 mod P for x below 2P."""
    y = x * x
    spare = np.empty_like(y)
    _folded(y, spare)
    np.multiply(y, y, out=y)
    _folded(y, spare)
    np.multiply(y, x, out=y)
    _folded(y, spare)
    np.subtract(y, np.uint64(P), out=spare)  # wraps to a huge number below P
    return np.minimum(y, spare, out=y)


def mixed(value: np.ndarray, offset: int) -> np.ndarray:
    """Two rounds over ``value + offset``; values are not negative."""
    x = (np.asarray(value).astype(np.uint64) % np.uint64(P) + np.uint64(offset % P)) % np.uint64(P)
    return _fifth(_fifth(x) + np.uint64(1))


def key_part(key: np.ndarray, seed: int) -> np.ndarray:
    """What the numbers of a key share over all replicates."""
    return mixed(key, KEY_OFFSET + seed)


def numbers(part: np.ndarray, rep: np.ndarray) -> np.ndarray:
    """Whole numbers 0..P-1 of keys, given by their ``key_part``, and replicates; (number + 0.5) / P is uniform."""
    return _fifth(part + mixed(rep, REP_OFFSET))


def uniform(key: np.ndarray, rep: np.ndarray, seed: int) -> np.ndarray:
    """Uniforms in (0, 1) at the points (i + 0.5) / P; ``key`` and ``rep`` broadcast against each other."""
    return (numbers(key_part(key, seed), rep).astype(np.float64) + 0.5) / P


def least_number(u: float) -> int:
    """The smallest number whose uniform is at or above ``u``."""
    x = min(max(int(u * P) - 2, 0), P)
    while x < P and (float(x) + 0.5) / P < u:
        x += 1
    return x


_TABLE_BITS = 15
#: Numbers that are drawn at once: they and their scratch stay in a core's cache.
_DRAWN = 1 << 14
#: Cells of more items are looked up in their law, not in a table.
_TABLED = 64


@lru_cache(maxsize=_TABLED)
def _poisson_table(mean: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers at which the count of a Poisson draw rises, and the counts of blocks of numbers (255: a rise inside)."""
    lo, before = poisson_law(mean)
    rises = np.array([least_number(b) for b in before[1:]], np.uint64)
    starts = np.arange((P >> _TABLE_BITS) + 1, dtype=np.uint64) << np.uint64(_TABLE_BITS)
    first = np.searchsorted(rises, starts, "right") + lo
    last = np.searchsorted(rises, starts + np.uint64((1 << _TABLE_BITS) - 1), "right") + lo
    return rises, np.where(first == last, first, 255).astype(np.uint8)


def _counts(x: np.ndarray, mean: int, out: np.ndarray) -> None:
    """Poisson counts of the numbers ``x``, in one row, by the table of their law."""
    rises, table = _poisson_table(mean)
    out[:] = table.take((x >> np.uint64(_TABLE_BITS)).view(np.int64))
    odd = np.flatnonzero(out == 255)
    if len(odd):
        out[odd] = np.searchsorted(rises, x[odd], "right") + poisson_law(mean)[0]


def poisson_ones(part: np.ndarray, rep: int) -> np.ndarray:
    """Poisson(1) counts of items in one replicate, the same as ``poisson_weights`` gives single items."""
    own, out = mixed(np.array([rep]), REP_OFFSET), np.empty(len(part), np.uint8)
    for i in range(0, len(part), _DRAWN):
        _counts(_fifth(part[i : i + _DRAWN] + own), 1, out[i : i + _DRAWN])
    return out


def uniform_sql(key: str, rep: str, seed: int) -> str:
    """Select items ending in ``u``: the same numbers as lateral aliases in SQL."""
    steps = []
    for name, value, offset in (("k", key, KEY_OFFSET + seed), ("p", rep, REP_OFFSET)):
        a = f"_{name}"
        steps += [f"({value} % {P} + {offset % P}) % {P} AS {a}0", f"{a}0*{a}0 % {P} AS {a}1", f"({a}1*{a}1 % {P} * {a}0 % {P} + 1) % {P} AS {a}2"]
        steps += [f"{a}2*{a}2 % {P} AS {a}3", f"{a}3*{a}3 % {P} * {a}2 % {P} AS {a}4"]
    steps += [f"(_k4 + _p4) % {P} AS _m0", f"_m0*_m0 % {P} AS _m1", f"((_m1*_m1 % {P} * _m0 % {P}) + 0.5::DOUBLE)/{P} AS u"]
    return ", ".join(steps)


def _around(mode: int, lo: int, hi: int, up, down) -> tuple[int, np.ndarray]:
    """Probabilities on lo..hi from the log ratios p(x)/p(x-1) above and p(x)/p(x+1) below the mode."""
    above, below = np.arange(mode + 1, hi + 1, dtype=float), np.arange(mode - 1, lo - 1, -1, dtype=float)
    logs = np.r_[np.cumsum(down(below))[::-1], 0.0, np.cumsum(up(above))]
    p = np.exp(logs)
    return lo, p / math.fsum(p)


@lru_cache(maxsize=4096)
def hypergeometric_law(n: int, positives: int, k: int, reach: float = REACH) -> tuple[int, np.ndarray]:
    """First count and probabilities of the positives among ``k`` of ``n`` items drawn without replacement.

    Only counts within ``reach`` standard deviations of the mode are listed; they are normalised to one.
    """
    least, most = max(0, k + positives - n), min(k, positives)
    mode = min(max((k + 1) * (positives + 1) // (n + 2), least), most)
    sd = math.sqrt(max(k * (positives / n) * (1 - positives / n) * (n - k) / max(n - 1, 1), 0.0)) if n else 0.0
    far = int(reach * sd + reach) + 1
    return _around(
        mode, max(least, mode - far), min(most, mode + far),
        lambda x: np.log(positives - x + 1) + np.log(k - x + 1) - np.log(x) - np.log(n - positives - k + x),
        lambda x: np.log(x + 1) + np.log(n - positives - k + x + 1) - np.log(positives - x) - np.log(k - x),
    )


@lru_cache(maxsize=65536)
def poisson_law(mean: int, reach: float = REACH) -> tuple[int, np.ndarray]:
    """First count and cumulative probabilities *before* each count of a Poisson law around its mode."""
    far = int(reach * math.sqrt(mean) + 2 * reach) + 1
    lo, p = _around(mean, max(0, mean - far), mean + far, lambda x: math.log(mean) - np.log(x), lambda x: np.log(x + 1) - math.log(mean))
    return lo, np.r_[0.0, np.cumsum(p)[:-1]]


#: Probabilities in memory at once.
_BLOCK = 1 << 20


def hypergeometric_draws(n: np.ndarray, positives: np.ndarray, k: np.ndarray, u: np.ndarray) -> np.ndarray:
    """One count per row: the inverse of its law at ``u``; rows of one law share its table."""
    out = np.zeros(len(u), np.int64)
    laws, row = np.unique(np.stack([n, positives, k], 1), axis=0, return_inverse=True)
    order = np.argsort(row, kind="stable")
    cuts = np.searchsorted(row[order], np.arange(len(laws) + 1))
    n, positives, k = laws.T.astype(float)
    share = positives / np.maximum(n, 1)
    far = np.floor(REACH * np.sqrt(np.maximum(k * share * (1 - share) * (n - k) / np.maximum(n - 1, 1), 0)) + REACH) + 1
    lo = np.maximum(np.maximum(0, k + positives - n), np.floor(k * share) - far)
    hi = np.minimum(np.minimum(k, positives), np.ceil(k * share) + far)
    step = max(1, _BLOCK // int((hi - lo).max(initial=0) + 1))
    for i in range(0, len(laws), step):
        a, b, c, start, end = (v[i : i + step, None] for v in (n, positives, k, lo, hi))
        x = start + np.arange(1, int((end - start).max()) + 1)
        inside = x <= end
        with np.errstate(invalid="ignore", divide="ignore"):
            ratio = np.log(b - x + 1) + np.log(c - x + 1) - np.log(x) - np.log(a - b - c + x)
        logs = np.hstack([np.zeros((len(a), 1)), np.cumsum(np.where(inside, ratio, 0.0), 1)])
        p = np.exp(logs - logs.max(1, keepdims=True))
        p[:, 1:][~inside] = 0.0
        total = np.cumsum(p, 1)
        before = (total - p) / total[:, -1:]
        for j in range(len(a)):
            at = order[cuts[i + j] : cuts[i + j + 1]]
            size = int(end[j, 0] - start[j, 0]) + 1
            out[at] = int(start[j, 0]) + np.searchsorted(before[j, :size], u[at], "right") - 1
    return out


def poisson_weights(key: np.ndarray, count: np.ndarray, reps: np.ndarray, seed: int) -> np.ndarray:
    """Resampled sizes, cells by replicates: a cell of ``count`` items weighs Poisson(count), as its items' sum does.

    Replicate 0 is the sample itself.
    """
    part, own, count = key_part(np.asarray(key), seed), mixed(np.asarray(reps), REP_OFFSET), np.asarray(count)
    out = np.empty((len(part), len(own)))
    step = max(1, _DRAWN // max(1, len(own)))
    narrow = np.empty(step * len(own), np.uint8)
    for m in np.unique(count).tolist():
        at = np.flatnonzero(count == m)
        lo, before = poisson_law(m)
        for i in range(0, len(at), step):
            some = at[i : i + step]
            x = _fifth(part[some][:, None] + own).ravel()
            if m <= _TABLED:
                w = narrow[: len(x)]
                _counts(x, m, w)
            else:
                w = lo + np.searchsorted(before, (x.astype(np.float64) + 0.5) / P, "right") - 1
            out[some] = w.reshape(len(some), -1)
    whole = np.asarray(reps) == 0
    out[:, whole] = np.asarray(count)[:, None]
    return out


POISSON_SQL = (
    f"pn AS (SELECT DISTINCT m FROM cl), px AS (SELECT m, unnest(generate_series(greatest(0, floor(m-{REACH}*sqrt(m)-{2 * REACH}))::BIGINT, ceil(m+{REACH}*sqrt(m)+{2 * REACH})::BIGINT)) AS x FROM pn), "
    "pp AS (SELECT m, x, exp(x*ln(m)-m-lgamma(x+1.0)) AS p FROM px), "
    "pc AS (SELECT m, x, coalesce(sum(p) OVER (PARTITION BY m ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)/sum(p) OVER (PARTITION BY m) AS before FROM pp)"
)


def weights_sql(cells: str, reps: int, seed: int) -> str:
    """CTEs ``cl`` (the cells, with m and key) and ``rw`` (their columns, rep and w > 0; replicate 0 is the sample)."""
    return (
        f"cl AS ({cells}), {POISSON_SQL}, rp AS (SELECT unnest(generate_series(1, {reps}))::BIGINT AS rep), "
        f"cu AS (SELECT cl.*, rep, {uniform_sql('key', 'rep', seed)} FROM cl, rp), "
        "rw AS (SELECT cu.* EXCLUDE (_k0, _k1, _k2, _k3, _k4, _p0, _p1, _p2, _p3, _p4, _m0, _m1, u, m, key), pc.x AS w FROM cu ASOF JOIN pc ON cu.m = pc.m AND cu.u >= pc.before WHERE pc.x > 0 UNION ALL SELECT cl.* EXCLUDE (m, key), 0, m FROM cl)"
    )
