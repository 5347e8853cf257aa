"""Aggregate column builders: several statistics share one pass over the data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marklens.functions.scalars import grid_code, half_up


def safe_ratio(a: Column, b: Column) -> Column:
    """NULL instead of a division by zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def moments(a: Column, b: Column) -> dict[str, Column]:
    """Sums that regression, agreement and correlation closed forms need."""
    return {
        "n": F.count(F.lit(1)),
        "sa": F.sum(a), "sb": F.sum(b),
        "saa": F.sum(a * a), "sbb": F.sum(b * b), "sab": F.sum(a * b),
    }


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(p - y))


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg((p - y) * (p - y)))


def r2(y: Column, p: Column) -> Column:
    total = F.sum(y * y) - F.sum(y) * F.sum(y) / F.count(y)
    return F.lit(1.0) - F.try_divide(F.sum((y - p) * (y - p)), total)


def bias(y: Column, p: Column) -> Column:
    return F.avg(p - y)


def within(y: Column, p: Column, tol: float) -> Column:
    return F.avg((F.abs(p - y) <= tol).cast("double"))


def quadratic_kappa(a: Column, b: Column) -> Column:
    """Quadratic weighted kappa of two integer codes from five sums."""
    a, b = a.cast("double"), b.cast("double")
    expected = F.sum(a * a) + F.sum(b * b) - 2 * F.sum(a) * F.sum(b) / F.count(a)
    return F.lit(1.0) - F.try_divide(F.sum((a - b) * (a - b)), expected)


def score_kappa(y: Column, p: Column) -> Column:
    """Kappa of a truth on the grid and a continuous prediction rounded half up to the grid."""
    return quadratic_kappa(grid_code(y), grid_code(half_up(p)))


def icc_agreement(a: Column, b: Column) -> Column:
    """ICC(A,1) of two raters: two-way random effects, absolute agreement."""
    a, b = a.cast("double"), b.cast("double")
    n = F.count(a)
    sa, sb, saa, sbb, sab = F.sum(a), F.sum(b), F.sum(a * a), F.sum(b * b), F.sum(a * b)
    grand = (sa + sb) * (sa + sb) / (2 * n)
    subjects = ((saa + sbb + 2 * sab) / 2 - grand) / (n - 1)
    raters = (sa - sb) * (sa - sb) / (2 * n)
    error = ((saa + sbb - 2 * sab) / 2 - raters) / (n - 1)
    return F.try_divide(subjects - error, subjects + error + 2 * (raters - error) / n)


def pearson(x: Column, y: Column, w: Column | None = None) -> Column:
    """Pearson correlation, optionally weighted; NULL when a side is constant."""
    w = F.lit(1.0) if w is None else w
    n, sx, sy = F.sum(w), F.sum(w * x), F.sum(w * y)
    cov = F.sum(w * x * y) - sx * sy / n
    vx = F.sum(w * x * x) - sx * sx / n
    vy = F.sum(w * y * y) - sy * sy / n
    return F.when((vx > 0) & (vy > 0), cov / F.sqrt(vx * vy))


def slope(y: Column, x: Column) -> Column:
    """Least-squares slope of y on x; NULL when x is constant."""
    n, sx, sy = F.count(x), F.sum(x), F.sum(y)
    vx = F.sum(x * x) - sx * sx / n
    return F.when(vx > 0, (F.sum(x * y) - sx * sy / n) / vx)


def regression_columns(y: Column, p: Column) -> dict[str, Column]:
    return {
        "n_samples": F.count(F.lit(1)),
        "mae": mae(y, p), "rmse": rmse(y, p), "r2": r2(y, p), "qwk": score_kappa(y, p),
    }


def extended_columns(y: Column, p: Column) -> dict[str, Column]:
    return {
        "mae": mae(y, p), "rmse": rmse(y, p), "r2": r2(y, p), "mean_bias": bias(y, p),
        "within_half": within(y, p, 0.5), "within_one": within(y, p, 1.0),
        "calibration_slope": slope(y, p),
        "prediction_sd": F.stddev_samp(p), "human_sd": F.stddev_samp(y),
    }


def queue_columns(large: Column, selected: Column) -> dict[str, Column]:
    """Counts and rates of one review queue; rates without a denominator are NULL."""
    n, k = F.count(F.lit(1)), F.count_if(selected)
    pos, hit = F.count_if(large), F.count_if(large & selected)
    prevalence, precision = safe_ratio(pos, n), safe_ratio(hit, k)
    return {
        "n": n, "selected_count": k, "positives": pos, "captured": hit,
        "prevalence": prevalence, "capture_rate": safe_ratio(hit, pos), "precision": precision,
        "lift": F.try_divide(precision, prevalence),
    }


def agreement_columns(a: Column, b: Column) -> dict[str, Column]:
    return {
        "n": F.count(F.lit(1)),
        "mae": F.avg(F.abs(a - b).cast("double")),
        "exact": F.avg((a == b).cast("double")),
        "within_half": F.avg((F.abs(a - b) <= 0.5).cast("double")),
        "within_one": F.avg((F.abs(a - b) <= 1).cast("double")),
        "qwk": quadratic_kappa(a, b),
        "icc": icc_agreement(a, b),
    }


def named(cols: dict[str, Column], digits: int | None = None) -> list[Column]:
    """Alias a dict of columns; with ``digits``, round the floating ones (all but the counts)."""
    whole = {"n", "n_samples", "selected_count", "positives", "captured"}
    return [
        (c if digits is None or k in whole else F.round(c, digits)).alias(k) for k, c in cols.items()
    ]
