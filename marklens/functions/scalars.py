"""Column builders for single rows: text keys, bands, errors, disagreement, categories."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marklens.schema import LARGE_ERROR, SCORE_MAX, SCORE_MIN

# Fixed patterns.
WORD_PATTERN = r"(?U)\b\w++(?:['’-]\w++)*+"  # possessive: long chains of hyphens cost no stack
NON_ASCII = r"[^\x00-\x7F]"
SCIENTIFIC_ID = r"(?i)^[0-9.]+E\+[0-9]+$"

# Fixed labels of the evidence classes.
EVIDENCE = {
    "A": "A. Supports added value of disagreement",
    "B": "B. Comparable to simpler baselines",
    "C": "C. Worse than simpler baselines",
    "D": "D. Mixed / inconclusive",
}


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.StringType())
def _casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else t.casefold())


def _only_non_ascii(udf, text: Column) -> Column:
    """Ship only texts that can change to the Python worker; ASCII rows travel as NULL."""
    return udf(F.when(text.rlike(NON_ASCII), text))


def squeeze(text: Column) -> Column:
    """Collapse runs of Unicode white space and trim."""
    # a single plain space is left as it is: a match per word would copy every text word by word
    return F.btrim(F.regexp_replace(text, r"(?U)\s{2,}|[^\S ]", " "))


def casefold(text: Column) -> Column:
    return F.coalesce(_only_non_ascii(_casefold, text), F.lower(text))


def identity_text(text: Column) -> Column:
    """Text normalised for identity: trimmed, case-folded, white space collapsed."""
    return casefold(squeeze(text))


def text_hash(text: Column) -> Column:
    return F.sha2(identity_text(text).cast("binary"), 256)


def clean_text(text: Column) -> Column:
    """NFKC plus white-space collapse; NULL when nothing is left."""
    return F.nullif(squeeze(F.coalesce(_only_non_ascii(_nfkc, text), text)), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD_PATTERN))


def first_words(text: Column, n: int = 150) -> Column:
    return F.array_join(F.slice(F.split(squeeze(text), " "), 1, n), " ")


def prompt_key(prompt: Column) -> Column:
    return F.lower(squeeze(prompt))


def is_non_ascii(text: Column) -> Column:
    return text.rlike(NON_ASCII)


def half_up(p: Column) -> Column:
    """Round half up to the half-point grid and clip to the scale."""
    return F.least(F.lit(SCORE_MAX), F.greatest(F.lit(SCORE_MIN), F.floor(p * 2 + 0.5) / 2))


def grid_code(y: Column) -> Column:
    """0..8 code of a half-point score."""
    return F.rint((y - 1) * 2).cast("int")


def on_grid(y: Column, tol: float = 1e-9) -> Column:
    return (F.abs((y - 1) * 2 - F.rint((y - 1) * 2)) <= tol) & y.between(SCORE_MIN, SCORE_MAX)


def score_band(y: Column) -> Column:
    """low up to 2.5, middle up to 3.5, high from 4; anything between is invalid."""
    return (
        F.when(y <= 2.5, "low").when(y <= 3.5, "middle").when(y >= 4.0, "high").otherwise("invalid")
    )


def left_closed_band(x: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Bins ``[a, b)``; ``labels`` has one entry more than ``edges``."""
    out = F.lit(labels[-1])
    for e, lab in reversed(list(zip(edges, labels))):
        out = F.when(x < e, lab).otherwise(out)
    return F.when(x.isNotNull(), out)


def right_closed_band(x: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Bins ``(a, b]``."""
    out = F.lit(labels[-1])
    for e, lab in reversed(list(zip(edges, labels))):
        out = F.when(x <= e, lab).otherwise(out)
    return F.when(x.isNotNull(), out)


def truth_band(y: Column) -> Column:
    """Bands with a closed middle."""
    return F.when(y < 2.5, "y<2.5").when(y <= 4.0, "2.5<=y<=4.0").when(y > 4.0, "y>4.0")


def abs_error(truth: Column, prediction: Column) -> Column:
    return F.abs(prediction - truth)


def largest(*cols: Column) -> Column:
    return F.greatest(*cols)


def consensus(a: Column, b: Column) -> Column:
    return (a + b) / 2


def reasons(flags: Mapping[str, Column]) -> Column:
    """Names of the conditions that hold, in the given order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in flags.items()]))


def error_trigger(err_v: Column, err_g: Column, threshold: float = LARGE_ERROR) -> Column:
    v, g = err_v >= threshold, err_g >= threshold
    return F.when(v & g, "both").when(v, "V").when(g, "G").otherwise("none")


def analysis_target(err_v: Column, err_g: Column) -> Column:
    return F.when(err_v >= err_g, "V").otherwise("G")


def error_relation(reference: Column, other: Column, threshold: float = LARGE_ERROR) -> Column:
    """How another model's signed error relates to the reference model's."""
    return (
        F.when(reference * other > 0, F.when(F.abs(other) >= threshold, "same_direction_both_large").otherwise(
            "same_direction_other_below"))
        .when(reference * other < 0, "opposite_sign")
        .otherwise("zero_other_error")
    )


def side_of_models(y: Column, a: Column, b: Column) -> Column:
    return F.when(y > F.greatest(a, b), "above_both").when(y < F.least(a, b), "below_both").otherwise("between")


def windowed_estimate(rate_per_100: Column, words: Column, window: int = 150) -> Column:
    return rate_per_100 * F.least(F.lit(window), words) / 100


def count_from_rate(rate: Column, words: Column, digits: int = 12) -> Column:
    """The one integer count whose rate per 100 words prints as ``rate`` to ``digits`` significant digits.

    NULL when no integer or more than one fits.  A printed value stands for an interval of half a
    unit in its last digit; its magnitude comes from the decimal exponent.
    """
    r = rate.cast("decimal(38,18)")
    exponent = F.when(rate == 0, F.lit(0)).otherwise(F.floor(F.log10(F.abs(rate))))
    half = (F.lit(0.5) * F.pow(F.lit(10.0), exponent - (digits - 1))).cast("decimal(38,18)")
    low = F.ceil((r - half) * words / 100)
    high = F.floor((r + half) * words / 100)
    return F.when(low == high, low).cast("bigint")


def evidence_class(signal: Column, random_mean: Column, first: Column, second: Column) -> Column:
    """Verdict on a queue signal against chance and two simple rankings."""
    rivals = (random_mean, first, second)
    between = (signal >= F.least(first, second)) & (signal <= F.greatest(first, second))
    return (
        F.when(signal > F.greatest(*rivals), EVIDENCE["A"])
        .when(signal < F.least(*rivals), EVIDENCE["C"])
        .when((signal >= random_mean) & between, EVIDENCE["B"])
        .otherwise(EVIDENCE["D"])
    )


def score_text(y: Column) -> Column:
    """Shortest text of a half-point score: 2 for 2.0, 2.5 for 2.5."""
    return F.regexp_replace(y.cast("string"), r"\.0$", "")


def type_family(edit_type: Column) -> Column:
    """``R:VERB:SVA`` -> ``VERB``; a type without a prefix is its own family."""
    return F.coalesce(F.try_element_at(F.split(edit_type, ":"), F.lit(2)), edit_type)


def is_grammar_edit(edit_type: Column) -> Column:
    return ~type_family(edit_type).isin("SPELL", "PUNCT", "ORTH")


def mapped(label: Column, mapping: Mapping[str, str]) -> Column:
    """Literal lookup; unknown labels become NULL."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), label)


def ratios_in_range(*cols: Column) -> Column:
    return F.when(reduce(lambda a, b: a & b, [c.between(0, 1) for c in cols]), "pass").otherwise("fail")
