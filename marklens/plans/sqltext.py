"""Small SQL text helpers for the twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def r(expr: str, alias: str, digits: int = 9) -> str:
    return f"round({expr}, {digits}) AS {alias}"


def rounded(df: DataFrame, digits: int = 9, skip: tuple[str, ...] = ()) -> DataFrame:
    """Round every double column, as the twins do."""
    return df.select(
        *[
            F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) and f.name not in skip else F.col(f.name)
            for f in df.schema.fields
        ]
    )


HALF_UP = "least(5.0::DOUBLE, greatest(1.0::DOUBLE, floor({0}*2+0.5::DOUBLE)/2))"


def code(x: str) -> str:
    return f"round(({x}-1)*2)"


def kappa(a: str, b: str) -> str:
    return (
        f"(1 - sum(({a}-{b})*({a}-{b}))/nullif(sum({a}*{a})+sum({b}*{b})-2*sum({a})*sum({b})/count(*), 0))"
    )


def mae(t: str = "truth", p: str = "prediction") -> str:
    return f"avg(abs({p}-{t}))"


def rmse(t: str = "truth", p: str = "prediction") -> str:
    return f"sqrt(avg(({p}-{t})*({p}-{t})))"


def r2(t: str = "truth", p: str = "prediction") -> str:
    return f"(1 - sum(({t}-{p})*({t}-{p}))/nullif(sum({t}*{t})-sum({t})*sum({t})/count(*), 0))"


def qwk(t: str = "truth", p: str = "prediction") -> str:
    return kappa(code(t), code(HALF_UP.format(p)))


def within(tol: float, t: str = "truth", p: str = "prediction") -> str:
    return f"avg((abs({p}-{t}) <= {tol})::INT)"


def n_if(cond: str) -> str:
    return f"count(*) FILTER (WHERE {cond})"


def q(x: str, p: float) -> str:
    return f"quantile_cont({x}, {p})"


def slope(y: str = "truth", x: str = "prediction") -> str:
    return f"((sum({x}*{y})-sum({x})*sum({y})/count(*))/nullif(sum({x}*{x})-sum({x})*sum({x})/count(*), 0))"


def pearson(x: str, y: str) -> str:
    return (
        f"((sum({x}*{y})-sum({x})*sum({y})/count(*))/nullif(sqrt((sum({x}*{x})-sum({x})*sum({x})/count(*))"
        f"*(sum({y}*{y})-sum({y})*sum({y})/count(*))), 0))"
    )
