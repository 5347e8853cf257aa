"""Row-level error and disagreement signals of two model families on two targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marklens.schema import LARGE_ERROR


def long_predictions(df: DataFrame, keep: list[str]) -> DataFrame:
    """One row per item, target and model."""
    return df.select(
        *keep,
        F.expr(
            "stack(4, 'V', 'linear', y_v, lin_v, 'V', 'forest', y_v, for_v, "
            "'G', 'linear', y_g, lin_g, 'G', 'forest', y_g, for_g) AS (target, model, truth, prediction)"
        ),
    )


def add_signals(df: DataFrame, threshold: float = LARGE_ERROR) -> DataFrame:
    """Errors of the reference family, the large-error flag and the disagreement of both families."""
    err_v, err_g = F.abs(F.col("for_v") - F.col("y_v")), F.abs(F.col("for_g") - F.col("y_g"))
    d_v, d_g = F.abs(F.col("for_v") - F.col("lin_v")), F.abs(F.col("for_g") - F.col("lin_g"))
    return df.withColumns(
        {
            "err_v": err_v, "err_g": err_g, "max_err": F.greatest(err_v, err_g),
            "large": F.greatest(err_v, err_g) >= threshold,
            "d_v": d_v, "d_g": d_g, "d_max": F.greatest(d_v, d_g), "d_mean": (d_v + d_g) / 2,
        }
    )
