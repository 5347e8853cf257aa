"""Imports every plan module, which registers its queries."""

from marklens.plans import (  # noqa: F401
    chance_queries,
    data_queries,
    drift_queries,
    metric_queries,
    model_queries,
    ranking_queries,
    scalar_queries,
    split_queries,
    stream_queries,
    text_queries,
)
