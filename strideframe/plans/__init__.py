"""Composed pipelines and the query registry."""

from strideframe.plans import (  # noqa: F401
    cluster_queries,
    eeg_queries,
    factor_queries,
    feature_queries,
    fusion_queries,
    quality_queries,
    selection_queries,
    session_queries,
    signal_queries,
    signal_rate_queries,
    source_queries,
    stats_queries,
    workflow_queries,
)
from strideframe.plans.registry import QUERIES, SQL  # noqa: F401
