"""Importing this module registers every query."""

from checks import (  # noqa: F401
    q_contracts,
    q_features,
    q_geo,
    q_joins,
    q_metrics,
    q_rle,
    q_search,
    q_sources,
    q_streams,
)
