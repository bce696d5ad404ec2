"""Every registered query with its SQL counterpart."""

from textweave.registry import (  # noqa: F401
    filter_queries,
    graph_queries,
    ingest_queries,
    link_queries,
    model_queries,
    stat_queries,
    text_queries,
)
from textweave.registry.frames import ORACLES, QUERIES  # noqa: F401
