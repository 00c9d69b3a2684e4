"""Registered queries over the given tables, each beside its SQL twin."""

from workload import (  # noqa: F401
    line_queries,
    page_queries,
    record_queries,
    review_queries,
    snapshot_queries,
    source_queries,
    stream_queries,
    table_queries,
    text_queries,
)
from workload.registry import ORACLES, QUERIES  # noqa: F401
