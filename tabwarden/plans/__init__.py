"""Registered queries and the SQL that checks them."""

from tabwarden.plans import (  # noqa: F401
    check_queries,
    delivery_queries,
    diff_queries,
    evidence_queries,
    flow_queries,
    run_queries,
    source_queries,
    stream_queries,
    submission_queries,
)
from tabwarden.plans.registry import QUERIES, Tables

__all__ = ["QUERIES", "Tables"]
