"""The registry of queries and their SQL oracles."""

from __future__ import annotations

from .plans import coherence_queries, gate_queries, join_queries, lang_queries, listing_queries, message_queries, patch_queries, plan_queries, plural_queries, reader_queries, rule_queries, script_queries, select_queries, site_queries, span_queries, stream_queries, token_queries  # noqa: F401
from .plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
