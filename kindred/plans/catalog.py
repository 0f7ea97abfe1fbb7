"""All queries of the engine: importing the query modules fills the registry."""

from __future__ import annotations

from kindred.plans import address_queries, etl_queries, graph_queries, linkage_queries, scalar_queries, source_queries  # noqa: F401
from kindred.plans.registry import ORACLES, QUERIES, Builder


def queries() -> dict[str, Builder]:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
