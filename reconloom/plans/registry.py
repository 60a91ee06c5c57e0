"""All registered queries of the library and their DuckDB SQL."""

from __future__ import annotations

from reconloom.plans import flow_queries, match_queries, resolve_queries, restore_queries, scalar_queries  # noqa: F401
from reconloom.plans.binding import ORACLES, QUERIES


def oracles() -> dict[str, str]:
    """The SQL by query."""
    return {name: sql if isinstance(sql, str) else sql() for name, sql in ORACLES.items()}


__all__ = ["QUERIES", "oracles"]
