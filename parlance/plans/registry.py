"""Every registered query with the SQL that it must equal."""

from __future__ import annotations

from . import adapters, q_aggregates, q_directories, q_intervals, q_joins, q_language, q_maps, q_scoring, q_sources, q_streams, q_text  # noqa: F401


def queries() -> dict:
    return dict(adapters.QUERIES)


def oracle_sql() -> dict:
    return dict(adapters.ORACLES)
