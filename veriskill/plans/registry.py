"""Every registered query and its SQL."""

from __future__ import annotations

from veriskill.plans import event_queries, grid_queries, object_queries, run_queries, scan_queries, station_queries, track_queries
from veriskill.plans.register import QUERIES, SQL

MODULES = (grid_queries, event_queries, track_queries, station_queries, object_queries, run_queries, scan_queries)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
