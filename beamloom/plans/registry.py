"""All named queries."""

from __future__ import annotations

import importlib

from beamloom.plans.catalogue import Build

MODULES = ("event_queries", "hist_queries", "join_queries", "quality_queries", "finder_queries", "stream_queries", "view_queries")


def all_queries() -> tuple[dict[str, Build], dict[str, str]]:
    builds: dict[str, Build] = {}
    sql: dict[str, str] = {}
    for m in MODULES:
        c = importlib.import_module(f"beamloom.plans.{m}").C
        builds.update(c.builds)
        sql.update(c.sql)
    return builds, sql
