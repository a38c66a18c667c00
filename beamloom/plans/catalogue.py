"""A small catalogue of named queries, each with the SQL that must give the same rows (where SQL can)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Build = Callable[[SparkSession, str], DataFrame]


@dataclass
class Catalogue:
    builds: dict[str, Build]
    sql: dict[str, str]

    def __init__(self):
        self.builds, self.sql = {}, {}

    def query(self, name: str, sql: str | None = None):
        def keep(fn: Build) -> Build:
            self.builds[name] = fn
            if sql is not None:
                self.sql[name] = sql.strip()
            return fn

        return keep
