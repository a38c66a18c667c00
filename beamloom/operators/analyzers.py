"""User analyses of built events: a function from events to named result tables, registered with how to build them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beamloom.operators.events import anchored_events, newest_events, no_grouping

Analysis = Callable[[DataFrame], dict[str, DataFrame]]


@dataclass(frozen=True)
class Analyzer:
    name: str
    window: int
    mode: str
    boards: tuple[int, ...] | None
    newest: int
    fn: Analysis

    def run(self, hits: DataFrame) -> dict[str, DataFrame]:
        """Chosen boards, events built the wanted way, then the user's tables."""
        if self.boards is not None:
            hits = hits.filter(F.col("board").isin(*self.boards))
        if self.mode == "newest":
            return self.fn(newest_events(hits, self.window, self.newest))
        return self.fn(no_grouping(hits) if self.mode == "single" else anchored_events(hits, self.window))


ANALYZERS: dict[str, Analyzer] = {}


def analyzer(name: str, window: int, mode: str = "all", boards: tuple[int, ...] | None = None, newest: int = 100):
    """Registers an analysis. Modes: 'all' events, the 'newest' ones, or 'single' hits."""

    def keep(fn: Analysis) -> Analysis:
        ANALYZERS[name] = Analyzer(name, window, mode, boards, newest, fn)
        return fn

    return keep
