"""A pipeline of verification strategies: plug-ins, a registry by level, and a fluent builder.

A strategy is three functions from DataFrames to a DataFrame. The pipeline runs those of a level, joins the last score of each
onto the components, and hands gaps and results to callbacks as DataFrames: nothing is computed until somebody reads them.
What a run did is counted in the pass that does it: give `run` a Progress, read the result, and ask the Progress.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

Step = Callable[[DataFrame], DataFrame]
EVENTS = ("phase", "progress", "components", "gaps", "result")


@dataclass(frozen=True)
class Strategy:
    """challenge: components to items; evaluate: items with answers to (component_id, item_id, team, score); gaps: evaluations to gaps."""

    name: str
    level: str
    challenge: Step
    evaluate: Step
    gaps: Step


class Registry:
    """Strategies, or anything else, by name; made once when first asked for."""

    def __init__(self) -> None:
        self._makers: dict[str, Callable[[], Strategy]] = {}
        self._made: dict[str, Strategy] = {}

    def register(self, name: str, make: Strategy | Callable[[], Strategy]) -> None:
        self._makers[name] = (lambda: make) if isinstance(make, Strategy) else make
        self._made.pop(name, None)

    def unregister(self, name: str) -> None:
        self._makers.pop(name, None)
        self._made.pop(name, None)

    def get(self, name: str) -> Strategy:
        if name not in self._makers:
            raise KeyError(f"no strategy {name}; there are {sorted(self._makers)}")
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def by_level(self, level: str) -> list[Strategy]:
        return [s for s in map(self.get, self._makers) if s.level == level]

    def names(self) -> list[str]:
        return list(self._makers)


def first_available(sources: list[Callable[[], DataFrame | None]], empty: DataFrame) -> DataFrame:
    """The first source that gives a table; one that fails or gives none is passed over; else the empty table."""
    for source in sources:
        try:
            found = source()
        except Exception:  # noqa: BLE001  a source that can't be read is what the chain is for
            continue
        if found is not None:
            return found
    return empty


class Progress:
    """Figures that Spark takes while rows go by: no job of its own, no second pass. They are there once the rows have been read."""

    def __init__(self) -> None:
        self._seen: dict[str, Observation] = {}

    def watch(self, name: str, rows: DataFrame, **figures: Column) -> DataFrame:
        """rows, of which aggregates are taken as they pass."""
        seen = self._seen[name] = Observation(f"{name}-{uuid.uuid4().hex}")
        return rows.observe(seen, *(c.alias(k) for k, c in figures.items()))

    def names(self) -> list[str]:
        return list(self._seen)

    def figures(self, name: str) -> dict[str, Any]:
        """Waits for the rows to be read."""
        return self._seen[name].get


@dataclass(frozen=True)
class Pipeline:
    strategies: tuple[Strategy, ...]
    threshold: float = 0.85
    #: (event, function): phase gets (strategy, begins or ends), progress (done, all), components and gaps (strategy, DataFrame), result the DataFrame of all.
    listeners: tuple[tuple[str, Callable[..., None]], ...] = ()

    def tell(self, event: str, *what: Any) -> None:
        for wanted, listener in self.listeners:
            if wanted == event:
                listener(*what)

    def run(self, components: DataFrame, answer: Callable[[Strategy, DataFrame], DataFrame], progress: Progress | None = None) -> DataFrame:
        """component_id, the mean score of each strategy (0 without items), overall and passed. progress gets each strategy's items, failed
        items and sum of scores, and of `result` the components and how many passed."""
        out = components.select("component_id").distinct()
        for i, s in enumerate(self.strategies, 1):
            self.tell("phase", s.name, "begins")
            rated = s.evaluate(answer(s, s.challenge(components)))
            counted = progress.watch(s.name, rated, items=F.count(F.lit(1)), failed=F.count_if(F.col("score") < self.threshold), score=F.sum("score")) if progress else rated
            means = counted.groupBy("component_id").agg(F.round(F.avg("score"), 9).alias(s.name))
            self.tell("gaps", s.name, s.gaps(rated))
            self.tell("components", s.name, means)
            self.tell("phase", s.name, "ends")
            self.tell("progress", i, len(self.strategies))
            out = out.join(means, "component_id", "left").withColumn(s.name, F.coalesce(s.name, F.lit(0.0)))
        names = [s.name for s in self.strategies]
        overall = F.round(sum((F.col(n) for n in names[1:]), F.col(names[0])) / len(names), 9) if names else F.lit(0.0)
        out = out.withColumn("overall", overall).withColumn("passed", F.col("overall") >= self.threshold)
        if progress:
            out = progress.watch("result", out, components=F.count(F.lit(1)), passed=F.count_if("passed"))
        self.tell("result", out)
        return out


@dataclass
class Builder:
    """Collects a pipeline's parts; every method gives the builder."""

    registry: Registry
    names: list[str] = field(default_factory=list)
    threshold: float = 0.85
    listeners: list[tuple[str, Callable[..., None]]] = field(default_factory=list)

    def with_strategies(self, *names: str) -> Builder:
        self.names += names
        return self

    def with_all(self) -> Builder:
        self.names = self.registry.names()
        return self

    def with_threshold(self, threshold: float) -> Builder:
        self.threshold = threshold
        return self

    def on(self, event: str, listener: Callable[..., None]) -> Builder:
        if event not in EVENTS:
            raise ValueError(f"no event {event}; there are {EVENTS}")
        self.listeners.append((event, listener))
        return self

    def on_gaps(self, listener: Callable[[str, DataFrame], None]) -> Builder:
        return self.on("gaps", listener)

    def build(self) -> Pipeline:
        if not self.names:
            raise ValueError("a pipeline needs a strategy")
        return Pipeline(tuple(map(self.registry.get, self.names)), self.threshold, tuple(self.listeners))
