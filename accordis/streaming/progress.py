"""Progress of streams as they run, told by Spark itself.

A stream whose rows are observed gives its figures with every micro-batch; a listener hands them on. Nothing is counted twice and
no job is run for it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQueryListener


def observed(stream: DataFrame, name: str, **figures: Column) -> DataFrame:
    """stream with aggregates taken as rows pass."""
    return stream.observe(name, *(c.alias(k) for k, c in figures.items()))


class Listener(StreamingQueryListener):
    """Calls tell(query, batch, rows read, {name: figures}) after each micro-batch, and ended(query, error or None) when a query stops."""

    def __init__(self, tell: Callable[[str, int, int, dict[str, dict]], None], ended: Callable[[str, str | None], None] = lambda *_: None) -> None:
        self.tell, self.ended, self._names = tell, ended, {}

    def onQueryStarted(self, event) -> None:
        self._names[event.id] = event.name

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.tell(p.name, p.batchId, p.numInputRows, {name: row.asDict() for name, row in p.observedMetrics.items()})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended(self._names.pop(event.id, None), event.exception)
