"""Replay of event logs as they come: the state of every run, kept between batches.

A run's state is small whatever its log: counters, the last output of each (component, stream) as a map, its errors as a list, and
of the components documented since its last complete iteration only those (seq, iteration) that a later completion may
leave over: the ones that no pair with a higher seq exceeds. So events may come in any order and in any batches, and the state
is that of the whole log read at once. A run from which nothing comes for `stall` of event time is told as stalled, by a
timer; the next event ends that.

State is kept by RocksDB and can be read between batches: see `outputs` and `errors`.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE = "run_id long, current_iteration int, errors long, documented long, last_iteration int, status string, resumable boolean, stalled boolean"
#: What a query over `replayed` needs beside its own settings.
SETTINGS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
NOTHING = (None, None, 0, 0, 0, None, None, 0)
# Spark asks a processor for its state variables in a worker that knows none of the files given to the others
register_pickle_by_value(sys.modules[__name__])


def left_over(pairs: list[tuple[int, int]], after: int | None) -> list[tuple[int, int]]:
    """Of (seq, iteration) those after a seq that count if any prefix of them goes: highest seq first, each with a higher iteration than all before."""
    out: list[tuple[int, int]] = []
    for seq, iteration in sorted(pairs, reverse=True):
        if (after is None or seq > after) and (not out or iteration > out[-1][1]):
            out.append((seq, iteration))
    return out


class Run(StatefulProcessor):
    """The state of one run."""

    def __init__(self, stall_ms: int) -> None:
        self.stall_ms = stall_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", "last_seq long, last_iteration int, errors long, documented long, starts long, status string, status_seq long, seen_ms long")
        self.later = handle.getListState("later", "seq long, iteration int")
        self.outputs = handle.getMapState("outputs", "component_id string, stream string", "seq long, output_path string")
        self.errors = handle.getListState("errors", "seq long, component_id string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last_seq, last, errors, documented, starts, status, status_seq, seen = self.totals.get() if self.totals.exists() else NOTHING
        pairs, paths, failed = list(self.later.get()) if self.later.exists() else [], {}, []
        for r in rows:
            seen = max(seen, r.ms)
            if r.type == "iteration_complete":
                last_seq = r.seq if last_seq is None else max(last_seq, r.seq)
                last = r.iteration if last is None or r.iteration is not None and r.iteration > last else last
            elif r.type == "component_documented":
                documented += 1
                if r.iteration is not None:
                    pairs.append((r.seq, r.iteration))
                at = (r.component_id, r.stream)
                paths[at] = max(paths.get(at, (-1, "")), (r.seq, f"{key[0]}/{r.component_id}/{r.seq}"))
            elif r.type == "error":
                errors += 1
                failed.append((r.seq, r.component_id))
            elif r.type == "run_start":
                starts += 1
            elif r.type == "run_complete" and (status_seq is None or r.seq > status_seq):
                status, status_seq = r.status, r.seq
        pairs = left_over(pairs, last_seq)
        for at, found in paths.items():
            if not self.outputs.containsKey(at) or tuple(self.outputs.getValue(at)) < found:
                self.outputs.updateValue(at, found)
        if failed:
            self.errors.appendList(failed)
        if pairs:
            self.later.put(pairs)
        elif self.later.exists():
            self.later.clear()
        self.totals.update((last_seq, last, errors, documented, starts, status, status_seq, seen))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(seen + self.stall_ms, timerValues.getCurrentWatermarkInMs() + 1))
        yield self.told(key[0], False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield self.told(key[0], True)

    def told(self, run_id: int, stalled: bool) -> Row:
        _, last, errors, documented, starts, status, _, _ = self.totals.get()
        pairs = list(self.later.get()) if self.later.exists() else []
        current = max(1 if last is None else last + 1, max((iteration for _, iteration in pairs), default=1))
        return Row(run_id=run_id, current_iteration=current, errors=errors, documented=documented, last_iteration=last or 0, status=status, resumable=starts > 0 and status in (None, "failed"), stalled=stalled and status is None)

    def close(self) -> None:
        pass


def replayed(log: DataFrame, late: str = "1 hour", stall_hours: float = 24 * 7) -> DataFrame:
    """The states of the runs that a batch of log (run_id, seq, ts, type, component_id, stream, iteration, status) changes."""
    ts = F.col("ts").cast("timestamp")
    rows = log.filter("run_id IS NOT NULL AND seq IS NOT NULL AND ts IS NOT NULL").select(F.col("run_id").cast("long").alias("run_id"), F.col("seq").cast("long").alias("seq"), ts.alias("ts"), F.unix_millis(ts).alias("ms"), "type", "component_id", "stream", F.col("iteration").cast("int").alias("iteration"), "status")
    return rows.withWatermark("ts", late).groupBy("run_id").transformWithState(Run(int(stall_hours * 3_600_000)), STATE, "Update", "EventTime")


def latest(states: DataFrame, number: str = "batch") -> DataFrame:
    """Each run's state of the last batch that told one; of a batch that told two, the one that isn't stalled."""
    names = [f.split()[0] for f in STATE.split(", ")[1:]]
    last = F.max_by(F.struct(*names), F.struct(number, ~F.col("stalled")))
    return states.groupBy("run_id").agg(last.alias("s")).select("run_id", "s.*")


def outputs(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(run_id, component_id, stream, seq, output_path) from the state that a query's checkpoint holds."""
    held = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "outputs").load()
    return held.select("key.run_id", "user_map_key.*", "user_map_value.*")


def errors(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(run_id, seq, component_id) of all errors, from the state that a query's checkpoint holds."""
    held = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "errors").option("flattenCollectionTypes", "true").load()
    return held.select("key.run_id", "list_element.*")
