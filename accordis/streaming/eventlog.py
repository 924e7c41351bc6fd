"""Structured Streaming over event logs: windows, sessions, deduplication and ticket expiry.

Event time must be a TIMESTAMP: a column without a zone is cast first. Sources are any streaming DataFrame; `read` takes a
folder of Parquet files with the log's schema.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read(spark: SparkSession, folder: str, pattern: str = "*.parquet", schema=None, files_per_trigger: int = 16) -> DataFrame:
    """A stream of the Parquet files that match a pattern in a folder."""
    schema = schema or spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def timed(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """events with ts as a TIMESTAMP and a watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def windowed(events: DataFrame, length: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Events and summed value by type in tumbling windows, or sliding ones if a slide is given."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("value")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Events of a user with pauses below the gap, as one row."""
    s = F.session_window("ts", gap)
    return events.groupBy(s.alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("s.start").alias("start"), F.col("s.end").alias("end"), "user_id", "n")


def deduplicated(events: DataFrame, keys: list[str]) -> DataFrame:
    """The first event of each key within the watermark."""
    return events.dropDuplicatesWithinWatermark(keys)


def ticket_states(events: DataFrame, hours: int = 48) -> DataFrame:
    """(ticket_key, status, at) as tickets end: resolved by an event, or expired `hours` after the first one without.

    The state of a ticket is its deadline; it goes when the ticket ends, so state is bounded by open tickets.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (deadline,) = state.get
            state.remove()
            yield pd.DataFrame({"ticket_key": [key[0]], "status": ["expired"], "at": [pd.Timestamp(deadline, unit="ms")]})
            return
        rows = pd.concat(list(batches)).sort_values("ts")
        ended = rows[rows["status"] != "pending"]
        if len(ended):
            if state.exists:
                state.remove()
            yield pd.DataFrame({"ticket_key": [key[0]], "status": [ended["status"].iloc[0]], "at": [ended["ts"].iloc[0]]})
            return
        if state.exists:
            (deadline,) = state.get
        else:
            deadline = int(rows["ts"].iloc[0].timestamp() * 1000) + hours * 3_600_000
            state.update((deadline,))
        state.setTimeoutTimestamp(max(deadline, state.getCurrentWatermarkMs() + 1))

    kept = events.select("ticket_key", "ts", "status")
    return kept.groupBy("ticket_key").applyInPandasWithState(step, "ticket_key string, status string, at timestamp", "deadline long", "append", GroupStateTimeout.EventTimeTimeout)


def run_once(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Everything that is there now, through the stream, as a table in memory: for tests and small reports."""
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
