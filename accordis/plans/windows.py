"""Event-time queries that the streaming forms must agree with (extensions ST1-ST3), over whole tables."""

from pyspark.sql import functions as F

from ..streaming import eventlog as e
from .registry import query


def events(t):
    return t.events.withColumn("ts", F.col("ts").cast("timestamp"))


@query("st1_tumbling_windows", "SELECT epoch_us(date_trunc('hour', ts)) AS start_us, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY 1, 2")
def _(t):
    return e.windowed(events(t)).select(F.unix_micros("start").alias("start_us"), "event_type", "n", "value")


@query("st1_session_windows", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM s GROUP BY user_id, s""")
def _(t):
    return e.sessions(events(t)).select("user_id", F.unix_micros("start").alias("start_us"), "n")


@query("st3_first_events", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def _(t):
    return t.events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))
