"""Queries on versioned tables, streams into them and incremental rounds (K2, K7, K8, S12, ST4-8, C11, JN5)."""

from pyspark.sql import functions as F

from ..operators import incremental, reconcile
from ..sources.scratch import new_folder
from ..sources.versions import Versions
from ..streaming import eventlog, replay, sides
from ..tables import RELATIONS
from .reconciliation import SIDES
from .registry import SQL, query


def state_settings(rows: int) -> dict[str, str]:
    """State dealt to one partition for each quarter of a million rows, four at least."""
    return {"spark.sql.shuffle.partitions": str(max(4, rows // 250_000))}


def history(t):
    """A table of orders by status with four versions: finished orders, open ones added, finished ones replaced, all of one priority."""
    table = Versions(t.spark, new_folder(t.spark))
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.lit(0).alias("round"))
    table.overwrite(rows.filter("status = 'F'"), "status")
    table.append(rows.filter("status = 'O'"), "status")
    table.replace(rows.filter("status = 'F' AND id % 2 = 0").withColumn("round", F.lit(2)), "status")
    table.overwrite(rows.filter("priority = '1-URGENT'").withColumn("round", F.lit(3)), "status")
    return table


_HELD = """(SELECT 1 AS version, o_orderkey AS id, o_orderstatus AS status, 0 AS round FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 2, o_orderkey, o_orderstatus, 0 FROM orders WHERE o_orderstatus IN ('F', 'O')
    UNION ALL SELECT 3, o_orderkey, o_orderstatus, 2 FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 2 = 0 UNION ALL SELECT 3, o_orderkey, o_orderstatus, 0 FROM orders WHERE o_orderstatus = 'O'
    UNION ALL SELECT 4, o_orderkey, o_orderstatus, 3 FROM orders WHERE o_orderpriority = '1-URGENT')"""


@query("k2_pinned_versions", f"SELECT * FROM {_HELD} h")
def _(t):
    """What readers of each version see, after all four were written."""
    table = history(t)
    out = None
    for version in table.numbers():
        rows = table.read(version).select(F.lit(version).alias("version"), "id", "status", "round")
        out = rows if out is None else out.unionAll(rows)
    return out


@query("s12_versions_left", f"SELECT version, CASE version WHEN 3 THEN 'replace' ELSE 'overwrite' END AS mode, n FROM (SELECT version, count(*) AS n FROM {_HELD} h GROUP BY version) WHERE version > 2")
def _(t):
    """The versions that retention of two leaves, newest first, with their rows."""
    table = history(t)
    table.retain(2, grace_s=0)
    counted = None
    for version in table.numbers():
        rows = table.read(version).agg(F.lit(version).cast("long").alias("version"), F.count(F.lit(1)).alias("n"))
        counted = rows if counted is None else counted.unionAll(rows)
    return table.history().join(F.broadcast(counted), "version").select("version", "mode", "n")


_STREAMED = """(SELECT DISTINCT l_orderkey AS component_id, concat('o', l_orderkey) AS caller, concat('p', l_partkey) AS callee, l_shipdate::TIMESTAMP AS ts FROM lineitem WHERE l_linenumber <= 6) a
    FULL JOIN (SELECT DISTINCT l_orderkey AS component_id, concat('o', l_orderkey) AS caller, concat('p', l_partkey) AS callee, l_shipdate::TIMESTAMP + to_hours(l_quantity::INT) AS ts FROM lineitem WHERE l_linenumber >= 2) b
    ON a.component_id = b.component_id AND a.callee = b.callee AND b.ts >= a.ts - INTERVAL 30 HOUR AND b.ts <= a.ts + INTERVAL 30 HOUR"""


@query("st4_stream_sides", f"""SELECT coalesce(a.component_id, b.component_id) AS component_id, coalesce(a.caller, b.caller) AS caller, coalesce(a.callee, b.callee) AS callee, a.ts IS NOT NULL AS in_a, b.ts IS NOT NULL AS in_b, epoch_us(a.ts) AS a_us, epoch_us(b.ts) AS b_us
    FROM {_STREAMED} WHERE coalesce(a.ts, b.ts) < (SELECT least(max(l_shipdate::TIMESTAMP) FILTER (l_linenumber <= 6), max(l_shipdate::TIMESTAMP + to_hours(l_quantity::INT)) FILTER (l_linenumber >= 2)) FROM lineitem) - INTERVAL 60 HOUR""")
def _(t):
    """Both streams read as streams, joined within 30 hours of event time and written once a batch, edges that wait in a table; of the
    result the time that is closed."""
    lines = lambda rows: rows.select(F.col("l_orderkey").alias("component_id"), F.concat(F.lit("o"), "l_orderkey").alias("caller"), F.concat(F.lit("p"), "l_partkey").alias("callee"), F.col("l_shipdate").alias("ts"), "l_linenumber", "l_quantity")
    a_of = lambda rows: lines(rows).filter("l_linenumber <= 6")
    b_of = lambda rows: lines(rows).filter("l_linenumber >= 2").withColumn("ts", F.col("ts") + F.make_dt_interval(hours=F.col("l_quantity").cast("int")))
    ended = [f(t.lineitem).agg(F.max(F.col("ts").cast("timestamp"))).first()[0] for f in (a_of, b_of)]
    read = lambda: eventlog.read(t.spark, t.dir, "lineitem.parquet")
    table, waiting = (Versions(t.spark, new_folder(t.spark)) for _ in range(2))
    sides.join_once(a_of(read()), b_of(read()), table, waiting, "st4", new_folder(t.spark), "30 hours", "2 hours").awaitTermination()
    closed = F.coalesce("a_ts", "b_ts") < F.least(*(F.lit(e) for e in ended)) - F.expr("INTERVAL 60 HOURS")
    return table.read().filter(closed).select("component_id", "caller", "callee", "in_a", "in_b", F.unix_micros("a_ts").alias("a_us"), F.unix_micros("b_ts").alias("b_us"))


@query("l4_stream_replay", SQL["l4_replay"])
def _(t):
    """The log read as a stream, a state kept for each run, and what the last batch told of each."""
    events = eventlog.read(t.spark, t.dir, "events.parquet")
    log = t.spark.sql(RELATIONS["log"].replace("FROM events", "FROM {events}"), events=events)
    table, checkpoint = Versions(t.spark, new_folder(t.spark)), new_folder(t.spark)
    settings = state_settings(t.events.count()) | replay.SETTINGS
    sides.write_once(replay.replayed(log), table, "l4", checkpoint, number="batch", mode="update", settings=settings).awaitTermination()
    return replay.latest(table.read()).select("run_id", "current_iteration", "errors", "documented", "last_iteration")


def rounds(t):
    """Three rounds over lineitem: all of it, then A forgets later lines of some orders, then the hints on some others go."""
    tables = [Versions(t.spark, new_folder(t.spark)) for _ in range(4)]
    a, b, hints, results = tables
    for table, edges in ((a, t.stream_a), (b, t.stream_b), (hints, t.hints)):
        incremental.start(table, edges)
    done = [incremental.reconcile_changes(*tables)]
    some = lambda n: t.orders.filter(f"o_orderkey % 997 = {n}").select(F.col("o_orderkey").alias("component_id"))
    incremental.change(a, t.lineitem.filter("l_linenumber <= 3").select(F.col("l_orderkey").alias("component_id"), F.concat(F.lit("o"), "l_orderkey").alias("caller"), F.concat(F.lit("p"), "l_partkey").alias("callee")), some(7))
    done.append(incremental.reconcile_changes(*tables))
    incremental.change(hints, t.hints.limit(0), some(11))
    done.append(incremental.reconcile_changes(*tables))
    return results, done


_A = "SELECT DISTINCT l_orderkey AS component_id, concat('o', l_orderkey) AS caller, concat('p', l_partkey) AS callee FROM lineitem WHERE l_linenumber <= CASE WHEN l_orderkey % 997 = 7 THEN 3 ELSE 6 END"
_H = "SELECT DISTINCT * FROM {hints} q WHERE component_id % 997 <> 11"


@query("jn5_incremental", f"""WITH s AS (SELECT coalesce(a.component_id, b.component_id) AS component_id, coalesce(a.caller, b.caller) AS caller, coalesce(a.callee, b.callee) AS callee, a.caller IS NOT NULL AS in_a, b.caller IS NOT NULL AS in_b
    FROM ({_A}) a FULL JOIN (SELECT DISTINCT * FROM {{stream_b}} y) b ON a.component_id = b.component_id AND a.callee = b.callee),
    h AS (SELECT s.*, CASE WHEN k.component_id IS NOT NULL THEN h.caller IS NOT NULL END AS hint FROM s LEFT JOIN (SELECT DISTINCT component_id FROM ({_H}) q) k ON k.component_id = s.component_id LEFT JOIN ({_H}) h ON h.component_id = s.component_id AND h.callee = s.callee WHERE in_a <> in_b)
    SELECT component_id, caller, callee, in_a, in_b, hint, CASE WHEN hint AND in_a THEN 'accept_stream_a' WHEN hint THEN 'accept_stream_b' ELSE 'needs_human_review' END AS resolution, CASE WHEN hint THEN 'ground_truth_hint' ELSE 'unresolved' END AS source, CASE WHEN hint THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM h""")
def _(t):
    """After three rounds, of which two compared only what had changed, the results are those of a full run."""
    return incremental.found(rounds(t)[0])


@query("jn5_round_sizes", f"""SELECT 1 AS round, (SELECT count(DISTINCT component_id) FROM (SELECT component_id FROM {{stream_a}} x UNION ALL SELECT component_id FROM {{stream_b}} y UNION ALL SELECT component_id FROM {{hints}} q)) AS compared
    UNION ALL SELECT 2, (SELECT count(DISTINCT component_id) FROM (SELECT component_id, callee FROM {{stream_a}} x WHERE component_id % 997 = 7 EXCEPT SELECT component_id, callee FROM ({_A}) a))
    UNION ALL SELECT 3, (SELECT count(DISTINCT component_id) FROM {{hints}} q WHERE component_id % 997 = 11)""")
def _(t):
    """Components that each round compared."""
    return t.spark.createDataFrame([(i, r.compared) for i, r in enumerate(rounds(t)[1], 1)], "round int, compared long")


@query("c11_iteration_rounds", f"""SELECT s.component_id AS id, count(*) FILTER (in_a = in_b OR h.caller IS NOT NULL) AS agreed, count(*) FILTER (in_a <> in_b AND h.caller IS NULL) AS left_over
    FROM {SIDES} s LEFT JOIN (SELECT DISTINCT * FROM {{hints}} q) h ON h.component_id = s.component_id AND h.callee = s.callee GROUP BY s.component_id""")
def _(t):
    """Rounds of settling what the streams differ in, only in components that still differ, five at most; what is left waits for a person."""
    edges = reconcile.hinted(reconcile.edge_sides(t.stream_a, t.stream_b), t.hints).withColumn("review", F.lit(False))
    settled, _ = reconcile.iterate(edges, incremental.settle, incremental.divergent, 5)
    return settled.groupBy(F.col("component_id").alias("id")).agg(F.count_if(F.col("in_a") & F.col("in_b")).alias("agreed"), F.count_if("review").alias("left_over"))
