"""Two streams of documented edges, joined as they come, and a sink that takes each micro-batch once.

An edge that A documents waits for B's, and the other way round, for `within` of event time; when the watermark has passed that, it
comes out alone. State is bounded by the edges of that time. Sinks are versioned tables: a batch's rows and its number become
visible in one rename, so a batch that is run again after a failure adds nothing.

The same join comes in two forms. `documented_sides` keeps its state in Spark's stores, a row at a time: for short batches. `join_once`
keeps the edges that still wait in a versioned table, and joins a batch with them as tables, which spill and sort: for batches of
any size, such as a backlog that is read at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.reconcile import KEY
from ..sources.versions import Versions


def documented_sides(a: DataFrame, b: DataFrame, within: str = "1 day") -> DataFrame:
    """Edges (component_id, caller, callee, ts) of two streams, or two tables, with in_a, in_b and the times at which each documented them.

    A pair meets if its times are at most `within` apart; an edge without one stands alone. Streams need watermarks on ts.
    Repeated rows of a stream count once; nulls in the key match nothing.
    """
    one = lambda rows, side: rows.select(*(F.col(c).alias(f"{side}_{c}") for c in (*KEY, "ts"))).dropDuplicates([f"{side}_{c}" for c in (*KEY, "ts")])
    left, right, gap = one(a, "a"), one(b, "b"), F.expr(f"INTERVAL {within}")
    same = (F.col("b_ts") >= F.col("a_ts") - gap) & (F.col("b_ts") <= F.col("a_ts") + gap)
    for c in KEY:
        same &= F.col(f"a_{c}") == F.col(f"b_{c}")
    both = left.join(right, same, "full_outer")
    return both.select(*(F.coalesce(f"a_{c}", f"b_{c}").alias(c) for c in KEY), F.col("a_ts").isNotNull().alias("in_a"), F.col("b_ts").isNotNull().alias("in_b"), "a_ts", "b_ts")


def write_once(stream: DataFrame, table: Versions, writer: str, checkpoint: str, keep: int = 100, number: str | None = None, mode: str = "append", settings: dict[str, str] | None = None, **trigger) -> StreamingQuery:
    """Start a query that appends every micro-batch to a table, each as one version and each once, whatever fails in between.

    writer names the query: several may fill one table. number: a column that gets the batch's number. trigger is that of
    DataStreamWriter, all that there is by default. Of the versions, `keep` stay. settings hold for this query only; the number of
    shuffle partitions, into which state is dealt, stays with its checkpoint. How much a batch reads is the source's
    setting (maxFilesPerTrigger, maxBytesPerTrigger).
    """

    def take(batch: DataFrame, n: int) -> None:
        target = Versions(batch.sparkSession, table.path, table.kind)
        if target.has(writer, n):  # run again after a failure: the state must still come about, its rows are there
            batch.write.format("noop").mode("overwrite").save()
            return
        target.append(batch.withColumn(number, F.lit(n).cast("long")) if number else batch, writer=(writer, n))
        if n % keep == keep - 1:
            target.retain(keep)

    conf = stream.sparkSession.conf
    before = {k: conf.get(k, None) for k in settings or {}}
    try:
        for k, v in (settings or {}).items():
            conf.set(k, v)
        out = stream.writeStream.queryName(writer).outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(take)
        return out.trigger(**trigger or {"availableNow": True}).start()  # a query takes its own copy of the settings when it starts
    finally:
        for k, v in before.items():
            if v is None:
                conf.unset(k)
            else:
                conf.set(k, v)


#: Rows of a batch for each partition of its join.
PART_ROWS = 500_000


def _sides(rows: DataFrame, gap: Column, parts: int) -> DataFrame:
    """Full outer join of a's and b's among rows (side, key, ts, old, met), each of which counts once; a side shuffles once for both."""

    def one(side: str) -> DataFrame:
        once = rows.filter(F.col("side") == side).repartition(parts, *KEY).groupBy(*KEY, "ts").agg(F.bool_or("old").alias("old"), F.bool_or("met").alias("met"))
        return once.select(*(F.col(c).alias(f"{side}_{c}") for c in (*KEY, "ts", "old", "met")))

    left, right = one("a"), one("b")
    same = (F.col("b_ts") >= F.col("a_ts") - gap) & (F.col("b_ts") <= F.col("a_ts") + gap)
    for c in KEY:
        same &= F.col(f"a_{c}") == F.col(f"b_{c}")
    return left.join(right, same, "full_outer")


def join_once(a: DataFrame, b: DataFrame, table: Versions, waiting: Versions, writer: str, checkpoint: str, within: str = "1 day", late: str = "1 hour", keep: int = 100, **trigger) -> StreamingQuery:
    """Start a query that appends documented_sides of two streams to a table, each micro-batch as one version and once.

    The watermark is the lesser of the latest times that both streams have brought, less `late`. A row that is not above that of the
    batch before is left out; an edge stays in `waiting` while one that isn't late could still meet it, and then comes out alone if none
    did. Rows without a time are left out. Watermark and waiting edges of a batch are one version, and a batch that is run again starts
    from the version of the batch before. Neither stream needs a watermark of its own.
    """
    side = lambda rows, name: rows.select(F.lit(name).alias("side"), *KEY, F.col("ts").cast("timestamp").alias("ts"))
    gap = F.expr(f"INTERVAL {within}")

    def bound(marks: dict[str, int]) -> Column | None:
        known = [marks.get(f"{writer} {s}") for s in "ab"]
        return None if None in known else F.timestamp_micros(F.lit(min(known))) - F.expr(f"INTERVAL {late}")

    def take(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        target, held = Versions(spark, table.path, table.kind), Versions(spark, waiting.path, waiting.kind)
        if target.has(writer, n):
            return
        before = next((m for m in map(held.manifest, reversed(held.numbers())) if m.writers.get(writer, -1) < n), None)
        marks = before.writers if before else {}
        batch = batch.filter("ts IS NOT NULL")
        brought = {r["side"]: r for r in batch.groupBy("side").agg(F.unix_micros(F.max("ts")).alias("us"), F.count(F.lit(1)).alias("n")).collect()}
        after = {k: v for k, v in marks.items() if k != writer}
        for s, r in brought.items():
            after[f"{writer} {s}"] = max(r["us"], after.get(f"{writer} {s}", r["us"]))
        floor, closed = bound(marks), bound(after)
        rows = (batch if floor is None else batch.filter(F.col("ts") > floor)).withColumns({"old": F.lit(False), "met": F.lit(False)})
        if before:
            rows = held.read(before.version).withColumn("old", F.lit(True)).unionByName(rows)
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(r["n"] for r in brought.values()) // PART_ROWS)

        # what waits has partners of at most two gaps below the watermark
        near = _sides(rows if closed is None else rows.filter(F.col("ts") + gap + gap > closed), gap, parts)
        kept = None
        for s, other in ("ab", "ba"):
            open_rows = near.filter(F.col(f"{s}_ts").isNotNull() if closed is None else F.col(f"{s}_ts") + gap > closed)
            open_rows = open_rows.select(F.lit(s).alias("side"), *(F.col(f"{s}_{c}").alias(c) for c in (*KEY, "ts")), (F.col(f"{s}_met") | F.col(f"{other}_ts").isNotNull()).alias("met"))
            kept = open_rows if kept is None else kept.unionAll(open_rows)
        held.overwrite(kept.groupBy("side", *KEY, "ts").agg(F.bool_or("met").alias("met")), writer=(writer, n), marks=after)

        pair = F.col("a_ts").isNotNull() & F.col("b_ts").isNotNull()
        out = pair & ~(F.col("a_old") & F.col("b_old"))
        if closed is not None:
            out |= ~pair & ~F.coalesce("a_met", "b_met") & (F.coalesce("a_ts", "b_ts") + gap <= closed)
        found = _sides(rows, gap, parts).filter(out)
        found = found.select(*(F.coalesce(f"a_{c}", f"b_{c}").alias(c) for c in KEY), F.col("a_ts").isNotNull().alias("in_a"), F.col("b_ts").isNotNull().alias("in_b"), "a_ts", "b_ts")
        target.append(found, writer=(writer, n))
        held.retain(2)
        if n % keep == keep - 1:
            target.retain(keep)

    both = side(a, "a").unionAll(side(b, "b"))
    return both.writeStream.queryName(writer).option("checkpointLocation", checkpoint).foreachBatch(take).trigger(**trigger or {"availableNow": True}).start()
