"""Layouts: plans without an exchange, skewed components, look-ups that read little; figures taken in passing; long sequences."""

import random
import time

from pyspark.sql import functions as F

from accordis.functions import text as x
from accordis.operators import reconcile, verification
from accordis.sources.layout import Lookup, Streams
from accordis.streaming import eventlog, progress

EDGES = "component_id long, caller string, callee string"


def made(spark, seed, hot=0):
    rng = random.Random(seed)
    rows = [(c, f"f{c}", f"g{rng.randrange(9)}") for c in range(60) for _ in range(rng.randrange(8))] + [(7, "f7", f"h{rng.randrange(3 * hot + 1)}") for _ in range(hot)]
    return spark.createDataFrame(rows, EDGES)


def test_three_way_comparison_needs_no_exchange(spark):
    a, b, t = (made(spark, i, hot=300) for i in range(3))
    held = Streams(spark, a, b, t, buckets=8)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = reconcile.classified(held.sources())
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        counts = held.counts()
        assert counts._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1  # of one row a component and slot
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sorted(map(str, got.collect())) == sorted(map(str, reconcile.three_way(a, b, t).collect()))
    # the component with most of the edges lies in many buckets, the others in one
    slots = {r["component_id"]: r["n"] for r in held.table().filter("source = 'a'").groupBy("component_id").agg(F.countDistinct("slot").alias("n")).collect()}
    assert slots.pop(7) > 20 and set(slots.values()) == {1}
    want = {r["component_id"]: (r["common"], r["only_a"], r["only_b"]) for r in reconcile.compare_streams(a, b, a.limit(0), b.limit(0)).collect()}
    assert {r["component_id"]: (r["common"], r["only_a"], r["only_b"]) for r in counts.collect()} == want
    held.write("b", a)  # one source anew, the others stay
    again = {r["component_id"]: (r["only_a"], r["only_b"]) for r in held.counts().collect()}
    assert set(again.values()) == {(0, 0)} and held.table().filter("source = 't'").count() == t.count()
    held.drop()


def rows_scanned(df):
    """Rows that the scans of a plan gave, after row groups were left out."""
    rows = df.collect()
    plan, todo, n = df._jdf.queryExecution().executedPlan(), [], 0
    todo.append(plan)
    while todo:
        node = todo.pop()
        if "AdaptiveSparkPlan" in node.getClass().getSimpleName():
            todo.append(node.executedPlan())
            continue
        if "FileSourceScan" in node.getClass().getSimpleName():
            n += node.metrics().get("numOutputRows").get().value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return rows, n


def test_look_ups_read_few_row_groups(spark, tmp_path):
    edges = spark.range(400_000).selectExpr("concat('c', pmod(xxhash64(id), 50000)) AS caller", "concat('d', pmod(xxhash64(id, 1), 50000)) AS callee").cache()
    known = Lookup(spark, f"file://{tmp_path}/edges")
    known.write(edges, group_bytes=64 << 10, distinct=5000)
    name = edges.first()["caller"]
    rows, read = rows_scanned(known.callees(name))
    assert sorted(r[0] for r in rows) == sorted(r[0] for r in edges.filter(F.col("caller") == name).select("callee").collect()) and rows
    assert read <= 40_000
    rows, read = rows_scanned(known.callers("d77"))
    assert len(rows) == edges.filter("callee = 'd77'").count() and read <= 40_000
    assert rows_scanned(known.callees("c12345x"))[1] <= 40_000  # a name inside the range that nobody has: bloom filters
    one = edges.first()
    assert known.has_edge(one["caller"], one["callee"]) and not known.has_edge(one["caller"], "nobody")
    edges.unpersist()


def test_lengths_of_common_subsequences():
    rng = random.Random(6)

    def table(a, b):
        row = [0] * (len(b) + 1)
        for p in a:
            now = [0]
            for j, q in enumerate(b):
                now.append(row[j] + 1 if p == q and p is not None else max(now[-1], row[j + 1]))
            row = now
        return row[-1]

    for _ in range(300):
        a, b = ([rng.choice(["x", "y", "z", "w", None]) for _ in range(rng.randrange(90))] for _ in range(2))
        assert x.lcs_length(a, b) == table(a, b)
    a, b = ([rng.randrange(50) for _ in range(10_000)] for _ in range(2))
    began = time.perf_counter()
    assert 1000 < x.lcs_length(a, b) < 10_000 and time.perf_counter() - began < 5


def test_null_sequences(spark):
    df = spark.createDataFrame([(["a"], None), (None, ["a"]), (None, None), ([], []), (["a", None], [None, "a"])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(x.lcs_similarity(F.col("a"), F.col("b"))).collect()] == [None, None, None, 1.0, 0.5]


def test_figures_are_those_of_the_rows_and_cost_no_job(spark):
    parts = spark.range(50).selectExpr("concat('c', id) AS component_id")
    rate = lambda items: items.withColumn("score", F.when(F.substring("component_id", -1, 1) == "7", 0.25).otherwise(1.0))
    registry = verification.Registry()
    registry.register("qa", verification.Strategy("qa", "core", lambda c: c.crossJoin(spark.range(2)), rate, lambda e: e.filter("score < 1")))
    pipeline = verification.Builder(registry).with_all().with_threshold(0.5).build()
    jobs = []
    for seen in (None, verification.Progress()):
        spark.sparkContext.setJobGroup(f"figures-{seen is None}", "")
        pipeline.run(parts, lambda _, items: items, seen).write.format("noop").mode("overwrite").save()
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"figures-{seen is None}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert seen.figures("qa") == {"items": 100, "failed": 10, "score": 92.5} and seen.figures("result") == {"components": 50, "passed": 45}
    assert jobs[0] == jobs[1]


def test_a_listener_hears_what_batches_counted(spark, tmp_path):
    folder = f"file://{tmp_path}/in"
    for n in range(3):
        spark.range(10 * n, 10 * n + 10).selectExpr("id AS event_id", "CAST(id % 4 AS DOUBLE) AS value").coalesce(1).write.mode("append").parquet(folder)
    told, ends = [], []
    listener = progress.Listener(lambda *what: told.append(what), lambda *what: ends.append(what))
    spark.streams.addListener(listener)
    try:
        stream = progress.observed(eventlog.read(spark, folder, files_per_trigger=1), "seen", rows=F.count(F.lit(1)), high=F.count_if(F.col("value") >= 3), last=F.max("event_id"))
        stream.writeStream.format("noop").queryName("heard").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
        until = time.time() + 20
        while not ends and time.time() < until:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert [(name, batch, rows) for name, batch, rows, _ in told] == [("heard", 0, 10), ("heard", 1, 10), ("heard", 2, 10)] and ends == [("heard", None)]
    assert sum(f["seen"]["high"] for *_, f in told) == 7 and max(f["seen"]["last"] for *_, f in told) == 29

