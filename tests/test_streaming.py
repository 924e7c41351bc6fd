import datetime as dt

from pyspark.sql import functions as F

from accordis.operators.reconcile import edge_sides
from accordis.sources.versions import Versions
from accordis.streaming import eventlog as e
from accordis.streaming import sides

START = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def write(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def events():
    return [(i, START + dt.timedelta(minutes=7 * i), i % 3, "view" if i % 2 else "click", float(i)) for i in range(60)]


EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double"


def test_windows_of_a_stream_equal_the_batch_on_closed_windows(spark, tmp_path):
    folder = f"file://{tmp_path}/events"
    write(spark, folder, events(), EVENT)
    batch = spark.read.parquet(folder)
    got = e.run_once(e.windowed(e.timed(e.read(spark, folder), "10 minutes")), "tumbling").collect()
    want = set(map(tuple, e.windowed(batch).collect()))
    closed = {w for w in want if w[1].replace(tzinfo=dt.UTC) <= START + dt.timedelta(minutes=7 * 59 - 10)}
    assert set(map(tuple, got)) == closed and len(closed) > 5


def test_repeated_events_count_once(spark, tmp_path):
    folder = f"file://{tmp_path}/events"
    write(spark, folder, events() + events()[:10], EVENT)
    assert e.run_once(e.deduplicated(e.timed(e.read(spark, folder)), ["event_id"]), "once").count() == 60


def test_tickets_expire_or_end(spark, tmp_path):
    folder = f"file://{tmp_path}/tickets"
    schema = "ticket_key string, ts timestamp, status string"
    write(spark, folder, [("a", START, "pending"), ("b", START, "pending"), ("c", START, "pending")], schema)
    write(spark, folder, [("b", START + dt.timedelta(hours=2), "resolved"), ("z", START + dt.timedelta(hours=80), "pending")], schema)
    write(spark, folder, [("z", START + dt.timedelta(hours=81), "pending")], schema)
    stream = e.timed(e.read(spark, folder, files_per_trigger=1), "1 hour")
    got = {r["ticket_key"]: r["status"] for r in e.run_once(e.ticket_states(stream), "ends", checkpoint=f"file://{tmp_path}/checkpoint").collect()}
    assert got == {"a": "expired", "b": "resolved", "c": "expired"}


def test_sliding_windows_and_sessions(spark):
    batch = spark.createDataFrame(events(), EVENT)
    assert e.windowed(batch, "1 hour", "30 minutes").agg(F.sum("n")).first()[0] == 120
    assert e.sessions(batch, "10 minutes").count() == 60 and e.sessions(batch, "30 minutes").count() == 3


EDGE = "component_id long, caller string, callee string, ts timestamp"


def edges(*of):
    return [(c, f"f{c}", callee, START + dt.timedelta(hours=h)) for c, callee, h in of]


def sides_of(spark, tmp_path, table, after=None):
    """The join of two folders into a table, until all files are read."""
    folders = [f"file://{tmp_path}/{side}" for side in "ab"]
    a, b = (e.timed(e.read(spark, f, files_per_trigger=1), "2 hours") for f in folders)
    query = sides.write_once(sides.documented_sides(a, b, "6 hours"), table, "sides", f"file://{tmp_path}/checkpoint")
    query.awaitTermination()
    return query


def test_stream_join_over_restarts_equals_the_batch(spark, tmp_path, monkeypatch):
    table = Versions(spark, f"file://{tmp_path}/out")
    early = [(1, "x", 0), (1, "y", 1), (2, "x", 2), (3, "x", 3), (3, "x", 3)], [(1, "x", 2), (2, "x", 9), (2, "z", 3)]
    later = [(4, "x", 30), (5, "x", 31)], [(4, "x", 33), (1, "y", 5), (6, "q", 31)]  # B's row for (1, y) is old, but not too old: A's still waits
    last = [(9, "end", 90), (2, "late", 4)], [(9, "end", 90)]  # the watermark leaves out a row that is older than it
    for n, (a, b) in enumerate((early, later, last)):
        write(spark, f"file://{tmp_path}/a", edges(*a), EDGE)
        write(spark, f"file://{tmp_path}/b", edges(*b), EDGE)
        if n == 1:  # the batch is written, then the query dies: it is run again under the same number
            append, fail = Versions.append, [True]

            def dies(self, *args, **more):
                append(self, *args, **more)
                if fail.pop() if fail else False:
                    raise RuntimeError("after the commit")

            monkeypatch.setattr(Versions, "append", dies)
            try:
                sides_of(spark, tmp_path, table)
            except Exception as failed:  # noqa: BLE001
                assert "after the commit" in str(failed)
            monkeypatch.undo()
            assert not fail
        sides_of(spark, tmp_path, table)
    on_time = [spark.createDataFrame(edges(*[r for part in (early, later, last) for r in part[side] if r != (2, "late", 4)]), EDGE) for side in (0, 1)]
    closed = F.coalesce("a_ts", "b_ts") < F.lit(START + dt.timedelta(hours=82))
    want = sides.documented_sides(*on_time, "6 hours").filter(closed)
    got = table.read().filter(closed)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 9
    # and on closed time the same edges stand on the same sides as in the whole comparison, where pairs are near enough
    whole = {tuple(r) for r in edge_sides(*on_time).filter("component_id < 9 AND NOT (component_id = 2 AND callee = 'x')").collect()}
    assert {tuple(r) for r in got.drop("a_ts", "b_ts").filter("NOT (component_id = 2 AND callee = 'x')").collect()} == whole
    assert table.manifest().writers["sides"] >= 3


def test_join_by_tables_over_restarts_equals_the_batch(spark, tmp_path, monkeypatch):
    """Batches without state stores give what the whole tables give: pairs over several batches, repeats, late rows, a batch that is run again."""
    table, waiting = (Versions(spark, f"file://{tmp_path}/{name}") for name in ("out", "waiting"))

    def run():
        a, b = (e.read(spark, f"file://{tmp_path}/{side}", files_per_trigger=1) for side in "ab")
        query = sides.join_once(a, b, table, waiting, "sides", f"file://{tmp_path}/checkpoint", "6 hours", "2 hours")
        query.awaitTermination()
        return query

    early = [(1, "x", 0), (1, "y", 1), (2, "x", 2), (3, "x", 3), (3, "x", 3), (7, "m", 8)], [(1, "x", 2), (2, "x", 9), (2, "z", 3), (7, "m", 8)]
    # B's row for (1, y) is old, but not too old: A's still waits; (7, m) has met one of B, and meets another; its A comes again
    later = [(4, "x", 30), (5, "x", 31), (7, "m", 8)], [(4, "x", 33), (1, "y", 7), (6, "q", 31), (7, "m", 9)]
    last = [(9, "end", 90), (2, "late", 4)], [(9, "end", 90), (4, "x", 34)]  # late, but for (4, x)
    for n, (a, b) in enumerate((early, later, last)):
        write(spark, f"file://{tmp_path}/a", edges(*a), EDGE)
        write(spark, f"file://{tmp_path}/b", edges(*b), EDGE)
        if n == 1:  # what waits is written, then the query dies before the rows are, and once more after that
            for dies_in in ("before", "after"):
                append, fail = Versions.append, [True]

                def dies(self, *args, append=append, fail=fail, dies_in=dies_in, **more):
                    if dies_in == "after":
                        append(self, *args, **more)
                    if fail.pop() if fail else False:
                        raise RuntimeError(f"{dies_in} the commit")
                    if dies_in == "before":
                        append(self, *args, **more)

                monkeypatch.setattr(Versions, "append", dies)
                try:
                    run()
                except Exception as failed:  # noqa: BLE001
                    assert f"{dies_in} the commit" in str(failed)
                monkeypatch.undo()
                assert not fail
        assert not run().lastProgress.stateOperators  # nothing is held in memory between batches
    on_time = [spark.createDataFrame(edges(*[r for part in (early, later, last) for r in part[side] if r != (2, "late", 4)]), EDGE) for side in (0, 1)]
    closed = F.coalesce("a_ts", "b_ts") < F.lit(START + dt.timedelta(hours=82))
    want = sides.documented_sides(*on_time, "6 hours").filter(closed)
    got = table.read().filter(closed)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.filter("component_id = 7").count() == 2
    assert {r["callee"] for r in waiting.read().collect()} == {"end"}
