"""Replay as a stream: any split and any order of a log gives the state of the whole log."""

import datetime as dt
import random

import pytest

from accordis.operators import history
from accordis.sources.versions import Versions
from accordis.streaming import eventlog, replay, sides

START = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
LOG = "run_id long, seq long, ts timestamp, type string, component_id string, stream string, iteration int, status string"
KINDS = ["component_documented"] * 6 + ["iteration_complete", "error", "run_start", "run_complete"]


def made(n, seed):
    rng = random.Random(seed)
    out = []
    for seq in range(n):
        kind = rng.choice(KINDS)
        out.append((rng.randrange(5), seq, START + dt.timedelta(minutes=seq), kind, f"c{rng.randrange(4)}", rng.choice("AB"), rng.randint(1, 9), rng.choice(["completed", "failed"]) if kind == "run_complete" else "completed"))
    return out


def write(spark, folder, rows):
    spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(folder)


def run(spark, tmp_path, table, late="1000 hours", **more):
    stream = eventlog.read(spark, f"file://{tmp_path}/log", files_per_trigger=1)
    settings = replay.SETTINGS | {"spark.sql.shuffle.partitions": "2"}
    sides.write_once(replay.replayed(stream, late, **more), table, "replay", f"file://{tmp_path}/checkpoint", number="batch", mode="update", settings=settings).awaitTermination()


@pytest.mark.parametrize("order", ["in order", "shuffled"])
def test_splits_and_restarts_give_the_state_of_the_whole_log(spark, tmp_path, order):
    events = made(300, 7)
    if order == "shuffled":
        random.Random(8).shuffle(events)
    table = Versions(spark, f"file://{tmp_path}/states")
    for a, b in ((0, 1), (1, 140), (140, 300)):  # the query ends and starts anew between these
        write(spark, f"file://{tmp_path}/log", events[a:b])
        if b == 140:
            write(spark, f"file://{tmp_path}/log", events[a:a])  # an empty batch
        run(spark, tmp_path, table)
    log = spark.createDataFrame(events, LOG)
    got = replay.latest(table.read())
    columns = ["run_id", "current_iteration", "errors", "documented", "last_iteration"]
    assert {tuple(r) for r in got.select(columns).collect()} == {tuple(r) for r in history.replay(log).select(columns).collect()}
    assert {(r.run_id, r.status) for r in got.collect()} == {tuple(r) for r in history.run_status(log).collect()}
    assert {r.run_id for r in got.filter("resumable").collect()} == {r.run_id for r in history.resumable(log).collect()}
    # what is kept can be read without the query
    checkpoint = f"file://{tmp_path}/checkpoint"
    paths = replay.outputs(spark, checkpoint)
    want = {}
    for e in sorted(events, key=lambda e: e[1]):
        if e[3] == "component_documented":
            want[e[0], e[4], e[5]] = f"{e[0]}/{e[4]}/{e[1]}"
    assert {(r.run_id, r.component_id, r.stream): r.output_path for r in paths.collect()} == want
    assert sorted((r.run_id, r.seq) for r in replay.errors(spark, checkpoint).collect()) == sorted((e[0], e[1]) for e in events if e[3] == "error")


def test_runs_that_stall_are_told(spark, tmp_path):
    at = lambda h: START + dt.timedelta(hours=h)
    event = lambda run, seq, h, kind="component_documented": (run, seq, at(h), kind, "c", "A", 1, "completed")
    table = Versions(spark, f"file://{tmp_path}/states")
    for rows in ([event(1, 0, 0, "run_start"), event(2, 1, 0), event(3, 2, 1, "run_complete")], [event(2, 3, 20)], [event(9, 4, 30)], [event(1, 5, 31)], [event(9, 6, 32)]):
        write(spark, f"file://{tmp_path}/log", rows)
        run(spark, tmp_path, table, late="1 hour", stall_hours=12)
    told = [(r.run_id, r.stalled) for r in table.read().orderBy("batch", "run_id").collect()]
    assert (1, True) in told and (2, True) not in told and (3, True) not in told  # 3 is complete, 2 went on in time
    assert {r.run_id: r.stalled for r in replay.latest(table.read()).collect()}[1] is False  # an event ended it


def test_pairs_that_may_count():
    rng = random.Random(3)
    for _ in range(200):
        pairs = [(rng.randrange(30), rng.randrange(6)) for _ in range(rng.randrange(12))]
        kept = replay.left_over(pairs, None)
        for after in range(-1, 31):
            highest = lambda of: max((i for s, i in of if s > after), default=None)  # noqa: B023, E731
            assert highest(kept) == highest(pairs)
            assert replay.left_over(kept, after) == replay.left_over(pairs, after)
