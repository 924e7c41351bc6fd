"""Incremental rounds against full runs: what is compared, what is read, and what a broken round leaves."""

import random

import pytest

from accordis.operators import incremental, reconcile
from accordis.sources.versions import Versions

EDGES = "component_id long, caller string, callee string"


def made(spark, rng, components, callees=12):
    rows = {(c, f"f{c}", f"g{rng.randrange(callees)}") for c in components for _ in range(rng.randint(1, 6))}
    return spark.createDataFrame(sorted(rows) + sorted(rows)[:3], EDGES)  # some rows twice


def rows(df):
    return sorted(map(str, df.select("component_id", "caller", "callee", "in_a", "in_b", "hint", "resolution", "source", "confidence").collect()))


@pytest.fixture
def tables(spark, tmp_path):
    return [Versions(spark, f"file://{tmp_path}/{name}") for name in ("a", "b", "hints", "results")]


def test_three_rounds_equal_full_runs(spark, tables, monkeypatch):
    a, b, hints, results = tables
    rng = random.Random(1)
    for table, ids in ((a, range(200)), (b, range(10, 210)), (hints, range(0, 210, 2))):
        incremental.start(table, made(spark, rng, ids), buckets=16)

    def full():
        return rows(incremental.discrepancies(*(t.read() for t in (a, b, hints))))

    first = incremental.reconcile_changes(*tables)
    assert rows(incremental.found(results)) == full() and first.compared == 210 and first.buckets == 16
    assert incremental.reconcile_changes(*tables) == incremental.Round(first.version, 0, 0, 0, 0)  # nothing new: no rows are read
    few = spark.createDataFrame([(c,) for c in (3, 50)], "component_id long")
    incremental.change(a, made(spark, rng, (3, 50), 40), few)
    second = incremental.reconcile_changes(*tables)
    assert rows(incremental.found(results)) == full()
    assert 1 <= second.compared <= 2 and second.buckets <= 2 and second.rows_read < first.rows_read / 4
    # a component goes from everywhere, one comes, and one is written again as it was
    gone = spark.createDataFrame([(5,), (300,), (7,)], "component_id long")
    same = a.read().filter("component_id = 7").drop("bucket")
    incremental.change(a, made(spark, rng, (300,)).unionAll(same), gone)
    for table in (b, hints):
        kept = table.read().filter("component_id IN (7, 300)").drop("bucket")
        incremental.change(table, kept, gone)
    third = incremental.reconcile_changes(*tables)
    assert rows(incremental.found(results)) == full()
    assert third.gone == 1 and third.compared == 1 and third.buckets <= 3
    assert rows(incremental.found(results, first.version)) != full()  # older rounds can still be read


def test_a_round_that_dies_is_run_again(spark, tables, monkeypatch):
    a, b, hints, results = tables
    rng = random.Random(2)
    for table in (a, b, hints):
        incremental.start(table, made(spark, rng, range(30)), buckets=4)
    monkeypatch.setattr(Versions, "_commit", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        incremental.reconcile_changes(*tables)
    monkeypatch.undo()
    assert results.manifest() is None
    assert incremental.reconcile_changes(*tables).compared == 30
    assert rows(incremental.found(results)) == rows(incremental.discrepancies(*(t.read() for t in (a, b, hints))))


def test_settling_stops_when_nothing_is_open(spark):
    edge = "component_id long, caller string, callee string, in_a boolean, in_b boolean, hint boolean, review boolean"
    edges = spark.createDataFrame([(1, "f", "x", True, False, True, False), (1, "f", "y", False, True, False, False), (1, "f", "z", True, True, None, False), (2, "g", "x", True, True, True, False), (3, "h", "x", False, True, None, False), (3, "h", "y", False, True, True, False)], edge)
    settled, n = reconcile.iterate(edges, incremental.settle, incremental.divergent, 5)
    got = {(r.component_id, r.callee): (r.in_a, r.in_b, r.review) for r in settled.collect()}
    assert n == 1 and got == {(1, "x"): (True, True, False), (1, "y"): (False, True, True), (1, "z"): (True, True, False), (2, "x"): (True, True, False), (3, "x"): (False, True, True), (3, "y"): (True, True, False)}
    assert reconcile.iterate(settled, incremental.settle, incremental.divergent, 5)[1] == 0


def test_no_components(spark, tables):
    for table in tables[:3]:
        incremental.start(table, spark.createDataFrame([], EDGES))
    assert incremental.reconcile_changes(*tables).compared == 0 and incremental.found(tables[3]).count() == 0
