"""Components, layers and what never resolves, against plain reachability; rounds on long paths."""

import random

import pytest
from pyspark.sql import functions as F

from accordis.operators import cycles
from accordis.sources.scratch import cut


def reach(nodes, edges):
    to = {n: set() for n in nodes}
    for a, b in edges:
        to[a].add(b)
    out = {}
    for n in nodes:
        seen, todo = set(), list(to[n])
        while todo:
            if (x := todo.pop()) not in seen:
                seen.add(x)
                todo += to[x]
        out[n] = seen
    return out


def brute(edges):
    edges = {(a, b) for a, b in edges if a is not None and b is not None}
    nodes = {n for e in edges for n in e}
    ways = reach(nodes, edges)
    components = {n: {m for m in ways[n] if n in ways[m]} | {n} for n in nodes}
    stuck = {n for n in nodes if any(m in ways[m] for m in ways[n] | {n})}
    layers = {}

    def layer(n):
        if n not in layers:
            layers[n] = max((layer(b) + 1 for a, b in edges if a == n), default=0)
        return layers[n]

    return {(n, min(c), len(c), n in ways[n]) for n, c in components.items()}, {(n, layer(n)) for n in nodes - stuck}, stuck


def found(spark, edges):
    df = spark.createDataFrame(edges, "a string, b string")
    return {tuple(r) for r in cycles.strongly_connected(df).collect()}, {tuple(r) for r in cycles.layers(df).collect()}, {r[0] for r in cycles.unresolved(df).collect()}


def named(pairs):
    return [(None if a is None else f"n{a}", None if b is None else f"n{b}") for a, b in pairs]


def graphs():
    rng = random.Random(4)
    for n, m in ((12, 12), (30, 34), (30, 60)):
        yield [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
    ring = [(i, (i + 1) % 7) for i in range(7)]
    # two rings with a path between, one into and one out of them, a ring through a chain and back, a loop, a repeated and a broken edge
    yield ring + [(10 + a, 10 + b) for a, b in ring] + [(3, 20), (20, 21), (21, 12), (30, 31), (31, 0), (16, 40), (40, 41), (41, 42), (50, 50), (51, 50), (60, 61), (61, 62), (62, 60), (62, 63), (63, 64), (64, 62), (3, 20), (None, 1), (2, None)]
    yield [(i, i + 1) for i in range(25)] + [(i, 100 + i) for i in range(25)] + [(0, 9), (3, 20)]  # a path with leaves and shortcuts
    yield [(7, 7)]


@pytest.mark.parametrize("edges", list(graphs()))
def test_against_reachability(spark, edges):
    assert found(spark, named(edges)) == brute(named(edges))


def test_rounds_on_a_path_grow_with_the_logarithm(spark):
    took = {}
    for n in (64, 4096):
        path = spark.range(n).selectExpr("id AS a", "id + 1 AS b")
        rounds = cycles.Rounds()
        assert cycles.layers(path, rounds).selectExpr("count(*)", "max(layer)", "sum(layer)").first()[:] == (n + 1, n, n * (n + 1) // 2)
        whole = cycles.Rounds()
        assert cycles.strongly_connected(path, whole).selectExpr("count(*)", "max(size)").first()[:] == (n + 1, 1)
        took[n] = rounds.n, whole.n
    assert took[4096][0] <= took[64][0] + 7 and took[4096][1] <= took[64][1] + 14 and took[4096][0] < 30


def test_a_long_ring(spark):
    ring = spark.range(2000).selectExpr("id AS a", "(id + 1) % 2000 AS b").unionAll(spark.range(2000, 2300).selectExpr("id AS a", "id - 1 AS b"))
    got = cycles.strongly_connected(ring).filter("on_cycle").selectExpr("count(*)", "min(component)", "max(component)", "min(size)").first()
    assert got[:] == (2000, 0, 0, 2000)
    assert cycles.unresolved(ring).count() == 2300 and cycles.layers(ring).isEmpty()


def test_nothing(spark):
    assert found(spark, []) == (set(), set(), set())


def test_a_loop_of_self_joins_keeps_its_size_estimate(spark, capsys):
    rows = spark.range(8).selectExpr("id", "id + 1 AS b")
    for _ in range(8):
        rows = cut(rows.join(rows.select("id", F.col("b").alias("c")), "id").select("id", F.greatest("b", "c").alias("b")))
    rows.explain("cost")
    said = capsys.readouterr().out
    assert rows.count() == 8 and "sizeInBytes=" in said and "EiB" not in said and "E+" not in said


def test_a_tree_takes_a_round_a_layer(spark):
    tree = spark.range(1, 4096).selectExpr("id AS a", "id div 2 AS b")
    rounds = cycles.Rounds()
    assert cycles.strongly_connected(tree, rounds).selectExpr("count(*)", "max(size)", "count_if(on_cycle)").first()[:] == (4096, 1, 0)
    assert rounds.n <= 20
