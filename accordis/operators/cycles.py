"""Cycles, layers and what never resolves, in rounds that don't follow the length of paths.

Two things keep rounds few. Nodes that only pass on (one way in and one out, or, for layers, one way out) are taken out by pointer
jumping: each step doubles how far a node sees, so a path of a million nodes is one edge after 20 steps. And nodes that can't be
on a cycle go in bulk. What is left is coloured forward by the largest node that reaches each, and members of a cycle are those
that reach, inside their colour, the node it is named for. Rounds end in files of the shared folder; a round's joins are on distinct nodes on
one side at least.

Edges are (a, b), a depends on b; repeats and rows with a null end don't count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import cut, release


#: A round that leaves more than this share of the edges is a slow one.
SLOW = 0.75


class Rounds:
    """Counts the rounds of a computation: each is a join over what is left."""

    def __init__(self) -> None:
        self.n = 0

    def cut(self, df: DataFrame) -> DataFrame:
        self.n += 1
        return cut(df)


def jump(steps: DataFrame, rounds: Rounds) -> DataFrame:
    """steps (node, to, w, c), one a node, followed until `to` is no node of steps: w adds up along the way, c is the highest of what
    each node asks for at its place, low the smallest node passed. open: the way never ends, as it leads into a ring."""
    at = rounds.cut(steps.select("node", "to", "w", "c", F.col("node").alias("low")).join(steps.select(F.col("node").alias("_n")), F.col("to") == F.col("_n"), "left").withColumn("open", F.col("_n").isNotNull()).drop("_n"))
    reach, before = 1, -1
    while True:
        n = at.filter("open").count()
        # on a way that ends some come to its end each time; if nobody does, all that are left lead into rings, and see all of them in time
        if n == 0 or n == before and reach >= n:
            return at
        before = n
        ahead = at.select(F.col("node").alias("_n"), F.col("to").alias("_to"), F.col("w").alias("_w"), F.col("c").alias("_c"), F.col("low").alias("_low"), F.col("open").alias("_open"))
        moved = at.filter("open").join(ahead, F.col("to") == F.col("_n")).select("node", F.col("_to").alias("to"), (F.col("w") + F.col("_w")).alias("w"), F.greatest(F.col("c"), F.col("_c") + F.col("w")).alias("c"), F.least("low", "_low").alias("low"), F.col("_open").alias("open"))
        seen, at = at, rounds.cut(at.filter("NOT open").unionByName(moved))
        release(seen)
        reach *= 2


def plain(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL").distinct()


def strongly_connected(edges: DataFrame, rounds: Rounds | None = None) -> DataFrame:
    """(node, component, size, on_cycle) of every node: component is the smallest node that it reaches and is reached from; on_cycle
    also for a node with an edge to itself."""
    rounds = rounds or Rounds()
    whole = cut(plain(edges))
    left = whole.filter("a <> b").withColumns({"w": F.lit(1).cast("long"), "c": F.lit(0).cast("long")})
    chains, members = [], [whole.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)]
    n = left.count()
    while n:
        left = rounds.cut(left.join(left.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(left.select(F.col("a").alias("b")).distinct(), "b", "left_semi"))
        n, m = left.count(), n
        if n < SLOW * m:  # trees go this way, at one join a layer
            continue
        left, passed, rings = _without_chains(left, rounds)
        chains.append(passed)
        members.append(rings)
        n, m = left.count(), n
        if n > SLOW * m:  # neither way takes much
            found, left = _coloured(left, rounds)
            members.append(found)
            n = left.count()
    named = members[0]
    for more in members[1:]:
        named = named.unionByName(more)
    named = cut(named)
    for passed in reversed(chains):
        own = lambda end: passed.select("node", F.col(end).alias("_end")).join(named.select(F.col("node").alias("_end"), F.col("component").alias(end)), "_end", "left").select("node", F.coalesce(end, "_end").alias(end))  # noqa: B023, E731
        both = own("head").join(own("to"), "node").filter(F.col("head") == F.col("to"))
        # an end that is in no component yet is one now, if a way leads from it to itself
        ends = passed.filter("head = to").select(F.col("to").alias("node"), F.col("to").alias("component")).distinct().join(named.select("node"), "node", "left_anti")
        named = cut(named.unionByName(both.select("node", F.col("head").alias("component"))).unionByName(ends))
    sizes = named.groupBy("component").agg(F.min("node").alias("_name"), F.count(F.lit(1)).alias("size"))
    cyclic = named.join(sizes, "component").select("node", F.col("_name").alias("component"), "size", F.lit(True).alias("on_cycle"))
    alone = whole.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(cyclic.select("node"), "node", "left_anti")
    loops = whole.filter("a = b").select(F.col("a").alias("node"), F.lit(True).alias("_loop"))
    single = alone.join(loops, "node", "left").select("node", F.col("node").alias("component"), F.lit(1).cast("long").alias("size"), F.coalesce("_loop", F.lit(False)).alias("on_cycle"))
    return cyclic.unionByName(single)


def _chain(left: DataFrame) -> DataFrame:
    """Nodes with one way in and one way out: (node, to, w, c, head)."""
    out = left.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("_o"), F.first("b").alias("to"), F.first("w").alias("w")).filter("_o = 1")
    into = left.groupBy(F.col("b").alias("node")).agg(F.count(F.lit(1)).alias("_i"), F.first("a").alias("head")).filter("_i = 1")
    return out.join(into, "node").select("node", "to", "w", F.lit(0).cast("long").alias("c"), "head")


def _without_chains(left: DataFrame, rounds: Rounds) -> tuple[DataFrame, DataFrame, DataFrame]:
    """left with each chain as one edge; its nodes with the chain's ends (node, head, to); and the members (node, component) of rings."""
    chain = rounds.cut(_chain(left))
    forward = jump(chain, rounds)
    back = jump(chain.select("node", F.col("head").alias("to"), "w", "c"), rounds)
    passed = forward.filter("NOT open").select("node", "to").join(back.filter("NOT open").select("node", F.col("to").alias("head")), "node")
    rings = forward.filter("open").select("node", F.col("low").alias("component"))
    passed = cut(passed)
    kept = left.select("a", "b").join(chain.select(F.col("node").alias("a")), "a", "left_anti").join(chain.select(F.col("node").alias("b")), "b", "left_anti")
    short = passed.filter("head <> to").select(F.col("head").alias("a"), F.col("to").alias("b"))
    # a chain from a node to itself needs no edge: the node and the chain are one component already
    return rounds.cut(kept.unionByName(short).distinct().withColumns({"w": F.lit(1).cast("long"), "c": F.lit(0).cast("long")})), passed, rings


def _coloured(left: DataFrame, rounds: Rounds) -> tuple[DataFrame, DataFrame]:
    """(members of components that are found, edges that may belong to others)."""
    way = left.select("a", "b")
    after = cut(way.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("colour", F.col("node")))
    colour = after
    while True:
        heard = way.join(colour.select(F.col("node").alias("a"), "colour"), "a").groupBy(F.col("b").alias("node")).agg(F.max("colour").alias("_heard"))
        known, after = after, rounds.cut(colour.join(heard, "node", "left").select("node", F.greatest("colour", F.coalesce("_heard", "colour")).alias("colour"), (F.col("_heard") > F.col("colour")).alias("_moved")))
        colour = after.select("node", "colour")
        release(known)
        if after.filter("_moved").isEmpty():
            break
    inside = way.join(colour.select(F.col("node").alias("a"), F.col("colour").alias("_of_a")), "a").join(colour.select(F.col("node").alias("b"), F.col("colour").alias("_of_b")), "b")
    inside = rounds.cut(inside.filter("_of_a = _of_b").select("a", "b", F.col("_of_a").alias("colour")))
    found = colour.filter("node = colour").select("node", F.col("colour").alias("component"))
    front = found
    while True:
        ahead = inside.join(front.select(F.col("node").alias("b")), "b", "left_semi").select(F.col("a").alias("node"), F.col("colour").alias("component")).distinct()
        front = rounds.cut(ahead.join(found.select("node"), "node", "left_anti"))
        if front.isEmpty():
            break
        found = cut(found.unionByName(front))
    rest = inside.select("a", "b").join(found.select(F.col("node").alias("a")), "a", "left_anti").join(found.select(F.col("node").alias("b")), "b", "left_anti")
    several = found.groupBy("component").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("component")
    return found.join(several, "component", "left_semi"), rounds.cut(rest.withColumns({"w": F.lit(1).cast("long"), "c": F.lit(0).cast("long")}))


def layers(edges: DataFrame, rounds: Rounds | None = None) -> DataFrame:
    """(node, layer): the longest way to a node without dependencies. Nodes on cycles, and those that depend on them, have none.

    A node with one dependency left is that one's layer plus a distance, or what its other, finished dependencies ask for if that
    is more, so all of these are followed at once; the others wait until their dependencies are finished.
    """
    return _peeled(edges, rounds or Rounds())[0]


def unresolved(edges: DataFrame, rounds: Rounds | None = None) -> DataFrame:
    """Nodes that never lose all dependencies: those on cycles and what depends on them."""
    return _peeled(edges, rounds or Rounds())[1]


def _peeled(edges: DataFrame, rounds: Rounds) -> tuple[DataFrame, DataFrame]:
    """(node, layer) of what resolves, and the nodes that don't."""
    whole = cut(plain(edges))
    nodes = cut(whole.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    zero = F.lit(0).cast("long")
    left = whole.withColumn("w", F.lit(1).cast("long"))
    floors = nodes.withColumn("floor", zero)  # what finished dependencies ask for
    known = nodes.join(whole.select(F.col("a").alias("node")).distinct(), "node", "left_anti").withColumn("layer", zero)
    known, done, followed = cut(known), [], []
    endless = nodes.limit(0)  # whose only way leads into a ring: looked at once
    while True:
        done.append(known)
        hit = left.join(known, F.col("b") == F.col("node"))
        asked = hit.groupBy(F.col("a").alias("node")).agg(F.max(F.col("layer") + F.col("w")).alias("floor"))
        floors = rounds.cut(floors.join(known.select("node"), "node", "left_anti").unionByName(asked).groupBy("node").agg(F.max("floor").alias("floor")))
        left = cut(left.join(known.select(F.col("node").alias("b")), "b", "left_anti"))
        if left.isEmpty():
            known = floors.select("node", F.col("floor").alias("layer"))
            done.append(known)
            break
        out = left.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("_o"), F.first("b").alias("to"), F.first("w").alias("w"))
        single = jump(out.filter("_o = 1").join(floors, "node").join(endless, "node", "left_anti").select("node", "to", "w", F.col("floor").alias("c")), rounds)
        through = cut(single.filter("NOT open"))
        endless = cut(endless.unionByName(single.filter("open").select("node")))
        followed.append(through)
        free = floors.join(left.select(F.col("a").alias("node")).distinct(), "node", "left_anti").select("node", F.col("floor").alias("layer"))
        # edges into what was followed lead on to where that ends, and keep what it asks for as their own floor
        onward = left.join(through.select("node"), F.col("a") == F.col("node"), "left_anti").join(through.select(F.col("node").alias("b"), F.col("to").alias("_to"), F.col("w").alias("_w"), F.col("c").alias("_c")), "b", "left")
        onward = cut(onward.select("a", F.coalesce("_to", "b").alias("b"), F.when(F.col("_to").isNull(), F.col("w")).otherwise(F.col("w") + F.col("_w")).alias("w"), (F.col("w") + F.col("_c")).alias("_floor")))
        floors = floors.join(through.select("node"), "node", "left_anti").unionByName(onward.filter("_floor IS NOT NULL").select(F.col("a").alias("node"), F.col("_floor").alias("floor")))
        floors = cut(floors.groupBy("node").agg(F.max("floor").alias("floor")))
        left = rounds.cut(onward.groupBy("a", "b").agg(F.max("w").alias("w")))
        known = cut(free)
        if known.isEmpty() and through.isEmpty():
            break
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    found = cut(found)
    for through in reversed(followed):
        ends = through.join(found.select(F.col("node").alias("to"), "layer"), "to")
        found = cut(found.unionByName(ends.select("node", F.greatest(F.col("c"), F.col("layer") + F.col("w")).alias("layer"))))
    return found, nodes.join(found.select("node"), "node", "left_anti")
