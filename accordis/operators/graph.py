"""Edge relations: bags of (caller, callee, ...). Functions that need sets say so."""

from __future__ import annotations

import heapq
import itertools

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import cut
from . import cycles

PAIR = ["caller", "callee"]


def callees(edges: DataFrame, node: str) -> DataFrame:
    """Callees of a node, repeats kept."""
    return edges.filter(F.col("caller") == node).select("callee")


def callers(edges: DataFrame, node: str) -> DataFrame:
    """Callers of a node, repeats kept."""
    return edges.filter(F.col("callee") == node).select("caller")


def has_edge(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted pairs with whether any edge matches."""
    known = edges.select(*PAIR).distinct().withColumn("exists", F.lit(True))
    return wanted.join(known, PAIR, "left").withColumn("exists", F.coalesce("exists", F.lit(False)))


def has_edge_between(edges: DataFrame, callers: DataFrame, callees: DataFrame, few: int = 64, spread: int = 64) -> DataFrame:
    """(caller, callee, exists) of each distinct pair from callers (caller, key) and callees (callee, key) with a key in common.

    Pairs are made once, from names that are distinct before, and don't move: a callee brings along those callers it has an edge
    from. Of callees with more than `few` of them the pairs are joined to the edges. A key's callees are dealt to `spread` parts.
    """
    sets = lambda rows, name: rows.groupBy(name).agg(F.collect_set("key").alias(f"_{name}_keys"))
    left, right = sets(callers, "caller"), sets(callees, "callee")
    met = edges.select(*PAIR).join(left, "caller").join(right, "callee").filter(F.arrays_overlap("_caller_keys", "_callee_keys"))
    known = cut(right.join(met.groupBy("callee").agg(F.collect_set("caller").alias("_from")), "callee", "left"))
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))
    ours = left.withColumn("key", F.explode("_caller_keys")).withColumn("_part", parts).repartition(n, "key", "_part")

    def paired(some: DataFrame) -> DataFrame:
        theirs = some.withColumn("key", F.explode("_callee_keys")).withColumn("_part", F.pmod(F.xxhash64("callee"), F.lit(spread)).cast("int")).repartition(n, "key", "_part")
        # ends with several keys in common meet at each of them, and count at the first
        first = (F.size("_caller_keys") == 1) | (F.size("_callee_keys") == 1) | (F.col("key") == F.array_min(F.array_intersect("_caller_keys", "_callee_keys")))
        return theirs.join(ours.hint("shuffle_hash"), ["key", "_part"]).filter(first)

    many = F.coalesce(F.size("_from"), F.lit(0)) > few
    light = paired(known.filter(~many)).select(*PAIR, F.coalesce(F.array_contains("_from", F.col("caller")), F.lit(False)).alias("exists"))
    crowded = known.filter(many)
    marks = crowded.select("callee", F.explode("_from").alias("caller"), F.lit(True).alias("exists"))
    heavy = paired(crowded).select(*PAIR).join(marks, PAIR, "left").select(*PAIR, F.coalesce("exists", F.lit(False)).alias("exists"))
    return light.unionAll(heavy)


def insert_absent(edges: DataFrame, new: DataFrame) -> DataFrame:
    """edges and those of new whose pair is absent (each pair once)."""
    return edges.unionByName(new.dropDuplicates(PAIR).join(edges.select(*PAIR).distinct(), PAIR, "left_anti"))


def delete_matching(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """edges without any row whose pair is in gone."""
    return edges.join(gone.select(*PAIR).distinct(), PAIR, "left_anti")


def pairs(edges: DataFrame) -> DataFrame:
    return edges.select(*PAIR)


def nodes(edges: DataFrame) -> DataFrame:
    """Distinct endpoints."""
    return edges.select(F.explode(F.array("caller", "callee")).alias("node")).distinct()


def counts(edges: DataFrame) -> DataFrame:
    """edge_count (of the bag) and node_count (distinct)."""
    return edges.agg(F.count(F.lit(1)).alias("edge_count")).crossJoin(F.broadcast(nodes(edges).agg(F.count(F.lit(1)).alias("node_count"))))


def diff(truth: DataFrame, documented: DataFrame) -> DataFrame:
    """Distinct pairs with side: matching, missing (in truth only) or extra. One aggregation instead of three set operations."""
    both = truth.select(*PAIR, F.lit(1).alias("t"), F.lit(0).alias("d")).unionAll(documented.select(*PAIR, F.lit(0).alias("t"), F.lit(1).alias("d")))
    sides = both.groupBy(*PAIR).agg(F.max("t").alias("t"), F.max("d").alias("d"))
    return sides.select(*PAIR, F.when(F.col("t") + F.col("d") == 2, "matching").when(F.col("t") == 1, "missing").otherwise("extra").alias("side"))


def ratio(part: Column, whole: Column, empty: float) -> Column:
    """part / whole as a double, or `empty` where whole is 0."""
    return F.when(whole == 0, F.lit(empty)).otherwise(part.cast("double") / F.nullif(whole, F.lit(0)).cast("double"))


def precision_recall(counted: DataFrame, empty_precision: float, empty_recall: float) -> DataFrame:
    """counted (tp, fp, fn) with precision, recall and f1; what an empty side means is the caller's convention."""
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp"), empty_precision), ratio(F.col("tp"), F.col("tp") + F.col("fn"), empty_recall)
    rated = counted.withColumns({"precision": p, "recall": r})
    total = F.col("precision") + F.col("recall")
    return rated.withColumn("f1", F.when(total == 0, F.lit(0.0)).otherwise(2 * F.col("precision") * F.col("recall") / F.nullif(total, F.lit(0.0))))


def diff_scores(truth: DataFrame, documented: DataFrame) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 and is_perfect of a graph diff; an empty side counts as perfect."""
    side = lambda s: F.count_if(F.col("side") == s)
    counted = diff(truth, documented).agg(side("matching").alias("tp"), side("extra").alias("fp"), side("missing").alias("fn"))
    return precision_recall(counted, 1.0, 1.0).withColumn("is_perfect", (F.col("fp") == 0) & (F.col("fn") == 0))


def merge(first: DataFrame, second: DataFrame, order: list[str]) -> DataFrame:
    """One edge a pair: from `first` if it has one, else from `second`; within a side the first by `order`."""
    both = first.withColumn("_side", F.lit(0)).unionByName(second.withColumn("_side", F.lit(1)))
    rest = [c for c in both.columns if c not in (*PAIR, "_side")]
    best = both.groupBy(*PAIR).agg(F.min(F.struct("_side", *order, *(c for c in rest if c not in order))).alias("_b"))
    return best.select(*PAIR, *(F.col(f"_b.{c}").alias(c) for c in rest))


def degrees(edges: DataFrame) -> DataFrame:
    """In- and out-degree of each node, repeats counted."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("caller").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("callee").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("e.node").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))


def adjacency(edges: DataFrame) -> DataFrame:
    """caller and its sorted distinct callees."""
    return edges.groupBy("caller").agg(F.sort_array(F.collect_set("callee")).alias("callees"))


def first_callees(edges: DataFrame, k: int) -> DataFrame:
    """caller and its k smallest distinct callees, sorted. Tasks keep k of a caller each before any meet."""
    place = F.row_number().over(Window.partitionBy("caller").orderBy("callee"))
    few = edges.select("caller", "callee").distinct().withColumn("_place", place).filter(F.col("_place") <= k)
    return few.groupBy("caller").agg(F.sort_array(F.collect_list("callee")).alias("callees"))


def known_endpoints(edges: DataFrame, components: DataFrame) -> DataFrame:
    """Edges whose two ends are components."""
    ids = components.select("component_id").distinct()
    return edges.join(ids.withColumnRenamed("component_id", "caller"), "caller", "left_semi").join(ids.withColumnRenamed("component_id", "callee"), "callee", "left_semi")


def dot_lines(edges: DataFrame) -> DataFrame:
    """A DOT line for each edge, quotes escaped."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return edges.select(F.concat(F.lit("  "), quoted("caller"), F.lit(" -> "), quoted("callee"), F.lit(";")).alias("line"))


def reach(edges: DataFrame, depth: int | None = None) -> DataFrame:
    """(source, target, distance) of all nodes within `depth` steps (any number for None) over edges (a, b): a frontier grows by one join a round, and each round ends in a checkpoint."""
    step = cut(edges.select("a", "b").distinct())
    frontier = step.select(F.col("a").alias("source"), F.col("b").alias("target"), F.lit(1).alias("distance"))
    found = frontier
    for d in itertools.count(2) if depth is None else range(2, depth + 1):
        ahead = frontier.join(step, F.col("target") == F.col("a")).select("source", F.col("b").alias("target")).distinct()
        frontier = cut(ahead.join(found, ["source", "target"], "left_anti").withColumn("distance", F.lit(d)))
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found


def layers(edges: DataFrame) -> DataFrame:
    """(node, layer): the longest path to a node without dependencies, over edges (a depends on b). Nodes on cycles, and those that depend on
    them, have no layer. Paths are followed by doubling, so rounds grow with how the graph branches, not with its depth."""
    return cycles.layers(edges)


def file_order(components: DataFrame) -> DataFrame:
    """components (component_id, file_path, line_start) with their place in the file: the order is (file_path, position)."""
    place = F.row_number().over(Window.partitionBy("file_path").orderBy("line_start", "component_id"))
    return components.select("component_id", "file_path", place.cast("long").alias("position"))


def fallback_order(components: DataFrame, edges: DataFrame | None) -> DataFrame:
    """(component_id, file_path, position) for processing without dependencies: by file and line if there is no graph, by name if the graph is empty.

    By name, file_path is empty and position the rank among components of the same first letter, so that no task orders all."""
    if edges is not None and edges.isEmpty():
        first = F.substring("component_id", 1, 1)
        place = F.row_number().over(Window.partitionBy(first).orderBy("component_id"))
        return components.select("component_id", F.lit("").alias("file_path"), place.cast("long").alias("position"))
    return file_order(components)


def unresolved(edges: DataFrame) -> DataFrame:
    """Nodes that never lose all dependencies: members of cycles and what depends on them."""
    return cycles.unresolved(edges.select(F.col("caller").alias("a"), F.col("callee").alias("b")))


def strongly_connected(edges: DataFrame) -> DataFrame:
    """(node, component, size, on_cycle): members of one cycle share a component, named for the smallest of them."""
    return cycles.strongly_connected(edges.select(F.col("caller").alias("a"), F.col("callee").alias("b")))


def dependency_order(edges: DataFrame, graph: str = "graph") -> DataFrame:
    """(graph, position, node): dependencies first, the smallest ready name next, what cycles block last by name.

    The order is sequential by nature, so a graph is one task's work; graphs are spread over tasks.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        needs: dict[str, set] = {}
        for a, b in zip(pdf["caller"], pdf["callee"], strict=True):
            needs.setdefault(a, set()).add(b)
            needs.setdefault(b, set())
        users: dict[str, list] = {n: [] for n in needs}
        for a, bs in needs.items():
            for b in bs:
                users[b].append(a)
        open_needs = {n: len(bs) for n, bs in needs.items()}
        ready = [n for n, k in open_needs.items() if not k]
        heapq.heapify(ready)
        out = []
        while ready:
            out.append(n := heapq.heappop(ready))
            for u in users[n]:
                open_needs[u] -= 1
                if not open_needs[u]:
                    heapq.heappush(ready, u)
        out += sorted(set(needs) - set(out))
        return pd.DataFrame({graph: pdf[graph].iloc[0], "position": range(len(out)), "node": out})

    return edges.groupBy(graph).applyInPandas(run, f"{graph} {edges.schema[graph].dataType.simpleString()}, position long, node string")


def top_by_degree(edges: DataFrame, k: int) -> DataFrame:
    """The k nodes with most incoming edges, ties by name."""
    return degrees(edges).orderBy(F.col("in_degree").desc(), "node").limit(k)


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by a full order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")
