"""Reconciling again only what changed.

Streams A and B and the hints are versioned tables in buckets of components. A round looks at the buckets whose parts differ from those
that the last round saw; other files aren't opened. In these, each component's rows have a content hash that doesn't depend on
their order or repeats; a component whose hash is the one of the last round is left as it is, and the others alone go
through comparison and resolution. Results stand in a versioned table with the same buckets: a round puts those of touched buckets
in place together with the versions of its inputs, in one rename. So a round that dies is simply run again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import cut
from ..sources.versions import Versions
from .reconcile import KEY, edge_sides, edges_of_three, hinted, resolve_edges

#: A row for each component (caller is null, h1, h2 and edges tell its content) and one for each discrepancy.
RESULT = "bucket int, component_id {id}, caller string, callee string, in_a boolean, in_b boolean, hint boolean, resolution string, source string, confidence double, h1 long, h2 long, edges long"
INPUTS = ("a", "b", "hints")


def bucket(component_id: str | Column = "component_id", buckets: int = 64) -> Column:
    """The bucket of a component."""
    return F.pmod(F.xxhash64(component_id), F.lit(buckets)).cast("int")


def bucketed(edges: DataFrame, buckets: int = 64) -> DataFrame:
    """edges with their bucket, one task's files to each: what an input table holds."""
    return edges.select(bucket(buckets=buckets).alias("bucket"), *KEY).repartition(buckets, "bucket")


def contents(a: DataFrame, b: DataFrame, hints: DataFrame) -> DataFrame:
    """(component_id, h1, h2, edges): 128 bits that stand for the set of a component's rows and of the sources that have each."""
    rows = edges_of_three(a, b, hints)
    row = ["caller", "callee", "a", "b", "t"]
    return rows.groupBy("component_id").agg(F.bit_xor(F.xxhash64(F.lit(1), *row)).alias("h1"), F.bit_xor(F.xxhash64(F.lit(2), *row)).alias("h2"), F.count(F.lit(1)).alias("edges"))


def discrepancies(a: DataFrame, b: DataFrame, hints: DataFrame) -> DataFrame:
    """Edges that one stream lacks, resolved."""
    return resolve_edges(hinted(edge_sides(a, b).filter("in_a <> in_b"), hints))


@dataclass(frozen=True)
class Round:
    """What a round did: the results' version, buckets that were read, rows in them, and components that were compared again or are gone."""

    version: int
    buckets: int
    rows_read: int
    compared: int
    gone: int


def reconcile_changes(a: Versions, b: Versions, hints: Versions, results: Versions) -> Round:
    """One round over inputs that bucketed() made. Gives what it did; the state is in `results`, see `found`."""
    held = results.manifest()
    inputs = dict(zip(INPUTS, (a, b, hints), strict=True))
    now = {name: table.manifest().version for name, table in inputs.items()}
    seen = {name: held.writers.get(name) for name in INPUTS} if held else dict.fromkeys(INPUTS)
    touched = sorted({v for name, table in inputs.items() for (v,) in table.changed(seen[name], now[name])})
    if held and not touched:
        return Round(held.version, 0, 0, 0, 0)
    read = {name: table.read(now[name], {"bucket": touched}) for name, table in inputs.items()}
    rows_read = sum(df.count() for df in read.values())
    kind = read["a"].schema["component_id"].dataType.simpleString()
    before = results.read(held.version, {"bucket": touched}) if held else a.spark.createDataFrame([], RESULT.format(id=kind))
    old = before.filter("caller IS NULL").select("component_id", "h1", "h2", "edges")
    new = cut(contents(*read.values()))
    # every touched component is one row on either side, so this meets once a component, however many edges it has
    both = new.join(old.select("component_id", *(F.col(c).alias(f"_{c}") for c in ("h1", "h2", "edges"))), "component_id", "full_outer")
    same = F.col("h1").eqNullSafe(F.col("_h1")) & F.col("h2").eqNullSafe(F.col("_h2")) & F.col("edges").eqNullSafe(F.col("_edges"))
    fresh = cut(both.filter(~same).select("component_id", "h1", "h2", "edges"))
    compared, gone = fresh.agg(F.count_if(F.col("h1").isNotNull()), F.count_if(F.col("h1").isNull())).first()
    again = fresh.filter("h1 IS NOT NULL")
    part = {name: df.select(*KEY).join(again, "component_id", "left_semi") for name, df in read.items()}
    buckets_of = lambda df: df.withColumn("bucket", _bucket_of(a))
    names = [f.split()[0] for f in RESULT.split(", ")]
    heads = buckets_of(again).select(*(F.col(n) if n in ("bucket", "component_id", "h1", "h2", "edges") else F.lit(None).alias(n) for n in names))
    rows = buckets_of(discrepancies(*part.values())).select(*(F.col(n) if n not in ("h1", "h2", "edges") else F.lit(None).cast("long").alias(n) for n in names))
    left = before.join(fresh, "component_id", "left_anti").select(*names)
    state = left.unionByName(heads).unionByName(rows).repartition(max(1, len(touched)), "bucket")
    version = results.replace(a.spark.createDataFrame([], RESULT.format(id=kind)).unionByName(state), "bucket", gone=[(v,) for v in touched], marks=now)
    return Round(version, len(touched), rows_read, compared, gone)


def _bucket_of(table: Versions) -> Column:
    """The bucket column as the inputs were dealt: their number is the table's property, kept as a mark of its first write."""
    return bucket(buckets=table.manifest().writers["buckets"])


def start(table: Versions, edges: DataFrame, buckets: int = 64) -> int:
    """Fill an input table for the first time, or wholly anew."""
    held = table.manifest()
    return table.replace(bucketed(edges, buckets), "bucket", gone=[tuple(p["values"]) for p in held.parts] if held else (), marks={"buckets": buckets})


def change(table: Versions, edges: DataFrame, components: DataFrame) -> int:
    """A version of an input table in which `components` have these edges and no others. Files of other buckets stay."""
    buckets = table.manifest().writers["buckets"]
    ids = components.select("component_id").distinct().withColumn("bucket", bucket(buckets=buckets))
    touched = [r["bucket"] for r in ids.select("bucket").distinct().collect()]  # at most the number of buckets
    left = table.read(where={"bucket": touched}).join(ids.select("component_id"), "component_id", "left_anti").select("bucket", *KEY)
    mine = bucketed(edges.join(ids.select("component_id"), "component_id", "left_semi"), buckets)
    return table.replace(left.unionByName(mine).repartition(max(1, len(touched)), "bucket"), "bucket", gone=[(v,) for v in touched])


def found(results: Versions, version: int | None = None) -> DataFrame:
    """The discrepancies of a version of the results."""
    return results.read(version).filter("caller IS NOT NULL").drop("bucket", "h1", "h2", "edges")


def settle(edges: DataFrame, _: int = 0) -> DataFrame:
    """One round of settling edges (component_id, caller, callee, in_a, in_b, hint, review): in components that differ, an edge that the hint
    confirms goes to the stream that lacks it, and one that nobody confirms is left for review. Other components pass as they are."""
    open_ids = divergent(edges).select("component_id").distinct()
    names = edges.columns
    rest = edges.join(open_ids, "component_id", "left_anti")
    resolved = resolve_edges(edges.join(open_ids, "component_id", "left_semi"))
    apart = (F.col("in_a") != F.col("in_b")) & ~F.col("review")
    accepted = apart & (F.col("resolution") != "needs_human_review")
    done = resolved.withColumns({"in_a": F.col("in_a") | accepted, "in_b": F.col("in_b") | accepted, "review": F.col("review") | apart & ~accepted})
    return rest.select(*names).unionByName(done.select(*names))


def divergent(edges: DataFrame) -> DataFrame:
    """Edges that a further round can settle."""
    return edges.filter("in_a <> in_b AND NOT review")
