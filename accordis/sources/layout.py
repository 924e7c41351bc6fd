"""Layouts of edge tables that later work needs no shuffle, or hardly any reading, for.

`Streams` keeps stream A, stream B and the hints bucketed and sorted by component, so comparing them runs on what each task reads. A
component with more than its share of all edges is cut into slots by its callees, the same way in all three: its edges then lie
in several buckets, and only sums of it meet again.

`Lookup` keeps edges sorted by caller, and once more by callee, in small row groups with bloom filters: a point look-up opens
the few groups that may hold the name.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reconcile import KEY
from .scratch import cut, new_folder

SLOTS = 64


class Streams:
    """Stream A, stream B and the hints as one table (source, component_id, slot, caller, callee), a folder for each source and in it a file for
    each bucket. A source can be written again alone."""

    SOURCES = ("a", "b", "t")

    def __init__(self, spark: SparkSession, a: DataFrame, b: DataFrame, hints: DataFrame, buckets: int) -> None:
        self.spark, self.buckets = spark, buckets
        every = a.select("component_id").unionAll(b.select("component_id")).unionAll(hints.select("component_id"))
        sizes = every.groupBy("component_id").agg(F.count(F.lit(1)).alias("_n"))
        whole = sizes.agg(F.sum("_n")).first()[0] or 0
        # more than one part in `buckets` of all edges: fewer than `buckets` components, whatever the table
        self._hot = cut(sizes.filter(F.col("_n") > whole // buckets).select("component_id", F.lit(True).alias("_hot")))
        self.name = f"accordis_edges_{uuid.uuid4().hex}"
        self.path = new_folder(spark, self.name)
        for source, edges in zip(self.SOURCES, (a, b, hints), strict=True):
            self.write(source, edges)

    def write(self, source: str, edges: DataFrame) -> None:
        """Put a source's edges in place of those that it had."""
        slot = F.when(F.col("_hot"), F.pmod(F.xxhash64("callee"), F.lit(SLOTS))).otherwise(F.lit(0)).cast("int")
        rows = edges.select(*KEY).join(F.broadcast(self._hot), "component_id", "left").select("component_id", slot.alias("slot"), "caller", "callee", F.lit(source).alias("source"))
        # one task for each bucket, so that a source's bucket is one sorted file
        dealt = rows.repartition(self.buckets, "component_id", "slot").sortWithinPartitions("component_id", "slot", "caller", "callee")
        if not self.spark.catalog.tableExists(self.name):
            first = dealt.write.partitionBy("source").bucketBy(self.buckets, "component_id", "slot").sortBy("component_id", "slot", "caller", "callee")
            first.format("parquet").option("path", self.path).saveAsTable(self.name)
            return
        before = self.spark.conf.get("spark.sql.sources.partitionOverwriteMode")
        try:
            self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
            dealt.select(*self.table().columns).write.insertInto(self.name, overwrite=True)
        finally:
            self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def sources(self) -> DataFrame:
        """Distinct edges with a, b and t: 1 where the source has the edge. All rows of an edge lie in one bucket, so none moves."""
        flags = (F.max((F.col("source") == s).cast("int")).alias(s) for s in self.SOURCES)
        return self.table().groupBy("component_id", "slot", "caller", "callee").agg(*flags)

    def counts(self) -> DataFrame:
        """(component_id, common, only_a, only_b): first by bucket, then the slots of a component."""
        found = self.sources().filter("a = 1 OR b = 1")
        both, a, b = (F.col("a") == 1) & (F.col("b") == 1), F.col("a") == 1, F.col("b") == 1
        by_slot = found.groupBy("component_id", "slot").agg(F.count_if(both).alias("common"), F.count_if(a & ~b).alias("only_a"), F.count_if(b & ~a).alias("only_b"))
        return by_slot.groupBy("component_id").agg(*(F.sum(c).alias(c) for c in ("common", "only_a", "only_b")))

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


class Lookup:
    """Edges in two orders under one folder."""

    ENDS = ("caller", "callee")

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, edges: DataFrame, group_bytes: int = 1 << 20, distinct: int = 100_000) -> None:
        """distinct: names that a row group may hold, which sizes its bloom filter."""
        for end in self.ENDS:
            out = edges.repartitionByRange(end).sortWithinPartitions(*sorted(self.ENDS, key=lambda e: e != end)).write
            for name, value in (("parquet.block.size", group_bytes), (f"parquet.bloom.filter.enabled#{end}", "true"), (f"parquet.bloom.filter.expected.ndv#{end}", distinct)):
                out = out.option(name, value)
            out.mode("overwrite").parquet(f"{self.path}/{end}")

    def by(self, end: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{end}")

    def callees(self, node: str) -> DataFrame:
        """Callees of a node, repeats kept."""
        return self.by("caller").filter(F.col("caller") == node).select("callee")

    def callers(self, node: str) -> DataFrame:
        """Callers of a node, repeats kept."""
        return self.by("callee").filter(F.col("callee") == node).select("caller")

    def has_edge(self, caller: str | Column, callee: str | Column) -> bool:
        return not self.by("caller").filter((F.col("caller") == caller) & (F.col("callee") == callee)).isEmpty()
