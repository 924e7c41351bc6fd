"""Connected components of an undirected graph given as edges of 64-bit nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v): root is the smallest node that it reaches.

    Labels move to neighbours and then jump to their label's label, so rounds grow with the logarithm of the longest path.
    Minima are aggregated before the shuffle; each round ends in a written table.
    """
    both = materialize(edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = materialize(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("root")))
    while True:
        last = labels
        heard = both.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("root").alias("heard"))
        lower = labels.join(heard, F.col("node") == F.col("u")).select("node", "root", F.least("root", "heard").alias("low"))
        lower = materialize(lower)
        ahead = lower.select(F.col("node").alias("_at"), F.col("low").alias("_low"))
        jumped = lower.join(ahead, F.col("low") == F.col("_at"), "left").select("node", F.least("low", F.coalesce("_low", "low")).alias("root"), F.col("root").alias("_was"))
        moved = materialize(jumped.select("node", "root", (F.col("root") != F.col("_was")).alias("_moved")))
        labels = moved.select("node", "root")
        labels._written_at = moved._written_at
        release(last, lower)
        if moved.filter("_moved").isEmpty():
            release(both)
            return labels
