"""Mixing sources to target weights by capped water-filling.

Sources share the corpus size by weight. A source may be repeated at most `epochs` times, so its target stops at that
multiple of its size; what it can't take goes to the others by weight until no target is above its cap. With sources in
the order of cap / weight the clamped ones come first, so the water level follows from running sums: no iteration.

A source's documents are taken whole floor(target / size) times. What remains of the target goes to a seeded sample:
documents stand in the order of a hash, and those before a mark get one more whole repetition, the one on the mark a
fraction of it. The mark is found from sums by source and hash bucket and then inside the one bucket that holds it, so a
source with a third of all rows is never in one task, and each row's share follows from its own hash and the mark.

Defined results: null texts have size 0 and are never taken; the null source counts as a source and comes last; sources
without words have target 0; repeated rows count each (on the mark
they share its words evenly); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, n_words, small

WEIGHTS = (1, 2, 3)
BUCKET_BITS = 12


def water_fill(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = 3) -> DataFrame:
    """Add weight and target to rows of (source, source_size). One row a source, so windows over all of them are small."""
    named = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(named) - 1) % len(weights) + 1)
    cap = F.col("source_size") * epochs
    filled = sources.withColumn("weight", weight.cast("long")).withColumn("_cap", cap)
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    filled = filled.withColumns({
        "_left": F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0)),
        "_weights": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        "_rank": F.row_number().over(order),
    })
    is_free = F.col("_cap") * F.col("_weights") > F.col("weight") * F.col("_left")
    filled = filled.withColumns({
        "_first_free": F.min(F.when(is_free, F.col("_rank"))).over(everything),
        "_level": F.min_by(F.when(is_free, F.col("_left") / F.col("_weights")), F.when(is_free, F.col("_rank"))).over(everything),
    })
    free = F.col("_rank") >= F.col("_first_free")
    target = F.when(free, F.least(F.col("weight") * F.col("_level"), F.col("_cap").cast("double"))).otherwise(F.col("_cap").cast("double"))
    return filled.select("source", "source_size", "weight", target.alias("target"))


def mark(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, source, size and the place in the seeded order: _u (63 bits) and its leading bits as _bucket."""
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    sized = sized.withColumn("_u", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "size"), 1))
    return sized.withColumn("_bucket", F.shiftright("_u", 63 - BUCKET_BITS))


def decide(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = 3) -> DataFrame:
    """A row for each source: source_size, weight, target, whole, and where its seeded sample ends.

    A document before (mark_u, mark_id, mark_size) gets one repetition more, one that stands there mark_part words of it.
    """
    targets = water_fill(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("whole", whole).withColumn("extra", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    targets = materialize(targets)
    buckets = sized.groupBy("source", "_bucket").agg(F.sum("size").alias("_words"))
    upto = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    buckets = buckets.withColumn("_end", F.sum("_words").over(upto)).withColumnRenamed("source", "_source")
    ends = small(targets.select("source", "extra")).join(buckets, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_end") > F.col("extra")))
    ends = ends.groupBy("source").agg(F.min(F.struct("_bucket", (F.col("extra") - F.col("_end") + F.col("_words")).alias("_left"))).alias("_at"))
    ends = ends.select(F.col("source").alias("_source"), F.col("_at._bucket").alias("_b"), F.col("_at._left").alias("_left"))
    near = sized.join(small(materialize(ends)), F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_b")))
    near = near.groupBy("source", "_left", "_u", "doc_id", "size").agg(F.count(F.lit(1)).alias("_n"))
    run = Window.partitionBy("source").orderBy("_u", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("_end", F.sum(F.col("_n") * F.col("size")).over(run)).filter(F.col("_end") > F.col("_left"))
    part = F.floor((F.col("_left") - F.col("_end") + F.col("_n") * F.col("size")) / F.col("_n")).cast("long")
    marks = near.groupBy("source").agg(F.min(F.struct("_u", "doc_id", "size", part.alias("part"))).alias("_m"))
    marks = marks.select(F.col("source").alias("_source"), F.struct("_m._u", "_m.doc_id", "_m.size").alias("mark"), F.col("_m.part").alias("mark_part"))
    return materialize(targets.join(small(marks), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source"))


def _with_decisions(sized: DataFrame, decisions: DataFrame) -> DataFrame:
    place = F.struct("_u", "doc_id", "size")
    part = F.when(F.col("mark").isNull(), F.when(F.col("extra") > 0, F.col("size")).otherwise(F.lit(0))).when(place < F.col("mark"), F.col("size")).when(place == F.col("mark"), F.col("mark_part")).otherwise(F.lit(0))
    joined = sized.join(small(decisions.withColumnRenamed("source", "_source")), F.col("source").eqNullSafe(F.col("_source")))
    return joined.withColumn("part", part.cast("long")).withColumn("taken", F.col("whole") * F.col("size") + F.col("part"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = 3, seed: int = 7) -> DataFrame:
    """doc_id, source, size, source_size, target, whole (repetitions), part (words of one more) and taken of every row."""
    sized = materialize(mark(docs, seed))
    return _with_decisions(sized, decide(sized, weights, epochs)).select("doc_id", "source", "size", "source_size", "target", "whole", "part", "taken")


def apply_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = 3, seed: int = 7) -> DataFrame:
    """The mixed corpus, with docs' columns: a row for each repetition, and for a fraction a row with its first words.

    Whether a row goes in, and how often, follows from its own hash and its source's decision: texts are never shuffled.
    """
    decisions = decide(materialize(mark(docs, seed)), weights, epochs)
    packed = docs.select(F.struct("*").alias("_row"), "doc_id", "source", "text")
    marked = packed.select("_row", "doc_id", "source", "text", n_words(F.col("text")).alias("size"))
    marked = marked.withColumn("_u", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "size"), 1))
    decided = _with_decisions(marked, decisions)
    wanted = F.concat(F.array_repeat(F.col("size"), F.when(F.col("size") > 0, F.col("whole")).otherwise(F.lit(0)).cast("int")), F.when(F.col("part") > 0, F.array("part")).otherwise(F.array().cast("array<long>")))
    rows = decided.select("_row", "text", "size", F.explode(wanted).alias("_take"))
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))
    cut = F.when(F.col("_take") >= F.col("size"), F.col("text")).otherwise(F.array_join(F.slice(words, F.lit(1), F.col("_take").cast("int")), " "))
    return rows.select(F.col("_row").withField("text", cut).alias("_row")).select("_row.*")
