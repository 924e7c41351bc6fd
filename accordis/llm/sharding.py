"""Sharding by a Feistel permutation of global row numbers.

Rows are numbered 0..N-1 in an order that depends on their content alone, a keyed Feistel network with cycle walking
permutes the numbers, and a row whose number becomes p goes to shard p % shards, slot p // shards. Shard counts are at
most one apart. Anyone who knows N and the seed can compute a row's place from its number, or the number from its place.

Numbering needs no global sort: rows fall into hash buckets, the bucket totals (at most `buckets` rows) are summed up,
and a window numbers rows inside a bucket. Rows that are equal in every key column are counted together first, so a row
that is repeated very often costs one row in the shuffle; runs of its numbers are then dealt to all tasks.

Defined results: a null text has size 1 and CRC 0, as an empty one; a null doc_id is an ordinary value; repeated rows get
a place each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small

ROUNDS = 6
#: Steps of cycle walking. A step leaves a row outside with a chance of about 1/sqrt(N), so this bound is never met.
WALK = 64
#: Numbers of a repeated row that one task gives at once.
RUN = 100_000


def feistel(x: Column, a: Column, b: Column, seed: int) -> Column:
    """A keyed permutation of 0..a*b-1: the halves live in Z_a and Z_b and are shifted in turn by a hash of the other."""

    def turn(s: Column, r: Column) -> Column:
        left, right = s["l"], s["r"]
        moved_left = F.struct(((left + F.pmod(F.xxhash64(F.lit(seed), r, right), a)) % a).alias("l"), right.alias("r"))
        moved_right = F.struct(left.alias("l"), ((right + F.pmod(F.xxhash64(F.lit(seed), r, left), b)) % b).alias("r"))
        return F.when(r % 2 == 0, moved_left).otherwise(moved_right)

    start = F.struct((x % a).alias("l"), F.floor(x / a).cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: s["l"] + s["r"] * a)


def permute(x: Column, n: Column, seed: int) -> Column:
    """A keyed permutation of 0..n-1: Feistel on the smallest rectangle that holds n, walking on while outside."""
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = F.ceil(n / a).cast("long")
    first = feistel(x, a, b, seed)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first, lambda at, _: F.when(at < n, at).otherwise(feistel(at, a, b, seed)))
    at = F.when(first < n, first).otherwise(walked)
    return F.when(at < n, at).otherwise(F.raise_error(F.lit("cycle walking did not end")).cast("long"))


def number_rows(rows: DataFrame, keys: list[str], seed: int, buckets: int = 4096) -> DataFrame:
    """Add row_number (0..N-1, by content) and n_rows to the rows of `keys`; equal rows get neighbouring numbers."""
    copies = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hashed = F.xxhash64(F.lit(seed), *keys)
    copies = materialize(copies.withColumns({"_h": hashed, "_bucket": F.pmod(hashed, F.lit(buckets)).cast("int")}))
    totals = copies.groupBy("_bucket").agg(F.sum("_n").alias("_in_bucket"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_bucket", F.coalesce(F.sum("_in_bucket").over(before), F.lit(0)).alias("_start"), F.sum("_in_bucket").over(Window.partitionBy()).alias("n_rows"))
    inside = Window.partitionBy("_bucket").orderBy("_h", *keys).rowsBetween(Window.unboundedPreceding, -1)
    placed = copies.join(small(starts, buckets), "_bucket").withColumn("_first", F.col("_start") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    each = lambda df: df.select(*keys, "n_rows", F.explode(F.sequence("_first", F.col("_first") + F.col("_n") - 1)).alias("row_number"))
    often = F.col("_n") > RUN
    if copies.filter(often).isEmpty():
        return each(placed)
    # a row that is repeated very often is cut into runs first, which are dealt to all tasks
    runs = placed.filter(often).withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / RUN))))
    cut = runs.select(*keys, "n_rows", "_run", (F.col("_first") + F.col("_run") * RUN).alias("_first"), F.least(F.lit(RUN), F.col("_n") - F.col("_run") * RUN).alias("_n"))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, as few small rows would be put together again
    return each(placed.filter(~often)).unionAll(each(cut.repartition(tasks, *keys, "_run")))


def shard(docs: DataFrame, shards: int = 16, seed: int = 20_240_229, buckets: int = 4096) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    placed = number_rows(rows, ["doc_id", "size", "text_crc32"], seed, buckets)
    at = placed.withColumn("position", permute(F.col("row_number"), F.col("n_rows"), seed))
    return at.select("doc_id", "size", "text_crc32", (F.col("position") % shards).cast("int").alias("shard"), F.floor(F.col("position") / shards).cast("long").alias("slot"), "row_number")
