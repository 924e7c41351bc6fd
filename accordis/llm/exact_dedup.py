"""Exact dedup through an extendible-hash index on shared files.

Entries. A row's key is a 64-bit hash of its normalised text (A-Z lowered). Narrow rows (doc_id, key, byte length, SHA-256)
are written to the shared folder. They are first merged inside `SEGMENTS` segments by hash of doc_id, and before that inside
each task, so a text with a third of all rows leaves a few entries.

Directory. It starts as one bucket. A bucket that holds more than `capacity` distinct keys splits on the next leading bit of
its keys, and the directory doubles when the bucket was as deep as the directory. Loads are counted `STEP` bits ahead, for
keys in overfull buckets only, so a pass over these keys stands for up to `STEP` doublings; passes go on until no bucket is
overfull, however deep that is (after 64 bits a bucket holds one key). The directory is a table of 2 ** depth slots, each
naming its bucket (keys are uniform hashes, so buckets are about equally deep and slots a small multiple of them); it is
broadcast only while it has few slots.

Owners. Each entry finds its bucket through the directory, by the leading bits of its key. An owner task takes a range of
keys, whole buckets; only there entries of different segments meet. It sorts them into bucket and chain (entries whose keys
collide), merges equal ones and writes its part of the index file. Entries whose bucket the directory doesn't name are in no
chain. Chains that stand for more than one row are then settled by comparing bytes: only the texts of such rows move, and
equal ones collapse inside each task before the shuffle.

Defined results: a null text is an empty one; of equal texts the row with the largest doc_id stays (of repeated rows with
that doc_id, all count as that row and are marked kept by the digest, one of them by `deduplicate`); a null doc_id ranks
below every other; an empty table gives an empty result; other columns are not read by the digest and are kept by
`deduplicate`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, release, small

CAPACITY = 1024
STEP = 8
SEGMENTS = 8
#: Directories of up to this many slots are broadcast (24 bytes each).
BROADCAST_SLOTS = 65_536
#: Duplicate rows up to this many are looked up by a broadcast of their ids (8 bytes each), more by a shuffle.
BROADCAST_IDS = 1_000_000
#: The same for rows of a digest and two ids (about 150 bytes each).
BROADCAST_GROUPS = 200_000


def normalised(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_norm", ascii_lower(F.coalesce(F.col("text"), F.lit(""))))


def entries(docs: DataFrame) -> DataFrame:
    """The entry file: a narrow row for each document."""
    norm = normalised(docs).select("doc_id", "_norm")
    return materialize(norm.select("doc_id", F.xxhash64("_norm").alias("key"), F.octet_length("_norm").alias("n_bytes"), F.sha2(F.encode("_norm", "UTF-8"), 256).alias("text_sha256")))


def leading(key: Column, bits: int) -> Column:
    """The leading bits of a key as a number."""
    return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")


def split(keys: DataFrame, depth: int, capacity: int) -> tuple[DataFrame, DataFrame]:
    """Buckets that need no further split, as (depth, bucket), and those still overfull at depth + STEP, from keys in overfull buckets of `depth` bits."""
    deepest = min(64, depth + STEP)
    fine = keys.groupBy(leading(F.col("key"), deepest).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
    levels = fine.select("n", F.explode(F.array(*(F.struct(F.lit(d).alias("depth"), F.shiftrightunsigned("prefix", deepest - d).alias("bucket")) for d in range(depth, deepest + 1)))).alias("at"))
    loads = materialize(levels.groupBy("at.depth", "at.bucket").agg(F.sum("n").alias("load")))
    over = loads.filter((F.col("load") > capacity) & (F.col("depth") < 64))
    halves = over.select((F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("bucket") * 2, F.col("bucket") * 2 + 1)).alias("bucket"))
    fits = loads.filter((F.col("load") <= capacity) | (F.col("depth") == 64))
    first = fits.filter(F.col("depth") == depth)
    leaves = fits.join(halves, ["depth", "bucket"], "left_semi").unionByName(first).select("depth", "bucket")
    return leaves, over.filter(F.col("depth") == deepest).select("bucket")


def directory(index: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """(slot, bucket, depth) of each slot that has a bucket, and the directory's depth. A bucket is named by its first slot."""
    keys = materialize(index.select("key").distinct())
    leaves, depth, left = [], 0, keys
    while True:
        settled, over = split(left, depth, capacity)
        leaves.append(materialize(settled))
        over = materialize(over)
        if over.isEmpty():
            break
        depth += STEP
        left = left.withColumn("_at", leading(F.col("key"), depth)).join(small(over.withColumnRenamed("bucket", "_at")), "_at", "left_semi").select("key")
    found = leaves[0]
    for more in leaves[1:]:
        found = found.unionByName(more)
    deep = found.agg(F.max("depth")).first()[0] or 0
    first = F.expr(f"shiftleft(bucket, {deep} - depth)")
    slots = F.explode(F.expr(f"sequence(first, first + shiftleft(1L, {deep} - depth) - 1L)"))
    doubled = materialize(found.select("depth", first.alias("first")).select(slots.alias("slot"), F.col("first").alias("bucket"), "depth"))
    release(keys, *leaves)
    return doubled, deep


def chains(index: DataFrame, slots: DataFrame, depth: int) -> DataFrame:
    """The index file: merged entries (owner, bucket, key, n_bytes, text_sha256, keep_id, group_size) with `chained`, the entries of the same key in the bucket."""
    segment = F.pmod(F.xxhash64("doc_id"), F.lit(SEGMENTS)).cast("int")
    merged = index.groupBy(segment.alias("segment"), "key", "n_bytes", "text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    placed = merged.withColumn("slot", leading(F.col("key"), depth)).join(small(slots, BROADCAST_SLOTS), "slot")
    owners = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    owner = F.floor(F.col("bucket") / F.lit(float(1 << depth)) * owners).cast("int")
    dealt = placed.withColumn("owner", owner).repartition(owners, "owner")
    met = dealt.groupBy("owner", "bucket", "key", "n_bytes", "text_sha256").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    return materialize(met.withColumn("chained", F.count(F.lit(1)).over(Window.partitionBy("owner", "bucket", "key"))))


def digest(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row."""
    index = entries(docs)
    found = chains(index, *directory(index, capacity))
    shared = found.filter(F.col("group_size") > 1).select("key", "n_bytes", "text_sha256")
    same = ["key", "n_bytes", "text_sha256"]
    repeated = materialize(index.join(small(shared, BROADCAST_GROUPS), same, "left_semi").select(F.col("doc_id").alias("_dup"), F.col("key").alias("_key")).distinct())
    texts = normalised(docs).select("doc_id", "_norm").join(small(repeated.select("_dup").distinct(), BROADCAST_IDS), F.col("doc_id").eqNullSafe(F.col("_dup")), "left_semi")
    compared = texts.groupBy("_norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = compared.filter(F.col("group_size") > 1).select(F.xxhash64("_norm").alias("key"), F.octet_length("_norm").alias("n_bytes"), F.sha2(F.encode("_norm", "UTF-8"), 256).alias("text_sha256"), F.col("keep_id").alias("_keep"), F.col("group_size").alias("_size"))
    # rows in no chain, or in a chain that the bytes don't confirm, stay alone
    settled = materialize(groups.join(small(shared, BROADCAST_GROUPS), same, "left_semi"))
    rows = index.join(small(settled, BROADCAST_GROUPS), same, "left")
    keep = F.when(F.col("_size") > 1, F.col("_keep")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", keep.alias("keep_id"), F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"), keep.eqNullSafe(F.col("doc_id")).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """docs without the rows that an equal text with a larger doc_id replaces; one row of several with that doc_id."""
    groups = digest(docs, capacity).filter(F.col("group_size") > 1)
    ruled = materialize(groups.groupBy(F.col("doc_id").alias("_d"), F.col("text_sha256").alias("_sha")).agg(F.first("kept").alias("_kept"), F.count(F.lit(1)).alias("_n")))
    packed = docs.select(F.struct("*").alias("_row"), "doc_id", F.sha2(F.encode(ascii_lower(F.coalesce(F.col("text"), F.lit(""))), "UTF-8"), 256).alias("_key"))
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_sha"))
    kept = packed.join(small(ruled, BROADCAST_GROUPS), same, "left").filter(F.col("_kept").isNull() | F.col("_kept"))
    if not ruled.filter(F.col("_kept") & (F.col("_n") > 1)).isEmpty():
        again = F.col("_kept").isNotNull() & (F.col("_n") > 1)
        one = F.row_number().over(Window.partitionBy("_sha", "_d").orderBy(F.xxhash64("_row")))
        kept = kept.filter(~F.coalesce(again, F.lit(False))).select("_row").unionAll(kept.filter(again).withColumn("_one", one).filter(F.col("_one") == 1).select("_row"))
    return kept.select("_row.*")
