"""A trie of conversation prefixes, from which a serving cache or a training run sees what conversations share.

A node is a distinct sequence of first turns (role, text). No trie is built and no level is walked. A prefix's key is its depth
and two 64-bit lanes: the exclusive or over its turns of a hash of (place, SHA-256 of the turn), so a running window gives
the keys of all prefixes of a conversation at once. Smallest-member ownership: a node belongs to the smallest conversation
that begins with it, and as that one is the smallest below it too, each conversation owns a suffix of its path. Windows over
the keys mark the owned nodes. What a subtree holds then is a sum over its top's members, for each the turns from the top to
its own end: all of them, less those that it owns. One group-by of prefixes gives every figure:

    saved_tokens = sum over members of words from here on - sum over members of owned words from here on
    n_leaves     = members that own their last node, if nothing goes on from that
    n_children   = members that own the node after this one

Skew: turns are numbered by range partitions, so a conversation that holds a third of all turns is cut among tasks; running sums are
taken in pieces of `piece` turns, and pieces get what came before them. Prefixes with more than 1 / SHARE of all turns are
at most SHARE keys, aggregated on the map side and broadcast; windows see only the others. The ids that end at one node
are joined to texts of at most BLOCK ids by many tasks; only the hash itself, which is a chain, runs over these in one.

Defined results: rows without a conv_id are left out; a null role or text is empty; turns go by `turn`, null first, equal ones by
the SHA-256 of role and text; repeated rows are turns of their own; an empty table has no nodes, not even a root; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, n_words, release, trimmed

KEY = ["depth", "k1", "k2"]
#: A key with more than 1 / SHARE of all occurrences is dealt with apart; there are at most SHARE of them.
SHARE = 4096
#: Ids of one node that are joined to one text.
BLOCK = 1 << 16
#: Turns of a conversation that one task takes at once.
PIECE = 4096


def turn_hash() -> Column:
    """SHA-256 of role and text; the role's length keeps the two apart."""
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, F.coalesce("text", F.lit(""))), 256))


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, said, words) of every turn, depth from 1 in the order of `turn`; said identifies role and text."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_hash().alias("said"), n_words(F.col("text")).alias("words")).filter("conv_id IS NOT NULL")
    # the row's number in the input lets equal rows be dealt to several partitions; their order doesn't matter
    keys = ["conv_id", F.col("turn").asc_nulls_first(), "said", "_row"]
    dealt = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = materialize(dealt.select("conv_id", "said", "words", F.monotonically_increasing_id().alias("at")).withColumn("part", F.shiftright("at", 33)))
    parts = dealt.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("conv_id", "part", (F.col("first") - F.coalesce(F.sum("n").over(earlier), F.lit(0))).alias("start"))
    out = materialize(dealt.join(starts, ["conv_id", "part"]).select("conv_id", (F.col("at") - F.col("start") + 1).alias("depth"), "said", "words"))
    release(dealt)
    return out


def rebuilt(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that share beginnings, made from numbered turns: the first h turns of conversation c - c % every, then c's own
    after its first h, with h = crc32 of c in decimal, modulo `most`. Gives the turns, and the conv_ids, turnless ones included."""
    first = turns.filter((F.col("conv_id") % every == 0) & (F.col("depth") < most))
    heads = first.groupBy(F.col("conv_id").alias("_base")).agg(F.sort_array(F.collect_list(F.struct("depth", "said", "words"))).alias("_head"))
    cut = _piece(PIECE)
    pieces = materialize(turns.groupBy("conv_id", cut.alias("piece")).agg(F.count(F.lit(1)).alias("_n")).drop("_n"))
    convs = pieces.select("conv_id").distinct().withColumn("_h", F.crc32(F.col("conv_id").cast("string")) % most)
    convs = convs.withColumn("_base", F.col("conv_id") - F.col("conv_id") % every).join(heads, "_base", "left")
    convs = materialize(convs.select("conv_id", "_h", F.filter(F.coalesce("_head", F.array()), lambda x: x["depth"] <= F.col("_h")).alias("_taken")))
    taken = convs.select("conv_id", F.explode("_taken").alias("t")).select("conv_id", "t.depth", "t.said", "t.words")
    # joined by piece, so that a conversation of very many turns doesn't meet in one task
    moved = pieces.join(convs.select("conv_id", "_h", F.size("_taken").alias("_k")), "conv_id")
    own = turns.withColumn("piece", cut).join(moved, ["conv_id", "piece"]).filter(F.col("depth") > F.col("_h"))
    return taken.unionByName(own.select("conv_id", (F.col("depth") - F.col("_h") + F.col("_k")).alias("depth"), "said", "words")), convs.select("conv_id")


def _piece(turns: int) -> Column:
    return F.floor(F.col("depth") / turns)


def paths(turns: DataFrame, piece: int) -> DataFrame:
    """Every prefix of every conversation: conv_id, piece, depth, k1, k2, words before its last turn, its words, the conversation's length."""
    lane = lambda i: F.xxhash64(F.lit(i), "depth", "said")
    rows = turns.select("conv_id", _piece(piece).alias("piece"), "depth", lane(1).alias("e1"), lane(2).alias("e2"), "words")
    running = Window.partitionBy("conv_id", "piece").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = rows.select("conv_id", "piece", "depth", F.bit_xor("e1").over(running).alias("x1"), F.bit_xor("e2").over(running).alias("x2"), (F.sum("words").over(running) - F.col("words")).alias("sofar"), "words")
    ends = rows.groupBy("conv_id", "piece").agg(F.bit_xor("e1").alias("t1"), F.bit_xor("e2").alias("t2"), F.sum("words").alias("tw"), F.max("depth").alias("td"))
    whole = Window.partitionBy("conv_id")
    earlier = whole.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    before = ends.select("conv_id", "piece", *(F.coalesce(f(c).over(earlier), zero).alias(n) for f, c, n in ((F.bit_xor, "t1", "b1"), (F.bit_xor, "t2", "b2"), (F.sum, "tw", "bw"))), F.max("td").over(whole).alias("length"))
    both = inside.join(before, ["conv_id", "piece"])
    return both.select("conv_id", "piece", "depth", F.col("x1").bitwiseXOR(F.col("b1")).alias("k1"), F.col("x2").bitwiseXOR(F.col("b2")).alias("k2"), (F.col("sofar") + F.col("bw")).alias("before"), "words", "length")


def owned(rows: DataFrame) -> DataFrame:
    """Paths with each node's owner, its smallest member, and `far`, the length of its longest member."""
    many = rows.count() // SHARE
    bucket = F.pmod("k1", F.lit(1 << 16))
    full = rows.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > many)
    among = rows.join(F.broadcast(full), bucket == F.col("_bucket"), "left_semi").groupBy(*KEY)
    hot = materialize(among.agg(F.count(F.lit(1)).alias("_n"), F.min("conv_id").alias("owner"), F.max("length").alias("far")).filter(F.col("_n") > many).drop("_n"))
    node = Window.partitionBy(*KEY)
    others = rows.join(F.broadcast(hot), KEY, "left_anti").withColumns({"owner": F.min("conv_id").over(node), "far": F.max("length").over(node)})
    return others.unionByName(rows.join(F.broadcast(hot), KEY))


def trie(turns: DataFrame, conversations: DataFrame, piece: int = PIECE) -> DataFrame:
    """A row for each node: depth, k1, k2, conv_id (its owner), parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256 (of the comma-joined ids of members that end there).

    turns: (conv_id, depth, said, words) with depths from 1 without a gap; conversations: all conv_ids, also those without turns.
    """
    marked = materialize(owned(materialize(paths(turns, piece))))
    own = F.col("conv_id") == F.col("owner")
    by_piece = marked.groupBy("conv_id", "piece").agg(
        F.min(F.when(own, F.col("depth"))).alias("since"), F.sum(F.when(~own, F.col("words"))).alias("shared"), F.max(F.when(~own, F.struct("depth", "owner"))).alias("over"),
        F.max((own & (F.col("depth") == F.col("length")) & (F.col("far") == F.col("length"))).cast("int")).alias("leaf"))
    whole = Window.partitionBy("conv_id")
    facts = by_piece.select("conv_id", "piece", F.min("since").over(whole).alias("since"), F.coalesce(F.sum("shared").over(whole), F.lit(0)).alias("shared"), F.max("over").over(whole)["owner"].alias("over"), F.max("leaf").over(whole).alias("leaf"))
    rows = marked.join(facts, ["conv_id", "piece"])
    since = F.coalesce("since", F.col("length") + 1)
    goes_on = (F.col("depth") < F.col("length")) & (F.col("depth") + 1 >= since)
    nodes = rows.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.max(F.when(own, F.when(F.col("depth") > since, F.col("conv_id")).otherwise(F.col("over")))).alias("parent_conv_id"), F.count(F.lit(1)).alias("n_convs"),
        F.count_if(goes_on).alias("n_children"), F.sum("leaf").cast("long").alias("n_leaves"), F.sum(F.when(F.col("depth") < since, F.col("shared") - F.col("before")).otherwise(0)).alias("saved_tokens"))
    nodes = materialize(nodes)
    zero = F.lit(0).cast("long")
    top, n = conversations.agg(F.min("conv_id"), F.count("conv_id")).first()
    below = nodes.filter("depth = 1").agg(F.count(F.lit(1)).alias("n_children"), F.coalesce(F.sum("n_leaves"), F.lit(1)).cast("long").alias("n_leaves"), F.coalesce(F.sum("saved_tokens"), zero).alias("saved_tokens"))
    root = below.filter(F.lit(n > 0)).select(*(zero.alias(k) for k in KEY), F.lit(top).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(n).cast("long").alias("n_convs"), "n_children", "n_leaves", "saved_tokens")
    under = nodes.withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(top)).otherwise(F.col("parent_conv_id")).cast("long"))
    turnless = conversations.join(marked.filter("depth = 1").select("conv_id"), "conv_id", "left_anti").select(*(zero.alias(k) for k in KEY), "conv_id")
    hashes = id_hashes(marked.filter("depth = length").select(*KEY, "conv_id").unionByName(turnless))
    none = hashlib.sha256(b"").hexdigest()
    return under.unionByName(root).join(hashes, KEY, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(none)))


def id_hashes(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256): SHA-256 of the decimal conv_ids of each key, ascending, joined by commas."""
    order = [*KEY, "conv_id"]
    blocks = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(trimmed(_joined), "depth long, k1 long, k2 long, first long, ids string")
    dealt = blocks.repartition(*KEY).sortWithinPartitions(*KEY, "first")
    return dealt.mapInArrow(trimmed(_hashed), "depth long, k1 long, k2 long, ends_sha256 string")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batches(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType], n: int = 2048) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == n:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def blocks() -> Iterator[tuple]:
        key, ids = None, []
        for *own, conv in _rows(batches):
            if own != key or len(ids) == BLOCK:
                if ids:
                    yield (*key, ids[0], ",".join(map(str, ids)))
                key, ids = own, []
            ids.append(conv)
        if ids:
            yield (*key, ids[0], ",".join(map(str, ids)))

    # a block may hold a megabyte, so few of them are held at once
    yield from _batches(blocks(), [*KEY, "first", "ids"], [pa.int64()] * 4 + [pa.string()], 64)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def digests() -> Iterator[tuple]:
        key, state = None, None
        for *own, _, ids in _rows(batches):
            if own != key:
                if state:
                    yield (*key, state.hexdigest())
                key, state = own, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if state:
            yield (*key, state.hexdigest())

    yield from _batches(digests(), [*KEY, "ends_sha256"], [pa.int64()] * 3 + [pa.string()])


def with_turns(nodes: DataFrame, conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """Nodes of a trie over `numbered` turns with the role and text of their last turn; the root has none."""
    said = conversations.select(turn_hash().alias("said"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["said"])
    last = nodes.join(turns.select("conv_id", "depth", "said"), ["conv_id", "depth"], "left")
    return last.join(said, "said", "left").drop("said")
