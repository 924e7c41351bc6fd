"""N-gram Jaccard join: documents whose sets of word shingles have a Jaccard similarity of at least num / den.

Exact copies of a set count once from the start (a key is a 64-bit hash of the set). Tiles: sets whose size bands can
link meet in the tiles of the shingles in their prefix. Shingles stand in one global order, the frequent ones last (at
least a share `frequent` of all, so at most 1 / frequent of them are ever broadcast) and by hash otherwise; two sets with
the similarity share a shingle among the first n - ceil(t n) + 1 of each, so no link is lost. Bitmaps: a set's signature is
a hashed parity bitmap whose width follows its size band; wide ones fold to the width of narrow ones, and the bits that
differ bound the overlap from above: overlap <= (|A| + |B| - bits) / 2. Pairs that the bound leaves are checked exactly by
intersecting the sorted arrays.

Large groups: a first pass checks for each set one partner only, the one that it meets in most tiles among the smallest keys
of these, and the sets next to it in tiles of more than `tile` sets. Links join sets to components. In two further passes, the
sets of a tile that lie in different components compare bitmaps in memory, after a row a set and tile has got its component:
first each set gives only the likeliest partner that the bound leaves, then tiles that had more give all that are still apart.
So the components are exact, while pairs inside a component are never listed, and of a group of near copies only a few links a
set. Larger tiles are split by size band and block, and block pairs compare. Partners of one set are spread over salted tiles
of at most `tile` each.

Defined results: texts without words have no shingles and link with nothing; a text of fewer than k words has one
shingle; null is an empty text; repeated rows are copies; a null doc_id never is a component's id unless it has no other;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, release, small, trimmed
from .graph import components
from .textnp import mix64, shingle_sets


@dataclass(frozen=True)
class Settings:
    k: int = 5
    num: int = 75
    den: int = 100
    frequent: float = 1e-7
    tile: int = 64
    block: int = 1024
    #: Shingles looked through at once for frequent ones; sets remembered by a task to leave out copies; rows of a tile task.
    sample: int = 1_000_000
    remembered: int = 200_000
    task_rows: int = 500_000
    tile_rows: int = 100_000
    #: Ids up to this many are broadcast, more are joined by a shuffle.
    broadcast_ids: int = 1_000_000


def set_key(hashes: np.ndarray) -> int:
    """A signed 64-bit key of a set."""
    return int(mix64(np.add.reduce(mix64(hashes ^ np.uint64(0x2545F4914F6CDD1D)), keepdims=True, dtype=np.uint64) + np.uint64(len(hashes)))[0].astype(np.int64)) if len(hashes) else 0


def prefix_size(n: int, s: Settings) -> int:
    return n - -(-s.num * n // s.den) + 1


def can_link(a: np.ndarray, b: np.ndarray, s: Settings) -> np.ndarray:
    """Whether sizes allow the similarity."""
    return s.den * np.minimum(a, b) >= s.num * np.maximum(a, b)


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """Parity bitmap: at least 256 bits and at least twice the set's size rounded up to a power of two, 65,536 at most."""
    bits = min(65_536, max(256, 2 << (len(hashes) - 1).bit_length()))
    at = (mix64(hashes + np.uint64(77)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little")


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    """A bitmap at a lower width: halves fold by parity, as the low bits of a hash stay."""
    while len(bits) > width:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def differing(a: np.ndarray, b: np.ndarray) -> int:
    """A lower bound on the size of the symmetric difference."""
    width = min(len(a), len(b))
    return int(np.bitwise_count(folded(a, width) ^ folded(b, width)).sum())


def linked(overlap: int, a: int, b: int, s: Settings) -> bool:
    return s.den * overlap >= s.num * (a + b - overlap)


def describe(docs: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, n, key, bits) of each row, and rows with n = -1 whose blobs are shingles that two or more sets of a run of `sample` shingles hold, with counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[int] = set()
        n_held = 0

        def found() -> tuple[bytes, bytes]:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            keep = counts >= 2
            return values[keep].tobytes(), counts[keep].astype(np.int32).tobytes()

        def out(ids: list, ns: list, keys: list, bits: list, blobs: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(keys, pa.int64()), pa.array(bits, pa.binary()), pa.array([b[0] for b in blobs], pa.binary()), pa.array([b[1] for b in blobs], pa.binary())], names=["doc_id", "n", "key", "bits", "shingles", "counts"])

        for batch in batches:
            ns, keys, bits = [], [], []
            for _, hashes in shingle_sets(batch.column(1), s.k):
                ns.append(len(hashes))
                keys.append(set_key(hashes))
                bits.append(bitmap(hashes).tobytes() if len(hashes) else None)
                if keys[-1] in seen:
                    continue
                if len(seen) >= s.remembered:
                    seen.clear()
                seen.add(keys[-1])
                held.append(hashes)
                n_held += len(hashes)
                if n_held >= s.sample:
                    yield out([None], [-1], [None], [None], [found()])
                    held, n_held = [], 0
            yield out(batch.column(0).to_pylist(), ns, keys, bits, [(None, None)] * len(ns))
        if held:
            yield out([None], [-1], [None], [None], [found()])

    return materialize(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(run), "doc_id long, n long, key long, bits binary, shingles binary, counts binary"))


def frequent_shingles(described: DataFrame, total: int, s: Settings) -> np.ndarray:
    """Sorted shingles whose sets, by what tasks report, are at least 8 and a share of at least `frequent`: at most 1 / frequent values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for values, counts in zip(batch.column(0), batch.column(1), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(values.as_py(), np.int64)), pa.array(np.frombuffer(counts.as_py(), np.int32))], names=["shingle", "n"])

    rows = described.filter("n = -1").select("shingles", "counts").mapInArrow(trimmed(run), "shingle long, n int")
    kept = rows.groupBy("shingle").agg(F.sum("n").alias("n")).filter(F.col("n") >= max(8.0, s.frequent * total)).select("shingle")
    return np.sort(kept.toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64))


def prefixes(docs: DataFrame, shared: Broadcast, s: Settings) -> DataFrame:
    """(shingle, key, n) for the prefix of each set, the broadcast frequent shingles last; a task leaves out sets that it has seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = shared.value
        seen: set[int] = set()
        for batch in batches:
            parts, keys, ns = [], [], []
            for _, hashes in shingle_sets(batch.column(0), s.k):
                if not len(hashes) or (key := set_key(hashes)) in seen:
                    continue
                if len(seen) >= s.remembered:
                    seen.clear()
                seen.add(key)
                if len(last):
                    at = np.minimum(np.searchsorted(last, hashes), len(last) - 1)
                    hot = last[at] == hashes
                    hashes = np.concatenate((hashes[~hot], hashes[hot])) if hot.any() else hashes
                parts.append(hashes[: prefix_size(len(hashes), s)])
                keys.append(key)
                ns.append(len(hashes))
            if parts:
                sizes = np.array([len(p) for p in parts])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts).view(np.int64)), pa.array(np.repeat(np.array(keys, np.int64), sizes)), pa.array(np.repeat(np.array(ns, np.int32), sizes))], names=["shingle", "key", "n"])

    return docs.select("text").mapInArrow(trimmed(run), "shingle long, key long, n int")


def tiles(rows: DataFrame, tasks: int, s: Settings) -> DataFrame:
    """First partners and tiles, from (shingle, key, n); sets without a partner of fitting size stay out.

    kind 0: a set v, the smallest key u that it meets in a tile of at most `tile` sets, if that is below v, and in how many of a task's tiles it does.
    kind 1: neighbours in size in a larger tile. kind 2: a member v of a larger tile, u being the shingle. kind 3: the same
    of a tile of at most `tile` sets, u being a hash of the sets that it holds: tiles that hold the same ones are one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, key, n, place, inside = _dealt(batches)
        if not len(key):
            return
        low, meets = key.copy(), np.zeros(len(key), bool)
        for a, b in _within(n, place, inside, s):
            low[a], low[b] = np.minimum(low[a], key[b]), np.minimum(low[b], key[a])
            meets[a] = meets[b] = True
        at = np.flatnonzero(low < key)
        near, times = np.unique(np.stack((low[at], key[at]), 1), axis=0, return_counts=True)
        yield _rows_of(0, near[:, 0], near[:, 1], times)
        at = np.flatnonzero(meets)
        if len(at):
            begins = np.flatnonzero(np.concatenate(([True], shingle[at][1:] != shingle[at][:-1])))
            sizes = np.diff(np.append(begins, len(at)))
            held = np.add.reduceat(mix64(key[at].view(np.uint64)), begins) + mix64(sizes.astype(np.uint64))
            one = np.zeros(len(begins), bool)
            one[np.unique(held, return_index=True)[1]] = True
            same, at = np.repeat(held.view(np.int64), sizes)[np.repeat(one, sizes)], at[np.repeat(one, sizes)]
            yield _rows_of(3, same, key[at], n[at])
        a = np.flatnonzero((inside > s.tile) & (place + 1 < inside))
        if len(a):
            a = a[can_link(n[a], n[a + 1], s)]
            near = np.unique(np.stack((np.minimum(key[a], key[a + 1]), np.maximum(key[a], key[a + 1])), 1), axis=0)
            yield _rows_of(1, near[:, 0], near[:, 1], np.zeros(len(near)))
            big = np.flatnonzero(inside > s.tile)
            yield _rows_of(2, shingle[big], key[big], n[big])

    return rows.repartition(tasks, "shingle").mapInArrow(trimmed(run), "kind int, u long, v long, n int")


def _dealt(batches: Iterator[pa.RecordBatch], columns: int = 3) -> list[np.ndarray]:
    """(shingle, key, n, ...) of a task, distinct and in the order (shingle, n, key), then each row's place in its tile and the tile's size."""
    got = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
    if not got:
        return [np.zeros(0, np.int64)] * (columns + 2)
    held = [np.concatenate(x) for x in zip(*got, strict=True)]
    del got
    order = np.lexsort((held[1], held[2], held[0]))
    held = [x[order] for x in held]
    new = np.concatenate(([True], (held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1])))
    held = [x[new] for x in held]
    starts = np.flatnonzero(np.concatenate(([True], held[0][1:] != held[0][:-1])))
    sizes = np.diff(np.append(starts, len(held[0])))
    return [*held, np.arange(len(held[0])) - np.repeat(starts, sizes), np.repeat(sizes, sizes)]


def _within(n: np.ndarray, place: np.ndarray, inside: np.ndarray, s: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of tiles of at most `tile` sets that fit in size, by their distance within the tile."""
    a = np.flatnonzero((inside > 1) & (inside <= s.tile))
    for step in range(1, s.tile):
        a = a[place[a] + step < inside[a]]
        if not len(a):
            return
        fits = a[can_link(n[a], n[a + step], s)]
        yield fits, fits + step


def _rows_of(kind: int, u: np.ndarray, v: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(u), kind, np.int32)), pa.array(u), pa.array(v), pa.array(n.astype(np.int32))], names=["kind", "u", "v", "n"])


def bitmaps(described: DataFrame, keys: DataFrame, s: Settings) -> DataFrame:
    """(key, n, bits) of the sets in keys."""
    known = described.filter("n > 0").select("key", F.col("n").cast("int").alias("n"), "bits").join(small(keys, s.broadcast_ids), "key", "left_semi")
    return materialize(known.groupBy("key").agg(F.first("n").alias("n"), F.first("bits").alias("bits")))


def arrays(docs: DataFrame, described: DataFrame, keys: DataFrame, s: Settings) -> DataFrame:
    """(key, n, shingles) of the sets in keys, from one document each: texts are read again, so only these are ever written."""
    spare = described.filter("n > 0").select("key", "doc_id").join(small(keys, s.broadcast_ids), "key", "left_semi").groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id")).alias("m")).select("key", F.col("m.doc_id").alias("_id"))
    spare = materialize(spare)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(set_key(h), len(h), h.tobytes()) for _, h in shingle_sets(batch.column(0), s.k) if len(h)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["key", "n", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(small(spare.select("_id").distinct(), s.broadcast_ids), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    made = texts.select("text").mapInArrow(trimmed(run), "key long, n int, shingles binary").join(small(spare.select("key"), s.broadcast_ids), "key", "left_semi")
    return materialize(made.dropDuplicates(["key"]))


def check(pairs: DataFrame, sets: DataFrame, column: str, test: Callable[[bytes, int, bytes, int], bool], s: Settings) -> DataFrame:
    """The pairs (u, v) that pass a test on a column of their sets. v's of one u are spread over tiles of at most `tile`."""
    degrees = pairs.groupBy("u").agg(F.count(F.lit(1)).alias("_d"))
    salted = degrees.withColumn("_salts", F.ceil(F.col("_d") / s.tile).cast("int"))
    left = salted.join(sets, F.col("u") == F.col("key")).select("u", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("v"), "n", F.col(column).alias("payload"))
    right = pairs.join(salted, "u").withColumn("salt", F.pmod(F.xxhash64("v"), "_salts").cast("int")).join(sets, F.col("v") == F.col("key")).select("u", "salt", "v", "n", F.col(column).alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: tuple | None = None
        for batch in batches:
            hits = []
            for u, salt, v, n, payload in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if v is None:
                    own = (u, salt, payload, n)
                elif own and own[:2] == (u, salt) and test(own[2], own[3], payload, n):
                    hits.append((u, v))
            yield pa.RecordBatch.from_arrays([pa.array([h[i] for h in hits], pa.int64()) for i in (0, 1)], names=["u", "v"])

    dealt = left.unionAll(right).repartition("u", "salt").sortWithinPartitions(F.col("u"), F.col("salt"), F.col("v").asc_nulls_first())
    return materialize(dealt.mapInArrow(trimmed(run), "u long, v long"))


def links(pairs: DataFrame, docs: DataFrame, described: DataFrame, bits: DataFrame, s: Settings, bounded: bool = False) -> DataFrame:
    """The candidate pairs that link: the bitmaps' bound first, unless they passed it, then the exact intersection of what it leaves."""

    def bound(a: bytes, na: int, b: bytes, nb: int) -> bool:
        return linked((na + nb - differing(np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8))) // 2, na, nb, s)

    def exact(a: bytes, na: int, b: bytes, nb: int) -> bool:
        x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
        at = np.minimum(np.searchsorted(x, y), na - 1)
        return linked(int((x[at] == y).sum()), na, nb, s)

    passing = pairs if bounded else check(pairs, bits, "bits", bound, s)
    keys = passing.select(F.explode(F.array("u", "v")).alias("key")).distinct()
    sets = arrays(docs, described, materialize(keys), s)
    found = check(passing, sets, "shingles", exact, s)
    release(sets)
    return found


class Bitmaps:
    """The bitmaps of some sets as matrices, by width; those of twice a width also stand folded to it."""

    def __init__(self, bits: list[bytes], n: np.ndarray, s: Settings) -> None:
        self.n, self.s = n, s
        self.width = np.fromiter(map(len, bits), np.int64, len(bits))
        self.place, self.rows = {}, {}
        above = None
        for w in sorted(set(self.width.tolist()), reverse=True):
            own = np.flatnonzero(self.width == w)
            matrix = np.frombuffer(b"".join([bits[i] for i in own.tolist()]), np.uint64).reshape(len(own), w // 8)
            place = np.zeros(len(bits), np.int32)
            place[own] = np.arange(len(own))
            rows = matrix
            if above and above[0] == 2 * w:
                place[above[1]] = len(own) + np.arange(len(above[1]))
                rows = np.concatenate((matrix, above[2][:, : w // 8] ^ above[2][:, w // 8 :]))
            self.place[w], self.rows[w] = place, rows
            above = (w, own, matrix)

    def likeness(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The highest similarity that the bitmaps allow, -1 where that is too low. Sizes fit, so widths are equal or one is twice the other."""
        out = np.full(len(a), -1.0)
        width = np.minimum(self.width[a], self.width[b])
        for w in np.unique(width).tolist():
            at, place, rows = np.flatnonzero(width == w), self.place[w], self.rows[w]
            for c in range(0, len(at), max(1, 4_000_000 // w)):
                i = at[c : c + max(1, 4_000_000 // w)]
                x, y = a[i], b[i]
                differ = np.bitwise_count(rows[place[x]] ^ rows[place[y]]).sum(axis=1, dtype=np.int64)
                both = self.n[x] + self.n[y]
                overlap = (both - differ) // 2
                out[i] = np.where(self.s.den * overlap >= self.s.num * (both - overlap), overlap / np.maximum(1, both - overlap), -1.0)
        return out


def _found(u: np.ndarray, v: np.ndarray, open_tiles: np.ndarray) -> pa.RecordBatch:
    """Pairs, and tiles that have more of them than were given."""
    pairs = np.unique(np.stack((np.minimum(u, v), np.maximum(u, v)), 1), axis=0)
    blank = [None] * len(open_tiles)
    return pa.RecordBatch.from_arrays([pa.array([*pairs[:, 0].tolist(), *blank], pa.int64()), pa.array([*pairs[:, 1].tolist(), *blank], pa.int64()), pa.array([None] * len(pairs) + open_tiles.tolist(), pa.int64())], names=["u", "v", "tile"])


class Likeliest:
    """For each of some sets the likeliest partner among pairs that come bit by bit."""

    def __init__(self, n: int) -> None:
        self.best, self.mate, self.pairs = np.full(n, -1.0), np.full(n, -1), 0

    def add(self, a: np.ndarray, b: np.ndarray, likeness: np.ndarray) -> None:
        """Pairs of rows; in one call a row comes first of a pair once at most, and second once at most."""
        self.pairs += len(a)
        for x, y in ((a, b), (b, a)):
            better = likeness > self.best[x]
            self.best[x[better]], self.mate[x[better]] = likeness[better], y[better]

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs of a row and its mate, the lower row first."""
        x = np.flatnonzero(self.mate >= 0)
        pairs = np.unique(np.stack((np.minimum(x, self.mate[x]), np.maximum(x, self.mate[x])), 1), axis=0)
        return pairs[:, 0], pairs[:, 1]


def members_of(found: DataFrame) -> DataFrame:
    """(shingle, key, large): the sets of each tile, of equal tiles once."""
    return materialize(found.filter("kind >= 2").select(F.col("u").alias("shingle"), F.col("v").alias("key"), (F.col("kind") == 2).alias("large")).distinct())


def across(members: DataFrame, roots: DataFrame, bits: DataFrame, s: Settings, only: DataFrame | None = None) -> DataFrame:
    """(u, v, tile): pairs of a tile's sets that lie in different components and pass the bitmaps' bound.

    Without `only`, each set gives its likeliest partner in the tile, and tiles that hold other pairs as well are listed
    (u and v null). With `only` (tile), these tiles give all their pairs. Components are told apart a row a set and tile.
    """
    every = only is not None
    if only is not None:
        members = members.join(small(only.select(F.col("tile").alias("shingle")), s.broadcast_ids), "shingle", "left_semi")
    members = members.join(small(roots, s.broadcast_ids), F.col("key") == F.col("node"), "left").select("shingle", "key", "large", F.coalesce("root", "key").alias("root"))
    mixed = members.groupBy("shingle").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a != b").select("shingle")
    members = materialize(members.join(mixed, "shingle", "left_semi"))
    return _small_tiles(members.filter("NOT large"), bits, s, every).unionAll(_large_tiles(members.filter("large"), bits, s, every))


def _small_tiles(members: DataFrame, bits: DataFrame, s: Settings, every: bool) -> DataFrame:
    """Pairs of tiles of at most `tile` sets, which stand in one task each."""
    tasks = max(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), members.count() // s.tile_rows + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        shingle, key, n, root = (np.concatenate([b.column(i).to_numpy() for b in got]) for i in range(4))
        order = np.lexsort((key, n, shingle))
        held = [x for b in got for x in b.column(4).to_pylist()]
        del got
        maps = Bitmaps([held[i] for i in order.tolist()], n[order], s)
        del held
        shingle, key, n, root = shingle[order], key[order], n[order], root[order]
        starts = np.flatnonzero(np.concatenate(([True], shingle[1:] != shingle[:-1])))
        sizes = np.diff(np.append(starts, len(shingle)))
        tile = np.repeat(np.arange(len(starts)), sizes)
        likeliest, seen = Likeliest(len(key)), np.zeros(len(starts), np.int64)
        for a, b in _within(n, np.arange(len(key)) - starts[tile], sizes[tile], s):
            apart = root[a] != root[b]
            a, b = a[apart], b[apart]
            like = maps.likeness(a, b)
            a, b, like = a[like >= 0], b[like >= 0], like[like >= 0]
            if every:
                yield _found(key[a], key[b], starts[:0])
            else:
                likeliest.add(a, b, like)
                seen += np.bincount(tile[a], minlength=len(starts))
        if not every:
            a, b = likeliest.edges()
            yield _found(key[a], key[b], shingle[starts[np.bincount(tile[a], minlength=len(starts)) < seen]])

    return members.join(bits, "key").select("shingle", "key", "n", "root", "bits").repartition(tasks, "shingle").mapInArrow(trimmed(run), "u long, v long, tile long")


def _large_tiles(members: DataFrame, bits: DataFrame, s: Settings, every: bool) -> DataFrame:
    """Pairs of larger tiles. A tile's members are split by size band (a band's sets link only with its own and the two bands
    beside it) and a band by hash into blocks of about `block` sets. Blocks meet in pairs, each pair in a task's memory at once.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(s.den / s.num))).cast("int")
    rows = members.join(bits, "key").withColumn("band", band)
    blocks = rows.groupBy("shingle", "band").agg(F.ceil(F.count(F.lit(1)) / s.block).cast("int").alias("_own"))
    rows = rows.join(blocks, ["shingle", "band"])
    for name, step in (("_next", -1), ("_prev", 1)):
        rows = rows.join(blocks.select("shingle", (F.col("band") + step).alias("band"), F.col("_own").alias(name)), ["shingle", "band"], "left")
    block = F.pmod(F.xxhash64("key"), "_own").cast("int")
    upto = lambda n: F.filter(F.sequence(F.lit(0), F.coalesce(n, F.lit(0))), lambda x: x < F.coalesce(n, F.lit(0)))
    place = lambda b, cross, i, j, side: F.struct(b.alias("band"), F.lit(cross).alias("cross"), i.alias("i"), j.alias("j"), side.alias("side"))
    own = F.transform(upto(F.col("_own")), lambda x: place(F.col("band"), 0, F.least(block, x), F.greatest(block, x), F.when(block <= x, 0).otherwise(1)))
    up = F.transform(upto(F.col("_next")), lambda x: place(F.col("band") + 1, 1, block, x, F.lit(0)))
    down = F.transform(upto(F.col("_prev")), lambda x: place(F.col("band"), 1, x, block, F.lit(1)))
    placed = rows.select("shingle", "key", "n", "root", "bits", F.explode(F.concat(own, up, down)).alias("t")).select("shingle", "t.*", "key", "n", "root", "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:5] != at:
                    yield from meet(at, held)
                    at, held = row[:5], []
                held.append(row[5:])
        yield from meet(at, held)

    def meet(at: tuple | None, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        if len(held) < 2:
            return
        side, key, n, root = (np.array([r[k] for r in held], np.int64) for k in range(4))
        maps = Bitmaps([r[4] for r in held], n, s)
        left = np.flatnonzero(side == 0)
        alone = at[2] == 0 and at[3] == at[4]
        right = left if alone else np.flatnonzero(side == 1)
        likeliest, out = Likeliest(len(key)), []
        for step in range(1 if alone else 0, len(right)):  # each left row with one right row at a time
            a = left[: len(left) - step] if alone else left
            b = right[step:] if alone else right[(np.arange(len(left)) + step) % len(right)]
            fits = (root[a] != root[b]) & can_link(n[a], n[b], s)
            a, b = a[fits], b[fits]
            like = maps.likeness(a, b)
            a, b, like = a[like >= 0], b[like >= 0], like[like >= 0]
            if not len(a):
                continue
            if every:
                out.append((a, b))
            else:
                for c in range(0, len(a), len(right)):  # a right row comes once at most
                    likeliest.add(a[c : c + len(right)], b[c : c + len(right)], like[c : c + len(right)])
        if every and out:
            a, b = (np.concatenate(x) for x in zip(*out, strict=True))
            yield _found(key[a], key[b], key[:0])
        elif not every and likeliest.pairs:
            a, b = likeliest.edges()
            yield _found(key[a], key[b], np.array([at[0]] if len(a) < likeliest.pairs else [], np.int64))

    keys = ["shingle", "band", "cross", "i", "j"]
    return placed.select(*keys, "side", "key", "n", "root", "bits").repartition(*keys).sortWithinPartitions(*keys, "key").mapInArrow(trimmed(run), "u long, v long, tile long")


def link_sets(docs: DataFrame, s: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """Documents as (doc_id, n, key), and (node, root) of the sets that link with another."""
    docs = docs.select("doc_id", F.col("text"))
    described = describe(docs, s)
    total = described.filter("n > 0").agg(F.sum("n")).first()[0] or 0
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(described, total, s))
    share = (s.den - s.num) / s.den
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(total * share / s.task_rows) + 1)
    found = materialize(tiles(prefixes(docs, frequent, s), tasks, s))
    frequent.destroy()
    # of a set's partners the one that it meets in most tiles: it is the likeliest to link
    met = found.filter("kind < 2").groupBy("u", "v").agg(F.sum("n").alias("n")).groupBy("v").agg(F.max_by("u", F.struct("n", F.bitwise_not("u"))).alias("u"))
    first = materialize(met.select("u", "v").unionAll(found.filter("kind = 1").select("u", "v")).distinct())
    members = members_of(found)
    keys = materialize(members.select("key").distinct())
    bits = bitmaps(described, keys, s)
    linked = links(first, docs, described, bits, s)
    roots, tested, only = components(linked), first, None
    for _ in range(2):
        got = materialize(across(members, roots, bits, s, only))
        pairs = materialize(got.filter("u IS NOT NULL").select("u", "v").distinct().join(tested, ["u", "v"], "left_anti"))
        if not pairs.isEmpty():
            more = links(pairs, docs, described, bits, s, bounded=True)
            if not more.isEmpty():
                moved = roots
                roots, linked = components(linked.unionAll(more)), linked.unionAll(more)
                release(moved)
        only = got.filter("tile IS NOT NULL").select("tile").distinct()
        if only.isEmpty():
            break
        tested = tested.unionAll(pairs)
    release(found, members, keys, bits)
    return described.filter("n >= 0").select("doc_id", "n", "key"), roots


def join(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles, component_id and key (of the set) of every row."""
    rows, roots = link_sets(docs, s)
    by_set = rows.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("_min"), F.count(F.lit(1)).alias("_rows"))
    rooted = by_set.join(roots, F.col("key") == F.col("node"), "left").withColumn("_root", F.coalesce("root", "key"))
    lowest = rooted.groupBy("_root").agg(F.min("_min").alias("component_id"), F.sum("_rows").alias("_size")).filter("_size > 1")
    named = materialize(rooted.join(lowest, "_root").select(F.col("key").alias("_key"), "component_id"))
    joined = rows.join(small(named, 200_000), (F.col("key") == F.col("_key")) & (F.col("n") > 0), "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "key")


def keep_one(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """docs with one row of each component: the one with the smallest doc_id, of several the one with the smallest set key and row hash."""
    rows, roots = link_sets(docs, s)
    sized = rows.filter("n > 0").join(roots, F.col("key") == F.col("node"), "left").withColumn("_root", F.coalesce("root", "key"))
    best = sized.groupBy("_root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "key")).alias("_best"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    ruled = sized.select("_root", F.col("key").alias("_key")).distinct().join(best, "_root").select("_key", F.col("_best.doc_id").alias("_id"), F.col("_best.key").alias("_of"))
    ruled = materialize(ruled)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [set_key(h) if len(h) else None for _, h in shingle_sets(batch.column(1), s.k)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64())], names=["_row", "_set"])

    packed = docs.select(F.struct("*").alias("_row"), "text")
    out = T.StructType([packed.schema["_row"], T.StructField("_set", T.LongType())])
    joined = packed.mapInArrow(trimmed(keyed), out).join(small(ruled, 200_000), F.col("_set") == F.col("_key"), "left")
    winner = (F.col("_set") == F.col("_of")) & F.col("_row.doc_id").eqNullSafe(F.col("_id"))
    kept = joined.filter(F.col("_key").isNull() | winner)
    again = rows.filter("n > 0").join(ruled.filter("_key = _of"), (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id"))).groupBy("_key").count().filter("count > 1").select(F.col("_key").alias("_twice"))
    again = materialize(again)
    if again.isEmpty():
        return kept.select("_row.*")
    marked = kept.join(small(again), F.col("_set") == F.col("_twice"), "left")
    one = F.row_number().over(Window.partitionBy("_set").orderBy(F.xxhash64("_row")))
    single = marked.filter(F.col("_twice").isNull()).select("_row.*")
    return single.unionAll(marked.filter(F.col("_twice").isNotNull()).withColumn("_one", one).filter("_one = 1").select("_row.*"))
