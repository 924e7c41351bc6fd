"""Scoring texts with a probabilistic suffix tree over words.

The tree's states are contexts, the words before a token, newest first. A context is a candidate if training texts hold it
`least` times or more, whatever the size of the corpus, and if longer contexts could tell more than its parent (the context
without its oldest word): training texts go on from the parent with more than one word, and with one of them twice. Its
next-word distribution takes `discount` from each count and gives what that frees to the parent's distribution, so every
distribution sums to 1:

    P(w | s) = max(c(s, w) - discount, 0) / c(s) + discount * followers(s) / c(s) * P(w | parent)

A candidate is retained if it diverges from its parent on tokens that it hasn't seen: the gain in log likelihood over its own
occurrences, each left out of the counts that predict it, is at least `gain` nats. The root is the add-one distribution over
all training words. A token is scored by the longest retained suffix of its history. Depth grows level by level; a level costs a
pass over what is still open. `depth` is the order of the tree, a parameter of the model: with None it grows until no context can be
made longer, which takes as many passes as the longest run of one repeated word has words.

No state is ever gathered in one place, so the tree may grow with the corpus. Tasks cut their documents into chunks of about
`chunk_tokens` tokens: distinct words (64-bit hashes), their training counts, and the tokens as codes into them. At a level a
chunk sends each distinct pair of context and next word that is still open, with its training count and the parent's
probability, packed by range of a hash of the context; the owner of a range adds up, tests its contexts and answers each chunk.
Ranges are for a number of open tokens, so their rows don't get smaller as the corpus grows. The first two levels have most of the
pairs, and send them in two halves, one after the other.
A chunk's state (what its open tokens score so far, and each text's sum of settled ones) is written after each level. What tokens
score after the first level follows from its answers, which take less room, so there the state leaves it out. After the second
one, if there is a limit, a state lists its open tokens, and after the third it has the words that these still need, so that later
levels don't read the chunks, which go. Chunks, states and answers are bucketed by chunk, so only pairs and answers are shuffled,
and no row is made for a word. Word counts are exchanged in the same way first. A context has 44 bits of hash and a follower 20, which keeps clashes rare up to some 10
billion contexts a level.

Defined results: a null text is empty: one end token; a null doc_id counts as a training row; repeated rows count each;
an empty table gives an empty result; other columns are not read. If there is nothing to learn from, the root still is.
"""

from __future__ import annotations

import gc
import itertools
import math
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import new_folder, remove
from .common import materialize, release, rows_at_once, trimmed
from .textnp import CHAIN, bytes_of, chunks, mix64, word_hashes

#: The end of a text, as a word of its own. No word hashes to it but by a chance of 2**-64.
END = np.uint64(0x5E1F_E4D0_0F7E_0001)
#: Bits of a pair's key that stand for the next word; the others stand for the context.
FOLLOWER_BITS = np.uint64(20)
#: Steps a bit in which the divergence test knows the parent's probabilities.
PARENT_STEPS = 4
#: Entries that a range is for, and bytes of the batches in which tasks take what was sent.
RANGE_ENTRIES, BATCH_BYTES = 1 << 21, 4 << 20
#: What becomes of a token at a level: settled, asked for, or settled because its context is too rare.
SETTLED, OPEN, RARE = 0, 1, 2


@dataclass(frozen=True)
class Settings:
    depth: int | None = 8
    least: int = 2
    gain: float = 3.0
    discount: float = 0.5
    chunk_tokens: int = 1_000_000
    folds: int = 7
    held_out: int = 2


def pack(values: np.ndarray) -> bytes:
    """Compressed bytes of an integer array, one byte plane after another."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T) if len(values) else values.view(np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(kind)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and which is whose."""
    order = np.argsort(keys)
    ordered = keys[order]
    first = np.ones(len(keys), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=first[1:])
    of = np.empty(len(keys), np.uint32)
    of[order] = np.cumsum(first, dtype=np.uint32) - np.uint32(1)
    return ordered[first], of


def by_frequency(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words, frequent ones first, so that their codes take few bytes, and each token's code."""
    found = pa.array(hashes).dictionary_encode()
    words, codes = found.dictionary.to_numpy(), found.indices.to_numpy()
    order = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    return words[order], rank[codes]


CHUNK_FIELDS = "chunk long, doc_ids binary, no_id binary, sizes binary, train binary, codes binary, words binary, counts binary"


def read_chunks(docs: DataFrame, settings: Settings) -> DataFrame:
    """The chunk rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n_held, number = 0, TaskContext.get().partitionId() << 32

        def close() -> pa.RecordBatch:
            nonlocal held, n_held, number
            ids, sizes = [x for h in held for x in h[0]], np.concatenate([h[1] for h in held]).astype(np.int64)
            words, codes = by_frequency(np.concatenate([h[2] for h in held]))
            train = np.array([i is None or zlib.crc32(str(i).encode()) % settings.folds != settings.held_out for i in ids], dtype=bool)
            counts = np.bincount(codes[np.repeat(train, sizes)], minlength=len(words)).astype(np.uint32)
            values = [np.array([i or 0 for i in ids], np.int64), np.array([i is None for i in ids], np.uint8), sizes, train.astype(np.uint8), codes.astype(np.uint32), words, counts]
            row = pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.array([pack(v)], pa.binary()) for v in values)], names=["chunk", "doc_ids", "no_id", "sizes", "train", "codes", "words", "counts"])
            held, n_held, number = [], 0, number + 1
            return row

        for batch in batches:
            ids = batch.column(0).to_pylist()
            data, offsets = bytes_of(batch.column(1))
            for a, b in chunks(offsets):
                hashes, first = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                hashes = np.insert(hashes, first[1:], END)
                held.append((ids[a:b], np.diff(first) + 1, hashes))
                n_held += len(hashes)
                if n_held >= settings.chunk_tokens:
                    yield close()
        if held:
            yield close()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(run), CHUNK_FIELDS)


class Buckets:
    """Tables bucketed by chunk in the shared folder, so that they join without a shuffle."""

    def __init__(self, spark, n: int) -> None:
        self.spark, self.n, self.names = spark, n, {}

    def write(self, df: DataFrame) -> DataFrame:
        name = f"accordis_{uuid.uuid4().hex}"
        path = new_folder(self.spark, name)
        df.write.bucketBy(self.n, "chunk").sortBy("chunk").format("parquet").option("compression", "none").option("path", path).saveAsTable(name)
        table = self.spark.table(name)
        self.names[name] = table._written_at = path
        table._name = name
        return table

    def drop(self, table: DataFrame) -> None:
        """Forget a table and its files, and let Spark clear up what shuffles of finished jobs left."""
        self.spark.sql(f"DROP TABLE {table._name}")
        remove(self.names.pop(table._name))

    def drop_all(self) -> None:
        for name in list(self.names):
            self.spark.sql(f"DROP TABLE {name}")
            remove(self.names.pop(name))


def clear_up(spark) -> None:
    """Shuffle files of finished jobs go once the driver has collected its garbage; ask for that."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def each(f: Callable[[dict], Iterator[dict]], names: list[str], kinds: list[pa.DataType]) -> Callable:
    """A mapInArrow function that calls f with each row and yields its rows in one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: v[0] for k, v in batch.slice(i, 1).to_pydict().items()}
                out = list(f(row))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([o.get(n) for o in out], k) for n, k in zip(names, kinds, strict=True)], names=names)

    return trimmed(run)


def grouped(settle: Callable[[list[dict]], Iterator[dict]], names: list[str], kinds: list[pa.DataType]) -> Callable:
    """The same for groups of rows of one range, which come together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[dict] = []

        def close() -> Iterator[pa.RecordBatch]:
            out = list(settle(group))
            yield pa.RecordBatch.from_arrays([pa.array([o.get(n) for o in out], k) for n, k in zip(names, kinds, strict=True)], names=names)

        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: v[0] for k, v in batch.slice(i, 1).to_pydict().items()}
                if group and group[0]["range"] != row["range"]:
                    yield from close()
                    group.clear()
                group.append(row)
        if group:
            yield from close()

    return trimmed(run)


ASK = ("chunk long, range int, keys binary, counts binary, parents binary", ["chunk", "range", "keys", "counts", "parents"], [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()])


def cut(chunk: int, bits: int, keys: np.ndarray, counts: np.ndarray, parents: np.ndarray | None = None) -> Iterator[dict]:
    """Sorted keys with their counts, a row for each range of keys that holds some."""
    edges = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).tolist() + [len(keys)]
    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        if b > a:
            yield {"chunk": chunk, "range": i, "keys": pack(np.diff(keys[a:b], prepend=np.uint64(0))), "counts": pack(counts[a:b].astype(np.uint32)), "parents": None if parents is None else pack(parents[a:b])}


def merged(group: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """All keys of a range, where each sent key is among them, their total counts, and where each chunk's keys end."""
    keys = [np.cumsum(unpack(r["keys"], "<u8"), dtype=np.uint64) for r in group]
    every, at = distinct(np.concatenate(keys))
    totals = np.bincount(at, weights=np.concatenate([unpack(r["counts"], "<u4") for r in group])).astype(np.uint64)
    return every, at, totals, np.cumsum([0] + [len(k) for k in keys]).tolist()


def count_words(table: DataFrame, bits: int, tasks: int) -> DataFrame:
    """(chunk, range, answer) with the training counts of the chunk's words, and per range n_tokens and n_types with a null chunk."""

    def ask(r: dict) -> Iterator[dict]:
        words = unpack(r["words"], "<u8")
        order = np.argsort(words)
        yield from cut(r["chunk"], bits, words[order], unpack(r["counts"], "<u4")[order])

    def settle(group: list[dict]) -> Iterator[dict]:
        _, at, totals, edges = merged(group)
        for r, a, b in zip(group, edges, edges[1:], strict=False):
            yield {"chunk": r["chunk"], "range": r["range"], "answer": pack(totals[at[a:b]])}
        yield {"range": group[0]["range"], "n_tokens": int(totals.sum()), "n_types": int((totals > 0).sum())}

    asked = table.select("chunk", "words", "counts").mapInArrow(each(ask, *ASK[1:]), ASK[0])
    dealt = asked.repartition(tasks, "range").sortWithinPartitions("range", "chunk")
    names = ["chunk", "range", "answer", "n_tokens", "n_types"]
    return materialize(dealt.mapInArrow(grouped(settle, names, [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]), "chunk long, range int, answer binary, n_tokens long, n_types long"))


def by_chunk(answers: DataFrame, *columns: str) -> DataFrame:
    """One row a chunk: its answers in the order of their ranges."""
    return answers.filter("chunk IS NOT NULL").groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("range", *columns))).alias("answers"))


def joined(chunks: DataFrame, heard: list[DataFrame], to: str) -> DataFrame:
    """Chunks with their answers, those of one part after those of another."""
    names = [f"{to}_{i}" for i in range(len(heard))]
    for name, answers in zip(names, heard, strict=True):
        chunks = chunks.join(answers.withColumnRenamed("answers", name), "chunk", "left")
    return chunks.withColumn(to, F.flatten(F.array_compact(F.array(*names)))).drop(*names)


def with_words(state: DataFrame, table: DataFrame, depth: int) -> DataFrame:
    """Lean states, at the level at which they don't hold their words with what gives them."""
    if depth > WHOLE_LEVELS + 1:
        return state
    return state.join(table.select("chunk", F.col("codes").alias("chunk_codes"), F.col("words").alias("chunk_words")), "chunk")


def of_answers(row: dict, column: str, kind: str) -> np.ndarray:
    parts = [unpack(a[column], kind) for a in row["answers"] or ()]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


#: A state of whole chunks. values: of open tokens; before the first level, the training counts of the chunk's words. Where values follow
#: from what is still there (after_first), steps takes their place, the parent's probabilities that the next level asks with.
STATE_NAMES = ["chunk", "status", "values", "steps", "sums", "base", "known", "open"]
STATE = (", ".join(f"{n} {'long' if n in ('chunk', 'open') else 'binary'}" for n in STATE_NAMES), STATE_NAMES, [pa.int64() if n in ("chunk", "open") else pa.binary() for n in STATE_NAMES])


def places(sizes: np.ndarray) -> np.ndarray:
    """Each token's place in its text."""
    out = np.arange(int(sizes.sum()))
    out -= np.repeat(np.cumsum(sizes) - sizes, sizes)
    return out


def text_sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, np.cumsum(sizes) - sizes) if len(sizes) else values[:0]


def at_root(counts: np.ndarray, n: int, types: int) -> np.ndarray:
    """log10 probabilities of words at the root, by their training counts."""
    return np.log10(counts.astype(float) + 1) - math.log10(n + types + 1)


def start(n: int, types: int, settings: Settings) -> Callable[[dict], Iterator[dict]]:
    """The state of a chunk before the first level."""

    def run(r: dict) -> Iterator[dict]:
        sizes, codes, words = unpack(r["sizes"], "<i8"), unpack(r["codes"], "<u4"), unpack(r["words"], "<u8")
        counts = np.empty(len(words), np.uint64)
        counts[np.argsort(words)] = of_answers(r, "answer", "<u8")
        root = at_root(counts, n, types)
        place = places(sizes)
        status = np.where(place >= 1, OPEN, SETTLED).astype(np.uint8)
        status[1:][counts[codes[:-1]] < settings.least] = RARE
        status[place == 0] = SETTLED
        value = root[codes]
        yield {"chunk": r["chunk"], "status": pack(status), "values": pack(counts), "sums": pack(text_sums(np.where(status == OPEN, 0.0, value), sizes)), "base": pack(text_sums(value, sizes)), "known": pack(text_sums((counts > 0).astype(np.int64)[codes], sizes)), "open": int((status == OPEN).sum())}

    return run


def followers_of(words: np.ndarray) -> np.ndarray:
    return mix64(words ^ np.uint64(0xA5A5_A5A5_5A5A_5A5A)) >> (np.uint64(64) - FOLLOWER_BITS)


def contexts(codes: np.ndarray, words: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Contexts of so many words and next words of the tokens at these places."""
    context = mix64(words)[codes[at - 1]]
    for back in range(2, depth + 1):
        context = mix64(context * CHAIN + words[codes[at - back]])
    return context, followers_of(words).astype(np.uint32)[codes[at]]


def pairs(context: np.ndarray, follower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys of pairs of context and next word, and which is whose."""
    return distinct(((context >> FOLLOWER_BITS) << FOLLOWER_BITS) | follower)


def steps_of(value: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(value * (-PARENT_STEPS / math.log10(2))), 0, 255).astype(np.uint8)


def ask(chunk: int, bits: int, keys: np.ndarray, pair: np.ndarray, steps: np.ndarray, train: np.ndarray) -> Iterator[dict]:
    parents = np.zeros(len(keys), np.uint8)
    parents[pair] = steps
    yield from cut(chunk, bits, keys, np.bincount(pair, weights=train, minlength=len(keys)), parents)


def asking(depth: int, bits: int, n: int, types: int, part: int | None = None) -> Callable[[dict], Iterator[dict]]:
    """The pairs of a level, or those of a part of it: contexts whose first bit is part."""

    def run(r: dict) -> Iterator[dict]:
        if not r["open"]:
            return
        codes = unpack(r["codes"], "<u4")
        at = np.flatnonzero(unpack(r["status"], "u1") == OPEN)
        context, follower = contexts(codes, unpack(r["words"], "<u8"), at, depth)
        if r["steps"] is not None:
            steps = unpack(r["steps"], "u1")
        elif depth == 1:
            steps = steps_of(at_root(unpack(r["values"], "<u8"), n, types))[codes[at]]
        else:
            steps = steps_of(unpack(r["values"], "<f8"))
        if part is not None:
            mine = context >> np.uint64(63) == part
            at, context, follower, steps = at[mine], context[mine], follower[mine], steps[mine]
        keys, pair = pairs(context, follower)
        train = np.repeat(unpack(r["train"], "u1"), unpack(r["sizes"], "<i8"))[at]
        yield from ask(r["chunk"], bits, keys, pair, steps, train)

    return run


def states(keys: np.ndarray, counts: np.ndarray, parents: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For sorted pairs: which context each belongs to, and the contexts' counts, followers, whether they are retained and whether longer ones may be. parents: probabilities."""
    context = keys >> FOLLOWER_BITS
    of = np.cumsum(np.concatenate(([0], context[1:] != context[:-1]))) if len(keys) else np.zeros(0, np.int64)
    size = int(of[-1]) + 1 if len(of) else 0
    seen, followers, twice = np.bincount(of, counts, size), np.bincount(of, counts > 0, size), np.bincount(of, counts > 1, size)
    others = np.maximum(seen - 1, 1)
    left = np.maximum(followers[of] - (counts == 1), 0)  # followers without the one that is left out
    p = np.maximum(counts - 1 - settings.discount, 0) / others[of] + settings.discount * left / others[of] * parents
    gains = np.bincount(of, np.where(counts > 0, counts * np.log(np.maximum(p, 1e-300) / parents), 0.0), size)
    return of, seen, followers, (seen >= settings.least) & (gains >= settings.gain), (followers > 1) & (twice > 0)


def settle_pairs(settings: Settings) -> Callable[[list[dict]], Iterator[dict]]:
    def run(group: list[dict]) -> Iterator[dict]:
        keys, at, totals, edges = merged(group)
        parents = np.zeros(len(keys), np.uint8)
        parents[at] = np.concatenate([unpack(r["parents"], "u1") for r in group])
        of, seen, followers, kept, longer = states(keys, totals.astype(float), 2.0 ** (parents / -float(PARENT_STEPS)), settings)
        for r, a, b in zip(group, edges, edges[1:], strict=False):
            mine = at[a:b]
            first = np.concatenate(([True], of[mine][1:] != of[mine][:-1]))
            contexts = of[mine][first]
            # of contexts that aren't retained a chunk needs to know only whether they go on, and which of its pairs are rare
            known = np.where(kept[of[mine]], totals[mine], np.minimum(totals[mine], settings.least))
            mark = (np.where(kept, followers, 0)[contexts].astype(np.uint32) << np.uint32(2)) | (longer[contexts].astype(np.uint32) << np.uint32(1)) | kept[contexts]
            yield {"chunk": r["chunk"], "range": r["range"], "counts": pack(known.astype(np.uint32)), "seen": pack(np.where(kept, seen, 0)[contexts].astype(np.uint32)), "followers": pack(mark)}

    return run


ANSWER = ("chunk long, range int, counts binary, seen binary, followers binary", ["chunk", "range", "counts", "seen", "followers"], [pa.int64(), pa.int32(), *[pa.binary()] * 3])


def told(r: dict, settings: Settings, keys: np.ndarray, pair: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of open tokens by a chunk's answers: their values at this level, their pairs' counts, and whether longer contexts may tell more."""
    context = keys >> FOLLOWER_BITS
    of = np.cumsum(np.concatenate(([0], context[1:] != context[:-1])))
    counts, seen, marked = (of_answers(r, c, "<u4") for c in ("counts", "seen", "followers"))
    kept, longer, followers = (marked & 1).astype(bool)[of], (marked & 2).astype(bool)[of], (marked >> 2).astype(float)[of]
    some = np.maximum(seen, 1).astype(float)[of]
    plain, rest = np.where(kept, np.maximum(counts - settings.discount, 0) / some, 0.0), np.where(kept, settings.discount * followers / some, 1.0)
    return np.log10(np.maximum(plain[pair] + rest[pair] * 10.0**value, 1e-300)), counts[pair], longer[pair]


def first_values(r: dict, settings: Settings, n: int, types: int) -> np.ndarray:
    """What the tokens that are open after the first level score there, from that level's answers and the state before it."""
    codes, at = unpack(r["codes"], "<u4"), np.flatnonzero(unpack(r["first_status"], "u1") == OPEN)
    value = at_root(unpack(r["first_values"], "<u8"), n, types)[codes[at]]
    value = told(r | {"answers": r["first_answers"]}, settings, *pairs(*contexts(codes, unpack(r["words"], "<u8"), at, 1)), value)[0]
    return value[unpack(r["status"], "u1")[at] == OPEN]


def hearing(depth: int, settings: Settings, n: int, types: int) -> Callable[[dict], Iterator[dict]]:
    """The state after a level; after the last one that needs whole texts, what is left of it."""
    last, before_last = becomes_lean(depth, settings), becomes_lean(depth + 1, settings)

    def run(r: dict) -> Iterator[dict]:
        if not r["open"]:
            yield lean_row(r, r["sums"]) if last else {name: r[name] for name in STATE[1]}
            return
        sizes, codes, status = unpack(r["sizes"], "<i8"), unpack(r["codes"], "<u4"), unpack(r["status"], "u1").copy()
        at = np.flatnonzero(status == OPEN)
        if depth == 1:
            value = at_root(unpack(r["values"], "<u8"), n, types)[codes[at]]
        else:
            value = first_values(r, settings, n, types) if last else unpack(r["values"], "<f8")
        keys, pair = pairs(*contexts(codes, unpack(r["words"], "<u8"), at, depth))
        value, counts, longer = told(r, settings, keys, pair, value)
        del keys, pair
        # an open token's next context is seen as often as the pair one token earlier
        beside = np.concatenate(([False], at[1:] - at[:-1] == 1))  # the token before is open too, and the entry before
        rare = (status[at - 1] == RARE) | beside & (np.concatenate(([0], counts[:-1])) < settings.least)
        del beside, counts
        place = places(sizes)[at]
        goes_on = longer & (place > depth) & (settings.depth is None or depth < settings.depth)
        status[at] = np.where(goes_on, np.where(rare, RARE, OPEN), SETTLED)
        goes_on &= ~rare
        done = np.zeros(len(status))
        done[at[~goes_on]] = value[~goes_on]
        sums = pack(unpack(r["sums"], "<f8") + text_sums(done, sizes))
        del done, rare, longer
        if last:
            at, place = at[goes_on], place[goes_on]
            text = np.repeat(np.arange(len(sizes), dtype=np.uint32), sizes)
            open_now = {"at": at, "place": np.minimum(place, settings.depth), "rare": status[at - 1] == RARE, "train": np.repeat(unpack(r["train"], "u1"), sizes)[at], "text": text[at], "values": value[goes_on]}
            yield lean_row(r, sums, open_now)
            return
        value = value[goes_on]
        yield {"chunk": r["chunk"], "status": pack(status), "values": None if before_last else pack(value), "steps": pack(steps_of(value)) if before_last else None, "sums": sums, "base": r["base"], "known": r["known"], "open": int(goes_on.sum())}

    return run


#: The last level with a state for whole chunks. From the next one on few tokens are open, and a state is lists of these; the chunk
#: gives that level their words, and few enough are open after it for a state to hold the words that they still need.
WHOLE_LEVELS = 2
#: Arrays of a lean state, an entry for each open token, ascending by its place in the chunk. rare: whether the token before is.
#: context and follower are left out as long as the words are.
LEAN_ARRAYS = {"at": "<u4", "context": "<u8", "follower": "<u4", "place": "u1", "rare": "u1", "train": "u1", "text": "<u4", "values": "<f8"}
LEAN_NAMES = ["chunk", *LEAN_ARRAYS, "older", "words", "sums", "base", "known", "open"]
LEAN = (", ".join(f"{n} {'long' if n in ('chunk', 'open') else 'binary'}" for n in LEAN_NAMES), LEAN_NAMES, [pa.int64() if n in ("chunk", "open") else pa.binary() for n in LEAN_NAMES])


def becomes_lean(depth: int, settings: Settings) -> bool:
    """Whether states are lean after a level: one level later they hold the words of all later ones, so there must be a limit."""
    return depth == WHOLE_LEVELS and settings.depth is not None and settings.depth > WHOLE_LEVELS


def lean_row(r: dict, sums: bytes, tokens: dict[str, np.ndarray] | None = None, older: list[np.ndarray] | None = None, words: np.ndarray | None = None) -> dict:
    """A lean state; with older, the words of the next levels as a list of codes for each, it has no more need of the chunk."""
    row = {"chunk": r["chunk"], "sums": sums, "base": r["base"], "known": r["known"], "open": 0}
    if tokens is None or not len(tokens["at"]):
        return row
    row |= {n: pack((np.diff(v, prepend=0) if n == "at" else v).astype(LEAN_ARRAYS[n])) for n, v in tokens.items()} | {"open": len(tokens["at"])}
    if older is None:
        return row
    codes = np.concatenate(older)
    used = np.zeros(len(words), bool)
    used[codes] = True
    return row | {"older": pack((np.cumsum(used, dtype=np.uint32) - np.uint32(1))[codes]), "words": pack(words[used])}


def lean_tokens(r: dict, depth: int, limit: int) -> tuple[dict[str, np.ndarray], list[np.ndarray], np.ndarray]:
    """Open tokens with contexts of depth words, the words of the levels after that up to limit, and the words that codes stand for."""
    tokens = {n: unpack(r[n], kind) for n, kind in LEAN_ARRAYS.items() if r[n] is not None}
    at = tokens["at"] = np.cumsum(tokens["at"], dtype=np.int64)
    if r["older"] is None:
        codes, words = unpack(r["chunk_codes"], "<u4"), unpack(r["chunk_words"], "<u8")
        tokens["context"], tokens["follower"] = contexts(codes, words, at, depth)
        return tokens, [codes[np.where(tokens["place"] >= back, at - back, 0)] for back in range(depth + 1, limit + 1)], words
    words = unpack(r["words"], "<u8")
    older = np.split(unpack(r["older"], "<u4"), len(unpack(r["older"], "<u4")) // len(at))
    tokens["context"] = mix64(tokens["context"] * CHAIN + words[older[0]])
    return tokens, older[1:], words


def lean_asking(depth: int, bits: int) -> Callable[[dict], Iterator[dict]]:
    def run(r: dict) -> Iterator[dict]:
        if r["open"]:
            tokens = lean_tokens(r, depth, depth)[0]
            keys, pair = pairs(tokens["context"], tokens["follower"])
            yield from ask(r["chunk"], bits, keys, pair, steps_of(tokens["values"]), tokens["train"])

    return run


def lean_hearing(depth: int, settings: Settings) -> Callable[[dict], Iterator[dict]]:
    """hearing() of lean states."""

    def run(r: dict) -> Iterator[dict]:
        if not r["open"]:
            yield lean_row(r, r["sums"])
            return
        tokens, older, words = lean_tokens(r, depth, settings.depth)
        value, counts, longer = told(r, settings, *pairs(tokens["context"], tokens["follower"]), tokens["values"])
        beside = np.concatenate(([False], np.diff(tokens["at"]) == 1))  # the token before is open too, and the entry before
        rare = tokens["rare"].astype(bool) | beside & (np.concatenate(([0], counts[:-1])) < settings.least)
        goes_on = longer & (tokens["place"] > depth) & (depth < settings.depth)
        tokens["rare"] = tokens["rare"].astype(bool) | beside & np.concatenate(([False], (goes_on & rare)[:-1]))
        tokens["values"] = value
        goes_on &= ~rare
        sums = unpack(r["sums"], "<f8")
        sums = sums + np.bincount(tokens["text"][~goes_on], value[~goes_on], len(sums))
        yield lean_row(r, pack(sums), {n: v[goes_on] for n, v in tokens.items()}, [o[goes_on] for o in older], words)

    return run


def range_bits(entries: int) -> int:
    """Ranges are for some two million entries, so that the rows that chunks and ranges exchange stay few and large."""
    return max(5, math.ceil(math.log2(entries / RANGE_ENTRIES + 1)))


def score(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = Buckets(spark, min(100_000, max(partitions, size // (16 * 8 * settings.chunk_tokens))))  # Spark's own limit on buckets
    with rows_at_once(spark, 1000):
        table = buckets.write(read_chunks(docs, settings))
    bits = range_bits(size // 32)  # words that chunks send, about
    with rows_at_once(spark, 256, BATCH_BYTES):
        answers = count_words(table, bits, max(partitions, (1 << bits) // 64))
    first = answers.filter("chunk IS NULL").agg(F.sum("n_tokens"), F.sum("n_types")).first()
    n, types = int(first[0] or 0), int(first[1] or 0)
    heard = buckets.write(by_chunk(answers, "answer"))
    release(answers)
    with rows_at_once(spark, 1):
        state = buckets.write(table.select("chunk", "sizes", "codes", "words").join(heard, "chunk").mapInArrow(each(start(n, types, settings), *STATE[1:]), STATE[0]))
    buckets.drop(heard)
    ends, lean, first_level = table, False, []
    for depth in itertools.count(1) if settings.depth is None else range(1, settings.depth + 1):
        clear_up(spark)
        n_open = state.agg(F.sum("open")).first()[0]
        if not n_open:
            break
        bits = range_bits(n_open)
        tasks = max(partitions, (1 << bits) // 64)
        heard = []
        for part in (0, 1) if depth <= WHOLE_LEVELS else (None,):  # most pairs are of these levels; half of them at a time
            if not lean:
                asked = table.select("chunk", "sizes", "train", "codes", "words").join(state.select("chunk", "status", "values", "steps", "open"), "chunk").mapInArrow(each(asking(depth, bits, n, types, part), *ASK[1:]), ASK[0])
            else:
                asked = with_words(state.select("chunk", *LEAN_ARRAYS, "older", "words", "open"), table, depth).mapInArrow(each(lean_asking(depth, bits), *ASK[1:]), ASK[0])
            dealt = asked.repartition(tasks, "range").sortWithinPartitions("range", "chunk")
            settled = dealt.mapInArrow(grouped(settle_pairs(settings), *ANSWER[1:]), ANSWER[0])
            with rows_at_once(spark, 256, BATCH_BYTES):
                heard.append(buckets.write(by_chunk(settled, "counts", "seen", "followers")))
            del asked, dealt, settled
            clear_up(spark)  # pairs and answers go before others or the next state come
        if lean:
            after = joined(with_words(state, table, depth), heard, "answers").mapInArrow(each(lean_hearing(depth, settings), *LEAN[1:]), LEAN[0])
        else:
            both = joined(table.select("chunk", "sizes", "train", "codes", "words").join(state, "chunk"), heard, "answers")
            lean = becomes_lean(depth, settings)
            if lean:
                both = joined(both.join(first_level[0].select("chunk", F.col("status").alias("first_status"), F.col("values").alias("first_values")), "chunk"), first_level[1:], "first_answers")
            form = LEAN if lean else STATE
            after = both.mapInArrow(each(hearing(depth, settings, n, types), *form[1:]), form[0])
            del both
        with rows_at_once(spark, 1):  # a row is a whole chunk
            after = buckets.write(after)
        done = [state, *heard]
        if becomes_lean(depth + 1, settings):
            first_level, done = done, []
        elif lean and depth == WHOLE_LEVELS:
            done += first_level
        elif lean and depth == WHOLE_LEVELS + 1:  # states have their words
            ends = buckets.write(table.select("chunk", "doc_ids", "no_id", "sizes", "train"))
            done.append(table)
        for each_one in done:
            buckets.drop(each_one)
        state = after
    fields = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = {k: v[0] for k, v in batch.slice(i, 1).to_pydict().items()}
                sizes = unpack(r["sizes"], "<i8")
                columns = [pa.array(unpack(r["doc_ids"], "<i8"), mask=unpack(r["no_id"], "u1").astype(bool)), pa.array(~unpack(r["train"], "u1").astype(bool)), pa.array(sizes), pa.array(unpack(r["known"], "<i8")), pa.array(np.full(len(sizes), n, np.int64)), pa.array(unpack(r["base"], "<f8")), pa.array(unpack(r["sums"], "<f8"))]
                yield pa.RecordBatch.from_arrays(columns, names=fields)

    ended = ends.select("chunk", "doc_ids", "no_id", "sizes", "train").join(state.select("chunk", "sums", "base", "known"), "chunk")
    out = materialize(ended.mapInArrow(trimmed(run), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"))
    buckets.drop_all()
    return out
