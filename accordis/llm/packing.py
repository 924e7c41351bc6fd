"""Packing documents into training sequences: hierarchical, over several context sizes.

Routing: a document's ids are cut into whole windows of the largest size; the rest goes to the tier of the next size that
holds it (512, 1024, 2048, 4096 by default). Packing: each task keeps a pool of rests by tier and, when the pool is full,
packs it tier by tier into windows of the tier's own size, all of them full: the longest rest opens a window and its gap is
filled from shorter tiers, longest first that still fits; a last gap is closed exactly by cutting one rest. What a task can't
close into a window of the shortest tier goes on with its ids to a few tasks that pack these tails the same way, and so on
until one pool is left. Its last tail, shorter than the shortest window, is the only padded sequence.

Step groups: sequences of a task are dealt to groups of `step_size` in turn, in order of their length and piece count, so that
steps hold about as many tokens; `step_id` is a column beside the contract.

Memory: a task holds one pool (pool_tokens ids). Nothing is sorted or grouped across tasks, only tails are shuffled:
less than one window a task. Sequence ids are (round, task, number in the task), so a task that runs again gives the same.

Defined results: a null text is empty and has the end id alone; a null doc_id stays null; repeated rows are packed each;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import bisect
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain, repeat
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, rows_at_once, trimmed

SIZES = (4096, 2048, 1024, 512)
END = 2
#: Words remembered by a task at most, pieces of words too, and words of a text looked up at once.
CACHE = 500_000
#: Words of short texts looked up together.
TOGETHER = 20_000
#: Texts handed to a task at once.
BATCH = 1000
ID = attrgetter("id")
PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("step_id", pa.int64()), ("tail", pa.binary())])
SPARK_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, step_id long, tail binary"


#: Words of these characters need no normalising but lower case, and split as PIECE says.
PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")


def byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, others from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordIds:
    """Token ids of texts by a tokenizer that never joins across space, tab, LF or CR: each word is looked up once.

    A new word of plain letters is split into its pieces, and each new piece goes to the tokenizer's model; any other word
    goes to the tokenizer whole. If the tokenizer turns out to split a sample otherwise, all words go to it whole.
    """

    SAMPLE = "It's 42 Ob\u00e9rs, 'we'll'--x_y! #%$ \u00c9t\u00e9s r2d2 (a.b) don't ''s"

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        letters = byte_letters()
        self.table = [letters[b] for b in range(256)]
        self.plain = True
        self.pieces: dict[str, bytes] = {}
        self.clear()
        if self.encode(self.SAMPLE).tolist() != self.tokenizer.encode(self.SAMPLE, add_special_tokens=False).ids:
            self.plain = False
            self.clear()

    def clear(self) -> None:
        """Forget words; pieces stay, as they cost most."""
        self.known: dict[str, int] = {"": 0}
        self.flat, self.n_flat = np.zeros(1 << 16, np.uint32), 0
        self.begin, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def piece(self, text: str) -> bytes:
        """The ids of a piece as unsigned 32-bit numbers: a third of what a list of them takes."""
        if len(self.pieces) >= CACHE:
            self.pieces.clear()
        coded = text if text.isascii() else "".join(map(self.table.__getitem__, text.encode()))
        ids = self.pieces[text] = array("I", map(ID, self.tokenizer.model.tokenize(coded))).tobytes()
        return ids

    def learn(self, new: set[str]) -> None:
        find, split, piece, known = PLAIN.fullmatch, PIECE.findall, self.pieces.get, self.known
        parts: list[bytes] = []
        sizes: list[int] = []
        odd: list[str] = []
        at = first = len(known)
        for w in new:
            if self.plain and w.isalpha() and w.isascii():  # one piece
                x = w.lower()
                ids = piece(x) or self.piece(x)
                parts.append(ids)
                sizes.append(len(ids))
                known[w] = at
                at += 1
            elif self.plain and "<|" not in w and find(w):
                n = 0
                for x in split(w.lower()):
                    ids = piece(x) or self.piece(x)
                    parts.append(ids)
                    n += len(ids)
                sizes.append(n)
                known[w] = at
                at += 1
            else:
                odd.append(w)
        for w, e in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False) if odd else (), strict=True):
            parts.append(array("I", e.ids).tobytes())
            sizes.append(len(parts[-1]))
            known[w] = at
            at += 1
        flat = np.frombuffer(b"".join(parts), np.uint32)
        while at > len(self.size):
            self.begin, self.size = np.resize(self.begin, 2 * len(self.size)), np.resize(self.size, 2 * len(self.size))
        while self.n_flat + len(flat) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.size[first:at] = np.array(sizes, np.int64) // flat.itemsize
        self.begin[first:at] = self.n_flat + np.cumsum(self.size[first:at]) - self.size[first:at]
        self.flat[self.n_flat : self.n_flat + len(flat)] = flat
        self.n_flat += len(flat)

    def words(self, text: str) -> list[str]:
        if self.plain and "<|" not in text:  # words that differ in A-Z alone are learned once; special tokens are told by case
            text = text.encode().lower().decode()
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")

    def encode(self, text: str) -> np.ndarray:
        words = self.words(text)
        parts = [self.look_up(words[i : i + CACHE])[0] for i in range(0, len(words), CACHE)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def encode_each(self, texts: Iterator[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text, looked up for about TOGETHER words at once."""
        held: list[list[str]] = []

        def close() -> Iterator[np.ndarray]:
            ids, size = self.look_up(list(chain.from_iterable(held)))
            counts = np.fromiter(map(len, held), np.int64, len(held))  # one at least: an empty text is an empty word
            ends = np.cumsum(np.add.reduceat(size, np.cumsum(counts) - counts)).tolist()
            held.clear()
            for a, b in zip([0, *ends], ends, strict=False):
                yield ids[a:b]

        n = 0
        for text in texts:
            words = self.words(text or "")
            if held and n + len(words) > TOGETHER:
                yield from close()
                n = 0
            if len(words) > TOGETHER:
                yield self.encode(text)
            else:
                held.append(words)
                n += len(words)
        if held:
            yield from close()

    def look_up(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of at most CACHE words, and how many each has. If the table would outgrow CACHE it is emptied first, and all of these words are learned."""
        at = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            asked = [words[i] for i in missing.tolist()]
            new = set(asked)
            if len(self.known) + len(new) > CACHE:
                self.clear()
                asked, missing = words, np.arange(len(words))
                new = set(words).difference(self.known)
            self.learn(new)
            at[missing] = np.fromiter(map(self.known.__getitem__, asked), np.int64, len(asked))
        size = self.size[at]
        where = np.repeat(self.begin[at] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return self.flat[where], size


def _length(piece: tuple) -> int:
    return len(piece[2])


class Packer:
    """Pools pieces and yields packed sequences. A piece is (doc_id, start in its document, ids, doc_tokens)."""

    def __init__(self, sizes: tuple[int, ...], pool_tokens: int, first_id: int, step_size: int) -> None:
        self.sizes, self.most, self.pool_tokens = sizes, sizes[0], pool_tokens
        self.next_id, self.first_id, self.step_size = first_id, first_id, step_size
        self.pool: list[tuple] = []
        self.held = 0
        self.rows: list[tuple] = []

    def add(self, doc_id, start: int, ids: np.ndarray, doc_tokens: int) -> None:
        whole = len(ids) // self.most
        for i in range(whole):
            self.emit([(doc_id, start + i * self.most, ids[i * self.most : (i + 1) * self.most], doc_tokens)])
        if len(ids) > whole * self.most:
            self.pool.append((doc_id, start + whole * self.most, ids[whole * self.most :], doc_tokens))
            self.held += len(ids) - whole * self.most
        if self.held >= self.pool_tokens:
            self.pack()

    def emit(self, pieces: list[tuple]) -> None:
        at = 0
        for doc_id, start, ids, doc_tokens in pieces:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), doc_tokens, self.next_id, at, None, None))
            at += len(ids)
        self.next_id += 1

    def pack(self) -> None:
        """Pack the pool tier by tier, the longest first, into windows of the tier's size; what can't fill a window stays.

        A tier's windows take its pieces, and those that a longer tier left over, as long as the pool fills them; gaps are
        filled from shorter tiers. The shortest tier's windows take whatever is left.
        """
        tiers: dict[int, list[tuple]] = {size: [] for size in self.sizes}
        for piece in sorted(self.pool, key=_length):  # stable: the order of arrival breaks ties
            tiers[min(s for s in self.sizes if s >= len(piece[2]))].append(piece)
        left = self.held
        for size in self.sizes:
            while left >= size and (size == self.sizes[-1] or any(tiers[s] for s in self.sizes if s >= size)):
                self.emit(self.window(tiers, size))
                left -= size
        self.pool = [p for s in self.sizes for p in tiers[s]]
        self.held = left

    def window(self, tiers: dict[int, list[tuple]], gap: int) -> list[tuple]:
        """Pieces that fill a window: the longest that fits, again and again; when none fits whole, the shortest longer one is cut."""
        out: list[tuple] = []
        while gap:
            size = next((s for s in self.sizes if tiers[s] and len(tiers[s][0][2]) <= gap), None)
            if size is None:
                size = next(s for s in reversed(self.sizes) if tiers[s])
                doc_id, start, ids, n = tiers[size].pop(0)
                out.append((doc_id, start, ids[:gap], n))
                rest = (doc_id, start + gap, ids[gap:], n)
                home = tiers[min(s for s in self.sizes if s >= len(rest[2]))]
                bisect.insort_left(home, rest, key=_length)
                return out
            out.append(tiers[size].pop(bisect.bisect_right(tiers[size], gap, key=_length) - 1))
            gap -= len(out[-1][2])
        return out

    def close(self) -> None:
        """The last tail: smaller windows as far as they fill, then at most one padded sequence."""
        self.pack()
        pieces, left = self.pool, self.held
        while left:
            room = next((s for s in self.sizes if s <= left), left)
            window, left = [], left - room
            while room:
                doc_id, start, ids, n = pieces.pop(0)
                window.append((doc_id, start, ids[:room], n))
                if len(ids) > room:
                    pieces.insert(0, (doc_id, start + room, ids[room:], n))
                room -= len(window[-1][2])
            self.emit(window)
        self.pool, self.held = [], 0

    def tails(self) -> None:
        for doc_id, start, ids, n in self.pool:
            self.rows.append((doc_id, start, len(ids), 0, n, -1, 0, None, ids.tobytes()))
        self.pool, self.held = [], 0

    def flush(self) -> Iterator[pa.RecordBatch]:
        """Rows so far, their sequences dealt to step groups, there and back, in order of their length and piece count."""
        if not self.rows:
            return
        count: dict[int, tuple[int, int]] = {}
        for r in self.rows:
            length, pieces = count.get(r[5], (0, 0))
            count[r[5]] = (length + r[2], pieces + 1)
        count.pop(-1, None)
        groups = max(1, -(-len(count) // self.step_size))
        deal = [*range(groups), *reversed(range(groups))]
        step = {s: deal[i % len(deal)] for i, s in enumerate(sorted(count, key=lambda s: (count[s], s)))}
        base = min(count, default=0)
        columns = list(zip(*self.rows, strict=True))
        columns[7] = [None if s < 0 else base + step[s] for s in columns[5]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PIECES, strict=True)], schema=PIECES)
        self.rows = []


def pack_documents(docs: DataFrame, tokenizer: str, sizes: tuple[int, ...] = SIZES, pool_tokens: int = 1_000_000, step_size: int = 64, tails_together: int = 128) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and step_id."""

    def first_id(level: int) -> int:
        return (level << 56) | (TaskContext.get().partitionId() << 32)

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(tokenizer)
        packer = Packer(sizes, pool_tokens, first_id(0), step_size)
        for batch in batches:
            for doc_id, found in zip(batch.column(0).to_pylist(), words.encode_each(t.as_py() for t in batch.column(1)), strict=True):
                ids = np.append(found, np.uint32(END)).astype("<u4")
                packer.add(doc_id, 0, ids, len(ids))
                if len(packer.rows) >= 20_000:
                    yield from packer.flush()
        packer.pack()
        packer.tails()
        yield from packer.flush()

    def repack(level: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            packer = Packer(sizes, pool_tokens, first_id(level), step_size)
            rows = sorted((r for b in batches for r in b.select(["doc_id", "start", "doc_tokens", "tail"]).to_pylist()), key=lambda r: (r["doc_id"] is None, r["doc_id"], r["start"], r["tail"]))
            for r in rows:
                packer.add(r["doc_id"], r["start"], np.frombuffer(r["tail"], "<u4"), r["doc_tokens"])
            packer.pack()
            packer.close() if last else packer.tails()
            yield from packer.flush()

        return run

    with rows_at_once(docs.sparkSession, BATCH):
        done = materialize(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(tokenize), SPARK_SCHEMA))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "step_id"]
    packed = done.filter("sequence_id >= 0").select(columns)
    tails, level = done.filter("sequence_id < 0"), 1
    while True:
        tokens = tails.agg(F.sum("length")).first()[0] or 0
        tasks = max(1, tokens // (tails_together * sizes[0]))
        last = tasks == 1
        more = materialize(tails.repartition(tasks, F.xxhash64("doc_id", "start")).mapInArrow(trimmed(repack(level, last)), SPARK_SCHEMA))
        packed = packed.unionByName(more.filter("sequence_id >= 0").select(columns))
        if last:
            return packed
        tails, level = more.filter("sequence_id < 0"), level + 1
