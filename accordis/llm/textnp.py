"""Words and shingles of whole Arrow batches as numpy arrays: no Python object for a word.

A word is a run of bytes other than 0x20 and 0x09-0x0D; A-Z are lowered. Its 64-bit hash is a polynomial over its bytes
modulo 2**64, taken from running sums over the batch and then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C55)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C55, -1, 2**64))
CHAIN = np.uint64(0xD1342543DE82EF95)
#: Bytes of text handled at once, unless a single text is longer.
CHUNK = 1 << 20

LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i for i below n at least."""
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", BASE), ("down", BASE_INVERSE)):
            steps = np.full(max(n, CHUNK) + 1, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, and where each text begins (one entry more than texts). Null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or texts.buffers()[2] is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every word, and the first word of each text (one entry more than texts)."""
    space = IS_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    solid = ~space
    begins = np.flatnonzero(solid & (np.concatenate(([True], space[:-1])) | edge[:-1])) if len(data) else np.zeros(0, np.int64)
    ends = np.flatnonzero(solid & (np.concatenate((space[1:], [True])) | edge[1:])) + 1 if len(data) else np.zeros(0, np.int64)
    return begins, ends, np.searchsorted(begins, offsets)


def chunks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK bytes, one text at least."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, side="right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def span_hashes(data: np.ndarray, *spans: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """For each (begins, ends) the hashes of these spans of data."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return [mix64((sums[ends] - sums[begins]) * down[begins] + (ends - begins).astype(np.uint64)) for begins, ends in spans]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of the texts, and the first word of each text."""
    begins, ends, first = word_spans(data, offsets)
    return span_hashes(LOWERED[data], (begins, ends))[0], first


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles of each text, with repeats, and the first of each text. A text with fewer words, but some, has one."""
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    start = np.concatenate(([0], np.cumsum(count)))
    at = np.repeat(first[:-1], count) + np.arange(start[-1]) - np.repeat(start[:-1], count)
    length = np.repeat(np.minimum(n, k), count)
    out = length.astype(np.uint64)
    for i in range(k):
        inside = i < length
        if inside.all():
            out = mix64(out * CHAIN + words[at + i])
        else:
            out = np.where(inside, mix64(out * CHAIN + words[np.minimum(at + i, max(len(words) - 1, 0))]), out) if len(words) else out
    return out, start


def shingle_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text of a batch."""
    data, offsets = bytes_of(texts)
    for a, b in chunks(offsets):
        words, first = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        hashes, start = shingle_hashes(words, first, k)
        for i in range(b - a):
            yield a + i, np.unique(hashes[start[i] : start[i + 1]])
