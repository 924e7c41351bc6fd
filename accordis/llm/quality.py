"""Quality rules: counts of words, symbols and repetitions, and a log-likelihood ratio of hashed n-grams.

Words, pairs of words and character shapes of words (runs of upper case, lower case, digits and marks) are hashed into `buckets`
bins. Two multinomials over the bins, one of trusted text and one of the whole corpus, give each bin a weight, the logarithm of
the ratio of its smoothed shares, in whole steps of 1 / STEPS. A text's score is the sum of its n-grams' weights over their
number. Sums of whole numbers don't depend on their order, so a text's verdict is the same wherever and however often it is
judged; score >= threshold is compared in whole numbers too. Bins are a bounded table (4 bytes each), whatever the corpus.

The corpus multinomial counts every n-gram of every text. Trusted text is all rows labelled quality 1; half of them, by a hash of
doc_id, make the multinomial, the other half are scored, like all rows labelled 0, to set the threshold: the one with the least
sum of the two shares judged wrong, counted only on rows that the fixed rules pass, and no higher than loses `lose` of trusted
rows. Thresholds are whole steps, so counts of scores rounded down to steps settle it; there are as many at most as steps between
the lowest and the highest weight, whatever the number of rows.

Defined results: a null text is empty: no words, so the fixed rules fail it; a null doc_id is judged like any other and is never
labelled; repeated rows are judged each; of labels that differ for a doc_id the lowest counts, null ones are left out; without
trusted rows all weights are 0 and only the fixed rules decide, without rows labelled 0 the threshold is the one that loses `lose`;
an empty table gives an empty result; `kept` passes other columns through, `judged` doesn't read them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, trimmed
from .textnp import CHAIN, IS_SPACE, bytes_of, chunks, mix64, span_hashes, word_spans

# Characters that count as symbols.
IS_SYMBOL = np.zeros(256, dtype=bool)
IS_SYMBOL[list(b"#*$%&|<>")] = True
# A text fails with fewer words, or with a larger share of words in repeated windows.
LEAST_WORDS, REPEATED_PER_CENT, WINDOW = 50, 50, 3
#: Classes of bytes for shapes: lower case, upper case, digits, letters beyond ASCII, and marks as themselves.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[97:123], SHAPE[65:91], SHAPE[48:58], SHAPE[128:] = 97, 65, 48, 128
STEPS = 1 << 16


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 16
    smoothing: float = 1.0
    lose: float = 0.005


@dataclass
class Model:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 << 16, np.int32))
    #: In steps a gram; None: every text passes.
    threshold: int | None = None


class Texts:
    """Measures and n-grams of a run of texts, as arrays with an entry for each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.begins, self.ends, self.first = word_spans(data, offsets)
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1
        newlines = np.flatnonzero(data == 10)
        line = np.searchsorted(newlines, self.begins)
        text = np.repeat(np.arange(self.n), np.diff(self.first))
        head = np.ones(len(line), dtype=bool)  # the first word of its line
        head[1:] = (line[1:] != line[:-1]) | (text[1:] != text[:-1])
        before, after = np.concatenate(([-1], newlines)), np.concatenate((newlines, [len(data)]))
        spans = np.maximum(offsets[:-1][text[head]], before[line[head]] + 1), np.minimum(offsets[1:][text[head]], after[line[head]])
        self.words, lines = span_hashes(data, (self.begins, self.ends), spans)
        self.text = text
        self.n_words = np.diff(self.first)
        self.n_dup_lines = np.bincount(text[head], minlength=self.n) - np.bincount(text[head][np.unique(_within(lines, text[head]), return_index=True)[1]], minlength=self.n)
        count = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[offsets])
        self.word_chars = count(~IS_SPACE[data] & ((data & 0xC0) != 0x80))
        self.n_symbols = count(IS_SYMBOL[data])
        self.n_repeat_words = self._repeated()

    def _run(self, size: int) -> np.ndarray:
        """Where windows of `size` words begin."""
        last = np.repeat(self.first[1:], self.n_words)
        return np.flatnonzero(np.arange(len(self.words)) + size <= last)

    def _repeated(self) -> np.ndarray:
        at = self._run(WINDOW)
        if not len(at):
            return np.zeros(self.n, np.int64)
        window = mix64(mix64(self.words[at] * CHAIN + self.words[at + 1]) * CHAIN + self.words[at + 2])
        _, of, n = np.unique(_within(window, self.text[at]), return_inverse=True, return_counts=True)
        twice = at[n[of] > 1]
        inside = np.zeros(len(self.words) + 1, dtype=np.int64)
        for i in range(WINDOW):
            inside[twice + i] = 1
        return np.diff(np.concatenate(([0], np.cumsum(inside)))[self.first])

    @property
    def base_failed(self) -> np.ndarray:
        return (self.n_words < LEAST_WORDS) | (100 * self.n_repeat_words > REPEATED_PER_CENT * self.n_words)

    def grams(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, bin) of each word, shape and pair of neighbours."""
        two = self._run(2)
        shapes = span_hashes(self._shape(), (self.begins, self.ends))[0]
        hashes = np.concatenate((self.words, mix64(shapes + np.uint64(1)), mix64(self.words[two] * CHAIN + self.words[two + 1])))
        return np.concatenate((self.text, self.text, self.text[two])), (mix64(hashes) % np.uint64(buckets)).astype(np.int64)

    def _shape(self) -> np.ndarray:
        """Bytes by their classes."""
        return SHAPE[self.data]


def _within(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Hashes that are equal only within a text."""
    return mix64(hashes ^ mix64(text.astype(np.uint64) + np.uint64(1)))


def texts_of(column: pa.Array) -> Iterator[Texts]:
    data, offsets = bytes_of(column)
    for a, b in chunks(offsets):
        yield Texts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def counted(docs: DataFrame, settings: Settings) -> np.ndarray:
    """Counts of all n-grams of docs by bin. A task sums up its texts first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(settings.buckets, np.int64)
        for batch in batches:
            for texts in texts_of(batch.column(0)):
                total += np.bincount(texts.grams(settings.buckets)[1], minlength=settings.buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bin", "n"])

    table = docs.select("text").mapInArrow(trimmed(run), "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(settings.buckets, np.int64)
    out[table.column("bin").to_numpy()] = table.column("n").to_numpy()
    return out


def weights(trusted: np.ndarray, corpus: np.ndarray, smoothing: float) -> np.ndarray:
    """Log ratios of the smoothed shares, in steps."""
    if not trusted.sum():
        return np.zeros(len(trusted), np.int32)
    share = lambda n: (n + smoothing) / (n.sum() + smoothing * len(n))
    return np.rint(np.log(share(trusted) / share(corpus)) * STEPS).astype(np.int32)


def threshold(good: list[float], poor: list[float], lose: float) -> int | None:
    """The cut between scores, in steps: fewest wrong shares in sum, no more of the good than `lose`."""
    return cut(*np.unique(good, return_counts=True), *np.unique(poor, return_counts=True), lose)


def cut(g: np.ndarray, n_good: np.ndarray, p: np.ndarray, n_poor: np.ndarray, lose: float) -> int | None:
    """The same for distinct scores in order, and how many rows have each."""
    if not len(g):
        return None
    good, poor = np.cumsum(n_good), np.cumsum(n_poor)
    most = float(g[np.searchsorted(good, int(lose * good[-1]), "right")])
    if not len(p):
        return int(np.floor(most))
    tried = np.unique(np.concatenate((g[g <= most], p[p + 1 <= most] + 1, [most])))
    below = lambda values, n: np.concatenate(([0], n))[np.searchsorted(values, tried)]
    wrong = below(g, good) / good[-1] + (poor[-1] - below(p, poor)) / poor[-1]
    best = np.flatnonzero(wrong == wrong.min())
    return int(np.floor((tried[best[0]] + tried[best[-1]]) / 2))


def _sums(texts: Texts, model: Model) -> tuple[np.ndarray, np.ndarray]:
    text, bins = texts.grams(len(model.weights))
    total = np.bincount(text, model.weights[bins], texts.n)  # whole numbers below 2 ** 53, so doubles add them exactly
    return total.astype(np.int64), np.bincount(text, minlength=texts.n)


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Weights from all of docs and of trusted text; a threshold from labelled rows that made no weights."""
    known = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    rows = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(known.hint("merge"), "doc_id").withColumn("trains", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == 0))
    corpus = counted(docs, settings)
    model = Model(weights(counted(rows.filter("quality = 1 AND trains"), settings), corpus, settings.smoothing))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in texts_of(batch.column(1)):
                total, n = _sums(texts, model)
                passed = pa.array(~texts.base_failed)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, texts.n).filter(passed), pa.array(total // np.maximum(n, 1)).filter(passed)], names=["quality", "score"])
                at += texts.n

    rated = rows.filter("quality = 0 OR NOT trains").select("quality", "text").mapInArrow(trimmed(run), "quality int, score long")
    table = rated.groupBy("quality", "score").agg(F.count(F.lit(1)).alias("n")).toArrow().sort_by("score")
    release(rows)
    quality, score, n = (table.column(c).to_numpy() for c in ("quality", "score", "n"))
    model.threshold = cut(score[quality == 1], n[quality == 1], score[quality == 0], n[quality == 0], settings.lose)
    return model


def verdicts(texts: Texts, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(score, kept) of some texts."""
    total, n = _sums(texts, model)
    passed = np.ones(texts.n, dtype=bool) if model.threshold is None else total >= model.threshold * n
    return total / np.maximum(n, 1) / STEPS, ~texts.base_failed & passed


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def judged(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, the measures, base_failed, score and kept of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[tuple] = [(*(getattr(t, m) for m in MEASURES), *verdicts(t, model)) for t in texts_of(batch.column(1))]
            if parts:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.concatenate(c)) for c in zip(*parts, strict=True))], names=["doc_id", *MEASURES, "score", "kept"])

    fields = ", ".join(f"{m} long" for m in MEASURES[:-1])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(run), f"doc_id long, {fields}, base_failed boolean, score double, kept boolean")


def kept(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [verdicts(t, model)[1] for t in texts_of(batch.column(at))]
            if found:
                yield batch.filter(pa.array(np.concatenate(found)))

    return docs.mapInArrow(trimmed(run), docs.schema)
