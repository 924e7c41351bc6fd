"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text.

A window of `window_words` words is compressed once with the dictionary of ordinary text and once with that of toxic text
(which also holds the ordinary one, so both know common words alike). The bytes that the toxic dictionary saves are the
window's distance. A text is judged by its windows: the largest saving, the runners-up, how many savings pass a calibrated
threshold, and the mean. A logistic fit on labelled rows that made no dictionary turns these into a score from 0 to 1.

Training reads a bounded sample of labelled rows: at most `per_class` rows of each class and `sample_bytes` bytes in all,
lowest hash of doc_id first; of a text longer than `sample_chars` a stretch of that length, at a place that follows from doc_id.
Half of them make the dictionaries, a quarter the threshold and the fit, and
the last quarter chooses the size of the toxic dictionary. That of ordinary text is made by zstandard's trainer. Its trainer
fills a dictionary of toxic text with ordinary syllables, which are as frequent there, so toxic rows are told from others by
far less (figures in the README); the toxic dictionary therefore holds the words of toxic rows with a character 5-gram, or a
neighbour, that stands out: the log-likelihood of its count against what ordinary rows suggest is at least `contrast`.
Scoring reads whole texts.

Defined results: null and empty texts have no windows and get the fit's score for none; a null doc_id is never held out
and never labelled; repeated rows are scored each; other columns pass through `score`; labels that are null are left out, and where rows
of a doc_id differ the largest counts; without labelled rows of both classes every score is 0.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, release, trimmed
from .textnp import IS_SPACE, LOWERED, bytes_of, chunks, word_spans

FOLDED = LOWERED.copy()
FOLDED[IS_SPACE] = 32
GRAM = 5


@dataclass(frozen=True)
class Settings:
    window_words: int = 16
    per_class: int = 3000
    sample_bytes: int = 64_000_000
    sample_chars: int = 250_000
    contrast: float = 14.0
    ordinary_bytes: int = 4096
    #: Sizes of the toxic part that are tried; the one that calibrates best stays.
    toxic_bytes: tuple[int, ...] = (128, 256, 512, 768, 1024, 1536, 3072, 6144)
    level: int = 3


@dataclass
class Model:
    ordinary: bytes = b""
    toxic: bytes = b""
    threshold: float = 0.0
    weights: list[float] = field(default_factory=list)
    settings: Settings = Settings()


def held_out(doc_id: Column, of: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves that remainder. A null id is not held out."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % of == remainder, F.lit(False))


def windows(data: bytes, begins: np.ndarray, ends: np.ndarray, size: int) -> list[bytes]:
    """Runs of `size` words of a folded text, with a space before and after."""
    starts = begins[::size]
    stops = ends[np.minimum(np.arange(len(starts)) * size + size - 1, len(ends) - 1)] if len(ends) else ends
    return [b" " + data[a:b] + b" " for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]


def _compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters(compression_level=level, min_match=3, strategy=zstandard.STRATEGY_GREEDY, window_log=14, hash_log=12, chain_log=12, search_log=3, write_content_size=0, write_dict_id=0, write_checksum=0)
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=params)


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model = model
        self.plain = _compressor(model.ordinary, model.settings.level).compress
        self.marked = _compressor(model.toxic + model.ordinary, model.settings.level).compress

    def savings(self, text: list[bytes]) -> np.ndarray:
        plain, marked = self.plain, self.marked
        return np.array([len(plain(w)) - len(marked(w)) for w in text], dtype=np.float64)

    def features(self, savings: np.ndarray) -> list[float]:
        if not len(savings):
            return [0.0] * 6
        top = np.sort(savings)[::-1]
        over = float((savings >= self.model.threshold).sum())
        return [top[0] / 8, float(top[1]) / 8 if len(top) > 1 else 0.0, float(top[2]) / 8 if len(top) > 2 else 0.0, math.log1p(over), over / len(savings), float(savings.mean())]

    def probability(self, features: list[float]) -> float:
        z = self.model.weights[-1] + sum(a * b for a, b in zip(features, self.model.weights, strict=False))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def score_batch(self, texts: pa.Array) -> list[float]:
        data, offsets = bytes_of(texts)
        out = []
        for a, b in chunks(offsets):
            part, at = FOLDED[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
            begins, ends, first = word_spans(part, at)
            whole = part.tobytes()
            for i in range(b - a):
                s = slice(first[i], first[i + 1])
                out.append(self.probability(self.features(self.savings(windows(whole, begins[s], ends[s], self.model.settings.window_words)))))
        return out


def _fold(text: str) -> list[bytes]:
    return FOLDED[np.frombuffer(text.encode(), np.uint8)].tobytes().split()


def _joined(words: list[bytes], size: int) -> list[bytes]:
    return [b" " + b" ".join(words[i : i + size]) + b" " for i in range(0, len(words), size)]


def _grams(word: bytes) -> set[bytes]:
    """Character 5-grams of a word between spaces; a shorter one is its own."""
    padded = b" " + word + b" "
    return {padded[i : i + GRAM] for i in range(max(1, len(padded) - GRAM + 1))}


def _neighbours(words: list[bytes]) -> set[tuple[bytes, bytes]]:
    return set(zip(words, words[1:], strict=False))


def telling(bad: list[list[bytes]], good: list[list[bytes]], parts: Callable[[list[bytes]], set], contrast: float) -> set:
    """Parts of texts that stand out in bad ones."""
    in_bad = Counter(x for words in bad for x in parts(words))
    in_good = Counter(x for words in good for x in parts(words) if x in in_bad)
    ratio = len(bad) / len(good)
    return {x for x, n in in_bad.items() if n > (e := ratio * (in_good[x] + 0.5)) and n * math.log(n / e) - (n - e) >= contrast}


def train(toxic: list[str], ordinary: list[str], priors: tuple[float, float], settings: Settings) -> Model:
    """The model of two bounded lists of texts. priors: rows that each class stands for."""
    if len(toxic) < 4 or len(ordinary) < 4:
        return Model(settings=settings)
    bad, good = [_fold(t) for t in toxic[::2]], [_fold(t) for t in ordinary[::2]]
    grams = telling(bad, good, lambda words: set().union(*map(_grams, set(words))), settings.contrast)
    pairs = telling(bad, good, _neighbours, settings.contrast)
    marked = Counter(w for words in bad for w in words if not grams.isdisjoint(_grams(w)))
    kept = [b" " + w + b" " for w, _ in sorted(marked.items(), key=lambda x: (x[1], x[0]))]
    phrases = Counter(p for words in bad for p in _neighbours(words) if p in pairs and marked.keys().isdisjoint(p))
    kept = [b" " + b" ".join(p) + b" " for p, _ in sorted(phrases.items(), key=lambda x: (x[1], x[0]))] + kept
    samples = [w for words in good for w in _joined(words, 8) if len(w) >= 8]
    try:
        common = zstandard.train_dictionary(settings.ordinary_bytes + 400, samples[:100_000], k=16, d=6).as_bytes()
    except zstandard.ZstdError:  # too little text for the trainer: the text itself serves
        common = b"".join(samples)
    marks, ordinary_text = b"".join(kept), common[-settings.ordinary_bytes :]

    def rows(part: int) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
        t, o = toxic[part::4] or toxic[1::2], ordinary[part::4] or ordinary[1::2]
        y = np.array([1.0] * len(t) + [0.0] * len(o))
        stands_for = np.where(y == 1, priors[0] / len(t), priors[1] / len(o))
        return [_joined(_fold(x), settings.window_words) for x in (*t, *o)], y, stands_for / stands_for.mean()

    fitted, chosen = rows(1), rows(3)
    sizes = sorted({min(size, max(1, len(marks))) for size in settings.toxic_bytes})
    tried = [calibrated(Model(ordinary_text, marks[-size:], settings=settings), *fitted) for size in sizes]
    return min(tried, key=lambda m: loss(m, *chosen))


def calibrated(model: Model, texts: list[list[bytes]], y: np.ndarray, stands_for: np.ndarray) -> Model:
    """A model with its threshold and weights fitted to texts."""
    scorer = Scorer(model)
    saved = [scorer.savings(t) for t in texts]
    plain = np.concatenate([np.zeros(1), *(s for s, bad in zip(saved, y, strict=True) if not bad)])
    model.threshold = float(max(2.0, np.quantile(plain, 0.999)))
    model.weights = fit_logistic(np.array([scorer.features(s) + [1.0] for s in saved]), y, stands_for)
    return model


def loss(model: Model, texts: list[list[bytes]], y: np.ndarray, stands_for: np.ndarray) -> float:
    """The weighted log loss of a model on texts."""
    scorer = Scorer(model)
    p = np.clip([scorer.probability(scorer.features(scorer.savings(t))) for t in texts], 1e-9, 1 - 1e-9)
    return float(-(stands_for * (y * np.log(p) + (1 - y) * np.log(1 - p))).mean())


def fit_logistic(x: np.ndarray, y: np.ndarray, row_weights: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> list[float]:
    """Newton's method with a small ridge; the last column is the intercept."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (row_weights * (p - y)) + ridge * w
        hessian = (x * (row_weights * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Train on rows that aren't held out. Only the bounded sample comes to the driver."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 4, 2))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {int(r["toxic"]): r["count"] for r in known.filter("toxic in (0, 1)").groupBy("toxic").count().collect()}
    order = F.xxhash64("doc_id"), F.col("doc_id")
    picked = known.filter("toxic = 1").orderBy(*order).limit(settings.per_class).unionAll(known.filter("toxic = 0").orderBy(*order).limit(settings.per_class))
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic")).filter("text IS NOT NULL")
    spare = F.greatest(F.length("text") - settings.sample_chars, F.lit(0))
    stretch = F.when(spare > 0, F.substring(F.col("text"), F.pmod(F.xxhash64("doc_id", F.lit(1)), (spare + 1).cast("long")).cast("int") + 1, F.lit(settings.sample_chars))).otherwise(F.col("text"))
    texts = materialize(texts.withColumn("text", stretch))  # two times per_class rows at most
    upto = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sizes = texts.select("doc_id", F.sum(F.octet_length("text")).over(upto).alias("_upto")).filter(F.col("_upto") <= settings.sample_bytes)
    rows = sorted(texts.join(F.broadcast(sizes), "doc_id").collect(), key=lambda r: r["doc_id"])
    release(texts)
    return train([r["text"] for r in rows if r["toxic"] == 1], [r["text"] for r in rows if r["toxic"] == 0], (counts.get(1, 0), counts.get(0, 0)), settings)


def score(docs: DataFrame, model: Model, column: str = "toxicity_score") -> DataFrame:
    """docs with the score of each whole text in a new last column."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model) if model.weights else None
        for batch in batches:
            scores = scorer.score_batch(batch.column(at)) if scorer else [0.0] * batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, column])

    return docs.mapInArrow(trimmed(run), T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))
