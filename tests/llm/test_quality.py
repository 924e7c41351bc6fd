"""Quality rules against plain Python: every measure, the weights, the threshold's effect and the verdicts."""

import math
import os
import random
import re
from collections import Counter

import numpy as np
import pytest

from accordis.llm import quality
from accordis.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def measures(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), failed


def grams(text):
    words = WORD.findall(text or "")
    kind = lambda c: "a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else "0" if "0" <= c <= "9" else c if ord(c) < 128 else "é" * len(c.encode())
    return [("w", w) for w in words] + [("s", "".join(map(kind, w))) for w in words] + [("p", *p) for p in zip(words, words[1:], strict=False)]


def made_rows():
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    good = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    junk = lambda n: " | ".join("".join(rng.choice("abcdefg") for _ in range(6)) for _ in range(n))
    out = [(i, good(rng.randint(55, 120)) if i % 4 else junk(rng.randint(40, 60))) for i in range(240)]
    out += [(300, "A line\nof text\nA line\n\n \nA line\r\nof text"), (301, None), (302, ""), (303, " \n\t"), (304, "x y z " * 40), (305, good(20_000)), (306, "one two three one two three four"), (None, good(60)), (307, "#a *b $c %d &e |f <g >h " * 3), (308, "é\n" * 60)]
    out += [(309, good(80))] * 3
    return [(*r, "score", 0.5, 3) for r in out]


SCHEMA = "doc_id long, text string, kept string, score double, n_words int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(made_rows(), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, int(i % 4 > 0)) for i in range(200)] + [(7, None), (None, 1), (9, 5)]
    return spark.createDataFrame(rows, "doc_id long, quality int")


def test_measures_and_verdicts(docs, labels):
    model = quality.fit(docs, labels)
    got = {}
    for r in quality.judged(docs, model).collect():
        got.setdefault(r.doc_id, []).append(r)
    for doc_id, text, *_ in made_rows():
        r = got[doc_id][0]
        assert tuple(r[m] for m in quality.MEASURES) == measures(text), doc_id
        assert r.kept == (not r.base_failed and (doc_id is None or doc_id >= 240 or doc_id % 4 > 0)), doc_id
    assert len(got[309]) == 3 and len({tuple(r) for r in got[309]}) == 1
    assert sorted(r.doc_id for r in quality.kept(docs, model).collect() if r.doc_id is not None) == sorted(i for i, rows in got.items() for r in rows if r.kept and i is not None)
    assert quality.kept(docs, model).schema == docs.schema


def test_weights_are_smoothed_log_ratios(spark, docs):
    """With far more bins than n-grams few of these share one: nearly every score must be what exact counts give."""
    settings = quality.Settings(buckets=1 << 22)
    docs, rows = docs.filter("doc_id < 150"), [r for r in made_rows() if r[0] is not None and r[0] < 150]
    trusted = docs.filter("doc_id % 4 = 1 AND doc_id < 100")
    model = quality.Model(quality.weights(quality.counted(trusted, settings), quality.counted(docs, settings), 1.0), None)
    t, c = Counter(), Counter()
    for doc_id, text, *_ in rows:
        c.update(grams(text))
        if doc_id % 4 == 1 and doc_id < 100:
            t.update(grams(text))
    nt, nc = t.total() + settings.buckets, c.total() + settings.buckets
    got = {r.doc_id: r.score for r in quality.judged(docs, model).collect()}
    apart = []
    for doc_id, text, *_ in rows:
        if g := grams(text):
            want = sum(math.log((t[x] + 1) / nt) - math.log((c[x] + 1) / nc) for x in g) / len(g)
            apart.append(abs(got[doc_id] - want))
        else:
            assert got[doc_id] == 0
    assert np.quantile(apart, 0.6) < 2e-5 and max(apart) < 0.05


def test_threshold():
    assert quality.threshold([], [1.0], 0.1) is None
    assert quality.threshold([5.0, 6.0, 7.0], [], 0.0) == 5
    assert -90 < quality.threshold([-10.0, 0.0, 3.0], [-100.0, -80.0, -90.0], 0.0) < -10
    mixed = quality.threshold(list(np.arange(100.0)), list(np.arange(-50.0, 50.0)), 0.05)
    assert mixed <= 5  # no more than a twentieth of the good is lost


def test_all_labelled_rows_count(spark):
    """More rows of a class than the sample of 8,192 that the fit once took."""
    rows = spark.range(20_000).selectExpr("id AS doc_id", "concat_ws(' ', concat('w', id % 97), concat('v', id % 89), 'x') AS text")
    known = rows.selectExpr("doc_id", "1 AS quality")
    settings = quality.Settings()
    trains = rows.filter("pmod(xxhash64(doc_id, 1), 2) = 0")
    want = quality.weights(quality.counted(trains, settings), quality.counted(rows, settings), settings.smoothing)
    assert np.array_equal(quality.fit(rows, known, settings).weights, want)


def test_threshold_of_counts():
    rng = np.random.default_rng(3)
    for _ in range(20):
        good, poor = rng.integers(-20, 40, 80), rng.integers(-50, 10, 60)
        tried = np.arange(-60, 60)
        g, p = (np.unique(x, return_counts=True) for x in (good, poor))
        got, most = quality.cut(*g, *p, 0.05), np.sort(good)[4]
        wrong = lambda t: (good < t).mean() + (poor >= t).mean()
        assert got <= most and wrong(got) <= min(map(wrong, tried[tried <= most])) + 0.05
        assert got == quality.threshold(list(good), list(poor), 0.05)


def test_unlabelled_and_empty(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(docs, none)
    assert all(r.kept != r.base_failed for r in quality.judged(docs, model).collect())
    empty = spark.createDataFrame([], SCHEMA)
    assert quality.judged(empty, quality.fit(empty, none)).collect() == [] and quality.kept(empty, model).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_labelled_tables(spark):
    """Rows labelled 1 that the fixed rules pass stay, rows labelled 0 go, whether or not they took part in the fit."""
    docs, labels = table(spark, SF.replace("0.001", "0.01"), "documents"), table(spark, SF.replace("0.001", "0.01"), "labels")
    half = labels.filter("doc_id % 2 = 0")
    rows = quality.judged(docs, quality.fit(docs, half)).join(labels.filter("doc_id % 2 = 1"), "doc_id").filter("NOT base_failed").collect()
    good, poor = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert len(good) > 100 and len(poor) > 5 and sum(good) >= 0.98 * len(good) and sum(poor) <= 0.1 * len(poor)
