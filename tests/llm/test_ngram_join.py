import re
from collections import Counter

import numpy as np

from accordis.llm import ngram_join
from accordis.llm.textnp import bytes_of, word_spans

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def components(raw):
    sets = [shingles(t) for _, t, _ in raw]
    parent = list(range(len(raw)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(raw)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    return sets, [find(i) for i in range(len(raw))]


def expected(raw):
    sets, root = components(raw)
    low = {}
    for i, r in enumerate(root):
        if raw[i][0] is not None:
            low[r] = min(low.get(r, raw[i][0]), raw[i][0])
    return Counter((raw[i][0], len(sets[i]), low.get(root[i])) for i in range(len(raw)))


def test_components_equal_brute_force(docs, raw):
    got = ngram_join.join(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == expected(raw)


def test_large_tiles_equal_brute_force(docs, raw):
    """All groups of near copies go through split tiles and both passes."""
    small = ngram_join.Settings(tile=4, block=3, frequent=1e-9)
    got = ngram_join.join(docs, small).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == expected(raw)


def test_keep_one_of_each_component(docs, raw):
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    _, root = components(raw)
    assert kept.count() == len(set(root))
    wanted = {i for i, _, c in expected(raw) if i == c}
    assert {r["doc_id"] for r in kept.collect()} - {None} == wanted - {None}


def test_nothing(empty):
    assert ngram_join.join(empty).count() == 0 and ngram_join.keep_one(empty).count() == 0


def test_bitmap_bounds_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = rng.integers(0, 2**63, 300, dtype=np.uint64), rng.integers(0, 2**63, 80, dtype=np.uint64)
        a, b = np.unique(np.concatenate((a, b[:40]))), np.unique(b)
        assert ngram_join.differing(ngram_join.bitmap(a), ngram_join.bitmap(b)) <= len(np.setxor1d(a, b))


def test_word_spans_equal_a_regular_expression():
    import pyarrow as pa

    texts = ["a b", "", None, " x\x0b\x0cy ", "é ü z", "last"]
    data, offsets = bytes_of(pa.array(texts))
    begins, ends, first = word_spans(data, offsets)
    got = [[data[b:e].tobytes().decode() for b, e in zip(begins[first[i] : first[i + 1]], ends[first[i] : first[i + 1]], strict=True)] for i in range(len(texts))]
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
