import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from accordis.llm import lm_scoring, packing, toxicity


LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

tokenizers = pytest.importorskip("tokenizers")
vocabulary = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def test_packed_pieces_make_up_every_document(docs, raw):
    t = tokenizers.Tokenizer.from_file(vocabulary)
    ids = Counter()
    for i, text, _ in raw:
        ids[(i, tuple([*t.encode(text or "", add_special_tokens=False).ids, 2]))] += 1
    got = packing.pack_documents(docs, vocabulary).collect()
    lengths = Counter((r["doc_id"], r["doc_tokens"]) for r in got if r["start"] == 0)
    assert lengths == Counter((i, len(x)) for (i, x), n in ids.items() for _ in range(n))
    whole = {i: np.array(x, "<u4") for (i, x), n in ids.items() if i is not None and n == 1}
    for r in got:
        if r["doc_id"] in whole:
            assert zlib.crc32(whole[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 4096
    assert sum(sum(n for _, n in p) & (sum(n for _, n in p) - 1) != 0 for p in sequences.values()) <= 1


def test_packing_nothing(empty):
    assert packing.pack_documents(empty, vocabulary).count() == 0


def test_word_table_gives_the_tokenizers_ids():
    t, table = tokenizers.Tokenizer.from_file(vocabulary), packing.WordIds(vocabulary)
    rng = random.Random(3)
    texts = ["", " \t", "It's 42, ÉTÉ's ﬁ İx a\x1cb c　d ½² <|endoftext|>x", "".join(chr(rng.randint(32, 700)) for _ in range(3000))]
    for text in texts:
        assert table.encode(text).tolist() == t.encode(text, add_special_tokens=False).ids


def test_word_table_takes_texts_of_more_words_than_it_remembers(monkeypatch):
    t = tokenizers.Tokenizer.from_file(vocabulary)
    monkeypatch.setattr(packing, "CACHE", 50)
    table = packing.WordIds(vocabulary)
    texts = ["a few words", " ".join(f"w{i}x\u00e9" for i in range(1000)), "a few w3x\u00e9 words", " ".join(f"v{i}" for i in range(50)), "\u4e2d w\u20ac " * 120]
    for text in texts:
        assert table.encode(text).tolist() == t.encode(text, add_special_tokens=False).ids
        assert len(table.known) <= 51


def labelled(spark):
    rng = random.Random(9)
    plain = ["".join(rng.choice("aeiounrst") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    bad = ["zorgblat", "vexxikon", "qwumpfer"]
    rows, labels = [], []
    for i in range(1200):
        w = [rng.choice(plain) for _ in range(rng.randint(20, 120))]
        if i % 8 == 0:
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 8 == 0)))
    extra = [(5000, None), (5001, ""), (None, "zorgblat"), (5002, "\n")]
    return spark.createDataFrame(rows + extra, "doc_id long, text string"), spark.createDataFrame([*labels, (5001, None), (None, 1)], "doc_id long, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model, "p").join(labels, "doc_id").filter(toxicity.held_out(F.col("doc_id"), 4, 2) & F.col("toxic").isNotNull()).collect()
    right = sum((r["p"] >= 0.3) == (r["toxic"] == 1) for r in got)
    assert len(got) > 200 and right / len(got) > 0.97
    every = toxicity.score(docs, model, "p").collect()
    assert len(every) == 1204 and all(0 <= r["p"] <= 1 for r in every)


def test_toxicity_reads_no_held_out_label(spark):
    docs, labels = labelled(spark)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id"), 4, 2), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, labels) == toxicity.fit(docs, flipped)


def test_toxicity_keeps_its_sample_beside_a_giant_text(spark):
    """A labelled text that is larger than the whole sample leaves room for the others."""
    docs, labels = labelled(spark)
    settings = toxicity.Settings(sample_bytes=300_000, sample_chars=2_000)
    giants = [(i, "plain words only " * 40_000) for i in range(8000, 8012)]  # some come first in any order
    more, known = docs.unionByName(spark.createDataFrame(giants, docs.schema)), labels.unionByName(spark.createDataFrame([(i, 0) for i, _ in giants], labels.schema))
    model = toxicity.fit(more, known, settings)
    assert model.weights
    got = toxicity.score(docs, model, "p").join(labels, "doc_id").filter("toxic IS NOT NULL").collect()
    assert sum((r["p"] >= 0.3) == (r["toxic"] == 1) for r in got) / len(got) > 0.95


def test_toxicity_scores_by_a_plain_twin(spark, docs):
    """Windows, savings, features and score of every text, one at a time."""
    train, labels = labelled(spark)
    model = toxicity.fit(train, labels)
    fold = str.maketrans({**{chr(i): chr(i + 32) for i in range(65, 91)}, **{c: " " for c in "\t\n\v\f\r"}})
    params = zstandard.ZstdCompressionParameters(compression_level=model.settings.level, min_match=3, strategy=zstandard.STRATEGY_GREEDY, window_log=14, hash_log=12, chain_log=12, search_log=3, write_content_size=0, write_dict_id=0, write_checksum=0)
    length = lambda window, known: len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(known, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params).compress(window))

    def twin(text):
        folded, words = (text or "").translate(fold), list(re.finditer(r"[^ ]+", (text or "").translate(fold)))
        windows = [f" {folded[words[i].start() : words[min(i + 15, len(words) - 1)].end()]} ".encode() for i in range(0, len(words), 16)]
        saved = sorted((length(w, model.ordinary) - length(w, model.toxic + model.ordinary) for w in windows), reverse=True)
        over = sum(s >= model.threshold for s in saved)
        at = lambda i: saved[i] / 8 if len(saved) > i else 0.0
        features = [at(0), at(1), at(2), math.log1p(over), over / len(saved), sum(saved) / len(saved)] if saved else [0.0] * 6
        z = model.weights[6] + sum(a * b for a, b in zip(features, model.weights, strict=False))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    rows = [(r["text"], r["toxicity_score"]) for r in toxicity.score(docs.drop("toxicity_score").filter("doc_id <> 214 OR doc_id IS NULL").unionByName(train.limit(40), allowMissingColumns=True), model).collect()]
    assert len(rows) > 150 and max(abs(twin(t) - p) for t, p in rows) < 1e-12


def test_toxicity_where_the_column_is_taken(spark):
    docs, labels = labelled(spark)
    held = docs.withColumn("toxicity_score", F.lit("mine"))
    got = toxicity.score(held, toxicity.fit(docs, labels), "another").first()
    assert got["toxicity_score"] == "mine" and 0 <= got["another"] <= 1


def test_toxicity_without_labels(docs, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["p"] for r in toxicity.score(docs, toxicity.fit(docs, none), "p").collect()} == {0.0}


class Brute:
    """The suffix tree by plain dictionaries. The divergence test knows a parent's probability to the operator's steps, nothing else is rounded."""

    def __init__(self, raw, s):
        self.s, self.tokens = s, [[*words(t), None] for _, t, _ in raw]
        self.train = [i is None or zlib.crc32(str(i).encode()) % s.folds != s.held_out for i, _, _ in raw]
        self.c, self.after, self.kept = Counter(), defaultdict(Counter), {}
        held = [t for t, use in zip(self.tokens, self.train, strict=True) if use]
        self.c.update(w for t in held for w in t)
        at, self.depth = [(t, k) for t in held for k in range(1, len(t))], 0
        while at and self.depth != s.depth:  # contexts of one more word, where the shorter one could tell more
            self.depth += 1
            contexts = [tuple(reversed(t[k - self.depth : k])) for t, k in at]
            for (t, k), context in zip(at, contexts, strict=True):
                self.after[context][t[k]] += 1
            at = [(t, k) for (t, k), context in zip(at, contexts, strict=True) if k > self.depth and len(self.after[context]) > 1 and max(self.after[context].values()) > 1]
        self.n = sum(self.c.values())

    def root(self, w):
        return math.log10((self.c[w] + 1) / (self.n + len(self.c) + 1))

    def retained(self, context):
        if context not in self.kept:
            after, gain = self.after[context], 0.0
            for w, k in after.items():
                steps = lm_scoring.PARENT_STEPS
                parent = 2.0 ** (np.clip(np.rint(self.value(context[:-1], w) * (-steps / math.log10(2))), 0, 255) / -steps)
                of, left = sum(after.values()) - 1, len(+after) - (k == 1)
                gain += k * math.log(max((max(k - 1 - self.s.discount, 0) + self.s.discount * left * parent) / max(of, 1), 1e-300) / parent)
            self.kept[context] = gain >= self.s.gain
        return self.kept[context]

    def mixed(self, context, w, parent):
        after = self.after[context]
        of = sum(after.values())
        return max(after[w] - self.s.discount, 0) / of + self.s.discount * len(+after) / of * parent

    def value(self, past, w):
        """log10 of the probability after a history, newest word first."""
        out = self.root(w)
        for d in range(1, len(past) + 1):
            context = past[:d]
            after = self.after.get(context)
            if after is None or sum(after.values()) < self.s.least:
                break
            if self.retained(context):
                out = math.log10(self.mixed(context, w, 10.0**out))
            if len(+after) < 2 or max(after.values()) < 2:
                break
        return out

    def rows(self, raw):
        past = lambda t, k: tuple(reversed(t[max(0, k - self.depth) : k]))
        return [(i, not use, len(t), sum(self.c[w] > 0 for w in t), self.n, sum(map(self.root, t)), sum(self.value(past(t, k), t[k]) for k in range(len(t)))) for (i, _, _), t, use in zip(raw, self.tokens, self.train, strict=True)]


def repeated(spark, raw, tails=False):
    """Rows with passages that some of them share, and one document twice."""
    rng = random.Random(11)
    passage = " ".join(f"w{rng.randint(0, 30)}" for _ in range(80))
    # two endings after the same nine words, each more than once: only the longest contexts tell which comes
    tails = [(1500 + k, f"{'first' if k % 2 else 'second'} " + "a b c d e f g h i " + ("left" if k % 2 else "right"), "s") for k in range(24)] if tails else []
    more = tails + [(1000 + k, " ".join(f"w{rng.randint(0, 30)}" for _ in range(60)) + (" " + passage if k % 3 == 0 else ""), "s") for k in range(40)]
    rows = [*raw, *more, (2001, "one text that is here two times and says what no other does", "s"), (2000, "one text that is here two times and says what no other does", "s")]
    return rows, spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(3)


def test_language_model_equals_brute_force(spark, raw):
    """All rows, long texts too; one chunk for each batch of texts and small ranges."""
    rows, df = repeated(spark, raw, tails=True)
    s = lm_scoring.Settings(depth=None, chunk_tokens=2000)
    brute = Brute(rows, s)
    want = brute.rows(rows)
    got = lm_scoring.score(df, s).collect()
    key = lambda r: tuple("~" if x is None else f"{x:012d}" if isinstance(x, int) else f"{x:.3f}" for x in r[:5])
    assert sorted(map(key, got)) == sorted(map(key, want))
    by = {(r[0], r[2], r[3]): r for r in want}
    for r in got:
        w = by[(r[0], r[2], r[3])]
        assert abs(r[5] - w[5]) < 1e-6 and abs(r[6] - w[6]) < 1e-9 * r[2]
    assert max(len(c) for c, k in brute.kept.items() if k) >= 8  # no limit but what diverges


def test_language_model_sums_to_one(spark, raw):
    rows, _ = repeated(spark, raw[:100])
    brute = Brute(rows, lm_scoring.Settings())
    brute.rows(rows)
    for context in [c for c, k in brute.kept.items() if k][:20]:
        assert abs(sum(10 ** brute.value(context, w) for w in [*brute.c, "never seen"]) - 1) < 0.01


def test_language_model_knows_repeated_texts(spark, raw):
    """A text that training rows hold twice scores far above its words, another doesn't."""
    rows, df = repeated(spark, raw)
    got = {r["doc_id"]: r for r in lm_scoring.score(df).filter("doc_id >= 2000").collect()}
    assert all(r["score"] - r["base_score"] > 10 for r in got.values())


def test_language_model_on_nothing(empty):
    assert lm_scoring.score(empty).count() == 0


def windows(packer):
    """Length and first piece's length of each sequence."""
    length, first = Counter(), {}
    for r in packer.rows:
        length[r[5]] += r[2]
        first.setdefault(r[5], r[2])
    return [(n, first[s]) for s, n in length.items()]


@pytest.mark.parametrize("size", packing.SIZES)
def test_a_tier_packs_windows_of_its_own_size(size):
    rng = random.Random(3)
    packer = packing.Packer(packing.SIZES, 10**9, 0, 8)
    for i in range(200):
        packer.add(i, 0, np.arange(rng.randint(size // 2 + 1, size - 1), dtype=np.uint32), 1)
    packer.pack()
    assert Counter(n for n, _ in windows(packer))[size] >= 0.95 * len(windows(packer)) and packer.held < packing.SIZES[-1]


def test_long_windows_take_gaps_from_shorter_tiers():
    """All windows are full; those of a longer tier begin with a piece that no shorter tier holds."""
    rng = random.Random(3)
    packer = packing.Packer(packing.SIZES, 10**9, 0, 8)
    for i in range(400):
        packer.add(i, 0, np.arange(rng.choice([rng.randint(1, 500), rng.randint(500, 9000)]), dtype=np.uint32), 1)
    packer.pack()
    found = windows(packer)
    assert {n for n, _ in found} <= set(packing.SIZES) and {512, 2048, 4096} <= {n for n, _ in found}
    assert all(first > size // 2 for size, first in found if size > packing.SIZES[-1])


def test_toxicity_of_long_texts_and_empty_tables(spark):
    """A toxic word deep in a very long text counts in training and scoring; columns with clashing names pass through; no rows give none."""
    docs, labels = labelled(spark)
    rng = random.Random(12)
    plain = ["".join(rng.choice("aeiounrst") for _ in range(5)) for _ in range(300)]
    long = [(7000 + i, " ".join(rng.choice(plain) for _ in range(40_000)) + (" zorgblat vexxikon zorgblat" if i else "")) for i in range(2)]
    every = docs.unionByName(spark.createDataFrame(long, "doc_id long, text string")).withColumns({"score": F.lit("s"), "toxic": F.lit(9)})
    known = labels.unionByName(spark.createDataFrame([(7000, 0), (7001, 1)], "doc_id long, toxic int"))
    model = toxicity.fit(every, known)
    got = {r["doc_id"]: r for r in toxicity.score(every, model, "p").filter("doc_id >= 7000").collect()}
    assert got[7001]["p"] > got[7000]["p"] and got[7000]["score"] == "s" and got[7000]["toxic"] == 9
    none = every.limit(0)
    assert toxicity.score(none, toxicity.fit(none, labels.limit(0)), "p").count() == 0
    assert toxicity.score(none, model, "p").count() == 0


def test_toxicity_learns_short_words_and_phrases():
    rng = random.Random(13)
    plain = ["".join(rng.choice("aeiounrst") for _ in range(5)) for _ in range(200)] + ["get", "lost"]
    text = lambda *extra: " ".join([rng.choice(plain) for _ in range(30)] + list(extra))
    toxic = [text("zq", "get lost") for _ in range(120)]
    model = toxicity.train(toxic, [text("get", "some", "lost") for _ in range(400)], (120, 400), toxicity.Settings())
    assert b" zq " in model.toxic and b" get lost " in model.toxic


def test_word_table_takes_texts_together_and_learns_pieces_once(monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 40)
    monkeypatch.setattr(packing, "TOGETHER", 12)
    t, table = tokenizers.Tokenizer.from_file(vocabulary), packing.WordIds(vocabulary)
    texts = ["One two", None, "", "ONE Two\tthree", "Été été İx KK", "<|endoftext|> <|ENDOFTEXT|> a<|endoftext|>B", *(" ".join(f"w{chr(97 + i % 26)}{j}x," for j in range(i)) for i in range(20)), "one"]
    got = [ids.tolist() for ids in table.encode_each(iter(texts))]
    assert got == [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    table = packing.WordIds(vocabulary)
    table.clear()
    list(table.encode_each(iter(["Word word WORD"])))
    assert len(table.known) == 2
    pieces = dict(table.pieces)
    table.clear()
    assert table.pieces == pieces and all(isinstance(p, bytes) for p in pieces.values())


@pytest.mark.parametrize("depth", [8, 3, 2])
def test_language_model_with_a_limit_equals_brute_force(spark, raw, depth):
    """Later levels read no texts; their states give what whole texts give."""
    rows, df = repeated(spark, raw, tails=True)
    s = lm_scoring.Settings(depth=depth, chunk_tokens=2000)
    assert [d for d in range(1, 10) if lm_scoring.becomes_lean(d, s)] == ([2] if depth > 2 else [])
    assert not {"codes", "sizes", "status"} & set(lm_scoring.LEAN_NAMES)
    want = {(r[0], r[2], r[3]): r for r in Brute(rows, s).rows(rows)}
    got = lm_scoring.score(df, s).collect()
    assert len(got) == len(rows)
    for r in got:
        w = want[(r[0], r[2], r[3])]
        assert abs(r[5] - w[5]) < 1e-6 and abs(r[6] - w[6]) < 1e-9 * r[2]


def test_packing_takes_batches_of_few_texts_and_puts_the_setting_back(docs, spark, monkeypatch):
    name, seen, write = "spark.sql.execution.arrow.maxRecordsPerBatch", [], packing.materialize
    before = spark.conf.get(name)
    monkeypatch.setattr(packing, "materialize", lambda df: (seen.append(spark.conf.get(name)), write(df))[1])
    assert packing.pack_documents(docs, vocabulary).count() > 0
    assert seen[0] == str(packing.BATCH) and spark.conf.get(name) == before
