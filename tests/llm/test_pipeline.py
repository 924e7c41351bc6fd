"""The pipeline's stages against brute force on a small corpus, each on what its predecessor kept."""

import re
from collections import Counter, defaultdict

import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text):
    w = words((text or "").translate(LOW))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def n_components(texts):
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    return len({find(i) for i in range(len(sets))})


@pytest.fixture(scope="module")
def sf_dir(spark, docs, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    docs.write.parquet(f"file://{folder}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"file://{folder}/labels.parquet")
    return f"file://{folder}"


def test_stages(spark, sf_dir, tmp_path):
    kept = {}
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = frame.columns, [r["text"] for r in frame.collect()]
    for name, stage in corpus_pipeline.STAGES:
        path = f"file://{tmp_path}/{name}"
        stage(spark, frame, sf_dir).write.parquet(path)
        frame = spark.read.parquet(path)
        kept[name] = frame.collect()
        assert name == "packing" or frame.columns == columns
    texts = {name: [r["text"] for r in rows] for name, rows in kept.items() if name != "packing"}
    assert Counter(texts["toxicity"]) == Counter(before)  # one label trains nothing, so nothing is rejected
    assert sorted((t or "").translate(LOW) for t in texts["exact_dedup"]) == sorted({(t or "").translate(LOW) for t in before})
    assert len(texts["ngram_jaccard_join"]) == n_components(texts["exact_dedup"])
    size, taken = Counter(), Counter()
    for r in kept["ngram_jaccard_join"]:
        size[r["source"]] += len(words(r["text"]))
    for r in kept["mixing"]:
        taken[r["source"]] += len(words(r["text"]))
    assert all(taken[s] <= 3 * n for s, n in size.items()) and abs(sum(taken.values()) - sum(size.values())) <= len(size)
    lengths = defaultdict(int)
    for r in kept["packing"]:
        lengths[r["sequence_id"]] += r["length"]
    assert max(lengths.values()) <= 4096
    whole = Counter((r["doc_id"], r["doc_tokens"]) for r in kept["packing"] if r["start"] == 0)
    assert sum(whole.values()) == len(kept["mixing"])
    assert sum(r["length"] for r in kept["packing"]) == sum(n * k for (_, n), k in whole.items())


def test_run_names_all_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard_join", "mixing", "packing"]


def test_toxic_documents_go_and_clean_ones_stay(spark, tmp_path):
    """A model that has learned rejects: what goes is what scores at least the limit, and only that."""
    import random

    from accordis.llm import toxicity

    rng = random.Random(14)
    plain = ["".join(rng.choice("aeiounrst") for _ in range(rng.randint(3, 6))) for _ in range(300)]
    rows = [(i, " ".join([rng.choice(plain) for _ in range(50)] + ["zorgblat vexxikon"] * 2 * (i % 6 == 0))) for i in range(900)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, int(i % 6 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, f"file://{tmp_path}").collect()}
    model = toxicity.fit(docs, spark.read.parquet(f"file://{tmp_path}/labels.parquet"))
    assert kept == {r["doc_id"] for r in toxicity.score(docs, model, "p").filter(f"p < {corpus_pipeline.TOXIC}").collect()}
    assert len(kept & {i for i in range(900) if i % 6 == 0}) <= 3 and len(kept) >= 740
