import hashlib
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from accordis.llm import exact_dedup, mixing, sharding

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def n_words(text):
    import re

    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plan(df):
    return df._jdf.queryExecution().toString()


def test_shards_are_even_gapless_and_reproducible(docs, raw):
    got = sharding.shard(docs, 4).collect()
    again = sharding.shard(docs.repartition(3), 4).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in raw)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_permutation_is_a_bijection(spark):
    for n in (1, 2, 3, 16, 97, 1000):
        got = spark.range(n).select(sharding.permute(F.col("id"), F.lit(n).cast("long"), 3).alias("p")).collect()
        assert sorted(r["p"] for r in got) == list(range(n))


def test_shard_of_nothing(empty):
    assert sharding.shard(empty).count() == 0


def targets(sizes, epochs=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    capped, total = {}, sum(sizes.values())
    while True:
        free = [s for s in order if s not in capped]
        left, w = total - sum(capped.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w > epochs * sizes[s]]
        if not over:
            return capped | {s: left * weight[s] / w for s in free}
        capped |= {s: epochs * sizes[s] for s in over}


def test_mix_meets_targets(docs, raw):
    got = mixing.mix(docs).collect()
    assert len(got) == len(raw)
    sizes = Counter()
    for _, text, source in raw:
        sizes[source] += n_words(text)
    wanted, taken = targets(sizes), Counter()
    for r in got:
        assert r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - wanted[r["source"]]) < 1e-6
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - wanted[s]) <= 3 for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(2)).collect()))


def test_mixed_rows_follow_the_decisions(docs):
    decided = mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("t")).collect()
    rows = mixing.apply_mix(docs)
    assert rows.columns == docs.columns
    got = Counter()
    for r in rows.collect():
        got[r["source"]] += n_words(r["text"])
    assert {s: n for s, n in got.items() if n} == {r["source"]: r["t"] for r in decided if r["t"]}


def test_mix_of_nothing(empty):
    assert mixing.mix(empty).count() == 0 and mixing.apply_mix(empty).count() == 0


def groups(raw):
    found = defaultdict(list)
    for i, text, _ in raw:
        found[(text or "").translate(LOW)].append(i)
    return found


def largest(ids):
    known = [i for i in ids if i is not None]
    return max(known) if known else None


def test_dedup_digest(docs, raw):
    by_text = groups(raw)
    want = Counter()
    for i, text, _ in raw:
        norm = (text or "").translate(LOW)
        keep = largest(by_text[norm])
        want[(i, keep, len(by_text[norm]), i == keep, hashlib.sha256(norm.encode()).hexdigest())] += 1
    got = exact_dedup.digest(docs, capacity=8)
    assert Counter(tuple(r) for r in got.collect()) == want
    assert "Python" not in plan(got)


def test_deduplicate_keeps_one_of_each(docs, raw):
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted((r["text"] or "").translate(LOW) for r in kept.collect()) == sorted(groups(raw))


def test_dedup_of_nothing(empty):
    assert exact_dedup.digest(empty).count() == 0 and exact_dedup.deduplicate(empty).count() == 0


def test_directory_splits_only_full_buckets(spark):
    """Slots cover all keys, no bucket is overfull, and none could be put together again with its other half."""
    index = spark.range(3000).select(F.xxhash64("id").alias("key"))
    slots, depth = exact_dedup.directory(index, capacity=100)
    rows = index.withColumn("slot", exact_dedup.leading(F.col("key"), depth)).join(slots, "slot").collect()
    load = Counter((r["bucket"], r["depth"]) for r in rows)
    assert len(rows) == 3000 and max(load.values()) <= 100 and len(load) > 30
    assert all(load[b] + load.get((b[0] ^ (1 << (depth - b[1])), b[1]), 100) > 100 for b in load)


def test_directory_doubles_past_one_step(spark):
    """Keys that share their first 20 bits split all the same, and one key never does."""
    index = spark.createDataFrame([((i % 2) << 40 | i,) for i in range(64)], "key long")
    slots, depth = exact_dedup.directory(index, capacity=40)
    assert depth > 2 * exact_dedup.STEP
    assert exact_dedup.directory(index.filter("key = 0").unionAll(index.filter("key = 0")), capacity=1)[1] == 0


def test_dedup_goes_through_its_directory(docs, monkeypatch):
    """Without the slot of a bucket its groups are lost."""
    want = exact_dedup.digest(docs, capacity=8).filter("group_size > 1").count()
    whole = exact_dedup.directory

    def torn(index, capacity):
        slots, depth = whole(index, capacity)
        return slots.filter("bucket = 0"), depth

    monkeypatch.setattr(exact_dedup, "directory", torn)
    assert exact_dedup.digest(docs, capacity=8).filter("group_size > 1").count() < want


def test_index_chains_colliding_keys(spark):
    index = spark.createDataFrame([(1, 5, 3, "a"), (2, 5, 3, "b"), (3, 5, 3, "a"), (4, 9, 3, "c")], "doc_id long, key long, n_bytes int, text_sha256 string")
    got = {(r["text_sha256"], r["keep_id"], r["group_size"], r["chained"]) for r in exact_dedup.chains(index, *exact_dedup.directory(index)).collect()}
    assert got == {("a", 3, 2, 2), ("b", 2, 1, 2), ("c", 4, 1, 1)}


def test_a_row_repeated_very_often_comes_from_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 1000)
    same = spark.range(50_500).selectExpr("CAST(NULL AS LONG) AS doc_id", "'again' AS text").unionAll(spark.range(30).selectExpr("id", "concat('t', id)"))
    got = sharding.shard(same)
    assert got.selectExpr("count(*)", "count(DISTINCT row_number)", "min(row_number)", "max(row_number)").first()[:] == (50_530, 50_530, 0, 50_529)
    assert {(r["shard"], r["n"], r["top"]) for r in got.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("top")).collect()} == {(s, 3158 + (s < 2), 3157 + (s < 2)) for s in range(16)}
    assert got.filter("doc_id IS NULL").select(F.spark_partition_id().alias("p")).groupBy("p").count().filter("count > 5000").count() >= 3
