"""The queries opN_<name>: each operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, exact_dedup, license, lm_scoring, mixing, ngram_join, packing, prefix_trie, quality, sharding, topk, toxicity, whitening
from .common import table


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repaired(table(spark, sf_dir, "conversations"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), "score")
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.digest(table(spark, sf_dir, "documents"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public tokenizer files are on every machine of the cluster."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.fit_and_scan(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, conversations = prefix_trie.rebuilt(prefix_trie.numbered(table(spark, sf_dir, "conversations")))
    return prefix_trie.trie(turns, conversations).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judged(docs, quality.fit(docs, table(spark, sf_dir, "labels"))).drop("score")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_toxicity": op3_toxicity,
    "op4_mixing": op4_mixing,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_exact_topk": op6_exact_topk,
    "op7_packing": op7_packing,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_sharding": op9_sharding,
    "op10_license_scan": op10_license_scan,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_quality_rules": op12_quality_rules,
    "op13_whitening": op13_whitening,
}
ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
        shingles AS (
            SELECT doc_id, unnest(list_distinct(list_transform(generate_series(1, greatest(1, len(w) - 4)), lambda i: array_to_string(w[i:i + 4], ' ')))) AS s FROM words WHERE len(w) > 0),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        links AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
            GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
        SELECT d.doc_id, coalesce(max(n), 0) AS n_shingles, min(reach.b) AS component_id
        FROM documents d LEFT JOIN sizes ON sizes.doc_id = d.doc_id JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id""",
    "op5_exact_dedup": """
        WITH rows AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
        ruled AS (SELECT *, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM rows)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM ruled""",
    "op6_exact_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
        r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s)
        SELECT * FROM r WHERE rank <= 5""",
    # h is a CRC-32 taken bit by bit: a list holds each byte and eight marks for the shifts after it
    "op11_prefix_trie": """
        WITH turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
            FROM conversations WHERE conv_id IS NOT NULL),
        convs AS (SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
            lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) ELSE xor(crc >> 1, 3988292384 * (crc & 1)) END, 4294967295::BIGINT), 4294967295) % 4 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
        built AS (SELECT c.conv_id, row_number() OVER (PARTITION BY c.conv_id ORDER BY t.conv_id <> c.base OR t.pos > h, t.pos) AS depth, role, text
            FROM convs c JOIN turns t ON (t.conv_id = c.base AND t.pos <= h) OR (t.conv_id = c.conv_id AND t.pos > h)),
        occ AS (SELECT conv_id, depth, string_agg(sha256(concat(length(role), ':', role, text)), '') OVER (PARTITION BY conv_id ORDER BY depth) AS k, len(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS words FROM built
            UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
        lengths AS (SELECT conv_id, max(depth) AS length FROM occ GROUP BY conv_id),
        nodes AS (SELECT k, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words, max(length) AS far,
            sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = length), '')) AS ends_sha256 FROM occ JOIN lengths USING (conv_id) GROUP BY k),
        above AS (SELECT o.k, n.conv_id, n.depth, n.n_convs, n.words, n.far FROM nodes n JOIN occ o ON o.conv_id = n.conv_id AND o.depth <= n.depth),
        sums AS (SELECT a.k, count(*) FILTER (a.depth = n.depth + 1) AS n_children, count(*) FILTER (a.far = a.depth) AS n_leaves, sum((a.n_convs - 1) * a.words)::BIGINT AS saved_tokens FROM above a JOIN nodes n USING (k) GROUP BY a.k)
        SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n_children, n_leaves, saved_tokens, n.ends_sha256
        FROM nodes n JOIN sums USING (k) LEFT JOIN occ o ON o.conv_id = n.conv_id AND o.depth = n.depth - 1 LEFT JOIN nodes p ON p.k = o.k""",
}
