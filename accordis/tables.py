"""The relations that the registered queries run on, each as a DataFrame and as the SQL that makes the same rows.

`Tables` reads one data directory. The dictionary RELATIONS holds SQL that Spark and DuckDB both accept, so an operator and
its check start from one definition; the operators themselves take any DataFrame with these columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .session import ship

#: name: SQL over the input tables.
RELATIONS = {
    "edges": """SELECT concat('s', l_suppkey) AS caller, concat('p', l_partkey) AS callee, l_linenumber AS line,
        CASE l_returnflag WHEN 'A' THEN 'direct' WHEN 'R' THEN 'conditional' ELSE 'loop' END AS call_type FROM lineitem""",
    "truth": "SELECT concat('s', l_suppkey) AS caller, concat('p', l_partkey) AS callee FROM lineitem WHERE l_returnflag <> 'N'",
    "documented": "SELECT concat('s', l_suppkey) AS caller, concat('p', l_partkey) AS callee FROM lineitem WHERE l_linenumber <= 6",
    "stream_a": "SELECT l_orderkey AS component_id, concat('o', l_orderkey) AS caller, concat('p', l_partkey) AS callee FROM lineitem WHERE l_linenumber <= 6",
    "stream_b": "SELECT l_orderkey AS component_id, concat('o', l_orderkey) AS caller, concat('p', l_partkey) AS callee FROM lineitem WHERE l_linenumber >= 2",
    "docs_a": "SELECT o_orderkey AS component_id FROM orders",
    "docs_b": "SELECT o_orderkey AS component_id FROM orders WHERE o_orderpriority <> '1-URGENT'",
    "hints": "SELECT l_orderkey AS component_id, concat('o', l_orderkey) AS caller, concat('p', l_partkey) AS callee FROM lineitem WHERE l_returnflag <> 'N'",
    "digraph": "SELECT concat('c', c_custkey) AS caller, concat('c', CASE WHEN c_nationkey = 0 THEN c_custkey * 2 ELSE CAST(floor(c_custkey / 2) AS BIGINT) END) AS callee FROM customer",
    "dag": """SELECT concat('o', o_orderkey) AS a, concat('c', o_custkey) AS b FROM orders UNION ALL SELECT concat('c', c_custkey), concat('n', c_nationkey) FROM customer
        UNION ALL SELECT concat('n', n_nationkey), concat('r', n_regionkey) FROM nation""",
    "scores": """SELECT l_orderkey AS component_id, sum(CAST(round(l_discount * 100) AS BIGINT)) / (CAST(count(*) AS DOUBLE) * 10) AS qa,
        sum(CAST(round(l_tax * 100) AS BIGINT)) / (CAST(count(*) AS DOUBLE) * 8) AS reconstruction, sum(CAST(l_quantity AS BIGINT)) / (CAST(count(*) AS DOUBLE) * 50) AS scenario,
        count(CASE WHEN l_returnflag <> 'R' THEN 1 END) / CAST(count(*) AS DOUBLE) AS mutation, count(CASE WHEN l_linestatus = 'F' THEN 1 END) / CAST(count(*) AS DOUBLE) AS impact,
        count(CASE WHEN l_linenumber <= 6 THEN 1 END) / CAST(count(*) AS DOUBLE) AS test_pass, count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS findings FROM lineitem GROUP BY l_orderkey""",
    "judged": """SELECT l.doc_id, d.source, d.lang, quality = 1 AS actual, n_chars >= 500 AS predicted FROM labels l JOIN documents d ON d.doc_id = l.doc_id""",
    "log": """SELECT user_id AS run_id, event_id AS seq, ts, CASE event_type WHEN 'signup' THEN 'run_start' WHEN 'view' THEN 'component_documented' WHEN 'click' THEN 'iteration_complete'
        WHEN 'purchase' THEN 'run_complete' ELSE 'error' END AS type, concat('c', event_id * 13 % 101) AS component_id, CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END AS stream,
        CAST(1 + (event_id * 7) % 11 AS INT) AS iteration, CASE WHEN value < 10 THEN 'failed' ELSE 'completed' END AS status, CAST(floor(value / 50) AS BIGINT) AS blocking, value FROM events""",
    "tickets": """SELECT concat('T-', o_orderkey) AS ticket_key, o_orderkey AS seq, CASE o_orderstatus WHEN 'F' THEN 'applied' WHEN 'O' THEN 'pending' ELSE 'resolved' END AS status,
        CASE WHEN o_orderkey % 3 = 0 THEN 'rebuild' ELSE 'discrepancy' END AS type, o_custkey AS component_id, concat('d', o_orderkey % 5000) AS discrepancy_id, o_orderpriority AS priority,
        CAST(floor(o_totalprice / 1000) AS BIGINT) AS complexity, o_orderdate AS created_at, o_orderdate + INTERVAL '48' HOUR AS timeout_at FROM orders""",
    "usage": """SELECT l_orderkey AS component_id, CAST(l_quantity AS BIGINT) AS prompt_tokens, CAST(l_linenumber AS BIGINT) AS completion_tokens, l_returnflag AS model, l_linestatus AS role FROM lineitem""",
    "pairs": "SELECT a.doc_id, a.text AS text_a, b.text AS text_b FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1",
    "iterations": """SELECT l_suppkey AS run_id, CAST(l_linenumber AS BIGINT) AS iteration, count(*) AS total, count(CASE WHEN l_returnflag <> 'R' THEN 1 END) AS identical,
        count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS discrepancies, count(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 1 END) AS resolved,
        count(CASE WHEN l_quantity > 48 THEN 1 END) AS blocking FROM lineitem GROUP BY l_suppkey, l_linenumber""",
    "answers": """SELECT l_orderkey AS item_id, CASE l_linestatus WHEN 'F' THEN 'A' ELSE 'B' END AS team, concat('c', l_suppkey % 7) AS category, l_returnflag <> 'R' AS is_correct,
        CAST(l_quantity AS BIGINT) AS similarity, l_linenumber AS seq, l_partkey AS pos FROM lineitem""",
}


class Tables:
    """The input tables of one directory as temporary views, and RELATIONS over them as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        ship(spark)
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in RELATIONS:
            return self.raw(name)
        import re

        sources = {t: self.raw(t) for t in set(re.findall(r"(?:FROM|JOIN) (\w+)", RELATIONS[name]))}
        sql = re.sub(r"\b(FROM|JOIN) (\w+)", r"\1 {\2}", RELATIONS[name].replace("{", "{{").replace("}", "}}"))
        return self.spark.sql(sql, **sources)


def with_relations(sql: str) -> str:
    """sql with each {relation} replaced by its definition as a subquery."""
    for name, text in RELATIONS.items():
        sql = sql.replace("{" + name + "}", f"({text})")
    return sql
