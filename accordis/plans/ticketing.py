"""Queries on tickets, usage and run figures (P18-P21, P24-P26, A17-A19, A21-A22, A26, A28, A30, JN10-JN12, JN14, SO9, F11)."""

from pyspark.sql import functions as F

from ..operators import history as h
from ..operators import scores as s
from ..operators import tickets as k
from .registry import query

# Priorities of tickets, and prices in dollars a million tokens.
PRIORITIES = {"critical": "0", "high": "0", "medium": "1", "low": "2", "lowest": "3"}
PRICES = {"A": (3, 15), "R": (15, 75), "N": (1, 4)}


@query("p18_confidence_bucket", "SELECT component_id, CASE WHEN c >= 95 THEN 'high' WHEN c >= 80 THEN 'medium' ELSE 'low' END AS bucket FROM (SELECT component_id, floor(mutation * 100) AS c FROM {scores} s)")
def _(t):
    return t.scores.select("component_id", s.confidence_bucket(F.col("mutation")).alias("bucket"))


@query("p19_ticket_query", "SELECT ticket_key, status FROM {tickets} t WHERE type = 'rebuild' AND status IN ('pending', 'resolved') AND status NOT IN ('applied', 'expired')")
def _(t):
    return k.query(t.tickets, types=["rebuild"], statuses=["pending", "resolved"], components=[]).select("ticket_key", "status")


@query("p20_overdue", "SELECT ticket_key FROM {tickets} t WHERE status = 'pending' AND timeout_at <= TIMESTAMP '1998-01-01'")
def _(t):
    return k.overdue(t.tickets, "1998-01-01").select("ticket_key")


@query("p21_severity_filter", "SELECT ticket_key, severity FROM (SELECT ticket_key, CASE substr(priority, 1, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' ELSE 'low' END AS severity FROM {tickets} t) WHERE severity IN ('critical', 'high')")
def _(t):
    first = F.substring("priority", 1, 1)
    severity = F.when(first == "1", "critical").when(first == "2", "high").when(first == "3", "medium").otherwise("low")
    return t.tickets.select("ticket_key", severity.alias("severity")).filter(k.at_least(F.col("severity"), "high"))


@query("p25_rebuild_priority", "SELECT ticket_key, CASE WHEN rn <= 3 THEN 'High' WHEN rn <= 10 THEN 'Medium' ELSE 'Low' END AS rebuild_priority FROM (SELECT ticket_key, row_number() OVER (ORDER BY complexity DESC, seq) AS rn FROM {tickets} t)")
def _(t):
    return k.rebuild_priority(t.tickets, [F.col("complexity").desc(), F.col("seq")])


@query("p26_enum_mapping", "SELECT c_custkey AS id, CASE lower(p) WHEN 'critical' THEN '0' WHEN 'high' THEN '0' WHEN 'medium' THEN '1' WHEN 'low' THEN '2' WHEN 'lowest' THEN '3' ELSE '1' END AS priority FROM (SELECT c_custkey, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'Critical' WHEN 'MACHINERY' THEN 'LOW' WHEN 'BUILDING' THEN 'lowest' ELSE c_mktsegment END AS p FROM customer)")
def _(t):
    raw = F.when(F.col("c_mktsegment") == "HOUSEHOLD", "Critical").when(F.col("c_mktsegment") == "MACHINERY", "LOW").when(F.col("c_mktsegment") == "BUILDING", "lowest").otherwise(F.col("c_mktsegment"))
    return t.customer.select(F.col("c_custkey").alias("id"), k.mapped(raw, PRIORITIES, "1").alias("priority"))


@query("a17_usage_rollup", """SELECT 'total' AS level, NULL AS name, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens, count(*) AS calls FROM {usage} u
    UNION ALL SELECT 'model', model, sum(prompt_tokens)::BIGINT, sum(completion_tokens)::BIGINT, count(*) FROM {usage} u GROUP BY model UNION ALL SELECT 'role', role, sum(prompt_tokens)::BIGINT, sum(completion_tokens)::BIGINT, count(*) FROM {usage} u GROUP BY role""")
def _(t):
    return k.usage_rollup(t.usage)


@query("a18_cost", "SELECT component_id, sum(prompt_tokens * CASE model WHEN 'A' THEN 3 WHEN 'R' THEN 15 ELSE 1 END + completion_tokens * CASE model WHEN 'A' THEN 15 WHEN 'R' THEN 75 ELSE 4 END)::BIGINT AS micro_dollars FROM {usage} u GROUP BY component_id")
def _(t):
    return k.cost(t.usage, PRICES)


@query("a19_stream_costs", "SELECT coalesce(role, 'all') AS role, coalesce(model, 'all') AS model, sum(prompt_tokens)::BIGINT AS tokens FROM {usage} u GROUP BY ROLLUP (role, model)")
def _(t):
    return t.usage.rollup("role", "model").agg(F.sum("prompt_tokens").alias("tokens")).select(F.coalesce("role", F.lit("all")).alias("role"), F.coalesce("model", F.lit("all")).alias("model"), "tokens")


@query("a21_ticket_metrics", "SELECT count(*) AS total, count(DISTINCT component_id) AS components_with_tickets, (SELECT count(DISTINCT c_custkey) FROM customer) AS components, count(*)::DOUBLE / (SELECT count(DISTINCT c_custkey) FROM customer) AS rate FROM {tickets} t")
def _(t):
    return k.ticket_metrics(t.tickets, t.customer.select(F.col("c_custkey").alias("component_id")))


SEVERITIES = "(SELECT *, CASE substr(priority, 1, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' ELSE 'low' END AS severity FROM {tickets} t)"


@query("a21_breakdown", f"SELECT 'type' AS dimension, type AS value, count(*) AS n FROM {SEVERITIES} s GROUP BY type UNION ALL SELECT 'severity', severity, count(*) FROM {SEVERITIES} s GROUP BY severity")
def _(t):
    return k.breakdown(t.tickets.withColumn("severity", k.severity_of(F.col("priority"))), "type", "severity")


@query("x8_apply_resolutions", "SELECT ticket_key, CASE WHEN status = 'resolved' AND complexity > 200 THEN 'applied' ELSE status END AS status FROM {tickets} t")
def _(t):
    return k.apply_resolutions(t.tickets, lambda resolved: resolved.filter("complexity > 200")).select("ticket_key", "status")


STATUSES, TYPES = ["pending", "in_progress", "resolved", "applied", "expired", "cancelled"], ["discrepancy", "rebuild"]


@query("a22_ticket_statistics", f"""SELECT d.dimension, d.value, count(t.ticket_key) AS n FROM (SELECT 'status' AS dimension, unnest({STATUSES}) AS value UNION ALL SELECT 'type', unnest({TYPES})) d
    LEFT JOIN {{tickets}} t ON (d.dimension = 'status' AND t.status = d.value) OR (d.dimension = 'type' AND t.type = d.value) GROUP BY d.dimension, d.value
    UNION ALL SELECT 'unique', 'components', count(DISTINCT component_id) FROM {{tickets}} t UNION ALL SELECT 'unique', 'discrepancies', count(DISTINCT discrepancy_id) FROM {{tickets}} t""")
def _(t):
    return k.statistics(t.tickets, STATUSES, TYPES)


@query("a26_epics", "SELECT component_id, sum(complexity)::BIGINT AS complexity, string_agg(ticket_key, ',' ORDER BY priority, seq) AS tickets FROM {tickets} t GROUP BY component_id")
def _(t):
    return k.epic(t.tickets)


@query("a28_success_rates", "SELECT run_id, (count(*) FILTER (type <> 'error'))::DOUBLE / count(*) AS success_rate, (count(DISTINCT component_id) FILTER (type = 'component_documented'))::DOUBLE / count(DISTINCT component_id) AS documentation_rate FROM {log} l GROUP BY run_id")
def _(t):
    return h.success_rates(t.log)


@query("a30_fingerprint", "SELECT lang, md5(string_agg(line, '|' ORDER BY line)) AS fingerprint FROM (SELECT lang, concat(doc_id, ':', n_chars, ':', doc_id % 9) AS line FROM documents) GROUP BY lang")
def _(t):
    files = t.documents.select("lang", F.col("doc_id").cast("string").alias("path"), F.col("n_chars").alias("size"), (F.col("doc_id") % 9).alias("mtime"))
    return k.fingerprint(files, "lang")


@query("jn10_ticket_enrichment", "SELECT ticket_key, coalesce(c_name, 'unknown') AS name, coalesce(c_mktsegment, '') AS segment FROM {tickets} t LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON c.c_custkey = t.component_id")
def _(t):
    return k.enriched(t.tickets, t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("component_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")))


@query("jn11_tickets_by_discrepancy", "SELECT d.id, count(t.ticket_key) AS tickets FROM (SELECT DISTINCT concat('d', p_partkey) AS id FROM part) d LEFT JOIN {tickets} t ON t.discrepancy_id = d.id GROUP BY d.id")
def _(t):
    return k.of_discrepancies(t.part.select(F.concat(F.lit("d"), "p_partkey").alias("id")), t.tickets)


@query("jn12_gap_strategy", "SELECT o_orderkey AS gap, coalesce(arg_min(l_returnflag, (l_linenumber, l_partkey, l_suppkey)), 'qa') AS strategy FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linestatus = 'F' GROUP BY o_orderkey")
def _(t):
    found = t.lineitem.filter("l_linestatus = 'F'").groupBy(F.col("l_orderkey").alias("gap")).agg(F.min_by("l_returnflag", F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("s"))
    return t.orders.select(F.col("o_orderkey").alias("gap")).join(found, "gap", "left").select("gap", F.coalesce("s", F.lit("qa")).alias("strategy"))


@query("jn14_untracked", "SELECT concat('T-', o_orderkey) AS ticket_key, CASE WHEN o_orderpriority = '1-URGENT' THEN 'rebuild' ELSE 'discrepancy' END AS type FROM orders WHERE NOT EXISTS (SELECT 1 FROM {tickets} t WHERE t.status = 'applied' AND t.seq = o_orderkey)")
def _(t):
    external = t.orders.select(F.concat(F.lit("T-"), "o_orderkey").alias("ticket_key"), F.when(F.col("o_orderpriority") == "1-URGENT", F.array(F.lit("x"), F.lit("rebuild"))).otherwise(F.array(F.lit("x"))).alias("labels"))
    return k.untracked(external, t.tickets.filter("status = 'applied'"))


@query("so9_labels", "SELECT ticket_key, CASE WHEN status = type THEN status ELSE concat(status, ',', type) END || ',auto' AS labels FROM {tickets} t")
def _(t):
    return t.tickets.select("ticket_key", F.array_join(k.labels([F.col("status"), F.col("type"), F.col("status"), F.lit("auto"), F.lit(None)]), ",").alias("labels"))


@query("f11_rendered_tickets", """SELECT ticket_key, CASE WHEN type = 'rebuild' THEN concat('Rebuild ', component_id, ' (', CASE WHEN complexity > 100 THEN complexity::VARCHAR ELSE '${size}' END, ') ${missing}') ELSE concat('[', status, '] ', ticket_key, ' for ', component_id) END AS body FROM {tickets} t""")
def _(t):
    """Templates by type, with variables; those that have no value stay as they are."""
    templates = t.spark.createDataFrame([("rebuild", "Rebuild ${component} (${size}) ${missing}")], "type string, template string")
    values = {"status": F.col("status"), "key": F.col("ticket_key"), "component": F.col("component_id"), "size": F.when(F.col("complexity") > 100, F.col("complexity"))}
    return k.render_tickets(t.tickets, templates, values, "[${status}] ${key} for ${component}").select("ticket_key", "body")
