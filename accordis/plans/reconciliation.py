"""Queries that reconcile two streams (JN1-JN6, JN9, SO2, SO5, C1-C17, P15-P17, P24, A5-A6, A27, DD1-DD8)."""

from pyspark.sql import functions as F

from ..operators import reconcile as r
from ..sources.layout import Streams
from .registry import SQL, query

SIDES = """(SELECT coalesce(a.component_id, b.component_id) AS component_id, coalesce(a.caller, b.caller) AS caller, coalesce(a.callee, b.callee) AS callee, a.caller IS NOT NULL AS in_a, b.caller IS NOT NULL AS in_b
    FROM (SELECT DISTINCT * FROM {stream_a} x) a FULL JOIN (SELECT DISTINCT * FROM {stream_b} y) b ON a.component_id = b.component_id AND a.callee = b.callee)"""
# A component counts when a stream documents it, with edges or without.
COMPARED = f"""(SELECT component_id, coalesce(has_a, false) OR coalesce(edge_a, false) AS has_a, coalesce(has_b, false) OR coalesce(edge_b, false) AS has_b, coalesce(common, 0) AS common, coalesce(only_a, 0) AS only_a, coalesce(only_b, 0) AS only_b
    FROM (SELECT DISTINCT component_id, true AS has_a FROM {{docs_a}} a) FULL JOIN (SELECT DISTINCT component_id, true AS has_b FROM {{docs_b}} b) USING (component_id) FULL JOIN (SELECT component_id, bool_or(in_a) AS edge_a, bool_or(in_b) AS edge_b,
    count(*) FILTER (in_a AND in_b) AS common, count(*) FILTER (in_a AND NOT in_b) AS only_a, count(*) FILTER (NOT in_a AND in_b) AS only_b FROM {SIDES} s GROUP BY component_id) USING (component_id))"""


def compared(t):
    return r.compare_streams(t.stream_a, t.stream_b, t.docs_a, t.docs_b)


@query("so2_edge_sides", f"SELECT * FROM {SIDES} s")
def _(t):
    return r.edge_sides(t.stream_a, t.stream_b)


@query("so2_stream_comparison", f"SELECT component_id, common, only_a, only_b, only_a = 0 AND only_b = 0 AS identical FROM {COMPARED} c WHERE has_a AND has_b")
def _(t):
    return r.common_components(compared(t))


@query("a6_agreement", f"""WITH c AS (SELECT count(*) AS components, count(*) FILTER (only_a = 0 AND only_b = 0) AS identical FROM {COMPARED} c WHERE has_a AND has_b)
    SELECT *, CASE WHEN components = 0 THEN 1.0::DOUBLE ELSE identical::DOUBLE / components END AS agreement_rate, CASE WHEN components = 0 THEN true ELSE identical::DOUBLE / components >= 0.95 END AS converged FROM c""")
def _(t):
    return r.agreement(r.common_components(compared(t)))


@query("jn2_missing_components", f"""SELECT component_id, CASE WHEN has_b THEN 'missing_in_a' ELSE 'missing_in_b' END AS type, CASE WHEN has_b THEN 'accept_stream_b' ELSE 'accept_stream_a' END AS resolution, 0.9::DOUBLE AS confidence FROM {COMPARED} c WHERE NOT (has_a AND has_b)""")
def _(t):
    return r.missing_components(compared(t))


HINTED = f"""(SELECT s.*, CASE WHEN k.component_id IS NOT NULL THEN h.caller IS NOT NULL END AS hint FROM {SIDES} s LEFT JOIN (SELECT DISTINCT component_id FROM {{hints}} q) k ON k.component_id = s.component_id
    LEFT JOIN (SELECT DISTINCT * FROM {{hints}} q) h ON h.component_id = s.component_id AND h.callee = s.callee WHERE in_a <> in_b)"""


def one_sided(t):
    return r.hinted(r.edge_sides(t.stream_a, t.stream_b).filter("in_a <> in_b"), t.hints)


@query("so5_symmetric_difference", f"SELECT component_id, caller, callee, in_a FROM {SIDES} s WHERE in_a <> in_b")
def _(t):
    return r.edge_sides(t.stream_a, t.stream_b).filter("in_a <> in_b").drop("in_b")


@query("jn3_hints", f"SELECT * FROM {HINTED} h")
def _(t):
    return one_sided(t)


RESOLVED = f"""(SELECT component_id, caller, callee, in_a, hint, CASE WHEN hint AND in_a THEN 'accept_stream_a' WHEN hint THEN 'accept_stream_b' ELSE 'needs_human_review' END AS resolution,
    CASE WHEN hint THEN 'ground_truth_hint' ELSE 'unresolved' END AS source, CASE WHEN hint THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM {HINTED} h)"""


@query("c2_edge_resolution", f"SELECT * FROM {RESOLVED} r")
def _(t):
    return r.resolve_edges(one_sided(t)).drop("in_b")


TYPED = f"""(SELECT *, CASE hash % 6 WHEN 0 THEN 'call_graph_edge' WHEN 1 THEN 'call_site_line' WHEN 2 THEN 'call_type_mismatch' WHEN 3 THEN 'summary_mismatch' WHEN 4 THEN 'missing_callee' ELSE 'missing_component' END AS type
    FROM (SELECT *, component_id + CAST(substring(callee, 2) AS BIGINT) AS hash FROM {RESOLVED} r) h)"""
TYPES = ("call_graph_edge", "call_site_line", "call_type_mismatch", "summary_mismatch", "missing_callee", "missing_component")


def typed(t):
    """Discrepancies of all types: the type follows from the ids."""
    number = F.col("component_id") + F.substring("callee", 2, 20).cast("long")
    return r.resolve_edges(one_sided(t)).withColumn("type", F.element_at(F.array(*map(F.lit, TYPES)), (number % 6 + 1).cast("int")))


@query("p15_flags", f"""SELECT component_id, callee, type, resolution, type IN ('call_graph_edge', 'call_site_line', 'call_type_mismatch') AS is_call_graph_related, resolution NOT IN ('needs_human_review', 'deferred') AS is_resolved,
    resolution IN ('needs_human_review', 'deferred') AS is_blocking, confidence < 0.7 AND resolution = 'needs_human_review' AS needs_review, CASE WHEN type IN ('call_graph_edge', 'call_site_line', 'call_type_mismatch') OR confidence < 0.5 THEN 'High' ELSE 'Medium' END AS priority FROM {TYPED} r""")
def _(t):
    return r.flags(typed(t)).select("component_id", "callee", "type", "resolution", "is_call_graph_related", "is_resolved", "is_blocking", "needs_review", "priority")


@query("p24_priority", f"SELECT type, CASE WHEN type IN ('call_graph_edge', 'call_site_line', 'call_type_mismatch') OR confidence < 0.5 THEN 'High' ELSE 'Medium' END AS priority, count(*) AS n FROM {TYPED} r GROUP BY ALL")
def _(t):
    return r.flags(typed(t)).groupBy("type", "priority").agg(F.count(F.lit(1)).alias("n"))


@query("p16_needs_ticket", f"SELECT component_id, callee, type FROM {TYPED} r WHERE resolution = 'needs_human_review' AND confidence < 0.7")
def _(t):
    return r.flags(typed(t)).filter("needs_review").select("component_id", "callee", "type")


@query("p16_blocking_by_component", f"SELECT component_id, count(*) AS blocking FROM {RESOLVED} r WHERE resolution = 'needs_human_review' GROUP BY component_id")
def _(t):
    return r.resolve_edges(one_sided(t)).filter("resolution = 'needs_human_review'").groupBy("component_id").agg(F.count(F.lit(1)).alias("blocking"))


@query("c4_recommendation", f"""SELECT total, blocking, review, total = 0 AS converged, CASE WHEN total = 0 THEN 'finalize' WHEN review > 0 THEN 'generate_tickets' WHEN 2 >= 5 THEN 'max_iterations_reached' ELSE 'continue' END AS recommendation
    FROM (SELECT count(*) AS total, count(*) FILTER (resolution = 'needs_human_review') AS blocking, count(*) FILTER (resolution = 'needs_human_review' AND confidence < 0.7) AS review FROM {RESOLVED} r)""")
def _(t):
    review = F.col("resolution") == "needs_human_review"
    counted = r.resolve_edges(one_sided(t)).agg(F.count(F.lit(1)).alias("total"), F.count_if(review).alias("blocking"), F.count_if(review & (F.col("confidence") < 0.7)).alias("review"))
    return r.recommend(counted, 2)


VALUES = """(SELECT o_orderkey AS id, o_orderstatus AS a, CASE WHEN o_totalprice > 100000 THEN o_orderstatus ELSE substr(o_orderpriority, 1, 1) END AS b, CASE WHEN o_custkey % 2 = 0 THEN o_orderstatus END AS truth FROM orders)"""


@query("c3_value_resolution", f"""SELECT *, CASE WHEN a IS NOT DISTINCT FROM b THEN 'accept_consensus' WHEN a IS NOT DISTINCT FROM truth THEN 'accept_stream_a' WHEN b IS NOT DISTINCT FROM truth THEN 'accept_stream_b' ELSE 'needs_human_review' END AS resolution,
    CASE WHEN a IS NOT DISTINCT FROM b THEN 0.99::DOUBLE WHEN a IS NOT DISTINCT FROM truth OR b IS NOT DISTINCT FROM truth THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM {VALUES} v""")
def _(t):
    o = t.orders
    b = F.when(F.col("o_totalprice") > 100000, F.col("o_orderstatus")).otherwise(F.substring("o_orderpriority", 1, 1))
    return r.resolve_values(o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("a"), b.alias("b"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderstatus")).alias("truth")))


@query("c1_structural_identity", """SELECT a.doc_id, a.text IS NOT DISTINCT FROM b.text AND a.lang IS NOT DISTINCT FROM b.lang AS identical FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1""")
def _(t):
    a = t.documents.select("doc_id", F.struct("text", "lang").alias("a"))
    b = t.documents.select((F.col("doc_id") - 1).alias("doc_id"), F.struct("text", "lang").alias("b"))
    return a.join(b, "doc_id").select("doc_id", F.col("a").eqNullSafe(F.col("b")).alias("identical"))


RATES = "(SELECT run_id, iteration, identical::DOUBLE / total AS match_rate, identical::DOUBLE / (total + 10) AS similarity, blocking FROM {iterations} i)"


@query("c6_convergence", f"""SELECT run_id, iteration, match_rate, similarity, blocking, match_rate >= 0.7 AS match_met, similarity >= 0.6 AS similarity_met, blocking <= 4 AS blocking_met,
    CASE WHEN match_rate >= 0.7 AND similarity >= 0.6 AND blocking <= 4 THEN 'converged' WHEN iteration >= 5 THEN 'forced' WHEN match_rate >= 0.7 OR similarity >= 0.6 OR blocking <= 4 THEN 'partially_converged' ELSE 'in_progress' END AS status,
    NOT (match_rate >= 0.7 AND similarity >= 0.6 AND blocking <= 4) AND iteration < 5 AS go_on FROM {RATES} x""")
def _(t):
    rows = t.iterations.select("run_id", "iteration", (F.col("identical").cast("double") / F.col("total")).alias("match_rate"), (F.col("identical").cast("double") / (F.col("total") + 10)).alias("similarity"), "blocking")
    return r.convergence(rows, 0.7, 0.6, 4, 5)


@query("c5_criteria", f"SELECT run_id, iteration, match_rate >= 0.66 AND similarity >= 0.6 AND blocking <= 6 AND iteration <= 5 AS satisfied FROM {RATES} x")
def _(t):
    rate = lambda n: F.col("identical").cast("double") / n
    rows = t.iterations.withColumns({"match_rate": rate(F.col("total")), "similarity": rate(F.col("total") + 10)})
    return rows.select("run_id", "iteration", r.satisfied(0.66, 0.6, 6, 5).alias("satisfied"))


@query("c10_secondary_rule", f"""SELECT run_id, iteration, discrepancies = 0 OR (identical::DOUBLE / total >= 0.65 AND blocking <= 3) AS converged FROM {{iterations}} i""")
def _(t):
    rows = t.iterations.withColumn("match_rate", F.col("identical").cast("double") / F.col("total"))
    return rows.select("run_id", "iteration", r.settled(0.65, 3).alias("converged"))


@query("c8_stream_status", f"""SELECT components, identical, components - identical AS differing, CASE WHEN components = 0 THEN 1.0::DOUBLE ELSE identical::DOUBLE / components END AS agreement_rate, components = 0 OR identical >= 0.95 * components AS converged
    FROM (SELECT count(*) AS components, count(*) FILTER (only_a = 0 AND only_b = 0) AS identical FROM {COMPARED} c WHERE has_a AND has_b)""")
def _(t):
    return r.stream_status(r.common_components(compared(t)))


@query("c8_status_ids", f"""SELECT component_id, CASE WHEN only_a = 0 AND only_b = 0 THEN 'identical' ELSE 'different' END AS status, only_a + only_b AS edges_apart FROM {COMPARED} c WHERE has_a AND has_b""")
def _(t):
    """The lists of ids, as rows: they grow with the input."""
    return r.status_ids(r.common_components(compared(t)))


@query("jn4_merge_streams", """SELECT o_orderkey AS component_id, coalesce(a.s, b.s) AS summary, CAST(trunc(CASE WHEN a.c IS NOT NULL AND b.c IS NOT NULL THEN least(a.c, b.c) * 100 ELSE coalesce(a.c, b.c) * 80 END) AS INTEGER) AS confidence,
    CASE WHEN a.c IS NOT NULL AND b.c IS NOT NULL THEN 'merged' WHEN a.c IS NOT NULL THEN 'stream_a' ELSE 'stream_b' END AS source FROM orders o
    LEFT JOIN (SELECT component_id, qa AS c, concat('a', component_id) AS s FROM {scores} x WHERE findings <= 2) a ON a.component_id = o_orderkey
    LEFT JOIN (SELECT component_id, scenario AS c, concat('b', component_id) AS s FROM {scores} x WHERE findings >= 1) b ON b.component_id = o_orderkey WHERE a.c IS NOT NULL OR b.c IS NOT NULL""")
def _(t):
    s = t.scores
    a = s.filter("findings <= 2").select("component_id", F.col("qa").alias("confidence"), F.concat(F.lit("a"), "component_id").alias("summary"))
    b = s.filter("findings >= 1").select("component_id", F.col("scenario").alias("confidence"), F.concat(F.lit("b"), "component_id").alias("summary"))
    return r.merge_streams(t.orders.select(F.col("o_orderkey").alias("component_id")), a, b)


@query("jn5_divergent_only", f"SELECT o_orderkey AS component_id, o_custkey FROM orders WHERE o_orderkey IN (SELECT component_id FROM {COMPARED} c WHERE has_a AND has_b AND only_a + only_b > 0)")
def _(t):
    divergent = r.common_components(compared(t)).filter("NOT identical")
    return t.orders.select(F.col("o_orderkey").alias("component_id"), "o_custkey").join(divergent, "component_id", "left_semi")


@query("jn6_resume", """WITH done AS (SELECT component_id FROM {log} l WHERE type = 'component_documented' AND run_id < 40 GROUP BY component_id HAVING count(DISTINCT stream) = 2)
    SELECT DISTINCT component_id FROM {log} l WHERE component_id NOT IN (SELECT component_id FROM done)""")
def _(t):
    log = t.log
    return r.unprocessed(log.select("component_id").distinct(), log.filter("type = 'component_documented' AND run_id < 40").select("component_id", "stream"))


@query("jn9_dependency_context", """SELECT e.caller, e.callee, coalesce(n.text, p.text) AS context FROM (SELECT DISTINCT caller, callee FROM {edges} e) e
    LEFT JOIN (SELECT concat('p', p_partkey) AS id, p_name AS text FROM part WHERE p_size > 25) n ON n.id = e.callee LEFT JOIN (SELECT concat('p', p_partkey) AS id, p_brand AS text FROM part WHERE p_size > 10) p ON p.id = e.callee WHERE coalesce(n.text, p.text) IS NOT NULL""")
def _(t):
    key = F.concat(F.lit("p"), "p_partkey").alias("component_id")
    return r.dependency_context(t.edges, t.part.filter("p_size > 25").select(key, F.col("p_name").alias("context")), t.part.filter("p_size > 10").select(key, F.col("p_brand").alias("context")))


@query("a27_feedback", f"""SELECT component_id, coalesce(string_agg(caller || '->' || callee, ',' ORDER BY caller || '->' || callee) FILTER (NOT in_a), '') AS to_add, coalesce(string_agg(caller || '->' || callee, ',' ORDER BY caller || '->' || callee) FILTER (NOT in_b), '') AS to_verify,
    count(*) FILTER (NOT in_a) AS n_add, count(*) FILTER (NOT in_b) AS n_verify, concat('add ', count(*) FILTER (NOT in_a), ', verify ', count(*) FILTER (NOT in_b)) AS message FROM {SIDES} s WHERE in_a <> in_b GROUP BY component_id""")
def _(t):
    return r.feedback(r.edge_sides(t.stream_a, t.stream_b))


CHECKS = """(SELECT l_orderkey AS id, count(*) FILTER (l_returnflag = 'A') AS found, count(*) FILTER (l_returnflag = 'N') AS missing_callees, count(*) FILTER (l_returnflag = 'R' AND l_linenumber > 3) AS false_callees,
    count(*) FILTER (l_returnflag = 'R' AND l_linenumber = 1) AS false_callers, count(*) FILTER (l_tax = 0) AS missing_docs FROM lineitem GROUP BY l_orderkey)"""


def checks(t):
    flag, n = F.col("l_returnflag"), F.col("l_linenumber")
    return t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.count_if(flag == "A").alias("found"), F.count_if(flag == "N").alias("missing_callees"), F.count_if((flag == "R") & (n > 3)).alias("false_callees"), F.count_if((flag == "R") & (n == 1)).alias("false_callers"), F.count_if(F.col("l_tax") == 0).alias("missing_docs"))


ISSUES = ["summary_empty", "summary_too_brief", "description_empty", "description_too_brief", "missing_purpose", "missing_functionality", "style"]


@query("p17_validation_flags", f"""SELECT c.id, missing_docs = 0 AS is_complete, false_callees + false_callers + missing_callees > 0 AS has_errors, len(list_intersect(issues, ['summary_empty', 'description_empty', 'description_too_brief', 'missing_purpose', 'missing_functionality'])) = 0 AS is_acceptable,
    result <> 'fail' AS is_valid, result = 'fail' OR false_callees > 0 AS requires_iteration FROM {CHECKS} c JOIN (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'fail' WHEN 'O' THEN 'warning' ELSE 'pass' END AS result,
    [x for x in [CASE WHEN o_custkey % 3 = 0 THEN {ISSUES}[1 + o_custkey % 7] END, CASE WHEN o_orderpriority = '5-LOW' THEN 'style' END] if x IS NOT NULL] AS issues FROM orders) o ON o.id = c.id""")
def _(t):
    said = F.when(F.col("o_orderstatus") == "F", "fail").when(F.col("o_orderstatus") == "O", "warning").otherwise("pass")
    issues = F.array_compact(F.array(F.when(F.col("o_custkey") % 3 == 0, F.element_at(F.array(*map(F.lit, ISSUES)), (F.col("o_custkey") % 7 + 1).cast("int"))), F.when(F.col("o_orderpriority") == "5-LOW", "style")))
    orders = t.orders.select(F.col("o_orderkey").alias("id"), said.alias("result"), issues.alias("issues"))
    return r.validation_flags(checks(t).join(orders, "id").withColumn("corrections", F.col("false_callees"))).select("id", "is_complete", "has_errors", "is_acceptable", "is_valid", "requires_iteration")


@query("a5_callee_accuracy", f"""SELECT id, CASE WHEN found + false_callees = 0 THEN 1.0::DOUBLE ELSE found::DOUBLE / (found + false_callees) END AS callee_precision, CASE WHEN found + missing_callees = 0 THEN 1.0::DOUBLE ELSE found::DOUBLE / (found + missing_callees) END AS callee_recall FROM {CHECKS} c""")
def _(t):
    from ..operators.graph import ratio

    return checks(t).select("id", ratio(F.col("found"), F.col("found") + F.col("false_callees"), 1.0).alias("callee_precision"), ratio(F.col("found"), F.col("found") + F.col("missing_callees"), 1.0).alias("callee_recall"))


@query("c12_final_edges", "SELECT component_id, caller, callee FROM {stream_a} a WHERE component_id IN (SELECT component_id FROM {stream_b} b)")
def _(t):
    return t.stream_a.join(t.stream_b.select("component_id").distinct(), "component_id", "left_semi").select("component_id", "caller", "callee")


@query("c13_explode_sections", "SELECT l_orderkey AS component_id, concat('p', l_partkey) AS caller, concat('o', l_orderkey) AS callee FROM lineitem UNION ALL SELECT l_orderkey, concat('o', l_orderkey), concat('s', l_suppkey) FROM lineitem")
def _(t):
    nested = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.concat(F.lit("p"), "l_partkey")).alias("callers"), F.collect_list(F.concat(F.lit("s"), "l_suppkey")).alias("callees"))
    own = F.concat(F.lit("o"), F.col("l_orderkey").cast("string"))
    edges = F.concat(F.transform("callers", lambda c: F.struct(c.alias("caller"), own.alias("callee"))), F.transform("callees", lambda c: F.struct(own.alias("caller"), c.alias("callee"))))
    return nested.select(F.col("l_orderkey").alias("component_id"), F.explode(edges).alias("e")).select("component_id", "e.caller", "e.callee")


@query("c15_to_verify", f"SELECT DISTINCT component_id FROM {SIDES} s WHERE in_a <> in_b")
def _(t):
    return r.edge_sides(t.stream_a, t.stream_b).filter("in_a <> in_b").select("component_id").distinct()


@query("c17_apply_correction", """SELECT o_orderkey AS id, coalesce(max(l_linestatus) FILTER (l_linenumber = 1), o_orderstatus) AS status, coalesce(max(l_shipdate) FILTER (l_linenumber = 2), o_orderdate) AS due, coalesce(max(l_returnflag) FILTER (l_linenumber = 3), o_orderpriority) AS priority
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus, o_orderdate, o_orderpriority""")
def _(t):
    """Corrections come as (id, path, value) rows: top-level fields and fields two and three levels down."""
    n = F.col("l_linenumber")
    path = F.when(n == 1, "status").when(n == 2, "plan.due").when(n == 3, "plan.rank.priority").when(n == 4, "plan.no.such")
    value = F.when(n == 1, F.col("l_linestatus")).when(n == 2, F.col("l_shipdate").cast("string")).otherwise(F.col("l_returnflag"))
    corrections = t.lineitem.select(F.col("l_orderkey").alias("id"), path.alias("path"), value.alias("value")).filter("path IS NOT NULL")
    docs = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.struct(F.col("o_orderdate").alias("due"), F.struct(F.col("o_orderpriority").alias("priority")).alias("rank")).alias("plan"))
    return r.corrected(docs, corrections, "id").select("id", "status", F.col("plan.due").alias("due"), F.col("plan.rank.priority").alias("priority"))


THREE = """(SELECT component_id, caller, callee, max(a) = 1 AS a, max(b) = 1 AS b, max(t) = 1 AS t FROM (SELECT *, 1 AS a, 0 AS b, 0 AS t FROM {stream_a} x UNION ALL SELECT *, 0, 1, 0 FROM {stream_b} y UNION ALL SELECT *, 0, 0, 1 FROM {hints} z) GROUP BY ALL)"""


@query("dd1_three_way", f"""WITH k AS (SELECT *, CASE WHEN a AND b AND t THEN 'agreed' WHEN a AND b THEN 'false_edge' WHEN NOT a AND NOT b THEN 'missing_edge' WHEN a THEN 'a_only' ELSE 'b_only' END AS kind FROM {THREE} x)
    SELECT component_id, caller, callee, kind, CASE WHEN kind = 'agreed' THEN 'none' WHEN kind = 'missing_edge' THEN 'critical' WHEN kind = 'false_edge' OR t THEN 'high' ELSE 'medium' END AS severity,
    CASE WHEN kind = 'agreed' THEN 'accept_consensus' WHEN t AND a THEN 'accept_stream_a' WHEN t AND b THEN 'accept_stream_b' WHEN t OR (a AND b) THEN 'accept_ground_truth' WHEN a THEN 'accept_stream_b' ELSE 'accept_stream_a' END AS resolution FROM k""")
def _(t):
    return r.three_way(t.stream_a, t.stream_b, t.hints)


@query("dd1_bucketed", SQL["dd1_three_way"])
def _(t):
    """The same on tables in buckets of components, which are compared where they lie."""
    return r.classified(Streams(t.spark, t.stream_a, t.stream_b, t.hints, buckets=16).sources())


@query("dd5_preference", """SELECT doc_id, CASE WHEN ca - cb > 0.1 THEN 'accept_stream_a' WHEN ca - cb < -0.1 THEN 'accept_stream_b' WHEN length(text_a) > length(text_b) * 1.5 THEN 'accept_stream_a' WHEN length(text_b) > length(text_a) * 1.5 THEN 'accept_stream_b' ELSE 'unchanged' END AS resolution
    FROM (SELECT *, (doc_id % 7)::DOUBLE / 8 AS ca, (doc_id % 5)::DOUBLE / 8 AS cb FROM {pairs} p)""")
def _(t):
    p = t.pairs.withColumns({"confidence_a": (F.col("doc_id") % 7).cast("double") / 8, "confidence_b": (F.col("doc_id") % 5).cast("double") / 8})
    return r.prefer(p).select("doc_id", "resolution")


@query("dd7_rates", f"""SELECT greatest(0, 1 - edges::DOUBLE / (3 * components)) AS match_rate, greatest(0, 1 - missing::DOUBLE / components) AS similarity FROM (SELECT count(*) AS components, sum(only_a + only_b) AS edges, count(*) FILTER (NOT (has_a AND has_b)) AS missing FROM {COMPARED} c)""")
def _(t):
    c = compared(t).agg(F.count(F.lit(1)).alias("components"), F.sum(F.col("only_a") + F.col("only_b")).alias("edges"), F.count_if(~(F.col("has_a") & F.col("has_b"))).alias("missing"))
    return c.select(F.greatest(F.lit(0.0), 1 - F.col("edges").cast("double") / (3 * F.col("components"))).alias("match_rate"), F.greatest(F.lit(0.0), 1 - F.col("missing").cast("double") / F.col("components")).alias("similarity"))


@query("dd8_short_names", """WITH c AS (SELECT concat('m', s_nationkey, '.', s_suppkey % 50) AS component_id, CAST(s_suppkey % 50 AS VARCHAR) AS short FROM supplier), n AS (SELECT short, count(*) AS n FROM c GROUP BY short),
    calls AS (SELECT DISTINCT concat('m', c_nationkey, '.f', c_custkey) AS caller, CAST(c_custkey % 60 AS VARCHAR) AS short FROM customer)
    SELECT caller, calls.short, min(component_id) AS component_id FROM calls JOIN c ON c.short = calls.short JOIN n ON n.short = c.short WHERE n = 1 OR starts_with(component_id, regexp_replace(caller, '\\.[^.]*$', '')) GROUP BY caller, calls.short""")
def _(t):
    components = t.supplier.select(F.concat(F.lit("m"), "s_nationkey", F.lit("."), F.col("s_suppkey") % 50).alias("component_id"))
    calls = t.customer.select(F.concat(F.lit("m"), "c_nationkey", F.lit(".f"), "c_custkey").alias("caller"), (F.col("c_custkey") % 60).cast("string").alias("short")).distinct()
    return r.by_short_name(calls, components)


PARAMETERS = """(SELECT l_orderkey AS component_id, concat('p', l_partkey) AS name, {0} AS type, {1} AS description FROM lineitem WHERE {2})"""
PARAMETERS_A = PARAMETERS.format("max(l_returnflag)", "max(l_linestatus)", "l_linenumber <= 5 GROUP BY l_orderkey, l_partkey")
PARAMETERS_B = PARAMETERS.format("max(CASE WHEN l_quantity > 40 THEN 'X' ELSE l_returnflag END)", "min(l_linestatus)", "l_linenumber >= 3 GROUP BY l_orderkey, l_partkey")


def parameters(t, side):
    n = F.col("l_linenumber")
    rows = t.lineitem.filter(n <= 5 if side == "a" else n >= 3).groupBy(F.col("l_orderkey").alias("component_id"), F.concat(F.lit("p"), "l_partkey").alias("name"))
    return rows.agg((F.max("l_returnflag") if side == "a" else F.max(F.when(F.col("l_quantity") > 40, "X").otherwise(F.col("l_returnflag")))).alias("type"), (F.max("l_linestatus") if side == "a" else F.min("l_linestatus")).alias("description"))


@query("dd3_parameters", f"""SELECT coalesce(a.component_id, b.component_id) AS component_id, coalesce(a.name, b.name) AS name, CASE WHEN a.name IS NULL THEN 'missing_in_a' WHEN b.name IS NULL THEN 'missing_in_b' ELSE 'type_mismatch' END AS kind,
    CASE WHEN a.name IS NULL OR b.name IS NULL THEN 'high' ELSE 'medium' END AS severity, CASE WHEN a.name IS NULL OR b.name IS NULL THEN 0.5::DOUBLE ELSE 0.6::DOUBLE END AS confidence
    FROM {PARAMETERS_A} a FULL JOIN {PARAMETERS_B} b ON a.component_id = b.component_id AND a.name = b.name WHERE a.name IS NULL OR b.name IS NULL OR a.type IS DISTINCT FROM b.type""")
def _(t):
    return r.parameter_differences(parameters(t, "a"), parameters(t, "b"))


@query("dd6_merged_texts", "SELECT doc_id, concat(text_a, chr(10) || chr(10), text_b) AS text, 0.75::DOUBLE AS confidence, 'merge_both' AS resolution FROM {pairs} p")
def _(t):
    return r.merge_texts(t.pairs).select("doc_id", "text", "confidence", "resolution")


@query("dd4_truth_resolution", f"SELECT component_id, caller, callee, 'accept_ground_truth' AS resolution, t AS stays, 0.99::DOUBLE AS confidence FROM {THREE} x WHERE NOT (a AND b AND t)")
def _(t):
    return r.by_truth(r.edges_of_three(t.stream_a, t.stream_b, t.hints)).select("component_id", "caller", "callee", "resolution", "stays", "confidence")


@query("p26_names", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'call_site_line' WHEN 1 THEN 'type_annotation' ELSE 'documentation_content' END AS type, CASE event_id % 4 WHEN 0 THEN 'merge_both' WHEN 1 THEN 'deferred' ELSE 'needs_human_review' END AS resolution,
    CASE event_id % 4 WHEN 0 THEN 'consensus' WHEN 1 THEN 'auto_resolved' ELSE 'unresolved' END AS source, CASE event_id % 4 WHEN 0 THEN 'in_progress' WHEN 1 THEN 'open' WHEN 2 THEN 'open' ELSE 'open' END AS status FROM events""")
def _(t):
    pick = lambda *values: F.element_at(F.array(*map(F.lit, values)), (F.col("event_id") % 4 + 1).cast("int"))
    return t.events.select(
        "event_id", r.named(pick("CALL_SITE_LINE", "type_annotation", "other", None), "type").alias("type"), r.named(pick("Merge_Both", "deferred", "merge", None), "resolution").alias("resolution"),
        r.named(pick("Consensus", "auto_resolved", "me", None), "source").alias("source"), r.ticket_status(pick("validating", "awaiting_review", "junk", None)).alias("status"))
