"""Report queries."""

from pyspark.sql import functions as F

from ..functions import text
from ..operators import graph, history, reconcile, verification
from ..sources import files
from ..sources.scratch import new_folder
from .reconciliation import SIDES
from .registry import query


@query("a24_summary", """SELECT run_id, epoch_us(max(ts)) - epoch_us(min(ts)) AS micros, count(*) AS events, count(DISTINCT component_id) AS components, count(*) FILTER (type = 'iteration_complete') AS iterations, max(iteration) AS last_iteration, count(*) FILTER (type = 'error') AS errors,
    count(*) FILTER (type = 'run_complete' AND status = 'completed') AS completed, sum(blocking)::BIGINT AS tokens, max(seq) AS last_seq, (count(*) FILTER (type = 'error'))::DOUBLE / count(*) AS error_rate, sum(blocking)::DOUBLE / count(DISTINCT component_id) AS tokens_per_component FROM {log} l GROUP BY run_id""")
def _(t):
    return history.run_summary(t.log).withColumn("micros", F.round(F.col("seconds") * 1_000_000).cast("long")).drop("started", "ended", "seconds")


RATED = "(SELECT run_id, iteration, identical::DOUBLE / total AS match_rate, identical::DOUBLE / (total + 4) AS similarity, blocking, discrepancies - resolved AS open_others FROM {iterations} i)"


def per_cent(rate):
    return f"printf('%.1f%%', round_even(({rate}) * 100, 1))"


@query("c7_required_actions", f"""SELECT run_id, iteration, concat_ws('; ', CASE WHEN match_rate < 0.98::DOUBLE THEN concat('Improve call graph match rate by ', {per_cent("0.98::DOUBLE - match_rate")}, ' (current: ', {per_cent("match_rate")}, ', required: ', {per_cent("0.98::DOUBLE")}, ')') END,
    CASE WHEN similarity < 0.95::DOUBLE THEN concat('Improve documentation similarity by ', {per_cent("0.95::DOUBLE - similarity")}, ' (current: ', {per_cent("similarity")}, ', required: ', {per_cent("0.95::DOUBLE")}, ')') END,
    CASE WHEN blocking > 0 THEN concat('Resolve ', blocking, ' blocking discrepancies') END, CASE WHEN open_others > 2 THEN concat('Resolve ', open_others - 2, ' non-blocking discrepancies (current: ', open_others, ', max: 2)') END,
    CASE WHEN blocking = 1 THEN 'Convergence appears stalled - consider manual intervention or adjusting criteria' END, CASE WHEN iteration > 3 THEN 'Metrics are declining - review recent changes and corrections' END) AS actions FROM {RATED} r""")
def _(t):
    rate = lambda n: F.col("identical").cast("double") / n
    rows = t.iterations.withColumns({"match_rate": rate(F.col("total")), "similarity": rate(F.col("total") + 4), "open_others": F.col("discrepancies") - F.col("resolved"), "is_stalled": F.col("blocking") == 1, "is_improving": F.col("iteration") <= 3})
    return reconcile.recommendations(reconcile.required_actions(rows, 0.98, 0.95, 2)).select("run_id", "iteration", F.array_join("recommendations", "; ").alias("actions"))


@query("c16_divergent_payload", f"""SELECT s.component_id, coalesce(string_agg(callee, ',' ORDER BY callee) FILTER (in_a), '') AS edges_a, coalesce(string_agg(callee, ',' ORDER BY callee) FILTER (in_b), '') AS edges_b, count(*) FILTER (in_a <> in_b) AS differences, coalesce(any_value(past), '') AS history
    FROM {SIDES} s LEFT JOIN (SELECT l_orderkey AS component_id, string_agg(concat(l_linenumber, ':', n), ' ' ORDER BY l_linenumber) AS past FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL) GROUP BY l_orderkey) h ON h.component_id = s.component_id
    GROUP BY s.component_id HAVING count(*) FILTER (in_a <> in_b) > 0""")
def _(t):
    past = t.lineitem.filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("component_id"), F.col("l_linenumber").alias("iteration")).agg(F.count(F.lit(1)).alias("differences"))
    return reconcile.divergent_payload(reconcile.edge_sides(t.stream_a, t.stream_b), past)


@query("k4_export_counts", f"SELECT count(*) FILTER (in_a AND in_b) AS consensus, count(*) FILTER (in_a AND NOT in_b) AS only_a, count(*) FILTER (NOT in_a AND in_b) AS only_b FROM {SIDES} s")
def _(t):
    s = reconcile.edge_sides(t.stream_a, t.stream_b)
    return s.agg(F.count_if(F.col("in_a") & F.col("in_b")).alias("consensus"), F.count_if(F.col("in_a") & ~F.col("in_b")).alias("only_a"), F.count_if(~F.col("in_a") & F.col("in_b")).alias("only_b"))


@query("k9_markdown", "SELECT concat('| ', s_suppkey, ' | ', s_name, ' |') AS line FROM supplier")
def _(t):
    return files.markdown_rows(t.supplier.select("s_suppkey", "s_name"))


@query("p22_type_set_blocking", "SELECT event_id, event_type IN ('error', 'purchase') OR value > 45 AS blocks FROM events")
def _(t):
    return t.events.select("event_id", reconcile.blocks(F.col("event_type"), F.col("value") > 45, ["error", "purchase"]).alias("blocks"))


@query("t6_fallback_order", "SELECT concat('c', p_partkey) AS component_id, p_brand AS file_path, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, concat('c', p_partkey)) AS position FROM part")
def _(t):
    return graph.fallback_order(t.part.select(F.concat(F.lit("c"), "p_partkey").alias("component_id"), F.col("p_brand").alias("file_path"), F.col("p_size").alias("line_start")), None)


@query("t6_alphabetical_order", "SELECT p_name AS component_id, '' AS file_path, row_number() OVER (PARTITION BY substring(p_name, 1, 1) ORDER BY p_name) AS position FROM (SELECT DISTINCT p_name FROM part)")
def _(t):
    names = t.part.select(F.col("p_name").alias("component_id")).distinct()
    return graph.fallback_order(names, t.edges.select("caller", "callee").limit(0))


@query("t8_first_callees", "SELECT caller, array_to_string(list_sort(list(DISTINCT callee))[1:20], ',') AS callees FROM {edges} e GROUP BY caller")
def _(t):
    return graph.first_callees(t.edges, 20).select("caller", F.array_join("callees", ",").alias("callees"))


@query("f19_impact_texts", """SELECT event_id, CASE event_type WHEN 'view' THEN concat('Change u', user_id, ' signature: add required parameter ', chr(39), 'options: dict', chr(39)) WHEN 'click' THEN concat('Delete u', user_id, ' entirely') WHEN 'purchase' THEN concat('Rename u', user_id, ' to u', user_id, '_v2') END AS text FROM events""")
def _(t):
    kind = F.when(F.col("event_type") == "view", "signature").when(F.col("event_type") == "click", "removal").when(F.col("event_type") == "purchase", "rename").otherwise("other")
    return t.events.select("event_id", text.impact_text(kind, F.concat(F.lit("pkg.mod.u"), "user_id")).alias("text"))


@query("x6_pipeline", """SELECT o_orderkey AS component_id, coalesce(qa, 0.0) AS qa, coalesce(masked, 0.0) AS masked, round((coalesce(qa, 0.0) + coalesce(masked, 0.0)) / 2, 6) AS overall, round((coalesce(qa, 0.0) + coalesce(masked, 0.0)) / 2, 9) >= 0.6 AS passed
    FROM orders LEFT JOIN (SELECT l_orderkey, round(avg(CASE WHEN l_returnflag = 'A' THEN 1.0::DOUBLE ELSE 0.0 END), 9) AS qa, round(avg(CASE WHEN l_linenumber > 2 THEN l_quantity::DOUBLE / 50 END), 9) AS masked FROM lineitem GROUP BY l_orderkey) s ON l_orderkey = o_orderkey""")
def _(t):
    """Two strategies from a registry, put together by the builder: items of each component, answered and rated."""
    return rated(t)


def rated(t, progress=None):
    items = lambda components, rows: components.join(rows.withColumnRenamed("l_orderkey", "component_id"), "component_id")
    strategies = verification.Registry()
    for name, rows, score in (("qa", t.lineitem, F.when(F.col("answer") == "A", 1.0).otherwise(0.0)), ("masked", t.lineitem.filter("l_linenumber > 2"), F.col("l_quantity").cast("double") / 50)):
        strategies.register(name, verification.Strategy(name, "active", lambda c, rows=rows: items(c, rows), lambda a, score=score: a.withColumn("score", score), lambda rated: rated.filter("score < 0.5")))
    pipeline = verification.Builder(strategies).with_all().with_threshold(0.6).build()
    return pipeline.run(t.orders.select(F.col("o_orderkey").alias("component_id")), lambda strategy, challenge: challenge.withColumn("answer", F.col("l_returnflag")), progress).withColumn("overall", F.round("overall", 6))


@query("x7_observed_figures", """SELECT 'qa' AS name, count(*) AS n, count(*) FILTER (l_returnflag <> 'A') AS few, round(count(*) FILTER (l_returnflag = 'A'), 3)::DOUBLE AS score FROM lineitem
    UNION ALL SELECT 'masked', count(*), count(*) FILTER (l_quantity::DOUBLE / 50 < 0.6::DOUBLE), round(sum(l_quantity::DOUBLE / 50), 3) FROM lineitem WHERE l_linenumber > 2 UNION ALL SELECT 'result', count(*), NULL, NULL FROM orders""")
def _(t):
    """What the run itself counted while its result was written."""
    progress = verification.Progress()
    rated(t, progress).write.parquet(new_folder(t.spark))
    seen = {name: progress.figures(name) for name in progress.names()}
    rows = [(name, f.get("items", f.get("components")), f.get("failed"), None if "score" not in f else round(f["score"], 3)) for name, f in seen.items()]
    return t.spark.createDataFrame(rows, "name string, n long, few long, score double")
