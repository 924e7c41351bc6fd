"""Queries on iteration histories and event logs."""

from pyspark.sql import functions as F

from ..operators import history as h
from .registry import query


@query("w1_trend_series", "SELECT run_id, string_agg(discrepancies::VARCHAR, ',' ORDER BY iteration) AS series FROM {iterations} i GROUP BY run_id")
def _(t):
    pairs = F.sort_array(F.collect_list(F.struct("iteration", "discrepancies")))
    return t.iterations.groupBy("run_id").agg(F.array_join(F.transform(pairs, lambda p: p["discrepancies"].cast("string")), ",").alias("series"))


@query("w2_improving", """SELECT run_id, coalesce(max(CASE WHEN rn = 1 THEN identical END) >= max(CASE WHEN rn = 2 THEN identical END) AND max(CASE WHEN rn = 1 THEN resolved END) >= max(CASE WHEN rn = 2 THEN resolved END), true) AS improving
    FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY iteration DESC) AS rn FROM {iterations} i) WHERE rn <= 2 GROUP BY run_id""")
def _(t):
    return h.improving(t.iterations, "run_id", "iteration", ["identical", "resolved"])


@query("w3_stalled", """SELECT run_id, seq, blocking, min(blocking) OVER w = max(blocking) OVER w AND min(blocking) OVER w > 0 AND count(*) OVER w = 3 AS stalled FROM {log} l WHERE type = 'iteration_complete'
    WINDOW w AS (PARTITION BY run_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def _(t):
    return h.stalled(t.log.filter("type = 'iteration_complete'").select("run_id", "seq", "blocking"), "run_id", ["seq"], "blocking")


@query("w6_history", """SELECT run_id, iteration, identical::DOUBLE / total AS agreement_rate, (sum(discrepancies) OVER w)::BIGINT AS found, (sum(resolved) OVER w)::BIGINT AS resolved, (sum(discrepancies) OVER w - sum(resolved) OVER w)::BIGINT AS open FROM {iterations} i
    WINDOW w AS (PARTITION BY run_id ORDER BY iteration ROWS UNBOUNDED PRECEDING)""")
def _(t):
    return h.running_rates(t.iterations)


@query("w7_latest_entry", "SELECT run_id, max(iteration) AS iteration, arg_max(discrepancies, iteration) AS discrepancies FROM {iterations} i GROUP BY run_id")
def _(t):
    return t.iterations.groupBy("run_id").agg(F.max("iteration").alias("iteration"), F.max_by("discrepancies", "iteration").alias("discrepancies"))


@query("a23_run_totals", "SELECT run_id, sum(discrepancies)::BIGINT AS discrepancies, sum(resolved)::BIGINT AS resolved, sum(blocking)::BIGINT AS tickets, arg_max(discrepancies - resolved, iteration) AS unresolved, max(iteration) AS iterations FROM {iterations} i GROUP BY run_id")
def _(t):
    return h.run_totals(t.iterations)


@query("a20_convergence_counts", """WITH c AS (SELECT component_id, count(*) AS iterations, bool_or(status = 'completed') AS converged, count(*) > 110 AS forced FROM {log} l GROUP BY component_id)
    SELECT *, CASE WHEN converged + forced + failed = 0 THEN 0.0::DOUBLE ELSE converged::DOUBLE / (converged + forced + failed) END AS rate FROM (SELECT count(*) FILTER (converged AND NOT forced) AS converged, count(*) FILTER (forced) AS forced, count(*) FILTER (NOT converged AND NOT forced) AS failed, round(avg(iterations), 6) AS average_iterations, max(iterations) AS max_iterations FROM c)""")
def _(t):
    c = t.log.groupBy("component_id").agg(F.count(F.lit(1)).alias("iterations"), F.bool_or(F.col("status") == "completed").alias("converged"), (F.count(F.lit(1)) > 110).alias("forced"))
    return h.convergence_counts(c)


RUNS = """(SELECT run_id, count(*) FILTER (type = 'component_documented') AS components, count(*) FILTER (type = 'iteration_complete') AS iterations, (count(*) * 3)::DOUBLE AS component_seconds, (count(*) * 5)::DOUBLE AS iteration_seconds,
    200 - count(*) AS left_components, 300 - count(*) AS left_iterations FROM {log} l GROUP BY run_id)"""


@query("a25_progress", f"""SELECT run_id, component_seconds / nullif(components, 0) AS mean_component, iteration_seconds / nullif(iterations, 0) AS mean_iteration, components::DOUBLE / component_seconds AS throughput,
    left_components * (component_seconds / nullif(components, 0)) + left_iterations * (iteration_seconds / nullif(iterations, 0)) AS eta FROM {RUNS} r""")
def _(t):
    n = F.count(F.lit(1))
    runs = t.log.groupBy("run_id").agg(F.count_if(F.col("type") == "component_documented").alias("components"), F.count_if(F.col("type") == "iteration_complete").alias("iterations"), (n * 3).cast("double").alias("component_seconds"), (n * 5).cast("double").alias("iteration_seconds"), (200 - n).alias("left_components"), (300 - n).alias("left_iterations"))
    return h.progress(runs)


@query("l1_processed", "SELECT DISTINCT run_id, stream, component_id FROM {log} l WHERE type = 'component_documented'")
def _(t):
    return h.processed(t.log)


@query("l2_last_iteration", "SELECT run_id, coalesce(max(iteration) FILTER (type = 'iteration_complete'), 0) AS last_iteration FROM {log} l GROUP BY run_id")
def _(t):
    return h.last_iteration(t.log)


@query("l3_run_status", "SELECT run_id, arg_max(status, seq) FILTER (type = 'run_complete') AS status FROM {log} l GROUP BY run_id")
def _(t):
    return h.run_status(t.log)


@query("l4_replay", """WITH c AS (SELECT run_id, max(seq) FILTER (type = 'iteration_complete') AS ls, max(iteration) FILTER (type = 'iteration_complete') AS li FROM {log} l GROUP BY run_id)
    SELECT l.run_id, greatest(coalesce(max(li) + 1, 1), coalesce(max(iteration) FILTER (type = 'component_documented' AND (ls IS NULL OR seq > ls)), 1))::INTEGER AS current_iteration, count(*) FILTER (type = 'error') AS errors, count(*) FILTER (type = 'component_documented') AS documented, coalesce(max(li), 0) AS last_iteration
    FROM {log} l JOIN c ON c.run_id = l.run_id GROUP BY l.run_id""")
def _(t):
    return h.replay(t.log)


@query("l5_last_outputs", "SELECT component_id, stream, arg_max(concat_ws('/', run_id, component_id, seq), seq) AS output_path FROM {log} l WHERE type = 'component_documented' GROUP BY component_id, stream")
def _(t):
    return h.last_outputs(t.log)


RESUMABLE = """(SELECT * FROM (SELECT run_id, count(*) FILTER (type = 'run_start') AS starts, arg_max(status, seq) FILTER (type = 'run_complete') AS status, count(DISTINCT component_id) FILTER (type = 'component_documented') AS components, max(seq) AS last_seq FROM {log} l GROUP BY run_id) WHERE starts > 0 AND (status IS NULL OR status = 'failed'))"""


@query("l6_resumable_runs", f"SELECT run_id, status, components, last_seq FROM {RESUMABLE} r")
def _(t):
    return h.resumable(t.log)


@query("t7_resumable_order", f"SELECT run_id, row_number() OVER (ORDER BY components DESC, last_seq DESC) AS position FROM {RESUMABLE} r")
def _(t):
    from pyspark.sql import Window

    return h.resumable(t.log).select("run_id", F.row_number().over(Window.orderBy(F.col("components").desc(), F.col("last_seq").desc())).cast("long").alias("position"))


@query("l8_upsert_outputs", "SELECT component_id, stream, arg_max(status, seq) AS status, max(seq) AS last_seq, sum(blocking)::BIGINT AS tokens FROM {log} l GROUP BY component_id, stream")
def _(t):
    return h.upsert(t.log, ["component_id", "stream"], "seq", "blocking")


@query("l9_phases", """SELECT run_id, s.seq AS start_seq, seq AS end_seq, type AS ended_by, status = 'completed' AS success, epoch_us(ts) - epoch_us(s.ts) AS duration_us
    FROM (SELECT *, max(CASE WHEN type = 'run_start' THEN {'seq': seq, 'ts': ts} END) OVER (PARTITION BY run_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM {log} l) WHERE type IN ('iteration_complete', 'run_complete')""")
def _(t):
    return h.phases(t.log, ["run_start"], ["iteration_complete", "run_complete"])


@query("l10_latest_status", "SELECT component_id, arg_max(status, seq) AS status, count(*) AS transitions FROM {log} l GROUP BY component_id")
def _(t):
    return t.log.groupBy("component_id").agg(F.max_by("status", "seq").alias("status"), F.count(F.lit(1)).alias("transitions"))


@query("k8_retention", "SELECT run_id, seq FROM (SELECT run_id, seq, row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) AS rn FROM {log} l WHERE type = 'iteration_complete') WHERE rn > 10")
def _(t):
    return h.retained(t.log.filter("type = 'iteration_complete'").select("run_id", "seq"), "run_id", "seq", 10)


@query("c9_continue", "SELECT run_id, max(iteration) < 5 AND arg_max(discrepancies, iteration) > 0 AS go_on FROM {iterations} i GROUP BY run_id")
def _(t):
    return h.goes_on(t.iterations, 5)


@query("f18_final_status", """SELECT run_id, iteration, CASE WHEN discrepancies = 0 THEN 'converged' WHEN identical::DOUBLE / total >= 0.5 THEN 'partially_converged' ELSE 'divergent' END AS status, iteration >= 5 AND discrepancies > 0 AS escalate FROM {iterations} i""")
def _(t):
    rated = t.iterations.withColumn("match_rate", F.col("identical").cast("double") / F.col("total"))
    return rated.select("run_id", "iteration", h.final_status(F.col("discrepancies"), F.col("match_rate")).alias("status"), h.escalates(F.col("iteration"), F.col("discrepancies"), 5).alias("escalate"))
