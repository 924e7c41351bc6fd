"""Queries on scores and answers (A3-A4, A7-A16, A29, T1-T4, W4-W5, F17, JN8, JN13, SO6-SO7, C14)."""

from pyspark.sql import functions as F

from ..operators import scores as s
from ..operators.graph import precision_recall
from .registry import query

OVERALL = "round(qa * 0.15 + reconstruction * 0.20 + scenario * 0.20 + mutation * 0.15 + impact * 0.15 + test_pass * 0.15, 9)"
GRADE = "CASE WHEN {q} >= 0.95 THEN 'A' WHEN {q} >= 0.85 THEN 'B' WHEN {q} >= 0.70 THEN 'C' ELSE 'F' END"
DOUBLES = "(SELECT component_id, qa::DOUBLE AS qa, reconstruction::DOUBLE AS reconstruction, scenario::DOUBLE AS scenario, mutation::DOUBLE AS mutation, impact::DOUBLE AS impact, test_pass::DOUBLE AS test_pass, findings FROM {scores} z)"
RATED = f"(SELECT component_id, overall, {GRADE.format(q='overall')} AS grade, overall >= 0.85 AS passing FROM (SELECT component_id, round(qa * 0.15::DOUBLE + reconstruction * 0.20::DOUBLE + scenario * 0.20::DOUBLE + mutation * 0.15::DOUBLE + impact * 0.15::DOUBLE + test_pass * 0.15::DOUBLE, 9) AS overall FROM {DOUBLES} d))"
LONG = f"""(SELECT component_id, area, area_order, score, threshold FROM (SELECT component_id, unnest(['qa', 'reconstruction', 'scenario', 'mutation', 'impact', 'test_pass']) AS area, unnest([0, 1, 2, 3, 4, 5]) AS area_order,
    unnest([qa, reconstruction, scenario, mutation, impact, test_pass]) AS score, unnest([0.8::DOUBLE, 0.8::DOUBLE, 0.85::DOUBLE, 0.75::DOUBLE, 0.85::DOUBLE, 0.9::DOUBLE]) AS threshold FROM {DOUBLES} d))"""


@query("a8_overall_f17_grade", f"SELECT * FROM {RATED} r")
def _(t):
    return s.graded(t.scores).select("component_id", "overall", "grade", "passing")


@query("a9_codebase_scores", f"SELECT {', '.join(f'round(avg({a}), 9) AS {a}' for a in s.AREAS)}, sum(findings)::BIGINT AS findings FROM {DOUBLES} d")
def _(t):
    return s.codebase(t.scores)


@query("a10_statistics", f"""SELECT count(*) AS count, round(avg(overall), 6) AS mean, min(overall) AS lowest, max(overall) AS highest, (count(*) FILTER (passing))::DOUBLE / count(*) AS passing_rate, list_sort(list(overall))[count(*) // 2 + 1] AS upper_median FROM {RATED} r""")
def _(t):
    return s.statistics(t.scores)


@query("a10_distribution", f"SELECT g.grade, count(r.grade) AS components FROM (SELECT unnest(['A', 'B', 'C', 'F']) AS grade) g LEFT JOIN {RATED} r ON r.grade = g.grade GROUP BY g.grade")
def _(t):
    return s.distribution(t.scores)


@query("a29_successful", f"SELECT count(*) FILTER (grade <> 'F') AS successful, count(*) AS components FROM {RATED} r")
def _(t):
    return s.graded(t.scores).agg(F.count_if(F.col("grade") != "F").alias("successful"), F.count(F.lit(1)).alias("components"))


@query("t1_worst_components", f"SELECT component_id, overall, grade FROM {RATED} r ORDER BY overall, component_id LIMIT 10")
def _(t):
    return s.best_components(t.scores, 10, worst=True)


@query("t1_best_components", f"SELECT component_id, overall, grade FROM {RATED} r ORDER BY overall DESC, component_id LIMIT 10")
def _(t):
    return s.best_components(t.scores, 10)


@query("t2_weakest_areas", f"SELECT component_id, rank, area, score FROM (SELECT *, (row_number() OVER (PARTITION BY component_id ORDER BY score, area_order))::INTEGER AS rank FROM {LONG} l) WHERE rank <= 3")
def _(t):
    return s.extreme_areas(t.scores, 3, weakest=True)


@query("t2_strongest_areas", f"SELECT component_id, rank, area, score FROM (SELECT *, (row_number() OVER (PARTITION BY component_id ORDER BY score DESC, area_order))::INTEGER AS rank FROM {LONG} l) WHERE rank <= 2")
def _(t):
    return s.extreme_areas(t.scores, 2, weakest=False)


# What each area must reach.
LIMITS = "[{'area': 'qa', 'least': 0.8}, {'area': 'reconstruction', 'least': 0.75}, {'area': 'scenario', 'least': 0.85}, {'area': 'mutation', 'least': 0.7}, {'area': 'impact', 'least': 0.75}, {'area': 'test_pass', 'least': 0.9}]"


@query("t3_recommendations", f"""SELECT component_id, area, round(gap, 9) AS gap, CASE WHEN gap > 0.2 THEN 'critical' WHEN gap > 0.1 THEN 'high' ELSE 'medium' END AS priority,
    (row_number() OVER (PARTITION BY component_id ORDER BY round_even(gap * 100, 0) DESC, area_order))::INTEGER AS rank
    FROM (SELECT component_id, l.area, area_order, u.least::DOUBLE - score AS gap FROM {LONG} l JOIN (SELECT unnest({LIMITS}) AS u) m ON u.area = l.area WHERE score < u.least::DOUBLE)""")
def _(t):
    return s.recommendations(t.scores)


@query("t4_failing_thresholds", f"""SELECT d.component_id, concat_ws(',', CASE WHEN qa < 0.8 THEN 'qa' END, CASE WHEN reconstruction < 0.75 THEN 'reconstruction' END, CASE WHEN scenario < 0.85 THEN 'scenario' END, CASE WHEN mutation < 0.7 THEN 'mutation' END,
    CASE WHEN impact < 0.75 THEN 'impact' END, CASE WHEN test_pass < 0.9 THEN 'test_pass' END, CASE WHEN overall < 0.85 THEN 'overall' END, CASE WHEN findings > 5 THEN 'findings' END) AS failing FROM {DOUBLES} d JOIN {RATED} r ON r.component_id = d.component_id""")
def _(t):
    return s.failing(t.scores).select("component_id", F.array_join("failing", ",").alias("failing"))


POINTS = "(SELECT run_id, iteration, identical::DOUBLE / total AS quality FROM {iterations} i)"


def points(t):
    return t.iterations.select("run_id", "iteration", (F.col("identical").cast("double") / F.col("total")).alias("quality"))


@query("w4_trend", f"""WITH d AS (SELECT *, quality - lag(quality) OVER (PARTITION BY run_id ORDER BY iteration) AS delta FROM {POINTS} p), g AS (SELECT run_id, count(*) AS points, round(avg(delta), 6) AS average_delta, round(arg_max(quality, iteration) - arg_min(quality, iteration), 6) AS total_change FROM d GROUP BY run_id)
    SELECT *, CASE WHEN points < 2 THEN 'insufficient_data' WHEN average_delta > 0.02 THEN 'improving' WHEN average_delta < -0.02 THEN 'declining' ELSE 'stable' END AS trend FROM g""")
def _(t):
    return s.trend(points(t), "run_id", "iteration", "quality")


@query("w5_before_after", f"""WITH d AS (SELECT *, lag(quality) OVER (PARTITION BY run_id ORDER BY iteration) AS b FROM {POINTS} p), e AS (SELECT *, round(quality - b, 6) AS delta FROM d WHERE b IS NOT NULL)
    SELECT run_id, iteration, delta, CASE WHEN delta > 0.05 THEN 'improved' WHEN delta < -0.05 THEN 'regressed' ELSE 'unchanged' END AS verdict,
    list_position(['F', 'C', 'B', 'A'], {GRADE.format(q='quality')}) > list_position(['F', 'C', 'B', 'A'], {GRADE.format(q='b')}) AS grade_improved FROM e""")
def _(t):
    return s.before_after(points(t), "run_id", "iteration", "quality")


COUNTED = "(SELECT source, count(*) FILTER (actual AND predicted) AS tp, count(*) FILTER (NOT actual AND predicted) AS fp, count(*) FILTER (actual AND NOT predicted) AS fn FROM {judged} j GROUP BY source)"


def rates(counted: str, p: float, r: float, keys: str) -> str:
    return f"""WITH r AS (SELECT *, CASE WHEN tp + fp = 0 THEN {p}::DOUBLE ELSE tp::DOUBLE / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN {r}::DOUBLE ELSE tp::DOUBLE / (tp + fn) END AS recall FROM {counted} c)
    SELECT {keys} tp, fp, fn, precision, recall, CASE WHEN precision + recall = 0 THEN 0.0::DOUBLE ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM r"""


def by_source(t, keep=None):
    j = t.judged if keep is None else t.judged.filter(keep)
    return j.groupBy("source").agg(F.count_if(F.col("actual") & F.col("predicted")).alias("tp"), F.count_if(~F.col("actual") & F.col("predicted")).alias("fp"), F.count_if(F.col("actual") & ~F.col("predicted")).alias("fn"))


@query("a3_precision_recall", rates(COUNTED, 0.0, 0.0, "source,"))
def _(t):
    return precision_recall(by_source(t), 0.0, 0.0)


@query("a4_impact_precision_recall", rates(COUNTED.replace("GROUP BY", "WHERE NOT predicted OR source > 'src4' GROUP BY"), 0.0, 1.0, "source,"))
def _(t):
    return precision_recall(by_source(t, "NOT predicted OR source > 'src4'"), 0.0, 1.0)


@query("a7_micro_average", rates(f"(SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM {COUNTED} c)", 0.0, 0.0, ""))
def _(t):
    return precision_recall(by_source(t).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn")), 0.0, 0.0)


@query("a11_category_means", "SELECT concat('c', l_suppkey % 7) AS category, round(avg((l_quantity + l_linenumber) / 2), 6) AS mean_score FROM lineitem GROUP BY 1")
def _(t):
    return s.category_means(t.lineitem.select(F.concat(F.lit("c"), F.col("l_suppkey") % 7).alias("category"), F.col("l_quantity").alias("a"), F.col("l_linenumber").alias("b")))


@query("a12_team_scores", "SELECT team, round(coalesce(avg(similarity), 0), 6) AS score FROM {answers} a GROUP BY team")
def _(t):
    return t.answers.groupBy("team").agg(F.round(F.coalesce(F.avg("similarity"), F.lit(0.0)), 6).alias("score"))


OUTCOMES = """(WITH l AS (SELECT item_id, team, is_correct, row_number() OVER (PARTITION BY item_id, team ORDER BY seq DESC, pos DESC, is_correct DESC) AS rn FROM {answers} a),
    b AS (SELECT item_id, bool_or(is_correct) FILTER (team = 'A') AS a, bool_or(is_correct) FILTER (team = 'B') AS b FROM l WHERE rn = 1 GROUP BY item_id) SELECT item_id, a, b, coalesce(a AND b, false) AS both_right, coalesce(NOT a AND NOT b, false) AS both_wrong FROM b)"""


@query("jn8_answers_by_item", f"SELECT item_id, a, b FROM {OUTCOMES} o")
def _(t):
    return s.shared_outcomes(t.answers).select("item_id", "a", "b")


@query("a13_shared_outcomes", f"SELECT item_id, both_right, both_wrong FROM {OUTCOMES} o WHERE both_right OR both_wrong")
def _(t):
    return s.shared_outcomes(t.answers).select("item_id", "both_right", "both_wrong").filter("both_right OR both_wrong")


@query("a14_finding_precision", "SELECT team, count(*) FILTER (is_correct) AS valid, count(*) AS total, (count(*) FILTER (is_correct))::DOUBLE / count(*) AS precision FROM {answers} a GROUP BY team")
def _(t):
    return s.finding_precision(t.answers)


@query("a15_test_pass_rate", "SELECT team, category, (count(*) FILTER (is_correct))::DOUBLE / count(*) AS pass_rate FROM {answers} a GROUP BY team, category")
def _(t):
    return s.pass_rates(t.answers, "team", "category")


@query("a16_average_and_failed", "SELECT component_id, (qa + scenario) / 2 AS average_score, qa < 0.5 AND scenario < 0.5 AS both_failed FROM " + DOUBLES + " d")
def _(t):
    return t.scores.select("component_id", *s.both_teams(F.col("qa"), F.col("scenario")))


@query("c14_component_scores", """WITH x AS (SELECT l_orderkey AS component_id, CASE l_returnflag WHEN 'A' THEN 'qa' WHEN 'R' THEN 'masked' ELSE 'scenario' END AS strategy, l_linenumber AS seq, l_quantity::INTEGER AS score FROM lineitem),
    m AS (SELECT component_id, strategy, score FROM (SELECT *, row_number() OVER (PARTITION BY component_id, strategy ORDER BY seq DESC, score DESC) AS rn FROM x) WHERE rn = 1)
    SELECT component_id, coalesce(max(score) FILTER (strategy = 'qa'), 0) AS qa, coalesce(max(score) FILTER (strategy = 'masked'), 0) AS masked, coalesce(max(score) FILTER (strategy = 'scenario'), 0) AS scenario FROM m GROUP BY component_id""")
def _(t):
    strategy = F.when(F.col("l_returnflag") == "A", "qa").when(F.col("l_returnflag") == "R", "masked").otherwise("scenario")
    return s.latest_by_strategy(t.lineitem.select(F.col("l_orderkey").alias("component_id"), strategy.alias("strategy"), F.col("l_linenumber").alias("seq"), F.col("l_quantity").cast("int").alias("score")), ["qa", "masked", "scenario"])


MISSES = "(SELECT l_orderkey AS item, list_sort(list(DISTINCT l_partkey % 50) FILTER (l_linestatus = 'F')) AS a, list_sort(list(DISTINCT l_partkey % 50) FILTER (l_linestatus = 'O')) AS b FROM lineitem GROUP BY l_orderkey)"


def misses(t):
    part = F.col("l_partkey") % 50
    return t.lineitem.groupBy(F.col("l_orderkey").alias("item")).agg(F.collect_set(F.when(F.col("l_linestatus") == "F", part)).alias("a"), F.collect_set(F.when(F.col("l_linestatus") == "O", part)).alias("b"))


@query("so6_commonly_missed", f"SELECT m, count(*) AS items FROM (SELECT item, unnest(list_intersect(a, b)) AS m FROM {MISSES} x) GROUP BY m")
def _(t):
    return misses(t).select("item", F.explode(F.array_intersect("a", "b")).alias("m")).groupBy("m").agg(F.count(F.lit(1)).alias("items"))


@query("so7_missed_by_both", f"SELECT item, array_to_string(list_sort(list_intersect(a, b)), ',') AS missed FROM {MISSES} x WHERE len(list_intersect(a, b)) > 0")
def _(t):
    both = F.sort_array(F.array_intersect("a", "b"))
    return misses(t).filter(F.size(both) > 0).select("item", F.array_join(F.transform(both, lambda x: x.cast("string")), ",").alias("missed"))


@query("jn13_validated_findings", "SELECT l_orderkey AS id, l_partkey AS finding, l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 20) AS valid FROM lineitem WHERE l_returnflag = 'R'")
def _(t):
    valid = t.part.filter("p_size < 20").select(F.col("p_partkey").alias("finding"), F.lit(True).alias("_v"))
    found = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("finding"))
    return found.join(valid, "finding", "left").select("id", "finding", F.coalesce("_v", F.lit(False)).alias("valid"))
