"""Quality scores: six areas from 0 to 1 and a count of findings for each component."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import ratio

#: area: (column, weight, threshold), in the order that breaks ties.
AREAS = {"qa": (0.15, 0.80), "reconstruction": (0.20, 0.75), "scenario": (0.20, 0.85), "mutation": (0.15, 0.70), "impact": (0.15, 0.75), "test_pass": (0.15, 0.90)}
GRADES = ("A", "B", "C", "F")
MOST_FINDINGS = 5


def overall() -> Column:
    """The weighted quality, rounded to 9 places so that the order of additions doesn't show."""
    terms = [F.col(a) * F.lit(w) for a, (w, _) in AREAS.items()]
    return F.round(sum(terms[1:], terms[0]), 9)


def grade(quality: Column) -> Column:
    return F.when(quality >= 0.95, "A").when(quality >= 0.85, "B").when(quality >= 0.70, "C").otherwise("F")


def graded(scores: DataFrame) -> DataFrame:
    """scores with overall, grade and passing (A or B)."""
    rated = scores.withColumn("overall", overall())
    return rated.withColumn("grade", grade(F.col("overall"))).withColumn("passing", F.col("grade").isin("A", "B"))


def codebase(scores: DataFrame) -> DataFrame:
    """Mean of each area and sum of findings; zeros without components."""
    return scores.agg(*(F.round(F.coalesce(F.avg(a), F.lit(0.0)), 9).alias(a) for a in AREAS), F.coalesce(F.sum("findings"), F.lit(0)).alias("findings"))


def statistics(scores: DataFrame) -> DataFrame:
    """count, mean, lowest, highest, upper median and share that passes of the overall quality.

    The upper median is the value at position n // 2 of the sorted list, counted from 0. Counts by thousandths (at most 1,001
    rows) show which one holds it, counts by value inside that one (at most a million values, by rounding) where: the list
    itself is never in one task.
    """
    rated = graded(scores)
    base = rated.agg(F.count(F.lit(1)).alias("count"), F.round(F.avg("overall"), 6).alias("mean"), F.min("overall").alias("lowest"), F.max("overall").alias("highest"), ratio(F.count_if("passing"), F.count(F.lit(1)), 0.0).alias("passing_rate"))
    rough = F.floor(F.col("overall") * 1000)
    place = _at_place(rated.groupBy(rough.alias("value")).agg(F.count(F.lit(1)).alias("n")), F.floor(F.sum("n").over(Window.partitionBy()) / 2))
    inside = rated.join(F.broadcast(place.select(F.col("value").alias("_rough"), "left")), rough == F.col("_rough"))
    middle = _at_place(inside.groupBy(F.col("overall").alias("value"), "left").agg(F.count(F.lit(1)).alias("n")), F.col("left")).select(F.col("value").alias("upper_median"))
    return base.join(F.broadcast(middle), F.lit(True), "left")


def _at_place(counts: DataFrame, place: Column) -> DataFrame:
    """The row of (value, n) that holds a place, counted from 0 in order of value, and how much of the place is left inside it."""
    before = F.coalesce(F.sum("n").over(Window.orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = counts.withColumns({"_before": before, "_place": place}).filter("_before <= _place AND _place < _before + n")
    return found.select("value", (F.col("_place") - F.col("_before")).alias("left"))


def distribution(scores: DataFrame) -> DataFrame:
    """Components of each grade, 0 for none."""
    counted = graded(scores).groupBy("grade").agg(F.count(F.lit(1)).alias("n"))
    domain = scores.sparkSession.createDataFrame([(g,) for g in GRADES], "grade string")
    return domain.join(counted, "grade", "left").select("grade", F.coalesce("n", F.lit(0)).alias("components"))


def areas(scores: DataFrame) -> DataFrame:
    """A row for each component and area: area, area_order, score, threshold."""
    rows = F.array(*(F.struct(F.lit(a).alias("area"), F.lit(i).alias("area_order"), F.col(a).alias("score"), F.lit(t).alias("threshold")) for i, (a, (_, t)) in enumerate(AREAS.items())))
    return scores.select("component_id", F.explode(rows).alias("a")).select("component_id", "a.*")


def extreme_areas(scores: DataFrame, k: int, weakest: bool) -> DataFrame:
    """The k weakest or strongest areas of each component; ties go by area order. Sorted inside a row: no shuffle."""
    sign = 1 if weakest else -1
    rows = F.array(*(F.struct((sign * F.col(a)).alias("by"), F.lit(i).alias("area_order"), F.lit(a).alias("area"), F.col(a).alias("score")) for i, a in enumerate(AREAS)))
    best = F.slice(F.sort_array(rows), 1, k)
    return scores.select("component_id", F.posexplode(best).alias("rank", "a")).select("component_id", (F.col("rank") + 1).alias("rank"), "a.area", "a.score")


def recommendations(scores: DataFrame) -> DataFrame:
    """Areas below their threshold with gap, priority and rank: the largest gap in whole per cent first, ties by area order."""
    gaps = areas(scores).filter("score < threshold").withColumn("gap", F.col("threshold") - F.col("score"))
    ranked = F.row_number().over(Window.partitionBy("component_id").orderBy(F.bround(F.col("gap") * 100, 0).desc(), "area_order"))
    return gaps.select("component_id", "area", F.round("gap", 9).alias("gap"), F.when(F.col("gap") > 0.2, "critical").when(F.col("gap") > 0.1, "high").otherwise("medium").alias("priority"), ranked.alias("rank"))


def failing(scores: DataFrame) -> DataFrame:
    """component_id and the checks that fail, in area order, then overall and findings."""
    checks = [F.when(F.col(a) < t, F.lit(a)) for a, (_, t) in AREAS.items()]
    checks += [F.when(overall() < 0.85, F.lit("overall")), F.when(F.col("findings") > MOST_FINDINGS, F.lit("findings"))]
    return scores.select("component_id", F.array_compact(F.array(*checks)).alias("failing"))


def best_components(scores: DataFrame, k: int, worst: bool = False) -> DataFrame:
    """The k best or worst components by overall quality, ties by id."""
    rated = graded(scores)
    return rated.orderBy(F.col("overall").asc() if worst else F.col("overall").desc(), "component_id").limit(k).select("component_id", "overall", "grade")


def trend(points: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """For each key: points, average delta, total change and a verdict, over a value in order."""
    w = Window.partitionBy(key).orderBy(order)
    deltas = points.withColumn("_delta", F.col(value) - F.lag(value).over(w))
    out = deltas.groupBy(key).agg(F.count(F.lit(1)).alias("points"), F.round(F.avg("_delta"), 6).alias("average_delta"), F.round(F.max_by(value, order) - F.min_by(value, order), 6).alias("total_change"))
    verdict = F.when(F.col("points") < 2, "insufficient_data").when(F.col("average_delta") > 0.02, "improving").when(F.col("average_delta") < -0.02, "declining").otherwise("stable")
    return out.withColumn("trend", verdict)


def before_after(points: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Each point against the one before it: delta, verdict, and whether the grade rose."""
    w = Window.partitionBy(key).orderBy(order)
    rank = lambda c: F.array_position(F.array(*(F.lit(g) for g in reversed(GRADES))), grade(c))
    paired = points.withColumn("_before", F.lag(value).over(w)).filter("_before IS NOT NULL")
    delta = F.round(F.col(value) - F.col("_before"), 6)
    verdict = F.when(delta > 0.05, "improved").when(delta < -0.05, "regressed").otherwise("unchanged")
    return paired.select(key, order, delta.alias("delta"), verdict.alias("verdict"), (rank(F.col(value)) > rank(F.col("_before"))).alias("grade_improved"))


def category_means(rows: DataFrame) -> DataFrame:
    """Mean of (a + b) / 2 by category."""
    return rows.groupBy("category").agg(F.round(F.avg((F.col("a") + F.col("b")) / 2), 6).alias("mean_score"))


def shared_outcomes(answers: DataFrame) -> DataFrame:
    """Per item: whether both teams were right, both wrong, and the last answer of each (by seq, then pos)."""
    best = answers.groupBy("item_id", "team").agg(F.max_by("is_correct", F.struct("seq", "pos", "is_correct")).alias("right"))
    both = best.groupBy("item_id").agg(F.max(F.when(F.col("team") == "A", F.col("right"))).alias("a"), F.max(F.when(F.col("team") == "B", F.col("right"))).alias("b"))
    return both.select("item_id", "a", "b", F.coalesce(F.col("a") & F.col("b"), F.lit(False)).alias("both_right"), F.coalesce(~F.col("a") & ~F.col("b"), F.lit(False)).alias("both_wrong"))


def latest_by_strategy(executions: DataFrame, names: list[str]) -> DataFrame:
    """A row for each component with the last score of each named strategy, 0 where it has none."""
    last = executions.groupBy("component_id", "strategy").agg(F.max_by("score", F.struct("seq", "score")).alias("score"))
    return last.groupBy("component_id").agg(*(F.coalesce(F.max(F.when(F.col("strategy") == n, F.col("score"))), F.lit(0)).alias(n) for n in names))


def confidence_bucket(confidence: Column) -> Column:
    """high from 95 per cent on, medium from 80, else low."""
    whole = F.floor(confidence * 100)
    return F.when(whole >= 95, "high").when(whole >= 80, "medium").otherwise("low")


def finding_precision(findings: DataFrame) -> DataFrame:
    """(team, valid, total, precision) of findings (team, is_correct)."""
    counted = findings.groupBy("team").agg(F.count_if("is_correct").alias("valid"), F.count(F.lit(1)).alias("total"))
    return counted.withColumn("precision", ratio(F.col("valid"), F.col("total"), 0.0))


def pass_rates(results: DataFrame, *keys: str) -> DataFrame:
    """The share of results (is_correct) that pass, by keys."""
    return results.groupBy(*keys).agg(ratio(F.count_if("is_correct"), F.count(F.lit(1)), 0.0).alias("pass_rate"))


def both_teams(a: Column, b: Column) -> list[Column]:
    """The average score of two teams, and whether both stayed below one half."""
    return [((a + b) / 2).alias("average_score"), ((a < 0.5) & (b < 0.5)).alias("both_failed")]
