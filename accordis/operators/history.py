"""Ordered histories: iterations of runs, append-only event logs and their replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import ratio


def improving(points: DataFrame, key: str, order: str, values: list[str]) -> DataFrame:
    """Whether the last point is at least the one before it in all values; true with fewer than two."""
    last = Window.partitionBy(key).orderBy(F.col(order).desc())
    two = points.withColumn("_rn", F.row_number().over(last)).filter("_rn <= 2")
    rose = [F.max(F.when(F.col("_rn") == 1, F.col(v))) >= F.max(F.when(F.col("_rn") == 2, F.col(v))) for v in values]
    every = rose[0]
    for r in rose[1:]:
        every = every & r
    return two.groupBy(key).agg(F.coalesce(every, F.lit(True)).alias("improving"))


def stalled(points: DataFrame, key: str, order: list[str], value: str, window: int = 3) -> DataFrame:
    """points with stalled: the last `window` values are equal and positive."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(1 - window, 0)
    same = (F.min(value).over(w) == F.max(value).over(w)) & (F.min(value).over(w) > 0) & (F.count(F.lit(1)).over(w) == window)
    return points.withColumn("stalled", same)


def running_rates(points: DataFrame) -> DataFrame:
    """Iteration history with rate, running discrepancies and what is still open after each."""
    w = Window.partitionBy("run_id").orderBy("iteration").rowsBetween(Window.unboundedPreceding, 0)
    total, done = F.sum("discrepancies").over(w), F.sum("resolved").over(w)
    return points.select("run_id", "iteration", ratio(F.col("identical"), F.col("total"), 1.0).alias("agreement_rate"), total.alias("found"), done.alias("resolved"), (total - done).alias("open"))


def run_totals(points: DataFrame) -> DataFrame:
    """Sums over a run's iterations; unresolved is the last iteration's."""
    return points.groupBy("run_id").agg(F.sum("discrepancies").alias("discrepancies"), F.sum("resolved").alias("resolved"), F.sum("blocking").alias("tickets"), F.max_by(F.col("discrepancies") - F.col("resolved"), "iteration").alias("unresolved"), F.max("iteration").alias("iterations"))


def convergence_counts(components: DataFrame) -> DataFrame:
    """converged, forced and failed (forced first), rate, mean and most iterations, from (converged, forced, iterations)."""
    forced, converged = F.col("forced"), F.col("converged") & ~F.col("forced")
    out = components.agg(F.count_if(converged).alias("converged"), F.count_if(forced).alias("forced"), F.count_if(~F.col("converged") & ~forced).alias("failed"), F.round(F.coalesce(F.avg("iterations"), F.lit(0.0)), 6).alias("average_iterations"), F.coalesce(F.max("iterations"), F.lit(0)).alias("max_iterations"))
    return out.withColumn("rate", ratio(F.col("converged"), F.col("converged") + F.col("forced") + F.col("failed"), 0.0))


def processed(log: DataFrame) -> DataFrame:
    """Distinct documented (run_id, stream, component_id)."""
    return log.filter((F.col("type") == "component_documented") & F.col("stream").isin("A", "B")).select("run_id", "stream", "component_id").distinct()


def last_iteration(log: DataFrame) -> DataFrame:
    return log.groupBy("run_id").agg(F.coalesce(F.max(F.when(F.col("type") == "iteration_complete", F.col("iteration"))), F.lit(0)).alias("last_iteration"))


def run_status(log: DataFrame) -> DataFrame:
    """Status of the last run_complete, null without one."""
    done = F.col("type") == "run_complete"
    return log.groupBy("run_id").agg(F.max_by(F.when(done, F.col("status")), F.when(done, F.col("seq"))).alias("status"))


def replay(log: DataFrame) -> DataFrame:
    """The state after each run's log: current_iteration, errors, documented, last_iteration.

    In closed form: after the last iteration_complete the iteration is the highest completed one plus 1, and components
    seen later may only raise it. The run's fold needs no order beyond two maxima.
    """
    complete = F.col("type") == "iteration_complete"
    runs = log.groupBy("run_id").agg(F.max(F.when(complete, F.col("seq"))).alias("_ls"), F.max(F.when(complete, F.col("iteration"))).alias("_li"))
    joined = log.join(runs.withColumnRenamed("run_id", "_run"), F.col("run_id") == F.col("_run"))
    later = (F.col("type") == "component_documented") & (F.col("_ls").isNull() | (F.col("seq") > F.col("_ls")))
    out = joined.groupBy("run_id").agg(F.max("_li").alias("_li"), F.max(F.when(later, F.col("iteration"))).alias("_seen"), F.count_if(F.col("type") == "error").alias("errors"), F.count_if(F.col("type") == "component_documented").alias("documented"))
    current = F.greatest(F.coalesce(F.col("_li") + 1, F.lit(1)), F.coalesce("_seen", F.lit(1)))
    return out.select("run_id", current.cast("int").alias("current_iteration"), "errors", "documented", F.coalesce("_li", F.lit(0)).alias("last_iteration"))


def last_outputs(log: DataFrame) -> DataFrame:
    """The last output of each (component, stream)."""
    path = F.concat_ws("/", F.col("run_id").cast("string"), "component_id", F.col("seq").cast("string"))
    return log.filter("type = 'component_documented'").groupBy("component_id", "stream").agg(F.max_by(path, "seq").alias("output_path"))


def resumable(log: DataFrame) -> DataFrame:
    """Runs that started and whose last run_complete is absent or failed, with their progress."""
    done = F.col("type") == "run_complete"
    runs = log.groupBy("run_id").agg(F.count_if(F.col("type") == "run_start").alias("starts"), F.max_by(F.when(done, F.col("status")), F.when(done, F.col("seq"))).alias("status"), F.countDistinct(F.when(F.col("type") == "component_documented", F.col("component_id"))).alias("components"), F.max("seq").alias("last_seq"))
    return runs.filter("starts > 0 AND (status IS NULL OR status = 'failed')").select("run_id", "status", "components", "last_seq")


def phases(log: DataFrame, starts: list[str], stops: list[str]) -> DataFrame:
    """Each stop of a run's phase with the last start before it: a restart overwrites the start. A stop that follows another one counts
    from the same start; one without any start has no duration. success says whether the stop's status is completed."""
    w = Window.partitionBy("run_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    begun = F.last(F.when(F.col("type").isin(starts), F.struct("seq", "ts")), ignorenulls=True).over(w)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    ended = log.withColumn("_begun", begun).filter(F.col("type").isin(stops))
    return ended.select("run_id", F.col("_begun.seq").alias("start_seq"), F.col("seq").alias("end_seq"), F.col("type").alias("ended_by"), (F.col("status") == "completed").alias("success"), (micros("ts") - micros("_begun.ts")).alias("duration_us"))


def run_summary(log: DataFrame) -> DataFrame:
    """A row for each run: timing, events, components, iterations, errors, how it ended, and rates."""
    n = lambda kind: F.count_if(F.col("type") == kind)
    out = log.groupBy("run_id").agg(
        F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("events"), F.countDistinct("component_id").alias("components"), n("iteration_complete").alias("iterations"),
        F.max("iteration").alias("last_iteration"), n("error").alias("errors"), F.count_if((F.col("type") == "run_complete") & (F.col("status") == "completed")).alias("completed"), F.sum("blocking").alias("tokens"), F.max("seq").alias("last_seq"))
    seconds = (F.unix_micros(F.col("ended").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))) / 1_000_000
    return out.withColumns({"seconds": seconds, "error_rate": F.col("errors").cast("double") / F.col("events"), "tokens_per_component": F.col("tokens").cast("double") / F.col("components")})


def retained(snapshots: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The snapshots that go because n newer ones exist."""
    return snapshots.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))).filter(F.col("_rn") > n).drop("_rn")


def upsert(outputs: DataFrame, keys: list[str], order: str, tokens: str) -> DataFrame:
    """The last output of each key, with all tokens ever spent on it (re-adding adds its tokens again)."""
    return outputs.groupBy(*keys).agg(F.max_by("status", order).alias("status"), F.max(order).alias("last_seq"), F.sum(tokens).alias("tokens"))


def progress(runs: DataFrame) -> DataFrame:
    """Mean component and iteration seconds, throughput and remaining seconds, from counts and sums per run."""
    return runs.select("run_id", F.try_divide("component_seconds", F.col("components")).alias("mean_component"), F.try_divide("iteration_seconds", F.col("iterations")).alias("mean_iteration"), F.try_divide(F.col("components").cast("double"), "component_seconds").alias("throughput"),
        (F.col("left_components") * F.try_divide("component_seconds", F.col("components")) + F.col("left_iterations") * F.try_divide("iteration_seconds", F.col("iterations"))).alias("eta"))


def goes_on(iterations: DataFrame, most: int) -> DataFrame:
    """(run_id, go_on): whether a run has iterations left and its last one left discrepancies."""
    return iterations.groupBy("run_id").agg(((F.max("iteration") < most) & (F.max_by("discrepancies", "iteration") > 0)).alias("go_on"))


def final_status(discrepancies: Column, match_rate: Column) -> Column:
    """How a run ended: converged, partially (half of it or more agrees) or not."""
    return F.when(discrepancies == 0, "converged").when(match_rate >= 0.5, "partially_converged").otherwise("divergent")


def escalates(iteration: Column, discrepancies: Column, most: int) -> Column:
    """Whether a run has used up its iterations with discrepancies left."""
    return (iteration >= most) & (discrepancies > 0)


def success_rates(log: DataFrame) -> DataFrame:
    """(run_id, success_rate, documentation_rate): events that are no errors, and components that were documented, of all."""
    documented = F.countDistinct(F.when(F.col("type") == "component_documented", F.col("component_id")))
    return log.groupBy("run_id").agg(ratio(F.count_if(F.col("type") != "error"), F.count(F.lit(1)), 0.0).alias("success_rate"), ratio(documented, F.countDistinct("component_id"), 0.0).alias("documentation_rate"))
