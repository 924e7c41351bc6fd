"""Tickets, usage facts and cost: filters, zero-filled statistics, grouping sets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import ratio
from .ordered import digests

TERMINAL = ("applied", "expired")
SEVERITY = ("critical", "high", "medium", "low")


def query(tickets: DataFrame, *, statuses: list[str] | None = None, types: list[str] | None = None, components: list | None = None, priorities: list[str] | None = None, terminal: bool = False) -> DataFrame:
    """Conjunctive optional filters: one that is empty doesn't apply; terminal tickets only on request."""
    for column, values in (("status", statuses), ("type", types), ("component_id", components), ("priority", priorities)):
        if values:
            tickets = tickets.filter(F.col(column).isin(values))
    return tickets if terminal else tickets.filter(~F.col("status").isin(*TERMINAL))


def overdue(tickets: DataFrame, now: str) -> DataFrame:
    """Pending tickets whose timeout has passed."""
    return tickets.filter((F.col("status") == "pending") & F.col("timeout_at").isNotNull() & (F.col("timeout_at") <= F.lit(now).cast("timestamp")))


def at_least(severity: Column, least: str) -> Column:
    """Whether a severity is at least as grave."""
    return severity.isin(*SEVERITY[: SEVERITY.index(least) + 1])


def rebuild_priority(ranked: DataFrame, order: list[Column]) -> DataFrame:
    """High for the first 3, Medium to the 10th, then Low. Only the first 10 rows matter, so they are found by a top-k."""
    first = ranked.orderBy(*order).limit(10).withColumn("_rank", F.row_number().over(Window.orderBy(*order)))
    keys = first.select("ticket_key", F.when(F.col("_rank") <= 3, "High").otherwise("Medium").alias("_p"))
    return ranked.join(F.broadcast(keys), "ticket_key", "left").select("ticket_key", F.coalesce("_p", F.lit("Low")).alias("rebuild_priority"))


def mapped(value: Column, table: dict[str, str], default: str) -> Column:
    """A case-insensitive enum lookup."""
    out = None
    for k, v in table.items():
        out = F.when(F.lower(value) == k, v) if out is None else out.when(F.lower(value) == k, v)
    return out.otherwise(default)


def statistics(tickets: DataFrame, statuses: list[str], types: list[str]) -> DataFrame:
    """Counts by status and by type, 0 for none, and of distinct components and discrepancies, as (dimension, value, n)."""
    counted = tickets.groupBy("status", "type").agg(F.count(F.lit(1)).alias("n"))
    rows = counted.select(F.explode(F.array(F.struct(F.lit("status").alias("dimension"), F.col("status").alias("value")), F.struct(F.lit("type").alias("dimension"), F.col("type").alias("value")))).alias("k"), "n").select("k.*", "n")
    sums = rows.groupBy("dimension", "value").agg(F.sum("n").alias("n"))
    domain = tickets.sparkSession.createDataFrame([("status", s) for s in statuses] + [("type", t) for t in types], "dimension string, value string")
    out = domain.join(sums, ["dimension", "value"], "left").select("dimension", "value", F.coalesce("n", F.lit(0)).alias("n"))
    unique = tickets.agg(F.countDistinct("component_id").alias("components"), F.countDistinct("discrepancy_id").alias("discrepancies"))
    return out.unionAll(unique.unpivot([], ["components", "discrepancies"], "value", "n").select(F.lit("unique").alias("dimension"), "value", "n"))


def ticket_metrics(tickets: DataFrame, components: DataFrame) -> DataFrame:
    """total, components that have tickets, all components, and tickets for one of these (0 without any)."""
    out = tickets.agg(F.count(F.lit(1)).alias("total"), F.countDistinct("component_id").alias("components_with_tickets"))
    out = out.join(F.broadcast(components.agg(F.countDistinct("component_id").alias("components"))), F.lit(True))
    return out.withColumn("rate", ratio(F.col("total"), F.col("components"), 0.0))


def breakdown(tickets: DataFrame, *columns: str) -> DataFrame:
    """(dimension, value, n): tickets by each of some columns, in one pass (grouping sets)."""
    sets = tickets.groupingSets([[c] for c in columns], *columns).agg(F.count(F.lit(1)).alias("n"), *(F.grouping(c).alias(f"_{c}") for c in columns))
    one = lambda pick: F.coalesce(*(F.when(F.col(f"_{c}") == 0, pick(c)) for c in columns))
    return sets.select(one(F.lit).alias("dimension"), one(lambda c: F.col(c).cast("string")).alias("value"), "n")


def severity_of(priority: Column) -> Column:
    """Severity from a priority that begins with its rank."""
    rank = F.substring(priority, 1, 1)
    return F.when(rank == "1", "critical").when(rank == "2", "high").when(rank == "3", "medium").otherwise("low")


def rendered(template: Column, values: dict[str, Column]) -> Column:
    """A template with ${name} replaced by values; names without a value stay as they are, and null values count as none."""
    for name, value in values.items():
        value = value.cast("string")
        template = F.when(value.isNull(), template).otherwise(F.replace(template, F.lit("${" + name + "}"), value))
    return template


def render_tickets(tickets: DataFrame, templates: DataFrame, values: dict[str, Column], default: str) -> DataFrame:
    """tickets with a body, from templates (type, template) by their type; types without a template take the default."""
    known = templates.select(F.col("type").alias("_type"), "template")
    joined = tickets.join(known, F.col("type") == F.col("_type"), "left").drop("_type")
    return joined.withColumn("body", rendered(F.coalesce("template", F.lit(default)), values)).drop("template")


def apply_resolutions(tickets: DataFrame, apply: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """tickets after a caller's function has seen all resolved ones at once: those whose ticket_key it returns are applied."""
    done = apply(tickets.filter("status = 'resolved'")).select("ticket_key").distinct().withColumn("_done", F.lit(True))
    joined = tickets.join(done, "ticket_key", "left")
    return joined.withColumn("status", F.when(F.col("_done") & (F.col("status") == "resolved"), "applied").otherwise(F.col("status"))).drop("_done")


def of_discrepancies(ids: DataFrame, tickets: DataFrame) -> DataFrame:
    """(id, tickets): how many tickets each discrepancy has, 0 for none. Tickets are counted before the join."""
    counted = tickets.groupBy(F.col("discrepancy_id").alias("id")).agg(F.count(F.lit(1)).alias("tickets"))
    return ids.select("id").distinct().join(counted, "id", "left").select("id", F.coalesce("tickets", F.lit(0)).alias("tickets"))


def usage_rollup(usage: DataFrame) -> DataFrame:
    """Grand total, totals by model and by role in one pass (grouping sets); "level" tells them apart."""
    sets = usage.groupingSets([[], ["model"], ["role"]], "model", "role").agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.count(F.lit(1)).alias("calls"), F.grouping("model").alias("_m"), F.grouping("role").alias("_r"))
    level = F.when(F.col("_m") == 0, "model").when(F.col("_r") == 0, "role").otherwise("total")
    return sets.select(level.alias("level"), F.coalesce("model", "role").alias("name"), "prompt_tokens", "completion_tokens", "calls")


def cost(usage: DataFrame, prices: dict[str, tuple[int, int]]) -> DataFrame:
    """Cost by component in millionths of a dollar: prices are dollars a million tokens, in and out, so products are whole."""
    table = usage.sparkSession.createDataFrame([(m, i, o) for m, (i, o) in prices.items()], "model string, price_in long, price_out long")
    priced = usage.join(F.broadcast(table), "model")
    return priced.groupBy("component_id").agg(F.sum(F.col("prompt_tokens") * F.col("price_in") + F.col("completion_tokens") * F.col("price_out")).alias("micro_dollars"))


def enriched(tickets: DataFrame, components: DataFrame) -> DataFrame:
    """Tickets with name and segment of their component, 'unknown' without one."""
    joined = tickets.join(components, "component_id", "left")
    return joined.select("ticket_key", F.coalesce("name", F.lit("unknown")).alias("name"), F.coalesce("segment", F.lit("")).alias("segment"))


def epic(tickets: DataFrame) -> DataFrame:
    """Per component: summed complexity and its tickets, urgent ones first."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct("priority", "seq"))), lambda t: F.concat(F.lit("T-"), t["seq"].cast("string")))
    return tickets.groupBy("component_id").agg(F.sum("complexity").alias("complexity"), F.array_join(listed, ",").alias("tickets"))


def untracked(external: DataFrame, tracked: DataFrame) -> DataFrame:
    """External tickets that aren't tracked yet, with a type from their labels."""
    new = external.join(tracked.select("ticket_key").distinct(), "ticket_key", "left_anti")
    return new.select("ticket_key", F.when(F.array_contains("labels", "rebuild"), "rebuild").otherwise("discrepancy").alias("type"))


def labels(columns: list[Column]) -> Column:
    """Labels without nulls and repeats, in their order."""
    return F.array_distinct(F.array_compact(F.array(*columns)))


def fingerprint(files: DataFrame, group: str) -> DataFrame:
    """md5 over a group's sorted (path, size, time) lines."""
    line = F.concat_ws(":", "path", F.col("size").cast("string"), F.col("mtime").cast("string"))
    return digests(files.select(group, line.alias("line")), group, "line", "|").withColumnRenamed("digest", "fingerprint")
