"""Reconciling two descriptions (streams A and B) of the same components, with a third source as a hint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import ratio

KEY = ["component_id", "caller", "callee"]
AGREEMENT, CONFIDENT, MAX_ITERATIONS = 0.95, 0.7, 5
# Types of discrepancy that static analysis can settle.
CALL_GRAPH_TYPES = ("call_graph_edge", "call_site_line", "call_type_mismatch")


# Names that types, resolutions, their sources and a ticket's status may have.
NAMES = {
    "type": ("call_graph_edge", "call_site_line", "call_type_mismatch", "documentation_content", "parameter_description", "return_description", "exception_documentation", "missing_parameter", "missing_exception", "type_annotation"),
    "resolution": ("accept_stream_a", "accept_stream_b", "accept_ground_truth", "accept_consensus", "merge_both", "needs_human_review", "deferred"),
    "source": ("consensus", "ground_truth_hint", "human_review", "auto_resolved", "unresolved"),
}
OTHERWISE = {"type": "documentation_content", "resolution": "needs_human_review", "source": "unresolved"}
STATUSES = {"open": "open", "in_progress": "in_progress", "documenting": "in_progress", "validating": "in_progress", "comparing": "in_progress", "awaiting_review": "open", "resolved": "resolved", "closed": "closed"}


def named(value: Column, what: str) -> Column:
    """value as one of the NAMES of a type, resolution or source, without regard to case; the default for any other and for null."""
    return F.when(F.lower(value).isin(*NAMES[what]), F.lower(value)).otherwise(OTHERWISE[what])


def ticket_status(status: Column) -> Column:
    """A component's status as that of its ticket: open for others and for null."""
    return F.coalesce(*(F.when(status == k, v) for k, v in STATUSES.items()), F.lit("open"))


def edge_sides(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct edges of each component with in_a and in_b. Both sides meet in one aggregation, so keys shuffle once."""
    both = a.select(*KEY, F.lit(1).alias("a"), F.lit(0).alias("b")).unionAll(b.select(*KEY, F.lit(0).alias("a"), F.lit(1).alias("b")))
    return both.groupBy(*KEY).agg((F.max("a") == 1).alias("in_a"), (F.max("b") == 1).alias("in_b"))


def compare_streams(a: DataFrame, b: DataFrame, documented_a: DataFrame, documented_b: DataFrame) -> DataFrame:
    """For each component that a stream documents (component_id), with edges or without: which has it, counts of common edges and
    of those of one side only. A component with edges counts as documented."""
    edges = edge_sides(a, b).select("component_id", "in_a", "in_b", F.lit(1).alias("_edge"))
    has = [d.select("component_id", F.lit(x).alias("in_a"), F.lit(not x).alias("in_b"), F.lit(0).alias("_edge")) for d, x in ((documented_a, True), (documented_b, False))]
    counted = lambda x: F.count_if((F.col("_edge") == 1) & x)
    return edges.unionAll(has[0]).unionAll(has[1]).groupBy("component_id").agg(
        F.bool_or("in_a").alias("has_a"), F.bool_or("in_b").alias("has_b"), counted(F.col("in_a") & F.col("in_b")).alias("common"),
        counted(F.col("in_a") & ~F.col("in_b")).alias("only_a"), counted(~F.col("in_a") & F.col("in_b")).alias("only_b"))


def common_components(compared: DataFrame) -> DataFrame:
    """Components of both streams, with whether their edges are the same."""
    return compared.filter("has_a AND has_b").withColumn("identical", (F.col("only_a") == 0) & (F.col("only_b") == 0)).drop("has_a", "has_b")


def agreement(common: DataFrame) -> DataFrame:
    """components, identical, agreement_rate (1 without components) and converged (rate of 0.95 or more)."""
    counted = common.agg(F.count(F.lit(1)).alias("components"), F.count_if("identical").alias("identical"))
    return counted.withColumn("agreement_rate", ratio(F.col("identical"), F.col("components"), 1.0)).withColumn("converged", F.col("agreement_rate") >= AGREEMENT)


def missing_components(compared: DataFrame) -> DataFrame:
    """A discrepancy, resolved for the side that has it, for each component that one stream lacks."""
    side = F.when(F.col("has_b"), "accept_stream_b").otherwise("accept_stream_a")
    return compared.filter("NOT (has_a AND has_b)").select("component_id", F.when(F.col("has_b"), "missing_in_a").otherwise("missing_in_b").alias("type"), side.alias("resolution"), F.lit(0.9).alias("confidence"))


def stream_status(common: DataFrame) -> DataFrame:
    """agreement() with the number of differing components; the ids are rows of status_ids()."""
    out = agreement(common)
    return out.select("components", "identical", (F.col("components") - F.col("identical")).alias("differing"), "agreement_rate", "converged")


def status_ids(common: DataFrame) -> DataFrame:
    """component_id, status (identical or different) and the number of edges that one side lacks."""
    return common.select("component_id", F.when(F.col("identical"), "identical").otherwise("different").alias("status"), (F.col("only_a") + F.col("only_b")).alias("edges_apart"))


# Issues that make a description unacceptable.
CRITICAL_ISSUES = ("summary_empty", "description_empty", "description_too_brief", "missing_purpose", "missing_functionality")


def per_cent(rate: Column) -> Column:
    """A rate as text with one decimal, halves to even."""
    return F.format_string("%.1f%%", F.bround(rate * 100, 1))


def required_actions(rows: DataFrame, least_match: float, least_similarity: float, most_open: int) -> DataFrame:
    """rows (match_rate, similarity, blocking, open_others) with `actions`: what keeps each from converging, as texts."""

    def below(name: str, rate: Column, least: float) -> Column:
        text = F.concat(F.lit(f"Improve {name} by "), per_cent(F.lit(least) - rate), F.lit(" (current: "), per_cent(rate), F.lit(", required: "), per_cent(F.lit(least)), F.lit(")"))
        return F.when(rate < least, text)

    others = F.col("open_others")
    many = F.concat(F.lit("Resolve "), others - most_open, F.lit(" non-blocking discrepancies (current: "), others, F.lit(f", max: {most_open})"))
    found = [below("call graph match rate", F.col("match_rate"), least_match), below("documentation similarity", F.col("similarity"), least_similarity),
             F.when(F.col("blocking") > 0, F.concat(F.lit("Resolve "), F.col("blocking"), F.lit(" blocking discrepancies"))), F.when(others > most_open, many)]
    return rows.withColumn("actions", F.array_compact(F.array(*found)))


def recommendations(rows: DataFrame) -> DataFrame:
    """rows of required_actions() with is_stalled and is_improving: the actions and what the trend adds, as `recommendations`."""
    stalled = F.when(F.col("is_stalled"), "Convergence appears stalled - consider manual intervention or adjusting criteria")
    declining = F.when(~F.col("is_improving"), "Metrics are declining - review recent changes and corrections")
    return rows.withColumn("recommendations", F.concat("actions", F.array_compact(F.array(stalled, declining))))


def blocks(type_: Column, flag: Column, blocking_types: list[str]) -> Column:
    """Whether a discrepancy blocks: by its type, or by its own flag."""
    return F.coalesce(type_.isin(blocking_types), F.lit(False)) | F.coalesce(flag, F.lit(False))


def divergent_payload(sides: DataFrame, history: DataFrame) -> DataFrame:
    """For each component whose streams differ: the edges of each, how many differ, and its history (component_id, iteration, differences) in order, as texts."""
    listed = lambda side: F.array_join(F.sort_array(F.collect_list(F.when(F.col(side), F.col("callee")))), ",")
    grouped = sides.groupBy("component_id").agg(listed("in_a").alias("edges_a"), listed("in_b").alias("edges_b"), F.count_if(F.col("in_a") != F.col("in_b")).alias("differences")).filter("differences > 0")
    past = history.groupBy("component_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("iteration", "differences"))), lambda h: F.concat_ws(":", h["iteration"].cast("string"), h["differences"].cast("string"))), " ").alias("history"))
    return grouped.join(past, "component_id", "left").withColumn("history", F.coalesce("history", F.lit("")))


def validation_flags(rows: DataFrame) -> DataFrame:
    """Flags of validated components: missing_docs, false_callees, false_callers, missing_callees and corrections are counts, issues
    an array of names and result pass, warning or fail. Missing callers are no errors."""
    return rows.withColumns({
        "is_complete": F.col("missing_docs") == 0, "has_errors": F.col("false_callees") + F.col("false_callers") + F.col("missing_callees") > 0,
        "is_acceptable": ~F.arrays_overlap("issues", F.array(*map(F.lit, CRITICAL_ISSUES))), "is_valid": F.col("result") != "fail",
        "requires_iteration": (F.col("result") == "fail") | (F.col("corrections") > 0)})


def dependency_context(edges: DataFrame, *sources: DataFrame) -> DataFrame:
    """(caller, callee, context) of callees that a source (component_id, context) knows; the first source that does counts."""
    ranked = [s.select(F.col("component_id").alias("callee"), F.struct(F.lit(i).alias("source"), "context").alias("found")) for i, s in enumerate(sources)]
    known = ranked[0]
    for more in ranked[1:]:
        known = known.unionAll(more)
    known = known.filter("found.context IS NOT NULL").groupBy("callee").agg(F.min("found").alias("found"))
    return edges.select("caller", "callee").distinct().join(known, "callee").select("caller", "callee", F.col("found.context").alias("context"))


def corrected(docs: DataFrame, corrections: DataFrame, key: str) -> DataFrame:
    """docs with the values of corrections (key, path, value as text) set. A path names a field, nested ones by dots; of several
    corrections of one field the largest value counts, and paths that docs don't have change nothing."""

    def leaves(schema: T.StructType, above: str = "") -> list[tuple[str, T.DataType]]:
        return [x for f in schema.fields if above or f.name != key for x in (leaves(f.dataType, f"{above}{f.name}.") if isinstance(f.dataType, T.StructType) else [(above + f.name, f.dataType)])]

    known = leaves(docs.schema)
    values = corrections.groupBy(key).pivot("path", [path for path, _ in known]).agg(F.max("value"))
    values = values.select(F.col(key).alias("_key"), *(F.col(f"`{path}`").alias(f"_{i}") for i, (path, _) in enumerate(known)))
    joined = docs.join(values, F.col(key) == F.col("_key"), "left")
    for i, (path, kind) in enumerate(known):
        top, _, below = path.partition(".")
        value = F.coalesce(F.col(f"_{i}").cast(kind), F.col(path))
        joined = joined.withColumn(top, F.col(top).withField(below, value) if below else value)
    return joined.select(docs.columns)


def parameter_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Parameters (component_id, name, type) that one side lacks (high, 0.5) or that differ in type (medium, 0.6). Both sides meet in one aggregation."""
    side = lambda p, name: p.select("component_id", "name", F.lit(name).alias("side"), "type")
    met = side(a, "a").unionAll(side(b, "b")).groupBy("component_id", "name").agg(*(F.count_if(F.col("side") == s).alias(f"n_{s}") for s in "ab"), *(F.max(F.when(F.col("side") == s, F.col("type"))).alias(f"type_{s}") for s in "ab"))
    kind = F.when(F.col("n_a") == 0, "missing_in_a").when(F.col("n_b") == 0, "missing_in_b").when(~F.col("type_a").eqNullSafe(F.col("type_b")), "type_mismatch")
    found = met.withColumn("kind", kind).filter("kind IS NOT NULL")
    apart = F.col("kind") == "type_mismatch"
    return found.select("component_id", "name", "kind", F.when(apart, "medium").otherwise("high").alias("severity"), F.when(apart, 0.6).otherwise(0.5).alias("confidence"))


def merge_texts(rows: DataFrame) -> DataFrame:
    """Resolution by merging: both texts, a blank line between them, with confidence 0.75."""
    return rows.withColumns({"text": F.concat_ws("\n\n", "text_a", "text_b"), "confidence": F.lit(0.75), "resolution": F.lit("merge_both")})


def by_truth(edges: DataFrame) -> DataFrame:
    """Resolution by the third source, with confidence 0.99: what it has stays, what it lacks goes. Edges that all three have need none."""
    open_ones = edges.filter("NOT (a = 1 AND b = 1 AND t = 1)")
    return open_ones.withColumns({"resolution": F.lit("accept_ground_truth"), "stays": F.col("t") == 1, "confidence": F.lit(0.99)})


def edges_of_three(a: DataFrame, b: DataFrame, truth: DataFrame) -> DataFrame:
    """Distinct edges with a, b and t: 1 where the source has the edge. All three meet in one aggregation."""
    rows = [df.select(*KEY, *(F.lit(int(i == j)).alias(n) for j, n in enumerate("abt"))) for i, df in enumerate((a, b, truth))]
    return rows[0].unionAll(rows[1]).unionAll(rows[2]).groupBy(*KEY).agg(*(F.max(n).alias(n) for n in "abt"))


def hinted(edges: DataFrame, hints: DataFrame) -> DataFrame:
    """edges with hint: true or false by the third source, null if that has nothing on the component."""
    known = hints.select("component_id").distinct().withColumn("_known", F.lit(True))
    backed = hints.select(*KEY).distinct().withColumn("_backed", F.lit(True))
    joined = edges.join(known, "component_id", "left").join(backed, KEY, "left")
    return joined.withColumn("hint", F.when(F.col("_known"), F.coalesce("_backed", F.lit(False)))).drop("_known", "_backed")


def resolve_edges(one_sided: DataFrame) -> DataFrame:
    """Resolution of edges that one stream has (in_a or not), by hint: the side that has a confirmed edge, else a person."""
    confirmed = F.coalesce("hint", F.lit(False))
    resolution = F.when(confirmed & F.col("in_a"), "accept_stream_a").when(confirmed, "accept_stream_b").otherwise("needs_human_review")
    return one_sided.withColumns({"resolution": resolution, "source": F.when(confirmed, "ground_truth_hint").otherwise("unresolved"), "confidence": F.when(confirmed, F.lit(0.7)).otherwise(F.lit(0.5))})


def resolve_values(rows: DataFrame) -> DataFrame:
    """The rule for values a, b and truth: equal ones are consensus, else the one that the truth supports, else a person."""
    a, b, truth = F.col("a"), F.col("b"), F.col("truth")
    resolution = F.when(a.eqNullSafe(b), "accept_consensus").when(a.eqNullSafe(truth), "accept_stream_a").when(b.eqNullSafe(truth), "accept_stream_b").otherwise("needs_human_review")
    confidence = F.when(a.eqNullSafe(b), F.lit(0.99)).when(a.eqNullSafe(truth) | b.eqNullSafe(truth), F.lit(0.7)).otherwise(F.lit(0.5))
    return rows.withColumns({"resolution": resolution, "confidence": confidence})


def flags(discrepancies: DataFrame) -> DataFrame:
    """is_call_graph_related, is_resolved, is_blocking, needs_review and priority of discrepancies (type, resolution, confidence)."""
    related = F.col("type").isin(*CALL_GRAPH_TYPES)
    resolved = ~F.col("resolution").isin("needs_human_review", "deferred")
    return discrepancies.withColumns({
        "is_call_graph_related": related, "is_resolved": resolved, "is_blocking": ~resolved,
        "needs_review": (F.col("confidence") < CONFIDENT) & ~resolved, "priority": F.when(related | (F.col("confidence") < 0.5), "High").otherwise("Medium")})


def recommend(counted: DataFrame, iteration: int) -> DataFrame:
    """converged and recommendation from counts total and review: one discrepancy that needs a person is enough for tickets."""
    converged = F.col("total") == 0
    said = F.when(converged, "finalize").when(F.col("review") > 0, "generate_tickets").when(F.lit(iteration) >= MAX_ITERATIONS, "max_iterations_reached").otherwise("continue")
    return counted.withColumns({"converged": converged, "recommendation": said})


def convergence(rows: DataFrame, least_match: float, least_similarity: float, most_blocking: int, max_iterations: int) -> DataFrame:
    """Per-criterion booleans and a status, from iteration, match_rate, similarity and blocking."""
    met = {"match_met": F.col("match_rate") >= least_match, "similarity_met": F.col("similarity") >= least_similarity, "blocking_met": F.col("blocking") <= most_blocking}
    every, some = met["match_met"] & met["similarity_met"] & met["blocking_met"], met["match_met"] | met["similarity_met"] | met["blocking_met"]
    status = F.when(every, "converged").when(F.col("iteration") >= max_iterations, "forced").when(some, "partially_converged").otherwise("in_progress")
    return rows.withColumns(met | {"status": status, "go_on": ~every & (F.col("iteration") < max_iterations)})


def merge_streams(components: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """For each component that a stream has (component_id, confidence, summary): both merge on A with the lower confidence, one alone is scaled by 0.8."""
    left = a.select("component_id", F.col("confidence").alias("_ca"), F.col("summary").alias("_sa"))
    right = b.select("component_id", F.col("confidence").alias("_cb"), F.col("summary").alias("_sb"))
    joined = components.join(left, "component_id", "left").join(right, "component_id", "left").filter(F.col("_ca").isNotNull() | F.col("_cb").isNotNull())
    both = F.col("_ca").isNotNull() & F.col("_cb").isNotNull()
    confidence = F.when(both, F.least("_ca", "_cb") * 100).otherwise(F.coalesce("_ca", "_cb") * 80).cast("int")
    return joined.select("component_id", F.coalesce("_sa", "_sb").alias("summary"), confidence.alias("confidence"), F.when(both, "merged").when(F.col("_ca").isNotNull(), "stream_a").otherwise("stream_b").alias("source"))


def feedback(sides: DataFrame) -> DataFrame:
    """Per component that differs: edges to add and to verify for stream A, as sorted texts, and a message."""
    edge = F.concat_ws("->", "caller", "callee")
    add, verify = F.sort_array(F.collect_list(F.when(~F.col("in_a"), edge))), F.sort_array(F.collect_list(F.when(~F.col("in_b"), edge)))
    grouped = sides.filter(F.col("in_a") != F.col("in_b")).groupBy("component_id").agg(F.array_join(add, ",").alias("to_add"), F.array_join(verify, ",").alias("to_verify"), F.count_if(~F.col("in_a")).alias("n_add"), F.count_if(~F.col("in_b")).alias("n_verify"))
    return grouped.withColumn("message", F.concat(F.lit("add "), F.col("n_add"), F.lit(", verify "), F.col("n_verify")))


def unprocessed(components: DataFrame, done: DataFrame) -> DataFrame:
    """components not done in both streams; done has (component_id, stream)."""
    finished = done.groupBy("component_id").agg(F.countDistinct("stream").alias("_n")).filter("_n = 2")
    return components.join(finished, "component_id", "left_anti")


def iterate(state: DataFrame, step, divergent, max_iterations: int) -> tuple[DataFrame, int]:
    """The driver loop: step(state, i) until divergent(state) is empty or the limit is met. Each round ends in a checkpoint."""
    from ..sources.scratch import cut

    state = cut(state)
    for i in range(1, max_iterations + 1):
        if divergent(state).isEmpty():
            return state, i - 1
        state = cut(step(state, i))
    return state, max_iterations


def three_way(a: DataFrame, b: DataFrame, truth: DataFrame) -> DataFrame:
    """Each edge by where it is: one side only, false (both but not in the truth), missing (truth only) or agreed, with severity."""
    return classified(edges_of_three(a, b, truth))


def classified(found: DataFrame) -> DataFrame:
    """The same from edges with a, b and t."""
    in_a, in_b, in_t = (F.col(n) == 1 for n in "abt")
    kind = F.when(in_a & in_b & in_t, "agreed").when(in_a & in_b, "false_edge").when(~in_a & ~in_b, "missing_edge").when(in_a, "a_only").otherwise("b_only")
    found = found.withColumn("kind", kind)
    severity = F.when(F.col("kind") == "agreed", "none").when(F.col("kind") == "missing_edge", "critical").when((F.col("kind") == "false_edge") | in_t, "high").otherwise("medium")
    accepted = F.when(in_t & in_a, "accept_stream_a").when(in_t & in_b, "accept_stream_b").when(in_t | (in_a & in_b), "accept_ground_truth").when(in_a, "accept_stream_b").otherwise("accept_stream_a")
    return found.select(*KEY, "kind", severity.alias("severity"), F.when(F.col("kind") == "agreed", "accept_consensus").otherwise(accepted).alias("resolution"))


def prefer(rows: DataFrame) -> DataFrame:
    """By preference: a confidence lead above 0.1, else a text more than 1.5 times as long (0.7), else nobody."""
    lead, la, lb = F.col("confidence_a") - F.col("confidence_b"), F.length("text_a"), F.length("text_b")
    choice = F.when(lead > 0.1, "accept_stream_a").when(lead < -0.1, "accept_stream_b").when(la > lb * 1.5, "accept_stream_a").when(lb > la * 1.5, "accept_stream_b").otherwise("unchanged")
    return rows.withColumn("resolution", choice)


def by_short_name(calls: DataFrame, components: DataFrame) -> DataFrame:
    """calls (caller, short) resolved to a component id by its last segment: a unique match, else the first of the caller's module."""
    last = lambda c: F.element_at(F.split(c, "\\."), -1)
    calls = calls.select("caller", "short").distinct()
    named = components.select("component_id", last(F.col("component_id")).alias("short"))
    unique = named.groupBy("short").agg(F.min("component_id").alias("component_id"), F.count(F.lit(1)).alias("_n")).filter("_n = 1").drop("_n")
    direct = calls.join(unique, "short").select("caller", "short", "component_id")
    module = F.regexp_replace("caller", r"\.[^.]*$", "")
    others = calls.join(unique, "short", "left_anti").select("short", module.alias("key"), F.lit(1).alias("_call"), "caller", F.lit(None).cast("string").alias("component_id"))
    # of the components of a name those of a module are neighbours in order, so the first of them is the next one at or after the
    # module's name; a call and what it may mean begin alike, which deals a frequent name to several tasks
    width = others.agg(F.min(F.length("key"))).first()[0] or 0
    known = named.join(unique, "short", "left_anti").select("short", F.col("component_id").alias("key"), F.lit(0).alias("_call"), F.lit(None).cast("string").alias("caller"), "component_id")
    downward = Window.partitionBy("short", F.substring("key", 1, width)).orderBy(F.col("key").desc(), "_call").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = known.unionAll(others).withColumn("_next", F.last("component_id", ignorenulls=True).over(downward))
    found = met.filter((F.col("_call") == 1) & F.startswith("_next", F.col("key"))).select("caller", "short", F.col("_next").alias("component_id"))
    return direct.unionAll(found)


def any_of(*tests: Column) -> Column:
    """Whether any test holds."""
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def satisfied(least_match: float, least_similarity: float, most_blocking: int, most_iterations: int) -> Column:
    """Whether match_rate, similarity, blocking and iteration all meet their limits."""
    return (F.col("match_rate") >= least_match) & (F.col("similarity") >= least_similarity) & (F.col("blocking") <= most_blocking) & (F.col("iteration") <= most_iterations)


def settled(least_match: float, most_blocking: int) -> Column:
    """The second rule of convergence: no discrepancies at all, or a high match rate with few that block."""
    return any_of(F.col("discrepancies") == 0, (F.col("match_rate") >= least_match) & (F.col("blocking") <= most_blocking))
