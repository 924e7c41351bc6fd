"""Rules that results must follow, on rows written by hand."""

import pytest
from pyspark.sql import functions as F

from accordis.functions import dirtyjson as j
from accordis.functions import lenient
from accordis.functions import text as x
from accordis.operators import graph, history, reconcile, scores, tickets


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{"a": 1}', {"a": 1}),
        ("", {}),
        ('```json\n{"a": [1, 2,],}\n```', {"a": [1, 2]}),
        ("```\n{'a': 'b'}\n```", {"a": "b"}),
        ("{a: True, b_2: None, c: NaN, d: -Infinity}", {"a": True, "b_2": None, "c": None, "d": -999999999}),
        ('{"url": "http://x.io/a", // the "address"\n"n": 1 /* one, {two} */}', {"url": "http://x.io/a", "n": 1}),
        ('{"a": "x" "b": 2 "c": [1 2] "d": {"e": true "f": null}}', {"a": "x", "b": 2, "c": [1, 2], "d": {"e": True, "f": None}}),
        ('{"p": ["k": 1, "l": "two"]}', {"p": [{"k": 1, "l": "two"}]}),
        ("{'say': 'it's \"so\"'}", {"say": 'it\'s "so"'}),
        ('Result: {"a": {"b": 1}} as you asked', {"a": {"b": 1}}),
        ('Result: {a: 1,} as asked', {"a": 1}),
        ('{"a": [1, 2', None),  # braces are closed before brackets
        ('{"a": {"b": 1', {"a": {"b": 1}}),
        ('{"summary": "short", "description": "a \\"quoted\\" text", "score": 0.5, "rest": "cut he', {"summary": "short", "description": 'a \\"quoted\\" text', "confidence": 0.5}),
        ("nothing here", None),
        ("[1, 2]", [1, 2]),
        ('"text"', "text"),
    ],
)
def test_cascade(text, want):
    assert lenient.parsed(text) == want


def test_repair_keeps_strings():
    said = '{"a": "True, None // no {x: 1,} \'q\' [\\"k\\": v]"}'
    assert lenient.repaired(said) == said


def test_coercion():
    assert lenient.as_text({"text": "t", "message": {"value": 7}, "name": "n"}) == "7"
    assert lenient.as_text({"a": ["x", None, {"reason": "r"}], "b": 0, "c": True}) == "x r True"
    assert lenient.as_texts([1, "", {"content": "c"}]) == ["1", "c"] and lenient.as_texts(" ") == [] and lenient.as_texts(None) == [] and lenient.as_texts(5) == ["5"]
    assert [lenient.as_whole(v) for v in ("7.9", 3, [4.2], {"line": "5"}, {"x": 1}, "no", None, True)] == [7, 3, 4, 5, None, None, None, 1]
    assert [lenient.as_truth(v, j.TRUE_WORDS) for v in (None, " Yes", "no", 0, {"enabled": "on"}, {"x": 1}, [])] == [True, True, False, False, True, True, True]
    assert [lenient.as_score(v, j.SCORES, 0.8) for v in (None, "High", "7", 12, -1, {"rating": [0.3]}, "junk", {})] == [0.8, 0.85, 0.7, 1.0, 0.0, 0.3, 0.8, 0.8]
    refs = lenient.as_refs([" a ", {"component_id": {"name": "b"}, "call_site_line": 0, "call_type": "EXCEPTION"}, {"component_id": 5, "call_site_line": "3", "call_type": "recursive"}, "", None, {"x": 1}], j.CALL_TYPES)
    assert refs == [("a", None, "direct"), ("b", None, "exception"), ("5", 3, "direct")]
    assert lenient.as_refs("one", j.CALL_TYPES) == [("one", None, "direct")]


def test_parameter_names(spark):
    rows = [("*args", "name", 0), ("The value to use", "value is used", 0), ("timeout (float): how long", "", 0), ("<bad>", "", 2), ("", "first of all", 1), ("", "!", 3), ("2x", "d", 0), (None, None, 4)]
    df = spark.createDataFrame(rows, "n string, d string, i int")
    got = [tuple(r) for r in df.select(*j.swapped(F.col("n"), F.col("d"), F.col("i"))).collect()]
    assert got == [("*args", "name"), ("value", "The value to use"), ("timeout", "timeout (float): how long"), ("param3", "<bad>"), ("first", "first of all"), ("param4", "!"), ("2x", "d"), ("param5", "")]


def test_components_without_edges_count(spark):
    none = spark.createDataFrame([], "component_id string, caller string, callee string")
    edge = spark.createDataFrame([("a", "a", "x")], none.schema)
    has = lambda *ids: spark.createDataFrame([(i,) for i in ids], "component_id string")
    got = reconcile.compare_streams(edge, none, has("a", "b", "c"), has("a", "b"))
    assert {r["component_id"]: (r["identical"], r["only_a"]) for r in reconcile.common_components(got).collect()} == {"a": (False, 1), "b": (True, 0)}
    assert [(r["component_id"], r["type"]) for r in reconcile.missing_components(got).collect()] == [("c", "missing_in_b")]
    assert reconcile.stream_status(reconcile.common_components(got)).first()["agreement_rate"] == 0.5


def test_flags_and_recommendation(spark):
    rows = [("call_site_line", "needs_human_review", 0.9), ("missing_callee", "needs_human_review", 0.6), ("summary", "deferred", 0.4), ("call_graph_edge", "accept_stream_a", 0.7)]
    got = reconcile.flags(spark.createDataFrame(rows, "type string, resolution string, confidence double")).collect()
    assert [(r["is_call_graph_related"], r["is_blocking"], r["needs_review"], r["priority"]) for r in got] == [(True, True, False, "High"), (False, True, True, "Medium"), (False, True, True, "High"), (True, False, False, "High")]
    counts = spark.createDataFrame([(0, 0), (5, 1), (5, 0)], "total int, review int")
    said = lambda i: [r["recommendation"] for r in reconcile.recommend(counts, i).collect()]
    assert said(2) == ["finalize", "generate_tickets", "continue"] and said(5)[2] == "max_iterations_reached"


def test_recommendations_are_ordered_by_whole_per_cent(spark):
    columns = "component_id string, qa double, reconstruction double, scenario double, mutation double, impact double, test_pass double, findings int"
    df = spark.createDataFrame([("a", 0.70, 0.646, 0.85, 0.70, 0.75, 0.90, 6)], columns)  # gaps of 10.0 and 10.4 per cent: both 10
    assert [r["area"] for r in scores.recommendations(df).orderBy("rank").collect()] == ["qa", "reconstruction"]
    assert scores.failing(df).first()["failing"] == ["qa", "reconstruction", "overall", "findings"]


def test_statistics_take_the_upper_median(spark):
    columns = "component_id string, qa double, reconstruction double, scenario double, mutation double, impact double, test_pass double, findings int"
    df = spark.createDataFrame([(str(i), *[v] * 6, 0) for i, v in enumerate((0.2, 0.9, 0.4, 0.4004))], columns)
    assert scores.statistics(df).first()["upper_median"] == 0.4004
    assert scores.statistics(df.limit(0)).first()["upper_median"] is None


def test_scenarios(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["a", "c"], "Out ", "out", ["e", "f"], ["f"], True), (["a"], ["a"], None, None, [], [], True), (["a"], ["a"], "o", "o", ["e"], ["e"], False)], "c array<string>, t array<string>, o string, s string, e array<string>, g array<string>, has boolean")
    got = [r["v"] for r in df.select(x.scenario_evaluation(*(F.col(c) for c in df.columns)).alias("v")).collect()]
    assert [(round(r["overall"], 4), r["output_correct"], r["missed_calls"], r["missed_effects"]) for r in got] == [(0.7167, True, ["b"], ["e"]), (1.0, True, [], []), (0.0, False, ["a"], ["e"])]


def test_masks_do_not_overlap():
    text = 'if x > 10: return "ten 10" + f(10)\n'
    kinds = ("constants", "strings", "conditions", "returns", "function_calls")
    spans = x.mask_spans(text, kinds, 100)
    assert [(text[a:b], k) for a, b, k in spans] == [("if x > 10:", "conditions"), ('return "ten 10" + f(10)\n', "returns")]
    some = x.mask_spans("1 2 3 4 5 6 7 8 9 " * 20, ("constants",), 30)
    assert 20 < len(some) < 90 and some == x.mask_spans("1 2 3 4 5 6 7 8 9 " * 20, ("constants",), 30)


def test_masked_text(spark):
    df = spark.createDataFrame([("a 10 b",), (None,), ("",)], "t string")
    got = [tuple(r["m"]) for r in df.select(x.masked_by_all(F.col("t"), ("constants",), 100).alias("m")).collect()]
    assert got == [("a [MASK_0] b", 1, pytest.approx(1 / 3)), ("", 0, 0.0), ("", 0, 0.0)]


def test_corrections_by_path(spark):
    docs = spark.createDataFrame([(1, "s", ("d", (1.5,))), (2, "t", None)], "id int, summary string, doc struct<text: string, more: struct<score: double>>")
    fixes = spark.createDataFrame([(1, "doc.more.score", "2.5"), (1, "summary", "new"), (2, "no.such", "x"), (1, "id", "9")], "id int, path string, value string")
    got = {r["id"]: r for r in reconcile.corrected(docs, fixes, "id").collect()}
    assert got[1]["summary"] == "new" and got[1]["doc"]["more"]["score"] == 2.5 and got[1]["doc"]["text"] == "d" and got[2]["summary"] == "t"


def test_phases_restart_and_stop_twice(spark):
    rows = [(1, 1, "run_start", "x", "2024-01-01 00:00:00"), (1, 2, "run_start", "x", "2024-01-01 00:00:10"), (1, 3, "run_complete", "completed", "2024-01-01 00:00:15"), (1, 4, "run_complete", "failed", "2024-01-01 00:00:20"), (2, 5, "run_complete", "completed", "2024-01-01 00:00:00")]
    log = spark.createDataFrame(rows, "run_id int, seq int, type string, status string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = [(r["start_seq"], r["end_seq"], r["success"], r["duration_us"]) for r in history.phases(log, ["run_start"], ["run_complete"]).orderBy("end_seq").collect()]
    assert got == [(2, 3, True, 5_000_000), (2, 4, False, 10_000_000), (None, 5, True, None)]


def test_layers_of_any_depth_and_cycles(spark):
    chain = [(f"n{i + 1}", f"n{i}") for i in range(9)] + [("x", "y"), ("y", "x"), ("z", "x")]
    got = {r["node"]: r["layer"] for r in graph.layers(spark.createDataFrame(chain, "a string, b string")).collect()}
    assert got == {f"n{i}": i for i in range(10)}


def test_rendering_and_applying(spark):
    df = spark.createDataFrame([("t1", "resolved", "rebuild", None), ("t2", "resolved", "other", "c"), ("t3", "pending", "other", "d")], "ticket_key string, status string, type string, component_id string")
    templates = spark.createDataFrame([("rebuild", "R ${key} ${component} ${what}")], "type string, template string")
    got = {r["ticket_key"]: r["body"] for r in tickets.render_tickets(df, templates, {"key": F.col("ticket_key"), "component": F.col("component_id")}, "${component}").collect()}
    assert got == {"t1": "R t1 ${component} ${what}", "t2": "c", "t3": "d"}
    done = tickets.apply_resolutions(df, lambda resolved: resolved.filter("type = 'other'"))
    assert {r["ticket_key"]: r["status"] for r in done.collect()} == {"t1": "resolved", "t2": "applied", "t3": "pending"}
