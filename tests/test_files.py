import pytest
from pyspark.sql import functions as F

from accordis.operators.verification import Builder, Registry, Strategy, first_available
from accordis.sources import files


def test_log_round_trip_skips_bad_lines(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    (log / "checkpoint_1.jsonl").write_text('{"type": "run_start", "run_id": "r", "seq": 1}\n\n{"type": \n{"type": "error", "run_id": "r", "seq": 2}\n')
    (log / "other.jsonl").write_text('{"type": "run_start"}\n')
    got = files.read_log(spark, f"file://{log}").orderBy("seq").collect()
    assert [(r["type"], r["seq"]) for r in got] == [("run_start", 1), ("error", 2)]
    more = spark.createDataFrame([("run_complete", "r", 3)], "type string, run_id string, seq long")
    files.append_log(more, f"file://{log}")
    assert files.read_log(spark, f"file://{log}", "*.json*").filter("seq = 3").count() == 1


def test_entities_and_snapshots(spark, tmp_path):
    path = f"file://{tmp_path}/docs"
    df = spark.createDataFrame([("A", "c1", "x"), ("B", "c1", "y")], "stream string, component string, text string")
    files.overwrite_json(df, path, "stream", "component")
    schema = "text string, stream string, component string"
    assert [r["text"] for r in files.entity(spark, path, schema, stream="B", component="c1").collect()] == ["y"]
    assert files.entity(spark, path, schema, stream="B", component="none").count() == 0
    ages = files.snapshots(spark.createDataFrame([("r", 1), ("r", 2)], "run string, id int"), "run", "id").collect()
    assert {r["id"]: r["age"] for r in ages} == {2: 1, 1: 2}


def test_exports(spark, tmp_path):
    sides = spark.createDataFrame([(1, "f", "g", True, True), (1, "f", "h", True, False)], "component_id int, caller string, callee string, in_a boolean, in_b boolean")
    assert tuple(files.export_graphs(sides, f"file://{tmp_path}/out", 2).first()) == (2, 1, 1, 0)
    assert spark.read.json(f"file://{tmp_path}/out/discrepancies").filter("iteration = 2").count() == 1
    (path,) = files.export_package({"graph": sides}, f"file://{tmp_path}/package", "run1")
    assert spark.read.json(path).count() == 2
    assert files.markdown_rows(spark.createDataFrame([("a|b", None)], "x string, y string")).first()["line"] == "| a\\|b | - |"


def test_pipeline_of_strategies(spark):
    parts = spark.createDataFrame([("a",), ("b",)], "component_id string")
    made, told = [], {}

    def make():
        made.append(1)
        rate = lambda items: items.withColumn("score", F.when(F.col("component_id") == "a", 1.0).otherwise(0.5))
        return Strategy("qa", "core", lambda c: c.withColumn("item_id", F.lit(1)), rate, lambda e: e.filter("score < 0.6"))

    registry = Registry()
    registry.register("qa", make)
    registry.register("none", Strategy("none", "deep", lambda c: c.limit(0), lambda i: i.withColumn("score", F.lit(1.0)), lambda e: e.limit(0)))
    pipeline = Builder(registry).with_strategies("qa", "none").with_threshold(0.5).on_gaps(lambda n, g: told.update({n: g.count()})).build()
    got = {r["component_id"]: (r["qa"], r["none"], r["overall"], r["passed"]) for r in pipeline.run(parts, lambda _, items: items).collect()}
    assert got == {"a": (1.0, 0.0, 0.5, True), "b": (0.5, 0.0, 0.25, False)}
    assert told == {"qa": 1, "none": 0} and made == [1]
    assert [s.name for s in registry.by_level("deep")] == ["none"]


def test_fallback_chain(spark):
    empty, full = spark.range(0), spark.range(3)

    def broken():
        raise OSError("gone")

    assert first_available([broken, lambda: None, lambda: full], empty).count() == 3
    assert first_available([broken], empty).count() == 0


def test_events_of_each_kind(spark, tmp_path):
    """What is written comes back; fields that a kind lacks or needs are errors."""
    path = f"file://{tmp_path}/events"
    documented = spark.createDataFrame([("c1", "A", 2)], "component_id string, stream string, iteration int")
    found = spark.createDataFrame([(["c1", "c2"], ["c2", "c1"])], "component_ids array<string>, processing_order array<string>")
    made = [files.events("run_start", spark.range(1).select(F.lit("{}").alias("config")), "r"), files.events("discovery_complete", found, "r"), files.events("component_documented", documented, "r"),
            files.events("error", spark.createDataFrame([("documenting", "bad")], "phase string, error string"), "r"), files.events("iteration_complete", spark.createDataFrame([(1, True)], "iteration int, converged boolean"), "r"),
            files.events("run_complete", spark.createDataFrame([("completed",)], "status string"), "r")]
    for one in made:
        files.append_log(one, path)
    got = {r["type"]: r for r in files.read_log(spark, path, "*.json").collect()}
    assert set(got) == set(files.EVENTS)
    assert got["discovery_complete"]["component_count"] == 2 and got["component_documented"]["duration_ms"] == 0.0 and got["error"]["error_type"] == "Error" and got["iteration_complete"]["converged"] is True
    for kind, rows in (("error", documented), ("component_documented", spark.range(1))):
        with pytest.raises(ValueError):
            files.events(kind, rows, "r")
