"""File sources and sinks: JSON-lines logs, entity documents, snapshots, exports. All go through Spark's readers and commit protocol."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .versions import Versions

LOG_SCHEMA = """type string, timestamp timestamp, run_id string, seq long, component_count int, component_id string, stream string, iteration int, status string,
    output_path string, duration_ms double, token_count long, phase string, error string, error_type string, components_processed int, converged boolean"""


def read_log(spark: SparkSession, path: str, pattern: str = "checkpoint_*.jsonl", schema: str = LOG_SCHEMA) -> DataFrame:
    """Events of JSON-lines files with the file they came from; blank and malformed lines are skipped."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").option("pathGlobFilter", pattern).json(path)
    lines = rows.withColumn("file", F.input_file_name())
    return lines.filter(F.col("_corrupt_record").isNull() & F.col("type").isNotNull()).drop("_corrupt_record")


# What an event of each kind holds beside type, timestamp and run_id, with the values of fields that aren't given.
EVENTS = {
    "run_start": {"config": "{}"},
    "discovery_complete": {"component_count": None, "component_ids": None, "processing_order": None},
    "component_documented": {"component_id": None, "stream": None, "iteration": None, "output_path": None, "duration_ms": 0.0, "token_count": None},
    "error": {"phase": None, "component_id": None, "stream": None, "error": "", "error_type": "Error", "traceback": None},
    "iteration_complete": {"iteration": None, "components_processed": 0, "discrepancies_found": 0, "discrepancies_resolved": 0, "converged": False, "duration_seconds": 0.0},
    "run_complete": {"status": None, "total_iterations": 0, "total_components": 0, "total_discrepancies": 0, "total_duration_seconds": 0.0, "metrics": "{}"},
}
#: Fields that an event of a kind can't do without.
NEEDED = {"discovery_complete": ("component_ids",), "component_documented": ("component_id", "stream", "iteration"), "error": ("phase",), "iteration_complete": ("iteration",), "run_complete": ("status",)}


def events(kind: str, rows: DataFrame, run_id: str) -> DataFrame:
    """A row for each event of a kind, ready for append_log(): rows hold its fields, others of the kind take their defaults, and any
    other column is an error. The timestamp is the rows' own, or now."""
    fields = EVENTS[kind]
    if missing := set(NEEDED.get(kind, ())) - set(rows.columns):
        raise ValueError(f"{kind} needs {sorted(missing)}")
    if unknown := set(rows.columns) - {*fields, "timestamp"}:
        raise ValueError(f"{kind} has no {sorted(unknown)}")
    if kind == "discovery_complete":
        rows = rows.withColumn("component_count", F.size("component_ids"))
    held = [F.col(name) if name in rows.columns else F.lit(value).cast("string" if value is None else {str: "string", float: "double", bool: "boolean", int: "long"}[type(value)]).alias(name) for name, value in fields.items()]
    at = F.col("timestamp") if "timestamp" in rows.columns else F.current_timestamp().alias("timestamp")
    return rows.select(F.lit(kind).alias("type"), at, F.lit(run_id).alias("run_id"), *held)


def append_log(events: DataFrame, path: str) -> None:
    """Add events to a log folder: new files only, those that are there stay."""
    events.write.mode("append").json(path)


def overwrite_json(df: DataFrame, path: str, *partition_by: str) -> int:
    """Replace a JSON table, partitioned by keys if some are given: entity documents by (stream, component) for one. Readers see the old
    rows until the new ones are whole. Gives the version."""
    return Versions(df.sparkSession, path, "json").overwrite(df, *partition_by)


def read_json(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a table that overwrite_json() wrote."""
    return Versions(spark, path, "json").read(version)


def entity(spark: SparkSession, path: str, schema: str, **keys: str) -> DataFrame:
    """Documents of one entity; no rows if there are none. Only the folders of these keys are read."""
    table = Versions(spark, path, "json")
    held = table.manifest()
    if held is None:
        return spark.createDataFrame([], schema)
    rows = table.read(held.version, {k: [v] for k, v in keys.items() if k in held.by})
    for k, v in keys.items():
        rows = rows.filter(F.col(k) == v)
    return rows.select(*StructType.fromDDL(schema).names)


def snapshots(df: DataFrame, key: str, order: str) -> DataFrame:
    """Snapshots with their age: 1 is the newest of its key."""
    return df.withColumn("age", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc())))


def export_graphs(sides: DataFrame, path: str, iteration: int) -> DataFrame:
    """Write consensus edges and discrepancies of a round as two JSON tables partitioned by iteration; gives the header of counts."""
    rows = sides.withColumn("iteration", F.lit(iteration))
    for name, keep in (("consensus", F.col("in_a") & F.col("in_b")), ("discrepancies", F.col("in_a") != F.col("in_b"))):
        rows.filter(keep).write.mode("append").partitionBy("iteration").json(f"{path.rstrip('/')}/{name}")
    return sides.agg(F.lit(iteration).alias("iteration"), F.count_if(F.col("in_a") & F.col("in_b")).alias("consensus"), F.count_if(F.col("in_a") & ~F.col("in_b")).alias("only_a"), F.count_if(~F.col("in_a") & F.col("in_b")).alias("only_b"))


def export_package(tables: dict[str, DataFrame], path: str, run_id: str) -> list[str]:
    """Write a run's tables (documentation, graph, report, metrics) as plain JSON folders, for readers of any kind; gives their paths."""
    out = []
    for name, df in tables.items():
        out.append(f"{path.rstrip('/')}/{run_id}_{name}")
        df.write.mode("overwrite").json(out[-1])
    return out


def export_metrics(metrics: DataFrame, path: str) -> int:
    """Write each run's metrics (run_id, ...) in place of what is there of these runs; other runs stay. Gives the version."""
    return Versions(metrics.sparkSession, path, "json").replace(metrics, "run_id")


def markdown_rows(df: DataFrame) -> DataFrame:
    """A Markdown table line for each row; null is a dash."""
    cells = [F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("-")) for c in df.columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
