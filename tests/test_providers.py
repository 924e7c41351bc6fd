"""Data sources and table functions: partitions, filters that are pushed, broken files, plug-ins."""

import json
import re

import pytest
from pyspark.sql import functions as F

from accordis.sources import analysers, code, providers
from accordis.sources.versions import Versions


@pytest.fixture(scope="module", autouse=True)
def known(spark):
    providers.register(spark)
    analysers.register(spark)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def log(tmp_path):
    for n in range(6):
        lines = [json.dumps({"type": "error" if i % 3 == 0 else "run_start", "run_id": f"r{i % 2}", "seq": 10 * n + i, "timestamp": "2024-01-01T00:00:00+01:00", "iteration": "two" if i == 1 else 2, "converged": True}) for i in range(10)]
        (tmp_path / f"checkpoint_{n}.jsonl").write_text("\n".join([lines[0], "", "{broken", "[1]", '{"seq": 1}', *lines[1:]]) + ("" if n else "\n"))
    (tmp_path / "notes.txt").write_text("not a log")
    return f"file://{tmp_path}"


def read(spark, path, **options):
    return spark.read.format("accordis_log").options(path=path, **options).load()


def test_log_rows_and_partitions(spark, log):
    rows = read(spark, log)
    assert rows.count() == 60 and rows.rdd.getNumPartitions() == 1
    assert read(spark, log, partition_bytes=1).rdd.getNumPartitions() == 6 and read(spark, log, partition_bytes=1).count() == 60
    first = rows.filter("seq = 1").first()
    assert (first.run_id, first.type, first.iteration, first.converged, first.file) == ("r1", "run_start", None, True, "checkpoint_0.jsonl")
    assert rows.filter("seq = 2").selectExpr("unix_seconds(timestamp)", "iteration").first()[:] == (1704063600, 2)
    assert read(spark, log, glob="checkpoint_[45].jsonl").selectExpr("min(seq)", "count(*)").first()[:] == (40, 20)


def test_filters_reach_the_reader(spark, log):
    some = read(spark, log, partition_bytes=1).filter("type = 'error' AND seq BETWEEN 10 AND 39 AND run_id IN ('r0', 'r9')")
    assert not re.search(r"\bFilter \(", plan(some))  # the reader answers for all of them
    assert {r.seq for r in some.collect()} == {n * 10 + i for n in (1, 2, 3) for i in (0, 6)}
    # the file's name chooses files before one is opened
    one = read(spark, log, partition_bytes=1).filter("file = 'checkpoint_3.jsonl'")
    assert one.rdd.getNumPartitions() == 1 and one.count() == 10
    # what the provider doesn't take stays with Spark
    late = read(spark, log).filter("timestamp > '2024-01-02' OR converged")
    assert re.search(r"\bFilter \(", plan(late)) and late.count() == 60


def test_nothing_to_read(spark, tmp_path):
    assert read(spark, f"file://{tmp_path}/none").count() == 0
    assert spark.read.format("accordis_none").load().filter("type = 'error'").count() == 0
    assert spark.read.format("accordis_none").schema("a int, b string").load().columns == ["a", "b"]
    with pytest.raises(Exception, match="path"):
        spark.read.format("accordis_log").load().count()


def test_sources_and_tickets(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg" / "a.py").write_text("def f():\n    return g()\n")
    (tmp_path / "pkg" / "b.py").write_bytes(b"x = '\xff\xfe'\n")
    (tmp_path / "c.py").write_text("")
    rows = {r.path: (r.text, r.error) for r in spark.read.format("accordis_source").load(f"file://{tmp_path}").collect()}
    assert rows["pkg/a.py"][0].startswith("def f") and rows["c.py"] == ("", None) and rows["pkg/b.py"][0] is None and "UnicodeDecodeError" in rows["pkg/b.py"][1]
    (tmp_path / "t.jsonl").write_text('{"ticket_key": "T-1", "status": "open", "created_at": "2024-05-01"}\n{"status": "lost"}\n')
    tickets = spark.read.format("accordis_tickets").load(f"file://{tmp_path}").filter("status = 'open'")
    assert [r.ticket_key for r in tickets.collect()] == ["T-1"]


def test_versions_as_rows(spark, tmp_path):
    table = Versions(spark, f"file://{tmp_path}/v")
    for n in range(3):
        table.append(spark.range(n + 1))
    got = spark.read.format("accordis_versions").load(table.path)
    assert [(r.version, r.parts) for r in got.filter("version >= 2").orderBy("version").collect()] == [(2, 2), (3, 3)]
    assert got.columns[:-1] == table.history().columns


def test_a_scan_goes_on_past_bytes_that_are_no_text(spark, tmp_path):
    """Spark's own reader: one file isn't UTF-8, one can't be parsed, one is fine."""
    (tmp_path / "good.py").write_text("class A:\n    pass\n# é\n")
    (tmp_path / "bad.py").write_bytes(b"\xff\xfe")
    (tmp_path / "broken.py").write_text("def (:")
    (tmp_path / "empty.py").write_text("")
    found = {r.path: (r.kind, r.component_id, (r.error or "").split(":")[0]) for r in code.components(code.scan(spark, f"file://{tmp_path}", ["*.py"])).collect()}
    assert found == {"good.py": ("class", "good.A", ""), "bad.py": ("error", None, "UnicodeDecodeError"), "broken.py": ("error", None, "SyntaxError")}
    assert {r.kind for r in code.calls(code.scan(spark, f"file://{tmp_path}", ["bad.py"])).collect()} == {"error"}


SOURCE = "import os as o\n\nclass A:\n    def run(self):\n        return o.getcwd()\n"


def files(spark):
    rows = [("x", f"m{i}.py", SOURCE if i % 5 else "def (:", "python") for i in range(130)] + [("y", "n.py", "", "python"), ("y", "o.py", None, "python"), ("z", "g.json", '{"f": ["a", "b"], "_n": 1}', "adjacency")]
    return spark.createDataFrame(rows, "batch string, path string, text string, language string")


def test_lateral_analysis(spark):
    got = spark.sql("SELECT f.batch, a.* FROM {files} f, LATERAL analyse('calls', f.path, f.text, f.language) a", files=files(spark))
    assert "component_id" not in got.columns and got.filter("kind = 'call' AND callee = 'os.getcwd'").count() == 104 and got.filter("kind = 'error'").count() == 26
    assert {(r.caller, r.callee) for r in got.filter("batch = 'z'").collect()} == {("f", "a"), ("f", "b")}
    components = spark.sql("SELECT a.* FROM {files} f, LATERAL analyse('components', f.path, f.text, f.language) a", files=files(spark))
    assert "callee" not in components.columns and components.filter("kind <> 'error'").count() == 209
    for wrong in ("analyse('nothing', 'p', 't')", "analyse(concat('c', 'x'), 'p', 't')"):
        with pytest.raises(Exception, match="literal"):
            spark.sql(f"SELECT * FROM {wrong}").collect()


def test_batches_share_an_analyser(spark):
    got = spark.sql("SELECT * FROM analyse_batch(TABLE(SELECT * FROM {files}) PARTITION BY batch ORDER BY (path), 'components')", files=files(spark))
    assert {tuple(r) for r in got.collect()} == {("x", "python-ast", 130, 208, 26, 2), ("y", "python-ast", 2, 0, 0, 0), ("z", "adjacency", 1, 1, 0, 1)}


def plugins():
    """Made in a function, so that workers need no module of the tests."""

    class Counting(analysers.Analyser):
        """A plug-in that looks at whole batches."""

        name, language = "counting", "python"

        def process_batch(self, kind, files):
            yield {"path": files[0][0], "kind": "batch"}

        def rows(self, kind, path, text):
            yield {"path": path, "kind": "lines", "line_start": text.count("\n")}

    class Missing(analysers.Analyser):
        name, language = "missing", "python"

        def available(self):
            return False

        def version(self):
            raise OSError("not installed")

    return Counting, Missing


def test_plugins(spark):
    Counting, Missing = plugins()
    try:
        analysers.register(spark, ("python", Counting), ("python", Missing))
        lines = spark.sql("SELECT a.line_start FROM {files} f, LATERAL analyse('components', f.path, f.text) a WHERE f.path = 'm1.py'", files=files(spark))
        assert [r[0] for r in lines.collect()] == [5]  # the first that can run
        batches = spark.sql("SELECT * FROM analyse_batch(TABLE(SELECT * FROM {files}) PARTITION BY (batch), 'components') WHERE batch = 'x'", files=files(spark))
        assert [tuple(r) for r in batches.collect()] == [("x", "counting", 130, 3, 0, 1)]  # 64, 64 and 2 files
        listed = {(r.name, r.available, r.is_default) for r in spark.sql("SELECT * FROM analysers() WHERE language = 'python'").collect()}
        assert listed == {("missing", False, True), ("counting", True, False), ("python-ast", True, False)}
    finally:
        analysers.register(spark)


def test_registry():
    made = []

    def factory():
        made.append(1)
        return plugins()[0]()

    known = analysers.Analysers()
    known.add("python", factory, first=True)
    assert not made and known.get("python").name == "counting" and known.get("python") is known.get("python") and made == [1]
    known.reset()
    assert known.get("python").name == "python-ast" and known.get("edges").name == "edge-list"
    with pytest.raises(ValueError, match="cobol"):
        known.get("cobol")
    edges = list(known.get("edges").rows("calls", "p", '{"graph": [{"source": "f", "target": "g", "flavor": "uses"}, {"source": "f", "target": "h", "flavor": "defines"}]}'))
    assert [(e["caller"], e["callee"]) for e in edges] == [("f", "g")]
