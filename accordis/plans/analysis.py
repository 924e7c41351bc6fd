"""Queries through table functions and data sources."""

from pyspark.sql import functions as F

from ..sources import analysers, code, providers
from ..sources.scratch import new_folder
from ..sources.versions import Versions
from .discovery import files
from .registry import SQL, query


def chosen(t):
    analysers.register(t.spark)
    return code.selected(files(t), ["*.py"], ["tests/*"])


@query("x1_components_by_sql", SQL["p23_components"])
def _(t):
    """The component scan as a lateral table function."""
    return t.spark.sql("SELECT a.kind, a.component_id, a.signature, a.is_public FROM {files} f, LATERAL analyse('components', f.path, f.text) a WHERE a.kind <> 'error'", files=chosen(t))


@query("x1_calls_by_sql", SQL["gr5_calls"])
def _(t):
    return t.spark.sql("SELECT a.caller, a.callee, a.line FROM {files} f, LATERAL analyse('calls', f.path, f.text) a WHERE a.kind = 'call'", files=chosen(t))


@query("x10_batches", """SELECT (p_partkey % 32)::VARCHAR AS batch, 'python-ast' AS analyser, count(*) AS files, 3 * count(*) FILTER (p_size % 7 <> 0) AS rows, count(*) FILTER (p_size % 7 = 0) AS errors, CASE WHEN count(*) FILTER (p_size % 7 <> 0) > 0 THEN 3 ELSE 0 END AS known
    FROM part WHERE p_size % 10 > 1 GROUP BY p_partkey % 32""")
def _(t):
    """One analyser a batch, which keeps count over its files."""
    dealt = chosen(t).withColumn("batch", F.regexp_extract("path", r"m(\d+)", 1).cast("long") % 32)
    return t.spark.sql("SELECT * FROM analyse_batch(TABLE(SELECT batch, path, text FROM {files}) PARTITION BY batch ORDER BY (path), 'components')", files=dealt)


def graph_texts(t):
    """A call graph of each supplier as JSON, some with a remark, a value that is no list or an entry that is no text."""
    named = F.concat(F.lit("p"), "l_partkey")
    listed = t.lineitem.filter("l_linenumber = 1").groupBy("l_suppkey").agg(F.sort_array(F.collect_set(named)).alias("callees"))
    plain = F.concat(F.lit('{"_description": "made", "s'), "l_suppkey", F.lit('": ["'), F.array_join("callees", '", "'), F.lit('"]'))
    odd = F.when(F.col("l_suppkey") % 5 == 0, ', "bad": "x"').when(F.col("l_suppkey") % 5 == 1, ', "half": ["q", 7]').otherwise("")
    return listed.select(F.concat(F.lit("g"), "l_suppkey", F.lit(".json")).alias("path"), F.concat(plain, odd, F.lit("}")).alias("text"))


@query("s5_guarded_and_strict", """WITH e AS (SELECT DISTINCT l_suppkey AS s, concat('s', l_suppkey) AS caller, concat('p', l_partkey) AS callee FROM lineitem WHERE l_linenumber = 1)
    SELECT 'adjacency' AS form, 'call' AS kind, caller, callee FROM e UNION ALL SELECT DISTINCT 'adjacency', 'call', 'half', 'q' FROM e WHERE s % 5 = 1
    UNION ALL SELECT 'adjacency-strict', 'call', caller, callee FROM e WHERE s % 5 <> 1 UNION ALL SELECT DISTINCT 'adjacency-strict', 'call', 'bad', 'x' FROM e WHERE s % 5 = 0
    UNION ALL SELECT DISTINCT 'adjacency-strict', 'call', '_description', letter FROM e, (VALUES ('m'), ('a'), ('d'), ('e')) v(letter) WHERE s % 5 <> 1 UNION ALL SELECT DISTINCT 'adjacency-strict', 'error', concat('g', s, '.json'), NULL FROM e WHERE s % 5 = 1""")
def _(t):
    """Adjacency texts with type guards and without: there a text stands for its letters, and a number makes the file an error."""
    analysers.register(t.spark)
    sql = "SELECT DISTINCT '{form}' AS form, a.kind, coalesce(a.caller, a.path) AS caller, a.callee FROM {{graphs}} g, LATERAL analyse('calls', g.path, g.text, '{form}') a"
    guarded, strict = (t.spark.sql(sql.format(form=form), graphs=graph_texts(t)) for form in ("adjacency", "adjacency-strict"))
    return guarded.unionAll(strict)


@query("x5_log_provider", "SELECT run_id::VARCHAR AS run_id, seq, component_id, stream, iteration FROM {log} l WHERE type = 'component_documented' AND seq >= 100")
def _(t):
    """The log written as JSON lines and read back through its provider, which drops other events before they leave it."""
    providers.register(t.spark)
    path = new_folder(t.spark)
    t.log.select("type", F.col("run_id").cast("string").alias("run_id"), "seq", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), "component_id", "stream", "iteration", "status").write.json(path)
    log = t.spark.read.format("accordis_log").option("path", path).option("glob", "*.json").load()
    return log.filter("type = 'component_documented' AND seq >= 100").select("run_id", "seq", "component_id", "stream", "iteration")


@query("x5_version_provider", """SELECT version, mode FROM (VALUES (2, 'append'), (3, 'replace')) v(version, mode), (SELECT count(*) AS n FROM orders) o WHERE n > 0""")
def _(t):
    """The versions of a table through their provider, which opens the manifests."""
    providers.register(t.spark)
    table = Versions(t.spark, new_folder(t.spark))
    orders = t.orders.select("o_orderkey", "o_orderstatus")
    table.overwrite(orders.filter("o_orderstatus = 'F'"), "o_orderstatus")
    table.append(orders.filter("o_orderstatus = 'O'"), "o_orderstatus")
    table.replace(orders.filter("o_orderstatus = 'P'"), "o_orderstatus")
    return t.spark.read.format("accordis_versions").option("path", table.path).load().filter("version > 1").select("version", "mode")
