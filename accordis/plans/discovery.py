"""Queries that read source text (S1-S3, P23, GR3, GR5). The files are made from the part table: one small module a part."""

from pyspark.sql import functions as F

from ..sources import code
from .registry import query

SOURCE = "import json as j\n\nclass C{0}:\n    def run(self, a, b=1):\n        return j.dumps(self.go(a))\n\ndef _f{0}():\n    return C{0}().run(1)\n"


def files(t):
    key = F.col("p_partkey").cast("string")
    text = F.replace(F.lit(SOURCE), F.lit("{0}"), key)
    path = F.concat(F.when(F.col("p_size") % 10 == 0, ".git/").when(F.col("p_size") % 10 == 1, "tests/").otherwise("src/"), F.lit("m"), key, F.lit(".py"))
    return t.part.select(path.alias("path"), F.when(F.col("p_size") % 7 == 0, F.lit("def broken(:")).otherwise(text).alias("text"))


@query("s1_file_selection", "SELECT concat('src/m', p_partkey, '.py') AS path FROM part WHERE p_size % 10 > 1")
def _(t):
    return code.selected(files(t), ["*.py"], ["tests/*"]).select("path")


@query("s3_parse_errors", "SELECT concat(CASE p_size % 10 WHEN 0 THEN '.git/' WHEN 1 THEN 'tests/' ELSE 'src/' END, 'm', p_partkey, '.py') AS path FROM part WHERE p_size % 7 = 0")
def _(t):
    return code.components(files(t)).filter("kind = 'error'").select("path")


@query("p23_components", """SELECT k.kind, concat('src.m', p_partkey, k.id, CASE WHEN k.tail THEN p_partkey::VARCHAR ELSE '' END, k.rest) AS component_id, replace(k.signature, '#', p_partkey::VARCHAR) AS signature, k.is_public FROM part,
    (VALUES ('class', '.C', true, '', 'class C#', true), ('method', '.C', true, '.run', 'def run(self, a, b=1)', true), ('function', '._f', true, '', 'def _f#()', false)) k(kind, id, tail, rest, signature, is_public) WHERE p_size % 7 <> 0 AND p_size % 10 > 1""")
def _(t):
    return code.components(code.selected(files(t), ["*.py"], ["tests/*"])).filter("kind <> 'error'").select("kind", "component_id", "signature", "is_public")


@query("gr3_containment", """SELECT concat('src.m', p_partkey, k.child, p_partkey, k.rest) AS component_id, concat('src.m', p_partkey, CASE WHEN k.rest = '' THEN '' ELSE concat('.C', p_partkey) END) AS parent_id FROM part, (VALUES ('.C', ''), ('.C', '.run'), ('._f', '')) k(child, rest) WHERE p_size % 7 <> 0 AND p_size % 10 > 1""")
def _(t):
    return code.components(code.selected(files(t), ["*.py"], ["tests/*"])).filter("kind <> 'error'").select("component_id", "parent_id")


@query("gr5_calls", """SELECT concat('src.m', p_partkey, k.own, p_partkey, k.rest) AS caller, CASE WHEN k.callee = 'C' THEN concat('C', p_partkey) ELSE k.callee END AS callee, k.line FROM part,
    (VALUES ('.C', '.run', 'json.dumps', 5), ('.C', '.run', 'self.go', 5), ('._f', '', 'run', 8), ('._f', '', 'C', 8)) k(own, rest, callee, line) WHERE p_size % 7 <> 0 AND p_size % 10 > 1""")
def _(t):
    return code.calls(code.selected(files(t), ["*.py"], ["tests/*"])).filter("kind = 'call'").select("caller", "callee", "line")
