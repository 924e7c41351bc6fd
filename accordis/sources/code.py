"""Python source files as tables: a scan with include and exclude globs, and per-file table functions for components and calls.

A file that can't be parsed, or isn't UTF-8, gives one row with kind 'error' and the scan goes on. Each file is one row's work in an Arrow
batch; files never meet, so there is no shuffle.
"""

from __future__ import annotations

import ast
import fnmatch
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SKIPPED = ("__pycache__", "node_modules", "venv", "build", "dist")
COMPONENT_FIELDS = "path string, kind string, component_id string, name string, parent_id string, line_start int, line_end int, signature string, docstring string, is_public boolean, error string"
CALL_FIELDS = "path string, kind string, caller string, callee string, line int, error string"


def glob_pattern(glob: str) -> str:
    """A Java regular expression for an fnmatch glob, in which * also matches a slash."""
    return fnmatch.translate(glob).replace("(?s:", "(?s)").removesuffix(r")\Z").removesuffix(r")\z")


def scan(spark: SparkSession, root: str, include: list[str], exclude: list[str] = ()) -> DataFrame:
    """(path, text, error) of files below root by relative path: any include, no exclude, no skipped or hidden folder; each file once.
    A file whose bytes aren't UTF-8 has no text but an error."""
    base = root.rstrip("/") + "/"
    files = spark.read.option("recursiveFileLookup", "true").format("binaryFile").load(base)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    rows = files.select(F.regexp_replace(F.substring_index("path", urlparse(base).path, -1), "^/", "").alias("path"), text.alias("text"))
    return selected(rows.withColumn("error", F.when(F.col("text").isNull(), "UnicodeDecodeError: the file isn't UTF-8")), include, exclude)


def selected(files: DataFrame, include: list[str], exclude: list[str] = ()) -> DataFrame:
    """files (path, ...) that the globs and the folder rules leave."""
    matches = lambda globs: F.exists(F.array(*(F.regexp_like("path", F.lit(f"^{glob_pattern(g)}$")) for g in globs)), lambda m: m) if globs else F.lit(False)
    folders = F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")))
    hidden = F.exists(folders, lambda p: p.startswith(".") | p.isin(*SKIPPED))
    return files.filter(matches(list(include)) & ~matches(list(exclude)) & ~hidden)


def module_name(path: str) -> str:
    parts = path.removesuffix(".py").split("/")
    return ".".join(parts[:-1] if parts[-1] == "__init__" and len(parts) > 1 else parts)


def signature(node: ast.AST) -> str:
    """A function's signature with all kinds of arguments, or a class's bases."""
    if isinstance(node, ast.ClassDef):
        return f"class {node.name}({', '.join(map(ast.unparse, node.bases))})" if node.bases else f"class {node.name}"
    returns = f" -> {ast.unparse(node.returns)}" if node.returns else ""
    return f"{'async ' * isinstance(node, ast.AsyncFunctionDef)}def {node.name}({ast.unparse(node.args)}){returns}"


def component_rows(path: str, text: str) -> Iterator[dict]:
    """Classes, functions and methods of a file with their containment."""

    def visit(body: list, scope: str, inside_class: bool) -> Iterator[dict]:
        for node in body:
            if not isinstance(node, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                for part in ("body", "orelse", "finalbody"):
                    yield from visit([n for n in getattr(node, part, []) if isinstance(n, ast.stmt)], scope, inside_class)
                continue
            is_class = isinstance(node, ast.ClassDef)
            own = f"{scope}.{node.name}"
            kind = "class" if is_class else "method" if inside_class else "function"
            yield {"path": path, "kind": kind, "component_id": own, "name": node.name, "parent_id": scope, "line_start": node.lineno, "line_end": node.end_lineno, "signature": signature(node), "docstring": ast.get_docstring(node), "is_public": not node.name.startswith("_"), "error": None}
            yield from visit(node.body, own, is_class)

    yield from visit(ast.parse(text).body, module_name(path), False)


def call_rows(path: str, text: str) -> Iterator[dict]:
    """Calls of a file: caller is the enclosing scope, callee the dotted name with import aliases resolved."""
    module, tree = module_name(path), ast.parse(text)
    names: dict[str, str] = {}
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            names |= {a.asname or a.name.split(".")[0]: a.name if a.asname else a.name.split(".")[0] for a in node.names}
        elif isinstance(node, ast.ImportFrom):
            names |= {a.asname or a.name: ".".join(filter(None, (node.module, a.name))) for a in node.names}

    def dotted(node: ast.expr) -> str | None:
        parts: list[str] = []
        while isinstance(node, ast.Attribute):
            parts.append(node.attr)
            node = node.value
        if isinstance(node, ast.Name):
            return ".".join([names.get(node.id, node.id), *reversed(parts)])
        return parts[0] if parts else None  # what a call or an index gives has no name: the method's own stays

    def visit(node: ast.AST, scope: str) -> Iterator[dict]:
        for child in ast.iter_child_nodes(node):
            inner = f"{scope}.{child.name}" if isinstance(child, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef) else scope
            if isinstance(child, ast.Call) and (callee := dotted(child.func)):
                yield {"path": path, "kind": "call", "caller": scope, "callee": callee, "line": child.lineno, "error": None}
            yield from visit(child, inner)

    yield from visit(tree, module)


def _per_file(files: DataFrame, rows: Callable[[str, str], Iterator[dict]], fields: str) -> DataFrame:
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, text, error in zip(batch["path"], batch["text"], batch["error"], strict=True):
                if error is not None:
                    out.append({"path": path, "kind": "error", "error": error})
                    continue
                try:
                    out += rows(path, text or "")
                except (SyntaxError, ValueError, RecursionError) as e:
                    out.append({"path": path, "kind": "error", "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(out, columns=names).astype(object).where(lambda d: d.notna(), None)

    error = F.col("error") if "error" in files.columns else F.lit(None).cast("string").alias("error")
    return files.select("path", "text", error).mapInPandas(run, fields)


def components(files: DataFrame) -> DataFrame:
    """A row for each component of each file."""
    return _per_file(files, component_rows, COMPONENT_FIELDS)


def calls(files: DataFrame) -> DataFrame:
    """A row for each call of each file."""
    return _per_file(files, call_rows, CALL_FIELDS)
