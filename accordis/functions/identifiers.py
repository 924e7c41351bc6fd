"""Column functions on component ids, paths and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of Python builtins that call edges leave out.
BUILTINS = [
    "print", "len", "range", "str", "int", "float", "bool", "list", "dict", "set", "tuple", "type", "isinstance", "issubclass", "hasattr",
    "getattr", "setattr", "delattr", "callable", "iter", "next", "enumerate", "zip", "map", "filter", "sorted", "reversed", "min", "max",
    "sum", "any", "all", "abs", "round", "pow", "divmod", "open", "input", "format", "repr", "hash", "id", "object", "super", "classmethod",
    "staticmethod", "property",
]
# Prefixes of standard-library modules.
STDLIB = [
    "os.", "sys.", "re.", "json.", "datetime.", "collections.", "itertools.", "functools.", "pathlib.", "typing.", "abc.", "logging.",
    "threading.", "multiprocessing.", "asyncio.", "http.", "urllib.", "email.", "html.", "xml.", "sqlite3.", "pickle.", "copy.", "math.",
    "random.", "statistics.",
]


def normal_id(raw: Column, kind: Column) -> Column:
    """An id as its source kind writes it, normalised; null where it must go."""
    t = F.trim(raw)
    java = F.trim(F.substring_index(F.substring_index(raw, "(", 1), ")", 1))
    ts = F.regexp_replace(F.regexp_replace(raw, r"\.(ts|js)$", ""), r"[/\\]", ".")
    out = (F.when(kind == "pycg", F.when(~(raw.startswith("<") | raw.endswith(">")), raw))
           .when(kind == "pyan", F.when(~F.contains(t, F.lit("->")), t)).when(kind == "java", java).when(kind == "ts", ts).otherwise(raw))
    return F.nullif(F.trim(out), F.lit(""))


def strip_prefix(value: Column, prefix: str, at_dot: bool = False, lower: bool = False) -> Column:
    """value without a leading prefix and then one leading dot. With at_dot, only if the prefix ends at a dot or the end."""
    has = value.startswith(prefix)
    if at_dot:
        has = value.startswith(prefix + ".") | (value == prefix)
    out = F.regexp_replace(F.when(has, F.substring(value, len(prefix) + 1, 1 << 30)).otherwise(value), r"^\.", "")
    return F.lower(out) if lower else out


def last_segment(value: Column) -> Column:
    return F.element_at(F.split(value, r"\."), -1)


def module_path(value: Column) -> Column:
    """All but the last dotted segment, empty without a dot."""
    return F.when(F.contains(value, F.lit(".")), F.regexp_replace(value, r"\.[^.]*$", "")).otherwise(F.lit(""))


def exclusion(callee: Column) -> Column:
    """builtin, stdlib or kept; builtin wins."""
    prefixed = F.lit(False)
    for p in STDLIB:
        prefixed = prefixed | callee.startswith(p)
    return F.when(last_segment(callee).isin(BUILTINS), "builtin").when(prefixed, "stdlib").otherwise("kept")


def call_type(hint: Column) -> Column:
    """A call type by the first matching group of substrings."""
    groups = [("conditional", ("conditional", "if")), ("loop", ("loop", "for", "while")), ("exception", ("try", "except")), ("callback", ("callback", "lambda")), ("dynamic", ("dynamic", "getattr"))]
    h, out = F.lower(hint), None
    for name, parts in groups:
        test = F.lit(False)
        for p in parts:
            test = test | F.contains(h, F.lit(p))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("direct")


def module_of_path(path: Column) -> Column:
    """A file path as a dotted module name."""
    dotted = F.replace(F.regexp_replace(path, r"\.py$", ""), F.lit("/"), F.lit("."))
    return F.regexp_replace(dotted, r"(^|\.)__init__$", "")


def safe_name(key: Column) -> Column:
    """A file name for a key: unsafe characters and dots become one underscore, the last 200 characters stay."""
    clean = F.regexp_replace(F.regexp_replace(key, r'[<>:"/\\|?*.]', "_"), "_+", "_")
    return F.btrim(F.right(clean, F.lit(200)), F.lit("_"))


def is_public(name: Column) -> Column:
    return ~name.startswith("_")


def excluded_by(value: Column, patterns: list[str]) -> Column:
    """Whether any pattern is a substring."""
    out = F.lit(False)
    for p in patterns:
        out = out | F.contains(value, F.lit(p))
    return out


def ignore_pattern(line: Column) -> Column:
    """A line of an ignore file as a substring pattern; null for comments and blanks."""
    t = F.trim(line)
    clean = F.replace(F.replace(F.regexp_replace(t, "/$", ""), F.lit("*"), F.lit("")), F.lit("/"), F.lit("."))
    return F.when((t != "") & ~t.startswith("#"), F.nullif(clean, F.lit("")))


def is_identifier(name: Column) -> Column:
    """A Python identifier, leading asterisks allowed."""
    return F.regexp_like(name, F.lit(r"^\**[A-Za-z_][A-Za-z0-9_]*$"))
