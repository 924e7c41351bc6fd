"""Analysers as table functions: plug-ins by language, called from SQL for each file or for batches of files.

An analyser says whether it can run here and in which version, and turns a file into components or calls. The registry gives
the one of a language, made on first use from a class or a factory. Three table functions come with it, after `register`:

    SELECT a.* FROM files f, LATERAL analyse('components', f.path, f.text) a
    SELECT * FROM analyse_batch(TABLE(SELECT lang AS batch, path, text FROM files) PARTITION BY batch ORDER BY (path), 'calls')
    SELECT * FROM analysers()

The schema of `analyse` follows from its first argument. `analyse_batch` gives each partition one analyser, which sees its files
BATCH at a time and may keep what it learned from earlier ones; at the end of a partition a row tells what it did.
A file that an analyser can't read gives a row of kind 'error', never a failed job.
"""

from __future__ import annotations

import json
import platform
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructType

from ..session import ship
from . import code

FIELDS = {"components": code.COMPONENT_FIELDS, "calls": code.CALL_FIELDS}
BATCH_FIELDS = "batch string, analyser string, files long, rows long, errors long, known long"
#: Files that a batch analyser is given at once.
BATCH = 64


class Analyser:
    """What every analyser is. Give `rows`; `process_batch` is one file after another unless a subclass knows better."""

    name = language = ""

    def available(self) -> bool:
        return True

    def version(self) -> str:
        return "1"

    def rows(self, kind: str, path: str, text: str) -> Iterator[dict]:
        raise NotImplementedError

    def safe_rows(self, kind: str, path: str, text: str | None) -> list[dict]:
        """The rows of a file, or one that tells why there are none."""
        try:
            return list(self.rows(kind, path, text or ""))
        except (SyntaxError, ValueError, TypeError, AttributeError, RecursionError) as e:
            return [{"path": path, "kind": "error", "error": f"{type(e).__name__}: {e}"}]

    def process_batch(self, kind: str, files: list[tuple[str, str]]) -> Iterator[dict]:
        for path, text in files:
            yield from self.safe_rows(kind, path, text)


class PythonSource(Analyser):
    """Python modules by their syntax tree."""

    name, language = "python-ast", "python"

    def version(self) -> str:
        return platform.python_version()

    def rows(self, kind: str, path: str, text: str) -> Iterator[dict]:
        return (code.component_rows if kind == "components" else code.call_rows)(path, text)


class Adjacency(Analyser):
    """Call graphs in JSON, {caller: [callee, ...]}; keys with a leading underscore hold remarks. What has another shape is passed over."""

    name, language = "adjacency", "adjacency"

    def edges(self, found) -> Iterator[tuple[str, str]]:
        for caller, callees in found.items() if isinstance(found, dict) else ():
            if not caller.startswith("_") and isinstance(callees, list):
                yield from ((caller, callee) for callee in callees if isinstance(callee, str))

    def rows(self, kind: str, path: str, text: str) -> Iterator[dict]:
        edges = list(self.edges(json.loads(text)))
        if kind == "calls":
            yield from ({"path": path, "kind": "call", "caller": a, "callee": b} for a, b in edges)
            return
        for own in dict.fromkeys(a for a, _ in edges):
            above, _, name = own.rpartition(".")
            yield {"path": path, "kind": "function", "component_id": own, "name": name, "parent_id": above, "is_public": not name.startswith("_")}


class StrictAdjacency(Adjacency):
    """The same without guards: every key is a caller, whatever can be run through holds its callees, and a file with anything else is an error."""

    name, language = "adjacency-strict", "adjacency-strict"

    def edges(self, found) -> Iterator[tuple[str, str]]:
        for caller, callees in found.items():
            for callee in callees:
                if not isinstance(callee, str):
                    raise TypeError(f"{caller} calls {callee!r}, which is no name")
                yield caller, callee


class EdgeList(Analyser):
    """Call graphs in JSON, {graph: [{source, target, flavor}]}; only uses are calls."""

    name, language = "edge-list", "edges"

    def rows(self, kind: str, path: str, text: str) -> Iterator[dict]:
        edges = [e for e in json.loads(text).get("graph", []) if e.get("flavor") == "uses"]
        if kind == "components":
            yield from ({"path": path, "kind": "function", "component_id": n} for n in sorted({e["source"] for e in edges}))
        else:
            yield from ({"path": path, "kind": "call", "caller": e["source"], "callee": e["target"]} for e in edges)


class Analysers:
    """Analysers by language. A maker is a class or any function without arguments; it is called on first use."""

    def __init__(self) -> None:
        self.reset()

    def reset(self) -> None:
        """Back to the analysers that come with the library."""
        self._makers: dict[str, list[Callable[[], Analyser]]] = {}
        self._made: dict[tuple[str, str], Analyser] = {}
        for kind in (PythonSource, Adjacency, StrictAdjacency, EdgeList):
            self.add(kind.language, kind)

    def add(self, language: str, maker: Callable[[], Analyser], first: bool = False) -> None:
        """One more analyser of a language; `first` makes it the default."""
        makers = self._makers.setdefault(language, [])
        makers.insert(0 if first else len(makers), maker)

    def languages(self) -> list[str]:
        return sorted(self._makers)

    def all(self, language: str) -> list[Analyser]:
        key = lambda maker: (language, f"{maker.__module__}.{maker.__qualname__}.{id(maker)}")
        return [self._made[key(m)] if key(m) in self._made else self._made.setdefault(key(m), m()) for m in self._makers.get(language, [])]

    def get(self, language: str) -> Analyser:
        """The first analyser of a language that can run here."""
        for found in self.all(language):
            if found.available():
                return found
        raise ValueError(f"no analyser for {language}; there are {self.languages()}")


#: The analysers of this process. Workers have their own, with what `register` was given.
ANALYSERS = Analysers()


TYPES = {"string": StringType(), "int": IntegerType(), "long": LongType(), "boolean": BooleanType()}


def names_of(fields: str) -> list[str]:
    return [f.split()[0] for f in fields.split(", ")]


def struct_of(fields: str) -> StructType:
    """The schema of a list of fields; a worker has no session to ask."""
    out = StructType()
    for f in fields.split(", "):
        out.add(f.split()[0], TYPES[f.split()[1]])
    return out


def _literal(argument: AnalyzeArgument, name: str, known: list[str]) -> str:
    if not argument.isConstantExpression or argument.value not in known:
        raise ValueError(f"{name} must be one of {known}, as a literal")
    return argument.value


def _tuple(row: dict, names: list[str]) -> tuple:
    return tuple(row.get(n) for n in names)


def _analyse(makers: list[tuple[str, Callable[[], Analyser]]]) -> type:
    class Analyse:
        """A row for each component or call of a file: kind, path, text and, for other languages than Python, the language."""

        def __init__(self) -> None:
            self.analysers = Analysers()
            for language, maker in makers:
                self.analysers.add(language, maker, first=True)

        @staticmethod
        def analyze(kind: AnalyzeArgument, path: AnalyzeArgument, text: AnalyzeArgument, language: AnalyzeArgument | None = None) -> AnalyzeResult:
            return AnalyzeResult(struct_of(FIELDS[_literal(kind, "the first argument", list(FIELDS))]))

        def eval(self, kind: str, path: str, text: str, language: str = "python") -> Iterator[tuple]:
            names = names_of(FIELDS[kind])
            for row in self.analysers.get(language).safe_rows(kind, path, text):
                yield _tuple(row, names)

    return Analyse


def _analyse_batch(makers: list[tuple[str, Callable[[], Analyser]]]) -> type:
    class AnalyseBatch:
        """A row for each partition of a table (batch, path, text, and language if there is one): what an analyser found in all of its files."""

        def __init__(self) -> None:
            self.analysers = Analysers()
            for language, maker in makers:
                self.analysers.add(language, maker, first=True)
            self.analyser, self.batch, self.held, self.counts = None, None, [], [0, 0, 0]
            self.known: set[str] = set()

        @staticmethod
        def analyze(rows: AnalyzeArgument, kind: AnalyzeArgument) -> AnalyzeResult:
            _literal(kind, "the second argument", list(FIELDS))
            if not rows.isTable or not {"batch", "path", "text"} <= set(rows.dataType.names):
                raise ValueError("the first argument must be TABLE(...) with batch, path and text")
            return AnalyzeResult(struct_of(BATCH_FIELDS))

        def eval(self, row, kind: str) -> Iterator[tuple]:
            if self.analyser is None:
                self.analyser = self.analysers.get(row["language"] if "language" in row else "python")
                self.batch, self.kind = row["batch"], kind
            self.held.append((row["path"], row["text"]))
            if len(self.held) == BATCH:
                self._flush()
            return iter(())

        def _flush(self) -> None:
            found = list(self.analyser.process_batch(self.kind, self.held))
            errors = sum(r["kind"] == "error" for r in found)
            self.known |= {r["kind"] for r in found}
            self.counts = [self.counts[0] + len(self.held), self.counts[1] + len(found) - errors, self.counts[2] + errors]
            self.held = []

        def terminate(self) -> Iterator[tuple]:
            if self.analyser is not None:
                self._flush()
                yield (str(self.batch), self.analyser.name, *self.counts, len(self.known - {"error"}))

    return AnalyseBatch


def _listing(makers: list[tuple[str, Callable[[], Analyser]]]) -> type:
    class Listing:
        """name, language, version and whether it can run on the executors, of every analyser."""

        def eval(self) -> Iterator[tuple]:
            known = Analysers()
            for language, maker in makers:
                known.add(language, maker, first=True)
            for language in known.languages():
                for place, a in enumerate(known.all(language)):
                    yield a.name, language, a.version() if a.available() else None, a.available(), place == 0

    return Listing


def register(spark: SparkSession, *more: tuple[str, Callable[[], Analyser]]) -> None:
    """Make analyse, analyse_batch and analysers known to SQL; more: (language, maker) of further analysers, first of their language."""
    ship(spark)
    spark.udtf.register("analyse", udtf(_analyse(list(more))))
    spark.udtf.register("analyse_batch", udtf(_analyse_batch(list(more))))
    spark.udtf.register("analysers", udtf(_listing(list(more)), returnType="name string, language string, version string, available boolean, is_default boolean"))
