"""Providers as Python data sources: logs, source files, tickets and versions of a table, read by name through Spark's reader.

    spark.read.format("accordis_log").option("path", folder).load().filter("type = 'error'")

Each has a schema of its own and cuts its files into partitions of about `partition_bytes`; a file is never cut. Filters that
compare a column with literals are taken over: those on the file's name choose files before any is opened, the others drop rows
before they leave the reader. What a provider can't take stays with Spark. A folder that isn't there or holds no file gives no
rows, which is also what the provider `accordis_none` gives for any schema: the default where there is nothing to ask.

Workers open files themselves, by pyarrow's file systems: file:, hdfs:, s3: and the like, not every scheme that Spark knows.
For others use the readers of `files` and `code`, which are Spark's own.
"""

from __future__ import annotations

import datetime as dt
import fnmatch
import json
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.types import LongType, StringType, StructType, TimestampType

from ..session import ship
from .files import LOG_SCHEMA
from .versions import HISTORY


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path on it."""
    return (fs.LocalFileSystem(), path) if "://" not in path and not path.startswith("file:") else fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


@dataclass
class Part(ds.InputPartition):
    files: list[str]


def _value(row: dict, column: tuple) -> Any:
    for name in column:
        row = row.get(name) if isinstance(row, dict) else None
    return row


#: How a filter that Spark offers judges a value; null passes none of them but IsNull.
TESTS = {
    ds.EqualTo: lambda v, f: v is not None and v == f.value, ds.In: lambda v, f: v is not None and v in f.value, ds.GreaterThan: lambda v, f: v is not None and v > f.value,
    ds.GreaterThanOrEqual: lambda v, f: v is not None and v >= f.value, ds.LessThan: lambda v, f: v is not None and v < f.value, ds.LessThanOrEqual: lambda v, f: v is not None and v <= f.value,
    ds.IsNull: lambda v, f: v is None, ds.IsNotNull: lambda v, f: v is not None, ds.StringStartsWith: lambda v, f: v is not None and v.startswith(f.value),
}


class FileReader(ds.DataSourceReader):
    """Reads the files of a folder that a glob matches; subclasses turn one file's bytes into rows by name."""

    glob, deep = "*", False

    def __init__(self, schema: StructType, options: dict) -> None:
        self.names, self.types = schema.names, {f.name: f.dataType for f in schema.fields}
        self.path, self.glob = options["path"], options.get("glob", self.glob)
        self.size = int(options.get("partition_bytes", 64 << 20))
        self.filters: list[ds.Filter] = []

    def pushFilters(self, filters: list[ds.Filter]):
        for f in filters:
            # times are compared by Spark, which knows the session's zone
            if type(f) in TESTS and isinstance(self.types.get(f.attribute[0]), StringType | LongType):
                self.filters.append(f)
            else:
                yield f

    def passes(self, row: dict, only: str | None = None) -> bool:
        """Whether a row passes the filters, or those on one column."""
        return all(TESTS[type(f)](_value(row, f.attribute), f) for f in self.filters if only is None or f.attribute == (only,))

    def partitions(self) -> list[ds.InputPartition]:
        system, root = store(self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=self.deep, allow_not_found=True))
        out: list[Part] = []
        room = 0
        for info in sorted((i for i in found if i.is_file and fnmatch.fnmatchcase(i.base_name, self.glob) and self.passes({"file": i.base_name}, "file")), key=lambda i: i.path):
            if room < info.size or not out:
                out.append(Part([]))
                room = self.size
            out[-1].files.append(info.path)
            room -= info.size
        return out or [Part([])]

    def read(self, partition: Part) -> Iterator[tuple]:
        system, root = store(self.path)
        for path in partition.files:
            with system.open_input_stream(path) as stream:
                for row in self.rows(path, path.removeprefix(root).lstrip("/"), stream):
                    if self.passes(row):
                        yield tuple(row.get(n) for n in self.names)

    def rows(self, path: str, below: str, stream) -> Iterator[dict]:
        raise NotImplementedError


def _time(text: Any) -> dt.datetime | None:
    """A time of ISO 8601, as UTC if it names no zone; None for anything else."""
    try:
        at = dt.datetime.fromisoformat(text)
    except (TypeError, ValueError):
        return None
    return at if at.tzinfo else at.replace(tzinfo=dt.UTC)


class Lines(FileReader):
    """JSON objects, one a line; blank lines, other values and broken lines are passed over. A field of another type than the schema's is null."""

    glob, needs = "*.jsonl", ("type",)

    def rows(self, path: str, below: str, stream) -> Iterator[dict]:
        name = path.rsplit("/", 1)[-1]
        rest = b""
        while block := stream.read(1 << 20):
            *lines, rest = (rest + block).split(b"\n")
            yield from (row for line in lines if (row := self.of(line, name)))
        if row := self.of(rest, name):
            yield row

    def of(self, line: bytes, name: str) -> dict | None:
        try:
            found = json.loads(line)
        except ValueError:
            return None
        if not isinstance(found, dict) or any(found.get(n) is None for n in self.needs):
            return None
        return {n: self.cast(found.get(n), kind) for n, kind in self.types.items() if n != "file"} | {"file": name}

    def cast(self, value: Any, kind) -> Any:
        if value is None:
            return None
        if isinstance(kind, TimestampType):
            return _time(value)
        if isinstance(kind, StringType):
            return value if isinstance(value, str) else json.dumps(value)
        wanted = {"boolean": bool, "double": float}.get(kind.simpleString(), int)
        if wanted is float and type(value) is int:
            return float(value)
        return value if type(value) is wanted else None


class Tickets(Lines):
    needs = ("ticket_key",)


class Sources(FileReader):
    """Files as text; one that isn't UTF-8 has an error in place of its text."""

    glob, deep = "*.py", True

    def rows(self, path: str, below: str, stream) -> Iterator[dict]:
        row = {"file": path.rsplit("/", 1)[-1], "path": below}
        try:
            yield row | {"text": stream.read().decode("utf-8")}
        except UnicodeDecodeError as e:
            yield row | {"error": f"UnicodeDecodeError: {e.reason} at byte {e.start}"}


class Snapshots(FileReader):
    """The versions of a table, a row for each manifest."""

    glob = "[0-9]*.json"

    def __init__(self, schema: StructType, options: dict) -> None:
        super().__init__(schema, options | {"path": options["path"].rstrip("/") + "/versions"})

    def rows(self, path: str, below: str, stream) -> Iterator[dict]:
        held = json.loads(stream.read())
        yield {"file": below, "version": held["version"], "at": dt.datetime.fromtimestamp(held["at"], dt.UTC), "mode": held["mode"], "parts": len(held["parts"]), "bytes": sum(p["bytes"] for p in held["parts"]), "writers": held["writers"]}


class Nothing(ds.DataSourceReader):
    def partitions(self) -> list[ds.InputPartition]:
        return [Part([])]

    def read(self, partition: Part) -> Iterator[tuple]:
        return iter(())


def provider(name: str, fields: str, kind: type[FileReader]) -> type[ds.DataSource]:
    """A data source of that name with a default schema."""

    class Provider(ds.DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return fields

        def reader(self, schema: StructType) -> ds.DataSourceReader:
            if "path" not in {k.lower() for k in self.options}:
                raise ValueError(f"{name} needs the option path")
            return kind(schema, dict(self.options))

    return Provider


class Empty(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "accordis_none"

    def schema(self) -> str:
        return LOG_SCHEMA

    def reader(self, schema: StructType) -> ds.DataSourceReader:
        return Nothing()


PROVIDERS = (
    provider("accordis_log", f"{LOG_SCHEMA}, file string", Lines), provider("accordis_tickets", "ticket_key string, type string, status string, component_id string, priority string, created_at timestamp, file string", Tickets),
    provider("accordis_source", "path string, text string, error string, file string", Sources), provider("accordis_versions", f"{HISTORY}, file string", Snapshots), Empty,
)


def register(spark: SparkSession) -> None:
    """Make the providers known to a session, with filters given to them."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in PROVIDERS:
        spark.dataSource.register(source)
