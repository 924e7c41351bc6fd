"""Digests of groups of lines in order, whatever a group's size: no task holds a group.

Lines are dealt by ranges of (group, line) and joined to stretches of at most BLOCK by many tasks. The digest is a chain by nature;
it runs over a group's stretches one after another, holding one at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1 << 14


def digests(rows: DataFrame, group: str, line: str, separator: str, algorithm: str = "md5") -> DataFrame:
    """(group, digest): of the group's sorted lines, joined by a separator; null lines are left out. A null group is one too."""
    kind = rows.schema[group].dataType.simpleString()
    # bounds are sampled from the beginnings of lines, which are short
    kept = rows.select(F.col(group).alias("g"), F.col(line).cast("string").alias("l"), F.substring(F.col(line).cast("string"), 1, 64).alias("h")).filter("l IS NOT NULL")
    ranged = kept.repartitionByRange("g", "h").sortWithinPartitions("g", "l").select("g", "l")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, key, held = False, None, []
        for batch in batches:
            for g, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not known or g != key or len(held) == BLOCK:
                    if held:
                        yield stretch(batch.schema.field(0).type, key, held)
                    known, key, held = True, g, []
                held.append(text)
        if held:
            yield stretch(batch.schema.field(0).type, key, held)

    def stretch(kind: pa.DataType, key, held: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], kind), *(pa.array([x], pa.string()) for x in (held[0], held[-1], separator.join(held)))], names=["g", "first", "last", "said"])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, key, state = False, None, None
        for batch in batches:
            for g, _, _, said in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if known and g == key:
                    state.update(separator.encode() + said.encode())
                    continue
                if known:
                    yield ended(batch.schema.field(0).type, key, state)
                known, key, state = True, g, hashlib.new(algorithm, said.encode(), usedforsecurity=False)
        if known:
            yield ended(batch.schema.field(0).type, key, state)

    def ended(kind: pa.DataType, key, state) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array([state.hexdigest()], pa.string())], names=["g", "digest"])

    stretches = ranged.mapInArrow(join, f"g {kind}, first string, last string, said string")
    return stretches.repartition("g").sortWithinPartitions("g", "first", "last").mapInArrow(chain, f"g {kind}, digest string").withColumnRenamed("g", group)
