"""What op8's levels keep on disk and hand over."""

import random
from pathlib import Path

import pyarrow as pa
import pytest

from accordis.llm import lm_scoring


def files(table):
    return sum(p.stat().st_size for p in Path(table._written_at.removeprefix("file:")).rglob("*.parquet"))


@pytest.fixture(scope="module")
def repeating(spark):
    """Texts whose words repeat so that most tokens stay open after the first level."""
    rng = random.Random(5)
    passages = [" ".join(f"w{rng.randint(0, 800)}" for _ in range(40)) for _ in range(40)]
    texts = [" ".join([*(f"w{rng.randint(0, 800)}" for _ in range(60)), *rng.sample(passages, 3)]) for _ in range(600)]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)


def test_language_model_keeps_little_beside_its_chunks(spark, repeating, monkeypatch):
    """Tables that are there at once: states hold no values that follow from others, and no words while chunks do."""
    live, most, chunks = {}, [0], []
    write, drop = lm_scoring.Buckets.write, lm_scoring.Buckets.drop

    def wrote(self, df):
        table = write(self, df)
        live[table._name] = files(table)
        if not chunks:
            chunks.append(live[table._name])
        most[0] = max(most[0], sum(live.values()))
        return table

    def dropped(self, table):
        live.pop(table._name)
        drop(self, table)

    monkeypatch.setattr(lm_scoring.Buckets, "write", wrote)
    monkeypatch.setattr(lm_scoring.Buckets, "drop", dropped)
    assert lm_scoring.score(repeating).count() == 600
    assert most[0] < 3 * chunks[0]


def test_rows_of_one_chunk_come_in_one_batch():
    """A batch for a row would cost more than the row where chunks meet many ranges."""
    run = lm_scoring.each(lambda r: ({"x": r["x"] + i} for i in range(r["n"])), ["x"], [pa.int64()])
    batch = pa.RecordBatch.from_pydict({"x": [10, 20, 30], "n": [3, 0, 2]})
    assert [b.column(0).to_pylist() for b in run(iter([batch]))] == [[10, 11, 12], [30, 31]]
    settle = lm_scoring.grouped(lambda group: ({"x": r["x"]} for r in group), ["x"], [pa.int64()])
    batch = pa.RecordBatch.from_pydict({"range": [0, 0, 1], "x": [1, 2, 3]})
    assert [b.column(0).to_pylist() for b in settle(iter([batch]))] == [[1, 2], [3]]


def test_batches_by_bytes_put_both_settings_back(spark):
    from accordis.llm.common import rows_at_once

    names = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    before = [spark.conf.get(n) for n in names]
    with rows_at_once(spark, 7, 1000):
        assert [spark.conf.get(n) for n in names] == ["7", "1000"]
        frame = spark.range(0, 4, 1, 1).selectExpr("repeat('x', 900) AS s").mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in bs), "n long")
        assert max(r.n for r in frame.collect()) <= 2
    assert [spark.conf.get(n) for n in names] == before
