"""Exact top-k by inner product, pruned by segment statistics at several resolutions.

Vectors are first turned by an orthonormal matrix (the principal axes of a block's queries), which leaves inner products as
they are and puts most of them into the first components. At a level, the first components are segments of one, the others
one long segment of which the mean and the deviation are kept: with segments of length L,
<q, x> <= sum of L * (mean_q * mean_x + deviation_q * deviation_x), which is a lower bound on the distance
|q|^2 + |x|^2 - 2 <q, x>. Levels go coarse to fine (LEVELS: shares of the components that stand alone). A pair that can't reach
its query's k-th best score is dropped at the first level that shows it, and the inner products of what is left are computed
exactly from the integers. A query's bar starts at its k-th best score among the queries of its block, which are rows too.

Queries are broadcast in blocks of at most `block` vectors (a bounded number of bytes for a given dimension), and each
block reads all vectors once: no vector is shuffled, a task keeps k rows for each query of the block, and only those meet
in a window by query. Integers are exact: products are summed as doubles where the sum stays below 2**53, else as 64-bit
integers.

Defined results: vectors that are null, or hold null or a non-finite component, take no part, nor do rows with a null
vec_id; a row never is a candidate of a query with its own vec_id; repeated query rows count once, repeated candidates
each; vectors of another dimension than the query's are no candidates; ties go to the smaller vec_id; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, trimmed

LEVELS = (0.0, 0.25, 0.5, 0.75, 0.875)
BLOCK = 8192
#: Vectors and queries that meet at once: memory for that many pairs, a few times over.
VECTORS, QUERIES = 1024, 128


def scaled(vectors: DataFrame) -> DataFrame:
    """vec_id and the components' floor(256 x) as longs, without vectors that take no part."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    sound = F.forall(x, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)) & ~F.isnan(v))
    rows = vectors.select("vec_id", x.alias("x")).filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & sound)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("x", lambda v: F.floor(v * 256).cast("long")).alias("x"))


def tail(x: np.ndarray, first: int) -> tuple[np.ndarray, int]:
    """[mean, deviation] of the components from `first` on, and how many these are."""
    rest = x[:, first:]
    n = rest.shape[1]
    return (np.stack((rest.mean(axis=1), rest.std(axis=1)), 1) if n else np.zeros((len(x), 2))), n


def axes(queries: np.ndarray) -> np.ndarray:
    """The principal axes of some vectors, strongest first, as columns of an orthonormal matrix."""
    _, vectors = np.linalg.eigh(queries.T @ queries)
    return np.ascontiguousarray(vectors[:, ::-1])


def reaches(bound: np.ndarray, least: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether a bound, with room for rounding at that product of lengths, isn't below the bar."""
    return bound + size * 1e-11 + 1e-3 >= least


class Searcher:
    """The k best candidates of each query of a block, over batches of vectors."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int) -> None:
        self.ids, self.q, self.k = ids, queries, k
        self.wide = queries.astype(np.float64)
        dim = queries.shape[1]
        self.largest = float(np.abs(self.wide).max()) if queries.size else 0.0
        self.axes = axes(self.wide) if dim else np.zeros((0, 0))
        self.turned = self.wide @ self.axes
        self.firsts = sorted({round(dim * share) for share in LEVELS})
        self.tails = [tail(self.turned, first) for first in self.firsts]
        self.length = np.sqrt((self.wide**2).sum(axis=1))
        self.rows = np.zeros((0, 3), np.int64)  # query number, vec_id, score
        self.least = self.bar()  # scores below these can't count
        #: Pairs met, pairs left after each level.
        self.left = np.zeros(len(self.firsts) + 1, np.int64)

    def exact(self, x: np.ndarray) -> bool:
        """Whether products with x are exact as sums of doubles."""
        return x.size == 0 or self.largest * float(np.abs(x).max()) * x.shape[1] < 2**53

    def bar(self) -> np.ndarray:
        """The k-th best score of each query among the others, where that is exact as a double."""
        least = np.full(len(self.ids), -np.inf)
        if len(self.ids) > self.k and self.exact(self.wide):
            for a in range(0, len(self.ids), QUERIES):
                scores = self.wide[a : a + QUERIES] @ self.wide.T
                scores[self.ids[a : a + QUERIES][:, None] == self.ids[None, :]] = -np.inf
                least[a : a + QUERIES] = np.partition(scores, -self.k, axis=1)[:, -self.k]
        return least

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        for a in range(0, len(ids), VECTORS):
            self.look(ids[a : a + VECTORS], x[a : a + VECTORS])

    def look(self, ids: np.ndarray, x: np.ndarray) -> None:
        """One block of vectors against all queries, some queries at a time."""
        wide = x.astype(np.float64)
        exact, turned = self.exact(wide), wide @ self.axes
        tails, length = [tail(turned, first)[0] for first in self.firsts], np.sqrt((wide**2).sum(axis=1))
        found = [self.rows]
        for a in range(0, len(self.ids) if len(ids) else 0, QUERIES):
            part = slice(a, a + QUERIES)
            least, q = self.least[part], self.turned[part]
            i, j = np.nonzero(self.ids[part][:, None] != ids[None, :])
            self.left[0] += len(i)
            dot, done = np.zeros(len(i)), 0
            for level, first in enumerate(self.firsts):
                of_query, n = self.tails[level]
                if len(i) * 8 > len(q) * len(x):  # most are left: all pairs at once
                    dot += (q[:, done:first] @ turned[:, done:first].T)[i, j]
                    rest = ((of_query[part] * n) @ tails[level].T)[i, j]
                else:
                    dot += np.einsum("ij,ij->i", q[i, done:first], turned[j, done:first])
                    rest = np.einsum("ij,ij->i", of_query[part][i] * n, tails[level][j])
                ok = reaches(dot + rest, least[i], self.length[part][i] * length[j])
                i, j, dot, done = i[ok], j[ok], dot[ok], first
                self.left[level + 1] += len(i)
            if not len(i):
                continue
            if exact:
                scores = np.concatenate([np.einsum("ij,ij->i", self.wide[part][i[c : c + 50_000]], wide[j[c : c + 50_000]]) for c in range(0, len(i), 50_000)]).astype(np.int64)
            else:
                scores = np.concatenate([(self.q[part][i[c : c + 10_000]] * x[j[c : c + 10_000]]).sum(axis=1) for c in range(0, len(i), 10_000)])
            good = scores >= least[i]
            found.append(np.stack((i[good] + a, ids[j[good]], scores[good]), 1))
        self.rows = np.concatenate(found)
        self.trim()

    def trim(self) -> None:
        r = self.rows[np.lexsort((self.rows[:, 1], -self.rows[:, 2], self.rows[:, 0]))]
        first = np.searchsorted(r[:, 0], r[:, 0])
        place = np.arange(len(r)) - first
        self.rows = r[place < self.k]
        full = r[place == self.k - 1]
        self.least[full[:, 0]] = np.maximum(self.least[full[:, 0]], full[:, 2])


def search(vectors: DataFrame, every: int = 50, k: int = 5, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score: the k best of all rows for each row whose vec_id is divisible by `every`."""
    spark = vectors.sparkSession
    rows = scaled(vectors)
    queries = materialize(rows.filter(F.col("vec_id") % every == 0).distinct().withColumn("dim", F.size("x")))
    n = queries.count()
    blocks = max(1, -(-n // block) * 2 if n > block else 1)
    numbered = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", "x"), F.lit(blocks)))
    if blocks > 1:  # a folder for each block, so that each is read once
        numbered = materialize(numbered, "dim", "block")
    parts = []
    for dim in sorted(r["dim"] for r in queries.select("dim").distinct().collect()):
        for b in range(blocks):
            got = numbered.filter((F.col("block") == b) & (F.col("dim") == dim)).select("vec_id", "x").toArrow()
            if got.num_rows:
                ids = got.column(0).to_numpy()
                matrix = np.concatenate([c.values.to_numpy() for c in got.column(1).chunks]).reshape(len(ids), dim) if dim else np.zeros((len(ids), 0), np.int64)
                order = np.argsort(ids, kind="stable")
                parts.append(_block(rows.filter(F.size("x") == dim), spark.sparkContext.broadcast((ids[order], matrix[order])), dim, k, blocks > 1))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = parts[0]
    for p in parts[1:]:
        best = best.unionAll(p)
    # a query that stands in the table with several vectors has several numbers
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "_of").orderBy(F.col("score").desc(), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _block(rows: DataFrame, shared, dim: int, k: int, write: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(*shared.value, k)
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)
            searcher.add(batch.column(0).to_numpy(), x)
        r = searcher.rows
        yield pa.RecordBatch.from_arrays([pa.array(searcher.ids[r[:, 0]]), pa.array(r[:, 0]), pa.array(r[:, 1]), pa.array(r[:, 2])], names=["query_id", "_of", "vec_id", "score"])

    best = rows.mapInArrow(trimmed(run), "query_id long, _of long, vec_id long, score long")
    return materialize(best) if write else best
