"""Approximate nearest neighbours by collision counting (operator 8).

Every vector is projected on PROJECTIONS random lines; a block of vectors keeps each line's values as a sorted array. A
query opens a window around its own value on every line and widens all of them step by step (virtual rehashing); a vector
that lies in the windows of THRESHOLD of the lines is a candidate and is verified by its exact inner product. Widening
ends when a vector as far as the k-th best so far would by now have passed the threshold with a chance of about 86 %, so
recall doesn't hang on the data's scale (Gan et al., 2012; Huang et al., 2015).

Largest inner products become least distances by one more component: vectors are scaled into the unit ball by the largest
norm and lifted on the sphere, queries are scaled to length one.

Vectors are dealt into blocks of bounded size, one a task: the task indexes its block once and streams all queries past it
in batches; each returns its k best of the block, and the k best of these are a query's result. Routing windows to ranges of
the lines instead would move a row for every collision: where the nearest vectors are but slightly nearer than the others
(random directions of 64 components: 1.1 against 1.4), windows cover three quarters of every line.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, or have no vec_id, take no
part; vectors meet only vectors of their own dimension; a row is never its own neighbour, other rows are, even if alike in
vec_id and vector; rows repeated are queries each; with fewer than k candidates all are returned; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import stored, table

PROJECTIONS, THRESHOLD = 48, 0.75
#: The k-th best must have passed the threshold by so many standard deviations before the windows stop widening.
SURE = 1.1
#: Half a window's first width, in units of the sphere's radius, and the factor of each step: the coarse one until some
#: vector's count is at a part of the threshold, then the fine one.
FIRST, COARSE, FINE, NEARLY = 0.08, 1.45, 1.18, 0.6
#: Most vectors of a block; tables are dealt into two blocks a core as long as these have LEAST_BLOCK vectors.
BLOCK, LEAST_BLOCK = 16_384, 12_288
#: Queries that a task works on at once.
QUERY_BATCH = 256


def _normal_cdf(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


class CollisionIndex:
    """Sorted projections of one block of vectors (rows of a matrix of doubles)."""

    def __init__(self, vectors: np.ndarray, largest: float, seed: int = 0) -> None:
        self.vectors, self.largest, self.verified = vectors, largest, 0
        lines = np.random.default_rng(seed).standard_normal((vectors.shape[1] + 1, PROJECTIONS))
        scaled = vectors / largest
        lift = np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", scaled, scaled)))
        values = np.column_stack([scaled, lift]) @ lines
        self.order = np.ascontiguousarray(np.argsort(values, axis=0, kind="stable").T)
        self.values = np.ascontiguousarray(np.sort(values, axis=0).T)
        self.lines = lines[:-1]

    def search(self, queries: np.ndarray, k: int, own: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(places, inner products) of each query's k best verified vectors, ties with the last included; own: places that are the query itself."""
        n, m = len(self.vectors), len(queries)
        norms = np.sqrt(np.einsum("ij,ij->i", queries, queries))
        centres = np.ascontiguousarray((queries / norms[:, None] @ self.lines).T)
        low = np.stack([np.searchsorted(v, c) for v, c in zip(self.values, centres, strict=True)])
        high = low.copy()
        searches = [_Search(self, q, k, float(norm), o) for q, norm, o in zip(queries, norms, own, strict=True)]
        active, half = np.arange(m), np.full(m, FIRST)
        while len(active):
            new_low, new_high = low.copy(), high.copy()
            for line, (values, centre) in enumerate(zip(self.values, centres, strict=True)):
                new_low[line, active] = np.minimum(low[line, active], np.searchsorted(values, centre[active] - half[active], "left"))
                new_high[line, active] = np.maximum(high[line, active], np.searchsorted(values, centre[active] + half[active], "right"))
            going = [searches[i].widen(low[:, i], new_low[:, i], high[:, i], new_high[:, i], float(half[i])) for i in active]
            low, high, active = new_low, new_high, active[np.array(going)]
            half[active] *= [searches[i].factor for i in active]
        self.verified += sum(s.verified for s in searches)
        return [(s.found, s.scores) for s in searches]


class _Search:
    """One query's collision counts in a block, and what has been verified."""

    def __init__(self, index: CollisionIndex, query: np.ndarray, k: int, norm: float, own: np.ndarray) -> None:
        self.index, self.query, self.k, self.norm = index, query, k, norm
        n = len(index.vectors)
        self.count, self.verified = np.zeros(n, dtype=np.int64), 0
        self.count[own] = -2 * PROJECTIONS  # what has been verified, or is the query itself, never passes again
        self.found, self.scores = np.empty(0, np.int64), np.empty(0)
        self.factor, self.least = COARSE, math.ceil(THRESHOLD * PROJECTIONS)

    def widen(self, low: np.ndarray, new_low: np.ndarray, high: np.ndarray, new_high: np.ndarray, half: float) -> bool:
        """Counts what the windows have gained; False once nothing near is likely to be missing."""
        index, n = self.index, len(self.count)
        parts = [o[a:b] for o, a, b in zip(index.order, new_low.tolist(), low.tolist(), strict=True)]
        parts += [o[a:b] for o, a, b in zip(index.order, high.tolist(), new_high.tolist(), strict=True)]
        self.count += np.bincount(np.concatenate(parts), minlength=n)
        if self.factor == COARSE and self.count.max() >= NEARLY * self.least:
            self.factor = FINE
        passed = np.flatnonzero(self.count >= self.least)
        if len(passed):
            self.count[passed] = -2 * PROJECTIONS
            self.verified += len(passed)
            self.found = np.concatenate([self.found, passed])
            self.scores = np.concatenate([self.scores, index.vectors[passed] @ self.query])
            if len(self.scores) > self.k:
                kept = self.scores >= np.partition(self.scores, len(self.scores) - self.k)[len(self.scores) - self.k]
                self.found, self.scores = self.found[kept], self.scores[kept]
        if len(self.scores) >= self.k:
            far = math.sqrt(max(1e-12, 2 - 2 * self.scores.min() / (self.norm * index.largest)))
            p = 2 * _normal_cdf(half / far) - 1
            if p - SURE * math.sqrt(p * (1 - p) / PROJECTIONS) >= THRESHOLD:
                return False
        return new_low.max() > 0 or new_high.min() < n


def usable(df: DataFrame) -> DataFrame:
    """(row, vec_id, v, dim) of the rows that take part, vectors as doubles. row: a number of the row's own; store the result before use."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.filter(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", v.alias("v"), F.size("embedding").alias("dim"))


FOUND = "query_row bigint, query_id bigint, vec_id bigint, score double"


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)


def _best(index: CollisionIndex, block: pa.RecordBatch, asked: pa.RecordBatch, k: int) -> pa.RecordBatch:
    """The k best of a block for each of some queries."""
    ids, rows = block.column("vec_id").to_numpy(), block.column("row").to_numpy()
    by_row = np.argsort(rows)
    ends = [np.searchsorted(rows[by_row], asked.column("row").to_numpy(), side) for side in ("left", "right")]
    own = [by_row[a:b] for a, b in zip(*ends, strict=True)]
    best = []
    vectors, queries = index.vectors, _matrix(asked)
    for query, (places, scores) in zip(queries, index.search(queries, k, own), strict=True):
        scores = np.einsum("ij,j->i", vectors[places], query)  # one order of summation, whatever else was verified
        order = np.lexsort((ids[places], -scores))[:k]
        best.append((places[order], scores[order]))
    at = pa.array(np.repeat(np.arange(len(best)), [len(p) for p, _ in best]))
    columns = [asked.column("row").take(at), asked.column("vec_id").take(at), pa.array(ids[np.concatenate([p for p, _ in best])]), pa.array(np.concatenate([s for _, s in best]))]
    return pa.RecordBatch.from_arrays(columns, names=["query_row", "query_id", "vec_id", "score"])


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score) of queries and vectors as `usable` gives them, stored."""
    n, largest = vectors.agg(F.count("*"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))).first()
    blocks = max(1, -(-n // BLOCK), min(-(-n // LEAST_BLOCK), 2 * vectors.sparkSession.sparkContext.defaultParallelism))
    columns = ("dim", "block", "is_query", "row", "vec_id", "v")
    left = vectors.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")).withColumn("is_query", F.lit(False))
    right = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("is_query", F.lit(True))
    # A block's vectors come first in its task, then the queries.
    dealt = left.select(*columns).unionAll(right.select(*columns)).repartitionByRange(blocks, "dim", "block").sortWithinPartitions("dim", "block", "is_query")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of, index, block = [], None, None, None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("dim", "block", "is_query")])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                part = batch.slice(a, b - a)
                if tuple(keys[:2, a]) != of:
                    held, of, index = [], tuple(keys[:2, a]), None
                if not keys[2, a]:
                    held.append(part)
                elif held:
                    if index is None:
                        block = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                        index = CollisionIndex(_matrix(block), largest)
                    for c in range(0, part.num_rows, QUERY_BATCH):
                        yield _best(index, block, part.slice(c, QUERY_BATCH), k)

    met = dealt.mapInArrow(search, FOUND)
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = stored(usable(table(spark, sf_dir, "embeddings")), "vectors")
    return neighbours(vectors, vectors.filter(F.pmod("vec_id", F.lit(20)) == 0))
