"""Exact nearest items by leaves: a bounded number of boxes that part queries or items, known to every task.

The leaves are those of a k-d tree over a bounded sample of places; the sample only says where to cut, every row is in a leaf, and a leaf's box is that of all its rows.
Each task compares its rows with all leaves' boxes at once, so a row is shuffled to the leaves that matter for it and nowhere else, and each leaf's rows meet in Arrow
groups of bounded size. Points are parted themselves, and each query goes to the leaves that may hold one of its nearest. Triangles may be as large as the model, so that
no parting of them tells near from far; there the queries are parted, and each triangle goes to the leaves whose queries it may be nearest to.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from plumbline.store import stored

AXES = ("x", "y", "z")
#: Most leaves, places that say where to cut, and rows of a leaf below which it isn't parted.
LEAVES, SAMPLE, FULL_POINTS, FULL_QUERIES = 4096, 1 << 16, 256, 64
#: Rows of either side that meet at once; pairs compared at once.
GROUP, BLOCK = 50_000, 1 << 20
#: Triangles that first bounds are taken from, and how many of them are measured for a query.
FIRST, MEASURED = 2048, 16
#: Slack of comparisons of squared distances.
SLACK = 1 + 1e-9


class Cuts:
    """A k-d tree's cuts, node i over nodes 2i and 2i + 1: the widest axis at the median."""

    def __init__(self, sample: np.ndarray, leaves: float) -> None:
        self.depth = max(0, min(int(math.log2(LEAVES)), math.floor(math.log2(max(1.0, leaves)))))
        self.axis, self.cut = np.zeros(1 << self.depth, dtype=np.int64), np.full(1 << self.depth, np.inf)
        rows = {1: sample}
        for node in range(1, 1 << self.depth):
            here = rows.pop(node)
            if len(here):
                axis = int(np.argmax(here.max(axis=0) - here.min(axis=0)))
                self.axis[node], self.cut[node] = axis, np.partition(here[:, axis], (len(here) - 1) // 2)[(len(here) - 1) // 2]
            low = here[:, self.axis[node]] <= self.cut[node]
            rows[2 * node], rows[2 * node + 1] = here[low], here[~low]

    def leaf(self, places: np.ndarray) -> np.ndarray:
        node, row = np.ones(len(places), dtype=np.int64), np.arange(len(places))
        for _ in range(self.depth):
            node = 2 * node + (places[row, self.axis[node]] > self.cut[node])
        return node


def _numbers(rows: pa.RecordBatch | pa.Table, columns: list[str]) -> np.ndarray:
    return np.column_stack([np.asarray(rows.column(c).to_numpy(zero_copy_only=False) if isinstance(rows, pa.RecordBatch) else rows.column(c).to_numpy(), dtype=np.float64) for c in columns]).reshape(-1, len(columns))


def _finite(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that have a place: no coordinate is null, NaN or infinite."""
    return rows.filter(" and ".join(f"abs({c}) < double('Infinity')" for c in columns))


def _sampled(rows: DataFrame, columns: list[str], count: int, most: int) -> np.ndarray:
    """About `most` of the rows' columns at most, told by hashes of their values, so that every run gets the same."""
    if count > most:
        rows = rows.filter(F.pmod(F.xxhash64(*columns), F.lit(count)) < most).limit(2 * most)
    return _numbers(rows.select(*[F.col(c).cast("double").alias(c) for c in columns]).toArrow(), columns)


def _with(schema: StructType, **more: type) -> StructType:
    return StructType([*schema.fields, *[StructField(c, t()) for c, t in more.items()]])


def _in_leaves(rows: DataFrame, columns: list[str], cuts: Cuts) -> DataFrame:
    """rows with their _leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cuts.leaf(_numbers(batch, columns)))], [*batch.schema.names, "_leaf"])

    return rows.mapInArrow(run, _with(rows.schema, _leaf=LongType))


def _squares(gaps: np.ndarray) -> np.ndarray:
    return gaps[..., 0] * gaps[..., 0] + gaps[..., 1] * gaps[..., 1] + gaps[..., 2] * gaps[..., 2]


def _met(queries: DataFrame, items: DataFrame, pairs: Callable[[pa.Table, pa.Table], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """The columns of those queries and items of one leaf that `pairs` says. Leaves of many rows meet in parts of GROUP rows of each side."""
    sizes = queries.groupBy("_leaf").agg(F.count("*").alias("q")).join(items.groupBy("_leaf").agg(F.count("*").alias("i")), "_leaf").collect()
    spark, names = queries.sparkSession, [c for c in queries.columns if c != "_leaf"] + [c for c in items.columns if c != "_leaf"]
    parted = [(r["_leaf"], math.ceil(r["q"] / GROUP), math.ceil(r["i"] / GROUP)) for r in sizes if max(r["q"], r["i"]) > GROUP]
    zero = F.lit(0).cast("bigint")
    if parted:
        parts = F.broadcast(spark.createDataFrame(parted, "_leaf bigint, _q bigint, _i bigint"))
        one = lambda rows, n: F.pmod(F.xxhash64(*[c for c in rows.columns if c != "_leaf"]), F.coalesce(n, F.lit(1)))
        each = lambda n: F.explode(F.sequence(zero, F.coalesce(n, F.lit(1)) - 1))
        whole = F.coalesce("_i", F.lit(1))
        left = queries.join(parts, "_leaf", "left").withColumn("_b", each(F.col("_i"))).withColumn("_part", one(queries, F.col("_q")) * whole + F.col("_b")).select(*queries.columns, "_part")
        right = items.join(parts, "_leaf", "left").withColumn("_a", each(F.col("_q"))).withColumn("_part", F.col("_a") * whole + one(items, F.col("_i"))).select(*items.columns, "_part")
    else:
        left, right = queries.withColumn("_part", zero), items.withColumn("_part", zero)

    def run(q: pa.Table, i: pa.Table) -> pa.Table:
        rows, of = pairs(q, i) if q.num_rows and i.num_rows else (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))
        one, other = q.drop_columns(["_leaf", "_part"]).take(pa.array(rows)), i.drop_columns(["_leaf", "_part"]).take(pa.array(of))
        return pa.Table.from_arrays([*one.columns, *other.columns], names)

    schema = StructType([f for f in (*queries.schema.fields, *items.schema.fields) if f.name != "_leaf"])
    # By a number of partitions of its own: the rows are few megabytes, and their comparing is what takes time.
    tasks, key = int(spark.conf.get("spark.sql.shuffle.partitions")), ["_leaf", "_part"]
    return left.repartition(tasks, *key).groupBy(*key).cogroup(right.repartition(tasks, *key).groupBy(*key)).applyInArrow(run, schema)


class Points:
    """Points (px, py, pz and more) to find the nearest of. Only a sample and the leaves' boxes and counts reach the driver."""

    def __init__(self, points: DataFrame, k: int) -> None:
        place = ["px", "py", "pz"]
        self.most, points = k, _finite(points, place)
        count = points.count()
        cuts = Cuts(_sampled(points, place, count, SAMPLE), count / max(FULL_POINTS, 4 * k))
        self.points = _in_leaves(points, place, cuts)
        boxes = self.points.groupBy("_leaf").agg(F.count("*").alias("n"), *[f(c).alias(f"{e}{c}") for e, f in (("lo_", F.min), ("hi_", F.max)) for c in place]).orderBy("_leaf").toArrow()
        self.ids, self.counts = boxes.column("_leaf").to_numpy(), boxes.column("n").to_numpy()
        self.low, self.high = (_numbers(boxes, [f"{e}{c}" for c in place]) for e in ("lo_", "hi_"))

    def pairs(self, queries: DataFrame, k: int, reach: float | None) -> DataFrame:
        """queries' columns (x, y, z and more) with those of every point that may be among a query's k nearest, ties included, and within reach."""
        ids, low, high, enough = self.ids, self.low, self.high, self.counts >= k
        limit = math.inf if reach is None else reach * reach

        def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first in range(0, batch.num_rows, 128):
                    some = batch.slice(first, 128)
                    at = _numbers(some, list(AXES))[:, None, :]
                    least = _squares(np.maximum(np.maximum(low - at, at - high), 0.0))
                    bound = np.full(len(least), limit)
                    if enough.any():
                        bound = np.minimum(bound, _squares(np.maximum(np.abs(low[enough] - at), np.abs(high[enough] - at))).min(axis=1))
                    bound = bound * SLACK
                    row, leaf = np.nonzero(least <= bound[:, None])
                    yield pa.RecordBatch.from_arrays([*some.take(pa.array(row)).columns, pa.array(bound[row]), pa.array(ids[leaf])], [*some.schema.names, "_bound", "_leaf"])

        def nearest(q: pa.Table, i: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            at, bound, place, found = _numbers(q, list(AXES)), q.column("_bound").to_numpy(), _numbers(i, ["px", "py", "pz"]), []
            step = max(1, BLOCK // len(place))
            for first in range(0, len(at), step):
                d2 = sum((np.square(place[:, c] - at[first : first + step, c, None]) for c in (1, 2)), np.square(place[:, 0] - at[first : first + step, 0, None]))
                last = d2.min(axis=1) if k == 1 else np.partition(d2, k - 1, axis=1)[:, k - 1] if k < len(place) else np.full(len(d2), np.inf)
                row, of = np.nonzero(d2 <= np.minimum(last * SLACK, bound[first : first + step])[:, None])
                found.append((row + first, of))
            return np.concatenate([r for r, _ in found]), np.concatenate([o for _, o in found])

        asked = _finite(queries, list(AXES))
        if not len(ids):
            return asked.join(self.points.drop("_leaf"), F.lit(False))
        sent = stored(asked.mapInArrow(routed, _with(asked.schema, _bound=DoubleType, _leaf=LongType)), "routed")
        return _met(sent, self.points, nearest).drop("_bound")


def _planes(corners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit normal (zero without an area), offset, least and greatest corner of triangles (n, 3, 3)."""
    normal = np.cross(corners[:, 1] - corners[:, 0], corners[:, 2] - corners[:, 0])
    size = np.linalg.norm(normal, axis=1, keepdims=True)
    # Of slivers, whose normals are mostly rounding, the box alone tells.
    longest = np.square(corners - np.roll(corners, 1, axis=1)).sum(axis=2).max(axis=1, keepdims=True)
    normal = np.where(size > 1e-9 * longest, normal / np.where(size > 0, size, 1.0), 0.0)
    return normal, (normal * corners[:, 0]).sum(axis=1), corners.min(axis=1), corners.max(axis=1)


def _least_gaps(at: np.ndarray, planes: tuple) -> np.ndarray:
    """For each place and triangle a distance that the true one isn't below: the greater of those to its plane and to its box."""
    normal, offset, low, high = planes
    out = np.abs(at @ normal.T - offset)
    square = np.zeros_like(out)
    for c in range(3):
        x = at[:, c, None]
        square += np.square(np.maximum(np.maximum(low[:, c] - x, x - high[:, c]), 0.0))
    return np.maximum(out, np.sqrt(square, out=square), out=out)


def _gaps(at: np.ndarray, corners: np.ndarray) -> np.ndarray:
    """Distance of each place to its triangle (n, 3, 3): to the foot in its plane if that is inside, else to the nearest edge."""
    normal = _planes(corners)[0]
    inside = (normal != 0).any(axis=1)
    edge = np.full(len(at), np.inf)
    for k in range(3):
        start, way = corners[:, k], corners[:, (k + 1) % 3] - corners[:, k]
        inside &= (np.cross(way, at - start) * normal).sum(axis=1) >= 0
        square = (way * way).sum(axis=1)
        t = np.clip(((at - start) * way).sum(axis=1) / np.where(square > 0, square, 1.0), 0.0, 1.0)
        edge = np.minimum(edge, np.linalg.norm(at - start - t[:, None] * way, axis=1))
    return np.where(inside, np.minimum(edge, np.abs(((at - corners[:, 0]) * normal).sum(axis=1))), edge)


def closest_triangles(queries: DataFrame, triangles: DataFrame) -> DataFrame:
    """queries' columns (x, y, z and more) with hit and the corners of every triangle that may be nearest to one, ties included.

    triangles: hit and the corners a_x .. c_z, stored. Only a sample of each side and the leaves' boxes reach the driver.
    """
    corner = [f"{n}_{c}" for n in "abc" for c in AXES]
    triangles = _finite(triangles.select("hit", *corner), corner)
    asked = stored(_finite(queries, list(AXES)), "asked")
    n, m = asked.count(), triangles.count()
    if not n or not m:
        return asked.join(triangles, F.lit(False))
    first = _sampled(triangles, corner, m, FIRST)
    if not len(first):
        first = _numbers(triangles.limit(FIRST).select(*corner).toArrow(), corner)
    first = first.reshape(-1, 3, 3)
    cuts, some = Cuts(_sampled(asked, list(AXES), n, SAMPLE), n / FULL_QUERIES), _planes(first)
    # Rounding of distances between places so far from the origin.
    span = asked.agg(F.max(F.greatest(*[F.abs(F.col(c).cast("double")) for c in AXES]))).first()[0] + triangles.agg(F.max(F.greatest(*[F.abs(c) for c in corner]))).first()[0]
    slack = 1e-12 * span + 1e-300

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _numbers(batch, list(AXES))
            bound = np.empty(len(at))
            for start in range(0, len(at), 256):
                here = at[start : start + 256]
                least = _least_gaps(here, some)
                count = min(MEASURED, len(first))
                tried = np.argpartition(least, count - 1, axis=1)[:, :count]
                bound[start : start + 256] = _gaps(np.repeat(here, count, axis=0), first[tried.ravel()]).reshape(-1, count).min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bound * SLACK + slack), pa.array(cuts.leaf(at))], [*batch.schema.names, "_bound", "_leaf"])

    dealt = stored(asked.mapInArrow(bounded, _with(asked.schema, _bound=DoubleType, _leaf=LongType)), "dealt")
    boxes = dealt.groupBy("_leaf").agg(F.max("_bound").alias("reach"), *[f(F.col(c).cast("double")).alias(f"{e}{c}") for e, f in (("lo_", F.min), ("hi_", F.max)) for c in AXES]).toArrow()
    ids, reach = boxes.column("_leaf").to_numpy(), boxes.column("reach").to_numpy()
    low, high = (_numbers(boxes, [f"{e}{c}" for c in AXES]) for e in ("lo_", "hi_"))
    middle, half = (low + high) / 2, (high - low) / 2 * SLACK

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                normal, offset, least, most = _planes(_numbers(part, corner).reshape(-1, 3, 3))
                near = np.abs(normal @ middle.T - offset[:, None]) - np.abs(normal) @ half.T <= reach
                square = np.zeros(near.shape)
                for c in range(3):
                    square += np.square(np.maximum(np.maximum(low[:, c] - most[:, c, None], least[:, c, None] - high[:, c]), 0.0))
                row, leaf = np.nonzero(near & (square <= reach * reach))
                yield pa.RecordBatch.from_arrays([*part.take(pa.array(row)).columns, pa.array(ids[leaf])], [*part.schema.names, "_leaf"])

    def nearest(q: pa.Table, i: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        at, bound, corners, found = _numbers(q, list(AXES)), q.column("_bound").to_numpy(), _numbers(i, corner).reshape(-1, 3, 3), []
        planes, step = _planes(corners), max(1, BLOCK // len(corners))
        for start in range(0, len(at), step):
            row, of = np.nonzero(_least_gaps(at[start : start + step], planes) <= bound[start : start + step, None])
            row += start
            gap = _gaps(at[row], corners[of])
            best = np.full(len(at), np.inf)
            np.minimum.at(best, row, gap)
            kept = gap <= np.minimum(best[row] * SLACK + slack, bound[row])
            found.append((row[kept], of[kept]))
        return np.concatenate([r for r, _ in found]), np.concatenate([o for _, o in found])

    sent = stored(triangles.mapInArrow(routed, _with(triangles.schema, _leaf=LongType)), "routed")
    return _met(dealt, sent, nearest).drop("_bound")
