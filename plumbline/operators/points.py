"""Point tables: boxes, clips, voxels, histograms and distance statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import geometry as G
from plumbline.operators.quantiles import with_percentiles
from plumbline.store import stored

XYZ = ("x", "y", "z")


def transform(points: DataFrame, matrix: list[float]) -> DataFrame:
    """points with x, y, z moved by a column-major matrix; a projection, no shuffle."""
    m = F.array(*[F.lit(float(v)) for v in matrix])
    out = G.transform_point(m, *[F.col(c) for c in XYZ])
    return points.withColumns(dict(zip(XYZ, out, strict=True)))


def bounding_box(points: DataFrame, *keys: str) -> DataFrame:
    """min_x .. max_z of each group; partial minima and maxima before the shuffle."""
    aggs = [f(c).alias(f"{n}_{c}") for c in XYZ for n, f in (("min", F.min), ("max", F.max))]
    return points.groupBy(*keys).agg(*aggs)


def box_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """iou of two one-row boxes."""
    left, right = a.select([F.col(c).alias(f"a_{c}") for c in a.columns]), b.select([F.col(c).alias(f"b_{c}") for c in b.columns])
    corner = lambda s, n: tuple(F.col(f"{s}_{n}_{c}") for c in XYZ)
    return left.join(right).select(G.box_iou(corner("a", "min"), corner("a", "max"), corner("b", "min"), corner("b", "max")).alias("iou"))


def clip(points: DataFrame, low: tuple, high: tuple) -> DataFrame:
    """Points inside a box, faces included; an empty box (a low above its high) clips nothing. The bounds are pushed to the scan."""
    if any(a > b for a, b in zip(low, high, strict=True)):
        return points
    keep = None
    for c, a, b in zip(XYZ, low, high, strict=True):
        keep = F.col(c).between(a, b) if keep is None else keep & F.col(c).between(a, b)
    return points.filter(keep)


def effective_box(low: tuple, high: tuple, offsets: dict[str, float], inset: bool = False) -> tuple[tuple, tuple]:
    """A clip box after its six offsets: added to the faces, or inwards from them."""
    get = lambda n: offsets.get(n, 0.0)
    sign = -1 if inset else 1
    return tuple(a + get(f"{c}_min") for c, a in zip(XYZ, low, strict=True)), tuple(b + sign * get(f"{c}_max") for c, b in zip(XYZ, high, strict=True))


def section_offsets(low: tuple, high: tuple, ratio: float) -> dict[str, float]:
    """Offsets of a box whose top is cut so that ratio percent (1 to 100) of its height is left."""
    return {"z_max": -(high[2] - low[2]) * (100 - min(max(ratio, 1), 100)) / 100}


def voxel_mean(points: DataFrame, size: float, *keys: str) -> DataFrame:
    """One mean point and count a voxel. Voxels begin half a voxel below the least point; a single pass of partial sums."""
    if size <= 0:
        return points
    least = points.groupBy(*keys).agg(*[(F.min(c) - size / 2).alias(f"o{c}") for c in XYZ])
    joined = points.join(F.broadcast(least)) if not keys else points.join(least, list(keys))
    cells = [F.floor((F.col(c) - F.col(f"o{c}")) / size).cast("bigint").alias(f"v{c}") for c in XYZ]
    return joined.select("*", *cells).groupBy(*keys, "vx", "vy", "vz").agg(*[F.avg(c).alias(c) for c in XYZ], F.count("*").alias("n"))


def voxel_two_phase(points: DataFrame, size: float, chunk: Column) -> DataFrame:
    """Mean of chunks' voxel means, every chunk counting once: what reading by chunks yields."""
    first = voxel_mean(points.withColumn("chunk", chunk), size, "chunk").select("chunk", *XYZ)
    return voxel_mean(first, size)


def recentre(points: DataFrame) -> DataFrame:
    """points moved so that their box's centre is the origin."""
    box = bounding_box(points)
    centred = points.join(F.broadcast(box))
    return centred.select(*[c for c in points.columns if c not in XYZ], *[(F.col(c) - (F.col(f"min_{c}") + F.col(f"max_{c}")) / 2).alias(c) for c in XYZ])


def distance_statistics(distances: DataFrame, d: str = "d") -> DataFrame:
    """min, max, mean, population deviation and the exact 50th, 90th, 95th and 99th percentiles."""
    kept = stored(distances.select(d), "distances")
    out = kept.agg(F.min(d).alias("min"), F.max(d).alias("max"), F.avg(d).alias("mean"), F.stddev_pop(d).alias("std"), F.count(d).alias("n"))
    return with_percentiles(out, kept, d, {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99})


def histogram(distances: DataFrame, reach: float, bins: int, d: str = "d") -> DataFrame:
    """bin, low, high, n of equal bins over [-reach, reach]; the last bin holds its upper end, values outside count nowhere."""
    reach = max(reach, 1e-6)
    width = 2 * reach / bins
    place = F.least(F.floor((F.col(d) + reach) / width), F.lit(bins - 1)).cast("int")
    found = distances.filter(F.col(d).between(-reach, reach)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    every = distances.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(found), "bin", "left").select("bin", (F.col("bin") * width - reach).alias("low"), ((F.col("bin") + 1) * width - reach).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def overflow_count(distances: DataFrame, reach: float, d: str = "d") -> DataFrame:
    return distances.agg(F.count_if(~F.col(d).between(-reach, reach)).alias("overflow_count"))
