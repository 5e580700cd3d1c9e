"""Exact nearest-neighbour joins, by leaves of bounded number: no nested loop, however far the points are."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions import geometry as G
from plumbline.operators.leaves import Points
from plumbline.store import stored


def _distinct(points: DataFrame, k: int) -> DataFrame:
    """Of points at the same place the k of least id: no leaf parts them, and ties go to these. Reduced before they are shuffled."""
    place = ["px", "py", "pz"]
    if k > 1:
        rank = F.row_number().over(Window.partitionBy(*place).orderBy("point_id"))
        return points.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")
    least = points.groupBy(*place).agg(F.min(F.struct("point_id", *[c for c in points.columns if c not in (*place, "point_id")])).alias("p"))
    return least.select(*[c if c in place else F.col(f"p.{c}").alias(c) for c in points.columns])


def index(points: DataFrame, *more: str, k: int = 1) -> Points:
    """Points (point_id, x, y, z, more) in leaves, for several searches of up to k nearest each."""
    # Adding zero makes -0.0 and 0.0 one place.
    placed = points.select("point_id", *[(F.col(a).cast("double") + 0.0).alias(f"p{a}") for a in ("x", "y", "z")], *more)
    return Points(stored(_distinct(placed, k), "places"), k)


def candidate_pairs(vertices: DataFrame, points: DataFrame | Points, k: int = 1, reach: float | None = None) -> DataFrame:
    """vertices' columns, point_id (and the index's further columns), d2 and dx, dy, dz of every point that may be among a vertex's k nearest."""
    found = points if isinstance(points, Points) else index(points, k=k)
    if found.most < k:
        raise ValueError(f"the index was made for {found.most} nearest points, not {k}")
    joined = found.pairs(vertices, k, reach)
    dx, dy, dz = F.col("px") - F.col("x"), F.col("py") - F.col("y"), F.col("pz") - F.col("z")
    return joined.select(*[c for c in joined.columns if c not in ("px", "py", "pz")], dx.alias("dx"), dy.alias("dy"), dz.alias("dz"), (dx * dx + dy * dy + dz * dz).alias("d2"))


def _side():
    return G.dot((F.col("nx"), F.col("ny"), F.col("nz")), (F.col("dx"), F.col("dy"), F.col("dz")))


def _signed(best: str):
    return F.when(F.col(f"{best}.side") >= 0, 1.0).otherwise(-1.0) * F.sqrt(f"{best}.d2")


def nearest(vertices: DataFrame, points: DataFrame | Points) -> DataFrame:
    """vertex_id, point_id, d: the nearest point, signed by the side of the normal it lies on (zero counts as outside).

    Ties go to the least point_id. Without points every vertex has null.
    """
    best = candidate_pairs(vertices, points).groupBy("vertex_id").agg(F.min(F.struct("d2", "point_id", _side().alias("side"))).alias("b"))
    return vertices.select("vertex_id").join(best.select("vertex_id", "b.point_id", _signed("b").alias("d")), "vertex_id", "left")


def nearest_constrained(vertices: DataFrame, points: DataFrame | Points, k: int = 8, max_angle: float = 75.0, half_space: bool = True, enabled: bool = True) -> DataFrame:
    """vertex_id, point_id, d, valid: of the k nearest points the nearest that lies along the normal, else the nearest.

    With k <= 1 or the constraint off this is `nearest`, valid being null.
    """
    if k <= 1 or not enabled:
        return nearest(vertices, points).withColumn("valid", F.lit(None).cast("boolean"))
    fine = _side() / F.greatest(F.sqrt("d2"), F.lit(1e-12)) >= math.cos(math.radians(max_angle))
    fine = fine & (_side() >= 0) if half_space else fine
    ranked = candidate_pairs(vertices, points, k).select("vertex_id", "d2", "point_id", fine.alias("fine"), F.struct("d2", "point_id", _side().alias("side")).alias("c"))
    rank = F.row_number().over(Window.partitionBy("vertex_id").orderBy("d2", "point_id"))
    kept = ranked.withColumn("rank", rank).filter(F.col("rank") <= k)
    best = kept.groupBy("vertex_id").agg(F.min("c").alias("any"), F.min(F.when(F.col("fine"), F.col("c"))).alias("good"))
    best = best.withColumn("b", F.coalesce("good", "any"))
    return vertices.select("vertex_id").join(best.select("vertex_id", "b.point_id", _signed("b").alias("d"), F.col("good").isNotNull().alias("valid")), "vertex_id", "left")


def within_radius(sources: DataFrame, targets: DataFrame | Points, radius: float, *more: str) -> DataFrame:
    """vertex_id, point_id, d2 (and more of the targets' columns) of the nearest target within radius of each source."""
    pairs = candidate_pairs(sources.select("vertex_id", "x", "y", "z"), targets, 1, radius).filter(F.col("d2") <= radius * radius)
    best = pairs.groupBy("vertex_id").agg(F.min(F.struct("d2", "point_id", *more)).alias("b"))
    return best.select("vertex_id", "b.point_id", "b.d2", *[f"b.{c}" for c in more])


def registration_quality(sources: DataFrame, matches: DataFrame) -> DataFrame:
    """fitness (matched share of the sources) and inlier_rmse."""
    joined = sources.select("vertex_id").join(matches, "vertex_id", "left")
    return joined.agg((F.count("d2") / F.count("*")).alias("fitness"), F.coalesce(F.sqrt(F.avg("d2")), F.lit(0.0)).alias("inlier_rmse"))
