"""Cloud-to-mesh comparison: voxels, transform, overlap, signed distances, statistics, smoothing and colours."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.color import distance_color
from plumbline.operators import mesh, neighbours, points
from plumbline.store import stored


@dataclass
class C2MParams:
    voxel_size: float = 0.05
    max_distance: float = 0.3
    tolerance: float = 0.05
    histogram_bins: int = 50
    knn_k: int = 8
    normal_constraint: bool = True
    half_space_only: bool = True
    max_angle: float = 75.0
    smooth_rounds: int = 5
    smooth_strength: float = 0.5


@dataclass
class C2MResult:
    distances: DataFrame
    statistics: DataFrame
    histogram: DataFrame
    overlap: DataFrame
    colors: DataFrame


def recolor(vertices: DataFrame, triangles: DataFrame, distances: DataFrame, params: C2MParams) -> DataFrame:
    """vertex_id, d (smoothed), r, g, b of stored distances."""
    smooth = mesh.smooth(distances.select("vertex_id", "d"), triangles, params.smooth_rounds, params.smooth_strength)
    return smooth.select("vertex_id", "d", *[c.alias(n) for n, c in zip("rgb", distance_color(F.col("d"), params.max_distance, params.tolerance), strict=True)])


def compute(scan: DataFrame, vertices: DataFrame, triangles: DataFrame, matrix: list[float], params: C2MParams | None = None) -> C2MResult:
    """scan: point_id, x, y, z, thinned out before it is moved; statistics use raw distances, colours smoothed ones."""
    params = params or C2MParams()
    thin = points.voxel_mean(scan, params.voxel_size).withColumn("point_id", F.monotonically_increasing_id()) if params.voxel_size > 0 else scan
    placed = stored(points.transform(thin, matrix).select("point_id", "x", "y", "z"), "scan")
    found = neighbours.nearest_constrained(vertices, placed, params.knn_k, params.max_angle, params.half_space_only, params.normal_constraint)
    distances = stored(found, "distances")
    return C2MResult(
        distances,
        points.distance_statistics(distances),
        points.histogram(distances, params.max_distance, params.histogram_bins),
        points.box_overlap(points.bounding_box(placed), points.bounding_box(vertices)),
        recolor(vertices, triangles, distances, params),
    )
