"""Remesh algorithms by name, with descriptions of their parameters."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import mesh as M
from plumbline.operators import remesh as R
from plumbline.store import stored


@dataclass
class Parameter:
    name: str
    label: str
    kind: str
    default: float
    low: float | None = None
    high: float | None = None
    visible_when: str | None = None


# Key, label, type, default, least, most and the switch that shows a parameter, as clients send and list them.
SHARED = """
target_edge_length | 目标边长 (m) | float | 0.1 | 0.001 | |
clean_tolerance | 清理容差 (m) | float | 0.005 | 0.0001 | |
use_decimation | 智能瘦身 | bool | 1 | | |
decimation_ratio | 瘦身保留比例 | float | 0.5 | 0.05 | 0.95 | use_decimation
"""
SUBDIVISION = """
subdivision_iterations | 细分迭代次数 | int | 2 | 0 | 10 |
subdivision_threshold_ratio | 细分阈值系数 | float | 2.0 | 1.0 | 4.0 |
use_isotropic | Isotropic 重网格化 | bool | 1 | | |
isotropic_collapse | Isotropic 边合并 | bool | 1 | | | use_isotropic
isotropic_iterations | Isotropic 迭代次数 | int | 5 | 1 | 20 | use_isotropic
surface_dist_ratio | 表面偏差系数 | float | 0.5 | 0.01 | 2.0 | use_isotropic
sliver_merge_ratio | 薄片合并系数 | float | 0.03 | 0.0 | 0.1 | use_isotropic
sliver_relax_checksurfdist | 薄片后处理放宽保形 | bool | 1 | | | use_isotropic
adaptive | 自适应采样 | bool | 1 | | | use_isotropic
crease_angle | 折角保护阈值 (°) | float | 60.0 | 0.0 | 90.0 | use_isotropic
"""
ISOTROPIC = """
isotropic_iterations | Isotropic 迭代次数 | int | 15 | 1 | 20 |
surface_dist_ratio | 表面偏差系数 | float | 0.5 | 0.01 | 2.0 |
sliver_merge_ratio | 薄片合并系数 | float | 0.03 | 0.0 | 0.1 |
sliver_relax_checksurfdist | 薄片后处理放宽保形 | bool | 1 | | |
adaptive | 自适应采样 | bool | 1 | | |
crease_angle | 折角保护阈值 (°) | float | 60.0 | 0.0 | 90.0 |
"""


def listed(*tables: str) -> list[Parameter]:
    rows = [[c.strip() for c in line.split("|")] for t in tables for line in t.strip().splitlines()]
    number = lambda c: float(c) if c else None
    return [Parameter(key, label, kind, float(default), number(low), number(high), shown or None) for key, label, kind, default, low, high, shown in rows]


@dataclass
class RemeshResult:
    vertices: DataFrame
    triangles: DataFrame
    vertices_before: int
    faces_before: int
    vertices_after: int
    faces_after: int
    extra: dict = field(default_factory=dict)

    def row(self) -> DataFrame:
        return self.vertices.sparkSession.createDataFrame([(self.vertices_before, self.faces_before, self.vertices_after, self.faces_after)], "vertices_before bigint, faces_before bigint, vertices_after bigint, faces_after bigint")


class Algorithm(Protocol):
    name: str
    label: str

    def parameters(self) -> list[Parameter]: ...

    def run(self, vertices: DataFrame, triangles: DataFrame, params: dict | None) -> RemeshResult: ...


ALGORITHMS: dict[str, Algorithm] = {}


def register(cls: type) -> type:
    ALGORITHMS[cls.name] = cls()
    return cls


def value(params: dict, p: Parameter):
    """A parameter within its bounds; what is missing or no number is the default. Whole numbers are cut, switches are by truth."""
    given = params.get(p.name, p.default)
    if p.kind == "bool":
        return bool(given)
    try:
        v = float(given)
    except (TypeError, ValueError):
        v = p.default
    v = int(v) if p.kind == "int" else v
    return min(max(v, p.low if p.low is not None else v), p.high if p.high is not None else v)


def values(params: dict | None, known: list[Parameter]) -> dict:
    """All parameters' values; names that the algorithm doesn't know are an error rather than silently left out."""
    odd = set(params or {}) - {p.name for p in known}
    if odd:
        raise ValueError(f"unknown parameters: {', '.join(sorted(odd))}")
    return {p.name: value(params or {}, p) for p in known}


def _measured(before: tuple[int, int], vertices: DataFrame, triangles: DataFrame, **extra) -> RemeshResult:
    return RemeshResult(vertices, triangles, *before, vertices.count(), triangles.count(), extra)


@register
class SubdivideThenIsotropic:
    """Clean, repair, thin out large meshes, split long edges at midpoints, even edges out, remove slivers."""

    name, label = "bim_preprocessor", "Subdivision and isotropic"
    MANY_FACES = 30_000

    def parameters(self) -> list[Parameter]:
        return listed(SHARED, SUBDIVISION)

    def run(self, vertices: DataFrame, triangles: DataFrame, params: dict | None) -> RemeshResult:
        p = values(params, self.parameters())
        before, target = (vertices.count(), triangles.count()), p["target_edge_length"]
        vertices, triangles = cleaned(vertices, triangles, p)
        if p["use_decimation"] and before[1] > self.MANY_FACES:
            vertices, triangles = thinned(vertices, triangles, before[1], 1000, p)
        vertices, triangles = M.subdivided(vertices, triangles, target * p["subdivision_threshold_ratio"], p["subdivision_iterations"])
        # Splitting below twice the target and merging would undo each other.
        merge = p["isotropic_collapse"] and p["subdivision_threshold_ratio"] >= 2
        return finished(before, vertices, triangles, p, p["isotropic_iterations"] if p["use_isotropic"] else 0, merge, 1)


@register
class IsotropicOnly:
    """Clean, repair, thin out, even edges out over more rounds, remove slivers."""

    name, label = "bim_isotropic_only", "Isotropic only"

    def parameters(self) -> list[Parameter]:
        return listed(SHARED, ISOTROPIC)

    def run(self, vertices: DataFrame, triangles: DataFrame, params: dict | None) -> RemeshResult:
        p = values(params, self.parameters())
        before = (vertices.count(), triangles.count())
        vertices, triangles = cleaned(vertices, triangles, p)
        if p["use_decimation"]:
            vertices, triangles = thinned(vertices, triangles, before[1], 100, p)
        return finished(before, vertices, triangles, p, p["isotropic_iterations"], True, 3)


def cleaned(vertices: DataFrame, triangles: DataFrame, p: dict) -> tuple[DataFrame, DataFrame]:
    """Close vertices merged, faces beyond two on an edge removed, vertices of several fans parted."""
    vertices, triangles = R.merged_within(vertices, triangles, p["clean_tolerance"])
    return repaired(vertices, triangles)


def repaired(vertices: DataFrame, triangles: DataFrame) -> tuple[DataFrame, DataFrame]:
    return R.split_fans(vertices, stored(M.without_non_manifold(triangles, vertices), "manifold"))


def thinned(vertices: DataFrame, triangles: DataFrame, faces: int, least: int, p: dict) -> tuple[DataFrame, DataFrame]:
    """Edges collapsed by quadric error down to a ratio of the faces that came in, or `least` of them, and what that left repaired."""
    wanted = max(least, int(faces * p["decimation_ratio"]))
    return repaired(*R.decimated(vertices, triangles, wanted)) if wanted < faces else (vertices, triangles)


def finished(before: tuple[int, int], vertices: DataFrame, triangles: DataFrame, p: dict, rounds: int, merge: bool, sliver_rounds: int) -> RemeshResult:
    """Isotropic rounds over the surface as it came to them, then the sliver pass: very short edges merged, edges flipped and vertices relaxed without a surface to return to."""
    target, angle = p["target_edge_length"], p["crease_angle"]
    reach = target * p["surface_dist_ratio"]
    if rounds:
        normals = vertices.select("vertex_id", "x", "y", "z").join(M.vertex_normals(triangles, vertices), "vertex_id", "left").fillna(0.0)
        vertices, triangles = R.isotropic(vertices, triangles, target, rounds, angle, reach, merge, adaptive=p["adaptive"], surface=M.Surface(triangles, normals))
    vertices, triangles = R.merged_within(vertices, triangles, min(target * p["sliver_merge_ratio"], p["clean_tolerance"]))
    vertices, triangles = R.isotropic(vertices, triangles, target, sliver_rounds, angle, reach if p["sliver_relax_checksurfdist"] else None, collapse=False, split=False)
    vertices = vertices.join(M.vertex_normals(triangles, vertices), "vertex_id", "left")
    return _measured(before, vertices, triangles, **p, collapse=merge)


def describe(spark: SparkSession) -> DataFrame:
    """One row an algorithm, its parameters nested."""
    rows = [(a.name, a.label, [(p.name, p.label, p.kind, float(p.default), None if p.low is None else float(p.low), None if p.high is None else float(p.high), p.visible_when) for p in a.parameters()]) for a in ALGORITHMS.values()]
    return spark.createDataFrame(rows, "name string, label string, params array<struct<name:string,label:string,kind:string,default:double,min:double,max:double,visible_when:string>>")


def remesh(vertices: DataFrame, triangles: DataFrame, algorithm: str, params: dict | None = None) -> RemeshResult:
    if algorithm not in ALGORITHMS:
        raise ValueError(f"no algorithm {algorithm}; there are {', '.join(sorted(ALGORITHMS))}")
    return ALGORITHMS[algorithm].run(vertices, triangles, params)


def best_pipeline(metrics: DataFrame, lower_is_better: list[str], higher_is_better: list[str]) -> DataFrame:
    """metric, best pipeline and its value, of rows (pipeline, metrics...)."""
    names = [*lower_is_better, *higher_is_better]
    long = metrics.unpivot(["pipeline"], names, "metric", "value")
    low: Column = F.col("metric").isin(*lower_is_better)
    return long.groupBy("metric").agg(F.when(F.first(low), F.min_by("pipeline", "value")).otherwise(F.max_by("pipeline", "value")).alias("pipeline"), F.when(F.first(low), F.min("value")).otherwise(F.max("value")).alias("value"))


