"""Timed comparisons: constrained nearest points over k and angle, and remesh algorithms."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame

from plumbline.operators import jobs, mesh, neighbours, points
from plumbline.plans import algorithms

# The cases that are compared, (k, angle); none is the unconstrained one, which comes first.
CASES = (None, (8, 75.0), (8, 60.0), (16, 75.0), (16, 60.0))


def constrained_cases(vertices: DataFrame, cloud: DataFrame) -> DataFrame:
    """(position, label, elapsed, ratio, is_fastest, mean, std, p90, min, max) of each case, one pyramid serving all."""
    spark, found, rows = vertices.sparkSession, neighbours.index(cloud, k=max(c[0] for c in CASES if c)), []
    for position, case in enumerate(CASES):
        began = time.time()
        k, angle = case or (1, 0.0)
        got = points.distance_statistics(neighbours.nearest_constrained(vertices, found, k, angle, enabled=case is not None)).first()
        label = "k=1" if case is None else f"k={k} half space and {angle:g} degrees"
        rows.append((position, label, time.time() - began, *[float(got[c]) for c in ("mean", "std", "p90", "min", "max")]))
    timed = spark.createDataFrame(rows, "position int, label string, elapsed double, mean double, std double, p90 double, min double, max double")
    return jobs.case_ratios(timed.select("position", "label", "elapsed")).join(timed.drop("label", "elapsed"), "position")


def remesh_cases(vertices: DataFrame, triangles: DataFrame, target: float, cases: dict[str, tuple[str, dict]] | None = None) -> DataFrame:
    """(pipeline, elapsed, faces_before, faces_after and edge statistics) of remesh algorithms on one mesh."""
    cases = cases or {name: (name, {}) for name in algorithms.ALGORITHMS}
    out = None
    for label, (name, params) in cases.items():
        began = time.time()
        got = algorithms.remesh(vertices, triangles, name, {"target_edge_length": target} | params)
        stats = mesh.edge_statistics(got.triangles, got.vertices, target)
        row = stats.selectExpr(f"'{label}' as pipeline", f"{time.time() - began} as elapsed", f"{got.faces_before} as faces_before", f"{got.faces_after} as faces_after", "*")
        out = row if out is None else out.unionByName(row)
    return out
