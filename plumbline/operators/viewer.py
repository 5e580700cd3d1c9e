"""Scene tables: what is shown, how large it is, and what a ray hits."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import geometry as G
from plumbline.operators.pyramid import Pyramid

# Limits that results must equal.
WIRE_FACES, SOFT_BYTES = 2_700_000, 256 * 1024 * 1024 - 8 * 1024 * 1024

XYZ = ("x", "y", "z")


def geometry_bytes(buffers: DataFrame) -> DataFrame:
    """(node_id, bytes, visible) from buffers (node_id, n_bytes): a node above the soft limit isn't shown."""
    sums = buffers.groupBy("node_id").agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("bytes"))
    return sums.withColumn("visible", F.col("bytes") <= SOFT_BYTES)


def static_meshes(nodes: DataFrame) -> DataFrame:
    """Nodes that can be merged: meshes with a geometry that are neither the root nor skinned nor instanced."""
    return nodes.filter("is_mesh and has_geometry and not is_skinned and not is_instanced and parent_id is not null")


def wire_allowed(n_faces):
    return n_faces <= WIRE_FACES


def visible_box(objects: DataFrame) -> DataFrame:
    """The box of all visible objects' boxes (min_x .. max_z, visible); no row if none is visible."""
    joined = objects.filter("visible").agg(*[F.min(f"min_{c}").alias(f"min_{c}") for c in XYZ], *[F.max(f"max_{c}").alias(f"max_{c}") for c in XYZ])
    return joined.filter("min_x is not null")


def hits(rays: DataFrame, corners: DataFrame) -> DataFrame:
    """(ray_id, face_id, ignored, t) of every triangle that a ray meets, for any number of rays.

    rays: ray_id, ox .. dz; corners: face_id, ignored, a_x .. c_z. Rays go down a pyramid of the triangles' boxes into those
    cells only that they meet, so a ray is tried on the triangles along it. Rays and triangles with a null, infinite or NaN
    coordinate and rays without a direction meet nothing; a ray on a triangle's plane doesn't meet it.
    """
    finite = lambda names: reduce(and_, [F.abs(F.col(c)) < math.inf for c in names])
    ends, places = [f"{p}{c}" for p in "od" for c in XYZ], [f"{p}_{c}" for p in "abc" for c in XYZ]
    lines = rays.select("ray_id", *[F.col(c).cast("double").alias(c) for c in ends]).filter(finite(ends) & (F.greatest(*[F.abs(F.col(c)) for c in ends[3:]]) > 0))
    faces = corners.select("face_id", "ignored", *[F.col(c).cast("double").alias(c) for c in places]).filter(finite(places))
    box = [f(*[f"{p}_{c}" for p in "abc"]).alias(f"{e}{c}") for e, f in (("lo_", F.least), ("hi_", F.greatest)) for c in XYZ]
    at = lambda p: tuple(F.col(f"{p}{c}") for c in XYZ)
    t = G.ray_triangle(at("o"), at("d"), at("a_"), at("b_"), at("c_"))
    return Pyramid(faces.select("*", *box)).met(lines).select("ray_id", "face_id", "ignored", t.alias("t")).filter("t is not null")


def picked(hits: DataFrame) -> DataFrame:
    """(ray_id, first, first_t, pick) of hits: the nearest, and the nearest that isn't to be ignored (the nearest where all are). Partial minima, no sort."""
    place = F.struct("t", "face_id")
    got = hits.groupBy("ray_id").agg(F.min(place).alias("first"), F.min(F.when(~F.col("ignored"), place)).alias("good"))
    return got.select("ray_id", F.col("first.face_id").alias("first"), F.col("first.t").alias("first_t"), F.coalesce("good", "first").getField("face_id").alias("pick"))
