"""Rigid fits from pairs, and point-to-plane refinement."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions import geometry as G
from plumbline.operators.neighbours import index, within_radius

SIDES = ("sx", "sy", "sz", "bx", "by", "bz")


class Fit(NamedTuple):
    matrix: list[float]
    quaternion: tuple[float, float, float, float]
    translation: tuple[float, float, float]
    rmse: float
    max_error: float
    pair_count: int
    inlier_count: int


def valid_pairs(pairs: DataFrame) -> DataFrame:
    keep = F.lit(True)
    for c in SIDES:
        keep = keep & G.finite(F.col(c))
    return pairs.filter(keep)


def covariance(pairs: DataFrame, *keys: str) -> DataFrame:
    """Means of both sides, the nine sums of centred products, and the sum of squares of the source: one shuffle each for means and sums."""
    means = pairs.groupBy(*keys).agg(*[F.avg(c).alias(f"m{c}") for c in SIDES], F.count("*").alias("n"))
    joined = pairs.join(means, list(keys)) if keys else pairs.join(F.broadcast(means))
    centred = {c: F.col(c) - F.col(f"m{c}") for c in SIDES}
    sums = [F.sum(centred[f"s{a}"] * centred[f"b{b}"]).alias(f"s{a}{b}") for a in "xyz" for b in "xyz"]
    spread = F.sum(centred["sx"] * centred["sx"] + centred["sy"] * centred["sy"] + centred["sz"] * centred["sz"]).alias("spread")
    return joined.groupBy(*keys, "n", *[f"m{c}" for c in SIDES]).agg(*sums, spread)


def solve(row) -> np.ndarray | None:
    """4 x 4 transform of one covariance row, or None if the points don't fix it."""
    if row is None or row["n"] < 3 or row["spread"] <= 1e-12:
        return None
    s = np.array([[row[f"s{a}{b}"] for b in "xyz"] for a in "xyz"])
    skew = np.array([s[1, 2] - s[2, 1], s[2, 0] - s[0, 2], s[0, 1] - s[1, 0]])
    form = np.empty((4, 4))
    form[0, 0], form[0, 1:], form[1:, 0], form[1:, 1:] = np.trace(s), skew, skew, s + s.T - np.trace(s) * np.eye(3)
    w, x, y, z = np.linalg.eigh(form)[1][:, -1]
    if w < 0:
        w, x, y, z = -w, -x, -y, -z
    out = np.eye(4)
    out[:3, :3] = [[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]]
    out[:3, 3] = np.array([row["mbx"], row["mby"], row["mbz"]]) - out[:3, :3] @ np.array([row["msx"], row["msy"], row["msz"]])
    return out


def column_major(m: np.ndarray) -> list[float]:
    return [float(v) for v in m.T.ravel()]


def residuals(pairs: DataFrame, matrix: list[float]) -> DataFrame:
    m = F.array(*[F.lit(float(v)) for v in matrix])
    p = G.transform_point(m, F.col("sx"), F.col("sy"), F.col("sz"))
    return pairs.withColumn("err", G.distance(p, (F.col("bx"), F.col("by"), F.col("bz"))))


def trimmed(pairs: DataFrame, *keys: str) -> DataFrame:
    """Of pairs with err, the max(3, ceil(0.8 n)) least of each group of six or more; ties by pair_id."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    ranked = pairs.withColumn("rank", F.row_number().over(w.orderBy("err", "pair_id"))).withColumn("n", F.count("*").over(w))
    return ranked.filter((F.col("n") < 6) | (F.col("rank") <= F.greatest(F.lit(3), F.ceil(F.col("n") * 0.8)))).drop("rank", "n")


def quaternion_of(m: np.ndarray) -> tuple[float, float, float, float]:
    """x, y, z, w of a rotation by its largest diagonal term."""
    r = m[:3, :3]
    squares = np.array([1 + r[0, 0] - r[1, 1] - r[2, 2], 1 - r[0, 0] + r[1, 1] - r[2, 2], 1 - r[0, 0] - r[1, 1] + r[2, 2], 1 + np.trace(r)])
    k = int(np.argmax(squares))
    products = np.array([
        [squares[0], r[0, 1] + r[1, 0], r[0, 2] + r[2, 0], r[2, 1] - r[1, 2]],
        [r[0, 1] + r[1, 0], squares[1], r[1, 2] + r[2, 1], r[0, 2] - r[2, 0]],
        [r[0, 2] + r[2, 0], r[1, 2] + r[2, 1], squares[2], r[1, 0] - r[0, 1]],
        [r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1], squares[3]],
    ])
    q = products[k] / np.linalg.norm(products[k])
    return tuple(float(v) for v in (q if q[3] >= 0 else -q))


def rigid_fit(pairs: DataFrame) -> Fit:
    """Fit of one group of pairs, refitted on the trimmed pairs; errors are over all valid pairs.

    Fewer than three valid pairs, or pairs that don't fix a turn, are an error; if only the refit fails, the first stays.
    """
    valid = valid_pairs(pairs).cache()
    matrix = solve(covariance(valid).first())
    if matrix is None:
        raise ValueError("at least three valid pairs that span a plane are needed")
    n = inliers = valid.count()
    if n >= 6:
        kept = trimmed(residuals(valid, column_major(matrix))).cache()
        again = solve(covariance(kept).first())
        if again is not None:
            matrix, inliers = again, kept.count()
        kept.unpersist()
    rmse, most = residuals(valid, column_major(matrix)).agg(F.sqrt(F.avg(F.col("err") * F.col("err"))), F.max("err")).first()
    valid.unpersist()
    return Fit(column_major(matrix), quaternion_of(matrix), tuple(float(v) for v in matrix[:3, 3]), rmse, most, n, inliers)


def _plane_sums() -> list:
    """Columns of the 27 sums over all matches from which a step follows."""
    cross = G.cross((F.col("x"), F.col("y"), F.col("z")), (F.col("nx"), F.col("ny"), F.col("nz")))
    row = [*cross, F.col("nx"), F.col("ny"), F.col("nz")]
    gap = (F.col("tx") - F.col("x")) * F.col("nx") + (F.col("ty") - F.col("y")) * F.col("ny") + (F.col("tz") - F.col("z")) * F.col("nz")
    return [*[F.sum(row[i] * row[j]) for i in range(6) for j in range(i, 6)], *[F.sum(row[i] * gap) for i in range(6)]]


def _plane_step(hits: int, sums: list[float]) -> np.ndarray | None:
    """The small motion that best brings sources onto their targets' planes."""
    if hits < 6:
        return None
    a, at = np.zeros((6, 6)), 0
    for i in range(6):
        for j in range(i, 6):
            a[i, j] = a[j, i] = sums[at]
            at += 1
    v = np.linalg.lstsq(a, np.array(sums[at:]), rcond=None)[0]
    rx, ry, rz = v[:3]
    cx, sx, cy, sy, cz, sz = np.cos(rx), np.sin(rx), np.cos(ry), np.sin(ry), np.cos(rz), np.sin(rz)
    out = np.eye(4)
    out[:3, :3] = np.array([[cz, -sz, 0], [sz, cz, 0], [0, 0, 1]]) @ np.array([[cy, 0, sy], [0, 1, 0], [-sy, 0, cy]]) @ np.array([[1, 0, 0], [0, cx, -sx], [0, sx, cx]])
    out[:3, 3] = v[3:]
    return out


def _moved(sources: DataFrame, m: np.ndarray) -> DataFrame:
    p = G.transform_point(F.array(*[F.lit(v) for v in column_major(m)]), F.col("x"), F.col("y"), F.col("z"))
    return sources.select("vertex_id", *[v.alias(c) for v, c in zip(p, "xyz", strict=True)])


def refine(sources: DataFrame, targets: DataFrame, matrix: list[float], radius: float = 0.3, rounds: int = 30, tolerance: float = 1e-6, max_rmse_ratio: float = 1.05, min_fitness_ratio: float = 0.95, force: bool = False) -> dict:
    """Point-to-plane refinement of a first matrix, and whether to take it.

    sources: vertex_id, x, y, z; targets: point_id, x, y, z, nx, ny, nz. One pyramid of the targets serves all rounds; only sums reach the driver, once a round.
    """
    start = np.array(matrix, dtype=float).reshape(4, 4).T
    now, first, before, n = start, None, None, max(1, sources.count())
    normals = targets.select("*", F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("z").alias("tz"))
    found = index(normals, "tx", "ty", "tz", "nx", "ny", "nz")
    for _ in range(rounds + 1):
        placed = _moved(sources, now)
        matched = placed.join(within_radius(placed, found, radius, "tx", "ty", "tz", "nx", "ny", "nz"), "vertex_id")
        hits, rmse, *sums = matched.agg(F.count("*"), F.sqrt(F.avg("d2")), *_plane_sums()).first()
        fitness, rmse = hits / n, rmse or 0.0
        first = first or (fitness, rmse)
        if before and abs(before[0] - fitness) < tolerance and abs(before[1] - rmse) < tolerance:
            break
        before, step = (fitness, rmse), _plane_step(hits, sums)
        if step is None:
            break
        now = step @ now
    return judge(first, (fitness, rmse), max_rmse_ratio, min_fitness_ratio, force) | {"matrix": column_major(now), "initial": list(matrix)}


def judge(first: tuple[float, float], last: tuple[float, float], max_rmse_ratio: float = 1.05, min_fitness_ratio: float = 0.95, force: bool = False) -> dict:
    """Whether a refinement (fitness, rmse) is worse than its start, and whether it is applied."""
    worse = first[1] > 1e-9 and (last[1] > first[1] * max_rmse_ratio or last[0] < first[0] * min_fitness_ratio)
    return {"init_fitness": first[0], "init_rmse": first[1], "fitness": last[0], "rmse": last[1], "regressed": worse, "applied": force or not worse, "fallback": worse and not force}


def calibration_pairs(spark: SparkSession, matrix: list[float]) -> DataFrame:
    """Three pairs that fix a transform: the origin and the ends of the x and y axes."""
    rows = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0)], "pair_id bigint, sx double, sy double, sz double")
    p = G.transform_point(F.array(*[F.lit(float(v)) for v in matrix]), F.col("sx"), F.col("sy"), F.col("sz"))
    return rows.select("*", *[v.alias(c) for v, c in zip(p, ("bx", "by", "bz"), strict=True)])
