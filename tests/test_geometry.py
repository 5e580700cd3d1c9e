import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import color
from plumbline.functions import geometry as G
from plumbline.operators import leaves as L
from plumbline.operators import mesh as M
from plumbline.operators import neighbours as N
from plumbline.operators import points as P
from plumbline.operators import registration as R
from plumbline.operators import viewer as V

RNG = np.random.default_rng(0)


def frame(spark, rows, schema):
    return spark.createDataFrame([tuple(float(v) if isinstance(v, np.floating) else int(v) if isinstance(v, np.integer) else v for v in r) for r in rows], schema)


@pytest.fixture(scope="module")
def cloud(spark):
    xyz = RNG.normal(size=(300, 3))
    xyz[5] = xyz[4]
    normals = RNG.normal(size=(40, 3))
    normals /= np.linalg.norm(normals, axis=1, keepdims=True)
    vertices = np.column_stack([RNG.normal(size=(40, 3)) * 3, normals])
    return xyz, vertices, frame(spark, [(i, *p) for i, p in enumerate(xyz)], "point_id bigint, x double, y double, z double"), frame(spark, [(i, *v) for i, v in enumerate(vertices)], "vertex_id bigint, x double, y double, z double, nx double, ny double, nz double")


def test_nearest_against_brute_force(cloud):
    xyz, vertices, points, mesh = cloud
    for r in N.nearest(mesh, points).collect():
        v = vertices[r["vertex_id"]]
        d = np.linalg.norm(xyz - v[:3], axis=1)
        best = int(np.argmin(d))
        assert r["point_id"] == best and abs(abs(r["d"]) - d[best]) < 1e-9
        assert (r["d"] >= 0) == ((xyz[best] - v[:3]) @ v[3:] >= 0)


def test_constrained_against_brute_force(cloud):
    xyz, vertices, points, mesh = cloud
    for r in N.nearest_constrained(mesh, points, k=6, max_angle=60).collect():
        v = vertices[r["vertex_id"]]
        gap = xyz - v[:3]
        order = np.argsort(np.linalg.norm(gap, axis=1), kind="stable")[:6]
        cos = gap[order] @ v[3:] / np.linalg.norm(gap[order], axis=1)
        good = order[(cos >= np.cos(np.radians(60))) & (cos >= 0)]
        assert r["point_id"] == (good[0] if len(good) else order[0]) and r["valid"] == bool(len(good))


def test_far_vertices_meet_few_candidates(spark):
    """A scan 19 m away, a flat one, and one with a third of its points in one place: exact, and never all with all."""
    rng = np.random.default_rng(5)
    vertices = np.column_stack([rng.uniform(0, 1, size=(200, 3)), np.tile([1.0, 0, 0], (200, 1))])
    mesh = frame(spark, [(i, *v) for i, v in enumerate(vertices)], "vertex_id bigint, x double, y double, z double, nx double, ny double, nz double")
    box = rng.uniform(0, 1, size=(2000, 3)) + [19, 0, 0]
    wall = np.column_stack([np.full(2000, 19.0), rng.uniform(-5, 5, size=(2000, 2))])
    heap = np.vstack([rng.uniform(0, 1, size=(1400, 3)), np.tile([3.0, 3, 3], (600, 1))])
    for xyz, most in ((box, 50), (wall, 60), (heap, 50)):
        points = frame(spark, [(i, *p) for i, p in enumerate(xyz)], "point_id bigint, x double, y double, z double")
        tried = N.candidate_pairs(mesh, points).count()
        assert tried < most * len(vertices), tried / len(vertices)
        got = {r["vertex_id"]: r["point_id"] for r in N.nearest(mesh, points).collect()}
        assert got == {i: int(np.argmin(((xyz - v[:3]) ** 2).sum(axis=1))) for i, v in enumerate(vertices)}
        near = {r["vertex_id"]: r["point_id"] for r in N.within_radius(mesh, points, 0.2).collect()}
        assert near == {i: p for i, p in got.items() if np.linalg.norm(xyz[p] - vertices[i, :3]) <= 0.2}


def test_no_points_give_nulls(spark, cloud):
    none = spark.createDataFrame([], "point_id bigint, x double, y double, z double")
    assert {r["d"] for r in N.nearest(cloud[3], none).collect()} == {None}


def test_histogram_closes_its_last_bin(spark):
    d = frame(spark, [(v,) for v in (-1.0, -0.5, 0.0, 0.5, 1.0, 1.5, -2.0)], "d double")
    assert [r["n"] for r in P.histogram(d, 1.0, 4).orderBy("bin").collect()] == [1, 1, 1, 2]
    assert P.overflow_count(d, 1.0).first()[0] == 2


def test_statistics_equal_numpy(spark):
    v = RNG.normal(size=201)
    r = P.distance_statistics(frame(spark, [(x,) for x in v], "d double")).first()
    assert np.allclose([r["mean"], r["std"], r["p50"], r["p90"], r["p95"], r["p99"]], [v.mean(), v.std(), *np.percentile(v, [50, 90, 95, 99])])


def test_separated_clouds_move_apart(spark):
    vertices, faces = M.unit_box(spark)
    mesh = vertices.join(M.vertex_normals(faces, vertices), "vertex_id")
    before = 0.0
    for offset in (0, 5.5, 50):
        points = M.points_in_box(spark, (offset, 0, 0), (0.5, 0.5, 0.5), 300)
        mean = N.nearest(mesh, points).agg(F.avg(F.abs("d"))).first()[0]
        assert mean >= before - 0.01
        before = mean
    far = P.box_overlap(P.bounding_box(points), P.bounding_box(vertices)).first()[0]
    near = P.box_overlap(P.bounding_box(M.points_in_box(spark, (0, 0, 0), (0.5, 0.5, 0.5), 300)), P.bounding_box(vertices)).first()[0]
    assert far < 1e-6 and near > 0.5


def test_rigid_fit_finds_a_translation(spark):
    s = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1], [1, 1, 1]], dtype=float)
    fit = R.rigid_fit(frame(spark, [(i, *p, *(p + [10, -2, 3])) for i, p in enumerate(s)], "pair_id bigint, sx double, sy double, sz double, bx double, by double, bz double"))
    assert fit.rmse < 1e-8 and fit.pair_count == fit.inlier_count == 5 and np.allclose(fit.translation, [10, -2, 3]) and np.allclose(fit.quaternion, [0, 0, 0, 1])


def test_rigid_fit_drops_an_outlier_and_equals_svd(spark):
    q, _ = np.linalg.qr(RNG.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    s = RNG.normal(size=(10, 3))
    b = s @ q.T + [1, 2, 3]
    b[3] += 5
    schema = "pair_id bigint, sx double, sy double, sz double, bx double, by double, bz double"
    fit = R.rigid_fit(frame(spark, [*((i, *p, *t) for i, (p, t) in enumerate(zip(s, b, strict=True))), (99, float("nan"), 0.0, 0.0, 0.0, 0.0, 0.0)], schema))
    assert fit.inlier_count == 8 and fit.pair_count == 10 and fit.max_error > 4
    assert np.allclose(np.array(fit.matrix).reshape(4, 4).T[:3, :3], q, atol=0.8)
    with pytest.raises(ValueError, match="three valid pairs"):
        R.rigid_fit(frame(spark, [(1, *([0.0] * 6)), (2, *([1.0] * 6))], schema))


def test_refinement_recovers_a_small_shift(spark):
    g = [(i * 20 + j, i / 10, j / 10, 0.1 * np.sin(i) * np.cos(j)) for i in range(20) for j in range(20)]
    g += [(1000 + k, (k % 10) / 5, 0.0, (k // 10) / 10) for k in range(40)] + [(2000 + k, 0.0, (k % 10) / 5, (k // 10) / 10) for k in range(40)]
    normals = [(0.0, 0.0, 1.0)] * 400 + [(0.0, 1.0, 0.0)] * 40 + [(1.0, 0.0, 0.0)] * 40
    target = frame(spark, [(*p, *n) for p, n in zip(g, normals, strict=True)], "point_id bigint, x double, y double, z double, nx double, ny double, nz double")
    source = target.select(F.col("point_id").alias("vertex_id"), (F.col("x") + 0.02).alias("x"), (F.col("y") - 0.01).alias("y"), (F.col("z") + 0.015).alias("z"))
    got = R.refine(source, target, [1.0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1.0], radius=0.08, rounds=12)
    assert got["applied"] and got["rmse"] < got["init_rmse"] / 2 and np.allclose(got["matrix"][12:15], [-0.02, 0.01, -0.015], atol=0.01)


@pytest.mark.parametrize(("first", "last", "force", "applied"), [((1, 0.1), (1, 0.2), False, False), ((1, 0.1), (1, 0.2), True, True), ((1, 0.1), (0.5, 0.1), False, False), ((1, 0), (0, 9), False, True)])
def test_judge(first, last, force, applied):
    assert R.judge(first, last, force=force)["applied"] is applied


def test_matrices_and_quaternions(spark):
    rows = frame(spark, [(i, *RNG.normal(size=7)) for i in range(20)], "id bigint, x double, y double, z double, w double, tx double, ty double, tz double")
    c = {k: F.col(k) for k in ("x", "y", "z", "w", "tx", "ty", "tz")}
    m = rows.withColumn("m", G.pose_matrix((c["x"], c["y"], c["z"], c["w"]), (c["tx"], c["ty"], c["tz"])))
    for r in m.select("*", G.multiply(G.rigid_inverse(F.col("m")), F.col("m")).alias("i"), F.array(*G.quaternion(F.col("m"))).alias("q"), F.array(*G.transform_delta(F.col("m"), F.col("m"))).alias("d")).collect():
        assert np.allclose(np.array(r["i"]).reshape(4, 4), np.eye(4), atol=1e-9) and np.allclose(r["d"], [0, 0], atol=1e-4)
        q = np.array([r["x"], r["y"], r["z"], r["w"]])
        assert abs(abs(q @ r["q"]) / np.linalg.norm(q) - 1) < 1e-9


def test_smoothing_by_matrix(spark):
    vertices, faces = M.unit_box(spark)
    lone = vertices.unionByName(frame(spark, [(50, 9.0, 9.0, 9.0)], "vertex_id bigint, x double, y double, z double"))
    d = np.append(np.arange(8.0), 4.0)
    edges = [(r["src"], r["dst"]) for r in M.edges(faces).collect()]
    w = np.zeros((9, 9))
    for a, b in edges:
        w[a, b] += 1
    w /= np.maximum(w.sum(1, keepdims=True), 1)
    for _ in range(3):
        d = 0.5 * d + 0.5 * w @ d
    values = lone.select("vertex_id", F.when(F.col("vertex_id") == 50, 4.0).otherwise(F.col("vertex_id").cast("double")).alias("d"))
    got = {r["vertex_id"]: r["d"] for r in M.smooth(values, faces, 3).collect()}
    assert np.allclose([got[i] for i in (*range(8), 50)], d)
    assert M.smooth(values, faces, 0).count() == 9


def test_mesh_cleaning_and_subdivision(spark):
    vertices, faces = M.unit_box(spark)
    v, t = M.subdivided(vertices, faces, 1.1, 1)
    assert v.count() == 14 and t.count() == 24
    assert abs(M.quality(t, v).agg(F.sum("area")).first()[0] - 6) < 1e-9
    v, t = M.subdivided(vertices, faces, 0.4, 2)
    assert t.count() == 12 * 16 and abs(M.quality(t, v).agg(F.sum("area")).first()[0] - 6) < 1e-9
    twice = vertices.unionByName(vertices.withColumn("vertex_id", F.col("vertex_id") + 8))
    doubled = faces.unionByName(faces.select((F.col("face_id") + 12).alias("face_id"), *[(F.col(c) + 8).alias(c) for c in M.CORNERS]))
    v, t = M.deduplicated(twice, doubled)
    assert (v.count(), t.count()) == (8, 12)
    v, t = M.joined_scene([(vertices, faces), (vertices, faces)])
    assert (v.select("vertex_id").distinct().count(), t.count()) == (16, 24)
    extra = faces.unionByName(frame(spark, [(99, 0, 1, 7)], "face_id bigint, v0 bigint, v1 bigint, v2 bigint"))
    assert M.without_non_manifold(extra, vertices).count() <= 13


def test_closest_surface_points(spark):
    vertices, faces = M.unit_box(spark)
    mesh = vertices.join(M.vertex_normals(faces, vertices), "vertex_id")
    asked = [(i, *p, 0.0, 0.0, 1.0) for i, p in enumerate(RNG.normal(size=(12, 3)) * 1.5)]
    hits = M.closest_faces(frame(spark, asked, "face_id bigint, x double, y double, z double, nx double, ny double, nz double"), faces, mesh)
    for r in hits.collect():
        p = np.array([r["x"], r["y"], r["z"]])
        foot = np.clip(p, -0.5, 0.5)
        if (np.abs(p) < 0.5).all():
            expected = (0.5 - np.abs(p)).min()
        else:
            expected = np.linalg.norm(p - foot)
        assert abs(np.sqrt(r["d2"]) - expected) < 1e-9


def test_color_ramp(spark):
    d = frame(spark, [(v,) for v in (-0.2, -0.1, 0.0, 0.1, 0.3)], "d double")
    got = [tuple(round(v, 2) for v in r) for r in d.select(*[c.alias(n) for c, n in zip(color.distance_color(F.col("d"), 0.2, 0.05), "rgb", strict=True)]).collect()]
    assert got[0] == (0.05, 0.28, 0.63) and got[-1] == (0.23, 0.23, 0.23) and got[2][1] > 0.75


def test_voxels_clips_and_centres(spark):
    p = frame(spark, [(0, 0.0, 0.0, 0.0), (1, 0.1, 0.1, 0.1), (2, 5.0, 5.0, 5.0)], "point_id bigint, x double, y double, z double")
    assert sorted(r["n"] for r in P.voxel_mean(p, 1.0).collect()) == [1, 2]
    assert P.voxel_two_phase(p, 1.0, F.col("point_id") % 2).count() == 2
    assert P.clip(p, (0, 0, 0), (1, 1, 1)).count() == 2 and P.clip(p, (1, 0, 0), (0, 1, 1)).count() == 3
    box = P.bounding_box(P.recentre(p)).first()
    assert box["min_x"] == -box["max_x"] == -2.5
    assert P.effective_box((0, 0, 0), (1, 1, 1), {"x_min": 0.2, "x_max": 0.3}, inset=True)[1][0] == 0.7


def _met(rays, corners):
    """Brute force: every ray against every triangle."""
    out = {}
    for r, ray in enumerate(rays):
        o, d = np.array(ray[:3]), np.array(ray[3:])
        for f, corner in enumerate(corners):
            a, b, c = np.array(corner).reshape(3, 3)
            det = np.dot(b - a, np.cross(d, c - a))
            if not det:
                continue
            u, v = np.dot(o - a, np.cross(d, c - a)) / det, np.dot(d, np.cross(o - a, b - a)) / det
            t = np.dot(c - a, np.cross(o - a, b - a)) / det
            if u >= 0 and v >= 0 and u + v <= 1 and t >= 0:
                out[r, f] = t
    return out


_RAY, _CORNERS = "ray_id bigint, " + ", ".join(f"{p}{c} double" for p in "od" for c in "xyz"), "face_id bigint, ignored boolean, " + ", ".join(f"{p}_{c} double" for p in "abc" for c in "xyz")


def test_rays_meet_what_brute_force_says(spark):
    at = RNG.uniform(-3, 3, size=(400, 3))
    corners = np.concatenate([at, at + RNG.normal(scale=0.8, size=(400, 3)), at + RNG.normal(scale=0.8, size=(400, 3))], axis=1)
    corners[:4, 2::3] = 1.0  # flat across an axis
    corners[4:7] = corners[3]  # repeated
    corners[7] = np.tile(corners[7][:3], 3)  # no area
    rays = np.concatenate([RNG.uniform(-5, 5, size=(60, 3)), RNG.normal(size=(60, 3))], axis=1)
    rays[:20, 3:5] = 0.0  # along an axis, both ways
    for k in range(4):
        rays[k, :2] = corners[k].reshape(3, 3).mean(axis=0)[:2]
        rays[k, 2] = 6.0 * (-1) ** k
        rays[k, 5] = -rays[k, 2]
    want = _met(rays, corners)
    assert len(want) > 30
    odd_rays = [(900, *[0.0] * 6), (901, None, 0.0, 0.0, 1.0, 0.0, 0.0), (902, float("nan"), 0.0, 0.0, 1.0, 0.0, 0.0), (903, 0.0, 0.0, 0.0, float("inf"), 0.0, 0.0)]
    odd_faces = [(900, False, None, *[0.0] * 8), (901, False, float("nan"), *[1.0] * 8), (902, False, float("inf"), *[1.0] * 8)]
    lines = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(rays)] + odd_rays, _RAY)
    faces = spark.createDataFrame([(k, k % 3 == 0, *map(float, c)) for k, c in enumerate(corners)] + odd_faces, _CORNERS)
    got = V.hits(lines, faces)
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()
    found = {(r.ray_id, r.face_id): r.t for r in got.collect()}
    assert found.keys() == want.keys()
    assert all(abs(found[k] - want[k]) < 1e-9 * max(1, want[k]) for k in want)
    assert V.hits(lines, faces.limit(0)).count() == 0 and V.hits(lines.limit(0), faces).count() == 0


def test_many_rays_try_few_triangles(spark):
    """A plate of 5,000 triangles and 2,000 rays through it: more rays than a user picks, far fewer trials than pairs."""
    cell = F.struct((F.col("id") % 50).alias("i"), F.floor(F.col("id") / 50).alias("j"))
    plate = spark.range(2500).select("id", cell.alias("g")).select("id", F.col("g.i").cast("double").alias("x"), F.col("g.j").cast("double").alias("y"))
    low = plate.selectExpr("2*id as face_id", "false as ignored", "x as a_x", "y as a_y", "0d as a_z", "x+1 as b_x", "y as b_y", "0d as b_z", "x as c_x", "y+1 as c_y", "0d as c_z")
    high = plate.selectExpr("2*id+1 as face_id", "false as ignored", "x+1 as a_x", "y+1 as a_y", "0d as a_z", "x as b_x", "y+1 as b_y", "0d as b_z", "x+1 as c_x", "y as c_y", "0d as c_z")
    rays = spark.range(2000).selectExpr("id as ray_id", "id % 50 + 0.3d as ox", "id % 47 + 0.3d as oy", "9d as oz", "0d as dx", "0d as dy", "-1d as dz")
    faces = low.unionAll(high)
    assert V.picked(V.hits(rays, faces)).filter("first = 2 * ((ray_id % 50) + 50 * (ray_id % 47)) and abs(first_t - 9) < 1e-9").count() == 2000
    tried = V.Pyramid(faces.selectExpr("*", *[f"least(a_{c}, b_{c}, c_{c}) as lo_{c}" for c in "xyz"], *[f"greatest(a_{c}, b_{c}, c_{c}) as hi_{c}" for c in "xyz"])).met(rays)
    assert tried.count() < 2000 * 60


def test_points_at_one_place_are_tried_once(spark):
    heap = spark.range(100000).select(F.col("id").alias("point_id"), *[F.lit(0.5).alias(a) for a in "xyz"])
    spread = spark.range(1000).select((F.col("id") + 200000).alias("point_id"), *[F.rand(i).alias(a) for i, a in enumerate("xyz")])
    vertices = spark.range(1000).select(F.col("id").alias("vertex_id"), *[(0.5 + F.rand(i + 5) / 1000).alias(a) for i, a in enumerate("xyz")], *[F.lit(0.0).alias(n) for n in ("nx", "ny")], F.lit(1.0).alias("nz"))
    points = heap.unionAll(spread).cache()
    assert N.candidate_pairs(vertices, points).count() < 10000
    assert {r["point_id"] for r in N.nearest(vertices, points).collect()} == {0}
    found = N.nearest_constrained(vertices, points, k=8)
    assert {r["point_id"] for r in found.collect()} == {0} and N.candidate_pairs(vertices, points, 8).count() < 20000
    with pytest.raises(ValueError, match="made for 1"):
        N.candidate_pairs(vertices, N.index(points), 8)


def test_places_may_be_decimals_and_minus_zero(spark):
    points = spark.sql("select id + 1 as point_id, cast(id as decimal(10, 2)) as x, cast(0 as decimal(10, 2)) as y, 0.0 as z from range(5)")
    vertices = spark.sql("select 1 as vertex_id, 2.2D as x, -0.0D as y, 0D as z, 0D as nx, 0D as ny, 1D as nz")
    assert N.nearest(vertices, points).first()["point_id"] == 3


def test_triangles_as_large_as_the_model_meet_few_queries(spark):
    """A soup of triangles whose boxes all overlap: the nearest are those of brute force, in parts of any size, and few pairs are tried."""
    rng = np.random.default_rng(11)
    corners, at = rng.normal(size=(600, 3, 3)), rng.normal(size=(500, 3))
    faces = frame(spark, [(i, *c.ravel()) for i, c in enumerate(corners)], "hit bigint, " + ", ".join(f"{n}_{c} double" for n in "abc" for c in "xyz"))
    asked = frame(spark, [(i, *p) for i, p in enumerate(at)], "face_id bigint, x double, y double, z double")
    gaps = np.column_stack([L._gaps(at, np.repeat(c[None], len(at), axis=0)) for c in corners])
    weights = rng.dirichlet(np.ones(3), size=2000)
    for p, c, gap in ((at[0], corners[0], gaps[0, 0]), (at[1], corners[2], gaps[1, 2])):
        assert gap <= np.linalg.norm(weights @ c - p, axis=1).min() <= gap + 0.3
    for group in (L.GROUP, 50):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(L, "GROUP", group)
            rows = L.closest_triangles(asked, faces).select("face_id", "hit").collect()
        best = {}
        for r in rows:
            best.setdefault(r["face_id"], set()).add(r["hit"])
        assert all(int(np.argmin(gaps[i])) in best[i] for i in range(len(at))) and len(rows) < (2 if group > 50 else 15) * len(at)


def test_nearest_few_of_many_come_in_parts_of_bounded_size(spark, monkeypatch):
    """Each leaf yields its k nearest and no more; hot leaves meet in parts; all as by brute force."""
    rng = np.random.default_rng(12)
    xyz, at = rng.normal(size=(8000, 3)), rng.normal(size=(150, 3))
    points = frame(spark, [(i, *p) for i, p in enumerate(xyz)], "point_id bigint, x double, y double, z double")
    vertices = frame(spark, [(i, *p, 1.0, 0.0, 0.0) for i, p in enumerate(at)] + [(999, float("nan"), 0.0, 0.0, 1.0, 0.0, 0.0)], "vertex_id bigint, x double, y double, z double, nx double, ny double, nz double")
    expected = {i: set(np.argsort(((xyz - p) ** 2).sum(axis=1))[:8].tolist()) for i, p in enumerate(at)}
    for group, most in ((L.GROUP, 150), (60, 2000)):
        monkeypatch.setattr(L, "GROUP", group)
        got = {}
        for r in N.candidate_pairs(vertices, points, 8).select("vertex_id", "point_id", "d2").collect():
            got.setdefault(r["vertex_id"], []).append((r["d2"], r["point_id"]))
        assert {i: {p for _, p in sorted(found)[:8]} for i, found in got.items()} == expected
        assert sum(map(len, got.values())) < most * len(at)
