import math
import random

from pyspark.sql import functions as F

from plumbline.operators import mesh as M
from plumbline.operators import remesh as R
from plumbline.operators.components import components
from plumbline.store import stored

VERTEX, FACE = "vertex_id bigint, x double, y double, z double", "face_id bigint, v0 bigint, v1 bigint, v2 bigint"


def plate(spark, n, place=lambda x, y: (x, y, 0.0), wobble=0.3):
    """A grid of n x n squares over the unit square, inner vertices moved a little."""
    rng, vs, fs = random.Random(0), [], []
    for i in range(n + 1):
        for j in range(n + 1):
            off = [wobble * (rng.random() - 0.5) / n if 0 < i < n and 0 < j < n else 0.0 for _ in range(2)]
            vs.append((i * (n + 1) + j, *place(i / n + off[0], j / n + off[1])))
    for i in range(n):
        for j in range(n):
            a = i * (n + 1) + j
            fs += [(len(fs), a, a + n + 1, a + 1), (len(fs) + 1, a + 1, a + n + 1, a + n + 2)]
    return stored(spark.createDataFrame(vs, VERTEX), "v"), stored(spark.createDataFrame(fs, FACE), "t")


def area(v, t):
    return M.quality(t, v).agg(F.sum("area")).first()[0]


def edge_counts(t):
    return {r["n"]: r["count"] for r in R.edge_faces(t).groupBy("n").count().collect()}


def test_components_against_brute_force(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(60)] + [(7, 7)]
    root = {x: x for p in pairs for x in p}
    for _ in range(200):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == root
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_decimated_plate_keeps_its_border(spark):
    v, t = plate(spark, 6)
    v2, t2 = R.decimated(v, t, 56)
    assert 53 <= t2.count() <= 56  # a collapse takes two faces, and the last ones are apart by chance
    assert abs(area(v2, t2) - 1) < 1e-6 and set(edge_counts(t2)) == {1, 2}
    corners = v2.filter("abs(x - round(x)) < 1e-6 and abs(y - round(y)) < 1e-6").count()
    assert corners == 4 and v2.filter("abs(z) > 1e-9").isEmpty()
    rim = R.edge_faces(t2).filter("n = 1").select(F.explode(F.array("lo", "hi")).alias("vertex_id")).distinct().join(v2, "vertex_id")
    assert rim.filter("least(abs(x), abs(y), abs(x - 1), abs(y - 1)) > 1e-6").isEmpty()


def test_decimated_cube_keeps_its_corners(spark):
    v, t = M.subdivided(*M.unit_box(spark), 0.8, 1)
    v2, t2 = R.decimated(v, t, 40)
    assert t2.count() <= 40 < t.count() and set(edge_counts(t2)) == {2} and abs(area(v2, t2) - 6) < 1e-6
    assert v2.filter("abs(abs(x) - 0.5) < 1e-6 and abs(abs(y) - 0.5) < 1e-6 and abs(abs(z) - 0.5) < 1e-6").count() == 8


def test_decimation_takes_few_rounds_and_ends_where_it_was_asked_to(spark, monkeypatch):
    v, t = plate(spark, 9, lambda x, y: (x, y, 0.2 * math.sin(9 * x) * math.cos(7 * y)), 0.8)
    taken, collapsed = [], R._collapsed
    monkeypatch.setattr(R, "_collapsed", lambda v, t, chosen: taken.append(chosen.count()) or collapsed(v, t, chosen))
    v2, t2 = R.decimated(v, t, 121)  # three quarters of 162
    assert 120 <= t2.count() <= 121 and len(taken) <= 4, taken
    assert set(edge_counts(t2)) == {1, 2} and v2.count() == 100 - sum(taken)


def test_equal_costs_are_told_apart(spark):
    """A hundred edges of no cost, each of two faces but for ten on a border: 51 faces are 51 or 52, never all."""
    edges = stored(spark.range(100).selectExpr("id as lo", "id + 1000 as hi", "if(id < 10, 1L, 2L) as n", "0.0D as cost"), "edges")
    got = R._cheapest(edges, 51, 190, F.xxhash64("lo", "hi")).agg(F.sum("n")).first()[0]
    assert got in (51, 52)


def test_cubes_that_share_a_corner_become_two_parts(spark):
    v, t = M.unit_box(spark)
    # The second cube's vertex 0 is the first one's 7.
    v2 = v.filter("vertex_id <> 0").select((F.col("vertex_id") + 10).alias("vertex_id"), *[(F.col(c) + 1.0).alias(c) for c in "xyz"])
    t2 = t.select((F.col("face_id") + 12).alias("face_id"), *[F.when(F.col(c) == 0, 7).otherwise(F.col(c) + 10).cast("bigint").alias(c) for c in M.CORNERS])
    v3, t3 = R.split_fans(v.unionAll(v2), t.unionAll(t2))
    assert (v3.count(), t3.count()) == (16, 24)
    parts = components(M.edges(t3).select(F.col("src").alias("a"), F.col("dst").alias("b")))
    assert sorted(r["count"] for r in parts.groupBy("root").count().collect()) == [8, 8]
    assert t3.filter("face_id < 12").exceptAll(t).isEmpty()


def test_merging_goes_by_distance(spark):
    places = [(0, 0.0999, 0.0, 0.0), (1, 0.1001, 0.0, 0.0), (2, 0.19, 0.0, 0.0), (3, 0.0999, 0.0, 0.0), (4, 5.0, 0.0, 0.0), (5, 5.2, 0.0, 0.0), (6, 0.0, 9.0, 0.0), (7, 0.0, 9.0, 3.0), (8, -0.05, 9.0, 0.0)]
    faces = [(0, 0, 4, 6), (1, 1, 5, 7), (2, 3, 4, 6), (3, 0, 1, 2), (4, 2, 8, 7)]
    v, t = R.merged_within(spark.createDataFrame(places, VERTEX), spark.createDataFrame(faces, FACE), 0.1)
    assert sorted(r[0] for r in v.select("vertex_id").collect()) == [0, 4, 5, 6, 7]
    assert sorted(map(tuple, t.select(*M.CORNERS).collect())) == [(0, 4, 6), (0, 5, 7), (0, 6, 7)]


def test_merging_against_brute_force(spark):
    rng = random.Random(9)
    places = [(i, *(round(rng.uniform(-0.4, 0.4), 3) for _ in range(3))) for i in range(300)]
    root = {p[0]: p[0] for p in places}
    near = [(a[0], b[0]) for a in places for b in places if a[0] < b[0] and sum((x - y) ** 2 for x, y in zip(a[1:], b[1:], strict=True)) <= 0.06 * 0.06]
    for _ in range(300):
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
    faces = [(i, i, (i + 1) % 300, (i + 2) % 300) for i in range(300)]
    want = {tuple(sorted({root[x] for x in f[1:]})) for f in faces}
    _, t = R.merged_within(spark.createDataFrame(places, VERTEX), spark.createDataFrame(faces, FACE), 0.06)
    assert sorted(tuple(sorted(r)) for r in t.select(*M.CORNERS).collect()) == sorted(w for w in want if len(w) == 3)


def test_merged_vertices_are_written_and_not_worked_out_again_by_each_step(spark):
    v, t = M.unit_box(spark)
    v2, _ = R.merged_within(v.select("*", F.lit(1).alias("more")), t, 0.1)
    assert v2.count() == 8 and v2.columns == ["vertex_id", "x", "y", "z", "more"]
    assert "Join" not in v2._jdf.queryExecution().optimizedPlan().toString() and len(v2.inputFiles()) > 0


def test_flips_bring_valences_nearer_to_six(spark):
    v, t = plate(spark, 4, wobble=0.0)
    # One inner edge turned the wrong way: two corners get seven neighbours and two get five.
    bad = t.filter("face_id not in (10, 11)").unionAll(spark.createDataFrame([(10, 6, 11, 12), (11, 6, 12, 7)], FACE))
    off = lambda t: M.edges(t).distinct().groupBy("src").count().select(F.sum(F.abs(F.col("count") - 6))).first()[0]
    _, t2 = R.flip_edges(v, bad, 60.0, 0.05, 0)
    assert off(t2) < off(bad) and t2.count() == t.count() and abs(area(v, t2) - 1) < 1e-9 and set(edge_counts(t2)) == {1, 2}


def test_creases_hold(spark):
    v, t = M.subdivided(*M.unit_box(spark), 0.8, 1)
    assert R.bends(R.edge_faces(t), t, v).filter("bend > 60").count() >= 12
    moved = R.relaxed(v, t, 60.0)
    assert moved.join(v.toDF("vertex_id", "a", "b", "c"), "vertex_id").filter("abs(x) = 0.5 and abs(y) = 0.5 and (x <> a or y <> b or z <> c)").isEmpty()


def test_isotropic_rounds_even_out_edges_on_the_surface(spark):
    v, t = plate(spark, 5, lambda x, y: (x**1.4, y, 0.3 * x**1.4), 0.6)
    before = M.edge_statistics(t, v, 0.13).first()["in_zone"]
    surface = M.Surface(t, stored(v.join(M.vertex_normals(t, v), "vertex_id"), "n"))
    v2, t2 = R.isotropic(v, t, 0.13, 3, reach=0.06, surface=surface)
    after = M.edge_statistics(t2, v2, 0.13).first()
    assert after["in_zone"] >= 66 > before and after["long"] == 0
    assert v2.filter("abs(z - 0.3 * x) > 1e-9").isEmpty() and abs(area(v2, t2) / area(v, t) - 1) < 1e-9 and set(edge_counts(t2)) == {1, 2}
