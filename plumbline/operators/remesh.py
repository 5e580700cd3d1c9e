"""Remeshing by local operations on independent sets: edges that collapse, split or flip in a round share no neighbourhood.

Meshes are vertices (vertex_id, x, y, z) and triangles (face_id, v0, v1, v2) with corners in the same turn. A round is joins on vertices and edges and
pre-aggregated minima; nothing is gathered but counts. An edge is chosen where its rank is the least in the neighbourhoods of its ends, so all chosen ones
can be applied at once, as if one after another.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import geometry as G
from plumbline.operators import mesh as M
from plumbline.operators.components import components
from plumbline.store import stored

XYZ = ("x", "y", "z")
#: Upper triangle of the symmetric 4x4 matrix of a quadric, row by row.
QUADRIC = [f"q{i}" for i in range(10)]
#: Weight of the planes that hold a border, against those of faces.
BORDER = 10.0
#: A collapse may turn a face by an angle of this cosine at most.
TURN = 0.2
#: Determinants under this part of the cubed mean of the diagonal leave a quadric's best place to its edge's ends and middle.
FLAT = 1e-9


def _at(prefix: str) -> tuple[Column, Column, Column]:
    return tuple(F.col(f"{prefix}{c}") for c in XYZ)


def _placed(vertices: DataFrame, key: str, prefix: str, *more: str) -> DataFrame:
    return vertices.select(F.col("vertex_id").alias(key), *[F.col(c).alias(f"{prefix}{c}") for c in (*XYZ, *more)])


def _unit(v: tuple) -> tuple:
    size = F.nullif(G.length(v), F.lit(0.0))
    return tuple(F.coalesce(c / size, F.lit(0.0)) for c in v)


def edge_faces(triangles: DataFrame) -> DataFrame:
    """(lo, hi, n, f0, o0, f1, o1): each edge's number of faces, and the face and the corner across of the first and the last of them."""
    ways = [("v0", "v1", "v2"), ("v1", "v2", "v0"), ("v2", "v0", "v1")]
    sides = F.array(*[F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"), F.struct(F.col("face_id").alias("f"), F.col(o).alias("o")).alias("of")) for a, b, o in ways])
    found = triangles.select(F.explode(sides).alias("s")).groupBy("s.lo", "s.hi").agg(F.count("*").alias("n"), F.min("s.of").alias("first"), F.max("s.of").alias("last"))
    other = F.col("n") > 1
    return found.select("lo", "hi", "n", F.col("first.f").alias("f0"), F.col("first.o").alias("o0"), F.when(other, F.col("last.f")).alias("f1"), F.when(other, F.col("last.o")).alias("o1"))


def bends(edges: DataFrame, triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """edges with the angle in degrees by which the surface bends there; null where an edge doesn't part two faces."""
    normals = M.face_normals(triangles, vertices).select("face_id", *[F.col(f"n{c}") for c in XYZ])
    side = lambda f, p: normals.select(F.col("face_id").alias(f), *[F.col(f"n{c}").alias(f"{p}{c}") for c in XYZ])
    met = edges.join(side("f0", "s_"), "f0").join(side("f1", "t_"), "f1", "left")
    cos = G.dot(_unit(_at("s_")), _unit(_at("t_")))
    return met.select(*edges.columns, F.when(F.col("n") == 2, F.degrees(F.acos(F.greatest(F.least(cos, F.lit(1.0)), F.lit(-1.0))))).alias("bend"))


def quadrics(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """vertices with QUADRIC: the sums over a vertex's faces of their planes' squares by area, and over its border edges of those of upright planes."""
    t = M.corners(triangles, vertices)
    a, b, c = (M.corner(k) for k in "abc")
    # Each step's columns are used many times by the next, so they are columns of their own and not spelt out again.
    t = _with(t, "w", G.cross(G.minus(b, a), G.minus(c, a)))
    t = _with(t.withColumn("area", G.length(_at("w")) / 2), "n", _unit(_at("w")))
    planes = t.select("face_id", *M.CORNERS, *_plane(_at("n"), a, F.col("area")))
    of_faces = planes.select(F.explode(F.array(*M.CORNERS)).alias("vertex_id"), *QUADRIC)
    border = edge_faces(triangles).filter("n = 1").select("lo", "hi", F.col("f0").alias("face_id"))
    ways = [("v0", "v1", "a", "b"), ("v1", "v2", "b", "c"), ("v2", "v0", "c", "a")]
    sides = F.array(*[F.struct(F.least(v, w).alias("lo"), F.greatest(v, w).alias("hi"), *[F.col(f"{m}_{c}").alias(f"{n}{c}") for m, n in ((k, "p"), (to, "q")) for c in XYZ]) for v, w, k, to in ways])
    rims = t.select("face_id", "nx", "ny", "nz", F.explode(sides).alias("s")).select("face_id", "nx", "ny", "nz", "s.*").join(border, ["face_id", "lo", "hi"])
    rims = _with(rims, "l", G.minus(_at("q"), _at("p")))
    rims = _with(rims, "c", G.cross(_at("l"), _at("n")))
    rims = _with(rims, "u", _unit(_at("c")))
    upright = rims.select("lo", "hi", *_plane(_at("u"), _at("p"), BORDER * G.dot(_at("l"), _at("l"))))
    of_borders = upright.select(F.explode(F.array("lo", "hi")).alias("vertex_id"), *QUADRIC)
    sums = of_faces.unionAll(of_borders).groupBy("vertex_id").agg(*[F.sum(q).alias(q) for q in QUADRIC])
    return vertices.select("vertex_id", *XYZ).join(sums, "vertex_id", "left").select("vertex_id", *XYZ, *[F.coalesce(q, F.lit(0.0)).alias(q) for q in QUADRIC])


def _with(df: DataFrame, prefix: str, v: tuple) -> DataFrame:
    return df.withColumns({f"{prefix}{c}": x for c, x in zip(XYZ, v, strict=True)})


def _plane(normal: tuple, through: tuple, weight: Column) -> list[Column]:
    """QUADRIC of one plane."""
    p = (*normal, -G.dot(normal, through))
    return [(weight * p[i] * p[j]).alias(q) for q, (i, j) in zip(QUADRIC, ((i, j) for i in range(4) for j in range(i, 4)), strict=True)]


def _error(q: list[Column], p: tuple) -> Column:
    x, y, z = p
    return q[0] * x * x + q[4] * y * y + q[7] * z * z + q[9] + 2 * (q[1] * x * y + q[2] * x * z + q[5] * y * z + q[3] * x + q[6] * y + q[8] * z)


def collapse_costs(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """edges (lo, hi, ...) with cost and the place x, y, z where both ends' quadrics have their least sum."""
    met = edges.join(_placed(vertices, "lo", "u_", *QUADRIC), "lo").join(_placed(vertices, "hi", "v_", *QUADRIC), "hi")
    met = met.select(*edges.columns, *[f"{p}{c}" for p in ("u_", "v_") for c in XYZ], *[(F.col(f"u_{q}") + F.col(f"v_{q}")).alias(q) for q in QUADRIC])
    q, u, v = [F.col(c) for c in QUADRIC], _at("u_"), _at("v_")
    c00, c01, c02 = q[4] * q[7] - q[5] * q[5], q[2] * q[5] - q[1] * q[7], q[1] * q[5] - q[2] * q[4]
    c11, c12, c22 = q[0] * q[7] - q[2] * q[2], q[1] * q[2] - q[0] * q[5], q[0] * q[4] - q[1] * q[1]
    met = met.withColumn("det", q[0] * c00 + q[1] * c01 + q[2] * c02).withColumn("scale", F.pow((q[0] + q[4] + q[7]) / 3, 3))
    met = met.withColumn("solved", F.abs("det") > FLAT * F.col("scale"))
    det = F.when(F.col("solved"), F.col("det")).otherwise(F.lit(1.0))
    best = tuple(-(r[0] * q[3] + r[1] * q[6] + r[2] * q[8]) / det for r in ((c00, c01, c02), (c01, c11, c12), (c02, c12, c22)))
    middle = tuple((a + b) / 2 for a, b in zip(u, v, strict=True))
    met = _with(met, "b_", best)
    best = _at("b_")
    tried = [F.struct(_error(q, p).alias("cost"), *[c.alias(n) for c, n in zip(p, XYZ, strict=True)]) for p in (middle, u, v)]
    solved = F.struct(_error(q, best).alias("cost"), *[c.alias(n) for c, n in zip(best, XYZ, strict=True)])
    met = met.withColumn("found", F.when(F.col("solved"), solved).otherwise(F.least(*tried)))
    return met.select(*edges.columns, F.greatest("found.cost", F.lit(0.0)).alias("cost"), *[F.col(f"found.{c}").alias(c) for c in XYZ])


def _allowed(candidates: DataFrame, vertices: DataFrame, triangles: DataFrame, edges: DataFrame, around: DataFrame, longest: float | None, reach: float | None) -> DataFrame:
    """Candidates (lo, hi, n, x, y, z, ...) whose collapse keeps the surface's topology and turns no face over, makes no edge longer than longest, and stays within reach of all planes it touches."""
    common = candidates.select("lo", "hi").join(around.select(F.col("src").alias("lo"), "dst"), "lo").join(around.select(F.col("src").alias("hi"), "dst"), ["hi", "dst"]).groupBy("lo", "hi").agg(F.count("*").alias("common"))
    rim = edges.filter("n = 1").select(F.explode(F.array("lo", "hi")).alias("vertex_id")).distinct().withColumn("rim", F.lit(True))
    ends = candidates.join(common, ["lo", "hi"]).filter("common = n and n <= 2")
    ends = ends.join(rim.toDF("lo", "rim_lo"), "lo", "left").join(rim.toDF("hi", "rim_hi"), "hi", "left").filter("n = 1 or rim_lo is null or rim_hi is null").drop("rim_lo", "rim_hi", "common")
    t = M.corners(triangles, vertices)
    turns = [("v0", "v1", "v2", "abc"), ("v1", "v2", "v0", "bca"), ("v2", "v0", "v1", "cab")]
    stars = t.select(F.explode(F.array(*[F.struct(F.col(p).alias("p"), F.col(q).alias("q"), F.col(r).alias("r"), *[F.col(f"{k}_{c}").alias(f"{n}_{c}") for k, n in zip(names, "pqr", strict=True) for c in XYZ]) for p, q, r, names in turns])).alias("s")).select("s.*")
    asked = ends.select("lo", "hi", *XYZ)
    moved = asked.withColumn("p", F.explode(F.array("lo", "hi"))).join(stars, "p").filter("not ((q = lo or q = hi) or (r = lo or r = hi))")
    new, p, q, r = _at(""), _at("p_"), _at("q_"), _at("r_")
    old_n, new_n = G.cross(G.minus(q, p), G.minus(r, p)), G.cross(G.minus(q, new), G.minus(r, new))
    bad = G.dot(old_n, new_n) <= TURN * G.length(old_n) * G.length(new_n)
    if longest is not None:
        bad = bad | (G.distance(new, q) > longest) | (G.distance(new, r) > longest)
    if reach is not None:
        bad = bad | (F.abs(G.dot(_unit(old_n), G.minus(new, p))) > reach)
    return ends.join(moved.filter(bad).select("lo", "hi").distinct(), ["lo", "hi"], "left_anti")


def _apart(candidates: DataFrame, around: DataFrame, rank: Column) -> DataFrame:
    """Candidates whose rank is the least among those that touch a neighbour of an end, or an end itself."""
    ranked = candidates.withColumn("rank", F.struct(rank.alias("r"), "lo", "hi"))
    at = ranked.select(F.explode(F.array("lo", "hi")).alias("vertex_id"), "rank").groupBy("vertex_id").agg(F.min("rank").alias("rank"))
    near = around.join(at.select(F.col("vertex_id").alias("dst"), "rank"), "dst").select(F.col("src").alias("vertex_id"), "rank")
    least = near.unionAll(at.select("vertex_id", "rank")).groupBy("vertex_id").agg(F.min("rank").alias("least"))
    out = ranked.join(least.toDF("lo", "least_lo"), "lo").join(least.toDF("hi", "least_hi"), "hi")
    return out.filter("rank = least_lo and rank = least_hi").drop("rank", "least_lo", "least_hi")


def _more_apart(candidates: DataFrame, around: DataFrame, chosen: DataFrame, rank: Column) -> DataFrame:
    """chosen and what is apart among those candidates that touch no chosen edge's end, nor a neighbour of one."""
    ends = chosen.select(F.explode(F.array("lo", "hi")).alias("vertex_id"))
    taken = ends.unionAll(around.join(ends.withColumnRenamed("vertex_id", "dst"), "dst").select(F.col("src").alias("vertex_id"))).distinct()
    free = candidates
    for c in ("lo", "hi"):
        free = free.join(taken.withColumnRenamed("vertex_id", c), c, "left_anti")
    return chosen.unionByName(_apart(stored(free, "free"), around, rank))


def _cheapest(chosen: DataFrame, faces: int, total: int, mixed: Column) -> DataFrame:
    """The cheapest of chosen (n, cost, ...), whose n come to total, that take `faces` faces together, or one more."""
    # Equal costs are told apart by a hash, else all of them were taken or none.
    part = F.pmod(mixed, F.lit(1 << 30)) / float(1 << 30)
    keyed = chosen.withColumn("key", F.when(F.col("cost") > 0, F.col("cost") * (1 + part / (1 << 20))).otherwise(part - 1))
    each = keyed.select("key", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))))
    most = each.agg(F.percentile_approx("key", (faces - 0.5) / total, 100_000)).first()[0]
    return keyed.filter(F.col("key") <= most).drop("key")


def _collapsed(vertices: DataFrame, triangles: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The mesh after the chosen edges (lo, hi, x, y, z) have become their lower end, there; further columns of vertices are added up."""
    sums = [c for c in vertices.columns if c not in ("vertex_id", *XYZ)]
    gone = vertices.select(F.col("vertex_id").alias("hi"), *[F.col(c).alias(f"g_{c}") for c in sums])
    to = chosen.select(F.col("lo").alias("vertex_id"), "hi", *[F.col(c).alias(f"to_{c}") for c in XYZ]).join(gone, "hi")
    kept = vertices.join(chosen.select(F.col("hi").alias("vertex_id")), "vertex_id", "left_anti").join(to, "vertex_id", "left")
    kept = kept.select("vertex_id", *[F.coalesce(f"to_{c}", c).alias(c) for c in XYZ], *[(F.col(c) + F.coalesce(f"g_{c}", F.lit(0.0))).alias(c) for c in sums])
    faces = triangles
    for c in M.CORNERS:
        faces = faces.join(chosen.select(F.col("hi").alias(c), F.col("lo").alias("to")), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
    faces = faces.filter("v0 <> v1 and v1 <> v2 and v0 <> v2").select("face_id", *M.CORNERS)
    return stored(kept, "vertices"), stored(faces, "faces")


def _both_ways(edges: DataFrame) -> DataFrame:
    """(src, dst) of neighbours, from stored edges that come once each."""
    return edges.filter("lo < hi").select(F.col("lo").alias("src"), F.col("hi").alias("dst")).unionAll(edges.filter("lo < hi").select(F.col("hi").alias("src"), F.col("lo").alias("dst")))


def decimated(vertices: DataFrame, triangles: DataFrame, wanted: int) -> tuple[DataFrame, DataFrame]:
    """Edges collapsed by quadric error until at most `wanted` faces are left, or none can be collapsed; a collapse takes two faces, so that one fewer may be left.

    A round takes the cheapest, by approximate quantile, of all edges that may collapse: as many as are still to go and half as many more, but a sixth of the edges at least.
    So each round but the last takes a like part of the mesh, also when few are to go, and the number of rounds follows from the ratio of faces and not from their number.
    Costs are ranked by powers of two, within a power by a hash of the round, so that on even surfaces a round finds many edges apart; a second pass fills up what
    the first one left. The last round takes the cheapest of what it has chosen.
    """
    vertices = stored(quadrics(vertices, triangles), "quadrics")
    left, turn = triangles.count(), 0
    while left > wanted:
        edges = stored(collapse_costs(vertices, edge_faces(triangles).select("lo", "hi", "n")), "edges")
        around = _both_ways(edges)
        fine = stored(_allowed(edges.filter("n <= 2 and lo < hi"), vertices, triangles, edges, around, None, None), "allowed")
        n, pool = fine.count(), max(0.75 * (left - wanted), edges.count() / 6)
        if not n:
            break
        if pool < n:
            fine = fine.filter(F.col("cost") <= fine.agg(F.percentile_approx("cost", pool / n, 1000)).first()[0])
        mixed = F.xxhash64("lo", "hi", F.lit(turn))
        rank = F.struct(F.when(F.col("cost") > 0, F.floor(F.log2("cost"))).otherwise(F.lit(-10_000)), mixed)
        first = stored(_apart(fine, around, rank), "apart")
        chosen = stored(_more_apart(fine, around, first, rank), "chosen")
        taken, turn = chosen.agg(F.sum("n")).first()[0], turn + 1
        if taken > left - wanted:
            chosen = stored(_cheapest(chosen, left - wanted, taken, mixed), "taken")
        vertices, triangles = _collapsed(vertices, triangles, chosen)
        left = triangles.count()
    return stored(M.without_unreferenced(vertices.select("vertex_id", *XYZ), triangles), "vertices"), triangles


def split_fans(vertices: DataFrame, triangles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices whose faces fall into several fans, that is sets linked over edges at the vertex, are parted: each fan but that of the least face gets a vertex of its own, at the same place.

    Edges should have two faces at most (`mesh.without_non_manifold`); of more, the first and the last are linked.
    """
    turns = [("v0", "v1"), ("v0", "v2"), ("v1", "v0"), ("v1", "v2"), ("v2", "v0"), ("v2", "v1")]
    sides = triangles.select(F.explode(F.array(*[F.struct(F.col(v).alias("v"), F.col(w).alias("w"), F.col("face_id").alias("f")) for v, w in turns])).alias("s")).select("s.*")
    shared = sides.groupBy("v", "w").agg(F.min("f").alias("a"), F.max("f").alias("b"))
    links = shared.select(F.struct("v", F.col("a").alias("f")).alias("a"), F.struct("v", F.col("b").alias("f")).alias("b"))
    fans = components(links).select("node.v", "node.f", F.col("root.f").alias("fan"))
    heads = fans.groupBy("v", "fan").agg(F.count("*").alias("faces")).join(fans.groupBy("v").agg(F.min("fan").alias("first")), "v").filter("fan <> first")
    first = (vertices.agg(F.max("vertex_id")).first()[0] or 0) + 1
    new = stored(heads.select("v", "fan", (F.monotonically_increasing_id() + first).alias("to")), "fans")
    moved = fans.join(new, ["v", "fan"]).select("v", F.col("f").alias("face_id"), "to")
    faces = triangles
    for c in M.CORNERS:
        faces = faces.join(moved.withColumnRenamed("v", c), ["face_id", c], "left").withColumn(c, F.coalesce("to", c)).drop("to")
    copies = new.join(vertices, F.col("v") == F.col("vertex_id")).select(*[F.col("to").alias(c) if c == "vertex_id" else F.col(c) for c in vertices.columns])
    return stored(vertices.unionAll(copies), "vertices"), stored(faces.select("face_id", *M.CORNERS), "faces")


def merged_within(vertices: DataFrame, triangles: DataFrame, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """Vertices linked by steps of at most the tolerance become the one of least id; then repeated and null faces and unused vertices go.

    Equal places are one before all else, and so are vertices of one cell of half the tolerance's side, whose diagonal is shorter than it; others meet by an equi-join of
    cells of the tolerance's side with half of their neighbours. What is compared within a cell are the vertices of different small cells, at most 8 of which
    fill it: links are counted once for each two small cells, so dense places cost comparisons but no rows.
    """
    if tolerance <= 0:
        return M.deduplicated(vertices, triangles)
    same = vertices.groupBy(*XYZ).agg(F.min("vertex_id").alias("to"))
    small = lambda c: F.floor(F.col(c) / (tolerance / 2)).cast("bigint")
    one = same.select("to", *XYZ, *[small(c).alias(f"s{c}") for c in XYZ], *[F.floor(small(c) / 2).cast("bigint").alias(f"c{c}") for c in XYZ])
    heads = one.groupBy("sx", "sy", "sz").agg(F.min("to").alias("head"))
    one = stored(one.join(heads, ["sx", "sy", "sz"]), "cells")
    steps = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (i, j, k) >= (0, 0, 0)]
    probe = one.select(F.col("head").alias("h"), *[F.col(c).alias(f"p{c}") for c in XYZ], *[F.col(f"c{c}").alias(f"o{c}") for c in XYZ], F.explode(F.array(*[F.struct(*[F.lit(s).alias(f"d{c}") for s, c in zip(step, XYZ, strict=True)]) for step in steps])).alias("d"))
    probe = probe.select("h", *[f"p{c}" for c in XYZ], *[(F.col(f"o{c}") + F.col(f"d.d{c}")).alias(f"c{c}") for c in XYZ])
    near = sum(((F.col(c) - F.col(f"p{c}")) * (F.col(c) - F.col(f"p{c}")) for c in "yz"), (F.col("x") - F.col("px")) * (F.col("x") - F.col("px"))) <= tolerance * tolerance
    across = probe.join(one, [f"c{c}" for c in XYZ]).filter((F.col("h") != F.col("head")) & near).select(F.least("h", "head").alias("a"), F.greatest("h", "head").alias("b")).distinct()
    roots = components(across.unionAll(one.select(F.col("to").alias("a"), F.col("head").alias("b"))))
    mapping = vertices.select("vertex_id", *XYZ).join(same, list(XYZ)).join(roots, F.col("to") == F.col("node")).select("vertex_id", F.col("root").alias("to"))
    faces = stored(M.without_degenerate(M.relabelled(triangles, mapping)), "faces")
    # Written, as every step that follows reads it several times.
    return stored(M.without_unreferenced(vertices, faces), "vertices"), faces


def _creases(edges: DataFrame, triangles: DataFrame, vertices: DataFrame, angle: float) -> DataFrame:
    """edges with bend and crease: whether the surface ends there, or bends by more than the angle."""
    bent = bends(edges, triangles, vertices)
    return bent.withColumn("crease", F.coalesce(F.col("bend") > angle, F.lit(True)))


def _held(edges: DataFrame, vertices: DataFrame, angle: float) -> DataFrame:
    """(vertex_id, corner) of the vertices on creases: a corner unless two creases meet there and go on nearly straight, turning by the angle at most."""
    met = edges.filter("crease").select("lo", "hi").join(_placed(vertices, "lo", "u_"), "lo").join(_placed(vertices, "hi", "v_"), "hi")
    met = _with(met, "d", _unit(G.minus(_at("v_"), _at("u_"))))
    ends = F.array(*[F.struct(F.col(v).alias("vertex_id"), *[(sign * F.col(f"d{c}")).alias(c) for c in XYZ]) for v, sign in (("lo", 1), ("hi", -1))])
    sums = met.select(F.explode(ends).alias("e")).groupBy("e.vertex_id").agg(F.count("*").alias("n"), *[F.sum(f"e.{c}").alias(c) for c in XYZ])
    # Two unit vectors that leave at an angle short of straight by `angle` add up to this length.
    return sums.select("vertex_id", ((F.col("n") != 2) | (G.length(_at("")) > 2 * math.sin(math.radians(angle) / 2))).alias("corner"))


def split_long(vertices: DataFrame, triangles: DataFrame, target: float, angle: float, adaptive: bool) -> tuple[DataFrame, DataFrame]:
    """Edges of more than 4/3 of the target halved; if adaptive, of a target that shrinks by the cosine of half the bend, to half at least."""
    edges = _creases(edge_faces(triangles), triangles, vertices, angle) if adaptive else edge_faces(triangles).withColumn("bend", F.lit(0.0))
    met = edges.join(_placed(vertices, "lo", "u_"), "lo").join(_placed(vertices, "hi", "v_"), "hi")
    part = F.greatest(F.cos(F.radians(F.coalesce("bend", F.lit(0.0))) / 2), F.lit(0.5))
    return M.split_edges(vertices, triangles, met.filter(G.distance(_at("u_"), _at("v_")) > 4 / 3 * target * part).select("lo", "hi"))


def collapse_short(vertices: DataFrame, triangles: DataFrame, target: float, angle: float, reach: float | None, turn: int) -> tuple[DataFrame, DataFrame]:
    """An independent set of the edges of less than 4/5 of the target collapsed, shortest first: to the middle, to the crease if one end lies on it, not across creases nor off corners."""
    edges = stored(_creases(edge_faces(triangles), triangles, vertices, angle), "edges")
    held, around = _held(edges, vertices, angle), _both_ways(edges)
    met = edges.join(_placed(vertices, "lo", "u_"), "lo").join(_placed(vertices, "hi", "v_"), "hi").withColumn("length", G.distance(_at("u_"), _at("v_"))).filter(F.col("length") < 0.8 * target)
    met = met.join(held.toDF("lo", "lo_corner"), "lo", "left").join(held.toDF("hi", "hi_corner"), "hi", "left")
    rank = lambda c: F.when(F.col(c).isNull(), 0).when(F.col(c), 2).otherwise(1)
    met = met.withColumn("lr", rank("lo_corner")).withColumn("hr", rank("hi_corner")).filter("(lr = 0 or hr = 0 or crease) and not (lr = 2 and hr = 2)")
    place = [F.when(F.col("lr") > F.col("hr"), F.col(f"u_{c}")).when(F.col("hr") > F.col("lr"), F.col(f"v_{c}")).otherwise((F.col(f"u_{c}") + F.col(f"v_{c}")) / 2).alias(c) for c in XYZ]
    asked = stored(met.select("lo", "hi", "n", "length", *place), "asked")
    fine = stored(_allowed(asked, vertices, triangles, edges, around, 4 / 3 * target, reach), "allowed")
    chosen = stored(_apart(fine, around, F.struct(F.floor(F.col("length") / target * 4), F.xxhash64("lo", "hi", F.lit(turn)))), "chosen")
    return (vertices, triangles) if chosen.isEmpty() else _collapsed(vertices, triangles, chosen)


def flip_edges(vertices: DataFrame, triangles: DataFrame, angle: float, reach: float | None, turn: int) -> tuple[DataFrame, DataFrame]:
    """An independent set of edges inside smooth parts turned to the other diagonal, where that brings the four corners' numbers of neighbours nearer to six (four on a border)."""
    edges = stored(_creases(edge_faces(triangles), triangles, vertices, angle), "edges")
    around = _both_ways(edges)
    rim = edges.filter("n = 1").select(F.explode(F.array("lo", "hi")).alias("vertex_id")).distinct().withColumn("rim", F.lit(True))
    off = around.groupBy(F.col("src").alias("vertex_id")).agg(F.count("*").alias("degree")).join(rim, "vertex_id", "left")
    off = stored(off.select("vertex_id", (F.col("degree") - F.when(F.col("rim"), 4).otherwise(6)).alias("off")), "degrees")
    names = (("lo", "a"), ("hi", "b"), ("o0", "c"), ("o1", "d"))
    quads = edges.filter("n = 2 and not crease and o0 <> o1")
    for key, name in names:
        quads = quads.join(off.toDF(key, f"off_{name}"), key).join(_placed(vertices, key, f"{name}_"), key)
    gain = sum((F.abs(f"off_{k}") - F.abs(F.col(f"off_{k}") + step) for k, step in (("b", -1), ("c", 1), ("d", 1))), F.abs("off_a") - F.abs(F.col("off_a") - 1))
    a, b, c, d = (_at(f"{k}_") for k in "abcd")
    # The turn of the first face tells on which side its corner lies: (a, b, c) or (b, a, c).
    first = triangles.select(F.col("face_id").alias("f0"), *M.CORNERS)
    quads = quads.withColumn("gain", gain).filter("gain > 0").join(first, "f0")
    right = F.expr("(v0 = lo and v1 = hi) or (v1 = lo and v2 = hi) or (v2 = lo and v0 = hi)")
    side = F.when(right, 1.0).otherwise(-1.0)
    old = tuple(p - q for p, q in zip(G.cross(G.minus(b, a), G.minus(c, a)), G.cross(G.minus(b, a), G.minus(d, a)), strict=True))
    one, other = G.cross(G.minus(d, a), G.minus(c, a)), G.cross(G.minus(c, b), G.minus(d, b))
    fine = (G.dot(old, one) > TURN * G.length(old) * G.length(one)) & (G.dot(old, other) > TURN * G.length(old) * G.length(other))
    if reach is not None:
        shift = tuple((c[i] + d[i] - a[i] - b[i]) / 2 for i in range(3))
        fine = fine & (F.abs(G.dot(_unit(old), shift)) <= reach)
    quads = quads.filter(fine).select("lo", "hi", "o0", "o1", "f0", "f1", "gain", (side > 0).alias("right"))
    free = quads.join(edges.select(F.col("lo").alias("x"), F.col("hi").alias("y")), (F.least("o0", "o1") == F.col("x")) & (F.greatest("o0", "o1") == F.col("y")), "left_anti")
    ranked = stored(free.withColumn("rank", F.struct(-F.col("gain"), F.xxhash64("lo", "hi", F.lit(turn)), F.col("lo"), F.col("hi"))), "quads")
    least = ranked.select(F.explode(F.array("lo", "hi", "o0", "o1")).alias("vertex_id"), "rank").groupBy("vertex_id").agg(F.min("rank").alias("least"))
    chosen = ranked
    for key, _ in names:
        chosen = chosen.join(least.toDF(key, "least"), key).filter("rank = least").drop("least")
    lo, hi, o0, o1 = (F.col(k) for k in ("lo", "hi", "o0", "o1"))
    new = [F.struct(F.col(f).alias("face_id"), *[F.when(F.col("right"), p).otherwise(q).alias(v) for p, q, v in zip(there, back, M.CORNERS, strict=True)]) for f, there, back in (("f0", (lo, o1, o0), (lo, o0, o1)), ("f1", (hi, o0, o1), (hi, o1, o0)))]
    turned = stored(chosen.select(F.explode(F.array(*new)).alias("t")).select("t.*"), "turned")
    if turned.isEmpty():
        return vertices, triangles
    return vertices, stored(triangles.join(turned.select("face_id"), "face_id", "left_anti").select("face_id", *M.CORNERS).unionAll(turned), "faces")


def relaxed(vertices: DataFrame, triangles: DataFrame, angle: float, strength: float = 0.5) -> DataFrame:
    """vertices (vertex_id, x, y, z, free) drawn along the surface to their neighbours' mean; free is false for those on creases and borders, which stay."""
    creases = _creases(edge_faces(triangles), triangles, vertices, angle).filter("crease")
    held = creases.select(F.explode(F.array("lo", "hi")).alias("vertex_id")).distinct().withColumn("held", F.lit(True))
    mean = M.edges(triangles).distinct().join(_placed(vertices, "dst", "m_"), "dst").groupBy(F.col("src").alias("vertex_id")).agg(*[F.avg(f"m_{c}").alias(f"m_{c}") for c in XYZ])
    met = vertices.join(mean, "vertex_id", "left").join(M.vertex_normals(triangles, vertices), "vertex_id", "left").join(held, "vertex_id", "left")
    pull = G.minus(_at("m_"), _at(""))
    lift = G.dot(pull, _at("n"))
    free = F.col("held").isNull() & F.col("m_x").isNotNull() & F.col("nx").isNotNull()
    return met.select("vertex_id", *[F.when(free, F.col(c) + strength * (pull[i] - lift * F.col(f"n{c}"))).otherwise(F.col(c)).alias(c) for i, c in enumerate(XYZ)], free.alias("free"))


def reprojected(vertices: DataFrame, surface: M.Surface) -> DataFrame:
    """The free ones of vertices (vertex_id, x, y, z, free) moved to their nearest points of the surface."""
    zero = [F.lit(0.0).alias(f"n{c}") for c in XYZ]
    hits = surface.closest(vertices.filter("free").select(F.col("vertex_id").alias("face_id"), *XYZ, *zero)).select(F.col("face_id").alias("vertex_id"), *[f"h{c}" for c in XYZ])
    return vertices.join(hits, "vertex_id", "left").select("vertex_id", *[F.coalesce(f"h{c}", c).alias(c) for c in XYZ])


def isotropic(vertices: DataFrame, triangles: DataFrame, target: float, rounds: int, angle: float = 60.0, reach: float | None = None, collapse: bool = True, split: bool = True, adaptive: bool = False, surface: M.Surface | None = None) -> tuple[DataFrame, DataFrame]:
    """Rounds that split long edges, collapse short ones, flip edges towards six neighbours, relax vertices along the surface and, where a surface is given, move them back on it."""
    vertices = vertices.select("vertex_id", *XYZ)
    for i in range(rounds):
        if split:
            vertices, triangles = split_long(vertices, triangles, target, angle, adaptive)
        if collapse:
            vertices, triangles = collapse_short(vertices, triangles, target, angle, reach, i)
        vertices, triangles = flip_edges(vertices, triangles, angle, reach, i)
        moved = stored(relaxed(vertices, triangles, angle), "relaxed")
        vertices = stored(reprojected(moved, surface) if surface else moved.drop("free"), "vertices")
    return vertices, triangles
