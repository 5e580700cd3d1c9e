"""Queries over viewer arithmetic and scene tables, and the SQL that says what each returns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import geometry as G
from plumbline.operators import viewer as V
from plumbline.plans import fixtures as X
from plumbline.plans.fixtures import with_views
from plumbline.sources.tiles import world_matrices

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def R(text: str, digits: int = 6) -> str:
    return f"round({text}, {digits})+0.0"


def rounded(rows: DataFrame, digits: int = 6) -> DataFrame:
    return rows.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes])


def R8(text: str) -> str:
    return R(text, 8)


def rounded8(rows: DataFrame) -> DataFrame:
    return rounded(rows, 8)


def _turn(q: tuple[float, float, float, float], t: tuple[float, float, float]) -> list[float]:
    """A fixed pose as 16 numbers, column by column."""
    x, y, z, w = q
    rows = [[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]]
    return [v for c in range(3) for v in (rows[0][c], rows[1][c], rows[2][c], 0.0)] + [*t, 1.0]


CLOUD, ALIGN = _turn((0.0, 0.6, 0.0, 0.8), (1.0, 2.0, 3.0)), _turn((0.0, 0.0, math.sqrt(0.5), math.sqrt(0.5)), (-4.0, 0.5, 2.0))


def _product(a: list[float], b: list[float]) -> list[float]:
    return [sum(a[4 * k + r] * b[4 * c + k] for k in range(4)) for c in range(4) for r in range(4)]


def _inverse(m: list[float]) -> list[float]:
    turned = [m[4 * r + c] for c in range(3) for r in range(3)]
    back = [-sum(m[4 * c + k] * m[12 + k] for k in range(3)) for c in range(3)]
    return [*turned[:3], 0.0, *turned[3:6], 0.0, *turned[6:], 0.0, *back, 1.0]


def _array(m: list[float]) -> Column:
    return F.array(*map(F.lit, m))


def _moved_sql(m: list[float], x: str, y: str, z: str, names: str) -> str:
    return ", ".join(f"{R(f'({m[r]})*({x})+({m[4 + r]})*({y})+({m[8 + r]})*({z})+({m[12 + r]})')} as {names[r]}" for r in range(3))


_WORLD, _QUARTER = _product(CLOUD, _inverse(ALIGN)), [1.0, 0, 0, 0, 0, 0, -1.0, 0, 0, 1.0, 0, 0, 0, 0, 0, 1.0]


@query(with_views(f"select point_id, {_moved_sql(_WORLD, 'x', 'y', 'z', 'xyz')}, {_moved_sql(_product(_QUARTER, _inverse(ALIGN)), 'x', 'y', 'z', 'abc')}, {_moved_sql(CLOUD, 'case when point_id%2=0 then 0 else x end', 'case when point_id%2=0 then 0 else y end', 'case when point_id%2=0 then 0 else z end', 'def')}, point_id%3<>0 as usable from v_points"))
def calibration_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The desired world matrix's origin for each centre, a point by the viewer's calibration matrix, and a matrix before centring."""
    p, zero = tuple(F.col(c) for c in "xyz"), F.lit(0.0)
    rows = X.points(spark, sf_dir).withColumns({"world": G.desired_world(_array(CLOUD), _array(ALIGN), p), "viewer": G.calibration_matrix(_array(ALIGN)), "raw": G.decentred(_array(CLOUD), p, F.col("point_id") % 2 == 0)})
    world, seen, raw = G.transform_point(F.col("world"), zero, zero, zero), G.transform_point(F.col("viewer"), *p), G.transform_point(F.col("raw"), *p)
    usable = G.is_rigid_array(F.array(*[F.lit(1.0)] * 15, F.when(F.col("point_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.lit(1.0))))
    return rounded(rows.select("point_id", *[v.alias(c) for v, c in zip((*world, *seen, *raw), "xyzabcdef", strict=True)], usable.alias("usable")))


@query(with_views(f"select vertex_id, {R('degrees(2*asin(sin(radians(x*40)/2)))', 4)} as yaw, {R('x+ny')} as px, {R('y+nz')} as py, {R('z+nx')} as pz, {R('degrees(asin(least(greatest(sin(radians(y*40)),-1),1)))', 4)} as pitch from v_vertices"))
def orientation_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn about y read back as Euler angles in both orders, and offsets with exchanged axes."""
    identity = (F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    at = tuple(F.col(c) for c in "xyz")
    yaw = G.euler_yxz(G.pose_matrix(G.turned_about_y(F.col("x") * 40, identity), at))[1]
    pitch = G.euler_xyz(G.pose_matrix(G.turned_about_y(F.col("y") * 40, identity), at))[1]
    p = G.lifted_position(at, (F.col("ny"), F.col("nx"), F.col("nz")))
    return rounded(rounded(X.vertices(spark, sf_dir).select("vertex_id", (F.round(yaw, 4) + 0.0).alias("yaw"), *[v.alias(f"p{c}") for v, c in zip(p, "xyz", strict=True)], (F.round(pitch, 4) + 0.0).alias("pitch"))))


@query(with_views("select point_id, y+1 as low, 9-y as low_least, y/2+3 as high_least, least(greatest(x, 0), y+3) as low_at, 20-least(greatest(x, y), 20) as high_at, least(greatest(x, 0), 5) as lo, case when least(greatest(x,0),5)+least(greatest(y,0),5)>5 then greatest(0, 5-least(greatest(x,0),5)) else least(greatest(y,0),5) end as hi from v_cloud"))
def clip_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, zero = F.col("x"), F.col("y"), F.lit(0.0)
    low = G.clip_face(y + 1, y + 4, 9 - y, F.lit(20.0), False)
    high = G.clip_face(y / 2 + 3, y + 4, zero, F.lit(20.0), True)
    lo, hi = G.clip_offsets(x, y, F.lit(5.0))
    return X.cloud(spark, sf_dir).select("point_id", low[0].alias("low"), low[1].alias("low_least"), high[1].alias("high_least"), G.clip_face_offset(x, y, y + 3, zero, F.lit(20.0), False).alias("low_at"), G.clip_face_offset(x, y, y + 3, zero, F.lit(20.0), True).alias("high_at"), lo.alias("lo"), hi.alias("hi"))


_STEPS = {0.01: 2, 0.5: 1, 1.0: 0, 0.0001: 3, 1e-7: 3, 0.125: 3, -1.0: 2, 0.0: 2}
_LIMITS = ("0.93", "NaN", "x", "1e3", "-4", "1.117", None, "Infinity")


@query(f"select k, ({list(_STEPS.values())})[k%8+1] as digits, ([0.93, 0.95, 0.95, 1, 0.5, 1, 0.95, 0.95])[k%8+1] as bound, ([0.93, 0.2, 0.2, 2, 0.2, 1.12, 0.2, 0.2])[k%8+1] as step from (select o_orderkey as k from orders)")
def step_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("o_orderkey") % 8 + 1).cast("int"))
    text = of(_LIMITS)
    return X.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), G.step_decimals(of(_STEPS)).alias("digits"), G.bounded_threshold(text, 0.5, 1.0, 0.95).cast("decimal(4,2)").cast("double").alias("bound"), F.round(G.adjust_step(text, 0.01, 2.0, 0.2), 2).alias("step"))


_FIT = math.sin(math.radians(30))


@query(
    with_views(
        f"select point_id, {R8('sqrt((x-y)*(x-y)+(y-z)*(y-z)+(z-1)*(z-1))')} as distance, {R8('abs(z-y)')} as rise, {R8('(x-10)/200*2-1')} as px, {R8('-((y-20)/100*2)+1')} as py, {R8('z+x-1')} as camera, {R8('case when y>0 then z*x/y end')} as zoomed, "
        f"{R8('degrees(atan2(x, y))')} as lon, {R8('90-degrees(acos(least(greatest(z/sqrt(x*x+y*y+z*z), -1), 1)))')} as lat, {R8(f'sqrt(x*x+y*y+z*z)/2/{_FIT}')} as fit, (x-y)*(x-y)+(z-1)*(z-1)<=400 as same, {R8('least(x*0.02, 1.5)')} as sliver, {R8('least(greatest(x, 5), 90)')} as held from v_cloud where x>0"
    )
)
def viewer_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, z, one = F.col("x"), F.col("y"), F.col("z"), F.lit(1.0)
    a, b = (x, y, z), (y, z, one)
    px, py = G.pointer_place(x, y, F.lit(10.0), F.lit(20.0), F.lit(200.0), F.lit(100.0))
    lon, lat = G.orientation(x, z, y)
    return rounded8(
        X.cloud(spark, sf_dir).filter("x > 0").select(
            "point_id", G.distance(a, b).alias("distance"), G.height_difference(a, (x, z, y)).alias("rise"), px.alias("px"), py.alias("py"), G.followed((x,), (one,), (z,))[0].alias("camera"), G.followed_distance(x, y, z).alias("zoomed"),
            lon.alias("lon"), lat.alias("lat"), G.fit_distance(x, y, z).alias("fit"), G.same_pose(x, z, y, one, 20.0).alias("same"), G.sliver_threshold(x, F.lit(0.02), F.lit(1.5)).alias("sliver"), G.clamp(x, 5.0, 90.0).alias("held"),
        )
    )


_RISE = "(greatest(0, ln(y)/ln(2)-ln(d)/ln(2)) + greatest(0, ln(2*d)/ln(2)-ln(d)/ln(2)))/8"


@query(with_views(f"select point_id, case when point_id%5=0 then 1.0 else {R(f'greatest(exp(-{_RISE}*220*cast(0.01 as double)), 0.22)')} end as shade from (select *, x+1 as d, y+cast(0.5 as double) as yy from v_cloud) t, lateral (select yy as y) q".replace("ln(y)", "ln(q.y)")))
def eye_dome(spark: SparkSession, sf_dir: str) -> DataFrame:
    depth = F.when(F.col("point_id") % 5 == 0, None).otherwise(F.col("x") + 1)
    neighbours = F.array(F.col("y") + 0.5, (F.col("x") + 1) / 2, (F.col("x") + 1) * 2, F.lit(None).cast("double"))
    return rounded(X.cloud(spark, sf_dir).filter("x + 1 > 0").select("point_id", G.eye_dome_shade(depth, neighbours, F.lit(0.01)).alias("shade")))


@query(with_views(f"select vertex_id, {R('x')} as m03, {R('2*(nx*ny-nz*w)/q')} as m01, {R('z+5')} as m23, {R('case when nx<>0 and -x/nx>=0 then -x/nx end')} as t from (select *, cast(0.5 as double) as w, nx*nx+ny*ny+nz*nz+cast(0.25 as double) as q from v_vertices)"))
def pose_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matrix of a pose, as rows and back, moved; and where a ray along the normal meets the plane x = 0."""
    at, n, zero = tuple(F.col(c) for c in "xyz"), tuple(F.col(f"n{c}") for c in "xyz"), F.lit(0.0)
    m = G.pose_matrix((*n, F.lit(0.5)), at)
    rows = G.to_rows(m)
    moved = G.moved(G.to_column_major(rows), zero, zero, F.lit(5.0))
    return rounded(X.vertices(spark, sf_dir).select("vertex_id", rows[0][3].alias("m03"), rows[0][1].alias("m01"), moved[14].alias("m23"), G.ray_plane(at, n, (zero, zero, zero), (F.lit(1.0), zero, zero)).alias("t")))


@query("select l_orderkey as node_id, cast(sum(l_partkey*20000) as bigint) as bytes, sum(l_partkey*20000)<=260046848 as visible from lineitem group by 1")
def node_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.geometry_bytes(X.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("node_id"), (F.col("l_partkey") * 20000).alias("n_bytes")))


@query("select o_orderkey as node_id, o_orderkey*500<=2700000 as wire from orders where o_orderkey%2=0 and o_orderkey%3<>0 and o_custkey%5<>0 and o_custkey%7<>0 and o_orderkey%11<>0")
def static_meshes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    nodes = X.read(spark, sf_dir, "orders").select(k.alias("node_id"), (k % 2 == 0).alias("is_mesh"), (k % 3 != 0).alias("has_geometry"), (c % 5 == 0).alias("is_skinned"), (c % 7 == 0).alias("is_instanced"), F.when(k % 11 != 0, k - 1).alias("parent_id"))
    return V.static_meshes(nodes).select("node_id", V.wire_allowed(F.col("node_id") * 500).alias("wire"))


@query(with_views("select min(x-1) as min_x, min(y-1) as min_y, min(z-1) as min_z, max(x+1) as max_x, max(y+1) as max_y, max(z+1) as max_z from v_cloud where point_id%3=0"))
def visible_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = V.G.sphere_box(tuple(F.col(c) for c in "xyz"), F.lit(1.0))
    boxes = X.cloud(spark, sf_dir).select((F.col("point_id") % 3 == 0).alias("visible"), *[v.alias(f"min_{c}") for v, c in zip(low, "xyz", strict=True)], *[v.alias(f"max_{c}") for v, c in zip(high, "xyz", strict=True)])
    return V.visible_box(boxes)


_A = "tan(radians(ray_id*2))"
_RAYS = "select n_nationkey as ray_id, cast((n_nationkey-12)/cast(20 as double) as double) as ox, cast((n_nationkey%5-2)/cast(10 as double) as double) as oy, cast(-50 as double) as oz, cast(0 as double) as dx, cast(0 as double) as dy, cast(1 as double) as dz from nation"
_HITS = """select ray_id, face_id, (e2z*qz+e2x*qx+e2y*qy)/det as t from (select *, (sx*px+sy*py)/det as u, (dz*qz)/det as v from (select *, sy*e1z-sz*e1y as qx, sz*e1x-sx*e1z as qy, sx*e1y-sy*e1x as qz from
(select *, -e2y as px, e2x as py, e1x*(-e2y)+e1y*e2x as det, ox-ax as sx, oy-ay as sy, oz-az as sz from (select r.*, t.face_id, a.x as ax, a.y as ay, a.z as az, b.x-a.x as e1x, b.y-a.y as e1y, b.z-a.z as e1z, c.x-a.x as e2x, c.y-a.y as e2y, c.z-a.z as e2z from r, v_triangles t join v_vertices a on t.v0=a.vertex_id join v_vertices b on t.v1=b.vertex_id join v_vertices c on t.v2=c.vertex_id)) where det<>0)) where u>=0 and v>=0 and u+v<=1 and (e2z*qz+e2x*qx+e2y*qy)/det>=0"""


@query(with_views(f"select ray_id, arg_min(face_id, (t, face_id)) as first, {R('min(t)')} as first_t, coalesce(arg_min(face_id, (t, face_id)) filter (face_id%4<>0), arg_min(face_id, (t, face_id))) as pick from h group by 1", r=_RAYS, h=_HITS))
def picked_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.operators import mesh as M

    k = F.col("n_nationkey")
    rays = X.read(spark, sf_dir, "nation").select(k.alias("ray_id"), ((k - 12) / 20).alias("ox"), ((k % 5 - 2) / 10).alias("oy"), F.lit(-50.0).alias("oz"), F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"), F.lit(1.0).alias("dz"))
    corners = M.corners(X.triangles(spark, sf_dir), X.vertices(spark, sf_dir)).withColumn("ignored", F.col("face_id") % 4 == 0)
    return rounded(V.picked(V.hits(rays, corners)))


_NODES = "select p_partkey as node, case when p_partkey%100=1 then null else p_partkey-1 end as parent, p_size%4 as q, p_size%7 as tx, p_partkey%5 as ty from part"
_TURN = "([1,0,-1,0])[w.t+1]", "([0,1,0,-1])[w.t+1]"


@query(
    f"with recursive n as ({_NODES}), w as (select node, cast(q as bigint) as t, cast(tx as bigint) as x, cast(ty as bigint) as y, cast(1 as bigint) as z from n where parent is null"
    f" union all select n.node, (w.t+n.q)%4, w.x+{_TURN[0]}*n.tx-{_TURN[1]}*n.ty, w.y+{_TURN[1]}*n.tx+{_TURN[0]}*n.ty, w.z+1 from n join w on n.parent=w.node)"
    " select node as node_id, cast(([1,0,-1,0])[t+1] as bigint) as cosine, cast(([0,1,0,-1])[t+1] as bigint) as sine, cast(x as bigint) as x, cast(y as bigint) as y, cast(z as bigint) as z from w"
)
def scene_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of up to a hundred nodes, each turned by quarters about z and moved against the one above it."""
    key, size = F.col("p_partkey"), F.col("p_size")
    turn = lambda *v: F.element_at(F.array(*map(F.lit, v)), (size % 4 + 1).cast("int"))
    cosine, sine = turn(1, 0, -1, 0), turn(0, 1, 0, -1)
    places = (cosine, sine, F.lit(0), F.lit(0), -sine, cosine, F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit(1), F.lit(0), size % 7, key % 5, F.lit(1), F.lit(1))
    nodes = X.read(spark, sf_dir, "part").select(key.alias("node_id"), F.when(key % 100 != 1, key - 1).alias("parent_id"), F.array(*[p.cast("double") for p in places]).alias("matrix"))
    at = {"cosine": 0, "sine": 1, "x": 12, "y": 13, "z": 14}
    return world_matrices(nodes).select("node_id", *[F.col("matrix")[i].cast("bigint").alias(c) for c, i in at.items()])
