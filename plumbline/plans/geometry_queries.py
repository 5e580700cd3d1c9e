"""Queries over points and meshes, and the SQL that says what each returns."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import color
from plumbline.functions import geometry as G
from plumbline.operators import mesh, neighbours, points, registration
from plumbline.operators import remesh as reshaped
from plumbline.plans import fixtures as X
from plumbline.plans.fixtures import with_views

MATRIX = [0.0, 1.0, 0.0, 0.0, -1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 10.0, -2.0, 3.0, 1.0]
QUERIES, SQL = {}, {}
D = lambda x: f"cast({x} as double)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a few decimals, without a negative zero."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


R = lambda x, n=6: f"round({x}, {n}) + 0.0"

_NEAREST = "select vertex_id, arg_min(point_id, (d2, point_id)) as point_id, arg_min(case when side >= 0 then sqrt(d2) else -sqrt(d2) end, (d2, point_id)) as d from (select v.vertex_id, p.point_id, (p.x-v.x)*(p.x-v.x)+(p.y-v.y)*(p.y-v.y)+(p.z-v.z)*(p.z-v.z) as d2, v.nx*(p.x-v.x)+v.ny*(p.y-v.y)+v.nz*(p.z-v.z) as side from v_vertices v, v_points p) group by vertex_id"


def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(X.vertices(spark, sf_dir), X.points(spark, sf_dir))


@query(with_views(f"select vertex_id, point_id, {R('d')} as d from n", n=_NEAREST))
def c2m_nn_signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(nearest(spark, sf_dir))


@query(with_views(f"select {R('min(d)')} as min, {R('max(d)')} as max, {R('avg(d)')} as mean, {R('stddev_pop(d)')} as std, {R('quantile_cont(d, 0.5)')} as p50, {R('quantile_cont(d, 0.9)')} as p90, {R('quantile_cont(d, 0.95)')} as p95, {R('quantile_cont(d, 0.99)')} as p99, count(d) as n from n", n=_NEAREST))
def c2m_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(points.distance_statistics(nearest(spark, sf_dir)))


@query(with_views(f"select vertex_id, point_id, {R('d')} as d from n", n=_NEAREST.replace("p.x", "(p.x+19)")))
def c2m_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan 19 m beside the model, as with a wrong alignment."""
    return rounded(neighbours.nearest(X.vertices(spark, sf_dir), X.points(spark, sf_dir).withColumn("x", F.col("x") + 19)))


_BINS, _REACH = 20, 0.05


@query(with_views(f"select cast(b as integer) as bin, {R('b * (2*0.05/20) - 0.05')} as low, {R('(b+1) * (2*0.05/20) - 0.05')} as high, count(d) as n from range({_BINS}) t(b) left join n on d between -0.05 and 0.05 and least(floor((d+{D(0.05)})/({D(0.1)}/20)), 19) = b group by b", n=_NEAREST))
def c2m_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(points.histogram(nearest(spark, sf_dir), _REACH, _BINS))


@query(with_views("select count(*) filter (where not d between -0.02 and 0.02) as overflow_count from n", n=_NEAREST))
def c2m_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.overflow_count(nearest(spark, sf_dir), 0.02)


_CANDIDATES = "select v.vertex_id, p.point_id, (p.x-v.x)*(p.x-v.x)+(p.y-v.y)*(p.y-v.y)+(p.z-v.z)*(p.z-v.z) as d2, v.nx*(p.x-v.x)+v.ny*(p.y-v.y)+v.nz*(p.z-v.z) as side from v_vertices v, v_points p"
_TOP = "select *, side / greatest(sqrt(d2), 1e-12) >= cos(radians(75)) and side >= 0 as fine from (select *, row_number() over (partition by vertex_id order by d2, point_id) as k from c) where k <= 8"


@query(with_views(f"select vertex_id, coalesce(arg_min(point_id, k) filter (where fine), arg_min(point_id, k)) as point_id, {R('coalesce(arg_min(case when side>=0 then sqrt(d2) else -sqrt(d2) end, k) filter (where fine), arg_min(case when side>=0 then sqrt(d2) else -sqrt(d2) end, k))')} as d, bool_or(fine) as valid from t group by vertex_id", c=_CANDIDATES, t=_TOP))
def knn_normal_constrained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(neighbours.nearest_constrained(X.vertices(spark, sf_dir), X.points(spark, sf_dir)))


@query(with_views("select avg(case when fine then 1.0 else 0.0 end) as valid_ratio, count(*) filter (where not fine) as fallback_count from (select vertex_id, bool_or(fine) as fine from t group by vertex_id)", c=_CANDIDATES, t=_TOP))
def knn_valid_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neighbours.nearest_constrained(X.vertices(spark, sf_dir), X.points(spark, sf_dir))
    return found.agg(F.avg(F.when(F.col("valid"), 1.0).otherwise(0.0)).alias("valid_ratio"), F.count_if(~F.col("valid")).alias("fallback_count"))


@query(with_views(f"select vertex_id, point_id, {R('d2', 9)} as d2 from (select *, row_number() over (partition by vertex_id order by d2, point_id) as k from c where d2 <= {D(0.03)}*{D(0.03)}) where k = 1", c=_CANDIDATES))
def radius_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(neighbours.within_radius(X.vertices(spark, sf_dir), X.points(spark, sf_dir), 0.03), 9)


@query(with_views(f"select {R('count(d2) / count(*)')} as fitness, {R('sqrt(avg(d2))')} as inlier_rmse from v_vertices v left join (select vertex_id, min(d2) as d2 from c where d2 <= {D(0.03)}*{D(0.03)} group by vertex_id) m using (vertex_id)", c=_CANDIDATES))
def registration_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = X.vertices(spark, sf_dir)
    return rounded(neighbours.registration_quality(v, neighbours.within_radius(v, X.points(spark, sf_dir), 0.03)))


@query(with_views(f"select point_id, {R('-y + 10')} as x, {R('x - 2')} as y, {R('z + 3')} as z from v_cloud"))
def transform_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(points.transform(X.cloud(spark, sf_dir), MATRIX))


_BOX = "select min(x) as min_x, max(x) as max_x, min(y) as min_y, max(y) as max_y, min(z) as min_z, max(z) as max_z from "


@query(with_views(_BOX + "v_cloud"))
def bounding_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.bounding_box(X.cloud(spark, sf_dir))


@query(with_views(f"select {R('i / u')} as iou from (select greatest(least(a.max_x,b.max_x)-greatest(a.min_x,b.min_x),0)*greatest(least(a.max_y,b.max_y)-greatest(a.min_y,b.min_y),0)*greatest(least(a.max_z,b.max_z)-greatest(a.min_z,b.min_z),0) as i, (a.max_x-a.min_x)*(a.max_y-a.min_y)*(a.max_z-a.min_z)+(b.max_x-b.min_x)*(b.max_y-b.min_y)*(b.max_z-b.min_z)-i as u from pb a, vb b)", pb=_BOX + "v_points", vb=_BOX + "v_vertices"))
def box_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(points.box_overlap(points.bounding_box(X.points(spark, sf_dir)), points.bounding_box(X.vertices(spark, sf_dir))))


@query(with_views("select point_id, x, y, z from v_cloud where x between 50 and 150 and y between 10 and 60 and z between 1 and 8"))
def clip_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.clip(X.cloud(spark, sf_dir), (50, 10, 1), (150, 60, 8))


@query(with_views("select point_id, x, y, z from v_cloud where x between 50 and 150 and y between 10 and 60 and z between 1 and 8 - 7*(100-40)/100.0"))
def clip_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = (50, 10, 1), (150, 60, 8)
    return points.clip(X.cloud(spark, sf_dir), *points.effective_box(low, high, points.section_offsets(low, high, 40)))


_ORIGIN = "select min(x)-2.5 as ox, min(y)-2.5 as oy, min(z)-2.5 as oz from v_cloud"


@query(with_views(f"select cast(floor((x-ox)/5) as bigint) as vx, cast(floor((y-oy)/5) as bigint) as vy, cast(floor((z-oz)/5) as bigint) as vz, {R('avg(x)', 10)} as x, {R('avg(y)', 10)} as y, {R('avg(z)', 10)} as z, count(*) as n from v_cloud, o group by all", o=_ORIGIN))
def voxel_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(points.voxel_mean(X.cloud(spark, sf_dir), 5.0), 10)


@query(with_views(f"select {R('avg(x)', 4)} as mean_x, {R('avg(y)', 4)} as mean_y, {R('avg(z)', 4)} as mean_z, count(*) as n from (select avg(x) as x, avg(y) as y, avg(z) as z from f, (select min(x)-2.5 as ox, min(y)-2.5 as oy, min(z)-2.5 as oz from f) group by floor((f.x-ox)/5), floor((f.y-oy)/5), floor((f.z-oz)/5))", f="select avg(x) as x, avg(y) as y, avg(z) as z from v_cloud c join (select point_id%4 as k, min(x)-2.5 as ox, min(y)-2.5 as oy, min(z)-2.5 as oz from v_cloud group by 1) o on c.point_id%4=o.k group by k, floor((c.x-ox)/5), floor((c.y-oy)/5), floor((c.z-oz)/5)"))
def voxel_two_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = points.voxel_two_phase(X.cloud(spark, sf_dir), 5.0, F.col("point_id") % 4)
    return rounded(found.agg(*[F.avg(c).alias(f"mean_{c}") for c in "xyz"], F.count("*").alias("n")), 4)


@query(with_views(f"select point_id, {R('x-(min_x+max_x)/2')} as x, {R('y-(min_y+max_y)/2')} as y, {R('z-(min_z+max_z)/2')} as z from v_points, b", b=_BOX + "v_points"))
def recentre(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(points.recentre(X.points(spark, sf_dir)))


_EDGES = "select unnest([v0,v1,v1,v2,v2,v0]) as src, unnest([v1,v0,v2,v1,v0,v2]) as dst from v_triangles"


@query(with_views("select src, count(*) as degree, count(distinct dst) as neighbours from e group by src", e=_EDGES))
def mesh_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.edges(X.triangles(spark, sf_dir)).groupBy("src").agg(F.count("*").alias("degree"), F.countDistinct("dst").alias("neighbours"))


_ROUND = lambda source: f"select v.vertex_id, 0.5*v.d + 0.5*coalesce(m.m, 0) as d from {source} v left join (select src, avg(d) as m from e join {source} s on e.dst=s.vertex_id group by src) m on v.vertex_id=m.src"


@query(with_views(f"select vertex_id, {R('d')} as d from d3", e=_EDGES, d0="select vertex_id, x as d from v_vertices", d1=_ROUND("d0"), d2=_ROUND("d1"), d3=_ROUND("d2")))
def laplacian_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = X.vertices(spark, sf_dir).select("vertex_id", F.col("x").alias("d"))
    return rounded(mesh.smooth(values, X.triangles(spark, sf_dir), 3, 0.5))


@query(with_views(f"select vertex_id, {R('coalesce(m, 0)')} as mean, coalesce(n, 1) as degree from v_vertices v left join (select src, avg(x) as m, count(*) as n from e join v_vertices s on e.dst=s.vertex_id group by src) on vertex_id=src", e=_EDGES))
def neighbour_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(mesh.neighbour_means(X.vertices(spark, sf_dir).select("vertex_id", F.col("x").alias("d")), mesh.edges(X.triangles(spark, sf_dir))))


_CORNERS = "select face_id, a.x ax, a.y ay, a.z az, b.x bx, b.y by_, b.z bz, c.x cx, c.y cy, c.z cz from v_triangles t join v_vertices a on t.v0=a.vertex_id join v_vertices b on t.v1=b.vertex_id join v_vertices c on t.v2=c.vertex_id"
_SIDES = "select face_id, sqrt((ax-bx)**2+(ay-by_)**2+(az-bz)**2) ab, sqrt((bx-cx)**2+(by_-cy)**2+(bz-cz)**2) bc, sqrt((cx-ax)**2+(cy-ay)**2+(cz-az)**2) ca, sqrt(((by_-ay)*(cz-az)-(bz-az)*(cy-ay))**2+((bz-az)*(cx-ax)-(bx-ax)*(cz-az))**2+((bx-ax)*(cy-ay)-(by_-ay)*(cx-ax))**2)/2 area from k"


@query(with_views(f"select face_id, {R('ax')} as a_x, {R('ay')} as a_y, {R('az')} as a_z, {R('bx')} as b_x, {R('by_')} as b_y, {R('bz')} as b_z, {R('cx')} as c_x, {R('cy')} as c_y, {R('cz')} as c_z from k", k=_CORNERS))
def triangle_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(mesh.corners(X.triangles(spark, sf_dir), X.vertices(spark, sf_dir)).drop("v0", "v1", "v2"))


_SHARE = lambda c: f"avg(case when {c} then 100.0 else 0.0 end)"


@query(with_views(f"select {R('avg(l)')} as mean, {R('stddev_pop(l)')} as std, {R('stddev_pop(l)/avg(l)')} as cov, {R('min(l)')} as min, {R('max(l)')} as max, {', '.join(f'{R(f"quantile_cont(l, {p / 100})")} as p{p}' for p in (5, 25, 50, 75, 95))}, {R(_SHARE('l >= 0.8*0.2 and l <= 1.33*0.2'))} as in_zone, {R(_SHARE('l < 0.5*0.2'))} as short, {R(_SHARE('l > 2*0.2'))} as long from (select unnest([ab,bc,ca]) as l from s)", k=_CORNERS, s=_SIDES))
def edge_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(mesh.edge_statistics(X.triangles(spark, sf_dir), X.vertices(spark, sf_dir), 0.2))


@query(with_views(f"select face_id, {R('area')} as area, {R('2*(greatest(area,1e-12)/((ab+bc+ca)/2))/(ab*bc*ca/(4*greatest(area,1e-12)))')} as quality from s", k=_CORNERS, s=_SIDES))
def triangle_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(mesh.quality(X.triangles(spark, sf_dir), X.vertices(spark, sf_dir)))


@query(with_views(f"select {R('avg(q)')} as mean_quality, {R('quantile_cont(q, 0.1)')} as p10_quality from (select 2*(greatest(area,1e-12)/((ab+bc+ca)/2))/(ab*bc*ca/(4*greatest(area,1e-12))) as q from s)", k=_CORNERS, s=_SIDES))
def quality_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(mesh.quality_statistics(X.triangles(spark, sf_dir), X.vertices(spark, sf_dir)))


_NORMALS = "select vertex_id, sum(nx) sx, sum(ny) sy, sum(nz) sz from (select unnest([v0,v1,v2]) as vertex_id, nx, ny, nz from (select t.v0, t.v1, t.v2, (by_-ay)*(cz-az)-(bz-az)*(cy-ay) nx, (bz-az)*(cx-ax)-(bx-ax)*(cz-az) ny, (bx-ax)*(cy-ay)-(by_-ay)*(cx-ax) nz from k join v_triangles t using (face_id))) group by vertex_id"


@query(with_views(f"select vertex_id, {R('sx/sqrt(sx*sx+sy*sy+sz*sz)')} as nx, {R('sy/sqrt(sx*sx+sy*sy+sz*sz)')} as ny, {R('sz/sqrt(sx*sx+sy*sy+sz*sz)')} as nz from n", k=_CORNERS, n=_NORMALS))
def vertex_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(mesh.vertex_normals(X.triangles(spark, sf_dir), X.vertices(spark, sf_dir)))


@query(with_views("select count(*) as n_vertices, (select count(*) from v_triangles) as n_faces from v_vertices"))
def mesh_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.vertices(spark, sf_dir).agg(F.count("*").alias("n_vertices")).join(X.triangles(spark, sf_dir).agg(F.count("*").alias("n_faces")))


_CLOSE = "select a.vertex_id as a, b.vertex_id as b from v_vertices a join v_vertices b on (a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2 <= cast(0.05 as double)**2"
_REACHED = "select vertex_id as a, vertex_id as b from v_vertices union select r.a, p.b from reached r join close_pairs p on r.b = p.a"
_MERGED = "select a as vertex_id, min(b) as keep from reached group by a"
_FACES = "select distinct list_sort([a.keep,b.keep,c.keep]) as k from v_triangles t join m a on v0=a.vertex_id join m b on v1=b.vertex_id join m c on v2=c.vertex_id where a.keep<>b.keep and b.keep<>c.keep and a.keep<>c.keep"


@query(with_views("select count(*) as n_faces, (select count(distinct v) from (select unnest(k) as v from f)) as n_vertices from f", close_pairs=_CLOSE, reached=_REACHED, m=_MERGED, f=_FACES))
def merge_close_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, t = reshaped.merged_within(X.vertices(spark, sf_dir), X.triangles(spark, sf_dir), 0.05)
    return t.agg(F.count("*").alias("n_faces")).join(v.agg(F.count("*").alias("n_vertices")))


_SOME = "select * from v_triangles where face_id % 3 <> 1"
_SIDED = "select v, w, face_id as f from some_faces, lateral (select unnest([v0,v0,v1,v1,v2,v2]) as v, unnest([v1,v2,v0,v2,v0,v1]) as w)"
_FANS = "select v, f as a, f as b from sided union select r.v, r.a, t.f from fans r join sided s on s.v = r.v and s.f = r.b join sided t on t.v = s.v and t.w = s.w"


@query(with_views("select (select count(*) from v_vertices) + (select count(*) from (select distinct v, fan from g)) - (select count(distinct v) from g) as n_vertices, (select count(*) from (select v from g group by v having count(distinct fan) > 1)) as n_split, (select count(*) from some_faces) as n_faces", some_faces=_SOME, sided=_SIDED, fans=_FANS, g="select v, a, min(b) as fan from fans group by v, a"))
def split_vertex_fans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mesh with a third of its faces missing, so that many vertices hold fans that touch nowhere else."""
    before, t = X.vertices(spark, sf_dir).select("vertex_id", "x", "y", "z"), X.triangles(spark, sf_dir).filter("face_id % 3 <> 1")
    v, t = reshaped.split_fans(before, t)
    places = v.groupBy("x", "y", "z").agg(F.count("*").alias("copies")).agg(F.sum("copies").alias("n_vertices"), F.count_if(F.col("copies") > 1).alias("n_split"))
    return places.join(t.agg(F.count("*").alias("n_faces")))


_PLANES = "select face_id, v0, v1, v2, ax, ay, az, bx, by_, bz, cx, cy, cz, wx/l as nx, wy/l as ny, wz/l as nz, l/2 as area from (select *, sqrt(wx*wx+wy*wy+wz*wz) as l from (select k.*, t.v0, t.v1, t.v2, (by_-ay)*(cz-az)-(bz-az)*(cy-ay) wx, (bz-az)*(cx-ax)-(bx-ax)*(cz-az) wy, (bx-ax)*(cy-ay)-(by_-ay)*(cx-ax) wz from k join v_triangles t using (face_id)))"
_RIMS = "select least(v,w) as lo, greatest(v,w) as hi, any_value(nx) nx, any_value(ny) ny, any_value(nz) nz, any_value(px) px, any_value(py) py, any_value(pz) pz, any_value(lx) lx, any_value(ly) ly, any_value(lz) lz from (select nx, ny, nz, unnest([v0,v1,v2]) v, unnest([v1,v2,v0]) w, unnest([ax,bx,cx]) px, unnest([ay,by_,cy]) py, unnest([az,bz,cz]) pz, unnest([bx-ax,cx-bx,ax-cx]) lx, unnest([by_-ay,cy-by_,ay-cy]) ly, unnest([bz-az,cz-bz,az-cz]) lz from pl) group by 1, 2 having count(*) = 1"
_UPRIGHT = "select lo, hi, ux/l nx, uy/l ny, uz/l nz, px, py, pz, 10*(lx*lx+ly*ly+lz*lz) as weight from (select *, sqrt(ux*ux+uy*uy+uz*uz) as l from (select *, ly*nz-lz*ny ux, lz*nx-lx*nz uy, lx*ny-ly*nx uz from rims))"
_HELD = "select unnest([v0,v1,v2]) v, nx, ny, nz, -(nx*ax+ny*ay+nz*az) d, area as weight from pl union all select unnest([lo,hi]), nx, ny, nz, -(nx*px+ny*py+nz*pz), weight from upright"
_QUADRICS = "select v, " + ", ".join(f"sum(weight*{a}*{b}) as q{i}" for i, (a, b) in enumerate((p, q) for j, p in enumerate(("nx", "ny", "nz", "d")) for q in ("nx", "ny", "nz", "d")[j:])) + " from held group by v"
_PAIRED = "select distinct least(v,w) as lo, greatest(v,w) as hi from (select unnest([v0,v1,v2]) v, unnest([v1,v2,v0]) w from v_triangles)"
_JOINT = "select e.lo, e.hi, u.x ux, u.y uy, u.z uz, v.x vx, v.y vy, v.z vz, " + ", ".join(f"a.q{i}+b.q{i} as q{i}" for i in range(10)) + " from paired e join qs a on a.v=e.lo join qs b on b.v=e.hi join v_vertices u on u.vertex_id=e.lo join v_vertices v on v.vertex_id=e.hi"
_ERR_AT = lambda x, y, z: f"(q0*{x}*{x}+q4*{y}*{y}+q7*{z}*{z}+q9+2*(q1*{x}*{y}+q2*{x}*{z}+q5*{y}*{z}+q3*{x}+q6*{y}+q8*{z}))"
_SOLVED = "select *, -((q4*q7-q5*q5)*q3+(q2*q5-q1*q7)*q6+(q1*q5-q2*q4)*q8)/det sx, -((q2*q5-q1*q7)*q3+(q0*q7-q2*q2)*q6+(q1*q2-q0*q5)*q8)/det sy, -((q1*q5-q2*q4)*q3+(q1*q2-q0*q5)*q6+(q0*q4-q1*q1)*q8)/det sz from (select *, q0*(q4*q7-q5*q5)+q1*(q2*q5-q1*q7)+q2*(q1*q5-q2*q4) as det, ((q0+q4+q7)/3)**3 as scale from joint)"


@query(with_views(f"select lo, hi, {R(f'greatest(case when abs(det) > 1e-9*scale then {_ERR_AT("sx", "sy", "sz")} else least({_ERR_AT("((ux+vx)/2)", "((uy+vy)/2)", "((uz+vz)/2)")}, {_ERR_AT("ux", "uy", "uz")}, {_ERR_AT("vx", "vy", "vz")}) end, 0)')} as cost from solved", k=_CORNERS, pl=_PLANES, rims=_RIMS, upright=_UPRIGHT, held=_HELD, qs=_QUADRICS, paired=_PAIRED, joint=_JOINT, solved=_SOLVED))
def quadric_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each edge's collapse costs at first."""
    t = X.triangles(spark, sf_dir)
    found = reshaped.collapse_costs(reshaped.quadrics(X.vertices(spark, sf_dir), t), reshaped.edge_faces(t).select("lo", "hi"))
    return rounded(found.select("lo", "hi", "cost"))


@query(with_views(f"select {', '.join(f'{R(f"sum(q{i})")} as q{i}' for i in range(10))} from qs", k=_CORNERS, pl=_PLANES, rims=_RIMS, upright=_UPRIGHT, held=_HELD, qs=_QUADRICS))
def quadric_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reshaped.quadrics(X.vertices(spark, sf_dir), X.triangles(spark, sf_dir)).agg(*[F.sum(q).alias(q) for q in reshaped.QUADRIC]))


@query()
def decimated_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces and vertices left of a mesh of which edges collapse until three quarters of the faces are left."""
    t = X.triangles(spark, sf_dir)
    wanted = t.count() * 3 // 4
    v, t = reshaped.decimated(X.vertices(spark, sf_dir), t, wanted)
    return t.agg(F.count("*").alias("n_faces"), F.lit(wanted).cast("bigint").alias("wanted")).join(v.agg(F.count("*").alias("n_vertices")))


_LONG = "select face_id, v, w from (select t.face_id, unnest([v0,v1,v2]) v, unnest([v1,v2,v0]) w, unnest([ab,bc,ca]) l from s join v_triangles t using (face_id)) where l > cast(0.2 as double)"


@query(with_views(f"select (select count(*) from v_triangles) + (select count(*) from long_sides) as n_faces, (select count(*) from v_vertices) + (select count(distinct (least(v,w), greatest(v,w))) from long_sides) as n_vertices, (select {R('sum(area)')} from s) as area", k=_CORNERS, s=_SIDES, long_sides=_LONG))
def midpoint_subdivision(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, t = mesh.subdivided(X.vertices(spark, sf_dir).select("vertex_id", "x", "y", "z"), X.triangles(spark, sf_dir), 0.2)
    return rounded(t.agg(F.count("*").alias("n_faces")).join(v.agg(F.count("*").alias("n_vertices"))).join(mesh.quality(t, v).agg(F.sum("area").alias("area"))))


@query()
def remesh_isotropic(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.plans.algorithms import remesh

    return remesh(X.vertices(spark, sf_dir).select("vertex_id", "x", "y", "z"), X.triangles(spark, sf_dir), "bim_isotropic_only", {"target_edge_length": 0.15, "isotropic_iterations": 2}).row()


@query()
def normal_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, t = X.vertices(spark, sf_dir), X.triangles(spark, sf_dir)
    asked = mesh.centroids(t, v).withColumn("x", F.col("x") + 0.001)
    return rounded(mesh.normal_deviation(mesh.closest_faces(asked, t, v)), 4)


_COV = ", ".join(f"{R(f's{a}{b}', 4)} as s{a}{b}" for a in "xyz" for b in "xyz")
_SUMS = ", ".join(f"sum((s{a}-ms{a})*({'"by"' if b == 'y' else 'b' + b}-mb{b})) as s{a}{b}" for a in "xyz" for b in "xyz")
_MEANS = "select fit_id, avg(sx) msx, avg(sy) msy, avg(sz) msz, avg(bx) mbx, avg(\"by\") mby, avg(bz) mbz, count(*) n from v_pairs group by fit_id"


@query(with_views(f"select fit_id, n, {_COV}, {R('spread', 4)} as spread from (select fit_id, n, {_SUMS}, sum((sx-msx)**2+(sy-msy)**2+(sz-msz)**2) as spread from v_pairs join means using (fit_id) group by fit_id, n)", means=_MEANS))
def rigid_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = registration.covariance(X.pairs(spark, sf_dir), "fit_id")
    return rounded(found.select("fit_id", "n", *[f"s{a}{b}" for a in "xyz" for b in "xyz"], "spread"), 4)


_ERR = "select *, sqrt((10-sy-bx)**2+(sx-2-\"by\")**2+(sz+3-bz)**2) as err from v_pairs"


@query(with_views(f"select fit_id, {R('sqrt(avg(err*err))')} as rmse, {R('max(err)')} as max_error, count(*) as n from e group by fit_id", e=_ERR))
def pair_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = registration.residuals(registration.valid_pairs(X.pairs(spark, sf_dir)), MATRIX).groupBy("fit_id")
    return rounded(found.agg(F.sqrt(F.avg(F.col("err") * F.col("err"))).alias("rmse"), F.max("err").alias("max_error"), F.count("*").alias("n")))


@query(with_views("select fit_id, pair_id from (select *, row_number() over (partition by fit_id order by err, pair_id) as k, count(*) over (partition by fit_id) as n from e) where n < 6 or k <= greatest(3, ceil(n*0.8))", e=_ERR))
def trimmed_inliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registration.trimmed(registration.residuals(X.pairs(spark, sf_dir), MATRIX), "fit_id").select("fit_id", "pair_id")


@query()
def rigid_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = registration.rigid_fit(X.pairs(spark, sf_dir).filter("fit_id = 0"))
    return rounded(spark.createDataFrame([(*[float(v) for v in fit.matrix], fit.rmse, fit.max_error, fit.pair_count, fit.inlier_count)], ", ".join([*(f"m{i} double" for i in range(16)), "rmse double", "max_error double", "pair_count bigint", "inlier_count bigint"])), 4)


@query()
def icp_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = X.vertices(spark, sf_dir).withColumnRenamed("vertex_id", "point_id").drop("r")
    moved = target.select(F.col("point_id").alias("vertex_id"), (F.col("x") + 0.01).alias("x"), "y", "z")
    got = registration.refine(moved, target, [1.0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1.0])
    return rounded(spark.createDataFrame([(got["init_rmse"], got["rmse"], got["fitness"], got["applied"])], "init_rmse double, rmse double, fitness double, applied boolean"), 4)


_STOPS = [tuple(int(s[i : i + 2], 16) / 255 for i in (1, 3, 5)) for s in color.STOPS]
_PLACE = "case when abs(d) > 0.15 then null when d < -0.02 then 0.25*(d+0.15)/0.13 when d < 0 then 0.25+0.25*(d+0.02)/0.02 when d < 0.02 then 0.5+0.25*d/0.02 else 0.75+0.25*(d-0.02)/0.13 end"


def _channel(i: int) -> str:
    arms = " ".join(f"when part = {k} then {D(_STOPS[k][i])} + rest * {D(_STOPS[k + 1][i] - _STOPS[k][i])}" for k in range(4))
    return f"case when part is null then 0.23 {arms} end"


@query(with_views(f"select vertex_id, {', '.join(f'{R(_channel(i), 4)} as {c}' for i, c in enumerate('rgb'))} from (select vertex_id, case when l is not null then least(floor(l*4), 3) end as part, l*4-part as rest from (select vertex_id, case when abs(d) <= 0.15 then cast(least(floor(({_PLACE.replace('0.25', D(0.25)).replace('0.15', D(0.15)).replace('0.13', D(0.13)).replace('0.02', D(0.02))})*256), 255) as double)/255 end as l from (select vertex_id, x as d from v_vertices)))"))
def color_ramp(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = color.distance_color(F.col("x"), 0.15, 0.02)
    return rounded(X.vertices(spark, sf_dir).select("vertex_id", *[v.alias(n) for v, n in zip(c, "rgb", strict=True)]), 4)


_Q = "select vertex_id, x/n as qx, y/n as qy, z/n as qz, nx/n as qw from (select *, sqrt(x*x+y*y+z*z+nx*nx) as n from v_vertices)"


@query(with_views(f"select vertex_id, {', '.join(f'{R(f'abs(q{c})')} as q{c}' for c in 'xyzw')} from q", q=_Q))
def quaternion_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = F.lit(0.0)
    m = X.vertices(spark, sf_dir).select("vertex_id", G.pose_matrix(tuple(F.col(c) for c in ("x", "y", "z", "nx")), (zero, zero, zero)).alias("m"))
    return rounded(m.select("vertex_id", *[F.abs(v).alias(f"q{c}") for v, c in zip(G.quaternion(F.col("m")), "xyzw", strict=True)]))


@query(with_views(f"select vertex_id, {R('sqrt(x*x+y*y+z*z)')} as shift, {R('degrees(2*acos(least(abs(nw),1)))', 3)} as angle from (select vertex_id, x, y, z, 2.0/sqrt(x*x+4) as nw from v_vertices)"))
def transform_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero, identity = F.lit(0.0), F.array(*[F.lit(1.0 if i % 5 == 0 else 0.0) for i in range(16)])
    m = G.pose_matrix((F.col("x"), zero, zero, F.lit(2.0)), (F.col("x"), F.col("y"), F.col("z")))
    shift, angle = G.transform_delta(identity, m)
    return X.vertices(spark, sf_dir).select("vertex_id", (F.round(shift, 6) + 0.0).alias("shift"), (F.round(angle, 3) + 0.0).alias("angle"))


@query(with_views(f"select point_id, {R('x')} as x, {R('y')} as y, {R('z')} as z from v_points"))
def matrix_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.array(*[F.lit(v) for v in MATRIX])
    there_and_back = G.multiply(G.rigid_inverse(m), m)
    p = G.transform_point(there_and_back, F.col("x"), F.col("y"), F.col("z"))
    return rounded(X.points(spark, sf_dir).select("point_id", *[v.alias(c) for v, c in zip(p, "xyz", strict=True)]))


_WRAP = "((x*7 + 180) - 360*floor((x*7 + 180)/360)) - 180"


@query(with_views(f"select point_id, {R(f'case when {_WRAP} = -180 then 180 else {_WRAP} end')} as wrapped, {R('least(greatest(y*3-100, -85), 85)', 9)} as lat, {R('floor(x/0.25+0.5)*0.25', 9)} as stepped, ceil((greatest(50, x, y)+5)/5)*5 as slider, {R('greatest(x/1000, 1e-6)', 9)} as clip_step, {R('y*y/0.8*1000', 9)} as chord_mm, {R('(x-100)/100*100', 9)} as deviation from v_cloud where x > 0"))
def viewer_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    return rounded(
        X.cloud(spark, sf_dir).filter("x > 0").select(
            "point_id", G.wrap_degrees(x * 7).alias("wrapped"), G.view_angles(x, y * 3 - 100)[1].alias("lat"), G.round_to_step(x, F.lit(0.25)).alias("stepped"), G.slider_range(x, y).cast("double").alias("slider"),
            G.clip_step(x).alias("clip_step"), G.chord_error_mm(y).alias("chord_mm"), G.deviation_percent(x, 100.0).alias("deviation"),
        ),
        9,
    )


