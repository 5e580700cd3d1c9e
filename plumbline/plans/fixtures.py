"""Points, meshes and catalogue tables derived from the supplied tables, as DataFrames and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _e(i: int) -> Column:
    return F.col("embedding")[i - 1].cast("double")


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vertex_id, r (dense rank from 0), x, y, z, nx, ny, nz. The rank is over a few thousand mesh vertices of one model."""
    norm = F.sqrt(_e(4) * _e(4) + _e(5) * _e(5) + _e(6) * _e(6))
    return read(spark, sf_dir, "embeddings").filter("label % 2 = 0").select(
        F.col("vec_id").alias("vertex_id"), (F.row_number().over(Window.orderBy("vec_id")) - 1).cast("bigint").alias("r"),
        _e(1).alias("x"), _e(2).alias("y"), _e(3).alias("z"), (_e(4) / norm).alias("nx"), (_e(5) / norm).alias("ny"), (_e(6) / norm).alias("nz"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """point_id, x, y, z: 21 points of each odd-labelled row."""
    each = F.array(*[F.struct(F.lit(j).alias("j"), _e(3 * j + 1).alias("x"), _e(3 * j + 2).alias("y"), _e(3 * j + 3).alias("z")) for j in range(21)])
    rows = read(spark, sf_dir, "embeddings").filter("label % 2 = 1").select("vec_id", F.explode(each).alias("p"))
    return rows.select((F.col("vec_id") * 21 + F.col("p.j")).alias("point_id"), "p.x", "p.y", "p.z")


def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """face_id, v0, v1, v2 of a grid 16 vertices wide."""
    v = vertices(spark, sf_dir).select("r", "vertex_id")
    at = lambda name, step: v.select((F.col("r") - step).alias("r"), F.col("vertex_id").alias(name))
    a = at("a", 0).filter("r % 16 < 15").join(at("b", 1), "r").join(at("c", 16), "r")
    low = a.select((2 * F.col("r")).alias("face_id"), F.col("a").alias("v0"), F.col("b").alias("v1"), F.col("c").alias("v2"))
    high = a.join(at("d", 17), "r").select((2 * F.col("r") + 1).alias("face_id"), F.col("b").alias("v0"), F.col("d").alias("v1"), F.col("c").alias("v2"))
    return low.unionAll(high)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fit_id, pair_id, sx, sy, sz, bx, by, bz: targets are a quarter turn about z plus (10, -2, 3) and 1 % noise."""
    return read(spark, sf_dir, "embeddings").select(
        F.col("label").alias("fit_id"), F.col("vec_id").alias("pair_id"), _e(1).alias("sx"), _e(2).alias("sy"), _e(3).alias("sz"),
        (10 - _e(2) + 0.01 * _e(4)).alias("bx"), (_e(1) - 2 + 0.01 * _e(5)).alias("by"), (_e(3) + 3 + 0.01 * _e(6)).alias("bz"),
    )


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("point_id"), (F.col("o_totalprice") / 1000).alias("x"), ((F.col("o_custkey") % 1000).cast("double") / 10).alias("y"), ((F.col("o_orderkey") % 97).cast("double") / 10).alias("z")
    )


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    bim = F.col("o_orderkey") % 2 == 0
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(bim, "bim").otherwise("pointcloud").alias("type"), F.concat("o_orderpriority", F.when(bim, ".ifc").otherwise(".las")).alias("source_name"),
        F.when(F.col("o_orderstatus") == "O", "ready").when(F.col("o_orderstatus") == "P", "processing").otherwise("failed").alias("status"), F.col("o_orderdate").alias("created_at"), (F.col("o_custkey") % 7).alias("owner_id"),
    )


def full_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """assets with all columns of the catalogue."""
    k = F.col("o_orderkey")
    status = F.when(k % 6 == 0, None).when(k % 6 == 2, "").otherwise(F.element_at(F.array(*map(F.lit, ("queued", "processing", "succeeded", "failed"))), (k % 4 + 1).cast("int")))
    more = read(spark, sf_dir, "orders").select(k.alias("id"), (F.col("o_custkey") * 1000).alias("source_size"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).otherwise("").alias("error_message"), F.concat(F.lit(" #AB"), F.lpad((k % 10000).cast("string"), 4, "0"), F.lit(" ")).alias("pointcloud_color"), status.alias("remesh_status"), (k % 7 < 3).alias("has_file"), *[F.lit(0).alias(c) for c in ("vertex_before", "face_before", "vertex_after")], (k % 3).alias("face_after"), F.concat(F.lit("/data/"), k.cast("string")).alias("dir"))
    return assets(spark, sf_dir).join(more, "id")


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").filter("o_orderkey % 2 = 1 and o_orderkey % 3 <> 0")
    return rows.select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("scan_id"), (F.col("o_orderkey") + 1 + 2 * (F.col("o_custkey") % 3)).alias("bim_id"), (F.col("o_custkey") % 7).alias("owner_id"), (F.col("o_totalprice") / 1000000.0).alias("rmse"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("upload_id"), "event_id", "ts", F.floor(F.col("value") * 1000).cast("bigint").alias("n_bytes"), "event_type")


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("element_id"), F.col("p_size").alias("step_id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"))


_E = lambda i: f"cast(embedding[{i}] as double)"
_NORM = f"sqrt({_E(4)}*{_E(4)}+{_E(5)}*{_E(5)}+{_E(6)}*{_E(6)})"

#: The same views in DuckDB SQL.
VIEWS = {
    "v_vertices": f"select vec_id as vertex_id, row_number() over (order by vec_id)-1 as r, {_E(1)} as x, {_E(2)} as y, {_E(3)} as z, {_E(4)}/{_NORM} as nx, {_E(5)}/{_NORM} as ny, {_E(6)}/{_NORM} as nz from embeddings where label%2=0",
    "v_points": "select vec_id*21+j as point_id, cast(embedding[3*j+1] as double) as x, cast(embedding[3*j+2] as double) as y, cast(embedding[3*j+3] as double) as z from embeddings, range(21) t(j) where label%2=1",
    "v_triangles": "select 2*a.r as face_id, a.vertex_id as v0, b.vertex_id as v1, c.vertex_id as v2 from v_vertices a join v_vertices b on b.r=a.r+1 join v_vertices c on c.r=a.r+16 where a.r%16<15 union all select 2*a.r+1, b.vertex_id, d.vertex_id, c.vertex_id from v_vertices a join v_vertices b on b.r=a.r+1 join v_vertices c on c.r=a.r+16 join v_vertices d on d.r=a.r+17 where a.r%16<15",
    "v_pairs": f'select label as fit_id, vec_id as pair_id, {_E(1)} as sx, {_E(2)} as sy, {_E(3)} as sz, 10-{_E(2)}+cast(0.01 as double)*{_E(4)} as bx, {_E(1)}-2+cast(0.01 as double)*{_E(5)} as "by", {_E(3)}+3+cast(0.01 as double)*{_E(6)} as bz from embeddings',
    "v_cloud": "select o_orderkey as point_id, o_totalprice/1000 as x, cast(o_custkey%1000 as double)/10 as y, cast(o_orderkey%97 as double)/10 as z from orders",
    "v_assets": "select o_orderkey as id, case when o_orderkey%2=0 then 'bim' else 'pointcloud' end as type, concat(o_orderpriority, case when o_orderkey%2=0 then '.ifc' else '.las' end) as source_name, case o_orderstatus when 'O' then 'ready' when 'P' then 'processing' else 'failed' end as status, o_orderdate as created_at, o_custkey%7 as owner_id from orders",
    "v_full_assets": "select a.*, o_custkey*1000 as source_size, case when o_orderstatus='F' then o_orderpriority else '' end as error_message, ' #AB'||lpad(cast(id%10000 as varchar), 4, '0')||' ' as pointcloud_color, case when id%6=0 then null when id%6=2 then '' else (['queued','processing','succeeded','failed'])[id%4+1] end as remesh_status, id%7<3 as has_file, id%3 as face_after, '/data/'||id as dir from v_assets a join orders on a.id=o_orderkey",
    "v_alignments": "select o_orderkey as id, o_orderkey as scan_id, o_orderkey+1+2*(o_custkey%3) as bim_id, o_custkey%7 as owner_id, o_totalprice/cast(1000000 as double) as rmse from orders where o_orderkey%2=1 and o_orderkey%3<>0",
    "v_chunks": "select user_id as upload_id, event_id, ts, cast(floor(value*1000) as bigint) as n_bytes, event_type from events",
    "v_elements": "select cast(p_partkey as varchar) as element_id, p_size as step_id, p_name as name, p_type as type from part",
}
_NEEDS = {"v_triangles": ("v_vertices",), "v_full_assets": ("v_assets",)}


def with_views(body: str, **more: str) -> str:
    """body with the views it names, and further common tables, in front."""
    text = body + " ".join(more.values())
    named = [v for v in VIEWS if v in text or any(v in _NEEDS.get(x, ()) and x in text for x in VIEWS)]
    tables = [f"{v} as ({VIEWS[v]})" for v in named] + [f"{k} as ({v})" for k, v in more.items()]
    return f"with recursive {', '.join(tables)} {body}" if tables else body
