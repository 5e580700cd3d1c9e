"""Queries over upload sessions, queues and results, and the SQL that says what each returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import geometry as G
from plumbline.functions import text as T
from plumbline.operators import catalog as C
from plumbline.operators import jobs as J
from plumbline.plans import fixtures as X
from plumbline.plans.fixtures import with_views

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


_STATES = "select o_orderkey as upload_id, concat('bim:', o_orderpriority, ':', o_custkey) as fingerprint, o_orderdate as timestamp from orders"
_SENT = "select o_orderkey as id, o_orderkey%50000000 as \"offset\", case when o_orderkey%4=0 then 0 else o_orderkey*100000 end as size from orders where o_orderkey%3<>0"
_TO_SEND = "select concat('bim:', o_orderpriority, ':', o_custkey) as fingerprint, max(o_orderkey)*70000 as size from orders group by 1 union all select concat('bim:new:', n_nationkey), n_nationkey*1000000 from nation"


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("upload_id"), T.fingerprint(F.lit("bim"), F.col("o_orderpriority"), F.col("o_custkey")).alias("fingerprint"), F.col("o_orderdate").alias("timestamp"))


def sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.read(spark, sf_dir, "orders").filter("o_orderkey % 3 <> 0").selectExpr("o_orderkey as id", "o_orderkey % 50000000 as offset", "case when o_orderkey%4=0 then 0 else o_orderkey*100000 end as size")


def to_send(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = X.read(spark, sf_dir, "orders").groupBy(T.fingerprint(F.lit("bim"), F.col("o_orderpriority"), F.col("o_custkey")).alias("fingerprint")).agg((F.max("o_orderkey") * 70000).alias("size"))
    new = X.read(spark, sf_dir, "nation").select(F.concat(F.lit("bim:new:"), F.col("n_nationkey").cast("string")).alias("fingerprint"), (F.col("n_nationkey").cast("bigint") * 1000000).alias("size"))
    return old.unionAll(new)


@query(with_views("select upload_id, fingerprint from s where timestamp > timestamp '1998-07-20 00:00:00' - interval 7 days", s=_STATES))
def pending_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.unexpired(states(spark, sf_dir), F.lit("1998-07-20 00:00:00").cast("timestamp_ntz")).select("upload_id", "fingerprint")


@query(with_views("select upload_id, case when upload_id%10=1 then 'again' else fingerprint end as fingerprint from s", s=_STATES))
def remembered_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = states(spark, sf_dir)
    return J.remembered(rows, rows.filter("upload_id % 10 = 1").withColumn("fingerprint", F.lit("again"))).select("upload_id", "fingerprint")


_RESUMED = "select f.fingerprint, u.id as upload_id, coalesce(u.\"offset\", 0) as \"offset\", case when u.size>0 then u.size else f.size end as size, u.id is null as is_new from f left join (select fingerprint, arg_max(upload_id, (timestamp, upload_id)) as saved from s group by 1) n using (fingerprint) left join u on n.saved=u.id"


@query(with_views("select * from r", s=_STATES, u=_SENT, f=_TO_SEND, r=_RESUMED))
def resumed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.resumed(to_send(spark, sf_dir), states(spark, sf_dir), sent(spark, sf_dir))


@query(with_views('select fingerprint, cast(number as bigint) as number, cast("offset"+number*5242880 as bigint) as at_byte, cast(least(5242880, size-"offset"-number*5242880) as bigint) as n_bytes from (select *, unnest(range(cast(ceil((size-"offset")/cast(5242880 as double)) as bigint))) as number from r where "offset"<size)', s=_STATES, u=_SENT, f=_TO_SEND, r=_RESUMED))
def planned_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = J.resumed(to_send(spark, sf_dir), states(spark, sf_dir), sent(spark, sf_dir)).select("fingerprint", "offset", "size")
    return J.chunk_plan(rows).select("fingerprint", "number", F.col("at").alias("at_byte"), "n_bytes")


_POLLS = "select l_orderkey as upload_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)-1+case when l_orderkey%50=0 then 400 else 0 end as number, case when l_quantity>45 then 'ready' when l_quantity>42 then 'failed' when l_quantity>40 then 'terminated' when l_quantity>39 then 'odd' else 'processing' end as status from lineitem"


@query(with_views("select upload_id, coalesce(e, 'waiting') as outcome, cast(coalesce(k, last+1) as bigint) as n_polls, cast(case when e='ready' then 100 else least(99, 90+coalesce(k, last+1)) end as bigint) as progress from (select upload_id, min(number) filter (e is not null) as k, arg_min(e, number) filter (e is not null) as e, max(number) as last from (select *, case when status in ('ready','failed','terminated') then status when status='odd' then 'unknown' when number>300 then 'timeout' end as e from p) group by 1)", p=_POLLS))
def poll_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")) - 1 + F.when(F.col("l_orderkey") % 50 == 0, 400).otherwise(0)
    status = F.expr("case when l_quantity>45 then 'ready' when l_quantity>42 then 'failed' when l_quantity>40 then 'terminated' when l_quantity>39 then 'odd' else 'processing' end")
    return J.polled(X.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("upload_id"), number.alias("number"), status.alias("status")))


@query("select o_orderkey as id, 'processing' as status from (select *, row_number() over (order by o_orderdate, o_orderkey) as k from orders where o_orderstatus='P') where k<=32")
def next_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "P", "queued").otherwise("ready").alias("status"), F.col("o_orderdate").alias("created_at"))
    return J.next_for_workers(rows, 32).select("id", "status")


_CALLS = "select l_orderkey as id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)-1 as number, l_quantity>25 as fine, case when l_quantity>35 then 200 else 500 end as code from lineitem"


@query(with_views("select id, case when c=200 then 'done' when c is not null then 'refused' when n>=3 then 'unreachable' else 'retry' end as outcome, cast(coalesce(k+1, n) as bigint) as n_calls, cast((coalesce(k+1, n)-1)*3 as bigint) as waited from (select id, min(number) filter (fine) as k, arg_min(code, number) filter (fine) as c, count(*) as n from c where number<3 group by 1)", c=_CALLS))
def call_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")) - 1
    return J.attempts(X.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), number.alias("number"), (F.col("l_quantity") > 25).alias("transport_ok"), F.when(F.col("l_quantity") > 35, 200).otherwise(500).alias("code")))


_WORK = "select id, type as asset_type, source_name as file_name, id*10 as file_size, owner_id, case when id%3=0 then 'uploading' else 'queued' end as status, '' as error_message, case when id%5=0 then null when id%7=0 then id else id*10 end as source_size, case when id%11=0 then 'converter failed' end as error from v_assets"
_WORKED = "select *, status='queued' as mine, coalesce(case when source_size is null then 'source missing' when source_size<>file_size then 'source differs in size' end, error) as e from w"


def _processed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = X.assets(spark, sf_dir)
    uploads = rows.select("id", F.col("type").alias("asset_type"), F.col("source_name").alias("file_name"), (F.col("id") * 10).alias("file_size"), "owner_id", F.when(F.col("id") % 3 == 0, "uploading").otherwise("queued").alias("status"), F.lit("").alias("error_message"))
    built = rows.select("id", F.when(F.col("id") % 5 == 0, None).when(F.col("id") % 7 == 0, F.col("id")).otherwise(F.col("id") * 10).alias("source_size"), F.when(F.col("id") % 11 == 0, "converter failed").alias("error"))
    return J.processed(uploads, built)


@query(with_views("select id, case when not mine then status when e is null then 'ready' else 'failed' end as status, case when mine then e else error_message end as error_message from x", w=_WORK, x=_WORKED))
def processed_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _processed(spark, sf_dir)[0].select("id", "status", "error_message")


@query(with_views("select id as upload_id, asset_type as type, case when e is null then 'ready' else 'failed' end as status, e as error_message, case when e is null and asset_type='bim' then 'queued' else '' end as remesh_status, case when e is null and asset_type='bim' then 'bim_preprocessor' end as remesh_algorithm from x where mine and source_size=file_size", w=_WORK, x=_WORKED))
def processed_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _processed(spark, sf_dir)[1].select("upload_id", "type", "status", "error_message", "remesh_status", "remesh_algorithm")


_TASKS = "select case when o_orderkey%2=0 then 'bim' else 'pointcloud' end as kind, o_orderkey+case when o_orderkey%5=0 then 100000000 else 0 end as id from orders"


@query(with_views("select t.kind, case when a.id is null then n.id else t.id end as id, case when a.id is null then 'ready' else a.status end as status, a.id is not null as matched from t left join v_assets a on t.id=a.id and t.kind=a.type left join (select type, arg_max(id, (created_at, id)) as id from v_assets where status='ready' group by 1) n on n.type=t.kind where a.id is not null or n.id is not null", t=_TASKS))
def synced_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    tasks = X.read(spark, sf_dir, "orders").select(F.when(k % 2 == 0, "bim").otherwise("pointcloud").alias("kind"), (k + F.when(k % 5 == 0, 100000000).otherwise(0)).alias("id"))
    return J.synced(tasks, X.assets(spark, sf_dir))


@query("select o_custkey as series, o_orderkey as \"offset\", coalesce(m >= lag(m) over (partition by o_custkey order by o_orderkey) - cast(0.01 as double), true) as is_rising from (select *, cast(o_totalprice as double) as m from orders)")
def rising_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("series"), F.col("o_orderkey").alias("offset"), F.col("o_totalprice").cast("double").alias("mean"))
    return J.rising(rows).drop("mean")


@query("select l_suppkey as series, bool_and(l_quantity > 1) as all_pass from lineitem group by 1")
def passed_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("series"), (F.col("l_quantity") > 1).alias("ok"))
    return J.all_pass(rows, "ok", "series")


@query("with c as (select n_nationkey as position, n_name as label, cast(len(n_name)*3+n_nationkey%5 as double) as elapsed from nation) select position, label, elapsed, elapsed/greatest((select arg_min(elapsed, position) from c), 1e-6) as ratio, position=(select position from c where position>(select min(position) from c) order by elapsed, position limit 1) as is_fastest from c")
def case_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    rows = X.read(spark, sf_dir, "nation").select(k.alias("position"), F.col("n_name").alias("label"), (F.length("n_name") * 3 + k % 5).cast("double").alias("elapsed"))
    return J.case_ratios(rows)


@query(with_views("select id, source_name from v_assets where type='bim' and status='ready' order by id"))
def ready_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.ready_models(X.assets(spark, sf_dir)).select("id", "source_name")


@query("select c_custkey as id, c_name as username from customer where lower(c_name)=lower('CUSTOMER#000000003')")
def user_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"))
    return C.user_by_name(rows, "CUSTOMER#000000003")


@query(with_views("select id, case when status='ready' and type='bim' and r='glb' then dir||'/model.glb' when status='ready' and type='bim' and r='metadata' then dir||'/metadata.json' when status='ready' and type='pointcloud' and r='tiles/a/b.pnts' then dir||'/'||r end as path, case when status='ready' and type='bim' and r in ('glb','metadata') then 200 when status='ready' and type='pointcloud' and r='tiles/a/b.pnts' then 200 when status='ready' and type='pointcloud' and r='tiles/../x' then 400 else 404 end as code from (select *, (['glb','metadata','tiles/a/b.pnts','tiles/../x','other'])[id//2%5+1] as r from v_full_assets)"))
def resource_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.element_at(F.array(*map(F.lit, ("glb", "metadata", "tiles/a/b.pnts", "tiles/../x", "other"))), (F.floor(F.col("id") / 2) % 5 + 1).cast("int"))
    return C.resource_path(X.full_assets(spark, sf_dir), asked)


_RESULTS = "select o_orderkey as id, o_custkey%50 as scan_id, o_custkey%9 as bim_id, o_custkey%3 as owner_id, o_orderdate as created_at, case when o_orderkey%4=0 then '' else '/r/'||o_orderkey end as colored_ply_path from orders"


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.read(spark, sf_dir, "orders").selectExpr("o_orderkey as id", "o_custkey % 50 as scan_id", "o_custkey % 9 as bim_id", "o_custkey % 3 as owner_id", "o_orderdate as created_at", "case when o_orderkey%4=0 then '' else concat('/r/', o_orderkey) end as colored_ply_path")


@query(with_views("select id, scan_id, bim_id, owner_id, colored_ply_path from (select *, row_number() over (partition by scan_id, bim_id, owner_id order by created_at desc, id desc) as k from r) where k=1", r=_RESULTS))
def latest_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.latest_results(_results(spark, sf_dir)).drop("created_at")


@query(with_views("select scan_id, bim_id, colored_ply_path from r where scan_id=7 and bim_id=7 and owner_id=1 and colored_ply_path<>''", r=_RESULTS))
def colored_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.colored_result(_results(spark, sf_dir), 7, 7, 1)


@query("select vec_id, case when label%3=0 then 400 when x<=0 or y<=0 or z<=0 then 400 else 0 end as code, case when x>0 then x else 0.3 end as distance, case when y>0 then y else 1.05 end as rmse_ratio, case when z>0 then z else 0.95 end as fitness_ratio from (select vec_id, label, cast(embedding[1] as double)+0.2 as x, cast(embedding[2] as double)+0.2 as y, cast(embedding[3] as double)+0.2 as z from embeddings)")
def request_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, z = (F.col("embedding")[i].cast("double") + 0.2 for i in range(3))
    matrix = F.slice("embedding", F.lit(1), F.when(F.col("label") % 3 == 0, 15).otherwise(16))
    code = C.fine_alignment_refusal(matrix, x, y, z)
    return X.read(spark, sf_dir, "embeddings").select("vec_id", code.alias("code"), G.positive_or(x, 0.3).alias("distance"), G.positive_or(y, 1.05).alias("rmse_ratio"), G.positive_or(z, 0.95).alias("fitness_ratio"))
