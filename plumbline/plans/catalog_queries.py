"""Queries over the catalogue, uploads and text functions, and the SQL that says what each returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import catalog as C
from plumbline.operators import uploads as U
from plumbline.plans import fixtures as X
from plumbline.plans.fixtures import with_views
from plumbline.sources import versions as V
from plumbline.sources.digests import read_digests
from plumbline.store import fresh_path

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(with_views("select id, type, source_name, status, created_at, owner_id from v_assets where owner_id=3 and type='bim' and status='ready' order by created_at desc, id limit 50 offset 50"))
def asset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.page(C.filtered(C.owned(X.assets(spark, sf_dir), 3), type="bim", status="ready"), 2, 50)


@query(with_views("select count(*) as total from v_assets where owner_id=3 and type='bim'"))
def asset_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.filtered(C.owned(X.assets(spark, sf_dir), 3), type="bim", status="").agg(F.count("*").alias("total"))


@query(with_views("select id, type, source_name, status, created_at, owner_id from v_assets where owner_id=3 and id=(select min(id) from v_assets where owner_id=3)"))
def asset_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.assets(spark, sf_dir)
    return C.by_id(rows, 3, rows.filter("owner_id = 3").agg(F.min("id")).first()[0])


_STATE = "case when coalesce(remesh_status,'')='' then (case when has_file then 'succeeded' else 'idle' end) when remesh_status='succeeded' and not has_file then 'failed' else remesh_status end"


@query(with_views(f"""select id, type, source_name as "sourceName", source_size as "sourceSize", status, error_message as "errorMessage", created_at as "createdAt", type='bim' as supported, case when type='bim' then s end as remesh, case when type='bim' then s in ('failed','idle') end as retry, case when type='bim' and s='succeeded' then id end as result, case when type='bim' and s='succeeded' and face_after>0 then face_after end as faces, case when type='pointcloud' then lower(trim(pointcloud_color)) end as color from (select *, {_STATE} as s from v_full_assets)"""))
def asset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.summary(X.full_assets(spark, sf_dir))
    m = "meshRemesh"
    return rows.select("id", "type", "sourceName", "sourceSize", "status", "errorMessage", "createdAt", f"{m}.supported", F.col(f"{m}.status").alias("remesh"), F.col(f"{m}.canRetry").alias("retry"), F.col(f"{m}.resultId").alias("result"), F.col(f"{m}.stats.face_after").alias("faces"), F.col("pointcloudColor").alias("color"))


@query(with_views("select id, type, status, case when status='ready' and type='bim' then '/assets/'||id||'/model.glb' end as model_url, case when status='ready' and type='bim' then '/assets/'||id||'/metadata.json' end as metadata_url, case when status='ready' and type='pointcloud' then '/assets/'||id||'/tiles/tileset.json' end as tiles_url from v_assets"))
def asset_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.detail(X.assets(spark, sf_dir))


@query(with_views("select a.id, count(l.id) as n_alignments, count(l.id) > 0 as aligned from v_assets a left join v_alignments l on a.id=l.scan_id and a.owner_id=l.owner_id where a.type='pointcloud' and a.status='ready' group by a.id"))
def scan_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    scans = X.assets(spark, sf_dir).filter("type = 'pointcloud' and status = 'ready'")
    return C.with_alignment(scans, X.alignments(spark, sf_dir)).select("id", "n_alignments", "aligned")


@query(with_views("select a.id, l.id as alignment_id, l.bim_id as alignment_bim_id from v_assets a left join (select *, row_number() over (partition by scan_id, owner_id order by id) as k from v_alignments) l on a.id=l.scan_id and a.owner_id=l.owner_id and k=1 where a.type='pointcloud'"))
def scan_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    scans = X.assets(spark, sf_dir).filter("type = 'pointcloud'")
    return C.first_alignment(scans, X.alignments(spark, sf_dir)).select("id", "alignment_id", "alignment_bim_id")


@query(with_views("select l.id, l.bim_id, a.source_name as bim_name from v_alignments l left join v_assets a on l.bim_id=a.id and l.owner_id=a.owner_id and a.type='bim' and a.status='ready'"))
def alignment_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.with_model_name(X.alignments(spark, sf_dir), X.assets(spark, sf_dir)).select("id", "bim_id", "bim_name")


_PAIRS = "select l.scan_id, l.owner_id, s.source_name as scan_name, s.created_at as scan_created, b.id as bim_id, b.source_name as bim_name, row_number() over (partition by l.scan_id, l.owner_id order by case when l.bim_id=f.first_bim then 0 else 1 end, b.created_at desc, b.id) as k from l join f on l.scan_id=f.scan_id and l.owner_id=f.owner_id join v_assets s on l.scan_id=s.id and l.owner_id=s.owner_id and s.status='ready' and s.type='pointcloud' join v_assets b on l.bim_id=b.id and l.owner_id=b.owner_id and b.status='ready' and b.type='bim'"
_MORE = "select * from v_alignments union all select id+1, scan_id, scan_id+7, owner_id, rmse from v_alignments union all select id+2, scan_id, scan_id+15, owner_id, rmse from v_alignments"


@query(with_views("select concat(scan_id, ':', bim_id) as key, scan_id, bim_id, owner_id, scan_name, bim_name, scan_created from p where k=1", l=_MORE, f="select scan_id, owner_id, min_by(bim_id, id) as first_bim from l group by 1, 2", p=_PAIRS))
def calibrated_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.alignments(spark, sf_dir)
    more = [rows.withColumns({"id": F.col("id") + i, "bim_id": F.col("scan_id") + step}) for i, step in ((1, 7), (2, 15))]
    return C.calibrated_pairs(X.assets(spark, sf_dir), rows.unionByName(more[0]).unionByName(more[1]))


_UPLOADS = "select o_orderkey as id, case when o_orderkey%5=0 then null else o_orderkey+o_custkey%2*10000000 end as asset_id, case when o_orderkey%3=0 then 'uploading' else 'ready' end as status, o_orderdate as created_at from orders"


def _uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.read(spark, sf_dir, "orders").selectExpr("o_orderkey as id", "case when o_orderkey%5=0 then null else o_orderkey+o_custkey%2*10000000 end as asset_id", "case when o_orderkey%3=0 then 'uploading' else 'ready' end as status", "o_orderdate as created_at")


@query(with_views("select u.id, case when u.status='ready' and a.id is null then 'failed' else u.status end as status, a.id as asset_id from u left join v_assets a on u.asset_id=a.id", u=_UPLOADS))
def upload_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.upload_view(_uploads(spark, sf_dir), X.assets(spark, sf_dir))


_FILES = "select o_orderkey%500 as asset_id, 'f'||cast(o_orderkey%7 as varchar) as path, min(o_orderkey)%11=0 as own from orders group by 1, 2"
_SENT = "select o_orderkey%500 as asset_id, 'f'||cast(o_orderkey%7 as varchar) as path, case when min(o_orderkey)%2=0 then 'ready' else 'failed' end as status, min(o_orderdate) as created_at from orders group by 1, 2"


@query(with_views("select asset_id, path, own, status from (select f.*, s.status, row_number() over (partition by f.asset_id order by case when own then 0 else 1 end, case when s.status='ready' then 0 else 1 end, s.created_at desc nulls last, f.path) as k from f left join s using (asset_id, path)) where k=1", f=_FILES, s=_SENT))
def source_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = [(F.col("o_orderkey") % 500).alias("asset_id"), F.concat(F.lit("f"), (F.col("o_orderkey") % 7).cast("string")).alias("path")]
    grouped = X.read(spark, sf_dir, "orders").groupBy(*keys).agg(F.min("o_orderkey").alias("k"), F.min("o_orderdate").alias("created_at"))
    files = grouped.select("asset_id", "path", (F.col("k") % 11 == 0).alias("own"))
    sent = grouped.select("asset_id", "path", F.when(F.col("k") % 2 == 0, "ready").otherwise("failed").alias("status"), "created_at")
    return C.best_source(sent, files).select("asset_id", "path", "own", "status")


_KEYS = "select cast(p_partkey as varchar) as key from part where p_partkey%2=0 union select cast(p_size as varchar) from part union select p_name from part where p_partkey%3=0 union select 'none'"


@query(with_views("select key, element_id, name, way from (select w.key, e.element_id, e.name, way, row_number() over (partition by w.key order by way, cast(element_id as bigint)) as k from w left join (select element_id as key, 0 as way, * from v_elements union all select cast(step_id as varchar), 1, * from v_elements union all select name, 1, * from v_elements) e on w.key=e.key) where k=1", w=_KEYS))
def metadata_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = X.read(spark, sf_dir, "part")
    wanted = part.filter("p_partkey % 2 = 0").select(F.col("p_partkey").cast("string").alias("key")).union(part.select(F.col("p_size").cast("string"))).union(part.filter("p_partkey % 3 = 0").select("p_name")).union(spark.createDataFrame([("none",)], "key string")).distinct()
    return C.find_element(X.elements(spark, sf_dir), wanted)


@query(with_views("select id, 'failed' as status from v_assets where status='ready' and id%4<>0"))
def asset_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.assets(spark, sf_dir)
    return C.unmatched_ready(rows, rows.filter("id % 4 = 0").select("id")).select("id", "status")


@query(with_views("select id, case when id%10=1 then rmse*2 else rmse end as rmse from v_alignments union all select id+100000000, rmse*2 from v_alignments where id%10=1"))
def alignment_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.alignments(spark, sf_dir)
    changed = rows.filter("id % 10 = 1").withColumn("rmse", F.col("rmse") * 2)
    new = changed.withColumns({"id": F.col("id") + 100000000, "scan_id": F.col("scan_id") + 100000000})
    return C.upserted(rows, changed.unionByName(new), "scan_id", "bim_id", "owner_id").select("id", "rmse")


@query(with_views("select id, bim_id, case when id%10=1 then 0.5 else rmse end as rmse from v_alignments"))
def alignment_partial_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.alignments(spark, sf_dir)
    return C.partly_updated(rows, rows.filter("id % 10 = 1").select("id", F.lit(0.5).alias("rmse")), "id").select("id", "bim_id", "rmse")


@query(with_views("select id, source_name, created_at from v_assets where type='bim' and status='ready' order by created_at desc, id desc limit 1"))
def latest_asset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.latest(X.assets(spark, sf_dir), "bim")


_JOBS = "select o_orderkey as id, case o_orderkey%6 when 0 then null when 1 then '' when 2 then 'queued' when 3 then 'processing' when 4 then 'succeeded' else 'failed' end as status, o_orderdate as created_at, o_orderkey%7=0 as has_file, o_custkey%3 as n from orders"


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.read(spark, sf_dir, "orders").selectExpr("o_orderkey as id", "case o_orderkey%6 when 0 then null when 1 then '' when 2 then 'queued' when 3 then 'processing' when 4 then 'succeeded' else 'failed' end as status", "o_orderdate as created_at", "o_orderkey%7=0 as has_file", "o_custkey%3 as n")


@query(with_views("select id, case when coalesce(status,'')='' and has_file then 'succeeded' when coalesce(status,'')='' then 'idle' when status='succeeded' and not has_file then 'failed' else status end as state, case when coalesce(status,'')='' and has_file then false when coalesce(status,'')='' then true when status='succeeded' and not has_file then true else status='failed' end as retry, case when n>0 then n end as n_faces from j", j=_JOBS))
def remesh_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, retry, counts = C.remesh_summary(F.col("status"), F.col("has_file"), [F.col("n"), F.lit(0).alias("zero")])
    return _jobs(spark, sf_dir).select("id", state.alias("state"), retry.alias("retry"), counts["n"].alias("n_faces"))


@query(with_views("select id, case when status in ('queued','processing') and created_at < timestamp '1996-01-01 00:00:00' - interval 30 minutes then 'failed' else status end as status from j", j=_JOBS))
def remesh_timeouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("1996-01-01 00:00:00").cast("timestamp_ntz")
    return _jobs(spark, sf_dir).select("id", C.expired(F.col("status"), F.col("created_at"), now).alias("status"))


@query(with_views("select id, status is null or status='' or status not in ('queued','processing','succeeded') as may_queue, case when status in ('queued','processing','succeeded') then 409 else 202 end as request_code, case when status in ('queued','processing') then 409 when status='succeeded' and has_file then 200 else 404 end as result_code, case when coalesce(status,'')='' and has_file then 'succeeded' when status='succeeded' and not has_file then 'failed' else status end as reconciled, case when id=8 and status='queued' then 'processing' else status end as claimed from j", j=_JOBS))
def remesh_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, f = F.col("status"), F.col("has_file")
    rows = _jobs(spark, sf_dir).select("id", "status", C.may_queue_remesh(s).alias("may_queue"), C.request_code(s).alias("request_code"), C.result_code(s, f).alias("result_code"), C.reconciled(s, f).alias("reconciled"))
    return C.claimed(rows, 8, "queued", "processing").withColumnRenamed("status", "claimed")


_HELD = "case when id%10=1 then 'queued' when status='processing' and id%5<>0 then 'succeeded' else status end"


@query(with_views(f"select id, {_HELD} as status from j", j=_JOBS))
def published_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs published in versions: upserted, then finished by workers, of whom a fifth hold the token of an earlier start."""
    jobs = _jobs(spark, sf_dir).select("id", "status", F.col("created_at").alias("started_at"))
    table = V.Versions(spark, fresh_path(spark, "jobs"))
    V.create(table, jobs)
    V.upsert(table, jobs.filter("id % 10 = 1").withColumn("status", F.lit("queued")), "id")
    held = F.when(F.col("id") % 5 == 0, F.col("started_at") - F.expr("INTERVAL 1 DAY")).otherwise(F.col("started_at"))
    V.claim(table, F.col("id"), "processing", "succeeded", held)
    return table.read().select("id", "status")


@query(with_views("select id, 'queued' as status, created_at from j where status in ('queued','processing')", j=_JOBS))
def job_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.recovered(_jobs(spark, sf_dir)).select("id", "status", "created_at")


@query(with_views("select upload_id, event_id, n_bytes, cast(sum(n_bytes) over w - n_bytes as bigint) as offset_before, cast(sum(n_bytes) over w as bigint) as offset_after from v_chunks window w as (partition by upload_id order by ts, event_id rows unbounded preceding)"))
def upload_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.running_offsets(X.chunks(spark, sf_dir))


@query(with_views("select upload_id, event_id, cast(least(greatest(floor(90*a/greatest(max(a) over (partition by upload_id),1)+0.5),0),90) as bigint) as progress from (select upload_id, event_id, cast(sum(n_bytes) over (partition by upload_id order by ts, event_id rows unbounded preceding) as double) as a from v_chunks)"))
def upload_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.progress(U.running_offsets(X.chunks(spark, sf_dir)))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A create, then chunks that fit, and now and then one that doesn't; each upload ends at its size."""
    o = U.running_offsets(X.chunks(spark, sf_dir)).join(X.chunks(spark, sf_dir).select("event_id", "ts"), "event_id")
    total = o.groupBy("upload_id").agg(F.max("offset_after").alias("size"), F.min("ts").alias("ts"))
    create = total.select("upload_id", F.lit(-1).cast("bigint").alias("event_id"), "ts", F.lit("create").alias("kind"), F.lit(None).cast("bigint").alias("at"), F.lit(None).cast("bigint").alias("n_bytes"), "size")
    chunk = o.select("upload_id", "event_id", "ts", F.lit("chunk").alias("kind"), F.col("offset_before").alias("at"), "n_bytes", F.lit(None).cast("bigint").alias("size"))
    wrong = o.filter("event_id % 5 = 0").select("upload_id", "event_id", "ts", F.lit("chunk").alias("kind"), (F.col("offset_before") + 1).alias("at"), "n_bytes", F.lit(None).cast("bigint").alias("size"))
    return create.unionByName(chunk).unionByName(wrong.withColumn("event_id", F.col("event_id") * 2 + 1000000))


_O = "select upload_id, event_id, ts, n_bytes, cast(sum(n_bytes) over w - n_bytes as bigint) as pos, cast(sum(n_bytes) over w as bigint) as after from v_chunks window w as (partition by upload_id order by ts, event_id rows unbounded preceding)"
_E = "select upload_id, -1 as event_id, min(ts) as ts, 'create' as kind, null as pos, null as n_bytes, max(after) as size from o group by 1 union all select upload_id, event_id, ts, 'chunk', pos, n_bytes, null from o union all select upload_id, event_id*2+1000000, ts, 'chunk', pos+1, n_bytes, null from o where event_id%5=0"
_N = "select *, row_number() over (partition by upload_id order by ts, event_id) as k from e"
_F = """select upload_id, k, case when coalesce(size,0)>0 then 'uploading' else 'queued' end as status, cast(0 as bigint) as off, cast(coalesce(size,0) as bigint) as size, cast(0 as bigint) as accepted, cast(0 as bigint) as refused from n where k=1
union all select f.upload_id, n.k, case when ok and f.off+n.n_bytes=f.size then 'queued' else f.status end, case when ok then f.off+n.n_bytes else f.off end, f.size, f.accepted+case when ok then 1 else 0 end, f.refused+case when ok then 0 else 1 end from (select f.*, n.k as nk, n.n_bytes as nb, (f.status='uploading' and n.pos=f.off and n.n_bytes between 0 and least(67108864, f.size-f.off)) as ok from f join n on n.upload_id=f.upload_id and n.k=f.k+1) f join n on n.upload_id=f.upload_id and n.k=f.nk"""


@query(with_views('select upload_id, status, off as "offset", size, accepted, refused from (select *, row_number() over (partition by upload_id order by k desc) as last from f) where last=1', o=_O, e=_E, n=_N, f=_F))
def upload_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.fold(_events(spark, sf_dir))


@query(with_views("select id, lower(regexp_extract(source_name, '(\\.[^./]*)$', 1)) as ext, (type='bim' and lower(source_name) like '%.ifc') or (type='pointcloud' and lower(source_name) like '%.las') as valid, concat(type, ':', source_name, ':', cast(id as varchar)) as fingerprint, cast(ceil(id/cast(5242880 as double)) as bigint) as done, greatest(1, cast(ceil(id*1000/cast(5242880 as double)) as bigint)) as chunks, case status when 'ready' then '已解析' when 'processing' then '解析中' else '处理失败，请重新上传' end as label, case status when 'ready' then 'success' when 'processing' then 'warning' else 'danger' end as tag, strftime(to_timestamp(id) at time zone 'UTC', '%Y-%m-%dT%H:%M:%SZ') as created from v_assets"))
def asset_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    done, chunks = T.chunk_counts(F.col("id"), F.col("id") * 1000)
    return X.assets(spark, sf_dir).select("id", T.extension(F.col("source_name")).alias("ext"), T.valid_extension(F.col("type"), F.col("source_name")).alias("valid"), T.fingerprint(F.col("type"), F.col("source_name"), F.col("id")).alias("fingerprint"), done.alias("done"), chunks.alias("chunks"), T.status_text(F.col("status"))[0].alias("label"), T.status_text(F.col("status"))[1].alias("tag"), T.rfc3339(F.col("id")).alias("created"))


@query(with_views("select event_id, left(trim(regexp_replace(coalesce(nullif(trim(json_extract_string(props, '$.msg')), ''), nullif(trim(json_extract_string(props, '$.message')), ''), props), '\\s+', ' ', 'g')), 300) as message, left(trim(regexp_replace(props, '\\s+', ' ', 'g')), 300) as log, regexp_matches(event_type, '^#[0-9a-fA-F]{6}$') as is_color, nullif(event_type, '') as kind, format('{:.3f}', value) as shown from events"))
def event_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.read(spark, sf_dir, "events").select("event_id", T.error_message(F.col("props"), "msg", "message").alias("message"), T.bounded_log(F.col("props")).alias("log"), F.col("event_type").rlike(T.COLOR).alias("is_color"), T.empty_to_null(F.col("event_type")).alias("kind"), T.three_decimals(F.col("value")).alias("shown"))


@query(with_views("select event_id, md5(props) as digest, case when value between 1 and 32 then cast(floor(value) as bigint) else 2 end as workers from events"))
def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.floor("value").cast("string")
    return X.read(spark, sf_dir, "events").select("event_id", F.md5("props").alias("digest"), F.when(F.col("value") >= 1, F.when(F.col("value") <= 32, T.setting(whole, 1, 32, 2)).otherwise(F.lit(2))).otherwise(F.lit(2)).cast("bigint").alias("workers"))


_BUNDLE = "coalesce(doc_id // 500, -1)"


@query(f"select {_BUNDLE} as bundle, sum(octet_length(encode(coalesce(text, '')))+1)::bigint as n_bytes, cast(ceil(sum(octet_length(encode(coalesce(text, '')))+1)/524288.0) as bigint) as pieces, md5(string_agg(coalesce(text, '')||chr(10), '' order by doc_id, coalesce(text, ''))) as digest from documents group by 1")
def file_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts written as files of 500 documents each, then digested piece by piece."""
    text = F.coalesce("text", F.lit(""))
    rows = X.read(spark, sf_dir, "documents").select(F.coalesce(F.floor(F.col("doc_id") / 500), F.lit(-1)).cast("bigint").alias("bundle"), "doc_id", text.alias("value"))
    path = fresh_path(spark, "files")
    rows.repartition("bundle").sortWithinPartitions("bundle", "doc_id", "value").select("bundle", "value").write.partitionBy("bundle").text(path)
    steps = read_digests(spark, path, piece=1)
    got = steps.groupBy("file").agg(F.max("n_bytes").alias("n_bytes"), F.sum((F.col("state") == "progress").cast("bigint")).alias("pieces"), F.max("digest").alias("digest"))
    return got.select(F.regexp_extract("file", "bundle=(-?[0-9]+)/", 1).cast("bigint").alias("bundle"), "n_bytes", "pieces", "digest")
