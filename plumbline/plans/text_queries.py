"""Queries over names, messages, settings and other text, and the SQL that says what each returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.plans import fixtures as X

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _case(value: str, texts: dict, otherwise: str) -> str:
    return f"case {value} " + " ".join(f"when '{k}' then '{v}'" for k, v in texts.items()) + f" else '{otherwise}' end"


def _of(key: Column, *values) -> Column:
    """One of values by the key's remainder."""
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def _sql_of(key: str, *values) -> str:
    return f"([{', '.join('null' if v is None else repr(v) for v in values)}])[{key}%{len(values)}+1]"


_STATUS = ("uploading", "queued", "processing", "ready", "failed", "terminated", "succeeded", "odd", None)


@query(
    f"select k, {_case('s', {'uploading': '文件上传中', 'queued': '解析中', 'processing': '解析中', 'ready': '已解析', 'failed': '处理失败，请重新上传', 'terminated': '上传已终止'}, '状态待更新')} as label, "
    f"{_case('s', {'ready': 'success', 'uploading': 'warning', 'queued': 'warning', 'processing': 'warning', 'failed': 'danger', 'terminated': 'danger'}, 'info')} as tag, "
    f"{_case('s', {'queued': '均匀化排队中', 'processing': '均匀化处理中', 'succeeded': '网格已均匀化', 'failed': '均匀化失败'}, '等待均匀化')} as remesh from (select o_orderkey as k, {_sql_of('o_orderkey', *_STATUS)} as s from orders)"
)
def status_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _of(F.col("o_orderkey"), *_STATUS)
    label, tag = T.status_text(s)
    return X.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), label.alias("label"), tag.alias("tag"), T.remesh_text(s).alias("remesh"))


_CODES = (400, 401, 404, 409, 413, 415, 500, 503, 418)


@query(
    f"select k, case c when 400 then coalesce(m, '请求参数错误，请检查文件类型和大小') when 401 then '登录状态已失效，请重新登录' when 404 then '上传会话不存在，请重新上传' when 409 then coalesce(m, '上传偏移不一致，已自动中断，请重新上传') when 413 then '文件过大，超出服务端限制' when 415 then coalesce(m, '当前文件类型不受支持') "
    f"else case when c>=500 then '服务器暂时不可用，请稍后重试' else coalesce(own, '上传失败，请稍后重试') end end as text from (select o_orderkey as k, ([{', '.join(map(str, _CODES))}])[o_orderkey%9+1] as c, case when o_custkey%2=0 then o_orderpriority end as m, case when o_custkey%3=0 then o_orderstatus end as own from orders)"
)
def upload_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = _of(F.col("o_orderkey"), *_CODES)
    message, own = F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderpriority")).otherwise(""), F.when(F.col("o_custkey") % 3 == 0, F.col("o_orderstatus"))
    return X.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), T.upload_error(code, message, own).alias("text"))


_SIZE = "case when n=0 then '0 B' when n<1024 then printf('%d B', n) else (select case when v>=100 then printf('%.0f', floor(v+0.5)) else printf('%.1f', floor(v*10+0.5)/10) end || ' ' || u from (select n/pow(1024.0, p) as v, (['B','KB','MB','GB','TB'])[p+1] as u from (select case when n<1048576 then 1 when n<1073741824 then 2 when n<1099511627776 then 3 else 4 end as p))) end"


@query(f"select k, {_SIZE} as size from (select o_orderkey as k, cast(case o_orderkey%5 when 0 then o_custkey%1500 when 1 then o_orderkey*1000 when 2 then o_orderkey*1000003 when 3 then o_orderkey*1000000007 else 0 end as bigint) as n from orders)")
def file_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.read(spark, sf_dir, "orders").selectExpr("o_orderkey as k", "cast(case o_orderkey%5 when 0 then o_custkey%1500 when 1 then o_orderkey*1000 when 2 then o_orderkey*1000003 when 3 then o_orderkey*1000000007 else 0 end as bigint) as n")
    return rows.select("k", T.file_size(F.col("n")).alias("size"))


_DAY = "make_timestamp(k*100000*1000000)"


@query(f"select k, strftime({_DAY}, '%Y-%m-%dT%H:%M:%SZ') as utc, case when k%10=0 then '时间未记录' else strftime({_DAY}, '%Y-%m-%d %H:%M') end as minute from (select o_orderkey as k from orders)")
def epoch_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return X.read(spark, sf_dir, "orders").select(k.alias("k"), T.rfc3339(k * 100000).alias("utc"), T.minute_text(F.when(k % 20 == 0, 0).when(k % 10 == 0, None).otherwise(k * 100000)).alias("minute"))


_DURATIONS = {"7d": 604800.0, "1.5D": 129600.0, " 2 d": 172800.0, "1h30m": 5400.0, "250ms": 0.25, "-1.5s": -1.5, "1h2m3.5s": 3723.5, "10us": 1e-5, "5ns": 5e-9, "0": 0.0, "1d2h": None, "12": None, "": None, "xd": None, ".5h": 1800.0, "3m": 180.0}


@query(f"select k, ({[v if v is not None else 'N' for v in _DURATIONS.values()]})[k%{len(_DURATIONS)}+1] as seconds from (select o_orderkey as k from orders)".replace("'N'", "null"))
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return X.read(spark, sf_dir, "orders").select(k.alias("k"), T.duration_seconds(_of(k, *_DURATIONS)).alias("seconds"))


_META = "o_orderpriority || ' ' || case when o_orderkey%3=0 then '!' else to_base64(encode(o_orderpriority)) end"


@query("select k, case when k%3=0 then null else p end as first, 'k dg==' as sent, case when k%2=0 then '/mnt/b/x/'||k else '/app/database/'||k end as rebased, '/app/data/'||k as back, 'a|'||p||'|b' as listed from (select o_orderkey as k, o_orderpriority as p from orders)")
def upload_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, p = F.col("o_orderkey"), F.col("o_orderpriority")
    meta = F.concat(F.lit("name "), F.when(k % 3 == 0, "!").otherwise(F.base64(F.encode(p, "UTF-8"))), F.lit(",lone"))
    path = F.concat(F.when(k % 2 == 0, "/app/data/x/").otherwise("/app/database/"), k.cast("string"))
    return X.read(spark, sf_dir, "orders").select(
        k.alias("k"), T.upload_metadata(meta)["name"].alias("first"), T.encoded_metadata(F.create_map(F.lit("k"), F.lit("v"))).alias("sent"), T.rebase(path, "/app/data/", "/mnt/b").alias("rebased"),
        T.rebase(F.concat(F.lit("/mnt/b/"), k.cast("string")), "/mnt/b", "/app/data").alias("back"), F.array_join(T.listed(F.concat(F.lit(" a,, "), p, F.lit(" ,b,"))), "|").alias("listed"),
    )


_NAMES = ("0123456789abcdefghij_$", "wall_12", "_x", "  ", "plain", None)


@query(f"select k, case when k%6=0 then n when k%6=1 then 'wall' when k%6=2 then '_x' when k%6=4 then 'plain' when k%2=0 then 'm' else coalesce(case when k%4=1 then 'm' end, 'p') end as id from (select o_orderkey as k, {_sql_of('o_orderkey', *_NAMES)} as n from orders)")
def element_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return X.read(spark, sf_dir, "orders").select(k.alias("k"), T.element_id(_of(k, *_NAMES), F.when((k % 2 == 0) | (k % 4 == 1), "m"), F.lit("p")).alias("id"))


@query("select k, case when k%4=0 then 'e'||k when k%4=1 then 'g'||k when k%4=2 then 'n'||k end as id, case when k%4=0 then 'e'||k when k%4=1 then 'g'||k end as flat from (select p_partkey as k from part)")
def ifc_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """expressID before all, then the other keys in order; blanks don't count; then the nested properties."""
    k, text = F.col("p_partkey"), F.col("p_partkey").cast("string")
    of = lambda kind, when, v: F.when(when, F.concat(F.lit(f" {kind}"), v, F.lit(" "))).otherwise(" ")
    values = F.create_map(F.lit("guid"), of("g", k % 4 < 2, text), F.lit("expressID"), of("e", k % 4 == 0, text), F.lit("elementId"), F.lit("no"))
    nested = F.when(k % 4 == 2, F.create_map(F.lit("IfcGUID"), of("n", k % 4 == 2, text)))
    return X.read(spark, sf_dir, "part").select(k.alias("k"), T.ifc_id(values, F.lit(None).cast("map<string,string>"), nested).alias("id"), T.ifc_id(values).alias("flat"))


@query("select event_id, coalesce(nullif(json_extract_string(props, '$.msg'), ''), nullif(json_extract_string(props, '$.message'), '')) as client, try_cast(event_type as integer) is null and true as no_number, coalesce(try_cast(cast(event_id%3000 as varchar)||case when event_id%4=0 then 'x' else '' end as integer), 0) as header from events")
def client_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    header = F.concat((e % 3000).cast("string"), F.when(e % 4 == 0, "x").otherwise(""))
    return X.read(spark, sf_dir, "events").select("event_id", T.client_error(F.col("props")).alias("client"), (T.header_int(F.col("event_type")) == 0).alias("no_number"), T.header_int(header).alias("header"))


_JSON = ('{"a":"1","b":"x"}', "null", None, "{broken", "{}")


@query(f"select k, case when k%5=0 then '1' end as a, k%5<>3 as valid, case when k%2=0 then 16 end as n_cells, case when k%2=0 then cast(k as double) end as first_cell, k+1 as count1, cast(k as double)/2 as edge0, '{{\"code\":'||k||',\"msg\":\"ok\",\"data\":{{\"a\":1}}}}' as envelope from (select o_orderkey as k from orders)")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    parsed, valid = T.parameters(_of(k, *_JSON))
    matrix = T.matrix_from_json(F.when(k % 2 == 0, F.concat(F.lit("["), k.cast("string"), F.lit(".0" + ",0.0" * 15 + "]"))))
    histogram = T.histogram_from_json(F.concat(F.lit('{"binEdges":['), (k / 2).cast("string"), F.lit('],"counts":[0,'), (k + 1).cast("string"), F.lit("]}")))
    return X.read(spark, sf_dir, "orders").select(
        k.alias("k"), parsed["a"].alias("a"), valid.alias("valid"), F.when(matrix.isNotNull(), F.size(matrix)).alias("n_cells"), matrix[0].alias("first_cell"), histogram["counts"][1].alias("count1"), histogram["binEdges"][0].alias("edge0"),
        T.envelope(k, F.lit("ok"), F.struct(F.lit(1).alias("a"))).alias("envelope"),
    )


@query("select k, case when k%4=0 then lower(c) else '#888888' end as color, (c is not null and k%4=0) as is_color, k%3<>0 as inside, k%5 in (0,2) as mesh, (k%7=0 or k%7=1) as accepted from (select o_orderkey as k, case when o_orderkey%4=0 then '#A0'||lpad(cast(o_orderkey%10000 as varchar), 4, '0') else 'red' end as c from orders)")
def name_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    color = F.when(k % 4 == 0, F.concat(F.lit("#A0"), F.lpad((k % 10000).cast("string"), 4, "0"))).otherwise("red")
    path, name = _of(k, "a/../../x", "tiles/a", "a/../b"), _of(k, "m.GLB", "m.las", "x.stl", "glb", "m.")
    kinds = F.array(F.lit("LAS"), F.lit("ifc"))
    return X.read(spark, sf_dir, "orders").select(
        k.alias("k"), T.stored_color(color, "#888888").alias("color"), color.rlike(T.COLOR).alias("is_color"), T.contained_path(path).alias("inside"), T.mesh_extension(name).alias("mesh"),
        T.accepted_extension(_of(k, "a.las", "b.IFC", "c.txt", "las.x", "d.", "e.lasx", "f"), kinds).alias("accepted"),
    )


@query("select k, case when k%6 in (0,1) then 400 when k%6=2 then 413 when k%6=3 then 400 when k%6=4 then 400 else 0 end as creation, case when k%7=0 then 409 when k%7=1 then 400 when k%7=2 then 400 when k%7=3 then 409 when k%7=4 then 413 when k%7=5 then 413 else 0 end as patch from (select o_orderkey as k from orders)")
def upload_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    creation = T.creation_refusal(_of(k, "x", "0", "99999", "10", "10", "10"), _of(k, "bim", "bim", "bim", "other", "bim", "bim"), _of(k, "a.ifc", "a.ifc", "a.ifc", "a.ifc", "a.las", "up/a.IFC"), 5000)
    at, n, status = _of(k, 5, None, -1, 4, 5, 5, 5), _of(k, 1, 1, 1, 1, 7, 60, 5), _of(k, "queued", *["uploading"] * 6)
    patch = T.upload_refusal(status, F.lit(5), _of(k, 10, 10, 10, 10, 10, 100, 10), at, n, 50)
    return X.read(spark, sf_dir, "orders").select(k.alias("k"), creation.alias("creation"), patch.alias("patch"))


_CELLS = {0.0: "0.000000", 1.5: "1.500000", -2.25: "-2.250000", 1234.5: "1.234500e+3", -0.00001: "-1.000000e-5", 1e21: "1.000000e+21", float("nan"): "0.000000", 999.5: "999.500000"}


@query(f"select k, ({list(_CELLS.values())})[k%8+1] as cell, 'https://h/t/'||k||'.json' as relative, case when k%2=0 then 'https://h/a.b' else 'blob:x' end as whole, 'a/'||k as below, 24 as n_digits from (select o_orderkey as k from orders)")
def viewer_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    uri = F.concat(k.cast("string"), F.lit(".json"))
    return X.read(spark, sf_dir, "orders").select(
        k.alias("k"), T.matrix_cell(_of(k, *_CELLS)).alias("cell"), T.tile_address(uri, F.lit("https://h/t/set.json")).alias("relative"), T.tile_address(F.when(k % 2 == 0, "/a.b").otherwise("blob:x"), F.lit("https://h/t/set.json")).alias("whole"),
        T.below_base(F.concat(T.tile_base(F.lit(""), F.lit("/x/set.json")), F.lit("a/"), k.cast("string")), F.lit("/x")).alias("below"), F.length(T.random_id()).alias("n_digits"),
    )
