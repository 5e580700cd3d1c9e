import base64
import time

import pytest
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import catalog as C
from plumbline.operators import jobs as J
from plumbline.operators import uploads as U
from plumbline.plans import algorithms as A
from plumbline.plans import c2m
from plumbline.operators import mesh as M
from plumbline.streaming.uploads import bytes_per_window, upload_states


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


@pytest.mark.parametrize(("kind", "name", "ok"), [("bim", "a.ifc", True), ("bim", "A.IFC", True), ("bim", "a.las", False), ("pointcloud", "x.las", True), ("pointcloud", "x.laz", False)])
def test_extensions(spark, kind, name, ok):
    assert one(spark, v=T.valid_extension(F.lit(kind), F.lit(name)))["v"] is ok


@pytest.mark.parametrize(("color", "kept"), [("#A1b2C3", "#a1b2c3"), ("#000000", "#000000"), ("red", None), ("#12345", None), ("#1234567", None), ("", None), ("123456", None)])
def test_colors(spark, color, kept):
    assert one(spark, v=T.stored_color(F.lit(color)))["v"] == kept


@pytest.mark.parametrize(("path", "ok"), [("tiles/a.json", True), ("a/../b", True), ("../x", False), ("a/../../x", False), ("/etc/x", False)])
def test_contained_paths(spark, path, ok):
    assert one(spark, v=T.contained_path(F.lit(path)))["v"] is ok


def test_texts(spark):
    meta = "name " + base64.b64encode("wänd.ifc".encode()).decode() + ",bad !!,lone"
    r = one(
        spark, m=T.upload_metadata(F.lit(meta)), e=T.encoded_metadata(F.create_map(F.lit("k"), F.lit("v"))), path=T.rebase(F.lit("/app/data/x/y"), "/app/data", "/mnt/b"), other=T.rebase(F.lit("/app/database"), "/app/data", "/mnt/b"),
        err=T.error_message(F.lit('{"msg":" ","detail":"no"}')), raw=T.error_message(F.lit(" plain ")), size=T.file_size(F.lit(1536)), small=T.file_size(F.lit(0)), dur=T.duration_seconds(F.lit("1h30m500ms")), nodur=T.duration_seconds(F.lit("x7d")),
        i=T.header_int(F.lit("x")), s=T.setting(F.lit("40"), 1, 32, 2), l=T.listed(F.lit(" a,, b ")), when=T.rfc3339(F.lit(0)), id=F.length(T.random_id()), guid=T.element_id(F.lit("0123456789abcdefghij_$"), F.lit("m"), F.lit("p")), pre=T.element_id(F.lit("w1_x"), F.lit("m"), F.lit("p")), up=T.element_id(F.lit(" "), F.lit(None), F.lit("p")),
        refused=T.upload_refusal(F.lit("uploading"), F.lit(5), F.lit(10), F.lit(4), F.lit(1), 100), env=T.envelope(F.lit(0), F.lit("ok"), F.struct(F.lit(1).alias("a"))), cell=T.matrix_cell(F.lit(1e-7)), bad=T.parameters(F.lit("null"))[1], text=T.upload_error(F.lit(413), F.lit("")),
    )
    assert r["m"] == {"name": "wänd.ifc"} and r["e"] == "k dg==" and r["path"] == "/mnt/b/x/y" and r["other"] == "/app/database"
    assert r["err"] == "no" and r["raw"] == "plain" and r["size"] == "1.5 KB" and r["small"] == "0 B" and r["dur"] == 5400.5 and r["nodur"] is None
    assert r["i"] == 0 and r["s"] == 2 and r["l"] == ["a", "b"] and r["when"] == "1970-01-01T00:00:00Z" and r["id"] == 24
    assert r["guid"] == "0123456789abcdefghij_$" and r["pre"] == "w1" and r["up"] == "p" and r["refused"] == 409 and r["env"] == '{"code":0,"msg":"ok","data":{"a":1}}' and r["cell"] == "1.000000e-7" and r["bad"] is True and r["text"] == T.UPLOAD_ERRORS[413]


def test_pages_are_bounded(spark):
    rows = spark.range(700).select("id", (F.col("id") % 7).alias("created_at"))
    assert C.page(rows, 0, 9999).count() == 100 and C.page(rows, 2, 500).count() == 200
    assert [r["id"] for r in C.page(rows, 1, 2).collect()] == [6, 13]


def test_updates(spark):
    rows = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "id int, name string, v double")
    new = spark.createDataFrame([(2, "B", None), (3, "c", 3.0)], "id int, name string, v double")
    assert sorted(map(tuple, C.upserted(rows, new, "id").collect())) == [(1, "a", 1.0), (2, "B", None), (3, "c", 3.0)]
    assert sorted(map(tuple, C.partly_updated(rows, new.select("id", "v"), "id").collect()), key=str) == [(1, "a", 1.0), (2, "b", None)]
    colored = rows.withColumn("pointcloud_color", F.lit("#aaaaaa"))
    assert [r["pointcloud_color"] for r in C.set_color(C.set_color(colored, 1, "#ABCDEF"), 2, "").orderBy("id").collect()] == ["#abcdef", None]


EVENTS = [(1, 0, "create", None, None, 10), (1, 1, "chunk", 0, 4, None), (1, 2, "chunk", 5, 2, None), (1, 3, "chunk", 4, 7, None), (1, 4, "chunk", 4, 6, None), (1, 5, "chunk", 10, 1, None), (2, 0, "create", None, None, 5), (2, 1, "terminate", None, None, None), (2, 2, "chunk", 0, 5, None), (3, 0, "chunk", 0, 1, None)]
EVENT_SCHEMA = "upload_id bigint, event_id bigint, kind string, at bigint, n_bytes bigint, size bigint, ts timestamp"
STATES = {(1, "queued", 10, 10, 2, 3), (2, "terminated", 0, 5, 0, 1), (3, "none", 0, 0, 0, 1)}


def events(spark):
    from datetime import datetime, timedelta

    return spark.createDataFrame([(*e, datetime(2024, 1, 1) + timedelta(seconds=e[1])) for e in EVENTS], EVENT_SCHEMA)


def test_upload_fold(spark):
    assert {tuple(r) for r in U.fold(events(spark)).collect()} == STATES


def test_upload_stream(spark, tmp_path):
    events(spark).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(EVENT_SCHEMA).parquet(f"{tmp_path}/in")
    query = upload_states(stream).writeStream.outputMode("update").format("memory").queryName("states").option("checkpointLocation", f"{tmp_path}/c").start()
    until = time.time() + 90
    while time.time() < until and spark.table("states").count() < len(STATES):
        time.sleep(0.5)  # with time-outs a query never ends by itself
    query.stop()
    assert {tuple(r) for r in spark.table("states").collect()} == STATES


def test_bytes_per_window(spark):
    rows = bytes_per_window(events(spark).filter("kind = 'chunk'")).collect()
    assert {(r["upload_id"], r["n_bytes"], r["n_chunks"]) for r in rows} == {(1, 20, 5), (2, 5, 1), (3, 1, 1)}


def test_algorithms(spark):
    rows = {r["name"]: r for r in A.describe(spark).collect()}
    assert [len(rows[n]["params"]) for n in ("bim_preprocessor", "bim_isotropic_only")] == [14, 10]
    with pytest.raises(ValueError, match="unknown parameters: iterations"):
        A.remesh(*M.unit_box(spark), "bim_isotropic_only", {"iterations": 3})
    assert set(rows) == {"bim_preprocessor", "bim_isotropic_only"} and all(p["default"] is not None for r in rows.values() for p in r["params"])
    with pytest.raises(ValueError, match="no algorithm"):
        A.remesh(None, None, "none")
    v, t = M.unit_box(spark)
    got = A.remesh(v, t, "bim_isotropic_only", {"target_edge_length": 0.5, "isotropic_iterations": 1, "clean_tolerance": "x", "use_decimation": False}).row().first()
    assert got["faces_before"] == 12 and got["faces_after"] > 12
    metrics = spark.createDataFrame([("a", 1.0, 2.0), ("b", 0.5, 3.0)], "pipeline string, err double, quality double")
    assert {(r["metric"], r["pipeline"]) for r in A.best_pipeline(metrics, ["err"], ["quality"]).collect()} == {("err", "b"), ("quality", "b")}


def test_comparison_pipeline(spark):
    vertices, faces = M.unit_box(spark)
    mesh = vertices.join(M.vertex_normals(faces, vertices), "vertex_id")
    got = c2m.compute(M.points_in_box(spark, (5, 0, 0), (0.5, 0.5, 0.5), 2000), mesh, faces, [1.0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, -5, 0, 0, 1.0])
    assert got.statistics.first()["n"] == 8 and abs(got.statistics.first()["mean"]) < 0.2 and got.overlap.first()["iou"] > 0.8
    assert got.histogram.count() == 50 and {"r", "g", "b"} <= set(got.colors.columns) and got.colors.count() == 8


def test_fixed_texts(spark):
    """Values read by hand."""
    labels = {s: tuple(one(spark, a=T.status_text(F.lit(s))[0], b=T.status_text(F.lit(s))[1])) for s in ("uploading", "terminated", "odd")}
    assert labels == {"uploading": ("文件上传中", "warning"), "terminated": ("上传已终止", "danger"), "odd": ("状态待更新", "info")}
    sizes = {n: one(spark, v=T.file_size(F.lit(n)))["v"] for n in (0, 1023, 1024, 1536, 102400, 153600, 5 << 30, 3 << 50)}
    assert sizes == {0: "0 B", 1023: "1023 B", 1024: "1.0 KB", 1536: "1.5 KB", 102400: "100 KB", 153600: "150 KB", 5 << 30: "5.0 GB", 3 << 50: "3072 TB"}
    errors = [one(spark, v=T.upload_error(F.lit(c), F.lit("server says")))["v"] for c in (400, 401, 404, 409, 413, 415, 502, 418)]
    assert errors == ["server says", "登录状态已失效，请重新登录", "上传会话不存在，请重新上传", "server says", "文件过大，超出服务端限制", "server says", "服务器暂时不可用，请稍后重试", "上传失败，请稍后重试"]
    spent = [one(spark, v=T.duration_seconds(F.lit(d)))["v"] for d in ("7d", "7D", "168h", "1.5h", "-2m", "100", "1d2h", "d")]
    assert spent == [604800.0, 604800.0, 604800.0, 5400.0, -120.0, None, None, None]
    assert len(one(spark, v=T.error_message(F.lit('{"msg": "' + "ä" * 400 + '"}')))["v"].encode()) == 300
    assert one(spark, v=T.client_error(F.lit('{"msg":" ","message":" m "}')))["v"] == " m "
    keys = F.create_map(F.lit("guid"), F.lit("g"), F.lit("expressId"), F.lit(" 7 "), F.lit("id"), F.lit("9"))
    assert one(spark, v=T.ifc_id(keys))["v"] == "7"


def test_utc_whatever_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Shanghai")
    try:
        got = one(spark, utc=T.rfc3339(F.lit(1700000000)), local=T.minute_text(F.lit(1700000000)), none=T.minute_text(F.lit(0)))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert tuple(got) == ("2023-11-14T22:13:20Z", "2023-11-15 06:13", "时间未记录")


def test_years_of_five_digits_have_no_sign(spark):
    got = one(spark, utc=T.rfc3339(F.lit(900_000_000_000)), minute=T.minute_text(F.lit(900_000_000_000)))
    assert tuple(got) == ("30489-11-11T16:00:00Z", "30489-11-11 16:00")


def test_chunks_of_one_session_are_planned_by_several_tasks(spark):
    rows = spark.createDataFrame([("a", 7, 100_000), ("b", 5, 5), ("c", 0, 10)], "fingerprint string, offset bigint, size bigint").coalesce(1)
    plan = J.chunk_plan(rows, 10)
    got = [tuple(r) for r in plan.orderBy("fingerprint", "number").collect()]
    assert got == [("a", 7, 100_000, i, 7 + 10 * i, min(10, 99_993 - 10 * i)) for i in range(10_000)] + [("c", 0, 10, 0, 0, 10)]
    assert plan.groupBy(F.spark_partition_id()).count().count() > 1


def test_blocks_of_chunks_follow_the_tasks_and_not_the_chunks(spark):
    rows = spark.createDataFrame([("a", 3, 3 + (1 << 28)), ("b", 0, 5), ("c", 5, 5)], "fingerprint string, offset bigint, size bigint")
    got = sorted(tuple(r) for r in J.chunk_blocks(rows, 1).select("fingerprint", "_first", "_end").collect())
    assert len(got) <= 2 + J.TASK_BLOCKS * (1 << 28) // J.TASK_CHUNKS + J.TASK_BLOCKS
    assert got[-1] == ("b", 0, 5) and [r[1] for r in got[:-1]] == [0, *[r[2] for r in got[:-2]]] and got[-2][2] == 1 << 28


def test_blocks_longer_than_a_part_are_spelt_out_whole(spark, monkeypatch):
    monkeypatch.setattr(J, "TASK_BLOCKS", 1)
    rows = spark.createDataFrame([("a", 7, 100_000), ("b", 0, 8193)], "fingerprint string, offset bigint, size bigint")
    got = [tuple(r) for r in J.chunk_plan(rows, 1).orderBy("fingerprint", "number").collect()]
    assert got == [("a", 7, 100_000, i, 7 + i, 1) for i in range(99_993)] + [("b", 0, 8193, i, i, 1) for i in range(8193)]
