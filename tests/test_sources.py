import base64
import hashlib
import json
import struct
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.operators import mesh as M
from plumbline.operators import ranks
from plumbline.sources import digests, las, meshes, records, tiles


def test_las_by_ranges(spark, tmp_path):
    xyz = np.random.default_rng(1).uniform(-100, 100, (2500, 3))
    las.write_las(f"{tmp_path}/a.las", xyz)
    las.write_las(f"{tmp_path}/b.las", xyz[:10])
    got = las.read_las(spark, str(tmp_path), records=1000).toPandas().sort_values("point_id")
    assert len(got) == 2510 == las.point_count(str(tmp_path)) and got["point_id"].is_unique
    assert np.allclose(got[["x", "y", "z"]].to_numpy()[:2500], xyz, atol=0.00051)
    with pytest.raises(ValueError, match="LAS"):
        las.read_header(b"nope" * 100)


def cube(spark):
    v, t = (x.toPandas() for x in M.unit_box(spark))
    return v[["x", "y", "z"]].to_numpy(), t[["v0", "v1", "v2"]].to_numpy()


def test_mesh_formats(spark, tmp_path):
    places, faces = cube(spark)
    (tmp_path / "m.ply").write_bytes(meshes.ply_bytes(places, faces, np.full((8, 3), 0.5)))
    (tmp_path / "m.obj").write_text("".join(f"v {x} {y} {z}\n" for x, y, z in places) + "".join(f"f {a + 1}/1 {b + 1} {c + 1}\n" for a, b, c in faces))
    (tmp_path / "m.off").write_text("OFF\n8 12 0\n" + "".join(f"{x} {y} {z}\n" for x, y, z in places) + "".join(f"3 {a} {b} {c}\n" for a, b, c in faces))
    table = np.zeros(12, dtype=[("n", "<f4", 3), ("v", "<f4", (3, 3)), ("a", "<u2")])
    table["v"] = places[faces]
    (tmp_path / "m.stl").write_bytes(b"\0" * 80 + struct.pack("<I", 12) + table.tobytes())
    blob = places.astype("<f4").tobytes() + faces.astype("<u2").tobytes()
    scene = {"scenes": [{"nodes": [0]}], "nodes": [{"translation": [1, 0, 0], "children": [1]}, {"mesh": 0, "scale": [2, 2, 2]}], "meshes": [{"primitives": [{"attributes": {"POSITION": 0}, "indices": 1}]}], "accessors": [{"bufferView": 0, "componentType": 5126, "count": 8, "type": "VEC3"}, {"bufferView": 1, "componentType": 5123, "count": 36, "type": "SCALAR"}], "bufferViews": [{"buffer": 0, "byteLength": 96}, {"buffer": 0, "byteOffset": 96, "byteLength": 72}], "buffers": [{"byteLength": 168}]}
    text = json.dumps(scene).encode()
    text += b" " * (-len(text) % 4)
    (tmp_path / "m.glb").write_bytes(struct.pack("<4sIIII", b"glTF", 2, 28 + len(text) + len(blob), len(text), 0x4E4F534A) + text + struct.pack("<II", len(blob), 0x004E4942) + blob)
    for kind, area in (("ply", 6), ("obj", 6), ("off", 6), ("stl", 6), ("glb", 24)):
        v, t = meshes.read_mesh(spark, f"{tmp_path}/m.{kind}")
        assert abs(M.quality(t.drop("file"), v).agg(F.sum("area")).first()[0] - area) < 1e-5, kind
        if kind == "glb":
            assert v.agg(F.avg("x")).first()[0] == 1.0


def test_write_ply_and_distances(spark, tmp_path):
    v, t = M.unit_box(spark)
    meshes.write_ply(v.withColumns({c: F.lit(0.25) for c in "rgb"}), t, f"{tmp_path}/o.ply")
    columns, faces = meshes.parse_ply((tmp_path / "o.ply").read_bytes())
    assert len(faces) == 12 and set(columns["red"]) == {64}
    d = v.select("vertex_id", F.col("x").alias("d"))
    (tmp_path / "d.bin").write_bytes(meshes.distance_bytes(d))
    back = meshes.read_distances(spark, f"{tmp_path}/d.bin")
    assert meshes.aligned_distances(v, back).count() == 8
    with pytest.raises(ValueError, match="don't match"):
        meshes.aligned_distances(v, back.filter("vertex_id < 7"))
    (tmp_path / "e.obj").write_text("v 0 0 0\n")
    with pytest.raises(Exception, match="no faces"):
        meshes.read_mesh(spark, f"{tmp_path}/e.obj")[0].count()


def pnts(n=3, version=1, extra=0):
    head = json.dumps({"POINTS_LENGTH": n, "POSITION": {"byteOffset": 0}}).encode()
    head += b" " * (-len(head) % 8)
    body = b"\0" * 36
    return struct.pack("<4sIIIIII", b"pnts", version, 28 + len(head) + len(body) + extra, len(head), len(body), 0, 0) + head + body


def test_tile_sets(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "tileset.json").write_text(json.dumps({"root": {"children": [{"content": {"uri": "sub/ext.json"}}, {"content": {"uri": "../out.pnts"}}]}}))
    (tmp_path / "sub/ext.json").write_text(json.dumps({"root": {"content": {"url": "t.pnts?x=1"}, "children": [{"content": {"uri": "../tileset.json"}}]}}))
    (tmp_path / "sub/t.pnts").write_bytes(pnts())
    assert {r["path"] for r in tiles.tile_files(spark, str(tmp_path)).collect()} == {"sub/ext.json", "sub/t.pnts", "tileset.json"}
    assert tiles.has_valid_tile(spark, str(tmp_path))
    rows = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate((pnts(), pnts(0), pnts(2.5), pnts(version=2), pnts(extra=1), b"\0" * 188, b""))], "i int, content binary")
    assert [r["ok"] for r in rows.orderBy("i").select(tiles.valid_pnts(F.col("content")).alias("ok")).collect()] == [True] + [False] * 6


def test_metadata_and_artifacts(spark, tmp_path):
    (tmp_path / "metadata.json").write_text(json.dumps({"elements": {"a": {"stepId": 5, "id": "a", "name": "wall", "type": "T"}}}))
    assert tiles.read_metadata(spark, f"{tmp_path}/metadata.json").first()["step_id"] == 5
    rows = spark.createDataFrame([("m.glb", bytearray(b"glTF" + b"\0" * 40)), ("m.glb", bytearray(b"glTF demo")), ("metadata.json", bytearray(b'{"a":1}')), ("metadata.json", bytearray(b"{")), ("tileset.json", bytearray(b"{}"))], "name string, content binary")
    ok = rows.select(tiles.valid_artifact(F.col("name"), F.length("content"), F.col("content")).alias("ok")).collect()
    assert [r["ok"] for r in ok] == [True, False, True, False, False]


def test_scene_transforms(spark):
    move = lambda x: [1.0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, x, 0, 0, 1.0]
    nodes = spark.createDataFrame([(1, None, [float(v) for v in move(1)]), (2, 1, [float(v) for v in move(2)]), (3, 2, [float(v) for v in move(4)])], "node_id int, parent_id int, matrix array<double>")
    assert {r["node_id"]: r["matrix"][12] for r in tiles.world_matrices(nodes).collect()} == {1: 1.0, 2: 3.0, 3: 7.0}


def test_gltf_with_embedded_and_separate_buffers(spark, tmp_path):
    import base64
    import json

    import numpy as np

    from plumbline.sources import meshes

    places = np.array([[0, 0, 0], [32767, 0, 0], [0, 32767, 0]], dtype="<i2")
    padded = np.zeros((3, 4), dtype="<i2")
    padded[:, :3] = places
    blob = padded.tobytes() + np.array([0, 1, 2], dtype="<u2").tobytes()
    scene = {
        "asset": {"version": "2.0"}, "scenes": [{"nodes": [0]}], "nodes": [{"mesh": 0, "translation": [1, 2, 3]}], "meshes": [{"primitives": [{"attributes": {"POSITION": 0}, "indices": 1}]}],
        "bufferViews": [{"buffer": 0, "byteOffset": 0, "byteLength": 24, "byteStride": 8}, {"buffer": 0, "byteOffset": 24, "byteLength": 6}],
        "accessors": [{"bufferView": 0, "componentType": 5122, "count": 3, "type": "VEC3", "normalized": True}, {"bufferView": 1, "componentType": 5123, "count": 3, "type": "SCALAR"}],
    }
    (tmp_path / "a b.bin").write_bytes(blob)
    (tmp_path / "in.gltf").write_text(json.dumps(scene | {"buffers": [{"uri": "data:application/octet-stream;base64," + base64.b64encode(blob).decode(), "byteLength": 30}]}))
    (tmp_path / "out.gltf").write_text(json.dumps(scene | {"buffers": [{"uri": "a%20b.bin", "byteLength": 30}]}))
    for name in ("in.gltf", "out.gltf"):
        v, t = meshes.read_mesh(spark, f"{tmp_path}/{name}")
        assert [(r["x"], r["y"], r["z"]) for r in v.orderBy("vertex_id").collect()] == [(1, 2, 3), (2, 2, 3), (1, 3, 3)] and t.count() == 1


def test_colours_and_missing_normals(spark, tmp_path):
    from plumbline.operators import mesh as M
    from plumbline.sources import meshes
    from pyspark.sql import functions as F

    vertices, faces = M.unit_box(spark)
    meshes.write_ply(vertices.withColumns({"r": F.lit(1.0), "g": F.lit(0.5), "b": F.lit(0.0)}), faces, f"{tmp_path}/c.ply")
    v, t = meshes.read_mesh(spark, f"{tmp_path}/c.ply")
    row = v.first()
    assert (row["r"], round(row["g"], 2), row["b"], row["nx"]) == (1.0, 0.5, 0.0, None)
    made = meshes.with_normals(v, t).collect()
    assert len(made) == 8 and all(abs(r["nx"] ** 2 + r["ny"] ** 2 + r["nz"] ** 2 - 1) < 1e-9 for r in made)


def test_database_tables(spark, tmp_path):
    from plumbline.sources.database import read_table, write_table

    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    rows = spark.range(100).selectExpr("id", "id % 3 as owner_id")
    write_table(rows, url, "assets", **driver)
    got = read_table(spark, url, "assets", "ID", (0, 100), 4, **driver)
    assert got.rdd.getNumPartitions() == 4
    assert got.count() == 100
    wanted = got.filter("OWNER_ID = 2")
    assert wanted.count() == 33
    assert "*equalto(owner_id,2)" in wanted._jdf.queryExecution().executedPlan().toString().lower()


def test_long_feature_table_is_valid(spark):
    import json
    import struct

    from plumbline.sources.tiles import valid_pnts
    from pyspark.sql import functions as F

    table = json.dumps({"note": "x" * 1_200_000, "POINTS_LENGTH": 2}).encode()
    tile = struct.pack("<4sIIIIII", b"pnts", 1, 28 + len(table), len(table), 0, 0, 0) + table
    assert spark.createDataFrame([(bytearray(tile),)], "content binary").select(valid_pnts(F.col("content"))).first()[0]


def test_benchmarks(spark):
    from plumbline.operators import mesh as M
    from plumbline.plans import benchmarks

    vertices, faces = M.unit_box(spark)
    model = vertices.join(M.vertex_normals(faces, vertices), "vertex_id")
    got = benchmarks.constrained_cases(model, M.points_in_box(spark, (0, 0, 0), (0.5, 0.5, 0.5), 300)).orderBy("position").collect()
    assert len(got) == 5 and got[0]["ratio"] == 1.0 and sum(r["is_fastest"] for r in got) == 1
    rows = benchmarks.remesh_cases(vertices, faces, 0.5, {"few": ("bim_isotropic_only", {"isotropic_iterations": 1, "use_decimation": False})}).collect()
    assert rows[0]["pipeline"] == "few" and rows[0]["faces_before"] == 12 and rows[0]["in_zone"] >= 0


def _plate(spark, n):
    """A plate of n x n vertices whose ids have gaps, in no order."""
    vertices = spark.range(n * n).selectExpr("id * 3 + 7 as vertex_id", f"cast(id % {n} as double) as x", f"cast(floor(id / {n}) as double) as y", "id / 10d as z", "1d as r", "0.5d as g", f"id / {n * n - 1}d as b", "'more' as part").repartition(5)
    at = lambda step: f"(id + {step}) * 3 + 7"
    cells = spark.range(n * n).filter(f"id % {n} < {n - 1} and id < {n * (n - 1)}")
    faces = cells.selectExpr("id * 2 as face_id", f"{at(0)} as v0", f"{at(1)} as v1", f"{at(n)} as v2").unionAll(cells.selectExpr("id * 2 + 1", at(1), at(n + 1), at(n)))
    return vertices, faces.repartition(3)


def test_ply_from_many_tasks_is_one_file(spark, tmp_path):
    vertices, faces = _plate(spark, 30)
    path = tmp_path / "plate.ply"
    path.write_bytes(b"old")
    meshes.write_ply(vertices, faces, str(path))
    v, f = (t.toPandas() for t in (vertices.orderBy("vertex_id"), faces.orderBy("face_id")))
    assert path.read_bytes() == meshes.ply_bytes(v[["x", "y", "z"]].to_numpy(), (f[["v0", "v1", "v2"]].to_numpy() - 7) // 3, v[["r", "g", "b"]].to_numpy())
    assert [p.name for p in tmp_path.iterdir()] == ["plate.ply"]
    meshes.write_ply(vertices.select("vertex_id", "x", "y", "z"), faces.limit(0), f"file://{tmp_path}/bare.ply")
    columns, none = meshes.parse_ply((tmp_path / "bare.ply").read_bytes())
    assert len(columns["x"]) == 900 and "red" not in columns and len(none) == 0
    meshes.write_ply(vertices.limit(0), faces.limit(0), f"{tmp_path}/empty.ply")
    assert (tmp_path / "empty.ply").read_bytes() == meshes.ply_bytes(np.zeros((0, 3)), np.zeros((0, 3)), np.zeros((0, 3)))


def test_a_failed_write_leaves_the_old_file(spark, tmp_path):
    vertices, faces = _plate(spark, 6)
    path = tmp_path / "plate.ply"
    path.write_bytes(b"old")
    for v, f in ((vertices.filter("vertex_id <> 40"), faces), (vertices.withColumn("y", F.when(F.col("vertex_id") < 40, F.col("y"))), faces), (vertices.unionAll(vertices.limit(1)), faces)):
        with pytest.raises(Exception, match="has no|dense in place|missing or repeated"):
            meshes.write_ply(v, f, str(path))
        assert path.read_bytes() == b"old" and [p.name for p in tmp_path.iterdir()] == ["plate.ply"]


def test_a_repeated_task_counts_once(tmp_path):
    """Two attempts of one task leave two segments; what the commit is told of is in the file."""
    writer = records.RecordWriter({"path": str(tmp_path / "d.bin"), "layout": '[[["d", "<f4"]]]'})
    batch = lambda first, values: pa.RecordBatch.from_pydict({"part": pa.array([0] * len(values), pa.int32()), "place": pa.array(range(first, first + len(values)), pa.int64()), "d": pa.array(values, pa.float64())})
    lost, last = writer.write(iter([batch(2, [9.0])])), writer.write(iter([batch(2, [3.0])]))
    first = writer.write(iter([batch(0, [1.0]), batch(1, [2.0])]))
    assert lost.name != last.name
    writer.commit([last, None, writer.write(iter([])), first])
    assert np.frombuffer((tmp_path / "d.bin").read_bytes(), "<f4").tolist() == [1.0, 2.0, 3.0]
    other = records.RecordWriter({"path": str(tmp_path / "d.bin"), "layout": '[[["d", "<f4"]]]'})
    with pytest.raises(ValueError, match="missing or repeated"):
        other.commit([other.write(iter([batch(1, [2.0])]))])
    other.abort([])
    assert [p.name for p in tmp_path.iterdir()] == ["d.bin"]
    with pytest.raises(ValueError, match="beyond what"):
        records.packed(pa.RecordBatch.from_pydict({"n": [1 << 31]}), [["n", "<i4"]])


def test_distances_from_many_tasks(spark, tmp_path):
    rows = spark.range(5000).selectExpr("id * 2 as vertex_id", "case when id <> 17 then id / 4d end as d").repartition(7)
    meshes.write_distances(rows, f"{tmp_path}/d.bin")
    back = np.frombuffer((tmp_path / "d.bin").read_bytes(), "<f4")
    assert np.isnan(back[17]) and np.array_equal(np.delete(back, 17), np.delete(np.arange(5000) / 4, 17).astype("<f4"))


def test_dense_ranks_need_no_window_over_all(spark):
    rows = spark.range(1000).selectExpr("id * 7 % 1009 as k").repartition(6)
    got = ranks.ranked(rows, "k", "r").toPandas().sort_values("k")
    assert got["r"].tolist() == list(range(1000)) and ranks.ranked(rows.limit(0), "k", "r").count() == 0


def test_digests_by_pieces(spark, tmp_path):
    data = np.random.default_rng(3).bytes((3 << 19) + 5)
    for name, content in {"a/one.bin": data, "a/b/two.txt": b"x", "empty": b"", "_SUCCESS": b"no", ".one.crc": b"no"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    got = {}
    for r in digests.read_digests(spark, str(tmp_path), piece=1).collect():
        got.setdefault(r.file.rsplit("/", 1)[-1], []).append((r.state, r.piece, r.progress, r.digest, r.error))
    assert got.keys() == {"one.bin", "two.txt", "empty"}
    assert [r[2] for r in got["one.bin"]] == [25, 50, 75, 100, 100] and got["one.bin"][-1] == ("success", None, 100, hashlib.md5(data).hexdigest(), None)
    assert got["two.txt"][-1][3] == hashlib.md5(b"x").hexdigest() and got["empty"] == [("error", None, None, None, "the file is empty")]
    assert digests.piece_bytes(1) == 512 << 10 and digests.piece_bytes(1 << 40) == 10 << 20
    assert digests.packs([("a", 5), ("b", 5), ("c", 90), ("d", 1)], 10) == [[("a", 5), ("b", 5)], [("c", 90)], [("d", 1)]]
    (tmp_path / "none").mkdir()
    assert digests.read_digests(spark, f"{tmp_path}/none").count() == 0


def test_digest_of_a_large_file_holds_one_piece(tmp_path):
    path, size = tmp_path / "sparse", 256 << 20
    with open(path, "wb") as f:
        f.truncate(size)
    want = hashlib.md5()
    for _ in range(size >> 20):
        want.update(bytes(1 << 20))
    tracemalloc.start()
    *_, last = digests.steps(str(path), size, digests.PIECE)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert last[5] == want.hexdigest() and peak < 4 * digests.PIECE


def _gltf(blob, views, accessors, node=None):
    scene = {
        "asset": {"version": "2.0"}, "scenes": [{"nodes": [0]}], "nodes": [{"mesh": 0} | (node or {})], "meshes": [{"primitives": [{"attributes": {"POSITION": 0}}]}],
        "bufferViews": [{"buffer": 0, "byteOffset": a, "byteLength": n} for a, n in views], "accessors": accessors,
        "buffers": [{"uri": "data:application/octet-stream;base64," + base64.b64encode(blob).decode(), "byteLength": len(blob)}],
    }
    return json.dumps(scene).encode()


def test_sparse_accessors_and_accessors_without_a_view():
    values = np.array([[2, 0, 0], [0, 3, 0]], dtype="<f4")
    blob = np.array([1, 2], dtype="<u2").tobytes() + values.tobytes() + np.arange(9, dtype="<f4").tobytes()
    sparse = {"count": 2, "indices": {"bufferView": 0, "componentType": 5123}, "values": {"bufferView": 1}}
    views = [(0, 4), (4, 24), (28, 36)]
    zeros = {"componentType": 5126, "count": 3, "type": "VEC3"}
    assert meshes.parse_gltf(_gltf(blob, views, [zeros]))[0].tolist() == [[0, 0, 0]] * 3
    assert meshes.parse_gltf(_gltf(blob, views, [zeros | {"sparse": sparse}]))[0].tolist() == [[0, 0, 0], [2, 0, 0], [0, 3, 0]]
    places, faces = meshes.parse_gltf(_gltf(blob, views, [zeros | {"bufferView": 2, "sparse": sparse}]))
    assert places.tolist() == [[0, 1, 2], [2, 0, 0], [0, 3, 0]] and faces.tolist() == [[0, 1, 2]]
    with pytest.raises(ValueError, match="beyond its buffer"):
        meshes.parse_gltf(_gltf(blob, views, [zeros | {"bufferView": 2, "count": 6}]))


def test_mirrored_nodes_keep_their_outside():
    blob = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0]], dtype="<f4").tobytes()
    plain = [{"bufferView": 0, "componentType": 5126, "count": 3, "type": "VEC3"}]
    for scale, up in (([1, 1, 1], 1), ([-1, 1, 1], 1), ([-1, -1, 1], 1), ([1, 1, -1], -1), ([-1, -2, -1], -1)):
        places, faces = meshes.parse_gltf(_gltf(blob, [(0, 36)], plain, {"scale": scale}))
        a, b, c = places[faces[0]]
        assert np.sign(np.cross(b - a, c - a)[2]) == up


def test_deep_scenes_cycles_and_gaps(spark):
    shift = lambda x: [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, x, 0.0, 0.0, 1.0]
    turn = [0.0, 1.0, 0.0, 0.0, -1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 2.0, 0.0, 0.0, 1.0]
    scene = lambda rows: spark.createDataFrame(rows, "node_id int, parent_id int, matrix array<double>")
    chain = [(i, i - 1 if i else None, shift(float(i))) for i in range(500)]
    gap = [(601 + i, 600 + i, shift(1.0)) for i in range(5)]  # below 600, which isn't there
    turned = [(700, None, turn), (701, 700, turn), (702, 701, shift(5.0))]
    got = {r["node_id"]: r["matrix"] for r in tiles.world_matrices(scene(chain + gap + turned)).collect()}
    assert {n: m[12] for n, m in got.items() if n < 500} == {i: i * (i + 1) / 2 for i in range(500)}
    assert set(got) == {*range(500), 700, 701, 702}
    assert got[702][:2] == [-1.0, 0.0] and got[702][12:14] == [-3.0, 2.0]  # 2, then 2 more along y, then 5 back along x
    assert tiles.world_matrices(scene([])).count() == 0
    with pytest.raises(ValueError, match="3 nodes are in a cycle"):
        tiles.world_matrices(scene(chain[:9] + [(20, 21, turn), (21, 20, turn), (22, 21, turn)])).count()
