"""Mesh files: PLY, OBJ, STL, OFF, GLB and glTF to vertices and triangles; PLY out.

A file is one mesh and is parsed by one task; many files are parsed side by side. Ids are unique within a file.
"""

from __future__ import annotations

import base64
import json
import struct
from urllib.parse import quote

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.mesh import CORNERS
from plumbline.operators.ranks import in_order, ranked
from plumbline.sources.files import opened
from plumbline.sources.records import RecordSink, discard, staging_beside

# PLY's names of number types.
_PLY = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}


def parse_ply(data: bytes) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """(vertex properties, faces of three corners); polygons become fans."""
    head, _, body = data.partition(b"end_header\n")
    elements: list[tuple[str, int, list]] = []
    kind = "ascii"
    for line in head.decode("ascii", "replace").split("\n"):
        p = line.split()
        if p[:1] == ["format"]:
            kind = p[1]
        elif p[:1] == ["element"]:
            elements.append((p[1], int(p[2]), []))
        elif p[:1] == ["property"]:
            elements[-1][2].append(p[1:])
    order = ">" if kind == "binary_big_endian" else "<"
    vertices, faces, at = {}, [], 0
    words = iter(body.split()) if kind == "ascii" else None
    for name, n, props in elements:
        if all(p[0] != "list" for p in props):
            if words:
                table = np.array([[float(next(words)) for _ in props] for _ in range(n)]).reshape(n, len(props))
                columns = {p[-1]: table[:, k] for k, p in enumerate(props)}
            else:
                dtype = np.dtype([(p[1], order + _PLY[p[0]]) for p in props])
                table = np.frombuffer(body, dtype=dtype, count=n, offset=at)
                at += n * dtype.itemsize
                columns = {p[1]: table[p[1]] for p in props}
            if name == "vertex":
                vertices = columns
            continue
        for _ in range(n):
            for p in props:
                if p[0] != "list":
                    if words:
                        next(words)
                    else:
                        at += np.dtype(_PLY[p[0]]).itemsize
                    continue
                if words:
                    row = [int(next(words)) for _ in range(int(next(words)))]
                else:
                    count = np.dtype(order + _PLY[p[1]])
                    size = int(np.frombuffer(body, count, 1, at)[0])
                    at += count.itemsize
                    item = np.dtype(order + _PLY[p[2]])
                    row = np.frombuffer(body, item, size, at).tolist()
                    at += size * item.itemsize
                if name == "face" and p[-1].startswith("vertex_ind"):
                    faces += [(row[0], row[i], row[i + 1]) for i in range(1, len(row) - 1)]
    return vertices, np.array(faces, dtype=np.int64).reshape(-1, 3)


def parse_obj(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    places, faces = [], []
    for line in data.decode("utf-8", "replace").splitlines():
        p = line.split()
        if p[:1] == ["v"]:
            places.append([float(v) for v in p[1:4]])
        elif p[:1] == ["f"]:
            row = [int(v.split("/")[0]) for v in p[1:]]
            row = [v - 1 if v > 0 else len(places) + v for v in row]
            faces += [(row[0], row[i], row[i + 1]) for i in range(1, len(row) - 1)]
    return np.array(places).reshape(-1, 3), np.array(faces, dtype=np.int64).reshape(-1, 3)


def parse_stl(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = struct.unpack_from("<I", data, 80)[0] if len(data) >= 84 else 0
    if len(data) == 84 + 50 * n:
        table = np.frombuffer(data, dtype=np.dtype([("n", "<f4", 3), ("v", "<f4", (3, 3)), ("a", "<u2")]), offset=84)
        places = table["v"].reshape(-1, 3).astype(float)
    else:
        places = np.array([[float(v) for v in line.split()[1:4]] for line in data.decode("ascii", "replace").splitlines() if line.split()[:1] == ["vertex"]]).reshape(-1, 3)
    return places, np.arange(len(places), dtype=np.int64).reshape(-1, 3)


def parse_off(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    words = [w for line in data.decode("ascii", "replace").splitlines() for w in line.split("#")[0].split()]
    n, m = int(words[1]), int(words[2])
    places = np.array(words[4 : 4 + 3 * n], dtype=float).reshape(-1, 3)
    faces, at = [], 4 + 3 * n
    for _ in range(m):
        size = int(words[at])
        row = [int(w) for w in words[at + 1 : at + 1 + size]]
        faces += [(row[0], row[i], row[i + 1]) for i in range(1, size - 1)]
        at += 1 + size
    return places, np.array(faces, dtype=np.int64).reshape(-1, 3)


def parse_glb(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All triangle meshes of a scene in world coordinates; compressed buffers are not read."""
    magic, version, _ = struct.unpack_from("<4sII", data)
    if magic != b"glTF" or version != 2:
        raise ValueError("not a GLB file of version 2")
    size = struct.unpack_from("<I", data, 12)[0]
    return _scene(json.loads(data[20 : 20 + size]), lambda _: data[28 + size :])


def parse_gltf(data: bytes, name: str = "") -> tuple[np.ndarray, np.ndarray]:
    """A glTF file; its buffers are data addresses or files beside it."""
    scene = json.loads(data)

    def buffer(i: int) -> bytes:
        uri = scene["buffers"][i]["uri"]
        if uri.startswith("data:"):
            return base64.b64decode(uri.partition(",")[2])
        with opened(f"{quote(_uri(name).rsplit('/', 1)[0], safe=':/%')}/{uri}") as f:
            return f.read()

    return _scene(scene, buffer)


def _uri(path: str) -> str:
    """Spark writes file:/x, others read file:///x."""
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


def _scene(scene: dict, buffer) -> tuple[np.ndarray, np.ndarray]:
    blobs: dict[int, bytes] = {}

    def elements(view_at: int | None, start: int, component: int, count: int, width: int) -> np.ndarray:
        """count rows of width numbers in a view; zeros where there is no view."""
        kind = np.dtype({5120: "i1", 5121: "u1", 5122: "<i2", 5123: "<u2", 5125: "<u4", 5126: "<f4"}[component])
        if view_at is None:
            return np.zeros((count, width), kind)
        view = scene["bufferViews"][view_at]
        which = view.get("buffer", 0)
        if which not in blobs:
            blobs[which] = buffer(which)
        start, stride, size = start + view.get("byteOffset", 0), view.get("byteStride") or width * kind.itemsize, width * kind.itemsize
        if count and start + stride * (count - 1) + size > len(blobs[which]):
            raise ValueError("an accessor reaches beyond its buffer")
        rows = np.lib.stride_tricks.as_strided(np.frombuffer(blobs[which], np.uint8, offset=start if count else 0), (count, size), (stride, 1))
        return np.array(rows).view(kind).reshape(count, width)

    def accessor(i: int) -> np.ndarray:
        a = scene["accessors"][i]
        width = {"SCALAR": 1, "VEC2": 2, "VEC3": 3, "VEC4": 4}[a["type"]]
        out = elements(a.get("bufferView"), a.get("byteOffset", 0), a["componentType"], a["count"], width)
        if few := a.get("sparse"):
            at, new = few["indices"], few["values"]
            places = elements(at["bufferView"], at.get("byteOffset", 0), at["componentType"], few["count"], 1).ravel()
            out[places] = elements(new["bufferView"], new.get("byteOffset", 0), a["componentType"], few["count"], width)
        # Whole numbers that stand for fractions.
        return np.maximum(out / np.iinfo(out.dtype).max, -1) if a.get("normalized") and out.dtype.kind in "iu" else out

    def local(node: dict) -> np.ndarray:
        if "matrix" in node:
            return np.array(node["matrix"], dtype=float).reshape(4, 4).T
        m = np.eye(4)
        x, y, z, w = node.get("rotation", (0, 0, 0, 1))
        m[:3, :3] = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]]) * np.array(node.get("scale", (1, 1, 1)))
        m[:3, 3] = node.get("translation", (0, 0, 0))
        return m

    places, faces, first = [], [], 0
    todo = [(n, np.eye(4)) for n in scene["scenes"][scene.get("scene", 0)].get("nodes", [])]
    while todo:
        i, above = todo.pop(0)
        node = scene["nodes"][i]
        world = above @ local(node)
        todo += [(c, world) for c in node.get("children", [])]
        for p in scene["meshes"][node["mesh"]]["primitives"] if "mesh" in node else []:
            if p.get("mode", 4) != 4:
                continue
            xyz = accessor(p["attributes"]["POSITION"]).astype(float)
            index = accessor(p["indices"]).ravel().astype(np.int64) if "indices" in p else np.arange(len(xyz))
            places.append(xyz @ world[:3, :3].T + world[:3, 3])
            corners = index.reshape(-1, 3) + first
            # A mirrored node turns its triangles over.
            faces.append(corners[:, [0, 2, 1]] if np.linalg.det(world[:3, :3]) < 0 else corners)
            first += len(xyz)
    return np.concatenate(places or [np.empty((0, 3))]), np.concatenate(faces or [np.empty((0, 3), np.int64)])


def _parsed(name: str, data: bytes) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """(places, faces, further columns: normals and colours from 0 to 1, where the file has them)."""
    kind = name.lower().rsplit(".", 1)[-1]
    if kind == "ply":
        columns, faces = parse_ply(data)
        more = {c: columns[c].astype(float) for c in ("nx", "ny", "nz") if c in columns}
        for c, field in (("r", "red"), ("g", "green"), ("b", "blue")):
            if field in columns:
                v = columns[field]
                more[c] = v / 255 if v.dtype.kind in "iu" or v.max(initial=0) > 1 else v.astype(float)
        return np.stack([columns[c] for c in "xyz"], axis=1).astype(float), faces, more
    if kind == "gltf":
        return *parse_gltf(data, name), {}
    return *{"obj": parse_obj, "stl": parse_stl, "off": parse_off, "glb": parse_glb}[kind](data), {}


def read_mesh(spark: SparkSession, path: str, require_faces: bool = True) -> tuple[DataFrame, DataFrame]:
    """(vertices, triangles) of the mesh files at path; normals and colours (0 to 1) are null where a file has none."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def vertices(batches):
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                places, faces, more = _parsed(name, data)
                if require_faces and not len(faces):
                    raise ValueError(f"{name} has no faces")
                out = pd.DataFrame(places, columns=["x", "y", "z"])
                out.insert(0, "vertex_id", np.arange(len(out)))
                out.insert(0, "file", name)
                for c in ("nx", "ny", "nz", "r", "g", "b"):
                    out[c] = more.get(c)
                yield out

    def triangles(batches):
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                out = pd.DataFrame(_parsed(name, data)[1], columns=["v0", "v1", "v2"])
                out.insert(0, "face_id", np.arange(len(out)))
                out.insert(0, "file", name)
                yield out

    return files.mapInPandas(vertices, "file string, vertex_id bigint, x double, y double, z double, nx double, ny double, nz double, r double, g double, b double"), files.mapInPandas(triangles, "file string, face_id bigint, v0 bigint, v1 bigint, v2 bigint")


def with_normals(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """One model's vertices with normals from its faces where the file has none."""
    from plumbline.operators.mesh import vertex_normals

    made = vertex_normals(triangles, vertices.select("vertex_id", "x", "y", "z")).toDF("vertex_id", "mx", "my", "mz")
    joined = vertices.join(made, "vertex_id", "left")
    return joined.withColumns({f"n{c}": F.coalesce(f"n{c}", f"m{c}") for c in "xyz"}).select(vertices.columns)


def ply_header(n_vertices: int | str, n_faces: int | str, colored: bool) -> str:
    props = "".join(f"property float {c}\n" for c in "xyz") + "".join(f"property uchar {c}\n" for c in (("red", "green", "blue") if colored else ()))
    return f"ply\nformat binary_little_endian 1.0\nelement vertex {n_vertices}\n{props}element face {n_faces}\nproperty list uchar int vertex_indices\nend_header\n"


def ply_bytes(places: np.ndarray, faces: np.ndarray, colors: np.ndarray | None = None) -> bytes:
    """Single-precision coordinates, faces, and colours (0 to 1) if given; no other attributes."""
    fields = [(c, "<f4") for c in "xyz"] + ([(c, "u1") for c in ("red", "green", "blue")] if colors is not None else [])
    table = np.zeros(len(places), dtype=fields)
    for k, c in enumerate("xyz"):
        table[c] = places[:, k]
    for k, c in enumerate(("red", "green", "blue") if colors is not None else ()):
        table[c] = np.clip(np.round(colors[:, k] * 255), 0, 255)
    rows = np.zeros(len(faces), dtype=[("n", "u1"), ("v", "<i4", 3)])
    rows["n"], rows["v"] = 3, faces
    head = ply_header(len(places), len(faces), colors is not None)
    return head.encode() + table.tobytes() + rows.tobytes()


def write_ply(vertices: DataFrame, triangles: DataFrame, path: str) -> None:
    """One PLY file of one model, packed by tasks and published by a rename; vertices (vertex_id, x, y, z) may have r, g and b (0 to 1).

    Vertices stand in the order of vertex_id, triangles of face_id; other columns are left out. A triangle of a vertex that
    isn't there, a null coordinate or a vertex number beyond 32 bits is an error and leaves the file as it was; a null
    colour is black.
    """
    colored = {"r", "g", "b"} <= set(vertices.columns)
    names = {"r": "red", "g": "green", "b": "blue"} if colored else {}
    numbered = ranked(vertices.select("vertex_id", "x", "y", "z", *names), "vertex_id", "place")
    faces = ranked(triangles.select("face_id", *CORNERS), "face_id", "place")
    for c in CORNERS:
        faces = faces.join(numbered.select(F.col("vertex_id").alias(c), F.col("place").alias(f"at_{c}")), c, "left")
    shade = lambda c: F.least(F.greatest(F.rint(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * 255), F.lit(0.0)), F.lit(255.0)).cast("int")
    first = in_order(numbered, "place").select(F.lit(0).alias("part"), "place", *[F.col(c).cast("double").alias(c) for c in "xyz"], *[shade(c).alias(n) for c, n in names.items()])
    second = in_order(faces, "place").select(F.lit(1).alias("part"), "place", *[f"at_{c}" for c in CORNERS])
    layout = [[[c, "<f4"] for c in "xyz"] + [[n, "u1"] for n in names.values()], [["corners", "u1", 3]] + [[f"at_{c}", "<i4"] for c in CORNERS]]
    _write_records(first.unionByName(second, allowMissingColumns=True), path, layout, ply_header("{0}", "{1}", colored))


def _write_records(rows: DataFrame, path: str, layout: list, header: str = "") -> None:
    rows.sparkSession.dataSource.register(RecordSink)
    staging = staging_beside(path)
    try:
        rows.write.format("records").options(path=path, layout=json.dumps(layout), header=header, staging=staging).mode("append").save()
    finally:
        discard(staging)  # Spark doesn't call abort where a stage before the writing one fails


def write_distances(distances: DataFrame, path: str) -> None:
    """A raw file of single-precision numbers in the order of vertex_id, packed by tasks and published by a rename; a null distance is NaN."""
    rows = in_order(ranked(distances.select("vertex_id", "d"), "vertex_id", "place"), "place")
    _write_records(rows.select(F.lit(0).alias("part"), "place", F.coalesce(F.col("d").cast("double"), F.lit(float("nan"))).alias("d")), path, [[["d", "<f4"]]])


def read_distances(spark: SparkSession, path: str) -> DataFrame:
    """vertex_id, d of a raw file of single-precision numbers in vertex order."""

    def rows(batches):
        for pdf in batches:
            for data in pdf["content"]:
                d = np.frombuffer(data, dtype="<f4").astype(float)
                yield pd.DataFrame({"vertex_id": np.arange(len(d)), "d": d})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, "vertex_id bigint, d double")


def distance_bytes(distances: DataFrame) -> bytes:
    """The body of one viewer's answer; files of any size are written by `write_distances`."""
    return distances.orderBy("vertex_id").select(F.col("d").cast("double")).toPandas()["d"].to_numpy().astype("<f4").tobytes()


def aligned_distances(vertices: DataFrame, distances: DataFrame) -> DataFrame:
    """distances of exactly these vertices; a missing or surplus one is an error."""
    odd = vertices.select("vertex_id").join(distances.select("vertex_id", "d"), "vertex_id", "full").filter("d is null").count() + distances.join(vertices, "vertex_id", "left_anti").count()
    if odd:
        raise ValueError(f"{odd} vertices and distances don't match")
    return distances
