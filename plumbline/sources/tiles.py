"""Tile sets, point tiles and model metadata."""

from __future__ import annotations

import json
import posixpath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType, StructField, StructType

from plumbline.functions.geometry import multiply
from plumbline.store import stored

#: How deep tile sets may refer to further ones.
DEPTH = 64


def uint32(content: Column, at: int) -> Column:
    byte = lambda i: F.conv(F.hex(F.substring(content, at + 1 + i, 1)), 16, 10).cast("bigint")
    return byte(0) + byte(1) * 256 + byte(2) * 65536 + byte(3) * 16777216


def valid_pnts(content: Column) -> Column:
    """Magic and version, sections that add up to the file, and a positive whole number of points."""
    sections = uint32(content, 12) + uint32(content, 16) + uint32(content, 20) + uint32(content, 24)
    head = F.substring(content, F.lit(29), uint32(content, 12).cast("int")).cast("string")
    n = F.get_json_object(head, "$.POINTS_LENGTH").try_cast("double")
    ok = (F.length(content) >= 28) & (F.substring(content, 1, 4) == F.lit(b"pnts")) & (uint32(content, 4) == 1) & (uint32(content, 8) == F.length(content)) & (sections + 28 == F.length(content)) & (n > 0) & (n == F.floor(n))
    return F.coalesce(ok, F.lit(False))


def tile_uris(node: dict) -> list[str]:
    """Addresses of the contents of a tile and of all below it."""
    out, todo = [], [node]
    while todo:
        tile = todo.pop()
        for content in [tile.get("content"), *(tile.get("contents") or [])]:
            if isinstance(content, dict) and (uri := content.get("uri") or content.get("url")):
                out.append(uri)
        todo += [c for c in tile.get("children") or [] if isinstance(c, dict)]
    return out


def tile_files(spark: SparkSession, folder: str, root: str = "tileset.json") -> DataFrame:
    """path, depth of all tile contents that a tile set leads to; external tile sets are followed level by level, each once."""
    texts = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(folder).select(F.regexp_replace("path", "^.*" + posixpath.basename(folder.rstrip("/")) + "/", "").alias("path"), F.col("content").cast("string").alias("text"))

    def leads_to(path: str, text: str) -> list[str]:
        try:
            base, root = posixpath.dirname(path), json.loads(text).get("root") or {}
        except (ValueError, AttributeError):
            return []
        found = [posixpath.normpath(posixpath.join(base, u.split("?")[0])) for u in tile_uris(root)]
        return [f for f in found if not f.startswith("..")]

    @F.pandas_udf("array<string>")
    def uris(paths: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([leads_to(p, t) for p, t in zip(paths, texts, strict=True)])

    links = stored(texts.select("path", F.explode(uris("path", "text")).alias("to")), "links")
    level, every, depth = spark.createDataFrame([(root,)], "path string"), None, 0
    while depth < DEPTH:
        found = links.join(level, "path", "left_semi").select(F.col("to").alias("path")).distinct()
        if every is not None:
            found = found.join(every.select("path"), "path", "left_anti")
        found = stored(found.withColumn("depth", F.lit(depth)), "tiles")
        if found.isEmpty():
            break
        every = found if every is None else every.unionAll(found)
        level, depth = found.filter(F.col("path").endswith(".json")).select("path"), depth + 1
    return every if every is not None else spark.createDataFrame([], "path string, depth int")


def has_valid_tile(spark: SparkSession, folder: str) -> bool:
    """Whether a tile set leads to any valid point tile."""
    tiles = tile_files(spark, folder).filter(F.col("path").endswith(".pnts")).select("path")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pnts").load(folder)
    files = files.select(F.regexp_replace("path", "^.*" + posixpath.basename(folder.rstrip("/")) + "/", "").alias("path"), valid_pnts(F.col("content")).alias("ok"))
    return bool(tiles.join(files, "path").agg(F.bool_or("ok")).first()[0])


METADATA = StructType([StructField("elements", MapType(StringType(), StructType([StructField(c, StringType()) for c in ("stepId", "id", "name", "type")])))])


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """element_id, step_id, id, name, type of a model's metadata file."""
    rows = spark.read.option("multiLine", True).schema(METADATA).json(path)
    return rows.select(F.explode("elements").alias("element_id", "e")).select("element_id", F.col("e.stepId").cast("int").alias("step_id"), "e.id", "e.name", "e.type")


def valid_artifact(name: Column, length: Column, content: Column) -> Column:
    """Whether a produced file can be what its name says: size, magic or JSON, and no placeholder text."""
    text = content.cast("string")
    demo = F.lower(text).contains("demo")
    return (
        F.when(name.endswith(".glb"), (length >= 32) & (F.substring(content, 1, 4) == F.lit(b"glTF")))
        .when(name.endswith("tileset.json"), (length >= 256) & F.try_parse_json(text).isNotNull() & ~demo)
        .when(name.endswith(".json"), F.try_parse_json(text).isNotNull() & ~demo)
        .otherwise(length > 0)
    )


def world_matrices(nodes: DataFrame) -> DataFrame:
    """node_id, matrix in world coordinates of a scene's nodes (node_id, unique; parent_id; matrix).

    Each node points to a node above it and holds the product of the matrices from below there down to itself. A round lets it point
    to where that one points, so that rounds follow the logarithm of the depth. Nodes below one that is missing are left out; a cycle is an error.
    """
    state = stored(nodes.select("node_id", F.col("parent_id").alias("up"), "matrix"), "nodes")
    open_ = state.filter("up is not null").count()
    while open_:
        above = state.select(F.col("node_id").alias("up"), F.col("up").alias("next"), F.col("matrix").alias("above"))
        moved = state.join(above, "up").select("node_id", F.col("next").alias("up"), multiply(F.col("above"), F.col("matrix")).alias("matrix"))
        state, before = stored(state.filter("up is null").unionAll(moved), "nodes"), open_
        open_ = state.filter("up is not null").count()
        if open_ == before:  # in every round the nearest to a root, or to a gap, comes to its end
            raise ValueError(f"{open_} nodes are in a cycle or below one")
    return state.select("node_id", "matrix")
