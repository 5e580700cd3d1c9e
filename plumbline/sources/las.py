"""LAS point files: spark.read.format("las"), one input partition a range of records.

A record has a fixed width, so any range is read by itself; scale and offset are applied to the integers. Options: path,
records (a partition's records, 1,000,000 unless set), float32 (coordinates rounded to single precision).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from plumbline.sources.files import found, opened

SCHEMA = "file string, point_id bigint, x double, y double, z double"


class LasHeader(NamedTuple):
    version: tuple[int, int]
    first: int
    width: int
    count: int
    scale: tuple[float, float, float]
    offset: tuple[float, float, float]


def read_header(data: bytes) -> LasHeader:
    """Versions 1.0 to 1.4; from 1.4 on the count has 64 bits."""
    if data[:4] != b"LASF":
        raise ValueError("not a LAS file")
    major, minor = data[24], data[25]
    first = struct.unpack_from("<I", data, 96)[0]
    width, count = struct.unpack_from("<HI", data, 105)
    if (major, minor) >= (1, 4) and len(data) >= 255:
        count = struct.unpack_from("<Q", data, 247)[0] or count
    return LasHeader((major, minor), first, width, count, struct.unpack_from("<3d", data, 131), struct.unpack_from("<3d", data, 155))


def coordinates(header: LasHeader, data: bytes) -> np.ndarray:
    """x, y and z of whole records."""
    raw = np.frombuffer(data, dtype=np.uint8).reshape(-1, header.width)[:, :12].copy().view("<i4")
    return raw * np.array(header.scale) + np.array(header.offset)


def write_las(path: str, xyz: np.ndarray, scale: float = 0.001) -> None:
    """A LAS 1.2 file of point format 0, for tests and exports of bounded size."""
    offset = xyz.min(axis=0) if len(xyz) else np.zeros(3)
    whole = np.round((xyz - offset) / scale).astype("<i4")
    head = bytearray(227)
    head[:4], head[24], head[25] = b"LASF", 1, 2
    struct.pack_into("<HII", head, 94, 227, 227, 0)
    struct.pack_into("<BHI", head, 104, 0, 20, len(xyz))
    struct.pack_into("<3d3d", head, 131, scale, scale, scale, *offset)
    body = np.zeros((len(xyz), 20), dtype=np.uint8)
    body[:, :12] = whole.view(np.uint8).reshape(-1, 12)
    with open(path, "wb") as f:
        f.write(bytes(head) + body.tobytes())


class Range(InputPartition):
    def __init__(self, path: str, first: int, n: int, before: int) -> None:
        self.path, self.first, self.n, self.before = path, first, n, before


class LasReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.records, self.float32 = options["path"], int(options.get("records", 1_000_000)), options.get("float32", "false").lower() == "true"

    def partitions(self) -> list[Range]:
        out, before = [], 0
        for path, _ in found(self.path, ".las"):
            with opened(path) as f:
                count = read_header(f.read(375)).count
            out += [Range(path, a, min(self.records, count - a), before + a) for a in range(0, count, self.records)]
            before += count
        return out or [Range("", 0, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.n:
            return
        with opened(part.path) as f:
            header = read_header(f.read(375))
            for a in range(0, part.n, 65_536):
                n = min(65_536, part.n - a)
                f.seek(header.first + (part.first + a) * header.width)
                xyz = coordinates(header, f.read(n * header.width))
                if self.float32:
                    xyz = xyz.astype(np.float32).astype(np.float64)
                ids = np.arange(part.before + a, part.before + a + len(xyz))
                yield pa.RecordBatch.from_arrays([pa.array([part.path] * len(xyz)), pa.array(ids), *[pa.array(xyz[:, k]) for k in range(3)]], names=["file", "point_id", "x", "y", "z"])


class LasSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LasReader:
        return LasReader(self.options)


def read_las(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(LasSource)
    return spark.read.format("las").options(**options).load(path)


def point_count(path: str) -> int:
    """From the headers alone."""
    total = 0
    for name, _ in found(path, ".las"):
        with opened(name) as f:
            total += read_header(f.read(375)).count
    return total
