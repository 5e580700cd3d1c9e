"""Digests of files of any size: spark.read.format("digests").

A file is read by one task, a piece at a time, as MD5 takes its bytes in order; files run side by side, small ones several
to a task. Options: path (a file or a folder; names that begin with _ or . are passed over, as Spark does), piece (bytes
read at once, 2 MiB unless set, held between 512 KiB and 10 MiB), pack (bytes of small files a task takes, 256 MiB).

Rows: a `progress` row for each piece, with the whole percentage done; then one `success` row with the digest. An empty file
has one `error` row. A file that can't be read fails its task, which Spark repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from plumbline.sources.files import found, opened

# Bounds of a piece that results must equal.
PIECE, LEAST_PIECE, MOST_PIECE = 2 << 20, 512 << 10, 10 << 20
SCHEMA = "file string, n_bytes bigint, state string, piece bigint, progress int, digest string, error string"
#: Rows of a batch.
BATCH = 4096


def piece_bytes(wanted: int) -> int:
    return max(LEAST_PIECE, min(MOST_PIECE, wanted))


def steps(path: str, n_bytes: int, piece: int) -> Iterator[tuple]:
    """The rows of one file; no more than one piece is held."""
    if not n_bytes:
        yield path, 0, "error", None, None, None, "the file is empty"
        return
    digest, total = hashlib.md5(usedforsecurity=False), -(-n_bytes // piece)
    with opened(path) as f:
        for k in range(total):
            wanted = min(piece, n_bytes - k * piece)
            data = f.read(wanted)
            if len(data) != wanted:
                raise OSError(f"{path} has become shorter while it was read")
            digest.update(data)
            yield path, n_bytes, "progress", k, (k + 1) * 100 // total, None, None
    yield path, n_bytes, "success", None, 100, digest.hexdigest(), None


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]) -> None:
        self.files = files


def packs(files: list[tuple[str, int]], most: int) -> list[list[tuple[str, int]]]:
    """Files in order, in groups of at most so many bytes and 1,000 files; a larger file is alone."""
    out, held = [], 0
    for path, n in files:
        if not out or held + n > most or len(out[-1]) == 1000:
            out.append([])
            held = 0
        out[-1].append((path, n))
        held += n
    return out


class DigestReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.piece, self.pack = options["path"], piece_bytes(int(options.get("piece", PIECE))), int(options.get("pack", 256 << 20))

    def partitions(self) -> list[Files]:
        files = [(p, n) for p, n in found(self.path, "") if p == self.path or not p.rsplit("/", 1)[-1].startswith(("_", "."))]
        return [Files(group) for group in packs(files, self.pack)] or [Files([])]

    def read(self, part: Files) -> Iterator[pa.RecordBatch]:
        rows = []
        for path, n in part.files:
            for row in steps(path, n, self.piece):
                rows.append(row)
                if len(rows) == BATCH:
                    yield self._batch(rows)
                    rows = []
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string())
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


class DigestSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "digests"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DigestReader:
        return DigestReader(self.options)


def read_digests(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(DigestSource)
    return spark.read.format("digests").options(**options).load(path)
