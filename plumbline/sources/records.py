"""A sink of one binary file made of fixed-width records: df.write.format("records").

Tasks pack their rows into segments beside the target; the commit puts a header that knows the counts and the segments in
order into one file and renames it, so that readers see the old file or the whole new one. A failed or repeated task leaves
a segment that no commit names; abort and commit remove the staging folder, which the driver makes and no task does, so a
task that outlives its job can't bring it back where folders must be made. Rows come as columns named in the layout, with
part (0, 1, ..: the section of the file) and place (dense from 0 within a section); a task's rows must be of one part and
rise in place without gaps, which `plumbline.operators.ranks` gives. Any file system that pyarrow knows will do. The target
is one sequential file, so the driver copies it once, in pieces of a few MB, and holds no more.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Bytes that the commit copies at once.
PIECE = 4 << 20


def located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def staging_beside(path: str) -> str:
    """A folder of its own for a write to path, on the same file system."""
    return f"{path}.parts-{uuid.uuid4().hex}"


def discard(staging: str) -> None:
    where, folder = located(staging)
    if where.get_file_info(folder).type == fs.FileType.Directory:
        where.delete_dir(folder)


@dataclass
class Segment(WriterCommitMessage):
    part: int
    first: int
    count: int
    name: str


def packed(batch: pa.RecordBatch, fields: list[list[str]]) -> np.ndarray:
    """A batch's records: fields are [column, numpy type] or [text, numpy type, fixed value]; integers are range-checked."""
    out = np.zeros(batch.num_rows, dtype=[(f[0], f[1]) for f in fields])
    for name, kind, *fixed in fields:
        if fixed:
            out[name] = fixed[0]
            continue
        column = batch.column(name)
        if column.null_count:
            raise ValueError(f"a record has no {name}")
        values = column.to_numpy(zero_copy_only=False)
        if np.dtype(kind).kind in "iu" and len(values) and not (np.iinfo(kind).min <= values.min() and values.max() <= np.iinfo(kind).max):
            raise ValueError(f"{name} is beyond what {kind} holds")
        out[name] = values
    return out


class RecordWriter(DataSourceArrowWriter):
    def __init__(self, options: dict) -> None:
        self.path, self.header, self.layout = options["path"], options.get("header", ""), json.loads(options["layout"])
        self.staging = options.get("staging") or staging_beside(self.path)
        where, folder = located(self.staging)
        where.create_dir(folder, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Segment:
        where, folder = located(self.staging)
        name, part, first, count, out = uuid.uuid4().hex, 0, 0, 0, None
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                parts, places = batch.column("part").to_numpy(), batch.column("place").to_numpy()
                if out is None:
                    part, first = int(parts[0]), int(places[0])
                    out = where.open_output_stream(f"{folder}/{name}")
                if (parts != part).any() or (places != np.arange(first + count, first + count + len(places))).any():
                    raise ValueError("a task's records must be of one part and dense in place")
                out.write(packed(batch, self.layout[part]).tobytes())
                count += batch.num_rows
        finally:
            if out is not None:
                out.close()
        return Segment(part, first, count, name)

    def commit(self, messages: list[Segment | None]) -> None:
        segments = sorted((m for m in messages if m is not None and m.count), key=lambda m: (m.part, m.first))
        counts = [0] * len(self.layout)
        for m in segments:
            if m.first != counts[m.part]:
                raise ValueError(f"records {counts[m.part]} to {m.first} of part {m.part} are missing or repeated")
            counts[m.part] += m.count
        where, target = located(self.path)
        folder = located(self.staging)[1]
        with where.open_output_stream(f"{folder}/whole") as out:
            out.write(self.header.format(*counts).encode())
            for m in segments:
                with where.open_input_stream(f"{folder}/{m.name}") as segment:
                    while piece := segment.read(PIECE):
                        out.write(piece)
        if not isinstance(where, fs.LocalFileSystem) and where.get_file_info(target).type == fs.FileType.File:
            where.delete_file(target)  # other systems don't rename over a file
        where.move(f"{folder}/whole", target)
        discard(self.staging)

    def abort(self, messages: list[Segment | None]) -> None:
        discard(self.staging)


class RecordSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "records"

    def writer(self, schema, overwrite: bool) -> RecordWriter:
        return RecordWriter(self.options)
