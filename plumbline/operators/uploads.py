"""Resumable uploads as a fold over ordered events: a chunk counts only if it begins where the last one ended.

Events: upload_id, event_id, ts, kind (create, chunk, terminate), at (offset of a chunk), n_bytes, size (of a create).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STATE = "upload_id bigint, status string, offset bigint, size bigint, accepted bigint, refused bigint"


class Upload(NamedTuple):
    status: str = "none"
    offset: int = 0
    size: int = 0
    accepted: int = 0
    refused: int = 0


def step(state: Upload, kind: str, at: int | None, n_bytes: int | None, size: int | None, chunk_limit: int) -> Upload:
    """The state after one event; events that don't fit are refused and change nothing else."""
    if kind == "create" and state.status == "none":
        return state._replace(status="uploading" if size else "queued", size=size or 0)
    if kind == "terminate" and state.status == "uploading":
        return state._replace(status="terminated")
    if kind == "chunk" and state.status == "uploading" and at == state.offset and 0 <= (n_bytes or 0) <= min(chunk_limit, state.size - state.offset):
        offset = state.offset + (n_bytes or 0)
        return state._replace(offset=offset, accepted=state.accepted + 1, status="queued" if offset == state.size else "uploading")
    return state._replace(refused=state.refused + 1)


def fold(events: DataFrame, chunk_limit: int = 64 << 20) -> DataFrame:
    """The last state of every upload: its events, one session's and few, as a sorted array that an expression folds."""
    fields = ("kind", "at", "n_bytes", "size")
    ordered = events.groupBy("upload_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", *fields))).alias("events"))
    nothing = F.struct(F.lit("none").alias("status"), *[F.lit(0).cast("bigint").alias(n) for n in Upload._fields[1:]])

    def after(s: Column, e: Column) -> Column:
        n, size = F.coalesce(e["n_bytes"], F.lit(0)), F.coalesce(e["size"], F.lit(0))
        sending = s["status"] == "uploading"
        begins, stops = (e["kind"] == "create") & (s["status"] == "none"), (e["kind"] == "terminate") & sending
        fits = (e["kind"] == "chunk") & sending & F.coalesce(e["at"] == s["offset"], F.lit(False)) & n.between(F.lit(0), F.least(F.lit(chunk_limit), s["size"] - s["offset"]))
        offset = s["offset"] + F.when(fits, n).otherwise(0)
        status = F.when(begins, F.when(size != 0, "uploading").otherwise("queued")).when(stops, "terminated").when(fits & (offset == s["size"]), "queued").otherwise(s["status"])
        return F.struct(
            status.alias("status"), offset.alias("offset"), F.when(begins, size).otherwise(s["size"]).cast("bigint").alias("size"),
            (s["accepted"] + F.when(fits, 1).otherwise(0)).alias("accepted"), (s["refused"] + F.when(begins | stops | fits, 0).otherwise(1)).alias("refused"),
        )

    return ordered.select("upload_id", F.aggregate("events", nothing, after).alias("s")).select("upload_id", "s.*")


def running_offsets(chunks: DataFrame) -> DataFrame:
    """Each chunk's offset before and after it, chunks in order of time."""
    w = Window.partitionBy("upload_id").orderBy("ts", "event_id")
    after = F.sum("n_bytes").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return chunks.select("upload_id", "event_id", "n_bytes", (after - F.col("n_bytes")).alias("offset_before"), after.alias("offset_after"))


def progress(offsets: DataFrame) -> DataFrame:
    """Percent shown after each chunk: 90 for a whole upload."""
    total = F.max("offset_after").over(Window.partitionBy("upload_id"))
    shown = F.least(F.greatest(F.floor(90 * F.col("offset_after") / F.greatest(total, F.lit(1)) + 0.5), F.lit(0)), F.lit(90))
    return offsets.select("upload_id", "event_id", shown.cast("bigint").alias("progress"))
