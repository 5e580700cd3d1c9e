"""The upload state machine and remesh time-outs over streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plumbline.operators.uploads import STATE, Upload, step

_SAVED = "status string, offset bigint, size bigint, accepted bigint, refused bigint"


def upload_states(events: DataFrame, chunk_limit: int = 64 << 20, idle_ms: int = 30 * 60 * 1000) -> DataFrame:
    """A stream of each upload's state after every batch that has events of it; an upload idle for too long ends as failed.

    State is one small row an upload, keyed by upload_id, kept in the query's checkpoint.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = Upload(*state.get) if state.exists else Upload()
        if state.hasTimedOut:
            state.remove()
            if now.status == "uploading":
                yield pd.DataFrame([[key[0], *now._replace(status="failed")]], columns=["upload_id", *Upload._fields])
            return
        rows = pd.concat(list(batches))
        for r in rows.sort_values(["ts", "event_id"]).itertuples():
            now = step(now, r.kind, None if pd.isna(r.at) else int(r.at), None if pd.isna(r.n_bytes) else int(r.n_bytes), None if pd.isna(r.size) else int(r.size), chunk_limit)
        state.update(tuple(now))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame([[key[0], *now]], columns=["upload_id", *Upload._fields])

    return events.groupBy("upload_id").applyInPandasWithState(run, STATE, _SAVED, "update", GroupStateTimeout.ProcessingTimeTimeout)


def bytes_per_window(events: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Bytes and chunks of each upload and window of event time; what is later than the watermark is left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "upload_id").agg(F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n_chunks")).select("upload_id", F.col("w.start").alias("start"), "n_bytes", "n_chunks")
