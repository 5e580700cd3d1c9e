"""Tables, shared working folder and Arrow helpers of the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that numpy works on at once, so that memory doesn't follow batch or document size.
CHUNK_BYTES = 1 << 20
BATCH_CONF, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, on a local master, one of our own where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = got.get() if got.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='plumbline-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used; removed when the driver ends."""
    path = f"{shared_dir(spark)}/plumbline/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete_quietly, spark, path)
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _delete_quietly(spark: SparkSession, path: str) -> None:
    try:
        delete_path(spark, path)
    except Exception:  # the session may have ended first
        pass


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, computed once and written as Parquet in the shared folder; lineage ends there."""
    return df.sparkSession.read.schema(df.schema).parquet(stored_path(df, name))


def stored_path(df: DataFrame, name: str) -> str:
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return path


def release_shuffles(spark: SparkSession) -> None:
    """Have the driver drop what it no longer refers to, so that executors delete those shuffle files."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def fresh(columns: list[str], *names: str) -> tuple[str, ...]:
    """names, each with as many underscores behind it as it takes to be none of columns."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return tuple(out)


def arrow_map(df: DataFrame, rows: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow with a function of one batch of at most BATCH_ROWS rows; df's columns reach it as they are.

    The session's own batch size is lowered to BATCH_ROWS where it is larger, as workers and executors hold a batch of
    texts as a whole; Spark reads it when the plan runs, so it can't be put back here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from rows(batch)
        give_back()

    return small_batches(df).mapInArrow(run, schema)


def small_batches(df: DataFrame) -> DataFrame:
    """df, its session holding Arrow batches to BATCH_ROWS rows."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(BATCH_CONF)) <= BATCH_ROWS:
        conf.set(BATCH_CONF, str(BATCH_ROWS))
    return df


def give_back() -> None:
    """Returns freed memory to the system at a task's end: Spark keeps its Python workers from stage to stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def text_bytes(column: pa.Array) -> Iterator[bytes]:
    """Each value's UTF-8 bytes; null as empty."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""
