"""Dense ranks of a whole table without a window over all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.store import stored


def ranked(rows: DataFrame, key: str, name: str) -> DataFrame:
    """rows with name: their dense place from 0 by key (unique; null first).

    Rows are parted by ranges of the key and written; a range's ranks begin after the counts of the ranges before, of which
    there are as many as partitions. A key that isn't unique gives its rows places of their own in no stated order.
    """
    dealt = stored(rows.repartitionByRange(key).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("_range").count()
    before = counts.select("_range", (F.sum("count").over(Window.orderBy("_range")) - F.col("count")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(key)) - 1
    return dealt.join(F.broadcast(before), "_range").select(*rows.columns, (F.col("_before") + inside).cast("bigint").alias(name))


def in_order(ranked_rows: DataFrame, name: str) -> DataFrame:
    """Rows dealt by ranges of a dense rank, each partition in order and without gaps."""
    return ranked_rows.repartitionByRange(name).sortWithinPartitions(name)
