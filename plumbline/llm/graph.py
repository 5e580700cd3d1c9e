"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import delete_path, new_path


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of edges (a, b); root: the least node that is linked with it, itself included.

    Each step keeps one row an edge and writes its result in the shared folder. A node with many edges is a skewed join
    key that adaptive execution splits; its least neighbour is pre-aggregated.
    """
    spark = edges.sparkSession
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    path = new_path(spark, name)
    now.write.parquet(path)
    done = None
    while True:
        now = spark.read.schema("a bigint, b bigint").parquet(path)
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum("b")).first()
        if state == done:
            break
        done = state
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("u")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = large.join(least, F.col("a") == F.col("u")).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        old, path = path, new_path(spark, name)
        small.filter("a <> b").distinct().write.parquet(path)
        delete_path(spark, old)
    linked = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return linked.unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
