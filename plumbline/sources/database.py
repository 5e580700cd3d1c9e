"""Catalogue tables in a relational database, PostgreSQL, MySQL or any other that Spark has a driver for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Connections at once: as many as the partitions that read.
READERS = 10


def read_table(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, readers: int = READERS, **options: str) -> DataFrame:
    """A table whose filters, columns, limits and sums Spark pushes to the database.

    With a whole-number key and its bounds, readers connections read ranges of it side by side; rows beyond the bounds
    belong to the first and last range.
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).option("pushDownPredicate", "true").option("pushDownLimit", "true").option("pushDownAggregate", "true")
    if key and bounds:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", readers)
    return reader.options(**options).load()


def write_table(rows: DataFrame, url: str, table: str, **options: str) -> None:
    """rows as a new table, or in place of all rows of one that is there; its columns' types stay."""
    rows.write.format("jdbc").option("url", url).option("dbtable", table).option("truncate", "true").options(**options).mode("overwrite").save()
