"""What the operators of this package share: the shared folder, written tables, row order keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.storage import shared_dir, written  # noqa: F401

#: Prefix of the columns that operators add while they work; they are dropped from every result.
OWN = "__tm_"
SPLITS = "spark.sql.files.minPartitionNum"
LAST_ID = 9223372036854775807


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` and a number of each row by its place in the table, the same in each read of it.

    How Spark cuts files into partitions depends on the number of cores that are alive, unless ``spark.sql.files.minPartitionNum`` is set. It is set
    here, once a session, to what it would be now: an executor that is lost between two reads then changes no number.
    """
    spark = df.sparkSession
    if spark.conf.get(SPLITS, None) is None:
        spark.conf.set(SPLITS, str(spark.sparkContext.defaultParallelism))
    return df.withColumn(name, F.monotonically_increasing_id())


def order_id(col: Column | str) -> Column:
    """An id as a sort key: null comes last."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(LAST_ID)).cast("long")


def plain_id(col: Column | str) -> Column:
    """The id that :func:`order_id` came from."""
    col = F.col(col) if isinstance(col, str) else col
    return F.when(col != LAST_ID, col)
