"""What files say about tables, without reading their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Table, files, size_bytes of each Parquet table below a folder, be it a file or a folder of files. Only the listing is read: content is pruned."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder)
    table = F.regexp_extract("path", r"/([^/]+)\.parquet(?:/[^/]*)?$", 1)
    return listed.select(table.alias("table"), "length").groupBy("table").agg(F.count("*").alias("files"), F.sum("length").alias("size_bytes"))
