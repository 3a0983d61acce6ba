"""Events and links side by side: tables bucketed by EventId, so that joins on it exchange nothing.

A table is written once, one file a bucket and sorted within, and rows that come later are added to the same buckets. What joins is any function over the two
DataFrames: over other DataFrames it shuffles, over these Spark reads bucket by bucket. The catalog holds the layout; where it does not outlive a session,
:func:`attach` names the files again.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

#: What a bucket should hold, so that a task sorts it in memory. Counts are powers of two: of two tables the smaller can have fewer buckets, and Spark reads some of the larger's together.
BUCKET_BYTES, FEWEST, MOST = 256 << 20, 8, 1 << 16


def bucket_count(size_bytes: int) -> int:
    """Buckets for a table of so many bytes on disk: a power of two."""
    wanted = max(1, math.ceil(size_bytes / BUCKET_BYTES))
    return min(MOST, max(FEWEST, 1 << (wanted - 1).bit_length()))


def _checked(rows: DataFrame, key: str, buckets: int) -> None:
    if not FEWEST <= buckets <= MOST or buckets & (buckets - 1):
        raise ValueError(f"a power of two from {FEWEST} to {MOST} buckets")
    if key not in rows.columns:
        raise ValueError(f"the table has no column {key}")


def lay_out(rows: DataFrame, table: str, path: str, buckets: int, key: str = "EventId") -> DataFrame:
    """Writes ``rows`` as a table with files below ``path``. Null keys share a bucket and join with nothing; an empty table has no file."""
    _checked(rows, key, buckets)
    rows.repartition(buckets, key).write.format("parquet").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    return rows.sparkSession.table(table)


def add(rows: DataFrame, table: str, buckets: int, key: str = "EventId") -> DataFrame:
    """Adds rows, with the table's columns in any order, as one more file in each bucket that gets some. Only the new rows are shuffled."""
    spark = rows.sparkSession
    _checked(rows, key, buckets)
    rows.select(spark.table(table).columns).repartition(buckets, key).write.mode("append").format("parquet").bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    spark.catalog.refreshTable(table)
    return spark.table(table)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def attach(spark: SparkSession, table: str, path: str, buckets: int, key: str = "EventId") -> DataFrame:
    """Names the files that an earlier session laid out; ``buckets`` and ``key`` are as they were then."""
    files = spark.read.parquet(path)
    _checked(files, key, buckets)
    columns = ", ".join(f"{_quoted(f.name)} {f.dataType.simpleString()}" for f in files.schema)
    location = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE {_quoted(table)} ({columns}) USING parquet LOCATION '{location}' CLUSTERED BY ({_quoted(key)}) SORTED BY ({_quoted(key)}) INTO {buckets} BUCKETS")
    return spark.table(table)
